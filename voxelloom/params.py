"""Parameters of a map and of its sensors, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Class slots of a cell, the number of an empty slot, the prior of a slot.
K_TOP, EMPTY, ALPHA = 2, 65535, 0.01


@dataclass(frozen=True)
class MapParams:
    resolution: float = 0.10
    num_classes: int = 14
    alpha: float = ALPHA
    w_occ: float = 1.0
    w_free: float = 0.5
    kappa: float = 1.0
    saturation: float = 0.0
    min_p_occ: float = 0.5
    mode: str = "dirichlet"
    trunc: float = 0.30
    carving: bool = False
    decay: float = 0.8
    min_range: float = 0.3
    max_range: float = 10.0
    range_decay: float = -1.0

    @property
    def prior_other(self) -> float:
        return max(0, self.num_classes - K_TOP) * self.alpha

    def sanitised(self) -> MapParams:
        """Values that cannot work are replaced: lengths and weights are not negative,
        rates and gates lie in [0, 1], a truncation of 0 becomes 0.15."""
        unit = lambda x: min(1.0, max(0.0, x))
        return replace(
            self, resolution=self.resolution if self.resolution > 0 else 0.10, num_classes=max(1, self.num_classes), w_occ=max(0.0, self.w_occ), w_free=max(0.0, self.w_free), kappa=max(0.0, self.kappa),
            saturation=max(0.0, self.saturation), min_p_occ=unit(self.min_p_occ), decay=unit(self.decay), trunc=self.trunc if self.trunc > 0 else 0.15,
        )


@dataclass(frozen=True)
class SensorProfile:
    """Weights of one kind of sensor; a None takes the map's value."""

    name: str
    w_occ: float | None = None
    w_free: float | None = None
    kappa: float | None = None
    min_p_occ: float | None = None
    kernel_radius: float = 0.0


#: A scanner that shapes the map, and a camera that only labels what is occupied.
LIDAR = SensorProfile("lidar")
CAMERA = SensorProfile("camera", w_occ=0.0, w_free=0.0, min_p_occ=0.55)
