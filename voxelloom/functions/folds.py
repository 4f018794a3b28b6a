"""Ordered folds over the observations of a cell, as Catalyst aggregates.

A state is a struct (a_occ, a_free, other, cls0, cnt0, cls1, cnt1, ...); an event a
struct whose first fields give its place in the order. Nothing runs outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ALPHA, EMPTY, K_TOP
from .scalar import lit


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), lit(0))


def empty_slots(prior_other: float, alpha: float = ALPHA) -> Column:
    """The state of a cell without class evidence; counters of branches start at 0."""
    fields = [lit(float(prior_other)).alias("other")]
    for k in range(K_TOP):
        fields += [lit(EMPTY).alias(f"cls{k}"), lit(float(alpha)).alias(f"cnt{k}")]
    return F.struct(*fields, *[lit(0).alias(n) for n in ("n_match", "n_empty", "n_evict", "n_drop")])


def slot_add(s: Column, c: Column, inc: Column, alpha: float = ALPHA) -> Column:
    """Adds evidence for a class to a state: EMPTY goes to OTHER, a tracked class
    grows, an empty slot is filled, the weakest slot gives way to more evidence than
    its own, and what is left goes to OTHER."""
    cls, cnt = [s[f"cls{k}"] for k in range(K_TOP)], [s[f"cnt{k}"] for k in range(K_TOP)]
    known, free = lit(-1), lit(-1)
    for k in reversed(range(K_TOP)):
        known = F.when(cls[k] == c, k).otherwise(known)
        free = F.when(cls[k] == EMPTY, k).otherwise(free)
    weak, least = lit(0), cnt[0]
    for k in range(1, K_TOP):
        weak, least = F.when(cnt[k] < least, k).otherwise(weak), F.least(least, cnt[k])
    held = F.greatest(lit(0.0), least - alpha)
    none = c == EMPTY
    branch = F.when(none, 0).when(known >= 0, 1).when(free >= 0, 2).when(inc > held, 3).otherwise(4)
    target = F.when(branch == 1, known).when(branch == 2, free).when(branch == 3, weak).otherwise(-1)
    fields = [(s["other"] + F.when(branch == 3, held).when((branch == 0) | (branch == 4), inc).otherwise(0.0)).alias("other")]
    for k in range(K_TOP):
        fields.append(F.when((target == k) & (branch > 1), c).otherwise(cls[k]).alias(f"cls{k}"))
        fields.append(F.when(target != k, cnt[k]).when(branch == 1, cnt[k] + inc).otherwise(alpha + inc).alias(f"cnt{k}"))
    counters = [(s[n] + (branch == b).cast("int")).alias(n) for n, b in (("n_match", 1), ("n_empty", 2), ("n_evict", 3), ("n_drop", 4))]
    return F.struct(*fields, *counters)


def fold_slots(events: Column, prior_other: float, alpha: float = ALPHA) -> Column:
    """Folds an array of struct(.., cls, inc), which is first sorted."""
    return F.aggregate(F.array_sort(events), empty_slots(prior_other, alpha), lambda s, e: slot_add(s, e["cls"], e["inc"], alpha))


def fold_branches(events: Column, prior_other: float, alpha: float = ALPHA) -> Column:
    """What became of the evidence of each frame: an array of struct(frame_id, n_match,
    n_empty, n_evict, n_drop), one for each frame with events struct(frame_id, .., cls, inc)."""
    names = ("n_match", "n_empty", "n_evict", "n_drop")
    entry = lambda f, d: F.struct(f.alias("frame_id"), *[d[n].alias(n) for n in names])
    none = F.array().cast("array<struct<frame_id:int,n_match:int,n_empty:int,n_evict:int,n_drop:int>>")
    init = F.struct(empty_slots(prior_other, alpha).alias("d"), none.alias("out"))

    def step(s, e):
        def put(d):
            last = F.try_element_at(s["out"], lit(-1))
            same = F.coalesce(last["frame_id"] == e["frame_id"], lit(False))
            kept = F.when(same, F.slice(s["out"], lit(1), F.greatest(F.size(s["out"]) - 1, lit(0)))).otherwise(s["out"])
            return F.struct(d.alias("d"), F.concat(kept, F.array(entry(e["frame_id"], d))).alias("out"))

        return let(slot_add(s["d"], e["cls"], e["inc"], alpha), put)

    counted = F.aggregate(F.array_sort(events), init, step)["out"]
    return let(counted, lambda c: F.transform(c, lambda x, i: F.struct(x["frame_id"].alias("frame_id"), *[(x[n] - F.when(i > 0, F.get(c, i - 1)[n]).otherwise(0)).alias(n) for n in names])))


def fold_naive(events: Column, prior_other: float, alpha: float = ALPHA) -> Column:
    """The last class wins: every filled slot's evidence goes to OTHER first."""

    def step(s, e):
        moved = lit(0.0)
        for k in range(K_TOP):
            moved = moved + F.when(s[f"cls{k}"] != EMPTY, s[f"cnt{k}"] - alpha).otherwise(0.0)
        fields = [(s["other"] + moved).alias("other"), e["cls"].alias("cls0"), lit(alpha + 1.0).alias("cnt0")]
        for k in range(1, K_TOP):
            fields += [lit(EMPTY).alias(f"cls{k}"), lit(float(alpha)).alias(f"cnt{k}")]
        return F.struct(*fields, *[s[n].alias(n) for n in ("n_match", "n_empty", "n_evict", "n_drop")])

    return F.aggregate(F.array_sort(events), empty_slots(prior_other, alpha), step)


def fold_parts(events: Column, cap: float, prior_other: float, alpha: float = ALPHA) -> Column:
    """The whole update of a cell under saturation. Events are struct(frame_id, phase,
    seq, q, o, w, parts, kappa, min_p): phase 1 a hit of quality q that adds o, with its
    classes as parts (cls, share), phase 2 a frame's carve of weight w. Counters are
    scaled to the cap after each step; a hit's class evidence is kappa * p * q, with
    the occupancy p after the hit, where p reaches min_p."""
    names = ["n_match", "n_empty", "n_evict", "n_drop"]
    start = empty_slots(prior_other, alpha)
    init = F.struct(lit(1.0).alias("a_occ"), lit(1.0).alias("a_free"), start.alias("d"))

    def capped_beta(s, e):
        raw = F.struct((s["a_occ"] + e["o"]).alias("o"), (s["a_free"] + e["w"]).alias("f"))
        scale = lambda b: F.when(b["o"] + b["f"] > cap, cap / (b["o"] + b["f"])).otherwise(1.0) if cap > 0 else lit(1.0)
        return let(raw, lambda b: F.struct((b["o"] * scale(b)).alias("o"), (b["f"] * scale(b)).alias("f")))

    def capped_dir(d):
        mass = d["other"]
        for k in range(K_TOP):
            mass = mass + d[f"cnt{k}"]
        ds = F.when(mass > cap, cap / mass).otherwise(1.0) if cap > 0 else lit(1.0)
        fields = [(d["other"] * ds).alias("other")]
        for k in range(K_TOP):
            n = d[f"cnt{k}"] * ds
            fields += [d[f"cls{k}"].alias(f"cls{k}"), F.when(d[f"cls{k}"] != EMPTY, F.greatest(n, lit(alpha))).otherwise(n).alias(f"cnt{k}")]
        return F.struct(*fields, *[d[n].alias(n) for n in names])

    def step(s, e):
        def with_beta(b):
            p = b["o"] / (b["o"] + b["f"])
            inc = e["kappa"] * p * e["q"]
            seen = (e["phase"] == 1) & (p >= e["min_p"]) & (inc > 0)
            parts = F.filter(e["parts"], lambda x: (x["cls"] == EMPTY) | (x["share"] > 0))
            d = F.when(seen, F.aggregate(parts, s["d"], lambda d, x: slot_add(d, x["cls"], inc * x["share"], alpha))).otherwise(s["d"])
            return F.struct(b["o"].alias("a_occ"), b["f"].alias("a_free"), let(d, lambda d: F.when(seen, capped_dir(d)).otherwise(d)).alias("d"))

        return let(capped_beta(s, e), with_beta)

    return F.aggregate(F.array_sort(events), init, step)


def fold_cell(events: Column, w_occ: float, kappa: float, cap: float, min_p: float, prior_other: float, alpha: float = ALPHA) -> Column:
    """fold_parts() of events struct(frame_id, phase, seq, cls, q, w) with one class each."""
    whole = F.transform(
        events,
        lambda e: F.struct(
            e["frame_id"].alias("frame_id"), e["phase"].alias("phase"), e["seq"].alias("seq"), e["q"].alias("q"), F.when(e["phase"] == 1, w_occ * e["q"]).otherwise(0.0).alias("o"), F.when(e["phase"] == 1, 0.0).otherwise(e["w"]).alias("w"),
            F.array(F.struct(e["cls"].alias("cls"), lit(1.0).alias("share"))).alias("parts"), lit(float(kappa)).alias("kappa"), lit(float(min_p)).alias("min_p"),
        ),
    )
    return fold_parts(whole, cap, prior_other, alpha)


def merge_slots(a: Column, b: Column, prior_other: float, alpha: float = ALPHA) -> Column:
    """The consensus of two class states: OTHER adds up less one prior; slots of one
    class add up less one prior; the largest K stay and the rest goes to OTHER."""
    slot = lambda s, k: F.struct(s[f"cls{k}"].alias("cls"), s[f"cnt{k}"].alias("cnt"))
    filled = lambda s: F.filter(F.array(*[slot(s, k) for k in range(K_TOP)]), lambda x: x["cls"] != EMPTY)
    left, right = filled(a), filled(b)
    other_of = lambda x, side: F.aggregate(F.filter(side, lambda y: y["cls"] == x["cls"]), lit(0.0), lambda t, y: t + y["cnt"] - alpha)
    both = F.transform(left, lambda x: F.struct((-(x["cnt"] + other_of(x, right))).alias("o"), x["cls"].alias("cls")))
    alone = F.filter(right, lambda y: ~F.exists(left, lambda x: x["cls"] == y["cls"]))
    ranked = F.array_sort(F.concat(both, F.transform(alone, lambda y: F.struct((-y["cnt"]).alias("o"), y["cls"].alias("cls")))))
    tail = F.aggregate(F.slice(ranked, K_TOP + 1, 2 * K_TOP), lit(0.0), lambda t, x: t + F.greatest(lit(0.0), -x["o"] - alpha))
    fields = [(F.greatest(lit(float(prior_other)), a["other"] + b["other"] - prior_other) + tail).alias("other")]
    for k in range(K_TOP):
        x = F.get(ranked, k)
        fields += [F.coalesce(x["cls"], lit(EMPTY)).alias(f"cls{k}"), F.coalesce(F.greatest(lit(alpha), -x["o"]), lit(float(alpha))).alias(f"cnt{k}")]
    return F.struct(*fields)


def fold_decay(events: Column, rate: float, until: Column, eps: float = 1e-3) -> Column:
    """A counter above 1 that fades by `rate` each frame before the frame's increments,
    and is forgotten once it is within eps of 1. events: struct(frame_id, inc), one a
    frame. The state after `until`, decayed up to it; null if forgotten."""

    def faded(s, frame):
        left = s["x"] * F.pow(lit(rate), (frame - s["f"]).cast("double"))
        return F.when(left < eps, 0.0).otherwise(left)

    init = F.struct(lit(0.0).alias("x"), lit(0).alias("f"))
    step = lambda s, e: F.struct((faded(s, e["frame_id"]) + e["inc"]).alias("x"), e["frame_id"].alias("f"))
    return let(F.aggregate(F.array_sort(events), init, step), lambda s: let(faded(s, until), lambda x: F.when(x > 0, 1 + x)))
