"""URL filters by a bit-parallel wildcard automaton.

Glob rules (`*` any run, `?` any byte) are packed side by side into the words
of one Shift-And mask. Bit j of a rule says that its first j tokens match the
bytes read so far; a star makes the bit before it hold on any byte. All rules
advance together, one byte of all URLs of a batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Stands between host and path; no UTF-8 text holds this byte.
SEP = 0xFF
#: Fixed values of the contract: rule (host, then path) and verdict.
BASE_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The method's own rules for urls that no base rule fits: globs for host and path; they block. A word must
#: be a whole label of the host or part of one between hyphens.
BLOCK_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")
BLOCK_GLOBS = tuple((f"*{a}{w}{z}*", "*") for w in BLOCK_WORDS for a in ".-" for z in ".-") + (("*.doubleclick.*", "*"), ("*", "*/wp-login.php*"), ("*", "*/cgi-bin/*"))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the contract has them; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    k = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:k], rest[k:]
    e = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:e]


def canonical(host: str, path: str) -> bytes:
    """`.host`, the separator, and the path: what the automaton reads."""
    return b"." + host.encode() + bytes([SEP]) + path.encode()


def rule_tokens(host: str, path: str) -> list[int | None]:
    """Bytes of a glob over a canonical url; None is a star, -1 any byte but the separator."""
    one = {"*": None, "?": -1}
    text = [*host, "\0sep", *path]
    out: list[int | None] = []
    for c in text:
        if c == "\0sep":
            out.append(SEP)
        elif c in one:
            out.append(one[c])
        else:
            out += list(c.encode())
    return out


class ShiftAnd:
    """All rules at once. Rules are token lists of rule_tokens()."""

    def __init__(self, rules: list[list[int | None]]):
        bits = sum(1 + sum(t is not None for t in r) for r in rules)
        self.words = max(1, -(-bits // 64))
        step, hold, begin = [0] * 256, 0, 0
        self.accept: list[int] = []
        at = 0
        for r in rules:
            begin |= 1 << at
            for t in r:
                if t is None:
                    hold |= 1 << at
                    continue
                at += 1
                for b in range(256) if t == -1 else (t,):
                    if t != -1 or b != SEP:
                        step[b] |= 1 << at
            self.accept.append(at)
            at += 1
        cut = lambda x: np.array([(x >> (64 * k)) & (2**64 - 1) for k in range(self.words)], np.uint64)
        self.step, self.hold, self.begin = np.stack([cut(x) for x in step]), cut(hold), cut(begin)

    def run(self, urls: list[bytes]) -> np.ndarray:
        """A boolean for each url and rule."""
        n = len(urls)
        length = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-length, kind="stable")
        data = np.frombuffer(b"".join(urls), np.uint8)
        start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)[order] if n else np.zeros(0, np.int64)
        length = length[order]
        state = np.tile(self.begin, (n, 1))
        left = np.searchsorted(-length, -np.arange(length[0] if n else 0), side="left")  # urls longer than t
        for t, k in enumerate(left.tolist()):
            s = state[:k]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.step[data[start[:k] + t]]) | (s & self.hold)
        out = np.zeros((n, len(self.accept)), bool)
        for j, a in enumerate(self.accept):
            out[order, j] = (state[:, a // 64] >> np.uint64(a % 64)) & np.uint64(1)
        return out


def url_verdicts(pages: DataFrame, base=BASE_RULES, globs=BLOCK_GLOBS, default: str = "allow") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, glob) for each row of pages.

    The longest base rule that fits names rule and verdict; else the first glob
    that fits blocks (glob tells which); else the verdict is `default`. A null
    url, or one without `://`, has an empty host and path and fits no rule of a
    host. Repeated rows are judged each by itself; other columns are ignored.
    """
    base = [(h, *r.partition("/"), v) for r, v in base for h in [r]]
    rules = [rule_tokens(f"*.{host}", f"{slash}{path}*") for _, host, slash, path, _ in base] + [rule_tokens(f"*{h}" if not h.startswith("*") else h, p) for h, p in globs]
    names = [r for r, *_ in base] + [f"{h} {p}" for h, p in globs]
    verdicts = [x[-1] for x in base]
    weight = np.array([len(r.encode()) for r, *_ in base], np.int64)

    def work(it):
        automaton = ShiftAnd(rules)
        for batch in it:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            fits = automaton.run([canonical(*p) for p in parts])
            nb = len(weight)
            best = np.where(fits[:, :nb], weight + 1, 0)
            k = best.argmax(1) if nb else np.zeros(len(parts), int)
            has = fits[:, :nb].any(1)
            g = fits[:, nb:].argmax(1) if fits.shape[1] > nb else np.zeros(len(parts), int)
            hit = fits[:, nb:].any(1)
            rule = [names[i] if x else None for i, x in zip(k, has)]
            glob = [names[nb + i] if x and not y else None for i, x, y in zip(g, hit, has)]
            verdict = [verdicts[i] if x else "block" if y else default for i, x, y in zip(k, has, hit)]
            cols = [batch.column("page_id"), [h for h, _ in parts], [p for _, p in parts], rule, verdict, glob]
            yield pa.RecordBatch.from_arrays([cols[0], *(pa.array(c, pa.string()) for c in cols[1:])], ["page_id", "host", "path", "rule", "verdict", "glob"])

    p = pages.select("page_id", "url")
    return p.mapInArrow(work, f"page_id {p.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, glob string")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    lower = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    like = lambda g: g.replace("_", "\\_").replace("%", "\\%").replace("*", "%").replace("?", "_")
    fit = " ".join(f"WHEN (ends_with('.' || host, '.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}')) THEN '{r}'" for r, _ in sorted(BASE_RULES, key=lambda x: -len(x[0])))
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in BASE_RULES)
    globs = " ".join(f"WHEN '.' || host LIKE '{like(h)}' ESCAPE '\\' AND path LIKE '{like(p)}' ESCAPE '\\' THEN '{h} {p}'" for h, p in BLOCK_GLOBS)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN {lower} ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT *, CASE {fit} END AS rule, CASE {globs} END AS g FROM u)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN g IS NULL THEN 'allow' ELSE 'block' END END AS verdict,
  CASE WHEN rule IS NULL THEN g END AS glob FROM r"""


ORACLE = _oracle()
