"""Cases that once went wrong: words that clash under polynomial hashes, strings of special
tokens, equal rows, clashing column names, masked outliers, pages without names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import op1_mcd, op2_dac, op3_parity, op5_decontam, op6_substring, op8_kdtree, op9_linedist, op10_url_filter
from voxelloom.llm.common import materialize
from voxelloom.llm.graph import without_ids

P = pytest.importorskip("public_tokenizers")


def thue_morse(n):
    """Two words of n letters that any polynomial hash modulo 2**64 confuses from 1,024 on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_clash(spark, n):
    from tokenizers import Tokenizer

    a, b = thue_morse(n)
    sides = [" ".join(f"{x}{i}" for i in range(60)) for x in "uv"]
    d = spark.createDataFrame([(1, f"x {a} y z"), (2, f"x {b} y z"), (3, " ".join([a] * 60)), (4, " ".join([b] * 60)), (5, f"{sides[0]} {a} {sides[1]}"), (6, f"{sides[0]} {b} {sides[1]}")], "doc_id long, text string")
    roots = {r.doc_id: r.component_id for r in op3_parity.jaccard_components(d, 4, 85, 100).collect()}
    assert roots[1] == 1 and roots[2] == 2 and roots[3] == 3 and roots[4] == 4 and roots[6] == 5  # 117 of 125 shingles of 5 and 6 are shared
    gone = {r.doc_id: r.n_removed for r in op6_substring.dedup_digests(d).collect()}
    assert gone == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 120}
    hits = {r.doc_id: r.n_hit for r in op5_decontam.decontaminate(d, spark.createDataFrame([(1, a)], "item_id long, text string")).collect()}
    assert hits == {1: 1, 2: 0, 3: 60, 4: 0, 5: 1, 6: 0}
    file = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    got = op2_dac.read_back(materialize(op2_dac.dac_segments(d, file), "t", **op2_dac.FORMAT), with_ids=True).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [2] for r in d.collect()}


def test_clashing_names_of_sets(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)] + [(20, " ".join(f"w3x{j}" for j in range(30))), (21, " ".join(f"w3x{j}" for j in range(29)))]
    real = op3_parity.set_name
    monkeypatch.setattr(op3_parity, "set_name", lambda s: (real(s)[0] % 4, real(s)[1]))
    got = {r.doc_id: r.component_id for r in op3_parity.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == {i: 3 if i > 19 else i for i in range(22)}


def test_special_strings(spark):
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "plain words " * 50, None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for literal in (False, True):
        t.encode_special_tokens = literal
        seg = materialize(op2_dac.dac_segments(d, file, literal=literal), "t", **op2_dac.FORMAT)
        got = {r.doc_id: list(r.ids) for r in op2_dac.read_back(seg, with_ids=True).collect()}
        assert got == {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}


def test_few_segments_are_read(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"hello w{i} " * 300) for i in range(60)], "doc_id long, text string")
    seg = materialize(op2_dac.dac_segments(d, P.path("byte_bpe_50k.json"), segment_tokens=500), "t", **op2_dac.FORMAT)
    ids = {r.doc_id: r.ids for r in op2_dac.read_back(seg, with_ids=True).collect()}
    wanted = spark.createDataFrame([(7, 5), (40, 0)], "doc_id long, offset long")
    few = op2_dac.tokens_at(seg, wanted)
    scan = next(x for x in few._jdf.queryExecution().executedPlan().toString().split("\n") if "payload" in x and "FileScan" in x)
    assert "EqualTo(segment," in scan.split("PushedFilters")[1]
    monkeypatch.setattr(op2_dac, "ASKED", 0)
    for out in (few, op2_dac.tokens_at(seg, wanted)):
        assert {(r.doc_id, r.token) for r in out.collect()} == {(7, ids[7][5]), (40, ids[40][0])}


def test_equal_rows_stay_apart(spark):
    d = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (2, "other")], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(i, f"item {i} words here") for i in range(9)] + [(10, "same words here")], "item_id long, text string")
    for block in (1 << 20, 20):
        assert sorted((r.doc_id, r.n_hit) for r in op5_decontam.decontaminate(d, b, block_bytes=block).collect()) == [(1, 3), (1, 3), (2, 0)]


def test_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    names = ("_id", "hash_id", "_name", "name", "check", "removed", "_removed", "of_id", "gone_id", "key", "kept", "d2", "row", "verdict", "lang", "source", "statistics")
    d = spark.createDataFrame([(i, text, len(text), *("x",) * len(names)) for i in (1, 2)], "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    out = op6_substring.without_repeats(d)
    assert out.columns == d.columns and sorted((r.doc_id, r.text == text, r._id) for r in out.collect()) == [(1, True, "x"), (2, False, "x")]
    assert [r.doc_id for r in without_ids(d, spark.createDataFrame([(1,)], "doc_id long")).collect()] == [2]
    assert op1_mcd.judged(d, tuple(d.columns)).select("row.*").columns == d.columns


def test_masked_outliers():
    """A fifth of the rows lies across the others' line: from the medians alone they are taken in."""
    from test_operators import robust_distances

    rng = np.random.default_rng(3)
    n = 500
    x = rng.normal(0, 0.05, (n, op1_mcd.P))
    t = rng.normal(0, 6, n)
    x[:, 0] += t
    x[:, 1] += t
    out = np.arange(n) < n // 5
    x[out, 1] -= 2 * t[out]
    x = (x * op1_mcd.SCALE).round()
    one, all_starts = (robust_distances(x, op1_mcd, s) for s in ((0,), (0, 1, 2)))
    far = out & (np.abs(t) > 3)
    assert (all_starts[far] > op1_mcd.CUTOFF).all() and (all_starts[~out] > op1_mcd.CUTOFF).mean() < 0.01
    assert (all_starts[far] > op1_mcd.CUTOFF).sum() >= (one[far] > op1_mcd.CUTOFF).sum()


def test_three_groups_equal_numpy(spark):
    from test_operators import robust_distances

    rng = np.random.default_rng(4)
    rows = []
    for g in range(3):
        t = rng.normal(0, 5, 200)
        x = rng.normal(0, 0.3, (200, op1_mcd.P)) + g
        x[:, 0] += t
        x[:, 3] += np.where(np.arange(200) < 40, -t, t)
        rows += [(g, int(k) % op1_mcd.SALTS, *map(int, r)) for k, r in enumerate((x * op1_mcd.SCALE).round())]
    d = spark.createDataFrame(rows, "gid long, salt int, " + ", ".join(f"x{i} long" for i in range(op1_mcd.P)))
    known = op1_mcd.estimates(d)
    centred = d.join(known, "gid").withColumns({f"x{i}": F.col(f"x{i}") - F.col(f"c{i}") for i in range(op1_mcd.P)})
    got = op1_mcd.with_distance(centred).groupBy("gid").agg(F.sort_array(F.collect_list("d2")).alias("d2")).collect()
    for r in got:
        want = robust_distances(np.array([x[2:] for x in rows if x[0] == r.gid], float), op1_mcd)
        assert np.allclose(r.d2, np.sort(want), rtol=1e-3, atol=1e-3)


def test_shards_of_copies_and_prefixes(spark):
    rng = random.Random(2)
    rows = [(i, f"text {rng.randint(0, 1500)} " * 3, "en", f"https://site{i % 5}.example/") for i in range(4000)]
    rows += [(5000 + i, "hot " * 8, "en", "https://site0.example/") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in op8_kdtree.kd_shards(d, 16).collect()}
    weight, shards = {}, {}
    for i, t, *_ in rows:
        assert got[i].text_crc32 == zlib.crc32(t.encode())
        weight[t] = weight.get(t, 0) + got[i].size
        shards.setdefault(t, set()).add(got[i].shard)
    total = sum(weight.values())
    assert all(len(s) == 1 for t, s in shards.items() if weight[t] <= total / 16 / 32) and len(shards["hot " * 8]) > 1
    loads = [sum(r.size for r in got.values() if r.shard == k) for k in range(16)]
    assert max(loads) - min(loads) < 4 * total / 16 / 32
    ranked = op8_kdtree.ranks(d, "source").orderBy("source").collect()
    assert [r["rank"] for r in ranked] == [0, 1, 2, 3, 4]


def page(middle):
    return f"<body><div><div><div>Sign in</div><div><span>About us</span></div></div></div>{middle}<div><div><div><div>All rights reserved</div></div></div></div></body>"


def test_windows_decide(monkeypatch):
    a = "running text that goes on for quite a while " * 4
    soup = page(f"<div><div><div><p>{a}</p><p>short</p><p>{a}</p></div></div></div>")
    want = f"{a}short {a.strip()}"
    assert op9_linedist.main_text(soup) == want
    named = f"<nav><ul><li><a href=x>x</a></li></ul></nav><div class='ad'>Buy these things now, they are cheap and good for you and yours.</div><article><p>{a}</p></article>"
    assert op9_linedist.main_text(named) == a.strip()
    monkeypatch.setattr(op9_linedist, "regions", lambda w, gaps, k: (np.zeros(len(w), int), np.where(np.array(w) > 0, 1e9, 0.0)))
    assert op9_linedist.main_text(soup) != want and op9_linedist.main_text(named) != a.strip()


def test_regions_by_loop():
    rng = random.Random(1)
    for _ in range(200):
        n, k = rng.randint(1, 12), rng.randint(1, 4)
        weights, gaps = [rng.choice([0, 0, 1, 5, 90]) for _ in range(n)], [rng.randint(0, 3) for _ in range(n)]
        cells = []
        for i, (w, g) in enumerate(zip(weights, gaps)):
            cells += [(0, None)] * g + [(w, i)]
        sums = [sum(w for w, _ in cells[max(0, j - k + 1) : j + 1]) for j in range(len(cells))]
        region, best, at = -1, {}, {}
        for j, s in enumerate(sums):
            if s > 0 and (j == 0 or sums[j - 1] == 0):
                region += 1
            if s > 0:
                best[region] = max(best.get(region, 0), s)
            if cells[j][1] is not None:
                at[cells[j][1]] = region if s > 0 else -1
        # a region may go on after the last line, in windows that still hold it
        tail = [sum(w for w, _ in cells[max(0, j - k + 1) :]) for j in range(len(cells), len(cells) + k - 1)]
        for s in tail:
            if s > 0 and region >= 0:
                best[region] = max(best[region], s)
        mine, highest = op9_linedist.regions(weights, gaps, k)
        assert mine.tolist() == [at[i] for i in range(n)] and highest.tolist() == [best.get(at[i], 0) for i in range(n)]


def test_articles_stay_whole():
    a = "a paragraph of the article that is long enough to surge by itself, as they are. " * 2
    html = f"<article><p>{a}</p><p><a href=x>See the full report of the working group here</a></p><div class='social-history'><p>Of social history</p></div><div class='legal-analysis'>Law</div><div class='share-buttons'>tweet</div><div class='ad'>buy</div><p>End</p></article><section class='comment-list'>{a * 9}</section>"
    assert op9_linedist.main_text(html) == f"{a}See the full report of the working group here Of social history Law End"
    for name in ("ad", "site-footer", "cookie-notice", "adBanner", "comment-list", "sidebar_right", "related-posts", "ad-300"):
        assert op9_linedist.names_boilerplate(name), name
    for name in ("social-history", "article-header", "entry-title", "gradient", "header-less-law", "content", "lead"):
        assert not op9_linedist.names_boilerplate(name), name


def test_words_of_hosts(spark):
    hosts = ["downloads.python.net", "uploads.wikimedia.net", "unspam-me.net", "tracker.debian.net", "ads.foo.net", "www.spam-farm.net", "a-casino.net", "x.adult-x.net"]
    p = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    assert [r.verdict for r in op10_url_filter.url_verdicts(p).orderBy("page_id").collect()] == ["allow"] * 4 + ["block"] * 4


def test_scratch_is_deleted(spark):
    import os

    from voxelloom.llm.common import scratch_root

    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    d = spark.createDataFrame([(i, f"word{i} " * 60, "en", "a") for i in range(70)], "doc_id long, text string, lang string, source string")
    op3_parity.jaccard_components(d).count()
    op6_substring.repeated_spans(d).count()
    op1_mcd.quality_verdicts(d).count()
    assert len(set(os.listdir(root)) - before) == 4  # the results, and the statistics that verdicts are read from
