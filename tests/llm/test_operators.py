"""Each operator against a brute-force version, on rows with nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import op2_dac, op3_parity, op4_license, op5_decontam, op6_substring, op7_bpe, op8_kdtree, op9_linedist, op10_url_filter
from voxelloom.llm.op1_mcd import quality_verdicts

P = pytest.importorskip("public_tokenizers")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, name string, key int, block int, sid long"


def words_of(rng, n):
    return [rng.choice(["the", "of", "Café", "naïve", "x1", "data,", "MIT", "License", "über"]) + str(rng.randint(0, 60)) * rng.randint(0, 1) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [words_of(rng, n) for n in (5, 60, 120, 200, 400, 3000)]
    passage = words_of(rng, 70)
    out = [" ".join(b) for b in base]
    out += [" ".join(base[3]), " ".join(base[3][:100] + ["edited"] + base[3][101:]), "\n".join(base[4])]
    out += [" ".join(base[1][:30] + passage + base[2][:20]), " ".join(base[2][:40] + passage), " ".join(passage[:49]), " ".join(passage[3:55])]
    out += [None, "", " \n\t ", "word", "a b c", "same line\nsame line\nsame line", "Und " * 100, "x" * 5000, "nbsp   \n\nhere   wide", "a\x1cb\x0bc"]
    out += ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0. under-the mit license", "CC BY-NC 4.0 cc by nc", "This work is licensed under the GNU General Public License, version 3.", "K under the mit licensex"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    ids = list(range(10, 10 + len(texts)))
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", 0, "x", "y", 1, 2, 3) for i, t in zip(ids, texts)]
    rows += [rows[3], (rows[4][0], "other text of the same id", "en", "s0", 0, "x", "y", 1, 2, 3), (None, texts[3], "en", "s1", 0, "x", "y", 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def plain(spark, texts):
    rows = [(i + 10, t, "en", "s0", 0, "x", "y", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, plain):
    got = {r.doc_id: r for r in quality_verdicts(plain).collect()}
    for r in plain.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if c[w[k], w[k + 1], w[k + 2]] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert g.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (g.base_failed and g.kept)
    assert quality_verdicts(docs, keep=tuple(docs.columns)).count() == docs.count()
    assert quality_verdicts(empty(spark)).count() == 0


def test_robust_distance_equals_numpy(spark):
    from voxelloom.llm import op1_mcd as m

    rng = random.Random(2)
    rows = [(i, "\n".join(" ".join(rng.choice(["alpha", "beta", "Gamma", "de"]) + str(rng.randint(0, 999)) for _ in range(12)) for _ in range(rng.randint(6, 40))), "en", "a") for i in range(150)]
    rows += [(200 + i, "WHAT? | # | NOW!! | " * 6 + " ".join(str(k) for k in range(60)), "en", "a") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_verdicts(d).collect()}
    assert all(not got[200 + i].kept and not got[200 + i].base_failed for i in range(5)) and all(got[i].kept for i in range(150))
    v = m.base_statistics(d).select("doc_id", *m.vector()).collect()
    d2 = robust_distances(np.array([[r[f"x{i}"] for i in range(m.P)] for r in v]), m)
    for r, x in zip(v, d2):
        assert got[r.doc_id].d2 == pytest.approx(x, rel=1e-4, abs=1e-4)


def robust_distances(x, m, starts=(0, 1, 2)):
    """Squared distances from the reweighted minimum covariance determinant, in numpy."""
    middle = np.median(x, 0).round()
    x, floor = (x - middle) / m.SCALE, np.diag(m.FLOOR)
    dist = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def step(est):
        b = np.floor(np.log1p(dist(*est)) * m.BINS)
        values, count = np.unique(b, return_counts=True)
        h = x[b <= values[np.flatnonzero(np.cumsum(count) - count < m.SHARE * len(b))[-1]]]
        return h.mean(0), np.cov(h.T, bias=True) * m.CONSISTENCY + floor

    d = np.sqrt((1.4826 * np.median(np.abs(x - np.median(x, 0) + 0), 0)) ** 2 + np.diag(floor))
    z = x / d
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    sign = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
    with np.errstate(all="ignore"):
        corr = np.nan_to_num(np.corrcoef(np.tanh(z).T)) * 0.999
    np.fill_diagonal(corr, 1)
    zero = np.zeros(m.P)
    first = [(zero, np.diag(d**2)), (zero, corr * np.outer(d, d)), (zero, sign.T @ sign / len(z) * m.P * np.outer(d, d) + floor)]
    logdet = lambda est: np.linalg.slogdet(est[1])[1]
    best = min((step(step(first[k])) for k in starts), key=logdet)
    for _ in range(m.MOST - m.FIRST):
        new = step(best)
        fell = logdet(new) < logdet(best) - m.STILL
        best = new
        if not fell:
            break
    h = x[dist(*best) <= m.NEAR]
    return dist(h.mean(0), np.cov(h.T, bias=True) * m.NEAR_CONSISTENCY + floor)


def test_shares_alone_are_rejected(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(i, "\n".join(line(10) for _ in range(20)), "en", "a") for i in range(300)]
    rows += [(300, "\n".join(line(19) + "\nsame" for _ in range(10)), "en", "a"), (301, "\n".join(line(10) for _ in range(12)) + "\n" + (again := line(40)) + "\n" + again, "en", "a")]
    once = line(10)
    rows += [(302, "\n".join([line(10) for _ in range(18)] + [once, once]), "en", "a")]
    got = {r.doc_id: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[300].n_dup_lines == 9 and got[300].n_repeat_words == 0 and got[301].n_repeat_words == 80 and got[301].n_dup_lines == 1
    assert not any(got[i].base_failed for i in got) and [i for i in got if not got[i].kept] == [300, 301]


def test_rare_languages_are_estimated(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(10))
    text = lambda: "\n".join(line() for _ in range(20))
    junk = "WHAT? | # | NOW!! | " * 6 + " ".join(str(k) for k in range(60))
    rows = [(i, text(), "en", "a") for i in range(100)] + [(100 + i, text(), "is", "b") for i in range(10)] + [(200, junk, "is", "b")]
    got = {r.doc_id: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[200].base_failed and [i for i in got if not got[i].kept] == [200] and all(r.d2 is not None for r in got.values())


def test_dac(spark, docs, plain):
    file = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    from voxelloom.llm.common import materialize

    seg = materialize(op2_dac.dac_segments(plain, file, segment_tokens=2000), "t", **op2_dac.FORMAT)
    got, start = op2_dac.read_back(seg, with_ids=True).orderBy("doc_id").collect(), 0
    for r, g in zip(plain.orderBy("doc_id").collect(), got):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens, list(g.ids)) == (r.doc_id, start, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    wanted = spark.createDataFrame([(g.doc_id, k) for g in got for k in (0, g.n_tokens - 1, g.n_tokens)], "doc_id long, offset long")
    at = {(r.doc_id, r.offset): r.token for r in op2_dac.tokens_at(seg, wanted).collect()}
    assert all(at[g.doc_id, 0] == g.ids[0] and at[g.doc_id, g.n_tokens - 1] == 2 and at[g.doc_id, g.n_tokens] is None for g in got)
    both = op2_dac.read_back(materialize(op2_dac.dac_segments(docs, file), "t", compression="none")).collect()
    assert len(both) == docs.count() and sorted((r.start, r.n_tokens) for r in both)[0][0] == 0
    assert op2_dac.read_back(materialize(op2_dac.dac_segments(empty(spark), file), "t", compression="none")).count() == 0


def test_dac_levels():
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1, 7] * 300, np.uint32)
    s = op2_dac.Segment(op2_dac.encode_segment(ids, np.array([len(ids)])))
    assert np.array_equal(s.all(), ids) and [s[i] for i in range(len(ids))] == ids.tolist()


def components_by_brute_force(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("chunk", [4096, 3])
def test_jaccard_components(spark, docs, plain, texts, chunk, monkeypatch):
    if chunk < 100:
        monkeypatch.setattr(op3_parity, "CHUNK", chunk)
        monkeypatch.setattr(op3_parity, "CELL_SHINGLES", 500)
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in plain.collect()]
    base = words_of(rng, 90)
    for i in range(40):  # near copies of each other, some linked and some just not
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
        rows.append((1000 + i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_parity.jaccard_components(d, k, num, den).collect()}
        assert got == components_by_brute_force(rows, k, num, den)
    if chunk > 100:
        assert op3_parity.jaccard_components(docs).count() == docs.count()
        assert op3_parity.jaccard_components(empty(spark)).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 700).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]))
        d = len(np.setxor1d(a, b))
        for x, y in ((512, 512), (512, 2048), (2048, 4096)):
            raw = [op3_parity.parity(a, x).tobytes(), op3_parity.parity(b, y).tobytes()]
            assert op3_parity.Sketches(raw).distance(0, np.array([1]))[0] <= d
            assert op3_parity.parity(b, y // 2).tobytes() == op3_parity.halved(op3_parity.parity(b, y)[None])[0].tobytes()
        both = len(a) + len(b) - len(np.union1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            bands = op3_parity.Bands(85, 100)
            assert len(np.intersect1d(op3_parity.segment_keys(a, bands), op3_parity.segment_keys(b, bands)))


def test_licences(spark, docs, plain):
    got = {r.doc_id: r for r in op4_license.licence_labels(plain).collect()}
    for r in plain.collect():
        w, at, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOW)), [], set()
        for p, label in op4_license.BASE_PHRASES:
            p = p.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(g.labels.split(",")) | ({""} - {""}) and 0 <= g.score <= 1
    gpl = next(r for r in plain.collect() if r.text and "General Public" in r.text)
    assert got[gpl.doc_id].labels == "gpl-3"
    assert op4_license.licence_labels(docs).count() == docs.count() and op4_license.licence_labels(empty(spark)).count() == 0


def test_licences_at_every_place(spark):
    gpl2, gpl3 = (next(t for label, t, _ in op4_license.TEMPLATES if label == x and t.startswith("this program")) for x in ("gpl-2", "gpl-3"))
    partial = gpl3.replace("version 3", "version")
    d = spark.createDataFrame([(1, f"{gpl2} and then {gpl3}"), (2, f"{gpl3} and then {gpl2}"), (3, f"{partial} {partial} {gpl3}"), (4, partial)], "doc_id long, text string")
    got = {r.doc_id: r for r in op4_license.licence_labels(d).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["gpl-2,gpl-3", "gpl-2,gpl-3", "gpl-3", ""] and [got[i].score for i in (1, 2, 3, 4)] == [1, 1, 1, 0]


def test_licences_of_common_words(spark):
    bsd, gpl3 = (next(t for label, t, _ in op4_license.TEMPLATES if label == x) for x in ("bsd", "gpl-3"))
    rows = [(0, f"{bsd} or {gpl3}"), *((i, f"{gpl3} and a general word") for i in range(1, 30))]
    got = {r.doc_id: r.labels for r in op4_license.licence_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "bsd,gpl-3", **{i: "gpl-3" for i in range(1, 30)}}


def test_licences_equal_alignment_everywhere(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        w = []
        for _ in range(3):
            notice = rng.choice(op4_license.TEMPLATES)[1].split()
            w += [x if rng.random() > 0.1 else rng.choice(["x", "license", "public"]) for x in notice] + rng.choice([["and"], ["public", "license"], []])
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.labels for r in op4_license.licence_labels(spark.createDataFrame(rows, "doc_id long, text string"), rare=1).collect()}
    for i, t in rows:
        w, labels = t.split(), {label for p, label in op4_license.BASE_PHRASES if f" {p} " in f" {t} "}
        for label, notice, must in op4_license.TEMPLATES:
            notice = notice.split()
            for b in range(-len(notice), len(w)):
                same = [x for j, x in enumerate(notice) if 0 <= b + j < len(w) and w[b + j] == x]
                near = f" {' '.join(w[max(b, 0) : max(b, 0) + len(notice) + 4])} "
                if len(same) / len(notice) >= op4_license.AGREE and sum(x not in op4_license.COMMON for x in same) >= op4_license.VOTES and all(f" {m} " in near for m in must):
                    labels.add(label)
        assert got[i] == ",".join(sorted(labels))


def contamination_by_brute_force(rows, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(size, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[j : j + k])].add(i)
    out = {}
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, docs, plain, texts, block):
    items = [(1, texts[9]), (2, " ".join(texts[2].split()[20:33])), (3, "a b c"), (4, None), (5, ""), (20, "WORD"), (20, "word"), (6, texts[9])]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in op5_decontam.decontaminate(plain, b, block_bytes=block).drop("n_near").collect()}
    assert got == contamination_by_brute_force([(r.doc_id, r.text) for r in plain.collect()], items)
    if block > 1000:
        assert op5_decontam.decontaminate(docs, b).count() == docs.count()
        assert op5_decontam.decontaminate(empty(spark), b).count() == 0
        assert op5_decontam.decontaminate(plain, b.where("false")).where("contaminated").count() == 0


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_proximity(spark, block):
    from voxelloom.llm.common import materialize

    rng = random.Random(8)
    vocabulary = ["one", "two", "three", "four", "five"]
    rows = [(1, "one two extra three four"), (2, "one two three four"), (3, "one four"), (4, None)] + [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 14)))) for i in range(5, 60)]
    items = [(1, "one two three four"), (2, "five one two"), (3, "two two")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: r for r in op5_decontam.contamination(materialize(op5_decontam.build_index(d), "i"), b, slop=2, block_bytes=block).collect()}
    for i, t in rows:
        w, near = (t or "").split(), set()
        for _, x in items:
            x = x.split()
            for p in range(len(w)):
                if w[p] == x[0] and all(x[j] in w[max(0, p + j - 2) : p + j + 3] for j in range(1, len(x))) and w[p : p + len(x)] != x:
                    near.add(p)
        assert sorted(got[i].near) == sorted(near)
    assert sorted(got[2].hits) == [0, 1, 2, 3] and not got[1].hits and sorted(got[1].near) == [0, 1] and not got[3].near


def repeats_by_brute_force(rows, size=50):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for d, t in rows:
        w = cut(t)
        for j in range(len(w) - size + 1):
            g = tuple(w[j : j + size])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, t in rows:
        w, gone = cut(t), set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < d:
                gone |= set(range(j, j + size))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup(spark, docs, plain):
    rows = [(r.doc_id, r.text) for r in plain.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op6_substring.dedup_digests(plain).collect()}
    assert got == repeats_by_brute_force(rows)
    assert op6_substring.dedup_digests(docs).count() == docs.count()
    assert op6_substring.dedup_digests(docs).where("doc_id IS NULL AND n_removed > 0").count() == 0
    assert op6_substring.dedup_digests(empty(spark)).count() == 0
    cut = op6_substring.without_repeats(plain)
    assert cut.columns == plain.columns
    for r in cut.collect():
        kept = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert hashlib.sha256(" ".join(kept).encode()).hexdigest() == got[r.doc_id][2]


def test_bpe(spark, docs, plain):
    import tiktoken

    file = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in op7_bpe.bpe_round_trip(plain, file, P.PATTERN).collect()}
    for r in plain.collect():
        assert list(got[r.doc_id].ids) == enc.encode_ordinary(r.text or "") and bytes(got[r.doc_id].decoded) == (r.text or "").encode()
    long = "word \n\n next  \tx" * 9000
    assert op7_bpe.encode(enc, long) == enc.encode_ordinary(long)
    assert op7_bpe.bpe_digests(docs, file, P.PATTERN).count() == docs.count() and op7_bpe.bpe_digests(empty(spark), file, P.PATTERN).count() == 0


def test_kd_shards(spark, docs):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randint(0, 300), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 9}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = op8_kdtree.kd_shards(d, 16).collect()
    assert len(got) == 3000 and {r.shard for r in got} == set(range(16))
    by = collections.defaultdict(list)
    for r in got:
        t = rows[r.doc_id][1].encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        by[r.shard].append(r)
    weights = [sum(r.size for r in x) for x in by.values()]
    assert max(weights) - min(weights) < 2 * 601 and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert len({r.shard for r in op8_kdtree.kd_shards(d, target_bytes=sum(weights) // 5 + 1).collect()}) == 5
    assert op8_kdtree.kd_shards(docs, 16).count() == docs.count() and op8_kdtree.kd_shards(empty(spark), 16).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy now, buy everything, this is a rather long advertisement text that goes on and on for ever.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> text.<br>Second &lt;line&gt; 1 < 2.</p><p>Third.</p></article>
<aside class="sidebar">side</aside><form><input name=x>form</form><div id="comments">reader says this and that at great length, again and again and again and again</div><footer>&copy; foot</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more First paragraph with bold text. Second <line> 1 < 2. Third."
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<nav>only</nav>"), (5, "u", "plain text"), (6, "u", PAGE[: PAGE.index("Third") + 3]), (1, "u", PAGE), (7, "u", "<p>" + "long words " * 20_000 + "</p>")]
    p = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = op9_linedist.page_texts(p).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 8 and by[1].text == want and by[1].n_chars == len(want) and by[1].url == "u"
    assert [by[i].text for i in (2, 3, 4, 5)] == ["", "", "", "plain text"] and by[6].text == want[: want.index("Third") + 3] and by[7].n_chars == 20_000 * 11 - 1
    assert op9_linedist.page_texts(p.where("false")).count() == 0


def test_main_text_is_whole():
    a, b = "first words " * 20, "last words " * 20
    main = op9_linedist.main_text
    for tag in ("article", "main"):
        page = f"<body><p>menu</p><{tag}><h1>Top</h1><div class=share>tweet</div><section>Short</section><nav>go</nav><p>{a}</p><ul><li>Salt</li><li>Pepper</li></ul><table><tr><td>1</td></tr></table><p><a href=x>all of it linked</a></p><p>{b}</p><div class=ad>buy</div><p>End</p></{tag}><footer>f</footer></body>"
        assert main(page) == f"Top Short {a}Salt Pepper 1 all of it linked {b}End"
    assert main(f"<div>{a}</div><div class=ad>buy</div><p>Short</p><aside>no</aside><p>{b}</p><nav>n</nav><p>tail</p>") == f"{a}Short {b.strip()}"
    assert main("<article><p><a href=x>linked</a></p></article>") == "linked" and main("<nav><article>n</article></nav>") == ""


def test_url_rules(spark):
    urls = ["http://A.org/x", "https://www.example.org/es/1?q", "https://example.org/en/12", "http://org", "http://notorg/", "http://x.com/fr/", "http://x.com/de/y#z", "http://my-casino.net/", "no scheme", None, "", "http://com/de/", "http://a.net/b.org/", "http://é.org/ü?x", "http://a.net/" + "x" * 3000]
    p = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.rule, r.verdict) for r in op10_url_filter.url_verdicts(p).orderBy("page_id").collect()]
    assert [g[1] for g in got] == ["org/", "example.org/es/", "example.org/en/1", None, None, "com/fr/", "com/de/", None, None, None, None, "com/de/", None, "org/", None]
    assert [g[2] for g in got][:8] == ["allow", "block", "block", "allow", "allow", "allow", "block", "block"] and got[0][0] == "a.org"
    assert op10_url_filter.url_verdicts(p.where("false")).count() == 0


def test_automaton_equals_fnmatch():
    import fnmatch

    rng = random.Random(9)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    automaton = op10_url_filter.ShiftAnd([[None if c == "*" else -1 if c == "?" else ord(c) for c in g] for g in globs])
    urls = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    got = automaton.run([u.encode() for u in urls])
    assert automaton.words > 1 and all(got[i, j] == fnmatch.fnmatchcase(u, g) for i, u in enumerate(urls) for j, g in enumerate(globs))
