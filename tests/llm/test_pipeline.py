import hashlib
import random
import re

from pyspark.sql import functions as F
from test_operators import components_by_brute_force as components
from test_operators import contamination_by_brute_force, repeats_by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as c

    from voxelloom.llm.op1_mcd import quality_verdicts

    assert c.ORACLE_SQL is None and [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_passages", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = docs, docs.columns
    for name, stage in c.STAGES:
        out = c.materialize(stage(spark, seen, SF), name)
        if name != "tokens":
            assert out.columns == columns and out.count() <= seen.count()
        rows = [(r.doc_id, r.text) for r in seen.collect()]
        if name == "quality":
            assert out.count() == quality_verdicts(seen).where("kept").count()
        if name == "near_duplicates":
            want = {i for i, (_, root) in components(rows, 5, 80, 100).items() if i == root}
            assert {r.doc_id for r in out.collect()} == want
        if name == "repeated_passages":
            words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
            want = {i: x[2] for i, x in repeats_by_brute_force(rows).items() if x[0] > x[1]}
            assert {r.doc_id: hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() for r in out.collect()} == want
            assert out.where("n_chars <> length(text)").count() == 0
        if name == "benchmark_passages":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r.doc_id for r in out.collect()} == {i for i, x in contamination_by_brute_force(rows, items).items() if not x[4]}
        if name == "tokens":
            assert out.count() == seen.count() and out.where(F.size("ids") != F.col("n_tokens")).count() == 0
        seen = out
    assert c.run(spark, SF).count() == seen.count()


def test_repeated_rows_stay_once(spark):
    import corpus_pipeline as c

    t = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, t), (1, t), (2, t), (3, "other " + t[:100]), (None, "x y z")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in c.near_duplicates(spark, d, SF).collect()) == [0, 1, 3]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, verdict string, row int, _id int, hash_id int, name int, check int, removed int, ids int, n_tokens int"


def test_stages_on_odd_tables(spark):
    import corpus_pipeline as c

    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    texts = [words(80) for _ in range(60)] + [None, "", " \n", "one", words(30_000)]
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else "s", len(t or ""), True, "v", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in enumerate(texts)]
    rows += [rows[0], (None, *rows[1][1:]), (0, words(70), *rows[0][2:])]
    for table in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        n = table.count()
        for name, stage in c.STAGES:
            out = stage(spark, table, SF)
            if name != "tokens":
                assert out.columns == table.columns
            got = out.count()
            assert got <= n
            if n and name == "quality":
                # the three added rows stay, short and empty texts go, and so does the one that is far longer than all others
                assert got == 60 + 3 and out.where("doc_id IS NULL").count() == 1
            if n and name == "near_duplicates":  # row 0 twice and its other text, the copy without an id
                assert got == n - 1 and out.where("doc_id = 0").count() == 2
            if n and name == "benchmark_passages":
                assert got == n
            if n and name == "tokens":
                assert got == n


def test_stages_can_be_read_later(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = c.quality(spark, docs, SF)
    n = c.benchmark_passages(spark, docs, SF).count()
    c.near_duplicates(spark, docs, SF)
    assert 0 < a.count() <= docs.count() and n > 0
