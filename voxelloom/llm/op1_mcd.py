"""Quality rules: robust multivariate outliers of text statistics.

Each document becomes a vector of transformed statistics. For each language and
source the location and scatter of the clean majority are estimated by the
minimum covariance determinant. Three deterministic starts (deviations from the
medians, the correlations of squashed deviations, and the covariance of spatial
signs) take two concentration steps each: the rows with the smallest
Mahalanobis distances, three quarters of all, give the next mean and covariance.
The start with the smallest determinant goes on until its determinant no longer
falls, and the rows within the 0.975 quantile give the reweighted estimate. Rows far
from their group's estimate are rejected.

DataFrame functions only. Sums are of whole numbers and quantiles come from
histograms, so the order of rows and the number of tasks change nothing, and
a group of any size is first aggregated where its rows lie: a step adds up moments
by group and bin of distance in one pass, and takes the bins that it needs. The
estimates, a row for each group, are joined with a salt, so one source may hold
most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release, scratch, settled, table

#: Bytes that separate words.
WHITE = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\x0c\r"
SCALE, P = 10_000, 6
#: Share of the rows that the estimates rest on, and the factor that makes their
#: covariance consistent for normal data: 0.75 / P(chi2 with 8 degrees <= the 0.75 quantile of chi2 with 6).
SHARE, CONSISTENCY = 0.75, 1.362
#: The 0.975 quantile of chi2 with 6 degrees, and the factor for rows within it.
NEAR, NEAR_CONSISTENCY = 14.449, 1.0492
#: Added to the variances: deviations this small are no evidence. Shares of duplicate lines
#: and repeated words are bounded; in a group without any, one above 0.39 is rejected by itself.
FLOOR = (0.25, 0.0025, 0.0064, 0.01, 0.01, 0.0025)
#: Steps of each start; steps at most in all, and the fall of the log determinant that ends them.
FIRST, MOST, STILL = 2, 20, 1e-3
SALTS, MIN_GROUP, BINS = 16, 50, 64
#: Squared distance beyond which a document is rejected: the 0.999999 quantile of chi2 with 6 degrees.
CUTOFF = 38.26

_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _without(text: str, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def base_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns `keep` and n_words, word_chars, n_symbols, n_loud (A-Z, ! and ?), n_lines, n_dup_lines,
    n_repeat_words and base_failed of each row. A null text has no words."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*keep, t.alias("_t"), F.array_remove(F.split(t, WHITE, -1), "").alias("_w"), F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0).alias("_l"))
    n, chars = F.size("_w"), F.length("_t")
    word = lambda i: F.get("_w", i)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<long>"))
    d = d.select(
        *keep, n.cast("long").alias("n_words"), _without("_t", _BLANK).cast("long").alias("word_chars"), (chars - _without("_t", "#*$%&|<>")).cast("long").alias("n_symbols"), (chars - _without("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!?")).cast("long").alias("n_loud"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), grams.alias("_g"),
    )
    # Equal runs stand side by side once sorted; their starts cover three words each.
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_p", F.array_sort(F.transform(F.filter("_s", lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0))))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_g", "_s", "_p")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics, in steps of 1 / SCALE."""
    n = F.greatest("n_words", F.lit(1))
    root = lambda a, b: F.sqrt(F.col(a) / b)
    x = [F.log1p("n_words"), F.log1p(F.col("word_chars") / n), root("n_symbols", n), root("n_dup_lines", F.greatest("n_lines", F.lit(1))), root("n_repeat_words", n), root("n_loud", F.greatest("word_chars", F.lit(1)))]
    return [F.floor(c * SCALE + 0.5).alias(f"x{i}") for i, c in enumerate(x)]


def _salted(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows joined with what is known of their group; the salt keeps a large group apart in parts."""
    salts = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salts, [*by, "salt"])


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, to rows that hold x0.., the mean m0.. and
    the covariance's factor l00..; one projection a dimension keeps expressions small."""
    for i in range(P):
        r = F.col(f"x{i}") / SCALE - F.col(f"m{i}")
        for j in range(i):
            r = r - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", r / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return rows.withColumn("d2", d2).drop(*[f"y{i}" for i in range(P)])


def _factor(groups: DataFrame) -> DataFrame:
    """The Cholesky factor l00.. of the covariance s00.., column by column, in its place, and logdet."""
    for j in range(P):
        rest = lambda i: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))  # noqa: B023, E731
        groups = groups.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"s{j}{j}") - rest(j), F.lit(1e-12))))
        groups = groups.withColumns({f"l{i}{j}": (F.col(f"s{i}{j}") - rest(i)) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    logdet = sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00")) * 2
    return groups.withColumn("logdet", logdet).drop(*[f"s{i}{j}" for i, j in _PAIRS])


def _estimate(sums: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Mean and factored covariance from the sums h, t0.., q00.. of rows."""
    mean = [(F.col(f"t{i}").cast("double") / F.col("h") / SCALE).alias(f"m{i}") for i in range(P)]
    out = sums.select(*by, "h", *mean, *[(F.col(f"q{i}{j}").cast("double") / F.col("h") / SCALE / SCALE).alias(f"q{i}{j}") for i, j in _PAIRS])
    cov = [((F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (FLOOR[i] if i == j else 0.0)).alias(f"s{i}{j}") for i, j in _PAIRS]
    return _factor(out.select(*by, *[f"m{i}" for i in range(P)], *cov))


def _moments() -> list[Column]:
    total = lambda c, name: F.sum(c).alias(name)
    return [F.count("*").alias("h"), *[total(F.col(f"x{i}"), f"t{i}") for i in range(P)], *[total(F.col(f"x{i}") * F.col(f"x{j}"), f"q{i}{j}") for i, j in _PAIRS]]


def concentrate(rows: DataFrame, known: DataFrame) -> DataFrame:
    """A concentration step of each (gid, start): the estimate from the SHARE of the rows
    that are nearest by the known one, whole bins of distance."""
    by = ["gid", "start"]
    far = with_distance(_salted(rows, known, ["gid"])).withColumn("bin", F.floor(F.log1p("d2") * BINS).cast("int"))
    cells = far.groupBy(*by, "bin").agg(*_moments())
    whole = Window.partitionBy(*by)
    cells = cells.withColumn("upto", F.sum("h").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("h")).withColumn("all", F.sum("h").over(whole))
    sums = cells.where(F.col("upto") < F.col("all") * SHARE).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ["h", *[f"t{i}" for i in range(P)], *[f"q{i}{j}" for i, j in _PAIRS]]])
    return _estimate(sums, by, CONSISTENCY)


def _starts(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """(gid, start, m0.., l00.., logdet) of the three starts; rows are centred on their medians."""
    z = [F.col(f"x{i}") / SCALE / F.col(f"d{i}") for i in range(P)]
    d = _salted(rows, scale, ["gid"]).select("gid", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")))
    d = d.select("gid", *[F.tanh(f"z{i}").alias(f"a{i}") for i in range(P)], *[F.when(norm > 0, F.col(f"z{i}") / norm).otherwise(0.0).alias(f"b{i}") for i in range(P)])
    whole = lambda c: F.sum((c * 1_000_000).cast("long"))
    sums = d.groupBy("gid").agg(F.count("*").alias("n"), *[whole(F.col(f"a{i}")).alias(f"a{i}") for i in range(P)], *[whole(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}{j}") for k in "ab" for i, j in _PAIRS])
    sums = sums.join(scale, "gid")
    c = lambda i, j: F.col(f"a{i}{j}") / F.col("n") / 1e6 - F.col(f"a{i}") / F.col("n") / 1e6 * F.col(f"a{j}") / F.col("n") / 1e6
    starts = []
    for k in range(3):
        cov = []
        for i, j in _PAIRS:
            both = F.col(f"d{i}") * F.col(f"d{j}")
            if k == 0:
                s = both if i == j else F.lit(0.0)
            elif k == 1:
                s = both if i == j else both * F.coalesce(c(i, j) / F.sqrt(F.greatest(c(i, i) * c(j, j), F.lit(1e-12))), F.lit(0.0)) * 0.999
            else:
                s = both * F.col(f"b{i}{j}") / F.col("n") / 1e6 * P + (FLOOR[i] if i == j else 0.0)
            cov.append(s.alias(f"s{i}{j}"))
        starts.append(F.struct(F.lit(k).alias("start"), *cov))
    out = sums.select("gid", F.explode(F.array(*starts)).alias("s")).select("gid", "s.*")
    return _factor(out.select("gid", "start", *[F.lit(0.0).alias(f"m{i}") for i in range(P)], *[f"s{i}{j}" for i, j in _PAIRS]))


def estimates(rows: DataFrame) -> DataFrame:
    """(gid, n, c0.., m0.., l00..) for each group of rows (gid, salt, x0..): the reweighted
    estimate, whose means are relative to the medians c0.. (whole steps of 1 / SCALE)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"x{i}").alias("x")) for i in range(P)])).alias("p")
    counts = materialize(rows.select("gid", pairs).groupBy("gid", "p.dim", "p.x").count(), "counts")
    median = counts.groupBy("gid", "dim").agg(F.round(F.expr("percentile(x, 0.5, count)")).cast("long").alias("c"), F.sum("count").alias("n"))
    mad = counts.join(median.select("gid", "dim", "c"), ["gid", "dim"]).groupBy("gid", "dim").agg(F.expr("percentile(abs(x - c), 0.5, count)").alias("off"))
    at = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
    spread = lambda i: F.sqrt(F.pow(at("off", i) / SCALE * 1.4826, F.lit(2)) + FLOOR[i])
    scale = median.join(mad, ["gid", "dim"]).groupBy("gid").agg(F.max("n").alias("n"), *[at("c", i).alias(f"c{i}") for i in range(P)], *[spread(i).alias(f"d{i}") for i in range(P)])
    scale = materialize(scale, "scale")
    discard(counts)
    centres = scale.select("gid", *[f"c{i}" for i in range(P)])
    rows = materialize(_salted(rows, centres, ["gid"]).select("gid", "salt", *[(F.col(f"x{i}") - F.col(f"c{i}")).alias(f"x{i}") for i in range(P)]), "centred")
    known = materialize(_starts(rows, scale.select("gid", *[f"d{i}" for i in range(P)])), "starts")
    for step in range(MOST):
        new = materialize(concentrate(rows, known.drop("logdet")), "step")
        if step + 1 == FIRST:  # the start with the smallest determinant goes on
            best = new.groupBy("gid").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
            known, new = new, new.join(best, ["gid", "start"], "left_semi")
            new = materialize(new, "best")
        elif step + 1 > FIRST:
            fell = new.join(known.select("gid", "start", F.col("logdet").alias("before")), ["gid", "start"]).where(F.col("logdet") < F.col("before") - STILL)
            if not fell.limit(1).count():
                known = new
                break
        known = new
    near = with_distance(_salted(rows, known.drop("logdet", "start"), ["gid"])).where(F.col("d2") <= NEAR)
    final = _estimate(near.groupBy("gid").agg(*_moments()), ["gid"], NEAR_CONSISTENCY).drop("logdet")
    return materialize(scale.select("gid", "n", *[f"c{i}" for i in range(P)]).join(final, "gid"), "estimates")


def judged(docs: DataFrame, keep: tuple[str, ...], cutoff: float = CUTOFF, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Rows (row, verdict): the columns `keep` of each row as a struct, and a struct of its
    statistics, base_failed, d2 (squared robust distance from its group) and kept.

    Groups are languages and sources; one of fewer than MIN_GROUP rows takes the
    estimate of its language, and a language of fewer that of all languages. If all
    rows are fewer, d2 is null and nothing is rejected beyond base_failed. Null
    languages and sources count as empty ones, a null text has no words; repeated rows
    are judged alike. The estimates rest on the rows that the base rules pass.
    """
    d = docs.select(F.struct(*[F.col(c) for c in dict.fromkeys(keep)]).alias("row"), F.col(text).alias("raw_text"), F.coalesce(F.col(lang), F.lit("")).alias("g_lang"), F.coalesce(F.col(source), F.lit("")).alias("g_source"))
    stats = base_statistics(d, "raw_text", ("row", "g_lang", "g_source"))
    stats = stats.select("*", *vector())
    salt = F.pmod(F.xxhash64(*[f"x{i}" for i in range(P)], "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    x = [f"x{i}" for i in range(P)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"]
    with scratch() as own:
        stats = own.keep(materialize(stats.withColumn("salt", salt), "statistics", compression="zstd"))
        release(docs.sparkSession)
        # The estimate that each language and source takes: its own, its language's, or that of all rows.
        n = F.sum(F.when(F.col("base_failed"), 0).otherwise(1))
        groups = materialize(stats.groupBy("g_lang", "g_source").agg(n.alias("n")), "groups")
        by_lang = groups.groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
        in_all = groups.agg(F.sum("n").alias("n_all"))
        at = lambda k, a, b: F.struct(F.lit(k).alias("level"), a.alias("l"), b.alias("s"))
        levels = [at(0, F.col("g_lang"), F.col("g_source")), at(1, F.col("g_lang"), F.lit("")), at(2, F.lit(""), F.lit(""))]
        takes = F.when(F.col("n") >= MIN_GROUP, levels[0]).when(F.col("n_lang") >= MIN_GROUP, levels[1]).when(F.col("n_all") >= MIN_GROUP, levels[2])
        groups = groups.join(by_lang, "g_lang").join(in_all, F.lit(True)).select("g_lang", "g_source", takes.alias("takes"))
        taken = materialize(groups.where("takes IS NOT NULL").select("takes").distinct().select("takes", F.monotonically_increasing_id().alias("gid")), "taken")
        groups = materialize(groups.join(taken, "takes", "left").select("g_lang", "g_source", "gid"), "groups")
        gives = groups.select("g_lang", "g_source", F.explode(F.array(*levels)).alias("takes")).join(taken, "takes").select("g_lang", "g_source", F.col("gid"))
        rows = _salted(stats.where("NOT base_failed").select("g_lang", "g_source", "salt", *x), gives, ["g_lang", "g_source"]).select("gid", "salt", *x)
        known = estimates(rows)
        pick = own.keep(materialize(groups.join(known, "gid", "left").drop("gid", "n"), "pick"))
    release(docs.sparkSession)
    out = _salted(stats, pick, ["g_lang", "g_source"]).withColumns({f"x{i}": F.col(f"x{i}") - F.col(f"c{i}") for i in range(P)})
    out = with_distance(out).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True)))
    return out.select("row", F.struct(*names).alias("verdict"))


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, keep: tuple[str, ...] = ("doc_id",), lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns `keep` of each row, and those of judged()'s verdict, which must have other names."""
    out = judged(docs, keep, cutoff, lang, source)
    return out.select("row.*", "verdict.*")


def op1_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: quality_verdicts(table(spark, sf_dir, "documents")), "verdicts")
