"""Observations, clouds, rays and maps derived from the driver's tables, in Spark
and, for comparison, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import lit
from .params import MapParams

#: The map that the queries build: coarse cells, and weights as the library's defaults.
MAP = MapParams(resolution=0.5, num_classes=14, trunc=1.0)


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Class observations of cells, in a total order by seq."""
    return _read(spark, sf, "events").selectExpr(
        "event_id AS seq", "CAST(datediff(CAST(ts AS DATE), DATE'2024-01-01') AS INT) AS frame_id", "CAST(user_id % 3 AS INT) AS source", "CAST(user_id % 8 AS INT) AS ix",
        "CAST(get_json_object(props,'$.k') AS INT) % 8 AS iy", "CAST(floor(value) AS INT) % 4 AS iz",
        "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS cls", "least(1.0D, value/100.0D) AS quality",
    )


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(lit(0), lit(20))).alias("pt"))
    x = lambda k: (F.get("embedding", 3 * F.col("pt") + k).cast("double") * 10).alias("xyz"[k])
    return e.select("vec_id", "pt", F.expr("CAST(vec_id div 50 AS INT)").alias("frame_id"), F.col("label").cast("int").alias("cls"), x(0), x(1), x(2))


def rays(spark: SparkSession, sf: str) -> DataFrame:
    """Rays from the origin to the cloud; the last point of a vector is a miss, class 9 moves.
    probs has the class and a second one; class 7 has no label."""
    c, k = cloud(spark, sf), F.col("cls")
    second = F.when(F.col("pt") % 3 == 0, 0.2).otherwise(0.3)
    probs = F.transform(F.sequence(lit(0), lit(9)), lambda i: F.when(i == k, lit(0.5) + F.col("pt") / 50).when(i == (k + 3) % 10, second).otherwise(0.0))
    return c.select(
        (F.col("vec_id") * 21 + F.col("pt")).alias("seq"), "frame_id", *[lit(0.0).alias(f"o{a}") for a in "xyz"], *[F.col(a).alias(f"e{a}") for a in "xyz"], "cls",
        (lit(0.5) + F.col("cls") / 20).alias("quality"), (F.col("cls") == 9).alias("is_dynamic"), F.when(F.col("pt") == 20, "miss").otherwise("hit").alias("kind"), F.when(k != 7, probs).alias("probs"),
    )


def beta(spark: SparkSession, sf: str) -> DataFrame:
    """Occupancy of three sources."""
    li = _read(spark, sf, "lineitem")
    part = lambda ok: lit(1.0) + F.sum(F.when(ok, F.col("l_quantity")).otherwise(0.0)) / 10
    a = F.col("l_returnflag") == "A"
    return li.groupBy((F.col("l_suppkey") % 3).cast("int").alias("source"), (F.col("l_partkey") % 40).cast("int").alias("ix"), (F.col("l_orderkey") % 40).cast("int").alias("iy"), F.col("l_linenumber").cast("int").alias("iz")).agg(part(a).alias("a_occ"), part(~a).alias("a_free"))


def beta_map(spark: SparkSession, sf: str) -> DataFrame:
    """The first source's occupancy."""
    return beta(spark, sf).where("source = 0").drop("source")


#: The same in DuckDB: each begins with a name that the next may use.
SQL = {
    "obs": """obs AS (SELECT event_id AS seq, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS frame_id, CAST(user_id % 3 AS INT) AS source, CAST(user_id % 8 AS INT) AS ix,
  CAST(json_extract_string(props,'$.k') AS INT) % 8 AS iy, CAST(floor(value) AS INT) % 4 AS iz,
  CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS INT) AS cls, least(1.0::double, value/100.0::double) AS quality FROM events)""",
    "cloud": """cloud AS (SELECT vec_id, j AS pt, CAST(vec_id // 50 AS INT) AS frame_id, CAST(label AS INT) AS cls, embedding[3*j+1]::double*10 AS x, embedding[3*j+2]::double*10 AS y, embedding[3*j+3]::double*10 AS z
  FROM (SELECT *, CAST(unnest(range(0,21)) AS INT) AS j FROM embeddings))""",
    "rays": """rays AS (SELECT vec_id*21+pt AS seq, frame_id, 0.0::double AS ox, 0.0::double AS oy, 0.0::double AS oz, x AS ex, y AS ey, z AS ez, cls, 0.5::double + cls/20.0::double AS quality, cls = 9 AS is_dynamic,
  CASE WHEN pt = 20 THEN 'miss' ELSE 'hit' END AS kind FROM cloud)""",
    "beta": """beta AS (SELECT CAST(l_suppkey % 3 AS INT) AS source, CAST(l_partkey % 40 AS INT) AS ix, CAST(l_orderkey % 40 AS INT) AS iy, CAST(l_linenumber AS INT) AS iz,
  1.0::double + sum(CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0.0::double END)/10.0::double AS a_occ, 1.0::double + sum(CASE WHEN l_returnflag<>'A' THEN l_quantity ELSE 0.0::double END)/10.0::double AS a_free
  FROM lineitem GROUP BY 1,2,3,4)""",
    "k": """k AS (SELECT *, CAST(floor(ox/0.5::double) AS INT) AS ax, CAST(floor(oy/0.5::double) AS INT) AS ay, CAST(floor(oz/0.5::double) AS INT) AS az, CAST(floor(ex/0.5::double) AS INT) AS bx, CAST(floor(ey/0.5::double) AS INT) AS by_, CAST(floor(ez/0.5::double) AS INT) AS bz FROM rays)""",
    "walk": """m AS (SELECT *, greatest(abs(bx-ax), abs(by_-ay), abs(bz-az)) AS m FROM k),
s AS (SELECT *, CAST(unnest(range(0, CASE WHEN kind = 'miss' THEN m+1 ELSE m END)) AS INT) AS step FROM m),
walk AS (SELECT seq, frame_id, kind, is_dynamic, quality, cls, step,
  CAST(ax + (CASE WHEN bx<ax THEN -1 ELSE 1 END) * (CASE WHEN m>0 THEN (2*step*abs(bx-ax)+m)//(2*m) ELSE 0 END) AS INT) AS ix,
  CAST(ay + (CASE WHEN by_<ay THEN -1 ELSE 1 END) * (CASE WHEN m>0 THEN (2*step*abs(by_-ay)+m)//(2*m) ELSE 0 END) AS INT) AS iy,
  CAST(az + (CASE WHEN bz<az THEN -1 ELSE 1 END) * (CASE WHEN m>0 THEN (2*step*abs(bz-az)+m)//(2*m) ELSE 0 END) AS INT) AS iz FROM s)""",
    "hits": """hits AS (SELECT seq, frame_id, cls, quality, is_dynamic, bx AS ix, by_ AS iy, bz AS iz FROM k WHERE kind = 'hit')""",
    "carve": """top AS (SELECT frame_id, ix, iy, iz, max(0.5::double*quality) AS w FROM walk GROUP BY ALL),
carve AS (SELECT ix, iy, iz, sum(w) AS inc FROM top ANTI JOIN (SELECT * FROM hits WHERE NOT is_dynamic) USING (frame_id, ix, iy, iz) GROUP BY ALL)""",
    "parts": """parts AS (SELECT seq, i, cls, share FROM (SELECT seq, CASE WHEN cls = 7 THEN [{'c': 65535, 's': 1.0::double}] ELSE list_sort([{'c': cls, 's': p1/greatest(1.0::double, p1 + p2)}, {'c': (cls + 3) % 10, 's': p2/greatest(1.0::double, p1 + p2)}]) || [{'c': 65535, 's': greatest(0.0::double, 1 - (p1 + p2))}] END AS l,
  unnest(range(0, len(l))) AS i, l[i+1].c AS cls, l[i+1].s AS share FROM (SELECT seq, cls, 0.5::double + (seq % 21)/50.0::double AS p1, CASE WHEN seq % 21 % 3 = 0 THEN 0.2::double ELSE 0.3::double END AS p2 FROM rays)))""",
    "run": """ev AS (SELECT frame_id, 1 AS phase, seq, ix, iy, iz, quality AS q, quality AS occ, 0.0::double AS free FROM hits WHERE NOT is_dynamic
  UNION ALL SELECT frame_id, 2, 0, ix, iy, iz, 0.0::double, 0.0::double, w FROM top ANTI JOIN (SELECT * FROM hits WHERE NOT is_dynamic) USING (frame_id, ix, iy, iz)),
ro AS (SELECT *, 1 + (sum(occ::DECIMAL(28,12)) OVER w)::double AS o, 1 + (sum(free::DECIMAL(28,12)) OVER w)::double AS f FROM ev WINDOW w AS (PARTITION BY ix, iy, iz ORDER BY frame_id, phase, seq)),
run AS (SELECT *, o/(o + f) AS p FROM ro WHERE phase = 1)""",
    "occ": """occ AS (SELECT ix, iy, iz, 1 + sum(o) AS a_occ, 1 + sum(f) AS a_free FROM (SELECT ix, iy, iz, quality AS o, 0.0::double AS f FROM hits WHERE NOT is_dynamic UNION ALL SELECT ix, iy, iz, 0.0::double, inc FROM carve) GROUP BY ALL)""",
}
NEEDS = {"rays": ["cloud"], "k": ["rays"], "walk": ["k"], "hits": ["k"], "carve": ["walk", "hits"], "occ": ["carve"], "parts": ["rays"], "run": ["carve"]}


def with_views(*names: str) -> str:
    """A WITH clause (without the last comma) of the named views and what they need."""
    done: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in done)
