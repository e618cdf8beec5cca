"""The driver's tables as series, partitions and p-values; each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netscale.operators.corr import correlation
from netscale.operators.series import densify
from netscale.operators.stats import correlation_pvalue, ranked_by
from netscale.sources.shared import written

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_month_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of order prices by nation and month since 1992."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("int")
    rows = orders.select(F.col("o_custkey").alias("c_custkey"), t.alias("t"), "o_totalprice").join(customer.select("c_custkey", "c_nationkey"), "c_custkey")
    return rows.groupBy(F.col("c_nationkey").alias("series_id"), "t").agg(F.sum("o_totalprice").alias("value"))


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(densify(written(nation_month_sparse(spark, sf_dir), "nation_month_sparse")), "nation_month")


def event_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of event values by type (numbered by name) and hour, of all hours of January 2024 at least, 0 where there is none."""
    events = table(spark, sf_dir, "events").where("event_type is not null")
    kinds = written(numbered(events.select("event_type").distinct(), "event_type", "series_id").withColumn("series_id", F.col("series_id").cast("int")), "kinds")
    t = F.expr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01', ts) as int)")
    rows = written(events.join(kinds, "event_type").groupBy("series_id", t.alias("t")).agg(F.sum("value").alias("value")), "event_hours")
    ends = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    full = kinds.select("series_id", F.explode(F.sequence(F.least(F.lit(0), F.lit(ends.a or 0)), F.greatest(F.lit(719), F.lit(ends.b or 0)))).alias("t"))
    return full.join(rows, ["series_id", "t"], "left").select("series_id", "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def emb_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as series over their dimensions, with their label."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("label", F.col("vec_id").cast("int").alias("series_id"), F.posexplode("embedding").alias("t", "v")).select("label", "series_id", "t", F.col("v").cast("double").alias("value"))


def user_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A community (its commonest event type, the first of equal ones, numbered from 1 by name) of each user for each week it has events in."""
    events = table(spark, sf_dir, "events").where("event_type is not null and user_id is not null and ts is not null")
    kinds = numbered(events.select("event_type").distinct(), "event_type", "kind")
    stage = F.expr("cast(floor(timestampdiff(DAY, timestamp_ntz'2024-01-01', ts) / 7) as int)")
    n = events.groupBy(F.col("user_id").alias("node"), stage.alias("stage"), "event_type").agg(F.count("*").alias("n"))
    best = n.groupBy("node", "stage").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("event_type"))
    rows = best.join(kinds, "event_type")
    return written(rows.select("node", "stage", F.pow(F.lit(10.0), F.col("stage") - 2.0).alias("tau"), (F.col("kind") + 1).cast("int").alias("community")), "user_week")


def nation_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(correlation(nation_month(spark, sf_dir)), "nation_corr")


def pair_pvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values of the correlations between nations, of as many samples as there are months."""
    n = nation_month(spark, sf_dir).select("t").distinct().count()
    return nation_corr(spark, sf_dir).select("i", "j", F.round(correlation_pvalue(F.col("r"), F.lit(n)), 9).alias("p"))


def user_kind_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (a, b) between users and the (event type, hour) in which they have an event; a type has as many numbers as there are hours."""
    events = table(spark, sf_dir, "events").where("event_type is not null and user_id is not null")
    kinds = written(numbered(events.select("event_type").distinct(), "event_type", "kind"), "kinds")
    hour = F.expr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01', ts) as bigint)")
    rows = written(events.join(kinds, "event_type").select(F.col("user_id").alias("a"), "kind", hour.alias("hour")), "hours")
    most = rows.agg(F.max("hour")).first()[0] or 0
    return rows.select("a", (F.col("kind") * (most + 1) + F.col("hour")).alias("b")).distinct()


def numbered(names: DataFrame, name: str, number: str) -> DataFrame:
    """Distinct names with their numbers from 0 in their order, ranked by ranges, not in one task."""
    ranked, _ = ranked_by(names.select(name), [name])
    return ranked.select(name, (F.col("rank") - 1).alias(number))


NATION_SPARSE = """nm AS (SELECT c_nationkey AS series_id, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INT) AS t, sum(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
NATION = f"""{NATION_SPARSE},
nation_month AS (SELECT s.series_id, g.t, coalesce(value, 0) AS value FROM (SELECT DISTINCT series_id FROM nm) s CROSS JOIN (SELECT DISTINCT t FROM nm) g LEFT JOIN nm USING (series_id, t))"""
EVENTS = """kinds AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS series_id FROM (SELECT DISTINCT event_type FROM events)),
eh AS (SELECT series_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INT) AS t, sum(value) AS value FROM events JOIN kinds USING (event_type) GROUP BY 1, 2),
event_hour AS (SELECT k.series_id, CAST(h.t AS INT) AS t, coalesce(value, 0) AS value FROM kinds k CROSS JOIN range(720) h(t) LEFT JOIN eh ON eh.series_id = k.series_id AND eh.t = h.t)"""
EMB = """emb AS (SELECT label, CAST(vec_id AS INT) AS series_id, CAST(p - 1 AS INT) AS t, CAST(embedding[p] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(p))"""
CORR = f"""{NATION},
corr AS (SELECT a.series_id AS i, b.series_id AS j, round(corr(a.value, b.value), 12) AS r FROM nation_month a JOIN nation_month b ON a.t = b.t AND a.series_id < b.series_id GROUP BY 1, 2)"""
USERS = """kd AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS kind FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
uc AS (SELECT user_id AS node, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 604800) AS INT) AS stage, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3),
ub AS (SELECT node, stage, event_type, row_number() OVER (PARTITION BY node, stage ORDER BY n DESC, event_type) AS rn FROM uc),
part AS (SELECT node, stage, power(10.0, stage - 2.0) AS tau, CAST(kind AS INT) AS community FROM ub JOIN kd USING (event_type) WHERE rn = 1)"""
PVALS = f"""{CORR}, months AS (SELECT count(DISTINCT t) AS n FROM nation_month),
pvals AS (SELECT i, j, round(greatest(0, 1 - abs(r) * (SELECT sum(exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4.0::DOUBLE)) * power(1 - r * r, k)) FROM months, range(0, (n - 2) // 2) g(k))), 9) + 0.0 AS p FROM corr)"""
LINKS = """ek AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS kind FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL)),
eh2 AS (SELECT user_id AS a, kind, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT) AS h FROM events JOIN ek USING (event_type) WHERE user_id IS NOT NULL),
links AS (SELECT DISTINCT a, kind * ((SELECT max(h) FROM eh2) + 1) + h AS b FROM eh2)"""
