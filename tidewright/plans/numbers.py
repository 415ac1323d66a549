"""Queries of numeric operators, over stand-in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from .corpus import H
from .register import query, table


@query("SELECT l_returnflag, sum(l_quantity) AS n_tokens, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 6) AS perplexity FROM lineitem GROUP BY l_returnflag")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.perplexity(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", ("l_returnflag",))
    return out.select("l_returnflag", "n_tokens", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@query("SELECT l_returnflag AS split, count(l_discount) AS n, round(avg(l_discount), 9) AS loss FROM lineitem GROUP BY l_returnflag")
def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("split"), "l_discount")
    return metrics.mean_loss(rows, "l_discount").withColumn("loss", F.round("loss", 9))


@query("SELECT source, least(greatest(1, round_even(2.0::DOUBLE * sum(n_chars) / (4 * 16 * 2), 0)), 5000)::BIGINT AS steps FROM documents GROUP BY source")
def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of two epochs of each source, 5000 at most."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return rows.select("source", metrics.horizons(2.0, F.col("n"), 4, 16, 2, 5000).alias("steps"))


@query("""SELECT event_id, round(CASE WHEN step < 100 THEN 3e-4 * (step + 1) / 101 WHEN step > 900 THEN 3e-5 ELSE 3e-5 + 0.5 * (1 + cos(pi() * (step - 100) / 800.0)) * (3e-4 - 3e-5) END, 10) AS rate
    FROM (SELECT event_id, event_id % 1000 AS step FROM events)""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at each event's step of a run of 1000."""
    steps = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000).alias("step"))
    return steps.select("event_id", F.round(metrics.learning_rate(F.col("step"), 3e-4, 3e-5, 100, 900), 10).alias("rate"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / 0.8) AS a FROM embeddings),
    c AS (SELECT vec_id, list_max(a) AS top, list_reverse_sort(a)[10] AS cut, a FROM s),
    e AS (SELECT vec_id, list_transform(a, lambda x: CASE WHEN x >= cut THEN exp(x - top) ELSE 0.0 END) AS e FROM c)
    SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS largest, len(list_filter(e, lambda x: x > 0))::INT AS kept FROM e""")
def topk_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "embeddings").select("vec_id", metrics.top_k_softmax(F.col("embedding"), 10, 0.8).alias("p"))
    return out.select("vec_id", F.round(F.array_max("p"), 6).alias("largest"), F.size(F.filter("p", lambda x: x > 0)).alias("kept"))


@query(f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / 0.1) AS a FROM embeddings),
    e AS (SELECT vec_id, list_transform(a, lambda x: CASE WHEN x >= list_reverse_sort(a)[10] THEN exp(x - list_max(a)) ELSE 0.0 END) AS e FROM s),
    p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p, {H.format(seed=7, key="vec_id")} / 281474976710656.0::DOUBLE AS u FROM e)
    SELECT vec_id, coalesce(list_min(list_filter(range(len(p)), lambda i: list_sum(p[1:i + 1]) > u)), list_max(list_filter(range(len(p)), lambda i: p[i + 1] > 0)))::INT AS place FROM p""")
def topk_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component of each vector, drawn from the softmax of its ten largest."""
    kept = table(spark, sf_dir, "embeddings").select("vec_id", metrics.top_k_softmax(F.col("embedding"), 10, 0.1).alias("p"))
    return kept.select("vec_id", metrics.draw(F.col("p"), F.col("vec_id"), 7).alias("place"))


@query("""SELECT vec_id, round(list_max(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding) + 1e-5), 6) AS largest FROM embeddings""")
def rmsnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(metrics.rms_norm(F.col("embedding"))), 6).alias("largest"))


@query("SELECT p.id AS id, q.pair::INT AS pair, round(cos(p.id / pow(10000.0, 2.0 * q.pair / 64)), 6) AS cos, round(sin(p.id / pow(10000.0, 2.0 * q.pair / 64)), 6) AS sin FROM (SELECT DISTINCT turn AS id FROM conversations) p, range(32) q(pair)")
def rope_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotary table at the places that turns have in their conversations."""
    places = table(spark, sf_dir, "conversations").select(F.col("turn").cast("long").alias("id")).distinct()
    return metrics.rotary(places, 64).select("id", "pair", F.round("cos", 6).alias("cos"), F.round("sin", 6).alias("sin"))


@query("""SELECT source, CASE WHEN n >= 1e9 THEN printf('%.1fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.1fK', n / 1e3) ELSE n::VARCHAR END AS label
    FROM (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source)""")
def count_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return n.select("source", metrics.count_label(F.col("n")).alias("label"))


@query("SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_so_far(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id", "value", ("user_id",))
