"""Queries of the sequence plane, over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat, corpus
from .corpus import H, dialect_sql
from .register import query, table

_TURNS = r"""
    c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'bot' ELSE 'user' END AS role, regexp_replace(coalesce(text, ''), '^[\s]+|[\s]+$', '', 'g') AS text FROM conversations),
    k AS (SELECT conv_id FROM c WHERE text <> '' GROUP BY conv_id HAVING count(*) >= 2 AND count(*) FILTER (role = 'bot') > 0),
    t AS (SELECT c.conv_id, role, text, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY c.conv_id) AS n FROM c JOIN k ON c.conv_id = k.conv_id WHERE text <> ''),
    r AS (SELECT *, (CASE WHEN i = 1 THEN '' ELSE chr(10) END) || (CASE WHEN role = 'user' THEN 'User: ' ELSE 'Pirate: ' END) AS cue FROM t)"""


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


@query(f"WITH {_TURNS} SELECT conv_id, string_agg(cue || text, '' ORDER BY i) AS text FROM r GROUP BY conv_id")
def conversation_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", chat.render(F.col("turns")).alias("text"))


@query(f"WITH {_TURNS} SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'bot') AS n_bot FROM t GROUP BY conv_id")
def conversation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("turns", lambda t: t["role"] == "bot")).cast("long").alias("n_bot"))


@query(f"WITH {_TURNS} SELECT conv_id, string_agg(CASE WHEN role = 'bot' THEN {dialect_sql('text')} ELSE text END, chr(10) ORDER BY i) AS text FROM t GROUP BY conv_id")
def bot_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _conversations(spark, sf_dir).withColumn("turns", chat.map_bot(F.col("turns"), corpus.dialect))
    return out.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("text"))


def _letters(text):
    """Stand-in tokens: the code point of each letter, so that ids and masks can be checked in SQL."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def _sum(ids, name: str):
    """A sum that depends on the order of the ids: each counts as often as its place, from 1 to 997 and again."""
    return F.aggregate(F.transform(ids, lambda x, i: x.cast("long") * (i % 997 + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias(name)


_SUM = "coalesce(list_sum(list_transform({0}, lambda x, i: x * ((i - 1) % 997 + 1))), 0)::BIGINT"
_POINTS = "list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)"
#: Ids and labels of every turn, and of whole conversations.
_IDS = f"""q AS (SELECT conv_id, i, n, role, {_POINTS.format("cue")} AS head, {_POINTS.format("text")} AS body FROM r),
    e AS (SELECT conv_id, i, n, CASE role WHEN 'bot' THEN head || body || [0::BIGINT] ELSE head || body END AS ids,
          CASE role WHEN 'bot' THEN list_transform(head, lambda x: -100::BIGINT) || body || [0::BIGINT] ELSE list_transform(head || body, lambda x: -100::BIGINT) END AS labels FROM q)"""


@query(f"""WITH {_TURNS}, {_IDS},
    w AS (SELECT conv_id, flatten(list(ids ORDER BY i)) AS ids, flatten(list(labels ORDER BY i)) AS labels FROM e GROUP BY conv_id),
    u AS (SELECT conv_id, len(ids) > 512 AS truncated, ids[greatest(len(ids) - 511, 1):] AS ids, labels[greatest(len(ids) - 511, 1):] AS labels FROM w)
    SELECT conv_id, len(ids)::BIGINT AS n, len(list_filter(labels, lambda x: x <> -100))::BIGINT AS learned, truncated, {_SUM.format("ids")} AS id_sum,
           ({_SUM.format("labels || list_transform(range(512 - len(labels)), lambda x: -100::BIGINT)")}) AS label_sum FROM u WHERE len(list_filter(labels, lambda x: x <> -100)) > 0""")
def sft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding has the end token 0, so it adds nothing to the sum of ids, and masked labels, which the sum of labels has."""
    out = _conversations(spark, sf_dir).select("conv_id", chat.masked(F.col("turns"), _letters, 0, 512).alias("e")).where("e IS NOT NULL")
    return out.select("conv_id", F.col("e.n").cast("long").alias("n"), F.size(F.filter("e.labels", lambda x: x != chat.IGNORE)).cast("long").alias("learned"), "e.truncated", _sum("e.input_ids", "id_sum"), _sum("e.labels", "label_sum"))


@query(f"""WITH {_TURNS}, {_IDS},
    z AS (SELECT conv_id, i, n, ids, CASE i WHEN 1 THEN ids ELSE ids[2:] END AS first_ids FROM e),
    y AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM z),
    f AS (SELECT conv_id, min(i) AS start FROM y WHERE len(first_ids) + later + 9 <= 384 OR i = n GROUP BY conv_id),
    w AS (SELECT y.conv_id, flatten(list(CASE WHEN i = start THEN first_ids ELSE ids END ORDER BY i)) || {_POINTS.format("chr(10) || 'Pirate: '")} AS ids FROM y JOIN f ON y.conv_id = f.conv_id AND i >= start GROUP BY y.conv_id),
    v AS (SELECT conv_id, ids[greatest(len(ids) - 383, 1):] AS ids FROM w)
    SELECT conv_id, len(ids)::BIGINT AS n_ids, {_SUM.format("ids")} AS id_sum FROM v""")
def rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _conversations(spark, sf_dir).select("conv_id", chat.prompt_window(F.col("turns"), _letters, 0, 512, 128).alias("ids"))
    return out.select("conv_id", F.size("ids").cast("long").alias("n_ids"), _sum("ids", "id_sum"))


@query(r"""WITH c AS (SELECT conv_id, role, turn, regexp_replace(coalesce(text, ''), '^[\s]+|[\s]+$', '', 'g') AS text FROM conversations),
    f AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS i, coalesce(arg_min(text, turn) FILTER (role = 'system'), '') AS s, coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS a FROM c GROUP BY conv_id)
    SELECT conv_id, 'User: ' || i || (CASE WHEN s <> '' THEN chr(10) || s ELSE '' END) || chr(10) || 'Pirate: ' || a AS text, '### Instruction:' || chr(10) || i || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM f WHERE i <> '' AND a <> ''""")
def instruction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first user, system and assistant texts as instruction, context and response."""
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first("user").alias("instruction"), first("system").alias("context"), first("assistant").alias("response"))
    return chat.instructions(rows).join(rows, "conv_id").select("conv_id", chat.render(F.col("turns")).alias("text"), chat.instruction_prompt(F.col("instruction")).alias("prompt"))


@query()
def sft_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of masked, rewritten, split examples."""
    built = chat.examples(_conversations(spark, sf_dir), _letters, 0, 512, rewrite=corpus.dialect)
    return chat.batches(built.where("split = 'train'"), 8, 32)


@query(f"""WITH {_TURNS}, {_IDS},
    w AS (SELECT conv_id, flatten(list(ids ORDER BY i)) AS ids, flatten(list(labels ORDER BY i)) AS labels FROM e GROUP BY conv_id),
    u AS (SELECT conv_id, ids[greatest(len(ids) - 511, 1):] AS ids, labels[greatest(len(ids) - 511, 1):] AS labels FROM w),
    s AS (SELECT *, row_number() OVER (ORDER BY {H.format(seed=1337, key="conv_id")}, conv_id) AS r, count(*) OVER () AS n FROM u WHERE len(list_filter(labels, lambda x: x <> -100)) > 0),
    train AS (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS pos, ids[1:511] AS x, (labels || list_transform(range(512 - len(labels)), lambda x: -100::BIGINT))[2:512] AS y FROM s WHERE r > greatest(1, floor(n * 0.02))),
    d AS (SELECT i // 32 AS batch, i % 32 AS place, {H.format(seed=1337, key="i")} % (SELECT count(*) FROM train) AS pos FROM range(256) r(i))
    SELECT batch, place, {_SUM.format("x")} AS x_sum, {_SUM.format("y")} AS y_sum FROM d JOIN train USING (pos)""")
def sft_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of masked, split examples, as sums that depend on the order of what they hold."""
    built = chat.examples(_conversations(spark, sf_dir), _letters, 0, 512)
    return chat.batches(built.where("split = 'train'"), 8, 32).select("batch", "place", _sum("x", "x_sum"), _sum("y", "y_sum"))


@query(f"""WITH {_TURNS}, {_IDS},
    w AS (SELECT conv_id, flatten(list(ids ORDER BY i)) AS ids, flatten(list(labels ORDER BY i)) AS labels FROM e GROUP BY conv_id),
    x AS (SELECT conv_id, len(ids) > 512 AS truncated FROM w WHERE len(list_filter(labels[greatest(len(ids) - 511, 1):], lambda x: x <> -100)) > 0)
    SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM w) - (SELECT count(*) FROM x) AS skipped, (SELECT count(*) FROM x WHERE truncated) AS truncated,
           (SELECT count(*) FROM x WHERE truncated) / greatest((SELECT count(*) FROM x), 1) AS truncated_share""")
def sft_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = _conversations(spark, sf_dir)
    return chat.summary(convs, chat.examples(convs, _letters, 0, 512))
