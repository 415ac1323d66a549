"""Quality rules for documents and hosts, as DataFrame expressions.

A document's counts come from its whole text without leaving its row: windows of three words are hashed,
sorted with their places, and a window that equals its neighbour is a repeated one.

Base rules reject a document outright: fewer than MIN_WORDS words, or more than half of its words inside
repeated windows. Soft rules (share of symbols, repeated lines, length of words) are judged by host:
the failures of each host (any rule) are summed before the shuffle, and its rate is shrunk towards the mean of
all hosts by a beta prior fitted to them by moments. How far a document is over the limit of a soft rule, as
a multiple of the limit, is its severity (the largest counts). The host's rate sets how much a rule
forgives: a document that fails a soft rule is rejected if severity * rate > HOST_RATE. So a host that fails in
half of its documents loses every soft failure, and a good one only texts far beyond a limit. Documents
that fail no rule are always kept.

Edges. ``source`` is the host of a document; null is a host of its own. Null and empty texts have no words, so
they fail the base rules. An empty table gives an empty result. Repeated rows, and rows with an equal or
null doc_id, are judged each on its own text and count as often as they come. Texts of any length are read
whole. Other columns are kept by keep(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, Store, let, read, words

MIN_WORDS, MAX_REPEAT = 50, 50
#: Per cent of symbols to words, of repeated lines to lines; least and most code points in a mean word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_CHARS = 25, 30, (2, 15)
HOST_RATE = 0.5
#: Least and most weight (in documents) of the prior.
PRIOR_WEIGHT = (2.0, 1000.0)


def repeated_words(ws: Column) -> Column:
    """How many words stand in a three-word window that comes twice or more."""

    def covered(sorted_windows: Column) -> Column:
        again = F.filter(F.transform(sorted_windows, lambda s, i: F.when((F.get(sorted_windows, i - 1)["h"] == s["h"]) | (F.get(sorted_windows, i + 1)["h"] == s["h"]), s["at"])), lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda p: F.array(p, p + 1, p + 2)))))

    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("at")))
    return F.when(F.size(ws) > 3, let(F.sort_array(windows), covered)).otherwise(0)


def counts(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of a text."""

    def lines(t: Column) -> Column:
        return let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))

    def of(t: Column, ws: Column) -> Column:
        return let(
            lines(t),
            lambda n: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                n["dup"].alias("n_dup_lines"),
                repeated_words(ws).cast("long").alias("n_repeat_words"),
                n["n"].alias("n_lines"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda ws: of(t, ws)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def soft_failed() -> Column:
    return (
        (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
        | (F.col("word_chars") < WORD_CHARS[0] * F.col("n_words"))
        | (F.col("word_chars") > WORD_CHARS[1] * F.col("n_words"))
    )


def severity() -> Column:
    """The largest multiple of a soft rule's limit that a document reaches; over 1 where it fails one."""
    over = F.greatest(
        100 * F.col("n_symbols") / (MAX_SYMBOLS * F.col("n_words")),
        100 * F.col("n_dup_lines") / (MAX_DUP_LINES * F.col("n_lines")),
        WORD_CHARS[0] * F.col("n_words") / F.col("word_chars"),
        F.col("word_chars") / (WORD_CHARS[1] * F.col("n_words")),
    )
    return F.when(F.col("n_words") > 0, over).otherwise(0.0)


def judged(docs: DataFrame, *own: Column | str) -> DataFrame:
    """source, the counts, base_failed, soft_failed and severity of every document, and ``own`` columns of it."""
    out = docs.select(*own, "source", counts(F.col("text")).alias("c")).select(*[c if isinstance(c, str) else F.col("row") for c in own], "source", "c.*")
    return out.withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed()).withColumn("severity", severity())


def host_rates(judged: DataFrame) -> DataFrame:
    """source, n, failed, worst, rate: each host's failure rate, shrunk by the beta prior of all hosts."""
    worst = F.max(F.when(F.col("soft_failed") & ~F.col("base_failed"), F.col("severity")))
    hosts = judged.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"), worst.alias("worst"))
    raw = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(raw).alias("mean"), F.coalesce(F.var_pop(raw), F.lit(0.0)).alias("var"), F.avg(1 / F.col("n")).alias("inverse"))
    # Moments: variance between hosts, less what their sizes alone would give.
    between = F.greatest(F.col("var") - F.col("mean") * (1 - F.col("mean")) * F.col("inverse"), F.lit(1e-9))
    weight = F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / between - 1, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1]))
    first = prior.select("mean", weight.alias("weight")).first()
    mean, weight = (first.mean or 0.0), (first.weight or PRIOR_WEIGHT[0])
    return hosts.withColumn("rate", (F.col("failed") + mean * weight) / (F.col("n") + weight))


def verdicts(store: Store, judged: DataFrame) -> DataFrame:
    """``judged``, which is a written table, with host_rate (of hosts that lose a document) and kept.

    Only hosts of which a document is rejected are joined back; they are broadcast if a count proves them few."""
    strict = host_rates(judged).where(F.col("worst") * F.col("rate") > HOST_RATE)
    strict = store.write(strict.select(F.col("source").alias("host"), F.col("rate").alias("host_rate")))
    small = strict.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
    out = judged.join(F.broadcast(strict) if small else strict, judged["source"].eqNullSafe(strict["host"]), "left")
    rejected = F.col("soft_failed") & F.coalesce(F.col("severity") * F.col("host_rate") > HOST_RATE, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("host")


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, the counts, base_failed, soft_failed, severity, host_rate and kept for every row of ``docs`` (doc_id, text, source, and more)."""
    store = Store(spark)
    return verdicts(store, store.write(judged(docs, "doc_id")))


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all of its columns.

    The rules are evaluated once: rows are written with their verdicts, without the ones that base rules
    reject, which only count for their hosts."""
    store, own = Store(spark), docs.columns
    rows = judged(docs, F.struct(*own).alias("row"))
    rows = store.write(rows.select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "source", "base_failed", "soft_failed", "severity"))
    return verdicts(store, rows).where("kept").select("row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    out = judge(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
      (100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS soft_failed,
      CASE WHEN n_words > 0 THEN greatest(100 * n_symbols / (25 * n_words), 100 * n_dup_lines / (30 * n_lines), 2 * n_words / word_chars, word_chars / (15 * n_words)) ELSE 0 END AS severity FROM c),
h AS (SELECT source, count(*) AS n, sum((base_failed OR soft_failed)::BIGINT) AS failed FROM f GROUP BY source),
m AS (SELECT avg(failed / n) AS mean, coalesce(var_pop(failed / n), 0) AS var, avg(1 / n) AS inverse FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inverse, 1e-9) - 1, 2.0), 1000.0) AS weight FROM m),
r AS (SELECT source, (failed + mean * weight) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (soft_failed AND severity * rate > 0.5)) AS kept FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source
"""
