"""Queries of the corpus plane, over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus
from ..operators.rewrite import rewrite
from .register import query, table

#: A seeded order that DuckDB repeats: 48 bits of md5('seed:key').
H = "('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 12))::BIGINT"
H_DOC = H.format(seed=1337, key="doc_id")


@query(r"""
    WITH p AS (SELECT source, unnest(regexp_split_to_array(text, '\n\s*')) AS para FROM documents),
         c AS (SELECT source, count(*) AS n_paragraphs, sum(length(para))::BIGINT AS n_chars
               FROM (SELECT source, trim(regexp_replace(para, '\s+', ' ', 'g')) AS para FROM p) WHERE length(para) >= 200 GROUP BY source)
    SELECT source, n_paragraphs, n_chars, round(n_paragraphs / sum(n_paragraphs) OVER (), 4) AS share FROM c""")
def paragraphs_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.paragraphs(table(spark, sf_dir, "documents").select("source", "text"), 200, r"\n\s*")
    counts = docs.groupBy("source").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("text")).cast("long").alias("n_chars"))
    return counts.withColumn("share", F.round(F.col("n_paragraphs") / F.sum("n_paragraphs").over(Window.partitionBy()), 4))


@query(r"SELECT doc_id, source, length(text)::BIGINT AS n FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])than')")
def regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A word's left boundary is spelled out, because engines differ on \b beside other than ASCII letters.
    return corpus.matching(table(spark, sf_dir, "documents"), r"(?i)(^|[^\p{L}\p{N}_])than").select("doc_id", "source", F.length("text").cast("long").alias("n"))


@query("""SELECT page_id, CASE WHEN a > 0 THEN substr(html, a + 9, CASE WHEN e > 0 THEN greatest(e - a - 9, 0) ELSE length(html) END)
          ELSE substr(html, 1, CASE WHEN e > 0 THEN e - 1 ELSE length(html) END) END AS body
          FROM (SELECT page_id, html, instr(html, '<article>') AS a, instr(html, '</article>') AS e FROM pages)""")
def strip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", corpus.between_markers(F.col("html"), "<article>", "</article>").alias("body"))


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {H_DOC}, doc_id) <= 50 THEN 'validation' ELSE 'train' END AS split FROM documents")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@query(f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {H_DOC}, doc_id) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.02)) THEN 'validation' ELSE 'train' END AS split FROM documents""")
def fraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fraction_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.02)


@query(f"SELECT doc_id, source FROM documents ORDER BY {H_DOC}, doc_id LIMIT 100")
def shuffle_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shuffle_select(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


def _weighted(spark: SparkSession, sf_dir: str, weights: tuple[float, ...]) -> tuple[DataFrame, dict]:
    """All sources of documents and weights that repeat in the order of their names, a null one last; a row for each comes to the driver."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    names = sorted((r.source for r in docs.select("source").distinct().collect()), key=lambda n: (n is None, n or ""))
    return docs, {n: weights[i % len(weights)] for i, n in enumerate(names)}


def _mixed(spark: SparkSession, sf_dir: str, weights: tuple[float, ...]) -> DataFrame:
    return corpus.combine_by(*_weighted(spark, sf_dir, weights), "doc_id")


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def combine_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, (1.0,)).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"""
    WITH w AS (SELECT source, n, [3.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
    n AS (SELECT source, weight / (SELECT sum(weight) FROM w) AS p, n FROM w),
    t AS (SELECT source, p, n, round_even((SELECT max(n / p) FROM n) * p, 0)::BIGINT AS total FROM n),
    i AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {H_DOC}, doc_id) - 1 AS i FROM documents),
    o AS (SELECT i.doc_id, i.source, k, p FROM (SELECT *, unnest(range(total)) AS k FROM t) t JOIN i ON i.source IS NOT DISTINCT FROM t.source AND i.i = k % n)
    SELECT doc_id, source, round((k + {H.format(seed=1337, key="(coalesce(source, 'None') || ':' || k)")} / 281474976710656.0::DOUBLE) / p, 6) AS output_order FROM o""")
def combine_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of 3, 1 and 1 in turn, in the order of the sources' names."""
    out = _mixed(spark, sf_dir, (3.0, 1.0, 1.0))
    return out.select("doc_id", "source", F.round("output_order", 6).alias("output_order"))


@query(f"""
    WITH w AS (SELECT source, n, [3.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
    c AS (SELECT source, n, row_number() OVER (ORDER BY source NULLS LAST) AS s, floor(sum(weight) OVER (ORDER BY source NULLS LAST) / (SELECT sum(weight) FROM w) * 281474976710656.0::DOUBLE)::BIGINT AS upto FROM w),
    u AS (SELECT list(upto ORDER BY s) AS cuts FROM c),
    d AS (SELECT i AS output_order, len(list_filter((SELECT cuts FROM u), lambda x: x <= {H.format(seed=1337, key="i")})) + 1 AS s FROM range((SELECT 100 * count(*) + 1000 FROM documents)) r(i)),
    k AS (SELECT output_order, s, row_number() OVER (PARTITION BY s ORDER BY output_order) - 1 AS k FROM d),
    t AS (SELECT max(output_order) AS last FROM k JOIN c USING (s) WHERE k = n - 1),
    i AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {H_DOC}, doc_id) - 1 AS i FROM documents)
    SELECT doc_id, c.source, output_order FROM k JOIN c USING (s) JOIN i ON i.source IS NOT DISTINCT FROM c.source AND i.i = k % n WHERE output_order <= (SELECT last FROM t)""")
def interleave_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same weights, a source drawn for each position until all are used up."""
    docs, weights = _weighted(spark, sf_dir, (3.0, 1.0, 1.0))
    return corpus.interleave(docs.select("doc_id", "source"), weights, "doc_id")


@query(f"""
    WITH s AS (SELECT source, text, CASE WHEN row_number() OVER (ORDER BY {H_DOC}, doc_id) <= 50 THEN 'validation' ELSE 'train' END AS split FROM documents),
    t AS (SELECT source, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'validation') AS val_rows,
          coalesce(sum(n + 1) FILTER (split = 'train' AND n > 0), 0)::BIGINT AS train_tokens
          FROM (SELECT *, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n FROM s) GROUP BY source)
    SELECT source, train_rows, val_rows, round(train_rows / sum(train_rows) OVER (), 4) AS row_share, train_tokens FROM t""")
def recipe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, shares and tokens by source; words and an end token stand in for a tokenizer's ids."""
    docs = corpus.exact_split(table(spark, sf_dir, "documents").select("doc_id", "source", F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("n")), "doc_id", 50)
    totals = docs.groupBy("source").agg(F.coalesce(F.sum(F.when((F.col("split") == "train") & (F.col("n") > 0), F.col("n") + 1)), F.lit(0)).cast("long").alias("train_tokens"))
    return corpus.row_shares(docs).join(totals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def dialect_sql(text: str) -> str:
    """The dialect as DuckDB SQL: a text is cut into words and what stands between them, and each piece is looked at with its neighbours."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in corpus.DIALECT_FORMS.items() if " " not in a)
    (small, small_to), (large, large_to) = sorted(((a, b) for a, b in corpus.DIALECT_FORMS.items() if " " in a), reverse=True)
    (one, two), (capital, _) = small.split(" "), large.split(" ")
    firsts = f"({quoted(one)}, {quoted(capital)})"
    piece = f"""CASE WHEN x = {quoted(one)} AND t[i + 1] = ' ' AND t[i + 2] = {quoted(two)} THEN {quoted(small_to)}
        WHEN x = {quoted(capital)} AND t[i + 1] = ' ' AND t[i + 2] = {quoted(two)} THEN {quoted(large_to)}
        WHEN x = ' ' AND i > 1 AND t[i - 1] IN {firsts} AND t[i + 1] = {quoted(two)} THEN ''
        WHEN x = {quoted(two)} AND i > 2 AND t[i - 1] = ' ' AND t[i - 2] IN {firsts} THEN ''
        ELSE coalesce(MAP {{{words}}}[x], x) END"""
    pieces = f"regexp_extract_all({text}, '[A-Za-z'']+|[^A-Za-z'']+')"
    return f"list_transform([{pieces}], lambda t: array_to_string(list_transform(t, lambda x, i: {piece}), ''))[1]"


#: Texts with equal neighbours, phrases and apostrophes beside the documents.
_HARD = [(-1, "the the sea and and"), (-2, "My friend, my friend's friend my my friend friends"), (-3, "The 'the the' theirs\nyou You YOU to-to to.to"), (-4, ""), (-5, "é the é")]
_HARD_SQL = " UNION ALL ".join("SELECT {}, '{}'".format(i, t.replace("'", "''")) for i, t in _HARD)


@query(f"SELECT doc_id, {dialect_sql('text')} AS text FROM (SELECT doc_id, text FROM documents UNION ALL {_HARD_SQL})")
def dialect_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and some short texts that are hard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_HARD, "doc_id long, text string"))
    return docs.select("doc_id", corpus.dialect(F.col("text")).alias("text"))


@query(r"""WITH w AS (SELECT DISTINCT lower(x) AS phrase FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z'']+')) AS x FROM benchmark)),
    t AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z'']+|[^A-Za-z'']+') AS p FROM documents)),
    j AS (SELECT doc_id, i, x, reverse(phrase) AS r, replace(x, '''', '') AS l FROM t LEFT JOIN w ON phrase = lower(x)),
    k AS (SELECT doc_id, i, CASE WHEN r IS NULL THEN CASE WHEN regexp_matches(x, '^[A-Za-z''].*[iI][nN][gG]$') THEN left(x, -3) || CASE WHEN x = upper(x) THEN 'IN''' ELSE 'in''' END ELSE x END
          WHEN len(l) > 1 AND l = upper(l) THEN upper(r) WHEN left(x, 1) BETWEEN 'A' AND 'Z' THEN upper(left(r, 1)) || substr(r, 2) ELSE r END AS y FROM j)
    SELECT doc_id, sha256(coalesce(string_agg(y, '' ORDER BY i), '')) AS sha256 FROM documents d LEFT JOIN k USING (doc_id) WHERE d.text IS NOT NULL GROUP BY doc_id""")
def phrase_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten by a dictionary of all words of the benchmark, each spelled backwards, and an ending."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0))).alias("w"))
    phrases = words.select(F.lower("w").alias("phrase")).distinct().withColumn("replacement", F.reverse("phrase"))
    out = rewrite(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), "text", phrases, (("ing", "in'"),))
    return out.select("doc_id", F.sha2("text", 256).alias("sha256"))
