"""Queries of the engine's own tokenizer operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, tokens
from .corpus import H
from .register import query, table


@query(r"SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, ' ?[\p{L}]+|[\p{N}]+')) AS word FROM documents) GROUP BY word")
def word_counts_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a pattern without look-ahead, which SQL engines have too."""
    return tokens.word_counts(table(spark, sf_dir, "documents"), pattern=r" ?[\p{L}]+|[\p{N}]+")


#: White space as the tokenizer has it, for a pattern without (?U).
_W = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"


# In SQL, which has no look-ahead, a mark is put before the last of several spaces that a word follows.
_MARKED = rf"regexp_replace(text, '([{_W}])([{_W}][^{_W}])', '\1' || chr(1) || '\2', 'g')"
_SPLIT = rf"regexp_extract_all({_MARKED}, '(?:''s|''t|''re|''ve|''m|''ll|''d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}\x01]+|[{_W}]+')"


@query(f"SELECT word, count(*) AS count FROM (SELECT unnest({_SPLIT}) AS word FROM documents) GROUP BY word")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.word_counts(table(spark, sf_dir, "documents"))


def _tokenizer(spark: SparkSession, sf_dir: str) -> dict:
    return tokens.train(table(spark, sf_dir, "documents"))


@query()
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = _tokenizer(spark, sf_dir)["merges"]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank long, left string, right string")


_NAMES = ["<|endoftext|>", *sorted(tokens.byte_letters())]
_OF_BYTE = [_NAMES.index(c) for c in tokens.byte_letters()]
_FIRST = 8


def _letters_sql(word: str) -> str:
    """A word's bytes as ids, each between commas."""
    return f"array_to_string(list_transform(regexp_extract_all(hex(encode({word})), '..'), lambda h: ',' || {_OF_BYTE}[('0x' || h)::INT + 1] || ','), '')"


def _first_merges_sql() -> str:
    names = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in _NAMES) + "]"
    steps = [f"w0 AS (SELECT {_letters_sql('word')} AS s, count(*) AS n FROM (SELECT unnest({_SPLIT}) AS word FROM documents) GROUP BY word)", f"t0 AS (SELECT {names} AS names)"]
    for i in range(_FIRST):
        ids = "list_transform(regexp_extract_all(s, '[0-9]+'), lambda x: x::INT)"
        pairs = f"SELECT a[k] AS l, a[k + 1] AS r, n FROM (SELECT *, unnest(range(1, len(a))) AS k FROM (SELECT {ids} AS a, n FROM w{i}))"
        steps += [
            f"p{i} AS MATERIALIZED (SELECT l, r FROM ({pairs}) GROUP BY l, r ORDER BY sum(n) DESC, l, r LIMIT 1)",
            f"t{i + 1} AS (SELECT list_append(names, names[l + 1] || names[r + 1]) AS names FROM t{i}, p{i})",
            f"w{i + 1} AS MATERIALIZED (SELECT replace(s, ',' || l || ',,' || r || ',', ',{len(_NAMES) + i},') AS s, n FROM w{i}, p{i})",
        ]
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS rank, names[l + 1] AS left, names[r + 1] AS right FROM p{i}, t{i}" for i in range(_FIRST))


@query(_first_merges_sql())
def bpe_first_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges that bpe_merges begins with; in SQL each one is found by counting the pairs anew."""
    merges = tokens.train(table(spark, sf_dir, "documents"), len(_NAMES) + _FIRST)["merges"]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank long, left string, right string")


#: A small vocabulary: each merge's parts are made by merges before it.
_FEW = [("e", "r"), ("Ġ", "t"), ("h", "e"), ("Ġt", "he"), ("i", "n"), ("Ġ", "a"), ("a", "n"), ("in", "g"), ("Ġa", "n"), ("an", "d"), ("Ġan", "d"), ("s", "s"), ("l", "l"), ("e", "n"), ("Ã", "©"), ("ss", "e"), ("a", "ll"), ("Ġ", "Ġ"), ("-", "-"), ("ĠĠ", "ĠĠ")]


def _few() -> dict:
    vocab = {n: i for i, n in enumerate(_NAMES)}
    for a, b in _FEW:
        vocab.setdefault(a + b, len(vocab))
    return {"vocab": vocab, "merges": [list(m) for m in _FEW]}


def _encoded_sql() -> str:
    vocab, s = _few()["vocab"], f"array_to_string(list_transform({_SPLIT}, lambda w: {_letters_sql('w')}), '#')"
    for a, b in _FEW:
        s = f"replace({s}, ',{vocab[a]},,{vocab[b]},', ',{vocab[a + b]},')"
    ids = f"regexp_extract_all({s}, '[0-9]+')"
    return f"SELECT doc_id, len(ids)::INT AS n_ids, array_to_string(ids, ' ') AS ids FROM (SELECT doc_id, CASE WHEN len(i) > 0 THEN list_append(i, '0') ELSE i END AS ids FROM (SELECT doc_id, {ids} AS i FROM documents))"


@query(_encoded_sql())
def encode_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by a small vocabulary that is given, so that SQL can join the parts one merge after the other."""
    out = tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), _few())
    return out.select("doc_id", F.size("ids").alias("n_ids"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query()
def encode_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer(spark, sf_dir)).select("doc_id", F.size("ids").alias("n_ids"), "ids")


@query(r"""
    WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM documents)
    SELECT doc_id, n::BIGINT AS n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM w""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's words begin in the flat stream."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).cast("long").alias("n"))
    return tokens.running_total(docs, "doc_id", "n")


@query(f"""WITH f AS (SELECT string_agg(text, '' ORDER BY doc_id) AS t FROM documents),
    g AS (SELECT list_transform(string_split(t, ''), lambda c: ord(c)::INT) AS ids FROM f),
    d AS (SELECT draw, {H.format(seed=1337, key="draw")} % ((SELECT len(ids) FROM g) - 65) AS start FROM range(256) r(draw))
    SELECT draw, start, array_to_string(ids[start + 1:start + 64], ' ') AS x, array_to_string(ids[start + 2:start + 65], ' ') AS y FROM d, g""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the flat stream of code points."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("ids"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return tokens.windows(docs, "doc_id", 64, 256).select("draw", "start", joined("x"), joined("y"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return tokens.fingerprint(rows).withColumnRenamed("path", "doc_id")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def decode_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ids of every document decode to, by a vocabulary learned from all of them."""
    docs, own = table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer(spark, sf_dir)
    return tokens.decode(tokens.encode(docs, own, end=False), own).select("doc_id", F.sha2("decoded", 256).alias("sha256"))


@query(f"""WITH s AS (SELECT len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n, CASE WHEN row_number() OVER (ORDER BY {H.format(seed=1337, key="doc_id")}, doc_id) <= 50 THEN 'validation' ELSE 'train' END AS split FROM documents)
    SELECT split, sum(CASE WHEN n > 0 THEN n + 1 ELSE 0 END)::BIGINT AS n_tokens FROM s GROUP BY split""")
def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by split, words and an end token standing in for a tokenizer's."""
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    ids = F.when(F.size(words) > 0, F.concat(F.transform(words, lambda w: F.length(w)), F.array(F.lit(0)))).otherwise(F.array().cast("array<int>"))
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    return tokens.token_totals(corpus.exact_split(docs, "doc_id", 50))


@query()
def token_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned vocabulary as base64 and rank."""
    return spark.createDataFrame(tokens.ranks(_tokenizer(spark, sf_dir)), "token string, rank long")
