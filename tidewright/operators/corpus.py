"""Corpus operators: filters, splits, samples, combination by recipe, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import digest, ordered_index, shuffled_index

#: White space as Python's \s has it: Unicode, and the four separators that Java leaves out.
WHITE = r"(?U)[\s\x1c-\x1f]+"


def prune(df: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """Only the named columns; the Parquet scan reads no others."""
    return df.select(*columns)


def matching(df: DataFrame, pattern: str = r"(?i)\bpirate", column: str = "text") -> DataFrame:
    """Rows whose text holds the pattern."""
    return df.where(F.col(column).rlike(pattern))


def unwrap(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, WHITE, " "), F.lit(" "))


def paragraphs(df: DataFrame, min_chars: int = 200, delimiter: str = r"\n\s*\n", column: str = "text") -> DataFrame:
    """One row for each unwrapped paragraph of at least ``min_chars`` code points, in place of the text; keeps the
    other columns, but for one named ord, whose place its number takes."""
    rest = [c for c in df.columns if c not in (column, "ord")]
    out = df.select(*rest, F.posexplode(F.split(column, delimiter)).alias("ord", column)).withColumn(column, unwrap(F.col(column)))
    return out.where(F.length(column) >= min_chars)


def between_markers(text: Column, start: str, end: str) -> Column:
    """The text after the first match of ``start`` and before the first of ``end``; a marker that is missing cuts nothing.

    Both are searched in the whole text, so an end before the start leaves nothing."""
    begin = F.regexp_instr(text, F.lit(start))
    first = F.when(begin > 0, begin + F.length(F.regexp_substr(text, F.lit(start)))).otherwise(F.lit(1))
    stop = F.regexp_instr(text, F.lit(end))
    last = F.when(stop > 0, stop).otherwise(F.length(text) + 1)
    return F.substr(text, first, F.greatest(last - first, F.lit(0)))


#: The markers around a book's own text in a public-domain archive's files.
BOOK_START = r"(?is)\*\*\*\s*START OF TH(?:E|IS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
BOOK_END = r"(?i)\*\*\*\s*END OF TH(?:E|IS) PROJECT GUTENBERG EBOOK"


def strip_book(text: Column) -> Column:
    """A book without its licence header and footer."""
    return between_markers(text, BOOK_START, BOOK_END)


def shuffle_select(df: DataFrame, key: str, n: int, seed: int = 1337) -> DataFrame:
    """The first n rows of a seeded order; n beyond the table takes all. Only n rows of each task are merged."""
    return df.withColumn("_h", digest(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def exact_split(df: DataFrame, key: str, n_val: int, seed: int = 1337) -> DataFrame:
    """``split``: exactly n_val validation rows of a seeded order (all, if there are fewer), the rest train.

    Null keys come first in that order; rows with equal keys are told apart by their other columns. A column named
    split is replaced."""
    df = df.drop("split")
    out = shuffled_index(df, key, seed, name="_position")
    return out.withColumn("split", F.when(F.col("_position") < n_val, "validation").otherwise("train")).drop("_position")


def fraction_split(df: DataFrame, key: str, fraction: float = 0.02, seed: int = 1337) -> DataFrame:
    """``split`` with max(1, floor(rows * fraction)) validation rows."""
    return exact_split(df, key, max(1, int(df.count() * fraction)), seed)


def combine(parts: dict[str, DataFrame], weights: dict[str, float], key: str, seed: int = 1337, draws: bool = False) -> DataFrame:
    """One table of several sources, each a table with ``key``; adds ``source`` and ``output_order``. See combine_by(), or with ``draws`` interleave().

    Columns of the sources that are named source or output_order are replaced."""
    tables = [d.drop("output_order").withColumn("source", F.lit(n).cast("string")) for n, d in parts.items()]
    return (interleave if draws else combine_by)(reduce(DataFrame.unionByName, tables), {n: weights[n] for n in parts}, key, seed)


def interleave(df: DataFrame, weights: dict[str | None, float], key: str, seed: int = 1337) -> DataFrame:
    """A table with a ``source`` for each row (one of the names in ``weights``, which may be null), drawn row by row.

    One source passes as it is, and equal weights give a plain union (output_order null). Otherwise each position of the output draws a
    source by weight and takes its next row in a seeded order, beginning again where it runs out, until every source has been used up once:
    the last position is the one at which the last source gives its last row for the first time. Positions are made by a
    range, and their rank among the draws of their source by cells with offsets, so no task walks through the
    output. The driver sees one count a source. A source that has rows but no weight is an error, as it would never be used up."""
    df = df.drop("output_order")
    if len(set(weights.values())) <= 1:
        return df.withColumn("output_order", F.lit(None).cast("long"))
    spark = df.sparkSession
    sizes = {r.source: r["count"] for r in df.groupBy("source").count().collect()}
    if any(weights.get(n, 0) <= 0 for n in sizes):
        raise ValueError("every source needs a weight above 0")
    names = [n for n in weights if n in sizes]
    total, cuts = sum(weights[n] for n in names), []
    for n in names[:-1]:
        cuts.append((cuts[-1] if cuts else 0) + weights[n])
    ends = F.array(*[F.lit(int(c / total * (1 << 48))) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    length = int(1.1 * max((sizes[n] * total / weights[n] for n in names), default=0)) + 100
    while True:
        drawn = spark.range(length).select(F.col("id").alias("output_order"), F.size(F.filter(ends, lambda c: c <= digest(F.col("id"), seed))).alias("_s"))
        found = {r["_s"]: r["count"] for r in drawn.groupBy("_s").count().collect()}
        if all(found.get(i, 0) >= sizes[n] for i, n in enumerate(names)):
            break
        length *= 2
    # One row for each source.
    plan = F.broadcast(spark.createDataFrame([(i, n, sizes[n]) for i, n in enumerate(names)], "_s int, _source string, _n long"))
    ranked = ordered_index(drawn, "output_order", ["_s"], "_k").join(plan, "_s")
    last = ranked.where("_k = _n - 1").agg(F.coalesce(F.max("output_order"), F.lit(-1))).first()[0]
    taken = ranked.where(F.col("output_order") <= last).select("output_order", "_s", (F.col("_k") % F.col("_n")).alias("_i"))
    rows = shuffled_index(df, key, seed, ["source"], "_i").join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_n")
    return rows.join(taken, ["_s", "_i"]).drop("_s", "_i")


def combine_by(df: DataFrame, weights: dict[str | None, float], key: str, seed: int = 1337) -> DataFrame:
    """A table with a ``source`` for each row (one of the names in ``weights``, which may be null), mixed by weight.

    One source passes as it is, and equal weights give a plain union (output_order null). Otherwise sources are
    interleaved by probability until each is used up once: with p_i its share of the weights, the
    output has T = max(n_i / p_i) rows, round(T * p_i) of them from source i, whose rows come again in
    the same order when they run out. Positions follow (k + jitter) / p_i, a digest's draw for the k-th row.
    The driver sees one count a source."""
    df = df.drop("output_order")
    if len(set(weights.values())) <= 1:
        return df.withColumn("output_order", F.lit(None).cast("double"))
    sizes = {r.source: r["count"] for r in df.groupBy("source").count().collect()}
    share = {n: w / sum(weights.values()) for n, w in weights.items()}
    longest = max((sizes[n] / share[n] for n in weights if n in sizes), default=0.0)
    rows = [(n, round(longest * share[n]), sizes[n], share[n]) for n in weights if n in sizes]
    plan = df.sparkSession.createDataFrame(rows, "_source string, _rows long, _n long, _p double")
    # One row for each weight.
    placed = shuffled_index(df, key, seed, ["source"], "_i").join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source"))).where(F.col("_i") < F.col("_rows"))
    # Row i is taken at k = i, i + n, i + 2n, ... below the source's number of output rows.
    placed = placed.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1 - F.col("_i")) / F.col("_n")))))
    k = F.col("_i") + F.col("_turn") * F.col("_n")
    jitter = digest(F.concat(F.coalesce("source", F.lit("None")), F.lit(":"), k.cast("string")), seed) / float(1 << 48)
    return placed.withColumn("output_order", (k + jitter) / F.col("_p")).drop("_i", "_turn", "_source", "_rows", "_n", "_p")


def row_shares(df: DataFrame) -> DataFrame:
    """source, rows of train and validation, and each source's share of all train rows, to four digits."""
    counts = df.groupBy("source").agg(F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "validation").alias("val_rows"))
    total = F.sum("train_rows").over(Window.partitionBy())
    return counts.withColumn("row_share", F.when(total > 0, F.round(F.col("train_rows") / total, 4)).otherwise(0.0))


# The dialect's own dictionary: (word, replacement), longest first, whole words only.
DIALECT = [
    ("my friend", "me hearty"), ("hello", "ahoy"), ("friend", "matey"), ("friends", "mateys"), ("yes", "aye"), ("the", "th'"), ("you", "ye"), ("your", "yer"),
    ("my", "me"), ("is", "be"), ("are", "be"), ("of", "o'"), ("and", "an'"), ("for", "fer"), ("to", "t'"), ("money", "doubloons"), ("house", "galley"), ("sea", "briny deep"),
]


#: Each word and phrase as it is found, also with a capital, and what stands for it.
DIALECT_FORMS = {a: b for word, other in DIALECT for a, b in ((word, other), (word.capitalize(), other[0].upper() + other[1:]))}
_DIALECT = r"(?<![A-Za-z'])(?:" + "|".join(sorted(DIALECT_FORMS, key=lambda w: (-len(w), w))) + r")(?![A-Za-z'])"


def dialect(text: Column) -> Column:
    """Rewrite by the dictionary in one pass: whole words of ASCII letters and apostrophes, a phrase before its words.

    The letters around a word aren't part of the match, so of equal neighbours each is rewritten; what was
    rewritten isn't read again. Null stays null."""
    table = F.create_map(*[F.lit(x) for pair in DIALECT_FORMS.items() for x in pair])
    found = F.regexp_extract_all(text, F.lit(_DIALECT), F.lit(0))
    return F.array_join(F.zip_with(F.split(text, _DIALECT, -1), found, lambda gap, word: F.concat(gap, F.coalesce(table[word], F.lit("")))), "")


def peek(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One row, chosen by a seeded order."""
    return shuffle_select(df, key, 1, seed)
