"""Queries of sources, sinks and the resumable scan: what they write is read again, in a folder that goes with the application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arena, corpus
from ..sources import registry, sinks, text
from ..storage import shared_folder
from ..streaming import scan
from .arena import _LOG, _log
from .corpus import H_DOC
from .register import query, table

_SPLIT = f"CASE WHEN row_number() OVER (ORDER BY {H_DOC}, doc_id) <= 50 THEN 'validation' ELSE 'train' END AS split"


def _registered(spark: SparkSession, sf_dir: str) -> registry.Sources:
    sources = registry.Sources(spark, shared_folder(spark))

    def build(spark: SparkSession) -> DataFrame:
        return corpus.exact_split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "text"), "key", 50)

    sources.add("documents", build, "documents.parquet")
    return sources


@query("SELECT source, count(*) AS n, sha256(min(text)) AS first_sha FROM documents GROUP BY source")
def materialized_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column pruning and a count by source over a registered source's cache."""
    docs = corpus.prune(_registered(spark, sf_dir).materialize("documents"), ("source", "text"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sha2(F.min("text"), 256).alias("first_sha"))


@query(f"SELECT 'documents' AS name, 'documents.parquet' AS origin, split, count(*) AS n FROM (SELECT {_SPLIT} FROM documents) GROUP BY split")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _registered(spark, sf_dir)
    sources.materialize("documents")
    found = sources.manifest("documents")
    return spark.createDataFrame([(found["name"], found["origin"], split, n) for split, n in found["rows"].items()], "name string, origin string, split string, n long")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])than')")
def resumable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a scan keeps which is stopped after its first file and taken up again."""
    folder, docs = shared_folder(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartition(3, "doc_id").write.parquet(f"{folder}/source")
    args = (spark, f"{folder}/source", docs.schema, F.col("text").rlike(r"(?i)(^|[^\p{L}\p{N}_])than"), f"{folder}/out", f"{folder}/state")
    scan.resumable_filter(*args)
    return scan.resumable_filter(*args).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT seq, conv_id::VARCHAR AS id, text AS prompt FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS seq, conv_id, text FROM conversations WHERE role = 'user' AND text <> '')")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts written as JSON lines in order, then scanned by line; their numbers come from files and blocks."""
    path = f"{shared_folder(spark)}/prompts"
    rows = table(spark, sf_dir, "conversations").where("role = 'user' AND text <> ''").orderBy("conv_id", "turn")
    rows.select(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("prompt")).write.json(path)
    return text.prompts(spark, path).select("seq", "id", "prompt")


_HALF = "(SELECT max(seq) // 2 FROM m)"


@query(f"""WITH {_LOG}, a AS (SELECT * FROM m WHERE seq <= {_HALF}), b AS (SELECT * FROM m WHERE seq > {_HALF})
    SELECT seq, model_a, model_b, winner FROM a UNION ALL SELECT seq, model_a, model_b, winner FROM b
    UNION ALL SELECT seq + (SELECT max(seq) + 1 - (SELECT min(seq) FROM a) FROM b), model_a, model_b, winner FROM a""")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of three appends, the last of which repeats the first one's rows under new numbers."""
    path, log = f"{shared_folder(spark)}/log", _log(spark, sf_dir)
    half = log.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    for part in (log.where(F.col("seq") <= half), log.where(F.col("seq") > half), log.where(F.col("seq") <= half)):
        sinks.append_log(part, path)
    return text.matches(spark, path).select("seq", "model_a", "model_b", "winner")


@query("SELECT doc_id % 1000 AS key, any_value(v) AS value FROM (SELECT doc_id, first_value(source) OVER (PARTITION BY doc_id % 1000 ORDER BY doc_id) AS v FROM documents) GROUP BY ALL")
def cache_put_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that is put twice; what it holds already stays."""
    path, docs = f"{shared_folder(spark)}/cache", table(spark, sf_dir, "documents").select((F.col("doc_id") % 1000).alias("key"), F.col("source").alias("value"), "doc_id")
    sinks.put_new(docs.groupBy("key").agg(F.min_by("value", "doc_id").alias("value")), path)
    sinks.put_new(docs.select("key", "value"), path)
    return spark.read.schema("key long, value string").json(path)


@query("""WITH f AS (SELECT string_split(string_agg(text, '' ORDER BY doc_id), '') AS v FROM documents),
    c AS (SELECT unnest(list_transform(v, lambda x: ord(x)::BIGINT % 65536)) AS id, unnest(range(len(v))) AS place FROM f)
    SELECT count(*) AS n, sum(id)::BIGINT AS id_sum, sum(id * (place % 997))::BIGINT AS order_sum FROM c""")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' code points as flat files of 16-bit ids, read again by blocks; the files make one stream in the order of their names."""
    folder = f"{shared_folder(spark)}/stream"
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.transform(F.split("text", ""), lambda c: F.ascii(c) % 65536).alias("ids"))
    written = sinks.token_files(docs, "doc_id", folder, file_ids=1 << 20)
    firsts = [(name.rsplit("/", 1)[1], sum(n for _, n in written[:i])) for i, (name, _) in enumerate(written)]
    blocks = text.token_file(spark, folder).withColumn("name", F.substring_index("file", "/", -1))
    blocks = blocks.join(F.broadcast(spark.createDataFrame(firsts, "name string, first long")), "name")
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    placed = F.transform("ids", lambda x, i: x.cast("long") * ((F.col("first") + F.col("block") * 65536 + i) % 997))
    return blocks.agg(F.sum(F.size("ids")).cast("long").alias("n"), F.sum(add(F.col("ids"))).alias("id_sum"), F.sum(add(placed)).alias("order_sum"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 IN (0, 3, 6, 9)")
def shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of ten shards, evenly spread, of a source that is dealt by the last digit of its ids."""
    folder = f"{shared_folder(spark)}/shards"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 10).cast("int").alias("shard"))
    docs.repartitionById(10, F.col("shard")).write.parquet(folder)
    found = registry.shard_scan(spark, folder, 200, 100, columns=("doc_id", "text"))
    return found.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""WITH j AS (SELECT 'cat' || item_id % 4 AS category, CASE WHEN length(text) % 3 = 0 THEN 'b' WHEN length(text) % 3 = 1 THEN 'tie' ELSE 'a' END AS slot FROM benchmark)
    SELECT category, 'length' AS judge, 'v1' AS judge_version, 'upper' AS model, count(*) AS n, count(*) FILTER (slot = 'a') AS agree, count(*) FILTER (slot = 'tie') AS tie, count(*) FILTER (slot = 'b') AS miss, round(count(*) FILTER (slot = 'b') / count(*), 3) AS miss_rate FROM j GROUP BY ALL""")
def calibration_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that goes by the length of the prompt, against known answers; counted, written as JSON lines, read again."""
    known = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("cat"), (F.col("item_id") % 4).cast("string")).alias("category"), F.col("text").alias("prompt"), F.lit("known").alias("gold"))
    rank = F.length("prompt") % 3

    def judge(prompt, a, b):
        first = a == "known"
        pick = F.when(rank == 1, "tie").when((rank == 2) == first, "A").otherwise("B")
        return F.struct(pick.alias("winner"), F.lit("").alias("reason"))

    players = arena.Registry()
    players.player("upper", F.upper)
    players.judge("length", judge, "v1")
    paths = arena.export_calibration(arena.calibrate(known, players), shared_folder(spark))
    return spark.read.schema("category string, judge string, judge_version string, model string, n long, agree long, tie long, miss long, miss_rate double").json(paths["json"])


@query(f"""WITH {_LOG} SELECT seq, model_a, model_b, judge, judge_version, winner FROM m""")
def match_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches report, read again from CSV."""
    path = f"{shared_folder(spark)}/matches"
    sinks.csv(_log(spark, sf_dir).orderBy("seq"), arena.MATCH_COLUMNS, path, single=False)
    return spark.read.option("header", True).schema("seq long, model_a string, model_b string, judge string, judge_version string, winner string").csv(path)
