"""Queries of the evaluation plane. There is no match log among the tables; one is derived from events (see derived_log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arena
from ..operators.cache import Cache
from ..operators.tournament import tournament
from ..storage import shared_folder
from ..streaming.elo import follow
from .corpus import H
from .register import query, table

_LOG = """
    v AS (SELECT event_id, lag(event_type) OVER u AS model_a, event_type AS model_b, floor(lag(value) OVER u / 20) AS va, floor(value / 20) AS vb FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT event_id AS seq, model_a, model_b, 'judge' || (event_id % 3) AS judge, 'v' || (event_id // 3 % 2) AS judge_version,
          CASE WHEN va > vb THEN model_a WHEN va < vb THEN model_b ELSE 'tie' END AS winner FROM v WHERE model_a <> model_b AND va IS NOT NULL AND vb IS NOT NULL),
    s AS (SELECT model_a AS model, model_b AS other, CASE winner WHEN 'tie' THEN 'draw' WHEN model_a THEN 'win' WHEN model_b THEN 'loss' END AS result FROM m
          UNION ALL SELECT model_b, model_a, CASE winner WHEN 'tie' THEN 'draw' WHEN model_b THEN 'win' WHEN model_a THEN 'loss' END FROM m)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.derived_log(table(spark, sf_dir, "events"))


@query(f"WITH {_LOG} SELECT * FROM m")
def match_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


@query(f"WITH {_LOG} SELECT model, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses, count(*) FILTER (result = 'draw') AS draws, count(*) AS games FROM s GROUP BY model")
def wlt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.counts(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT model, other, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses, count(*) FILTER (result = 'draw') AS ties, count(*) AS n FROM s GROUP BY model, other")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.head_to_head(_log(spark, sf_dir))


# The driver's events have these five types.
_TYPES = ("click", "error", "purchase", "signup", "view")
_CELLS = ", ".join(f"CASE row_model WHEN '{t}' THEN '-' ELSE max(CASE other WHEN '{t}' THEN printf('%d-%d-%d/%d', w, l, t, w + l + t) ELSE '0-0-0/0' END) END AS {t}" for t in _TYPES)


@query(f"""WITH {_LOG}, g AS (SELECT model AS row_model, other, coalesce(result, 'draw') AS result FROM s),
    h AS (SELECT row_model, other, count(*) FILTER (result = 'win') AS w, count(*) FILTER (result = 'loss') AS l, count(*) FILTER (result = 'draw') AS t FROM g GROUP BY ALL)
    SELECT row_model, {_CELLS} FROM h GROUP BY row_model""")
def head_to_head_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.matrix(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT judge, sum((winner = model_a)::INT)::BIGINT AS a_wins, sum((winner = model_b)::INT)::BIGINT AS b_wins, sum((winner = 'tie')::INT)::BIGINT AS ties, count(*) AS games FROM m GROUP BY judge")
def slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.slot_counts(_log(spark, sf_dir), ("judge",))


@query(f"WITH {_LOG} SELECT judge, string_agg(DISTINCT judge_version, ',' ORDER BY judge_version) AS versions, count(DISTINCT judge_version) > 1 AS mixed FROM m GROUP BY judge")
def judge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.judge_versions(_log(spark, sf_dir)).withColumn("versions", F.array_join("versions", ","))


@query(f"WITH {_LOG} SELECT judge, judge_version, count(*) AS n FROM m WHERE judge <> 'judge1' OR judge_version = 'v1' GROUP BY ALL")
def version_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.of_version(_log(spark, sf_dir), {"judge1": "v1"}).groupBy("judge", "judge_version").agg(F.count("*").alias("n"))


# Ratings by places in the list of names, 1500 each, moved by one match [place of a, place of b, score] after the other.
_FOLD = """list_reduce(list([a, b, s]::DOUBLE[] ORDER BY i), lambda r, m: list_transform(r, lambda x, j: CASE
        WHEN j = m[1] THEN x + 8.0::DOUBLE * (m[3] - 1 / (1 + pow(10.0::DOUBLE, (r[m[2]::INT] - r[m[1]::INT]) / 400)))
        WHEN j = m[2] THEN x - 8.0::DOUBLE * (m[3] - 1 / (1 + pow(10.0::DOUBLE, (r[m[2]::INT] - r[m[1]::INT]) / 400))) ELSE x END),
        list_transform((SELECT names FROM p), lambda x: 1500.0::DOUBLE))"""
_NAMES = "p AS (SELECT list(DISTINCT model ORDER BY model) AS names FROM s)"
_SCORED = f"""{_NAMES}, o AS (SELECT seq, list_position((SELECT names FROM p), model_a) AS a, list_position((SELECT names FROM p), model_b) AS b,
    CASE winner WHEN model_a THEN 1.0 WHEN model_b THEN 0.0 ELSE 0.5 END::DOUBLE AS s, row_number() OVER (ORDER BY seq) - 1 AS k FROM m)"""
_POINT = f"{_SCORED}, f AS (SELECT unnest((SELECT names FROM p)) AS model, unnest((SELECT {_FOLD} FROM (SELECT *, seq AS i FROM o))) AS rating)"
_BOOT = f"""{_SCORED}, d AS (SELECT g, t, {H.format(seed=0, key="(g || ':' || t)")} % (SELECT count(*) FROM m) AS k FROM range(200) x(g), range((SELECT count(*) FROM m)) y(t)),
    z AS (SELECT g, {_FOLD} AS r, list_distinct(list(a) || list(b)) AS seen FROM (SELECT g, t AS i, a, b, s FROM d JOIN o USING (k)) GROUP BY g),
    c AS (SELECT model, round(quantile_cont(rating, 0.025), 1) AS ci_low, round(quantile_cont(rating, 0.975), 1) AS ci_high
          FROM (SELECT unnest((SELECT names FROM p)) AS model, unnest(r) AS rating, unnest(range(1, len(r) + 1)) AS j, seen FROM z) WHERE list_contains(seen, j) GROUP BY model)"""


@query(f"WITH {_LOG}, {_POINT} SELECT model, round(rating, 1) AS rating FROM f")
def elo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.ratings(_log(spark, sf_dir)).select("model", F.round("rating", 1).alias("rating"))


@query(f"WITH {_LOG}, {_POINT} SELECT model, round(rating, 1) AS rating FROM f")
def elo_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ratings from a log that is appended in three parts and followed after each."""
    folder, log = shared_folder(spark), _log(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0] or 0
    args = (f"{folder}/log", log.schema, f"{folder}/state", f"{folder}/checkpoint")
    for i in range(3):
        log.where(f"seq > {last * i // 3 - (i == 0)} AND seq <= {last * (i + 1) // 3}").write.mode("append").json(f"{folder}/log")
        out = follow(spark, *args)
    return out.select("model", F.round("rating", 1).alias("rating"))


# Types of events of users whose numbers leave the same rest: five models in each of eight circles.
_CIRCLES = _LOG.replace("SELECT event_id, lag(event_type) OVER u AS model_a, event_type AS model_b", "SELECT event_id, user_id % 8 || lag(event_type) OVER u AS model_a, user_id % 8 || event_type AS model_b")


@query(f"WITH {_CIRCLES}, {_POINT} SELECT model, round(rating, 1) AS rating FROM f")
def elo_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of models that fall into circles, each of which is replayed alone."""
    events = table(spark, sf_dir, "events").withColumn("event_type", F.concat((F.col("user_id") % 8).cast("string"), "event_type"))
    return arena.ratings_apart(arena.derived_log(events)).select("model", F.round("rating", 1).alias("rating"))


@query(f"WITH {_LOG}, {_BOOT} SELECT * FROM c")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    boot = arena.bootstrap(_log(spark, sf_dir))
    return boot.groupBy("model").agg(F.round(F.percentile("rating", F.lit(0.025)), 1).alias("ci_low"), F.round(F.percentile("rating", F.lit(0.975)), 1).alias("ci_high"))


@query(f"""WITH {_LOG}, {_BOOT}, f AS (SELECT unnest((SELECT names FROM p)) AS model, unnest((SELECT {_FOLD} FROM (SELECT *, seq AS i FROM o))) AS rating)
    SELECT model, round(rating, 1) AS rating, ci_low, ci_high, wins, losses, draws, games FROM f JOIN c USING (model) JOIN
    (SELECT model, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses, count(*) FILTER (result = 'draw') AS draws, count(*) AS games FROM s GROUP BY model) USING (model)""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.leaderboard(_log(spark, sf_dir))


_VERDICT = "['A', 'B', 'tie'][1 + (event_id * {0}) % 3]"


@query(f"""WITH v AS (SELECT event_id AS seq, {_VERDICT.format(7)} AS f, {_VERDICT.format(1)} AS r, 'f' || event_id % 2 AS fr, 'f' || event_id % 3 AS rr FROM events),
    w AS (SELECT *, CASE f WHEN 'A' THEN 'a' WHEN 'B' THEN 'b' ELSE 'tie' END AS pf, CASE r WHEN 'A' THEN 'b' WHEN 'B' THEN 'a' ELSE 'tie' END AS pr FROM v)
    SELECT seq, CASE WHEN pf = pr THEN pf ELSE 'tie' END AS slot, CASE WHEN rr <> fr THEN fr || ' | swap: ' || rr ELSE fr END AS reason FROM w""")
def swap_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict pairs made up from event numbers."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, ("A", "B", "tie"))), (1 + (F.col("event_id") * k) % 3).cast("int"))
    say = lambda k: F.concat(F.lit("f"), (F.col("event_id") % k).cast("string"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.struct(pick(7).alias("winner"), say(2).alias("reason")).alias("f"), F.struct(pick(1).alias("winner"), say(3).alias("reason")).alias("r"))
    return e.select("seq", arena.consolidate(F.col("f"), F.col("r")).alias("c")).select("seq", "c.*")


@query("""WITH j AS (SELECT b.item_id, 'cat' || b.item_id % 4 AS category, 'judge' || x.j AS judge, 'v1' AS judge_version, 'm' || y.m AS model, ['a', 'b', 'tie'][1 + (b.item_id * 5 + x.j * 3 + y.m) % 3] AS slot FROM benchmark b, range(2) x(j), range(3) y(m))
    SELECT category, judge, judge_version, model, count(*) AS n, count(*) FILTER (slot = 'a') AS agree, count(*) FILTER (slot = 'tie') AS tie, count(*) FILTER (slot = 'b') AS miss, round(count(*) FILTER (slot = 'b') / count(*), 3) AS miss_rate FROM j GROUP BY ALL""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known answers by judges by models; the slots are made up from their numbers."""
    units = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("j")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(2))))
    slot = F.element_at(F.array(*map(F.lit, ("a", "b", "tie"))), (1 + (F.col("item_id") * 5 + F.col("j") * 3 + F.col("m")) % 3).cast("int"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    return arena.calibration(units.select(name("cat", F.col("item_id") % 4).alias("category"), name("judge", "j").alias("judge"), F.lit("v1").alias("judge_version"), name("m", "m").alias("model"), slot.alias("slot")))


@query("SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def cache_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.last_write(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value")))


@query("SELECT DISTINCT user_id AS key FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id")
    return arena.misses(e.select("key"), e.where("event_id % 50 = 0").select("key").distinct())


@query("SELECT count(*) FILTER (h) AS hits, count(*) FILTER (NOT h) AS misses, avg(h::INT) AS hit_rate FROM (SELECT user_id IN (SELECT user_id FROM events WHERE event_id % 50 = 0) AS h FROM events)")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id")
    return arena.hit_rate(e.select("key"), e.where("event_id % 50 = 0").select("key"))


@query("SELECT doc_id, sha256(source::BLOB || '\\x00'::BLOB || lang::BLOB || '\\x00'::BLOB) AS key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", arena.cache_key("source", "lang").alias("key"))


@query(f"WITH {_LOG} SELECT a.model AS model_a, b.model AS model_b FROM (SELECT DISTINCT model FROM s) a JOIN (SELECT DISTINCT model FROM s) b ON a.model < b.model")
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = arena.sides(_log(spark, sf_dir)).select("model").distinct()
    return names.select(F.col("model").alias("model_a")).join(names.select(F.col("model").alias("model_b")), F.col("model_a") < F.col("model_b"))


@query(f"""WITH {_LOG}, {_POINT}, n AS (SELECT list(model ORDER BY rating) AS v FROM f)
    SELECT turn::INT AS turn, v[a] AS model_a, v[b] AS model_b FROM n, (VALUES (0, 1, 2), (0, 3, 4), (1, 1, 3), (1, 2, 4), (2, 1, 4), (2, 2, 3)) t(turn, a, b)""")
def swiss_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of the five event types by their ratings: neighbours meet, then the nearest that haven't met."""
    rating, played = {r.model: r.rating for r in arena.ratings(_log(spark, sf_dir)).collect()}, set()
    rows = [(turn, a, b) for turn in range(3) for a, b in arena.pair_up(rating, rating, played, 3 + turn)]
    return spark.createDataFrame(rows, "turn int, model_a string, model_b string")


@query("""WITH a AS (SELECT DISTINCT text AS prompt FROM benchmark WHERE text IS NOT NULL), j AS (SELECT prompt, 'length' AS judge, 'lower' AS winner FROM a WHERE length(prompt) > 40
    UNION ALL SELECT prompt, 'length', CASE WHEN length(prompt) < 40 THEN 'forty' ELSE 'tie' END FROM a WHERE length(prompt) <= 40
    UNION ALL SELECT prompt, 'first', CASE WHEN left(prompt || repeat('~', 40), 40) < lower(prompt) THEN 'forty' WHEN left(prompt || repeat('~', 40), 40) > lower(prompt) THEN 'lower' ELSE 'tie' END FROM a)
    SELECT prompt, judge, winner, left(prompt || repeat('~', 40), 40) AS answer_forty, lower(prompt) AS answer_lower FROM j""")
def tournament_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two players and two judges over all texts of the benchmark: one that gives forty letters, and one that gives all in small ones; who wins is
    the one with more letters, or the one that comes first in the order of the alphabet."""
    pick = lambda a, b: F.struct(F.when(a, "A").when(b, "B").otherwise("tie").alias("winner"), F.lit("").alias("reason"))
    registry = arena.Registry()
    registry.player("forty", lambda p: F.rpad(p, 40, "~"))
    registry.player("lower", F.lower)
    registry.judge("length", lambda p, a, b: pick(F.length(a) > F.length(b), F.length(a) < F.length(b)), "v1")
    registry.judge("first", lambda p, a, b: pick(a < b, a > b), "v1")
    prompts = sorted(r.text for r in table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("text").distinct().collect())
    out = tournament(spark, registry, prompts)
    answer = lambda n: F.when(F.col("model_a") == n, F.col("response_a")).otherwise(F.col("response_b"))
    return out.select("prompt", "judge", "winner", answer("forty").alias("answer_forty"), answer("lower").alias("answer_lower"))


@query()
def tournament_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swiss rounds of three players and two judges, with each type of event as a prompt, after the derived log."""
    registry = arena.Registry()
    registry.player("echo", arena.echo)
    registry.player("upper", F.upper)
    registry.player("reverse", arena.from_texts(lambda texts: [(t or "")[::-1] for t in texts]))
    registry.judge("coin", arena.coin(3), "v1")
    registry.judge("model", arena.from_verdicts(lambda texts: ['{"winner": "%s", "reason": "length"}' % "AB"[len(t) % 2] for t in texts]), "v1")
    prompts = sorted(r.event_type for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())
    out = tournament(spark, registry, prompts, log=_log(spark, sf_dir))
    return out.select("seq", "prompt", "model_a", "model_b", "judge", "judge_version", "winner", "reason")


@query("""WITH d AS (SELECT doc_id, lang, source, 'x' || doc_id % 3 AS kind FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
    SELECT doc_id, CASE WHEN lang <= 'de' THEN 'kept ' || lang ELSE 'said ' || lang || ' ' || source || ' ' || kind END AS answer, CASE WHEN lang <= 'de' THEN 0 ELSE 1 END::BIGINT AS call FROM d""")
def cached_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by language, source and kind through a cache that knows some languages; a second writer and a second run change nothing."""
    store = Cache(spark, f"{shared_folder(spark)}/cache", "answer string, call long")
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").withColumn("kind", F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string")))
    wanted = docs.select("doc_id", "lang", "source", "kind", arena.cache_key("lang", "source", "kind").alias("key"))
    store.put(wanted.where("lang <= 'de'").select("key", F.concat(F.lit("kept "), "lang").alias("answer"), F.lit(0).cast("long").alias("call")))
    says = lambda n: lambda missing: missing.select("key", F.concat_ws(" ", F.lit("said"), "lang", "source", "kind").alias("answer"), F.lit(n).cast("long").alias("call"))
    store.through(wanted, says(1))
    store.put(says(9)(wanted))
    return store.through(wanted, says(2)).select("doc_id", "answer", "call")
