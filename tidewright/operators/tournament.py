"""Swiss rounds over prompts: answers and verdicts are made in Spark through caches, ratings and pairs on the driver.

All players answer all prompts in one job. Which players meet depends on ratings, and these on all verdicts before, so the
driver replays the tournament over the verdicts that it knows. Where one is missing it goes on with the ratings that it has, only to list what
the rest of the tournament will probably ask for; all of that is judged in one job, and the replay is taken up again where
it stopped. After WAVES such jobs the rest is judged whole, each pair of players on each prompt. So the number of jobs is bounded
whatever the number of prompts, and the log is the one that asking one by one would give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from .arena import BASE, Registry, K, cache_key, consolidate, pair_up, warm_start
from .cache import Cache

#: Jobs of verdicts that go by what the ratings make likely.
WAVES = 6

LOG = "seq long, prompt string, model_a string, model_b string, response_a string, response_b string, judge string, judge_version string, winner string, verdict_forward string, verdict_reverse string, reason string"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class _Bench:
    """Answers and verdicts of a tournament's prompts, through the two caches of ``folder``."""

    def __init__(self, spark: SparkSession, registry: Registry, prompts: list[str], folder: str):
        self.spark, self.registry = spark, registry
        self.answers = Cache(spark, f"{folder}/answers", "response string")
        self.verdicts = Cache(spark, f"{folder}/verdicts", "winner string, reason string")
        units = spark.createDataFrame(list(enumerate(prompts)), "no long, prompt string").withColumn("player", F.explode(F.array(*map(F.lit, registry.players))))
        self.answered = self.answers.through(units.withColumn("key", cache_key("player", "prompt")), self._play).drop("key")
        self.judged: list[DataFrame] = []

    def _play(self, missing: DataFrame) -> DataFrame:
        # A player is asked in a branch of its own, since a Python function runs for every row of its table.
        return _union([missing.where(F.col("player") == name).withColumn("response", play(F.col("prompt"))) for name, (play, _) in self.registry.players.items()])

    def _ask(self, missing: DataFrame) -> DataFrame:
        parts = []
        for name, (judge, _) in self.registry.judges.items():
            parts.append(missing.where(F.col("judge") == name).withColumn("_v", judge(F.col("prompt"), F.col("one"), F.col("two"))))
        return _union(parts).withColumn("winner", F.col("_v.winner")).withColumn("reason", F.col("_v.reason"))

    def judge(self, pairs: list[tuple[int, str, str]]) -> dict[tuple[int, str, str], list[tuple[str, str]]]:
        """What each judge says of pairs (number of a prompt, two players), asked both ways round: its name and the slot that wins, by pair and by
        the pair turned round, which the same two calls answer."""
        judges = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("judge"), F.lit(version).alias("version")) for i, (n, (_, version)) in enumerate(self.registry.judges.items())])
        of = lambda side: self.answered.select("no", F.col("player").alias(side), F.col("response").alias(f"response_{side}"))
        rows = self.spark.createDataFrame(pairs, "no long, a string, b string").join(self.answered.select("no", "prompt").distinct(), "no").join(of("a"), ["no", "a"]).join(of("b"), ["no", "b"])
        rows = rows.withColumn("j", F.explode(judges)).select("*", "j.*").drop("j")
        ways = F.array(F.struct(F.lit("f").alias("way"), F.col("response_a").alias("one"), F.col("response_b").alias("two")), F.struct(F.lit("r").alias("way"), F.col("response_b").alias("one"), F.col("response_a").alias("two")))
        calls = rows.withColumn("w", F.explode(ways)).select("*", "w.*").drop("w")
        said = self.verdicts.through(calls.withColumn("key", cache_key("judge", "version", "prompt", "one", "two")), self._ask)
        by = ["no", "a", "b", "place", "judge", "version", "prompt", "response_a", "response_b"]
        verdict = F.struct(F.coalesce("winner", F.lit("tie")).alias("winner"), F.coalesce("reason", F.lit("")).alias("reason"))
        both = said.groupBy(*by).agg(F.max(F.when(F.col("way") == "f", verdict)).alias("f"), F.max(F.when(F.col("way") == "r", verdict)).alias("r"))

        def side(x: str, y: str, f: str, r: str):
            c = consolidate(F.col(f), F.col(r))
            fields = {"a": x, "b": y, "response_a": f"response_{x}", "response_b": f"response_{y}", "verdict_forward": f"{f}.winner", "verdict_reverse": f"{r}.winner"}
            return F.struct(*[F.col(c).alias(n) for n, c in fields.items()], c["slot"].alias("slot"), c["reason"].alias("reason"))

        found = both.select("no", "place", "judge", "version", "prompt", F.explode(F.array(side("a", "b", "f", "r"), side("b", "a", "r", "f"))).alias("s")).select("no", "place", "judge", "version", "prompt", "s.*")
        self.judged.append(found)
        known: dict[tuple[int, str, str], list[tuple[str, str]]] = {}
        for r in found.select("no", "a", "b", "place", "judge", "slot").orderBy("no", "a", "b", "place").collect():
            known.setdefault((r.no, r.a, r.b), []).append((r.judge, r.slot))
        return known


def tournament(spark: SparkSession, registry: Registry, prompts: list[str], rounds: int = 3, k: float = K, base: float = BASE, seed: int = 0, log: DataFrame | None = None, folder: str | None = None, waves: int = WAVES) -> DataFrame:
    """Swiss rounds over every prompt, which ends early when every pair has met; returns the new rows of the match table.

    Ratings carry over from one prompt to the next and from an earlier ``log``, whose greatest seq the new rows follow. ``folder`` holds the caches
    of answers and verdicts, which outlive the tournament; without one they go with the application. Pairs and slots come to the driver, texts don't."""
    rating, first = {n: base for n in registry.players}, 0
    if log is not None:
        rating |= {r.model: r.rating for r in warm_start(log, k, base).collect()}
        first = 1 + (log.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0])
    every = [(a, b) for i, a in enumerate(registry.players) for b in list(registry.players)[i + 1 :]]
    rows: list[tuple] = []
    if not (prompts and every and registry.judges):
        return spark.createDataFrame(rows, LOG)
    bench = _Bench(spark, registry, prompts, folder or shared_folder(spark))
    known: dict[tuple[int, str, str], list[tuple[str, str]]] = {}

    def play(no: int, rating: dict[str, float], wanted: set[tuple[int, str, str]], at: int) -> list[tuple]:
        """A prompt's matches as far as they are known; what isn't is wanted, and leaves the ratings as they are."""
        played: set[frozenset[str]] = set()
        out: list[tuple] = []
        for turn in range(rounds):
            if len(played) >= len(every):
                break
            for a, b in pair_up(registry.players, rating, played, seed + turn):
                if (no, a, b) not in known:
                    wanted.add((no, a, b))
                for judge, slot in known.get((no, a, b), []):
                    score = {"a": 1.0, "b": 0.0}.get(slot, 0.5)
                    gain = k * (score - 1 / (1 + 10 ** ((rating[b] - rating[a]) / 400)))
                    rating[a] += gain
                    rating[b] -= gain
                    out.append((at + len(out), no, a, b, judge))
        return out

    no, asked = 0, 0
    while no < len(prompts):
        wanted: set[tuple[int, str, str]] = set()
        guess = dict(rating)
        for later in range(no, len(prompts)):
            found = play(later, guess, wanted, first + len(rows))
            if not wanted:
                rows += found
                rating, no = dict(guess), later + 1
        if wanted:
            asked += 1
            if asked > waves:
                wanted = {(i, a, b) for i in range(no, len(prompts)) for a, b in every if (i, a, b) not in known}
            known |= bench.judge(sorted(wanted))
    # The last word on a pair is that of the first job that judged it; the texts meet the order of the log here.
    judged = _union(bench.judged).dropDuplicates(["no", "a", "b", "judge"]).withColumnRenamed("no", "_no")
    order = spark.createDataFrame(rows, "seq long, no long, model_a string, model_b string, judge string")
    on = (F.col("no") == F.col("_no")) & (F.col("model_a") == F.col("a")) & (F.col("model_b") == F.col("b")) & (order["judge"] == judged["judge"])
    winner = F.when(F.col("slot") == "a", F.col("a")).when(F.col("slot") == "b", F.col("b")).otherwise("tie")
    return order.join(judged, on).select("seq", "prompt", "model_a", "model_b", "response_a", "response_b", order["judge"], F.col("version").alias("judge_version"), winner.alias("winner"), "verdict_forward", "verdict_reverse", "reason").orderBy("seq")
