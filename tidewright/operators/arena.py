"""Tournaments: verdicts, Elo replay, bootstrap intervals, tables of results, pairing, calibration, memo caches.

A match table has seq (its order is part of the data), model_a, model_b, judge, judge_version and winner
(a model's name or "tie")."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import arrow_path, files, shared_folder
from .order import digest, digests, ordered_index

BASE, K = 1500.0, 8.0


def expected(a: Column, b: Column) -> Column:
    """The share of points that a rating of a expects against one of b."""
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def consolidate(forward: Column, reverse: Column) -> Column:
    """struct of slot (a, b or tie) and reason from a verdict and the one with sides swapped."""
    # " | swap: " and "swap disagreed" are fixed values of the log's format.
    picks = lambda v, a, b: F.when(v["winner"] == "A", a).when(v["winner"] == "B", b).otherwise("tie")
    f, r = picks(forward, "a", "b"), picks(reverse, "b", "a")
    slot = F.when((f != "tie") & (f == r), f).otherwise("tie")
    reason = F.when((reverse["reason"] != "") & (reverse["reason"] != forward["reason"]), F.concat(forward["reason"], F.lit(" | swap: "), reverse["reason"])).otherwise(forward["reason"])
    reason = F.when((f != "tie") & (r != "tie") & (f != r) & (reason == ""), "swap disagreed").otherwise(reason)
    return F.struct(slot.alias("slot"), reason.alias("reason"))


def verdict(raw: Column) -> Column:
    """struct of winner and reason from a judge's JSON; anything but A, B or tie is a tie."""
    v = F.from_json(raw, "winner string, reason string")
    return F.struct(F.when(v["winner"].isin("A", "B", "tie"), v["winner"]).otherwise("tie").alias("winner"), F.coalesce(v["reason"], F.lit("")).alias("reason"))


def of_version(matches: DataFrame, versions: dict[str, str] | None) -> DataFrame:
    """Drop a match only if its judge is named and its version is another one."""
    if not versions:
        return matches
    wanted = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])[F.col("judge")]
    return matches.where(wanted.isNull() | (F.coalesce("judge_version", F.lit("")) == wanted))


def sides(matches: DataFrame) -> DataFrame:
    """Two rows for each match, one for each player: model, other, result (win, loss, draw or none)."""
    result = lambda me, it: F.when(F.col("winner") == "tie", "draw").when(F.col("winner") == F.col(me), "win").when(F.col("winner") == F.col(it), "loss").otherwise("none")
    both = F.array(*[F.struct(F.col(me).alias("model"), F.col(it).alias("other"), result(me, it).alias("result")) for me, it in (("model_a", "model_b"), ("model_b", "model_a"))])
    return matches.select(F.explode(both).alias("s")).select("s.*")


def counts(matches: DataFrame) -> DataFrame:
    """model, wins, losses, draws, games; a winner that is nobody counts as a game only."""
    n = lambda r: F.count_if(F.col("result") == r)
    return sides(matches).groupBy("model").agg(n("win").alias("wins"), n("loss").alias("losses"), n("draw").alias("draws"), F.count("*").alias("games"))


def head_to_head(matches: DataFrame) -> DataFrame:
    """model, other, wins, losses, ties, n for both orientations; here a winner that is nobody is a tie."""
    n = lambda *r: F.count_if(F.col("result").isin(*r))
    return sides(matches).groupBy("model", "other").agg(n("win").alias("wins"), n("loss").alias("losses"), n("draw", "none").alias("ties"), F.count("*").alias("n"))


def slot_counts(matches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, a_wins, b_wins, ties and games: who won by place; a winner that is nobody counts as a game only."""
    winner = F.col("winner")
    return matches.groupBy(*by).agg(F.count_if(winner == F.col("model_a")).alias("a_wins"), F.count_if((winner == F.col("model_b")) & (winner != F.col("model_a"))).alias("b_wins"), F.count_if(winner == "tie").alias("ties"), F.count("*").alias("games"))


def matrix(matches: DataFrame) -> DataFrame:
    """row_model and a column for each model, in the order of names: wins-losses-ties/n of the row's model, - for itself."""
    h = head_to_head(matches)
    names = [r.model for r in h.select("model").distinct().orderBy("model").collect()]
    cell = F.concat(F.concat_ws("-", "wins", "losses", "ties"), F.lit("/"), F.col("n").cast("string"))
    out = h.groupBy("model").pivot("other", names).agg(F.first(cell))
    cells = [F.when(F.col("model") == n, "-").otherwise(F.coalesce(F.col(f"`{n}`"), F.lit("0-0-0/0"))).alias(n) for n in names]
    return out.select(F.col("model").alias("row_model"), *cells)


def judge_versions(matches: DataFrame) -> DataFrame:
    """judge, versions (sorted) and whether there are several."""
    return matches.groupBy("judge").agg(F.sort_array(F.collect_set(F.coalesce("judge_version", F.lit("")))).alias("versions")).withColumn("mixed", F.size("versions") > 1)


def _score(unknown: float | None) -> Column:
    return F.when(F.col("winner") == F.col("model_a"), 1.0).when(F.col("winner") == F.col("model_b"), 0.0).when(F.col("winner") == "tie", 0.5).otherwise(F.lit(unknown).cast("double"))


def replay(matches: DataFrame, by: tuple[str, ...] = (), k: float = K, base: float = BASE, unknown: float | None = None, start: DataFrame | None = None) -> DataFrame:
    """by, model, rating, place and last after each group's matches: place is the order in which a group's models were first rated, last
    the group's last seq.

    A replay is sequential. Groups are dealt to tasks, each task reads its groups' matches in order, batch by
    batch, and holds the ratings of one group only, so a log of any length needs no more than its models.
    A winner that is nobody changes and rates nothing, or scores ``unknown`` if given. Of equal seq the names decide.
    ``start`` is what an earlier replay returned: its groups go on from there, and a match whose seq isn't after the group's last is an error."""
    one = matches.select(*by, F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), "model_a", "model_b", _score(unknown).alias("score"), F.lit(None).cast("long").alias("last")).where("score IS NOT NULL")
    if start is not None:
        one = start.select(*by, F.lit(0).alias("kind"), F.col("place").alias("seq"), F.col("model").alias("model_a"), F.lit(None).cast("string").alias("model_b"), F.col("rating").alias("score"), "last").unionByName(one)
    rows = (one.repartition(*by) if by else one.repartition(1)).sortWithinPartitions(*by, "kind", "seq", "model_a", "model_b", "score")
    keys = rows.select(*by).schema if by else None
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in keys] if by else []
    names = [*by, "model", "rating", "place", "last"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rated, kinds, before, last = None, {}, None, None, None

        def done() -> pa.RecordBatch:
            columns = [pa.array([group[i]] * len(rated), t) for i, t in enumerate(kinds)]
            own = [pa.array(list(rated), pa.string()), pa.array(list(rated.values()), pa.float64()), pa.array(range(len(rated)), pa.int64()), pa.array([last] * len(rated), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *own], names=names)

        for batch in batches:
            kinds = batch.schema.types[: len(by)]
            groups = zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True) if by else [()] * batch.num_rows
            for key, kind, seq, a, b, s, known in zip(groups, *[batch.column(len(by) + i).to_pylist() for i in range(6)], strict=True):
                if key != group:
                    if rated:
                        yield done()
                    group, rated, before, last = key, {}, None, None
                if not kind:
                    rated[a], before = s, known
                    last = known
                    continue
                if before is not None and seq is not None and seq <= before:
                    raise ValueError(f"match {seq} comes after match {before} has been rated")
                last = seq if last is None or seq is not None and seq > last else last
                x, y = rated.get(a, base), rated.get(b, base)
                gain = k * (s - 1 / (1 + 10 ** ((y - x) / 400)))
                rated[a] = x + gain
                rated[b] = y - gain
        if rated:
            yield done()

    return rows.mapInArrow(fold, ", ".join([*types, "model string", "rating double", "place long", "last long"]))


def ratings(matches: DataFrame, by: tuple[str, ...] = (), k: float = K, base: float = BASE, unknown: float | None = None) -> DataFrame:
    """by, model, rating after replaying each group's matches in order (seq); see replay()."""
    return replay(matches, by, k, base, unknown).drop("place", "last")


def warm_start(matches: DataFrame, k: float = K, base: float = BASE) -> DataFrame:
    """Ratings that a tournament continues with: here a winner that is nobody is a draw."""
    return ratings(matches, (), k, base, 0.5)


def circles(matches: DataFrame) -> DataFrame:
    """model and circle: the least model that it is linked with by matches, directly or through others.

    Pairs that have met are few beside matches, and are found by partial counts. Each round a model takes the least circle of those it
    has met and that circle's own one, so long chains shrink by half; rounds are written in the shared folder until none changes."""
    spark = matches.sparkSession
    folder = shared_folder(spark)
    met = sides(matches.withColumn("winner", F.lit("tie"))).where("model IS NOT NULL AND other IS NOT NULL").select("model", "other").distinct()
    met.write.parquet(f"{folder}/met")
    met = spark.read.schema(met.schema).parquet(f"{folder}/met")
    now, turn = met.select("model").distinct().withColumn("circle", F.col("model")), 0
    while True:
        near = met.join(now.select(F.col("model").alias("other"), F.col("circle").alias("_near")), "other").groupBy("model").agg(F.min("_near").alias("_near"))
        least = now.join(near, "model").withColumn("_least", F.least("circle", "_near"))
        jump = now.select(F.col("model").alias("_least"), F.col("circle").alias("_jump"))
        moved = least.join(jump, "_least").select("model", F.least("_least", "_jump").alias("circle"), (F.least("_least", "_jump") != F.col("circle")).alias("moved"))
        moved.write.parquet(f"{folder}/{turn}")
        moved = spark.read.schema(moved.schema).parquet(f"{folder}/{turn}")
        now, turn = moved.select("model", "circle"), turn + 1
        if moved.where("moved").isEmpty():
            return now


def ratings_apart(matches: DataFrame, k: float = K, base: float = BASE) -> DataFrame:
    """The ratings of one log. Models that no match links don't influence each other, so each circle of models is replayed by a
    task of its own."""
    which = circles(matches)
    n = which.limit(SENT + 1).count()
    placed = matches.join(F.broadcast(which) if n <= SENT else which, F.col("model_a") == F.col("model")).drop("model")
    return ratings(placed, ("circle",), k, base).drop("circle")


#: Matches of a log, or models, that may be sent to all tasks.
SENT = 1_000_000

#: Matches of a log that a task may hold as codes of at most 4 bytes each, models that such codes can name, and bytes of drawn codes held at a time.
HELD, NAMED, DRAWN = 64_000_000, 30_000, 1 << 27


def _written(df: DataFrame) -> DataFrame:
    """The rows, written in the shared folder and read again, so that what they come from is computed once."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resamples(matches: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """n_boot samples of as many matches with replacement: columns of matches, replicate, seq (the draw's place).

    Columns named position, draw or replicate are replaced. The log is written in the shared folder, as it is counted, cut and joined;
    it is sent to all tasks if the count shows that it is short."""
    matches = matches.drop("position", "draw", "replicate")
    spark, matches = matches.sparkSession, _written(matches)
    n = matches.count()
    draws = spark.range(n_boot * n).select(F.floor(F.col("id") / n).cast("int").alias("replicate"), (F.col("id") % n).alias("draw"))
    draws = draws.withColumn("position", digest(F.concat_ws(":", "replicate", "draw"), seed) % n)
    numbered = ordered_index(matches, "seq").drop("seq")
    return draws.join(F.broadcast(numbered) if n <= SENT else numbered, "position").withColumnRenamed("draw", "seq").drop("position")


def _run(start: np.ndarray, codes: np.ndarray, k: float) -> np.ndarray:
    """Ratings (log, piece, model) after each piece's matches (log, piece, match) from its start; see bootstrap() for the codes.

    All pieces advance together, match by match."""
    pieces, models, tenfold = codes.reshape(-1, codes.shape[-1]), start.shape[-1], float(np.log(10)) / 400
    bits, first, rated = models.bit_length() - 1, np.arange(len(pieces)) * models, start.flatten()
    for at in range(0, pieces.shape[1], 64):
        block = np.ascontiguousarray(pieces[:, at : at + 64].T).astype(np.int64)
        scored = block & 3
        for a, b, score, most in zip((block >> bits + 2) + first, (block >> 2 & models - 1) + first, (scored - 1) / 2, k * (scored > 0), strict=True):
            x, y = rated.take(a), rated.take(b)
            # 10 ** (difference / 400); numpy's exp takes a third of the time of its power.
            gain = most * (score - 1 / (1 + np.exp((y - x) * tenfold)))
            rated[a] = x + gain
            rated[b] = y - gain
    return rated.reshape(start.shape)


def _replays(logs: np.ndarray, models: int, k: float, base: float, forget: float = 10_000.0, joint: float = 1e-9) -> np.ndarray:
    """Ratings (log, model) after each log, a row of codes, every match of which is replayed.

    A log is cut into pieces that are replayed side by side. A piece starts at ratings that the end of the piece before it gives from the base, as ratings
    forget where they came from; then the whole piece before must end within ``joint`` of that start, or else the log is replayed in
    fewer pieces, and in one at last. Two sets of ratings never part further in a match if k < 694 (a match moves both ratings of a
    pair by a share of their difference, at most k ln 10 / 1600 of it), so a result is within joint * pieces of the replay in one piece."""
    rows, n = logs.shape
    ends = max(1, int(forget * models / k)) if 0 < k < 694 else n
    pieces, left, out = max(1, n // (8 * ends)), np.arange(rows), np.full((rows, models), float(base))
    while len(left):
        length = -(-n // pieces)
        cut = np.zeros((len(left), pieces, length), logs.dtype)
        cut.reshape(len(left), -1)[:, :n] = logs[left]
        start = np.full((len(left), pieces, models), float(base))
        if pieces > 1:
            start[:, 1:] = _run(start[:, 1:], cut[:, :-1, -ends:], k)
        end = _run(start, cut, k)
        joined = (abs(end[:, :-1] - start[:, 1:]) < joint).all(axis=(1, 2))
        out[left[joined]] = end[joined, -1]
        left, pieces = left[~joined], max(1, pieces // 4)
    return out


def _seen(codes: np.ndarray, models: int) -> np.ndarray:
    """Which models a scored match rates; it looks no further once all are found."""
    bits, seen = models.bit_length() - 1, np.zeros(models, bool)
    for at in range(0, len(codes), 1 << 16):
        some = codes[at : at + (1 << 16)].astype(np.int64)
        some = some[some & 3 > 0]
        seen[some >> bits + 2] = seen[some >> 2 & models - 1] = True
        if seen[1:].all():
            break
    return seen


def bootstrap(matches: DataFrame, n_boot: int = 200, seed: int = 0, k: float = K, base: float = BASE, sent: int = HELD) -> DataFrame:
    """replicate, model, rating: each sample of resamples() replayed.

    A log of up to ``sent`` matches is written in the shared folder in its order, as a code of one to four bytes for each match (its models' numbers and its
    score); a task reads that, and draws and replays its replicates from it, some side by side: nothing is shuffled n_boot times.
    The samples of a longer one are shuffled by replicate."""
    spark, log = matches.sparkSession, _written(matches.select("seq", "model_a", "model_b", "winner"))
    n = log.count()
    named = log.select(F.explode(F.array("model_a", "model_b")).alias("model")).where("model IS NOT NULL").distinct()
    names = [None, *sorted(r.model for r in named.limit(NAMED + 1).collect())]
    if n > sent or len(names) > NAMED:
        return ratings(resamples(log, n_boot, seed), ("replicate",), k, base)
    if len(names) == 1:
        return spark.createDataFrame([], "replicate int, model string, rating double")
    bits = (len(names) - 1).bit_length()
    number = lambda c: F.broadcast(spark.createDataFrame([*enumerate(names)][1:], f"{c}_n long, {c} string"))
    # A match that rates nobody, for want of a winner or a name, has no score: 0, else 1 to 3.
    score = F.when(F.col("model_a").isNull() | F.col("model_b").isNull(), 0).otherwise(F.coalesce(1 + 2 * _score(None), F.lit(0))).cast("long")
    code = F.shiftleft(F.coalesce("model_a_n", F.lit(0)), bits + 2) + F.shiftleft(F.coalesce("model_b_n", F.lit(0)), 2) + score
    coded = log.join(number("model_a"), "model_a", "left").join(number("model_b"), "model_b", "left").select("seq", code.alias("code"))
    folder = shared_folder(spark)
    coded.orderBy("seq", "code").select("code").write.parquet(f"{folder}/codes")
    parts = [path for path, _ in files(spark, f"{folder}/codes", ".parquet")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.parquet import ParquetFile

        log, at, models = np.empty(n, np.min_scalar_type((1 << 2 * bits + 2) - 1)), 0, 1 << bits
        for path in parts:
            system, place = arrow_path(path)
            with system.open_input_file(place) as data:
                for batch in ParquetFile(data).iter_batches():
                    log[at : at + batch.num_rows] = batch.column(0).to_numpy()
                    at += batch.num_rows
        few = max(1, DRAWN // log.nbytes)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for some in (ids[i : i + few] for i in range(0, len(ids), few)):
                drawn = np.empty((len(some), n), log.dtype)
                for replicate, row in zip(some, drawn, strict=True):
                    for i in range(0, n, 1 << 20):
                        row[i : i + (1 << 20)] = log[digests(f"{seed}:{replicate}:", i, min(n, i + (1 << 20))) % n]
                for replicate, row, rated in zip(some, drawn, _replays(drawn, models, k, base), strict=True):
                    (who,) = _seen(row, models).nonzero()
                    yield pa.RecordBatch.from_arrays([pa.array([replicate] * len(who), pa.int32()), pa.array([names[i] for i in who], pa.string()), pa.array(rated[who])], names=["replicate", "model", "rating"])

    dealt = spark.range(n_boot, numPartitions=max(1, min(n_boot, 2 * spark.sparkContext.defaultParallelism)))
    return dealt.mapInArrow(run, "replicate int, model string, rating double")


def leaderboard(matches: DataFrame, versions: dict[str, str] | None = None, n_boot: int = 200, seed: int = 0, k: float = K, base: float = BASE) -> DataFrame:
    """model, rating, ci_low, ci_high, wins, losses, draws, games, best first, of equal ratings the one rated first.

    Models that no scored match rates aren't listed. The interval is the 2.5 and 97.5 percentile of the replicates
    that a model plays in (its rating, if there are none); all three are rounded to one digit."""
    matches = of_version(matches, versions)
    if n_boot:
        matches = _written(matches.select("seq", "model_a", "model_b", "winner"))
    out = replay(matches, (), k, base).join(counts(matches), "model")
    if n_boot:
        boot = bootstrap(matches, n_boot, seed, k, base)
        ci = boot.groupBy("model").agg(F.percentile("rating", F.lit(0.025)).alias("low"), F.percentile("rating", F.lit(0.975)).alias("high"))
        out = out.join(ci, "model", "left")
    else:
        out = out.withColumn("low", F.col("rating")).withColumn("high", F.col("rating"))
    rounded = lambda c: F.round(F.coalesce(c, "rating"), 1)
    out = out.select("model", F.round("rating", 1).alias("rating"), rounded("low").alias("ci_low"), rounded("high").alias("ci_high"), "wins", "losses", "draws", "games", "place")
    return out.orderBy(F.desc("rating"), "place").drop("place")


def cache_key(*fields: str | Column) -> Column:
    """SHA-256 over the fields, each followed by a zero byte. A null field makes it null, a key that no cache holds."""
    parts = [x for f in fields for x in ((F.col(f) if isinstance(f, str) else f).cast("binary"), F.lit(b"\0"))]
    return F.sha2(F.concat(*parts), 256)


def last_write(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """A log's last row for each key. Partial maxima come before the shuffle, so a hot key costs little."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), seq).alias("r")).select("r.*")


def misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """The distinct keys that the cache can't answer."""
    return wanted.join(cache, key, "left_anti").dropDuplicates([key])


def hit_rate(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """hits, misses and hit_rate over all that is wanted."""
    hit = wanted.join(cache.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"), F.avg(F.coalesce("_hit", F.lit(0))).alias("hit_rate"))


def calibration(judged: DataFrame) -> DataFrame:
    """Counts of (category, judge, judge_version, model, slot), where slot a is the known answer: n, agree, tie, miss, miss_rate."""
    n = lambda s: F.count_if(F.col("slot") == s)
    out = judged.groupBy("category", "judge", "judge_version", "model").agg(F.count("*").alias("n"), n("a").alias("agree"), n("tie").alias("tie"), n("b").alias("miss"))
    return out.withColumn("miss_rate", F.round(F.col("miss") / F.col("n"), 3)).orderBy("judge", "category", "model")


def pair_up(names: Iterable[str], rating: dict[str, float], played: set[frozenset[str]], seed: int = 0) -> list[tuple[str, str]]:
    """A round's pairs. In the order of ratings (of equal ones a seeded digest's) each player that is still free
    gets the free one after it that it hasn't met, or else any, the nearest of these. ``played`` grows.

    The registry of players is small and each choice depends on the ones before, so this runs on the driver."""
    from hashlib import md5

    ranked = sorted(names, key=lambda n: (rating.get(n, BASE), md5(f"{seed}:{n}".encode()).hexdigest()))
    met = lambda i, j: frozenset((ranked[i], ranked[j])) in played
    free, pairs = dict.fromkeys(range(len(ranked))), []
    for i in range(len(ranked)):
        rivals = [(met(i, j), j) for j in free if j > i] if i in free else []
        if rivals:
            _, j = min(rivals)
            del free[i], free[j]
            pairs.append((ranked[i], ranked[j]))
    played.update(map(frozenset, pairs))
    return pairs


Player = Callable[[Column], Column]
Judge = Callable[[Column, Column, Column], Column]


def echo(prompt: Column) -> Column:
    """The player that answers with its prompt."""
    return prompt


def coin(seed: int) -> Judge:
    """A judge that flips a seeded coin: struct of winner and reason."""

    def judge(prompt: Column, a: Column, b: Column) -> Column:
        return F.struct(F.when(digest(F.concat_ws("\0", prompt, a, b), seed) % 2 == 0, "A").otherwise("B").alias("winner"), F.lit("").alias("reason"))

    return judge


def from_texts(answer: Callable[[list[str]], list[str]]) -> Player:
    """A player that answers batches of prompts in Python, a model that a task loads once or a remote one: see remote()."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("string")
    def play(prompts: pa.Array) -> pa.Array:
        return pa.array(answer(prompts.to_pylist()), pa.string())

    return play


def judge_prompt(prompt: str, a: str, b: str, rubric: str) -> str:
    """What a judging model reads: the rubric and both answers. A fixed format."""
    return f"{rubric}\n---\nPrompt:\n{prompt}\n\n---\nResponse A:\n{a}\n\n---\nResponse B:\n{b}\n"


#: The rubric of a judge that has no other.
RUBRIC = 'Compare two responses to one prompt by correctness, by what is left out and by what is made up.\nAnswer with JSON only: {"winner": "A" or "B" or "tie", "reason": "<a sentence>"}\n'


def from_verdicts(answer: Callable[[list[str]], list[str]], rubric: str = RUBRIC) -> Judge:
    """A judge whose model answers batches of judge_prompt() texts with JSON; anything else is a tie."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("string")
    def ask(prompts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        texts = [judge_prompt(*x, rubric) for x in zip(prompts.to_pylist(), one.to_pylist(), two.to_pylist(), strict=True)]
        return pa.array(answer(texts), pa.string())

    return lambda prompt, a, b: verdict(ask(prompt, a, b))


def remote(url: str, model: str, key: str | None = None, system: str | None = None, tries: int = 3, timeout: float = 60.0, **settings) -> Callable[[list[str]], list[str]]:
    """Answers of a chat service over HTTP (messages in, choices out), one request for each text; for from_texts() and from_verdicts()."""

    def answer(texts: list[str]) -> list[str]:
        import json
        import time
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        out = []
        for text in texts:
            messages = [{"role": "system", "content": system}] if system else []
            body = json.dumps({"model": model, "messages": [*messages, {"role": "user", "content": text}], **settings}).encode()
            request = Request(url, body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})})
            for again in range(tries):
                try:
                    with urlopen(request, timeout=timeout) as reply:
                        out.append(json.loads(reply.read())["choices"][0]["message"]["content"] or "")
                    break
                except URLError:
                    if again == tries - 1:
                        raise
                    time.sleep(2**again)
        return out

    return answer


def key_values(items: Iterable[str]) -> dict[str, str]:
    """name=value settings; the first = divides them, and one without is an error."""
    parts = [item.partition("=") for item in items]
    for name, sign, _ in parts:
        if not sign:
            raise ValueError(f"expected name=value, got {name!r}")
    return {name: value for name, _, value in parts}


class Registry:
    """Named players (one configuration for each name) and judges with versions (the last one counts)."""

    def __init__(self):
        self.players: dict[str, tuple[Player, str]] = {}
        self.judges: dict[str, tuple[Judge, str]] = {}

    def player(self, name: str, play: Player, config: str = "") -> None:
        if name in self.players and self.players[name][1] != config:
            raise ValueError(f"player {name!r} exists with another configuration")
        self.players[name] = (play, config)

    def judge(self, name: str, judge: Judge, version: str = "") -> None:
        self.judges[name] = (judge, version)


def derived_log(events: DataFrame) -> DataFrame:
    """A stand-in match table from an event table: neighbours in a user's events meet, types are the players.

    The higher fifth of the value scale wins, equal fifths are a tie; a type doesn't meet itself."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("event_id", F.lag("event_type").over(before).alias("model_a"), F.col("event_type").alias("model_b"), F.floor(F.lag("value").over(before) / 20).alias("va"), F.floor(F.col("value") / 20).alias("vb"))
    rows = rows.where("model_a <> model_b AND va IS NOT NULL AND vb IS NOT NULL")
    winner = F.when(F.col("va") > F.col("vb"), F.col("model_a")).when(F.col("va") < F.col("vb"), F.col("model_b")).otherwise("tie")
    return rows.select(F.col("event_id").alias("seq"), "model_a", "model_b", F.concat(F.lit("judge"), F.col("event_id") % 3).alias("judge"), F.concat(F.lit("v"), F.floor(F.col("event_id") / 3) % 2).alias("judge_version"), winner.alias("winner"))


def calibrate(prompts: DataFrame, registry: Registry) -> DataFrame:
    """Judge every player's answer against the known one (category, prompt, gold), both ways round, and count."""
    units = []
    for name, (play, _) in registry.players.items():
        answer = play(F.col("prompt"))
        for judge_name, (judge, version) in registry.judges.items():
            c = consolidate(judge(F.col("prompt"), F.col("gold"), answer), judge(F.col("prompt"), answer, F.col("gold")))
            units.append(F.struct(F.lit(name).alias("model"), F.lit(judge_name).alias("judge"), F.lit(version).alias("judge_version"), c["slot"].alias("slot")))
    judged = prompts.where("gold IS NOT NULL AND gold <> ''").select("category", F.explode(F.array(*units)).alias("u")).select("category", "u.*")
    return calibration(judged)


MATCH_COLUMNS = ["seq", "model_a", "model_b", "judge", "judge_version", "winner"]


def export_all(matches: DataFrame, out: str, versions: dict[str, str] | None = None, n_boot: int = 200) -> dict[str, str]:
    """Three CSV reports: matches and head to head over all versions, the leaderboard over the wanted ones."""
    from ..sources.sinks import csv

    board = leaderboard(matches, versions, n_boot)
    reports = {"matches": (matches.orderBy("seq"), MATCH_COLUMNS), "leaderboard": (board, board.columns), "head_to_head": ((m := matrix(matches)).orderBy("row_model"), m.columns)}
    for name, (df, columns) in reports.items():
        csv(df, columns, f"{out}/{name}", name != "matches")
    return {name: f"{out}/{name}" for name in reports}


def export_calibration(counted: DataFrame, out: str) -> dict[str, str]:
    """The rows of calibration() as JSON lines and as CSV, in their order."""
    from ..sources.sinks import csv

    paths = {"json": f"{out}/calibration.jsonl", "csv": f"{out}/calibration.csv"}
    counted.coalesce(1).write.mode("overwrite").json(paths["json"])
    csv(counted, counted.columns, paths["csv"])
    return paths
