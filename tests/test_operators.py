"""Operators on small fixtures."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import arena, chat, corpus, metrics, order, tokens, tournament
from tidewright.operators.cache import Cache
from tidewright.sources import registry, sinks, text
from tidewright.streaming import elo, scan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- corpus


def test_book_markers(spark):
    book = "Header\n*** START OF THE PROJECT GUTENBERG EBOOK TITLE\nTWO ***body\nof it*** END OF THIS PROJECT GUTENBERG EBOOK ***\nfooter"
    assert one(spark, corpus.strip_book(F.lit(book))) == "body\nof it"
    assert one(spark, corpus.strip_book(F.lit("no markers"))) == "no markers"


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "short\n\nhard\nwrapped   line that is long enough to keep here\n \n" + "x" * 40)], "id long, text string")
    assert [r.text for r in corpus.paragraphs(df, 40).orderBy("ord").collect()] == ["hard wrapped line that is long enough to keep here", "x" * 40]
    assert one(spark, corpus.unwrap(F.lit(" a \x1c\x85b "))) == "a b"


@pytest.mark.parametrize("n", [0, 8, 40, 99])
def test_exact_split(spark, n):
    df = spark.range(40).withColumnRenamed("id", "key")
    split = [r.split for r in corpus.exact_split(df, "key", n).collect()]
    assert len(split) == 40 and split.count("validation") == min(n, 40)


def test_fraction_split_has_one_at_least(spark):
    assert corpus.fraction_split(spark.range(3), "id", 0.02).where("split = 'validation'").count() == 1


def test_combine(spark):
    a, b = spark.range(10).select(F.col("id").alias("key")), spark.range(100, 105).select(F.col("id").alias("key"))
    assert corpus.combine({"a": a, "b": b}, {"a": 2.0, "b": 2.0}, "key").count() == 15
    assert corpus.combine({"a": a}, {"a": 0.3}, "key").count() == 10
    mixed = corpus.combine({"a": a, "b": b}, {"a": 1.0, "b": 3.0}, "key").collect()
    # Source a is used up once at 40 rows, so b's five rows come six times each.
    assert sum(r.source == "a" for r in mixed) == 10 and sum(r.source == "b" for r in mixed) == 30
    assert {r.key for r in mixed} == {*range(10), *range(100, 105)}


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 3.0}, {"a": 5.0, "b": 1.0, None: 2.0}, {"a": 0.01, "b": 1.0}])
def test_interleave_is_the_one_drawn_row_by_row(spark, weights):
    draw = lambda key: int(hashlib.md5(f"1337:{key}".encode()).hexdigest()[:12], 16)
    rows = [(i, "a" if i < 11 else "b" if i < 40 or None not in weights else None) for i in range(55)]
    order = {n: sorted((i for i, s in rows if s == n), key=lambda i: (draw(i), i)) for n in weights}
    cuts, total = [], sum(weights.values())
    for n in weights:
        cuts.append((cuts[-1] if cuts else 0) + weights[n])
    want, at, done, i = [], dict.fromkeys(weights, 0), set(), 0
    while len(done) < len(weights):
        n = list(weights)[sum(int(c / total * 2**48) <= draw(i) for c in cuts[:-1])]
        want.append((i, order[n][at[n]], n))
        at[n] += 1
        if at[n] == len(order[n]):
            done.add(n)
            at[n] = 0
        i += 1
    got = corpus.interleave(spark.createDataFrame(rows, "key long, source string").repartition(4), weights, "key").collect()
    assert sorted((r.output_order, r.key, r.source) for r in got) == want
    with pytest.raises(ValueError):
        corpus.interleave(spark.createDataFrame(rows, "key long, source string"), {"a": 1.0, "x": 2.0}, "key")
    assert corpus.interleave(spark.createDataFrame([], "key long, source string"), weights, "key").count() == 0


def test_exact_split_of_null_and_equal_keys(spark):
    rows = [(None, "a"), (None, "b"), (1, "x"), (1, "y"), (1, "y"), (2, "z")]
    df = spark.createDataFrame(rows, "key long, text string")
    for n in range(8):
        one, two = (sorted(map(repr, corpus.exact_split(d, "key", n).collect())) for d in (df, df.repartition(5)))
        assert one == two and sum("validation" in r for r in one) == min(n, 6)


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a" * 30, 7, "old", 5, [9])], "key long, text string, ord int, source string, output_order int, ids array<int>")
    assert corpus.paragraphs(df, 10).first().ord == 0
    both = corpus.combine({"a": df, "b": df}, {"a": 1.0, "b": 3.0}, "key").collect()
    assert {r.source for r in both} == {"a", "b"} and all(isinstance(r.output_order, float) for r in both)
    assert tokens.encode(df, tokens.train(df, 258)).first().ids[-1] == 0
    clash = log(spark, ROWS).selectExpr("*", "1 AS position", "2 AS draw", "3 AS replicate")
    assert sorted({r.replicate for r in arena.resamples(clash, 2).collect()}) == [0, 1]


def reference_dialect(text):
    import re

    forms = {}
    for word, other in corpus.DIALECT:
        forms |= {word: other, word.capitalize(): other[0].upper() + other[1:]}
    pattern = "|".join(sorted(map(re.escape, forms), key=len, reverse=True))
    return re.sub(rf"(?<![A-Za-z'])({pattern})(?![A-Za-z'])", lambda m: forms[m[1]], text)


def test_dialect_of_neighbours(spark):
    texts = ["the the sea and and", "My friend, my friend friends my my friend", "'the the' the's theirs", "", "the\nthe\tThe", "é the é you,you;you"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", corpus.dialect(F.col("t")).alias("d")).collect()}
    assert got == {i: reference_dialect(t) for i, t in enumerate(texts)} | {9: None}
    assert got[0] == "th' th' briny deep an' an'"


def test_dialect(spark):
    assert one(spark, corpus.dialect(F.lit("Hello my friend, you and the sea. Theirs"))) == "Ahoy me hearty, ye an' th' briny deep. Theirs"


def test_ordered_index_and_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).alias("v")).repartition(5)
    assert all(r.position == r.k for r in order.ordered_index(df, "k").collect())
    assert all(r.before == 2 * r.k for r in order.running_total(df, "k", "v").collect())
    assert order.ordered_index(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("cells", [1, 2, 7, 512, 3000])
def test_range_cells(spark, cells):
    df = spark.range(2000).select(((F.col("id") * 37) % 1009 - 500).alias("k"))
    cell = order.range_cell(df, "k", least=cells)
    rows = sorted((r.k, r.c) for r in df.select("k", cell.alias("c")).collect())
    assert [c for _, c in rows] == sorted(c for _, c in rows) and len({c for _, c in rows}) > min(cells, 900) / 2


# --- chat


TURNS = "array<struct<role:string,text:string>>"


def letters(t):
    return F.transform(F.split(t, ""), lambda c: F.ascii(c))


def reference_mask(conv, block, eos):
    ids, labels = [], []
    for i, (role, t) in enumerate(conv):
        cue = ("\n" if i else "") + ("User: " if role == "user" else "Pirate: ")
        if role == "user":
            ids += map(ord, cue + t)
            labels += [-100] * len(cue + t)
        else:
            body = [*map(ord, t), eos]
            ids += [*map(ord, cue), *body]
            labels += [-100] * len(cue) + body
    cut, ids, labels = len(ids) > block, ids[-block:], labels[-block:]
    if all(x == -100 for x in labels):
        return None
    return ids + [eos] * (block - len(ids)), labels + [-100] * (block - len(labels)), cut


CONVERSATIONS = [
    [("user", "hi"), ("bot", "ahoy")],
    [("user", "a"), ("bot", "b"), ("user", "c"), ("bot", "d")],
    [("user", "long " * 40), ("bot", "ok")],
    [("bot", "ok"), ("user", "long " * 40)],
    [("user", "x"), ("user", "y")],
]


@pytest.mark.parametrize("block", [16, 40, 400])
def test_masked(spark, block):
    df = spark.createDataFrame([(c,) for c in CONVERSATIONS], f"turns {TURNS}")
    got = [r.e and (r.e.input_ids, r.e.labels, r.e.truncated) for r in df.select(chat.masked(F.col("turns"), letters, 0, block).alias("e")).collect()]
    assert got == [reference_mask(c, block, 0) for c in CONVERSATIONS]


def reference_window(conv, budget, eos):
    conv = list(conv)
    while True:
        ids = []
        for i, (role, t) in enumerate(conv):
            cue = ("\n" if i else "") + ("User: " if role == "user" else "Pirate: ")
            ids += [*map(ord, cue + t)] + ([eos] if role != "user" else [])
        ids += map(ord, ("\n" if conv else "") + "Pirate: ")
        if len(ids) <= budget or len(conv) <= 1:
            return ids[-budget:]
        conv.pop(0)


@pytest.mark.parametrize("block", [20, 32, 48, 400])
def test_prompt_window(spark, block):
    convs = [*CONVERSATIONS, []]
    df = spark.createDataFrame([(c,) for c in convs], f"turns {TURNS}")
    assert [r.w for r in df.select(chat.prompt_window(F.col("turns"), letters, 0, block, 8).alias("w")).collect()] == [reference_window(c, block - 8, 0) for c in convs]


def test_instruction_prompt(spark):
    assert one(spark, chat.instruction_prompt(F.lit(" \tdo it\n"))) == "### Instruction:\ndo it\n\n### Response:\n"


def test_instructions(spark):
    df = spark.createDataFrame([(1, " do it ", None, "done"), (2, "with", " ctx\t", "ok"), (3, " ", "x", "y"), (4, "a", "b", None)], "conv_id long, instruction string, context string, response string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.instructions(df).collect()}
    assert got == {1: [("user", "do it"), ("bot", "done")], 2: [("user", "with\nctx"), ("bot", "ok")]}


def test_shift(spark):
    x = one(spark, chat.shifted(F.struct(F.array(*map(F.lit, (1, 2, 3))).alias("input_ids"), F.array(*map(F.lit, (4, 5, 6))).alias("labels"))))
    assert (x.x, x.y) == ([1, 2], [5, 6])


# --- arena


def log(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, model_a string, model_b string, judge string, judge_version string, winner string")


def replay(rows, unknown=None):
    r = {}
    for a, b, _, _, w in rows:
        s = 1.0 if w == a else 0.0 if w == b else 0.5 if w == "tie" else unknown
        if s is None:
            continue
        x, y = r.get(a, 1500.0), r.get(b, 1500.0)
        e = 1 / (1 + 10 ** ((y - x) / 400))
        r[a], r[b] = x + 8 * (s - e), y - 8 * (s - e)
    return r


ROWS = [("a", "b", "j", "v1", "a"), ("b", "c", "j", "v2", "b"), ("c", "a", "k", None, "tie"), ("a", "c", "k", "v1", "nobody"), ("b", "a", "j", "v1", "b")]


def test_replay(spark):
    for unknown, f in ((None, arena.ratings), (0.5, arena.warm_start)):
        got = {r.model: r.rating for r in f(log(spark, ROWS).repartition(4)).collect()}
        assert got == pytest.approx(replay(ROWS, unknown))


def test_published_point_ratings(spark):
    rows = [x for _ in range(45) for x in (("s3", "s8", "j", "", "tie"), ("s3", "gpt", "j", "", "gpt"), ("s3", "s8", "j", "", "tie"))]
    got = {r.model: r.rating for r in arena.ratings(log(spark, rows)).collect()}
    assert got == pytest.approx(replay(rows)) and got["gpt"] > got["s8"] > got["s3"]


def test_unknown_winners_differ_by_operator(spark):
    c = {r.model: r for r in arena.counts(log(spark, ROWS)).collect()}
    assert (c["a"].wins, c["a"].losses, c["a"].draws, c["a"].games) == (1, 1, 1, 4)
    h = {(r.model, r.other): r for r in arena.head_to_head(log(spark, ROWS)).collect()}
    assert (h["a", "c"].ties, h["a", "c"].n) == (2, 2)


def test_versions(spark):
    m = log(spark, ROWS)
    assert {r.judge: r.mixed for r in arena.judge_versions(m).collect()} == {"j": True, "k": True}
    assert arena.of_version(m, {"j": "v1"}).count() == 4 and arena.of_version(m, None).count() == 5


def test_leaderboard_lists_rated_models_in_the_order_of_their_rating_and_first_match(spark):
    rows = [("z", "y", "j", "", "tie"), ("b", "a", "j", "", "tie"), ("q", "r", "j", "", "nobody"), ("a", "q", "j", "", "nobody")]
    board = arena.leaderboard(log(spark, rows).repartition(3), n_boot=0).collect()
    assert [(r.model, r.rating, r.games) for r in board] == [("z", 1500.0, 1), ("y", 1500.0, 1), ("b", 1500.0, 1), ("a", 1500.0, 2)]
    assert arena.leaderboard(log(spark, rows[2:]), n_boot=3).collect() == []


def test_replay_by_groups_and_batches(spark):
    rows = [(g, i, f"m{(i * 7 + g) % 5}", f"m{(i * 3 + g) % 5 + 5}", ("tie", f"m{(i * 7 + g) % 5}", f"m{(i * 3 + g) % 5 + 5}")[i % 3]) for g in range(3) for i in range(12_000)]
    df = spark.createDataFrame(rows, "g long, seq long, model_a string, model_b string, winner string").repartition(7)
    got = {(r.g, r.model): r.rating for r in arena.ratings(df, ("g",)).collect()}
    want = {(g, m): x for g in range(3) for m, x in replay([(a, b, "", "", w) for h, _, a, b, w in rows if h == g]).items()}
    assert got == pytest.approx(want)


def match_rows(n, models, seed=1):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.sample(models, 2)
        rows.append((3 * i, a, b, rng.choice([a, b, "tie", "nobody"])))
    return rows


MATCHES = "seq long, model_a string, model_b string, winner string"


def test_bootstrap_of_short_and_of_long_logs(spark):
    df = spark.createDataFrame(match_rows(300, list("abcdef")), MATCHES).repartition(3)
    short, long = ({(r.replicate, r.model): r.rating for r in arena.bootstrap(df, 7, 5, sent=sent).collect()} for sent in (1000, 10))
    assert short == pytest.approx(long) and len(short) == 42
    assert arena.bootstrap(df.limit(0), 5).count() == 0


def resample(rows, replicate, seed):
    """The draws of one replicate, one by one."""
    return [rows[int(hashlib.md5(f"{seed}:{replicate}:{i}".encode()).hexdigest()[:12], 16) % len(rows)] for i in range(len(rows))]


def test_bootstrap_of_a_log_beyond_a_million_matches_without_a_shuffle_of_samples(spark, monkeypatch):
    n = 1_000_003
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    df = spark.range(n).select((n - F.col("id")).alias("seq"), name(F.col("id") % 5).alias("model_a"), name((F.col("id") + 1 + F.col("id") % 3) % 5).alias("model_b"), (F.col("id") * 7919 % 11).alias("r"))
    df = df.withColumn("winner", F.when(F.col("r") < 5, F.col("model_a")).when(F.col("r") < 8, F.col("model_b")).when(F.col("r") < 10, "tie").otherwise("nobody"))
    rows = [(f"m{i % 5}", f"m{(i + 1 + i % 3) % 5}", i * 7919 % 11) for i in reversed(range(n))]
    rows = [(a, b, "", "", a if r < 5 else b if r < 8 else "tie" if r < 10 else "nobody") for a, b, r in rows]
    monkeypatch.setattr(arena, "resamples", None)
    got = {(r.replicate, r.model): r.rating for r in arena.bootstrap(df, 2, 3).collect()}
    assert len(got) == 10 and {m: x for (r, m), x in got.items() if r == 1} == pytest.approx(replay(resample(rows, 1, 3)), abs=1e-7)


def test_bootstrap_skips_matches_that_rate_nobody(spark):
    rows = [(5, "a", "b", "a"), (None, "b", "c", "tie"), (7, "d", "a", "nobody"), (7, None, "a", "a"), (8, "c", "c", "c"), (9, "b", "e", "e")]
    got = {(r.replicate, r.model): r.rating for r in arena.bootstrap(spark.createDataFrame(rows, MATCHES), 9, 2, base=1000).collect()}
    want = {}
    for g in range(9):
        played = [r for r in resample([rows[i] for i in (1, 0, 3, 2, 4, 5)], g, 2) if r[1] and r[3] != "nobody"]
        want |= {(g, m): x - 500 for m, x in replay([(a, b, "", "", w) for _, a, b, w in played]).items()}
    assert got == pytest.approx(want) and {m for _, m in got} == set("abce")


def test_leaderboard_computes_its_log_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    df = log(spark, ROWS)
    board = arena.leaderboard(df.mapInArrow(counted, df.schema), n_boot=3).collect()
    assert sorted(r.model for r in board) == ["a", "b", "c"] and computed.value == len(ROWS)


def test_pieces_that_do_not_join_are_replayed_in_fewer(monkeypatch):
    import numpy as np

    rng, shapes, run = np.random.default_rng(1), [], arena._run
    a = rng.integers(1, 4, (2, 30_000))
    logs = (a << 4 | (a % 3 + 1) << 2 | rng.integers(0, 4, a.shape)).astype(np.uint8)
    whole = arena._replays(logs, 4, 8.0, 1500.0, forget=1e9)
    monkeypatch.setattr(arena, "_run", lambda start, codes, k: shapes.append(codes.shape) or run(start, codes, k))
    assert arena._replays(logs, 4, 8.0, 1500.0, forget=20) == pytest.approx(whole, abs=1e-7) and shapes[1][1] > shapes[-1][1]
    assert arena._replays(logs, 4, 800.0, 1500.0, forget=20) == pytest.approx(run(np.full((2, 1, 4), 1500.0), logs[:, None], 800.0)[:, 0])


@pytest.mark.parametrize("before,start,stop", [("0:0:", 0, 1203), ("5:199:", 9_990, 10_020), ("-3:12:", 99_998, 125_003), ("7:123456:", 123_456_789_995, 123_456_800_005), ("", 0, 0)])
def test_digests_by_arrays(before, start, stop):
    assert order.digests(before, start, stop).tolist() == [int(hashlib.md5(f"{before}{i}".encode()).hexdigest()[:12], 16) for i in range(start, stop)]


def test_circles_and_ratings_apart(spark):
    rows = match_rows(200, [f"a{i}" for i in range(9)], 1) + [(r[0] + 1, *r[1:]) for r in match_rows(90, ["b", "c"], 2)] + [(5000 + i, f"m{i:02}", f"m{i + 1:02}", "tie" if i % 3 else f"m{i:02}") for i in range(40)] + [(9000, "x", "y", "nobody")]
    df = spark.createDataFrame(rows, MATCHES).repartition(5)
    found = {r.model: r.circle for r in arena.circles(df).collect()}
    assert found == {**{f"a{i}": "a0" for i in range(9)}, "b": "b", "c": "b", **{f"m{i:02}": "m00" for i in range(41)}, "x": "x", "y": "x"}
    whole = {r.model: r.rating for r in arena.ratings(df).collect()}
    assert {r.model: r.rating for r in arena.ratings_apart(df).collect()} == pytest.approx(whole) and len(whole) == 52


@pytest.mark.parametrize("by", [(), ("g",)])
def test_ratings_follow_a_log(spark, tmp_path, by):
    rows = [(i % 3, *r) for i, r in enumerate(match_rows(240, list("abcde")))]
    schema = f"g long, {MATCHES}"
    whole = spark.createDataFrame(rows, schema)
    args = (f"{tmp_path}/log", whole.schema, f"{tmp_path}/state", f"{tmp_path}/checkpoint", by)
    for a, b in ((0, 1), (1, 100), (100, 101), (101, 240)):
        spark.createDataFrame(rows[a:b], schema).repartition(3).write.mode("append").json(f"{tmp_path}/log")
        got = elo.follow(spark, *args)
        want = arena.replay(spark.createDataFrame(rows[:b], schema), by)
        key = lambda r: (*[r[c] for c in by], r.model)
        assert {key(r): (r.rating, r.place, r["last"]) for r in got.collect()} == {key(r): (pytest.approx(r.rating), r.place, r["last"]) for r in want.collect()}
    assert elo.follow(spark, *args).count() == got.count()
    # A match that comes too late stops the stream, and what was rated stays.
    spark.createDataFrame([(0, 4, "a", "b", "a")], schema).write.mode("append").json(f"{tmp_path}/log")
    with pytest.raises(Exception, match="comes after"):
        elo.follow(spark, *args)
    assert elo.rated(spark, f"{tmp_path}/state", got.select(*by).schema if by else None).count() == got.count()


def test_published_head_to_head(spark):
    rows = [x for _ in range(45) for x in (("s3", "s8", "j", "", "tie"), ("gpt", "s3", "j", "", "gpt"), ("s8", "s3", "j", "", "tie"))] + [("gpt", "s8", "j", "", "nobody")]
    got = arena.matrix(log(spark, rows)).orderBy("row_model")
    assert got.columns == ["row_model", "gpt", "s3", "s8"]
    assert [tuple(r) for r in got.collect()] == [("gpt", "-", "45-0-0/45", "0-0-1/1"), ("s3", "0-45-0/45", "-", "0-0-90/90"), ("s8", "0-0-1/1", "0-0-90/90", "-")]


def test_slot_counts(spark):
    r = arena.slot_counts(log(spark, ROWS)).first()
    assert (r.a_wins, r.b_wins, r.ties, r.games) == (3, 0, 1, 5)


def test_key_values():
    assert arena.key_values(["a=1", "b=x=y", "c="]) == {"a": "1", "b": "x=y", "c": ""}
    with pytest.raises(ValueError):
        arena.key_values(["a"])


def test_players_and_judges_in_python(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][-1]["content"]
            answer = json.dumps({"winner": "A", "reason": body["model"]}) if "Response A:" in said else said.upper()
            data = json.dumps({"choices": [{"message": {"content": answer}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/chat"
    play, judge = arena.from_texts(arena.remote(url, "m")), arena.from_verdicts(arena.remote(url, "j"))
    df = spark.createDataFrame([("hi",), ("yo",)], "p string").select("p", play(F.col("p")).alias("r"))
    rows = df.select("p", "r", judge(F.col("p"), F.col("r"), F.col("p")).alias("v")).collect()
    server.shutdown()
    assert [(r.p, r.r, tuple(r.v)) for r in rows] == [("hi", "HI", ("A", "j")), ("yo", "YO", ("A", "j"))]
    assert arena.judge_prompt("p", "a", "b", "R") == "R\n---\nPrompt:\np\n\n---\nResponse A:\na\n\n---\nResponse B:\nb\n"


def test_forced_repeats(spark):
    # The weakest has met all; it takes the nearest, though the others haven't met.
    played = {frozenset("ab"), frozenset("ac"), frozenset("ad")}
    assert arena.pair_up("abcd", {"a": 1, "b": 2, "c": 3, "d": 4}, played) == [("a", "b"), ("c", "d")]
    assert frozenset("cd") in played


def test_tournament_goes_on_after_a_log(spark):
    reg = arena.Registry()
    for n in "ab":
        reg.player(n, arena.echo)
    reg.judge("coin", arena.coin(1))
    rows = tournament.tournament(spark, reg, ["one"], rounds=2, log=log(spark, ROWS)).collect()
    assert [r.seq for r in rows] == [5]


def test_leaderboard_without_bootstrap(spark):
    rows = arena.leaderboard(log(spark, ROWS), n_boot=0).collect()
    assert all(r.ci_low == r.rating == r.ci_high for r in rows) and [r.rating for r in rows] == sorted((r.rating for r in rows), reverse=True)


def test_bootstrap_brackets(spark):
    rows = [("a", "b", "j", "", "a")] * 8 + [("a", "b", "j", "", "b")] * 2
    r = {x.model: x for x in arena.leaderboard(log(spark, rows), n_boot=30).collect()}
    assert r["a"].ci_low <= r["a"].rating <= r["a"].ci_high and r["a"].rating > r["b"].rating


@pytest.mark.parametrize("f,r,slot,reason", [("A", "B", "a", "x | swap: y"), ("B", "A", "b", "x | swap: y"), ("A", "A", "tie", "x | swap: y"), ("tie", "B", "tie", "x | swap: y")])
def test_swap(spark, f, r, slot, reason):
    v = lambda w, s: F.struct(F.lit(w).alias("winner"), F.lit(s).alias("reason"))
    assert tuple(one(spark, arena.consolidate(v(f, "x"), v(r, "y")))) == (slot, reason)
    assert one(spark, arena.consolidate(v("A", ""), v("A", ""))).reason == "swap disagreed"


def test_verdict(spark):
    assert [tuple(one(spark, arena.verdict(F.lit(x)))) for x in ('{"winner":"A","reason":"r"}', '{"winner":"Z"}', "{}")] == [("A", "r"), ("tie", ""), ("tie", "")]


def test_pairing():
    rating = {"best": 1800, "strong": 1600, "mid": 1400, "weak": 1000}
    assert arena.pair_up(rating, rating, set()) == [("weak", "mid"), ("strong", "best")]
    played = set()
    for turn in range(3):
        arena.pair_up("abcd", dict.fromkeys("abcd", 1500.0), played, turn)
    assert len(played) >= 4


def test_tournament(spark):
    reg = arena.Registry()
    for n in "abc":
        reg.player(n, arena.echo if n != "c" else lambda p: F.upper(p))
    with pytest.raises(ValueError):
        reg.player("a", arena.echo, "other")
    reg.judge("coin", arena.coin(3), "v1")
    rows = tournament.tournament(spark, reg, ["one", "two"], rounds=3).collect()
    assert [r.seq for r in rows] == list(range(len(rows))) and {r.winner for r in rows} <= {"a", "b", "c", "tie"} and len(rows) >= 4


def plain_tournament(names, judges, verdicts, prompts, rounds, rating):
    """One match after the other, as they are played."""
    rows, every = [], len(names) * (len(names) - 1) // 2
    for no, prompt in enumerate(prompts):
        played = set()
        for turn in range(rounds):
            if len(played) >= every:
                break
            for a, b in arena.pair_up(names, rating, played, turn):
                for j in judges:
                    f, r = verdicts(j, prompt, names[a], names[b]), verdicts(j, prompt, names[b], names[a])
                    pf, pr = {"A": "a", "B": "b"}.get(f, "tie"), {"A": "b", "B": "a"}.get(r, "tie")
                    slot = pf if pf == pr else "tie"
                    s = {"a": 1.0, "b": 0.0}.get(slot, 0.5)
                    gain = 8 * (s - 1 / (1 + 10 ** ((rating[b] - rating[a]) / 400)))
                    rating[a] += gain
                    rating[b] -= gain
                    rows.append((prompt, a, b, f"{prompt}{names[a]}", f"{prompt}{names[b]}", j, {"a": a, "b": b}.get(slot, "tie"), f, r))
    return rows


@pytest.mark.parametrize(("players", "rounds", "waves"), [(5, 3, 6), (4, 5, 6), (6, 2, 0), (6, 2, 1), (1, 3, 6), (2, 3, 6)])
def test_tournament_is_the_one_played_match_by_match(spark, players, rounds, waves):
    names = {f"p{i}": f"<{i * 7 % 5}>" for i in range(players)}
    reg = arena.Registry()
    for n, mark in names.items():
        reg.player(n, lambda p, mark=mark: F.concat(p, F.lit(mark)))
    said = lambda salt, p, x, y: "ABt"[int(hashlib.md5(f"{salt}{p}{x}{y}".encode()).hexdigest()[:6], 16) % 3].replace("t", "tie")

    def judge(salt):
        pick = lambda p, x, y: F.conv(F.substr(F.md5(F.concat(F.lit(salt), p, x, y).cast("binary")), F.lit(1), F.lit(6)), 16, 10).cast("long") % 3
        return lambda p, x, y: F.struct(F.when(pick(p, x, y) == 0, "A").when(pick(p, x, y) == 1, "B").otherwise("tie").alias("winner"), F.lit("r").alias("reason"))

    for j in ("j1", "j2"):
        reg.judge(j, judge(j), "v")
    prompts = [f"prompt {i}" for i in range(12)] + ["prompt 3"]
    got = [(r.prompt, r.model_a, r.model_b, r.response_a, r.response_b, r.judge, r.winner, r.verdict_forward, r.verdict_reverse) for r in tournament.tournament(spark, reg, prompts, rounds, waves=waves).orderBy("seq").collect()]
    verdicts = lambda j, p, x, y: said(j, p, p + x, p + y)
    want = plain_tournament(names, ("j1", "j2"), verdicts, prompts, rounds, dict.fromkeys(names, 1500.0))
    assert got == want


def test_tournament_again_makes_no_call(spark, tmp_path):
    reg = arena.Registry()
    for n in "abc":
        reg.player(n, arena.from_texts(lambda texts, n=n: [f"{n}{t}" for t in texts]))
    reg.judge("coin", arena.coin(3), "v1")
    prompts = [f"q{i}" for i in range(40)]
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    for group, some in (("few", prompts[:4]), ("many", prompts)):
        spark.sparkContext.setJobGroup(group, group)
        rows = tournament.tournament(spark, reg, some, folder=f"file://{tmp_path}/{group}").orderBy("seq").collect()
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs[1] <= 2 * jobs[0]

    def broken(texts):
        raise AssertionError("asked again")

    for n in "abc":
        reg.players[n] = (arena.from_texts(broken), "")
    reg.judges["coin"] = (lambda p, a, b: F.struct(F.raise_error(F.lit("judged again")).cast("string").alias("winner"), F.lit("").alias("reason")), "v1")
    again = tournament.tournament(spark, reg, prompts, folder=f"file://{tmp_path}/many").orderBy("seq").collect()
    assert again == rows and len(rows) == 120


def test_cache_of_two_writers_and_of_one_that_is_lost(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    one, two = Cache(spark, path, "v string"), Cache(spark, path, "v string")
    df = lambda rows: spark.createDataFrame(rows, "key string, v string")
    held = lambda c: {r.key: r.v for r in c.read().collect()}
    assert held(one) == {}
    # Both have looked before either has written.
    first, second = one._write(df([("a", "1"), ("b", "1")])), two._write(df([("b", "2"), ("c", "2")]))
    one._commit({"table": first})
    two._commit({"table": second})
    assert held(one) == held(two) == {"a": "1", "b": "1", "c": "2"}
    # A table that was never named, and a number that was taken by a writer who is lost.
    two._write(df([("z", "9")]))
    (tmp_path / "c/commits/000000000002").touch()
    one.put(df([("a", "7"), ("d", "4"), ("d", "3"), (None, "x")]))
    assert held(one) == {"a": "1", "b": "1", "c": "2", "d": "3"}
    calls = []

    def call(missing):
        calls.append(sorted(r.key for r in missing.collect()))
        return missing.withColumn("v", F.concat("key", F.lit("!")))

    wanted = spark.createDataFrame([("a", 1), ("e", 2), ("e", 3), (None, 4)], "key string, n int")
    for _ in range(2):
        got = sorted((r.n, r.key, r.v) for r in two.through(wanted, call).collect())
        assert got == [(1, "a", "1"), (2, "e", "e!"), (3, "e", "e!"), (4, None, None)]
    assert calls == [["e"], []]
    before = held(one)
    one.compact()
    assert held(two) == before and len(one._commits()) == 1
    two.put(df([("f", "6"), ("a", "0")]))
    one.compact()
    one.compact()
    assert held(one) == before | {"f": "6"} and {r.key for r in one.read(df([("f", "")])).collect()} == {"f"}


def test_caches(spark):
    logged = spark.createDataFrame([(1, "k", "old"), (2, "k", "new"), (3, "m", "x")], "seq long, key string, value string")
    assert {r.key: r.value for r in arena.last_write(logged).collect()} == {"k": "new", "m": "x"}
    wanted = spark.createDataFrame([("k",), ("z",), ("z",)], "key string")
    assert [r.key for r in arena.misses(wanted, logged).collect()] == ["z"]
    assert one(spark, arena.cache_key(F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a\0b\0").hexdigest()


# --- metrics


def test_schedule(spark):
    rate = lambda i: one(spark, metrics.learning_rate(F.lit(i), 1.0, 0.1, 10, 110))
    assert rate(0) == pytest.approx(1 / 11) and rate(10) == pytest.approx(1.0) and rate(60) == pytest.approx(0.55) and rate(111) == 0.1
    assert metrics.horizon(1, 8000, 4, 16) == 125 and metrics.horizon(0, 10, 4, 16) == 1 and metrics.horizon(9, 8000, 4, 16, most=200) == 200


def test_draws_and_their_end(spark):
    p = F.array(*[F.lit(x) for x in (0.0, 0.2, 0.0, 0.5, 0.3, 0.0)])
    n = {r.place: r["count"] for r in spark.range(20_000).select(metrics.draw(p, F.col("id"), 3).alias("place")).groupBy("place").count().collect()}
    assert set(n) == {1, 3, 4} and all(abs(n[i] - 20_000 * x) < 400 for i, x in ((1, 0.2), (3, 0.5), (4, 0.3)))
    assert one(spark, metrics.draw(F.array(F.lit(0.0), F.lit(1e-9), F.lit(0.0)), F.lit(1), 3)) == 1 and one(spark, metrics.draw(F.array().cast("array<double>"), F.lit(1), 3)) is None
    ids = lambda *x: F.array(*map(F.lit, x))
    assert [one(spark, metrics.until_end(ids(*x), 0)) for x in ((1, 2, 0, 3), (0, 1), (4, 5))] == [[1, 2], [], [4, 5]]
    assert one(spark, metrics.horizons(2.0, F.lit(40), 4, 2)) == metrics.horizon(2.0, 40, 4, 2) == 10 and one(spark, metrics.horizons(1.0, F.lit(20), 4, 2)) == metrics.horizon(1.0, 20, 4, 2) == 2


def test_top_k_keeps_ties(spark):
    p = one(spark, metrics.top_k_softmax(F.array(*map(F.lit, (1.0, 3.0, 3.0, 2.0))), 1))
    assert p == pytest.approx([0, 0.5, 0.5, 0])


def test_perplexity(spark):
    r = metrics.perplexity(spark.createDataFrame([(1.0, 3), (2.0, 1)], "l double, n long"), "l", "n").first()
    assert r.perplexity == pytest.approx(math.exp(1.25))


def test_mean_loss(spark):
    rows = spark.createDataFrame([("train", 1.0), ("train", 2.0), ("val", 4.0), ("val", None)], "split string, loss double")
    assert {r.split: (r.n, r.loss) for r in metrics.mean_loss(rows, "loss").collect()} == {"train": (2, 1.5), "val": (1, 4.0)}


def test_long_conversations_have_their_window_in_little_time(spark):
    import time

    turns = F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda i: F.struct(F.when(i % 2 == 1, "user").otherwise("bot").alias("role"), F.concat(F.lit("say "), i.cast("string")).alias("text")))
    start = time.time()
    got = spark.range(1).select(chat.prompt_window(turns, letters, 0, 1000, 8).alias("w")).first().w
    assert time.time() - start < 30
    conv = [("user" if i % 2 else "bot", f"say {i}") for i in range(1, 10_001)]
    assert got == reference_window(conv[-200:], 992, 0)


# --- tokens


@pytest.fixture(scope="module")
def small(spark):
    texts = ["the old harbour pilot wrote", "every tide and every wind", "café 😀 isn't it  \n\n ok", ""] * 5
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_merges_and_ids_match_the_library(spark, small, tmp_path):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    lib = Tokenizer(models.BPE())
    lib.pre_tokenizer, lib.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    lib.train_from_iterator([r.text for r in small.collect()], trainers.BpeTrainer(vocab_size=300, special_tokens=["<|endoftext|>"], initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    own = tokens.train(small, 300)
    tokens.save(spark, own, str(tmp_path / "t.json"))
    again = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert own["vocab"] == lib.get_vocab()
    rows = tokens.decode(tokens.encode(small, own, end=False), own).collect()
    for r in rows:
        assert r.ids == lib.encode(r.text).ids == again.encode(r.text).ids and r.decoded == r.text
    ended = {r.doc_id: r.ids for r in tokens.encode(small, own).collect()}
    assert ended[3] == [] and all(x[-1] == 0 and x.count(0) == 1 for i, x in ended.items() if i % 4 != 3)
    assert len(tokens.ranks(own)) == 299
    with pytest.raises(ValueError):
        tokens.check_vocabulary({"vocab": {}})


@pytest.mark.parametrize("size", [262, 300, 900])
def test_merges_of_runs_match_the_library(spark, sf, size):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    texts = ["aaaaaaa aaa aa a", "abababab babab", "aabaabaab aab", "xyxyxxyy" * 3, "ééé é", "=====", "1111 111 11"] * 3
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    lib = Tokenizer(models.BPE())
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    lib.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=size, special_tokens=["<|endoftext|>"], initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    own = tokens.train(spark.createDataFrame([(t,) for t in texts], "text string"), size)
    assert own["vocab"] == lib.get_vocab() and own["merges"] == [list(m) for m in json.loads(lib.to_str())["model"]["merges"]]
    assert tokens.train(spark.createDataFrame([], "text string"), 300)["merges"] == []


@pytest.mark.parametrize("tasks", [1, 2, 5])
def test_merges_of_several_tasks(spark, sf, tasks):
    """Each merge found by counting all pairs anew, and the same by words dealt to tasks."""
    texts = ["aaaaaaa aaa aa a", "abababab babab", "aabaabaab aab", "xyxyxxyy" * 3, "ab abc abcd bcd cd", "1111 111 11"] * 3 + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()]
    counted = tokens.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    names = ["<|endoftext|>", *sorted(tokens.byte_letters())]
    words = [[[names.index(tokens.byte_letters()[b]) for b in r.word.encode()], r["count"]] for r in counted.collect()]
    want = []
    while len(names) < 420:
        pairs = {}
        for ids, n in words:
            for p in zip(ids, ids[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + n
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        want.append((names[a], names[b]))
        if names[a] + names[b] not in names:
            names.append(names[a] + names[b])
        new = names.index(names[a] + names[b])
        for w in words:
            ids, i = w[0], 0
            while i < len(ids) - 1:
                if ids[i] == a and ids[i + 1] == b:
                    ids[i : i + 2] = [new]
                i += 1
    assert tokens.merges(counted, 420, tasks=tasks) == want


def test_long_words_are_encoded_in_little_time(spark):
    import random
    import time

    rng = random.Random(4)
    own = tokens.train(spark.createDataFrame([("the tide and the wind " * 3 + "nineteen inns in the inner hand",)], "text string"), 290)
    ranks = {tuple(m): i for i, m in enumerate(own["merges"])}
    encoder = tokens._Encoder(own)
    for _ in range(500):
        word = "".join(rng.choices("theindaw ", k=rng.randint(0, 120)))
        parts = [tokens.byte_letters()[b] for b in word.encode()]
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert encoder.merged([encoder.of_byte[b] for b in word.encode()]) == [own["vocab"][p] for p in parts]
    start = time.time()
    long = "".join(rng.choices("thein", k=1_000_000))
    row = tokens.encode(spark.createDataFrame([(long,), (None,)], "text string"), own, end=False).orderBy(F.col("text").isNull()).collect()
    assert time.time() - start < 30 and row[1].ids == []
    back = {i: t for t, i in own["vocab"].items()}
    assert "".join(back[i] for i in row[0].ids) == long


def test_a_full_memory_loses_its_older_half(spark, small, monkeypatch):
    import pyarrow as pa

    own = tokens.train(small, 300)
    want = {r.doc_id: r.ids for r in tokens.encode(small, own).collect()}
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    encoder = tokens._Encoder(own)
    rows = small.select("doc_id", tokens.split_words(F.col("text")).alias("w")).orderBy("doc_id").collect()
    for r in rows:
        assert encoder.rows(pa.array([r.w, None, []], pa.list_(pa.string())), 0).to_pylist() == [want[r.doc_id], [], []]
    assert len(encoder.known) < 20 and len(encoder.first) == len(encoder.known) + 1


def test_rare_words_count_as_well(spark):
    # More distinct words than the cap that train once had, and a rare one that holds the most frequent pair.
    often = spark.range(2_000_001).select(F.repeat(F.concat(F.lit(" "), F.col("id").cast("string")), 2).alias("text"))
    rare = spark.createDataFrame([("zy" * 3_000_000,)], "text string")
    assert tokens.train(often.unionByName(rare), 258)["merges"] == [["z", "y"]]


def test_windows_of_equal_rows_and_few_ids(spark):
    rows = [(1, [1, 2, 3])] * 7 + [(2, [4] * 40)] * 3 + [(None, [9, 8])] * 2 + [(2, []), (5, list(range(100, 20_000)))]
    flat = [9, 8] * 2 + [1, 2, 3] * 7 + [4] * 120 + list(range(100, 20_000))
    for block in (4, 30, 5000):
        for r in tokens.windows(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(5), "doc_id", block, 40).collect():
            assert r.x == flat[r.start : r.start + block] and r.y == flat[r.start + 1 : r.start + 1 + block]
    plan = tokens.windows(spark.createDataFrame(rows, "doc_id long, ids array<int>"), "doc_id", 4, 9)._jdf.queryExecution().executedPlan().toString()
    # Ids are cut where they are joined: no exchange carries them but that of the parts.
    assert not [line for line in plan.splitlines() if "Exchange" in line and "ids#" in line]


def test_windows(spark):
    rows = [(i, list(range(sum(range(i)) + 0, sum(range(i + 1))))) for i in range(60)]
    flat = [x for _, ids in rows for x in ids]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(4)
    got = tokens.windows(df, "doc_id", 16, 50).collect()
    assert len(got) == 50
    for r in got:
        assert r.x == flat[r.start : r.start + 16] and r.y == flat[r.start + 1 : r.start + 17] and r.start < len(flat) - 17
    with pytest.raises(ValueError):
        tokens.windows(df.limit(0), "doc_id", 16, 5)


# --- sources, sinks, streaming


def test_prompts(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text('{"id":"1","category":"c","prompt":"a","gold":"g"}\n\n# note\n"bare"\n{"prompt":"b","gold":""}\n')
    assert [(r.prompt, r.gold) for r in text.prompts(spark, str(p)).orderBy("seq").collect()] == [("a", "g"), ("bare", None), ("b", "")]
    assert [r.prompt for r in text.gold_prompts(spark, str(p)).collect()] == ["a"]


def test_registry_and_build(spark, tmp_path, small):
    reg = registry.Sources(spark, str(tmp_path))
    calls = []

    def build(s):
        calls.append(1)
        return corpus.exact_split(small.select(F.col("doc_id").alias("key"), "text"), "key", 4)

    reg.add("one", build, "here")
    assert not reg.cached("one")
    assert reg.materialize("one").count() == 20 and reg.materialize("one").count() == 20 and len(calls) == 1
    assert reg.manifest("one")["rows"] == {"train": 16, "validation": 4}
    with pytest.raises(KeyError):
        reg.materialize("two")
    (tmp_path / "r.json").write_text(json.dumps({"name": "d", "sources": [{"name": "one"}], "vocab_size": 280}))
    meta = reg.build(registry.read_recipe(spark, str(tmp_path / "r.json")), str(tmp_path / "out"))
    assert meta["sources"][0]["row_share"] == 1.0 and meta["vocab_size"] == 280 and meta["train_tokens"] > 0
    with pytest.raises(FileNotFoundError):
        registry.read_recipe(spark, str(tmp_path / "none.json"))


def test_shards(spark, tmp_path):
    assert registry.shards_for(1, 116_000, 43) == [0, 21, 42]
    assert registry.shards_for(5_000_000, 116_000, 43) == list(range(43))
    for n in range(0, 5_000_000, 70_001):
        k = math.ceil(n / 116_000) + 2
        assert registry.shards_for(n, 116_000, 43) == (list(range(43)) if k >= 43 else sorted({round(i * 42 / (k - 1)) for i in range(k)}))
    for i in range(10):
        spark.range(i * 100, i * 100 + 100).selectExpr("id", "'x' AS text").coalesce(1).write.parquet(f"{tmp_path}/raw/{i}")
    import shutil
    from pathlib import Path

    (tmp_path / "all" / "en").mkdir(parents=True)
    for i in range(10):
        shutil.copy(next(Path(f"{tmp_path}/raw/{i}").glob("*.parquet")), f"{tmp_path}/all/en/train-{i:05d}.parquet")
    got = {r.id // 100 for r in registry.shard_scan(spark, f"{tmp_path}/all/en", 150, 100, columns=("id",)).collect()}
    assert got == {0, 3, 6, 9}
    assert registry.named_config(f"{tmp_path}/all", "en", "train")(spark).columns == ["text"]
    assert registry.named_config(f"{tmp_path}/all", "en", "train-00003", ("id",))(spark).count() == 100


def test_token_file(spark, tmp_path):
    ids = [1, 2, 65535, 0, 513]
    row = sinks.token_bytes(spark.createDataFrame([(ids,), (None,), ([],)], "ids array<int>")).collect()
    (tmp_path / "t.bin").write_bytes(row[0].bytes)
    assert row[1].bytes is None and row[2].bytes == b""
    back = text.token_file(spark, str(tmp_path / "t.bin"), 2).orderBy("block").collect()
    assert [x for r in back for x in r.ids] == ids and [len(r.ids) for r in back] == [2, 2, 1]
    with pytest.raises(Exception, match="65535"):
        sinks.token_bytes(spark.createDataFrame([([65536],)], "ids array<int>")).collect()
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        text.token_file(spark, str(tmp_path / "odd.bin"))


@pytest.mark.parametrize("file_ids", [1 << 30, 5000])
def test_token_files(spark, tmp_path, file_ids):
    rows = [(i, [(i * 7 + j) % 65536 for j in range(i % 50)]) for i in range(1000)]
    flat = [x for _, ids in rows for x in ids]
    df = spark.createDataFrame(rows, "key long, ids array<int>").repartition(6)
    written = sinks.token_files(df, "key", str(tmp_path / "out"), file_ids=file_ids)
    assert sum(n for _, n in written) == len(flat) and (len(written) == 1) == (file_ids > len(flat))
    import numpy as np

    assert np.concatenate([np.fromfile(f, "<u2") for f, _ in written]).tolist() == flat
    back = text.token_file(spark, str(tmp_path / "out"), 64, task_bytes=1000).orderBy("file", "block").collect()
    assert [x for r in back for x in r.ids] == flat
    windows = tokens.windows(spark.createDataFrame([(i, r.ids) for i, r in enumerate(back)], "key long, ids array<int>"), "key", 16, 20).collect()
    assert all(r.x == flat[r.start : r.start + 16] for r in windows)


def test_token_source_commits_or_leaves_nothing(spark, tmp_path):
    from tidewright.sources.token_source import TokenIds

    spark.dataSource.register(TokenIds)
    path = str(tmp_path / "a folder")
    rows = [(i, [(i * 31 + j) % 65536 for j in range(i % 9)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "key long, ids array<int>")
    ordered = df.repartitionByRange(4, "key").sortWithinPartitions("key")
    ordered.write.format("token_ids").mode("append").save(path)
    flat = [x for _, ids in rows for x in ids]
    read = lambda **o: [x for r in spark.read.format("token_ids").options(**o).load(path).orderBy("file", "block").collect() for x in r.ids]
    assert read() == read(block=100, task_bytes=900) == flat
    names = sorted(p.name for p in (tmp_path / "a folder").iterdir())
    bad = df.withColumn("ids", F.when(F.col("key") == 1999, F.array(F.lit(65536))).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="65535"):
        bad.repartition(3).write.format("token_ids").mode("append").save(path)
    assert read() == flat and [p for p in names if p[0] != "_"] == sorted(p.name for p in (tmp_path / "a folder").iterdir() if p.name[0] != "_")
    df.limit(0).write.format("token_ids").mode("append").save(path)
    ordered.select("ids").write.format("token_ids").mode("append").save(path)
    assert read() == flat + flat
    ordered.limit(3).coalesce(1).write.format("token_ids").mode("overwrite").save(path)
    assert read() == [x for _, ids in rows[:3] for x in ids]


def test_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    plan = text.lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "value" in line]


def test_files_of_any_length_have_a_digest(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"x" * 1000)
    (tmp_path / "empty").write_bytes(b"")
    with open(tmp_path / "long", "wb") as f:
        f.truncate((2 << 30) + 5)
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in text.file_digests(spark, str(tmp_path)).collect()}
    long = hashlib.sha256()
    for _ in range(512):
        long.update(bytes(4 << 20))
    long.update(bytes(5))
    assert got == {"small": hashlib.sha256(b"x" * 1000).hexdigest(), "empty": hashlib.sha256(b"").hexdigest(), "long": long.hexdigest()}


def test_fetching_goes_on_where_it_stopped(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Lock, Thread

    asked, now, most, lock, down = [], [0], [0], Lock(), {"/7"}

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            import time

            with lock:
                asked.append(self.path)
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.02)
            book = f"*** START OF THE PROJECT GUTENBERG EBOOK X ***\n\nA page of book {self.path} that is long enough\n\n*** END OF THE PROJECT GUTENBERG EBOOK X ***"
            with lock:
                now[0] -= 1
            self.send_response(503 if self.path in down else 200)
            self.end_headers()
            self.wfile.write(book.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    base, folder = f"http://127.0.0.1:{server.server_port}", f"file://{tmp_path}/kept"
    table = lambda ns: spark.createDataFrame([(f"{base}/{n}",) for n in ns], "url string")
    first = text.fetch_all(spark, table(range(10)), folder, batch=4, tries=1).collect()
    assert sum(r.text is None for r in first) == 1 and len(asked) == 10 and most[0] <= 2
    down.clear()
    again = text.fetch_all(spark, table([*range(12), 3]), folder, tries=1).collect()
    assert all(r.text for r in again) and len(again) == 12 and sorted(asked[10:]) == ["/10", "/11", "/7"]
    rows = text.fetched_books(spark, [1, 2], base + "/{}", folder, min_chars=10).collect()
    assert sorted(r.text for r in rows) == [f"A page of book /{n} that is long enough" for n in (1, 2)] and len(asked) == 13
    server.shutdown()


def plain_rewrite(text, phrases, endings):
    import re

    out, at = "", 0
    while at < len(text):
        m = re.match(r"[A-Za-z']+", text[at:])
        if not m:
            out, at = out + text[at], at + 1
            continue
        fits = [p for p in phrases if text[at : at + len(p)].lower() == p and not re.match(r"[A-Za-z']", text[at + len(p) :])]
        if fits:
            p = max(fits, key=len)
            found, other = text[at : at + len(p)], phrases[p]
            letters = re.sub("[^A-Za-z]", "", found)
            out += other.upper() if len(letters) > 1 and letters == letters.upper() else other[0].upper() + other[1:] if "A" <= found[0] <= "Z" else other
            at += len(p)
            continue
        word = m.group()
        for e, o in endings:
            if word.lower().endswith(e) and len(word) > len(e):
                word = word[: -len(e)] + (o.upper() if word == word.upper() else o)
                break
        out, at = out + word, at + len(m.group())
    return out


def test_phrases_are_rewritten_as_by_hand(spark):
    import random

    from tidewright.operators.rewrite import rewrite

    rng = random.Random(6)
    words = ["the", "sea", "old", "my", "friend", "it's", "going", "o'", "wind", "a"]
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 4))): f"r{i} x" for i in range(60)}
    endings = (("ing", "in'"), ("d", "t"))
    case = lambda w: rng.choice([w, w, w.upper(), w.capitalize()])
    texts = ["".join(case(rng.choice([*words, "singing", "é"])) + rng.choice([" ", " ", " ", "  ", ", ", "\n", "-"]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([*phrases.items(), (None, "x"), ("y", None)], "phrase string, replacement string")
    want = {i: None if t is None else plain_rewrite(t, phrases, endings) for i, t in enumerate(texts)}
    for sent in (1000, 5):
        assert {r.id: r.text for r in rewrite(df, "text", table, endings, sent).collect()} == want


def test_a_long_dictionary_takes_one_pass(spark):
    from tidewright.operators.rewrite import rewrite

    table = spark.range(100_000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.when(F.col("id") % 2 == 0, F.lit(" end")).otherwise(F.lit(""))).alias("phrase"), F.col("id").cast("string").alias("replacement"))
    name = lambda i: "w" + "".join("abcdefghij"[int(c)] for c in str(i))
    df = spark.createDataFrame([(" ".join(f"{name(i)} end" for i in range(k, 100_000, 1000)),) for k in range(20)], "text string")
    want = sorted(" ".join(str(i) if i % 2 == 0 else f"{i} end" for i in range(k, 100_000, 1000)) for k in range(20))
    assert sorted(r.text for r in rewrite(df, "text", table).collect()) == want
    convs = spark.createDataFrame([(1, [("user", "wb wb"), ("bot", "wb Wb"), ("user", "x")])], "conv_id long, turns array<struct<role:string,text:string>>")
    assert [tuple(t) for t in chat.rewrite_bot(convs, table).first().turns] == [("user", "wb wb"), ("bot", "1 1"), ("user", "x")]


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" + ("\n" if i % 3 else "") for i in range(500)))
    want = [x for name in "ab" for x in (tmp_path / f"{name}.txt").read_text().splitlines()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted((r.seq, r.value) for r in text.lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(want))


def test_appended_logs_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "log")
    for rows in (ROWS[:2], ROWS[2:3], ROWS[3:]):
        sinks.append_log(log(spark, rows).repartition(3), path)
    got = text.matches(spark, path)
    assert sorted((r.seq, r.model_a, r.winner) for r in got.collect()) == [(i, r[0], r[4]) for i, r in enumerate(ROWS)]
    assert {r.model: r.rating for r in arena.ratings(got).collect()} == pytest.approx(replay(ROWS))


def test_memo_and_gallery(spark, tmp_path):
    (tmp_path / "memo.jsonl").write_text('{"key": "a", "response": "1"}\n# note\n{"key": "b", "response": "2"}\n\n{"key": "a", "response": "3"}\n{"response": "4"}\n')
    assert {r.key: r.response for r in text.memo(spark, str(tmp_path / "memo.jsonl"), "response string").collect()} == {"a": "3", "b": "2"}
    prompts = spark.createDataFrame([(1, "the sea"), (2, "a")], "seq long, prompt string")
    made = sinks.completions(prompts, lambda p: F.concat(p, F.lit(" again")), lambda c: F.split(c, " "))
    assert [tuple(r) for r in made.orderBy("seq").collect()] == [(1, "the sea", "the sea again", 2, 3), (2, "a", "a again", 1, 2)]
    assert "the sea again" in sinks.gallery(made, "Samples").first()[0]


def test_small_files(spark, tmp_path):
    path = sinks.metrics_row(spark, str(tmp_path), "2025-01-02", "m", {"perplexity": {"loss": 1.5}, "n": 2})
    assert path.endswith("/2025-01-02/m/metrics.json") and json.loads((tmp_path / "2025-01-02/m/metrics.json").read_text()) == {"perplexity": {"loss": 1.5}, "n": 2}
    samples = spark.createDataFrame([(1, "a", "x", 3, 4)], "seq long, prompt string, completion string, n_in long, n_out long")
    sinks.write_gallery(samples, "T", str(tmp_path / "g.md"))
    assert (tmp_path / "g.md").read_text().startswith("# T\n\n## a\n\nx")


def test_shared_folders(spark):
    from tidewright import storage

    folder = storage.shared_folder(spark)
    storage.put_text(spark, f"{folder}/x", "é")
    assert storage.exists(spark, f"{folder}/x") and [n for _, n in storage.files(spark, folder)] == [2]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "k", "v"), (2, "k", "w")], "seq long, key string, value string")
    sinks.put_new(rows, str(tmp_path / "cache"))
    sinks.put_new(spark.createDataFrame([(3, "k", "x"), (4, "m", "y")], "seq long, key string, value string"), str(tmp_path / "cache"))
    assert sorted(r.key for r in spark.read.json(str(tmp_path / "cache")).collect()) == ["k", "m"]
    sinks.csv(rows, ["key", "value"], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["key", "value"]
    samples = spark.createDataFrame([(2, "b", "y", 1, 2), (1, "a", "x", 3, 4)], "seq long, prompt string, completion string, n_in long, n_out long")
    assert sinks.gallery(samples, "T").first().markdown.startswith("# T\n\n## a\n\nx\n\n_3 in, 4 out_\n")


def test_resumable_scan(spark, tmp_path, small):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    small.repartition(3).write.parquet(src)
    keep = F.col("text").rlike("(?i)tide")
    args = (spark, src, small.schema, keep, out, state)
    first = scan.resumable_filter(*args).count()
    small.limit(8).write.mode("append").parquet(src)
    again = sorted(map(tuple, scan.resumable_filter(*args).collect()))
    assert first == 5 and again == sorted(map(tuple, spark.read.parquet(src).where(keep).collect()))
    assert scan.resumable_filter(*args).count() == len(again)
    scan.restart(spark, out, state)
    assert scan.resumable_filter(*args).count() == len(again)


# --- compositions


def test_examples_and_batches(spark):
    rows = [(i, [("user", f"q{i}"), ("bot", f"hello {i}")]) for i in range(60)] + [(99, [("user", "a"), ("user", "b")])]
    convs = spark.createDataFrame(rows, f"conv_id long, turns {TURNS}")
    built = chat.examples(convs, letters, 0, 24, rewrite=corpus.dialect).cache()
    assert built.count() == 60 and built.where("split = 'validation'").count() == 1
    s = chat.summary(convs, built).first()
    assert (s.n, s.skipped) == (60, 1) and s.truncated_share == s.truncated / 60
    got = chat.batches(built.where("split = 'train'"), 3, 4).collect()
    assert len(got) == 12 and all(len(r.x) == len(r.y) == 23 for r in got)
    assert sorted((r.batch, r.place) for r in got) == [(b, p) for b in range(3) for p in range(4)]


def test_calibrate_and_export(spark, tmp_path):
    reg = arena.Registry()
    reg.player("echo", arena.echo)
    reg.judge("first", lambda p, a, b: F.struct(F.when(a == p, "B").otherwise("A").alias("winner"), F.lit("").alias("reason")), "v1")
    prompts = spark.createDataFrame([("c", "p", "gold"), ("c", "q", None)], "category string, prompt string, gold string")
    row = arena.calibrate(prompts, reg).first()
    assert (row.n, row.agree, row.miss_rate) == (1, 1, 0.0)
    paths = arena.export_all(log(spark, ROWS), str(tmp_path), n_boot=2)
    assert spark.read.option("header", True).csv(paths["matches"]).count() == 5
    assert spark.read.option("header", True).csv(paths["head_to_head"]).columns == ["row_model", "a", "b", "c"]
    out = arena.export_calibration(arena.calibrate(prompts, reg), str(tmp_path / "cal"))
    assert spark.read.json(out["json"]).first().agree == 1 and spark.read.option("header", True).csv(out["csv"]).columns[-1] == "miss_rate"


def test_books_and_peek(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.txt").write_text("*** START OF THE PROJECT GUTENBERG EBOOK X ***\n" + "\n\n".join(f"paragraph {i} {j} " * 20 for j in range(5)) + "\n*** END OF THE PROJECT GUTENBERG EBOOK X ***")
    rows = text.books(spark, str(tmp_path))
    assert rows.count() == 10 and rows.select("key").distinct().count() == 10
    assert corpus.peek(rows, "key", 3).collect() == corpus.peek(rows.repartition(4), "key", 3).collect()


def test_config(tmp_path):
    from tidewright import config

    (tmp_path / "a.py").write_text("from tidewright.config import Config\nconfig = Config(dataset='x')\n")
    (tmp_path / "b.py").write_text("from tidewright.config import Config\ndef make_config():\n    return Config(block_size=7)\n")
    (tmp_path / "c.py").write_text("x = 1\n")
    assert config.load(str(tmp_path / "a.py")).dataset == "x" and config.load(str(tmp_path / "b.py")).block_size == 7
    with pytest.raises(AttributeError):
        config.load(str(tmp_path / "c.py"))


def test_vocabulary_size():
    assert tokens.vocabulary_size({"vocab": {"a": 0}}, 9) == 1 and tokens.vocabulary_size(None, 9) == 9


def test_code_reaches_executors(spark):
    from tidewright import ship

    ship.to_executors(spark)
    ship.to_executors(spark)
    assert spark.sparkContext.applicationId in ship._SENT
