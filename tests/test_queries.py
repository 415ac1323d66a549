"""Every query of the catalogue against its DuckDB SQL, and the ones without SQL by their columns and rows."""

import os

import duckdb
import pytest

from tidewright.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_leaderboard(spark, sf):
    rows = QUERIES["leaderboard"](spark, sf).collect()
    ratings = {r.model: r.rating for r in QUERIES["elo_replay"](spark, sf).collect()}
    counts = {r.model: r for r in QUERIES["wlt_counts"](spark, sf).collect()}
    assert [r.rating for r in rows] == sorted(ratings.values(), reverse=True)
    for r in rows:
        assert r.rating == ratings[r.model] and r.ci_low <= r.ci_high and r.wins == counts[r.model].wins and r.games == counts[r.model].games


def test_queries_take_the_operators_defaults(spark, sf, monkeypatch):
    from tidewright.operators import arena, tokens

    seen = []
    bootstrap = arena.bootstrap
    monkeypatch.setattr(arena, "bootstrap", lambda matches, n=200, *more: seen.append(n) or bootstrap(matches, n, *more))
    QUERIES["leaderboard"](spark, sf)
    QUERIES["bootstrap_ci"](spark, sf)
    assert seen == [200, 200]
    got = [(r.left, r.right) for r in QUERIES["bpe_merges"](spark, sf).orderBy("rank").collect()]
    own = tokens.train(spark.read.parquet(f"{sf}/documents.parquet"), 8192)
    assert len(got) > 255 and got == [tuple(m) for m in own["merges"]]


def test_combining_all_sources(spark, sf, tmp_path):
    import hashlib

    draw = lambda key: int(hashlib.md5(f"1337:{key}".encode()).hexdigest()[:12], 16)
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    few = [(r.doc_id, r.text, None if r.source == "src3" else r.source) for r in docs if r.source in ("src0", "src3", "src4", "src7")]
    spark.createDataFrame(few, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = {s: sorted((i for i, _, x in few if x == s), key=lambda i: (draw(i), i)) for s in ("src0", "src4", "src7", None)}
    got = {r.source: (r.n, r.chars) for r in QUERIES["combine_concat"](spark, str(tmp_path)).collect()}
    assert got == {s: (len(ids), sum(len(t) for _, t, x in few if x == s)) for s, ids in parts.items()}
    share = dict(zip(parts, (3 / 8, 1 / 8, 1 / 8, 3 / 8), strict=True))
    longest = max(len(ids) / share[s] for s, ids in parts.items())
    want = [(ids[k % len(ids)], s, (k + draw(f"{s}:{k}") / 2**48) / share[s]) for s, ids in parts.items() for k in range(round(longest * share[s]))]
    rows = sorted(((r.doc_id, r.source, r.output_order) for r in QUERIES["combine_interleave"](spark, str(tmp_path)).collect()), key=lambda r: r[2])
    want.sort(key=lambda r: r[2])
    assert [r[:2] for r in rows] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(rows, want, strict=True))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())


def test_plans_prune_and_push(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,source:string>" in plan(QUERIES["paragraphs_by_source"](spark, sf))
    # No window over all rows in one partition, and no join of everything with everything.
    for name in ("exact_split", "token_offsets", "combine_interleave", "cache_last_write", "head_to_head"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, sf))


def test_order_does_not_depend_on_partitions(spark, sf):
    from tidewright.operators import corpus

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    one, two = (sorted(map(tuple, corpus.exact_split(d, "doc_id", 30).collect())) for d in (docs, docs.repartition(7)))
    assert one == two and sum(s == "validation" for _, s in one) == 30
