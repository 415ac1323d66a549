"""Vector codes, the filter audit and token-id files against plain Python, on small fixtures with hard cases and on driver tables."""

import hashlib
import math
import os
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import audit, codes, fingerprint, html, idfiles, queries


def tables(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit"])
def test_against_sql(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    cursor = tables(sf).execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())


# --- vector codes


def brute_codes(rows):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = max(Counter(len(v) for _, v, _ in kept).items(), key=lambda x: (x[1], x[0]))[0]
    kept = sorted((x for x in kept if len(x[1]) == width), key=lambda x: (x[0] is None, x[0] or 0, np.array(x[1], "<f8").tobytes()))
    size = -(-width // 8)
    whole = [[math.floor(Fraction(x) * 4096) for x in v] + [0] * (8 * size - width) for _, v, _ in kept]
    parts = [[w[p * size : (p + 1) * size] for w in whole] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    code, error, flat = [""] * len(kept), [0] * len(kept), []
    for rows_of in parts:
        book = [list(x) for x in rows_of[:16]]
        for _ in range(6):
            own = [near(x, book)[1] for x in rows_of]
            for e in range(len(book)):
                mine = [x for x, k in zip(rows_of, own, strict=True) if k == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for i, x in enumerate(rows_of):
            d, e = near(x, book)
            code[i] += f"{e:02x}"
            error[i] += d
        flat += [str(c) for entry in book for c in entry]
    total = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        total[label] += e
    digest = hashlib.sha256(",".join(flat).encode()).hexdigest()
    return sorted(((i, c, e, total[label]) for (i, _, label), c, e in zip(kept, code, error, strict=True)), key=repr), digest


def coded(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, v long, error int")
    out, books = codes.compress(df)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.with_label_error(out).collect()), key=repr), codes.codebooks_digest(books)


def vectors(n, width, seed=5, scale=1.0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in rng.normal(size=width) * scale] for _ in range(n)]


def test_codes_by_brute_force(spark):
    v = vectors(90, 16)
    rows = [(i, x, i % 3 if i % 7 else None) for i, x in enumerate(v)]
    rows += [(200, None, 1), (201, [], 1), (202, [float("nan")] * 16, 1), (203, [float("-inf"), *v[0][1:]], 1), (204, [None, *v[0][1:]], 1), (205, [1.0, 2.0], 1), (None, v[3], None), (7, v[8], 1), (7, v[7], 1), (7, v[7], 1)]
    rows += [(300 + i, v[0], 0) for i in range(40)]
    got, digest = coded(spark, [(*r, "clash", 9, 9) for r in rows])
    want, wanted = brute_codes(rows)
    assert got == want and digest == wanted and len(got) == 134


@pytest.mark.parametrize(("n", "width", "scale"), [(5, 8, 1), (40, 13, 0.001), (30, 8, 1e5), (1, 3, 1)])
def test_codes_of_few_odd_and_large_vectors(spark, n, width, scale):
    rows = [(i, x, i % 2) for i, x in enumerate(vectors(n, width, 9, scale))]
    got, digest = coded(spark, [(*r, None, None, None) for r in rows])
    want, wanted = brute_codes(rows)
    assert got == want and digest == wanted


def test_codes_of_nothing(spark):
    got, digest = coded(spark, [])
    assert got == [] and digest == hashlib.sha256(b"").hexdigest()


def test_partial_distances_equal_whole_ones():
    rng = np.random.default_rng(1)
    for wide, kind in ((3, np.int64), (50, np.int64), (4, object)):
        x, book = rng.integers(-3, 4, (500, wide)).astype(kind), rng.integers(-3, 4, (16, wide)).astype(kind)
        book[5], book[9] = book[2], book[2]
        whole = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        index, best = codes.nearest(x, book)
        assert (index == np.array([min(range(16), key=lambda e: (r[e], e)) for r in whole])).all() and (best == whole.min(axis=1)).all()


# --- filter audit


def brute_audit(docs, labels):
    least, known = {}, {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        known[i] = tuple(max((a for a in ab if a is not None), default=None) for ab in zip(known.get(i, (None, None)), (q, x), strict=True))
    parts = {}
    for i, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        parts.setdefault(lang or "", []).append((bad, known.get(i, (None, None)) if i is not None else (None, None)))
    out = []
    for part, rows in parts.items():
        mine, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(gone)
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                mine.append(("".join(order), step, len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), only, sum(r[1][0] == 1 for r in gone), sum(r[1][1] == 1 for r in gone), f))
        out += [(part, *m[:-1], shapley[m[-1]]) for m in mine]
    return sorted(out)


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, lang string, mask int, part string")
    return sorted(tuple(r) for r in audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())


def test_audit_by_brute_force(spark):
    plain = " ".join(f"w{i}" for i in range(250))
    texts = [plain, plain, plain + " |", "A B C", None, "", "x " * 300, "É é", " \x0b\x0c\x1c  ", plain.upper(), "long " + "yZ" * 300_000, plain + "\x00", "café" * 210 + " # $"]
    docs = [(i, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate(texts * 3)]
    docs += [docs[0], docs[0], (None, plain, "en"), (None, plain, "en"), (3, "other text", "fr"), (-5, "", None)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(20)] + [(0, 1, None), (None, 1, 1), (999, 1, 1), (3, None, 1)]
    got = audited(spark, docs, labels)
    assert got == brute_audit(docs, labels) and len(got) == 4 * 600
    assert audited(spark, [], labels) == [] and len(audited(spark, docs[:1], [])) == 600


def test_audit_of_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


# --- token-id files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(idfiles.default_path())
    t.no_truncation()
    t.no_padding()
    return t


HARD = [
    None, "", " ", "the sea", "The SEA", "H̱ İ ẖ", "á̂ b ́c", "x<|startoftext|>y <|endoftext|> <|STARTOFTEXT|>", "\x01 a\x01b \x01\x01", "a\x1cb\x85c d e", "ΣΑΣ ΟΔΟΣ", "it's I'M 'TIS",
    "１２ ½ ² 3.14", "é" * 50, "Å Å K K ſ", "😀👍🏽 mixed\ttabs\x0bvt\x0cff\r\n", "안녕 한국 한", "zz" * 40_000, "a " * 5000, "̈́ क़ Ω", "ʼn Ǆ ﬁ İi ı", "\x00\x00 \x00",
]


def test_words_have_the_librarys_ids(library):
    import random

    rng = random.Random(3)
    letters = "aAbBzZhHiI01 .,'|<>é̱́̇ßΣσΩ½\x01\x1c\x85  한ᆫ\n\t\r😀"
    texts = [(t or "") for t in HARD] + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    encoder = idfiles.Encoder(idfiles.vocabulary(idfiles.default_path()))
    sizes, flat = encoder.encode([t.encode() for t in texts])
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert flat[a:b].tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], repr(t)


@pytest.mark.parametrize("ids", [[], [7], [1, 1], [5] * 1000, [5] * 1001, [1, 2] * 500, [1, 2, 3] * 333 + [2, 3], list(range(1000)), [1, 1, 2] * 300, [*range(40), *range(20)] * 30])
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.int32)
    terminals, rules, lengths, seq = idfiles.re_pair(ids)
    assert idfiles.expand(terminals, rules, lengths, seq).tolist() == ids.tolist()
    for k in range(len(rules)):
        assert len(idfiles.expand(terminals, rules, lengths, np.array([k + len(terminals)]))) == lengths[k] and rules[k].max() < k + len(terminals)


def test_grammar_of_random_ids():
    rng = np.random.default_rng(2)
    for n in (3, 50, 2000, 40_000):
        for letters in (2, 3, 10, 1000):
            ids = rng.integers(0, letters, n).astype(np.int32)
            terminals, rules, lengths, seq = idfiles.re_pair(ids)
            assert (idfiles.expand(terminals, rules, lengths, seq) == ids).all()
    repeats = np.tile(rng.integers(0, 9000, 500), 80)
    assert len(idfiles.re_pair(repeats)[3]) < len(repeats) / 50


def brute_files(library, docs):
    """Rows by doc_id, null first; of equal ids the texts may stand in any order, so they are compared as sets of (size, crc)."""
    rows = {}
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        rows.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    out, at = [], 0
    for i in sorted(rows, key=lambda i: (i is not None, i or 0)):
        out.append((i, at, sorted(rows[i])))
        at += sum(n for n, _ in rows[i])
    return out


@pytest.mark.parametrize("block", [16, 1000, idfiles.BLOCK])
def test_files_by_brute_force(spark, library, tmp_path, block):
    docs = [(i * 3 % 101 - 20, t) for i, t in enumerate(HARD * 2)] + [(None, "no id"), (None, None), (4, "again"), (4, "again"), (4, "another")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, ids string, start int").repartition(5)
    files = idfiles.write_tokens(df, f"file://{tmp_path}/ids", idfiles.default_path(), block=block).cache()
    got = {}
    for r in idfiles.read_tokens(files).collect():
        assert r.n_tokens * 4 == len(r.ids)
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, zlib.crc32(r.ids)))
    want = brute_files(library, docs)
    assert len(got) == len(want)
    for i, start, rows in want:
        mine = sorted(got[i])
        assert mine[0][0] == start and sorted(m[1:] for m in mine) == rows and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))
    # Any document, and any range, by itself.
    from pyarrow import fs

    for f in files.collect():
        with fs.LocalFileSystem().open_input_file(f.file.removeprefix("file://")) as data:
            r = idfiles.Reader(data)
            flat = r.ids(0, r.n_ids).tolist()
            assert len(flat) == f.n_ids == sum(r.sizes.tolist())
            for k in range(len(r.docs)):
                assert r.document(k).tolist() == flat[r.starts[k] : r.starts[k] + r.sizes[k]]
            for a, b in ((0, 0), (3, 4), (5, 40), (15, 17), (r.n_ids - 1, r.n_ids)):
                assert r.ids(a, b).tolist() == flat[a:b]


def test_files_of_nothing_and_of_half_a_file(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert idfiles.read_tokens(idfiles.write_tokens(empty, f"file://{tmp_path}/none", idfiles.default_path())).count() == 0
    from pyarrow import BufferReader

    with pytest.raises(ValueError, match="not a whole one"):
        idfiles.Reader(BufferReader(b"x" * 100))


def test_files_of_documents(spark, sf, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in idfiles.op13(spark, sf).collect())
    assert got == [(i, at, *rows[0]) for i, at, rows in brute_files(library, docs)]


def test_nothing_holds_all_rows_in_one_task(spark, sf):
    plan = audit.op12(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert audit.op12(spark, sf).agg(F.count("*")).first()[0] % 600 == 0


# --- main text: names in camel case and in one word, roles, unseen parts, and names that the text contradicts

LONG = "The harbour pilot wrote down every tide and wind he met on his way to the far islands and back again, and he read it to all who asked for it in winter when the ships lay still in the bay."
P = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    ("page", "word", "kept"),
    [
        (f"<article>{P}<div class='userComments'><p>SOME {LONG}</p></div></article>", "SOME", False),
        (f"<article>{P}{P}</article><ol class='commentlist'><li>SOME {LONG}</li></ol>", "SOME", False),
        (f"<div class='post'>{P}{P}</div><section id='discussion'><p>SOME {LONG}</p></section>", "SOME", False),
        (f"<div class='post'>{P}{P}</div><section class='responses'><p>SOME {LONG}</p></section>", "SOME", False),
        (f"<article>{P}<div class='adBox'><p>SOME {LONG}</p></div>{P}</article>", "SOME", False),
        (f"<div>{P}{P}</div><div class='siteFooter'><p>SOME {LONG}</p></div>", "SOME", False),
        (f"<div><p>SOME {LONG}</p></div><div role='main'>{P}{P}</div>", "SOME", False),
        (f"<article>{P}<p style='color:red; display:none'>SOME {LONG}</p></article>", "SOME", False),
        (f"<article>{P}<div class='menu'><a href='1'>SOME {LONG}</a></div>{P}</article>", "SOME", False),
        (f"<article><div class='social-history'><p>SOME {LONG}</p></div><p>END {LONG}</p></article>", "SOME", True),
        (f"<article><p>START {LONG}</p><section class='menu'><p>SOME {LONG}</p></section><p>END {LONG}</p></article>", "SOME", True),
        (f"<article><div id='search-and-rescue'><p>SOME {LONG}</p></div><p>END {LONG}</p></article>", "SOME", True),
        (f"<div role='main'><p>SOME {LONG}</p></div>", "SOME", True),
        (f"<article><p style='display:block'>SOME {LONG}</p></article>", "SOME", True),
    ],
)
def test_names_are_read_by_their_parts(page, word, kept):
    text = html.main_text(page)
    assert "harbour" in text and (word in text) == kept


# --- ranges of ids by bytes


def test_ranges_follow_bytes():
    cells = [(10, 5), (20, 5), (30, 100), (40, 1), (50, 2), (60, 3), (70, 4)]
    assert fingerprint.range_ends(cells, 10) == [20, 30, 70] and fingerprint.range_ends(cells, 1000) == [70] and fingerprint.range_ends([], 5) == []
    assert fingerprint.range_ends([(1, 0), (2, 0)], 0) == [2]


def test_long_texts_that_stand_together_are_parted(spark):
    rows = [(i, "x y " * (100_000 if 40 <= i < 80 else 10)) for i in range(400)]
    parts = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT last").groupBy("part").agg(F.sum(F.length("text")).alias("n"))
    sizes = [r.n for r in parts.collect()]
    assert len(sizes) >= 2 and max(sizes) <= 12 << 20
