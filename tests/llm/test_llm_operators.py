"""Each operator against a brute-force version, on small fixtures with hard cases and on driver tables."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.llm import bpe, fingerprint, html, minhash, mixing, private, quality, rules, substrings, toxicity
from tidewright.llm.common import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, at long, h long"
SPACE = "[\x20\x09-\x0d]+"
BASE = "the old harbour pilot wrote down every tide and every wind that he met on his way to the far islands and back again"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def fixture_rows():
    texts = [
        BASE * 3, BASE * 3, BASE * 3 + " once more", None, "", "  \n\t ", "one", "one", "one two three", "One TWO three",
        "a b c d", "a b c d e", "x " * 300, "café 😀 naïve text", "\x0b\x0c mixed\x0bspaces\x0cinside", BASE.upper(), "mail a.b@c.de, call +1 (415) 555-0100 or 10.0.0.1 now",
        "card 4111 1111 1111 1111 and iban DE89 3704 0044 0532 0130 00", "you are an idiot, a pathetic loser. trash!", "word " * 20 + BASE, "long " + "y" * 200_000, BASE + "\n" + BASE + "\n" + BASE,
    ]
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", len(t or ""), "k", i, i) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[6], (500, BASE + " island", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return sorted([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], key=lambda x: (x[0], x[1] or ""))


# --- near duplicates


def brute_components(rows, k, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(fold))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, hard, docs):
    for df, k in ((hard, 4), (hard, 5), (docs, 4)):
        got = minhash.near_duplicates(spark, df, k, 80).collect()
        want = brute_components(pairs(df), k, 80)
        assert len(got) == df.count()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_with_null_and_reused_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(2, one), (2, two), (5, one + " more"), (7, two + " more"), (None, three), (None, three + " x"), (9, None), (9, None), (None, "")]
    want = sorted([(2, 2, True), (2, 2, True), (5, 2, False), (7, 2, False), (None, None, None), (None, None, None), (9, 9, True), (9, 9, True), (None, None, True)], key=repr)
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = minhash.near_duplicates(spark, df, 4, 80).collect()
        assert sorted(((r.doc_id, r.component_id, None if r.doc_id is None and r.n_shingles else r.kept) for r in got), key=repr) == want
        assert sum(r.kept for r in got if r.doc_id is None and r.n_shingles) == 1


def test_near_duplicates_that_share_a_frequent_shingle(spark):
    # Texts around one common passage, no two of them alike, and a few that are.
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(i, common + " " + " ".join(f"w{i}x{j}" for j in range(8 + i % 5))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(0, 120, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, df, 4, 80).collect()}
    assert got == brute_components(rows, 4, 80)


def test_near_duplicates_of_nothing(spark, empty):
    assert minhash.near_duplicates(spark, empty).count() == 0


def test_signatures_estimate_similarity():
    a, b = [f"w{i}" for i in range(400)], [f"w{i}" for i in range(40, 440)]
    doc, h, n = minhash.shingles([" ".join(a).encode(), " ".join(b).encode()], 4)
    one, two = minhash.signatures(doc, h, 2)
    assert abs((one == two).mean() - 357 / 437) < 0.1


# --- substrings


def brute_substrings(rows, length):
    first, every = {}, {i: words(t) for i, t in rows}
    for i, w in every.items():
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in every.items():
        gone = set()
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < i:
                gone.update(range(j, j + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


def test_substrings(spark, hard, docs):
    for df in (hard, docs):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.repeated_passages(spark, df, 13).collect()}
        assert got == brute_substrings(pairs(df), 13)


def test_substrings_with_hot_keys(spark, docs, monkeypatch):
    # Every key that comes twice in the sample is hot, so both ways to find its ends are taken.
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "SAMPLED", 10_000)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.repeated_passages(spark, docs, 13).collect()}
    assert got == brute_substrings(pairs(docs), 13)


def test_substrings_of_rows_that_share_an_id(spark):
    pool = [f"w{i} v{i * 7 % 91}" for i in range(200)]
    one, two, three = (" ".join(pool[a : a + 40]) for a in (0, 50, 100))
    long = " ".join(f"only{i}" for i in range(500))
    rows = [(1, one), (2, two + " tail"), (None, one), (None, three), (None, long + " " + two), (None, "short"), (None, None), (5, one), (5, three + " more"), (5, "a b"), (5, long), (7, three)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, want = {}, []
    rank = lambda i: 2**63 if i is None else i
    grams = lambda w: [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
    for i, t in rows:
        for g in grams(words(t)):
            first[g] = min(first.get(g, rank(i)), rank(i))
    for i, t in rows:
        w = words(t)
        gone = {p for j, g in enumerate(grams(w)) if first[g] < rank(i) for p in range(j, j + 13)}
        want.append((rank(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(rank(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.repeated_passages(spark, df, 13).collect()]
    assert sorted(got) == sorted(want)


def test_substrings_of_nothing(spark, empty):
    assert substrings.repeated_passages(spark, empty).count() == 0


def test_words_are_split_like_the_contract():
    texts = [BASE, "", " a\x0bb\x0c c\t", "é x y"]
    w = Words([t.encode() for t in texts])
    got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[w.doc == i], w.end[w.doc == i], strict=True)] for i in range(4)]
    assert got == [words(t) for t in texts]


# --- personal data


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, re.A):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and luhn % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


HARD_TEXTS = [
    "a@b.c.@d.e a@b.c%d@e.f @x.y a@@b.c a@b a@b..c x@y.z-",
    "1.2.3.4.5.6.7.8 999.1.1.1 256.1.1.1 1.2.3 01.02.03.004 00255.1.1.1 1..2.3.4",
    "4111111111111111 4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111112 5 4111 1111 1111 1111 12",
    "+1 415 555 0100 +1(415)555-0100 ++12345678 +1 2 3 +12345678901234567 +1....2345678 é😀 +4930123456 end",
    "😀 mail é.x@y.de 😀 10.0.0.1 é" * 3,
    "1 " * 500 + "4111111111111111",
    "", None,
]


def test_base_spans(spark, docs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD_TEXTS)], "doc_id long, text string")
    for d in (df, docs):
        texts = {r.doc_id: r.text or "" for r in d.collect()}
        got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found if s.kind in private.BASE] for r in private.detect(d).collect()}
        assert got == {i: brute_spans(t) for i, t in texts.items()}


def test_checksums_and_context(spark):
    df = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 ok"), (2, "iban DE88 3704 0044 0532 0130 00 ok"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in private.detect(df).collect()}
    assert got == {1: [("iban", 5, 32)], 2: [], 3: [("ssn", 4, 15)], 4: []}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to é a@b.de, 10.0.0.1 and +1 (415) 555-0100."), (2, "nothing"), (3, None), (4, "a@10.0.0.1")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", private.redact(F.col("text")).alias("t")).collect()}
    assert got == {1: "to é <EMAIL>, <IP> and <PHONE>.", 2: "nothing", 3: None, 4: "<EMAIL>"}


def test_spans_of_long_texts_and_secrets(spark):
    import time

    text = " ".join(f"u{i}@m{i % 7}.example.com, 10.0.{i % 256}.{i % 251}" for i in range(25_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    start = time.time()
    got = [(s.kind, s.start, s.end) for s in private.detect(df).collect()[0].found]
    assert time.time() - start < 30 and len(got) == 50_000 and got == brute_spans(text)
    assert df.select(private.redact(F.col("text")).alias("t")).collect()[0].t == " ".join(["<EMAIL>, <IP>"] * 25_000)
    token = "0123456789abcdef0123456789abcdef01234567"
    rows = [(1, f'token = "{token}" end'), (2, f"commit {token} end"), (3, "token " + "a" * 40), (4, f"the password is{' ' * 60}{token}")]
    got = {r.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.found] for r in private.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("secret", 9, 49, 0.65)], 2: [], 3: [], 4: []}


def brute_redaction(text, found):
    out, at = [], 0
    for start, less, kind in sorted((s, -e, k) for k, s, e in found):
        if start >= at:
            out.append(text[at:start] + f"<{kind.upper()}>")
        at = max(at, -less)
    return "".join(out) + text[at:]


def test_redaction_against_brute_force(spark, docs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*HARD_TEXTS, "4111 1111 1111 111 1.2.3.4 and 1.2.3.4@b.cd é😀" * 300, "x" * 5000 + " a@b.de " + "é" * 3000])], "doc_id long, text string")
    for d in (df, docs):
        both = d.select("text", private.spans(F.col("text")).alias("found"), private.redact(F.col("text")).alias("t")).collect()
        assert all(r.t == (None if r.text is None else brute_redaction(r.text, [(s.kind, s.start, s.end) for s in r.found])) for r in both)


def test_op2_columns(spark, sf, docs):
    from tidewright.llm import queries

    rows = {r.doc_id: r for r in queries.queries()["op2_personal_data"](spark, sf).collect()}
    for i, t in pairs(docs):
        base = brute_spans(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in private.BASE)
        assert r.n_spans == len(r.scores) == len([x for x in r.spans.split(",") if x]) and r.spans.startswith(listed)


# --- quality rules


def brute_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    inside = {j for i, g in enumerate(windows) if often[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_rule_counts(spark, hard, docs):
    for df in (hard, docs):
        got = rules.judge(spark, df).collect()
        want = {i: brute_counts(t) for i, t in pairs(df)}
        assert len(got) == df.count()
        for r in got:
            n, chars, symbols, dup, rep = want[r.doc_id]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
            assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
            assert not (r.kept and r.base_failed)
            assert r.kept or r.base_failed or r.soft_failed


def test_bad_hosts_lose_soft_failures(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    odd = clean + " " + "### " * 0 + " ".join(f"$$${i}$$$" for i in range(30))
    rows = [(i, odd, "bad") for i in range(60)] + [(100 + i, clean, "bad") for i in range(5)] + [(200 + i, clean if i else odd, "good") for i in range(60)]
    got = {r.doc_id: r.kept for r in rules.judge(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(60)) and all(got[100 + i] for i in range(5)) and all(got[200 + i] for i in range(60))


def test_hosts_decide_by_rate_and_severity(spark):
    text = lambda n: " ".join(f"word{i}" + "#" * n for i in range(80))
    # 0.3 of each host's documents fail, so what is over 0.5 / 0.3 times a limit goes: 100 * n symbols in 100 words against 25.
    rows = [(100 * h + i, text(0 if i >= 30 else 1 if i < 15 else 3), f"host{h}") for h in range(3) for i in range(100)]
    got = {r.doc_id: r for r in rules.judge(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(r.severity == pytest.approx(0 if i % 100 >= 30 else 4 if i % 100 < 15 else 12) or r.severity < 1 for i, r in got.items())
    assert {i for i, r in got.items() if not r.kept} == {100 * h + i for h in range(3) for i in range(30)}
    mild = [(i, " ".join(f"word{j}" + ("#" if j < 24 else "") for j in range(80)) if i < 30 else text(0), "host") for i in range(100)]
    assert all(r.kept and r.soft_failed == (r.doc_id < 30) for r in rules.judge(spark, spark.createDataFrame(mild, "doc_id long, text string, source string")).collect())


def test_rules_keep_all_columns(spark, hard, empty):
    kept = rules.keep(spark, hard)
    assert kept.columns == hard.columns and kept.count() == rules.judge(spark, hard).where("kept").count()
    assert rules.judge(spark, empty).count() == 0


# --- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in free}
        for s in full:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    return target


def test_mix(spark, hard, docs):
    for df in (hard, docs):
        rows = mixing.mix(df).collect()
        sizes, taken, want = Counter(), Counter(), {i: len(words(t)) for i, t in pairs(df)}
        largest = Counter()
        for r in rows:
            assert r.size == want[r.doc_id] and 0 <= r.taken <= 3 * r.size
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        target = brute_targets(dict(sizes))
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
            # Rows with one id share a hash, so two of them may come together.
            assert abs(taken[r.source] - r.target) <= 2 * largest[r.source] / 2 + 1
        again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect()}
        assert again == {(r.doc_id, r.taken) for r in rows}


def test_targets_of_many_sources(spark, monkeypatch):
    from tidewright.llm.common import Store

    sizes = {f"host{i * 7919 % 1000}": (i * 31 % 97) ** 2 for i in range(500)} | {None: 40}
    monkeypatch.setattr(mixing, "RANGE", 60)
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(Store(spark), df).collect()}
    want = brute_targets(sizes)
    assert got == {s: pytest.approx(t) for s, t in want.items()}


def test_mix_sample_has_all_columns(spark, hard, empty):
    out = mixing.sample(hard)
    assert out.columns == hard.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(hard).collect())
    assert mixing.mix(empty).count() == 0


# --- fingerprints


def test_fingerprints(spark, hard, docs, empty):
    for df in (docs, hard):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (-x[0], x[1]))
        want = []
        for i, (d, t) in enumerate(rows):
            after, n = rows[(i + 1) % len(rows)][1], len(t) // 3
            edited = t[: len(t) - n] + after[:n]
            a, b, c = (fingerprint.fingerprint(x.encode()) for x in (t, edited, after))
            want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
        got = [tuple(r) for r in fingerprint.fingerprints(df).collect()]
        assert sorted(got) == sorted(want)
    assert fingerprint.fingerprints(empty).count() == 0


def brute_fingerprint(text):
    """One byte at a time, with a list for the window."""
    import xxhash

    block = 3
    while block * 64 < len(text):
        block *= 2
    window, prints = [0] * 7, []
    hashes = []
    for b in text:
        window = window[1:] + [b]
        shifted = 0
        for i, x in enumerate(window):
            shifted ^= x << (5 * (6 - i))
        hashes.append((sum(window) + sum((i + 1) * x for i, x in enumerate(window)) + (shifted & 0xFFFFFFFF)) & 0xFFFFFFFF)
    for size in (block, 2 * block):
        letters, piece = "", b""
        for i, h in enumerate(hashes):
            piece += text[i : i + 1]
            if h % size == size - 1 or i == len(text) - 1:
                letters += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[xxhash.xxh32_intdigest(piece) % 64]
                piece = b""
        prints.append(re.sub(r"(.)\1{3,}", r"\1\1\1", letters))
    return f"{block}:{prints[0]}:{prints[1]}"


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_fingerprints_against_brute_force(docs):
    some = [(t or "").encode() for _, t in pairs(docs)][:40] + [b"", b"a", b"ab" * 500, "é😀 ".encode() * 90]
    prints = [fingerprint.fingerprint(t) for t in some]
    assert prints == [brute_fingerprint(t) for t in some]
    for a, b in zip(prints, prints[1:], strict=False):
        one, two = a.split(":")[1], b.split(":")[1]
        assert fingerprint.common(one, two) == brute_common(one, two)


def test_ranges_follow_the_size(spark, docs, monkeypatch):
    whole = sorted(map(tuple, fingerprint.fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprint, "LEAST_BYTES", 1 << 13)
    dealt = fingerprint.with_next(docs)
    assert dealt.rdd.getNumPartitions() > 10 and dealt.select("part").distinct().count() > 10
    assert sorted(map(tuple, fingerprint.fingerprints(docs).collect())) == whole


def test_likeness():
    text = " ".join(f"word{i * i}" for i in range(900)).encode()
    one, two = fingerprint.fingerprint(text), fingerprint.fingerprint(text[:3000] + b"changed" + text[3000:])
    other = fingerprint.fingerprint(" ".join(f"term{i * 7 + 3}" for i in range(900)).encode())
    assert fingerprint.likeness(one, one) == 1 and fingerprint.likeness(one, two) > 0.8 and fingerprint.likeness(one, other) < 0.3
    assert fingerprint.common("abcde", "axcye") == 3
    assert len(fingerprint.fingerprint(b"z" * 100_000)) < 20


def test_fingerprint_blocks_agree(monkeypatch):
    text = b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(400))
    whole = fingerprint.fingerprint(text)
    monkeypatch.setattr(fingerprint, "BLOCK", 97)
    assert fingerprint.fingerprint(text) == whole


# --- BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe(hard, docs, tokenizer):
    for df in (hard, docs):
        texts = {(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()}
        got = bpe.encode(df, bpe.default_path()).collect()
        want = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts}
        assert len(got) == df.count()
        for r in got:
            assert r.ids == want[r.doc_id] and r.decoded == tokenizer.decode(want[r.doc_id], skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b <|endoftext|", "don't I'LL we're", "  \n\n x  ", "  x​", "١٢٣ ½ Ⅷ 漢字かな 한글", "é 🏴‍☠️", "a" * 5000, "ab" * 3000 + "é" * 500, "=" * 700, "\x00\x01\x1c\x85"])
def test_bpe_of_hard_texts(text, tokenizer):
    vocab = bpe.Vocabulary(bpe.vocabulary(bpe.default_path()))
    ids = vocab.encode(text)
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids and vocab.decode(ids) == text


# --- HTML

PAGES = [
    (
        '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, a long advert text that is longer than most.</div>'
        "<article><h1>Head line</h1><p><b>First &amp; long paragraph\n with  white space.<br>More<p>Short.</p><aside>Side text</aside><p>Last &lt;one&gt;</p></article><footer>&copy; Foot</footer></body></html>",
        "Head line First & long paragraph with white space. More Short. Last <one>",
    ),
    ("<body><div id=menu><a href=x>a</a></div><div><p>" + "A paragraph of text that is long enough. " * 3 + "</p><p>Short.</p></div><div class='comments'><p>" + "reader comment " * 20 + "</p></div>", ("A paragraph of text that is long enough. " * 3).strip() + " Short."),
    ("<article><form><input value='x'>Sign up</form><p>Text</p><div class='cookie-notice'>We use cookies</div><!-- no <p>this</p> --><style>p{}</style><p>End", "Text End"),
    ("", ""), (None, ""), ("<p></p>", ""), ("plain text", "plain text"), ("<article><p>cut off in a ta", "cut off in a ta"), ("<script>never closed <p>x</p>", ""),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}


WRAPPED = [
    ("<body><nav>Menu</nav><div class='content has-sidebar'><article><h1>Head</h1><p>Text of it.</p></article></div></body>", "Head Text of it."),
    ("<div id=page class='header-fixed'><div class='sidebar'><p>Side text.</p></div><div><p>LONG</p><p>Short.</p></div></div><p>A line of the page's own that is outside.</p>", "LONG Short. A line of the page's own that is outside."),
    ("<div class='has-sidebar'><article><p>Text</p><div class='related'><article>Other</article></div></article></div><div class='comments'><article>LONG</article></div>", "Text"),
    ("<body class=x><svg width='1'/><article><p>After a drawing</p></article></body>", "After a drawing"),
    ("<div><svg><path d='x'></div><article>One <svg><text>no</text></svg>two</article>", "One two"),
    ("<article><p>Before</p><video src=x><p>after</p></article>", "Before after"), ("<p>LONG</p><iframe src=x>", "LONG"),
    ("<div><p>LONG LONG LONG</p><div class=ad>Buy</div><p>Short.</p><div class=ad>Buy</div><p>LONG LONG</p></div>", "LONG LONG LONG Short. LONG LONG"),
    ("<div><p>LONG LONG LONG</p><div class=ad>Buy</div><p>The end.</p></div>", "LONG LONG LONG The end."),
    ("<div><p>LONG</p><nav>x</nav><p><a href=x>Only a link that is long enough to be a region</a></p></div>", "LONG"),
]


def test_main_text_is_whole():
    long = "A paragraph of text that is long enough, and goes on for a while."
    assert [html.main_text(h.replace("LONG", long)) for h, _ in WRAPPED] == [t.replace("LONG", long) for _, t in WRAPPED]


def test_main_text_of_hard_markup():
    long = "A paragraph of text that is long enough, and goes on for a while."
    pages = [
        ("<article><p title=it's>First para</p><p>Second para</p></article>", "First para Second para"),
        ("<article><p title='a>b' data-x=\"c>d\" e=f'g>One</p><p x = 'y>z'>Two</p></article>", "One Two"),
        ("<article><p title=\"never closed>One</p><p>Two</p></article>", "One Two"),
        ("<article>..story..</article><article class='comment'><p>reader says hi</p></article>", "..story.."),
        (f"<article><p>{long}</p><section><article class='user-comment'>reader</article><article id='reply-2'>again</article></section></article>", long),
        (f"<div><article class='comment'><p>{long}</p></article></div>", long),
        (f"<article class='post comments-open'><p>{long}</p></article>", long),
        ("<article><b><p>one</b> two</p><p>three</p></article>", "one two three"),
        (f"<article><p>{long}</p><div class=ad>Buy</div><div class=ad>Buy</div><p>End.</p></article>", f"{long} End."),
        (f"<article><p>{long}</p><nav>x</nav><ul><li><a href=x>{long}</a></li></ul><div class=ad>Buy</div><p>(c)</p></article>", long),
        ("a < b, 3 > 2 <!-- > --><!--> c <3", "a < b, 3 > 2 c <3"),
    ]
    assert [html.main_text(h) for h, _ in pages] == [t for _, t in pages]


def test_main_text_of_long_pages():
    import time

    n = 100_000
    for page in ("<b>" * n + "</i>" * n, "<article>" + "<p>some words of a paragraph here" * n, "<div><a href='x'>" * n + "t" + "</a>" * n, '<a title="x' * n, "<p class='comment'>x" * n):
        start = time.time()
        html.main_text(page)
        assert time.time() - start < 10


def brute_main_text(lines):
    """Step by step over (text, letters in links) of a page without a marked part; a gap is None."""
    size = [0 if x is None else len(x[0]) for x in lines]
    block = [sum(size[i : i + html.BLOCK]) for i in range(len(size))]
    spans, i = [], 0
    while i < len(size):
        if not size[i]:
            i += 1
            continue
        j = i
        while j < len(size) and block[j]:
            j += 1
        end = max(x for x in range(i, j) if size[x]) + 1
        spans.append((i, end, any(size[x] and block[x] > html.SURGE for x in range(i, end))))
        i = j
    total = lambda s: sum(size[s[0] : s[1]])
    real = [s for s in spans if 2 * sum(max(0, size[x] - lines[x][1]) for x in range(s[0], s[1]) if size[x]) >= total(s)]
    strong = [s for s in real if s[2]] or real
    if not strong:
        return ""
    fair = [s for s in strong if total(s) >= html.SHARE * max(map(total, strong))]
    a, b = spans.index(fair[0]), spans.index(fair[-1])
    while a and spans[a - 1] in real and spans[a][0] - spans[a - 1][1] <= html.BLOCK:
        a -= 1
    while b + 1 < len(spans) and spans[b + 1] in real and spans[b + 1][0] - spans[b][1] <= html.BLOCK:
        b += 1
    return " ".join(lines[x][0] for s in spans[a : b + 1] if s in real for x in range(s[0], s[1]) if size[x])


def test_main_text_against_brute_force():
    import random

    for seed in range(400):
        rng = random.Random(seed)
        lines, page = [], []
        for i in range(rng.randrange(1, 14)):
            kind = rng.choice("pppsslag")
            text = " ".join(f"w{i}x{j}" for j in range(rng.randrange(8, 40) if kind in "pl" else rng.randrange(1, 4)))
            if kind in "ag":
                page.append(rng.choice([f"<nav>{text}</nav>", f"<div class='advert'>{text}</div>", f"<script>{text}</script><footer><p>{text}</p></footer>"]))
                lines += [None] * html.BLOCK
            else:
                page.append(f"<p><a href='#'>{text}</a></p>" if kind == "l" else f"<div><p>{text}</p></div>")
                lines.append((text, len(text) if kind == "l" else 0))
        assert html.main_text("<body>" + "".join(page) + "</body>") == brute_main_text(lines), seed


def test_extraction_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert html.extract(spark.createDataFrame([], schema)).collect() == []
    got = html.extract(spark.createDataFrame([(1, None, "<p>x</p>", "y", "z"), (1, None, "<p>x</p>", "y", "z"), (None, "u", None, None, None)], schema)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [(1, None, "x", 1), (1, None, "x", 1), (None, "u", "", 0)]


def test_regions():
    assert html.regions([0, 0, 5, 60, 50, 0, 0, 0, 0, 70, 0, 0, 0], 40) == [(2, 5), (9, 10)]
    assert html.regions([], 40) == [] and html.regions([0, 0], 0) == []


def test_generated_pages(spark, sf):
    got = html.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)
        if inner:
            import html as h

            blocks = re.split(r"</?(?:p|h1)>", inner[1])
            want = " ".join(x for b in blocks if (x := " ".join(h.unescape(re.sub(r"<[^>]*>", lambda m: " " if "br" in m[0] else "", b)).split())))
            assert r.text == want


# --- classifiers


def held_out_rows(spark, name, folder="/root/testdata/sf0.01"):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    from tidewright.llm import queries

    rows = queries.queries()[name](spark, folder).collect()
    return [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels], rows


def auc(scored):
    good, bad = [s for s, y in scored if y], [s for s, y in scored if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_toxicity_held_out(spark):
    own, rows = held_out_rows(spark, "op4_toxicity")
    assert auc([(r.score, y.toxic) for r, y in own]) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    clean = [r.predicted for r, y in own if not y.toxic]
    assert sum(clean) <= 0.05 * len(clean)


def test_quality_held_out(spark):
    own, rows = held_out_rows(spark, "op3_quality_classifier")
    assert auc([(r.tail_probability, y.quality) for r, y in own]) > 0.9
    assert all(0 <= r.top_probability <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_classifiers_on_hard_rows(spark, hard, empty):
    model = toxicity.DEFAULT
    got = {r.doc_id: r for r in toxicity.score(hard, model).collect()}
    assert got[18].predicted == 1 and got[3].predicted == got[0].predicted == 0
    assert toxicity.score(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(hard, none) is toxicity.DEFAULT
    kept = {r.doc_id: r.kept for r in quality.score(hard, quality.fit(hard, quality.grades(none))).collect()}
    assert kept[0] and not kept[3] and not kept[4] and not kept[5]


def test_grammar():
    lexicon = toxicity.Lexicon({})
    out = lambda t: toxicity.clause_output(t, lexicon)
    assert out("you are an idiot") > out("an idiot") > out("he said an idiot") > 0
    assert out("not an idiot") < out("an idiot") and out("kill the light") == 0 < out("i will kill you")
    assert toxicity.matched("fine. such trash, really. ok", lexicon) == [" such trash"]


def brute_clause(clause, lexicon):
    """The grammar by flags, word by word, without a table."""
    out, negated, threat, aimed, said, at = 0.0, 0, 0.0, False, False, 0
    for m in re.finditer(r"[^\W\d_]+", clause):
        said |= any(c in '"\u201c\u201e\u00ab' for c in clause[at : m.start()])
        at, word = m.end(), m.group()
        weak = (0.5 if negated else 1) * (0.6 if said else 1)
        negated = max(0, negated - 1)
        if (stem := lexicon.stem(word)) is not None:
            out += lexicon.weights[stem] * weak * (1.25 if aimed else 1)
        elif word in toxicity.VIOLENCE:
            threat = weak
        elif word in toxicity.TARGETS:
            out, threat, aimed = out + 5 * threat, 0.0, True
        elif word in toxicity.NEGATIONS:
            negated = 3
        elif word in toxicity.REPORTS:
            said = True
    return out


def test_composed_grammar_equals_its_parts_and_brute_force():
    import itertools

    lexicon = toxicity.Lexicon({"nast": 2.5})
    words = {"I": "idiot", "V": "kill", "T": "you", "N": "not", "R": "said", "O": "light"}
    for n in range(1, 6):
        for letters in itertools.product(toxicity.LETTERS, repeat=n):
            if "Q" in (letters[-1], *(a for a, b in itertools.pairwise(letters) if b == "Q")):
                continue  # a quote counts with the word after it
            text = "".join('"' if c == "Q" else words[c] + " " for c in letters)
            symbols, weights, out = list(letters), [4.0 if c == "I" else 0.0 for c in letters], 0.0
            for part in toxicity.cascade():
                symbols, more = part.walk(symbols, weights)
                out += more
            assert toxicity.clause_output(text, lexicon) == pytest.approx(out) == pytest.approx(brute_clause(text, lexicon)), text
    text = "nobody wrote \u201cyou nasty moron\u201d , they will not stab the nastier ones"
    assert toxicity.clause_output(text, lexicon) == pytest.approx(brute_clause(text, lexicon))
    one = toxicity.compose(toxicity.negation(), toxicity.reported())
    assert one.walk(["N", "R", "I"], [0, 0, 1])[0] == ["N", "R-", "I-~"]


def test_score_against_brute_force(spark, sf, docs, hard):
    import math

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    lexicon = toxicity.Lexicon(model.weights)
    for df in (docs, hard):
        got = {}
        for r in toxicity.score(df, model).collect():
            got[r.doc_id] = r
        for i, t in pairs(df):
            outs = [x for c in re.split("[.!?;:,\n\r\u2026]", (t or "").lower()) if (x := brute_clause(c, lexicon)) > 0]
            n, total = 1 + (t or "").count(" ") + (t or "").count("\n"), sum(outs)
            row = [math.log1p(total), math.log1p(max(outs, default=0)), math.log1p(100 * total / (n + 20)), math.log1p(len(outs)), float(bool(outs))]
            z = model.intercept + sum(a * b for a, b in zip(row, model.coefficients, strict=True))
            assert got[i].score == pytest.approx(1 / (1 + math.exp(-min(35, max(-35, z))))) and got[i].clauses == len(outs)


def test_training_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(200)] * 2 + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(empty, labels) is toxicity.DEFAULT
    one, two = (toxicity.train(d, labels) for d in (docs, docs.repartition(7)))
    assert one.weights == two.weights and list(one.coefficients) == list(two.coefficients)
    a, b = (quality.fit(d, quality.grades(labels)) for d in (docs.unionByName(docs.limit(5)), docs.unionByName(docs.limit(5)).repartition(7)))
    assert list(a.weights) == list(b.weights) and list(a.thresholds) == list(b.thresholds)
    assert not quality.fit(empty, quality.grades(labels)).weights.any() and quality.score(empty, a).count() == 0


def brute_features(text):
    """Column -> value by plain integers, one word at a time."""
    from tidewright.llm import common

    full = 2**64 - 1

    def mixed(x, salt=0):
        x = (x + salt * 0xD1B54A32D192ED03) & full
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * m) & full
        return x ^ (x >> 33)

    def word(w):
        return mixed(sum(int(common._BYTE[b]) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, b in enumerate(w)) & full)

    def shape(w):
        kinds = [48 if 48 <= b < 58 else 65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else b for b in w]
        runs = [k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]]
        return mixed(sum(mixed(k + min(i, 12) * 257, 19) for i, k in enumerate(runs)) & full, 23)

    ws = [w.encode() for w in words(text)]
    hashes, shapes = [word(w) for w in ws], [shape(w) for w in ws]
    half = quality.DIMS // 2
    cols = Counter()
    for i in range(len(ws)):
        cols[hashes[i] % half] += 1
        cols[half + shapes[i] % (half // 2)] += 1
        cols[half + half // 2 + (mixed((shapes[i] * 3 + shapes[i - 1]) & full, 31) if i else 0) % (half // 2 - 2)] += 1
        cols[quality.DIMS - 1 if i and hashes[i] == hashes[i - 1] else quality.DIMS - 2] += 1
    norm = sum(cols.values()) ** 0.5
    return {c: n**0.5 / norm for c, n in cols.items()}


def test_quality_against_brute_force(spark, sf, docs, hard):
    import math

    import numpy as np

    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf}/labels.parquet")))
    assert model.weights.any() and (np.diff(model.thresholds) > 0).all()
    for df in (docs.where("doc_id < 60"), hard):
        got = {r.doc_id: r for r in quality.score(df, model).collect()}
        for i, t in pairs(df):
            z = sum(model.weights[c] * v for c, v in brute_features(t).items())
            tails = [1 / (1 + math.exp(-min(35, max(-35, z - x)))) for x in model.thresholds]
            r = got[i]
            assert (r.expected_grade, r.tail_probability, r.top_probability) == pytest.approx((sum(tails), tails[0], tails[-1]))
            assert r.kept == (bool(words(t)) and tails[0] >= quality.KEEP)


def test_clauses_are_whole_however_long():
    lexicon = toxicity.Lexicon({})
    far = "some other words " * 40
    score = lambda t: sum(toxicity.clause_output(c, lexicon) for c in toxicity.matched(t, lexicon))
    assert score(f"you {far} idiot") > score(f"{far} idiot") > score(f"was said {far} idiot") == score(f"\u201c{far} idiot") > 0
    text = f"one. he said {far} idiot and {far} moron, fine. {far}, you {far} loser"
    assert toxicity.matched(text, lexicon) == [f" he said {far} idiot and {far} moron", f" you {far} loser"]
    # The window's edge once fell inside skill, whose rest is a word of violence.
    text = f"skill {'x' * 387} you idiot"
    assert toxicity.matched(text, lexicon) == [text]


def test_ordinal_recovers_thresholds():
    import numpy as np

    from tidewright.llm.linear import Ordinal

    rng = np.random.default_rng(1)
    x, n = rng.normal(size=(3000, 3)), 3000
    grade = ((x @ [2.0, -1.0, 0.0] + rng.logistic(size=n))[:, None] > np.array([-1.0, 0.5, 2.0])).sum(axis=1)
    m = Ordinal(3, 4, l2=1e-5, steps=600).fit(np.repeat(np.arange(n), 3), np.tile(np.arange(3), n), x.reshape(-1), grade, np.ones(n))
    assert np.allclose(m.weights, [2, -1, 0], atol=0.2) and np.allclose(m.thresholds, [-1, 0.5, 2], atol=0.25)
    assert (np.diff(m.tails(np.array([0.3]))[0]) < 0).all()


# --- the pipeline


def test_pipeline(spark, sf, hard, empty):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixture", "tokens"]
    for start in (hard, empty):
        now = start
        for i, (_, stage) in enumerate(p.STAGES):
            now = stage(spark, now, sf).cache()
            if i < 4:
                assert now.columns == p.COLUMNS
            now.count()
        vocab = bpe.Vocabulary(bpe.vocabulary(bpe.default_path()))
        for r in now.collect():
            assert r.ids == vocab.encode(r.decoded)
    assert p.run(spark, sf).count() > 0


def test_near_duplicate_stage_with_null_and_reused_ids(spark):
    import corpus_pipeline as p

    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, two), (2, two), (None, one), (None, three), (None, three), (None, ""), (None, ""), (4, "x"), (4, "x"), (5, one + " more")]
    df = spark.createDataFrame([(i, t, "en", f"s{n}", len(t)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(1, one, "s0"), (1, two, "s1"), (None, three, "s4"), (None, "", "s6"), (None, "", "s7"), (4, "x", "s8")], key=repr)
    for d in (df, df.repartition(5, "source")):
        assert sorted(((r.doc_id, r.text, r.source) for r in p.near_duplicates(spark, d, "").collect()), key=repr) == want


def test_near_duplicate_stage_keeps_one_of_each(spark, docs):
    import corpus_pipeline as p

    kept = {r.doc_id for r in p.near_duplicates(spark, docs, "").collect()}
    assert kept == {root for _, root in brute_components(pairs(docs), 5, 80).values()}


