"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is a DataFrame expression: ``regexp_extract_all`` gives the matches of a text and ``split`` by
the same pattern the gaps between them, whose lengths add up to code-point offsets.

The patterns are written so that Java's matcher finds the leftmost non-overlapping matches of the plain
patterns in linear time: a match can only begin where a run of its letters begins (or where the match
before it ended), and runs are taken possessively, so no run is scanned twice and none is backtracked.

Base kinds (email, ip, card, phone) are always kept. A method kind (iban, ssn, secret) is kept if its
score reaches KEEP: its checksum, or a secret's mix of letters and digits, counts as much as the words within
NEAR code points before it. A list of spans is put together by running sums and maxima in n log n steps,
and a text is cut in pieces of PIECE code points before parts of it are taken, so that time follows a text's
length however many spans it has.

Edges. Null and empty texts have no spans; redacted, a null text stays null. An empty table gives an empty
result. Repeated rows, and rows with an equal or null doc_id, are searched each alone. Spans and scores depend
on the text only; other columns, whatever their names, are left out by detect() and kept by a caller of redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read, running

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Kinds in the order of a span list, with the pattern of each.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed match without words nearby, by kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.4, "secret": 0.4}
#: Words before a span (within NEAR code points) that speak for its kind, and ones that speak against any.
CONTEXT = {"email": "e-?mail|contact|write to", "ip": r"\bip\b|address|host|server", "card": "card|visa|master|credit|debit|payment", "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|konto|transfer", "ssn": r"ssn|social security|tax id", "secret": r"token|key|secret|passw|bearer|credential"}
AGAINST = r"\bversion\b|\bisbn\b|\bissn\b|\border no|\bserial\b|\bexample only\b"
NEAR, KEEP = 48, 0.6
#: Matches before a span whose texts fill NEAR code points, the shortest one having four.
_BEFORE = NEAR // 4
#: Code points of the pieces that a text is cut into before parts of it are taken.
PIECE = 1024
_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _number(c: Column) -> Column:
    return F.ascii(c) - 48


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn checksum: every second digit from the right counts twice."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, _number(c)).otherwise(F.when(_number(c) > 4, 2 * _number(c) - 9).otherwise(2 * _number(c))))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (blanks allowed) leaves 1 modulo 97 with its first four letters moved to its end."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + _number(c)) % 97)) == 1


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match is one of its kind beyond its pattern."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)") & ~match.rlike("-00-|0000$")
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= 10)
    return F.lit(True)


def found(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of one kind's confirmed spans, in order."""

    def place(matches: Column) -> Column:
        gaps = F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(matches))
        steps = F.zip_with(matches, gaps, lambda m, gap: F.struct(m.alias("m"), F.length(m).alias("n"), (F.length(gap) + F.length(m)).alias("step"), F.right(gap, F.lit(NEAR)).alias("gap"), F.right(m, F.lit(NEAR)).alias("tail")))
        return let(steps, lambda s: let(running(F.transform(s, lambda x: x["step"]), lambda a, b: a + b), lambda ends: kept(s, ends)))

    def kept(s: Column, ends: Column) -> Column:
        placed = F.transform(s, lambda x, i: F.struct(x["m"].alias("m"), i.alias("i"), (F.get(ends, i) - x["n"]).alias("start"), F.get(ends, i).alias("end")))
        real = F.filter(placed, lambda x: confirmed(kind, x["m"]))

        def scored(x: Column) -> Column:
            near = F.slice(s, F.greatest(x["i"] - _BEFORE, F.lit(0)) + 1, F.least(x["i"], F.lit(_BEFORE)))
            before = F.concat(F.array_join(F.transform(near, lambda y: F.concat(y["gap"], y["tail"])), ""), F.get(s, x["i"])["gap"])
            before = F.lower(F.right(before, F.lit(NEAR)))
            score = F.lit(PRIOR[kind]) + F.when(before.rlike(CONTEXT[kind]), 0.25).otherwise(0.0) - F.when(before.rlike(AGAINST), 0.3).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

        out = F.transform(real, scored)
        return out if kind in BASE else F.filter(out, lambda x: x["score"] >= KEEP)

    return let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(F.array().cast(_SPANS)))


def spans(text: Column) -> Column:
    """All spans of a text, by kind as PATTERNS lists them, then by start."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.concat(*[found(k, t) for k in PATTERNS]))


def listed(found_spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(found_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and found (the spans with their scores), for every row of ``docs`` (doc_id, text, and more)."""
    return docs.select("doc_id", spans(F.col("text")).alias("found"))


def redact(text: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one. Null stays null."""

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """The code points from a up to b."""
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        ends = lambda: F.concat(F.substr(piece(i), a % PIECE + 1), F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), F.substr(piece(j), F.lit(1), b % PIECE))
        return F.when(i == j, F.substr(piece(i), a % PIECE + 1, b - a)).otherwise(ends())

    def cover(t: Column, found_spans: Column) -> Column:
        order = F.sort_array(F.transform(found_spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
        return let(order, lambda o: let(running(F.transform(o, lambda s: -s["less"]), F.greatest), lambda tops: joined(t, o, tops)))

    def joined(t: Column, order: Column, tops: Column) -> Column:
        # A span that begins where all before it have ended, with that end.
        heads = F.transform(order, lambda s, i: F.struct(F.when(i > 0, F.get(tops, i - 1)).otherwise(0).alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
        heads = F.filter(heads, lambda h: h["start"] >= h["at"])
        last = F.element_at(tops, -1)
        pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        put = lambda p: F.concat(F.array_join(F.transform(heads, lambda h: F.concat(between(p, h["at"], h["start"]), F.lit("<"), F.upper(h["kind"]), F.lit(">"))), ""), between(p, last, F.length(t)))
        return let(pieces, put)

    return let(text, lambda t: let(spans(t), lambda s: F.when(F.size(s) > 0, cover(t, s)).otherwise(t)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    out = detect(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"), F.transform("found", lambda s: s["score"]).alias("scores"))
