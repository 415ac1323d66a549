"""Toxicity by a weighted finite-state grammar over clauses.

A clause is read as a string of word classes: insult (a word of the lexicon), violence, target, negation,
report, quote (an opening one) and other. Five weighted transducers stand in a cascade, each a transition table that reads what the
one before it writes:
  negation  after a negating word marks the next NEGATED words as weak;
  reported  after a verb of speech or an opening quote marks all that follows as reported;
  target    after a word for a person marks insults as aimed;
  threat    pairs a word of violence with the next target, and puts out a weight for the pair only;
  insult    puts out a factor for the word's own weight, by the marks that it carries.
compose() makes one table of them, whose states are the reachable combinations of theirs; a clause walks
through that table once. What is scored is the matched clause: the sum of the weights on its path. A text's
score is a logistic function of its clauses' sum, largest clause, share of its words, and number.

The lexicon is a short fixed one of insults, and stems learned from labels: beginnings of words (and
whole words) that are found in toxic texts far more often than in others, by a likelihood ratio, weighted by the
logarithm of their rates. The logistic is fitted with each training text's own counts left out of its weights.
The fits use at most SAMPLE labelled rows outside the held-out quarter of ids and TOXIC_SAMPLE toxic ones
(those with the least digests); all of their stems are counted, and every one that passes the ratio is
looked at. Labels, languages, sources and ids are no input of a score.

Edges. Null and empty texts match nothing and get the score of that. Without toxic labels, or any others, the
fixed lexicon and fixed coefficients are used; so they are where ``documents`` is empty. Of labels that come
again for an id the largest counts; a null label is none. Rows of documents with an equal id are each scored on their own text,
and each counts in a fit if the id is labelled. Texts of any length are read whole, a clause too, and other columns are
left out, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, read
from .linear import Ordinal
from .quality import held_out

SAMPLE, TOXIC_SAMPLE, PREDICT = 6000, 3000, 0.3
#: Least texts with a stem and least likelihood ratio (a chi-square with one degree of freedom) for the lexicon.
LEAST_TEXTS, LEAST_RATIO = 3, 14.0
STEM_LETTERS = range(3, 9)

# The grammar's closed classes.
INSULTS = "idiot moron loser scum trash stupid pathetic worthless disgusting clown imbecile bastard dumbass dummkopf arschloch abschaum trottel connard crétin salaud ordure idiota imbécil basura estúpido".split()
VIOLENCE = "kill hurt destroy murder beat stab shoot strangle töten umbringen verprügeln tuer frapper matar golpear".split()
TARGETS = "you your yours yourself u he she they them him her those these people everyone du dich dir ihr euch sie tu toi vous ils elle tú ti vosotros ustedes ellos".split()
NEGATIONS = "not no never nobody isn aren wasn don doesn nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say called calls wrote writes told reported quoted claimed sagte sagt nannte dit écrit appelé dijo escribió llamó".split()
NEGATED, WEAK_NEGATED, WEAK_REPORTED, STRONG_TARGET = 3, 0.5, 0.6, 1.25
FIXED_WEIGHT, THREAT_WEIGHT = 4.0, 5.0

_WORD = re.compile(r"[^\W\d_]+")
_ENDS = ".!?;:,\n\r…"
_CLAUSE = re.compile(f"[{_ENDS}]")
_QUOTES = frozenset("\"“„«")
_CLASSES = {w: "V" for w in VIOLENCE} | {w: "T" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS}

#: Input letters: insult, violence, target, negation, report, quote, other.
LETTERS = "IVTNRQO"


class Transducer:
    """A deterministic transducer: arcs[state][symbol] is (next state, symbol written, factor, weight).

    A path's output is, for each word, its own weight (of the lexicon) times the arc's factor, plus the arc's weight."""

    def __init__(self, start: object, arcs: dict[object, dict[str, tuple[object, str, float, float]]]):
        self.start, self.arcs = start, arcs

    def walk(self, symbols: list[str], weights: list[float]) -> tuple[list[str], float]:
        """What is written for a string of symbols, and its output."""
        state, written, out = self.start, [], 0.0
        for symbol, own in zip(symbols, weights, strict=True):
            state, symbol, factor, weight = self.arcs[state][symbol]
            written.append(symbol)
            out += own * factor + weight
        return written, out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer that writes what ``second`` writes for what ``first`` writes; factors and weights add up.

    Its states are the pairs of states that are reached from the starts."""
    start = (first.start, second.start)
    arcs: dict[object, dict[str, tuple[object, str, float, float]]] = {}
    todo = [start]
    while todo:
        at = todo.pop()
        if at in arcs:
            continue
        arcs[at] = {}
        for symbol, (one, middle, factor, weight) in first.arcs[at[0]].items():
            two, written, more, plus = second.arcs[at[1]][middle]
            arcs[at][symbol] = ((one, two), written, factor + more, weight + plus)
            todo.append((one, two))
    return Transducer(start, arcs)


def _marked(letters: str, marks: str) -> list[str]:
    """Each letter with each subset of the marks, in the order of the marks."""
    some = [""]
    for m in marks:
        some += [x + m for x in some]
    return [c + x for c in letters for x in some]


def negation() -> Transducer:
    """States: how many words are still weak. A quote is no word."""
    arcs = {}
    for left in range(NEGATED + 1):
        mark, then = ("-" if left else ""), max(0, left - 1)
        arcs[left] = {c: (left if c == "Q" else NEGATED if c == "N" else then, c + mark, 0.0, 0.0) for c in LETTERS}
    return Transducer(0, arcs)


def reported() -> Transducer:
    """States: whether speech is reported, up to the clause's end. A quote holds for the word that follows it, a verb from the next word on."""
    symbols = _marked(LETTERS, "-")
    return Transducer(False, {said: {x: (said or x[0] in "RQ", x + ("~" if said else ""), 0.0, 0.0) for x in symbols} for said in (False, True)})


def target() -> Transducer:
    """States: whether somebody is spoken of."""
    symbols = _marked(LETTERS, "-~")
    return Transducer(False, {aimed: {x: (aimed or x[0] == "T", x + ("+" if aimed and x[0] == "I" else ""), 0.0, 0.0) for x in symbols} for aimed in (False, True)})


def _weak(marks: str) -> float:
    return (WEAK_NEGATED if "-" in marks else 1.0) * (WEAK_REPORTED if "~" in marks else 1.0)


def threat() -> Transducer:
    """States: the marks of a word of violence that waits for its target, or None."""
    symbols = _marked(LETTERS, "-~+")
    arcs: dict[object, dict[str, tuple[object, str, float, float]]] = {}
    for waits in (None, "", "-", "~", "-~"):
        arcs[waits] = {}
        for x in symbols:
            then = x[1:].replace("+", "") if x[0] == "V" else None if x[0] == "T" else waits
            arcs[waits][x] = (then, x, 0.0, THREAT_WEIGHT * _weak(waits) if x[0] == "T" and waits is not None else 0.0)
    return Transducer(None, arcs)


def insult() -> Transducer:
    """One state: an insult's marks give the factor of its own weight."""
    return Transducer(0, {0: {x: (0, x, _weak(x[1:]) * (STRONG_TARGET if "+" in x else 1.0) if x[0] == "I" else 0.0, 0.0) for x in _marked(LETTERS, "-~+")}})


def cascade() -> list[Transducer]:
    return [negation(), reported(), target(), threat(), insult()]


def grammar() -> list[list[tuple[int, float, float]]]:
    """The composed transducer with numbered states: rows of (next state, factor, weight) by letter; 0 is the start."""
    parts = cascade()
    whole = parts[0]
    for part in parts[1:]:
        whole = compose(whole, part)
    number = {whole.start: 0}
    for state in whole.arcs:
        number.setdefault(state, len(number))
    table = [[(0, 0.0, 0.0)] * len(LETTERS) for _ in number]
    for state, arcs in whole.arcs.items():
        for symbol, (then, _, factor, weight) in arcs.items():
            table[number[state]][LETTERS.index(symbol)] = (number[then], factor, weight)
    return table


class Lexicon:
    """Weighted stems; a stem ending in $ is a whole word."""

    def __init__(self, weights: dict[str, float]):
        self.weights = {f"{w}$": FIXED_WEIGHT for w in INSULTS} | weights
        self.lengths = sorted({len(s) for s in self.weights if s[-1] != "$"}, reverse=True)
        words = [s.rstrip("$") for s in self.weights]
        # Words that can begin a match at all, found in one pass over a text.
        self.find = re.compile(rf"(?<![^\W\d_])(?:{_trie(sorted(set(words) | set(VIOLENCE)))})[^\W\d_]*").finditer

    def stem(self, word: str) -> str | None:
        """The lexicon's entry for a word: the word itself, or its longest stem."""
        if f"{word}$" in self.weights:
            return f"{word}$"
        return next((word[:n] for n in self.lengths if word[:n] in self.weights), None)


def _trie(words: list[str]) -> str:
    """A pattern of all words that shares their beginnings, so that matching is one walk down."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        more = [re.escape(c) + build(x) for c, x in sorted(node.items()) if c]
        if not more:
            return ""
        # The rest of a word is read anyway, so a shorter entry can stand for a longer one.
        return "" if "" in node else more[0] if len(more) == 1 else f"(?:{'|'.join(more)})"

    return build(root)


_GRAMMAR = grammar()
_INSULT, _QUOTE, _OTHER = LETTERS.index("I"), LETTERS.index("Q"), LETTERS.index("O")
_NUMBER = {w: LETTERS.index(c) for w, c in _CLASSES.items()}


def letters(clause: str, lexicon: Lexicon) -> Iterator[tuple[int, str | None]]:
    """The clause as numbers of input letters, with the entry of each insult. Opening quotes before a word are one letter."""
    at = 0
    for m in _WORD.finditer(clause):
        if not _QUOTES.isdisjoint(clause[at : m.start()]):
            yield _QUOTE, None
        at = m.end()
        word = m.group()
        stem = lexicon.stem(word)
        yield (_INSULT, stem) if stem is not None else (_NUMBER.get(word, _OTHER), None)


def clause_output(clause: str, lexicon: Lexicon, weigh=None) -> float:
    """What the composed transducer puts out on its way through one clause."""
    out, state = 0.0, 0
    for letter, stem in letters(clause, lexicon):
        state, factor, weight = _GRAMMAR[state][letter]
        out += weight
        if stem is not None:
            out += factor * (lexicon.weights[stem] if weigh is None else weigh(stem))
    return out


def matched(text: str, lexicon: Lexicon) -> list[str]:
    """The clauses that hold a word of the lexicon or of violence."""
    out, done = [], 0
    for m in lexicon.find(text):
        if m.start() < done:
            continue
        # From the end of the last clause that was taken on, so that no letter is searched again.
        start = max(done, 1 + max(text.rfind(c, done, m.start()) for c in _ENDS))
        end = _CLAUSE.search(text, m.end())
        done = end.start() if end else len(text)
        out.append(text[start:done])
    return out


def describe(text: str, lexicon: Lexicon, weigh=None) -> list[float]:
    """The features of a text: constants apart, what its clauses add up to."""
    outs = [x for c in matched(text, lexicon) if (x := clause_output(c, lexicon, weigh)) > 0]
    n = 1 + text.count(" ") + text.count("\n")
    total = sum(outs)
    return [math.log1p(total), math.log1p(max(outs, default=0.0)), math.log1p(100 * total / (n + 20)), math.log1p(len(outs)), 1.0 if outs else 0.0]


def stems(text: str) -> Counter:
    """Beginnings of the text's words, and whole words, with how often they come."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text)).items():
        out[f"{w}$"] += n
        for k in STEM_LETTERS:
            if k > len(w):
                break
            out[w[:k]] += n
    return out


def ratio(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """Likelihood ratio of a of n_a against b of n_b."""
    n, both = n_a + n_b, a + b
    cells = ((a, n_a * both / n), (b, n_b * both / n), (n_a - a, n_a * (n - both) / n), (n_b - b, n_b * (n - both) / n))
    return 2 * reduce(lambda x, y: x + y, [F.when((o > 0) & (e > 0), o * F.log(o / F.nullif(e, F.lit(0.0)))).otherwise(0.0) for o, e in cells])


class Model:
    """A lexicon and the logistic over clause features."""

    def __init__(self, weights: dict[str, float], coefficients: np.ndarray, intercept: float):
        self.weights, self.coefficients, self.intercept = weights, coefficients, intercept

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.coefficients + self.intercept, -35, 35)))


#: Used where nothing can be learned.
DEFAULT = Model({}, np.array([0.6, 0.6, 0.6, 0.3, 0.5]), -4.0)


def _weight(tox_words: float, clean_words: float, all_tox: float, all_clean: float) -> float:
    """Log ratio of a stem's rates, counted in words, with half a word added to each."""
    return min(8.0, math.log((tox_words + 0.5) / (all_tox + 1)) - math.log((clean_words + 0.5) / (all_clean + 1)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, toxic_sample: int = TOXIC_SAMPLE) -> Model:
    """Learn from labels (doc_id, toxic) outside the held-out quarter."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {bool(r.t): r.n for r in known.groupBy((F.col("toxic") >= 1).alias("t")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return DEFAULT
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    some = known.where("toxic >= 1").orderBy(order).limit(toxic_sample).unionByName(known.where("toxic < 1").orderBy(order).limit(sample))
    # At most sample + toxic_sample ids are broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", (F.col("toxic") >= 1).cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = stems((text or "").lower())
                own["\0"] = sum(n for s, n in own.items() if s[-1] == "$")
                for s, n in own.items():
                    row = found.setdefault(s, [0, 0, 0, 0])
                    row[1 - toxic] += 1
                    row[3 - toxic] += n
        names = list(found)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([found[s][j] for s in part], pa.int64()) for j in range(4)]], names=["stem", "tox_texts", "texts", "tox_words", "words"])

    store = Store(docs.sparkSession)
    table = texts.mapInArrow(count, "stem string, tox_texts long, texts long, tox_words long, words long")
    table = store.write(table.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("tox_texts", "texts", "tox_words", "words")]))
    whole = table.where(F.col("stem") == "\0").collect()
    if not whole or not whole[0].tox_texts or not whole[0].texts:
        return DEFAULT
    n_tox, n_clean, all_tox, all_clean = (whole[0][c] for c in ("tox_texts", "texts", "tox_words", "words"))
    # Only what passes the test comes to the driver; it is bounded as the labelled texts are.
    passed = (F.col("stem") != "\0") & (F.col("tox_texts") >= LEAST_TEXTS) & (F.col("tox_texts") * n_clean > 2 * F.col("texts") * n_tox) & (ratio(F.col("tox_texts"), F.col("texts"), n_tox, n_clean) >= LEAST_RATIO)
    found = table.where(passed).withColumn("ratio", ratio(F.col("tox_texts"), F.col("texts"), n_tox, n_clean)).collect()
    store.drop(table)
    chosen: dict[str, tuple[int, int, int]] = {}
    begun: set[str] = set()
    for r in sorted(found, key=lambda r: (-r.ratio, -len(r.stem), r.stem)):
        plain = r.stem.rstrip("$")
        # Not beside a beginning of its own, nor a beginning of one that was chosen.
        if not any(plain[:k] in chosen for k in STEM_LETTERS) and r.stem not in begun:
            chosen[r.stem] = (r.tox_words, r.words, r.tox_texts)
            begun.update(r.stem[:k] for k in range(1, len(r.stem) + 1))
    weights = {s: _weight(a, b, all_tox, all_clean) for s, (a, b, _) in chosen.items()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for b in batches:
            rows = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = (text or "").lower()
                own = Counter(s for w in _WORD.findall(text) if (s := lexicon.stem(w)))

                def weigh(s: str, own=own, toxic=toxic) -> float:
                    if s not in chosen:
                        return FIXED_WEIGHT
                    a, b, t = chosen[s]
                    if toxic and t - 1 < LEAST_TEXTS - 1:
                        return 0.0
                    return _weight(a - own[s], b, all_tox, all_clean) if toxic else _weight(a, b - own[s], all_tox, all_clean)

                rows.append([*describe(text, lexicon, weigh), float(toxic)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)], names=[f"x{i}" for i in range(6)])

    x = np.array([list(r) for r in texts.mapInArrow(features, ", ".join(f"x{i} double" for i in range(6))).collect()]).reshape(-1, 6)
    # In an order of its own, so that the sums don't depend on how rows were dealt.
    x = x[np.lexsort(x.T)]
    grade = x[:, 5].astype(int)
    # Weights undo the different shares of toxic and other rows in the sample.
    weight = np.where(grade == 1, sizes[True] / max(1, (grade == 1).sum()), sizes[False] / max(1, (grade == 0).sum()))
    row, col = np.repeat(np.arange(len(x)), 5), np.tile(np.arange(5), len(x))
    fitted = Ordinal(5, 2, l2=1e-4, steps=1500, rate=0.03).fit(row, col, x[:, :5].reshape(-1), grade, weight)
    return Model(weights, fitted.weights, -float(fitted.thresholds[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and clauses (how many matched) for every row of ``docs`` (doc_id, text, and more)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.coefficients, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        lexicon = Lexicon(own.weights)
        for b in batches:
            rows = np.array([describe((b.column(1)[i].as_py() or "").lower(), lexicon) for i in range(b.num_rows)]).reshape(-1, 5)
            value = own.score(rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value), pa.array((value >= PREDICT).astype(np.int32)), pa.array(np.rint(np.expm1(rows[:, 3])).astype(np.int64))], names=["doc_id", "score", "predicted", "clauses"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, clauses long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the labels outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "clauses")
