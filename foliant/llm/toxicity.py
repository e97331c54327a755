"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

Folding undoes homoglyphs, accents and digits or signs used as letters; what is left are words, one space apart. The
lexicon holds whole words and word beginnings, weighted by the log odds of being in a toxic document, learned from
labels. Of the entries that match at one place the heaviest counts. Exception phrases (two words with one of them in
the lexicon, seen in clean documents instead) cancel the matches in them. The score is a logistic function of the
weight found and of that weight per word.

At most ``TRAIN_ROWS`` labelled documents (those whose key has a low hash) are learned from. Their texts are gathered in
one pass and stored. Every entry and phrase in them is counted and weighed on the executors; only those that pass the
thresholds are collected, and all of them are kept.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import boxed, bucket_of, forget, path_of, prepare, sampled, settled, unboxed
from foliant.llm.pii import FOLD

TRAIN_ROWS = 60_000
#: Tasks that the labelled texts are dealt to.
TRAIN_PARTS = 24
HELD_COUNTS = 200_000
LEAST_DOCS, LEAST_EVIDENCE = 6, 28.0
BEGINNINGS = (4, 5, 6)
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1

# Digits and signs that stand for letters; 1 stands for i or l.
LEET = {"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
LEET_SIGNS = {"@": "a", "$": "s", "!": "i"}
ONE = "il"
#: Ones in a word up to which every mix of readings is tried; beyond it all are read alike.
MOST_ONES = 3

# between letters, or before two letters at the start of a word
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])|(?<!\w)[@$!](?=[^\W\d_]{2})")
_WORDS = re.compile(r"[^\W_]+")


def _table() -> dict[int, str | None]:
    table = {k: v and LEET.get(v.lower(), v.lower()) for k, v in FOLD.items()}
    for c in range(0xC0, 0x250):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if plain and plain.isascii():
            table[c] = plain
    table |= {c: None for c in range(0x300, 0x370)}
    return table | {ord(k): v for k, v in LEET.items()}


TABLE = _table()
#: What folding drops, or turns from a sign to a letter or back: it moves the ends of words.
_MOVES = {c: v for c, v in TABLE.items() if not v or bool(_WORDS.fullmatch(v)) != bool(_WORDS.fullmatch(chr(c)))}
_MOVING = re.compile("[" + "".join(map(re.escape, map(chr, _MOVES))) + "]")


def words(text: str | None, reading=lambda w: w.replace("1", ONE[0])) -> list[str]:
    """The folded words of a whole text; ``reading`` says how a word with ones is read."""
    text = (text or "").lower()
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: LEET_SIGNS[m[0]], text)
    if not text.isascii() and _MOVING.search(text):
        text = text.translate(_MOVES)
    found = _WORDS.findall(text)
    for i, w in enumerate(found):
        if not w.isascii() or not w.isalpha():
            w = w.translate(TABLE)
            found[i] = reading(w) if "1" in w else w
    return found


def entries_in(found: set[str]) -> set[str]:
    """Lexicon entries that a document with these words has: "=word" and "^beginning"."""
    out = {"=" + w for w in found}
    for n in BEGINNINGS:
        out |= {"^" + w[:n] for w in found if len(w) > n}
    return out


class Lexicon:
    """Weights by entry, exception phrases (pairs of words), and the coefficients (bias, per log weight, per density)."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients=(-3.0, 1.0, 1.0)):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, tuple(coefficients)

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            form = f" {entry[1:]} " if entry[0] == "=" else f" {entry[1:]}"
            found.add_word(form, (len(form), w))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
            return found
        return None

    def reading(self, word: str) -> str:
        """``word`` with its ones read so that the heaviest entry matches; as i where none does."""
        n = word.count("1")
        mixes = itertools.product(ONE, repeat=n) if n <= MOST_ONES else [x * n for x in ONE]
        forms = ["".join(itertools.chain(*itertools.zip_longest(word.split("1"), mix, fillvalue=""))) for mix in mixes]
        return max(forms, key=lambda w: max((self.weights.get(e, 0.0) for e in entries_in({w})), default=0.0))

    def features(self, automaton, text: str | None) -> tuple[float, float]:
        """(log(1 + weight), weight per word) of a text; an empty one has none."""
        found = words(text, self.reading)
        if not found or automaton is None:
            return 0.0, 0.0
        at, spared = {}, []
        for end, (n, w) in automaton.iter(f" {' '.join(found)} "):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif at.get(start, 0.0) < w:
                at[start] = w
        if spared:
            spared.sort()
            reach, i = -1, 0
            for start in sorted(at):
                while i < len(spared) and spared[i][0] <= start:
                    reach = max(reach, spared[i][1])
                    i += 1
                if start < reach:
                    del at[start]
        total = sum(at.values())
        return math.log1p(total), total / (len(found) + 20)

    def score(self, x: tuple[float, float]) -> float:
        b, a1, a2 = self.coefficients
        z = b + a1 * x[0] + a2 * x[1]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _evidence(a, b, n1, n0):
    """Log-likelihood ratio of a in n1 against b in n0."""
    def ll(k, n, p):
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (a + b) / (n1 + n0)
    return 2 * (ll(a, n1, a / n1) + ll(b, n0, b / n0) - ll(a, n1, p) - ll(b, n0, p)) if 0 < p < 1 else 0.0


def _weight(a, b, n1, n0):
    return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))


def _counts(batches, count):
    """Rows (entry, a, b): in how many toxic and clean documents; counts are handed on before they fill the memory."""
    found = {True: Counter(), False: Counter()}

    def flush():
        a, b = found[True], found[False]
        entries = list(a.keys() | b.keys())
        columns = [pa.array(entries, pa.string()), pa.array([a[e] for e in entries], pa.int64()), pa.array([b[e] for e in entries], pa.int64())]
        a.clear()
        b.clear()
        return pa.RecordBatch.from_arrays(columns, names=["entry", "a", "b"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[toxic].update(count(text))
            if len(found[True]) + len(found[False]) >= HELD_COUNTS:
                yield flush()
    if found[True] or found[False]:
        yield flush()


def _counted(texts: DataFrame, count) -> DataFrame:
    """Rows (entry, a, b) of what ``count`` finds in ``texts`` (toxic, text), summed over all tasks."""
    rows = texts.mapInArrow(lambda it: _counts(it, count), "entry string, a long, b long")
    return rows.groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _passing(batches, weigh):
    """Rows (entry, w) of counted entries to which ``weigh`` gives a weight."""
    for batch in batches:
        found = [(e, weigh(a, b)) for e, a, b in zip(*(c.to_pylist() for c in batch.columns))]
        found = [(e, w) for e, w in found if w is not None]
        yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], pa.string()), pa.array([w for _, w in found], pa.float64())], names=["entry", "w"])


def _weighed(counted: DataFrame, weigh) -> dict[str, float]:
    rows = counted.mapInArrow(lambda it: _passing(it, weigh), "entry string, w double").collect()
    return {r["entry"]: r["w"] for r in sorted(rows)}


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from about ``most`` labelled rows at most whose key is in no held-out fold.

    A key that has both labels counts as toxic; rows of ``docs`` that share a key all learn from its label. Null keys and
    labels teach nothing, null texts have no words. Without rows of both classes the lexicon is empty. Only key, text
    and label are read, so extra columns of any name may be there.
    """
    spark = docs.sparkSession
    prepare(spark)
    fold = bucket_of(F.col("_key"), FOLDS)
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_y")).where(F.col("_key").isNotNull() & F.col("_y").isNotNull() & (fold != HELD_OUT))
    known = settled(known.groupBy("_key").agg(F.max("_y").alias("_y")), "toxicity-labels")
    chosen = sampled(known, F.col("_key"), most).select("_key", (F.col("_y") == 1).alias("toxic"), (fold == CALIBRATION).alias("_held"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")  # at most ``most`` keys
    rows = settled(rows.repartition(TRAIN_PARTS, "_key").select("toxic", "_held", "_text"), "toxicity-texts", drop=[path_of(known)])
    try:
        return _learned(rows)
    finally:
        forget(spark, path_of(rows))


def _learned(rows: DataFrame) -> Lexicon:
    """The lexicon of stored rows (toxic, _held, _text)."""
    size = {r["toxic"]: r["count"] for r in rows.where("not _held").groupBy("toxic").count().collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        return Lexicon({}, [])
    rest = rows.where("not _held").select("toxic", "_text")

    def weight(a, b):
        w = _weight(a, b, n1, n0)
        return w if w >= 1.5 and _evidence(a, b, n1, n0) >= LEAST_EVIDENCE else None

    weights = _weighed(_counted(rest, lambda t: entries_in(set(words(t)))).where(F.col("a") >= LEAST_DOCS), weight)

    def phrases(t):
        found = words(t)
        known: dict[str, bool] = {w: bool(weights.keys() & entries_in({w})) for w in set(found)}
        hit = [known[w] for w in found]
        return {f"{a} {b}" for a, b, x, y in zip(found, found[1:], hit, hit[1:]) if x or y}

    def spared(a, b):
        w = _weight(a, b, n1, n0)
        return w if w < -0.7 else None

    exceptions = list(_weighed(_counted(rest, phrases).where(F.col("b") >= LEAST_DOCS), spared)) if weights else []

    lexicon = Lexicon(weights, exceptions)
    held = rows.where("_held").select(F.col("toxic").cast("int"), "_text")
    found = held.mapInArrow(lambda it: _features(it, lexicon), "y int, x1 double, x2 double").toArrow()  # at most TRAIN_ROWS rows
    if found.num_rows:
        x = np.stack([found["x1"].to_numpy(), found["x2"].to_numpy()], axis=1)
        order = np.lexsort((found["y"].to_numpy(), *x.T))  # whatever the order of the rows
        lexicon.coefficients = _logistic(x[order], found["y"].to_numpy()[order].astype(float))
    return lexicon


def _features(batches, lexicon):
    automaton = lexicon.automaton()
    for batch in batches:
        x = [lexicon.features(automaton, t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["y", "x1", "x2"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Logistic coefficients (bias first), the others not negative, by projected gradient steps on scaled features."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    a = np.c_[np.ones(len(x)), x / scale]
    w = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0])
    step = 4 / np.linalg.norm(a.T @ a / len(a), 2)
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        w = w - step * (a.T @ (p - y) / len(a) + ridge * np.r_[0, w[1:]] * 0.01)
        w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), float(w[1] / scale[0]), float(w[2] / scale[1])


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Rows (_row: the row of ``docs``, score: 0 to 1, predicted: int), one per row of ``docs``.

    Null and empty texts score as having no match. Texts are read whole; work is in proportion to their length. Repeated
    rows score alike; extra columns stay in _row under any name. Empty tables give no rows.
    """
    prepare(docs.sparkSession)

    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            score = [lexicon.score(lexicon.features(automaton, t)) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "score", "predicted"])

    rows = boxed(docs, text=F.col(text))
    schema = T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the lexicon learned from ``labels`` calls toxic; all columns stay. No labels: all rows stay."""
    return unboxed(scored(docs, learn(docs, labels)).where("predicted = 0"))
