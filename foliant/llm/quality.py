"""Quality by a sparse ensemble of rules (Friedman and Popescu's RuleFit) over statistics of the text.

Shallow boosted trees are grown on labelled documents; each path from a root is a conjunctive rule over statistics.
A logistic regression with an L1 penalty weights the rules and drops most. The rules left are compiled into a Spark
column expression, so documents are scored by built-in functions only.

Trees and weights are fitted on the driver from the statistics (never the texts) of at most ``TRAIN_ROWS`` labelled
documents, those whose key has a low hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import boxed, bucket_of, forget, path_of, sampled, settled

TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1
TREES, DEPTH, LEAST_LEAF, CUTS = 60, 3, 20, 32
MOST_RULES = 250


SPACES = " \t\n\x0b\x0c\r"
LONG_WORD = 20
#: Patterns whose matches are counted.
COUNTED = {
    "capitals": r"\b\p{Lu}[\p{Lu}\p{Nd}]+\b", "initials": r"\b\p{Lu}\p{Ll}", "digits": r"[0-9]+", "signs": r"[%$&*#|<>{}=^~+@_\\/]+", "shouts": r"[!?]+",
    "sentences": r"[.!?](?:[\x20\x09-\x0D]|$)", "commas": r"[,;:]",
}
NAMES = ("chars", "words", "lines", *COUNTED, "longs", "twins", "kinds", "line_kinds")


def words_of(text: Column) -> Column:
    """The words of a whole text, none for a null or empty one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a whole text by built-in functions, given its words as a column; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    twins = F.zip_with(F.slice(words, F.lit(2), F.size(words)), words, lambda a, b: a == b)  # the last has no successor: null
    found = {
        "chars": F.char_length(t), "words": F.size(words), "lines": F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"))) + 1,
        **{k: F.regexp_count(t, F.lit(p)) for k, p in COUNTED.items()}, "longs": F.size(F.filter(words, lambda w: F.char_length(w) > LONG_WORD)),
        "twins": F.size(F.filter(twins, lambda x: F.coalesce(x, F.lit(False)))), "kinds": F.size(F.array_distinct(words)), "line_kinds": F.size(F.array_distinct(F.split(t, r"\n"))),
    }
    return {k: v.cast("double") for k, v in found.items()}


def shares(raw: dict[str, Column]) -> dict[str, Column]:
    """What rules are made of, from columns that hold ``statistics``."""
    words, lines = F.greatest(raw["words"], F.lit(1.0)), F.greatest(raw["lines"], F.lit(1.0))
    out = {f"{k}_per_word": raw[k] / words for k in ("capitals", "initials", "digits", "signs", "shouts", "sentences", "commas", "longs", "twins", "kinds")}
    return out | {"chars": raw["chars"], "words": raw["words"], "word_length": raw["chars"] / words, "line_words": raw["words"] / lines, "line_kinds": raw["line_kinds"] / lines}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column _stat; the words and each statistic are computed once."""
    raw = docs.withColumn("_words", words_of(F.col(text)))
    raw = raw.withColumn("_raw", F.struct(*[c.alias(k) for k, c in statistics(F.col(text), F.col("_words")).items()])).drop("_words")
    own = {k: F.col(f"_raw.{k}") for k in NAMES}
    return raw.withColumn("_stat", F.struct(*[c.alias(k) for k, c in shares(own).items()])).drop("_raw")


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold)


class Ensemble:
    """Weighted rules and a bias; ``score`` is the column 1 / (1 + exp(-(bias + sum of the weights of rules that hold)))."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]]):
        self.bias, self.rules = bias, rules

    def score(self, stat: str = "_stat") -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule:
                x = F.col(f"{stat}.{name}")
                holds = holds & ((x > F.lit(cut)) if above else (x <= F.lit(cut)))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, rng) -> tuple[list, np.ndarray]:
    """A regression tree on ``residual`` by squared error: (paths to its nodes, its prediction)."""
    paths, out = [], np.zeros(len(residual))

    def split(rows, path, depth):
        out[rows] = residual[rows].mean()
        if path:
            paths.append(tuple(path))
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF:
            return
        best = (1e-9, None, None)
        total, n = residual[rows].sum(), len(rows)
        for f in rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)]:
            m = len(cuts[f]) + 1
            cnt = np.cumsum(np.bincount(binned[rows, f], minlength=m))[:-1]
            low = np.cumsum(np.bincount(binned[rows, f], weights=residual[rows], minlength=m))[:-1]
            ok = (cnt >= LEAST_LEAF) & (n - cnt >= LEAST_LEAF)
            if ok.any():
                gain = np.where(ok, low**2 / np.maximum(cnt, 1) + (total - low) ** 2 / np.maximum(n - cnt, 1) - total**2 / n, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            return
        _, f, k = best
        below = binned[rows, f] <= k
        split(rows[below], [*path, (int(f), False, float(cuts[f][k]))], depth + 1)
        split(rows[~below], [*path, (int(f), True, float(cuts[f][k]))], depth + 1)

    split(np.arange(len(residual)), [], 0)
    return paths, out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient; the bias is not penalised."""
    n, k = a.shape
    own, ones = a.T @ a, a.sum(axis=0)
    gram = np.block([[np.array([[float(n)]]), ones[None, :]], [ones[:, None], own]])
    step = 4 * n / float(np.linalg.eigvalsh(gram.astype(np.float64))[-1])
    bias, w = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5)), np.zeros(k)
    b2, w2, t = bias, w.copy(), 1.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(b2 + a @ w2.astype(a.dtype), -40, 40))) - y) / n
        new_b, new_w = b2 - step * g.sum(), w2 - step * (a.T @ g.astype(a.dtype))
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        b2, w2 = new_b + (t - 1) / t2 * (new_b - bias), new_w + (t - 1) / t2 * (new_w - w)
        moved = max(abs(new_b - bias), float(np.abs(new_w - w).max(initial=0.0)))
        bias, w, t = new_b, new_w, t2
        if moved < 1e-4:
            break
    return float(bias), w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 4) -> Ensemble:
    """A rule ensemble from statistics ``x`` (a row per document) and 0/1 labels ``y``; one class only: no rules."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble(math.log(p / (1 - p)), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    margin, paths = np.full(len(y), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), {}
    for _ in range(TREES):
        some = rng.random(len(y)) < 0.6
        p = 1 / (1 + np.exp(-margin))
        own, _ = grow(x[some], (y - p)[some], cuts, binned[some], rng)
        if not own:
            break
        tree, out = grow(x, y - p, cuts, binned, rng)
        margin = margin + 1.5 * out
        for path in [*own, *tree]:
            paths.setdefault(tuple(sorted(path)), None)
    rules = list(paths)
    seen: dict[bytes, tuple[float, Rule, np.ndarray]] = {}
    for r in rules:  # one rule for each set of documents, a bit a document
        hold = np.logical_and.reduce([(x[:, f] > c) == above for f, above, c in r])
        share = hold.mean()
        if 0 < share < 1:
            link = abs(y[hold].mean() - y.mean()) * math.sqrt(share / (1 - share))  # the correlation, but for a constant
            seen.setdefault(np.packbits(hold).tobytes(), (link, r, np.packbits(hold)))
    best_rules = sorted(seen.values(), key=lambda v: (-v[0], v[1]))[:MOST_RULES]
    if not best_rules:
        return Ensemble(float(margin.mean()), [])
    rules = [r for _, r, _ in best_rules]
    holds = np.stack([np.unpackbits(bits, count=len(y)) for _, _, bits in best_rules], axis=1).astype(np.float32)
    test = rng.random(len(y)) < 0.25
    best = (np.inf, 1e-3)
    for penalty in (1e-2, 3e-3, 1e-3, 3e-4):
        if test.any() and not test.all():
            b, w = lasso(holds[~test], y[~test], penalty, 200)
            z = np.clip(b + holds[test] @ w, -40, 40)
            loss = np.mean(np.log1p(np.exp(-np.where(y[test] == 1, z, -z))))
            best = min(best, (loss, penalty))
    bias, w = lasso(holds, y, best[1])
    return Ensemble(bias, [(tuple((names[f], above, c) for f, above, c in r), v) for r, v in zip(rules, w) if abs(v) > 1e-4])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_ROWS) -> Ensemble:
    """A rule ensemble from about ``most`` labelled rows at most whose key is not in the held-out fold.

    A key that has both labels counts as 0; rows of ``docs`` that share a key all learn from its label. Null keys and labels
    teach nothing, null texts count as empty. One class only, or no labels: no rules, the score is the share of that class.
    Only key, text and label are read, so extra columns of any name may be there.
    """
    fold = bucket_of(F.col("_key"), FOLDS)
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_y")).where(F.col("_key").isNotNull() & F.col("_y").isNotNull() & (fold != HELD_OUT))
    known = settled(known.groupBy("_key").agg(F.min("_y").alias("_y")), "quality-labels")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sampled(known, F.col("_key"), most)), "_key")  # at most ``most`` keys
    rows = with_statistics(rows, "_text").select("_y", "_stat.*").toArrow()  # a few numbers a row
    forget(docs.sparkSession, path_of(known))
    names = list(shares({k: F.lit(0.0) for k in NAMES}))
    x = np.stack([rows[n].to_numpy() for n in names], axis=1) if rows.num_rows else np.zeros((0, len(names)))
    y = (rows["_y"].to_numpy() == 1).astype(float)
    order = np.lexsort((y, *x.T))  # whatever the order of the rows
    return fit(x[order], y[order], names)


def scored(docs: DataFrame, ensemble: Ensemble, text: str = "text") -> DataFrame:
    """Rows (_row: the row of ``docs``, score: 0 to 1, predicted: int), one per row of ``docs``.

    Null texts score as empty ones, texts are read whole, repeated rows score alike; extra columns stay in _row under any
    name. Empty tables give no rows.
    """
    out = with_statistics(boxed(docs, text=F.col(text)), "text").select("_row", ensemble.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
