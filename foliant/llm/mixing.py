"""Mixing sources to target weights: certain whole copies, then Pareto order sampling. DataFrame operations only.

A source's target is a share of all words. Targets follow the weights, but stop at ``max_repeats`` times the source's
own words; the excess is shared again by weight among the others until none is above.

Of each document of a source, floor(target / source words) copies are certain. What is left of the target goes to an
unequal-probability sample: a document's inclusion probability is p = min(1, level * z), z its size measure (the square
root of its size, the size cut to its two leading digits), the level such that the words expected are the words left.
Pareto sampling ranks documents by q = [u / (1 - u)] / [p / (1 - p)], u a hash of the document, and takes the lowest; those
with p = 1 come first. The sample's size is fixed in words: it stops where the words taken come nearest to the words left,
so a source misses its target by half a document at most.

Probabilities are solved on sums by source and measure: 1,710 rows a source at most, whatever the rows. The cut is
found without sorting a source: q is mapped to [0, 1), counted in ``CELLS`` cells per source, then again in ``CELLS`` parts
of the cell in which the cut lies; only that part's rows (N / CELLS**2 of a source) are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import boxed, forget, path_of, settled, small_or_shuffled, unboxed

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: float = 3.0) -> DataFrame:
    """Targets of ``sources`` (source, source_size): adds weight and target.

    Sources go by code point, null last, and take the weights in turn. A row per source, so one window over all of
    them is small. With the caps c = max_repeats * size, the final targets are min(c, level * weight): the level is
    the highest at which a source, taken by c / weight, can no longer be filled by the words left.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    array = F.array(*[F.lit(float(w)) for w in weights])
    out = sources.withColumn("weight", F.element_at(array, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    out = out.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    filled = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy().orderBy(F.lit(1)).rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("level", (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everyone)
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return out.withColumn("target", target).select("source", "source_size", "weight", "target")


def size_class(size: Column) -> Column:
    """``size`` cut to its two leading digits, 1 at least: at most 90 classes for each number of digits."""
    unit = F.pow(F.lit(10.0), F.greatest(F.length(size.cast("string")) - 2, F.lit(0))).cast("long")
    return F.greatest(F.floor(size / unit) * unit, F.lit(1)).cast("long")


def inclusion(classes: DataFrame) -> DataFrame:
    """Adds p to (source, class, words, left): p = min(1, level * sqrt(class)), words by p expected as many as are left.

    Classes that hold p = 1 are the largest. If the classes before one hold p = 1 and it does not, the level is the words
    left beyond them over the sum of words * sqrt(class) from it on; the largest class that fits says the level.
    """
    z = F.sqrt(F.col("class").cast("double"))
    by_size = Window.partitionBy("source").orderBy(F.col("class").desc())
    filled = F.coalesce(F.sum("words").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * z).over(by_size.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = classes.withColumn("own", F.when(rest > 0, F.greatest(F.lit(0.0), F.col("left") - filled) / rest))
    fits = F.when(F.col("own") * z <= 1, F.struct("class", "own"))
    level = F.max(fits).over(Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    p = F.when(F.col("left") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(level["own"] * z, F.lit(1.0))))
    return rows.withColumn("p", p).drop("own")


def _before(cells: DataFrame, part: list[str], order: str) -> DataFrame:
    """Adds the words that lie before each cell of ``part``."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))


def mix(
    docs: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeats: float = 3.0,
    seed: int = 8,
) -> DataFrame:
    """Rows (_row: the row of ``docs``, size, source_size, target (double), copies, taken).

    ``size`` is an expression over ``docs``. Null sources are a source of their own. A row's place in the draw is a
    hash of its key, or of its text where the key is null; rows that agree in it and in size are drawn together, so reruns
    agree whatever the partitions. Texts are counted whole. No rows or no words at all: targets and copies are 0. Extra
    columns stay in _row under any name.
    """
    sized = boxed(docs, source=F.col(source), size=size, u=uniform(F.col(key), F.col(text), seed))
    sized = sized.withColumn("class", size_class(F.col("size")))
    rows = settled(sized.select("source", "size", "class", "u"), "mix-rows")

    classes = settled(rows.groupBy("source", "class").agg(F.sum("size").alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("certain", F.floor(expected + F.lit(1e-12)).cast("long"))
    targets = settled(targets.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size"))), "mix-targets")
    shares = classes.alias("r").join(small_or_shuffled(targets).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    shares = inclusion(shares.select("r.source", "r.class", "r.words", "t.source_size", "t.target", "t.certain", "t.left"))
    shares = settled(shares.drop("words"), "mix-shares")

    able = small_or_shuffled(shares.where("p > 0"))
    drawn = rows.alias("r").join(able.alias("s"), _same("r", "s", "class")).select("r.source", "r.size", "r.u", "s.p", "s.left")
    drawn = _placed(drawn)
    first = _before(drawn.groupBy("source", "coarse", "left").agg(F.sum("size").alias("words")), ["source"], "coarse")
    cut = settled(first.where("before <= left and left < before + words").select("source", "coarse", F.col("before").alias("base")), "mix-cut")
    near = drawn.alias("r").join(small_or_shuffled(cut).alias("c"), _same("r", "c", "coarse")).select("r.*", "c.base")
    second = _before(near.groupBy("source", "fine", "left", "base").agg(F.sum("size").alias("words")), ["source"], "fine")
    second = second.where("base + before <= left and left < base + before + words")
    second = settled(second.select("source", "fine", (F.col("base") + F.col("before")).alias("base")), "mix-cut")
    last = drawn.alias("r").join(small_or_shuffled(second).alias("c"), _same("r", "c", "fine"))
    last = last.groupBy("r.source", "r.place", "r.left", "c.base").agg(F.sum("r.size").alias("words"))
    last = _before(last, ["source"], "place").where("base + before + words / 2 <= left")
    last = last.groupBy("source").agg(F.max("place").alias("last_place"))
    edges = second.alias("s").join(last.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left").select("s.source", F.col("s.fine").alias("edge"), "l.last_place")
    rules = shares.alias("t").join(edges.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    rules = settled(rules.select("t.source", "t.class", "t.source_size", "t.target", "t.certain", "t.p", "t.left", "e.edge", "e.last_place"), "mix-rules")
    for done in (rows, classes, targets, shares, cut, second):
        forget(docs.sparkSession, path_of(done))
    rules = small_or_shuffled(rules.select(*[F.col(c).alias(f"_m_{c}") for c in rules.columns]))

    out = sized.join(rules, F.col("source").eqNullSafe(F.col("_m_source")) & (F.col("class") == F.col("_m_class")), "left")
    place = _place(F.col("u"), F.col("_m_p"))
    drawn = (_fine(place) < F.col("_m_edge")) | (place <= F.coalesce(F.col("_m_last_place"), F.lit(-1.0)))
    drawn = F.when(F.col("_m_p") <= 0, False).when(F.col("_m_edge").isNull(), F.col("_m_left") > 0).otherwise(drawn)
    copies = F.coalesce(F.col("_m_certain"), F.lit(0)) + drawn.cast("long")
    total, target = F.coalesce("_m_source_size", F.lit(0)).cast("long"), F.coalesce("_m_target", F.lit(0.0))
    out = out.select("_row", "size", total.alias("source_size"), target.alias("target"), copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1 from the first 13 hexadecimal digits of an MD5 digest: any engine gives the same."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))))
    return (F.conv(F.left(F.md5(name.cast("binary")), F.lit(13)), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _place(u: Column, p: Column) -> Column:
    """q / (1 + q) of the Pareto rank q: it keeps the order and lies in [0, 1)."""
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.when((p > 0) & (p < 1), odds / (1 + odds)).otherwise(F.lit(0.0))


def _fine(place: Column) -> Column:
    return F.least(F.floor(place * F.lit(float(CELLS * CELLS))), F.lit(CELLS * CELLS - 1)).cast("long")


def _placed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("place", _place(F.col("u"), F.col("p"))).withColumn("fine", _fine(F.col("place")))
    return rows.withColumn("coarse", F.floor(F.col("fine") / CELLS).cast("long"))


def _same(a: str, b: str, cell: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.{cell}") == F.col(f"{b}.{cell}"))


def copied(docs: DataFrame, size: Column) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies, with the columns it came with.

    Rows of no words share their source's certain copies and its draw, as rows of one word do. Empty tables give no rows.
    """
    out = mix(docs, size).where("copies > 0")
    return unboxed(out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
