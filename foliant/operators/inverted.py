"""The inverted index: postings (term, doc_id, field, tf, positions), doc_stats (doc_id, n_tokens), corpus (n_docs, avg_tokens)."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.stem import porter
from foliant.functions.text import TOKEN, blank_if_null, fold, fold_text, spaced
from foliant.shared import send_code

FIELDS = ("title", "authors", "year", "abstract", "keywords", "fulltext")
#: Postings to an Arrow batch, stems that a task remembers, and texts that it is sent at once.
BATCH, REMEMBERED, TEXTS_AT_ONCE = 20_000, 200_000, 64


def _postings(batches, stem: bool, exact: frozenset | None, begins: tuple | None):
    """Postings of rows (doc_id, field, words one space apart): a text is counted where it lies, without any exchange.

    One text is split at a time, and what was counted leaves as soon as a batch is full.
    """
    known: dict[str, str | None] = {}
    some = exact is not None or begins is not None

    def term_of(word: str) -> str | None:
        term = porter(word) if stem else word
        return term if not some or (exact is not None and term in exact) or (begins is not None and term.startswith(begins)) else None

    for batch in batches:
        rows, terms, counts, places = [], [], [], array("i")

        def flush():
            at, ends = pa.array(rows, pa.int64()), np.concatenate([[0], np.cumsum(counts)])
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(places, np.int32)))
            columns = [pa.array(terms, pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array(counts, pa.int64()), held]
            return pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "field", "tf", "positions"])

        for i, text in enumerate(batch.column(2)):
            words = text.as_py()
            found: dict[str, list[int]] = {}
            for p, w in enumerate(words.split(" ") if words else ()):
                if stem or some:
                    term = known.get(w, known)
                    if term is known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        term = known[w] = term_of(w)
                    if term is None:
                        continue
                    w = term
                if w in found:
                    found[w].append(p)
                else:
                    found[w] = [p]
            rows.extend([i] * len(found))
            terms.extend(found)
            for own in found.values():
                counts.append(len(own))
                places.extend(own)
            if len(rows) >= BATCH:
                yield flush()
                rows, terms, counts, places = [], [], [], array("i")
        if rows:
            yield flush()


def postings(papers: DataFrame, key: str = "id", stem: bool = True, fields=FIELDS, exact=None, begins=None) -> DataFrame:
    """Postings; with ``stem``, words are folded and stemmed. Positions count the words of a field from 0.

    ``exact``, ``begins``: terms and beginnings of terms that are asked for; all texts are read, but postings of other terms
    need not leave the task. Texts reach Python a few at a time, so its memory depends on the longest, not on their number.
    """
    spark = papers.sparkSession
    send_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))
    own = lambda f: spaced(F.lower(fold(F.lower(blank_if_null(F.col(f))))) if stem else F.lower(blank_if_null(F.col(f))))
    parts = F.array(*[F.struct(F.lit(f).alias("field"), own(f).alias("words")) for f in fields])
    rows = papers.select(F.col(key).alias("doc_id"), F.explode(parts).alias("part")).select("doc_id", F.col("part.field").alias("field"), F.col("part.words").alias("words"))
    kinds = [("term", T.StringType()), ("doc_id", papers.schema[key].dataType), ("field", T.StringType()), ("tf", T.LongType()), ("positions", T.ArrayType(T.IntegerType()))]
    exact, begins = None if exact is None else frozenset(exact), None if begins is None else tuple(begins)
    return rows.mapInArrow(lambda it: _postings(it, stem, exact, begins), T.StructType([T.StructField(n, k) for n, k in kinds]))


def doc_stats(papers: DataFrame, key: str = "id", fields=FIELDS) -> DataFrame:
    """Tokens of each document over all fields; a row-wise expression, no exchange."""
    total = sum((F.regexp_count(blank_if_null(F.col(f)), F.lit(TOKEN)) for f in fields), F.lit(0))
    return papers.select(F.col(key).alias("doc_id"), total.cast("long").alias("n_tokens"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"))


def write(rows: DataFrame, folder: str) -> None:
    """Write postings ordered by term across files, so that a term or prefix reads few row groups."""
    rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/postings")


def phrase_terms(phrase: str) -> list[str]:
    """The stored terms of a phrase, in order: words folded and stemmed."""
    import regex

    return [porter(w) for w in regex.findall(TOKEN, fold_text(phrase.lower()))]


def _follow(found: Column, terms: list[str]) -> Column:
    """Whether one field of ``found`` (array of field, term, positions) holds the terms one after the other."""
    starts = None
    for j, term in enumerate(terms):
        # where the phrase would start, as field and position; places of a field never meet those of another
        own = F.flatten(F.transform(F.filter(found, lambda x: x["term"] == term), lambda x: F.transform(x["positions"], lambda p: F.struct(x["field"].alias("f"), (p - j).alias("p")))))
        starts = own if starts is None else F.array_intersect(starts, own)
    return F.size(starts) > 0


def with_phrases(postings: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(doc_id) of the documents that hold every phrase (stored terms in order) within a field of theirs.

    A phrase without terms is found nowhere; no phrases: no documents. Only the postings of these terms are read, and a
    document's meet in one row: as many as fields times terms.
    """
    wanted = sorted({t for p in phrases for t in p})
    if not phrases or not all(phrases):
        return postings.select("doc_id").limit(0)
    rows = postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.collect_list(F.struct("field", "term", "positions")).alias("found"))
    for p in phrases:
        rows = rows.where(_follow(F.col("found"), p))
    return rows.select("doc_id")


__all__ = ["FIELDS", "corpus_stats", "doc_stats", "phrase_terms", "postings", "with_phrases", "write"]
