"""Ranked search: field-weighted BM25, year and class filters, exact and fuzzy re-ranking, relevance from 0 to 100.

Two plans give the same scores. ``bm25`` reads documents once: a phrase's weighted frequency is a row-wise expression, so
the only exchange is the one-row aggregate of corpus statistics. ``bm25_indexed`` reads the inverted index
(``operators.inverted``): prefixes are literal filters that reach the scan of postings sorted by term.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.functions.fuzzy import fuzzy_score, may_pass, rapid_installed
from foliant.functions.querytext import index_prefixes, parse_year_range, split_terms
from foliant.functions.stem import porter
from foliant.functions.text import BEGIN, TOKEN, blank_if_null, fold_text, tokens
from foliant.shared import send_code, settled

RESULT_COLUMNS = ("id", "path", "filename", "title", "authors", "year", "abstract", "keywords", "preview", "doi", "arxiv_id")
FALLBACK_FIELDS = ("title", "keywords", "abstract", "authors", "fulltext")
FUZZY_FIELDS, FUZZY_CHARS, FUZZY_GATE = ("title", "abstract", "keywords"), 500, 60.0
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def year_filter(bounds: tuple[int, int] | None) -> Column:
    """Inclusive; blank years count as 0."""
    return F.lit(True) if bounds is None else F.col("year_int").between(*bounds)


def idf(n_docs: Column, n_hits: Column) -> Column:
    return F.greatest(F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5)), F.lit(LEAST_IDF))


def term_score(weight: Column, frequency: Column, length: Column, mean_length: Column) -> Column:
    return weight * frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / mean_length))


def begun(lowered: Column, prefix: str) -> Column:
    """How many words of a lower-cased text begin with ``prefix``; a prefix of letters and digits is counted where it stands."""
    if re.fullmatch("[0-9a-z]+", prefix):
        return F.regexp_count(lowered, F.lit(f"(?={prefix}){BEGIN}{prefix}"))
    return F.size(F.filter(tokens(lowered), lambda w: F.startswith(w, F.lit(prefix))))


def bm25(docs: DataFrame, prefixes: list[str], weights: dict[str, float], key: str = "id") -> DataFrame:
    """Rows (key, bm25) of the documents with a word that starts with one of ``prefixes``; words are not stemmed.

    Statistics are over all of ``docs``; a prefix is one phrase, whose frequency sums every word it begins.
    """
    names = list(weights)
    texts = docs.select(key, *[F.lower(blank_if_null(F.col(c))).alias(c) for c in names])
    frequencies = [reduce(lambda a, b: a + b, [F.lit(weights[c]) * begun(F.col(c), p.lower()) for c in names]).alias(f"f{i}") for i, p in enumerate(prefixes)]
    rows = texts.select(key, reduce(lambda a, b: a + b, [F.regexp_count(F.col(c), F.lit(TOKEN)) for c in names]).cast("double").alias("length"), *frequencies)
    rows = settled(rows, "bm25-rows")  # a few numbers a document; read for the statistics and for the scores, so texts are read once
    about = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(prefixes))])
    scored = rows.crossJoin(F.broadcast(about))  # one row
    parts = [term_score(idf(F.col("n"), F.col(f"n{i}")), F.col(f"f{i}"), F.col("length"), F.col("mean")) for i in range(len(prefixes))]
    # a score over 0 says that some word matched; a filter on frequencies would sink to the scan and tokenise twice
    return scored.select(key, F.coalesce(reduce(lambda a, b: a + b, parts), F.lit(0.0)).alias("bm25")).where("bm25 > 0")


def bm25_indexed(postings: DataFrame, doc_stats: DataFrame, corpus: DataFrame, stems: list[str], weights: dict[str, float]) -> DataFrame:
    """Rows (doc_id, bm25) from the inverted index, for prefixes of stored terms."""
    weight = reduce(lambda c, kv: c.when(F.col("field") == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    begins = [F.col("term").startswith(p) for p in stems]
    # one scan of the terms that any prefix begins; a term counts for each prefix of its own
    rows = postings.where(reduce(lambda a, b: a | b, begins)).select("doc_id", (weight * F.col("tf")).alias("f"), F.explode(F.array_compact(F.array(*[F.when(b, i) for i, b in enumerate(begins)]))).alias("phrase"))
    found = settled(rows.groupBy("doc_id", "phrase").agg(F.sum("f").alias("f")), "bm25-found")  # read for the counts and for the scores
    counts = found.groupBy("phrase").agg(F.count("*").alias("hits"))  # a row per phrase of the query
    rows = found.join(F.broadcast(counts), "phrase").join(doc_stats, "doc_id").crossJoin(F.broadcast(corpus))
    one = term_score(idf(F.col("n_docs"), F.col("hits")), F.col("f"), F.col("n_tokens"), F.col("avg_tokens"))
    return rows.groupBy("doc_id").agg(F.sum(one).alias("bm25"))


def candidates(scores: DataFrame, papers: DataFrame, settings: Settings, top_n: int = 30, years=None, key: str = "id") -> DataFrame:
    """The best candidates by BM25 with position (0 first) and total; ties go to the smaller id. Filters come first.

    The best are found on keys and filtered columns alone; only then are the records of those few read.
    """
    return records(papers, *best_keys(scores, papers, settings, top_n, years, key), key)


def best_keys(scores: DataFrame, papers: DataFrame, settings: Settings, top_n: int = 30, years=None, key: str = "id") -> tuple[DataFrame, list]:
    """The best candidates (key, bm25) and their keys, of which a limit holds few."""
    kept = papers.where(year_filter(parse_year_range(years)))
    if settings.require_scholarly:
        kept = kept.where("is_scholarly = 1")
    limit = max(settings.candidate_limit, 10 * top_n)
    best = kept.select(key).join(scores, key).orderBy(F.round("bm25", 6).desc(), key).limit(limit)
    best = settled(best, "candidates")  # ``limit`` rows, asked for their keys and joined
    return best, [r[key] for r in best.select(key).collect()]


def records(papers: DataFrame, best: DataFrame, keys: list, key: str = "id") -> DataFrame:
    """The records of the ``best`` with position (0 first) and total."""
    rows = papers.where(F.col(key).isin(keys)).join(F.broadcast(best), key)  # the keys reach the scan
    return positioned(rows, [F.round("bm25", 6).desc(), F.col(key)])


def positioned(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds position and total to rows that a limit has bounded."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("total", F.count("*").over(Window.partitionBy()))


def substring_hits(papers: DataFrame, terms: list[str], settings: Settings, top_n: int = 30, years=None) -> DataFrame:
    """The scan that answers when the index finds nothing: any term within any field, by id."""
    kept = papers.where(year_filter(parse_year_range(years)))
    if settings.require_scholarly:
        kept = kept.where("is_scholarly = 1")
    within = [F.contains(F.lower(blank_if_null(F.col(f))), F.lit(t)) for t in terms for f in FALLBACK_FIELDS]
    rows = kept.where(reduce(lambda a, b: a | b, within)).orderBy("id").limit(max(settings.candidate_limit, 10 * top_n))
    return positioned(rows, [F.col("id")])


def exact_bonus(terms: list[str], weights: dict[str, float]) -> Column:
    """100 times the weight of each field that holds a term, for each term, repeats counted."""
    parts = [F.when(F.contains(F.lower(blank_if_null(F.col(f))), F.lit(t)), F.lit(100.0 * w)).otherwise(F.lit(0.0)) for t in terms for f, w in weights.items()]
    return reduce(lambda a, b: a + b, parts)


def fuzzy_bonus(terms: list[str], weights: dict[str, float], rapid: bool | None = None):
    """A pandas UDF over the fuzzy fields: half the weight times the similarity, where no exact match counts.

    ``rapid``: score by rapidfuzz; by default where it is installed.
    """
    rapid = rapid_installed() if rapid is None else rapid
    send_code(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())

    @F.pandas_udf("double")
    def bonus(title: pd.Series, abstract: pd.Series, keywords: pd.Series) -> pd.Series:
        out = []
        for row in zip(title, abstract, keywords):
            total = 0.0
            for t in terms:
                for name, value in zip(FUZZY_FIELDS, row):
                    value = value or ""
                    if t in value.lower():
                        continue
                    value = value[:FUZZY_CHARS]
                    if rapid or may_pass(len(t), len(value), FUZZY_GATE):
                        score = fuzzy_score(t, value, rapid)
                        if score > FUZZY_GATE:
                            total += weights[name] * score * 0.5
            out.append(total)
        return pd.Series(out, dtype=float)

    return bonus


def relevance(rows: DataFrame, bonus: Column, top_n: int = 30) -> DataFrame:
    """Candidates by base (total - position) plus bonus, the best ``top_n`` with relevance; ties keep their order."""
    scored = rows.withColumn("score", F.col("total") - F.col("position") + bonus)
    best = F.greatest(F.max("score").over(Window.partitionBy()), F.lit(1.0))
    scored = scored.withColumn("relevance", F.least(F.lit(100), F.floor(F.col("score") / best * 100)).cast("int"))
    return scored.orderBy(F.col("score").desc(), "position").limit(top_n)


def stems_of(query: str) -> list[str]:
    """The stored terms whose beginnings a query asks the index for."""
    return list(dict.fromkeys(porter(fold_text(p.lower())) for p in index_prefixes(split_terms(query))))


def search(papers: DataFrame, query: str, years=None, top_n: int = 30, settings: Settings = Settings(), fuzzy: bool = True, index: tuple | None = None) -> DataFrame:
    """Search ``papers``; result columns and relevance, best first.

    ``index``: (postings, doc_stats, corpus) of ``operators.inverted``; without it words are matched as they stand.
    Where the index finds nothing, the substring scan answers. A query without terms finds nothing.
    """
    terms = split_terms(query)
    if not terms:
        return papers.select(*RESULT_COLUMNS, F.lit(0).alias("relevance")).limit(0)
    prefixes, rows = index_prefixes(terms), None
    if prefixes:
        if index is None:
            scores = bm25(papers, prefixes, settings.bm25_weights)
        else:
            scores = bm25_indexed(*index, stems_of(query), settings.bm25_weights).withColumnRenamed("doc_id", "id")
        best, keys = best_keys(scores, papers, settings, top_n, years)
        rows = records(papers, best, keys) if keys else None  # whether there are any is known without reading records
    if rows is None:
        rows = substring_hits(papers, terms, settings, top_n, years)
    bonus = exact_bonus(terms, settings.rerank_weights)
    if fuzzy:
        bonus = bonus + fuzzy_bonus(terms, settings.rerank_weights)(*FUZZY_FIELDS)
    return relevance(rows, bonus, top_n).select(*RESULT_COLUMNS, "relevance")


def result_cards(results: DataFrame) -> DataFrame:
    """What a presenter shows of results: title or file name, up to six keyword chips, short DOI, band and bar width."""
    chips = F.filter(F.transform(F.slice(F.split("keywords", "[;,·]"), 1, 6), lambda x: F.trim(x)), lambda x: x != "")
    band = F.when(F.col("relevance") > 70, "high").when(F.col("relevance") > 40, "medium").otherwise("low")
    return results.select(
        "id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename")).alias("heading"), F.array_join(chips, "|").alias("chips"),
        F.left("doi", F.lit(40)).alias("doi"), band.alias("band"), F.greatest(F.lit(4), F.floor(F.col("relevance") * 88 / 100)).cast("int").alias("bar"),
    )


def pages_of(results: DataFrame, settings: Settings = Settings()):
    """Results in batches of ``render_batch`` rows, streamed to the driver."""
    batch = []
    for row in results.toLocalIterator():
        batch.append(row)
        if len(batch) == settings.render_batch:
            yield batch
            batch = []
    if batch:
        yield batch
