"""A deterministic paper around each row of ``documents``, so that field extraction has something to find.

The same lines are built in Spark and, for the oracle, in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.functions.extract import AFTER_ABSTRACT, AFTER_KEYWORDS, MARKERS, REFERENCE_WORDS, SECTION_WORDS, fields
from foliant.shared import settled, spread

_W = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_WI = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
_LB = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_NOT_WC = r"[^\p{L}\p{N}_]"


def pages(spark: SparkSession, sf_dir: str, with_keywords: bool = False) -> DataFrame:
    """(doc_id, path, mtime, size, pages)."""
    i, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    word = i.cast("string")
    on = lambda n, line: F.when(i % n == 0, line)
    parts = [
        F.concat(F.lit("Paper number "), word, F.lit(" on text")), F.lit("Author One, Author Two"), on(3, F.concat(F.lit("doi 10.1234/abc."), word)),
        on(5, F.concat(F.lit("arXiv: 2101.0"), F.lpad(word, 4, "0"))), on(7, F.lit("Keywords: alpha; beta")) if with_keywords else F.lit(None).cast("string"),
        on(2, F.concat(F.lit("Abstract\n"), F.left(text, F.lit(200)), F.lit("\nIntroduction"))), F.concat(F.lit("Published "), (i % 90 + 1950).cast("string")),
        text, on(4, F.lit("References\n[1] x [2] y [3] z")),
    ]
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    path = F.concat(F.lit("docs/"), word, F.lit(".pdf"))
    return rows.select("doc_id", path.alias("path"), (i + 0.5).cast("double").alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.array(F.concat_ws("\n", *parts)).alias("pages"))


def papers(spark: SparkSession, sf_dir: str, with_keywords: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Records of the enveloped documents, extracted where they are read; id is doc_id."""
    out = fields(pages(spark, sf_dir, with_keywords), settings)
    return out.withColumnRenamed("doc_id", "id").withColumn("filename", F.element_at(F.split("path", "/"), -1)).drop("pages", "mtime")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records written once, for plans that read them more than once, as searches read a library's records."""
    # a preview is the beginning of a stored text, so it is cut when read
    rows = settled(papers(spark, sf_dir).drop("preview"), "papers")
    return rows.withColumn("preview", F.left("fulltext", F.lit(Settings().preview_chars)))


def clean_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_W}+', ' ', 'g'), ' ')"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def lines_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '{_LB}'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def title_sql(ls: str) -> str:
    no = r"(?i)^(https?://|www\.|©|copyright|[0-9]+$|received|accepted|published|vol\.|volume|doi:|email|e-mail|abstract$|keywords?$)"
    return (
        f"coalesce(list_filter({ls}[1:20], lambda x: length(x) BETWEEN 8 AND 250 AND NOT regexp_matches(x, '{no}')"
        f" AND length(regexp_replace(x, '[^\\p{{L}}{_WI}]', '', 'g')) / length(x) > 0.55)[1], {ls}[1], '')"
    )


def section_sql(c: str, header: str, following, most: int) -> str:
    stop = rf"\n{_W}*(?:{'|'.join(following)}){_W}*[:.]?{_W}*\n"
    return f"left({strip_sql(f'''regexp_extract({c}, '(?is)(?:^|\\n){_W}*{header}{_W}*[:.]?{_W}*\\n?(.*?)(?:{stop}|\\n?\\z)', 1)''')}, {most})"


def papers_sql(with_keywords: bool = False) -> str:
    """Common table expressions that end in ``papers``, the records of the enveloped documents."""
    words = "CASE WHEN doc_id % 7 = 0 THEN 'Keywords: alpha; beta' END," if with_keywords else ""
    markers = "|".join(m.replace(".", r"\.") for m in MARKERS)
    any_of = lambda ws: f"regexp_matches(t, '(?i)(^|{_NOT_WC})({'|'.join(ws)})($|{_NOT_WC})')"
    return f"""
E AS (SELECT doc_id AS id, 'docs/' || doc_id || '.pdf' AS path, strlen(text)::BIGINT AS size, array_to_string(list_filter([
    'Paper number ' || doc_id || ' on text', 'Author One, Author Two', CASE WHEN doc_id % 3 = 0 THEN 'doi 10.1234/abc.' || doc_id END,
    CASE WHEN doc_id % 5 = 0 THEN 'arXiv: 2101.0' || lpad(doc_id::VARCHAR, 4, '0') END, {words}
    CASE WHEN doc_id % 2 = 0 THEN 'Abstract' || chr(10) || left(text, 200) || chr(10) || 'Introduction' END, 'Published ' || (doc_id % 90 + 1950),
    text, CASE WHEN doc_id % 4 = 0 THEN 'References' || chr(10) || '[1] x [2] y [3] z' END], lambda x: x IS NOT NULL), chr(10)) AS page FROM documents),
L AS (SELECT *, {lines_sql('page')} AS ls FROM E),
T AS (SELECT *, {title_sql('ls')} AS raw_title FROM L),
A0 AS (SELECT *, lower({strip_sql('raw_title')}) AS tn FROM T),
A1 AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: contains(lower(x), tn)), true), 0) AS st FROM A0),
A2 AS (SELECT *, list_filter(ls[st + 1:], lambda x: NOT contains(lower(x), tn)) AS rest FROM A1),
A3 AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: regexp_matches(x, '(?i)^abstract($|{_NOT_WC})')), true), 0) AS op FROM A2),
A4 AS (SELECT *, list_filter(CASE WHEN op > 0 THEN rest[1:op - 1] ELSE rest END, lambda x: length(x) > 5 AND NOT regexp_matches(x, '^\\p{{Nd}}+\\.?{_W}')) AS au FROM A3),
B AS (SELECT id, path, size, left({clean_sql('raw_title')}, 300) AS title,
    CASE WHEN tn <> '' AND st > 0 THEN left({clean_sql("array_to_string(au[1:3], '; ')")}, 300) ELSE '' END AS authors,
    regexp_extract(page, '(^|{_NOT_WC})(19[5-9][0-9]|20[0-4][0-9])($|{_NOT_WC})', 2) AS year,
    left({clean_sql(section_sql('page', 'abstract', AFTER_ABSTRACT, 1200))}, 1200) AS abstract,
    left({clean_sql(section_sql('page', f'key{_W}*words?', AFTER_KEYWORDS, 400))}, 400) AS keywords,
    {clean_sql('left(page, 200000)')} AS fulltext, left(regexp_extract(page, '10\\.[0-9]{{4,9}}/[^{_WI}"<>]+', 0), 200) AS doi,
    left(regexp_extract(page, '(?i)arxiv[:{_WI}]*([0-9]{{4}}\\.[0-9]{{4,5}})', 1), 50) AS arxiv_id FROM A4),
C AS (SELECT *, left(fulltext, 4000) AS preview, concat_ws(' ', title, abstract, keywords, fulltext) AS t FROM B),
S AS (SELECT *, list_filter([CASE WHEN doi <> '' THEN 'DOI' END, CASE WHEN arxiv_id <> '' THEN 'arXiv id' END, CASE WHEN abstract <> '' THEN 'abstract' END,
    CASE WHEN {any_of(REFERENCE_WORDS)} THEN 'references' END, CASE WHEN {any_of(SECTION_WORDS)} THEN 'paper sections' END,
    CASE WHEN len(regexp_extract_all(t, '\\[[0-9]{{1,3}}\\]')) >= 3 THEN 'numbered citations' END,
    CASE WHEN regexp_matches(t, '(?i){markers}') THEN 'source ''' || lower(regexp_extract(t, '(?i){markers}', 0)) || '''' END], lambda x: x IS NOT NULL) AS sg FROM C),
papers AS (SELECT * EXCLUDE (t, sg), len(sg)::INTEGER AS n_signals, CASE WHEN len(sg) >= 2 THEN 1 ELSE 0 END::INTEGER AS is_scholarly,
    left(CASE WHEN len(sg) > 0 THEN array_to_string(sg, ', ') ELSE 'no scholarly markers found' END, 200) AS doc_reason,
    coalesce(try_cast(year AS INTEGER), 0)::INTEGER AS year_int, id || '.pdf' AS filename FROM S)"""
