"""Literal cases of the text functions, in Spark and on the driver."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.functions import extract, text
from foliant.functions.fuzzy import fuzzy_score, may_pass
from foliant.functions.querytext import index_prefixes, keyword_pattern, parse_keywords, parse_year_range, split_terms
from foliant.functions.stem import porter


@pytest.mark.parametrize("raw, found", [
    ("2024", (2024, 2024)), ("2020-2025", (2020, 2025)), ("2025-2020", (2020, 2025)), ("2020-", (2020, 9999)), ("-2019", (1000, 2019)), ("2020 to 2025", (2020, 2025)),
    ("2020..2025", (2020, 2025)), ("2020–2025", (2020, 2025)), ("2020—2025", (2020, 2025)), ("", None), ("abc", None), ("2020-2021-2022", None), ("october", None), ("-", (1000, 9999)), ("20²", None), (None, None), ((3, 1), (3, 1)),
])
def test_year_ranges(raw, found):
    assert parse_year_range(raw) == found


def test_settings_from_the_environment(caplog):
    got = Settings.from_environment({"FOLIANT_FULLTEXT_CHARS": "0", "FOLIANT_WORKERS": "many", "FOLIANT_REQUIRE_SCHOLARLY": "No", "FOLIANT_INDEX_NAME": "x", "FOLIANT_LOG_LEVEL": "", "FOLIANT_RERANK_WEIGHTS": "1"})
    assert (got.fulltext_chars, got.workers, got.require_scholarly, got.index_name, got.log_level) == (0, 0, False, "x", "WARNING") and got.rerank_weights == Settings().rerank_weights
    assert "FOLIANT_WORKERS" in caplog.text and Settings.from_environment({"FOLIANT_REQUIRE_SCHOLARLY": "1"}).require_scholarly


def test_query_texts():
    assert split_terms("Deep, Learning;x") == ["deep", "learning"]
    assert split_terms("ion ion") == ["ion", "ion"]
    assert index_prefixes(["p53-dependent"]) == ["p53", "dependent"]
    assert index_prefixes(["café", "naïve"]) == ["caf", "na", "ve"]
    assert parse_keywords("p53,  machine   learning;p53") == ["p53", "machine learning"]
    assert keyword_pattern("  ") is None


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_word_matches(spark):
    values = ["ionization", "the ion.", "ion_x", "éion", "ión", "ION", "x ion", "ion²"]
    assert column(spark, values, lambda c: c.rlike(keyword_pattern("ion"))) == [False, True, False, False, False, True, True, False]
    assert column(spark, ["machine \n learning", "machinelearning"], lambda c: c.rlike(keyword_pattern("machine learning"))) == [True, False]
    assert column(spark, ["a.b", "axb", "The", "the"], lambda c: c.rlike(keyword_pattern("a.b"))) == [True, False, False, False]
    assert column(spark, ["The", "the"], lambda c: c.rlike(keyword_pattern("The", True))) == [True, False]


def test_sections(spark):
    values = ["T\nAbstract\nfoo\nIntroduction\nbar", "T\nAbstract\nfoo\n1. Introduction\nbar", "T\nAbstractions of x\nfoo", "Abstract: foo\nKeywords: a\nIntroduction\nz", "none", ""]
    made = column(spark, values, lambda c: extract.section(c, "abstract", extract.AFTER_ABSTRACT, 1200))
    assert made == ["foo", "foo\n1. Introduction\nbar", "ions of x\nfoo", "foo\nKeywords: a", "", ""]


def test_white_space_and_lines(spark):
    assert column(spark, ["  a \x1c\x85  b\n", None, ""], text.clean) == ["a b", "", ""]
    assert column(spark, ["a\r\nb\x0bc\x0cd\x1ee\x85f\u2028g\n\n h "], text.lines) == [list("abcdefgh")]
    assert column(spark, ["Café ² x_y"], text.tokens) == [["café", "²", "x", "y"]]
    assert column(spark, ["é ế ß naïvely"], text.fold) == ["e ế ß naively"]


def test_body_budget(spark):
    rows = spark.createDataFrame([(["abc", "", None, "defg", "hi"],), ([],)], "pages array<string>")
    assert [r[0] for r in rows.select(extract.body(F.col("pages"), 5)).collect()] == ["abc de", ""]
    assert [r[0] for r in rows.select(extract.body(F.col("pages"), 0)).collect()] == ["abc defg hi", ""]


def test_fields_of_a_page(spark):
    page = "http://x.org\n12\nA Study of Small Things\nAnn Author, Bob Writer\n1. Lab\nSome Institute\nAbstract\nWe look.\nIntroduction\nIn 2031 and 1949, 1999. doi 10.1000/x.y arXiv: 2101.00001"
    rows = spark.createDataFrame([("a", [page]), ("b", [])], "path string, pages array<string>")
    a, b = [r.asDict() for r in extract.fields(rows).orderBy("path").collect()]
    assert (a["title"], a["authors"], a["year"], a["abstract"]) == ("A Study of Small Things", "Ann Author, Bob Writer; Some Institute", "2031", "We look.")
    assert (a["doi"], a["arxiv_id"], a["is_scholarly"]) == ("10.1000/x.y", "2101.00001", 1)
    assert a["doc_reason"] == "DOI, arXiv id, abstract, paper sections, source 'institute'" or a["doc_reason"].startswith("DOI, arXiv id, abstract, paper sections, source '")
    assert (b["title"], b["is_scholarly"], b["doc_reason"]) == ("", 1, "")


@pytest.mark.parametrize("word, stem", [("running", "run"), ("has", "ha"), ("as", "as"), ("flies", "fli"), ("agreed", "agre"), ("analysis", "analysi"), ("university", "univers"), ("studies", "studi"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("controlling", "control")])
def test_stems(word, stem):
    assert porter(word) == stem


def test_stems_as_sqlite():
    """Every word of the small corpus is stemmed as SQLite's tokenizer stems it."""
    import unicodedata

    import pyarrow.parquet as pq
    import regex

    words = sorted({w for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() for w in regex.findall(r"[\p{L}\p{N}]+", text.fold_text(t.lower()))})
    words = [w for w in words if unicodedata.normalize("NFC", w) == w]
    words += "caresses ties cats feed plastered bled motoring conflated troubled sized tanned hissing fizzed failing filing happy sky conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, w) VALUES (?, ?)", list(enumerate(words)))
    found = {doc: term for term, doc in db.execute("SELECT term, doc FROM v")}
    wrong = [(w, porter(w), found[i]) for i, w in enumerate(words) if porter(w) != found[i]]
    assert not wrong, wrong[:10]


def test_fuzzy():
    assert round(fuzzy_score("network", "networks"), 2) == 93.33
    assert round(fuzzy_score("network", "neural network"), 2) == 66.67
    assert fuzzy_score("abc", "abc def") == pytest.approx(60.0)
    assert fuzzy_score("x", "") == 0
    assert not may_pass(3, 7, 60.0) and may_pass(7, 8, 60.0)


def test_udfs(spark):
    from foliant.functions.fuzzy import fuzzy_udf
    from foliant.functions.stem import porter_udf

    rows = spark.createDataFrame([("papers", "paper"), ("numbering", None)], "a string, b string")
    made = rows.select(porter_udf("a").alias("stem"), fuzzy_udf("a", "b").alias("score")).collect()
    assert [r["stem"] for r in made] == ["paper", "number"] and made[0]["score"] == pytest.approx(fuzzy_score("papers", "paper")) and made[1]["score"] == 0
