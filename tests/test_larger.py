"""What larger tables showed: figures that grew, and fields that are cut."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.functions import extract, text
from foliant.operators import incremental, inverted, ranking
from foliant.plans import catalogue, envelope


def test_markers_and_white_space_as_plain_patterns(spark):
    deal = random.Random(5)
    parts = [*extract.MARKERS, *[m[:-1] for m in extract.MARKERS], " ", "  ", "\t", " ", " \n", " ", "\r\n", "\x85", "x", "é"]
    texts = ["".join(deal.choice(parts) for _ in range(deal.randrange(12))) for _ in range(400)] + ["a" + " \n" * 50_000 + "b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    made = rows.select("t", extract.first_marker(F.lower("t")).alias("m"), text.clean(F.col("t")).alias("c"), F.regexp_extract(F.lower("t"), "|".join(rf"\Q{m}\E" for m in extract.MARKERS), 0).alias("m0"), F.trim(F.regexp_replace("t", f"{text.W}+", " ")).alias("c0")).collect()
    assert all(r["m"] == r["m0"] and r["c"] == r["c0"] for r in made)


def test_authors_beyond_the_first_lines(spark):
    """Few of the lines beside the title can be authors, so the others are looked at too."""
    own = ["A title of this paper", *["12 x y z"] * 30, "First Author", "Second Author", "Abstract", "Third Author"]
    row = spark.createDataFrame([("\n".join(own),)], "t string").select(extract.authors(F.col("t"), F.lit(own[0])).alias("a")).first()
    assert row["a"] == "First Author; Second Author"


def test_words_begun_as_plain_code(spark):
    texts = ["With without WITH-with withs", "swith éwith with_with 1with", "", "wıth İwith with.with"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("t"))
    made = [r["n"] for r in rows.select(ranking.begun(F.col("t"), "with").alias("n")).collect()]
    assert made == [r["n"] for r in rows.select(F.size(F.filter(text.tokens(F.col("t")), lambda w: F.startswith(w, F.lit("with")))).alias("n")).collect()]


def test_a_stored_record_holds_its_text_once(spark, small):
    rows = envelope.stored(spark, small)
    assert rows.where("preview <> left(fulltext, 4000)").isEmpty() and "preview" not in spark.read.parquet(rows.inputFiles()[0].rsplit("/", 1)[0]).columns


def test_postings_of_few_texts_at_once(spark, small):
    """Python gets texts by the dozen, not by the ten thousand, and postings leave it in batches."""
    rows = spark.read.parquet(f"{small}/documents.parquet")
    assert inverted.postings(rows, "doc_id", fields=("text",)).count() and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 64
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(64)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array(["text"] * 64), pa.array(texts)], names=["doc_id", "field", "words"])
    made = list(inverted._postings(iter([batch]), False, None, None))
    assert sum(b.num_rows for b in made) == 64_000 and max(b.num_rows for b in made) <= inverted.BATCH + 1000


def test_fields_are_extracted_once_to_count(spark, small):
    plan = catalogue.count_nonscholarly(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bibliography") == 1


def test_postings_asked_for_equal_the_rest_left_out(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").withColumnRenamed("doc_id", "id")
    key = lambda made: sorted(map(repr, made.collect()))
    every = inverted.postings(rows, fields=("text",))
    assert key(inverted.postings(rows, fields=("text",), exact=("the", "with"))) == key(every.where("term in ('the', 'with')"))
    assert key(inverted.postings(rows, fields=("text",), begins=("th", "re"))) == key(every.where("term like 'th%' or term like 're%'"))


def test_a_cut_field_is_no_text_that_was_tried(spark, tmp_path):
    """Authors are cut to 300 characters, here within "therefore": the text itself does not hold "the"."""
    line = "x" * (300 - len("Author One, Author Two; Published 1951; ") - 4) + " therefore"
    texts = [(1, line), (2, "the one"), (7, "nothing")]
    spark.createDataFrame([(i, t, len(t)) for i, t in texts], "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = catalogue.aggregate_stats(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = db.execute(catalogue.ORACLE["aggregate_stats"])
    row = dict(zip([d[0] for d in found.description], found.fetchone()))
    assert row["candidates"] == 1 and row["matched"] + row["skipped_nonpaper"] == 2 and made.first().asDict() == row


def test_wide_rows_are_not_sorted_to_get_ids(spark):
    old = spark.createDataFrame([(1, "a", "x" * 10)], "id long, path string, text string")
    new = spark.createDataFrame([("a", "y"), ("b", "z")], "path string, text string")
    assert incremental.upsert(old, new)._jdf.queryExecution().optimizedPlan().toString().count("shuffle_hash") == 2
