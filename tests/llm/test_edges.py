"""Empty tables, nulls everywhere, extra columns, and the pipeline as a whole."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import bpe, mixing, pii, quality, registry, simhash, toxicity

EMPTY = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, _row int, key string, size string",
    "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def tables(spark, folder, rows):
    for name, schema in EMPTY.items():
        width = schema.count(",") + 1
        spark.createDataFrame([tuple([None] * width)] * rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("query", registry.QUERIES, ids=lambda q: q.__name__)
def test_empty_tables(spark, tmp_path, query):
    assert query(spark, tables(spark, tmp_path, 0)).count() == 0


@pytest.mark.parametrize("query", registry.QUERIES, ids=lambda q: q.__name__)
def test_rows_of_nulls(spark, tmp_path, query):
    rows = {"op1_preference_pairs": 0, "op10_topk_search": 0}.get(query.__name__, 3)
    assert query(spark, tables(spark, tmp_path, 3)).count() == rows


def test_pipeline_on_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, 0)).count() == 0


def test_pipeline_stage_by_stage(spark, small):
    """Each stage against what its operator says of its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {"documents": docs}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, small).persist()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        seen[name] = docs = made
    ids = {k: collections.Counter(r["doc_id"] for r in v.select("doc_id").collect()) for k, v in seen.items()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    gone = ids["documents"] - ids["toxicity"]
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(ids["documents"])
    assert not ids["simhash_near_dedup"] - ids["toxicity"] and max(ids["simhash_near_dedup"].values()) == 1
    assert ids["pii_redaction"] == ids["simhash_near_dedup"]
    texts = {r["doc_id"]: r["text"] for r in seen["simhash_near_dedup"].collect()}
    for r in seen["pii_redaction"].collect():
        assert r["text"] == pii.redact(texts[r["doc_id"]], pii.find(texts[r["doc_id"]])[1]) and r["n_chars"] == len(r["text"])
    assert max(ids["source_mixing"].values()) <= 3 and ids["byte_bpe"] == ids["source_mixing"]
    import public_tokenizers

    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in seen["source_mixing"].collect()}
    assert all(codec.encode(texts[r["doc_id"]]) == r["ids"] for r in seen["byte_bpe"].collect())
    run = corpus_pipeline.run(spark, small)
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in run.collect()) == collections.Counter((r["doc_id"], r["ids_sha256"]) for r in seen["byte_bpe"].collect())


CLASHES = ("_row", "_text", "_key", "_y", "_stat", "_raw", "_words", "key", "text_", "fp", "mark", "root", "score", "predicted", "size", "class", "u", "copies", "row", "chunk", "ids", "k")


def odd_documents(spark):
    """Nulls in any column, empty, repeated and long texts, repeated ids, and columns named like those used inside."""
    rows = [
        (1, "plain words here and there. mail a@b.org now", "en", "s", 10), (1, "plain words here and there. mail a@b.org now", "en", "s", 10), (1, "another text of the same id", None, None, None),
        (None, "no id but a text of some length", "en", "s", 3), (None, None, None, None, None), (5, None, "en", "t", 0), (6, "", "en", "t", 0), (7, " \n\t", "en", None, 3),
        (8, "long " * 60_000 + "call +1 234 567 8901", "en", "s", 300_020), (9, "É" * 30_000, "fr", "t", 30_000), (10, "plus one two three four five six seven eight nine", "en", "t", 50),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


def test_operators_on_odd_documents(spark, small):
    import public_tokenizers

    docs, labels = odd_documents(spark), spark.read.parquet(f"{small}/labels.parquet").withColumn("_y", F.lit("clash")).withColumn("_key", F.lit(1))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    some = spark.read.parquet(f"{small}/documents.parquet").withColumn("_y", F.lit("clash"))
    named = collections.Counter(i for i, _ in texts)
    keys = lambda df, c: collections.Counter(r[0] for r in df.select(c).collect())
    assert keys(toxicity.scored(docs, toxicity.learn(some, labels)), "_row.doc_id") == named
    assert keys(quality.scored(docs, quality.learn(some, labels)), "_row.doc_id") == named
    assert keys(mixing.mix(docs, mixing.word_count(F.col("text"))), "_row.doc_id") == named
    assert keys(simhash.near_duplicates(docs), "key") == named
    found = pii.spans(docs).collect()
    assert sorted((r["key"] or 0, r["spans"]) for r in found) == sorted((i or 0, pii.written(pii.find(t)[1])) for i, t in texts)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    made = bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()
    assert sorted((r["key"] or 0, r["n_tokens"], r["ids_sha256"]) for r in made) == sorted((i or 0, *bpe.digests(codec, codec.encode(t or ""))[:2]) for i, t in texts)


def test_pipeline_on_odd_documents(spark, small, tmp_path):
    """Against each stage in plain code: nothing is toxic, one row of each group stays, spans go, copies are encoded."""
    docs = odd_documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, stage(spark, seen, str(tmp_path)).persist()
        assert seen.columns == docs.columns
        rows, old = seen.collect(), before.collect()
        if name == "toxicity":
            assert len(rows) == len(old)
        elif name == "simhash_near_dedup":
            assert sorted((r["doc_id"] or 0, (r["text"] or "")[:20].strip()) for r in rows) == sorted([(1, "plain words here and"), (1, "another text of the"), (0, "no id but a text of"), (5, ""), (8, "long long long long"), (9, "É" * 20), (10, "plus one two three f")])
        elif name == "pii_redaction":
            assert [r["text"] for r in rows] == [t and pii.redact(t, pii.find(t)[1]) for t in (r["text"] for r in old)]
            assert sum("<PHONE>" in (r["text"] or "") for r in rows) == 2 and sum("<EMAIL>" in (r["text"] or "") for r in rows) == 1
        else:
            assert {r["text"] for r in rows} <= {r["text"] for r in old}
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in run) == collections.Counter(r["doc_id"] for r in seen.collect())
