"""The catalogue against DuckDB, ranking against SQLite, and the library from indexing to collecting."""

import hashlib
import math
import os
import random
import shutil
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.functions.stem import porter
from foliant.operators import collect, incremental, inverted, ranking
from foliant.plans import catalogue
from foliant.plans.library import Library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NO_SQL = [q for q in catalogue.QUERIES if q not in catalogue.ORACLE]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck(small):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_query_equals_sql(spark, small, duck, name):
    made = catalogue.QUERIES[name](spark, small)
    result = duck.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in result.description]
    rows = [dict(zip(columns, r)) for r in result.fetchall()]
    assert sorted(columns) == sorted(made.columns)
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows) == sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in made.collect())


@pytest.mark.parametrize("name", NO_SQL)
def test_query_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_index_equals_sqlite(spark, small):
    """Stemmed, folded, field-weighted scores by the index agree with FTS5."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), F.left("text", F.lit(60)).alias("title"), F.col("text").alias("fulltext"))
    fields, weights = ("title", "fulltext"), {"title": 5.0, "fulltext": 1.0}
    stats = inverted.doc_stats(rows, fields=fields)
    made = ranking.bm25_indexed(inverted.postings(rows, fields=fields), stats, inverted.corpus_stats(stats), [porter(w) for w in ("with", "rewh", "ereane")], weights)
    made = {r["doc_id"]: r["bm25"] for r in made.collect()}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, fulltext, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, title, fulltext) VALUES (?, ?, ?)", [tuple(r) for r in rows.collect()])
    found = dict(db.execute("SELECT rowid, -bm25(t, 5.0, 1.0) FROM t WHERE t MATCH '\"with\"* OR \"rewh\"* OR \"ereane\"*'"))
    assert made.keys() == found.keys()
    assert all(abs(made[k] - found[k]) < 1e-5 for k in found)


def free_name(base, taken):
    if base not in taken:
        return base
    stem, dot, ext = base.rpartition(".")
    stem, ext = (stem, dot + ext) if stem else (base, "")
    n = 1
    while f"{stem} ({n}){ext}" in taken:
        n += 1
    return f"{stem} ({n}){ext}"


def test_names_are_free(spark):
    """Names file by file, in plain code: the first form that neither the destination nor another file's own name holds."""
    rng = random.Random(3)
    for _ in range(3):
        names = ["a.pdf", "a (1).pdf", "a (3).pdf", "b", ".x", "c.tar.gz", "a (1) (1).pdf", "c (2).gz", "a (01).pdf"]
        paths = sorted({f"/d{rng.randrange(30)}/{rng.choice(names)}" for _ in range(80)})
        taken = {rng.choice(["a.pdf", "a (1).pdf", "a (2).pdf", "b (1)", "b", ".x", ".x (2)", "c.tar.gz", "a (5).pdf", "a (1) (2).pdf", "z"]) for _ in range(5)}
        made = collect.name_plan(spark.createDataFrame([(p,) for p in paths], "path string"), taken=spark.createDataFrame([(t,) for t in taken], "name string"))
        made = {r["path"]: r["name"] for r in made.collect()}
        own, used = {os.path.basename(p) for p in paths}, set(taken)
        for p in paths:
            base = os.path.basename(p)
            name = free_name(base, used) if free_name(base, used) == base else free_name(base, used | own)
            used.add(name)
            assert made[p] == name, (p, made[p], name)
        assert len(set(made.values())) == len(paths) and not set(made.values()) & taken
    alone = spark.createDataFrame([("/x/a.pdf",), ("/y/a.pdf",)], "path string")
    assert sorted(r["name"] for r in collect.name_plan(alone).collect()) == ["a (1).pdf", "a.pdf"]


def test_collect_properties(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    one = rows.where(collect.matches_all(F.col("text"), ["the"]))
    two = rows.where(collect.matches_all(F.col("text"), ["the", "with"]))
    assert two.join(one, "doc_id", "left_anti").count() == 0
    assert 0 < two.count() <= one.count() <= rows.count()


def pages(spark, rows):
    return spark.createDataFrame(rows, "path string, mtime double, size long, pages array<string>")


PAPER = "A Study of Networks\nAnn Author\nAbstract\nDeep network things in 2021.\nIntroduction\nText of the network. doi 10.1000/abc References"


def test_library(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/lib", Settings())
    first = pages(spark, [("/d/a.pdf", 1.0, 10, [PAPER]), ("/d/b.pdf", 1.0, 10, ["An invoice of nothing much\nnetwork"]), ("/d/c.pdf", 1.0, 10, [])])
    stats = library.update(first)
    assert (stats.total, stats.indexed, stats.skipped, stats.n_empty) == (3, 3, 0, 1)
    ids = {r["path"]: r["id"] for r in library.papers().collect()}
    assert library.update(first).skipped == 3
    second = pages(spark, [("/d/a.pdf", 1.005, 10, [PAPER]), ("/d/b.pdf", 1.02, 10, [PAPER + " more"]), ("/d/e.pdf", 1.0, 10, [PAPER])])
    stats = library.update(second)
    assert (stats.total, stats.indexed, stats.skipped) == (3, 2, 1)
    now = {r["path"]: r["id"] for r in library.papers().collect()}
    assert now.keys() == {"/d/a.pdf", "/d/b.pdf", "/d/e.pdf"} and now["/d/b.pdf"] == ids["/d/b.pdf"] and len(set(now.values())) == 3
    found = library.search("networking").collect()  # the stem finds them
    assert {r["path"] for r in found} == now.keys() and found[0]["relevance"] == 100
    assert library.search("").count() == 0
    assert library.search("network", "1990").count() == 0
    assert library.matches("network, study").where("verdict = 'matched'").count() == 3
    assert library.count_nonscholarly() == 0


def test_copying(spark, tmp_path):
    """The copy plan and the names, on real files."""
    source, dest = tmp_path / "src", tmp_path / "dst"
    (source / "sub").mkdir(parents=True)
    dest.mkdir()
    for name, data in (("a.pdf", b"one"), ("sub/a.PDF", b"two"), ("b.pdf", b"one"), ("c.pdf", b"there"), ("d.pdf", b"unique!")):
        (source / name).write_bytes(data)
    (dest / "old.pdf").write_bytes(b"there")
    from foliant.sources.files import by_path, digests, list_files, with_digests

    listed = by_path(list_files(spark, str(source))).collect()
    assert [os.path.basename(r["path"]) for r in listed] == ["a.pdf", "b.pdf", "c.pdf", "d.pdf", "a.PDF"] and listed[0]["size"] == 3
    plan = {os.path.relpath(r["path"], source): r["action"] for r in collect.copy_plan(digests(spark, str(source)), digests(spark, str(dest), "*", False)).collect()}
    listing = list_files(spark, str(source)), list_files(spark, str(dest), "*", False)
    lazy = collect.digested(listing[0], collect.met_sizes(*listing), with_digests).collect()
    assert {r["size"] for r in lazy if r["digest"]} == {3, 5} and len(lazy) == 5 and [r["size"] for r in lazy if not r["digest"]] == [7]
    assert plan == {"a.pdf": "copy", "b.pdf": "skip", "c.pdf": "skip", "d.pdf": "copy", "sub/a.PDF": "copy"}
    assert digests(spark, str(source)).where("size = 5").first()["digest"] == hashlib.sha256(b"there").hexdigest()


def plain_papers(n, step, words=("alpha", "betas", "gamma", "deltas")):
    return [(f"/d/{i}.pdf", float(step), 10, [f"Paper {i}\nAn Author\nAbstract\n{' '.join(words[(i + step + k) % 4] for k in range(3))}\nIntroduction\nreferences {i}"]) for i in n]


def test_segments_equal_a_rebuild(spark, tmp_path):
    """After many small updates, merges among them, records and index are those of one whole update."""
    library, rng = Library(spark, f"file://{tmp_path}/lib", Settings()), random.Random(5)
    now: dict[str, tuple] = {}
    sizes = []
    for step in range(9):
        changed = plain_papers(rng.sample(range(30), 6 if step else 20), step)
        now |= {r[0]: r for r in changed}
        if step % 3 == 2:
            for path in rng.sample(sorted(now), 2):
                del now[path]
            stats = library.update(pages(spark, list(now.values())))
        else:
            stats = library.add(pages(spark, changed))
        assert stats.errors == 0 and library.papers().count() == len(now)
        sizes.append(len(library.store.current()))
    assert max(sizes) > 1 and max(sizes) < 7 and any(b <= a for a, b in zip(sizes, sizes[1:]))
    whole = Library(spark, f"file://{tmp_path}/whole", Settings())
    whole.update(pages(spark, list(now.values())))
    drop = ("id", "indexed_at")
    show = lambda lib: sorted(repr(r) for r in lib.papers().drop(*drop).collect())
    assert show(library) == show(whole)

    def index(lib):
        of = {r["id"]: r["path"] for r in lib.papers().collect()}
        assert len(of) == len(now)
        found, stats, corpus = lib.index()
        return sorted((r["term"], of[r["doc_id"]], r["field"], r["tf"], tuple(r["positions"])) for r in found.collect()), sorted((of[r["doc_id"]], r["n_tokens"]) for r in stats.collect()), corpus.collect()

    assert index(library) == index(whole)
    files = [f for s in library.store.current() for f in (s["name"],)]
    assert {d for d in os.listdir(tmp_path / "lib") if d.startswith("segment-")} >= set(files)


def test_segments_of_another_schema_are_built_anew(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/lib", Settings())
    rows = pages(spark, plain_papers(range(3), 0))
    library.update(rows)
    (segment,) = library.store.current()
    where = library.store.where(segment, "papers")
    spark.read.parquet(where).drop("doi").coalesce(1).write.parquet(f"{tmp_path}/less")
    shutil.rmtree(where.removeprefix("file://"))
    shutil.move(f"{tmp_path}/less", where.removeprefix("file://"))
    assert library.papers().count() == 0 and library.index() is None
    assert library.update(rows).indexed == 3 and library.papers().count() == 3


def test_a_crash_leaves_the_state_before_or_after(spark, tmp_path, monkeypatch):
    library = Library(spark, f"file://{tmp_path}/lib", Settings())
    library.update(pages(spark, plain_papers(range(3), 0)))
    before = sorted(r["path"] for r in library.papers().collect())
    for step in ("_write", "_merged", "_rename", "commit"):
        target = library.store if step in ("_rename", "commit") else library

        def crash(*args, **kwargs):
            raise KeyboardInterrupt

        with monkeypatch.context() as m:
            m.setattr(target, step, crash)
            m.setattr(library.store, "MERGED", 1)
            with pytest.raises(KeyboardInterrupt):
                library.update(pages(spark, plain_papers(range(5), 1)))
        assert sorted(r["path"] for r in library.papers().collect()) == before
    with monkeypatch.context() as m:
        m.setattr(library.store, "_sweep", crash)
        with pytest.raises(KeyboardInterrupt):
            library.update(pages(spark, plain_papers(range(5), 1)))
    assert library.papers().count() == 5
    (tmp_path / "lib" / "pointer-000000000099.json").write_text('{"n": 99, "seg')  # half a pointer
    assert library.papers().count() == 5
    assert Library(spark, f"file://{tmp_path}/lib", Settings(format_version=99)).papers().count() == 0
    state = library.store.current()
    library.update(pages(spark, plain_papers(range(6), 1)))
    with pytest.raises(RuntimeError):
        library.store.commit(state, state)


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}, {"spark.sql.adaptive.enabled": "false"}])
def test_upsert_of_many_wide_rows(spark, conf):
    """200,000 rows of 2 KB go in whole, with ids 1 to n in the order of paths, and again on top of a half of them."""
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 200_000
        wide = F.concat(F.repeat(F.lit("text "), 390), F.sha2(F.col("id").cast("string"), 256))
        new = spark.range(n).select(F.concat(F.lit("/d/"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("path"), wide.alias("text"))
        old = new.limit(0).withColumn("id", F.lit(0).cast("long"))
        made = incremental.upsert(old, new).select("id", "path", F.length("text").alias("l"))
        row = made.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"), F.countDistinct("path"), F.min("l"), F.count_if(F.col("path") == F.concat(F.lit("/d/"), F.lpad((F.col("id") - 1).cast("string"), 7, "0")))).first()
        assert tuple(row) == (n, n, 1, n, n, 2014, n)
        half = new.where("cast(substring(path, 4) as int) % 2 = 1").withColumn("id", F.substring("path", 4, 7).cast("long") + 10)
        row = incremental.upsert(half, new).agg(F.count("*"), F.countDistinct("id"), F.max("id"), F.count_if(F.col("id") == F.substring("path", 4, 7).cast("long") + 10)).first()
        assert tuple(row) == (n, n, n + 9 + n // 2, n // 2)
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_phrases_as_sqlite(spark, small):
    """The gate of collection against FTS5: stemmed, folded phrases, all of them, each within one field."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), F.left("text", F.lit(60)).alias("title"), F.col("text").alias("fulltext"))
    odd = [(900_000, "Numbered papers, read", "numbers"), (900_001, "paper", "number papers; Numbering-paper"), (900_002, "Café résumés", "x"), (900_003, "paper paper number", "a paper number paper")]
    rows = rows.unionByName(spark.createDataFrame(odd, "id long, title string, fulltext string"))
    found = inverted.postings(rows, fields=("title", "fulltext")).persist()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, fulltext, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, title, fulltext) VALUES (?, ?, ?)", [tuple(r) for r in rows.collect()])
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    places = sorted((term, doc, col, at) for term, doc, col, at in db.execute("SELECT term, doc, col, offset FROM v"))
    made = sorted((r["term"], r["doc_id"], r["field"], p) for r in found.collect() for p in r["positions"])
    assert not set(made) ^ set(places), sorted(set(made) ^ set(places), key=lambda x: (x[1], x[3]))[:6]
    assert made == places and all(r["tf"] == len(r["positions"]) for r in found.limit(50).collect())
    words = [r["term"] for r in found.groupBy("term").count().orderBy(F.col("count").desc(), "term").limit(12).collect()]
    for phrases in (["number paper"], ["Papers NUMBERING"], ["numbering of"], ["cafe resume"], ["paper", "number"], ["paper number paper"], ["paper paper"], [f"{words[0]} {words[1]}"], [f"{words[2]} {words[0]}", words[3]], ["nothing-here"], ["p.a"]):
        match = " AND ".join('"' + p + '"' for p in phrases)
        want = sorted(r for (r,) in db.execute("SELECT rowid FROM t WHERE t MATCH ?", [match]))
        assert sorted(r["doc_id"] for r in inverted.with_phrases(found, [inverted.phrase_terms(p) for p in phrases]).collect()) == want, phrases
    assert inverted.with_phrases(found, [[]]).count() == 0
    found.unpersist()


def test_collect_files(spark, tmp_path, monkeypatch):
    """From files to copies: errors, names that are taken, content that is there, candidates beyond the matches."""
    from foliant.plans import library as plans

    source, dest = tmp_path / "src", tmp_path / "dst"
    (source / "sub").mkdir(parents=True)
    dest.mkdir()
    for name, data in (("a.pdf", b"one"), ("sub/a.pdf", b"two"), ("b.pdf", b"one"), ("c.pdf", b"four"), ("d.pdf", b"fifth"), ("e.pdf", b"sixth!")):
        (source / name).write_bytes(data)
    (dest / "old.pdf").write_bytes(b"four")
    (dest / "a.pdf").write_bytes(b"of another size")
    texts = {"d.pdf": "An invoice\nnetwork study", "e.pdf": PAPER.replace("network", "networks")}

    def read(files, workers):
        pages = F.array(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.element_at(F.split("path", "/"), -1)), F.lit(PAPER)))
        return files.withColumn("pages", pages).withColumn("error", F.when(F.endswith("path", F.lit("/b.pdf")), F.lit("b.pdf: no")))

    monkeypatch.setattr(plans, "read_pdfs", read)
    library = Library.beside(spark, str(source), Settings())
    done = library.collect(str(source), str(dest), "network, study")
    assert (done.total_indexed, done.candidates, done.matched, done.copied, done.skipped_existing, done.skipped_nonpaper, done.errors) == (6, 5, 3, 2, 1, 1, 1)
    assert sorted(os.listdir(dest)) == ["a (1).pdf", "a (2).pdf", "a.pdf", "old.pdf"] and {(dest / n).read_bytes() for n in ("a (1).pdf", "a (2).pdf")} == {b"one", b"two"}
    again = library.collect(str(source), str(dest), "network, study")
    assert (again.copied, again.skipped_existing, again.errors) == (0, 3, 1)  # what could not be read is tried again
    fresh = library.collect(str(source), str(tmp_path / "fresh"), "network, study", update=False)
    assert (fresh.total_indexed, fresh.copied, fresh.skipped_existing, fresh.errors) == (5, 3, 0, 0) and sorted(os.listdir(tmp_path / "fresh")) == ["a (1).pdf", "a.pdf", "c.pdf"]
    assert library.collect(str(source), str(tmp_path / "none"), "network", should_cancel=lambda: True).cancelled and not (tmp_path / "none").exists()


def test_errors_progress_and_cancel(spark, tmp_path):
    library, seen = Library(spark, f"file://{tmp_path}/lib", Settings()), []
    rows = pages(spark, plain_papers(range(40), 0))
    assert library.update(rows, should_cancel=lambda: True) == incremental.IndexStats(total=40, cancelled=True)
    assert library.papers().count() == 0 and library.store.current() is None
    stats = library.update(rows, progress=lambda done, total: seen.append((done, total)), should_cancel=lambda: False)
    assert stats.indexed == 40 and seen and all(a <= b for a, b in seen)


def test_a_newer_request_ends_the_one_that_runs():
    import threading
    import time

    from foliant.plans.jobs import Cancelled, Latest

    latest, log, begun = Latest(), [], threading.Event()

    def work(name):
        def run(should_cancel):
            log.append(f"{name} begins")
            begun.set()
            while name != "c":
                if should_cancel():
                    log.append(f"{name} ends")
                    raise Cancelled
                time.sleep(0.01)
            return name

        return run

    def submit(name):
        try:
            log.append(latest.submit(work(name)))
        except Cancelled:
            pass

    first = threading.Thread(target=submit, args="a")
    first.start()
    begun.wait()
    others = [threading.Thread(target=submit, args=n) for n in "bc"]
    for t in others:
        t.start()
        time.sleep(0.2)
    for t in (first, *others):
        t.join(10)
    assert log[:2] == ["a begins", "a ends"] and log[-2:] == ["c begins", "c"] and log.count("b begins") <= 1


def test_pdf_libraries_in_turn():
    from foliant.sources.files import pages_of_pdf

    def by(content, library):
        if library == "one":
            raise ValueError("damaged")
        return [library]

    assert pages_of_pdf(b"", ["one", "two"], by) == ["two"] and pages_of_pdf(b"", ["one"], by) == [] and pages_of_pdf(b"", ["two", "one"], by) == ["two"]


def test_unreadable_files(spark, tmp_path):
    from foliant.sources.files import copied, with_digests

    (tmp_path / "a").write_bytes(b"x")
    rows = spark.createDataFrame([(f"{tmp_path}/a", 1), (f"{tmp_path}/gone", 1)], "path string, size long")
    made = {os.path.basename(r["path"]): r for r in with_digests(rows).collect()}
    assert made["a"]["error"] is None and made["gone"]["digest"] is None and made["gone"]["error"].startswith("gone: ")
    (tmp_path / "to").mkdir()
    out = copied(rows.withColumn("name", F.element_at(F.split("path", "/"), -1)), f"{tmp_path}/to")
    assert [sorted(r["error"] is None for r in out.collect()) for _ in range(2)] == [[False, True]] * 2 and os.listdir(tmp_path / "to") == ["a"]


def plain_search(rows, scores, terms, weights):
    """Search with fuzzy scores row by row: (id, relevance), best first."""
    from foliant.functions.fuzzy import fuzzy_score

    best = sorted((r for r in rows if r["id"] in scores and r["is_scholarly"] == 1 and 1960 <= r["year_int"] <= 2030), key=lambda r: (-round(scores[r["id"]], 6), r["id"]))[:300]
    out = []
    for place, r in enumerate(best):
        score = len(best) - place
        for t in terms:
            for f, w in weights.items():
                if t in (r[f] or "").lower():
                    score += 100 * w
                elif f in ("title", "abstract", "keywords") and (r[f] or ""):
                    similar = fuzzy_score(t, r[f][:500])
                    score += w * similar * 0.5 if similar > 60 else 0
        out.append((score, place, r["id"]))
    most = max([s for s, _, _ in out] + [1])
    return [(i, min(100, math.floor(s / most * 100))) for s, _, i in sorted(out, key=lambda x: (-x[0], x[1]))[:30]]


@pytest.mark.parametrize("query", [catalogue.SEARCH, "papr numbr on", "paper number"])
def test_fuzzy_search_as_plain_code(spark, small, query):
    from foliant.functions.querytext import index_prefixes, split_terms
    from foliant.plans import envelope

    settings, papers = Settings(), envelope.papers(spark, small)
    scores = {r["id"]: r["bm25"] for r in ranking.bm25(papers, index_prefixes(split_terms(query)), settings.bm25_weights).collect()}
    made = [(r["id"], r["relevance"]) for r in ranking.search(papers, query, "1960-2030").collect()]
    assert made == plain_search(papers.collect(), scores, split_terms(query), settings.rerank_weights) and made


def test_stream(spark, tmp_path):
    from foliant.streaming.ingest import pages_stream, start

    library = Library(spark, f"file://{tmp_path}/lib", Settings())
    pages(spark, [("/d/a.pdf", 1.0, 10, [PAPER])]).write.parquet(f"{tmp_path}/in/1")
    for n in (1, 2):
        start(pages_stream(spark, f"{tmp_path}/in/*"), library, f"{tmp_path}/check").awaitTermination()
        assert library.papers().count() == n
        pages(spark, [("/d/b.pdf", 1.0, 10, [PAPER])]).write.mode("overwrite").parquet(f"{tmp_path}/in/2")


def test_windows_of_a_stream(spark, small, tmp_path):
    """A stream of events, file by file, counts as one scan does; windows that are still open come with the last batch."""
    from foliant.streaming.ingest import counts_by_window

    events = spark.read.parquet(f"{small}/events.parquet").where("ts is not null")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination()
    show = lambda df: sorted((str(r["window"]["start"]), r["n"]) for r in df.collect())
    assert show(spark.table("windows")) == show(counts_by_window(events)) and spark.table("windows").count() > 1


def test_cli(tmp_path, capsys):
    from foliant.cli import main

    assert main(["--index", str(tmp_path / "none")]) == 2
    assert main(["--index", str(tmp_path), "--collect", "--dest", str(tmp_path / "d"), "--keywords", " , "]) == 2
    with pytest.raises(SystemExit):
        main(["--collect", "--index", str(tmp_path)])
