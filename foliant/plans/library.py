"""The three things that the library does: index a corpus, search it, collect from it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import LOG, Settings
from foliant.functions.extract import fields
from foliant.functions.querytext import parse_keywords
from foliant.operators import collect as collecting
from foliant.operators import inverted
from foliant.operators.incremental import IndexStats, Segments, assigned, needs_indexing, vanished
from foliant.operators.ranking import search
from foliant.plans import jobs
from foliant.shared import forget, path_of, settled, small_or_shuffled
from foliant.sources.files import copied, list_files, read_pdfs, with_digests

COLUMNS = (
    "id", "path", "mtime", "size", "filename", "title", "authors", "year", "abstract", "keywords", "fulltext", "preview",
    "doi", "arxiv_id", "is_scholarly", "doc_reason", "indexed_at", "year_int",
)
EMPTY = (
    "id long, path string, mtime double, size long, filename string, title string, authors string, year string, abstract string, keywords string, fulltext string,"
    " preview string, doi string, arxiv_id string, is_scholarly int, doc_reason string, indexed_at timestamp, year_int int"
)
MANIFEST = ("id", "path", "mtime", "size")


def paper_rows(pages: DataFrame, settings: Settings) -> DataFrame:
    """Records of rows (id, path, mtime, size, pages), and their error: null, or why a file could not be read."""
    if "error" not in pages.columns:
        pages = pages.withColumn("error", F.lit(None).cast("string"))
    out = fields(pages, settings).withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("indexed_at", F.current_timestamp())
    return out.select(*COLUMNS, "error")


class Library:
    """A corpus, its records and index in segments in ``folder``. Work and writes of an update are those of its changes."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings.from_environment()
        self.store = Segments(spark, folder, self.settings.format_version)

    @classmethod
    def beside(cls, spark: SparkSession, source: str, settings: Settings | None = None) -> "Library":
        settings = settings or Settings.from_environment()
        return cls(spark, f"{source.rstrip('/')}/{settings.index_name}", settings)

    def state(self) -> list[dict] | None:
        """The segments that count; none if there are none, or they were written by another format or lack a column of now."""
        segments = self.store.current()
        for s in segments or []:
            if set(COLUMNS) - set(self.spark.read.parquet(self.store.where(s, "papers")).columns):
                LOG.warning("%s lacks columns and is built anew", self.store.folder)
                return None
        return segments

    def _records(self, segments: list[dict] | None = None) -> DataFrame:
        found = self.store.read("papers", "id", segments)
        return self.spark.createDataFrame([], EMPTY) if found is None else found.where("error is null").select(*COLUMNS)

    def papers(self) -> DataFrame:
        return self._records(self.state() or [])

    def index(self) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """(postings, doc_stats, corpus) of the live documents."""
        segments = self.state()
        if not segments:
            return None
        stats = self.store.read("doc_stats", "doc_id", segments)
        return self.store.read("postings", "doc_id", segments), stats, inverted.corpus_stats(stats)

    def update(self, pages: DataFrame, force: bool = False, **watch) -> IndexStats:
        """Take in a corpus of rows (path, mtime, size, pages): changed ones anew, vanished ones out.

        Of rows that share a path one is taken. ``watch``: should_cancel() and progress(done, total), see ``jobs.run``.
        """
        return self._update(pages.select("path", "mtime", "size"), lambda todo: self._pages(pages, todo), force, **watch)

    def add(self, pages: DataFrame, **watch) -> IndexStats:
        """As ``update``, but documents that ``pages`` does not hold stay."""
        return self._update(pages.select("path", "mtime", "size"), lambda todo: self._pages(pages, todo), False, keep=True, **watch)

    @staticmethod
    def _pages(pages: DataFrame, todo: DataFrame) -> DataFrame:
        todo = small_or_shuffled(todo.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), "id"))
        same = (F.col("path") == F.col("_path")) & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))
        rows = pages.join(todo, same).select("id", "path", "mtime", "size", "pages")
        repeated = not pages.groupBy("path").count().where("count > 1").isEmpty()  # paths alone; pages move only if some repeat
        return rows.dropDuplicates(["path"]) if repeated else rows

    def update_from_files(self, source: str, force: bool = False, **watch) -> IndexStats:
        return self._update(list_files(self.spark, source), lambda todo: read_pdfs(todo, self.settings.workers), force, **watch)

    def _update(self, files: DataFrame, read, force: bool, keep: bool = False, should_cancel=None, progress=None) -> IndexStats:
        state = self.state()
        base = [] if force or state is None else state
        known = self._records(base).select(*MANIFEST)
        files = files.groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("f")).select("path", "f.mtime", "f.size")
        todo = needs_indexing(files, known)
        ids = settled(todo.join(assigned(known, todo), "path").select(*MANIFEST), "todo")
        gone = (known.limit(0) if keep else vanished(known, files)).select("id")
        total, n_todo = files.count(), ids.count()
        try:
            if not (n_todo or state is None or force or not gone.isEmpty()):
                return IndexStats(total=total, skipped=total)
            segment, segments = self.store.new(), list(base)
            try:
                rows = jobs.run(self.spark, lambda: self._write(segment, read(ids), known, gone), should_cancel, progress)
            except jobs.Cancelled:
                forget(self.spark, segment)
                return IndexStats(total=total, cancelled=True)
            segments.append({"name": os.path.basename(segment), "rows": rows})
            at = self.store.to_merge(segments)
            if at < len(segments):
                segments[at:] = [self._merged(segments, at)]
            self.store.commit(segments, state)
        finally:
            forget(self.spark, path_of(ids))
        made = self.spark.read.parquet(f"{segment}/papers")
        about = made.agg(F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.expr("error is null and fulltext = '' and title = ''")).alias("empty")).first()
        samples = [r["error"] for r in made.where("error is not null").select("error").orderBy("error").limit(5).collect()]
        for s in samples:
            LOG.warning("could not index %s", s)
        if at < len(segments):
            forget(self.spark, segment)
        errors = n_todo - about["indexed"]
        return IndexStats(total=total, indexed=about["indexed"], skipped=total - n_todo, errors=errors, error_samples=samples, n_empty=about["empty"])

    def _write(self, segment: str, pages: DataFrame, known: DataFrame, gone: DataFrame) -> int:
        """Write a segment of the records of ``pages``, their index, and the ids they replace or that are gone; its rows."""
        paper_rows(pages, self.settings).write.parquet(f"{segment}/papers")
        papers = self.spark.read.parquet(f"{segment}/papers").where("error is null")
        inverted.write(inverted.postings(papers), segment)
        inverted.doc_stats(papers).write.parquet(f"{segment}/doc_stats")
        replaced = known.select("id").join(papers.select("id"), "id", "left_semi")
        replaced.unionByName(gone).write.parquet(f"{segment}/dead")
        return papers.count() + self.spark.read.parquet(f"{segment}/dead").count()

    def _merged(self, segments: list[dict], at: int) -> dict:
        """The segments from ``at`` on as one; words are not read again."""
        segment, some = self.store.new(), segments[at:]
        self.store.read("papers", "id", some).where("error is null").write.parquet(f"{segment}/papers")
        inverted.write(self.store.read("postings", "doc_id", some), segment)
        self.store.read("doc_stats", "doc_id", some).write.parquet(f"{segment}/doc_stats")
        dead = [self.spark.read.parquet(self.store.where(s, "dead")) for s in some]
        every = dead[0]
        for more in dead[1:]:
            every = every.unionByName(more)
        (every.distinct() if at else every.limit(0)).write.parquet(f"{segment}/dead")  # nothing lies before the first
        rows = sum(self.spark.read.parquet(f"{segment}/{t}").count() for t in ("doc_stats", "dead"))
        return {"name": os.path.basename(segment), "rows": rows}

    def count_nonscholarly(self) -> int:
        return self.papers().where("is_scholarly = 0").count()

    def search(self, query: str, years=None, top_n: int = 30) -> DataFrame:
        return search(self.papers(), query, years, top_n, self.settings, index=self.index())

    def candidates(self, keywords: str) -> DataFrame:
        """The papers that the index says may hold all keywords: each as a phrase of stemmed words within one field."""
        index = self.index()
        if index is None:
            return self.papers()
        found = inverted.with_phrases(index[0], [inverted.phrase_terms(k) for k in parse_keywords(keywords)])
        return self.papers().join(found.withColumnRenamed("doc_id", "id"), "id", "left_semi")

    def matches(self, keywords: str, dest: str = "", match_case: bool = False) -> DataFrame:
        """Of the candidates those that hold every keyword exactly, with their verdict."""
        return collecting.split_matches(self.candidates(keywords), parse_keywords(keywords), dest, match_case, self.settings.require_scholarly)

    def collect(self, source: str, dest: str, keywords: str, match_case: bool = False, update: bool = True, **watch) -> collecting.AggregateStats:
        """Copy the files of matching papers from ``source`` into ``dest``; both are local or mounted folders.

        Sizes are compared before any file is opened, files are hashed and copied in tasks, and names are planned as a whole
        before the first copy. Cancelled before copying begins, nothing is copied.
        """
        if not parse_keywords(keywords):
            return collecting.AggregateStats(dest_dir=dest)
        source, dest = os.path.abspath(source), os.path.abspath(dest)
        if source == dest:
            raise ValueError("source and destination are the same folder")
        indexed = self.update_from_files(source, **watch) if update else IndexStats(total=self.papers().count())
        if indexed.cancelled:
            return collecting.AggregateStats(total_indexed=indexed.total, errors=indexed.errors, cancelled=True, dest_dir=dest)
        try:
            split = jobs.run(self.spark, lambda: settled(self.matches(keywords, dest, match_case).select("path", "size", "verdict"), "matches"), **watch)
        except jobs.Cancelled:
            return collecting.AggregateStats(total_indexed=indexed.total, errors=indexed.errors, cancelled=True, dest_dir=dest)
        counts = {r["verdict"]: r["count"] for r in split.groupBy("verdict").count().collect()}
        os.makedirs(dest, exist_ok=True)
        wanted, there = split.where("verdict = 'matched'").select("path", "size"), list_files(self.spark, dest, "*", False)
        sizes = settled(collecting.met_sizes(wanted, there), "met-sizes")
        held = settled(collecting.digested(wanted, sizes, with_digests), "digests")
        old = with_digests(there.join(small_or_shuffled(sizes), "size", "left_semi").select("path", "size")).drop("error")
        plan = settled(collecting.copy_plan(held.where("error is null").drop("error"), old), "copy-plan")
        names = collecting.name_plan(plan.where("action = 'copy'"), taken=there.select(F.element_at(F.split("path", "/"), -1).alias("name")))
        done = settled(copied(names, dest), "copied")  # the side effect, once; a task that runs again writes the same names
        failed = held.where("error is not null").select("error").unionByName(done.where("error is not null").select("error"))
        for r in failed.limit(5).collect():
            LOG.warning("could not copy %s", r["error"])
        stats = collecting.AggregateStats(
            total_indexed=indexed.total, candidates=self.candidates(keywords).count(), matched=counts.get("matched", 0), copied=done.where("error is null").count(),
            skipped_existing=plan.where("action = 'skip'").count(), skipped_nonpaper=counts.get("nonpaper", 0), errors=indexed.errors + failed.count(), dest_dir=dest,
        )
        for table in (split, sizes, held, plan, done):
            forget(self.spark, path_of(table))
        return stats
