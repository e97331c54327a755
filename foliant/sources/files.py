"""Sources of documents: folders of files, PDF among them, and tables of page texts.

Listings read no contents. Contents are opened in tasks, file by file, so a file that can't be read is a row with an error.
"""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.shared import send_code

PDF_GLOB = "*.[pP][dD][fF]"
#: Files that a task of contents opens, about.
FILES_A_TASK = 64


def plain_path(c: Column) -> Column:
    """A file source's path without its scheme; it is not percent-encoded."""
    return F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")


def list_files(spark: SparkSession, folder: str, glob: str = PDF_GLOB, recursive: bool = True) -> DataFrame:
    """(path, mtime, size) of files; their contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder)
    return rows.select(plain_path(F.col("path")).alias("path"), (F.unix_millis("modificationTime") / 1000.0).alias("mtime"), F.col("length").alias("size"))


def by_path(files: DataFrame) -> DataFrame:
    return files.orderBy(F.lower("path"), "path")


def _dealt(files: DataFrame, workers: int = 0) -> DataFrame:
    """Files over tasks: ``workers`` if given, else by their number."""
    send_code(files.sparkSession)
    return files.repartition(workers or max(1, files.count() // FILES_A_TASK), "path")


def _sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def _each(batches, use, columns: list[str], kinds: list[pa.DataType]):
    """The rows of ``batches`` with what ``use(row)`` gives (a tuple, by ``kinds``) and error: null, or why a file can't be used."""
    for batch in batches:
        found, errors = [], []
        for row in batch.to_pylist():
            try:
                found.append(use(row))
                errors.append(None)
            except OSError as error:
                found.append((None,) * len(kinds))
                errors.append(f"{os.path.basename(row['path'])}: {error}")
        made = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(errors, pa.string())], names=[*batch.schema.names, *columns, "error"])


def with_digests(files: DataFrame) -> DataFrame:
    """Files (path, size) with digest (SHA-256 of the content) and error."""
    run = lambda it: _each(it, lambda row: (_sha256(row["path"]),), ["digest"], [pa.string()])
    return _dealt(files.select("path", "size")).mapInArrow(run, "path string, size long, digest string, error string")


def digests(spark: SparkSession, folder: str, glob: str = PDF_GLOB, recursive: bool = True) -> DataFrame:
    """(path, size, digest) of every file that can be read."""
    return with_digests(list_files(spark, folder, glob, recursive)).where("error is null").drop("error")


def _copy(source: str, target: str) -> None:
    """Copy by way of a hidden name, so a task that runs twice, or is lost, leaves no half file under the name."""
    draft = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
    try:
        shutil.copy2(source, draft)
        os.replace(draft, target)
    finally:
        if os.path.exists(draft):
            os.remove(draft)


def copied(plan: DataFrame, folder: str) -> DataFrame:
    """Copy files (path, name) into a local or mounted ``folder``, in tasks; the rows with error."""
    run = lambda it: _each(it, lambda row: _copy(row["path"], os.path.join(folder, row["name"])) or (), [], [])
    return _dealt(plan.select("path", "name")).mapInArrow(run, "path string, name string, error string")


def pdf_libraries() -> list[str]:
    """Which of the optional PDF libraries are installed, the preferred one first."""
    import importlib.util

    return [name for name in ("pdfplumber", "pypdf") if importlib.util.find_spec(name)]


def _pages_by(content: bytes, library: str) -> list[str]:
    if library == "pdfplumber":
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [_text(lambda p=page: p.extract_text(x_tolerance=3, y_tolerance=3)) for page in pdf.pages]
    from pypdf import PdfReader

    return [_text(page.extract_text) for page in PdfReader(io.BytesIO(content)).pages]


def pages_of_pdf(content: bytes, libraries: list[str], by=_pages_by) -> list[str]:
    """Texts of the pages by the first library that can open the file; a page that fails is empty, a file that fails has none."""
    for library in libraries:
        try:
            return by(content, library)
        except Exception:  # noqa: BLE001, S112  any damage of a file leaves it to the next library, not the job
            continue
    return []


def _text(read) -> str:
    try:
        return read() or ""
    except Exception:  # noqa: BLE001
        return ""


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def read_pdfs(files: DataFrame, workers: int = 0) -> DataFrame:
    """PDF files (path, ...) with pages and error (null, or why the file can't be read); only these files are opened."""
    libraries = pdf_libraries()
    if not libraries:
        raise RuntimeError("install pdfplumber or pypdf to read PDF files")
    run = lambda it: _each(it, lambda row: (pages_of_pdf(_read(row["path"]), libraries),), ["pages"], [pa.list_(pa.string())])
    kinds = ", ".join(f"{n} {k}" for n, k in files.dtypes)
    return _dealt(files, workers).mapInArrow(run, f"{kinds}, pages array<string>, error string")


def pages_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, size, pages) from Parquet."""
    return spark.read.parquet(path).select("path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"), "pages")
