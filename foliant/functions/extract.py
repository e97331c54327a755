"""Bibliographic fields from page texts, and the signals of a paper, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.functions.text import W, W_IN, WC, blank_if_null, clean, let, lines, strip

# How lines begin that are no titles.
NO_TITLE = r"(?i)^(https?://|www\.|©|copyright|[0-9]+$|received|accepted|published|vol\.|volume|doi:|email|e-mail|abstract$|keywords?$)"
# Names of publishers, databases and kinds of institutions, in the order in which they are tried.
MARKERS = (
    "doi.org", "arxiv", "biorxiv", "medrxiv", "ssrn", "pubmed", "pmc",
    "ieee", "acm", "elsevier", "springer", "nature", "wiley", "sciencedirect",
    "jstor", "taylor & francis", "sage", "oxford university press",
    "cambridge university press", "plos", "mdpi", "frontiers", "bmj", "aaas",
    "proceedings of", "journal of", "university", "institute", "laboratory",
    "national laboratory", "department of", "technical report", "working paper",
    "world health organization", "nasa", "nist", "cern", "oecd", "unesco",
    "european commission", "national institutes of health", "research council",
)
# Words of a references part and of other parts of a paper.
REFERENCE_WORDS = ("references", "bibliography", "works cited")
SECTION_WORDS = ("introduction", "abstract", "methodology", "methods")
AFTER_ABSTRACT = ("introduction", "keywords", "key words", r"1\.", "1 ")
AFTER_KEYWORDS = ("abstract", "introduction", r"1\.", "1 ")


#: Lines that are looked at first for a title's authors; all the others only if these leave it open.
HEAD = 8


def whole(words) -> str:
    first = "".join(sorted({w[0] for w in words}))
    return f"(?i)(?=[{first}])(?<!{WC})({'|'.join(words)})(?!{WC})"  # a letter is compared before anything is looked up


def trie(words) -> str:
    """A pattern that finds what the alternation of ``words`` finds, but compares a letter that several begin with once.

    None of them may begin with another, as the alternation then depends on their order.
    """
    if any(a != b and b.startswith(a) for a in words for b in words):
        raise ValueError("a word begins with another")

    def of(rest: list[str]) -> str:
        by_first: dict[str, list[str]] = {}
        for w in rest:
            by_first.setdefault(w[0], []).append(w[1:])
        parts = [rf"\Q{c}{ws[0]}\E" if len(ws) == 1 else rf"\Q{c}\E{of(ws)}" for c, ws in by_first.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return of(list(dict.fromkeys(words)))


def title(page: Column) -> Column:
    """The first of twenty lines that looks like a title, else the first line."""
    return let(lines(page), title_of)


def title_of(own: Column) -> Column:
    share = lambda x: F.char_length(F.regexp_replace(x, rf"[^\p{{L}}{W_IN}]", "")) / F.char_length(x)
    fits = lambda x: F.char_length(x).between(8, 250) & ~x.rlike(NO_TITLE) & (share(x) > 0.55)
    first = F.get(own, F.lit(0))
    return F.when(fits(first), first).otherwise(F.coalesce(F.get(F.filter(F.slice(own, 1, 20), fits), F.lit(0)), first, F.lit("")))


def authors(page: Column, found_title: Column) -> Column:
    """Up to three lines between the title's line and the abstract."""
    return let(F.lower(strip(found_title)), lambda name: authors_of(lines(page), name))


def authors_of(own: Column, name: Column) -> Column:
    titled = lambda x: F.contains(F.lower(x), name)
    opens = lambda x: x.rlike(r"(?i)^abstract($|[^\p{L}\p{N}_])")
    able = lambda x: (F.char_length(x) > 5) & ~x.rlike(rf"^\p{{Nd}}+\.?{W}")

    def up_to_abstract(rest):
        return let(F.array_position(F.transform(rest, opens), True).cast("int"), lambda n: F.when(n > 0, F.slice(rest, F.lit(1), n - 1)).otherwise(rest))

    def after_title(all_lines):
        at = lambda some: F.array_position(F.transform(some, titled), True).cast("int")
        # what the first lines tell is not asked of all of them
        start = let(at(F.slice(all_lines, 1, HEAD)), lambda n: F.when((n > 0) | (F.size(all_lines) <= HEAD), n).otherwise(at(all_lines)))
        rest = lambda n, most: F.filter(F.slice(all_lines, n + 1, most), lambda x: ~titled(x))
        found = lambda n, most: F.slice(F.filter(let(rest(n, most), up_to_abstract), able), 1, 3)

        def whole_or_head(n):
            settles = lambda own, cut, x: (F.size(x) == 3) | (F.size(cut) < F.size(own)) | (F.size(all_lines) <= n + HEAD)
            chosen = lambda own, cut, x: F.when(settles(own, cut, x), x).otherwise(found(n, F.size(all_lines)))
            return let(rest(n, F.lit(HEAD)), lambda own: let(up_to_abstract(own), lambda cut: let(F.slice(F.filter(cut, able), 1, 3), lambda x: chosen(own, cut, x))))

        return let(start, lambda n: F.when((name != "") & (n > 0), F.array_join(whole_or_head(n), "; ")).otherwise(F.lit("")))

    return let(own, after_title)


def year(front: Column) -> Column:
    return F.regexp_extract(front, f"(?<!{WC})(19[5-9][0-9]|20[0-4][0-9])(?!{WC})", 1)


def section(text: Column, header: str, following: tuple[str, ...], most: int) -> Column:
    """What stands under a header, up to a following header alone on its line or to the end."""
    stop = rf"\n{W}*(?:{'|'.join(following)}){W}*[:.]?{W}*\n"
    body = F.regexp_extract(text, rf"(?is)(?:^|\n){W}*{header}{W}*[:.]?{W}*\n?(.*?)(?={stop}|\n?\z)", 1)
    return F.left(strip(body), F.lit(most))


def abstract(front: Column, settings: Settings) -> Column:
    return F.left(clean(section(front, "abstract", AFTER_ABSTRACT, 1200)), F.lit(settings.abstract_chars))


def keywords(front: Column) -> Column:
    return F.left(clean(section(front, rf"key{W}*words?", AFTER_KEYWORDS, 400)), F.lit(400))


def doi(front: Column) -> Column:
    return F.left(F.regexp_extract(front, rf'10\.[0-9]{{4,9}}/[^{W_IN}"<>]+', 0), F.lit(200))


def arxiv_id(front: Column) -> Column:
    return F.left(F.regexp_extract(front, rf"(?i)arxiv[:{W_IN}]*([0-9]{{4}}\.[0-9]{{4,5}})", 1), F.lit(50))


def body(pages: Column, most: int) -> Column:
    """Pages that are not empty, one space apart, cut to a budget of characters that counts no separators; 0: all."""
    some = F.filter(pages, lambda p: F.coalesce(p, F.lit("")) != "")
    if most <= 0:
        return F.array_join(some, " ")
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"))

    def step(state, page):
        room = F.lit(most) - state["used"]
        part = F.left(page, F.greatest(room, F.lit(0)))
        parts = F.when(room > 0, F.concat(state["parts"], F.array(part))).otherwise(state["parts"])
        return F.struct(parts.alias("parts"), (state["used"] + F.char_length(part)).cast("int").alias("used"))

    return F.aggregate(some, start, step, lambda s: F.array_join(s["parts"], " "))


def signals(found: dict[str, Column]) -> Column:
    """The names of the signals a record shows, in a fixed order, as an array."""
    whole_text = F.concat_ws(" ", *[blank_if_null(found[c]) for c in ("title", "abstract", "keywords", "fulltext")])
    # one lower-cased body for all names: a pattern that ignores case tries each letter twice at every place
    marker_in = lambda text: let(F.lower(text), first_marker)
    return let(whole_text, lambda text: let(marker_in(text), lambda marker: _shown(found, text, marker)))


def first_marker(lowered: Column) -> Column:
    """The first name of MARKERS in a lower-cased text; a pattern looks for it only where a search for each says there is one."""
    least = [m for m in MARKERS if not any(o != m and o in m for o in MARKERS)]  # whoever holds another holds that one
    there = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m)) for m in least])
    return F.when(there, F.regexp_extract(lowered, trie(MARKERS), 0)).otherwise(F.lit(""))


def _shown(found: dict[str, Column], text: Column, marker: Column) -> Column:
    shown = (
        (blank_if_null(found["doi"]) != "", F.lit("DOI")),
        (blank_if_null(found["arxiv_id"]) != "", F.lit("arXiv id")),
        (blank_if_null(found["abstract"]) != "", F.lit("abstract")),
        (text.rlike(whole(REFERENCE_WORDS)), F.lit("references")),
        (text.rlike(whole(SECTION_WORDS)), F.lit("paper sections")),
        (F.regexp_count(text, F.lit(r"\[[0-9]{1,3}\]")) >= 3, F.lit("numbered citations")),
        (marker != "", F.concat(F.lit("source '"), marker, F.lit("'"))),
    )
    return F.filter(F.array(*[F.when(c, v) for c, v in shown]), lambda x: x.isNotNull())


def with_class(papers: DataFrame, settings: Settings) -> DataFrame:
    """Adds n_signals, is_scholarly (0 or 1) and doc_reason."""
    out = papers.withColumn("_signals", signals({c: F.col(c) for c in papers.columns}))
    reason = F.when(F.size("_signals") > 0, F.array_join("_signals", ", ")).otherwise(F.lit("no scholarly markers found"))
    out = out.withColumn("n_signals", F.size("_signals")).withColumn("is_scholarly", (F.size("_signals") >= max(1, settings.min_signals)).cast("int"))
    return out.withColumn("doc_reason", F.left(reason, F.lit(200))).drop("_signals")


def fields(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds the fields of a record to rows with a column ``pages`` (array of page texts).

    Rows without pages get empty fields and count as scholarly, as records that were never classified do.
    """
    pages = F.transform("pages", blank_if_null)
    rows = rows.withColumn("_page", F.get(pages, F.lit(0))).withColumn("_front", F.array_join(F.slice(pages, 1, min(2, settings.front_pages)), "\n"))
    rows = rows.withColumn("_lines", lines(F.col("_page")))  # once, for title and authors
    rows = rows.withColumn("_title", title_of(F.col("_lines")))
    rows = rows.withColumns({
        "title": F.left(clean(F.col("_title")), F.lit(300)), "authors": F.left(clean(let(F.lower(strip(F.col("_title"))), lambda name: authors_of(F.col("_lines"), name))), F.lit(300)),
        "year": year(F.col("_front")), "abstract": abstract(F.col("_front"), settings), "keywords": keywords(F.col("_front")),
        "fulltext": clean(body(F.col("pages"), settings.fulltext_chars)), "doi": doi(F.col("_front")), "arxiv_id": arxiv_id(F.col("_front")),
    }).withColumn("preview", F.left("fulltext", F.lit(settings.preview_chars)))
    rows = with_class(rows.drop("_page", "_front", "_lines", "_title"), settings)
    empty = F.coalesce(F.size("pages"), F.lit(0)) <= 0
    texts = ("title", "authors", "year", "abstract", "keywords", "fulltext", "preview", "doi", "arxiv_id", "doc_reason")
    rows = rows.withColumns({c: F.when(empty, F.lit("")).otherwise(blank_if_null(F.col(c))) for c in texts})
    rows = rows.withColumn("is_scholarly", F.when(empty, F.lit(1)).otherwise(F.col("is_scholarly")))
    # a plain integer can be pushed to the scan, a cast of text can't
    return rows.withColumn("year_int", F.coalesce(F.expr("try_cast(year AS int)"), F.lit(0)))
