"""Settings of the library; each can be set by an environment variable ``FOLIANT_<NAME>`` or in code."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field, fields

LOG = logging.getLogger("foliant")


#: Spellings of false; anything else that is set is true.
OFF = frozenset({"0", "false", "off", "no"})
#: How the text of an environment variable becomes a setting, by the type of its default.
READERS = {int: int, bool: lambda text: text.strip().lower() not in OFF, str: str}


@dataclass(frozen=True)
class Settings:
    #: Pages at the front that are kept verbatim.
    front_pages: int = 4
    abstract_chars: int = 1200
    #: Characters of body text that are indexed; 0: all.
    fulltext_chars: int = 200_000
    preview_chars: int = 4000
    #: Candidates that are ranked again per query, at least.
    candidate_limit: int = 240
    #: Hide documents that do not read as papers or reports.
    require_scholarly: bool = True
    #: Signals that a paper must show, 1 at least.
    min_signals: int = 2
    #: Partitions for extraction; 0: Spark's choice.
    workers: int = 0
    #: Rows that a presenter gets at once.
    render_batch: int = 4
    index_name: str = ".foliant_index"
    log_level: str = "WARNING"
    format_version: int = 3
    #: Weights of the second ranking, by field.
    rerank_weights: dict = field(default_factory=lambda: {"title": 5.0, "keywords": 4.0, "abstract": 3.0, "authors": 2.0, "preview": 1.0})
    #: Weights of BM25, by field.
    bm25_weights: dict = field(default_factory=lambda: {"title": 5.0, "authors": 2.0, "year": 1.0, "abstract": 3.0, "keywords": 4.0, "fulltext": 1.0})

    @classmethod
    def from_environment(cls, environment=os.environ) -> "Settings":
        """Settings from variables; one that is unset, empty or of the wrong type leaves the default."""
        found = {}
        for f in fields(cls):
            read, text = READERS.get(type(f.default)), environment.get(f"FOLIANT_{f.name.upper()}")
            if read and text:
                try:
                    found[f.name] = read(text)
                except ValueError:
                    LOG.warning("FOLIANT_%s: %r is no %s, so it stays %r", f.name.upper(), text, type(f.default).__name__, f.default)
        return cls(**found)


def configure_logging(settings: Settings) -> None:
    """Log lines go to stderr at the level set."""
    logging.basicConfig(level=getattr(logging, settings.log_level.upper(), logging.WARNING), format="%(asctime)s %(levelname)s %(name)s %(message)s")
