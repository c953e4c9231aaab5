"""The vocabulary of entity types, and a guide to a corpus in Markdown."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators import reports as R
from ..operators.kg import STRUCTURAL
from ..operators.views import Corpus
from .sinks import write_if_changed


class BadVocabulary(ValueError):
    """A vocabulary file that lacks types or says they aren't structural."""


def load_vocabulary(path: str) -> dict[str, bool]:
    """Type names and whether each is structural; the four structural ones must be there and say so."""
    try:
        rows = json.loads(Path(path).read_text(encoding="utf-8"))["types"]
        found = {str(r["name"]): bool(r.get("structural", False)) for r in rows}
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise BadVocabulary(f"{path}: {e}") from e
    small = {k.lower(): v for k, v in found.items()}
    if missing := [t for t in STRUCTURAL if not small.get(t)]:
        raise BadVocabulary(f"{path} lacks {', '.join(missing)}")
    return found


def content_types(vocabulary: dict[str, bool]) -> list[str]:
    return [k for k, structural in vocabulary.items() if not structural]


def write_vocabulary(path: str, content: list[str], before: dict[str, bool] | None = None) -> bool:
    """Writes the structural types that were there, or the four, and these content types, each once; says whether the file changed."""
    kept = [k for k, structural in (before or {}).items() if structural] or [t.capitalize() for t in STRUCTURAL]
    seen = {k.lower() for k in kept}
    fresh = [c for i, c in enumerate(content) if c.strip() and c.lower() not in seen and c.lower() not in {x.lower() for x in content[:i]}]
    rows = [{"name": k, "structural": True} for k in kept] + [{"name": c, "structural": False} for c in fresh]
    return write_if_changed(path, json.dumps({"version": 1, "types": rows}, indent=2, ensure_ascii=False) + "\n")


def _cell(value: object) -> str:
    return ("" if value is None else str(value)).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """The first rows of a frame as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join(map(_cell, cells)) + " |"
    return "\n".join([line(df.columns), "|" + "-|" * len(df.columns), *[line(r) for r in rows]])


def corpus_guide(corpus: Corpus, verbs: DataFrame) -> str:
    """What a corpus covers: its size, topics by category and version, its relation verbs, and which tool answers which question."""
    parts = [
        "# Guide to this corpus", "## Size", markdown_table(R.structure_profile(corpus)), "## Topics by category", markdown_table(R.category_coverage(corpus).orderBy("category")),
        "## Topics by version", markdown_table(R.version_coverage(corpus).orderBy("version")), "## Relation verbs", markdown_table(verbs.orderBy("kind", "phrase")),
        "## Which question goes where", "Counting, ranking and dates: SQL over the relations. What is connected to what: the graph's levels, paths and ranks. What was said about something: the contexts of the retrieval.",
    ]
    return "\n\n".join(parts) + "\n"
