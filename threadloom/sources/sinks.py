"""Results as text tables, JSON lines and files that are only written when they change."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame

#: Widest column of a text table.
WIDEST = 60


def _shown(value: object) -> str:
    text = "" if value is None else value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat() if isinstance(value, date) else str(value)
    return text if len(text) <= WIDEST else text[: WIDEST - 3] + "..."


def text_table(df: DataFrame, most: int | None = 1000) -> str:
    """A table for reading: the first `most` rows (all, if that is None), nulls empty, long values cut, the number of rows below."""
    rows = (df if most is None else df.limit(most)).collect()
    if not rows:
        return "(no results)"
    cells = [df.columns, *[[_shown(v) for v in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:], f"({len(rows)} rows)"])


def json_rows(df: DataFrame, most: int | None = 1000) -> str:
    """The first `most` rows (all, if that is None) as a JSON list of objects."""
    return json.dumps([r.asDict(recursive=True) for r in (df if most is None else df.limit(most)).collect()], default=str, ensure_ascii=False, indent=2)


def write_if_changed(path: str, text: str) -> bool:
    """Writes a file through a temporary one beside it; leaves it alone if it holds the same, and says whether it wrote."""
    p, data = Path(path), text.encode()
    if p.exists() and hashlib.sha256(p.read_bytes()).digest() == hashlib.sha256(data).digest():
        return False
    new = p.with_name(p.name + ".new")
    new.write_bytes(data)
    new.replace(p)
    return True


def graph_payload(nodes: DataFrame, edges: DataFrame, most: int = 100_000) -> str:
    """Nodes and edges for an explorer, in order, as one text; for more than `most` of either there is write_graph."""
    n, e = nodes.orderBy("name").limit(most + 1).collect(), edges.orderBy("a", "b").limit(most + 1).collect()
    if max(len(n), len(e)) > most:
        raise ValueError(f"more than {most} nodes or edges: write_graph writes any number")
    return json.dumps({"nodes": [r.asDict() for r in n], "edges": [r.asDict() for r in e]}, ensure_ascii=False, sort_keys=True)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges of any number as JSON lines, by the executors."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


POLICIES = ("backup", "alongside", "fail")


def write_report(path: str, text: str, policy: str = "backup", stamp: str | None = None) -> Path:
    """Writes a report; where there is one already it is kept beside (backup), stays and the new one gets a time in its name (alongside), or that is an error (fail)."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    p, stamp = Path(path), stamp or datetime.now().strftime("%Y%m%d-%H%M%S")
    if p.exists() and policy == "fail":
        raise FileExistsError(path)
    if p.exists() and policy == "alongside":
        p = p.with_name(f"{p.stem}-{stamp}{p.suffix}")
    elif p.exists():
        p.replace(p.with_name(f"{p.stem}-{stamp}.bak{p.suffix}"))
    p.parent.mkdir(parents=True, exist_ok=True)
    write_if_changed(str(p), text)
    return p


def log_run(folder: str, name: str, facts: dict[str, object], stamp: str | None = None) -> Path:
    """A run's facts as a file of its own."""
    p = Path(folder) / f"{name}-{stamp or datetime.now().strftime('%Y%m%d-%H%M%S')}.md"
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join([f"# {name}", "", *[f"- {k}: {v}" for k, v in facts.items()], ""]), encoding="utf-8")
    return p


def cached(path: str, signature: str, compute: Callable[[], object]) -> object:
    """What was computed for a signature, from a file that holds it; computed and written where the file is of another one, broken or missing."""
    p = Path(path)
    try:
        held = json.loads(p.read_text(encoding="utf-8"))
        if held["signature"] == signature:
            return held["value"]
    except (OSError, ValueError, KeyError, TypeError):
        pass
    value = compute()
    write_if_changed(path, json.dumps({"signature": signature, "value": value}, ensure_ascii=False, sort_keys=True))
    return value


class Busy(RuntimeError):
    """Another run holds the folder."""


@contextmanager
def exclusive(folder: str) -> Iterator[None]:
    """Holds a folder for one run: a lock file that only one can make, removed at the end."""
    lock = Path(folder) / ".lock"
    try:
        fd = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise Busy(f"{lock} is held by {lock.read_text(encoding='utf-8').strip() or 'another run'}") from None
    try:
        os.write(fd, str(os.getpid()).encode())
        os.close(fd)
        yield
    finally:
        lock.unlink(missing_ok=True)
