"""Settings in layers: defaults, an .env file of the project, one of the data folder, and what a caller passes; later ones win."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

#: Known settings and what they are without any file.
DEFAULTS = {"DATA_DIR": ".", "MASTER": "", "QUERY_MODE": "mix", "LIMIT": "30", "BUCKETS": "12", "CHUNK_TOKENS": "1200", "CHUNK_OVERLAP": "100"}


def read_env(path: Path) -> dict[str, str]:
    """NAME=value lines of a file; blank lines, comments and an `export` in front don't count, quotes around a value neither. A missing file has none."""
    if not path.is_file():
        return {}
    out: dict[str, str] = {}
    for line in path.read_text(encoding="utf-8").splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.lstrip().startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def layered(root: str | None = None, data: str | None = None, given: Mapping[str, object] | None = None) -> dict[str, str]:
    """The settings in force; the data folder may be named by the project's file, nulls among the given ones don't count."""
    found = DEFAULTS | (read_env(Path(root) / ".env") if root else {})
    folder = data or found["DATA_DIR"]
    return found | read_env(Path(folder) / ".env") | {"DATA_DIR": folder} | {k: str(v) for k, v in (given or {}).items() if v is not None}
