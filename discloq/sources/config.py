"""Settings from a file of NAME=value lines."""

from __future__ import annotations

import os
from pathlib import Path


def load_settings(path: str | Path, into: dict | None = None) -> dict[str, str]:
    """Reads comments, ``export`` and quotes; a name that is already set keeps its value."""
    into = os.environ if into is None else into
    found = {}
    path = Path(path)
    for line in path.read_text("utf-8").splitlines() if path.is_file() else ():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if not equals or not name or name.startswith("#"):
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        else:
            value = value.split(" #")[0].rstrip()
        found[name] = value
        into.setdefault(name, value)
    return found
