"""Small files that the driver reads: settings with defaults, and templates."""

from __future__ import annotations

import json
from pathlib import Path


def read_settings(path: str, defaults: dict, *, write_back: bool = False) -> dict:
    """Settings of a JSON file; keys that it lacks come from ``defaults``.

    A missing or unreadable file gives the defaults.  With ``write_back`` a file that is missing, unreadable
    or incomplete is written whole.
    """
    file = Path(path)
    try:
        given = json.loads(file.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        given = None
    settings = {**defaults, **(given if isinstance(given, dict) else {})}
    if write_back and given != settings:
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(settings, indent=2, ensure_ascii=False), encoding="utf-8")
    return settings


class Templates:
    """Format templates of a file, read once; a user's own templates by name stand before them."""

    def __init__(self, path: str, user: dict[str, str] | None = None) -> None:
        self.path, self.user = path, dict(user or {})
        self._stored: dict[str, str] | None = None

    def get(self, name: str, default: str = "<EMPTY>") -> str:
        if self._stored is None:
            self._stored = read_settings(self.path, {})
        return self.user.get(name) or self._stored.get(name) or default
