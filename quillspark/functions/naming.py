"""Names, addresses and settings of a run; for the driver alone."""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterable, Mapping


def slug(name: str) -> str:
    """Lower-case letters, digits and dots, other runs as one dash."""
    return re.sub(r"[^a-z0-9.]+", "-", name.lower()).strip("-")


def chat_url(base: str) -> str:
    """The chat endpoint of an API address, whether or not it is named already."""
    base = base.rstrip("/")
    return base if base.endswith("/chat/completions") else f"{base}/chat/completions"


def auth_header(key: str, basic: bool = False) -> dict[str, str]:
    return {"Authorization": f"Basic {base64.b64encode(key.encode()).decode()}" if basic else f"Bearer {key}"}


def read_env(text: str) -> dict[str, str]:
    """NAME=value lines; comments and blank lines go, so do quotes around a value."""
    out = {}
    for line in text.splitlines():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            out[name.strip()] = re.sub(r"^(['\"])(.*)\1$", r"\2", value.strip())
    return out


def distinct_paths(paths: Iterable[str]) -> None:
    """Fail if two paths are one place: alike but for case or Unicode form, or the same file by links."""
    seen: dict[str, str] = {}
    for path in paths:
        real = os.path.realpath(path)
        key = unicodedata.normalize("NFC", real).casefold()
        for other_key, other in seen.items():
            same = os.path.exists(path) and os.path.exists(other) and os.path.samefile(path, other)
            if key == other_key or same:
                raise ValueError(f"{path!r} and {other!r} are one place")
        seen[key] = path


def require(found: Mapping[str, object], expected: Mapping[str, object]) -> None:
    """Fail if metadata lack a key or hold another value."""
    wrong = {k: (found.get(k), v) for k, v in expected.items() if k not in found or found[k] != v}
    if wrong:
        raise ValueError("metadata differ (found, expected): " + ", ".join(f"{k}: {v}" for k, v in sorted(wrong.items())))
