"""Settings from a .env file."""

from __future__ import annotations

import hmac
import os
import re


def read_env(path: str, environ: dict | None = None) -> dict[str, str]:
    """The file's settings under those of the process, which win.  Blank lines
    and comments are left out; a pair of quotes around a value is dropped."""
    out: dict[str, str] = {}
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except FileNotFoundError:
        lines = []
    for line in lines:
        found = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*", line)
        if found:
            value = found.group(2)
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            out[found.group(1)] = value
    return out | dict(os.environ if environ is None else environ)


def redact(value):
    """A secret as it may be logged: its ends, or nothing of a short one."""
    if not isinstance(value, str):
        return value
    return f"{value[:4]}...{value[-2:]}" if len(value) > 8 else "***"


def same_secret(given: str, expected: str) -> bool:
    """Comparison whose time doesn't tell where two secrets differ."""
    return hmac.compare_digest(given.encode(), expected.encode())
