"""Column-name normalisation (S6) and canonical sensor names.

Names are metadata, so this runs in Python on ``df.columns``; Python's
Unicode-aware ``\\w`` keeps Hangul intact.
"""

from __future__ import annotations

import re

# Raw sensor headers and the canonical names they map to.
# They must equal the source system's names for files to be recognised.
CANONICAL_SENSOR_NAMES = {
    "온도": "temp",
    "temp": "temp",
    "습도": "humid",
    "압력": "press",
    "불량여부": "error",
}

# The four steps a header goes through, in this order (see normalize_name).
_WS = re.compile(r"\s+")
_NON_WORD = re.compile(r"[^\w]+")


def normalize_name(name: str) -> str:
    """strip -> whitespace runs to '_' -> non-word runs to '_' -> lower-case."""
    s = str(name).strip()
    s = _WS.sub("_", s)
    s = _NON_WORD.sub("_", s)
    return s.lower()


def normalize_names(names: list[str], rename: dict[str, str] | None = None) -> list[str]:
    """Normalise then apply the exact-match canonical rename.

    Raises on collisions (two source columns landing on one name), which
    would otherwise silently shadow data.
    """
    mapping = CANONICAL_SENSOR_NAMES if rename is None else rename
    out = [mapping.get(n, n) for n in (normalize_name(x) for x in names)]
    seen: dict[str, int] = {}
    for i, n in enumerate(out):
        if n in seen:
            raise ValueError(
                f"columns {names[seen[n]]!r} and {names[i]!r} both normalise to {n!r}")
        seen[n] = i
    return out
