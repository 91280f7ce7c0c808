"""Names for helper columns that no column of the input has."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores behind as it takes; case does not tell names apart."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
