"""A small result as an aligned table of text."""

from __future__ import annotations

import re

_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")


def shown_width(text: str) -> int:
    """Characters that take room on a terminal."""
    return len(_ANSI.sub("", text))


def table(rows: list[dict | str], just: str = "r", missing: str = "-", repeat_header: int = 40) -> str:
    """Rows as columns in the order they first come up; a one-character string is a rule.

    just: l or r for each column, the last for all others.
    """
    columns = list(dict.fromkeys(k for r in rows if isinstance(r, dict) for k in r))
    side = [just[min(i, len(just) - 1)] for i in range(len(columns))]
    cell = lambda r, c: str(r[c]) if c in r and r[c] is not None else missing
    width = [max(len(c), *(shown_width(cell(r, c)) for r in rows if isinstance(r, dict))) for c in columns]
    fill = lambda text, i: " " * (width[i] - shown_width(text)) + text if side[i] == "r" else text + " " * (width[i] - shown_width(text))
    line = lambda cells: " | ".join(fill(x, i) for i, x in enumerate(cells)).rstrip()
    out = []
    for i, r in enumerate(rows):
        if i % repeat_header == 0:
            out.append(line(columns))
        out.append(r * (sum(width) + 3 * (len(width) - 1)) if isinstance(r, str) else line([cell(r, c) for c in columns]))
    return "\n".join(out)
