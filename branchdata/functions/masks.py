"""Mask patterns compiled to column expressions.

A pattern is literal text with placeholders:

* ``{{id}}``     the row's key value as text (repeatable);
* ``{{last4}}``  the last four characters of the masked value; NULL stays NULL;
* ``{{<col>}}``  the masked column's own *name* as literal text (never its value);
* no placeholder: a constant that replaces every value, NULLs included.

Both ``{{id}}`` and ``{{last4}}`` may appear in one pattern.  The result is
always built from ``lit``/``concat``/``right`` so it stays inside codegen,
and no SQL text is ever assembled, so quotes in a pattern need no escaping.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"(\{\{[^{}]+\}\})")


def mask_column(pattern: str, column: str, id_col: str | None = "id") -> Column:
    parts = []
    for piece in _TOKEN.split(pattern):
        if not piece:
            continue
        if piece == "{{id}}":
            if id_col is None:
                raise ValueError(f"mask for {column!r} needs a key column for {{{{id}}}}")
            parts.append(F.col(id_col).cast("string"))
        elif piece == "{{last4}}":
            parts.append(F.right(F.col(column).cast("string"), F.lit(4)))
        elif piece.lower() == "{{" + column.lower() + "}}":
            parts.append(F.lit(column))
        else:
            parts.append(F.lit(piece))
    if not parts:
        return F.lit("")
    if len(parts) == 1:
        return parts[0]
    return F.concat(*parts)


def pattern_needs_id(pattern: str) -> bool:
    return "{{id}}" in pattern
