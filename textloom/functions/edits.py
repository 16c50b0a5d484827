"""Edit scripts between words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_script(a: str, b: str) -> list[tuple[str, str, str]]:
    """A shortest script from a to b as (op, character, new character); op is del, add or replace.

    Where several are shortest, going back from the ends: equal characters match, else a deletion goes before an
    addition and that before a replacement."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        last = rows[-1]
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] if x == y else 1 + min(last[j], row[j - 1], last[j - 1]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i or j:
        here = rows[i][j]
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif i and rows[i - 1][j] + 1 == here:
            i -= 1
            out.append(("del", a[i], ""))
        elif j and rows[i][j - 1] + 1 == here:
            j -= 1
            out.append(("add", b[j], ""))
        else:
            i, j = i - 1, j - 1
            out.append(("replace", a[i], b[j]))
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("op", "a", "b")])))
def edits(wrong: pd.Series, right: pd.Series) -> pd.Series:
    """edit_script of each pair; null if either is null."""
    return pd.Series([None if x is None or y is None else [{"op": o, "a": p, "b": q} for o, p, q in edit_script(x, y)] for x, y in zip(wrong, right, strict=True)])
