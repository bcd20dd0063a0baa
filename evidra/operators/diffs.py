"""Line differences of texts, as an Arrow-batched function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: more line pairs than this are compared as sets of lines.
MOST_CELLS = 500_000
#: Fixed value: what a comparison of sets says above its lines.
COARSE = "(coarse diff: inputs too large for line LCS)"


def line_diff(old: str, new: str, old_name: str = "old", new_name: str = "new") -> str:
    """Lines with "  " kept, "- " removed and "+ " added, by a longest common subsequence; removal first where it is open."""
    a, b = old.split("\n") if old else [], new.split("\n") if new else []
    head = [f"--- {old_name}", f"+++ {new_name}"]
    if len(a) * len(b) > MOST_CELLS:
        left, right = set(a), set(b)
        return "\n".join([*head, COARSE, *(f"- {x}" for x in a if x not in right), *(f"+ {x}" for x in b if x not in left)])
    same = 0  # the lines that both begin with are kept as they stand
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    out, a, b = [*head, *(f"  {x}" for x in a[:same])], a[same:], b[same:]
    rows, width = _match_rows(a, b), len(b)
    common = lambda i, j: (width - j) - (rows[i] & ((1 << (width - j)) - 1)).bit_count()
    i = j = 0
    while i < len(a) and j < width:
        if a[i] == b[j]:
            out.append(f"  {a[i]}")
            i, j = i + 1, j + 1
        elif common(i + 1, j) >= common(i, j + 1):
            out.append(f"- {a[i]}")
            i += 1
        else:
            out.append(f"+ {b[j]}")
            j += 1
    return "\n".join([*out, *(f"- {x}" for x in a[i:]), *(f"+ {x}" for x in b[j:])])


def _match_rows(a: list[str], b: list[str]) -> list[int]:
    """Bit-parallel common subsequences of line tails: row i stands for a[i:], its lowest k bits for the last k lines of b;
    the zeros among these bits are as many as the longest common subsequence has lines. A row is one number."""
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for k, x in enumerate(reversed(b)):
        where[x] = where.get(x, 0) | 1 << k
    rows = [full]
    for x in reversed(a):
        v = rows[-1]
        u = v & where.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    rows.reverse()
    return rows


def apply_diff(diff: str) -> tuple[list[str], list[str]]:
    """The old and the new lines that a (not coarse) diff tells of."""
    lines = diff.split("\n")[2:]
    return [x[2:] for x in lines if x[:2] in ("  ", "- ")], [x[2:] for x in lines if x[:2] in ("  ", "+ ")]


def line_diff_column(old: Column, new: Column, old_name: Column, new_name: Column) -> Column:
    """``line_diff`` of two columns; null if either text is null."""

    def run(old: pd.Series, new: pd.Series, old_name: pd.Series, new_name: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or n is None else line_diff(o, n, on, nn) for o, n, on, nn in zip(old, new, old_name, new_name)], dtype=object)

    return F.pandas_udf(run, StringType())(old, new, old_name, new_name)
