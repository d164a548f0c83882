"""One rounding rule for results on both engines.

Sums of decimals carry noise in their last bits, and a value such as 0.1234565 may then
round either way. A nudge far below the kept digits makes both engines round it up.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

NUDGE = 1e-9


def nround(column, digits):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + NUDGE, digits) if digits < 9 else F.round(c, digits)


def rounded(df, digits=6):
    """Round every double column."""
    return df.select(
        *[
            nround(F.col(f"`{n}`"), digits).alias(n) if kind == "double" else F.col(f"`{n}`")
            for n, kind in df.dtypes
        ]
    )


def nudged_sql(sql: str) -> str:
    """``round(a, n)`` with n below 9 becomes ``round((a) + nudge, n)``."""
    out, at = [], 0
    for hit in re.finditer(r"(?<![A-Za-z_])round\(", sql):
        if hit.start() < at:
            continue
        depth, i, comma = 1, hit.end(), None
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = i
            i += 1
        digits = sql[comma + 1 : i - 1].strip() if comma else ""
        inner = sql[hit.end() : comma] if comma else sql[hit.end() : i - 1]
        out.append(sql[at : hit.start()])
        if digits.isdigit() and int(digits) < 9:
            out.append(f"round(({nudged_sql(inner)}) + {NUDGE!r}, {digits})")
        else:
            out.append(f"round({nudged_sql(inner)}{', ' + digits if comma else ''})")
        at = i
    out.append(sql[at:])
    return "".join(out)
