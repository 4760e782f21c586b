"""Rows of a Spark query and of its DuckDB counterpart, in a form that can be compared."""

from __future__ import annotations

import decimal
import math


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows(data, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in data)
