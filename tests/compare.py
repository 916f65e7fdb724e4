"""Rows of two results, made comparable."""

from __future__ import annotations

import math


def rows(df) -> list[tuple]:
    """Rows of a pandas frame with columns in order of name, sorted."""

    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return int(v) if math.isfinite(v) and v == int(v) else round(v, 9)
        return v if isinstance(v, (bool, int, str)) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)
