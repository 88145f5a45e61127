"""Item lists: parsing, normalising, filling and matching, as column expressions.

Inside the engine a list is ``array<bigint>``; strings with blanks stand at the edges only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_tokens(text: Column, dedup: bool = True) -> Column:
    """ASCII digit tokens of a list, in order, as strings. Null and blank lists are empty. With ``dedup`` equal tokens
    count once; ``01`` and ``1`` are different tokens."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x.rlike("^[0-9]+$"))
    return F.array_distinct(parts) if dedup else parts


def parse_items(text: Column, dedup: bool = True, k: int | None = None) -> Column:
    """Item ids of a list, the first ``k`` tokens only if given."""
    tokens = item_tokens(text, dedup)
    if k is not None:
        tokens = F.slice(tokens, 1, k)
    return F.transform(tokens, lambda x: x.cast("bigint"))


def join_items(items: Column) -> Column:
    return F.array_join(items.cast("array<string>"), " ")


def normalize_items(text: Column, k: int) -> Column:
    """A cleaned list: distinct digit tokens, at most ``k``."""
    return F.array_join(F.slice(item_tokens(text), 1, k), " ")


def fill_to_k(items: Column, fallback: Column, k: int) -> Column:
    """``items``, then items of ``fallback`` that aren't there yet, up to ``k``."""
    return F.slice(F.array_distinct(F.concat(items, fallback)), 1, k)


def hits(predicted: Column, wanted: Column) -> Column:
    """Number of distinct items in both lists."""
    return F.size(F.array_intersect(predicted, wanted))


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    return F.least(F.greatest(x, low), high)


def share_of(n: Column, ratio: float) -> Column:
    """Whole part of ``n * ratio`` in double precision."""
    return F.floor(n * F.lit(float(ratio))).cast("int")
