"""Filling fixed-capacity containers: dominance reduction, then best fit, over whole corpora.

Items of equal size are interchangeable, so the instance is its histogram of sizes, which has at most ``capacity`` rows
however many items there are. The plan is made on the histogram: sets of up to three items that dominate every other
set with their largest item are fixed (with multiplicity), best fit decreasing fills the rest. The items are then
numbered exactly within their size and look up their place in the plan.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.numbering import number_in_groups
from larder.session import materialize

#: Published pre-tokenisation pattern of GPT-2; fixed value. ``(?U)`` gives white space its Unicode meaning in Java.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


SPAN = T.StructType(
    [T.StructField("lo", T.LongType()), T.StructField("base", T.LongType()), T.StructField("per", T.IntegerType()),
     T.StructField("place", T.IntegerType()), T.StructField("fixed", T.BooleanType())]
)


def count_tokens(text: Column) -> Column:
    """Matches of the GPT-2 pre-tokenisation pattern; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("(?U)" + GPT2_PATTERN)), F.lit(0))


def pieces(docs: DataFrame, id_col: str, size: Column, capacity: int) -> DataFrame:
    """(item, piece_no, n_pieces, first, size): items longer than ``capacity`` are cut into full pieces and a rest."""
    sized = docs.select(F.col(f"`{id_col}`").alias("item"), size.cast("bigint").alias("whole"))
    n = F.ceil(F.col("whole") / capacity).cast("int")
    cut = sized.withColumn("n_pieces", n).withColumn(
        "piece_no", F.explode_outer(F.when(n > 0, F.sequence(F.lit(1), n)))
    )
    first = (F.col("piece_no") - 1).cast("bigint") * capacity
    return cut.select(
        "item",
        F.coalesce("piece_no", F.lit(1)).alias("piece_no"),
        F.greatest("n_pieces", F.lit(1)).alias("n_pieces"),
        F.coalesce(first, F.lit(0).cast("bigint")).alias("first"),
        F.least(F.coalesce(F.col("whole") - first, F.lit(0)), F.lit(capacity)).cast("int").alias("size"),
    )


def _at_most(free: Counter, limit: int) -> list[int]:
    """At s, the largest size of at most s that is left, else 0."""
    out = [0] * (limit + 1)
    for s in range(1, limit + 1):
        out[s] = s if free[s] > 0 else out[s - 1]
    return out


def _smallest(free: Counter, capacity: int, n: int) -> list[int]:
    out: list[int] = []
    for s in range(1, capacity + 1):
        out += [s] * min(free[s], n - len(out))
        if len(out) == n:
            break
    return out


def reduce_instance(free: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets: removes them from ``free`` and returns (sizes, times).

    A set dominates another with the same largest item if its remaining items can take the place of groups of the
    other's. With the largest item j fixed, let r be the largest item that still fits: {j} dominates if nothing fits;
    {j, r} if it fills the container, if no two others fit beside j, or if only two fit and together never exceed r;
    {j, r, b}, b the largest fitting beside both, if only two fit and b is at least the smaller of any two that fit.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(sizes: tuple[int, ...]) -> None:
        need = Counter(sizes)
        times = min(free[s] // k for s, k in need.items())
        if times:
            free.subtract({s: k * times for s, k in need.items()})
            fixed.append((sizes, times))

    for j in range(capacity, 0, -1):
        while free[j] > 0:
            room, had = capacity - j, free[j]
            free[j] -= 1
            below = _at_most(free, room)
            r = below[room]
            low = _smallest(free, capacity, 3)
            choice: tuple[int, ...] | None = None
            if not r:
                choice = (j,)
            elif r == room or len(low) < 2 or low[0] + low[1] > room:
                choice = (j, r)
            elif len(low) < 3 or sum(low) > room:

                def beside(x: int, limit: int, below: list[int] = below) -> int:
                    y = below[max(0, limit)]
                    return below[x - 1] if y == x and free[x] < 2 else y

                b = beside(r, room - r)
                top = second = 0
                x = below[min(r, room - 1)]
                while x:
                    y = beside(x, min(x, room - x))
                    if y:
                        top, second = max(top, x + y), max(second, y)
                    x = below[x - 1]
                if top <= r:
                    choice = (j, r)
                elif b and min(b, r) >= second:
                    choice = (j, r, b)
            free[j] += 1
            if choice is None:
                break
            fix(choice)
            if free[j] == had:  # only one of j is left for a set that needs two
                break
    return fixed


def best_fit(free: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on the histogram; bins of equal content are one group."""
    groups: dict[tuple[int, ...], int] = {}
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(sizes: tuple[int, ...], times: int) -> None:
        room = capacity - sum(sizes)
        by_room[room][sizes] = by_room[room].get(sizes, 0) + times

    for s in range(capacity, 0, -1):
        left = free[s]
        room = s
        while left > 0 and room < capacity:
            if not by_room.get(room):
                room += 1
                continue
            sizes, times = next(iter(by_room[room].items()))
            q = room // s
            full = min(times, left // q)
            if full:
                take, per = full, q
            else:
                take, per = 1, left
            if take == times:
                del by_room[room][sizes]
            else:
                by_room[room][sizes] = times - take
            put(sizes + (s,) * per, take)
            left -= take * per
        q = capacity // s
        if left >= q:
            put((s,) * q, left // q)
            left %= q
        if left:
            put((s,) * left, 1)
        free[s] = 0
    for bins in by_room.values():
        for sizes, times in bins.items():
            groups[sizes] = groups.get(sizes, 0) + times
    return sorted(groups.items(), key=lambda x: (-sum(x[0]), x[0]))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """(sizes of a container, number of such containers, fixed by dominance)."""
    free: Counter = Counter({s: n for s, n in histogram.items() if n > 0})
    fixed = reduce_instance(free, capacity)
    return [(s, n, True) for s, n in fixed] + [(s, n, False) for s, n in best_fit(free, capacity)]


def _looker(starts: list[tuple]):
    """A function of (size, nth) that finds the span of an item by binary search; ``starts`` has a span per size and kind of
    container, so its length hangs on the capacity, not on the number of items."""
    table = np.array([r[:2] for r in starts], dtype=np.int64).reshape(-1, 2)
    spans = pd.DataFrame(starts, columns=["size", "lo", "base", "per", "place", "fixed"])
    first = {int(s): int(k) for s, k in zip(*np.unique(table[:, 0], return_index=True), strict=True)}
    last = {s: int(np.searchsorted(table[:, 0], s, "right")) for s in first}

    @F.pandas_udf(SPAN)
    def look(size: pd.Series, nth: pd.Series) -> pd.DataFrame:
        at = np.zeros(len(size), dtype=np.int64)
        sizes, n = size.to_numpy(), nth.to_numpy()
        for s in np.unique(sizes):
            mine = sizes == s
            b, e = first[int(s)], last[int(s)]
            at[mine] = b + np.searchsorted(table[b:e, 1], n[mine], "right") - 1
        return spans.iloc[at][SPAN.names].reset_index(drop=True)

    return look


def pack(docs: DataFrame, id_col: str, size: Column, capacity: int = 512) -> DataFrame:
    """(item, piece_no, n_pieces, first, size, container_id, place, fixed): the container of every item or piece.

    Items are split only if longer than ``capacity``; ``first`` is the first unit of the piece. Items of size 0 or null
    take no room and have no container (null). Items of equal id stay separate items; an empty table gives an empty
    result.
    """
    parts = materialize(pieces(docs, id_col, size, capacity), "pieces")
    hist = {
        r["size"]: r["n"] for r in parts.filter("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    used: Counter = Counter()
    rows, base = [], 0
    for sizes, times, fixed in plan(hist, capacity):
        place = 1
        for s, per in sorted(Counter(sizes).items(), reverse=True):
            rows.append((s, used[s], used[s] + per * times, base, per, place, fixed))
            used[s] += per * times
            place += per
        base += times
    starts = sorted((s, lo, base, per, place, fixed) for s, lo, _, base, per, place, fixed in rows)
    salts = max(64, max(hist.values(), default=0) // 1_000_000)  # parts of the largest size hold about a million rows
    ordered = number_in_groups(parts.filter("size > 0"), ["size"], ["item", "piece_no"], "nth", salts)
    at = ordered.withColumn("s", _looker(starts)("size", "nth"))
    off = F.col("nth") - F.col("s.lo")
    placed = at.select(
        "item", "piece_no", "n_pieces", "first", "size",
        (F.col("s.base") + F.floor(off / F.col("s.per"))).cast("bigint").alias("container_id"),
        (F.col("s.place") + off % F.col("s.per")).cast("int").alias("place"),
        F.col("s.fixed").alias("fixed"),
    )
    nothing = parts.filter("size = 0").select(
        "item", "piece_no", "n_pieces", "first", "size",
        F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("boolean").alias("fixed"),
    )
    return placed.unionByName(nothing)
