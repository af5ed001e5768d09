"""Items that appear together: pair counts and association scores over baskets of any size.

Items too rare for any wanted pair are dropped first, which loses no pair. The items of a basket are cut into chunks of
bounded size, and each pair of chunks is a row of its own, so that the product of a huge basket is spread over many
tasks; an ordinary basket is one chunk and one row. Pair counts are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.skew import heavy_of, sized_join
from larder.session import BROADCAST_BYTES, materialize

#: Items of a chunk: a pair of chunks gives at most about the square of this many pairs.
CHUNK_ITEMS = 256


def _chunk_pairs(kept: DataFrame, chunk_items: int, limit: int) -> DataFrame:
    """(field_name, lo, hi, n_left, items): each pair of chunks of each basket with its items, the left chunk's first.

    A chunk pairs with itself too (lo = hi). No row holds more than two chunks, whatever the basket's size.
    """
    by = ["field_name", "basket"]
    sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    huge = sizes.filter(F.col("_size") > chunk_items).select(
        *by, F.ceil(F.col("_size") / chunk_items).cast("int").alias("_chunks"), "_size"
    )
    huge = materialize(huge, "huge")
    # the share is of the huge baskets' rows, so it takes in every basket that is hot among all
    rows = sized_join(kept, huge.drop("_size"), by, "left", limit, lambda: heavy_of(huge, by, "_size"))
    n = F.coalesce("_chunks", F.lit(1))
    chunk = F.pmod(F.xxhash64("item"), n).cast("int")
    rows = rows.select(*by, "item", chunk.alias("_chunk"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_other"))
    lo, hi = F.least("_chunk", "_other"), F.greatest("_chunk", "_other")
    groups = rows.groupBy(*by, lo.alias("lo"), hi.alias("hi")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("_chunk") > lo).cast("int").alias("side"), "item"))).alias("items")
    )
    left = F.when(F.col("lo") == F.col("hi"), F.size("items")).otherwise(F.size(F.filter("items", lambda x: x["side"] == 0)))
    return groups.select("field_name", "lo", "hi", left.alias("n_left"), F.transform("items", lambda x: x["item"]).alias("items"))


def _pairs(groups: DataFrame) -> DataFrame:
    """(field_name, item_a, item_b), smaller first: within a chunk each item and those after it, else the product."""
    inside = F.col("lo") == F.col("hi")
    first = groups.select(
        "field_name", "lo", "hi", "n_left", "items", F.posexplode(F.slice("items", 1, F.col("n_left"))).alias("i", "x")
    )
    start = F.when(inside, F.col("i") + 2).otherwise(F.col("n_left") + 1)
    rest = F.slice("items", start, F.greatest(F.size("items") - start + 1, F.lit(0)))
    both = first.select("field_name", "x", F.explode(rest).alias("y"))
    return both.select("field_name", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))


def cooccurrence(
    rows: DataFrame, min_pairs: int = 5, min_share: float = 0.0, chunk_items: int = CHUNK_ITEMS,
    limit: int = BROADCAST_BYTES
) -> DataFrame:
    """(field_name, item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, pmi, npmi) for item_a < item_b.

    ``rows`` has field_name, basket, item; repeated rows count once, null baskets and items are left out, items compare
    by code point; a basket of one item gives no pair but counts in n_baskets. Only pairs in at least ``min_pairs``
    baskets and in the share ``min_share`` of a field's baskets come out. Baskets of more than ``chunk_items`` items
    are cut into chunks; no basket is cut short. Tables of items and of huge baskets are broadcast up to ``limit`` bytes;
    beyond it their hot keys are split off.
    """
    once = materialize(
        rows.select("field_name", "basket", "item").filter(
            F.col("basket").isNotNull() & F.col("item").isNotNull()
        ).distinct(),
        "baskets"
    )
    singles = once.groupBy("field_name", "item").agg(F.count(F.lit(1)).alias("n"))
    baskets = once.select("field_name", "basket").distinct()
    totals = materialize(baskets.groupBy("field_name").agg(F.count(F.lit(1)).alias("n_baskets")), "totals")
    totals = F.broadcast(totals)  # a row per field
    # the share is taken a little lower than it is written, as it may not have an exact double
    least = F.greatest(F.lit(min_pairs), F.ceil(F.col("n_baskets") * min_share * (1 - 1e-12)))
    # a pair occurs at most as often as its rarer item
    items = singles.join(totals, "field_name").filter(F.col("n") >= least).select("field_name", "item", "n", "n_baskets")
    items = materialize(items, "items")
    names = items.select("field_name", "item")
    hot = lambda: heavy_of(items, ["field_name", "item"], "n")
    kept = sized_join(once, names, ["field_name", "item"], "left_semi", limit, hot)
    pairs = _pairs(_chunk_pairs(kept, chunk_items, limit))
    counts = pairs.groupBy("field_name", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))
    counts = counts.join(totals, "field_name").filter(F.col("n_ab") >= least).drop("n_baskets")
    counts = materialize(counts, "pairs")
    a = items.select("field_name", F.col("item").alias("item_a"), F.col("n").alias("n_a"), "n_baskets")
    b = items.select("field_name", F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    out = sized_join(counts, a, ["field_name", "item_a"], "inner", limit)
    out = sized_join(out, b, ["field_name", "item_b"], "inner", limit)
    p = F.col("n_ab").cast("double") / F.col("n_baskets")
    lift = p * F.col("n_baskets") / F.col("n_a") * F.col("n_baskets") / F.col("n_b")
    return out.select(
        "field_name", "item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets",
        lift.alias("lift"), F.log(lift).alias("pmi"),
        F.when(p < 1, F.log(lift) / -F.log(p)).otherwise(1.0).alias("npmi"),
    )
