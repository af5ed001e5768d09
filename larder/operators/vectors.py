"""Vectors: exact nearest neighbours of a stated query set, hybrid embeddings, substitution scores, user segments."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.numeric import finite, steady_round
from larder.functions.vocabulary import SEGMENT_REST, SEGMENT_RULES
from larder.operators.quantiles import exact_quantiles
from larder.operators.skew import heavy_of, split_join

#: Query vectors broadcast at once.
BLOCK = 2_000

#: Vectors of a block of the join of all vectors, broadcast at once.
LINK_BLOCK = 20_000


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, accumulated in double; null if one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The columns of the ``k`` highest values of each row, ties by smaller id. Only what is not below the k-th value is sorted."""
    out = np.empty((s.shape[0], min(k, s.shape[1])), dtype=np.int64)
    if s.shape[1] <= k:
        return np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    for r in range(s.shape[0]):
        at = np.flatnonzero(s[r] >= least[r])
        out[r] = at[np.lexsort((ids[at], -s[r, at]))[:k]]
    return out


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` rows of highest cosine for each query, itself left out, exactly.

    ``queries`` and ``rows`` have id and embedding. The queries are a stated set and are taken in blocks of bounded size
    against all rows; every task keeps k rows per query, the rest is a merge of those. Null and zero vectors match
    nothing; ties go to the smaller id.
    """
    spark = rows.sparkSession
    q = queries.select(
        F.col("id").cast("bigint").alias("id"), "embedding"
    ).filter("id is not null and embedding is not null")
    n_blocks = max(1, math.ceil(q.count() / block))
    parts = []
    for b in range(n_blocks):
        mine = q.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b) if n_blocks > 1 else q
        got = mine.collect()
        ids = np.array([r["id"] for r in got], dtype=np.int64)
        m = np.array([r["embedding"] for r in got], dtype=np.float64).reshape(len(got), -1 if got else 0)
        norm = np.linalg.norm(m, axis=1)
        ids, m = ids[norm > 0], m[norm > 0] / norm[norm > 0, None]
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for p in batches:
                p = p[p["embedding"].notna() & p["id"].notna()]
                if not len(p) or not len(ids):
                    continue
                x = np.stack(p["embedding"].to_numpy()).astype(np.float64)
                other, norm = p["id"].to_numpy(dtype=np.int64), np.linalg.norm(x, axis=1)
                x, other = x[norm > 0] / norm[norm > 0, None], other[norm > 0]
                s = np.round(m @ x.T, 9)
                s[ids[:, None] == other[None, :]] = -np.inf
                top = _best(s, other, k)
                out = pd.DataFrame(
                    {
                        "query_id": np.repeat(ids, top.shape[1]), "id": other[top].ravel(),
                        "similarity": np.take_along_axis(s, top, 1).ravel()
                    }
                )
                yield out[np.isfinite(out["similarity"])]

        parts.append(
            rows.select(F.col("id").cast("bigint").alias("id"), "embedding").mapInPandas(
                run, "query_id bigint, id bigint, similarity double"
            )
        )
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid_embedding(
    df: DataFrame, id_col: str, vector: str, numbers: list[str], weights: tuple[float, float] = (0.7, 0.3)
) -> DataFrame:
    """(id, embedding): the text vector and the standardised numbers (gaps by median, population deviation), weighted,
    joined and scaled to length 1. The statistics are one row."""
    middle = exact_quantiles(df, numbers, [0.5])
    filled = [F.coalesce(finite(F.col(c)), F.lit(middle[c, 0.5] or 0.0)) for c in numbers]
    s = df.agg(
        *[F.avg(f).alias(f"a_{c}") for c, f in zip(numbers, filled, strict=True)],
        *[F.stddev_pop(f).alias(f"s_{c}") for c, f in zip(numbers, filled, strict=True)]
    ).first()
    scaled = [
        ((f - F.lit(s[f"a_{c}"] or 0.0)) / F.lit(s[f"s_{c}"] or 1.0)) * weights[1] for c,
        f in zip(numbers, filled, strict=True)
    ]
    text = F.transform(vector, lambda v: v.cast("double") * weights[0])
    whole = F.concat(text, F.array(*scaled))
    length = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda a, v: a + v * v))
    return df.select(F.col(id_col).alias("id"), whole.alias("_e")).select(
        "id", F.transform("_e", lambda v: v / F.nullif(length, F.lit(0.0))).alias("embedding")
    )


def substitution_scores(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Neighbour pairs with the differences of their features, health delta and recommendation score.

    ``pairs`` has query_id, id, similarity; ``features`` has id, rating, sentiment, protein, saturated_fat, sugar, sodium.
    """
    names = [c for c in features.columns if c != "id"]
    a = features.select(F.col("id").alias("query_id"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = features.select("id", *[F.col(c).alias(f"b_{c}") for c in names])
    j = pairs.join(a, "query_id").join(b, "id")
    d = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in names}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    health = 0.4 * zero(d["protein"]) - 0.25 * zero(d["saturated_fat"]) - 0.2 * zero(d["sugar"]) - 0.15 * zero(d["sodium"])
    score = 0.6 * F.col("similarity") + 0.2 * zero(d["rating"]) + 0.1 * zero(d["sentiment"]) + 0.1 * health
    return j.select(
        F.col("query_id").alias("candidate_id"), F.col("id").alias("substitute_id"), steady_round(F.col("similarity")).alias("similarity"),
        *[
            steady_round(v).alias(f"{c}_delta") for c, v in d.items()
        ], steady_round(health).alias("health_delta"), steady_round(score).alias("recommendation_score"),
    )


def segment_users(
    df: DataFrame, id_col: str, features: list[str], ks: tuple[int, ...] = (4, 5, 6),
    seeds: tuple[int, ...] = tuple(range(42, 52)), sample: int = 10_000
) -> DataFrame:
    """(id, cluster_id, cluster_label): K-Means on the standardised features of all rows, each k with the best of ten
    starts; k by the silhouette over ``sample`` rows picked by the hash of their id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from larder.session import materialize

    filled = df.select(
        F.col(id_col).alias("_id"), *[F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in features]
    ).filter("_id is not null")
    vec = VectorAssembler(inputCols=features, outputCol="_v").transform(filled)
    if filled.isEmpty():
        return filled.select(F.col("_id").alias(id_col), F.lit(0).alias("cluster_id"), F.lit("").alias("cluster_label"))
    scaler = StandardScaler(inputCol="_v", outputCol="features", withMean=True, withStd=True).fit(vec)
    data = materialize(scaler.transform(vec), "scaled")
    small = materialize(data.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("features"), "sample")
    best = None
    for k in ks:
        models = [KMeans(k=k, seed=s, featuresCol="features", predictionCol="cluster_id").fit(data) for s in seeds]
        model = min(models, key=lambda m: m.summary.trainingCost)
        got = model.transform(small)
        if got.select("cluster_id").distinct().count() < 2:
            continue
        score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster_id").evaluate(got)
        if best is None or score > best[0]:
            best = (score, model)
    if best is None:
        return filled.select(
            F.col("_id").alias(id_col), F.lit(0).alias("cluster_id"), F.lit(SEGMENT_REST).alias("cluster_label")
        )
    out = best[1].transform(data)
    centroids = {r["cluster_id"]: r for r in out.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in features]).collect()}  # k rows
    names = segment_labels(centroids)
    label = F.coalesce(*[F.when(F.col("cluster_id") == c, F.lit(n)) for c, n in names.items()])
    return out.select(F.col("_id").alias(id_col), "cluster_id", label.alias("cluster_label"), *features)


def segment_labels(centroids: dict, rules: tuple[tuple[str, str], ...] = SEGMENT_RULES) -> dict[int, str]:
    """Names for the few segments: each rule takes the unused one with the highest mean, the rest is general."""
    names: dict[int, str] = {}
    for feature, label in rules:
        free = [c for c in sorted(centroids) if c not in names]
        if free and feature in centroids[free[0]].asDict():
            names[max(free, key=lambda c: centroids[c][feature])] = label
    return {c: names.get(c, SEGMENT_REST) for c in centroids}


def _usable(df: DataFrame) -> DataFrame:
    """(id, embedding) of the rows that can match: an id, no null or NaN in the vector, not all zero."""
    return df.select(F.col("id").cast("bigint").alias("id"), "embedding").filter(
        "id is not null and exists(embedding, v -> v <> 0) and forall(embedding, v -> v is not null and not isnan(v))"
    )


def equal_vectors(df: DataFrame) -> DataFrame:
    """(a, b), a < b: every id whose vector another id has too, with the smallest such id; null and zero vectors equal
    nothing. A vector with a large share of all rows meets its smallest id by broadcast."""
    from larder.session import materialize

    ok = _usable(df)
    counts = materialize(ok.groupBy("embedding").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("_n")), "copies")
    first = counts.filter("_n > 1").select("embedding", "a")
    return split_join(ok, first, ["embedding"], heavy=heavy_of(counts, ["embedding"])).filter("a <> id").select(
        "a", F.col("id").alias("b")
    )


def _spanning(links: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, column) of enough ``links`` to join all that they join; ``group`` has the group of each column so far and
    is brought up to date."""
    for r in np.flatnonzero(links.any(axis=1)):
        at = np.flatnonzero(links[r])
        of = group[at]
        if (of == of[0]).all():
            yield r, at[0]
            continue
        old, first = np.unique(of, return_index=True)
        group[np.isin(group, old)] = old[0]
        for c in at[first]:
            yield r, c


def _block_join(df: DataFrame, least: float, every: bool, block: int, tile: int = 1_024) -> DataFrame:
    """(a, b, similarity), a < b: pairs of different vectors with cosine of at least ``least``, exactly.

    Copies are represented by their smallest id. The vectors are cut into blocks by the hash of their id; one block at a
    time is broadcast and meets the rows of its own and all later blocks in tiles, so every pair is compared once and a
    dense region needs no more memory than any other. Without ``every`` a task gives only as many pairs as join all that
    are linked to its block, at most one a row and one a vector of the block.
    """
    from larder.session import materialize

    spark = df.sparkSession
    unit = materialize(_usable(df).groupBy("embedding").agg(F.min("id").alias("id")), "vectors")
    n_blocks = max(1, math.ceil(unit.count() / block))
    number = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    unit = materialize(unit.withColumn("_b", number).repartition("_b", "id"), "vectors", ["_b"] if n_blocks > 1 else None)
    parts = []
    for k in range(n_blocks):
        got = unit.filter(F.col("_b") == k).select("id", "embedding").orderBy("id").toPandas()  # about ``block`` rows
        if got.empty:
            continue
        m = np.stack(got["embedding"].to_numpy()).astype(np.float64)
        shared = spark.sparkContext.broadcast(
            (got["id"].to_numpy(dtype=np.int64), m / np.linalg.norm(m, axis=1, keepdims=True))
        )

        def run(batches: Iterator[pd.DataFrame], shared=shared, k=k) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            group = np.arange(len(ids))
            for p in batches:
                for start in range(0, len(p), tile):
                    t = p.iloc[start:start + tile]
                    x = np.stack(t["embedding"].to_numpy()).astype(np.float64)
                    i, own = t["id"].to_numpy(dtype=np.int64), t["_b"].to_numpy() == k
                    s = np.round(x / np.linalg.norm(x, axis=1, keepdims=True) @ m.T, 9)
                    links = s >= least
                    if every:
                        links &= ~own[:, None] | (i[:, None] < ids[None, :])
                        u, v = np.nonzero(links)
                    else:
                        u, v = np.array(list(_spanning(links, group)), dtype=np.int64).reshape(-1, 2).T
                    out = pd.DataFrame(
                        {"a": np.minimum(i[u], ids[v]), "b": np.maximum(i[u], ids[v]), "similarity": s[u, v]}
                    )
                    yield out[out["a"] < out["b"]]

        pairs = unit.filter(F.col("_b") >= k).select("id", "embedding", "_b").mapInPandas(
            run, "a bigint, b bigint, similarity double"
        )
        if n_blocks > 1:  # else the broadcasts of all blocks are held at once
            pairs = materialize(pairs, "pairs")
            shared.destroy()
        parts.append(pairs)
    empty = spark.createDataFrame([], "a bigint, b bigint, similarity double")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def similar_vectors(df: DataFrame, least: float, block: int = LINK_BLOCK) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of different vectors with cosine of at least ``least``.

    Equal vectors are one beforehand (their smallest id stands for them), so copies give no pairs. Null and zero vectors
    match nothing. The work is quadratic, and so is the result where much of the data is alike.
    """
    return _block_join(df, least, True, block)


def linked_vectors(df: DataFrame, least: float, block: int = LINK_BLOCK) -> DataFrame:
    """(a, b), a < b: links of cosine of at least ``least`` whose components are the classes of all such links, copies
    included. All pairs are compared, but links inside what is joined already are left out."""
    return _block_join(df, least, False, block).select("a", "b").unionByName(equal_vectors(df))
