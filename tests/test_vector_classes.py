import numpy as np

from larder.operators.matching import components
from larder.operators.vectors import linked_vectors, similar_vectors
from larder.plans.serving import vector_classes


def write(spark, folder, x, more=()):
    data = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + list(more)
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    df.repartition(4).write.parquet(f"{folder}/embeddings.parquet")
    return {r["node"]: r["component"] for r in vector_classes(spark, str(folder)).collect()}


def test_copies_share_the_class_of_their_vector(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(60, 32)).astype(np.float32)
    one = [float(v) for v in x[7]]
    more = [(900 + i, one) for i in range(30)] + [(990, [0.0] * 32), (991, [0.0] * 32), (992, None), (993, None)]
    got = write(spark, tmp_path, x, more)
    assert len(got) == 94 and {got[900 + i] for i in range(30)} == {got[7]}
    assert all(got[i] == i for i in range(990, 994))


def test_recall_with_a_third_of_the_rows_just_below_the_threshold(spark):
    """1,000 of 3,000 rows lie at cosine 0.89 to one direction, at about 0.79 to each other; each of 100 linked pairs
    among them is a class of its own and must be found."""
    r = np.random.default_rng(1)
    axis = np.eye(64)[0]

    def around(n, c):
        d = r.normal(size=(n, 64))
        d[:, 0] = 0
        return c * axis + np.sqrt(1 - c * c) * d / np.linalg.norm(d, axis=1)[:, None]

    dense, e = around(1000, 0.89), r.normal(size=(100, 64))
    e -= (e * dense[:100]).sum(axis=1)[:, None] * dense[:100]
    near = 0.905 * dense[:100] + np.sqrt(1 - 0.905**2) * e / np.linalg.norm(e, axis=1)[:, None]
    x = np.concatenate([dense, near, r.normal(size=(1900, 64))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(u @ u.T >= 0.9, 1))}
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "id bigint, embedding array<float>")
    got = {(p["a"], p["b"]) for p in similar_vectors(df, 0.9).collect()}
    assert len(want) >= 100 and got == want, f"{len(want - got)} of {len(want)} links lost"
    classes = {c["node"]: c["component"] for c in components(df.select("id"), linked_vectors(df, 0.9)).collect()}
    assert all(classes[a] == classes[b] for a, b in want)
    assert len(set(classes.values())) == len(x) - len(want)


def test_blocks_meet_each_other(spark):
    r = np.random.default_rng(2)
    c = r.normal(size=(6, 16))
    x = np.concatenate([c[i % 6] + 0.4 * r.normal(size=(1, 16)) for i in range(150)]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "id bigint, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(np.round(u @ u.T, 9) >= 0.8, 1))}
    pairs = [(p["a"], p["b"]) for p in similar_vectors(df, 0.8, block=40).collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    few = linked_vectors(df, 0.8, block=40)
    assert {(p["a"], p["b"]) for p in few.collect()} <= want
    of = lambda e: {p["node"]: p["component"] for p in components(df.select("id"), e).collect()}
    assert of(few) == of(spark.createDataFrame(sorted(want), "a bigint, b bigint"))
