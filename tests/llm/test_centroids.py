import hashlib
import math

import duckdb
import numpy as np
import pytest

from tracelight.llm import queries as Q
from tracelight.llm.centroids import Centroids, cluster_vectors

SF = "/root/testdata/sf0.001"


def brute(rows, k=8, rounds=10, dimension=64):
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) and abs(x) <= 131072 for x in v)
    ]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    starts = sorted((sha(f"3:{i}"), np.array(v, np.int64).tobytes(), v) for i, v in kept if i is not None)
    points = [v for _, _, v in starts[:k]]
    if not points:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        points = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else p for c, p in enumerate(points)]
    found = [(i, *near(v)) for i, v in kept]
    total = {c: sum(d for _, d, b in found if b == c) for c in range(len(points))}
    return sorted(
        ((i, c, d, total[c], sum(total.values()), sha(",".join(map(str, points[c])))) for i, d, c in found), key=str
    )


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force_and_sql(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = Q.op12_centroid_clustering(spark, SF)
    assert got(found) == brute(rows)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        table = db.execute(Q.ORACLE["op12_centroid_clustering"])
        assert [c[0] for c in table.description] == found.columns
        assert sorted(table.fetchall(), key=str) == got(found)


@pytest.fixture
def odd():
    rng = np.random.default_rng(8)
    nan, inf = float("nan"), float("inf")
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 1024]) for i in range(200)]  # many ties
    rows += [(5, rows[5][1]), (5, rows[9][1]), (None, rows[3][1]), (None, rows[3][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 2.0, 3.0]), (904, [nan, 0.0, 0.0, 0.0])]
    rows += [(905, [inf, 0.0, 0.0, 0.0]), (906, [-131072.0, 131072.0, -0.0005, 0.0]), (907, [1e300, 0.0, 0.0, 0.0]), (908, [1.0] * 5)]
    return rows


@pytest.mark.parametrize("k", [1, 2, 8, 50, 1000])
def test_odd_vectors(spark, odd, k):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in odd], "vec_id long, embedding array<double>, cluster int, id string")
    assert got(cluster_vectors(table, k=k, rounds=3, dimension=4)) == brute(odd, k, 3, 4)


def test_few_and_no_vectors(spark, odd):
    schema = "vec_id long, embedding array<float>"
    assert got(cluster_vectors(spark.createDataFrame([], schema))) == []
    assert got(cluster_vectors(spark.createDataFrame([(1, None), (2, [1.0])], schema))) == []
    assert got(cluster_vectors(spark.createDataFrame([(None, [0.5] * 64)], schema))) == []
    few = [(1, [0.5] * 64), (2, [0.25] * 64), (2, [0.25] * 64), (3, [-1.5] * 64)]
    assert got(cluster_vectors(spark.createDataFrame(few, schema))) == brute(few)


def test_search_finds_the_nearest_and_passes_many_by():
    rng = np.random.default_rng(1)
    points = rng.integers(-1000, 1000, (200, 3))
    vectors = np.concatenate([rng.integers(-1000, 1000, (3000, 3)), points, (points[:-1] + points[1:]) // 2])
    apart = ((vectors[:, None, :] - points[None]) ** 2).sum(axis=2)
    best, least = Centroids(points).nearest(vectors)
    assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
    twice = np.concatenate([points, points])  # equal centroids: the smaller number
    best, _ = Centroids(twice).nearest(vectors)
    assert (best == apart.argmin(axis=1)).all()
