"""Exact integer k-means whose nearest centroids are found by Orchard search.

Each centroid has a list of the others by distance from it. A vector starts at some centroid and goes
along its list. A closer centroid is jumped to at once: its list goes on from the start, and centroids
that were visited are passed by. Once the next of the list lies strictly beyond twice the vector's own
distance, the triangle inequality says that everything after it is farther away, so the search ends. As
it ends only strictly beyond, centroids at equal distance are all seen, and the smaller number wins.

Vectors are whole numbers (floor(1024 x)), distances are squared and exact. A round is one pass over the
stored vectors: every task returns sums per centroid, grouped sums give the next centroids, and only
``k`` centroids come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.tables import stored

K = 8
ROUNDS = 10
DIMENSION = 64
SCALE = 1024
#: Whole components beyond this have squared distances that do not fit in a long.
LARGEST = 1 << 27
#: Vectors times centroids of which a task keeps the visited marks at once.
_MARKS = 1 << 22


class Centroids:
    """Centroids, and for each the others in order of distance."""

    def __init__(self, points: np.ndarray):
        self.points = points
        k = len(points)
        apart = np.zeros((k, k), np.int64)
        for i in range(k):
            apart[i] = ((points - points[i]) ** 2).sum(axis=1)
        far = apart.astype(np.float64)
        np.fill_diagonal(far, -1)
        self.lists = np.lexsort((np.broadcast_to(np.arange(k), (k, k)), far), axis=1)[:, 1:]
        self.apart = np.take_along_axis(apart, self.lists, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the centroid nearest to each vector; of equal ones the smallest number."""
        k = len(self.points)
        best, least = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        step = max(1, _MARKS // k)
        for i in range(0, len(vectors), step):
            best[i : i + step], least[i : i + step] = self._search(vectors[i : i + step])
        return best, least

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(vectors), len(self.points)
        at = np.zeros(n, np.int64)  # the centroid whose list is gone along
        best = at.copy()
        least = ((vectors - self.points[0]) ** 2).sum(axis=1)
        place = np.zeros(n, np.int64)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        going = np.arange(n)
        while len(going):
            going = going[place[going] < k - 1]
            own, where = at[going], place[going]
            # strictly beyond twice the distance: of the squares, four times
            going = going[self.apart[own, where] <= 4 * least[going]]
            other = self.lists[at[going], place[going]]
            place[going] += 1
            new = ~visited[going, other]
            asked, other = going[new], other[new]
            visited[asked, other] = True
            distance = ((vectors[asked] - self.points[other]) ** 2).sum(axis=1)
            closer = distance < least[asked]
            tied = (distance == least[asked]) & (other < best[asked])
            best[asked[tied]] = other[tied]
            jump = asked[closer]
            best[jump] = at[jump] = other[closer]
            least[jump] = distance[closer]
            place[jump] = 0
        return best, least


def _whole(values: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are vectors, and those as whole numbers."""
    values = values.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(values), -1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(sizes == dimension)
    flat = values.take(pa.array(fit)).flatten()
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)  # nulls become nan
    with np.errstate(all="ignore"):
        scaled = np.floor(numbers * SCALE)
        good = (np.abs(scaled) <= LARGEST).all(axis=1)
    return fit[good], scaled[good].astype(np.int64)


def _keep(dimension: int):
    def run(batches):
        for batch in batches:
            kept, vectors = _whole(batch.column("vector"), dimension)
            rows = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(8 * dimension), len(kept), [None, pa.py_buffer(np.ascontiguousarray(vectors).tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(kept)), rows.cast(pa.binary())], names=["id", "vector"]
            )

    return run


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.int64).reshape(-1, dimension)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """(id, vector) of the rows that have a vector, its whole components as bytes; written to the shared folder."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    kind = rows.select(f"`{id_col}`").dtypes[0][1]
    taken = rows.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"))
    return stored(taken.mapInArrow(_keep(dimension), f"id {kind}, vector binary"), "vectors")


def _sums(centroids: Centroids, dimension: int):
    def run(batches):
        k = len(centroids.points)
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = _vectors(batch.column("vector"), dimension)
            best, _ = centroids.nearest(vectors)
            counts += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            some = np.flatnonzero(np.bincount(best, minlength=k))
            if len(some):
                sums[some] += np.add.reduceat(vectors[order], np.searchsorted(best[order], some), axis=0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    return run


def moved(vectors: DataFrame, centroids: Centroids, dimension: int) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors, where they have any."""
    parts = vectors.mapInArrow(_sums(centroids, dimension), "cluster long, n long, sums array<long>")
    total = (
        parts.select("cluster", "n", F.posexplode("sums"))
        .groupBy("cluster", "pos")
        .agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    )
    points = centroids.points.copy()
    for row in total.collect():
        points[row.cluster, row.pos] = int(row.total) // row.n
    return points


def first_centroids(vectors: DataFrame, k: int, dimension: int) -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of ``3:<id>``, in that order; rows of equal ids by their components."""
    text = F.concat(F.lit("3:"), F.col("id").cast("string"))
    rows = (
        vectors.filter("id is not null")
        .select(F.sha2(text.cast("binary"), 256).alias("h"), "vector")
        .orderBy("h", "vector")
        .limit(k)
        .collect()
    )
    return np.frombuffer(b"".join(bytes(r.vector) for r in rows), np.int64).reshape(-1, dimension)


def fit_centroids(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION) -> Centroids | None:
    """Centroids after ``rounds`` rounds over the result of ``whole_vectors``; None if there is no vector."""
    points = first_centroids(vectors, k, dimension)
    if not len(points):
        return None
    for _ in range(rounds):
        points = moved(vectors, Centroids(points), dimension)
    return Centroids(points)


def _assign(centroids: Centroids, dimension: int):
    def run(batches):
        for batch in batches:
            best, distance = centroids.nearest(_vectors(batch.column("vector"), dimension))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"]
            )

    return run


def cluster_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dimension: int = DIMENSION,
) -> DataFrame:
    """Per vector its id, cluster, squared distance, inertia of the cluster and of all, and the centroid's digest.

    Vectors of another length and those with a null or non-finite component are left out; so are those
    with components beyond ±131072, whose squared distances are no longs. Ids may repeat, each row is a
    vector of its own. Rows of null id are assigned, but never the start of a centroid. With fewer than
    ``k`` vectors of an id there are as many centroids; with none, or for an empty table, the result is
    empty. Of centroids at equal distance the one of smaller number is the nearest; one without vectors
    stays where it is. Other columns of ``rows`` are not looked at.
    """
    vectors = whole_vectors(rows, id_col, vector_col, dimension)
    centroids = fit_centroids(vectors, k, rounds, dimension)
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance long"
    if centroids is None:
        assigned = vectors.filter("false").selectExpr("id", "0 as cluster", "0L as distance")
        points = []
    else:
        assigned = stored(vectors.mapInArrow(_assign(centroids, dimension), schema), "clusters")
        points = centroids.points.tolist()
    # one row for each of the k centroids, so both tables are of bounded size
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    whole = sum(r.cluster_inertia for r in inertia)
    told = [(r.cluster, r.cluster_inertia, whole, _digest(points[r.cluster])) for r in inertia]
    facts = rows.sparkSession.createDataFrame(
        told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return (
        assigned.join(F.broadcast(facts), "cluster")
        .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )


def _digest(point: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, point)).encode()).hexdigest()


def _round_sql(i: int, last: bool) -> str:
    assigned = f"""
        a{i} AS MATERIALIZED (
            SELECT row, vec_id, v, min(struct_pack(d := d, c := c)) AS near
            FROM (
                SELECT row, vec_id, v, c,
                    list_sum(list_transform(list_zip(v, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
                FROM kept, c{i}
            ) GROUP BY row, vec_id, v
        )"""
    if last:
        return assigned
    return assigned + f""",
        c{i + 1} AS MATERIALIZED (
            SELECT c, coalesce(q, p) AS p
            FROM c{i} LEFT JOIN (
                SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS q
                FROM (
                    SELECT near.c AS c, pos, sum(v[pos])::HUGEINT AS s, count(*)::HUGEINT AS n
                    FROM a{i}, range(1, {DIMENSION + 1}) t(pos) GROUP BY ALL
                ) GROUP BY c
            ) USING (c)
        )"""


#: The same rounds without Orchard search: every vector against every centroid.
ORACLE = f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = {DIMENSION} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS p
            FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h LIMIT {K})
        ),{",".join(_round_sql(i, i == ROUNDS) for i in range(ROUNDS + 1))}
        SELECT vec_id, near.c::INT AS cluster, near.d AS distance,
            (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(p, ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN c{ROUNDS} ON near.c = c"""
