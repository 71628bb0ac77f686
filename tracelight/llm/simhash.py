"""SimHash fingerprints, and near-duplicates by covering locality-sensitive hashing.

For radius r, each of the 64 bit positions gets a random vector of r + 1 bits; each of the 2**(r + 1) - 1
nonzero vectors v gives one table, whose mask has the positions with an odd product with v. Whatever
r positions two fingerprints differ in, some v is orthogonal to all their vectors, so the pair agrees
under that mask: every pair within the radius meets in some table.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import arrays as A
from tracelight.llm import repeats as R
from tracelight.llm.components import components
from tracelight.llm.tables import row_keyed, stored

RADIUS = 3
SHINGLE_WORDS = 3
#: Distinct fingerprints of one key of a table from which on the key is split further.
LARGE_GROUP = 4096
_SEED = 42


def covering_masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """Masks of 64 bits of which, for any ``radius`` positions, one has none of them."""
    rng = random.Random(seed)
    vectors = [rng.randrange(1 << (radius + 1)) for _ in range(64)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))
    ]


def _fingerprints(shingle: int):
    def run(batches):
        for block in A.blocks(batches, limit=A.SMALL_BLOCK_BYTES):
            u = R.units(block.column("text"), words=True)
            text = A.LOWER[u.data].tobytes()
            found = np.zeros(block.num_rows, np.uint64)
            for d in range(block.num_rows):
                a, b = u.offsets[d], u.offsets[d + 1]
                if b > a:
                    found[d] = fingerprint(text, u.starts[a:b], u.ends[a:b], shingle)
            yield pa.RecordBatch.from_arrays(
                [block.column("rid"), block.column("owner"), pa.array(found.view(np.int64))], names=["rid", "owner", "fp"]
            )

    return run


def fingerprint(text: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int) -> int:
    """Bits set in over half of the shingles' XXH64 values, of words that stand one blank apart."""
    n = max(1, len(starts) - shingle + 1)
    last = ends[min(shingle, len(ends)) - 1 :]
    digest, seed = xxhash.xxh64_intdigest, _SEED
    hashes = np.array(
        [digest(text[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64
    )
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _star_links(radius: int):
    """Links that connect, inside each group of one key, all fingerprints within the radius."""

    def run(batches):
        for table in R.whole_groups(batches, "bucket"):
            key, fp = table.column("bucket").to_numpy(), table.column("fp").to_numpy()
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(key)), strict=True):
                if b - a > 1:
                    left, right = spanning_links(np.unique(fp[a:b]), radius)
                    if len(left):
                        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return run


def spanning_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the fingerprints that joins those within the radius, by search from each unseen one.

    Every fingerprint is compared once with those not yet reached, a row at a time, so neither pairs
    nor links pile up.
    """
    left, right = [], []
    rest = fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = _bits((rest ^ one).view(np.uint64)) <= radius
            if near.any():
                reached = rest[near]
                left.append(reached)
                right.append(np.full(len(reached), one))
                front.extend(reached)
                rest = rest[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` (long) that chains within the radius join.

    Fingerprints meet by masked value in each table. A key with over ``LARGE_GROUP`` of them is split:
    its open bits are cut into radius + 1 parts, of which a pair within the radius shares one.
    """
    masks = covering_masks(radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("m")).select(
        "fp", "m.mask", F.col("m.t").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key")
    )
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE_GROUP)
    marked = keyed.join(large, ["t", "key"], "left")
    parts = []
    for m in masks:
        free = [i for i in range(64) if not m >> i & 1]
        cuts = [sum(1 << i for i in free[p :: radius + 1]) for p in range(radius + 1)]
        parts.append(F.array(*[F.lit(signed(m | c)) for c in cuts]))
    finer = F.element_at(F.array(*parts), F.col("t") + 1)
    split = F.when(F.col("n").isNull(), F.array(F.col("mask"))).otherwise(finer)
    buckets = marked.select("fp", "t", F.posexplode(split).alias("part", "mask")).select(
        F.xxhash64("t", "part", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp"
    )
    return (
        buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_star_links(radius), "a long, b long").distinct()
    )


def link_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE_WORDS
) -> DataFrame:
    """rid, the id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row.

    Fingerprints link at ``radius`` or fewer differing bits. Null and empty texts have fingerprint
    zero and link like any other. Rows may repeat; a null id gives its group no id, and a group of
    null ids only has a null component_id. An empty table gives an empty result.
    """
    linked = _linked(row_keyed(docs, id_col, text_col), radius, shingle)
    return linked.select(
        "rid",
        F.col("owner").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.owner").alias("component_id"),
    )


def _linked(keyed: DataFrame, radius: int, shingle: int) -> DataFrame:
    """rid, owner, ``fp`` and ``least``, the first row (owner, rid; null owners last) of its group, of every row."""
    prints = stored(
        keyed.select("rid", "owner", "text").mapInArrow(_fingerprints(shingle), "rid long, owner long, fp long"), "prints"
    )
    place = F.struct(F.col("owner").isNull().alias("nobody"), "owner", "rid")
    distinct = stored(prints.groupBy("fp").agg(F.min(place).alias("first")), "distinct")
    found = components(near_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    grouped = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = grouped.groupBy("component").agg(F.min("first").alias("least"))
    return prints.join(grouped.join(named, "component").select("fp", "least"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, the first by id, null ids last; columns as they are.

    Rows of one id are told apart: of equal ones any one stays, and others go only with their own group.
    Columns may have any names. Null and empty texts are one group. An empty table gives an empty result.
    """
    inner = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    keyed = row_keyed(inner, "_id", "_text", ["_row"])
    lost = _linked(keyed, RADIUS, SHINGLE_WORDS).filter("rid <> least.rid").select("rid")
    return keyed.join(lost, "rid", "left_anti").select("_row.*")
