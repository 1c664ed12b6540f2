"""Near-duplicate embeddings: sign hashes in several tables, exact cosines, components.

Each table cuts the vectors by the signs of `bits` random projections; `bits` grows with the
logarithm of their number and the number of tables follows from it, so that a pair just at the
threshold shares no bucket with chance MISS. Inside a bucket all cosines are computed, as
matrix products in double precision. Buckets beyond BLOCK vectors are dealt out as pairs of
blocks. A pair counts in the first table that both vectors share, so links are counted
without ever writing pairs; for the components a block sends one spanning link per vector.

Equal vectors are one class from the start. Vectors that are null, zero, or hold null or
non-finite components link with nothing; so do rows without an id, which get a null component
and are kept. Vectors of different lengths never link. Rows that share an id are separate
vectors. Extra columns are ignored.
"""

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.bytewords import mix
from sparkgauge.llm.components import block_sides, components, deal, forest, map_blocks
from sparkgauge.llm.shared import stage

MISS = 1e-6
#: Vectors per bucket that the number of bits aims at, and per block of a large bucket.
AIM, BLOCK = 256, 512
SEED = 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def plan(count: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = max(4, math.ceil(math.log2(max(1, count / AIM))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


@functools.lru_cache(4)
def _planes(dim: int, count: int) -> np.ndarray:
    """Random planes with whole-number entries: projections are then exact in any order."""
    draw = np.random.default_rng([SEED, dim]).standard_normal((count, dim))
    return np.rint(draw * 1024).T


def _codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket number of unit vectors in each table."""
    sides = np.rint(unit * (1 << 20)) @ _planes(unit.shape[1], bits * tables) > 0
    powers = np.left_shift(np.int64(1), np.arange(bits))
    return sides.reshape(len(unit), tables, bits) @ powers


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(False).astype(float).reshape(len(lists), -1)


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, f1, f2, v); v and the fingerprints are null where nothing can link."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    good = F.when(fine & some & F.col("vec_id").isNotNull(), v)
    return vectors.select(F.col("vec_id").cast("long"), good.alias("v")).select(
        "vec_id",
        F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("f1"),
        F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), F.reverse("v"))).alias("f2"),
        "v",
    )


def _buckets(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(bucket, place, id) of every class in every table."""

    def mapper(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("v")], np.int64)
            for dim in np.unique(sizes):
                own = batch.filter(pa.array(sizes == dim))
                codes = _codes(_unit(_matrix(own.column("v"))), bits, tables).astype(np.uint64)
                for place in range(tables):
                    with np.errstate(over="ignore"):
                        start = np.uint64(dim) * np.uint64(tables) + np.uint64(place)
                        bucket = mix(mix(np.array([start])) * _STEP + codes[:, place])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(bucket.view(np.int64)),
                            pa.array(np.full(len(bucket), place, np.int32)),
                            own.column("cid"),
                        ],
                        ["bucket", "place", "id"],
                    )

    return classes.select("cid", "v").mapInArrow(mapper, "bucket long, place int, id long")


def _links(blocks: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(cid, links, root): links first found in a block, and a spanning link."""

    def linked(group: pa.Table) -> pa.RecordBatch | None:
        unit = _unit(_matrix(group.column("v").combine_chunks()))
        cid = group.column("id").to_numpy()
        weight = group.column("n").to_numpy()
        one, two, same = block_sides(group)
        near = unit[one] @ unit[two].T >= threshold
        a, b = np.nonzero(np.triu(near, 1) if same else near)
        a, b = one[a], two[b]
        if not len(a):
            return None
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        codes = _codes(unit[used], bits, tables)
        a, b = at[: len(a)], at[len(a) :]
        new = np.ones(len(a), bool)
        for earlier in range(int(group.column("place")[0].as_py())):
            new &= codes[a, earlier] != codes[b, earlier]
        a, b, cid, weight = a[new], b[new], cid[used], weight[used]
        if not len(a):
            return None
        links = np.bincount(a, weight[b], len(used)) + np.bincount(b, weight[a], len(used))
        node, root = forest(cid[a], cid[b])
        parent = dict(zip(node.tolist(), root.tolist(), strict=True))
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(cid[some]),
                pa.array(links[some].astype(np.int64)),
                pa.array([parent.get(c, c) for c in cid[some].tolist()], pa.int64()),
            ],
            ["cid", "links", "root"],
        )

    return map_blocks(blocks, linked, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: other vectors at a cosine of at least
    `threshold`, and the smallest vec_id reachable by such links."""
    rows = stage(_valid(vectors), "vectors")
    grouped = rows.where("f1 is not null").groupBy("f1", "f2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")
    )
    classes = stage(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector_classes")
    bits, tables = plan(classes.count(), threshold)
    dealt = deal(stage(_buckets(classes, bits, tables), "sign_buckets"), BLOCK)
    blocks = dealt.join(classes.select(F.col("cid").alias("id"), "n", "v"), "id")
    found = stage(_links(blocks, bits, tables, threshold), "vector_links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(
        F.col("node").alias("cid"), "component"
    )
    joined = stage(
        classes.select("f1", "f2", "cid", "id", "n")
        .join(counts, "cid", "left")
        .join(label, "cid", "left")
        .select(
            "f1", "f2", "id",
            F.coalesce("component", "cid").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        ),
        "linked_classes",
    )
    least = stage(joined.groupBy("component").agg(F.min("id").alias("component_id")), "least_ids")
    known = stage(
        joined.join(least, "component").select("f1", "f2", "n_links", "component_id"), "known"
    )
    plain = rows.select("vec_id", "f1", "f2")
    linked = plain.where("f1 is not null").join(known, ["f1", "f2"])
    alone = plain.where("f1 is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    both = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return both.withColumn("kept", kept)
