"""Connected components of a distributed edge list, and links inside buckets of any size."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.shared import is_empty, stage
from sparkgauge.session import scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.unionByName(back)


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest of a and its neighbours b. A table of its own: both sides of the join that
    follows are then plain exchanges, which Spark can split where one node is hot."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return stage(least.select("a", F.least("a", "m").alias("m")), "least")


def _are_stars(edges: DataFrame) -> bool:
    """True if every node a has one neighbour b only, and no b is also an a."""
    ends = edges.select("a", F.lit(1).alias("own"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("own"), F.lit(1).alias("centre"))
    )
    counted = ends.groupBy("a").agg(F.sum("own").alias("own"), F.max("centre").alias("centre"))
    return is_empty(counted.where("own + centre > 1"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest reachable node.

    Large-star and small-star steps (Kiveris et al., 2014) take turns until the edges are stars
    around the smallest nodes. Edge columns a, b may be of any ordered type; loops and repeated
    edges do no harm. Every step is an aggregate with map-side combine and one equi-join; at
    most one row per round reaches the driver.
    """
    order = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    with scratch() as keep:
        now = keep(_stars(stage(order.distinct(), "edges")))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)


def _stars(now: DataFrame) -> DataFrame:
    """The edges of the table `now`, as a table of stars around the smallest nodes."""
    while not _are_stars(now):
        both = _both_ways(now)
        large = (
            both.join(_least(both), "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = stage(large.distinct(), "large_star")
        least = _least(large)
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
        )
        now = stage(small.distinct(), "small_star")
    return now


def _pairs(frame: DataFrame) -> DataFrame:
    return frame.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(
        F.col("a") != F.col("b")
    )


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    with scratch() as keep:
        labels = stage(components(edges), "labels").select(F.col("node").alias("id"), "component")
        columns = [F.col(c) for c in members.columns]
        labelled = members.join(labels, "id", "left").select(
            *columns, F.coalesce("component", "id").alias("label")
        )
        return keep(stage(labelled, "labelled"))


def inner_pairs(members: DataFrame, condition: Column | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of ids in one bucket. The other columns of `members` are there
    under their names with _a and _b for `condition`, which the join itself tests."""
    sides = [
        members.select(
            F.col("bucket").alias(f"bucket_{x}"),
            F.col("id").alias(x),
            *[F.col(c).alias(f"{c}_{x}") for c in members.columns if c not in ("bucket", "id")],
        )
        for x in "ab"
    ]
    on = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("a") < F.col("b"))
    on = on if condition is None else on & condition
    return sides[0].join(sides[1], on).select("a", "b")


def to_first(members: DataFrame) -> DataFrame:
    """Pairs of every id with the smallest of its bucket."""
    first = stage(members.groupBy("bucket").agg(F.min("id").alias("a")), "first_ids")
    return members.select("bucket", F.col("id").alias("b")).join(first, "bucket").select("a", "b")


def bucket_links(
    members: Callable[[], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[DataFrame], DataFrame],
    rest: Callable[[DataFrame], DataFrame],
    condition: Column | None = None,
    small: int = 16,
) -> DataFrame:
    """Confirmed links (a, b) that connect all that is connected inside the buckets.

    `members` makes (bucket, id, ...); `verify` keeps the pairs (a, b) that are really linked.
    Buckets of up to `small` ids have all their pairs verified. A larger one mostly holds a
    family of near copies, where a pair inside an already connected part adds nothing: a few
    pairs per id, which `near` picks, come first. Then the ids get the label of the part that
    they are connected to, and `rest` has to give every pair of ids with different labels that
    may still be linked. So no component is missed, and a family's pairs are never written out.
    """
    with scratch() as keep:
        few, crowd = (keep(t) for t in _by_size(members(), small))
    with scratch() as keep:
        candidates = inner_pairs(few, condition)
        crowded = not is_empty(crowd)
        if crowded:
            candidates = candidates.unionByName(near(crowd).select("a", "b"))
        tried = keep(stage(_pairs(candidates).distinct(), "candidates"))
    with scratch() as keep:
        edges = keep(stage(verify(tried), "links"))
    if not crowded:
        return edges
    with scratch() as keep:
        fresh = _pairs(rest(_labelled(crowd, edges)).select("a", "b")).distinct()
        fresh = keep(stage(fresh.join(tried, ["a", "b"], "left_anti"), "fresh"))
    if is_empty(fresh):
        return edges
    with scratch() as keep:
        return keep(stage(edges.unionByName(verify(fresh)), "links"))


def _by_size(members: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Tables of the members in buckets of two to `small` ids, and in larger ones."""
    members = stage(members, "members")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = stage(sizes, "bucket_sizes")
    few = members.join(sizes.where(f"n <= {small}").select("bucket"), "bucket")
    crowd = members.join(sizes.where(f"n > {small}").select("bucket"), "bucket")
    return stage(few, "few"), stage(crowd, "crowd")


def deal(rows: DataFrame, size: int) -> DataFrame:
    """Add (block, left) to rows with (bucket, id): a bucket beyond `size` rows becomes pairs of
    blocks (i <= j), and a row of block i goes to each pair with i. `left` tells the side, null
    where the pair is a block with itself: all pairs of rows meet exactly once."""
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    large = stage(
        counts.where(F.col("n") > size).select(
            "bucket", F.ceil(F.col("n") / size).cast("long").alias("s")
        ),
        "large_buckets",
    )
    own = F.pmod(F.xxhash64("id"), F.col("s"))
    others = F.sequence(F.lit(0).cast("long"), F.coalesce("s", F.lit(1)) - 1)
    return (
        rows.join(large, "bucket", "left")
        .withColumn("i", F.coalesce(own, F.lit(0)))
        .withColumn("j", F.explode(others))
        .select(
            *rows.columns,
            F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("block"),
            F.when(F.col("i") != F.col("j"), F.col("i") < F.col("j")).alias("left"),
        )
    )


def block_sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers on both sides of a block pair, and whether they are the same rows."""
    left = group.column("left")
    if left.null_count:
        every = np.arange(group.num_rows)
        return every, every, True
    side = left.to_numpy()
    return np.flatnonzero(side), np.flatnonzero(~side), False


def map_blocks(
    rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply `work` to the rows of each `block`, which `deal` keeps small."""

    def mapper(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            key = table.column("block").to_numpy()
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                if end - start > 1 and (out := work(table.slice(start, end - start))) is not None:
                    yield out
            rest = table.slice(starts[-1])
        if rest is not None and rest.num_rows > 1 and (out := work(rest)) is not None:
            yield out

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(mapper, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (id, smallest id of its tree) of the links between a and b; in memory."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    apart = label != np.arange(len(ids))
    return ids[apart], ids[label[apart]]
