"""Near duplicates by a MinHash LSH forest, confirmed on full shingle sets.

Every tree of the forest sorts the signatures from a place of its own. Texts with a common
prefix of `DEPTH` hashes in some tree are candidates. Where a prefix is shared by many (a
family of near copies, a common passage), the tree goes as much deeper as that region needs,
and neighbours in its sorted order, which share the longest prefixes, are compared first; what these
leave apart is compared signature by signature in blocks. Candidates pass an estimate on the signatures and are then confirmed on the full sets.

Texts with equal sets are one class from the start. Null or empty texts have an empty set and
link with nothing. Rows without an id link with nothing either: null component, kept. Rows
that share an id count as one document. Extra columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.llm.bytewords import NOT_BLANK, mix, words
from sparkgauge.llm.components import block_sides, bucket_links, components, deal, map_blocks
from sparkgauge.llm.shared import is_empty, map_texts, rows_of, runs, stage, without

DEPTH = 4
#: Chance that a pair just at the threshold shares no prefix in any tree.
MISS = 1e-6
#: Standard errors below the threshold at which an estimate still passes.
MARGIN = 4.5
#: Rows of a region that one task sorts; larger ones are cut at deeper prefixes.
REGION = 2000
#: Signatures per side that are compared with each other in memory.
BLOCK = 512
#: Bits of the map of a set, which bounds from above what two sets can share.
MAP_BITS = 2048
_STEP = np.uint64(0xD6E8FEB86659FD93)


def trees_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**DEPTH))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted inside each, and where each text's begin.

    A text of fewer than `size` words has one shingle, its whole sequence of words.
    """
    hashes, bounds = words(texts, NOT_BLANK)
    counts = np.diff(bounds)
    out = np.zeros(len(hashes), np.uint64)
    valid = np.zeros(len(hashes), bool)
    with np.errstate(over="ignore"):
        for n in range(1, size + 1):
            if n < size:
                at = bounds[:-1][counts == n]
            else:
                last = np.repeat(bounds[1:], counts)
                at = np.flatnonzero(np.arange(len(hashes)) + n <= last)
            total = np.full(len(at), n, np.uint64)
            for j in range(n):
                total = total * _STEP + hashes[at + j]
            out[at], valid[at] = mix(total), True
    text = np.repeat(np.arange(len(counts)), counts)[valid]
    out = out[valid]
    starts = np.searchsorted(text, np.arange(len(counts) + 1))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[fresh], np.searchsorted(text[fresh], np.arange(len(counts) + 1))


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return base[:count].astype(np.uint32), base[count:].astype(np.uint32) | np.uint32(1)


def signatures(docs: DataFrame, size: int, hashes: int) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, sig): 128-bit fingerprint of each set; its MinHashes, size
    and bit map in one binary value."""
    flips, factors = _seeds(hashes)
    one, two = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

    def work(run: pa.RecordBatch) -> pa.RecordBatch:
        sets, bounds = shingle_sets(run.column("text"), size)
        counts = np.diff(bounds)
        some = np.flatnonzero(counts)
        at = bounds[some]
        low = sets.astype(np.uint32)
        least = np.empty((len(some), hashes), ">u4")
        prints = np.zeros((2, len(counts)), np.uint64)
        if len(some):
            with np.errstate(over="ignore"):
                for i in range(hashes):
                    least[:, i] = np.minimum.reduceat((low ^ flips[i]) * factors[i], at)
                prints[0, some] = np.add.reduceat(mix(sets ^ one), at)
                prints[1, some] = np.add.reduceat(mix(sets ^ two), at)
        bits = np.zeros((len(some), MAP_BITS), bool)
        bits[np.repeat(np.arange(len(some)), counts[some]), sets >> np.uint64(53)] = True
        maps = np.packbits(bits, axis=1)
        sigs: list[bytes | None] = [None] * len(counts)
        for row, k in enumerate(some):
            number = np.array([counts[k]], ">u4")
            sigs[k] = least[row].tobytes() + number.tobytes() + maps[row].tobytes()
        return pa.RecordBatch.from_arrays(
            [
                run.column("doc_id"),
                pa.array(counts),
                pa.array(prints[0].view(np.int64), mask=counts == 0),
                pa.array(prints[1].view(np.int64), mask=counts == 0),
                pa.array(sigs, pa.binary()),
            ],
            ["doc_id", "n_shingles", "fp1", "fp2", "sig"],
        )

    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return map_texts(
        picked, work, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary"
    )


def _parse(sigs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHashes, set sizes and bit maps (as 64-bit words) of a column of signatures."""
    listed = sigs.to_pylist()
    raw = np.frombuffer(b"".join(listed), np.uint8).reshape(len(listed), -1)
    body = raw.shape[1] - MAP_BITS // 8 - 4
    words = [np.ascontiguousarray(x) for x in np.split(raw, [body, body + 4], axis=1)]
    hashes, size = (x.view(">u4").astype(np.uint32) for x in words[:2])
    return hashes, size[:, 0].astype(np.int64), words[2].view(np.uint64)


def _may_link(sizes, maps, other_sizes, other_maps, threshold: float) -> np.ndarray:
    """False for pairs that surely miss the threshold: bits of one map that the other lacks
    are shingles that it lacks."""
    most = np.minimum(
        sizes - np.bitwise_count(maps & ~other_maps).sum(1),
        other_sizes - np.bitwise_count(other_maps & ~maps).sum(1),
    )
    return most >= threshold * (sizes + other_sizes - most) - 1e-6


def _buckets(classes: DataFrame, trees: int) -> DataFrame:
    """(bucket, id): one row per tree; the tree is in the low byte of the bucket."""

    def mapper(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _parse(batch.column("sig"))[0].astype(np.uint64)
            ids = batch.column("id")
            with np.errstate(over="ignore"):
                for tree in range(trees):
                    key = np.full(len(sig), tree, np.uint64)
                    for level in range(tree * DEPTH, (tree + 1) * DEPTH):
                        key = mix(key * _STEP + sig[:, level])
                    key = (key & ~np.uint64(0xFF)) | np.uint64(tree)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), ids], ["bucket", "id"]
                    )

    return classes.select("id", "sig").mapInArrow(mapper, "bucket long, id long")


def _neighbours(crowd: DataFrame, classes: DataFrame, hashes: int) -> DataFrame:
    """Pairs next to each other in the sorted order of a tree, inside crowded regions."""
    skip = (F.col("bucket").bitwiseAND(F.lit(0xFF)) * DEPTH * 4).cast("int")
    turned = F.concat(
        F.expr(f"substring(sig, cast((bucket & 255) * {DEPTH * 4} as int) + 1, {hashes * 4})"),
        F.substring("sig", F.lit(1), skip),
    )
    rows = stage(
        crowd.join(classes.select("id", "sig"), "id").select(
            "bucket", "id", turned.alias("sorted"), F.col("bucket").alias("region")
        ),
        "regions",
    )
    done, depth = None, DEPTH
    while True:
        crowded = rows.groupBy("region").count().where(F.col("count") > REGION).select("region")
        crowded = stage(crowded, "crowded_regions")
        calm = rows.join(crowded, "region", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        depth = depth * 2
        if not crowded.take(1):
            break
        deeper = F.substring("sorted", 1, 4 * depth)
        if depth >= 2 * hashes:  # equal signatures all along: any order serves
            deeper = F.col("id").bitwiseAND(F.lit(depth // hashes - 1)).cast("string").cast("binary")
        rows = stage(
            rows.join(crowded, "region").withColumn("region", F.xxhash64("region", deeper)),
            "regions",
        )
    order = Window.partitionBy("region").orderBy("sorted", "id")
    before = done.select(
        F.col("id").alias("a"),
        F.lag("id", 1).over(order).alias("one"),
        F.lag("id", 2).over(order).alias("two"),
    )
    return before.select("a", F.explode(F.array("one", "two")).alias("b")).where("b is not null")


def _confirmed(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose full sets reach the threshold."""

    def mapper(batches):
        for run in (y for batch in batches for x in runs(batch, "text_a") for y in runs(x, "text_b")):
            one, bounds_one = shingle_sets(run.column("text_a"), size)
            two, bounds_two = shingle_sets(run.column("text_b"), size)
            linked = np.zeros(run.num_rows, bool)
            for i in range(run.num_rows):
                a = one[bounds_one[i] : bounds_one[i + 1]]
                b = two[bounds_two[i] : bounds_two[i + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield run.select(["a", "b"]).filter(pa.array(linked))

    return pairs.mapInArrow(mapper, "a long, b long")


def _likely(pairs: DataFrame, least: float, threshold: float) -> DataFrame:
    """Pairs whose signatures agree in a share of at least `least` of their hashes, and whose
    bit maps leave the threshold within reach."""

    def mapper(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (_parse(batch.column(c)) for c in ("sig_a", "sig_b"))
            near = (one[0] == two[0]).mean(axis=1) >= least
            near &= _may_link(*one[1:], *two[1:], threshold)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.mapInArrow(mapper, "a long, b long")


def _apart(
    labelled: DataFrame, classes: DataFrame, least: float, threshold: float
) -> DataFrame:
    """Pairs with different labels in a crowded bucket whose signatures are near.

    Signatures are compared block by block inside tasks; a pair is given out in the first tree
    in which both share a prefix, so only likely pairs are ever rows.
    """

    def work(group: pa.Table) -> pa.RecordBatch | None:
        one, two, same = block_sides(group)
        label = group.column("label").to_numpy()
        if (label == label[0]).all():
            return None
        sig, sizes, maps = _parse(group.column("sig"))
        hashes = sig.shape[1]
        agree = np.zeros((len(one), len(two)), np.uint16)
        for h in range(hashes):
            agree += sig[one, h][:, None] == sig[two, h][None, :]
        near = (agree >= least * hashes) & (label[one][:, None] != label[two][None, :])
        a, b = np.nonzero(np.triu(near, 1) if same else near)
        a, b = one[a], two[b]
        new = _may_link(sizes[a], maps[a], sizes[b], maps[b], threshold)
        a, b = a[new], b[new]
        equal = sig[a] == sig[b]
        new = np.ones(len(a), bool)
        for tree in range(int(group.column("bucket")[0].as_py()) & 0xFF):
            new &= ~equal[:, tree * DEPTH : (tree + 1) * DEPTH].all(axis=1)
        ids = group.column("id").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids[a[new]]), pa.array(ids[b[new]])], ["a", "b"])

    rows = deal(labelled, BLOCK).join(classes.select("id", "sig"), "id")
    return map_blocks(rows, work, "a long, b long")


def _ids(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs`.

    Linked are documents with 100 * intersection >= percent * union of their sets of shingles
    of `size` words; component_id is the smallest doc_id reachable by links.
    """
    threshold = percent / 100
    trees = trees_for(threshold)
    hashes = max(128, trees * DEPTH)
    least = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / hashes)
    rows = stage(signatures(docs, size, hashes), "signatures")
    classes = stage(
        rows.where("sig is not null and doc_id is not null")
        .groupBy("fp1", "fp2")
        .agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")),
        "classes",
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))

    def verify(pairs: DataFrame) -> DataFrame:
        known = stage(rows_of(classes.select("id", "sig"), _ids(pairs, "id"), "id"), "pair_sigs")
        left = known.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
        right = known.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
        likely = stage(
            _likely(pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b"), least, threshold),
            "likely",
        )
        full = stage(rows_of(texts, _ids(likely, "id"), "id"), "pair_texts")
        left = full.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        right = full.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        both = likely.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return _confirmed(both, size, percent)

    links = bucket_links(
        lambda: _buckets(classes, trees),
        verify,
        near=lambda crowd: _neighbours(crowd, classes, hashes),
        rest=lambda labelled: _apart(labelled, classes, least, threshold),
    )
    found = components(links).select(F.col("node").alias("id"), "component")
    labels = stage(
        classes.select("fp1", "fp2", "id")
        .join(found, "id", "left")
        .select("fp1", "fp2", F.coalesce("component", "id").alias("component_id")),
        "class_components",
    )
    plain = rows.select("doc_id", "n_shingles", "fp1", "fp2")
    linked = (
        plain.where("fp1 is not null and doc_id is not null")
        .join(labels, ["fp1", "fp2"])
        .select("doc_id", "n_shingles", "component_id")
    )
    alone = plain.where("fp1 is null or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(alone).withColumn("kept", kept)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with its columns, one document of every group of near duplicates.

    Of rows that repeat an id the least stays; rows without an id all stay.
    """
    marked = stage(near_duplicates(docs, size, percent), "marked")
    gone = stage(marked.where("not kept").select("doc_id").distinct(), "gone")
    kept = without(docs, gone, "doc_id")
    twice = stage(
        marked.where("kept and doc_id is not null")
        .groupBy("doc_id").count().where("count > 1").select("doc_id"),
        "repeated_ids",
    )
    if is_empty(twice):
        return kept
    # Types without an order, as maps, are compared by their text.
    order = [
        F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
        for f in docs.schema.fields
    ]
    least = rows_of(kept, twice, "doc_id").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*order)).alias("_row")
    )
    return without(kept, twice, "doc_id").unionByName(least.select("_row.*"))
