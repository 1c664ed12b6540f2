"""Hard negatives of anchor vectors by Fagin's threshold algorithm.

Components are quantised to whole numbers, floor(scale * x), and the score of two vectors is their
inner product, in 64-bit integers. An anchor's positives are its best `positives` other rows of the same
label. For each positive the negatives are the best `negatives` rows of another label whose score
lies in the window low * p <= 100 * n <= 100 * p under the positive's score p. Higher scores come
first, equal ones by smaller vec_id.

The rows are dealt out to blocks of a bounded number of rows, and the anchors go to every block. A
block holds one candidate list for each dimension, sorted by component. An anchor reads the lists from the
end that its component's sign makes best (dimensions in which it is 0 not at all), in ever larger steps; rows
seen for the first time are scored in full. The threshold, the inner product of the anchor with
the components last read, bounds the scores of all rows not yet seen. A window is done once the threshold
is strictly below its kth score (an equal score might still come with a smaller vec_id), or below its lower
end; reading stops when all windows are done. The best rows of the blocks are then ranked together.
Two such passes are made, first for the positives over the rows of the anchor's label, then for the windows.

Every anchor is compared with all rows, in blocks: the work is anchors times rows, and the anchors
are repeated once per block. Nothing is broadcast or collected. Memory of a task: a block, about
16 bytes a component, and a batch of anchors.

Rows without vec_id or label, without vector, or with a null or non-finite component take no part.
Rows that repeat a vec_id: the one with the least (label, vector) stands. Vectors of other lengths have no score
with each other, empty vectors none at all. Quantised vectors whose scores might not fit in 64 bits are an
error. Extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.llm.shared import stage

BLOCK_ROWS = 8192
#: Entries that an anchor reads from each list in its first step; each step doubles the depth.
FIRST_STEP = 16


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v) with v an array of longs, one row per vec_id."""
    x = F.col("x")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0))
    infinite = [F.lit(float("inf")), F.lit(float("-inf"))]
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & ~c.isin(*infinite))
    rows = rows.where(fine)
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return (
        rows.select("vec_id", "label", whole.alias("v"))
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "v")).alias("r"))
        .select("vec_id", "r.label", "r.v")
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Lists:
    """The candidates of one block, with a list of row numbers for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        by_id = np.argsort(ids)
        self.ids, self.labels, self.x = ids[by_id], labels[by_id], x[by_id]
        self.order = np.ascontiguousarray(np.argsort(-self.x, axis=0, kind="stable").T.astype(np.int32))

    def of_label(self, label: int) -> "Lists":
        mine = self.labels == label
        return Lists(self.ids[mine], self.labels[mine], self.x[mine])

    def read(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Row numbers seen for the first time, their scores, and the threshold, step by step."""
        n = len(self.ids)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        dims = np.concatenate([up, down])
        seen = np.zeros(n, bool)
        start, step = 0, FIRST_STEP
        if not len(dims):  # nothing to read: all scores are 0
            yield np.arange(n), np.zeros(n, np.int64), -np.inf
            return
        while start < n:
            end = min(n, start + step)
            now = np.zeros(n, bool)
            now[self.order[up, start:end]] = True
            now[self.order[down, n - end : n - start]] = True
            rows = np.flatnonzero(now & ~seen)
            seen |= now
            last = np.concatenate([self.order[up, end - 1], self.order[down, n - end]])
            threshold = int(a[dims] @ self.x[last, dims]) if end < n else -np.inf
            yield rows, self.x[rows] @ a, threshold
            start, step = end, 2 * step


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller rows (rows are in order of id)."""
    if len(rows) > 4 * k:  # only what reaches the kth score has to be sorted
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= kth)
        return few[np.lexsort((rows[few], -scores[few]))[:k]]
    return np.lexsort((rows, -scores))[:k]


class Best:
    """The best k scores between low (times 100) and high, seen so far."""

    def __init__(self, low: int | None, high: int | None, k: int):
        self.low, self.high, self.k, self.done = low, high, k, False
        self.scores, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, threshold: float) -> None:
        if self.high is not None:
            inside = (scores <= self.high) & (scores * 100 >= self.low)
            rows, scores = rows[inside], scores[inside]
        rows, scores = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores])
        best = _best(scores, rows, self.k)
        self.rows, self.scores = rows[best], scores[best]
        full = len(self.scores) == self.k and threshold < self.scores[-1]
        self.done = full or (self.low is not None and threshold * 100 < self.low)


def top_rows(
    lists: Lists, a: np.ndarray, windows: list[Best], skip_id: int | None, skip_label: int | None
) -> None:
    """Fill the windows with the best rows, other than those of one id or of one label."""
    for rows, scores, threshold in lists.read(a):
        if skip_id is not None:
            keep = lists.ids[rows] != skip_id
            rows, scores = rows[keep], scores[keep]
        if skip_label is not None:
            keep = lists.labels[rows] != skip_label
            rows, scores = rows[keep], scores[keep]
        for window in windows:
            if not window.done:
                window.add(rows, scores, threshold)
        if all(w.done for w in windows):
            return


def _blocks(rows: DataFrame, anchors: DataFrame, work, schema: str, blocks: int) -> DataFrame:
    """`work(block, anchors)` for each block of `rows` and the batches of all anchors.

    A block's rows come first in its task, the anchors after them, a batch at a time.
    """
    dealt = rows.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(0).alias("side"), "vec_id", "label", "v",
        F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives"),
    )
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(1).alias("side"), "vec_id", "label", "v", "positives",
    )

    def mapper(batches):
        block, held, lists = None, [], {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = table.column("block").to_numpy() * 2 + table.column("side").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(start, end - start).combine_chunks()
                if key[start] >> 1 != block:
                    block, held, lists = key[start] >> 1, [], {}
                if not key[start] & 1:
                    held.append(part)
                    continue
                if held:
                    lists, held = _by_length(pa.concat_tables(held)), []
                if (out := work(lists, part)) is not None:
                    yield out

    parted = dealt.unionByName(asked).repartitionById(blocks, "block")
    return parted.sortWithinPartitions("block", "side", "label").mapInArrow(mapper, schema)


def _by_length(rows: pa.Table) -> dict[int, Lists]:
    sizes = np.array([len(v) for v in rows.column("v")])
    out = {}
    for size in np.unique(sizes):
        some = rows.take(np.flatnonzero(sizes == size)).combine_chunks()
        ids, labels = (some.column(c).to_numpy() for c in ("vec_id", "label"))
        out[int(size)] = Lists(ids, labels, _matrix(some.column("v").chunk(0)))
    return out


def _each_anchor(lists: dict, anchors: pa.Table):
    """(anchor row number, its lists, its components) of the anchors that have candidates here."""
    checked = {}
    for i, v in enumerate(anchors.column("v")):
        a = np.array(v.as_py(), np.int64)
        if (own := lists.get(len(a))) is None:
            continue
        top = checked.setdefault(len(a), np.abs(own.x.astype(np.float64)).max(0))
        if top @ np.abs(a.astype(np.float64)) >= 2.0**62 / 100:
            raise ValueError("scores of these quantised vectors might not fit in 64 bits")
        yield i, own, a


def _table(columns: list[list], names: list[str]) -> pa.RecordBatch | None:
    if not columns[0]:
        return None
    return pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names)


def _positives_of(k: int):
    def work(lists: dict, anchors: pa.Table):
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        by_label: dict[tuple[int, int], Lists] = {}
        out = [[], [], []]
        for i, own, a in _each_anchor(lists, anchors):
            key = (len(a), int(labels[i]))
            if key not in by_label:
                # Anchors come in order of label, so one label's lists are kept at a time.
                by_label = {key: own.of_label(key[1])}
            window = Best(None, None, k)
            top_rows(by_label[key], a, [window], int(ids[i]), None)
            out[0].append(np.full(len(window.rows), ids[i]))
            out[1].append(by_label[key].ids[window.rows])
            out[2].append(window.scores)
        return _table(out, ["anchor_id", "positive_id", "positive_score"])

    return work


def _negatives_of(k: int, low: int):
    def work(lists: dict, anchors: pa.Table):
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        wanted = anchors.column("positives")
        out = [[], [], [], [], []]
        for i, own, a in _each_anchor(lists, anchors):
            positives = wanted[i].as_py()
            windows = [Best(low * p["score"], p["score"], k) for p in positives]
            top_rows(own, a, windows, None, int(labels[i]))
            for p, window in zip(positives, windows, strict=True):
                n = len(window.rows)
                for column, values in zip(
                    out,
                    (np.full(n, ids[i]), np.full(n, p["id"]), own.ids[window.rows], np.full(n, p["score"]), window.scores),
                    strict=True,
                ):
                    column.append(values)
        return _table(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return work


def _ranked(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The best k rows per key. A rank limit is applied before the shuffle as well, so that a
    key's task gets k rows from each task before it at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str = "vec_id % 100 = 0",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` has vec_id, label and embedding; `is_anchor` is a condition on vec_id.
    """
    rows = stage(quantised(vectors, scale), "quantised")
    n = rows.count()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few rows are cut into smaller blocks, for all tasks to have some; never into larger ones.
    blocks = max(1, -(-n // block_rows), min(parts, n // 256))
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    anchors = rows.where(is_anchor).withColumn("positives", none)
    schema = "anchor_id long, positive_id long, positive_score long"
    found = _blocks(rows, anchors, _positives_of(positives), schema, blocks)
    best = stage(_ranked(found, ["anchor_id"], "positive_score", "positive_id", positives), "positives")
    pairs = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(
            F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
        ).alias("positives")
    )
    asked = stage(anchors.drop("positives").join(pairs, "vec_id"), "anchors")
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _blocks(rows, asked, _negatives_of(negatives, low), schema, blocks)
    ranked = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def relabelled(vectors: DataFrame) -> DataFrame:
    """Every seventh row moved to the next of ten labels, so that labels hold some noise."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")
