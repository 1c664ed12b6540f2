"""Quality of texts by a factorisation machine.

Features are hashed words, structure statistics of the text and its length as metadata. A score
takes linear time: pairwise interactions add up as half of (sum of v x)^2 - sum of (v x)^2 in
each of RANK dimensions. The machine is fitted with Adam on a bounded sample of labelled
documents, weighted to the share of the labels; the rest of the documents is only scored.

Null and empty texts are scored by their structure statistics, which are those of no words.
Without labels of both kinds the score is the share of ones, 0 without any. Repeated rows are
scored one by one; null ids are never held out; extra columns are ignored.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.bytewords import NOT_BLANK, byte_class, flat, per_text, span_hashes, spans
from sparkgauge.llm.shared import map_texts, stage
from sparkgauge.llm.toxicity import labelled_sample, learning_rows

#: Labelled documents per class that the machine is fitted on, at most.
ONES, ZEROS = 2000, 2000
BUCKETS, RANK, STEPS, RATE = 1 << 12, 8, 120, 0.05
_KINDS = (
    byte_class((0x41, 0x5A)),  # capitals
    byte_class((0x61, 0x7A)),
    byte_class((0x30, 0x39)),
    byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),  # signs
    byte_class((0x80, 0xFF)),
    byte_class((0x0A, 0x0A)),
)
STATISTICS = len(_KINDS) + 7


class Model(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    bias: float
    linear: np.ndarray  # BUCKETS + STATISTICS
    factors: np.ndarray  # BUCKETS + STATISTICS, RANK


def features(texts: pa.Array):
    """(text, bucket, value) of the hashed words, and the structure statistics per text."""
    raw, bounds = flat(texts)
    starts, ends = spans(raw, NOT_BLANK)
    hashes = span_hashes(raw, starts, ends)
    begin = per_text(starts, bounds)
    n = np.diff(begin)
    texts_n = len(n)
    owner = np.repeat(np.arange(texts_n), n)
    count, size = np.maximum(n, 1), np.maximum(np.diff(bounds) - 1, 1)
    sums = np.concatenate([np.zeros((1, len(_KINDS))), np.cumsum([k[raw] for k in _KINDS], 1).T])
    shares = np.diff(sums[bounds], axis=0) / size[:, None]
    shares[:, 5] = np.maximum(shares[:, 5] - 1 / size, 0)  # the closing line feed is ours
    wide = np.bincount(owner, ends - starts, texts_n) / count
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=texts_n) / count
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again = np.bincount(owner[again], minlength=texts_n) / count
    sign = _KINDS[3]
    tail = np.bincount(owner, sign[raw[ends - 1]] & sign[raw[np.maximum(ends - 2, 0)]], texts_n)
    alone = np.bincount(owner, sign[raw[starts]] & (ends - starts == 1), texts_n)
    statistics = np.column_stack(
        [shares, wide, distinct, again, tail / count, alone / count, np.log1p(n), np.log1p(size)]
    )
    bucket = (hashes >> np.uint64(52)).astype(np.int64)
    key, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
    value = np.sqrt(times / count[key // BUCKETS])
    return key // BUCKETS, key % BUCKETS, value, statistics


def _raw_scores(owner, bucket, value, dense, model: Model) -> np.ndarray:
    count = len(dense)
    z = (dense - model.mean) / model.spread
    linear, factors = model.linear, model.factors
    out = model.bias + z @ linear[BUCKETS:] + np.bincount(owner, value * linear[bucket], count)
    for f in range(RANK):
        v = value * factors[bucket, f]
        d = z * factors[BUCKETS:, f]
        total = np.bincount(owner, v, count) + d.sum(1)
        squares = np.bincount(owner, v * v, count) + (d * d).sum(1)
        out += (total * total - squares) / 2
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_sample(owner, bucket, value, dense, y: np.ndarray, share: float) -> Model:
    """Fit on the features of a sample, weighted as if `share` of it had the label 1."""
    mean, spread = dense.mean(0), dense.std(0) + 1e-6
    draw = np.random.default_rng(9)
    params = {
        "bias": np.zeros(1),
        "linear": np.zeros(BUCKETS + STATISTICS),
        "factors": draw.normal(0, 0.02, (BUCKETS + STATISTICS, RANK)),
    }
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
    z = (dense - mean) / spread
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    for step in range(1, STEPS + 1):
        model = Model(mean, spread, params["bias"][0], params["linear"], params["factors"])
        error = weight * (_sigmoid(_raw_scores(owner, bucket, value, dense, model)) - y)
        ev = error[owner] * value
        grad = {"bias": np.array([error.sum()])}
        grad["linear"] = np.concatenate([np.bincount(bucket, ev, BUCKETS), error @ z])
        g = np.empty_like(params["factors"])
        ev2, z2 = np.bincount(bucket, ev * value, BUCKETS), error @ (z * z)
        for f in range(RANK):
            v = params["factors"][:, f]
            total = np.bincount(owner, value * v[bucket], len(y)) + z @ v[BUCKETS:]
            g[:BUCKETS, f] = np.bincount(bucket, ev * total[owner], BUCKETS) - ev2 * v[:BUCKETS]
            g[BUCKETS:, f] = (error * total) @ z - z2 * v[BUCKETS:]
        grad["factors"] = g
        for k, v in params.items():
            d = grad[k] + (1e-4 * v if k != "bias" else 0)
            first, second = moments[k]
            first += 0.1 * (d - first)
            second += 0.001 * (d * d - second)
            v -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(mean, spread, float(params["bias"][0]), params["linear"], params["factors"])


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5) -> Model:
    rows = stage(learning_rows(labels, "quality", fold), "quality_rows")
    share = rows.agg(F.avg("y")).first()[0]
    sample = labelled_sample(docs, rows, ONES, ZEROS)

    def work(run: pa.RecordBatch) -> pa.RecordBatch:
        owner, bucket, value, dense = features(run.column("text"))
        starts = pa.array(np.searchsorted(owner, np.arange(run.num_rows + 1)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                run.column("doc_id"),
                run.column("y"),
                pa.ListArray.from_arrays(starts, pa.array(bucket, pa.int32())),
                pa.ListArray.from_arrays(starts, pa.array(value)),
                pa.array(dense.tolist(), pa.list_(pa.float64())),
            ],
            ["doc_id", "y", "bucket", "value", "dense"],
        )

    # At most ONES + ZEROS rows of at most BUCKETS entries.
    kept = map_texts(
        sample.select("doc_id", "y", "text"),
        work,
        "doc_id long, y int, bucket array<int>, value array<double>, dense array<double>",
    )
    table = kept.orderBy("doc_id", "dense").toArrow()
    y = table.column("y").to_numpy().astype(float)
    if len(y) and 0 < y.mean() < 1:
        buckets = table.column("bucket").combine_chunks()
        owner = np.repeat(np.arange(len(y)), buckets.value_lengths().to_numpy())
        value = table.column("value").combine_chunks().flatten().to_numpy()
        dense = np.array(table.column("dense").to_pylist())
        return fit_sample(owner, buckets.flatten().to_numpy(), value, dense, y, share)
    odds = np.clip(share or 0.0, 1e-9, 1 - 1e-9)
    none = np.zeros(BUCKETS + STATISTICS)
    bias = float(np.log(odds / (1 - odds)))
    return Model(none[:STATISTICS], none[:STATISTICS] + 1, bias, none, np.zeros((len(none), RANK)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row, in the reading tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(run: pa.RecordBatch) -> pa.RecordBatch:
        p = _sigmoid(_raw_scores(*features(run.column("text")), shared.value))
        return pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(picked, work, "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame, fold: int = 5, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == 0
    return score(docs, fit(docs, labels, fold)).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
