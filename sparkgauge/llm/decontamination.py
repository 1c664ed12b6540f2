"""Training documents that contain benchmark items: BM25 with block maxima, then overlap.

The items (parts of up to PART words, longer ones in several parts) form an inverted index with
BM25 impacts, scaled so that a part's impacts add up to 1. Every passage (2 * PART words, every
PART words) is a query. Its terms of least weight, which together stay below half the
threshold, need no postings; the postings of the others are read as block maxima, and only
blocks of parts whose bound reaches the threshold are scored exactly. All parts above the
threshold are then verified: share of the question's five-word shingles and of the answer's
words in the passage. The answer is an item's last sentence (its last quarter of words if there
is one sentence only), the question what stands before it.

Items of fewer than MIN_WORDS words or without text match nothing; items that repeat an id are
separate texts of one item. Null or empty texts and rows without an id match nothing. Extra
columns are ignored. The index goes out in shards of at most SHARD_BYTES of item text, one pass
over the documents for each, so its size is bounded however large the benchmark is. Document
frequencies and the mean length are those of all parts, so scores do not depend on the shards.
"""

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.bytewords import ALNUM, mix, words
from sparkgauge.llm.shared import map_texts, stage, without

PART, BLOCK, MIN_WORDS, SHINGLE = 64, 16, 8, 5
SHARD_BYTES = 16 << 20
#: BM25 term saturation and length weight.
K1, B = 1.2, 0.75
#: Least share of a part's weight that a passage must hold to be verified.
THRESHOLD = 0.5
OVERLAP = 0.8
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Index(NamedTuple):
    terms: np.ndarray  # sorted hashes
    top: np.ndarray  # largest impact of each term
    starts: np.ndarray  # of each term's postings, by part number
    parts: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray  # of each term's blocks
    blocks: np.ndarray
    block_tops: np.ndarray
    count: int  # of parts
    items: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of SHINGLE consecutive words, or of all words if there are fewer."""
    size = min(SHINGLE, len(hashes))
    if not size:
        return hashes
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = total * _STEP + hashes[j : len(hashes) - size + 1 + j]
    return np.unique(mix(total))


def _hashes(text: str) -> np.ndarray:
    return words(pa.array([text]), ALNUM)[0]


def _parts(text: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(all words, question words, answer words) of each part of an item."""
    every = _hashes(text)
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if len(_hashes(s))]
    tail = len(_hashes(sentences[-1])) if len(sentences) > 1 else len(every) // 4
    out = []
    for start in range(0, max(1, len(every) - PART + PART // 2), PART // 2):
        part = every[start : start + PART]
        if len(part) < MIN_WORDS:
            break
        last = start + PART >= len(every)
        cut = max(0, len(every) - tail - start) if last else len(part)
        question, answer = part[:cut], part[cut:]
        if len(question) < SHINGLE:
            question, answer = part, part[:0]
        out.append((part, question, answer))
        if last:
            break
    return out


class Totals(NamedTuple):
    """Of the parts of all shards: how many hold a term, their number and mean length."""

    df: dict[int, int]
    count: int
    length: float


def build_index(items: list[tuple[int, str]], totals: Totals | None = None) -> Index:
    """Index of the parts of some items; without `totals` they are all there are."""
    owner, parts = [], []
    for item, text in items:
        for part in _parts(text):
            owner.append(item)
            parts.append(part)
    counted = [np.unique(p[0], return_counts=True) for p in parts]
    lengths = np.array([len(p[0]) for p in parts], float)
    if not parts:
        empty = np.zeros(0)
        none = np.zeros(1, np.int64)
        return Index(empty.astype(np.uint64), empty, none, none[:0], empty, none, none[:0], empty,
                     0, none[:0], [], [])
    term = np.concatenate([t for t, _ in counted])
    tf = np.concatenate([c for _, c in counted]).astype(float)
    part = np.repeat(np.arange(len(parts)), [len(t) for t, _ in counted])
    terms, at = np.unique(term, return_inverse=True)
    if totals is None:
        seen, count, length = np.bincount(at), len(parts), lengths.mean()
    else:
        seen = np.array([totals.df[int(t)] for t in terms.view(np.int64)])
        count, length = totals.count, totals.length
    idf = np.log(1 + (count - seen + 0.5) / (seen + 0.5))
    impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[part] / length))
    impact /= np.bincount(part, impact)[part]
    order = np.lexsort((part, at))
    at, part, impact = at[order], part[order], impact[order]
    key = at * (len(parts) // BLOCK + 1) + part // BLOCK
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    limits = np.arange(len(terms) + 1)
    return Index(
        terms,
        np.maximum.reduceat(impact, np.searchsorted(at, limits[:-1])),
        np.searchsorted(at, limits),
        part,
        impact,
        np.searchsorted(at[first], limits),
        part[first] // BLOCK,
        np.maximum.reduceat(impact, first),
        len(parts),
        np.array(owner, np.int64),
        [shingles(p[1]) for p in parts],
        [np.unique(p[2]) for p in parts],
    )


def _expand(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the postings of all terms in `which`, and the place in `which` of each."""
    size = starts[which + 1] - starts[which]
    ends = np.cumsum(size)
    source = np.repeat(np.arange(len(which)), size)
    ramp = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    return starts[which][source] + ramp, source


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, weight, minlength=len(keys))


def retrieve(passage: np.ndarray, term: np.ndarray, index: Index, threshold: float):
    """(passage, part, score) of all parts whose score reaches the threshold.

    The input is the distinct (passage, term number) pairs of many passages.
    """
    top = index.top[term]
    order = np.lexsort((top, passage))
    passage, term, top = passage[order], term[order], top[order]
    head = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    sizes = np.diff(np.append(head, len(passage)))
    running = np.cumsum(top)
    running -= np.repeat(running[head] - top[head], sizes)
    weak = running < threshold / 2
    # What the weak terms of a passage can add at most.
    rest = np.bincount(passage, np.where(weak, top, 0))
    strong = np.flatnonzero(~weak)
    spot, source = _expand(index.block_starts, term[strong])
    width = index.count // BLOCK + 1
    key, bound = _sums(passage[strong][source] * width + index.blocks[spot], index.block_tops[spot])
    open_ = bound + rest[key // width] >= threshold
    if not open_.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # Exact scores in the open blocks: all terms of their passages.
    live = np.zeros(int(passage.max()) + 1, bool)
    live[key[open_] // width] = True
    all_terms = np.flatnonzero(live[passage])
    spot, source = _expand(index.starts, term[all_terms])
    owner = passage[all_terms][source]
    block = owner * width + index.parts[spot] // BLOCK
    inside = np.isin(block, key[open_])
    key, score = _sums(
        owner[inside] * np.int64(index.count) + index.parts[spot][inside], index.impacts[spot][inside]
    )
    good = score >= threshold
    return key[good] // index.count, key[good] % index.count, score[good]


def _share(wanted: np.ndarray, present: np.ndarray) -> float:
    return float(np.isin(wanted, present).mean()) if len(wanted) else 1.0


def matches(run: pa.RecordBatch, index: Index, threshold: float, overlap: float):
    """Verified (row, part, first word, score, question share, answer share) of a run of texts."""
    hashes, bounds = words(run.column("text"), ALNUM)
    if not len(hashes) or not index.count:
        return []
    counts = np.diff(bounds)
    steps = -(-counts // PART)  # passages per text, one every PART words
    base = np.cumsum(steps) - steps
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(hashes)) - bounds[text]
    place = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == hashes)
    step = inside[known] // PART
    now = base[text[known]] + step
    earlier = step > 0
    passage = np.concatenate([now, now[earlier] - 1])
    term = np.concatenate([place[known], place[known][earlier]])
    pairs = np.unique(passage * np.int64(len(index.terms)) + term)
    if not len(pairs):
        return []
    found = retrieve(pairs // len(index.terms), pairs % len(index.terms), index, threshold)
    out = []
    for p, part, score in zip(*found, strict=True):
        row = int(np.searchsorted(base, p, "right")) - 1
        while steps[row] == 0:
            row -= 1
        first = int(p - base[row]) * PART
        window = hashes[bounds[row] + first : min(bounds[row] + first + 2 * PART, bounds[row + 1])]
        question = _share(index.question[part], shingles(window))
        answer = _share(index.answer[part], window)
        if question >= overlap and answer >= overlap:
            out.append((row, part, first, float(score), question, answer))
    return out


def _shards(items: DataFrame, shard_bytes: int) -> Iterator[tuple[Index, bool]]:
    """Indexes over all items, each of at most about `shard_bytes` of text, one after the other;
    and whether there are several. Only the items of one are on the driver at a time."""
    items = stage(
        items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(
            "item_id is not null and text is not null"
        ),
        "items",
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= shard_bytes:
        rows = items.orderBy("item_id", "text").collect()
        yield build_index([(r["item_id"], r["text"]) for r in rows]), False
        return

    def terms(run: pa.RecordBatch) -> pa.RecordBatch:
        parts = [p[0] for t in run.column("text").to_pylist() for p in _parts(t)]
        distinct = [np.unique(p) for p in parts]
        flat = np.concatenate([*distinct, np.zeros(0, np.uint64)]).view(np.int64)
        # The first term of a part brings the part's length, the others none.
        sizes = [np.where(np.arange(len(d)) == 0, len(p), 0) for d, p in zip(distinct, parts, strict=True)]
        sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(sizes)], ["term", "length"])

    schema = "term long, length long"
    listed = stage(map_texts(items.select("text"), terms, schema), "item_terms")
    parts = listed.where("length > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    df = stage(listed.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item_df")
    count = math.ceil(2 * size / shard_bytes)
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        mine = items.where(shard == k)
        rows = mine.orderBy("item_id", "text").collect()
        own = map_texts(mine.select("text"), terms, schema).select("term").distinct()
        known = {r["term"]: r["df"] for r in df.join(own, "term").collect()}
        totals = Totals(known, parts["n"], parts["mean"])
        yield build_index([(r["item_id"], r["text"]) for r in rows], totals), True


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) per document and
    item found in it, with the figures of its best passage. What several shards find is written
    one by one, so that one index is held at a time."""
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    picked = picked.where("doc_id is not null")
    found = None
    for index, several in _shards(items, shard_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(run: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            rows = matches(run, shared.value, threshold, overlap)
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [
                run.column("doc_id").take(at),
                pa.array(shared.value.items[[r[1] for r in rows]] if rows else [], pa.int64()),
                pa.array([r[3] for r in rows], pa.float64()),
                pa.array([r[4] for r in rows], pa.float64()),
                pa.array([r[5] for r in rows], pa.float64()),
                pa.array([r[2] for r in rows], pa.int64()),
            ]
            names = ["doc_id", "item_id", "score", "question", "answer", "first_word"]
            return pa.RecordBatch.from_arrays(columns, names)

        schema = "doc_id long, item_id long, score double, question double, answer double, first_word long"
        part = map_texts(picked, work, schema)
        if several:
            part = stage(part, "found_items")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("score", "question", "answer", (-F.col("first_word")).alias("later"))).alias("b")
    return (
        found.groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "item_id",
            "b.score",
            F.col("b.question").alias("question_overlap"),
            F.col("b.answer").alias("answer_overlap"),
            (-F.col("b.later")).alias("first_word"),
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs` minus the documents that contain an item; rows without an id stay."""
    ids = stage(contaminated(docs, items, **options).select("doc_id").distinct(), "contaminated")
    return without(docs, ids, "doc_id")
