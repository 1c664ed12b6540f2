"""Language-model scores of whole texts from a log-frequency Bloom filter.

Tokens are the words of a text (ASCII capitals folded, cut at blanks) and one end. All one- and
two-token counts of the training texts are gathered. A count c is quantised to a level on a
logarithmic scale, and the pairs (n-gram, 1) to (n-gram, level) go into a Bloom filter (Talbot and
Osborne, 2007), which is broadcast. A reader probes level by level until one is missing, so a
level is never read too low; false positives, about one in a hundred n-grams that are not there,
read it too high.

Scores are those of a bigram model with hierarchical Dirichlet smoothing (MacKay and Peto, 1995):
p(w | h) = (c(h w) + s p(w)) / (c(h) + s) and p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). Levels stand
for their least count above the line and their largest one below it, so that the probabilities of
all words add up to one at most, false positives apart. `base_score` uses p(w) alone with exact
counts, which come from sorted arrays of word hashes next to the filter.

Broadcasts are bounded however large the corpus is: the hash space of the tokens is cut into shards
of at most about `shard_bytes`, and each shard takes a pass over the texts, which adds the terms of
the tokens that belong to it. A token's terms need the n-gram counts that end in it and its own count,
so they are in one shard. Words that make up one 65,536th of all tokens or more, 65,536 at most,
are known to every shard, and their n-grams are dealt out by the whole n-gram: no word makes a
shard large. Words are 64-bit hashes.

Nulls: a null text is empty (its only token is the end). A row without id is held out. Every row
gets a row, repeated rows as well; extra columns are ignored. Without training texts all counts
are zero.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm import bytewords, tally
from sparkgauge.llm.shared import map_texts, stage

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Words with at least one of so many tokens are known to all shards; there are no more than these.
HOT = 1 << 16
#: Bits of the filter per (n-gram, level), and hash functions.
BITS, HASHES = 10, 5
STRENGTH = 200.0
SHARD_BYTES = 1 << 28
#: Parts in which the segments of a shard are collected.
CHUNKS = 8
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Least count of each level: a scale with ratio 1.5, as whole numbers.
LEVELS = np.unique(np.ceil(1.5 ** np.arange(0, 107) * (1 - 1e-12))).astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and so on; 0 for none."""
    return np.searchsorted(LEVELS, counts, "right")


def least(levels: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], LEVELS])[levels].astype(np.float64)


def most(levels: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], LEVELS[1:] - 1, LEVELS[-1:]])[levels].astype(np.float64)


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return bytewords.mix(before * _ODD + word)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: hashes of the tokens, those before them, and the text of each."""
    words, at = bytewords.words(texts, bytewords.NOT_BLANK)
    n = len(texts)
    text = np.repeat(np.arange(n), np.diff(at) + 1)
    ends = at[1:] + np.arange(n)
    now = np.empty(len(words) + n, np.uint64)
    is_end = np.zeros(len(now), bool)
    is_end[ends] = True
    now[is_end], now[~is_end] = END, words
    before = np.concatenate([[BEGIN], now[:-1]])
    before[before == END] = BEGIN
    return now, before, text


# --- the filter ------------------------------------------------------------------------------


def _bit(keys: np.ndarray, at_level, i: int, sizes: np.ndarray) -> np.ndarray:
    """Position of the i-th hash of (key, level) among `sizes` bits."""
    with np.errstate(over="ignore"):
        x = bytewords.mix(keys + np.asarray(at_level).astype(np.uint64) * _ODD)
        turn = (x >> np.uint64(32)) | np.uint64(1)
        return ((x + np.uint64(i) * turn) % sizes.astype(np.uint64)).astype(np.int64)


def build(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of a filter that holds the levels of `counts`."""
    levels = level(counts)
    size = max(64, -(-int(levels.sum()) * BITS // 64) * 64)
    flags = np.zeros(size, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        held = keys[levels >= j]
        for i in range(HASHES):
            flags[_bit(held, j, i, np.array(size))] = True
    return np.packbits(flags, bitorder="little")


def probe(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, of: np.ndarray):
    """Levels of `keys` in the filters `of`; the filters' first bytes and sizes in bits are given."""
    out = np.zeros(len(keys), np.int64)
    alive = np.flatnonzero(sizes[of] > 0)
    for j in range(1, len(LEVELS) + 1):
        if not len(alive):
            break
        for i in range(HASHES):
            place = _bit(keys[alive], j, i, sizes[of[alive]])
            byte = bits[starts[of[alive]] + (place >> 3)]
            alive = alive[(byte >> (place & 7).astype(np.uint8)) & 1 > 0]
        out[alive] = j
    return out


class Shard:
    """What a pass needs: a range of segments with their exact word counts and filters."""

    def __init__(self, number, shift, bits, words, counts, one, two, hot, totals):
        self.number, self.shift, self.bits, self.totals = number, shift, bits, totals
        self.words, self.counts, self.hot, self.hot_counts = words, counts, *hot
        self.first = number << shift
        self.one, self.two = one, two
        self.hot_filter = build(*hot)

    def is_here(self, routes):
        return tally.segment_of(routes, self.bits) >> self.shift == self.number

    def levels(self, filters, keys, routes):
        return probe(*filters, keys, tally.segment_of(routes, self.bits) - self.first)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `keys` in an ascending table, and which of them are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def score(shard: Shard, texts: pa.Array, strength: float) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text: the part of this shard."""
    n_all, n_distinct, n_docs = shard.totals
    now, before, text = tokens(texts)
    word, at = np.unique(now, return_inverse=True)
    place, hot = find(shard.hot, word)
    grams = pair(before, now)
    routes = np.where(hot[at], grams, now)
    here = shard.is_here(routes)

    count = np.zeros(len(word), np.int64)
    spot, known = find(shard.words, word)
    count[known] = shard.counts[spot[known]]
    count[hot] = shard.hot_counts[place[hot]]

    # Of words of other shards nothing is asked.
    own = shard.is_here(word) & ~hot
    levels = np.zeros(len(word), np.int64)
    levels[own] = shard.levels(shard.one, word[own], word[own])
    one = np.array([len(shard.hot_filter) * 8])
    zero = np.zeros(int(hot.sum()), np.int64)
    levels[hot] = probe(shard.hot_filter, np.zeros(1, np.int64), one, word[hot], zero)

    room = n_all + 0.1 * (n_distinct + 1)
    base = np.log10((count + 0.1) / room)
    prior = strength * (least(levels) + 0.1) / room
    as_context = np.where(word == END, 0.0, np.log10(most(levels) + strength))

    found = np.zeros(len(now))
    found[here] = least(shard.levels(shard.two, grams[here], routes[here]))
    terms = np.log10(found + prior[at]) - as_context[at]
    n = len(texts)

    def per_text(values):
        return np.bincount(text[here], weights=values[here], minlength=n)

    begin = np.log10(n_docs + strength) if shard.number == 0 else 0.0
    return [
        per_text(np.ones(len(now))).astype(np.int64),
        per_text((count > 0)[at]).astype(np.int64),
        per_text(base[at]),
        per_text(terms) - begin,
    ]


# --- training --------------------------------------------------------------------------------

_WORDS = "segment long, n_tokens long, n_words long, keys binary, counts binary, filter binary"


def _word_segment(segment: int, keys: np.ndarray, counts: np.ndarray):
    yield pa.record_batch(
        [
            pa.array([segment]), pa.array([int(counts.sum())]), pa.array([len(keys)]),
            pa.array([keys.tobytes()]), pa.array([counts.astype(np.int64).tobytes()]),
            pa.array([build(keys, counts).tobytes()]),
        ],
        ["segment", "n_tokens", "n_words", "keys", "counts", "filter"],
    )


def _pair_segment(segment: int, keys: np.ndarray, counts: np.ndarray):
    yield pa.record_batch(
        [pa.array([segment]), pa.array([build(keys, counts).tobytes()])], ["segment", "filter"]
    )


def _hot_words(words: DataFrame, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the words with n_tokens / HOT tokens or more."""

    def mapper(batches):
        for batch in batches:
            for keys, counts in zip(*batch.columns, strict=True):
                keys = np.frombuffer(keys.as_buffer(), np.int64)
                counts = np.frombuffer(counts.as_buffer(), np.int64)
                many = counts >= -(-n_tokens // HOT)
                yield pa.record_batch([pa.array(keys[many]), pa.array(counts[many])], ["key", "n"])

    found = words.select("keys", "counts").mapInArrow(mapper, "key long, n long").toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]


class Filters:
    """Filters of consecutive segments, end to end, with first bytes and sizes in bits."""

    def __init__(self, n: int):
        self.starts, self.sizes, self.bytes = np.zeros(n, np.int64), np.zeros(n, np.int64), bytearray()

    def add(self, at: int, blob: bytes) -> None:
        self.starts[at], self.sizes[at] = len(self.bytes), len(blob) * 8
        self.bytes += blob

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(self.bytes or bytearray(1), np.uint8), self.starts, self.sizes


class Model:
    """Counts of the training texts: `words` and `pairs` are tables by segment."""

    def __init__(self, docs: DataFrame, shard_bytes: int = SHARD_BYTES):
        texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.bits = bits = tally.segment_bits(tally.text_bytes(texts))

        def word_keys(run):
            now, _, _ = tokens(run.column("text"))
            return now, now

        self.words = words = stage(tally.tally(texts, word_keys, bits, _word_segment, _WORDS), "lm_words")
        sums = words.agg(F.sum("n_tokens"), F.sum("n_words")).first()
        self.n_tokens, self.n_words = sums[0] or 0, sums[1] or 0
        self.n_docs = texts.count()
        self.hot = hot = _hot_words(words, self.n_tokens)

        def pair_keys(run):
            now, before, _ = tokens(run.column("text"))
            grams = pair(before, now)
            return grams, np.where(find(hot[0], now)[1], grams, now)

        self.pairs = stage(
            tally.tally(texts, pair_keys, bits, _pair_segment, "segment long, filter binary"), "lm_pairs"
        )
        self._cut(shard_bytes)

    def _cut(self, shard_bytes: int) -> None:
        """Halve the shards until the largest one is within the bound."""
        sizes = self.words.select(
            "segment", (F.length("keys") + F.length("counts") + F.length("filter")).alias("n")
        ).unionByName(self.pairs.select("segment", F.length("filter").alias("n")))
        self.cuts = 0
        while True:
            shift = self.bits - self.cuts
            shard = F.shiftright("segment", shift)
            top = sizes.groupBy(shard).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
            if top <= shard_bytes:
                return
            if not shift:
                raise ValueError(f"a segment takes {top} bytes: shard_bytes is too small")
            self.cuts += 1

    def shard(self, number: int) -> Shard:
        """Its segments come to the driver a few at a time, and stay as flat arrays only."""
        shift = self.bits - self.cuts
        first, n = number << shift, 1 << shift
        keys, counts, one, two = [], [], Filters(n), Filters(n)
        each = max(1, n // CHUNKS)
        for start in range(first, first + n, each):
            mine = F.col("segment").between(start, start + each - 1)
            rows = self.words.where(mine).select("segment", "keys", "counts", "filter").toArrow()
            for segment, key, count, blob in zip(*rows.sort_by("segment").columns, strict=True):
                keys.append(np.frombuffer(key.as_py(), np.uint64))
                counts.append(np.frombuffer(count.as_py(), np.int64))
                one.add(segment.as_py() - first, blob.as_py())
            for segment, blob in zip(*self.pairs.where(mine).select("segment", "filter").toArrow().columns, strict=True):
                two.add(segment.as_py() - first, blob.as_py())
        return Shard(
            number, shift, self.bits,
            np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)]),
            one.done(), two.done(), self.hot, (self.n_tokens, self.n_words, self.n_docs),
        )

    def scores(self, docs: DataFrame, strength: float = STRENGTH) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of
        `docs` (doc_id, text, held_out)."""
        context = docs.sparkSession.sparkContext
        columns = ["doc_id", "held_out", "text_hash", "n_tokens", "n_known", "base_score", "score"]
        schema = (
            "doc_id long, held_out boolean, text_hash binary, n_tokens long, n_known long, "
            "base_score double, score double"
        )
        hashed = F.unhex(F.sha2("text", 256)) if self.cuts else F.lit(None).cast("binary")
        rows = docs.select("doc_id", "held_out", hashed.alias("text_hash"), "text")
        parts = None
        for number in range(1 << self.cuts):
            sent = context.broadcast(self.shard(number))

            def work(run, sent=sent):
                made = [pa.array(x) for x in score(sent.value, run.column("text"), strength)]
                return pa.record_batch([*run.columns[:3], *made], columns)

            # The sums of a shard are written, and its broadcast is gone, before the next one.
            part = stage(map_texts(rows, work, schema), "lm_part")
            sent.destroy()
            parts = part if parts is None else parts.unionByName(part)
        if self.cuts:
            parts = _summed(parts, 1 << self.cuts)
        return parts.select(
            "doc_id", "held_out", "n_tokens", "n_known",
            F.lit(self.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        )


def _summed(parts: DataFrame, shards: int) -> DataFrame:
    """Parts of a row added up. Rows that repeat have equal parts, which count once each."""
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    rows = parts.groupBy("doc_id", "held_out", "text_hash").agg(F.count(F.lit(1)).alias("n"), *sums)
    copies = (F.col("n") / shards).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(
        "doc_id", "held_out",
        *[F.expr(f"{c} div int(n / {shards})").alias(c) for c in ("n_tokens", "n_known")],
        *[(F.col(c) / copies).alias(c) for c in ("base_score", "score")],
    )


def scored(
    docs: DataFrame, fold: int = 10, held: int = 0, strength: float = STRENGTH, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Scores of all texts by a model of those whose crc32(doc_id as text) mod fold is not `held`."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % fold == held, F.lit(True)).alias("held_out"),
    )
    return Model(docs.where("not held_out"), shard_bytes).scores(docs, strength)
