"""Phrase collocation mining: multikey quicksort of suffix pointers, routed by their leading words.

Texts (ASCII capitals folded) are cut at `.,;:!?` and line ends into pieces, and those at blanks and
tabs into words; everything is counted per language (a null lang is `und`). A phrase of 2 to
`longest` words with `least` occurrences or more is a candidate. Its score is the lowest, over all
cuts into two parts, of floor(1000 * count * n / (count of first part * count of rest)), n being the words of the
language. A candidate drops out if a longer one holds it and reaches `percent` of its count; of the others the
best `top` of each language are returned.

A suffix starts at every word and is looked at up to `longest` words deep. All suffixes that begin
with the same two words of a language are routed to one task, which sorts pointers to them by three-way
radix quicksort: pointers are split by their word at one depth into less, equal and greater, the
equal ones go on one word deeper. The size of an equal part is the count of its phrase. Parts of fewer
occurrences than `least` are abandoned, as nothing longer in them can reach it.

Little needs routing. A first pass counts all words and leading pairs (64-bit hashes, added up in the
tasks before they are shuffled), and a bit map of fixed size, MAP_BITS, marks the pairs that reach `least`.
Collisions in it only let some more suffixes through. A suffix ends where the pair that follows is not
marked, as no candidate goes on beyond it, and suffixes of one word are not sent. Equal suffixes are added
up in each task. Leading pairs that make up a 4,096th of the words or more (4,096 at most, so their broadcast is
bounded) are dealt out by the whole suffix, sorted without abandoning, and their partial counts are added up.

Scores are exact: products are 38-digit decimals and divided as whole numbers. Words are
64-bit hashes until the end; a last pass fetches the spelling of the words in candidates.

Nulls: a null text is empty. Rows that repeat count as often as they occur. Ids and extra columns are
ignored. An empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.llm import bytewords, tally
from sparkgauge.llm.shared import map_texts, runs, stage

#: Bits of the map of frequent pairs and of the map of needed words: 16 MB at any size.
MAP_BITS = 27
#: Bits of a piece of them, that a task makes: 256 KB.
PIECE_BITS = 21
#: Leading pairs with at least one of so many words are dealt out by the whole suffix.
HOT = 1 << 12
#: Rows of suffixes that a task gathers before it adds equal ones up.
GATHERED = 1 << 20
_CUTS = bytewords.byte_class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
_WORD = ~(_CUTS | bytewords.byte_class((0x20, 0x20), (0x09, 0x09)))
_ONE, _TWO = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") | 1


def _words(run: pa.RecordBatch):
    """Of a run: folded bytes, starts and ends of the words, which of them the next word follows
    in the same piece, and the row of each."""
    raw, bounds = bytewords.flat(run.column("text"))
    raw = bytewords.LOWER[raw]
    starts, ends = bytewords.spans(raw, _WORD)
    cuts = np.concatenate([[0], np.cumsum(_CUTS[raw])])
    goes_on = np.zeros(len(starts), bool)
    if len(starts):
        goes_on[:-1] = cuts[starts[1:]] == cuts[ends[:-1]]
    row = np.repeat(np.arange(run.num_rows), np.diff(bytewords.per_text(starts, bounds)))
    return raw, starts, ends, goes_on, row


def _langs(run: pa.RecordBatch) -> np.ndarray:
    names = run.column("lang").dictionary_encode()
    hashes = np.array([lang_hash(x) for x in names.dictionary.to_pylist()], np.uint64)
    return hashes[names.indices.to_numpy()]


def _keys(langs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (lang, word), and of (lang, word, next word) for each but the last."""
    with np.errstate(over="ignore"):
        one = bytewords.mix(langs + words * _ONE)
        return one, bytewords.mix(one[:-1] * _TWO + words[1:])


def _read(run: pa.RecordBatch):
    """Words as hashes, the language of each, where a piece goes on, and the two kinds of keys; a
    pair that crosses the end of a piece has the key 0."""
    raw, starts, ends, goes_on, row = _words(run)
    words = np.maximum(bytewords.span_hashes(raw, starts, ends), np.uint64(1))
    langs = _langs(run)[row]
    one, two = _keys(langs, words)
    pairs = np.zeros(len(words), np.uint64)
    pairs[:-1] = two
    pairs[~goes_on] = 0
    return words, langs, one, pairs


def _count_keys(run: pa.RecordBatch):
    _, _, one, pairs = _read(run)
    keys = np.concatenate([one, pairs[pairs != 0]])
    return keys, keys


def bit_map(keys: DataFrame) -> np.ndarray:
    """Bits of the hashes in `key`, by their top MAP_BITS bits: 16 MB however many there are.

    Tasks make pieces of it, so that the driver gets these bytes and no row for each cell.
    """
    place = F.shiftrightunsigned("key", 64 - MAP_BITS).alias("place")
    bit = F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits")
    cells = keys.select(place).groupBy(F.shiftright("place", 6).alias("cell")).agg(bit)
    parts = F.shiftright("cell", PIECE_BITS - 6).alias("piece")

    def pieces(batches):
        made = {}
        for batch in batches:
            piece, cell, bits = (c.to_numpy() for c in batch.columns)
            for p in np.unique(piece):
                mine = piece == p
                made.setdefault(int(p), np.zeros(1 << (PIECE_BITS - 6), np.int64))[
                    cell[mine] & (1 << (PIECE_BITS - 6)) - 1
                ] = bits[mine]
        if made:
            blobs = pa.array([x.tobytes() for x in made.values()], pa.binary())
            yield pa.record_batch([pa.array(list(made), pa.int64()), blobs], ["piece", "bits"])

    dealt = cells.select(parts, "cell", "bits").repartition("piece")
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    made = dealt.mapInArrow(pieces, "piece long, bits binary").toArrow()
    for piece, bits in zip(*made.columns, strict=True):
        start = piece.as_py() << (PIECE_BITS - 3)
        out[start : start + (1 << (PIECE_BITS - 3))] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - MAP_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


# --- routing ---------------------------------------------------------------------------------


def _suffixes(run: pa.RecordBatch, bits: np.ndarray, longest: int):
    """Leading-pair keys and rows (lang, word, ..., word) of the suffixes worth sorting, padded by 0."""
    words, langs, _, pairs = _read(run)
    on = _marked(bits, pairs) & (pairs != 0)
    start = np.flatnonzero(on)
    rows = np.zeros((len(start), longest + 1), np.uint64)
    rows[:, 0], rows[:, 1], rows[:, 2] = langs[start], words[start], words[np.minimum(start + 1, len(words) - 1)]
    alive = np.arange(len(start))
    for k in range(2, longest):
        alive = alive[on[np.minimum(start[alive] + k - 1, len(on) - 1)]]
        rows[alive, k + 1] = words[start[alive] + k]
    return pairs[start], rows


def _row_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            out = bytewords.mix(out * _TWO + rows[:, k])
    return out


def _routed(texts: DataFrame, bits, hot, segments: int, longest: int) -> DataFrame:
    """Rows of tally.BLOBS: suffixes with counts, by segment; odd segments are those of hot pairs."""

    def mapper(batches):
        kept, size = [], 0

        def flush():
            pairs, rows = (np.concatenate(x) for x in zip(*kept, strict=True))
            hashes, first, counts = np.unique(_row_hash(rows), return_index=True, return_counts=True)
            pairs, rows = pairs[first], rows[first]
            is_hot = np.isin(pairs, hot.value)
            segment = tally.segment_of(np.where(is_hot, hashes, pairs), segments) * 2 + is_hot
            return tally.segment_blobs(segment, rows, counts)

        for batch in batches:
            for run in runs(batch, "text"):
                pairs, rows = _suffixes(run, bits.value, longest)
                if len(pairs):
                    kept.append((pairs, rows))
                    size += len(pairs)
                if size >= GATHERED:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return texts.mapInArrow(mapper, tally.BLOBS)


# --- sorting ---------------------------------------------------------------------------------


def equal_parts(rows: np.ndarray, weights: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a row, columns, weight) of every prefix of two columns and more that reaches `least`.

    Three-way radix quicksort of pointers into `rows`, with 0 as the end of a row.
    """
    out = []
    todo = [(np.arange(len(rows)), 0)] if len(rows) else []
    while todo:
        pointers, depth = todo.pop()
        if weights[pointers].sum() < least:
            continue  # abandoned
        column = rows[pointers, depth]
        pivot = column[len(column) // 2]
        less, greater = column < pivot, column > pivot
        equal = pointers[~(less | greater)]
        for part in (pointers[less], pointers[greater]):
            if len(part):
                todo.append((part, depth))
        weight = int(weights[equal].sum())
        if not pivot or weight < least:
            continue
        if depth:
            out.append((int(equal[0]), depth + 1, weight))
        if depth + 1 < rows.shape[1]:
            todo.append((equal, depth + 1))
    return out


def _sorted_counts(routed: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, words, n): counts of the phrases with at least `least` occurrences."""

    def work(segment, keys, counts):
        rows = keys.reshape(-1, longest + 1)
        # Pointers start in the order of their leading words, which parts the first depths at once.
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        rows, counts = rows[order], counts[order]
        lead = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1), [True]]))
        bound = 1 if segment & 1 else least
        at, size, n = [], [], []
        for start, end in zip(lead[:-1], lead[1:], strict=True):
            for row, columns, weight in equal_parts(rows[start:end], counts[start:end], bound):
                if columns > 2:
                    at.append(start + row)
                    size.append(columns - 1)
                    n.append(weight)
        if at:
            size = np.array(size)
            chosen = rows[np.array(at)]
            inside = np.arange(longest) < size[:, None]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            words = pa.array(chosen[:, 1:][inside].view(np.int64))
            yield pa.record_batch(
                [
                    pa.array(chosen[:, 0].copy().view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), words),
                    pa.array(np.array(n, np.int64)),
                ],
                ["lang", "words", "n"],
            )

    parts = tally.grouped_blobs(routed, work, "lang long, words array<long>, n long")
    return parts.groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- scores ----------------------------------------------------------------------------------


def _frequent(segment, keys, counts, least):
    many = counts >= least
    yield pa.record_batch([pa.array(keys[many].view(np.int64)), pa.array(counts[many])], ["key", "n"])


def _word_counts(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, words, n) of the single words in `phrases`; keys of (lang, word) are made in tasks."""
    single = phrases.select("lang", F.explode("words").alias("word")).distinct()

    def keys(batches):
        for batch in batches:
            lang, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("lang", "word"))
            with np.errstate(over="ignore"):
                key = bytewords.mix(lang + word * _ONE).view(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(key)], ["lang", "word", "key"])

    keyed = single.mapInArrow(keys, "lang long, word long, key long")
    return keyed.join(frequent, "key").select("lang", F.array("word").alias("words"), "n")


def _uncovered(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that no longer one holds with `percent` of their count. One word more is all that
    has to be looked at: counts only fall with length, so a longer holder has one between."""
    inner = F.explode(
        F.array(
            F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1)
        )
    )
    held = (
        phrases.where(F.size("words") > 2)
        .select("lang", inner.alias("words"), F.col("n").alias("most"))
        .groupBy("lang", "words")
        .agg(F.max("most").alias("most"))
    )
    covered = F.col("most") * 100 >= F.col("n") * percent
    return phrases.join(held, ["lang", "words"], "left").where(F.col("most").isNull() | ~covered).drop("most")


def _scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, n, score) with the cut of the lowest score, the first of equal ones."""
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select(
        "lang", "words", F.col("n").alias("a"), "k",
        F.slice("words", F.lit(1), F.col("k")).alias("first"),
        F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"),
    )
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(
            counts.select("lang", F.col("words").alias(part), F.col("n").alias(name)), ["lang", part]
        )
    cuts = cuts.join(totals, "lang")

    def exact(column):
        return F.col(column).cast("decimal(17,0)")

    above = (exact("a") * exact("n")) * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("above", above.cast("decimal(38,0)")).withColumn(
        "below", (exact("l") * exact("r")).cast("decimal(38,0)")
    )
    lowest = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "a", "n").agg(lowest).select(
        "lang", "words", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def _spellings(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, spelling) of the needed word hashes, found in the texts."""
    bits = texts.sparkSession.sparkContext.broadcast(bit_map(needed))

    def mapper(batches):
        told = np.zeros(0, np.uint64)
        for batch in batches:
            for run in runs(batch, "text"):
                raw, starts, ends, _, _ = _words(run)
                words = np.maximum(bytewords.span_hashes(raw, starts, ends), np.uint64(1))
                words, first = np.unique(words, return_index=True)
                new = _marked(bits.value, words) & ~np.isin(words, told)
                words, first = words[new], first[new]
                if not len(words):
                    continue
                # Some repeats do no harm: what a task remembers is bounded.
                told = np.concatenate([told, words])[-tally.FLUSH // 16 :]
                text = [raw[starts[i] : ends[i]].tobytes().decode() for i in first]
                yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(text, pa.string())], ["key", "spelling"])

    found = texts.mapInArrow(mapper, "key long, spelling string")
    return found.join(needed, "key", "left_semi").groupBy("key").agg(F.min("spelling").alias("spelling"))


def _spelled(scored: DataFrame, spellings: DataFrame) -> DataFrame:
    each = scored.select("lang", "words", F.posexplode("words").alias("i", "key"))
    text = (
        each.join(spellings, "key")
        .groupBy("lang", "words")
        .agg(F.sort_array(F.collect_list(F.struct("i", "spelling"))).alias("parts"))
        .select("lang", "words", F.array_join(F.col("parts.spelling"), " ").alias("phrase"))
    )
    return scored.join(text, ["lang", "words"])


def _totals(texts: DataFrame) -> DataFrame:
    """(lang, name, n) per language with its words; lang is the hash."""

    def count(run):
        _, starts, _, _, row = _words(run)
        n = np.bincount(row, minlength=run.num_rows)
        return pa.record_batch(
            [pa.array(_langs(run).view(np.int64)), run.column("lang"), pa.array(n)], ["lang", "name", "n"]
        )

    return map_texts(texts, count, "lang long, name string, n long").groupBy("lang", "name").agg(F.sum("n").alias("n"))


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score)."""
    if least < 2 or longest < 2:
        raise ValueError("phrases have two words and two occurrences at least")
    context = docs.sparkSession.sparkContext
    texts = docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
    )
    size = tally.text_bytes(texts)
    bits = tally.segment_bits(size)
    totals = stage(_totals(texts), "lang_words")
    frequent = stage(
        tally.tally(texts, _count_keys, bits, lambda s, k, n: _frequent(s, k, n, least), "key long, n long"),
        "frequent_keys",
    )
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    hot = frequent.where(F.col("n") * HOT >= n_words).select("key").toArrow().column("key").to_numpy()
    sent = [context.broadcast(bit_map(frequent)), context.broadcast(hot.view(np.uint64))]
    routed = _routed(texts, *sent, tally.segment_bits(size, 4 * tally.SEGMENT_BYTES), longest)
    phrases = stage(_sorted_counts(routed, longest, least), "phrases")
    for broadcast in sent:  # the next map is made when this one is gone
        broadcast.destroy()
    words = stage(_word_counts(phrases, frequent), "phrase_words")
    chosen = _uncovered(phrases, percent)
    scored = stage(
        _scored(chosen, phrases.unionByName(words), totals.select("lang", "n")), "scored_phrases"
    )
    needed = scored.select(F.explode("words").alias("key")).distinct()
    spelled = _spelled(scored, _spellings(texts, needed)).join(totals.select("lang", "name"), "lang")
    order = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        F.col("name").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
