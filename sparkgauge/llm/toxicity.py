"""Toxicity of texts behind leetspeak, spaced-out and stretched spelling.

A character language model is counted over all texts. Suspicious spans become lattices: a digit
or sign may stand for letters or for nothing, a repeated letter may be one letter, blanks,
dots and dashes between single letters or signs may be fillers. Signs alone, without any letter,
are numbers, and a single doubled letter is ordinary spelling: neither is a suspect. A Viterbi search takes the path that the language
model and the channel costs find likeliest; the restored text is then scored by the log-odds of
its words and word beginnings, learned from a bounded sample of labelled documents.

Null and empty texts get the score of a text without any evidence. With no labels of both kinds
every score is 0. Null ids count as not held out. Repeated rows are scored one by one; extra
columns are ignored. Texts are read whole.
"""

import functools
import re
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge.llm.bytewords import LOWER, byte_class, flat, mix, per_text, span_hashes, spans
from sparkgauge.llm.shared import map_texts, rows_of, runs, stage

#: Labelled documents per class that the lexicon is learned from, at most.
TOXIC_SAMPLE, CLEAN_SAMPLE = 2000, 4000
#: Least shrunken log-odds of an entry of the lexicon, and its size at most.
LEAST_WEIGHT, LEXICON = 1.0, 5000
#: Byte lengths of word beginnings that count as evidence besides whole words.
BEGINNINGS = (4, 5, 6)
SYMBOLS = 64
#: Channel costs: a sign read as a letter, a filler or repeated letter dropped, a sign dropped.
SWAP, FILLER, REPEAT, DROP = 0.5, 0.2, 1.0, 8.0
# Letters that digits and signs stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e",
}
# Three or more single letters or signs, fillers between all of them; no weak sign at an end.
_UNIT, _FILL = f"(?:[^\\W\\d_]|[{re.escape(''.join(LEET))}])", r"[ \t\xa0.*_,/~'-]"
_END = "(?![!|+])" + _UNIT
SPACED = re.compile(f"(?<![^\\W_]){_END}(?:{_FILL}+{_UNIT})+{_FILL}+{_END}(?![^\\W_])")
_LETTER = re.compile(r"[^\W\d_]")
_BLANKS = re.compile(r"[ \t\xa0]+")
# What ends a span besides blanks; all else may stand inside a word.
SPLIT = ",;:()[]{}<>/\\\"=&?#%"
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
# Restored spans kept per task, and the length up to which one is kept.
_CACHE, _CACHED = 200_000, 40


class Model(NamedTuple):
    chars: np.ndarray  # log P(letter | two before), SYMBOLS cubed
    features: np.ndarray  # sorted hashes of the lexicon
    weights: np.ndarray
    slope: float
    intercept: float


@functools.lru_cache(1)
def _symbols() -> np.ndarray:
    """Code point to symbol: 0 no letter, 1-26 a-z, other letters share the rest."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c * 7919 % (SYMBOLS - 27)
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams inside the words of all texts (0: outside a word).

    Each task sends one row per trigram it has seen, so the shuffle is bounded by tasks times
    SYMBOLS cubed and the result by SYMBOLS cubed.
    """

    def mapper(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for run in runs(batch, "text"):
                text = " ".join(t for t in run.column("text").to_pylist() if t).lower()
                s = np.concatenate([[0, 0], _symbols()[_points(text)], [0]]).astype(np.int32)
                before, here = s[1:-1], s[2:]
                older = np.where(before > 0, s[:-2], 0)
                code = (older * SYMBOLS + before) * SYMBOLS + here
                total += np.bincount(code[(before > 0) | (here > 0)], minlength=SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(code), pa.array(total[code])], ["code", "n"]
        )

    picked = docs.select(F.col("text").cast("string").alias("text"))
    rows = picked.mapInArrow(mapper, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = np.zeros(SYMBOLS**3)
    for row in rows.toLocalIterator():
        table[row["code"]] = row["n"]
    return table


def char_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities from trigram counts, interpolated with pairs and single letters."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 2 * p1) / (two.sum(1, keepdims=True) + 2)
    p3 = (three + 4 * p2) / (three.sum(2, keepdims=True) + 4)
    return np.log(p3)


def _choices(word: str) -> list[list[tuple[str, float]]]:
    gaps = [m.span() for m in _BLANKS.finditer(word)]
    least = min((end - start for start, end in gaps), default=0)
    # A gap wider than others may be one between words.
    wide = {start for start, end in gaps if end - start > least}
    out = []
    for i, c in enumerate(word):
        if c.isalpha():
            ways = [(c, 0.0)]
            if i and word[i - 1] == c:
                ways.append(("", REPEAT))
        elif c in LEET:
            ways = [(x, SWAP) for x in LEET[c]] + [("", DROP)]
        else:
            ways = [("", FILLER)] + [(" ", FILLER)] * (i in wide)
        out.append(ways)
    return out


def viterbi(word: str, chars: np.ndarray) -> str:
    """Likeliest spelling behind a lower-case word."""
    table = _symbols()
    # The text of a path is a chain of (chain before, letter): nothing is copied.
    best: dict = {(0, 0): (0.0, None)}
    for ways in _choices(word):
        step: dict = {}
        for (older, before), (score, chain) in best.items():
            for letter, cost in ways:
                if letter == " ":
                    key, new = (0, 0), score - cost + chars[older, before, 0]
                elif letter:
                    symbol = int(table[ord(letter)])
                    key, new = (before, symbol), score - cost + chars[older, before, symbol]
                else:
                    key, new = (older, before), score - cost
                if key not in step or new > step[key][0]:
                    step[key] = (new, (chain, letter) if letter else chain)
        best = step
    def text(chain):
        letters = []
        while chain is not None:
            chain, letter = chain
            letters.append(letter)
        return "".join(reversed(letters))

    ends = {k: s + chars[*k, 0] for k, (s, _) in best.items()}
    top = max(ends.values())
    return max(text(best[k][1]) for k, score in ends.items() if score == top)


def _suspects(text: str) -> list[tuple[int, int]]:
    """Spans of a lower-case text that may hide a word, of any length."""
    points = _points(text)
    if len(points) < 3:
        return []
    leet = np.zeros(128, bool)
    leet[[ord(c) for c in LEET if ord(c) < 128]] = True
    letter = _symbols()[points] > 0
    sign = (leet[np.minimum(points, 127)] & (points < 128)) | (points == 0x20AC)
    after = np.append(letter[1:], False)
    before = np.insert(letter[:-1], 0, False)
    single = sign & ~np.append(points[1:] == points[:-1], False)
    weak = (points == ord("!")) | (points == ord("|"))
    hit = sign & (after | (before & single & ~weak))
    twice = letter[1:] & (points[1:] == points[:-1])
    hit[2:] |= twice[1:] & twice[:-1]
    hit[3:] |= twice[2:] & twice[:-2]
    out = []
    split = np.zeros(128, bool)
    split[[ord(c) for c in SPLIT]] = True
    split = split[np.minimum(points, 127)] & (points < 128)
    blank = np.flatnonzero((points <= 0x20) | (points == 0xA0) | split)
    for i in np.flatnonzero(hit):
        if out and i < out[-1][1]:
            continue
        k = np.searchsorted(blank, i)
        start = int(blank[k - 1]) + 1 if k else 0
        end = int(blank[k]) if k < len(blank) else len(points)
        out.append((start, end))
    if len(text) > 4:
        out += [m.span() for m in SPACED.finditer(text) if _LETTER.search(m[0])]
    return sorted(out, key=lambda span: (span[0], -span[1]))


def restore(text: str | None, chars: np.ndarray, cache: dict[str, str]) -> str:
    """The lower-case text with every suspicious span replaced by its likeliest spelling."""
    if not text:
        return ""
    text = text.lower()
    pieces, done = [], 0
    for start, end in _suspects(text):
        if start < done:
            continue
        word = text[start:end]
        found = cache.get(word)
        if found is None:
            found = viterbi(word, chars)
            if len(word) <= _CACHED:
                if len(cache) >= _CACHE:
                    cache.clear()
                cache[word] = found
        pieces += [text[done:start], found]
        done = end
    return "".join([*pieces, text[done:]]) if pieces else text


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings, the text each is from, and words per text."""
    raw, bounds = flat(texts)
    raw = LOWER[raw]
    starts, ends = spans(raw, LETTERS)
    counts = np.diff(per_text(starts, bounds))
    text = np.repeat(np.arange(len(counts)), counts)
    hashes, owners = [span_hashes(raw, starts, ends)], [text]
    for n in BEGINNINGS:
        long = ends - starts >= n
        part = span_hashes(raw, starts[long], starts[long] + n)
        hashes.append(mix(part ^ np.uint64(n)))
        owners.append(text[long])
    return np.concatenate(hashes), np.concatenate(owners), counts


def _restored(run: pa.RecordBatch, chars: np.ndarray, cache: dict) -> pa.Array:
    return pa.array([restore(t, chars, cache) for t in run.column("text").to_pylist()], pa.string())


def evidence(texts: pa.Array, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed weights of the distinct entries of the lexicon in each text."""
    hashes, owners, counts = _features(texts)
    if not len(features) or not len(hashes):
        return np.zeros(len(counts))
    place = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
    hit = features[place] == hashes
    pairs = np.unique(owners[hit] * np.int64(len(features)) + place[hit])
    which = pairs // len(features)
    return np.bincount(which, weights[pairs % len(features)], minlength=len(counts))


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge, for classes in share `prior`."""
    design = np.stack([x, np.ones_like(x)], 1)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + 0.1 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def learning_rows(labels: DataFrame, column: str, modulus: int) -> DataFrame:
    """(doc_id, y): one row per labelled document outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))
    return (
        labels.where(F.col(column).isin(0, 1) & (fold != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(column).cast("int").alias("y"))
    )


def labelled_sample(docs: DataFrame, rows: DataFrame, ones: int, zeros: int) -> DataFrame:
    """(doc_id, y, text) of at most `ones` and `zeros` documents of each class, by hash order."""
    rows = stage(rows, "learning_rows")
    order = F.xxhash64("doc_id")
    picked = (
        rows.where("y = 1").orderBy(order, "doc_id").limit(ones)
        .unionByName(rows.where("y = 0").orderBy(order, "doc_id").limit(zeros))
    )
    picked = stage(picked, "picked")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    few = rows_of(texts, picked.select("doc_id"), "doc_id")
    return stage(few.join(picked, "doc_id"), "labelled_sample")


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5) -> Model:
    """Count the language model over all of `docs`; learn the lexicon from a bounded sample."""
    chars = char_model(char_counts(docs))
    rows = learning_rows(labels, "toxic", fold)
    sample = labelled_sample(docs, rows, TOXIC_SAMPLE, CLEAN_SAMPLE)
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def count(batches):
        cache: dict[str, str] = {}
        for batch in batches:
            for run in runs(batch, "text"):
                hashes, owners, _ = _features(_restored(run, shared.value, cache))
                toxic = run.column("y").to_numpy(False) == 1
                order = np.lexsort((owners, hashes))
                hashes, owners = hashes[order], owners[order]
                fresh = np.ones(len(hashes), bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
                hashes, owners = hashes[fresh], owners[fresh]
                keys, at = np.unique(hashes, return_inverse=True)
                ones = np.bincount(at, toxic[owners], minlength=len(keys)).astype(np.int64)
                n = np.bincount(at, minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(ones), pa.array(n - ones)],
                    ["feature", "ones", "zeros"],
                )

    totals = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    ones, zeros = int(totals[0] or 0), int(totals[1] or 0)
    empty = Model(chars, np.zeros(0, np.uint64), np.zeros(0), 0.0, -1e9)
    if not ones or not zeros:
        return empty
    counted = (
        sample.select("y", "text").mapInArrow(count, "feature long, ones long, zeros long")
        .groupBy("feature")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    )
    a, b = F.col("ones") + 0.5, F.col("zeros") + 0.5
    odds = F.log(a / (ones + 1)) - F.log(b / (zeros + 1)) - 1.5 * F.sqrt(1 / a + 1 / b)
    lexicon = (
        counted.where("ones >= 3").withColumn("weight", odds).where(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc("weight"), "feature")
        .limit(LEXICON)
        .collect()
    )
    features = np.array([r["feature"] for r in lexicon], np.int64).view(np.uint64)
    order = np.argsort(features)
    features, weights = features[order], np.array([r["weight"] for r in lexicon])[order]

    def weigh(run: pa.RecordBatch) -> pa.RecordBatch:
        found = evidence(_restored(run, shared.value, {}), features, weights)
        return pa.RecordBatch.from_arrays([run.column("y"), pa.array(found)], ["y", "x"])

    seen = map_texts(sample.select("y", "text"), weigh, "y int, x double").toPandas()
    totals = stage(rows, "all_rows").agg(F.avg("y")).first()
    slope, intercept = _logistic(np.log1p(seen["x"].to_numpy()), seen["y"].to_numpy(), totals[0])
    return Model(chars, features, weights, slope, intercept)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, then restored_text and toxic_score, per row of `docs`; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = "restored_text string, toxic_score double"
    kept = [f"_{i}" for i in range(len(keep))]

    def mapper(batches):
        cache: dict[str, str] = {}
        m = shared.value
        for batch in batches:
            for run in runs(batch, "text"):
                texts = _restored(run, m.chars, cache)
                x = np.log1p(evidence(texts, m.features, m.weights))
                p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.intercept, -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [*[run.column(c) for c in kept], texts, pa.array(p)],
                    [*kept, "restored_text", "toxic_score"],
                )

    picked = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)],
        F.col("text").cast("string").alias("text"),
    )
    schema = T.StructType([*picked.schema.fields[:-1], *T.StructType.fromDDL(added).fields])
    out = picked.mapInArrow(mapper, schema)
    names = [F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)]
    return out.select(*names, "restored_text", "toxic_score")


def without_toxic(docs: DataFrame, labels: DataFrame, fold: int = 5, cut: float = 0.5) -> DataFrame:
    """`docs` with its columns, minus the documents that score at least `cut`."""
    scored = score(docs, fit(docs, labels, fold), tuple(docs.columns))
    return scored.where(F.col("toxic_score") < cut).select(*[F.col(f"`{c}`") for c in docs.columns])


def predictions(docs: DataFrame, labels: DataFrame, fold: int = 5, cut: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == 0
    return score(docs, fit(docs, labels, fold)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= cut).cast("int").alias("predicted"),
    )
