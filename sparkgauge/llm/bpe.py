"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct words of a run of texts lie in one flat array of symbols. In every round the pairs
of adjacent symbols are looked up by binary search among the sorted pair keys of the merge
list, each word takes its lowest-rank pair (all places, from the left, not overlapping), and
finished words leave the array. Words are cut out of the texts with array operations too.

Null text: no ids, decoded text empty. Empty text: the same. Repeated rows and ids are encoded
row by row, extra columns pass through `keep` only. Texts are never cut.
"""

import functools
import json
import unicodedata
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.bytewords import flat, span_hashes
from sparkgauge.llm.shared import runs

#: Vocabulary file by default; `load` takes any other of the same kind.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Larger runs share more words, which are encoded once per run.
ENCODE_BYTES = 4 << 20
LETTER, NUMBER, OTHER, BLANK, EDGE = range(5)
# White space of the pattern that cuts texts into words.
BLANKS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
          0x202F, 0x205F, 0x3000]
# Contractions of the same pattern, after the apostrophe.
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")


class Model(NamedTuple):
    """Merge list and vocabulary as arrays; its size is that of the vocabulary file."""

    pair_keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    first: np.ndarray  # id of each byte
    token_bytes: np.ndarray
    token_ends: np.ndarray
    special: tuple[tuple[bytes, int], ...]


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> Model:
    """Read a byte-level BPE of the tokenizers library from its JSON file, on the driver."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, to_byte = spec["model"]["vocab"], byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    special = tuple((t["content"].encode(), t["id"]) for t in spec["added_tokens"])
    texts = {i: bytes(to_byte[c] for c in word) for word, i in vocab.items()}
    texts |= {i: word for word, i in special}
    words = [texts.get(i, b"") for i in range(max(texts) + 1)]
    first = np.zeros(256, np.int64)
    for letter, byte in to_byte.items():
        first[byte] = vocab[letter]
    return Model(
        keys[order],
        order.astype(np.int64),
        merged[order],
        first,
        np.frombuffer(b"".join(words), np.uint8),
        np.cumsum([0, *map(len, words)]),
        special,
    )


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.int8
    )
    table[BLANKS] = BLANK
    return table


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the consecutive groups of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _cut(raw: np.ndarray, bounds: np.ndarray, special) -> tuple[np.ndarray, ...]:
    """Byte starts and ends of all words, in order, and the id of those that are special."""
    data = raw.tobytes()
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width)])
    kind = _classes()[points]
    kind[np.searchsorted(at, bounds[1:] - 1)] = EDGE
    given = []
    for word, number in special:
        place = data.find(word)
        while place >= 0:
            given.append((place, len(word), number))
            k = np.searchsorted(at, place)
            kind[k : k + len(word.decode())] = EDGE
            place = data.find(word, place + len(word))
    n = len(points)
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == EDGE)
    # White space before a word: its last character stands alone, and a plain space joins it.
    end = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & (kind[1:] != EDGE)) + 1
    start[end - 1] = True
    start[end[points[end - 1] == 0x20]] = False
    # Short forms: an apostrophe on its own with letters after it.
    mark = np.flatnonzero((points == 0x27) & start[:n])
    mark = mark[kind[mark] == OTHER]
    following = np.concatenate([points, np.zeros(3, np.uint32)])
    is_letter = np.concatenate([kind == LETTER, np.zeros(3, bool)])
    for form in SHORT_FORMS:
        hit = mark
        for j, letter in enumerate(form, 1):
            hit = hit[(following[hit + j] == ord(letter)) & is_letter[hit + j]]
        mark = np.setdiff1d(mark, hit, assume_unique=True)
        start[hit + 1] = False
        after = hit + 1 + len(form)
        start[after[is_letter[after]]] = True
    edge = np.flatnonzero(start)
    left, right = edge[:-1], edge[1:]
    real = kind[left] != EDGE
    starts, ends = at[left[real]], at[right[real]]
    fixed = np.full(len(starts), -1, np.int64)
    if given:
        places, sizes, numbers = (np.array(x, np.int64) for x in zip(*given, strict=True))
        starts = np.concatenate([starts, places])
        ends = np.concatenate([ends, places + sizes])
        fixed = np.concatenate([fixed, numbers])
        order = np.argsort(starts, kind="stable")
        starts, ends, fixed = starts[order], ends[order], fixed[order]
    return starts, ends, fixed


def _look_up(left, right, same_word, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Rank and new symbol of pairs, by binary search; no pair: a rank beyond all others."""
    key = (left << 32) | right
    place = np.minimum(np.searchsorted(model.pair_keys, key), len(model.pair_keys) - 1)
    known = same_word & (model.pair_keys[place] == key)
    return np.where(known, model.ranks[place], len(model.ranks)), model.merged[place]


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, model: Model):
    """Final symbols of words given as one flat array, and the number for each word.

    Only pairs next to a merge are looked up again.
    """
    count, none = len(lengths), len(model.ranks)
    word = np.repeat(np.arange(count, dtype=np.int32), lengths)
    pad = np.full(1, none), np.zeros(1, np.int64)
    found = _look_up(symbols[:-1], symbols[1:], word[:-1] == word[1:], model)
    rank, merged = (np.concatenate(x) for x in zip(found, pad, strict=True))
    done_symbols, done_words = [], []
    while len(symbols):
        new_word = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(new_word, len(symbols)))
        least = np.minimum.reduceat(rank, new_word)
        active = least < none
        finished = np.repeat(~active, sizes)
        if finished.any():
            done_symbols.append(symbols[finished])
            done_words.append(word[finished])
            going = ~finished
            symbols, word, rank, merged = (x[going] for x in (symbols, word, rank, merged))
            least, sizes = least[active], sizes[active]
        spot = np.flatnonzero(rank == np.repeat(least, sizes))
        if not len(spot):
            break
        # In a run such as aaaa the pairs overlap: every second one counts.
        head = np.concatenate([[True], np.diff(spot) != 1])
        run = np.arange(len(spot)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        spot = spot[run % 2 == 0]
        symbols[spot] = merged[spot]
        keep = np.ones(len(symbols), bool)
        keep[spot + 1] = False
        symbols, word, rank, merged = (x[keep] for x in (symbols, word, rank, merged))
        here = spot - np.arange(len(spot))
        last = len(symbols) - 1
        changed = np.concatenate([here, here - 1])
        changed = changed[changed >= 0]
        after = np.minimum(changed + 1, last)
        same = (word[changed] == word[after]) & (changed < last)
        rank[changed], merged[changed] = _look_up(symbols[changed], symbols[after], same, model)
    if not done_symbols:
        return np.zeros(0, np.int64), np.zeros(count, np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=count)


def encode_batch(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in one array, and where those of each text begin."""
    raw, bounds = flat(texts)
    starts, ends, fixed = _cut(raw, bounds, model.special)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    lengths = ends - starts
    _, first, which = np.unique(
        span_hashes(raw, starts, ends) + lengths.astype(np.uint64),
        return_index=True,
        return_inverse=True,
    )
    # Equal hashes are checked byte by byte; a word that differs is encoded by itself.
    same = lengths == lengths[first[which]]
    size = np.where(same, lengths, 0)
    step = _ramp(size)
    differs = raw[np.repeat(starts, size) + step] != raw[np.repeat(starts[first[which]], size) + step]
    odd = ~same
    odd[np.repeat(np.arange(len(starts)), size)[differs]] = True
    if odd.any():
        extra = np.flatnonzero(odd)
        which[extra] = len(first) + np.arange(len(extra))
        first = np.concatenate([first, extra])
    size = np.where(fixed[first] < 0, lengths[first], 1)
    symbols = model.first[raw[np.repeat(starts[first], size) + _ramp(size)]]
    special = np.flatnonzero(fixed[first] >= 0)
    symbols[(np.cumsum(size) - size)[special]] = fixed[first[special]]
    ids, numbers = merge_rounds(symbols, size, model)
    begin = np.cumsum(numbers) - numbers
    tokens = numbers[which]
    out = ids[np.repeat(begin[which], tokens) + _ramp(tokens)].astype(np.int32)
    total = np.concatenate([[0], np.cumsum(tokens)])
    return out, total[np.searchsorted(starts, bounds)]


def decode_batch(ids: np.ndarray, bounds: np.ndarray, model: Model) -> list[str]:
    """Texts of consecutive groups of ids; bytes that are no UTF-8 become U+FFFD."""
    start, end = model.token_ends[ids], model.token_ends[ids + 1]
    size = end - start
    data = model.token_bytes[np.repeat(start, size) + _ramp(size)].tobytes()
    total = np.concatenate([[0], np.cumsum(size)])[bounds]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(total[:-1], total[1:], strict=True)]


def encode_decode(docs: DataFrame, model: Model, keep: str = "doc_id long") -> DataFrame:
    """(kept columns, ids array<int>, decoded string) of every text, in the reading tasks.

    `keep` names columns of `docs` with their types. The model goes out as one Spark broadcast,
    bounded by the vocabulary file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [part.split()[0] for part in keep.split(",")]

    def mapper(batches):
        for batch in batches:
            for run in runs(batch, "text", ENCODE_BYTES):
                ids, bounds = encode_batch(run.column("text"), shared.value)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                texts = decode_batch(ids, bounds, shared.value)
                kept = [run.column(name) for name in names]
                yield pa.RecordBatch.from_arrays(
                    [*kept, lists, pa.array(texts, pa.string())], [*names, "ids", "decoded"]
                )

    picked = docs.select(*names, F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(mapper, f"{keep}, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `encode_decode`'s rows."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
