"""Language by rank order of n-grams: out-of-place distance to a profile per language.

A profile is the TOP most frequent n-grams (1 to 3 letters, with word ends) of a sample of
documents of one language. A document's own TOP n-grams, counted over its whole text, are
compared with each profile: the distance adds up how far every n-gram is out of place, TOP for
one that the profile lacks. Ties are ordered by n-gram.

Null texts and texts without a letter are `und` with score 0, and so is everything if nothing
could be learned. Repeated rows are predicted one by one; extra columns are ignored.
"""

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.shared import map_texts, stage

TOP, LONGEST = 300, 3
#: Documents per language that a profile is learned from, about, picked by hash.
LEARN = 2000
EDGE = 0x5F
_STEPS = 1 << 24


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Letter code of each code point in 16 bits, EDGE for what is no letter."""
    table = np.full(0x110000, EDGE, np.uint16)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = c if c <= 0xFFFF else 0xE000 + c % 0x1900
    return table


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    line = np.concatenate([[EDGE], _letters()[points], [EDGE]]).astype(np.uint64)
    edge = line == EDGE
    line = line[~(edge & np.insert(edge[:-1], 0, False))]
    edge = line == EDGE
    grams = [line[~edge]]
    for n in range(2, LONGEST + 1):
        code = np.zeros(max(0, len(line) - n + 1), np.uint64)
        inner = np.zeros(len(code), bool)
        for j in range(n):
            code |= line[j : j + len(code)] << np.uint64(16 * (n - 1 - j))
            if 0 < j < n - 1:
                inner |= edge[j : j + len(code)]
        grams.append(code[~inner])
    return np.unique(np.concatenate(grams), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:TOP]]


def learn(docs: DataFrame, fold: int = 4, held: int = 2) -> dict[str, np.ndarray]:
    """Ranked n-grams per language, from documents outside the held-out fold."""
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder(fold) != held)
    )
    totals = stage(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(_STEPS)) * F.col("n") < F.lit(LEARN * _STEPS)
    sample = known.join(totals, "lang").where(share).select("lang", F.col("text").cast("string"))

    def work(run: pa.RecordBatch) -> pa.RecordBatch:
        langs, codes, counts = [], [], []
        column = np.array(run.column("lang").to_pylist(), object)
        texts = np.array(run.column("text").to_pylist(), object)
        for lang in dict.fromkeys(column):
            grams, n = gram_counts(" ".join(texts[column == lang]))
            langs += [lang] * len(grams)
            codes.append(grams)
            counts.append(n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()),
                pa.array(np.concatenate([*codes, np.zeros(0, np.uint64)]).view(np.int64)),
                pa.array(np.concatenate([*counts, np.zeros(0, np.int64)])),
            ],
            ["lang", "gram", "n"],
        )

    grams = map_texts(sample, work, "lang string, gram long, n long")
    summed = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.slice(
        F.sort_array(F.collect_list(F.struct(-F.col("n"), "gram"))), 1, TOP
    )
    # Per language and hash part first, so that no task sorts all n-grams of a language.
    part = summed.groupBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64)).alias("part")).agg(
        best.alias("best")
    )
    top = part.select("lang", F.explode("best").alias("g")).groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list("g")), 1, TOP).alias("best")
    )
    rows = top.select("lang", F.col("best.gram").alias("grams")).orderBy("lang").collect()
    return {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in rows}


def _remainder(fold: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) per row; the score is the gap to the second-best profile."""
    names = list(profiles)
    union = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
    ranks = np.full((len(union) + 1, len(names)), -1, np.int64)
    for i, grams in enumerate(profiles.values()):
        ranks[np.searchsorted(union, grams), i] = np.arange(len(grams))

    def one(text: str | None) -> tuple[str, float]:
        if not text or not names:
            return "und", 0.0
        codes, counts = gram_counts(text)
        if not len(codes):
            return "und", 0.0
        codes = ranked(codes, counts)
        place = np.searchsorted(union, codes)
        place[np.append(union, 0)[place] != codes] = len(union)
        found = ranks[place]
        away = np.where(found < 0, TOP, np.abs(found - np.arange(len(codes))[:, None])).sum(0)
        order = np.argsort(away, kind="stable")
        best = away[order[0]]
        second = away[order[1]] if len(order) > 1 else TOP * len(codes)
        return names[order[0]], float((second - best) / second) if second else 0.0

    def work(run: pa.RecordBatch) -> pa.RecordBatch:
        found = [one(t) for t in run.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                run.column("doc_id"),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ],
            ["doc_id", "lang_pred", "score"],
        )

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(picked, work, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    held_out = F.coalesce(_remainder(fold) == held, F.lit(False))
    return predict(docs, learn(docs, fold, held)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )
