"""Scores of op3, op9 and op10 against versions that follow the definitions word for word."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from sparkgauge.llm import language_id, quality_fm, queries, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def top_grams(texts):
    """The most frequent n-grams, ties by code points: letters, and pairs and triples of letters
    and word ends with no word end in the middle."""
    counts = Counter()
    for text in texts:
        line = "_" + "".join(c if c.isalpha() else "_" for c in text.lower()) + "_"
        while "__" in line:
            line = line.replace("__", "_")
        counts.update(c for c in line if c != "_")
        counts.update(line[i : i + 2] for i in range(len(line) - 1))
        counts.update(g for i in range(len(line) - 2) if (g := line[i : i + 3])[1] != "_")
    del counts["_"]

    def code(gram):
        return sum(ord(c) << 16 * k for k, c in enumerate(reversed(gram)))

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: language_id.TOP]


def test_language_by_plain_out_of_place_sums(spark, docs):
    learned = {}
    for d in docs:
        if d.lang is not None and d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2:
            learned.setdefault(d.lang, []).append(d.text)
    profiles = {lang: top_grams(texts) for lang, texts in sorted(learned.items())}
    ranks = {lang: {g: i for i, g in enumerate(grams)} for lang, grams in profiles.items()}
    found = {r.doc_id: r for r in queries.queries()["op3_language_id"](spark, SMALL).collect()}
    assert len(found) == len(docs) and len(profiles) > 1
    for d in docs:
        grams = top_grams([d.text or ""])
        away = {
            lang: sum(abs(rank[g] - i) if g in rank else language_id.TOP for i, g in enumerate(grams))
            for lang, rank in ranks.items()
        }
        order = sorted(away, key=lambda lang: (away[lang], lang))
        r = found[d.doc_id]
        if not grams:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best, second = away[order[0]], away[order[1]]
        assert r.lang_pred == order[0]
        assert r.score == pytest.approx((second - best) / second if second else 0.0)


def test_quality_by_all_pairs_of_features(spark, docs):
    """The linear-time score is the sum over all pairs of features of x_i x_j <v_i, v_j>."""
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality_fm.fit(frame, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert np.abs(model.factors).max() > 0.01
    scores = {r.doc_id: r.score for r in queries.queries()["op9_quality_fm"](spark, SMALL).collect()}
    assert len(scores) == len(docs)
    for d in docs:
        _, bucket, value, dense = quality_fm.features(pa.array([d.text], pa.string()))
        at = np.concatenate([bucket, quality_fm.BUCKETS + np.arange(quality_fm.STATISTICS)])
        x = np.concatenate([value, (dense[0] - model.mean) / model.spread])
        pairs = np.outer(x, x) * (model.factors[at] @ model.factors[at].T)
        raw = model.bias + x @ model.linear[at] + np.triu(pairs, 1).sum()
        assert scores[d.doc_id] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9)


def path_score(path, chars):
    """Log probability of a path's letters under the character model, less its channel costs."""
    score, older, before = 0.0, 0, 0
    for letter, cost in path:
        score -= cost
        if letter == " ":
            score += chars[older, before, 0]
            older = before = 0
        elif letter:
            symbol = int(toxicity._symbols()[ord(letter)])
            score += chars[older, before, symbol]
            older, before = before, symbol
    return score + chars[older, before, 0]


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_against_all_paths(docs, seed):
    draw = np.random.default_rng(seed)
    counts = draw.integers(0, 50, toxicity.SYMBOLS**3).astype(float) ** 2 * (draw.random(toxicity.SYMBOLS**3) < 0.3)
    chars = toxicity.char_model(counts)
    signs = list("aabbeeilost") + list(toxicity.LEET) + list(" .-*")
    for _ in range(60):
        word = "".join(draw.choice(signs, int(draw.integers(1, 8))))
        word = word.replace(" ", " " * int(draw.integers(1, 3)))
        paths = list(product(*toxicity._choices(word)))
        scores = np.array([path_score(p, chars) for p in paths])
        best = {"".join(x for x, _ in paths[i]) for i in np.flatnonzero(scores >= scores.max() - 1e-9)}
        assert toxicity.viterbi(word, chars) in best
