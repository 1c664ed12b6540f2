"""op4 against BM25 scores of every part for every passage, and with shards of any size."""

import math
from collections import Counter

import numpy as np
import pytest

from sparkgauge.llm import decontamination as dec

SMALL = "/root/testdata/sf0.001"


def word_lists(draw, n, size):
    """Texts over a few frequent and many rare words."""
    return [
        " ".join(f"w{int(min(k, 400))}" for k in draw.zipf(1.3, int(draw.integers(dec.MIN_WORDS, size))))
        for _ in range(n)
    ]


def plain_scores(passage, parts):
    """Share of each part's BM25 weight that the distinct words of a passage hold."""
    df = Counter(w for p in parts for w in set(p))
    mean = sum(map(len, parts)) / len(parts)
    scores = []
    for p in parts:
        weight = {
            w: math.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5))
            * tf * (dec.K1 + 1) / (tf + dec.K1 * (1 - dec.B + dec.B * len(p) / mean))
            for w, tf in Counter(p).items()
        }
        scores.append(sum(x for w, x in weight.items() if w in passage) / sum(weight.values()))
    return scores


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_block_maxima_find_all_parts(threshold):
    draw = np.random.default_rng(3)
    items = word_lists(draw, 60, 200)
    index = dec.build_index(list(enumerate(items)))
    parts = [list(p[0]) for t in items for p in dec._parts(t)]
    assert index.count == len(parts) > 100
    passages = [dec._hashes(t) for t in word_lists(draw, 20, 300)]
    passages += [np.concatenate([parts[k], passages[k % 20]]) for k in range(0, len(parts), 9)]
    pairs = [(i, w) for i, p in enumerate(passages) for w in np.unique(p) if w in set(index.terms)]
    number = {w: i for i, w in enumerate(index.terms)}
    owner = np.array([i for i, _ in pairs])
    term = np.array([number[w] for _, w in pairs])
    found = {(p, k): s for p, k, s in zip(*dec.retrieve(owner, term, index, threshold), strict=True)}
    wanted = {
        (i, k): s
        for i, p in enumerate(passages)
        for k, s in enumerate(plain_scores(set(p), parts))
        if s >= threshold
    }
    assert len(wanted) > 10 and found.keys() == wanted.keys()
    assert all(found[at] == pytest.approx(s) for at, s in wanted.items())


def test_scores_do_not_depend_on_shards(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    size = items.selectExpr("sum(octet_length(text)) s").first().s
    results = []
    for shard_bytes in (size, size // 2):
        rows = dec.contaminated(docs, items, threshold=0.3, overlap=0.2, shard_bytes=shard_bytes).collect()
        results.append({(r.doc_id, r.item_id): (r.score, r.question_overlap, r.first_word) for r in rows})
    one, many = results
    assert one and one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k]) for k in one)
