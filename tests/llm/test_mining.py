"""Language-model scores, hard negatives and collocations against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from sparkgauge.llm import collocations, hard_negatives, lm_scoring, oracle, queries, tally
from sparkgauge.llm.bytewords import mix

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


# --- language-model scores -------------------------------------------------------------------


def tokens(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), None]


def held(doc_id, fold=10):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % fold == 0


def base_scores(rows):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n = sum(counts.values())
    room = n + 0.1 * (len(counts) + 1)
    out = []
    for i, text in rows:
        own = tokens(text)
        score = sum(math.log10((counts[t] + 0.1) / room) for t in own)
        out.append((i, held(i), len(own), sum(counts[t] > 0 for t in own), n, score))
    return out


def check_base(got, rows):
    def key(r):
        return (r[0] is None, r[0] or 0, r[2], r[5])

    got = sorted([tuple(r)[:6] for r in got], key=key)
    wanted = sorted(base_scores(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in wanted], rel=1e-9)


@pytest.mark.parametrize("sf_dir", [SF, LARGER])
def test_lm_base_scores(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.queries()["op11_lm_scoring"](spark, sf_dir).collect()
    check_base(got, docs)
    # A model of word pairs tells held-out texts better than one of words.
    new = [r for r in got if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


ODD = [
    (1, "The cat sat on the mat"), (2, "the cat"), (2, "the cat"), (3, None), (4, ""), (5, " \n\t"),
    (None, "the dog"), (None, None), (7, "the " * 40_000), (8, "CAT é cat"), (9, "x" * 300_000),
]


@pytest.mark.parametrize("shard_bytes", [1 << 28, 1500])
def test_lm_odd_rows(spark, shard_bytes):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns(
        {"segment": F.lit(1), "keys": F.lit("k"), "score": F.lit(2.0), "held_out": F.lit("h")}
    )
    check_base(lm_scoring.scored(docs, shard_bytes=shard_bytes).collect(), ODD)


def test_lm_shards_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r.doc_id: r for r in lm_scoring.scored(docs).collect()}
    # The smallest that hold one segment each.
    many = lm_scoring.scored(docs, shard_bytes=120_000)
    assert len(one) == 200
    for r in many.collect():
        other = one[r.doc_id]
        assert (r.n_tokens, r.n_known) == (other.n_tokens, other.n_known)
        assert (r.base_score, r.score) == pytest.approx((other.base_score, other.score), rel=1e-9)


def test_lm_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.scored(none).collect() == []
    # 70 is held out, so nothing is learnt.
    alone = next(i for i in range(100) if held(i))
    rows = spark.createDataFrame([(alone, "a b")], "doc_id long, text string")
    (got,) = lm_scoring.scored(rows).collect()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)


def test_filter_never_reads_a_level_too_low():
    draw = np.random.default_rng(3)
    keys = mix(draw.integers(0, 1 << 60, 20_000).astype(np.uint64))
    counts = np.maximum(1, draw.pareto(0.8, len(keys)).astype(np.int64))
    bits = lm_scoring.build(keys, counts)
    starts, sizes = np.zeros(1, np.int64), np.array([len(bits) * 8])
    zero = np.zeros(len(keys), np.int64)
    got = lm_scoring.probe(bits, starts, sizes, keys, zero)
    true = lm_scoring.level(counts)
    assert (got >= true).all() and (got > true).mean() < 0.03
    other = mix(keys)
    assert (lm_scoring.probe(bits, starts, sizes, other, zero) > 0).mean() < 0.03
    assert (lm_scoring.least(true) <= counts).all() and (lm_scoring.most(true) >= counts).all()


def test_lm_probabilities_add_up_to_one_at_most(spark):
    """All continuations of a context, by the scores of short texts that differ in one word."""
    words = [f"w{i}" for i in range(30)]
    draw = np.random.default_rng(5)
    texts = [" ".join(words[int(w * w * 30)] for w in draw.random(40)) for _ in range(60)]
    model = lm_scoring.Model(spark.createDataFrame([(t,) for t in texts], "text string"))
    for begin in ("w0 ", "w3 ", "w17 w9 ", "", "new "):
        asked = [begin.strip(), *[begin + w for w in words]]
        rows = spark.createDataFrame(
            [(i, t, False) for i, t in enumerate(asked)], "doc_id long, text string, held_out boolean"
        )
        got = {r.doc_id: r.score for r in model.scores(rows).collect()}
        # p(begin w end) / p(end | w) summed over w is p(begin) (1 - p(end | begin)) at most.
        ended = {
            r.doc_id: r.score
            for r in model.scores(
                spark.createDataFrame([(i, f"{w} {w}", False) for i, w in enumerate(words)], rows.schema)
            ).collect()
        }
        assert len(got) == 31 and all(math.isfinite(x) for x in [*got.values(), *ended.values()])
        total = sum(10 ** got[i] for i in range(31))
        assert total <= 1.02


# --- hard negatives --------------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=5, low=80, scale=256, every=100):
    good = {}
    for i, x, label in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = (label, [math.floor(c * scale) for c in x])
        good[i] = min(good.get(i, row), row)
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scores = [
            (-sum(p * q for p, q in zip(v, w, strict=True)), i, other)
            for i, (other, w) in good.items()
            if i != a and len(w) == len(v)
        ]
        for p, i, _ in sorted(s for s in scores if s[2] == label)[:positives]:
            inside = sorted(s for s in scores if s[2] != label and low * -p <= 100 * -s[0] <= 100 * -p)
            out += [(a, i, k, j, -p, -n) for k, (n, j, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def test_negatives_with_ties_repeats_and_odd_rows(spark):
    draw = np.random.default_rng(7)
    rows = []
    for i in range(600):
        # Few distinct vectors, so that scores tie; a third of the rows are one vector.
        x = [1.0, 0.5, 0.0, -0.5] if i % 3 == 0 else [float(c) / 4 for c in draw.integers(-3, 4, 4)]
        rows.append((i, x, int(draw.integers(0, 3))))
    rows += [
        (700, None, 1), (800, [1.0, None, 0.0, 0.0], 1), (900, [1.0, float("nan"), 0.0, 0.0], 1),
        (1000, [1.0, float("inf"), 0.0, 0.0], 1), (1100, [0.0] * 4, 1), (1200, [], 1),
        (1300, [1.0, 0.5, 0.0, -0.5], None), (1400, [1.0, 0.5], 1), (1401, [1.0, 0.5], 1),
        (1402, [0.9, 0.5], 2), (None, [1.0, 0.5, 0.0, -0.5], 1),
        (100, [1.0, 0.5, 0.0, -0.5], 2), (100, [1.0, 0.5, 0.0, -0.5], 2), (5, [2.0, 0.0, 0.0, 0.0], 0),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {"block": F.lit(1), "side": F.lit("s"), "v": F.lit(3), "rank": F.lit(4), "score": F.lit(5)}
    )
    wanted = plain_negatives(rows)
    assert len(wanted) > 50
    for size in (64, 8192):
        got = hard_negatives.hard_negatives(frame, block_rows=size)
        assert sorted(tuple(r) for r in got.collect()) == wanted


def test_negatives_of_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(none).collect() == []


def test_negatives_too_large_for_a_long(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(frame).collect()


def test_threshold_stops_before_the_end():
    """On skewed components the lists are not read to the end, and the result is the best rows."""
    draw = np.random.default_rng(9)
    x = (draw.pareto(1.5, (4000, 3)) * 100).astype(np.int64)
    lists = hard_negatives.Lists(np.arange(4000), np.zeros(4000, np.int64), x)
    a = np.array([5, 3, 1])
    window = hard_negatives.Best(None, None, 5)
    read = 0
    for rows, scores, threshold in lists.read(a):
        read += len(rows)
        window.add(rows, scores, threshold)
        if window.done:
            break
    assert read < 2000
    order = np.lexsort((np.arange(4000), -(x @ a)))[:5]
    assert window.rows.tolist() == order.tolist()


@pytest.mark.parametrize("sf_dir", [SF, LARGER])
def test_negatives_like_sql(spark, sf_dir):
    got = queries.queries()["op12_hard_negatives"](spark, sf_dir)
    assert differences(got, connect(sf_dir), oracle.OP12) == []


# --- collocations ----------------------------------------------------------------------------


def plain_collocations(rows, least, longest=5, percent=100, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= least]
        longer = [(q, f[q]) for q in found if len(q) > 2]
        kept = []
        for p in found:
            if any(
                len(q) > len(p) and 100 * m >= percent * f[p]
                and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, m in longer
            ):
                continue
            cuts = [
                (1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                for k in range(1, len(p))
            ]
            score, _, left, right = min(cuts)
            kept.append((-score, -f[p], " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_collocations_of_made_up_texts(spark, monkeypatch):
    draw = np.random.default_rng(11)
    words = [f"w{i}" for i in range(12)] + ["Über", "É", "z\x00"]
    rows = []
    for i in range(300):
        text = "".join(
            f"{words[int(len(words) * w * w)]}{' ' if x < 0.8 else draw.choice(['. ', ',', chr(10), '\t', '; '])}"
            for w, x in draw.random((60, 2))
        )
        rows.append((text, ["en", "de", None][i % 3]))
    # A third of all words stand in one phrase, which has a hot leading pair.
    rows += [("Alpha beta gamma delta epsilon zeta " * 400, "en"), (None, "en"), ("", None), ("x" * 100_000, "xx")]
    frame = spark.createDataFrame(rows, "text string, lang string").withColumns(
        {"n": F.lit(1), "words": F.lit("w"), "key": F.lit(2), "segment": F.lit(3), "phrase": F.lit("p")}
    )
    for least, percent, top in ((20, 100, 2000), (50, 60, 7)):
        wanted = plain_collocations(rows, least, percent=percent, top=top)
        got = collocations.collocations(frame, least=least, percent=percent, top=top)
        assert sorted(tuple(r) for r in got.collect()) == wanted
        assert len(wanted) > 10
    # The same with every pair hot and with flushes of few keys.
    monkeypatch.setattr(collocations, "HOT", 1 << 40)
    monkeypatch.setattr(tally, "FLUSH", 500)
    monkeypatch.setattr(collocations, "GATHERED", 100)
    got = collocations.collocations(frame, least=20)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 20)


def test_collocations_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits; the division is exact."""
    phrases = spark.createDataFrame([(1, [5, 6], 9_000_000_001)], "lang long, words array<long>, n long")
    single = spark.createDataFrame(
        [(1, [5], 9_000_000_007), (1, [6], 9_000_000_019)], "lang long, words array<long>, n long"
    )
    totals = spark.createDataFrame([(1, 12_345_678_901_234)], "lang long, n long")
    (got,) = collocations._scored(phrases, phrases.unionByName(single), totals).collect()
    assert got.score == 1000 * 9_000_000_001 * 12_345_678_901_234 // (9_000_000_007 * 9_000_000_019)


def test_collocations_of_empty_table(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).collect() == []


def test_equal_parts_are_counts():
    draw = np.random.default_rng(13)
    rows = np.zeros((3000, 4), np.uint64)
    for row in rows:
        n = draw.integers(2, 5)
        row[:n] = draw.integers(1, 5, n)
    weights = draw.integers(1, 4, len(rows))
    wanted = Counter()
    for row, weight in zip(rows.tolist(), weights.tolist(), strict=True):
        for k in range(2, 5):
            if row[k - 1]:
                wanted[tuple(row[:k])] += weight
    got = {tuple(rows[i, :k].tolist()): n for i, k, n in collocations.equal_parts(rows, weights, 60)}
    assert got == {p: n for p, n in wanted.items() if n >= 60}


@pytest.mark.parametrize("sf_dir", [SF, LARGER])
def test_collocations_like_sql(spark, sf_dir):
    got = queries.queries()["op13_collocations"](spark, sf_dir)
    assert differences(got, connect(sf_dir), oracle.OP13) == []
