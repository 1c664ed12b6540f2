"""Registered queries against brute force, exact libraries and held-out labels."""

import base64
import hashlib
import re

import numpy as np
import plain
import pytest

import corpus_pipeline
from sparkgauge.llm import bpe, embedding_dedup, queries

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def rows(spark, name, sf_dir=SF):
    return queries.queries()[name](spark, sf_dir).collect()


def test_line_dedup(spark, docs):
    wanted = plain.repeated_lines({i: r.text for i, r in docs.items()})
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in rows(spark, "op1_line_dedup")}
    assert got == wanted


def test_minhash_dedup(spark, docs):
    sizes, component = plain.near_duplicates({i: r.text for i, r in docs.items()}, 3, 85)
    for r in rows(spark, "op5_minhash_dedup"):
        assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], component[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_minhash_dedup_of_one_large_family(spark):
    """Hundreds of edited copies of one text, and copies of the copies."""
    from sparkgauge.llm.minhash_dedup import near_duplicates

    draw = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(700):
        words = list(base)
        for k in draw.choice(150, draw.integers(0, 12), replace=False):
            words[k] = f"e{draw.integers(10**9)}"
        texts[i] = " ".join(words)
    texts |= {1000 + i: texts[i] for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, component = plain.near_duplicates(texts, 3, 85)
    assert {r.doc_id: r.component_id for r in near_duplicates(frame, 3, 85).collect()} == component


def test_embeddings(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(60, 32))
    some = centres[draw.integers(0, 60, 1500)] + draw.normal(size=(1500, 32)) * 0.3
    hot = centres[0] + draw.normal(size=(700, 32)) * 0.2
    vectors = np.concatenate([some, hot, hot[:50]]).astype(np.float32)
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"
    )
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    a, b = np.nonzero(np.triu(near, 1))
    component = plain.components(range(len(vectors)), zip(a.tolist(), b.tolist(), strict=True))
    for r in embedding_dedup.near_duplicates(frame).collect():
        assert r.n_links == near[r.vec_id].sum() - 1
        assert r.component_id == component[r.vec_id]


def test_decontamination(spark, docs, items):
    got = {(r.doc_id, r.item_id) for r in rows(spark, "op4_decontamination")}
    assert got == plain.contains({i: r.text for i, r in docs.items()}, items)


def test_language(spark):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    held = [r for r in rows(spark, "op3_language_id", LARGER) if r.held_out]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.99


@pytest.mark.parametrize(("name", "column"), [("op9_quality_fm", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_labels(spark, name, column):
    known = {r.doc_id: r[column] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [r for r in rows(spark, name, LARGER) if r.held_out and r.doc_id in known]
    for label in (0, 1):
        own = [r.predicted == label for r in held if known[r.doc_id] == label]
        assert np.mean(own) > 0.88


def test_license(spark, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in rows(spark, "op7_license_scan"):
        words = plain.word_list(docs[r.doc_id].text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        found = [
            (i, label)
            for phrase, label in phrases.items()
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert r.first_word == min((i for i, _ in found), default=None)
        assert r.last_word == max((i for i, _ in found), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in found}))


def test_warc(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first: dict = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = rows(spark, "op6_warc")
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        own = first[pages[r.page_id]] == r.page_id
        assert r.payload_bytes == len(pages[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(pages[r.page_id]).digest()).decode()
        assert (r.record_type, r.refers_to) == (
            ("response", None) if own else ("revisit", first[pages[r.page_id]])
        )


def coded(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.TOKENIZER)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    listed = ",".join(map(str, ids))
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, decoded))


def test_bpe(spark, docs):
    got = rows(spark, "op8_bpe")
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == coded(docs[r.doc_id].text)


def test_pipeline(spark, docs, items):
    toxic = {r.doc_id for r in rows(spark, "op10_toxicity") if r.predicted}
    texts = {i: r.text for i, r in docs.items() if i not in toxic}
    texts = plain.without_lines(texts, plain.repeated_lines(texts))
    _, component = plain.near_duplicates(texts, 5, 80)
    texts = {i: t for i, t in texts.items() if component[i] == i}
    bad = {d for d, _ in plain.contains(texts, items)}
    wanted = {i: coded(t) for i, t in texts.items() if i not in bad}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == wanted


def test_no_word_of_the_reading_pattern_is_lost():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x0bb\x1cc") == ["a", "b\x1cc"]
