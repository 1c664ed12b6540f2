"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgauge.llm import (
    bpe,
    decontamination,
    embedding_dedup,
    language_id,
    license_scan,
    line_dedup,
    minhash_dedup,
    quality_fm,
    toxicity,
    warc_writer,
)

LONG = " ".join(f"word{i % 977} idi0t" for i in range(60_000))
LINE = "a line of several plain words that is long enough to count here"
TEXTS = [
    (1, LINE),
    (2, LINE),
    (3, None),
    (4, ""),
    (5, "   \n\n \t"),
    (6, LONG),
    (7, LONG + " more"),
    (8, "x"),
    (8, "x"),
    (9, "SPDX-License-Identifier: MIT OR (GPL-2.0 AND Apache-2.0)\nmit license"),
    (None, LINE),
    (None, None),
    (10, "é中\U0001f642 <|endoftext|> \x00 don't"),
]
EXTRA = {"id": 1, "component": "c", "sig": "s", "bucket": 2, "a": 3, "b": 4, "score": 0.5, "label": 7,
         "norm": "n", "word": "w", "y": 1, "block": 5, "_0": "u"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t else None, None, len(t) if t else None) for i, t in TEXTS]
    out = spark.createDataFrame(rows, SCHEMA)
    return out.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 11)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL = sorted((i for i, _ in TEXTS), key=lambda x: (x is None, x))


def test_near_duplicates(docs):
    rows = minhash_dedup.near_duplicates(docs, 3, 85).collect()
    got = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in rows}
    assert len(rows) == len(TEXTS)
    assert got[(2, True)] == (1, False)
    assert got[(7, True)] == (6, False)
    assert got[(8, True)] == (8, True)
    assert got[(4, False)] == (4, True)
    assert got[(None, True)] == (None, True)
    kept = minhash_dedup.one_of_each(docs, 3, 85)
    assert kept.columns == docs.columns
    assert ids(kept) == [1, 3, 4, 5, 6, 8, 9, 10, None, None]


def test_lines(docs):
    gone = line_dedup.repeated_lines(docs).collect()
    assert [(r.doc_id, r.line_no, r.keep_doc_id) for r in gone if r.doc_id == 2] == [(2, 0, 1)]
    left = line_dedup.without_repeated_lines(docs)
    assert left.columns == docs.columns
    assert {2, 7}.isdisjoint(set(ids(left)) - {7})
    assert set(ALL) - set(ids(left)) <= {2, 7}


def test_scores(docs, labels):
    for frame in (
        toxicity.predictions(docs, labels),
        quality_fm.predictions(docs, labels),
    ):
        rows = frame.collect()
        assert ids(frame) == ALL
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert not any(r.held_out for r in rows if r.doc_id is None)


def test_language(docs):
    rows = language_id.predictions(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}


def test_license(docs):
    rows = {r.doc_id: r for r in license_scan.summary(license_scan.scan(docs)).collect()}
    assert (rows[9].n_base, rows[9].base_labels, rows[9].labels) == (1, "mit", "apache,gpl,mit")
    assert rows[9].permissive
    assert (rows[3].n_words, rows[3].first_word, rows[3].labels) == (0, None, "")


def test_bpe(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.TOKENIZER)
    docs = docs.withColumn("own", F.col("text"))
    rows = bpe.encode_decode(docs, bpe.load(bpe.TOKENIZER), "doc_id long, own string").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.ids == plain.encode(r.own or "", add_special_tokens=False).ids
        assert r.decoded == (r.own or "")


def test_decontamination(spark, docs):
    items = spark.createDataFrame(
        [(1, LINE), (1, LINE), (2, None), (3, ""), (4, "too short"), (None, LINE)],
        "item_id long, text string",
    )
    rows = decontamination.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1), (2, 1)]
    left = decontamination.without_contaminated(docs, items)
    assert (left.columns, ids(left)) == (docs.columns, [i for i in ALL if i not in (1, 2)])


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 0.0]), (9, [-1.0, 0.0]), (10, [1.0]),
            (None, [1.0, 0.0]), (11, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame = frame.withColumns({"cid": F.lit(1), "n": F.lit(2), "id": F.lit(3)})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got[1] == got[2] == got[8] == (2, 1)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 9, 10, 11))
    assert got[None] == (0, None)


def test_pages(spark):
    rows = [(3, "http://a/ b", "<p>"), (1, None, "<p>"), (2, "u", None), (4, "u", ""), (5, "u", "x" * 300_000),
            (5, "u", "x" * 300_000), (None, "u", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumn("digest", F.lit(1)).withColumn("shard", F.lit(2))
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to)
                 for r in warc_writer.round_trip(pages).collect())
    assert got == [
        (0, 3, "response", None), (1, 3, "response", None), (2, 0, "response", None),
        (3, 3, "revisit", 1), (4, 0, "revisit", 2), (5, 300_000, "response", None),
        (5, 300_000, "response", None),
    ]


CLASHING = {"_gone": "g", "_id": 8, "_hash": 9, "_text": "t", "_row": 1, "keep": 2}


def test_lines_with_clashing_columns(docs):
    frame = docs.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    left = line_dedup.without_repeated_lines(frame)
    assert left.columns == frame.columns
    rows = left.collect()
    assert all([r[k] for k in CLASHING] == list(CLASHING.values()) for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in line_dedup.without_repeated_lines(docs).collect()}


def test_repeated_ids_with_a_map(docs):
    frame = docs.withColumn("m", F.create_map(F.lit("k"), F.col("n_chars")))
    kept = minhash_dedup.one_of_each(frame, 3, 85)
    assert (kept.columns, ids(kept)) == (frame.columns, [1, 3, 4, 5, 6, 8, 9, 10, None, None])
    assert {r.m["k"] for r in kept.collect() if r.doc_id == 8} == {1}


def staged(spark, frame, folder):
    """The stages one after the other, each on what the one before has written."""
    for i, (_, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, frame, str(folder))
        if i < 4:
            assert out.columns == frame.columns
        out.write.parquet(f"{folder}/stage_{i}")
        frame = spark.read.parquet(f"{folder}/stage_{i}")
    return frame.collect()


def test_pipeline_of_odd_rows(spark, docs, labels, tmp_path):
    clashing = {k: F.lit(v) for k, v in CLASHING.items()}
    frame = docs.withColumns({**clashing, "m": F.create_map(F.lit("k"), F.lit(1))})
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items = spark.createDataFrame([(1, LINE), (2, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = staged(spark, frame, tmp_path)
    # 2 repeats 1, which holds an item; 7 and the second 8 are copies.
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    assert [i for none, i in got if not none and i not in (6, 9)] == [3, 4, 5, 8, 10]
    assert all(r.n_tokens >= 0 for r in rows)


def test_pipeline_of_empty_tables(spark, docs, labels, tmp_path):
    labels.where("false").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert staged(spark, docs.where("false"), tmp_path) == []


def test_empty_tables(spark, docs, labels):
    none, unlabelled = docs.where("false"), labels.where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    assert minhash_dedup.one_of_each(none).count() == 0
    assert line_dedup.without_repeated_lines(none).count() == 0
    assert toxicity.predictions(none, unlabelled).count() == 0
    assert toxicity.without_toxic(docs, unlabelled).count() == len(TEXTS)
    assert quality_fm.predictions(docs, unlabelled).count() == len(TEXTS)
    assert language_id.predictions(none).count() == 0
    assert decontamination.contaminated(docs, items).count() == 0
    assert decontamination.contaminated(none, items).count() == 0
    assert license_scan.summary(license_scan.scan(none)).count() == 0
    assert bpe.digests(bpe.encode_decode(none, bpe.load(bpe.TOKENIZER))).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_writer.round_trip(pages).count() == 0


def test_stage_columns():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "decontamination", "bpe"]
