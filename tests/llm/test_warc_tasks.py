"""op6: shards of neighbouring ids in as many tasks as they need, nothing left of attempts."""

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from sparkgauge.llm import warc_writer
from sparkgauge.session import run_dir

SMALL = "/root/testdata/sf0.001"


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(warc_writer, "SHARDS_A_TASK", 2)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    folder = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc_writer.write(pages, folder, shard_bytes=20_000, roll_bytes=4_000)
    rows = manifest.orderBy("file").collect()
    shards = {r.file.split("-")[1] for r in rows}
    assert len(shards) > 4 * 2 and len(rows) > len(shards)
    assert [r.first_id for r in rows] == sorted(r.first_id for r in rows)
    assert all(a.last_id < b.first_id for a, b in zip(rows, rows[1:]))
    base = Path(folder.removeprefix("file:"))
    assert {p.name for p in base.iterdir()} == {r.file for r in rows} | {"manifest"}
    files = len([p for p in (base / "manifest").iterdir() if p.suffix == ".parquet"])
    assert files >= len(shards) / 2
    back = warc_writer.read_back(manifest, folder)
    wanted = pages.select(
        "page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes")
    )
    got = back.select("page_id", "payload_bytes")
    assert got.count() == wanted.count() and got.exceptAll(wanted).isEmpty()
    again = warc_writer.write(pages, folder + "-again", shard_bytes=20_000, roll_bytes=4_000)
    assert {(r.file, r.sha256) for r in again.collect()} == {(r.file, r.sha256) for r in rows}
