"""Streaming ingest: new files in a folder are hashed once and upserted into the index."""

import numpy as np

from imprint.sources.index_store import read_index
from imprint.streaming.ingest import start_ingest
from test_files import pattern, png_bytes


def test_ingest_available_now(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    (src / "a.png").write_bytes(png_bytes(pattern(5)))
    (src / "b.png").write_bytes(png_bytes(pattern(6)))
    base, ckpt = str(tmp_path / "index"), str(tmp_path / "ckpt")
    q = start_ingest(spark, str(src), base, ckpt)
    q.awaitTermination(300)
    first = {r.path.rsplit("/", 1)[1]: r.h for r in read_index(spark, base).collect()}
    assert set(first) == {"a.png", "b.png"}
    (src / "c.png").write_bytes(png_bytes(np.kron(pattern(5), np.ones((2, 2, 1))).astype(np.uint8)))
    q = start_ingest(spark, str(src), base, ckpt)
    q.awaitTermination(300)
    second = {r.path.rsplit("/", 1)[1]: r.h for r in read_index(spark, base).collect()}
    assert set(second) == {"a.png", "b.png", "c.png"}
    assert second["a.png"] == first["a.png"]
    assert bin((second["a.png"] ^ second["c.png"]) & ((1 << 64) - 1)).count("1") <= 2
