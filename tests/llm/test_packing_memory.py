"""A packing task holds the words of little text at once, and a worker gives back what earlier stages freed."""

import re
from pathlib import Path

import numpy as np

from sightline.llm import common, packing


def test_little_text_is_encoded_at_once(spark, monkeypatch):
    text = "some words of a text that goes on " * 1_500  # 51 kB
    plain, allowed = packing.encoder, 2 * packing.PIECE

    def watched(path, library):
        enc = plain(path, library)

        class Watched:
            def batch(self, many):
                if len(many) > 1 and sum(map(len, many)) > allowed:
                    raise ValueError("too much text at once")
                return enc.batch(many)

        return Watched()

    docs = spark.range(150).selectExpr("id doc_id", f"'{text}' text").coalesce(1)
    want = packing.pack(docs).groupBy("doc_id").sum("length").sort("doc_id").collect()
    monkeypatch.setattr(packing, "encoder", watched)
    assert packing.pack(docs).groupBy("doc_id").sum("length").sort("doc_id").collect() == want
    assert len(want) == 150


def held() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_freed_memory_goes_back():
    blocks = [np.ones(100_000, np.uint8) for _ in range(1_000)]  # small enough for the heap, which keeps what is freed
    last = np.ones(100_000, np.uint8)
    del blocks
    before = held()
    common.release_memory()
    assert before - held() > 50 and last.all()
