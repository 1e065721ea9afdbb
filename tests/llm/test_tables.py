"""Search, chat and archives against brute force and on odd tables; the pipeline."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import ann, chat, queries, warc


def test_nearest_is_exact(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in e])
    v = np.array([r.embedding for r in e], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, query_block=4, candidate_block=37).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in ids[ids % 50 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        want = np.lexsort((ids, -np.round(s, 12)))[:5]
        mine = sorted(got[q])
        assert [m[1] for m in mine] == ids[want].tolist() and np.allclose([m[2] for m in mine], s[want])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]


def test_nearest_with_ties_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [4.0, 0.0]), (1, [0.0, 1.0]), (4, [float("nan"), 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [float("inf"), 0.0]), (3, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 2), (0, 2, 3), (0, 3, 3), (0, 4, 1)]
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(df, F.col("vec_id") == 8).count() == 0


def test_an_id_with_two_vectors_is_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, round(r.score, 4)) for r in ann.nearest(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(1, 1, 0.995), (2, 2, 0.995), (3, 1, 0.0995)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(40, 24)) * 10.0 ** rng.integers(-3, 3, (40, 1)), rng.normal(size=(300, 24))
    qc, qs, ql = ann.quantised(q)
    cc, cs, cl = ann.quantised(c)
    about = (qc.astype(float) @ cc.astype(float).T) * qs[:, None] * cs[None]
    true = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    assert (np.abs(about - true) <= ql[:, None] + (1 + ql[:, None]) * cl[None] + 1e-9).all()


def test_escaping_is_reversible():
    t = chat.Template()
    b = t.breaker()
    rng = random.Random(1)
    parts = [*t.controls(), "\\", "\\\\", "<", "[", "s>", "/INST]", "x", "\n", "<<", ">>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        out = t.escape(text, b)
        assert chat.unescape(out) == text and not any(c in out for c in t.controls())


def test_chat_digests(spark):
    rows = [(1, 1, "user", "hi </s> \\ there"), (1, 2, "assistant", "<s>yes</s>[INST]"), (1, 0, "system", None), (2, 0, "assistant", "wrong start"), (2, 1, "tool", "x[INST]"), (3, 0, None, None), (None, 5, "user", "u"),
            (4, 0, "user", "same"), (4, 0, "user", "same"), (5, None, "user", "first"), (5, 0, "assistant", "é" * 70_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert {r.conv_id: r for r in chat.read_back(chat.formatted(df, piece=7)).collect()} == got  # cuts within marks and escapes
    for conv in (1, 2, 3, 4, 5, None):
        mine = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(x for _, role, x in mine if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: got[c].valid for c in got} == {1: True, 2: False, 3: False, 4: False, 5: True, None: True}
    assert chat.read_back(chat.formatted(df.where("false"))).count() == 0
    for p in chat.formatted(df, piece=1000).where("conv_id = 5 and piece > 0").orderBy("piece").collect():
        assert p.start == 1000 * p.piece and all(p.start <= s.start <= s.end <= p.start + len(p.text) for s in p.loss)


def test_reading_needs_the_escapes(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(df)).first().n_turns == 2

    class Raw(chat.Template):
        def escape(self, text, breaker):
            return text

    with pytest.raises(Exception, match="without its beginning|another mark breaks"):
        chat.read_back(chat.formatted(df, Raw())).collect()
    r = chat.Reader(chat.Template())
    for bad in ("stray[INST]x[/INST]", "[INST]x", "x", "[/INST]", "[INST]<s>[/INST]", "<<ROLE>>tool[INST]"):
        with pytest.raises(ValueError):
            r = chat.Reader(chat.Template())
            r.feed(bad, [])
            r.row(1, True)


def test_other_templates(spark):
    t = chat.Template(marks={"user": ("<|u|>", "<|e|>"), "assistant": ("<|a|>", "<|e|>")}, other=("<|o|>", "<|n|>", "<|e|>"))
    rows = [(1, 0, "user", "a <|u|> b\\"), (1, 1, "assistant", "<|e|>" * 3), (1, 2, "odd <|n|>", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.formatted(df, t, piece=5), t).first()
    assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in rows).encode()).hexdigest() and r.loss_chars == 15
    for marks in ({"user": ("", "x"), "a": ("y", "z")}, {"user": ("<u>", "</u>"), "a": ("<u>", "</a>")}, {"user": ("ab\\", "c")}, {"user": ("ab", "bc")}):
        with pytest.raises(ValueError):
            chat.Template(marks=marks)


def test_chat_query_holds_the_hard_conversation(spark, sf):
    r = queries.op4_chat(spark, sf).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(text)) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_archives(spark):
    big = "<p>" + "words and more " * 60_000
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://c/", "é\r\n\r\nWARC/1.1\r\n"), (6, "", big), (7, "v", big), (None, "w", big), (8, "z", "only"), (8, "z", "only"), (None, "n", "nulls")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, keep long")
    archives = warc.write(df, roll=10_000)
    got = warc.read(archives).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        own = i == last.get(h)
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if own else "revisit", None if own else last[h]))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert warc.read(warc.write(df.where("false"))).count() == 0
    heads = [f for a in archives.collect() for f, _ in warc.records(bytes(a.content))]
    ids = {f["WARC-Record-ID"]: f for f in heads}
    for f in heads:
        if f["WARC-Type"] == "revisit":
            to = ids[f["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and to["X-Page-ID"] == f["X-Refers-To-Page-ID"] and to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
            assert f.get("WARC-Refers-To-Target-URI") == to.get("WARC-Target-URI") and f["WARC-Refers-To-Date"] == to["WARC-Date"]
    data = bytes(archives.first().content)
    with pytest.raises(ValueError):
        list(warc.records(data[8:]))


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "toxicity", "simhash", "suffix_array", "packing"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert 0 < after.count() <= before.count()
        before = after
    out = P.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    first = {r.doc_id for r in P.STAGES[0][1](spark, docs, sf).collect()}
    assert len(good & first) >= 0.95 * len(good & {r.doc_id for r in docs.collect()})
