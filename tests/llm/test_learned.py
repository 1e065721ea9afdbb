"""Learned scores against plain loops, on odd tables with a trained model, and the pipeline against brute force."""

import math
import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest
from test_documents import check_packing, library, plain_fingerprint  # noqa: F401

from sightline.llm import quality, toxicity
from sightline.llm.common import sample_labelled

WORDS = ("river stone winter letter garden morning captain island copper window market harvest lantern silver meadow bridge kitchen "
         "thunder pocket village orchard feather anchor candle mountain valley").split()
RUDE = ["blockhead", "numbskull", "dimwit"]


def prose(rng, n):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(6, 14))).capitalize() + "." for _ in range(n))


def junk(rng, n):
    return "\n".join("BUY NOW!!! $$$ " * 3 + str(rng.randrange(10**9)) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    """Good and bad, clean and toxic texts, long ones and repeated ids among them, then odd rows."""
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(240):
        good, toxic = i % 2, i % 3 == 0
        t = prose(rng, rng.randrange(3, 9)) if good else junk(rng, rng.randrange(3, 9))
        if toxic:
            t += f" you {rng.choice(RUDE)} of a {rng.choice(RUDE)}"
        if i % 40 == 1:
            t = prose(rng, 400) + t
        docs.append((i, t))
        labels.append((i, good, int(toxic)))
    odd = [(0, docs[0][1]), (1, "another text of the same id"), (900, None), (901, ""), (902, " \n\t "), (None, prose(rng, 4)), (None, prose(rng, 4)), (903, "x" * 5000),
           (904, prose(rng, 3000)), (905, "é¿ü " * 400), (906, junk(rng, 2000)), (907, f"You {RUDE[0]}, you bl0ckhe4d!")]
    labels += [(901, 0, 0), (902, 0, None), (None, 1, 1), (5, 0, 1), (99_999, 1, 1), (904, None, 0)]
    frame = spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 5 else "s", None if t is None else len(t), 0.5, "clash") for k, (i, t) in enumerate(docs + odd)],
                                  "doc_id long, text string, lang string, source string, n_chars long, score double, fp string")
    return frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_passage(passage, earlier):
    """The numbers of a passage, counted one byte at a time."""
    kind = [int(quality.KIND[b]) for b in passage]
    n, k = max(len(passage), 1), quality.KINDS
    one, two = [0] * k, [0] * k * k
    for a in kind:
        one[a] += 1
    for a, b in zip(kind, kind[1:], strict=False):
        two[a * k + b] += 1
    words, word = [], []
    for b, a in zip([*passage, 32], [*kind, 1], strict=True):
        if a <= 2:
            if word:
                words.append(bytes(word).lower())
            word = []
        else:
            word.append(b)
    again = 0
    for w in words:
        again += w in earlier
        earlier.add(w)
    tail = [again / max(len(words), 1), math.log1p(len(words)) / 5, len(passage) / max(len(words), 1) / 20 if words else 0.0, math.log1p(len(passage)) / 7]
    return [math.sqrt(x / n) for x in one] + [math.sqrt(x / n) for x in two] + tail


def plain_score(model, text):
    raw, earlier = (text or "").encode(), set()
    passages = [raw[i : i + quality.PASSAGE] for i in range(0, len(raw), quality.PASSAGE)] or [b""]
    w = {k: v.astype(float) for k, v in model.w.items()}
    h = [np.tanh(((np.array(plain_passage(p, earlier)) - model.mean) * model.scale) @ w["E"] + w["e"]) for p in passages]
    a = [float((np.tanh(x @ w["V"]) / (1 + np.exp(-(x @ w["U"])))) @ w["w"]) for x in h]
    e = [math.exp(x - max(a)) for x in a]
    z = sum(x * y for x, y in zip(e, h, strict=True)) / sum(e)
    return 1 / (1 + math.exp(-float((z @ w["c"] + w["b"])[0])))


def plain_matched(lex, folded):
    """Every entry and exception looked for at every place."""
    places = lambda entry: [i for i in range(len(folded)) if folded.startswith(entry, i)]
    spared = [(i, i + len(p) - 1) for p in lex.exceptions for i in places(p)]
    best = {}
    for entry, w in lex.weights.items():
        for i in places(entry):
            if not any(a <= i < z for a, z in spared):
                best[i] = max(w, best.get(i, 0.0))
    return sum(w for _, w in sorted(best.items())), max(0, folded.count(" ") - 1)


def test_quality_scores_of_odd_rows_by_a_trained_model(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    assert model.constant is None
    got = sorted(((r.doc_id, r.score) for r in quality.score(docs, model).collect()), key=str)
    want = sorted(((r.doc_id, plain_score(model, r.text)) for r in docs.collect()), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    gap = [abs(a - b) for a, b in zip(sorted(s for _, s in got), sorted(s for _, s in want), strict=True)]
    assert max(gap) < 1e-3
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(s >= quality.THRESHOLD for _, s in got)
    assert quality.score(docs.where("false"), model).count() == 0
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    by = dict(got)
    assert sum((by[i] >= 0.7) == (i in good) for i in range(240)) > 230


def test_toxicity_scores_of_odd_rows_by_a_trained_lexicon(spark, labelled):
    docs, labels = labelled
    lex = toxicity.fit(docs, labels)
    assert any(w.strip() in " ".join(RUDE) for w in lex.weights)
    got = sorted(((r.doc_id, r.matched, r.n_words, r.score) for r in toxicity.score(docs, lex).collect()), key=str)
    want = sorted(((r.doc_id, *(m := plain_matched(lex, toxicity.fold(r.text or ""))), lex.score(*m)) for r in docs.collect()), key=str)
    assert got == want
    assert toxicity.fit(docs, labels) == lex
    by = {i: s for i, *_, s in got}
    assert by[907] >= 0.7 and by[900] == by[901] < 0.1
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(s < toxicity.THRESHOLD for *_, s in got)


def test_a_label_of_long_texts_alone_is_learned(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 500) + (" you numbskull" if i % 2 else "")) for i in range(60)]
    assert all(len(t) > 20_000 for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    lex = toxicity.fit(docs, labels)
    assert any("numb" in w for w in lex.weights) and quality.fit(docs, labels).constant is None


def test_one_sampled_row_for_each_id(spark):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(500)] + [(2, None), (3, "x"), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (4, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.y, r.text) for r in sample_labelled(docs, labels, "quality", 7, 99, 10)[0].collect())
    assert got == [(1, 1, "copy 0"), (2, 0, "")]
    many = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "word " * (i % 9)) for i in range(200, 400)], "doc_id long, text string")
    assert sample_labelled(docs, many, "quality", 7, 99, 30)[0].groupBy("y").count().where("count = 30").count() == 2


def test_a_bound_in_bytes(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 3) if i % 2 else junk(rng, 3)) for i in range(100)] + [(100, "x" * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(101)], "doc_id long, quality int")
    assert quality.fit(docs, labels, most_bytes=8000).constant is None
    assert quality.fit(docs, labels, most_bytes=10).constant == 1.0


def test_hash_seeds_make_no_difference():
    code = ("import random; from sightline.llm import toxicity as t; r = random.Random(1); w = [f'w{k}x' for k in range(90)]\n"
            "x = ' '.join(r.choice(w) for _ in range(900)); f = t.fold(x)\n"
            "c = {e: (sorted(r.sample(range(50), 9)), r.randrange(3)) for e in sorted(t.entries_of(f))}\n"
            "print(sorted(t.marks_of(f)), sorted(t.entries_of(f)), t.chosen(c, 50, 50, 2))")
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": s, "PYTHONPATH": here}, capture_output=True, text=True, check=True).stdout for s in ("1", "2")}
    assert len(said) == 1 and len(said.pop()) > 1000


def test_long_texts_are_matched_in_linear_time():
    lex = toxicity.Lexicon({" idiot ": 5.0, " stup": 4.0}, frozenset({" not stupid ", " stupid mistake "}), -4.0, 2.0, 2.0)
    text = toxicity.fold("you idiot are not stupid mistake makers " * 80_000)
    assert len(text) > 3_000_000
    t = time.time()
    got = lex.matched(lex.automaton(), text)
    assert time.time() - t < 15 and got == (5.0 * 80_000, 80_000 * 7)
    small = toxicity.fold("you idiot are not stupid mistake makers stupid " * 20)
    assert lex.matched(lex.automaton(), small) == plain_matched(lex, small)


def plain_first_of_group(rows):
    """Exactly one row of each group of rows whose fingerprints chains of three bits join."""
    fp = [plain_fingerprint(t or "") for _, t in rows]
    left, keep = set(range(len(rows))), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            k = todo.pop()
            if k not in group:
                group.add(k)
                todo += [j for j in left if j not in group and (fp[j] ^ fp[k]).bit_count() <= 3]
        left -= group
        keep.append(min(group, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)))
    return [rows[k] for k in sorted(keep)]


def plain_without_repeats(rows):
    key = lambda i: 1 << 63 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(key(i), first.get(b[k : k + 50], key(i)))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone.update(range(k, k + 50))
        out.append((i, bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="ignore")))
    return out


def test_pipeline_against_brute_force_on_odd_tables(spark, labelled, library, tmp_path):  # noqa: F811
    import corpus_pipeline as P

    docs, labels = labelled
    rng = random.Random(6)
    shared = prose(rng, 2)
    more = [(1000 + k, prose(rng, 3) + shared + prose(rng, 3)) for k in range(6)] + [(1010, prose(rng, 2)), (1011, None)]
    more += [(1012, more[0][1]), (1013, more[1][1] + " Once more."), (None, more[2][1])]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "m", None, 0.1, "z") for i, t in more], docs.schema))
    docs.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.fit(docs, labels)
    rows = [r for r in rows if plain_score(model, r[1]) >= quality.THRESHOLD]
    lex = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    rows = [r for r in rows if lex.score(*plain_matched(lex, toxicity.fold(r[1] or ""))) < toxicity.THRESHOLD]
    rows = plain_without_repeats(plain_first_of_group(rows))
    assert len(rows) > 60 and len({i for i, _ in rows if i is not None and 1000 <= i < 1010}) >= 5
    got = P.run(spark, str(tmp_path))
    left = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in got.select("doc_id").collect()} == {i for i, _ in rows}
    check_packing(got, left, library, 4096)
    tokens = lambda t: len(library.encode(t, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got.collect()) == sum(tokens(t) for _, t in rows)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_blocks_of_a_long_text_change_nothing():
    """A text that goes over many blocks is encoded, and scored, as in one."""
    import random

    rng = random.Random(8)
    texts = [b"", b"x", " ".join(rng.choice(("alpha", "beta", "ünï", f"w{rng.randrange(900)}", "N°1,")) for _ in range(4000)).encode(), b"tail " * 300, b"", b"end"]
    for block in (512, 600, 2048, 1 << 20):
        whole = np.concatenate([x for x, _ in quality.bags(texts, 1 << 30)])
        own = np.concatenate([o for _, o in quality.bags(texts, 1 << 30)])
        assert np.array_equal(np.concatenate([o for _, o in quality.bags(texts, block)]), own)
        assert np.allclose(np.concatenate([x for x, _ in quality.bags(texts, block)]), whole, atol=1e-6)
        assert [int((own == i).sum()) for i in range(len(texts))] == [max(1, -(-len(t) // quality.PASSAGE)) for t in texts]


def test_a_very_long_text_is_scored_in_bounded_memory():
    import random
    import tracemalloc

    rng = random.Random(8)
    model = quality.train([(np.concatenate([x for x, _ in quality.bags([t])]), k % 2) for k, t in enumerate([b"Good words stand here. " * 60, b"!!! $$$ CLICK " * 50] * 4)], epochs=3)
    text = " ".join(rng.choice(("alpha", "beta", f"w{rng.randrange(90000)}")) for _ in range(10_000)).encode() * 800
    assert len(text) > 40 << 20
    tracemalloc.start()
    score = model.score([text])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert 0 <= score[0] <= 1 and peak < 250 << 20


def test_a_large_text_does_not_end_the_sample(spark):
    docs = spark.createDataFrame([(k, "good words here " * (3000 if k % 10 == 0 else 3)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    sizes = []
    keep = quality.train
    try:
        quality.train = lambda rows: sizes.append(len(rows)) or keep(rows, epochs=1)
        quality.fit(docs, labels, most_bytes=100_000)
    finally:
        quality.train = keep
    assert sizes[0] > 100  # all short ones, and those of the long that fit


def test_batches_are_bounded(spark):
    """The effective size of a batch, whether the session says nothing, more or less."""
    from sightline.llm import common

    def measured(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.column("text").nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(64).selectExpr("id doc_id", "repeat('x', 1 << 20) text").coalesce(1)
    for said, want in ((None, common.BATCH), ("64MB", common.BATCH), ("1MB", 1 << 20)):
        spark.conf.unset(key) if said is None else spark.conf.set(key, said)
        read = common.texts(docs)
        assert common.batch_bytes(spark) == want
        sizes = read.mapInArrow(measured, "n long").collect()
        assert max(r.n for r in sizes) <= want + (2 << 20)
    spark.conf.unset(key)
