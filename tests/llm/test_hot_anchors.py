"""A phrase of k-mer length that most documents share, with other bytes around it in each."""

import hashlib
import random

import numpy as np
from test_documents import COLUMNS, plain_repeats

from sightline.llm import suffix

#: Of many phrases the one with the smallest hash, which is the anchor of nearly all windows that hold it.
PHRASE = min((f"the usual terms of {k:04d}/x" for k in range(3000)), key=lambda p: int(suffix.kmer_hashes(p.encode())[0]))


def heaviest(docs):
    """Bytes of distinct texts that the heaviest bucket key, an anchor, gets from all groups."""
    under = {}
    for r in suffix.messages(docs)[2].collect():
        at = 0
        for a, n in zip(np.frombuffer(r["anchors"], "<u8").tolist(), np.frombuffer(r["sizes"], "<u4").tolist(), strict=True):
            under.setdefault(a, set()).add(bytes(r["text"][at : at + n]))
            at += n
    return max(sum(map(len, t)) for t in under.values())


def test_hot_anchors_are_split(spark, monkeypatch):
    for name, value in (("GROUP", 20_000), ("ANCHORS", 9_000), ("BUCKET", 30_000), ("HOT", 2_000)):
        monkeypatch.setattr(suffix, name, value, raising=False)
    rng = random.Random(4)
    word = lambda: hashlib.md5(rng.randbytes(8)).hexdigest()[: rng.randrange(3, 12)]
    own = lambda: " ".join(word() for _ in range(12))
    texts = [f"{own()} {PHRASE} {own()}" for _ in range(300)]
    texts += [t[20:] + own() for t in texts[:40]] + [texts[5], "", None, "a" * 400, "a" * 300 + PHRASE + "a" * 300]
    ids = [None if k % 37 == 0 else k - k % 11 // 10 for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    last = suffix.LAST
    want = plain_repeats([(last if i is None else i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)])
    assert sum(w[2] for w in want) > 1000
    got = sorted((last if r[0] is None else r[0], *r[1:]) for r in ([x[c] for c in COLUMNS] for x in suffix.removed_digests(docs).collect()))
    assert got == want
    groups = docs.selectExpr("sum(octet_length(text)) s").first().s // 20_000 + 1
    assert heaviest(docs) <= 2_000 + groups * suffix.LONGEST_RUN
    monkeypatch.setattr(suffix, "HOT", 1 << 40)
    assert heaviest(docs) > 10_000


def test_one_sentence_in_thousands_of_contexts(spark, monkeypatch):
    """The largest bucket stays near the median, and rows of one id, or without one, are dealt over many groups."""
    for name, value in (("GROUP", 40_000), ("ANCHORS", 60_000), ("BUCKET", 100_000), ("HOT", 4_000)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(6)
    own = lambda n: " ".join(hashlib.md5(rng.randbytes(8)).hexdigest()[: rng.randrange(3, 12)] for _ in range(n))
    sentence = f"please note that {PHRASE} apply to every order of goods and services."
    assert len(sentence) >= 75
    docs = spark.createDataFrame([(None if k % 3 == 0 else k, f"{own(9)} {sentence} {own(9)}") for k in range(4000)], "doc_id long, text string").repartition(4)
    dealt, _, sent, _ = suffix.messages(docs)
    sizes = sorted(r.s for r in sent.selectExpr("b", "length(text) s").groupBy("b").sum("s").toDF("b", "s").collect())
    assert len(sizes) > 5 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    groups = sorted(r["count"] for r in dealt.groupBy("g").count().collect())
    assert groups[-1] < 3 * groups[len(groups) // 2]
    got = suffix.removed_digests(docs).selectExpr("count_if(n_removed >= 75) n", "min(if(n_removed > 0, doc_id, null)) first").first()
    assert got.n == 3999 and got["first"] == 2  # all but that of document 1


def test_one_text_an_anchor_in_every_group(spark, monkeypatch):
    """Each group has a single short text under the anchor; together they are too many for one bucket."""
    for name, value in (("GROUP", 400), ("ANCHORS", 60_000), ("BUCKET", 100_000), ("HOT", 2_000)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(9)
    own = lambda n: "".join(hashlib.md5(rng.randbytes(8)).hexdigest() for _ in range(n))
    texts = [own(3) + PHRASE + own(3) for _ in range(150)]
    texts += [t[40:] for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert docs.selectExpr("sum(octet_length(text)) s").first().s // 400 > 60
    assert heaviest(docs) <= 2_000
    want = plain_repeats([(i, t.encode()) for i, t in enumerate(texts)])
    assert sorted(tuple(x[c] for c in COLUMNS) for x in suffix.removed_digests(docs).collect()) == want and sum(w[2] for w in want) > 1000
    monkeypatch.setattr(suffix, "HOT", 1 << 40)
    assert heaviest(docs) > 5_000
