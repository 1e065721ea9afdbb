"""The document operators against brute force and on odd tables."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash

from sightline.llm import bpe, media, packing, quality, simhash, suffix, toxicity
from sightline.llm.common import held_out


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_trie_encodes_as_the_library(library):
    random.seed(3)
    texts = ["", " ", "It's WE'LL 'tis '", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ İstanbul é ﬁ", "a\x1cb\u0085c", "½ Ⅷ ² ١٢ 日本語 👩‍👩‍👧", "x" * 5000, "antidisestablishmentarianism " * 50]
    texts += ["".join(random.choice("abcdethino ,.'") for _ in range(random.randrange(1, 90))) for _ in range(400)]
    e = bpe.Encoder(bpe.default_vocabulary())
    for t, (ids, text) in zip(texts, e.batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert text == library.decode(want, skip_special_tokens=False)
    small = bpe.Encoder(bpe.default_vocabulary())
    small.KEEP, small.TRIE = 50, 7  # forgetting and small tries change nothing
    assert [x for k in range(0, len(texts), 40) for x in small.batch(texts[k : k + 40])] == list(e.batch(texts))


def test_long_words_need_linear_memory(library):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdethino") for _ in range(200_000)), "a" * 120_000, "é" * 60_000]
    e = bpe.Encoder(bpe.default_vocabulary())
    tracemalloc.start()
    got = [np.frombuffer(i, "<u4").tolist() for i, _ in e.batch(words)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900 * sum(map(len, words))
    assert not any(len(c) > e.SHORT for m in (e.seen, e.text, e.words) for c in m)
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_unassigned_characters_and_other_vocabularies(library):
    texts = ["ab\u0378cd it's\U0001fbfa!x", "\u2fe0\u2fe0", "x\u0530y 1\U000e0fff2"]
    e = bpe.Encoder(bpe.default_vocabulary())
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in e.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError, match="settings"):
        bpe.Encoder(bpe.default_vocabulary().replace("word_bpe_49k", "byte_bpe_50k"))


def test_encoding_of_odd_tables(odd_docs, no_docs, library):
    got = bpe.encode_digests(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got}
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert by_id[r.doc_id].n_tokens == len(ids)
        assert by_id[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_digests(no_docs).count() == 0
    full = bpe.encode(odd_docs.where("doc_id = 1"))
    one = full.first()
    assert one.decoded == library.decode(list(one.ids), skip_special_tokens=False) == bpe.decode(full).first().decoded
    odd = odd_docs.sparkSession.createDataFrame([(1, None), (2, []), (3, [49407, 77777777, 320])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd).orderBy("doc_id").collect()] == [None, "", "<|endoftext|> a</w>"]


def check_packing(df, docs, library, width):
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    got = df.collect()
    for doc, copies in ids.items():
        mine = [r for r in got if r.doc_id == doc]
        assert sum(r.length for r in mine) == sum(map(len, copies))
        for r in mine:
            assert any(len(c) == r.doc_tokens and zlib.crc32(c[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for c in copies)
        if len(copies) == 1:
            at = 0
            for r in sorted(mine, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at == width or at & (at - 1) == 0


def test_packing(odd_docs, no_docs, library, spark, sf):
    check_packing(packing.pack(odd_docs), odd_docs, library, 4096)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    check_packing(packing.pack(docs, width=512, open_windows=3), docs, library, 512)
    assert packing.pack(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_docs, width=1000)


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """component by smallest doc, of (doc, fingerprint)"""
    root = {d: d for d, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(pairs):
        for b, g in pairs[:i]:
            if (f ^ g).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in pairs}


def test_fingerprints_and_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs.collect()]
    want = plain_components(plain)
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    for d, f in plain:
        assert got[d].fingerprint == f"{f:016x}"
        assert got[d].component_id == want[d]


@pytest.mark.parametrize("hot", [5_000, 8])
def test_links_of_random_balls(spark, monkeypatch, hot):
    """Chains of fingerprints up to three bits apart, and decoys at four; also with groups split as hot."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.append(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 3, 4])):
                f ^= 1 << b
    fps = sorted(set(fps))
    want = plain_components([(f, f) for f in fps])
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = simhash.links(df).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links)
    root = {signed(f): signed(f) for f in fps}
    comp = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for f in root:
        groups.setdefault(comp.get(f, f), set()).add(f)
    expected = {}
    for f, r in want.items():
        expected.setdefault(r, set()).add(signed(f))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_of_odd_tables(odd_docs, no_docs):
    got = simhash.groups(odd_docs)
    assert got.count() == odd_docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, r)
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == "0" * 16
    assert by[4].component_id == 3 and by[2].component_id == by[None].component_id == 1
    assert simhash.groups(no_docs).count() == 0
    kept = simhash.first_of_group(odd_docs)
    assert kept.columns == odd_docs.columns and {1, 3, 9} <= {r.doc_id for r in kept.collect()} and 2 not in {r.doc_id for r in kept.collect()}


def plain_repeats(docs):
    first = {}
    for d, b in docs:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_against_all_strings(spark, sf, monkeypatch):
    for name, value in (("GROUP", 60_000), ("ANCHORS", 9_000), ("BUCKET", 30_000)):
        monkeypatch.setattr(suffix, name, value)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    assert sum(w[2] for w in want) > 1000
    assert rows(suffix.removed_digests(docs), *COLUMNS) == want


def test_suffix_dedup_of_repetitive_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", 3_000)
    rng = random.Random(9)
    texts = ["ab" * 300, "a" * 49, "a" * 50, "a" * 51, "", None]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(40, 400))) for _ in range(20)]
    texts += [texts[7][10:120] + texts[8][5:100], "é" * 60, "xé" * 60, "é" * 60 + "x", texts[9], texts[9]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(suffix.removed_digests(docs), *COLUMNS) == plain_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_longest_previous_factors(monkeypatch):
    """Against all pairs of suffixes, for texts with a first and a later copy."""
    rng = random.Random(2)
    for letters in ("ab", "abcdefgh", "a"):
        texts = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randrange(50, 80))).encode() for _ in range(8)))
        texts = list(dict.fromkeys([*texts, *(t[3:] + b"c" * 9 for t in texts)]))
        first = np.array([rng.randrange(-3, 6) for _ in texts])
        last = first + np.array([rng.choice([0, 0, 2]) for _ in texts])
        suffixes = [(k, t[i : i + 50]) for k, t in enumerate(texts) for i in range(len(t) - 49)]

        def factor(s, doc):
            best = 0
            for k, t in suffixes:
                if first[k] < doc or last[k] < doc:
                    best = max(best, next((i for i in range(50) if s[i] != t[i]), 50))
            return best

        want = [[factor(s, first[k]) for k, s in suffixes], [factor(s, last[k]) if last[k] > first[k] else 0 for k, s in suffixes]]
        assert [x.tolist() for x in suffix.longest_previous(texts, first, last)] == want


def test_nearest_smaller_in_long_chains():
    """An ascending chain with a small value at its end takes the stack, other values the pointers."""
    rng = random.Random(8)
    for value in (list(range(300)) + [0, 150], [rng.randrange(9) for _ in range(400)], [3] * 50):
        shared = [0] + [rng.randrange(51) for _ in value[1:]]
        want = []
        for i, v in enumerate(value):
            j = next((j for j in range(i - 1, -1, -1) if value[j] < v), None)
            want.append(0 if j is None else min(shared[j + 1 : i + 1]))
        assert suffix.smaller_before(np.array(value), np.array(shared)).tolist() == want


def test_suffix_dedup_of_odd_tables(odd_docs, no_docs):
    got = suffix.without_repeats(odd_docs)
    assert got.columns == odd_docs.columns and got.dtypes == odd_docs.dtypes and got.count() == odd_docs.count()
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[1] and not by[2] and not by[None] and by[11] == "!" and by[7].strip() == "tail"
    assert suffix.without_repeats(no_docs).count() == 0 and suffix.removed_digests(no_docs).count() == 0


def plain_payload(text):
    """UTF-8 and zero bytes up to a positive multiple of 64, by counting up."""
    raw = bytearray((text or "").encode())
    while not raw or len(raw) % 64:
        raw.append(0)
    return bytes(raw)


def test_media_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 9000, media.STEP * media.FRAME + 65):
        for raw in (rng.randbytes(n), b"\xff" * n, b"\xff\xd0\x00" * (n // 3), b"text " * (n // 5)):
            payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            avi = media.write_avi(payload)
            back, pictures, facts = media.load(avi)
            assert back == payload and len(pictures) == len(facts["frames"]) == -(-len(payload) // media.FRAME)
            spans, _ = media.shots(pictures)
            assert spans[0][0] == 0 and spans[-1][1] == len(pictures)
            size, sha, crc, n_avi, sha_avi, feature, clips = media.read_digests(avi)
            assert (size, sha, crc) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (n_avi, sha_avi) == (len(avi), hashlib.sha256(avi).hexdigest())
            assert [(c["first_frame"], c["end_frame"]) for c in clips] == spans and all(c["start_s"] == c["first_frame"] / 25 for c in clips)
            assert feature.startswith(f"frames={len(pictures)};shots={len(spans)};") and f"mean={pictures.mean():.3f}" in feature
    with pytest.raises(ValueError):
        media.load(media.write_avi(b"x" * 64)[:200])


def plain_cuts(d):
    cuts, begun = [0], 0
    for k in range(len(d)):
        past = d[begun:k]
        if d[k] > (max(0.05, np.mean(past) + 3 * np.std(past)) if len(past) >= 2 else 0.35):
            cuts.append(k + 1)
            begun = k + 1
    return cuts


def test_cuts_are_those_of_the_whole_shot():
    rng = random.Random(3)
    for _ in range(30):
        d = [rng.choice([0.01, 0.02, 0.3, 0.9]) * rng.random() for _ in range(200)]
        assert media.cuts_of(d) == plain_cuts(d)


def test_media_memory_is_a_small_multiple():
    payload = random.Random(2).randbytes(6 << 20)
    tracemalloc.start()
    avi = media.write_avi(payload)
    wrote = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    media.read_digests(avi)
    read = tracemalloc.get_traced_memory()[1] - len(avi)
    tracemalloc.stop()
    assert wrote < 5 * len(payload) and read < 3 * len(payload) + (8 << 20)


def by_java(spark, jpeg):
    """Samples of the first band by the JVM's own decoder."""
    jvm = spark._jvm
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(jpeg)).getRaster()
    w, h = raster.getWidth(), raster.getHeight()
    return np.array([[raster.getSample(x, y, 0) for x in range(w)] for y in range(h)])


def test_own_frames_by_other_decoders(spark):
    raw = random.Random(5).randbytes(media.FRAME)
    frame = next(media.encode_frames(raw))
    grey = media.samples(media.own_codes([frame]))[0].reshape(4, 4, 8, 8).transpose(0, 2, 1, 3).reshape(32, 32)
    assert np.abs(by_java(spark, frame) - grey.astype(int)).max() <= 1
    assert np.abs(media.picture(frame)[0].astype(int) - grey).max() <= 1


@pytest.mark.parametrize(("width", "height", "kind"), [(37, 21, "colour"), (16, 16, "colour"), (40, 33, "grey")])
def test_any_baseline_frame(spark, width, height, kind):
    """Frames that the JVM writes (with its tables, and with half resolution of colours), decoded as the JVM does."""
    jvm = spark._jvm
    kinds = jvm.java.awt.image.BufferedImage
    image = kinds(width, height, kinds.TYPE_BYTE_GRAY if kind == "grey" else kinds.TYPE_INT_RGB)
    for y in range(height):
        for x in range(width):
            v = (x * 7 + y * 11) % 256
            image.setRGB(x, y, v << 16 | v << 8 | v if kind == "grey" else v << 16 | (255 - v) << 8 | (x * 5) % 256)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    jpeg = bytes(out.toByteArray())
    got = media.picture(jpeg)
    assert got[0].shape == (height, width) and len(got) == (1 if kind == "grey" else 3)
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(jpeg))
    rgb = np.array([[[back.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(width)] for y in range(height)])
    if kind == "grey":
        assert np.abs(got[0].astype(int) - by_java(spark, jpeg)).max() <= 1
    else:
        assert np.abs(got[0] - rgb @ [0.299, 0.587, 0.114]).max() <= 3


def test_usual_tables_and_restarts(spark):
    """A frame without Huffman tables takes the standard's, which are those that the JVM writes."""
    jvm = spark._jvm
    kinds = jvm.java.awt.image.BufferedImage
    image = kinds(24, 24, kinds.TYPE_INT_RGB)
    for k in range(24 * 24):
        image.setRGB(k % 24, k // 24, k * 7919 % (1 << 24))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    jpeg, bare, at = bytes(out.toByteArray()), b"\xff\xd8", 2
    while jpeg[at + 1] != 0xDA:
        n = int.from_bytes(jpeg[at + 2 : at + 4], "big") + 2
        bare += b"" if jpeg[at + 1] == 0xC4 else jpeg[at : at + n]
        at += n
    bare += jpeg[at:]
    assert len(bare) < len(jpeg) - 300 and all((a == b).all() for a, b in zip(media.picture(jpeg), media.picture(bare), strict=True))
    avi = media.write_avi(b"x" * 5000)
    facts = media.read_avi(avi)
    other = avi[:8] + avi[8:].replace(avi[facts["frames"][0][0] : facts["frames"][0][0] + 20], b"\xff\xfe" * 10)
    with pytest.raises(ValueError):
        list(media.decoded(other, media.read_avi(other)))
    for bad in (b"", b"\xff\xd8\xff\xd9", jpeg[: len(jpeg) // 2], jpeg.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(ValueError):
            media.picture(bad)


def test_files_of_other_writers(spark):
    """Two streams, an index that counts from the file's beginning or none, an empty frame, and frames of another codec."""
    jvm = spark._jvm
    kinds = jvm.java.awt.image.BufferedImage
    frames = []
    for grey in (30, 30, 31, 220, 221):
        image = kinds(20, 12, kinds.TYPE_INT_RGB)
        for k in range(240):
            image.setRGB(k % 20, k // 20, grey * 0x10101)
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(image, "jpg", out)
        frames.append(bytes(out.toByteArray()))
    frames.insert(2, b"")
    c = media.chunk
    strl = lambda kind: c(b"LIST", b"strl" + c(b"strh", kind + b"MJPG" + bytes(12) + (2).to_bytes(4, "little") + (20).to_bytes(4, "little") + bytes(28)))
    head = b"AVI " + c(b"LIST", b"hdrl" + c(b"avih", bytes(56)) + strl(b"auds") + strl(b"vids"))
    for indexed in (True, False):
        body, index = b"movi", b""
        for f in frames:
            for name, raw in ((b"01dc", f), (b"00wb", b"sound")):
                index += name + (16).to_bytes(4, "little") + (8 + len(head) + 8 + len(body)).to_bytes(4, "little") + len(raw).to_bytes(4, "little")
                body += c(name, raw)
        data = head + c(b"LIST", body) + (c(b"idx1", index) if indexed else b"")
        avi = b"RIFF" + len(data).to_bytes(4, "little") + data
        got = media.clips(spark.createDataFrame([(1, avi), (2, None)], "doc_id long, avi binary")).orderBy("clip").collect()
        assert [(r.doc_id, r.first_frame, r.end_frame, round(r.end_s, 6)) for r in got] == [(1, 0, 4, 0.4), (1, 4, 6, 0.6)]


def test_media_samples_are_the_inverse_transform():
    codes = np.arange(64, dtype=np.uint8).reshape(1, 1, 64)
    c = np.zeros((8, 8))
    c.ravel()[media.ZIGZAG] = codes.ravel().astype(float) - 255
    k = np.arange(8)
    want = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            s = 0.0
            for u in k:
                for v in k:
                    s += (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * c[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16)
            want[y, x] = s
    assert np.abs(media.samples(codes)[0, 0].astype(int) - np.clip(np.rint(want + 128), 0, 255)).max() <= 1
    assert media.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_shots_are_found():
    dark, light = np.full((6, 16, 8, 8), 40, np.uint8), np.full((5, 16, 8, 8), 200, np.uint8)
    assert media.shots(np.concatenate([dark, light]))[0] == [(0, 6), (6, 11)]


def test_media_of_odd_tables(odd_docs, no_docs):
    got = media.stored_digests(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    for r in odd_docs.collect():
        payload = plain_payload(r.text)
        m = by[r.doc_id]
        assert (m.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32) == (len((r.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert m.clips[0].start_s == 0 and [c.end_frame for c in m.clips][:-1] == [c.first_frame for c in m.clips][1:]
    assert by[1].media_sha256 == by[2].media_sha256 and by[3].payload_bytes == 64
    clips = media.clips(media.media(odd_docs.where("doc_id in (6, 9)")))
    assert {r.doc_id for r in clips.collect()} == {6, 9} and clips.where("end_s <= start_s").count() == 0
    assert media.stored_digests(no_docs).count() == 0


def held(rows_, mod, rest):
    return {r.doc_id for r in rows_ if zlib.crc32(str(r.doc_id).encode()) % mod == rest}


def test_held_out_fold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in docs.where(held_out(4, 2)).collect()}
    assert got == held(docs.collect(), 4, 2)


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, which):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    module, mod, rest = (quality, 4, 2) if which == "quality" else (toxicity, 3, 1)
    scores = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    y = {r.doc_id: r[which] for r in labels.collect()}
    test = [d for d in y if zlib.crc32(str(d).encode()) % mod == rest and d in scores]
    right = sum((scores[d] >= 0.7) == (y[d] == 1) for d in test)
    assert len(test) > 500 and right / len(test) > 0.97


def test_classifiers_without_labels_and_on_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (99, 1, 1), (2, 1, 0), (2, 0, 1)], none.schema)
    for labels in (none, odd):
        for module in (quality, toxicity):
            model = module.fit(odd_docs, labels)
            got = module.score(odd_docs, model)
            assert got.count() == odd_docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
            assert module.score(no_docs, model).count() == 0
    assert toxicity.keep_clean(odd_docs, none).columns == odd_docs.columns
    assert quality.keep_good(odd_docs, none).count() == odd_docs.count()


def test_folding_and_exceptions():
    assert toxicity.fold("You 1d10t, ѕtuріd!") == " you idiot stupid "
    assert toxicity.fold("m0r​on in 2024") == " moron in 2024 "
    lex = toxicity.Lexicon({" idiot ": 5.0, " stup": 5.0}, frozenset({" not stupid "}), -4.0, 2.0, 2.0)
    auto = lex.automaton()
    hit = lambda t: lex.score(*lex.matched(auto, toxicity.fold(t)))
    assert hit("an idiot") > 0.9 and hit("that is not stupid at all") < 0.1 and hit("") < 0.1 and hit("idiotic") < 0.1
    assert hit("an idiot") > hit("an idiot " + "calm words here " * 500)


def test_training_learns_attention():
    """One bad passage among good ones marks a document; the model must find it."""
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0, 1, quality.SIZE), rng.normal(0, 1, quality.SIZE)
    bags = []
    for k in range(300):
        x = good + rng.normal(0, 0.3, (6, quality.SIZE))
        if k % 2:
            x[rng.integers(6)] = bad
        bags.append((x.astype(np.float32), 1 - k % 2))
    m = quality.train(bags, epochs=25)
    right = 0
    for x, y in bags:
        h = m.represent(x)
        a = (np.tanh(h @ m.w["V"]) / (1 + np.exp(-(h @ m.w["U"])))) @ m.w["w"]
        e = np.exp(a - a.max())
        z = (e[:, None] * h).sum(0) / e.sum()
        right += ((z @ m.w["c"] + m.w["b"])[0] > 0) == (y == 1)
    assert right > 290


def test_a_text_of_twenty_million_ids_is_packed_in_proportion():
    import time

    packer = packing.Packer(4096, 16, 0)
    ids = np.arange(20_000_000, dtype="<u4").tobytes()
    began = time.process_time()
    packer.put(1, 0, ids, 20_000_000)
    packer.finish()
    assert time.process_time() - began < 10
    assert sum(r[2] for r in packer.rows) == 20_000_000
    at = 0
    for doc, start, n, crc, total, *_ in packer.rows:
        assert (doc, start, total) == (1, at, 20_000_000) and crc == zlib.crc32(ids[4 * at : 4 * (at + n)])
        at += n
