"""Media columns: AVI files of motion JPEG, their index, intra frames and shots (operator 5).

A payload of bytes is stored without loss as the quantised coefficients of greyscale baseline JPEG frames: 64 bytes
are one block of 8 x 8. Each byte is the eight magnitude bits of a coefficient of size category 8, coded with one
Huffman symbol of one bit, and a restart after every block keeps the DC coefficient independent. So a block takes
72 bits exactly, and whole frames are coded and decoded with array operations.

Reading goes by the RIFF structure: the header list, the movi list and the idx1 index that points at each frame (files
without one are walked). Frames of the form above are decoded by arrays, all other baseline frames by their own Huffman
tables (those of the standard where a frame has none), quantisation, sampling factors and restarts. A shot ends where
the difference of neighbouring frames' sample histograms exceeds an adaptive bound, the mean of the shot's differences
so far plus a multiple of their spread. Each shot is a timed clip row.

Files are written and read a few hundred frames at a time, so beside a file and its text a task holds little.

Defined cases: null and empty texts are one block of zeros; equal texts give equal files; very long texts are many
frames, worked on one file at a time; a file over RIFF's 4 GB raises ValueError (a text of 2 GB, Spark's longest, stays
below); repeated rows are stored each; an empty table gives no rows; further columns are ignored; null files have no
clips; a file that is damaged, or whose frames aren't baseline JPEG, raises ValueError; an empty frame repeats the one
before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.common import as_batch, pieces, texts

#: A frame of 32 x 32 samples is 16 blocks.
SIDE = 4
BLOCKS = SIDE * SIDE
FRAME = 64 * BLOCKS
RATE = 25
#: Frames coded or decoded at once.
STEP = 256
#: Order in which a block's coefficients are coded: row and column of each place on the diagonals.
_diagonals = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
ZIGZAG = np.array([8 * r + c for r, c in _diagonals])
_k = np.arange(8)
DCT = (np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * _k + 1) * _k[:, None] * np.pi / 16)).astype(np.float32)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def head(side: int = SIDE) -> bytes:
    """All markers of a frame before its coded data: tables, size, restart interval of one block, scan."""
    size = 8 * side
    one = bytes([1] + [0] * 15)
    return (b"\xff\xd8" + segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC0, struct.pack(">BHHBBBB", 8, size, size, 1, 1, 0x11, 0))
            + segment(0xC4, b"\x00" + one + b"\x08") + segment(0xC4, b"\x10" + one + b"\x08")
            + segment(0xDD, struct.pack(">H", 1)) + segment(0xDA, b"\1\1\x00\0\x3f\0"))


HEAD = head()


def encode_frames(payload: bytes) -> Iterator[bytes]:
    """JPEG files of the payload; the last frame is filled up with zero bytes."""
    for at in range(0, len(payload), STEP * FRAME):
        part = payload[at : at + STEP * FRAME]
        n = -(-len(part) // FRAME)
        data = np.frombuffer(part.ljust(n * FRAME, b"\0"), np.uint8).reshape(-1, 64)
        bits = np.zeros((len(data), 64, 9), np.uint8)  # the code is a 0 bit, then eight bits of magnitude
        bits[:, :, 1:] = np.unpackbits(data[:, :, None], axis=2)
        coded = np.packbits(bits.reshape(len(data), -1), axis=1)
        for f in range(n):
            scan = []
            for b in range(BLOCKS):
                if b:
                    scan.append(bytes((0xFF, 0xD0 + (b - 1) % 8)))
                raw = coded[f * BLOCKS + b].tobytes()
                scan.append(raw.replace(b"\xff", b"\xff\0") if b"\xff" in raw else raw)
            yield HEAD + b"".join(scan) + b"\xff\xd9"


def own_codes(frames: list[bytes]) -> np.ndarray:
    """Quantised coefficients in coding order, (frames, blocks, 64), as the byte each stands for, of this codec's frames."""
    blocks = []
    for jpeg in frames:
        scan = jpeg[len(HEAD) : -2]
        if jpeg[-2:] != b"\xff\xd9":
            raise ValueError("a frame without an end")
        if scan.count(b"\xff\0"):
            # restart markers are never 0 after 0xff, so undoing the stuffing first keeps them apart by their place
            pieces_, start, k = [], 0, 0
            while k < BLOCKS - 1:
                end = scan.index(bytes((0xFF, 0xD0 + k % 8)), start)
                pieces_.append(scan[start:end].replace(b"\xff\0", b"\xff"))
                start, k = end + 2, k + 1
            pieces_.append(scan[start:].replace(b"\xff\0", b"\xff"))
            blocks.append(b"".join(pieces_))
        else:
            raw = np.frombuffer(scan + b"\xff\xd0", np.uint8)
            if len(raw) != BLOCKS * 74:
                raise ValueError("coded data of another length")
            blocks.append(raw.reshape(BLOCKS, 74)[:, :72].tobytes())
    coded = np.frombuffer(b"".join(blocks), np.uint8)
    if len(coded) != len(frames) * BLOCKS * 72:
        raise ValueError("coded data of another length")
    bits = np.unpackbits(coded).reshape(-1, 64, 9)
    if bits[:, :, 0].any():
        raise ValueError("a code outside the table")
    return np.packbits(bits[:, :, 1:], axis=2).reshape(len(frames), BLOCKS, 64)


#: Fixed values of the JPEG standard (Annex K.3): how many Huffman codes of each length from 1 on, and the symbols of the
#: codes shorter than 16 bits; those of 16 bits are the remaining symbols in ascending order.
USUAL = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1), "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1), "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
           "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
           "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


@lru_cache(maxsize=64)
def huffman(counts: bytes, symbols: bytes) -> list[int]:
    """By the next 16 bits: 256 times the length of the code they begin with, plus its symbol; -1 for none."""
    table, code, k = [-1] * (1 << 16), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            at, many = code << 16 - length, 1 << 16 - length
            if at + many > len(table):
                raise ValueError("a Huffman table with too many codes")
            table[at : at + many] = [length << 8 | symbol] * many
            code += 1
        k, code = k + n, code << 1
    return table


def usual(number: int) -> list[int]:
    counts, short = USUAL[number]
    first = bytes.fromhex(short)
    every = [r << 4 | s for r in range(16) for s in range(1, 11)] if number & 0x10 else []
    return huffman(bytes(counts), first + bytes(sorted(set(every) - set(first))))


def headers(jpeg: bytes) -> dict:
    """Size, components, tables and restart interval of a frame, and where its coded data begins."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, info = 2, {"huff": {}, "quant": {}, "restart": 0}
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one must be")
        mark = jpeg[at + 1]
        if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD7:  # fill byte, or markers without a body
            at += 1 if mark == 0xFF else 2
            continue
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("a frame without size, or of other than 8 bits")
            info["size"] = height, width
            info["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("a frame that isn't baseline JPEG")
        elif mark == 0xDB:
            while body:
                wide = body[0] >> 4
                info["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                info["huff"][body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            info["restart"] = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            info["scan"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            info["at"] = at
            if "size" not in info:
                raise ValueError("a scan without a frame")
            return info
    raise ValueError("a frame without a scan")


def intervals(scan: bytes) -> Iterator[bytes]:
    """Coded data between restart markers, without stuffing, up to the frame's end."""
    start = at = 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if scan[at + 1] == 0:
            at += 2
        elif scan[at + 1] == 0xFF:
            at += 1
        else:
            yield scan[start:at].replace(b"\xff\0", b"\xff")
            if not 0xD0 <= scan[at + 1] <= 0xD7:
                return
            start = at = at + 2
    raise ValueError("a frame without an end")


def picture(jpeg: bytes) -> list[np.ndarray]:
    """Samples of each component of any baseline frame, as coded: components of less resolution are smaller."""
    info = headers(jpeg)
    height, width = info["size"]
    parts = info["parts"]
    if set(info["scan"]) != {c for c, *_ in parts}:
        raise ValueError("a frame of several scans")
    if len(parts) == 1:  # one component is never interleaved
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    h_max, v_max = max(h for _, h, _, _ in parts), max(v for _, _, v, _ in parts)
    across, down = -(-width // (8 * h_max)), -(-height // (8 * v_max))
    coefficients = [np.zeros((down * v, across * h, 64), np.int64) for _, h, v, _ in parts]
    tables = []
    for c, *_ in parts:
        dc, ac = info["scan"][c]
        tables.append((info["huff"].get(dc) or usual(dc & 1), info["huff"].get(0x10 | ac) or usual(0x10 | ac & 1)))
    unit, total = 0, across * down
    for raw in intervals(jpeg[info["at"] :]):
        bits, have, at, last = 0, 0, 0, [0] * len(parts)
        for _ in range(min(info["restart"] or total, total - unit)):
            row, col = divmod(unit, across)
            for k, (_, h, v, _) in enumerate(parts):
                for b in range(h * v):
                    block = coefficients[k][row * v + b // h, col * h + b % h]
                    place = 0
                    while place < 64:
                        while have < 32:  # beyond the end ones are read, as the standard pads with them
                            bits, have, at = (bits << 8 | (raw[at] if at < len(raw) else 0xFF)) & 0xFFFFFFFFFFFF, have + 8, at + 1
                        found = tables[k][place > 0][bits >> have - 16 & 0xFFFF]
                        if found < 0 or at > len(raw) + 8:
                            raise ValueError("a code outside the table")
                        have -= found >> 8
                        size, run = found & 15, found >> 4 & 15
                        if place and not size:
                            if run < 15:
                                break
                            place += 16
                            continue
                        place += run if place else 0
                        value = 0
                        if size:
                            value = bits >> have - size & (1 << size) - 1
                            have -= size
                            if value < 1 << size - 1:
                                value -= (1 << size) - 1
                        if place > 63:
                            raise ValueError("a block of more than 64 coefficients")
                        if not place:
                            value = last[k] = last[k] + value
                        block[place] = value
                        place += 1
            unit += 1
        if unit == total:
            break
    if unit != total:
        raise ValueError("a frame that ends early")
    out = []
    for (_, h, v, q), c in zip(parts, coefficients, strict=True):
        plane = np.zeros(c.shape, np.float64)
        plane[..., ZIGZAG] = c * info["quant"][q]
        plane = np.rint(DCT.T.astype(float) @ plane.reshape(*c.shape[:2], 8, 8) @ DCT.astype(float) + 128)
        whole = np.clip(plane, 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * c.shape[0], 8 * c.shape[1])
        out.append(whole[: -(-height * v // v_max), : -(-width * h // h_max)])
    return out


def samples(codes: np.ndarray) -> np.ndarray:
    """Decoded samples (frames, blocks, 8, 8): inverse DCT of the coefficients that the bytes stand for."""
    c = codes.astype(np.float32)
    c -= np.where(codes < 128, np.float32(255), np.float32(0))
    plane = np.empty_like(c)
    plane[..., ZIGZAG] = c
    plane = plane.reshape(*codes.shape[:2], 8, 8)
    return np.clip(np.rint(DCT.T @ plane @ DCT + 128), 0, 255).astype(np.uint8)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload; its length in bytes is kept in the INFO list."""
    n, size = -(-len(payload) // FRAME), 8 * SIDE
    movi, index, most = bytearray(b"LIST\0\0\0\0movi"), bytearray(), 0
    for f in encode_frames(payload):
        index += struct.pack("<4sIII", b"00dc", 0x10, len(movi) - 8, len(f))
        movi += chunk(b"00dc", f)
        most = max(most, len(f))
    if len(movi) + len(index) + 1024 >= 1 << 32:
        raise ValueError("a payload that needs more than the 4 GB of a RIFF file")
    struct.pack_into("<I", movi, 4, len(movi) - 8)
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, size, size, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, size, size)
    form = struct.pack("<IiiHH4sIiiII", 40, size, size, 1, 8, b"MJPG", size * size, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", str(len(payload)).encode() + b"\0"))
    before = b"AVI " + hdrl + info
    total = len(before) + len(movi) + 8 + len(index)
    return b"".join([b"RIFF", struct.pack("<I", total), before, movi, b"idx1", struct.pack("<I", len(index)), index])


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks in a range; a list's name is its kind."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError("a chunk beyond its list")
        yield (data[at + 8 : at + 12], at + 12, size - 4) if name in (b"LIST", b"RIFF") else (name, at + 8, size)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> dict:
    """An AVI file's seconds a frame, the place and size of each frame of its first video stream (by the index, else by
    walking the movi list), and, where this module wrote it, the stored length."""
    top = list(chunks(data, 0, len(data)))
    if not top or top[0][0] != b"AVI ":
        raise ValueError("not an AVI file")
    _, at, size = top[0]
    out: dict = {"seconds": 1 / RATE, "frames": []}
    base, inside, index, video, streams = 0, (0, 0), (0, 0), None, 0
    for name, start, n in chunks(data, at, at + size):
        if name == b"hdrl":
            for sub, s, m in chunks(data, start, start + n):
                if sub == b"avih":
                    out["seconds"] = struct.unpack_from("<I", data, s)[0] / 1e6
                elif sub == b"strl":
                    for part, t, _ in chunks(data, s, s + m):
                        if part == b"strh" and data[t : t + 4] == b"vids" and video is None:
                            video = streams
                            scale, rate = struct.unpack_from("<II", data, t + 20)
                            out["seconds"] = scale / rate if scale and rate else out["seconds"]
                    streams += 1
        elif name == b"INFO":
            for sub, s, m in chunks(data, start, start + n):
                if sub == b"ICMT" and (text := data[s : s + m].rstrip(b"\0")).isdigit():
                    out["length"] = int(text)
        elif name == b"movi":
            base, inside = start - 4, (start, start + n)
        elif name == b"idx1":
            index = start, n
    wanted = (b"%02ddc" % (video or 0), b"%02ddb" % (video or 0))

    def walk(a: int, z: int) -> Iterator[tuple[int, int]]:
        for name, s, m in chunks(data, a, z):
            if name == b"rec ":
                yield from walk(s, s + m)
            elif name in wanted:
                yield s, m

    if not index[1]:
        out["frames"] = list(walk(*inside))
        return out
    entries = [e for e in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]) if e[0] in wanted]
    if entries and data[base + entries[0][2] : base + entries[0][2] + 4] != entries[0][0]:
        base = 0  # some writers count from the file's beginning
    for name, _, offset, n in entries:
        at = base + offset
        if data[at : at + 4] != name or at + 8 + n > len(data):
            raise ValueError("the index points at no frame")
        out["frames"].append((at + 8, n))
    return out


def decoded(data: bytes, facts: dict) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """A few frames at a time: the bytes they store (None for frames of other codecs) and their samples of brightness,
    (frames, ...)."""
    last = None
    for own, some in groupby(facts["frames"], key=lambda f: data.startswith(HEAD, f[0])):
        if not own:
            for at, n in some:
                if n:
                    last = picture(data[at : at + n])[0][None]
                elif last is None:
                    raise ValueError("an empty frame before all others")
                yield None, last
            continue
        some = list(some)
        for k in range(0, len(some), STEP):
            codes = own_codes([data[at : at + n] for at, n in some[k : k + STEP]])
            shown = samples(codes)
            last = shown[-1:]
            yield codes.tobytes(), shown


def cuts_of(differences: Iterable[float], factor: float = 3.0, least: float = 0.05) -> list[int]:
    """Frames at which shots begin: 0, and where a difference to the frame before passes the shot's own bound."""
    cuts, n, total, squares = [0], 0, 0.0, 0.0
    for k, d in enumerate(differences):
        mean = total / n if n else 0.0
        bound = max(least, mean + factor * max(0.0, squares / n - mean * mean) ** 0.5) if n >= 2 else 0.35
        if d > bound:
            cuts.append(k + 1)
            n, total, squares = 0, 0.0, 0.0
        else:
            n, total, squares = n + 1, total + d, squares + d * d
    return cuts


class Watcher:
    """Takes frames a few at a time and keeps histogram differences and the mean of samples."""

    def __init__(self):
        self.frames, self.total, self.count = 0, 0, 0
        self.before: np.ndarray | None = None
        self.differences: list[float] = []

    def see(self, shown: np.ndarray) -> None:
        n = len(shown)
        flat = shown.reshape(n, -1)
        counts = np.bincount((np.arange(n)[:, None] * 16 + (flat >> 4)).ravel(), minlength=n * 16).reshape(n, 16) / flat.shape[1]
        self.total += int(flat.sum(dtype=np.int64))
        self.count += flat.size
        line = counts if self.before is None else np.concatenate([self.before[None], counts])
        self.differences += (np.abs(np.diff(line, axis=0)).sum(axis=1) / 2).tolist()
        self.before = counts[-1]
        self.frames += n

    def shots(self) -> list[tuple[int, int]]:
        """[first, end) frames of each shot."""
        cuts = cuts_of(self.differences)
        return list(zip(cuts, [*cuts[1:], self.frames], strict=True)) if self.frames else []


def shots(pictures: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """[first, end) frames of each shot, and the differences of neighbouring frames' histograms (0 to 1)."""
    w = Watcher()
    w.see(pictures)
    return w.shots(), np.array(w.differences)


def load(data: bytes) -> tuple[bytes, np.ndarray, dict]:
    """The stored bytes, the samples of all frames, and the facts of a file that ``write_avi`` made."""
    facts = read_avi(data)
    raw, shown = zip(*decoded(data, facts), strict=True)
    if None in raw or "length" not in facts:
        raise ValueError("a file that stores no payload")
    return b"".join(raw)[: facts["length"]], np.concatenate(shown), facts


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def media(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``avi``, the file that stores each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("avi", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b):
                yield as_batch({"doc_id": p.column("doc_id"), "avi": [write_avi(padded(t)[1]) for t in p.column("text").to_pylist()]}, schema)

    return texts(docs).mapInArrow(run, "doc_id long, avi binary")


def timed(spans: list[tuple[int, int]], seconds: float) -> list[tuple[int, int, float, float]]:
    return [(a, z, a * seconds, z * seconds) for a, z in spans]


def clips(files: DataFrame) -> DataFrame:
    """A row for each shot of each file: frames, and seconds from the file's own rate."""
    schema = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()),
                        ("start_s", pa.float64()), ("end_s", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, column="avi"):
                rows = []
                for doc, data in zip(p.column("doc_id").to_pylist(), p.column("avi").to_pylist(), strict=True):
                    if data is None:
                        continue
                    facts, w = read_avi(data), Watcher()
                    for _, shown in decoded(data, facts):
                        w.see(shown)
                    rows += [(doc, k, a, z, s, e) for k, (a, z, s, e) in enumerate(timed(w.shots(), facts["seconds"]))]
                if rows:
                    yield as_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return files.select("doc_id", "avi").mapInArrow(run, "doc_id long, clip int, first_frame int, end_frame int, start_s double, end_s double")


CLIP = pa.struct([("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
                    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("clips", pa.list_(CLIP))])
DIGEST_DDL = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
              "clips array<struct<first_frame:int,end_frame:int,start_s:double,end_s:double>>")


def read_digests(avi: bytes) -> tuple:
    """Size, digest and checksum of the tail of what a file stores, the file's size and digest, its feature and clips."""
    facts, w, sha, left, tail = read_avi(avi), Watcher(), hashlib.sha256(), 0, b""
    left = facts["length"]
    for raw, shown in decoded(avi, facts):
        if raw is None:
            raise ValueError("a file that stores no payload")
        raw = raw[:left]
        left -= len(raw)
        sha.update(raw)
        tail = (tail + raw[-64:])[-64:]
        w.see(shown)
    if left:
        raise ValueError("a file that ends before its payload")
    s, d = facts["seconds"], w.differences
    cut = timed(w.shots(), s)
    feature = (f"frames={w.frames};shots={len(cut)};seconds={w.frames * s:.2f};cuts={','.join(f'{a:.2f}' for _, _, a, _ in cut[1:])};"
               f"mean={w.total / w.count:.3f};change={sum(d) / len(d) if d else 0:.4f}")
    return (facts["length"], sha.hexdigest(), zlib.crc32(tail), len(avi), hashlib.sha256(avi).hexdigest(), feature,
            [dict(zip(("first_frame", "end_frame", "start_s", "end_s"), c, strict=True)) for c in cut])


def stored_digests(docs: DataFrame) -> DataFrame:
    """What reading each stored file back gives, with its timed clips. Writing and reading meet in one task, so that the
    files, larger than the texts, aren't shuffled or kept; ``media`` and ``clips`` give the files and clip rows themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b):
                rows = []
                for doc, text in zip(p.column("doc_id").to_pylist(), p.column("text").to_pylist(), strict=True):
                    n, payload = padded(text)
                    rows.append((doc, n, *read_digests(write_avi(payload))))
                yield as_batch(dict(zip(DIGEST.names, zip(*rows, strict=True), strict=True)), DIGEST)

    return texts(docs).mapInArrow(run, DIGEST_DDL)
