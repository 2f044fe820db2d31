"""Media columns: AVI motion-JPEG with intra frames, and shots found in them.

`store` turns bytes into an AVI file: a RIFF with a header list, a `movi` list of `00dc` chunks and an `idx1` index. Each
chunk is one intra frame of `SIDE` x `SIDE` grey samples in lossless JPEG (SOF3: left prediction, each difference as a
Huffman-coded category and its extra bits; all categories have codes of four bits). So the stored form gives back every
sample exactly, at 8 bits each. `Reader` parses RIFF and index, decodes the frames and yields samples; `shots` cuts them
where the histogram difference of neighbouring frames is above an adaptive threshold (mean plus `DEVIATIONS` standard
deviations of the `WINDOW` differences before it), which gives clips timed at `FPS` frames a second.

Frames are coded and decoded in lockstep: sample i of many frames at once, in numpy, at most `FRAMES` frames at a time, so
memory is bounded whatever the length of a text.

Nulls and edge cases: a null or empty text is one frame of 255s; repeated rows and null doc_ids are rows like others; very
long texts become long clips, whole; extra columns are ignored; an empty table gives an empty result. UTF-8 holds no byte
255, so the padding is told from the text. A damaged file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE, FPS, FRAMES, PAD = 24, 25, 4096, 255
AREA = SIDE * SIDE
BINS, WINDOW, DEVIATIONS, LEAST_CUT = 16, 8, 3.0, 0.25
CATEGORIES = 9  # of differences of 8-bit samples: 0 to 8 extra bits
CODE = 4  # bits of each category's code


def _frame_head() -> bytes:
    """Everything before the entropy-coded data; the same for every frame."""
    counts = bytes(CATEGORIES if i == CODE else 0 for i in range(1, 17))
    table = b"\x00" + counts + bytes(range(CATEGORIES))
    frame = struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00"
    scan = b"\x01\x01\x00" + bytes([1, 0, 0])  # one component, predictor 1 (left)
    part = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xC4, table) + part(0xC3, frame) + part(0xDA, scan)


HEAD, TAIL = _frame_head(), b"\xff\xd9"


def _predicted(frames: np.ndarray) -> np.ndarray:
    """What each sample is predicted as: 128 for the first, the one above for the first of a row, else the left one."""
    out = np.empty(frames.shape, np.int16)
    square = frames.reshape(-1, SIDE, SIDE)
    p = out.reshape(-1, SIDE, SIDE)
    p[:, :, 1:] = square[:, :, :-1]
    p[:, 1:, 0] = square[:, :-1, 0]
    p[:, 0, 0] = 128
    return out


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """`frames`: n x AREA of uint8 -> n JPEG images."""
    diff = frames.astype(np.int16) - _predicted(frames)
    size = np.zeros(diff.shape, np.int64)
    magnitude = np.abs(diff)
    for b in range(CATEGORIES - 1):
        size += magnitude >= 1 << b
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    length = size + CODE
    value = (size.astype(np.uint64) << size.astype(np.uint64)) | extra
    ends = np.cumsum(length, axis=1)
    words = int(ends[:, -1].max()) // 32 + 2
    begin = ends - length
    # place each code in the 64 bits that start at its word; neighbours are disjoint, so sums are unions
    shift = (64 - (begin & 31) - length).astype(np.uint64)
    at = (begin >> 5) + np.arange(len(frames))[:, None] * words
    flat, spread = at.ravel(), (value << shift).ravel()
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    sums = np.add.reduceat(spread, starts)
    out = np.zeros(len(frames) * words, np.uint64)
    out[flat[starts]] = sums >> np.uint64(32)
    out[flat[starts] + 1] += sums & np.uint64(0xFFFFFFFF)
    data = out.astype(">u4").reshape(len(frames), words)
    made = []
    for row, bits in zip(data, ends[:, -1].tolist()):
        body = bytearray(row.tobytes()[: (bits + 7) // 8])
        if bits & 7:
            body[-1] |= (1 << 8 - (bits & 7)) - 1  # the last byte is filled with ones
        made.append(HEAD + bytes(body).replace(b"\xff", b"\xff\x00") + TAIL)
    return made


def decode_frames(images: list[bytes]) -> np.ndarray:
    """The samples of images as `encode_frames` makes them: n x AREA of uint8."""
    bodies = []
    for x in images:
        if not x.startswith(HEAD) or not x.endswith(TAIL):
            raise ValueError("not a lossless frame of the expected form")
        bodies.append(x[len(HEAD) : -len(TAIL)].replace(b"\xff\x00", b"\xff"))
    wide = max(map(len, bodies)) + 4
    raw = np.frombuffer(b"".join(b.ljust(wide, b"\0") for b in bodies), np.uint8).reshape(len(bodies), wide).astype(np.uint32)
    # the 32 bits that start at each byte: a code has 12 at most, so 7 + 12 of them hold it
    window = np.zeros((len(bodies), wide), np.uint32)
    window[:, :-3] = raw[:, :-3] << 24 | raw[:, 1:-2] << 16 | raw[:, 2:-1] << 8 | raw[:, 3:]
    window, base = window.ravel(), np.arange(len(bodies), dtype=np.int64) * wide
    bit = np.zeros(len(bodies), np.int64)
    samples = np.empty((AREA, len(bodies)), np.int32)
    for i in range(AREA):
        w = window[base + (bit >> 3)] << (bit & 7).astype(np.uint32)
        size = (w >> np.uint32(28)).astype(np.int64)
        extra = ((w >> np.uint32(20)) & np.uint32(0xFF)).astype(np.int64) >> (8 - size)
        half = (1 << size) >> 1
        diff = np.where(extra < half, extra - (1 << size) + 1, extra)
        before = 128 if i == 0 else samples[i - SIDE] if i % SIDE == 0 else samples[i - 1]
        samples[i] = before + diff
        bit += size + CODE
    if samples.min() < 0 or samples.max() > 255 or (bit > 8 * (wide - 4)).any():
        raise ValueError("damaged frame")
    return samples.T.astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(images: list[bytes]) -> bytes:
    most = max(map(len, images))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(images), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(images), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", AREA, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    movi, index, at = [b"movi"], [], 4
    for x in images:
        c = _chunk(b"00dc", x)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + header + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> list[bytes]:
    """The images that the RIFF index lists, in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    end, at, movi, index = 8 + struct.unpack_from("<I", data, 4)[0], 12, None, None
    if end > len(data):
        raise ValueError("the file is cut off")
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    out = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1]]):
        if name == b"00dc":
            start = movi + offset
            if data[start : start + 8] != b"00dc" + struct.pack("<I", size):
                raise ValueError("the index does not match the frames")
            out.append(data[start + 8 : start + 8 + size])
    return out


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(AREA, -(-len(raw) // AREA) * AREA), bytes([PAD]))


def store(payload: bytes) -> bytes:
    """An AVI whose frames hold `payload` (a positive multiple of AREA bytes)."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, AREA)
    images = [x for i in range(0, len(frames), FRAMES) for x in encode_frames(frames[i : i + FRAMES])]
    return write_avi(images)


def shots(frames: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, frame after the last, histogram difference at its start) of each shot."""
    n = len(frames)
    cells = (np.arange(n)[:, None] * BINS + (frames >> 4)).ravel()
    hist = np.bincount(cells, minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * AREA)
    cuts = [(0, 0.0)]
    if n > 1:
        total, square = np.r_[0.0, np.cumsum(diff)], np.r_[0.0, np.cumsum(diff * diff)]
        i = np.arange(n - 1)
        lo = np.maximum(0, i - WINDOW)
        k = np.maximum(1, i - lo)
        mean = (total[i] - total[lo]) / k
        spread = np.sqrt(np.maximum(0, (square[i] - square[lo]) / k - mean * mean))
        cuts += [(int(j) + 1, float(diff[j])) for j in np.flatnonzero((diff > LEAST_CUT) & (diff > mean + DEVIATIONS * spread))]
    ends = [c for c, _ in cuts[1:]] + [n]
    return [(a, b, d) for (a, d), b in zip(cuts, ends)]


def _groups(sizes: list[int]):
    """Runs of files of at most FRAMES frames together, or one longer file."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > FRAMES:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def _stored(batches):
    for b in batches:
        ids, texts, media = b.column(0).cast(pa.int64()), b.column(1), []
        sizes = [max(1, -(-len(t.as_buffer()) // AREA)) if t.is_valid else 1 for t in texts]
        for lo, hi in _groups(sizes):
            frames = np.frombuffer(b"".join(padded(texts[i].as_py()) for i in range(lo, hi)), np.uint8).reshape(-1, AREA)
            images = [x for i in range(0, len(frames), FRAMES) for x in encode_frames(frames[i : i + FRAMES])]
            at = 0
            for n in sizes[lo:hi]:
                media.append(write_avi(images[at : at + n]))
                at += n
            if sum(map(len, media)) > 16 << 20:  # rows are handed on before they fill memory
                yield pa.RecordBatch.from_arrays([ids[hi - len(media) : hi], pa.array(media, pa.binary())], names=["doc_id", "media"])
                media = []
        if media:
            yield pa.RecordBatch.from_arrays([ids[len(ids) - len(media) :], pa.array(media, pa.binary())], names=["doc_id", "media"])


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_ms:long,end_ms:long,first_frame:int,frames:int,difference:double>>"
_CLIP = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("difference", pa.float64())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("clips", pa.list_(_CLIP))])


def _read_back(batches):
    """Files are parsed and decoded some FRAMES frames at a time, and their rows handed on."""
    for b in batches:
        ids, media = b.column(0).to_pylist(), b.column(1)
        group: list[tuple[int, bytes, list]] = []
        frames = 0
        for i, m in zip(ids, media):
            raw = m.as_py()
            images = read_avi(raw)
            if group and frames + len(images) > FRAMES:
                yield _rows(group)
                group, frames = [], 0
            group.append((i, raw, images))
            frames += len(images)
        if group:
            yield _rows(group)


def _rows(group: list[tuple[int, bytes, list]]) -> pa.RecordBatch:
    images = [x for _, _, f in group for x in f]
    frames = np.concatenate([decode_frames(images[i : i + FRAMES]) for i in range(0, len(images), FRAMES)])
    rows, at = [], 0
    for doc_id, raw, own_images in group:
        own = frames[at : at + len(own_images)]
        at += len(own)
        payload = own.tobytes()
        clips = [{"start_ms": a * 1000 // FPS, "end_ms": z * 1000 // FPS, "first_frame": a, "frames": z - a, "difference": d} for a, z, d in shots(own)]
        feature = f"{len(own)} frames, {len(clips)} shots: " + ",".join(f"{c['start_ms']}-{c['end_ms']}" for c in clips)
        rows.append({"doc_id": doc_id, "n_bytes": len(payload.rstrip(b"\xff")), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest(), "feature": feature, "clips": clips})
    return pa.RecordBatch.from_pylist(rows, schema=_READ)


def media(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` -> doc_id, media (the AVI file of the text's padded bytes)."""
    return docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, media binary")


def clips(stored: DataFrame) -> DataFrame:
    """`stored(doc_id, media)` -> one row per file: sizes and digests of what was read back, and its timed clips."""
    return stored.select("doc_id", "media").mapInArrow(_read_back, READ)
