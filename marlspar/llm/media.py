"""Media columns: bytes as greyscale PNG images in binary columns, and perceptual hashes of them.

Writing: payload bytes are 8-bit samples, 192 a row; every row gets the filter with the least sum of
absolute differences, and the image is stored with or without filters, whichever is smaller. Reading
walks the chunks, tests every checksum, inflates, and undoes the five PNG filters with numpy.
The hash is 64 signs of the low-frequency cosine coefficients of the image shrunk to 32 x 32.

Defined cases: a null text is empty, and an empty text is one row of spaces; a damaged image raises
ValueError; equal payloads give equal images and hashes; null ids stay null; repeated rows give
repeated results; texts of any length become one image, whole; an empty table gives no rows; columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, map_batches, narrow

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 192
#: Filters that the writer tries on each row: none, left, above. The reader knows all five.
WRITE_FILTERS = (0, 1, 2)
SIDE, LOW = 32, 8
_COSINES = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5)[None, :] * np.arange(LOW)[:, None])


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of the row width."""
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray, kind: int, bpp: int = 1) -> np.ndarray:
    """All rows (height, bytes) under one PNG filter."""
    left, up, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, bpp:], up[1:], corner[1:, bpp:] = rows[:, :-bpp], rows[:-1], rows[:-1, :-bpp]
    if kind == 3:
        return rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    if kind == 4:
        return rows - _nearest(left, up, corner)
    return rows - (np.zeros_like(rows), left, up)[kind]


def _nearest(left, up, corner):
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    near_a, near_b, near_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((near_a <= near_b) & (near_a <= near_c), left, np.where(near_b <= near_c, up, corner)).astype(np.uint8)


def unfiltered(kinds: np.ndarray, rows: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Undo PNG filters. Runs of rows with the filters none, left or above are whole-array sums modulo
    256; the two filters that need both neighbours go pixel by pixel."""
    out = rows.copy()
    height, width = out.shape
    sides = np.flatnonzero(kinds == 1)
    if len(sides):
        lanes = out[sides].reshape(len(sides), width // bpp, bpp)
        out[sides] = np.cumsum(lanes, axis=1, dtype=np.uint8).reshape(len(sides), width)
    y = 0
    while y < height:
        if kinds[y] == 2:
            stop = y
            while stop < height and kinds[stop] == 2:
                stop += 1
            first = max(y - 1, 0)
            out[first:stop] = np.cumsum(out[first:stop], axis=0, dtype=np.uint8)
            y = stop
            continue
        if kinds[y] > 2:
            above = out[y - 1] if y else np.zeros(width, np.uint8)
            for x in range(0, width, bpp):
                left = out[y, x - bpp : x] if x else np.zeros(bpp, np.uint8)
                guess = ((left.astype(np.uint16) + above[x : x + bpp]) >> 1).astype(np.uint8) if kinds[y] == 3 else _nearest(left, above[x : x + bpp], above[x - bpp : x] if x else np.zeros(bpp, np.uint8))
                out[y, x : x + bpp] += guess
        y += 1
    return out


def write_png(payload: bytes, filters=WRITE_FILTERS, level: int = 1) -> bytes:
    """A greyscale PNG of WIDTH samples a row; the payload's length must be a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    options = np.stack([filtered(rows, k) for k in filters])
    cost = np.minimum(options, 0 - options).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = np.asarray(filters, np.uint8)[best]
    lines[:, 1:] = options[best, np.arange(len(rows))]
    plain = np.zeros_like(lines)
    plain[:, 1:] = rows
    body = min(zlib.compress(plain.tobytes(), level), zlib.compress(lines.tobytes(), level), key=len)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> np.ndarray:
    """The samples (height, bytes a row) of an 8-bit, not interlaced PNG without a palette."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"the checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or any(head[4:]):
        raise ValueError("this kind of PNG is not supported")
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if lines.size != head[1] * (head[0] * bpp + 1):
        raise ValueError("the image has the wrong size")
    lines = lines.reshape(head[1], head[0] * bpp + 1)
    if lines[:, 0].max() > 4:
        raise ValueError("unknown filter")
    return unfiltered(lines[:, 0], lines[:, 1:], bpp)


def _shrink(samples: np.ndarray, axis: int) -> np.ndarray:
    n = samples.shape[axis]
    edges = np.arange(SIDE + 1) * n // SIDE
    if n < SIDE:
        return samples.take(edges[:-1], axis=axis)
    sums = np.add.reduceat(samples, edges[:-1], axis=axis)
    return sums / np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency cosine coefficients exceed their median."""
    small = _shrink(_shrink(samples.astype(np.float64), 0), 1)
    low = (_COSINES @ small @ _COSINES.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _write_batches(batches):
    for batch in batches:
        data, at = flat(batch["text"])
        media = [write_png(pad(data[at[i] : at[i + 1]].tobytes())) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read_batches(batches):
    for batch in batches:
        data, at = flat(batch["media"])
        rows = []
        for i in range(batch.num_rows):
            samples = read_png(media := data[at[i] : at[i + 1]].tobytes())
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
        columns = [*zip(*rows, strict=True)] or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *map(pa.array, columns, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (binary: the PNG file)."""
    return map_batches(narrow(docs, id_col, text_col, binary=True), _write_batches, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Decode a media column: sizes and digests of payload and file, and hash (binary, 8 bytes)."""
    return map_batches(media, _read_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")


def op2(docs: DataFrame) -> DataFrame:
    return read_media(to_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("hash")).alias("feature"))
