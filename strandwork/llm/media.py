"""Binary columns as 8-bit grey PNG images: writing, checked reading, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, IDAT, SIDE, LOW = 64, 1 << 18, 32, 8
#: Rows that share a filter when images are written.
BAND = 32
_k = np.arange(LOW)[:, None]
_DCT = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * _k / (2 * SIDE))


def pad(body: bytes, multiple: int = WIDTH) -> bytes:
    """Bytes 0 appended up to a positive multiple."""
    return body + bytes(-len(body) % multiple if body else multiple)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """Grey 8-bit PNG of rows of `width` samples in IDAT chunks of at most IDAT bytes.

    Each band of BAND rows has the one of the filters None, Sub and Up whose differences, taken as signed bytes, are least
    in sum; of equal ones the first. Average and Paeth are read but not written: they are undone sample after sample.
    """
    if not payload or len(payload) % width:
        raise ValueError(f"the payload must be a positive multiple of {width} bytes")
    height = len(payload) // width
    rows = np.zeros((height, width + 1), dtype=np.uint8)
    plain = np.frombuffer(payload, dtype=np.uint8).reshape(height, width)
    left, up = np.zeros_like(plain), np.zeros_like(plain)
    left[:, 1:], up[1:] = plain[:, :-1], plain[:-1]
    tried = [plain, plain - left, plain - up]
    sums = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in tried])
    best = np.add.reduceat(sums, np.arange(0, height, BAND), axis=1).argmin(axis=0).repeat(BAND)[:height]
    rows[:, 0] = best
    for k in np.unique(best):
        rows[best == k, 1:] = tried[k][best == k]
    packed = zlib.compress(rows, level)
    parts = [_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def _wave(out: np.ndarray, a: int, b: int, kind: int) -> None:
    """Undo Average (3) or Paeth (4) in rows a to b, a slanting front of samples at a time: each needs those left, above and between."""
    width = out.shape[1]
    grid = np.zeros((b - a + 1, width + 1), dtype=np.int16)  # with the row above and a column of 0
    grid[0, 1:], grid[1:, 1:] = (out[a - 1] if a else 0), out[a:b]
    for front in range(width + b - a - 1):
        y = np.arange(max(0, front - width + 1), min(b - a, front + 1)) + 1
        x = front - y + 2
        left, up, corner = grid[y, x - 1], grid[y - 1, x], grid[y - 1, x - 1]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            near = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        grid[y, x] = (grid[y, x] + guess) & 255
    out[a:b] = grid[1:, 1:]


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the five row filters of one-byte samples; runs of rows of one vectorisable filter are undone together."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if not kinds.any():
        return out
    if kinds.max() > 4:
        raise ValueError("unknown PNG row filter")
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(edges, edges[1:], strict=False):
        kind = kinds[a]
        above = out[a - 1] if a else np.zeros(out.shape[1], dtype=np.uint8)
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8) + above
        elif kind > 2:
            _wave(out, a, b, int(kind))
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples (height, width) of an 8-bit grey PNG; every chunk's checksum is tested, damage raises ValueError."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, stream, ended = 8, None, zlib.decompressobj(), False
    data = []
    while not ended:
        if at + 12 > len(media):
            raise ValueError("the PNG ends early")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(media[at + 4 : at + 8 + n]):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(stream.decompress(body))
        ended, at = kind == b"IEND", at + 12 + n
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images that are not interlaced are read")
    raw = b"".join(data) + stream.flush()
    if len(raw) != header[1] * (header[0] + 1):
        raise ValueError("the PNG holds another number of samples")
    return _unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(header[1], header[0] + 1))


def cosine_hash(samples: np.ndarray) -> str:
    """64-bit perceptual hash, 16 hex digits: the image averaged to 32x32, its 8x8 lowest cosine terms against their median."""
    h, w = samples.shape
    grid = samples.astype(np.float64)
    for n in (h, w):
        cuts = (np.arange(SIDE + 1) * n) // SIDE
        low, high = np.minimum(cuts[:-1], n - 1), np.maximum(cuts[1:], np.minimum(cuts[:-1], n - 1) + 1)
        sums = np.vstack([np.zeros((1, grid.shape[1])), np.cumsum(grid, axis=0)])
        grid = ((sums[high] - sums[low]) / (high - low)[:, None]).T
    terms = (_DCT @ grid @ _DCT.T).round(6).ravel()
    bits = terms > np.median(terms[1:])
    return np.packbits(bits).tobytes().hex()


def _store(batches, level):
    for batch in batches:
        bodies = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array([encode_png(pad(b), level=level) for b in bodies], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        out = [[] for _ in range(6)]
        for media in batch.column(2).to_pylist():
            samples = decode_png(media)
            payload = samples.tobytes()
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=names)


def store_as_png(df: DataFrame, key: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, padded, as a PNG in a binary column.

    A null or empty text is 64 bytes of 0; repeated rows and null keys keep a row each; other columns are ignored.
    """
    arrow_batches(df.sparkSession, 1000)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: _store(b, level), "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read every stored image back, test its checksums and compute digests and the cosine hash of its samples."""
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
