"""Media columns: texts as PNG images in binary columns, read back with checksum tests, and cosine-transform hashes.

A payload is stored as 8-bit RGB samples, 64 pixels (192 bytes) a row, each row filtered as Sub, Up or None by the
smallest sum of absolute differences. Reading back walks the chunks, tests every CRC, inflates IDAT (zlib tests its
own Adler-32), and undoes the filters with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored

ROW = 192  # bytes of one image row: 64 pixels of three samples
SIGNATURE = b"\x89PNG\r\n\x1a\n"
STEP = 500  # images that are in memory at once
SIDE, LOW = 32, 8  # the hash: a SIDE x SIDE luminance grid, its LOW x LOW low frequencies


class MediaError(ValueError):
    """A stored image that does not read back: bad signature, checksum, header or length."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of ROW, and the length before padding. Null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw)), len(raw)


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """The payload, a positive multiple of ROW bytes, as a PNG."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    left = np.zeros_like(x)
    left[:, 3:] = x[:, :-3]
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    forms = np.stack([x, x - left, x - up])
    cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    rows = np.empty((len(x), ROW + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = forms[kind, np.arange(len(x))]
    head = struct.pack(">IIBBBBB", ROW // 3, len(x), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image from encode_png, or of any 8-bit RGB PNG that uses filters 0 to 4; MediaError otherwise."""
    if media[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    at, idat, size, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise MediaError("cut short")
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or size is None or size[2:] != (8, 2, 0, 0, 0):
        raise MediaError("no end, or not plain 8-bit RGB")
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    wide = size[0] * 3
    if rows.size != size[1] * (wide + 1):
        raise MediaError("wrong length")
    rows = rows.reshape(size[1], wide + 1)
    return unfilter(rows[:, 0], rows[:, 1:], 3).tobytes()


def unfilter(kind: np.ndarray, body: np.ndarray, bpp: int) -> np.ndarray:
    """Undo PNG filters. Runs of None, Sub and Up rows are summed at once; Average and Paeth go byte by byte."""
    if kind.max(initial=0) > 4:
        raise MediaError("unknown filter")
    out = body.copy()
    sub = kind == 1
    if sub.any():
        pixels = out[sub].reshape(int(sub.sum()), -1, bpp)
        out[sub] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(len(pixels), -1)
    hard = np.flatnonzero(kind >= 3)
    if not len(hard):
        # each run of Up rows is a running sum (modulo 256) from the row above it
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != 2]))
        total = np.cumsum(out, axis=0, dtype=np.uint8)
        first = starts[np.searchsorted(starts, np.arange(len(out)), side="right") - 1]
        above = np.zeros_like(out)
        above[1:] = total[:-1]
        return total - above[first]
    for y in range(len(out)):
        up = out[y - 1] if y else np.zeros_like(out[0])
        if kind[y] == 2:
            out[y] += up
        elif kind[y] >= 3:
            row, over = body[y].astype(int), up.astype(int)
            done = np.zeros(len(row) + bpp, int)
            for i in range(len(row)):
                a, b, c = done[i], over[i], over[i - bpp] if i >= bpp else 0
                if kind[y] == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                done[i + bpp] = (row[i] + guess) & 255
            out[y] = done[bpp:]
    return out


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE)) * np.where(k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


_COS = _cosines()


def cosine_hash(payload: bytes) -> bytes:
    """Eight bytes: the signs, against their median, of the lowest two-dimensional cosine frequencies of the image."""
    rgb = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    grey = rgb.mean(axis=2).reshape(len(rgb), SIDE, -1).mean(axis=2)  # 64 wide to SIDE wide
    edges = np.arange(SIDE) * len(grey) // SIDE
    if len(grey) >= SIDE:
        counts = np.diff(np.append(edges, len(grey)))
        grid = np.add.reduceat(grey, edges, axis=0) / counts[:, None]
    else:
        grid = grey[edges]
    low = np.round((_COS @ grid @ _COS.T).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


FIELDS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, media_hash binary"


def _told(n: int, media: bytes) -> tuple:
    """What the stored bytes of an image read back as; MediaError if they don't, or if they lost the padding."""
    back = decode_png(media)
    if len(back) % ROW or back[n:].strip(b" "):
        raise MediaError("padding lost")
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(back)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a PNG in a binary column, and its length before padding."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_png(p) for p, _ in made], pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def read_back(images: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the images of a table (id, n_bytes, media) read back as, with every checksum tested: their id, FIELDS."""
    kind = images.schema[id_col].dataType.simpleString()
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                told = [_told(n, m) for n, m in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = list(zip(*told, strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True))], names=["id", *(n for n, _ in fields)])

    return images.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its text is stored as a PNG in the binary column of a table, and this is what the stored bytes
    read back as, with the 64-bit cosine hash in ``media_hash``. The table stays in the shared folder.

    Null texts are empty; an empty text is one row of 192 spaces. Equal texts give equal values, rows that repeat are
    kept as they are, a null id stays null, an empty table gives no rows, and other columns are not looked at.
    """
    return read_back(stored(encode(docs, id_col, text_col), "media", keep=True), id_col)
