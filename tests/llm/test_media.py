import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import media as M


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=900))
def test_round_trip(text):
    payload, n = M.payload_of(text)
    assert len(payload) % 192 == 0 and payload and payload[:n] == text.encode("utf-8", "surrogatepass")
    assert M.decode_png(M.encode_png(payload)) == payload
    assert len(M.cosine_hash(payload)) == 8


def test_checksums_are_tested():
    media = bytearray(M.encode_png(M.payload_of("x" * 1000)[0]))
    for at in (20, 45, len(media) - 3):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(M.MediaError):
            M.decode_png(bytes(bad))
    with pytest.raises(M.MediaError):
        M.decode_png(bytes(media[:-5]))


def test_every_filter():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (6, 12), np.uint8).astype(int)
    rows = []
    for y, kind in enumerate([1, 2, 3, 4, 0, 4]):
        up = x[y - 1] if y else np.zeros(12, int)
        left = np.concatenate([np.zeros(3, int), x[y][:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * left, left, up, (left + up) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((x[y] - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = M.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert M.decode_png(png) == x.astype(np.uint8).tobytes()


def test_table(spark, odd, none):
    rows = M.to_media(odd).collect()
    assert len(rows) == odd.count() == M.encode(odd).filter("media is not null").count()
    one, two = (next(r for r in rows if r.doc_id == k) for k in (1, 4))
    assert one.media_sha256 == two.media_sha256 and one.media_hash == two.media_hash
    empty = next(r for r in rows if r.doc_id == 2)
    assert (empty.n_bytes, empty.payload_bytes) == (0, 192)
    assert M.to_media(none).count() == 0


def test_query_is_recomputed(spark, tmp_path, odd):
    """Every column of the query from the texts alone, by plain code; the feature by the definition of the transform."""
    import hashlib
    import math

    from strandline.llm import queries

    texts = [None, "", "x", "a b" * 64, "ä" * 500, "The cat sat on the mat.\n" * 400]
    spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[-1]])], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_media(spark, str(tmp_path)).collect()}
    assert got[5][1:] == got[6][1:]
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((max(1, math.ceil(len(raw) / 192)) * 192) - len(raw))
        media = M.encode_png(payload)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-16:]), len(media))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())
        grey = [[sum(payload[y * 192 + 3 * x + c] for c in range(3)) / 3 for x in range(64)] for y in range(len(payload) // 192)]
        halves = [[(row[2 * x] + row[2 * x + 1]) / 2 for x in range(32)] for row in grey]
        edges = [y * len(halves) // 32 for y in range(33)]
        grid = [[sum(halves[j][x] for j in range(edges[y], max(edges[y + 1], edges[y] + 1))) / max(edges[y + 1] - edges[y], 1) for x in range(32)] for y in range(32)]
        cos = lambda u, v: math.sqrt((1 if u == 0 else 2) / 32) * math.cos(math.pi * (2 * v + 1) * u / 64)
        rows = [[sum(grid[y][x] * cos(u, x) for x in range(32)) for u in range(8)] for y in range(32)]
        low = [round(sum(rows[y][u] * cos(v, y) for y in range(32)), 6) for v in range(8) for u in range(8)]
        middle = sorted(low[1:])[31]
        bits = sum((x > middle) << (63 - i) for i, x in enumerate(low))
        assert bin(int(r.feature, 16) ^ bits).count("1") <= 1  # rounding may turn a bit that is at the middle
