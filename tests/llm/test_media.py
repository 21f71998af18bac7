import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from roundtide.llm import media as m


def png(samples, kinds):
    """An encoder by the book for every filter type."""
    h, w, c = samples.shape
    out = bytearray()
    zero = np.zeros(w * c, int)
    above = zero
    for y in range(h):
        row = samples[y].ravel().astype(int)
        left = np.concatenate([np.zeros(c, int), row[:-c]])
        corner = np.concatenate([np.zeros(c, int), above[:-c]])
        p = left + above - corner
        a, b, d = abs(p - left), abs(p - above), abs(p - corner)
        guess = [zero, left, above, (left + above) // 2, np.where((a <= b) & (a <= d), left, np.where(b <= d, above, corner))][kinds[y]]
        out += bytes([kinds[y]]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    header = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    data = zlib.compress(bytes(out))
    return m.SIGNATURE + m._chunk(b"IHDR", header) + m._chunk(b"tEXt", b"k\0v") + m._chunk(b"IDAT", data[:9]) + m._chunk(b"IDAT", data[9:]) + m._chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_all_filters_are_undone(channels):
    samples = np.random.default_rng(channels).integers(0, 256, (25, 17, channels), dtype=np.uint8)
    assert (m.read_png(png(samples, [y % 5 for y in range(25)])) == samples).all()


def test_round_trip_and_damage():
    for n in (0, 1, 191, 192, 193, 5000):
        payload = random.Random(n).randbytes(n)
        stored = m.write_png(m.padded(payload))
        got = m.read_png(stored).tobytes()
        assert got[:n] == payload and set(got[n:]) <= {32} and len(got) % 192 == 0 and got
    for at in (3, 20, 45, len(stored) // 2, len(stored) - 5):
        broken = bytearray(stored)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            m.read_png(bytes(broken))
    for cut in (10, 40, len(stored) - 12):
        with pytest.raises(ValueError):
            m.read_png(stored[:cut])


def test_cosine_hash_is_the_transform_of_the_reduced_image():
    samples = np.random.default_rng(1).integers(0, 256, (64, 64, 1), dtype=np.uint8)
    small = samples[:, :, 0].reshape(32, 2, 32, 2).mean(axis=(1, 3))
    c = [[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    c = np.array(c).ravel()
    assert m.cosine_hash(samples) == np.packbits(c > np.median(c[1:])).tobytes().hex()
    assert m.cosine_hash(samples) == m.cosine_hash(samples.copy())


def test_query_on_odd_rows(odd_docs, empty_docs, odd_rows):
    got = m.media_features(m.as_media(odd_docs)).collect()
    assert len(got) == len(odd_rows)
    expected = {}
    for i, t in odd_rows:
        raw = (t or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        expected.setdefault(i, set()).add((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in expected[r["doc_id"]]
        assert r["error"] is None and len(r["feature"]) == 16
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (6, 7)}) == 1
    assert m.media_features(m.as_media(empty_docs)).count() == 0


def test_damaged_media_give_a_reason(spark):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def png(header, samples=b""):
        return m.SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(samples)) + chunk(b"IEND", b"")

    size = lambda w, h: struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    cases = {
        1: (b"no image", "not a PNG"), 2: (None, "no media"), 3: (b"", "not a PNG"), 4: (png(size(1, 1)[:9]), "header of a wrong length"),
        5: (png(size(0, 0)), "an image without rows or columns"), 6: (png(size(4, 0)), "an image without rows or columns"),
        7: (png(size(0, 2), b"\0\0"), "an image without rows or columns"), 8: (png(size(1, 1), b"\0"), "wrong amount of image data"), 9: (png(size(1, 1), b"\0a"), None),
    }
    rows = [(i, 3, None if x is None else bytearray(x)) for i, (x, _) in cases.items()]
    got = m.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    assert {r["doc_id"]: r["error"] for r in got} == {i: e for i, (_, e) in cases.items()}
    assert {r["doc_id"]: r["payload_bytes"] for r in got if r["payload_bytes"]} == {9: 1}
    assert {r["doc_id"] for r in got if r["media_bytes"] is None} == {2}
