"""Media columns: payloads stored as PNG images and read back with checks.

Writing packs bytes as 8-bit grey samples, 192 to a row, filters each row with the cheaper of None,
Sub and Up, and deflates. Reading walks the chunks, tests every checksum and length, inflates, and
undoes all five filter types in numpy. The feature is a 64-bit hash of low-frequency cosine
coefficients of the image, reduced to 32 x 32.

Edge cases: null and empty texts are one row of blanks; equal texts give equal bytes and features;
extra columns are ignored; a null id passes through; damaged images raise ``ValueError`` in
``read_png`` and give a null payload with the reason in ``media_features``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide.llm.common import map_columns, texts

WIDTH = 192
#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(payload: bytes, unit: int = WIDTH) -> bytes:
    """The payload followed by blanks up to a positive multiple of ``unit`` bytes."""
    return payload + b" " * (max(unit, -(-len(payload) // unit) * unit) - len(payload))


def write_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """8-bit greyscale PNG of the payload, whose length is a positive multiple of ``width``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    options = np.stack([rows, sub, up])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    data = np.empty((len(rows), width + 1), np.uint8)
    data[:, 0] = kind
    data[:, 1:] = options[kind, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(data.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(data: np.ndarray, channels: int) -> np.ndarray:
    """Undo the row filters; rows that refer to nothing or to themselves need no loop over samples."""
    kinds, rows = data[:, 0], data[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise ValueError(f"unknown filter type {int(kinds.max())}")
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        row = rows[y]
        if kind == SUB:
            row[:] = np.add.accumulate(row.reshape(-1, channels), axis=0, dtype=np.uint8).ravel()
        elif kind == UP:
            row += above
        elif kind in (AVERAGE, PAETH):
            up = above.astype(np.int32).reshape(-1, channels)
            cur = row.astype(np.int32).reshape(-1, channels)
            left = corner = np.zeros(channels, np.int32)
            for x in range(len(cur)):
                if kind == AVERAGE:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
                left = cur[x] = (cur[x] + guess) & 255
                corner = up[x]
            row[:] = cur.astype(np.uint8).ravel()
        above = row
    return rows


def read_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit PNG (grey, RGB, or either with alpha) as rows x columns x channels."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, packed, ended = 8, None, [], False
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("chunk cut short")
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media):
            raise ValueError("chunk cut short")
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of chunk {kind.decode('latin-1')}")
        at += 12 + size
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("header of a wrong length")
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 0x20:
            raise ValueError(f"unknown critical chunk {kind.decode('latin-1')}")
    if header is None or not ended:
        raise ValueError("header or end is missing")
    width, height, depth, colour, _, _, interlace = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit images that are not interlaced")
    if not width or not height:
        raise ValueError("an image without rows or columns")
    data = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(data) != height * (width * channels + 1):
        raise ValueError("wrong amount of image data")
    return _unfilter(data.reshape(height, width * channels + 1), channels).reshape(height, width, channels)


def cosine_basis(n: int = 32, low: int = 8) -> np.ndarray:
    """The first ``low`` vectors of the cosine transform of length ``n``."""
    return np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(low)[:, None] / (2 * n))


def cosine_hash(samples: np.ndarray, size: int = 32, low: int = 8) -> str:
    """64 bits: which low-frequency coefficients of the reduced grey image exceed their median."""
    grey = samples.mean(axis=2)

    def reduce(a: np.ndarray) -> np.ndarray:
        if len(a) < size:
            return a[np.arange(size) * len(a) // size]
        edges = np.arange(size + 1) * len(a) // size
        return np.add.reduceat(a, edges[:-1], axis=0) / np.diff(edges)[:, None]

    small = reduce(reduce(grey).T).T
    basis = cosine_basis(size, low)
    c = np.round(basis @ small @ basis.T, 6).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes().hex()


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a PNG in a binary column."""

    def make():
        def step(ids, text):
            raw = [t.encode("utf-8", "surrogatepass") for t in text]
            return [ids, [len(r) for r in raw], [write_png(padded(r)) for r in raw]]

        return step

    return map_columns(texts(docs), make, "doc_id long, n_bytes long, media binary", chunk=64)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored images hold, from reading them back."""

    def make():
        def step(ids, n_bytes, media):
            out = [[] for _ in range(9)]
            for i, n, m in zip(ids, n_bytes, media):
                try:
                    if m is None:
                        raise ValueError("no media")
                    samples = read_png(m)
                    p, error = samples.tobytes(), None
                    got = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
                    feature = cosine_hash(samples)
                except (ValueError, zlib.error) as e:
                    got, feature, error = (None, None, None), None, str(e)
                stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                row = (i, n, *got, *stored, feature, error)
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return step

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, error string"
    )
    return map_columns(media.select("doc_id", "n_bytes", "media"), make, schema, chunk=64)
