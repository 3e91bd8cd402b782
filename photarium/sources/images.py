"""Decoding images without an image library: Netpbm (P2, P3, P5, P6) and uncompressed BMP of 8, 24 or 32 bits; and their features."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Weights of the channels, as in functions.colour.
from photarium.functions.colour import GRAY


class Undecodable(ValueError):
    """No image of a known kind."""


def decode(raw: bytes) -> tuple[np.ndarray, str]:
    """(height x width x 3 array of bytes, pixel format)."""
    if raw[:2] in (b"P2", b"P3", b"P5", b"P6"):
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise Undecodable("unknown kind of file")


_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _netpbm(raw: bytes) -> tuple[np.ndarray, str]:
    at, numbers = 2, []
    for _ in range(3):
        m = _TOKEN.match(raw, at)
        if not m or not m[1].isdigit():
            raise Undecodable("header")
        numbers.append(int(m[1]))
        at = m.end()
    w, h, top = numbers
    n = w * h * (3 if raw[1:2] in b"36" else 1)
    if not n or not 0 < top < 65536:
        raise Undecodable("size")
    if raw[1:2] in b"56":
        wide = 2 if top > 255 else 1
        body = raw[at + 1 : at + 1 + n * wide]
        if len(body) < n * wide:
            raise Undecodable("file ends early")
        values = np.frombuffer(body, ">u2" if wide == 2 else np.uint8).astype(np.float64)
    else:
        parts = re.sub(rb"#[^\n]*", b"", raw[at:]).split()[:n]
        if len(parts) < n:
            raise Undecodable("file ends early")
        values = np.array(parts, np.float64)
    pixels = np.floor(values * 255 / top + 0.5).astype(np.uint8)
    colour = raw[1:2] in b"36"
    return pixels.reshape(h, w, 3) if colour else np.repeat(pixels.reshape(h, w, 1), 3, axis=2), "24bppRGB" if colour else "8bppGray"


def _bmp(raw: bytes) -> tuple[np.ndarray, str]:
    if len(raw) < 54:
        raise Undecodable("header")
    offset, = struct.unpack_from("<I", raw, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32) or w < 1 or h == 0:
        raise Undecodable("kind of bitmap")
    row = (w * bits + 31) // 32 * 4
    if len(raw) < offset + row * abs(h):
        raise Undecodable("file ends early")
    rows = np.frombuffer(raw, np.uint8, row * abs(h), offset).reshape(abs(h), row)[:, : w * bits // 8]
    if bits == 8:
        palette = np.frombuffer(raw, np.uint8, offset - 14 - size, 14 + size)
        palette = np.resize(palette[: len(palette) // 4 * 4].reshape(-1, 4), (256, 4))
        pixels = palette[rows][:, :, 2::-1]
    else:
        pixels = rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return (pixels[::-1] if h > 0 else pixels).copy(), {8: "8bppIndexed", 24: "24bppRGB", 32: "32bppARGB"}[bits]


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 of a gray or P6 of a colour array."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def to_gray(pixels: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(pixels @ np.array(GRAY) + 0.5), 0, 255).astype(np.uint8)


def resize(gray: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area mean, each output pixel over the input it covers."""

    def axis(n: int, m: int) -> np.ndarray:
        cover = np.zeros((m, n))
        for k in range(m):
            a, b = k * n / m, (k + 1) * n / m
            for i in range(int(a), min(n, int(np.ceil(b)))):
                cover[k, i] = min(b, i + 1) - max(a, i)
        return cover / cover.sum(axis=1, keepdims=True)

    return np.floor(axis(gray.shape[0], h) @ gray.astype(float) @ axis(gray.shape[1], w).T + 0.5).astype(np.uint8)


FEATURES = (
    "path string, decoded boolean, imgwidth int, imgheight int, imgframes int, imgpixfmt string, levels array<long>, "
    "small binary, big binary, smallH binary, bigH binary"
)


def features(files: DataFrame, mirrored: bool = True) -> DataFrame:
    """files(path, content) to one row each: properties, gray histogram and fingerprints of 9 x 8 and 32 x 32, plain and mirrored.

    A file of under 3 bytes or of an unknown kind is not decoded: nothing but its path comes back.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"]):
                try:
                    if not path or raw is None or len(raw) < 3:
                        raise Undecodable("empty")
                    pixels, kind = decode(bytes(raw))
                except Undecodable:
                    rows.append((path, False, *[None] * 9))
                    continue
                gray = to_gray(pixels)
                prints = [resize(g, w, h).tobytes() for g in ((gray, gray[:, ::-1]) if mirrored else (gray,)) for w, h in ((9, 8), (32, 32))]
                levels = np.bincount(gray.ravel(), minlength=256).tolist()
                rows.append((path, True, gray.shape[1], gray.shape[0], 1, kind, levels, *prints, *[None] * (4 - len(prints))))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return files.select("path", "content").mapInPandas(of, FEATURES)
