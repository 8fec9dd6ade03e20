"""Pictures as bytes: PNG in numpy and zlib, other formats by Pillow where it is installed."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

try:
    from PIL import Image
except ImportError:
    Image = None

MAGIC = b"\x89PNG\r\n\x1a\n"


def png(image: np.ndarray) -> bytes:
    """A PNG of a height x width grey or height x width x 3 RGB picture of bytes."""
    height, width = image.shape[:2]
    lines = np.hstack([np.zeros((height, 1), np.uint8), image.reshape(height, -1)])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _chunks(data: bytes) -> dict[bytes, bytes]:
    out, at = {}, len(MAGIC)
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        out[kind] = out.get(kind, b"") + data[at + 8 : at + 8 + n]
        at += n + 12
    return out


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of samples from rows that start with the number of their filter; step is the bytes of a pixel."""
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(lines):
        kind, row = line[0], line[1:].copy()
        if kind == 1:
            row = row.reshape(-1, step).cumsum(axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            for x in range(len(row)):
                a, b, c = (int(v) for v in (row[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0))
                guess = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v: abs(a + b - c - v))
                row[x] = (int(row[x]) + guess) & 255
        out[y] = above = row
    return out


def decoded(data: bytes) -> np.ndarray:
    """height x width (grey) or height x width x 3 (RGB) bytes of an encoded picture."""
    if data.startswith(MAGIC):
        chunks = _chunks(data)
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        if depth == 8 and colour in (0, 2) and not interlaced:
            step = 3 if colour == 2 else 1
            lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, 1 + width * step)
            return _unfiltered(lines, step).reshape((height, width, 3) if colour == 2 else (height, width))
    if Image is None:
        raise ValueError("only 8-bit grey and RGB PNG pictures are decoded here; install Pillow for other formats")
    picture = Image.open(io.BytesIO(data))
    return np.asarray(picture if picture.mode in ("L", "RGB") else picture.convert("RGB"))
