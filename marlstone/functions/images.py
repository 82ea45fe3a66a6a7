"""PNG files without an imaging library: what the engine writes, and plain files read back."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGN = b"\x89PNG\r\n\x1a\n"


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of an array [height, width] or [height, width, 3] of bytes."""
    h, w = pixels.shape[:2]
    color = 2 if pixels.ndim == 3 else 0
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGN + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray | None:
    """The array of a PNG file of 8 bits a channel, not interlaced, gray or RGB with or without alpha (which is dropped); None for others."""
    if data[:8] != _SIGN:
        return None
    at, packed, head = 8, b"", None
    try:
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                packed += body
            at += size + 12
        w, h, depth, color, _, _, interlaced = head
        channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
        if depth != 8 or channels is None or interlaced:
            return None
        lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * channels)
    except (struct.error, zlib.error, TypeError, ValueError):
        return None
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, channels)
    x = out.reshape(h, w, channels)
    return x[:, :, 0] if channels < 3 else x[:, :, :3]


def _unfiltered(how: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of pixels from its differences; filters 0 to 4 are those of the format."""
    if how == 0:
        return line
    if how == 2:
        return line + above
    if how == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out = line.astype(np.int64)
    up = above.astype(np.int64)
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        if how == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - step] if i >= step else 0
            near = [abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)]
            guess = (left, up[i], corner)[int(np.argmin(near))]
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)
