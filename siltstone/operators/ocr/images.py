"""Pixels of images: portable any-maps and PNG, decoded by rows; others need a decoder of one's own."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

#: Pixels of the largest image that is decoded.
MOST = 64 << 20
#: Channels of each PNG colour type; start and step (x, y) of each pass of interlacing.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def read_pgm(data: bytes) -> np.ndarray:
    """A grey or colour image of the portable any-map formats P5 and P6."""
    stream = io.BytesIO(data)
    head: list[bytes] = []
    while len(head) < 4:
        line = stream.readline()
        if not line:
            raise ValueError("the image ends in its header")
        head += line.split(b"#")[0].split()
    kind, w, h, most = head[0], int(head[1]), int(head[2]), int(head[3])
    if kind not in (b"P5", b"P6") or most > 255:
        raise ValueError("neither P5 nor P6 of eight bits")
    shape = (h, w) if kind == b"P5" else (h, w, 3)
    body = stream.read(int(np.prod(shape)))
    if len(body) < np.prod(shape):
        raise ValueError("the image is cut off")
    return np.frombuffer(body, np.uint8).reshape(shape)


def pgm(img: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (img.shape[1], img.shape[0]) + img.astype(np.uint8).tobytes()


def _row(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row without its filter; ``step`` bytes make a pixel."""
    if kind == 0:
        return row
    if kind == 1:
        wide = np.zeros(-(-len(row) // step) * step, np.uint8)
        wide[: len(row)] = row
        return np.add.accumulate(wide.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
    if kind == 2:
        return row + above
    out = bytearray(len(row))
    up, raw = above.tolist(), row.tolist()
    for i, x in enumerate(raw):
        a = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (a + up[i]) // 2
        elif kind == 4:
            b, c = up[i], up[i - step] if i >= step else 0
            near = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else c
        else:
            raise ValueError(f"unknown row filter {kind}")
        out[i] = (x + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def _pass(body: bytes, at: int, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """(samples as height x width x channels, where the next pass begins)."""
    size, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    if at + height * (size + 1) > len(body):
        raise ValueError("the image data are cut off")
    rows, above = [], np.zeros(size, np.uint8)
    for y in range(height):
        start = at + y * (size + 1)
        above = _row(body[start], np.frombuffer(body, np.uint8, size, start + 1), above, step)
        rows.append(above)
    raw = np.stack(rows) if rows else np.zeros((0, size), np.uint8)
    if depth == 16:
        raw = raw[:, ::2]  # the upper byte of each sample
    elif depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(height, -1, depth)
        raw = np.packbits(bits, axis=2, bitorder="big").reshape(height, -1) >> (8 - depth)
        raw = raw[:, : width * channels]
    return raw.reshape(height, width, channels), at + height * (size + 1)


def read_png(data: bytes) -> np.ndarray:
    """Grey (height x width) or RGB (height x width x 3) of eight bits. What is transparent is white; ancillary chunks and checksums aren't looked at."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n") or data[12:16] != b"IHDR" or len(data) < 33:
        raise ValueError("no PNG header")
    width, height, depth, color, packing, _, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    if color not in CHANNELS or depth not in (1, 2, 4, 8, 16) or packing or interlaced > 1:
        raise ValueError("a PNG of an unknown kind")
    if not 0 < width * height <= MOST:
        raise ValueError(f"{width} x {height} pixels")
    at, parts, palette, clear = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IDAT":
            parts.append(chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk[: n // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(chunk, np.uint8)
        elif kind == b"IEND":
            break
        at += 12 + n
    channels = CHANNELS[color]
    body = zlib.decompressobj().decompress(b"".join(parts), (width * channels * 2 + 2) * height + 64)
    if interlaced:
        out, at = np.zeros((height, width, channels), np.uint8), 0
        for x, y, dx, dy in PASSES:
            w, h = len(range(x, width, dx)), len(range(y, height, dy))
            if w and h:
                out[y::dy, x::dx], at = _pass(body, at, w, h, depth, channels)
    else:
        out, _ = _pass(body, 0, width, height, depth, channels)
    if color == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("a colour that isn't in the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = clear[: len(alpha)]
        return _on_white(palette[out[:, :, 0]], alpha[out[:, :, 0]])
    if depth < 8:
        out = out * (255 // ((1 << depth) - 1))
    if color in (4, 6):
        return _on_white(out[:, :, :-1], out[:, :, -1]) if color == 6 else _on_white(out[:, :, :1], out[:, :, 1])[:, :, 0]
    return out if color == 2 else out[:, :, 0]


def _on_white(pixels: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    a = alpha[:, :, None].astype(np.uint16)
    return ((pixels * a + 255 * (255 - a)) // 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Pixels of an image by its first bytes."""
    if data.startswith(b"\x89PNG"):
        return read_png(data)
    if data[:2] in (b"P5", b"P6"):
        return read_pgm(data)
    raise ValueError("no decoder for this kind of image")
