"""PNG pictures to arrays with numpy: inflate, then the five row filters undone along diagonals.

A filtered byte depends on the bytes to the left, above, and above left. All pixels of one diagonal are free of each other once
the diagonals before are known, so a picture takes height + width steps of whole-array arithmetic, whatever filters its rows use.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: samples in a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def unfiltered(rows: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """rows: (height, width, bytes of a pixel) of filtered bytes; filters: one of 0 to 4 for each row."""
    height, width, depth = rows.shape
    if (filters <= 2).all() and not (filters == 1).any():  # none and up only: sums down the columns
        out, above = np.empty_like(rows), np.zeros((width, depth), np.uint8)
        for y in range(height):
            above = rows[y] + above if filters[y] else rows[y]
            out[y] = above
        return out
    out = np.zeros((height + 1, width + 1, depth), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        far = [np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)]
        nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        kind = filters[y][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, nearest], 0)
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def png_size(content: bytes) -> tuple[int, int]:
    """(height, width) as the header says."""
    if content[:8] != SIGNATURE or len(content) < 33:
        raise ValueError("no PNG header")
    width, height = struct.unpack(">II", content[16:24])
    return height, width


def decoded_png(content: bytes, most: int = 1 << 28) -> np.ndarray:
    """(height, width, 1), BGR or BGRA in 8 bits: grey, true colour and palettes of all depths; of 16 bits the higher 8 count. An
    interlaced picture, a damaged one, or one of more than `most` samples raises ValueError."""
    height, width = png_size(content)
    depth, colour, _, _, interlaced = content[24:29]
    if interlaced or colour not in SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise ValueError("an interlaced or unknown kind of PNG")
    samples = SAMPLES[colour]
    if not height or not width or height * width * samples > most:
        raise ValueError(f"{height} x {width} pixels")
    at, body, palette, clear = 8, [], None, b""
    while at + 12 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        if kind == b"IDAT":
            body.append(data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = data
        elif kind == b"IEND":
            break
        at += 12 + size
    line, unit = (width * samples * depth + 7) // 8, max(1, samples * depth // 8)
    inflater = zlib.decompressobj()
    try:
        flat = inflater.decompress(b"".join(body), height * (line + 1))
    except zlib.error as e:
        raise ValueError(f"damaged PNG: {e}") from e
    if len(flat) < height * (line + 1):
        raise ValueError("the picture ends early")
    rows = np.frombuffer(flat, np.uint8, height * (line + 1)).reshape(height, line + 1)
    if rows[:, 0].max() > 4:
        raise ValueError("unknown row filter")
    raw = unfiltered(rows[:, 1:].reshape(height, -1, unit), rows[:, 0]).reshape(height, line)
    if depth == 16:
        raw = raw[:, ::2]
    elif depth < 8:
        raw = np.unpackbits(raw, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth)[::-1])
        raw = raw[:, : width * samples].astype(np.uint8)
        if colour == 0:
            raw = raw * np.uint8(255 // ((1 << depth) - 1))
    pixels = raw.reshape(height, width, samples)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("a colour outside the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        table = np.hstack([palette[:, ::-1], alpha[:, None]]) if clear else palette[:, ::-1]
        return table[pixels[:, :, 0]]
    if colour == 4:
        return np.concatenate([np.repeat(pixels[:, :, :1], 3, axis=2), pixels[:, :, 1:]], axis=2)
    return pixels if colour == 0 else pixels[:, :, [2, 1, 0, 3][:samples]]
