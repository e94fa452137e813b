"""Raster images: headers of six formats, PNG and BMP codecs, scaling and comparison, with numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAX_PIXELS = 1 << 28
PNG_MARK = b"\x89PNG\r\n\x1a\n"


def identify(data: bytes) -> tuple[str, int, int, float | None, float | None] | None:
    """(format, width, height, dpi x, dpi y) from a header; None for anything else."""
    try:
        if data.startswith(PNG_MARK):
            w, h = struct.unpack(">II", data[16:24])
            at = data.find(b"pHYs", 0, 1 << 16)
            if at > 0 and data[at + 12] == 1:
                return "png", w, h, *(round(k * 0.0254, 2) for k in struct.unpack(">II", data[at + 4 : at + 12]))
            return "png", w, h, None, None
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", data[6:10]), None, None
        if data[:2] == b"BM":
            if struct.unpack("<I", data[14:18])[0] == 12:
                return "bmp", *struct.unpack("<HH", data[18:22]), None, None
            w, h, _, _, _, _, x, y = struct.unpack("<iiHHIIii", data[18:46])
            return "bmp", w, abs(h), *(round(k * 0.0254, 2) if k > 0 else None for k in (x, y))
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
    except (struct.error, IndexError):
        pass
    return None


def _jpeg(data: bytes):
    at, dpi = 2, (None, None)
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE0 and data[at + 4 : at + 9] == b"JFIF\0":
            unit, x, y = struct.unpack(">BHH", data[at + 11 : at + 16])
            dpi = (float(x), float(y)) if unit == 1 else (round(x * 2.54, 2), round(y * 2.54, 2)) if unit == 2 else dpi
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return "jpeg", w, h, *dpi
        at += 2 + size
    return None


def _tiff(data: bytes):
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, count, value = struct.unpack(e + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if kind == 5:
            p = struct.unpack(e + "I", value)[0]
            a, b = struct.unpack(e + "II", data[p : p + 8])
            tags[tag] = a / b if b else 0.0
        elif kind in (3, 4) and count == 1:
            tags[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    if 256 not in tags or 257 not in tags:
        return None
    scale = {2: 1.0, 3: 2.54}.get(tags.get(296, 2))
    dpi = [round(tags[t] * scale, 2) if scale and t in tags else None for t in (282, 283)]
    return "tiff", tags[256], tags[257], *dpi


def _webp(data: bytes):
    kind = data[12:16]
    if kind == b"VP8X":
        return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), None, None
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), None, None
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return "webp", w & 0x3FFF, h & 0x3FFF, None, None
    return None


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of rows x columns x 1 to 4 bytes (grey, grey and alpha, RGB, RGBA)."""
    h, w, channels = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Rows x columns x channels of 8 bits; all colour types and depths, interlaced or not; checksums are checked."""
    at, body, palette, clear, head = 8, b"", None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[0] * head[1] > MAX_PIXELS:
        raise ValueError("no PNG")
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    out = np.zeros((h, w, channels), np.uint16)
    used = 0
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlace else [(0, 0, 1, 1)]
    for x0, y0, dx, dy in passes:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        stride, step = (pw * channels * depth + 7) // 8, max(1, channels * depth // 8)
        lines = _unfiltered(raw[used : used + ph * (stride + 1)].reshape(ph, stride + 1), step)
        used += ph * (stride + 1)
        if depth == 16:
            samples = lines.reshape(ph, -1, 2)[:, :, 0].astype(np.uint16)
        elif depth == 8:
            samples = lines.astype(np.uint16)
        else:
            bits = np.unpackbits(lines, axis=1).reshape(ph, -1, depth)
            samples = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint16)
        out[y0::dy, x0::dx] = samples[:, : pw * channels].reshape(ph, pw, channels)
    if colour == 3:
        rgb = palette[out[:, :, 0]]
        if clear is None:
            return rgb.astype(np.uint8)
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([rgb, alpha[out[:, :, :1]]], axis=2).astype(np.uint8)
    return (out * (255 // ((1 << depth) - 1)) if depth < 8 else out).astype(np.uint8)


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    before = np.zeros(lines.shape[1] - 1, np.int32)
    for k, line in enumerate(lines):
        kind, row = line[0], line[1:].astype(np.int32)
        if kind == 2:
            row = (row + before) & 255
        elif kind == 1:
            for s in range(step):
                row[s::step] = np.cumsum(row[s::step]) & 255
        elif kind in (3, 4):
            for i in range(len(row)):
                a, b = (row[i - step] if i >= step else 0), before[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = before[i - step] if i >= step else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i] = (row[i] + guess) & 255
        out[k], before = row, row
    return out


def scaled_size(w: int, h: int, most: int) -> tuple[int, int]:
    """Size with the longer side at ``most``; never larger than before."""
    if max(w, h) <= most:
        return w, h
    return max(1, round(w * most / max(w, h))), max(1, round(h * most / max(w, h)))


def scale(pixels: np.ndarray, most: int) -> np.ndarray:
    """Box-filtered to a longer side of ``most``."""
    h, w, channels = pixels.shape
    tw, th = scaled_size(w, h, most)
    if (tw, th) == (w, h):
        return pixels
    sums = np.zeros((h + 1, w + 1, channels))
    sums[1:, 1:] = pixels.astype(np.float64).cumsum(axis=0).cumsum(axis=1)
    ys, xs = np.arange(th + 1) * h // th, np.arange(tw + 1) * w // tw
    box = sums[ys[1:]][:, xs[1:]] - sums[ys[:-1]][:, xs[1:]] - sums[ys[1:]][:, xs[:-1]] + sums[ys[:-1]][:, xs[:-1]]
    return np.floor(box / ((ys[1:] - ys[:-1])[:, None, None] * (xs[1:] - xs[:-1])[None, :, None]) + 0.5).astype(np.uint8)


def luma(pixels: np.ndarray) -> np.ndarray:
    p = pixels.astype(np.int64)
    return p[:, :, 0] if p.shape[2] < 3 else (299 * p[:, :, 0] + 587 * p[:, :, 1] + 114 * p[:, :, 2] + 500) // 1000


def compare(a: np.ndarray, b: np.ndarray, threshold: int = 32, radius: int = 1) -> tuple[int, int, float]:
    """(differing pixels, common pixels, share): a pixel differs if no neighbour within the radius of the other image is near in every channel."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    x, y = a[:h, :w].astype(np.int16), b[:h, :w].astype(np.int16)

    def unmatched(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        near = np.zeros((h, w), bool)
        padded = np.pad(q, ((radius, radius), (radius, radius), (0, 0)), mode="edge")
        for dy in range(2 * radius + 1):
            for dx in range(2 * radius + 1):
                near |= (np.abs(p - padded[dy : dy + h, dx : dx + w]) <= threshold).all(axis=2)
        return ~near

    n = int((unmatched(x, y) | unmatched(y, x)).sum())
    return n, h * w, n / (h * w) if h * w else 0.0
