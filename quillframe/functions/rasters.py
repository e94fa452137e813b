"""Pixels of BMP, GIF (first frame) and TIFF images, as rows x columns x channels of 8 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .images import MAX_PIXELS, PNG_MARK, decode_png
from .pdf import lzw, run_length


def decode(data: bytes) -> np.ndarray:
    """Pixels by the format that the first bytes tell; ValueError for what is damaged or not supported."""
    try:
        if data.startswith(PNG_MARK):
            return decode_png(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return decode_gif(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return decode_tiff(data)
    except (struct.error, IndexError, KeyError, TypeError, zlib.error) as e:
        raise ValueError("damaged image") from e
    raise ValueError("no image that can be decoded")


def _sized(w: int, h: int) -> None:
    if w <= 0 or h <= 0 or w * h > MAX_PIXELS:
        raise ValueError("an image of no allowed size")


def _samples(lines: np.ndarray, depth: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits, high bits first."""
    if depth == 8:
        return lines
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
    return (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack("<II", data[10:18])
    if head == 12:
        w, h, _, depth = struct.unpack("<HHHH", data[18:26])
        packing, colours, size = 0, 0, 3
    else:
        w, h, _, depth, packing, _, _, _, colours = struct.unpack("<iiHHIIiiI", data[18:50])
        size = 4
    down, h = h < 0, abs(h)
    _sized(w, h)
    if depth <= 8:
        count = colours or 1 << depth
        table = np.frombuffer(data[14 + head : 14 + head + count * size].ljust(256 * size, b"\0")[: 256 * size], np.uint8).reshape(-1, size)[:, 2::-1]
        if packing == 1 and depth == 8:
            index = _bmp_runs(data[start:], w, h)
        elif packing == 0:
            stride = (w * depth + 31) // 32 * 4
            index = _samples(np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride), depth)[:, :w]
        else:
            raise ValueError("a BMP of a kind that is not supported")
        pixels = table[index]
    elif depth == 24 and packing == 0:
        stride = (w * 3 + 3) // 4 * 4
        pixels = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)[:, : w * 3].reshape(h, w, 3)[:, :, ::-1]
    elif depth in (16, 32) and packing in (0, 3):
        stride = (w * depth + 31) // 32 * 4
        words = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)[:, : w * depth // 8].copy().view("<u2" if depth == 16 else "<u4").astype(np.uint32)
        masks = struct.unpack("<III", data[54:66]) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if depth == 16 else (0xFF0000, 0xFF00, 0xFF)
        if not all(masks):
            raise ValueError("damaged image")
        low = [(m & -m).bit_length() - 1 for m in masks]
        pixels = np.stack([((words & m) >> s) * 255 // (m >> s) for m, s in zip(masks, low, strict=True)], axis=2)
    else:
        raise ValueError("a BMP of a kind that is not supported")
    return np.ascontiguousarray(pixels if down else pixels[::-1]).astype(np.uint8)


def _bmp_runs(data: bytes, w: int, h: int) -> np.ndarray:
    out = np.zeros((h, w), np.uint8)
    x = y = at = 0
    while at + 1 < len(data) and y < h:
        n, value = data[at], data[at + 1]
        at += 2
        if n:
            out[y, x : x + n] = value
            x += n
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            break
        elif value == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            row = np.frombuffer(data[at : at + value], np.uint8)[: max(0, w - x)]
            out[y, x : x + len(row)] = row
            x, at = x + value, at + value + value % 2
    return out


def decode_gif(data: bytes) -> np.ndarray:
    """The first frame on its screen, RGBA: what it does not cover is clear."""
    w, h, flags = struct.unpack("<HHB", data[6:11])
    _sized(w, h)
    at = 13
    palette = None
    if flags & 0x80:
        palette = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
        at += palette.size
    clear = None
    while True:
        mark = data[at]
        at += 1
        if mark == 0x21:
            if data[at] == 0xF9 and data[at + 2] & 1:
                clear = data[at + 5]
            at += 1
            while data[at]:
                at += 1 + data[at]
            at += 1
        elif mark == 0x2C:
            x, y, fw, fh, own = struct.unpack("<HHHHB", data[at : at + 9])
            at += 9
            if own & 0x80:
                palette = np.frombuffer(data, np.uint8, 3 << (own & 7) + 1, at).reshape(-1, 3)
                at += palette.size
            bits, body = data[at], bytearray()
            at += 1
            while at < len(data) and data[at]:
                body += data[at + 1 : at + 1 + data[at]]
                at += 1 + data[at]
            _sized(fw, fh)
            index = np.frombuffer(_gif_codes(bytes(body), bits, fw * fh).ljust(fw * fh, b"\0"), np.uint8).reshape(fh, fw)
            if own & 0x40:
                order = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            if palette is None:
                raise ValueError("a GIF without colours")
            colours = np.concatenate([palette, np.zeros((256 - len(palette), 3), np.uint8)])
            out = np.zeros((h, w, 4), np.uint8)
            part = index[: max(0, h - y), : max(0, w - x)]
            out[y : y + part.shape[0], x : x + part.shape[1], :3] = colours[part]
            out[y : y + part.shape[0], x : x + part.shape[1], 3] = 255 if clear is None else np.where(part == clear, 0, 255)
            return out
        else:
            raise ValueError("a GIF without a frame")


def _gif_codes(data: bytes, bits: int, most: int) -> bytes:
    """Codes with low bits first, as GIF packs them."""
    if not 1 <= bits <= 8:
        raise ValueError("damaged image")
    stop = (1 << bits) + 1
    table: list[bytes] = [bytes([i]) for i in range(1 << bits)] + [b"", b""]
    out, width, last, held, n = bytearray(), bits + 1, b"", 0, 0
    for byte in data:
        held |= byte << n
        n += 8
        while n >= width:
            code = held & (1 << width) - 1
            held >>= width
            n -= width
            if code == stop - 1:
                table, width, last = table[: stop + 1], bits + 1, b""
                continue
            if code == stop or code > len(table):
                return bytes(out)
            if code == len(table) and not last:
                return bytes(out)
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if len(out) >= most:
                return bytes(out[:most])
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return bytes(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """The first page: grey, RGB(A) or palette in strips, plain, PackBits, LZW or deflated, with or without the difference predictor."""
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    tags: dict[int, list[int]] = {}
    for k in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        letter, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, (None, 0))
        if letter is None:
            continue
        place = at + 10 + 12 * k if count * size <= 4 else struct.unpack(e + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        tags[tag] = list(struct.unpack(f"{e}{count}{letter}", data[place : place + count * size]))
    one = lambda t, d: tags.get(t, [d])[0]
    w, h, depth, packing, photo, channels = one(256, 0), one(257, 0), one(258, 1), one(259, 1), one(262, 1), one(277, 1)
    _sized(w, h)
    if 322 in tags or one(284, 1) != 1 or depth not in (1, 2, 4, 8, 16) or any(d != depth for d in tags.get(258, [])):
        raise ValueError("a TIFF of a kind that is not supported")
    unpack = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: run_length}.get(packing)
    if unpack is None or photo not in (0, 1, 2, 3):
        raise ValueError("a TIFF of a kind that is not supported")
    rows, stride = one(278, h), (w * channels * depth + 7) // 8
    raw = b"".join(unpack(data[p : p + n])[: min(rows, h - k * rows) * stride].ljust(min(rows, h - k * rows) * stride, b"\0") for k, (p, n) in enumerate(zip(tags[273], tags[279], strict=True)))
    lines = np.frombuffer(raw[: h * stride], np.uint8).reshape(h, stride)
    if depth == 16:
        samples = lines.copy().view(e + "u2").reshape(h, w, channels)
    else:
        samples = _samples(lines, depth)[:, : w * channels].reshape(h, w, channels)
    if one(317, 1) == 2:
        samples = np.cumsum(samples, axis=1, dtype=samples.dtype)
    if photo == 3:
        table = (np.array(tags[320]).reshape(3, -1).T >> 8).astype(np.uint8)
        return table[samples[:, :, 0]]
    full = (samples >> 8).astype(np.uint8) if depth == 16 else samples * np.uint8(255 // ((1 << depth) - 1))
    return 255 - full if photo == 0 else full
