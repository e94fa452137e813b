"""Decryption of PDF files by the standard handler: RC4 of 40 to 128 bits, AES of 128 and 256, user or owner password.

AES decryption runs over all blocks of a stream at once; encryption, which only the password check of
256-bit files needs, goes block by block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from hashlib import md5, sha256, sha384, sha512

import numpy as np

# What pads a password to 32 bytes.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = byte ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


@cache
def _field() -> tuple[list[int], list[list[int]]]:
    """The S-box and the products of each byte with 0 to 15 in the field of AES, by rule."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a = a << 1 ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out

    power, log = [1] * 256, [0] * 256
    for k in range(1, 255):
        power[k] = times(power[k - 1], 3)
        log[power[k]] = k
    box = []
    for x in range(256):
        v = power[(255 - log[x]) % 255] if x else 0
        box.append(0x63 ^ v ^ (v << 1 | v >> 7) & 255 ^ (v << 2 | v >> 6) & 255 ^ (v << 3 | v >> 5) & 255 ^ (v << 4 | v >> 4) & 255)
    return box, [[times(x, k) for x in range(256)] for k in range(16)]


def _round_keys(key: bytes) -> list[bytes]:
    box, products = _field()
    n = len(key) // 4
    words = [key[4 * k : 4 * k + 4] for k in range(n)]
    constant = 1
    for k in range(n, 4 * (n + 7)):
        w = words[-1]
        if k % n == 0:
            w = bytes([box[w[1]] ^ constant, box[w[2]], box[w[3]], box[w[0]]])
            constant = products[2][constant]
        elif n > 6 and k % n == 4:
            w = bytes(box[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(w, words[k - n], strict=True)))
    return [b"".join(words[k : k + 4]) for k in range(0, len(words), 4)]


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC of whole blocks, without padding."""
    box, products = _field()
    keys, out, last = _round_keys(key), bytearray(), iv
    two, three = products[2], products[3]
    shifted = [(5 * i) % 16 for i in range(16)]
    for at in range(0, len(data), 16):
        s = [a ^ b ^ c for a, b, c in zip(data[at : at + 16], last, keys[0], strict=True)]
        for k in keys[1:-1]:
            t = [box[s[i]] for i in shifted]
            s = []
            for c in (0, 4, 8, 12):
                a, b, d, e = t[c : c + 4]
                s += [two[a] ^ three[b] ^ d ^ e ^ k[c], a ^ two[b] ^ three[d] ^ e ^ k[c + 1], a ^ b ^ two[d] ^ three[e] ^ k[c + 2], three[a] ^ b ^ d ^ two[e] ^ k[c + 3]]
        last = bytes(box[s[i]] ^ k for i, k in zip(shifted, keys[-1], strict=True))
        out += last
    return bytes(out)


def aes_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC of whole blocks, without padding."""
    box, products = _field()
    back = np.empty(256, np.uint8)
    back[box] = np.arange(256)
    nine, eleven, thirteen, fourteen = (np.array(products[k], np.uint8) for k in (9, 11, 13, 14))
    keys = [np.frombuffer(k, np.uint8) for k in _round_keys(key)]
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    unshifted = [(13 * i) % 16 for i in range(16)]
    s = blocks ^ keys[-1]
    for k in reversed(keys[1:-1]):
        s = (back[s[:, unshifted]] ^ k).reshape(-1, 4, 4)
        a, b, c, d = (s[:, :, i] for i in range(4))
        s = np.stack([fourteen[x] ^ eleven[y] ^ thirteen[z] ^ nine[w] for x, y, z, w in ((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))], axis=2).reshape(-1, 16)
    s = back[s[:, unshifted]] ^ keys[0]
    return (s ^ np.concatenate([np.frombuffer(iv, np.uint8)[None], blocks[:-1]])).tobytes() if len(blocks) else b""


def _opened(key: bytes, data: bytes) -> bytes:
    """What AES with its vector in front and padding behind holds; a broken tail is left out."""
    body = data[16 : len(data) // 16 * 16]
    if not body:
        return b""
    plain = aes_decrypt(key, data[:16], body)
    return plain[: -plain[-1]] if 1 <= plain[-1] <= 16 else plain


def _hash_256(revision: int, password: bytes, salt: bytes, user: bytes) -> bytes:
    k = sha256(password + salt + user).digest()
    if revision < 6:
        return k
    n = 0
    while True:
        e = aes_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (sha256, sha384, sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


def _padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


def _key_128(entry: dict, ident: bytes, password: bytes, size: int, revision: int) -> bytes | None:
    def from_user(padded: bytes) -> bytes | None:
        plain = entry.get("EncryptMetadata") is False and revision >= 4
        key = md5(padded + entry["O"][:32] + (int(entry["P"]) & 0xFFFFFFFF).to_bytes(4, "little") + ident + (b"\xff" * 4 if plain else b"")).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = md5(key[:size]).digest()
        key = key[:size]
        if revision < 3:
            return key if rc4(key, PAD) == entry["U"][:32] else None
        check = md5(PAD + ident).digest()
        for k in range(20):
            check = rc4(bytes(b ^ k for b in key), check)
        return key if check == entry["U"][:16] else None

    found = from_user(_padded(password))
    if found is not None:
        return found
    owner = md5(_padded(password)).digest()
    for _ in range(50 if revision >= 3 else 0):
        owner = md5(owner[:size]).digest()
    user = entry["O"][:32]
    for k in range(19 if revision >= 3 else 0, -1, -1):
        user = rc4(bytes(b ^ k for b in owner[:size]), user)
    return from_user(user)


def _key_256(entry: dict, password: bytes, revision: int) -> bytes | None:
    u, o, password = entry["U"][:48], entry["O"][:48], password[:127]
    if _hash_256(revision, password, u[32:40], b"") == u[:32]:
        return aes_decrypt(_hash_256(revision, password, u[40:48], b""), bytes(16), entry["UE"][:32])
    if _hash_256(revision, password, o[32:40], u) == o[:32]:
        return aes_decrypt(_hash_256(revision, password, o[40:48], u), bytes(16), entry["OE"][:32])
    return None


def opener(entry: dict, ident: bytes, password: str = "") -> Callable[[int, int, bytes, bool], bytes]:
    """A function (object number, generation, data, is a stream) -> plain data; ValueError for a wrong password or another handler."""
    version, revision = int(entry.get("V") or 0), int(entry.get("R") or 0)
    if entry.get("Filter") != "Standard" or version not in (1, 2, 4, 5):
        raise ValueError("an encryption that is not supported")
    methods = ["V2", "V2"]
    if version >= 4:
        filters = entry.get("CF") or {}
        methods = [str((filters.get(entry.get(n, "Identity")) or {}).get("CFM", "None")) for n in ("StrF", "StmF")]
    if version == 5:
        key = _key_256(entry, password.encode(), revision)
    else:
        size = 5 if version == 1 else 16 if version == 4 else int(entry.get("Length") or 40) // 8
        key = _key_128(entry, ident, password.encode("latin-1", "replace"), size, revision)
    if key is None:
        raise ValueError("the password does not open the file")

    def plain(number: int, generation: int, data: bytes, stream: bool) -> bytes:
        method = methods[stream]
        if method == "None":
            return data
        if method == "AESV3":
            return _opened(key, data)
        own = md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(len(key) + 5, 16)]
        return _opened(own, data) if method == "AESV2" else rc4(own, data)

    return plain
