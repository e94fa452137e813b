"""Encrypted PDF files: published vectors of the ciphers, and files encrypted here step by step."""

from hashlib import md5, sha256

import pytest

from quillframe.functions import pdf, pdf_edit
from quillframe.functions.pdf_crypt import PAD, _hash_256, aes_decrypt, aes_encrypt, rc4


def test_ciphers_by_published_vectors():
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, made in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(size))
        assert aes_encrypt(key, bytes(16), plain).hex() == made and aes_decrypt(key, bytes(16), bytes.fromhex(made)) == plain
    # Two blocks of chained mode, first and second of the published example.
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    text = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    made = "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2"
    assert aes_encrypt(key, iv, text).hex() == made and aes_decrypt(key, iv, bytes.fromhex(made)) == text


def _file(entry: bytes, seal) -> bytes:
    content = b"BT /F1 12 Tf 72 700 Td (secret words) Tj ET"
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[4 0 R]/Count 1>>", 3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>",
        4: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>/Contents 5 0 R>>", 6: b"<</Title<" + seal(6, b"The title").hex().encode() + b">>>", 7: entry,
    }
    data = seal(5, content)
    objects[5] = b"<</Length %d>>\nstream\n" % len(data) + data + b"\nendstream"
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in sorted(objects.items())) + b"trailer\n<</Root 1 0 R/Info 6 0 R/Encrypt 7 0 R/ID[<" + IDENT.hex().encode() + b"><00>]>>\n"


IDENT = b"0123456789abcdef"


def _pad16(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def _old(revision: int, size: int, user: bytes, owner: bytes, aes: bool) -> bytes:
    """O, U and the key as the format's algorithms 2 to 5 say."""
    rounds = 50 if revision >= 3 else 0
    k = md5((owner + PAD)[:32]).digest()
    for _ in range(rounds):
        k = md5(k[:size]).digest()
    o = (user + PAD)[:32]
    for i in range(20 if revision >= 3 else 1):
        o = rc4(bytes(b ^ i for b in k[:size]), o)
    key = md5((user + PAD)[:32] + o + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + IDENT).digest()
    for _ in range(rounds):
        key = md5(key[:size]).digest()
    key = key[:size]
    u = PAD if revision == 2 else md5(PAD + IDENT).digest()
    for i in range(20 if revision >= 3 else 1):
        u = rc4(bytes(b ^ i for b in key), u)

    def seal(n: int, data: bytes) -> bytes:
        own = md5(key + n.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if aes else b"")).digest()[: min(size + 5, 16)]
        return bytes(16) + aes_encrypt(own, bytes(16), _pad16(data)) if aes else rc4(own, data)

    kind = {2: b"/V 1/R 2", 3: b"/V 2/R 3/Length 128", 4: b"/V 4/R 4/CF<</S<</CFM/AESV2>>>>/StmF/S/StrF/S"}[revision]
    return _file(b"<</Filter/Standard" + kind + b"/P -4/O<%s>/U<%s>>>" % (o.hex().encode(), u.ljust(32, b"\0").hex().encode()), seal)


def _new(revision: int, user: bytes, owner: bytes) -> bytes:
    key = bytes(range(32))
    u = _hash_256(revision, user, b"validate", b"") + b"validate" + b"key salt"
    o = _hash_256(revision, owner, b"VALIDATE", u) + b"VALIDATE" + b"KEY SALT"
    ue = aes_encrypt(_hash_256(revision, user, b"key salt", b""), bytes(16), key)
    oe = aes_encrypt(_hash_256(revision, owner, b"KEY SALT", u), bytes(16), key)
    entry = b"<</Filter/Standard/V 5/R %d/CF<</S<</CFM/AESV3>>>>/StmF/S/StrF/S/P -4/O<%s>/U<%s>/OE<%s>/UE<%s>>>" % (revision, *(x.hex().encode() for x in (o, u, oe, ue)))
    return _file(entry, lambda n, data: bytes(16) + aes_encrypt(key, bytes(16), _pad16(data)))


@pytest.mark.parametrize("kind", ["rc4-40", "rc4-128", "aes-128", "aes-256-r5", "aes-256-r6"])
def test_encrypted_files_open(kind):
    make = {"rc4-40": lambda u, o: _old(2, 5, u, o, False), "rc4-128": lambda u, o: _old(3, 16, u, o, False), "aes-128": lambda u, o: _old(4, 16, u, o, True), "aes-256-r5": lambda u, o: _new(5, u, o), "aes-256-r6": lambda u, o: _new(6, u, o)}[kind]
    content = make(b"reader", b"boss")
    for password in ("reader", "boss"):
        assert "".join(x[2] for x in pdf.letters(content, password)) == "secret words"
    with pytest.raises(ValueError, match="password"):
        list(pdf.letters(content))
    open_to_all = make(b"", b"boss")
    assert next(pdf_edit.information(open_to_all))[0] == "The title"
    # Pages taken out of it are plain.
    assert "".join(x[2] for x in pdf.letters(pdf_edit.extracted(open_to_all, [1]))) == "secret words"


def test_first_hash_of_revision_five():
    assert _hash_256(5, b"p", b"salt", b"") == sha256(b"psalt").digest()
