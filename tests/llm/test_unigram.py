"""Token counts against the sentencepiece library, which is given the same pieces and scores as a unigram model."""

import re
import struct

import pyarrow.parquet as pq
import sentencepiece

from quillframe.llm import queries, token_counts


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return n, at


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _fields(data: bytes):
    """(number, whole field, its body or None) of a message."""
    at = 0
    while at < len(data):
        began = at
        tag, at = _varint(data, at)
        body = None
        if tag & 7 == 0:
            _, at = _varint(data, at)
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            body, at = data[at : at + n], at + n
        else:
            at += 4 if tag & 7 == 5 else 8
        yield tag >> 3, data[began:at], body


def _unigram(path: str, scores: dict[str, float]) -> sentencepiece.SentencePieceProcessor:
    """The vocabulary's file with other scores and the kind of a unigram model."""
    out = b""
    with open(path, "rb") as f:
        for number, whole, body in _fields(f.read()):
            if number == 1:
                parts = list(_fields(body))
                piece = next(b for n, _, b in parts if n == 1).decode()
                kept = b"".join(w for n, w, _ in parts if n != 2)
                body = kept + b"\x15" + struct.pack("<f", scores.get(piece, 0.0))
                whole = b"\x0a" + _number(len(body)) + body
            elif number == 2:
                body = b"".join(w for n, w, _ in _fields(body) if n != 3) + b"\x18\x01"
                whole = b"\x12" + _number(len(body)) + body
            out += whole
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_counts_are_those_of_the_library_with_the_same_scores():
    path = queries.vocabulary(queries.PIECES)
    scores = token_counts.scores(path)
    library = _unigram(path, scores)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    words = sorted({w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") if all(c in scores for c in w) and token_counts.MARK not in w})
    assert len(words) > 1000
    trie = token_counts.SharedTrie(scores)
    ties = 0
    for word, pieces in zip(words, library.encode(words, out_type=str), strict=True):
        assert "".join(pieces) == token_counts.MARK + word
        trie.count(token_counts.MARK + word)
        node = trie.root
        for c in token_counts.MARK + word:
            node = node[c]
        score, tokens = node[None]
        assert abs(score - sum(scores[p] for p in pieces)) < 1e-4, word
        ties += tokens != len(pieces)
        assert tokens <= len(pieces) or abs(score - sum(scores[p] for p in pieces)) < 1e-5, word
    assert ties <= len(words) // 1000
