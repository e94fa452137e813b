"""Token counts under a unigram model, by dynamic programming on a trie of pre-tokens.

A text's pre-tokens are its words ``[^\\x20\\x09-\\x0D]+``, each with the word mark U+2581 before it.
Distinct pre-tokens go into a trie. A node stands for a prefix, and the best segmentation of a prefix
does not depend on what follows: its score is the largest, over pieces that end there, of the score
of the shorter prefix plus the piece's, computed once when the node is made. A node stores the score
and the number of tokens; the node where a pre-token ends has its count. Ties of score take fewer
tokens.

Pieces come from a public vocabulary of ranked pieces; a piece of rank r has the score
``-log(r + 2)``, the law that word frequencies follow nearly: the file's own scores are ranks of merges, which as
unigram scores would break most words into short pieces. With these scores the sentencepiece library, as a
unigram model, segments alike. A character that no piece covers costs
``UNKNOWN`` per byte and counts as many tokens as UTF-8 bytes, as byte fallback has it.

A worker remembers the trie up to ``most`` nodes (some 350 bytes each) and as many counts of words (some 110
bytes each, those of the last half kept when it is full); a trie that starts anew changes no count. Null and empty texts have no tokens. Repeated rows give repeated rows, an
empty table an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text, kept, slices
from .word_bpe import _as_text

MARK = "▁"
UNKNOWN = -25.0
COUNTED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pre_tokens", pa.int64())])


def scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary (without control, unknown and byte pieces) with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    return {model.id_to_piece(k): -math.log(r + 2) for r, k in enumerate(plain)}


class SharedTrie:
    """Nodes are dicts of child nodes by character; None holds a node's (score, tokens)."""

    def __init__(self, pieces: dict[str, float], most: int = 800_000):
        self.most, self.longest = most, max(map(len, pieces), default=0)
        self.pieces = pieces
        self.known: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.root: dict = {None: (0.0, 0)}
        self.nodes = 1

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of a pre-token."""
        node, path, i = self.root, [self.root[None]], 0
        for ch in word:
            child = node.get(ch)
            i += 1
            if child is None:
                best, tokens = path[i - 1][0] + UNKNOWN * (n := len(ch.encode("utf-8", "surrogatepass"))), path[i - 1][1] + n
                for size in range(1, min(i, self.longest) + 1):
                    score = self.pieces.get(word[i - size : i])
                    if score is not None:
                        before = path[i - size]
                        total = before[0] + score
                        if total > best or total == best and before[1] + 1 < tokens:
                            best, tokens = total, before[1] + 1
                node[ch] = child = {None: (best, tokens)}
                self.nodes += 1
            node = child
            path.append(node[None])
        return path[-1][1]

    def counts(self, words: list[bytes]) -> np.ndarray:
        if self.nodes > self.most:
            self._forget()
        if len(self.known) > self.most // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        for w in words:
            if w not in known:
                met = before.get(w)
                known[w] = met if met is not None else self.count(MARK + w.decode("utf-8", "replace")) if w else 0
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _counter(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = kept(f"trie {path}", lambda: SharedTrie(scores(path), most))
        for part in slices(batches, most=8 << 20):
            words = pc.ascii_split_whitespace(_as_text(part.column("text").fill_null(b"")))
            bounds = words.offsets.to_numpy()
            bounds = bounds - bounds[0]
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary()).to_pylist()
            at = coded.indices.to_numpy(zero_copy_only=False)
            filled = np.array([len(w) > 0 for w in distinct], np.int64)
            sums = [np.concatenate([[0], np.cumsum(x[at])])[bounds] for x in (trie.counts(distinct), filled)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(np.diff(s)) for s in sums)], schema=COUNTED)

    return run


def count_tokens(docs: DataFrame, path: str, most: int = 800_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_pre_tokens of each row."""
    return id_and_text(docs, id_col, text_col, 8 << 20).mapInArrow(_counter(path, most), "doc_id long, n_tokens long, n_pre_tokens long")
