"""Token ids of whole texts by a tokenizers file whose pre-tokens never cross white space.

The text is cut at ASCII white space, which such a tokenizer drops, and each distinct piece is
encoded once per worker; the ids of a text are the joined ids of its pieces. A piece of ASCII
characters is lower-cased and cut into pre-tokens here, as the file's own steps would, and each
distinct pre-token is encoded once; any other piece goes to the tokenizer as it is.
"""

from __future__ import annotations

import gc
import os
import re
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

# Fixed value: what the file's pre-tokenizer matches in lower-case ASCII.
ASCII_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: Bytes of text that are encoded at once.
SLICE = 8 << 20
#: Words that go to the tokenizer at once; its results are large.
BATCH = 1000


class WordBpe:
    """encode() gives the ids of each text as little-endian unsigned 32-bit integers. Null counts as empty.

    About ``most`` pieces are remembered in arrays, some 70 bytes each, and half as many pre-tokens in a dict, some
    140 bytes each. Beyond that the pieces met in one slice of texts only and the older pre-tokens are forgotten,
    which changes no result.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.pre: dict[str, bytes] = {}
        self.pre_before: dict[str, bytes] = {}
        self.pieces = pa.array([], pa.binary())
        self.flat, self.used = np.empty(1 << 16, "<u4"), 0
        self.begin, self.size, self.met = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces met in several slices, the most often met ones if they are still too many."""
        n = len(self.pieces)
        keep = self.met[:n] > 1
        if keep.sum() > self.most // 2:
            keep &= self.met[:n] > np.partition(self.met[:n], n - self.most // 2)[n - self.most // 2]
        places = np.flatnonzero(keep)
        self.pieces = self.pieces.take(pa.array(places))
        size = self.size[places]
        at = np.repeat(self.begin[places] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        self.flat, self.used = self.flat[at], len(at)
        self.begin, self.size, self.met = np.cumsum(size) - size, size, self.met[places] // 2

    @classmethod
    def of(cls, path: str) -> WordBpe:
        """One coder for all tasks of a Python worker."""
        return kept(f"word-bpe {path}", lambda: cls(path))

    def _coded(self, words: list[str]) -> list[bytes]:
        found: list[bytes] = []
        for k in range(0, len(words), BATCH):
            found += [pack(f"<{len(c.ids)}I", *c.ids) for c in self.tokenizer.encode_batch_fast(words[k : k + BATCH], add_special_tokens=False)]
        return found

    def _learn(self, pieces: list[bytes]) -> None:
        words = [p.decode("utf-8", "replace") for p in pieces]
        ids: list[bytes | None] = [None] * len(words)
        whole = [k for k, w in enumerate(words) if not w.isascii() or "<|" in w]
        for k, coded in zip(whole, self._coded([words[k] for k in whole]), strict=True):
            ids[k] = coded
        rest = [k for k, found in enumerate(ids) if found is None]
        lowered = [words[k].lower() for k in rest]
        plain = {w for w in lowered if w.isalpha()}
        several = {k: ASCII_PRE_TOKEN.findall(w) for k, w in zip(rest, lowered, strict=True) if w not in plain}
        if len(self.pre) > self.most // 4:
            self.pre, self.pre_before = {}, self.pre
        pre, before = self.pre, self.pre_before
        wanted = [w for w in plain.union(*several.values()) if w not in pre]
        pre.update((w, before[w]) for w in wanted if w in before)
        new = [w for w in wanted if w not in pre]
        pre.update(zip(new, self._coded(new), strict=True))
        for k, w in zip(rest, lowered, strict=True):
            ids[k] = pre[w] if w in plain else b"".join(map(pre.__getitem__, several[k]))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n, total = len(self.pieces), int(sizes.sum())
        if n + len(ids) > len(self.begin):
            self.begin, self.size, self.met = (np.concatenate([a[:n], np.zeros(n // 4 + 2 * len(ids), np.int64)]) for a in (self.begin, self.size, self.met))
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used // 4 + 2 * total, "<u4")])
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(ids), "<u4")
        self.begin[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(ids)] = sizes
        self.met[n : n + len(ids)] = 0
        self.used += total
        self.pieces = pa.concat_arrays([self.pieces, pa.array(pieces, pa.binary())])

    def encode(self, texts: pa.Array | list[bytes | None]) -> list[bytes]:
        """The ids of each text, which is UTF-8 in binary values."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        found: list[bytes] = []
        begin, held = 0, 0
        for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
            if held and held + n > SLICE:
                found += self._slice(texts.slice(begin, i - begin))
                begin, held = i, 0
            held += n
        return found + self._slice(texts.slice(begin))

    def _slice(self, texts: pa.Array) -> list[bytes]:
        words = pc.ascii_split_whitespace(_as_text(texts.fill_null(b"")))
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary())
        if len(self.pieces) > self.most:
            self._forget()
        found = pc.index_in(distinct, value_set=self.pieces)
        entry = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            gc.disable()  # many small lists live for a moment, none in a cycle
            entry[entry < 0] = np.arange(len(self.pieces), len(self.pieces) + found.null_count)
            self._learn(distinct.filter(found.is_null()).to_pylist())
            gc.enable()
        self.met[entry] += 1
        at = entry[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(self.begin[at] - ends[:-1], sizes)
        place += np.arange(len(place))
        data = self.flat[place].tobytes()
        cuts = (4 * ends[bounds - bounds[0]]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _as_text(values: pa.Array) -> pa.Array:
    """Binary values seen as text; bytes that are no UTF-8 become replacement characters."""
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values.to_pylist()], pa.string())
