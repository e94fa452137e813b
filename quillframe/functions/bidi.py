"""Bidirectional text by the Unicode algorithm: levels of code points for a paragraph of known direction, levels of a line, visual order."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

MAX_DEPTH = 125
EMBED = {"LRE": (0, None), "RLE": (1, None), "LRO": (0, "L"), "RLO": (1, "R")}
REMOVED = {"LRE", "RLE", "LRO", "RLO", "PDF", "BN"}
ISOLATES = {"LRI", "RLI", "FSI"}
NEUTRAL = {"B", "S", "WS", "ON", "LRI", "RLI", "FSI", "PDI"}


def classes(text: str) -> list[str]:
    """The class of each code point; one without a class counts as left to right."""
    return [unicodedata.bidirectional(c) or "L" for c in text]


def needs_reordering(text: str) -> bool:
    """Whether anything in the text may stand elsewhere than where it is stored."""
    return any(t in ("R", "AL", "AN", "RLE", "RLO", "RLI", "FSI") for t in classes(text))


@lru_cache(4096)
def _bracket(c: str) -> tuple[str, bool] | None:
    """(the closing bracket of the pair, whether c opens it), by the names of mirrored brackets."""
    c = unicodedata.normalize("NFC", c)
    kind, name = unicodedata.category(c), unicodedata.name(c, "")
    if not unicodedata.mirrored(c) or kind not in ("Ps", "Pe"):
        return None
    if kind == "Pe":
        return c, False
    try:
        return unicodedata.lookup(name.replace("LEFT", "RIGHT")), True
    except KeyError:
        return None


def _first_strong(types: list[str], begin: int, end: int) -> int:
    """Level 1 if the first strong class, isolates passed over, is right to left."""
    depth = 0
    for t in types[begin:end]:
        if t in ISOLATES:
            depth += 1
        elif t == "PDI":
            depth = max(0, depth - 1)
        elif not depth and t in ("L", "R", "AL"):
            return int(t != "L")
    return 0


def _isolate_ends(types: list[str]) -> dict[int, int]:
    ends, open_ = {}, []
    for i, t in enumerate(types):
        if t in ISOLATES:
            open_.append(i)
        elif t == "PDI" and open_:
            ends[open_.pop()] = i
    return ends


def levels(text: str, paragraph: int = 0) -> list[int]:
    """The level of each code point. What the algorithm removes has the level of what stands before it."""
    types = classes(text)
    original = list(types)
    ends = _isolate_ends(types)
    found = [paragraph] * len(types)
    stack: list[tuple[int, str | None, bool]] = [(paragraph, None, False)]
    lost_isolates = lost_embeddings = valid = 0
    for i, t in enumerate(original):
        level, override, _ = stack[-1]
        if t in EMBED or t in ISOLATES:
            if t in ISOLATES:
                found[i] = level
                types[i] = override or t
                odd = _first_strong(original, i + 1, ends.get(i, len(original))) if t == "FSI" else int(t == "RLI")
            else:
                odd = EMBED[t][0]
            following = (level + 1) | 1 if odd else (level + 2) & ~1
            if following <= MAX_DEPTH and not lost_isolates and not lost_embeddings:
                valid += t in ISOLATES
                stack.append((following, None if t in ISOLATES else EMBED[t][1], t in ISOLATES))
            elif t in ISOLATES:
                lost_isolates += 1
            elif not lost_isolates:
                lost_embeddings += 1
        elif t == "PDI":
            if lost_isolates:
                lost_isolates -= 1
            elif valid:
                lost_embeddings = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                valid -= 1
            found[i] = stack[-1][0]
            types[i] = stack[-1][1] or t
        elif t == "PDF":
            if not lost_isolates:
                if lost_embeddings:
                    lost_embeddings -= 1
                elif not stack[-1][2] and len(stack) > 1:
                    stack.pop()
        elif t == "B":
            found[i] = paragraph
            stack, lost_isolates, lost_embeddings, valid = stack[:1], 0, 0, 0
        elif t != "BN":
            found[i] = level
            types[i] = override or t
    for run in _sequences(original, found, ends):
        _resolve(text, types, original, found, run, paragraph, ends)
    before = paragraph
    for i, t in enumerate(original):
        if t in REMOVED:
            found[i] = before
        before = found[i]
    return found


def _sequences(original: list[str], found: list[int], ends: dict[int, int]) -> list[list[int]]:
    """Isolating run sequences, without what the algorithm removes."""
    runs: list[list[int]] = []
    for i, t in enumerate(original):
        if t in REMOVED:
            continue
        if runs and found[runs[-1][-1]] == found[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    by_first = {r[0]: r for r in runs}
    closing = set(ends.values())
    out = []
    for r in runs:
        if original[r[0]] == "PDI" and r[0] in closing:
            continue
        whole = list(r)
        while (end := ends.get(whole[-1])) is not None and end in by_first:
            whole += by_first[end]
        out.append(whole)
    return out


def _resolve(text: str, types: list[str], original: list[str], found: list[int], run: list[int], paragraph: int, ends: dict[int, int]) -> None:
    level = found[run[0]]
    beyond = lambda i, step: next((found[k] for k in (range(i - 1, -1, -1) if step < 0 else range(i + 1, len(found))) if original[k] not in REMOVED), paragraph)
    last = paragraph if original[run[-1]] in ISOLATES and run[-1] not in ends else beyond(run[-1], 1)
    sos = "R" if max(level, beyond(run[0], -1)) & 1 else "L"
    eos = "R" if max(level, last) & 1 else "L"
    t = [types[i] for i in run]
    n = len(t)
    for k in range(n):  # W1
        if t[k] == "NSM":
            t[k] = sos if k == 0 else "ON" if t[k - 1] in ISOLATES or t[k - 1] == "PDI" else t[k - 1]
    strong = sos
    for k in range(n):  # W2
        if t[k] in ("L", "R", "AL"):
            strong = t[k]
        elif t[k] == "EN" and strong == "AL":
            t[k] = "AN"
    t = ["R" if x == "AL" else x for x in t]  # W3
    for k in range(1, n - 1):  # W4
        if t[k - 1] == t[k + 1] and (t[k] in ("ES", "CS") and t[k + 1] == "EN" or t[k] == "CS" and t[k + 1] == "AN"):
            t[k] = t[k + 1]
    k = 0
    while k < n:  # W5
        if t[k] == "ET":
            end = k
            while end < n and t[end] == "ET":
                end += 1
            if k and t[k - 1] == "EN" or end < n and t[end] == "EN":
                t[k:end] = ["EN"] * (end - k)
            k = end
        else:
            k += 1
    t = ["ON" if x in ("ES", "ET", "CS") else x for x in t]  # W6
    strong = sos
    for k in range(n):  # W7
        if t[k] in ("L", "R"):
            strong = t[k]
        elif t[k] == "EN" and strong == "L":
            t[k] = "L"
    own = "R" if level & 1 else "L"
    side = lambda x: x if x == "L" else "R" if x in ("R", "EN", "AN") else None
    for a, b in _pairs(text, run, t):  # N0
        inside = {side(x) for x in t[a + 1 : b]}
        if own in inside:
            made = own
        elif inside - {None}:
            before = next((s for x in reversed(t[:a]) if (s := side(x))), sos)
            made = before if before != own else own
        else:
            continue
        for at in (a, b):
            t[at] = made
            while at + 1 < n and original[run[at + 1]] == "NSM":
                at += 1
                t[at] = made
    k = 0
    while k < n:  # N1, N2
        if t[k] in NEUTRAL:
            end = k
            while end < n and t[end] in NEUTRAL:
                end += 1
            before, after = side(t[k - 1]) if k else sos, side(t[end]) if end < n else eos
            t[k:end] = [before if before == after else own] * (end - k)
            k = end
        else:
            k += 1
    for i, x in zip(run, t, strict=True):  # I1, I2
        found[i] = level + (int(x != "R" and x != "L") * 2 + int(x == "R") if not level & 1 else int(x != "R"))


def _pairs(text: str, run: list[int], t: list[str]) -> list[tuple[int, int]]:
    """Pairs of brackets in order of the opening one; beyond 63 open brackets no pair counts."""
    open_: list[tuple[str, int]] = []
    out = []
    for k, i in enumerate(run):
        bracket = _bracket(text[i]) if t[k] == "ON" else None
        if bracket is None:
            continue
        if bracket[1]:
            if len(open_) == 63:
                return []
            open_.append((bracket[0], k))
            continue
        for at in range(len(open_) - 1, -1, -1):
            if open_[at][0] == bracket[0]:
                out.append((open_[at][1], k))
                del open_[at:]
                break
    return sorted(out)


def line_levels(text: str, found: list[int], begin: int, end: int, paragraph: int = 0) -> list[int]:
    """Levels of a line: separators, and blanks before them and at its end, go back to the paragraph's level."""
    line, trailing = found[begin:end], True
    for k, t in reversed(list(enumerate(classes(text[begin:end])))):
        if t in ("S", "B"):
            line[k], trailing = paragraph, True
        elif trailing and (t == "WS" or t in ISOLATES or t == "PDI" or t in REMOVED):
            line[k] = paragraph
        else:
            trailing = False
    return line


def visual_order(line: list[int]) -> list[int]:
    """Logical places of a line in the order in which they stand, left to right."""
    order = list(range(len(line)))
    for level in range(max(line, default=0), min(line, default=1) | 1, -1) if line else []:
        _turn(order, line, level)
    if line:
        _turn(order, line, min(line) | 1)
    return order


def _turn(order: list[int], line: list[int], level: int) -> None:
    k = 0
    while k < len(order):
        end = k
        while end < len(order) and line[order[end]] >= level:
            end += 1
        order[k:end] = order[k:end][::-1]
        k = end + 1


def visual(text: str, paragraph: int = 0) -> str:
    """A text of one line as it stands from left to right, without mirroring."""
    return "".join(text[i] for i in visual_order(line_levels(text, levels(text, paragraph), 0, len(text), paragraph)))
