"""Each operator against brute force on small fixtures, with nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillframe.llm import byte_bpe, langid, near_copies, packing, quality, queries, simhash, token_counts, token_files, topk, toxicity, url_filter
from quillframe.llm.common import new_path
from quillframe.llm.word_bpe import WordBpe

WORDS = "the of and to in is was for on that with by this those people garden river stone light paper".split()
ODD = ["It's  DON'T\tx \x1c a1b22 'S ...'re É H̱ İ ǅ Σς\x0bq 日本語テスト 12%$# a_b \x85d\x00e", "", "   ", "\n\n a\n", "a  b   c \n\t d ", "x" * 5000]


def texts(n: int = 60, seed: int = 3) -> list[str | None]:
    r = random.Random(seed)
    made: list[str | None] = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 120))) for _ in range(n)]
    return [None, *ODD, *made, made[0], made[1], made[1] + " end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", 1, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, id long, fp string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def word_path() -> str:
    return queries.vocabulary(queries.WORD_BPE)


def ids_of(text: str | None, end: int) -> bytes:
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(word_path())
    return np.array([*coder.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def test_word_bpe_is_the_tokenizer():
    samples = [t for t in texts() if t is not None] + ["<|endoftext|>a b<|startoftext|>"]
    for most in (3, 60, 100_000):
        coder = WordBpe(word_path(), most=most)
        for k in range(0, len(samples), 7):  # slices that share some words, so that memories are thinned out again and again
            for part in (samples[k : k + 9], samples[:12]):
                assert coder.encode([t.encode() for t in part]) == [ids_of(t, 0)[:-4] for t in part]


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, word_path(), capacity=256, block_tokens=2000).collect()
    wanted = Counter((r.doc_id, ids_of(r.text, 2)) for r in docs.collect())
    pieces: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault((r.doc_id, r.start), []).append(r)
    for (doc, ids), copies in wanted.items():
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in own) == copies * len(ids) // 4 and {r.doc_tokens for r in own} == {len(ids) // 4}
        assert all(r.ids == ids[4 * r.start : 4 * (r.start + r.length)] for r in own)
        seen = Counter(k for r in own for k in range(r.start, r.start + r.length))
        assert seen == dict.fromkeys(range(len(ids) // 4), copies)
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for spans in seqs.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
        padding += 0 if end & (end - 1) == 0 else 256 - end
    assert padding <= 0.1 * sum(r.length for r in rows)
    assert packing.pack_documents(empty, word_path()).count() == 0


def plain_pack(lengths: list[int], capacity: int, quadratic: float) -> list[tuple]:
    """The greedy of the module's text, step by step over lists."""
    room = packing.capacities(sum(lengths), capacity).tolist()
    cost, used, out = [0.0] * len(room), [0] * len(room), []
    queue = [[min(capacity, n - s), i, s] for i, n in enumerate(lengths) for s in range(0, n, capacity)]
    while queue:
        queue.sort(key=lambda q: (-q[0], q[1], q[2]))
        n, i, start = queue.pop(0)
        fits = [k for k in range(len(room)) if room[k] >= n]
        s = min(fits or [k for k in range(len(room)) if room[k] > 0], key=lambda k: (cost[k], k))
        if not fits:
            queue.append([n - room[s], i, start + room[s]])
            n = room[s]
        out.append((i, start, n, s, used[s]))
        used[s], room[s], cost[s] = used[s] + n, room[s] - n, cost[s] + n + quadratic * n * n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pack_is_the_greedy(seed):
    r = np.random.default_rng(seed)
    lengths = np.concatenate([r.integers(1, 60, 80), r.integers(100, 700, 12), [256, 512, 1]])
    r.shuffle(lengths)
    assert [tuple(x) for x in packing.pack(lengths, 256).tolist()] == plain_pack(lengths.tolist(), 256, 1 / 2048)
    # 100 and 90 open a sequence each; 40 goes to the one of lower cost.
    rows = {int(i): int(s) for i, _, _, s, _ in packing.pack(np.array([100, 90, 40, 26]), 128).tolist() if i < 3}
    assert rows[0] != rows[1]


def test_token_files_round_trip(spark, docs, empty):
    out = new_path(spark, "t")
    manifest = token_files.write_token_files(docs, word_path(), out, shards=3, frame_bytes=64)
    rows = sorted(token_files.read_token_files(spark, out, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    at, wanted = 0, {r.doc_id: ids_of(r.text, 1) for r in docs.collect()}
    for r in rows:
        assert (r.start, r.ids, r.n_tokens) == (at, wanted[r.doc_id], len(r.ids) // 4)
        at += r.n_tokens
    some = token_files.read_token_files(spark, out, manifest, [9, 20]).collect()
    assert {r.doc_id: r.ids for r in some} == {k: wanted[k] for k in (9, 20)}
    assert token_files.read_token_files(spark, out, token_files.write_token_files(empty, word_path(), out)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (-(1 << 63), "b c"), (0, None), (3, "x"), (3, "x"), (3, "x")], "doc_id long, text string")
    manifest = token_files.write_token_files(odd, word_path(), out)
    assert [r.doc_id for r in sorted(token_files.read_token_files(spark, out, manifest).collect(), key=lambda r: r.start)] == [None, -(1 << 63), 0, 3, 3, 3]
    assert [r.doc_id for r in token_files.read_token_files(spark, out, manifest, [0]).collect()] == [0]


def test_token_file_decompresses_only_what_is_asked_and_sees_damage(tmp_path):
    import zstandard

    path = tmp_path / "a.zst"
    with open(path, "wb") as f:
        w = token_files.ShardWriter(f, 64)
        for i in range(40):
            w.add(i, np.arange(i, dtype="<u4").tobytes())
        w.close()
    data = path.read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(np.arange(i, dtype="<u4").tobytes() for i in range(40))
    with open(path, "rb") as f:
        r = token_files.ShardReader(f, len(data))
        assert r.ids(3) == np.arange(3, dtype="<u4").tobytes() and r.decompressed == 1
    broken = bytearray(data)
    broken[20] ^= 255
    path.write_bytes(bytes(broken))
    with open(path, "rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        r = token_files.ShardReader(f, len(data))
        [r.ids(k) for k in range(40)]


def plain_fingerprint(text: str | None, words: int) -> int:
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def groups(prints: list[int], ids: list[int], radius: int) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
                root[b] = a
    return [ids[find(i)] for i in range(len(prints))]


def test_near_duplicates(docs, empty):
    rows = sorted(simhash.near_duplicates(docs).collect())
    source = sorted((r.doc_id, r.text or "") for r in docs.collect())
    prints = [plain_fingerprint(t, 4) for _, t in source]
    assert [(r.doc_id, int(r.fingerprint, 16)) for r in rows] == [(i, p) for (i, _), p in zip(source, prints, strict=True)]
    assert [r.component_id for r in rows] == groups(prints, [i for i, _ in source], 4)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_bit_sliced_links_are_exact(radius):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40).astype(np.uint64)
    prints = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)]]))
    r.shuffle(prints)
    a, b = simhash.links(prints, np.zeros(len(prints), np.int64), radius, slab=3)
    want = groups([int(p) for p in prints], list(range(len(prints))), radius)
    root = list(range(len(prints)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = min(root[x], root[y]), max(root[x], root[y])
        root = [p if k == q else k for k in root]
    assert root == want and len(a) == len(prints) - len(set(want))


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 16)
    r = random.Random(1)
    prints = sorted({r.getrandbits(6) | (k << 50) for k in range(3) for _ in range(60)})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    found = {x.node: x.component for x in simhash.components(simhash.link_forest(df, 2)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == groups(prints, list(range(len(prints))), 2)
    # All bits but a few are shared by every row: buckets are refined to the end.
    prints = [(1 << 62) | k for k in range(300)]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    found = {x.node: x.component for x in simhash.components(simhash.link_forest(df, 1)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == groups(prints, list(range(len(prints))), 1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}


def test_byte_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    path = queries.vocabulary(queries.BYTE_BPE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, buckets=3, chunk_bytes=500, most=2)
    wanted = {r.doc_id: np.array(coder.encode_ordinary(r.text or ""), "<u4").tobytes() for r in docs.collect()}
    rows = encoded.collect()
    assert len(rows) == docs.count() and all(r.ids == wanted[r.doc_id] and r.n_tokens == len(r.ids) // 4 for r in rows)
    plain = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(bytes(r.decoded) == plain[r.doc_id] for r in byte_bpe.decode(encoded, path).collect())
    for r in byte_bpe.digests(encoded, path).collect():
        assert r.ids_sha256 == hashlib.sha256(wanted[r.doc_id]).hexdigest() and r.decoded_sha256 == hashlib.sha256(plain[r.doc_id]).hexdigest()
    assert byte_bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_token_counts_are_the_best_segmentations(docs, empty):
    pieces = {"▁": -9.0, "▁the": -1.0, "▁a": -2.0, "th": -3.0, "e": -4.0, "r": -4.0, "i": -4.0, "ri": -4.5, "river": -6.0, "a": -4.0, "x": -5.0, "xx": -6.0}
    trie = token_counts.SharedTrie(pieces, most=5)

    def best(w: str) -> int:
        scores = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            n = len(w[i - 1].encode())
            options = [(scores[i - 1][0] + token_counts.UNKNOWN * n, scores[i - 1][1] + n)]
            options += [(scores[j][0] + pieces[w[j:i]], scores[j][1] + 1) for j in range(i) if w[j:i] in pieces]
            top = max(o[0] for o in options)
            scores.append(min((o for o in options if o[0] == top), key=lambda o: o[1]))
        return scores[-1][1]

    words = ["the", "river", "xxxa", "日本", "a", "these", "rivers"] * 2
    assert trie.counts([w.encode() for w in words]).tolist() == [best("▁" + w) for w in words]
    path = queries.vocabulary(queries.PIECES)
    whole = token_counts.SharedTrie(token_counts.scores(path))
    got = {r.doc_id: (r.n_tokens, r.n_pre_tokens) for r in token_counts.count_tokens(docs, path).collect()}
    for r in docs.collect():
        parts = (r.text or "").encode().split()
        assert got[r.doc_id] == (sum(whole.count("▁" + p.decode()) for p in parts), len(parts))
    assert token_counts.count_tokens(empty, path).count() == 0


def test_language_profiles(spark, empty):
    r = random.Random(2)
    make = lambda alphabet: " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 8))) for _ in range(60))
    rows = [(i, make("abcdeä" if i % 2 else "vwxyzé"), "p" if i % 2 else "q") for i in range(60)] + [(90, None, "p"), (91, "12 ..", "q"), (92, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit(df.where("doc_id < 40 or doc_id > 80"), per_language=1000, top=50)
    # Against counts in plain Python.
    counts: Counter = Counter()
    for i, t, lang in rows[:40]:
        if lang == "p":
            w = " " + re.sub("[^a-zä]+", " ", t.lower()).strip() + " "
            for n in (1, 2, 3):
                counts.update(w[k : k + n] for k in range(len(w) - n + 1) if w[k : k + n] != " " and w[k : k + n][1:2] != " " or n == 2)
    best = sorted(counts, key=lambda g: (-counts[g], [ord(c) for c in g]))[:5]
    decode = lambda c: "".join(chr(p) for p in ((c >> 42) & 0x1FFFFF, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF) if p).replace("\x01", " ")
    column = profiles.languages.index("p")
    mine = sorted((int(profiles.ranks[k, column]), decode(int(profiles.codes[k]))) for k in range(len(profiles.codes)) if profiles.ranks[k, column] < 5)
    assert {g for _, g in mine} == set(best)
    found = {x.doc_id: x for x in langid.identify(df, profiles).collect()}
    # The out-of-place distance in plain Python, over dicts of ranks.
    learned = {name: {int(c): int(r) for c, r in zip(profiles.codes, profiles.ranks[:, k], strict=True) if r < 50} for k, name in enumerate(profiles.languages)}
    for i, t, _ in rows[40:50]:
        own = Counter(langid.grams(t.encode()).tolist())
        places = {g: n for n, g in enumerate(sorted(own, key=lambda g: (-own[g], g))[:50])}
        distance = {name: sum(abs(ranks[g] - n) if g in ranks else 50 for g, n in places.items()) for name, ranks in learned.items()}
        assert found[i].lang_pred == min(distance, key=lambda name: (distance[name], name)) and abs(found[i].score - (1 - min(distance.values()) / (50 * len(places)))) < 1e-12
    assert all(found[i].lang_pred == lang for i, _, lang in rows[40:60]) and all(0 <= x.score <= 1 for x in found.values())
    assert found[90].lang_pred == found[91].lang_pred == "und"
    assert langid.identify(df, langid.fit(df.limit(0))).first().lang_pred == "und"
    assert langid.identify(empty, profiles).count() == 0


def test_toxicity_learns_words_and_leaves_wordless_texts(spark, empty):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(40)) + (" vile" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)] + [(900, None, 0), (901, "", 1), (902, "stone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    machine = toxicity.fit(df.where("doc_id < 300"), df.select("doc_id", df.label.alias("toxic")))
    found = {x.doc_id: x for x in toxicity.score(df, machine).collect()}
    assert all(found[i].predicted == y for i, _, y in rows[300:400])
    assert found[900].predicted == found[901].predicted == 0
    kept = toxicity.keep_clean(df, machine)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, x in found.items() if x.score < 0.5}
    assert toxicity.score(empty, machine).count() == 0
    assert toxicity.score(df, toxicity.fit(df.limit(0), df.select("doc_id", df.label.alias("toxic")))).first().predicted == 0


def test_toxicity_factors_learn_pairs():
    r = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(4000):
        a, b = r.integers(0, 2, 2)
        rows.append(np.sort(np.array([k for k, on in ((1, a), (2, b), (int(r.integers(10, 400)), 1)) if on], np.int64)))
        labels.append(int(a and b))
    machine = toxicity.train(rows, np.array(labels), bits=10, epochs=20)
    # Rows that differ in the pair alone: both terms together score above the sum of what each adds.
    one, two, both, none = machine.score([np.array([1]), np.array([2]), np.array([1, 2]), np.array([999])])
    assert both > 0.5 > max(one, two, none)


def test_toxicity_raw_is_the_double_loop():
    r = np.random.default_rng(6)
    machine = toxicity.Machine(10, np.arange(0, 1024, 3), 0.3, r.normal(0, 1, 342), r.normal(0, 1, (342, 4)))
    rows = [r.integers(0, 342, n) for n in (0, 1, 2, 7, 40)]
    rows = [np.unique(x) for x in rows]
    got = machine.raw(np.concatenate(rows), np.cumsum([0, *map(len, rows)]))
    for x, value in zip(rows, got, strict=True):
        scale = 1 / np.sqrt(max(len(x), 1))
        pairs = sum(machine.v[i] @ machine.v[j] for a, i in enumerate(x) for j in x[:a])
        assert abs(value - (0.3 + scale * machine.w[x].sum() + scale**2 * pairs)) < 1e-9


def brute_quality(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures_and_cascade(spark, docs, empty):
    extra = [(1000, "a b c d a b c a b c x", "en", "s", 1, ""), (1001, ("one two three\n" * 30), "en", "s", 1, ""), (1002, "# $ % word " * 40, "en", "s", 1, "")]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("n_words", docs["id"])
    rows = quality.judge(df, sample_rows=20).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute_quality(r.text), r.doc_id
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and (not r.base_failed or not r.kept)
    orders = [quality.rules(), quality.rules()[::-1]]
    kept = [{r.doc_id for r in quality.judge(df, o).where("kept").collect()} for o in orders]
    assert kept[0] == kept[1] == {r.doc_id for r in rows if r.kept}
    # Only a line feed ends a line, for the rules on line ends as for the counts.
    odd = " ".join(f"wording{chr(97 + i % 26) * (1 + i // 26)}...\u0085" for i in range(60)) + " end"
    assert quality.judge(spark.createDataFrame([(1, odd), (2, odd.replace("\u0085", "\n"))], "doc_id long, text string")).orderBy("doc_id").select("rejected_by").collect() == [(None,), ("ellipsis_lines",)]
    assert quality.judge(empty).count() == 0
    good = quality.keep_good(df, sample_rows=20)
    assert good.columns == df.columns and sorted(map(repr, good.collect())) == sorted(repr(r) for r in df.collect() if r.doc_id in kept[0])


def test_quality_keeps_columns_whatever_their_names(spark):
    prose = "\n".join(" ".join(f"{w}{k}{n}" for k, w in enumerate(WORDS)) for n in range(5))
    rows = [(k, prose + f" tail{k}" if k % 3 else "short", 7, "mine", True, [1], "other", 3) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, body string, n_chars long, rejected_by string, n_lines boolean, _words array<int>, text string, row int")
    kept = quality.keep_good(df, text_col="body", sample_rows=10).collect()
    assert sorted(map(tuple, kept)) == [r for r in rows if r[0] % 3]
    judged = quality.judge(df, text_col="body", sample_rows=10).collect()
    assert all((r.n_chars, r._words, r.text, r.row) == (7, [1], "other", 3) and r.kept == (r.doc_id % 3 > 0) for r in judged)
    assert quality.keep_good(df.limit(0), text_col="body").count() == 0


def test_cascade_order_is_greedy():
    made = [quality.Rule(n, None, needs) for n, needs in (("dear", ("windows",)), ("cheap", ()), ("same", ()), ("free", ("windows",)))]
    found = [((True, True, True, False), 50), ((True, False, False, False), 30), ((False, False, False, True), 5), ((False,) * 4, 15)]
    out = quality.greedy(made, found, {"windows": 10.0}, dict.fromkeys(("dear", "cheap", "same", "free"), 1.0), set())
    # "same" adds nothing after "cheap"; "free" pays for no measure once "dear" has.
    assert [r.name for r in out] == ["cheap", "dear", "free", "same"]


def test_repeated_words_are_exact_where_hashes_collide(spark, monkeypatch):
    real = quality.F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: quality.F.shiftleft(quality.F.pmod(real(*c), quality.F.lit(3)), 61))
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abcdefghij"[: 2 + i]) for _ in range(60))) for i in range(8)] + [(8, "a b c x a b c y b c x"), (9, " ".join(map(str, range(80))))]
    found = quality.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [x.n_repeat_words for x in sorted(found)] == [brute_quality(t)[4] for _, t in rows]


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_url_filter_as_of(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(url_filter, "HOT", 1)
    entries = spark.createDataFrame(
        [("Bad.example", "add", "2024-01-10", "x"), ("bad.example", "remove", "2024-02-01", "x"), ("bad.example", "add", "2024-02-01", "x"), ("bad.example", "remove", "2024-03-01", "x"), ("a.bad.example", "add", "2024-01-20", "y"), (None, "add", "2024-01-01", "z"), ("late.example", "remove", "2024-01-01", "z"), ("bad.example", "add", "2024-01-15", "x")],
        "domain string, action string, day string, category string",
    ).selectExpr("domain", "action", "category", "to_timestamp(day) as listed_at")
    cases = [
        ("http://bad.example/", "2024-01-09", None), ("http://www.BAD.example:80/x", "2024-01-10", "bad.example"), ("https://u@bad.example?q", "2024-02-15", "bad.example"), ("http://bad.example", "2024-03-01", None),
        ("http://x.a.bad.example/", "2024-01-25", "a.bad.example"), ("http://x.a.bad.example/", "2024-05-25", "a.bad.example"), ("http://notbad.example/", "2024-01-25", None), (None, "2024-01-25", None), ("no url", "2024-01-25", None), ("http://late.example", "2024-01-25", None), ("http://bad.example", None, None),
    ]
    captures = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(cases)], "page_id long, url string, d string").selectExpr("page_id", "url", "to_timestamp(d) as fetched_at", "'c' as blocked", "'h' as host", "'t' as timeline", "5 as at", "'s' as salt", "'b' as best", "1 as row")
    found = {r.page_id: r for r in url_filter.evaluate(captures, entries).collect()}
    assert [found[i].matched_domain for i in range(len(cases))] == [c[2] for c in cases]
    assert [found[i].blocked for i in range(len(cases))] == [c[2] is not None for c in cases] and (found[0].host, found[0].timeline, found[0].at, found[0].salt, found[0].best, found[0].row) == ("h", "t", 5, "s", "b", 1)
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0 and url_filter.evaluate(captures, entries.limit(0)).where("blocked").count() == 0


def plain_top(rows: list[tuple], is_query, k: int = 5) -> list[tuple]:
    """query_id, rank, vec_id and true score of the k best, in whole numbers."""
    whole = lambda x: int(np.floor(256 * x)) if abs(x) < 1 << 53 else int(x) * 256
    used = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in used:
        if is_query(q):
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in used if i != q)[:k]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(want)


@pytest.mark.parametrize("first", [16, 2])
def test_top_k_is_exact(spark, monkeypatch, first):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "FIRST", first)
    r = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in np.round(r.normal(0, 0.3, 8), 1)]) for i in range(400)]
    rows = [*vectors, (400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (None, [1.0] * 8), (600, []), (650, [0.5, 0.5]), (7, [0.1] * 8), (700, [0.3] * 9), (50, [0.2] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = topk.top_k(df, F.pmod("id", F.lit(50)) == 0, k=5, shard_rows=100, block_bytes=300)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in found.collect()) == plain_top(rows, lambda i: i % 50 == 0)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_of_very_large_numbers(spark):
    from pyspark.sql import functions as F

    rows = [(0, [-1e30, 1.0]), (50, [1.0, 1.0]), (1, [0.5, 2.0]), (2, [1e30, 0.0]), (3, [1e300, 1e300]), (100, [-1e300, 3.0]), (4, [2e30, 0.0]), (5, [-2e30, 0.5]), (150, [3e12, -7e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = [(q, n, i, cut(s)) for q, n, i, s in plain_top(rows, lambda i: i % 50 == 0)]
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, F.pmod("id", F.lit(50)) == 0).collect()) == want
    keys = [topk._order_key(s) if not -(1 << 63) <= s < 1 << 63 else topk.PLAIN for s in (-(10**50), -(10**30) - 1, -(10**30), 5, 10**30, 10**30 + 1, 10**50)]
    assert keys == sorted(keys)


def test_ball_tree_prunes():
    r = np.random.default_rng(2)
    centres = r.normal(0, 300, (40, 16))
    vectors = np.concatenate([c + r.normal(0, 5, (100, 16)) for c in centres]).astype(np.int64)
    tree, best = topk.BallTree(np.arange(len(vectors)), vectors), topk.Best(1, 5)
    tree.search(np.array([-1]), vectors[:1], best, np.array([topk.LEAST]))
    scores = vectors @ vectors[0]
    assert tree.visited < len(vectors) / 4 and best.ids[0].tolist() == np.lexsort((np.arange(len(vectors)), -scores))[:5].tolist()
    # A kth score from elsewhere prunes further.
    again = topk.BallTree(np.arange(len(vectors)), vectors)
    again.search(np.array([-1]), vectors[:1], topk.Best(1, 5), np.array([int(scores.max()) + 1]))
    assert again.visited <= tree.visited


def plain_groups(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """The smallest id that each document reaches over pairs of five-word Jaccard similarity 0.8 or more."""
    sets, root = {}, {}
    for i, t in rows:
        parts = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        sets[i], root[i] = {tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set(), i
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                p, q = sorted((root[i], root[j]))
                root = {k: p if v == q else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("common", [200_000, 3])
def test_near_copies_are_exact(spark, docs, empty, monkeypatch, common):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "COMMON", common)
    r = random.Random(4)
    word = lambda: r.choice(WORDS) + r.choice("abcdefgh")
    passage, rows = [word() for _ in range(40)], []
    for k in range(12):  # edited copies of one text, more and more edits; a passage that all share
        base = [*passage, *(word() for _ in range(r.randint(30, 150)))]
        rows.append((100 * k, " ".join(base)))
        for n in range(1, 7):
            text = list(base)
            for _ in range(n if k % 2 else 1 + n % 3):
                text[r.randrange(len(text))] = word()
            rows.append((100 * k + n, " ".join(text).upper() if n == 2 else "\n".join(text)))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "a b"), (5004, "A  b"), (5005, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_groups(rows)
    assert 20 < len(set(want.values())) < len(rows) - 20
    assert {x.doc_id: x.component_id for x in near_copies.linked(df).collect()} == want
    if common == 200_000:
        assert {x.doc_id for x in corpus_pipeline.distinct(spark, df, "").collect()} == set(want.values())
        assert near_copies.keep_one(empty).count() == 0
        assert near_copies.keep_one(docs).columns == docs.columns
        ids = spark.createDataFrame([(None, "x y z"), (7, "x y z"), (None, "only here"), (9, "p q"), (9, "p q")], "doc_id long, text string")
        assert sorted(map(tuple, near_copies.keep_one(ids).collect()), key=repr) == [(7, "x y z"), (9, "p q"), (9, "p q"), (None, "only here"), (None, "x y z")]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    prose = lambda: "\n".join(" ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(20)) for _ in range(6))
    rows = [(i, prose(), "en", "s", 0) for i in range(60)]
    rows = [(i, t + (" vile" if i % 6 == 0 else ""), a, b, c) for i, t, a, b, c in rows] + [(100, rows[1][1], "en", "s", 0), (101, "short", "en", "s", 0), (102, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(48)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "packing"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted = {i for i in range(60) if i % 6}
    assert {p.doc_id for p in pieces} == wanted
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        names = sorted(df.columns)
        mine = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
        theirs = sorted(map(repr, con.sql(f"select {', '.join(names)} from ({sql})").fetchall()))
        assert mine == theirs, name


def test_places_survive_their_coding():
    r = np.random.default_rng(3)
    for top in (1, 188, 200, 70_000, 1 << 25, 1 << 26):
        places = np.concatenate([r.integers(0, top, 500), [0, top - 1]]).astype(np.int64)
        assert (byte_bpe._places_in(byte_bpe._places_out(places)) == places).all()
    assert len(byte_bpe._places_in(byte_bpe._places_out(np.empty(0, np.int64)))) == 0


def test_texts_of_megabytes(spark):
    """One text of five megabytes and one word of a megabyte through every operator on texts."""
    import public_tokenizers
    import tiktoken

    r = random.Random(12)
    long = " ".join(r.choice(WORDS) + r.choice("abcdefgh") + str(r.randrange(300)) for _ in range(650_000))
    rows = [(1, long, "p"), (2, "x" * 1_000_000, "q"), (3, "the river", "p"), (4, long, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    assert len(long) > 5_000_000
    prints = {x.doc_id: x for x in simhash.near_duplicates(df).collect()}
    assert int(prints[1].fingerprint, 16) == plain_fingerprint(long, 4) and prints[4].component_id == 1
    assert {x.doc_id for x in near_copies.keep_one(df).collect()} == {1, 2, 3}
    found = {x.doc_id: x for x in quality.measures(df).collect()}
    assert (found[1].n_words, found[1].word_chars) == brute_quality(long)[:2] and found[1].n_repeat_words == brute_quality(long)[4] and found[2].n_words == 1
    wanted = {i: ids_of(t, 2) for i, t, _ in rows[:3]}
    pieces: dict = {}
    for p in packing.pack_documents(df.where("doc_id < 4"), word_path()).collect():
        pieces.setdefault(p.doc_id, []).append((p.start, p.ids))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == wanted
    out = new_path(spark, "long")
    read = token_files.read_token_files(spark, out, token_files.write_token_files(df, word_path(), out, end_id=2))
    assert {x.doc_id: x.ids for x in read.collect()} == {**wanted, 4: wanted[1]}
    path = queries.vocabulary(queries.BYTE_BPE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digests = {x.doc_id: x for x in byte_bpe.digests(byte_bpe.encode(df, path, public_tokenizers.PATTERN), path).collect()}
    assert digests[1].ids_sha256 == hashlib.sha256(np.array(coder.encode_ordinary(long), "<u4").tobytes()).hexdigest() and digests[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert digests[2].decoded_sha256 == hashlib.sha256(b"x" * 1_000_000).hexdigest()
    assert {x.doc_id: x.n_pre_tokens for x in token_counts.count_tokens(df, queries.vocabulary(queries.PIECES)).collect()}[1] == 650_000
    assert {x.doc_id: x.lang_pred for x in langid.identify(df, langid.fit(df)).collect()}[1] in ("p", "q")
    assert toxicity.score(df, toxicity.train([np.array([5])], np.array([0]))).count() == 4
