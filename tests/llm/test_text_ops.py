"""Line dedup, tiling, suffix dedup and quality rules against brute force."""

import hashlib
import re
import tempfile
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tessera.llm import induced, line_dedup, near_dedup, quality_rules, suffix_dedup, tiling


def runs_brute(docs, min_lines=3, min_chars=250):
    """(doc, place) of the lines of all windows of 1, 2 or 3 lines that count and stand at an earlier place."""
    first, gone = {}, set()
    for k, t in enumerate(docs):
        s = [x for x in t.split("\n") if x.strip(" ")]
        for i in range(len(s)):
            for d in range(1, min_lines + 1):
                run = tuple(s[i : i + d])
                if len(run) == d and (d == min_lines or sum(map(len, run)) >= min_chars) and first.setdefault(run, (k, i)) != (k, i):
                    gone |= {(k, j) for j in range(i, i + d)}
    return gone


def test_line_dedup_matches_brute_force(make):
    rng = np.random.default_rng(4)
    pool = [f"line {i} " + "x" * int(rng.integers(0, 40)) for i in range(12)] + ["", "  ", "y" * 260]
    docs = ["\n".join(pool[j] for j in rng.integers(0, len(pool), int(rng.integers(0, 14)))) for _ in range(60)]
    got = {(r["_ld_doc"], s) for r in line_dedup.deleted_lines(make(docs)).collect() for s in r["gone"]}
    assert got == runs_brute(docs)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.line_deduplicated(make(docs), drop_emptied=False).collect()}
    for k, t in enumerate(docs):
        n, out = -1, []
        for line in t.split("\n"):
            n += bool(line.strip(" "))
            if not line.strip(" ") or (k, n) not in got:
                out.append(line)
        assert kept[k] == "\n".join(out)


def test_line_dedup_deletes_whole_runs(make, spark):
    long, run = "a" * 299, ["a" * 299, "b" * 105, "c" * 9]
    rng = np.random.default_rng(5)
    pool = [*run, "d" * 150, "e" * 120, "", "f", "g"]
    docs = ["\n".join(run), "\n".join(["x", *run, "y"]), "\n".join([long, "z", "b" * 105])]
    docs += ["\n".join(pool[j] for j in rng.integers(0, len(pool), int(rng.integers(0, 12)))) for _ in range(50)]
    got = {(r["_ld_doc"], s) for r in line_dedup.deleted_lines(make(docs)).collect() for s in r["gone"]}
    assert got == runs_brute(docs) and {s for k, s in got if k == 1} == {1, 2, 3} and {s for k, s in got if k == 2} == {0}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_lines(spark, make(docs), "").collect()}
    assert 0 in kept and kept[1] == "x\ny" and kept[2] == "z\n" + "b" * 105


def test_line_dedup_hard_rows(hard, empty):
    out = line_dedup.line_deduplicated(hard)
    assert out.columns == hard.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[9] == 3 and ids[0] == 1 and ids[None] == 1
    assert ids[7] + ids[8] == 1  # one very long line, copied
    assert line_dedup.line_deduplicated(empty).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_tiling_catches_reordered_passages(make, spark):
    a, b = "alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda mu"
    docs = make([f"x {b} y {a} z", f"X {ITEM.upper()}!", "alpha beta gamma delta", f"{a} and nothing else of it", "clean words only here today", None, ""])
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    for most in (10**6, 0):
        got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in tiling.tilings(docs, bench, most_seeds=most).collect()}
        assert got == {(0, 7): (1.0, 2), (1, 7): (1.0, 1), (3, 7): (0.5, 1)}
    assert sorted(r["doc_id"] for r in tiling.decontaminated(docs, bench, 0.6).collect()) == [2, 3, 4, 5, 6]


def tiles_brute(doc, item, least):
    """Greedy string tiling as defined: longest unmarked common run first, from the left of the document."""
    md, mi, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not md[a + n] and not mi[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return total
        for k in range(n):
            md[a + k] = mi[b + k] = True
        total += n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=24), st.lists(st.integers(0, 3), min_size=3, max_size=12))
def test_tile_matches_definition(doc, item):
    d, i = np.array(doc, np.uint64), np.array(item, np.uint64)
    hits = [(a, b) for a in range(len(doc) - 2) for b in range(len(item) - 2) if doc[a : a + 3] == item[b : b + 3]]
    tiles = tiling.tile(d, i, np.array([h[0] for h in hits], int), np.array([h[1] for h in hits], int), 3) if hits else []
    assert sum(t[2] for t in tiles) == tiles_brute(doc, item, 3)


def suffixes_of(s, n_symbols, folder, memory=64 << 20, step=1 << 16):
    places, same = [], []
    induced.suffixes(s, n_symbols, induced.Scratch(str(folder), memory, step), lambda a, b: (places.append(np.array(a)), same.append(np.array(b))))
    return np.concatenate(places).tolist(), np.concatenate(same).tolist()


def suffixes_brute(s):
    """Descending suffixes, and what each shares with the one before."""
    s = s.tolist()
    order, same = sorted(range(len(s)), key=lambda i: s[i:], reverse=True), [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        same.append(n)
    return order, same


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60) | st.lists(st.integers(1, 900), max_size=60) | st.lists(st.sampled_from([1, 1, 1, 7]), max_size=80), st.sampled_from([(1 << 20, 1 << 16), (300, 3), (0, 1)]), st.booleans())
def test_suffixes_and_common_prefixes(symbols, limits, twice):
    s = np.array([*symbols, *(symbols if twice else []), 0], np.uint16)
    with tempfile.TemporaryDirectory() as folder:
        assert suffixes_of(s, 901, folder, *limits) == suffixes_brute(s)


def test_suffixes_of_long_runs_and_large_alphabets(tmp_path):
    rng = np.random.default_rng(3)
    for s in (np.ones(300), np.arange(1, 600), np.arange(600, 1, -1), rng.integers(1, 2**20, 600), np.tile(rng.integers(1, 90, 150), 4)):
        s = np.append(s, 0).astype(np.int32)
        assert suffixes_of(s, int(s.max()) + 1, tmp_path) == suffixes_of(s, int(s.max()) + 1, tmp_path, 4000, 64) == suffixes_brute(s)


def test_sorting_keeps_to_its_memory(tmp_path):
    """What waits in queues, streams and names stands in files: ten times what is ever in memory."""
    rng = np.random.default_rng(0)
    s = np.memmap(tmp_path / "text", np.int32, "w+", shape=(20_001,))
    s[:-1] = np.concatenate([np.tile(rng.integers(1, 60, 5_000), 2), rng.integers(1, 60, 10_000)])
    scratch, seen, most = induced.Scratch(str(tmp_path), 4_000, 128), [0, 0], [0]

    def emit(at, same):
        seen[0] += len(at)
        seen[1] += int((same >= 4_000).sum())

    written = [0]
    write = induced.Parts.write
    induced.Parts.write = lambda self, a: (written.__setitem__(0, written[0] + a.nbytes), write(self, a))[1]
    tracemalloc.start()
    try:
        induced.suffixes(s, 60, scratch, emit)
        most[0] = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        induced.Parts.write = write
    assert seen[0] == 20_001 and seen[1] >= 1_001 and written[0] > 10 * most[0], (written, most)


def bytes_brute(texts, span=200):
    raw, seen = [(t or "").encode() for t in texts], Counter()
    for r in raw:
        seen.update(r[i : i + span] for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) > 0).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def test_suffix_dedup_matches_brute_force(make):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdeéü \n"), n))
    shared = [word(int(n)) for n in rng.integers(150, 420, 8)]
    texts = [word(int(rng.integers(0, 300))) + shared[rng.integers(8)][int(rng.integers(0, 60)) :] + word(int(rng.integers(0, 200))) + shared[rng.integers(8)] for _ in range(40)]
    texts += [texts[3], texts[3], "a" * 900, "a" * 199, "a" * 200, "ab" * 150, None, "", word(5000)]
    rows = suffix_dedup.byte_deduplicated(make(texts), whole=True).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [got[k] for k in range(len(texts))] == bytes_brute(texts)
    split = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.byte_deduplicated(make(texts), hot=2).collect()}
    assert split == got  # anchors split by longer context, twice
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)


def test_suffix_dedup_of_two_texts_with_one_tag(make):
    """Two texts whose content hashes begin with the same 31 bits still find what they share."""
    rng, seen = np.random.default_rng(5), {}
    shared = "".join(rng.choice(list("abcdefgh "), 605))
    for k in range(1 << 20):
        tag = xxhash.xxh64_intdigest((shared + str(k)).encode(), 42) >> 33
        if tag in seen:
            break
        seen[tag] = k
    got = suffix_dedup.byte_deduplicated(make([shared + str(seen[tag]), shared + str(k)])).collect()
    assert all(r["n_removed"] >= 605 for r in got)


def thue_morse(n):
    """Two texts that polynomial hashes modulo a power of two cannot tell apart."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 4096])
def test_unequal_lines_words_and_windows_stay_unequal(make, spark, n):
    a, b = thue_morse(n)
    plain = " ".join(f"w{i}" for i in range(30))
    got = quality_rules.repetition_rules(make([f"{a} x {a}\n{b} x {b}\n{plain}", f"{a}\n{b}\n{plain}", f"{a}\n{a}\n{plain}"])).orderBy("doc_id").collect()
    assert [r["n_dup_lines"] for r in got] == [0, 0, 1]
    item = f"one two {a} three four"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make([f"z one two {b} three four z", f"z {item} z"])
    for most in (10**6, 0):
        assert [r["doc_id"] for r in tiling.tilings(docs, bench, most_seeds=most).collect()] == [1]
    texts = [f"p q {x} r {y} s" for x in (a, b) for y in (a, b)]
    assert {r["class_id"] for r in near_dedup.near_classes(make([f"{t} {plain[:6]}" for t in texts])).collect()} == {0, 1, 2, 3}


def test_words_are_cut_at_unicode_punctuation(make, spark):
    item = "これは日本語の長い文章です。そして続きます"
    bench = spark.createDataFrame([(1, item), (2, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = make([f"前書き：{item}！", "alpha—beta\u00a0gamma\u3000delta “epsilon”", "これは別の文です"])
    assert {(r["doc_id"], r["item_id"]) for r in tiling.leaks(docs, bench).collect()} == {(0, 1), (1, 2)}


def test_suffix_dedup_hard_rows(hard, empty):
    got = suffix_dedup.byte_deduplicated(hard).collect()
    assert len(got) == hard.count()
    long = [r for r in got if r["doc_id"] in (7, 8)]
    assert all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 for r in long)
    assert suffix_dedup.byte_deduplicated(empty).count() == 0


def quality_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, seen, dup = len(words), set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    inside = set()
    for i in range(n - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(map(len, words)), symbols, dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_rules_match_brute_force(make):
    rng = np.random.default_rng(2)
    pool = ["a", "bé", "c#", "\n", "d\ne", "|x|", "日本", " ", "\t", "\x0b"]
    texts = [" ".join(pool[i] for i in rng.integers(0, int(rng.integers(2, len(pool))), int(rng.integers(0, 200)))) for _ in range(80)] + [None, "", " \n ", "one two"]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality_rules.repetition_rules(make(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [quality_brute(t) for t in texts]


def test_quality_rules_keep_plain_and_drop_repeated(make, hard, empty):
    rng = np.random.default_rng(0)
    plain = " ".join("w%d" % i for i in rng.integers(0, 5000, 400))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.repetition_rules(make([plain, ("buy this now at once " * 60), plain + "\n" + plain])).collect()}
    assert kept == {0: True, 1: False, 2: False}
    assert quality_rules.repetition_rules(hard).count() == hard.count()
    assert quality_rules.repetition_rules(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5])
def test_chunks_bounds(n):
    from tessera.llm import textnum as T

    off = np.arange(n + 1) * 3
    assert [(a, b) for a, b, _ in T.chunks(np.zeros(3 * n, np.uint8), off, 6)] == [(a, min(n, a + 2)) for a in range(0, n, 2)]
