"""WARC, tool calls, tokens, near duplicates, models and the pipeline."""

import base64
import hashlib
import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, langid_cnn, near_dedup, tool_calls, toxicity, warc
from tessera.llm import textnum as T
from tessera.llm.common import held_out, shared_dir
from test_text_ops import runs_brute, tiles_brute


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark):
    html = ["a\r\n\r\nWARC/1.1\r\nb", "", None, "a\r\n\r\nWARC/1.1\r\nb", "ü" * 70_000, "x", "x"]
    df = pages(spark, [(i, f"http://h/{i}\n?q", h, "clash") for i, h in enumerate(html)] + [(None, None, "x", None), (5, "http://again", "x", None)])
    folder = shared_dir(spark)
    warc.write_archives(df, folder)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == 9
    by = {r["page_id"]: r for r in got if r["page_id"] not in (None, 5)}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        if i in by:
            assert by[i]["payload_bytes"] == len(raw) and by[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(i, by[i]["record_type"], by[i]["refers_to"]) for i in sorted(by)] == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (3, "revisit", 0), (4, "response", None), (6, "revisit", 5)]
    assert [r["record_type"] for r in got if r["page_id"] in (None, 5)] == ["response"] * 3
    ids = {r["record_id"] for r in got if r["page_id"] == 0}
    assert len(ids) == 1 and by[0]["url"] == "http://h/0%0A?q"


def test_warc_small_payloads_and_empty_table(spark):
    df = pages(spark, [(0, "u", "ab", None), (1, "u", "ab", None), (2, "u", "abcd", None), (3, "u", "abcd", None)])
    a, b = shared_dir(spark), shared_dir(spark)
    warc.write_archives(df, a, min_bytes=3)
    assert Counter(r["record_type"] for r in warc.read_archives(spark, a).collect()) == {"response": 3, "revisit": 1}
    warc.write_archives(df.limit(0), b)
    assert warc.read_archives(spark, b).count() == 0


def test_tool_calls(spark):
    call = lambda i, args, refs=(): "text <tool_call>" + json.dumps({"id": i, "name": "f", "arguments": args, "refs": list(refs)}) + "</tool_call>"
    rows = [
        (1, 0, "assistant", call("a", {"y": 1, "x": "é"})), (1, 1, "tool", json.dumps({"id": "a", "content": "done"})), (1, 2, "assistant", call("b", {"x": 3}, ["c"])),
        (1, 3, "assistant", call("c", {"x": "q", "z": 0}, ["d"])), (1, 4, "assistant", call("d", {"x": "w"})), (1, 5, "tool", json.dumps({"id": "nobody", "content": "?"})),
        (2, 0, "assistant", call("p", {"x": "1"}, ["q"])), (2, 1, "assistant", call("q", {"x": "2"}, ["p"])), (3, 0, None, None), (None, 0, "tool", None),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS level")
    schema = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "string"}, "y": {"type": "integer", "minimum": 0}}}}
    got = {r["call_id"]: r for r in tool_calls.linked(*tool_calls.parsed_calls(messages), schema).collect() if r["call_id"]}
    assert got["a"]["valid"] and got["a"]["json"] == '{"arguments":{"x":"é","y":1},"id":"a","name":"f","result":"done"}'
    assert (got["b"]["valid"], got["c"]["valid"]) == (False, False) and "unknown" in got["c"]["error"]
    assert got["d"]["level"] < got["c"]["level"] < got["b"]["level"]
    assert got["p"]["level"] is None and got["q"]["level"] is None
    assert got["nobody"]["status"] == "no_call" and got["d"]["status"] == "no_result"
    assert tool_calls.linked(*tool_calls.turn_calls(messages.limit(0)), schema).count() == 0


def test_tool_calls_keep_every_result(spark):
    calls = spark.createDataFrame([(1, 0, "a", "f", "{}", []), (1, 1, "b", "f", "{}", []), (1, 2, None, "f", "{}", []), (1, 2, "a", "f", "{}", [])], "conv_id long, turn long, call_id string, name string, arguments string, refs array<string>")
    rows = [(1, 3, "a", "x"), (1, 4, "a", "y"), (1, 4, "a", "y"), (1, 5, None, "p"), (1, 6, None, "q"), (1, 6, None, "q"), (1, 7, "z", "s"), (1, 8, "z", "t"), (None, 9, "a", "u"), (2, 3, "a", None)]
    results = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, content string")
    got = Counter((r["status"], r["conv_id"], r["call_id"], r["turn"], r["result_turn"], r["n_results"], json.loads(r["json"])["result"]) for r in tool_calls.linked(calls, results, {"f": {}}).collect())
    want = [("linked", 1, "a", t, *x) for t in (0, 2) for x in ((3, 3, "x"), (4, 3, "y"), (4, 3, "y"))]
    want += [("no_result", 1, "b", 1, None, 0, None), ("no_result", 1, None, 2, None, 0, None)]
    want += [("no_call", 1, None, None, 5, 1, "p"), ("no_call", 1, None, None, 6, 1, "q"), ("no_call", 1, None, None, 6, 1, "q")]
    want += [("no_call", 1, "z", None, 7, 2, "s"), ("no_call", 1, "z", None, 8, 2, "t"), ("no_call", None, "a", None, 9, 1, "u"), ("no_call", 2, "a", None, 3, 1, None)]
    assert got == Counter(want)


def test_tool_calls_strict_json_and_clashing_columns(spark):
    bad = ["NaN", '{"x":Infinity}', '{"x":1e400}', '{"x":"\\ud800"}', "[" * 100_000, "", None, "{"]
    long = json.dumps({"x": "é" * 300_000})
    args = [*bad, '{"b":1,"a":2,"b":3}', long, long]
    calls = spark.createDataFrame([(1, k, f"c{k}", "f", a, [f"c{k + 1}"], 7, "e", "j") for k, a in enumerate(args)], "conv_id long, turn long, call_id string, name string, arguments string, refs array<string>, level long, error string, json string")
    results = spark.createDataFrame([(1, 50, "c0", "r", 1, 2)], "conv_id long, turn long, call_id string, content string, level long, n_results long")
    got = sorted(tool_calls.linked(calls, results, {"f": {}}).collect(), key=lambda r: r["turn"])
    assert [r["valid"] for r in got] == [False] * len(bad) + [True] * 3
    assert all(json.loads(r["json"], parse_constant=lambda x: 1 / 0)["arguments"] is None for r in got[: len(bad)])
    assert got[len(bad)]["json"].startswith('{"arguments":{"a":2,"b":3}') and len(got[-1]["json"]) > 300_000
    assert [r["level"] for r in got] == [2 * (len(args) - 1) - k for k in range(len(args))]  # every call refers to the next


def reference():
    raw, pattern = bpe.public_ranks()
    enc = bpe.encoder(raw, pattern)
    return enc, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=enc.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300) | st.text("ab ", max_size=300) | st.text("thein'aé日\n ", max_size=300))
def test_bpe_equals_the_library(text):
    enc, ref = reference()
    got = enc.encode_all([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == ref.encode_ordinary(text) and enc.decode(got) == text.encode()


def test_bpe_ranks_that_are_out_of_order():
    """A pair of a merged token may rank below it; ids equal the library's."""
    pieces = [b"ab", b"abc", b"bc", b"ca", b"cab", b"aa", b"bca"]
    for seed in range(30):
        order = np.random.default_rng(seed).permutation(len(pieces))
        ranks = {bytes([b]): b for b in range(256)} | {pieces[k]: 256 + int(r) for k, r in enumerate(order)}
        enc, ref = bpe.BytePairEncoder(ranks, r"\S+|\s+"), tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        for t in ("".join(np.random.default_rng(n).choice(list("abc"), 50)) for n in range(20)):
            assert np.frombuffer(enc.encode_all([t])[0], "<u4").tolist() == ref.encode_ordinary(t)


def test_bpe_rows(hard, empty):
    _, ref = reference()
    got = bpe.byte_bpe(hard, *bpe.public_ranks(), tokens=True).collect()
    texts = [r["text"] or "" for r in hard.collect()]
    assert Counter((r["decoded_sha256"], r["n_tokens"]) for r in got) == Counter((hashlib.sha256(t.encode()).hexdigest(), len(ref.encode_ordinary(t))) for t in texts)
    assert bpe.byte_bpe(empty, *bpe.public_ranks()).count() == 0


def own_shingles(text):
    """Counted runs of five lower-cased words, or the whole of a shorter text."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def jaccard_pairs(texts, like=0.8):
    """All pairs of a weighted Jaccard similarity of ``like`` or more, by an inverted index."""
    sets = [own_shingles(t) for t in texts]
    df = Counter(x for s in sets for x in s)
    w = {x: math.log1p(sum(map(bool, sets)) / n) for x, n in df.items()}
    total = [sum(w[x] * n for x, n in s.items()) for s in sets]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x, n in s.items():
            where[x].append((k, n))
    out = set()
    for k, s in enumerate(sets):
        both = Counter()
        for x, n in s.items():
            for j, m in where[x]:
                if j < k:
                    both[j] += w[x] * min(n, m)
        out |= {(j, k) for j, v in both.items() if v >= like * (total[j] + total[k] - v)}
    return out


def classes_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def jaccard_classes(texts, like=0.8):
    return classes_of(len(texts), jaccard_pairs(texts, like))


def test_near_classes_of_a_table_against_all_pairs(spark):
    """Recall of the links of 0.8 and above, and no link below."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    pairs = jaccard_pairs(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_classes(docs).collect()}
    found = sum(got[ids[a]]["class_id"] == got[ids[b]]["class_id"] for a, b in pairs)
    assert len(pairs) > 50 and found >= 0.99 * len(pairs)
    want = classes_of(len(texts), pairs)
    assert all(want[k] == want[ids.index(got[i]["class_id"])] for k, i in enumerate(ids))


def test_near_classes_of_repeated_ids(make):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    docs = make([text(0), text(1), text(0), text(2), text(0), None, text(3), text(3)], [3, 9, 9, 9, None, 9, None, None])
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_dedup.near_classes(docs).collect())
    assert got == Counter({(3, 3, 0): 1, (9, 9, 0): 3, (9, 3, 0): 1, (None, 3, 0): 1, (None, None, 0): 2})
    assert Counter(r["text"] for r in near_dedup.deduplicated(docs).collect()) == Counter([text(0), text(1), text(2), None, text(3)])


def test_near_classes_match_brute_force(make):
    rng = np.random.default_rng(7)
    base = [[f"w{x}" for x in rng.integers(0, 9000, 150)] for _ in range(12)]
    texts = []
    for _ in range(160):
        t = list(base[rng.integers(12)])
        for _ in range(int(rng.integers(0, 9))):
            t[rng.integers(len(t))] = f"v{rng.integers(10**6)}"
        texts.append(" ".join(t))
    texts += [texts[0], "one two three", "One, two three!", "one two", None, "", ""]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(make(texts)).collect()}
    want = jaccard_classes(texts)
    assert sum(got[k] != want[k] for k in range(len(texts))) <= 1  # banding may miss a pair near 0.8 (p < 0.001)


def true_similarity(texts, a, b):
    """Weighted Jaccard similarity of two texts, by TF-IDF of their five-word shingles themselves."""
    sets = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    df = Counter(x for s in sets for x in s)
    keys = set(sets[a]) | set(sets[b])
    return sum(min(sets[a][k], sets[b][k]) * np.log1p(len(sets) / df[k]) for k in keys) / sum(max(sets[a][k], sets[b][k]) * np.log1p(len(sets) / df[k]) for k in keys)


def test_near_classes_weigh_by_true_frequency(make):
    """With over a million shingles a bucket's frequency is far above that of its shingles, and common passages looked alike."""
    n = iter(range(10**9))
    new = lambda k: [f"w{next(n)}" for _ in range(k)]
    passage = new(2400)
    texts = [" ".join(passage + new(66)) for _ in range(200)] + [" ".join(new(3000)) for _ in range(200)]
    texts.append(" ".join(texts[399].split()[:2900] + new(20)))
    assert true_similarity(texts, 0, 1) < 0.79 and true_similarity(texts, 399, 400) > 0.9
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(make(texts)).collect()}
    assert got == {k: min(k, 399) for k in range(401)}


def test_near_copies_of_a_group_in_a_large_table(make):
    """By unbounded idf the edits of each copy weigh more than the text that eight copies share, and all pairs fall below 0.8."""
    n = iter(range(10**9))
    new = lambda k: [f"w{next(n)}" for _ in range(k)]
    passage = new(204)
    texts = [" ".join(passage + new(22)) for _ in range(8)] + [" ".join(new(6)) for _ in range(8000)]
    sets = [own_shingles(t) for t in texts]
    df = Counter(x for s in sets for x in s)
    weight = lambda keys: sum(math.log1p(len(texts) / df[x]) for x in keys)
    a, b = set(sets[0]), set(sets[1])
    assert len(a & b) / len(a | b) > 0.81 and weight(a & b) / weight(a | b) < 0.79
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(make(texts)).collect()}
    assert got == {k: 0 if k < 8 else k for k in range(len(texts))}


def test_document_frequencies_are_exact(make):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), int(rng.integers(0, 400)))) for _ in range(600)] + [None, "same text of exactly six"] * 300
    low = pa.array([t or "" for t in texts], pa.large_string())
    _, h, count, _ = near_dedup.shingles(near_dedup.Words(*T.buffers(low)))
    h >>= np.uint64(32)  # as in the rows
    want, n = Counter(h.tolist()), sum(bool(t) for t in texts)
    rows, n_texts = near_dedup.weighted(near_dedup.lowered(make(texts)))
    for rows in (rows, near_dedup.with_frequency(near_dedup.packs(near_dedup.lowered(make(texts)), 7))):
        seen, tf = Counter(), 0
        for r in rows.toArrow().to_pylist():
            hs = np.frombuffer(r["h"], np.uint32)
            df, many = (near_dedup.decoded(pa.scalar(r[c], pa.binary()), len(hs)).tolist() for c in ("df", "tf"))
            assert [want[x] for x in hs.tolist()] == df
            seen.update(hs.tolist())
            tf += sum(many)
        assert seen == want and tf == count.sum() and n_texts == n
    assert max(want.values()) > 255


def test_near_dedup_hard_rows(hard, empty):
    out = near_dedup.deduplicated(hard)
    ids = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == hard.columns and ids[7] + ids[8] == 1 and ids[9] == 2 and ids[None] == 1 and ids[0] == ids[1] == 1
    assert near_dedup.near_classes(hard).count() == hard.count()
    assert near_dedup.deduplicated(empty).count() == 0


def test_weighted_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 300, dtype=np.uint64)
    w = rng.random(300).astype(np.float32) + 0.5
    a, b = np.arange(0, 240), np.arange(40, 300)
    want = w[40:240].sum() / w.sum()
    odds = near_dedup._odd
    near_dedup._odd = rng.integers(1, 2**62, 600, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    try:
        s = near_dedup.samples(np.concatenate([h[a], h[b]]), np.log(np.concatenate([w[a], w[b]])), np.array([0, len(a), len(a) + len(b)]))
    finally:
        near_dedup._odd = odds
    assert abs((s[0] == s[1]).mean() - want) < 0.06


LANG = {"en": ["the", "and", "thing", "with"], "de": ["ü", "sch", "keit", "und"], "fr": ["é", "eau", "tion", "le"]}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(LANG[lang], int(rng.integers(1, 4)))) for _ in range(n))


def test_language_cnn(make, hard, empty):
    rng = np.random.default_rng(0)
    langs = [x for x in LANG for _ in range(60)]
    docs = make([tongue(rng, x, int(rng.integers(20, 120))) for x in langs], None, langs)
    apart = held_out("doc_id", 3, 1)
    model = langid_cnn.fit_languages(docs, ~apart)
    rows = langid_cnn.identify(docs, model, apart).collect()
    told = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(told) > 30 and np.mean(told) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["row"]["text"]: r["lang_pred"] for r in langid_cnn.identify(hard, model, rows=True).collect()}
    assert got[None] == got[""] == got["?!"] == "und" and got["é"] != "und"
    assert {r["lang_pred"] for r in langid_cnn.identify(hard, None).collect()} == {"und"}
    assert langid_cnn.fit_languages(empty, ~apart) is None and langid_cnn.identify(empty, model).count() == 0


def test_toxicity(make, spark, hard, empty):
    rng = np.random.default_rng(0)
    bad, plain = ["moronic", "scumbag", "worthless"], [f"{a}{b}" for a in "ab cd ef gh ij kl".split() for b in "mn op qr st uv".split()]
    toxic = [int(x) for x in rng.random(600) < 0.2]
    texts = [" ".join([*rng.choice(plain, 60), *(rng.choice(bad, 3) if x else [])]) for x in toxic]
    docs, apart = make(texts), held_out("doc_id", 5, 0)
    labels = spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic)] + [(10**6, 1, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, ~apart)
    rows = [r for r in toxicity.toxicity(docs, model, apart).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in rows]) > 0.95
    twice = docs.unionByName(docs.filter("doc_id < 9").withColumn("text", F.lit(None).cast("string")))
    assert len(toxicity.toxicity(twice, toxicity.train(twice, labels.union(labels), ~apart), apart).collect()) == 609
    got = toxicity.toxicity(hard, model).collect()
    assert len(got) == hard.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(empty, model).count() == 0
    assert {r["score"] for r in toxicity.toxicity(hard, toxicity.train(docs, labels.limit(0), ~apart)).collect()} == {0.0}


def test_pipeline(spark, make, tmp_path):
    rng = np.random.default_rng(3)
    langs = [list(LANG)[k % 3] for k in range(60)]
    texts = [tongue(rng, x, 80) for x in langs]
    item = " ".join(f"bench{k}" for k in range(20))
    texts += [texts[0], texts[1].replace(" ", "  ", 3), texts[2] + " " + item, "123 !!", None, "", "same line of text\n" * 2]
    docs = make(texts, None, [*langs, *["en"] * 7])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, str(tmp_path))
        assert stages.columns == docs.columns, name
    ids = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert ids == [*range(60), 66]


def pipeline_brute(docs, items):
    """Token ids by doc_id of the documents that stay: every stage by its definition."""
    docs = {i: t for i, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    ids, texts, gone = list(docs), list(docs.values()), None
    gone, lined = runs_brute(texts), {}
    for k, t in enumerate(texts):
        n, kept = -1, []
        for line in t.split("\n"):
            n += bool(line.strip(" "))
            if not line.strip(" ") or (k, n) not in gone:
                kept.append(line)
        if "\n".join(kept).strip(" \n") or kept == t.split("\n"):
            lined[ids[k]] = "\n".join(kept)
    ids, texts = list(lined), list(lined.values())
    classes = classes_of(len(texts), jaccard_pairs(texts))
    _, ref = reference()
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = {}
    for k, (i, t) in enumerate(zip(ids, texts)):
        if classes[k] == k and not any(tiles_brute(words(t), words(x), 5) >= 0.5 * len(words(x)) for x in items):
            out[i] = ref.encode_ordinary(t)
    return out


def test_pipeline_against_brute_force(spark, make, tmp_path):
    """Stages in a row: letters, repeated lines of other documents, near copies, reordered benchmark passages, tokens."""
    rng = np.random.default_rng(11)
    langs = [list(LANG)[k % 3] for k in range(40)]
    texts = ["\n".join(tongue(rng, x, 24) for _ in range(4)) for x in langs]
    shared = "\n".join(f"shared line number {k} of a license text" for k in range(3))
    item = " ".join(f"bench{k}" for k in range(24))
    moved = " ".join(f"bench{k}" for k in [*range(12, 24), *range(12)])
    texts += [texts[0] + "\n" + shared, shared + "\n" + texts[1], shared, texts[2].replace(" ", "  ", 2), texts[3] + " extra", f"{tongue(rng, 'en', 30)} {moved}", "only 5 of bench0 bench1 bench2", "12 34 !", "", None]
    for t in ("x" * 260, "y" * 260):
        texts += [t + "\n" + tongue(rng, "de", 40), tongue(rng, "fr", 40) + "\n" + t]
    langs += ["en"] * (len(texts) - len(langs))
    make(texts, None, langs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == pipeline_brute(dict(enumerate(texts)), [item])


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_hard_rows(spark, hard, empty, tmp_path, k):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (hard, empty):
        out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        if k == 4:
            assert out.count() == docs.count()
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()
