"""Operators over whole tables, against brute force."""

import importlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomstone.llm import chat, decontam, embed_join, jaccard, queries, toxicity, warc
from loomstone.llm.components import brute_components, components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def small_sketch(monkeypatch):
    """Small tables need few counters; some tokens then share one, which must not matter."""
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 12)


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        k = min(8, len(w))
        for j in range(len(w) - k + 1) if k and i is not None else ():
            windows[tuple(w[j : j + k])].add(str(i))
    out = []
    for d, t in docs:
        w = word.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if got := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= got
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def edge_texts():
    base = " ".join(f"word{i}" for i in range(30))
    return [None, "", "...", base, base, base.upper(), "x " * 5000 + base, "word0 word1", "word0", base.replace("word9", "other"), "é ü " + base[:80], base + " " + base]


def test_decontamination(spark):
    items = [(1, " ".join(f"word{i}" for i in range(5, 25))), (2, "word0 word1"), (10, "WORD3 word4, word5-word6 word7 word8 word9 word10 word11"), (11, None), (12, "  "), (None, "word1"), (2, "word29"), (3, "é ü word0")]
    docs = list(enumerate(edge_texts()))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_hit")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    assert sorted(tuple(r) for r in decontam.contamination(d, b).collect()) == want
    kept = {r["doc_id"] for r in decontam.decontaminate(d, b).collect()}
    assert kept == {i for i, _, hit, _ in want if hit < 8}
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(d, b.limit(0)).collect()} == {0}
    old = decontam.BLOCK_BYTES
    decontam.BLOCK_BYTES = 80
    try:
        assert sorted(tuple(r) for r in decontam.contamination(d.unionByName(d), b).collect()) == sorted(want + want)
        assert {r["doc_id"] for r in decontam.decontaminate(d, b, min_hit=1).collect()} == {i for i, _, hit, _ in want if not hit}
    finally:
        decontam.BLOCK_BYTES = old


def test_decontamination_over_blocks(spark, monkeypatch):
    """Words hit by items of several blocks count together."""
    d = spark.createDataFrame([(1, "a b c d e x f g h i j", 5), (2, "a b c d e x a b c", 5), (3, None, 5)], "doc_id long, text string, n long").coalesce(1)
    b = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "item_id long, text string").coalesce(1)
    for size in (decontam.BLOCK_BYTES, 5):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = decontam.decontaminate(d, b)
        assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 3]


def test_decontamination_on_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in queries.QUERIES["op1_decontamination"](spark, DATA).collect())
    assert got == [(d, n, h, len(i), len(i) >= 2) for d, n, h, i in brute_contamination(docs, items)]


def test_longest_matches(spark):
    d = spark.createDataFrame([(7, "a b c d e f g h i j zz"), (8, "q")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x a b c d e f g h i j y")], "item_id long, text string")
    assert [tuple(r) for r in decontam.longest_matches(d, b).collect()] == [(7, "1", 1, 0, 10)]


def test_longest_matches_do_not_depend_on_slices(spark, monkeypatch):
    """Every match that goes on to neither side, against a plain search, whatever shares a slice."""
    rng = random.Random(12)
    words = ["w0", "w1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(2, 40)))) for i in range(8)]
    docs = [(i, " ".join(rng.choice([*words, "other"]) for _ in range(rng.randrange(0, 60)))) for i in range(30)] + [(30, items[0][1]), (31, items[0][1][3:] + " w1"), (32, None)]
    want = set()
    for d, text in docs:
        x = (text or "").split()
        for i, item in items:
            y = item.split()
            for p in range(len(x)):
                for q in range(len(y)):
                    if p and q and x[p - 1] == y[q - 1]:
                        continue
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= min(8, len(y)):
                        want.add((d, str(i), q, p, n))
    assert len(want) > 5
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for parts in (1, 7):
        got = [tuple(r) for r in decontam.longest_matches(rows.repartition(parts), bench).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_words_of_one_hash(spark, monkeypatch):
    """A word that shares its hash with one of the benchmark is told apart."""
    real = decontam.words_of

    def weak(raw, offsets, word):
        starts, ends, hashes, first = real(raw, offsets, word)
        same = np.array([raw[a:b].tobytes() in (b"alpha", b"omega") for a, b in zip(starts, ends, strict=True)], dtype=bool)
        return starts, ends, np.where(same, np.uint64(77), hashes), first

    monkeypatch.setattr(decontam, "words_of", weak)
    bench = decontam.Benchmark(["1"], pa.array(["a b c d alpha e f g"]))
    for text, want in (("x a b c d alpha e f g y", 8), ("x a b c d omega e f g y", 0), ("a b c d omega e f g a b c d alpha e f g", 8)):
        hit, items = decontam.Shard(pa.array([text]), bench).hits()
        assert (int(hit.sum()), items) == (want, [[0]] if want else [[]])


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array(seed):
    rng = random.Random(seed)
    s = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 60))])
    order = decontam.suffix_array(s, len(s))
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_jaccard(docs, percent=85):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for d, t in docs:
        w = word.findall((t or "").translate(LOW))
        sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = brute_components(list(sets), links)
    return [(d, len(sets[d]), found[d]) for d in sorted(sets)]


def near_copies(seed=1, groups=12, noise=60):
    """Chains of texts that lose similarity step by step, copies, shared passages, short texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(40)
    texts = [None, "", "   ", "one", "One", "one two", "one two three four"]
    for _ in range(groups):
        now = fresh(rng.randrange(8, 120))
        for _ in range(rng.randrange(2, 9)):
            texts.append(" ".join(now))
            now = list(now)
            for _ in range(rng.randrange(0, max(2, len(now) // 20))):
                now[rng.randrange(len(now))] = fresh(1)[0]
        texts += [texts[-1], texts[-1].upper()]
    for _ in range(noise):
        texts.append(" ".join(fresh(rng.randrange(1, 30)) + passage))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("common", [8, 0])
def test_jaccard(spark, common, monkeypatch):
    """Also where nearly every token is taken for a common one."""
    monkeypatch.setattr(jaccard, "COMMON_PAIRS", common)
    monkeypatch.setattr(jaccard, "COMMON_DEVIATIONS", 6.0 if common else 0.0)
    docs = near_copies(common + 1)
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS c", "2 AS component_id", "3 AS n")
    want = brute_jaccard(docs)
    assert len({w[2] for w in want}) < len(want)
    got = sorted(tuple(r) for r in jaccard.ngram_jaccard(rows.repartition(5)).collect())
    assert got == want
    kept = jaccard.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.ngram_jaccard(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.ngram_jaccard(rows).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert sorted(r["doc_id"] for r in jaccard.keep_one(rows).collect()) == [1, 3]


def test_jaccard_of_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (None, "v w x y z"), (None, "q r s t u"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.ngram_jaccard(rows).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, None), (None, 0, None)], key=str)


def test_odd_sketch():
    """It never differs in more buckets than sets do in tokens, whatever their sizes."""
    rng = np.random.default_rng(5)
    for n, m, shared in ((40, 50, 30), (500, 3000, 400), (60000, 20, 10), (1, 1, 1), (700, 700, 650)):
        tokens = rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
        a, b = tokens[:n], tokens[n - shared :]
        assert jaccard.odd_buckets(jaccard.odd_sketch(a), jaccard.odd_sketch(b)) <= n + m - 2 * shared


def test_jaccard_of_few_words(spark):
    """A slice may hold fewer words than a shingle."""
    for n in range(7):
        text = " ".join(f"w{i}" for i in range(n))
        assert [len(s) for s in jaccard.shingle_sets(pa.array([text]))] == [max(min(n, 1), n - 3)]
    rows = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.ngram_jaccard(rows).collect()] == [(1, 1, 1)]


def test_jaccard_on_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op5_ngram_jaccard"](spark, DATA).collect()) == brute_jaccard(docs)


@pytest.mark.parametrize("most", [0, 10**6])
def test_components(spark, most, monkeypatch):
    monkeypatch.setattr(importlib.import_module("loomstone.llm.components"), "TASK_LINKS", most)
    rng = random.Random(4)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    want = brute_components(sorted({x for p in links for x in p}), links)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"PIVOT_BYTES": 3 * 8 * 12, "CELLS": 0, "BATCH_BYTES": 8 * 12 * 5}, {"LABELS": 1}])
def test_embeddings(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(embed_join, name, value)
    monkeypatch.setattr(embed_join, "CELL", 40)
    monkeypatch.setattr(embed_join, "BLOCK", 30)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 12))
    rows = []
    for i in range(400):
        v = base[rng.integers(60)] + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.12, 0.25])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    hot = rng.normal(size=12)
    rows += [(400 + i, (hot + rng.normal(size=12) * 0.01).astype(np.float32).tolist(), 1) for i in range(150)]
    rows += [(900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] + [1.0] * 11, 1), (904, [None] + [1.0] * 11, 1), (905, hot.tolist(), None), (906, [], 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1)]
    v = {i: (np.array(x, float), y) for i, x, y in rows if x and None not in x and y is not None and np.isfinite(x).all() and any(x)}
    links = [(a, b) for a, b in itertools.combinations(v, 2) if v[a][1] == v[b][1] and len(v[a][0]) == len(v[b][0]) and v[a][0] @ v[b][0] / np.linalg.norm(v[a][0]) / np.linalg.norm(v[b][0]) >= 0.98]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    comp = brute_components([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS node", "3 AS n_links")
    got = sorted(tuple(r) for r in embed_join.embedding_near_dedup(df).collect())
    assert got == [(i, degree[i], comp[i], comp[i] == i) for i in sorted(r[0] for r in rows)]
    assert embed_join.embedding_near_dedup(df.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    """Learnt labels carry over to rows that were not learnt from; offending sentences hold a learnt word."""
    rng = random.Random(9)
    bad = ["scum", "moron", "trash"]
    docs, labels = [], []
    for i in range(1200):
        words = [[f"w{rng.randrange(300)}" for _ in range(8)] for _ in range(rng.randrange(1, 6))]
        y = i % 4 == 0
        if y:
            rng.choice(words).append(rng.choice(bad))
        docs.append((i, ". ".join(" ".join(w) for w in words) + "."))
        labels.append((i, int(y)))
    docs += [(5000, None), (5001, ""), (5002, "..."), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS score")
    model = toxicity.train(d, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == y for i, y in held) / len(held) > 0.95
    assert all(got[i]["score"] == 0 for i in (5000, 5001, 5002))
    text = dict(docs)
    for i, y in held[:60]:
        for s in got[i]["offending"]:
            assert any(w in text[i][s["start"] : s["end"]] for w in bad) or not y
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == 0}
    none = toxicity.train(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.toxicity(d, none).collect()} == {0}


def brute_repair(roles):
    """The least cost over all sequences of options."""
    best = chat.INFINITE
    stack = [(0, chat.START, 0)]
    while stack:
        i, state, cost = stack.pop()
        if i == len(roles):
            best = min(best, cost + chat.END_COST[state])
            continue
        stack += [(i + 1, nxt, cost + c) for c, nxt, _, _ in chat.OPTIONS[state][roles[i]]]
    return best


def legal(rendered):
    turns = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", rendered, re.DOTALL)
    names = [t[0] for t in turns]
    body = names[1:] if names[:1] == ["system"] else names
    return "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in turns) == rendered and body == ["user", "assistant"] * (len(body) // 2) and body


def test_chat(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn if rng.random() < 0.9 else 0, rng.choice(["user", "assistant", "system", "bot", "Human", None, "?"]), rng.choice(["hi", "", None, "text"])))
    rows += [(500, t, rng.choice(["user", "assistant", "system"]), f"t{t}") for t in range(400)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (1, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.format_chats(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows)
    mine = defaultdict(list)
    for r in rows:
        mine[r[0]].append(r[1:])
    first = lambda v: (v is not None, v)
    out = defaultdict(list)
    for r in got:
        out[r["conv"]].append(r)
    for conv, turns in mine.items():
        turns.sort(key=lambda t: [first(x) if x is not None else (False,) for x in t])
        roles = [chat.role_state(t[1]) for t in turns]
        want = chat.repair(roles, [t[2] for t in turns])
        assert sorted((w[0], w[1], w[2], w[3], w[4]) for w in want) == sorted((r["action"], r["out_role"], r["out_turn"], r["cost"], r["piece"]) for r in out[conv])
        assert legal("".join(w[4] for w in want))
        if len(roles) <= 6:
            assert sum(w[3] for w in want) == brute_repair(roles)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_warc(spark):
    rec = "record_id long, url string, captured long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    rng = random.Random(8)
    rows = []
    for i in range(600):
        url = rng.choice(["http://A.com/x/", "https://a.com/x?utm_source=q", "a.com/x", "http://b.org/?b=1&a=2", "http://b.org?a=2&b=1#f", None, ""])
        kind = rng.choice(["response", "revisit", "revisit", "other", None])
        rows.append((i, url, rng.choice([None, *range(200)]), kind, rng.choice([None, "e1", "e2"]), rng.choice([None, "m"]), rng.choice([None, None, "d1", "d2"]), rng.choice([None, {}, {"ETag": "z", "X": "1"}, {"Vary": "v", "Set-Cookie": "c"}])))
    rows.append(rows[1])
    df = spark.createDataFrame(rows, rec)
    keys = {r["record_id"]: r["k"] for r in df.select("record_id", warc.canonical_url(df["url"]).alias("k")).collect()}
    assert keys[next(i for i, r in enumerate(rows) if r[1] == "http://A.com/x/")] == "a.com/x"
    assert {keys[i] for i, r in enumerate(rows[:600]) if r[1] and "b.org" in r[1]} == {"b.org?a=2&b=1"}
    want = []
    for i, _url, at, kind, etag, lm, digest, headers in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and keys[r[0]] is not None and keys[r[0]] == keys[i] and r[2] is not None and at is not None and r[2] < at]
        hit = max(before, key=lambda r: (r[2], r[0]), default=None)
        own = {k.lower(): v for k, v in (headers or {}).items()}
        if hit is None:
            outcome = "orphan"
        else:
            pairs = [(a, b) for a, b in ((etag, hit[4]), (lm, hit[5]), (digest, hit[6])) if a is not None and b is not None]
            outcome = "conflict" if any(a != b for a, b in pairs) else "resolved" if pairs else "unvalidated"
        if outcome == "resolved":
            own = {k.lower(): v for k, v in (hit[7] or {}).items()} | {k: v for k, v in own.items() if k in warc.PERMITTED}
        want.append((i, keys[i], at, hit and hit[0], hit and hit[2], outcome, "\n".join(f"{k}: {v}" for k, v in sorted(own.items()))))
    assert {w[5] for w in want} == {"orphan", "conflict", "resolved", "unvalidated"}
    key = lambda r: str(r)
    for stretches in (1, 64):
        assert sorted((tuple(r) for r in warc.resolve_revisits(df, stretches).collect()), key=key) == sorted(want, key=key)
    assert warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(con.execute(f"SELECT {cols} FROM ({queries.ORACLES[name]})").fetchall(), key=str)


def test_word_hashes_hold_texts_apart():
    """Words never go on into the next text, and hashes do not depend on where a word stands."""
    from loomstone.llm.common import text_bytes, words_of

    raw, offsets = text_bytes(pa.array(["abc", None, "abc abc", "", "xabc"]))
    starts, ends, hashes, first = words_of(raw, offsets, jaccard.WORD)
    assert first.tolist() == [0, 1, 1, 3, 3, 4] and (ends - starts).tolist() == [3, 3, 3, 4]
    assert len(set(hashes[:3].tolist())) == 1 and hashes[3] != hashes[0]


def test_toxicity_of_long_and_repeated_texts(spark, monkeypatch):
    """A text that does not fit into the sample's bytes is passed over; the others are learnt from."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40_000)
    docs = [(i, "you vile fool. " if i % 2 else "good morning all. ") for i in range(300)] + [(i, "word " * 5000) for i in range(300, 330)] + [(None, "x"), (1, "you vile fool. ")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i < 300 else 0) for i in range(330)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(rows, labels)
    assert model.value.score("you vile fool.") > 0.5 > model.value.score("good morning all.")
    nothing = toxicity.train(rows.limit(0), labels)
    assert nothing.value.score("you vile fool.") < 0.5


def test_noisy_or_by_brute_force(spark):
    """Scores from their definition, and the fit's likelihood against weights moved by a little."""
    rng = random.Random(3)
    clean, bad = [f"c{chr(97 + i)}lm" for i in range(12)], ["nasty", "horrid"]
    texts, marks = [], []
    for i in range(400):
        toxic = i % 3 == 0
        lines = [" ".join(rng.choice(clean) for _ in range(5)) for _ in range(4)]
        if toxic:
            lines[rng.randrange(4)] += " " + rng.choice(bad)
        texts.append(". ".join(lines))
        marks.append(toxic)
    weights, bias = toxicity.fit(texts, np.array(marks, dtype=float))
    scorer = toxicity.Scorer(weights, bias)

    def plain(text, w):
        clean = 1.0
        for s in re.split(r"[.!?\n]+", text.lower()):
            seen = set(re.findall(r"[a-z]+", s))
            if seen:
                clean *= 1 - 1 / (1 + np.exp(-(bias + sum(w[p] for x in seen for p in toxicity.parts(x)))))
        return 1 - clean

    assert all(abs(scorer.score(t) - plain(t, weights)) < 1e-9 for t in texts[:50])
    assert [scorer.score(t) >= 0.5 for t in texts] == marks
    loss = lambda w: -sum(np.log(max(1e-12, p if y else 1 - p)) for p, y in ((plain(t, w), y) for t, y in zip(texts, marks, strict=True)))
    for word, sign in (("nasty", 1), ("calm", -1)):
        less = weights.copy()
        less[toxicity.parts(word)] -= sign * 0.5
        assert loss(less) > loss(weights)


def test_vectors_of_null_ids(spark):
    rows = spark.createDataFrame([(None, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.01]), (None, None, None)], "vec_id long, label string, embedding array<double>")
    got = sorted((tuple(r) for r in embed_join.embedding_near_dedup(rows).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)], key=str)
