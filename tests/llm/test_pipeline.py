"""The pipeline against plain versions of its stages."""

import re
from collections import defaultdict

import corpus_pipeline
from tokenizers import Tokenizer

from loomstone.llm import bpe, secrets, toxicity

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from test_corpus_operators import brute_contamination, brute_jaccard

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    left = {i: r["text"] for i, r in rows.items() if model.value.score(r["text"]) < 0.5}
    assert len(left) < len(rows)
    near = brute_jaccard(list(left.items()))
    left = {i: left[i] for i, _, c in near if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {i: left[i] for i, _, hit, _ in brute_contamination(list(left.items()), items) if hit < 8}
    left = {i: secrets.masked(t) for i, t in left.items()}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = {i: (len(t), library.encode(t, add_special_tokens=False).ids) for i, t in left.items()}
    got = {r["doc_id"]: (r["n_chars"], r["ids"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want


def test_near_duplicates_of_five_words(spark, monkeypatch):
    """Copies of similarity 0.80 to 0.85 go, and those below stay."""
    import itertools
    import random

    from loomstone.llm import jaccard
    from loomstone.llm.components import brute_components

    monkeypatch.setattr(jaccard, "SKETCH_BITS", 12)
    rng = random.Random(6)
    texts = ["one two three", "one two three", "four five"]
    for appended in (20, 22, 24, 26):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(words), " ".join(words + [f"x{rng.randrange(10**6)}" for _ in range(appended)])]
    for changed in range(2, 7):
        words = [f"w{rng.randrange(10**6)}" for _ in range(190)]
        texts.append(" ".join(words))
        for i in range(changed):
            words[20 + 30 * i] = "other"
        texts.append(" ".join(words))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in map(str.split, texts)]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = brute_components(list(range(len(sets))), links)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, rows, DATA).collect()}
    assert kept == {i for i in found if found[i] == i}
    assert not {4, 6, 8} & kept and 10 in kept


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and columns of the operators' own names pass every stage; an empty table stays empty."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clash = {"_id": "j", "_text": "a", "ids": "b", "n": "c", "h": "d", "score": "e", "component_id": "f", "kept": "g", "label": "i"}
    long = " ".join(f"calm{i}" for i in range(200_000))
    rows = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "  \n ", "en", "s", 4), (-4, long, "en", "s", len(long)), (-5, "a quiet river", None, None, None), (-5, "a quiet river", None, None, None), (None, "the quiet hill", "en", "s", 14), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    for k, table in enumerate((odd, odd.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            # The fit of the first stage needs labelled rows, so it goes over the documents as well.
            given = table.unionByName(docs.limit(0 if k else 200)) if name == "toxicity" else table
            given = given.withColumns({c: F.lit(v) for c, v in clash.items()}) if name != "tokens" else given
            if name == "toxicity" and k:
                continue
            out = stage(spark, given, DATA)
            if name != "tokens":
                assert out.columns == given.columns
                assert all(r[c] == v for r in out.limit(5).collect() for c, v in clash.items())
            found = sorted((r["doc_id"] for r in out.where("doc_id < 0 OR doc_id IS NULL").select("doc_id").collect()), key=str)
            # Of rows that repeat an id near_duplicates leaves one.
            want = [] if k else [r[0] for i, r in enumerate(rows) if name != "near_duplicates" or i != 5]
            assert found == sorted(want, key=str), name
    got = [(r["doc_id"], r["n_tokens"], r["ids"]) for r in corpus_pipeline.tokens(spark, odd, DATA).collect()]
    assert sorted(i for i, n, _ in got if n == 0 and i is not None) == [-2, -1] and all(len(x) == n for _, n, x in got)


def test_no_import_from_the_rest():
    """Nothing else in the library imports this package."""
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    users = defaultdict(list)
    for p in (root / "loomstone").rglob("*.py"):
        if "llm" not in p.parts and re.search(r"loomstone\.llm|from \.+llm", p.read_text()):
            users[p].append(p)
    assert not users
