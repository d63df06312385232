"""Operators that judge one row at a time, against plain versions."""

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import bpe, html_text, secrets, url_filter

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def auto():
    return bpe.automaton(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


TEXTS = ["", "a", " ", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext", "é  日本語 🤷‍♀️ I'll don't we've", " " * 300 + "x", "aaaaaaaaaaaa" * 40, "\x00\x01\x7f\u200b\u0301", "naïve\n\n\tx\r\n 123 4567 ½ ٣", "x" * 3000, "ab" * 400, "日本語" * 300, "it's's 's \n're ''ll o'lly", " \t x  \u3000y\x85z "]


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_is_the_library(auto, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert auto.encode(text) == ids
    n, joined, raw = auto.summaries(pa.array([text]))[0]
    assert (n, joined) == (len(ids), ",".join(map(str, ids)))
    assert raw.decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False) == auto.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(text):
    from tokenizers import Tokenizer

    auto, library = bpe.automaton(bpe.default_vocabulary()), _library(Tokenizer)
    assert auto.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert auto.decode(auto.encode(text)) == text


_kept = {}


def _library(kind):
    return _kept.setdefault("t", kind.from_file(bpe.default_vocabulary()))


def test_bpe_texts_together(auto, library):
    """Texts of one slice do not touch each other, whatever stands at their ends."""
    rng = random.Random(4)
    pool = [*"'s 't 're 've 'm 'll 'd ' a b 1 ½ é 日本 ! the ing A l re ſ aaaa ٣".split(), " ", "  ", "\n", "\t", "\u200b", "\x1c", "\x85", "\u3000", "<|endoftext|>", " the"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(3000)]
    ids, per = auto.encode_texts(pa.array(texts))
    end = np.cumsum(per)
    for text, a, b in zip(texts, end - per, end, strict=True):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_table(auto):
    """The compiled table holds just the arcs that stepping through the gadgets leaves, on a small vocabulary."""
    import json

    letters = {b: c for c, b in bpe.byte_letters().items()}
    made = [("a", "b"), ("b", "c"), ("a", "a"), ("ab", "ab"), ("aa", "a"), ("c", "ab"), ("b", "a"), ("ba", "bc"), ("abab", "abab")]
    vocab = {letters[b]: b for b in range(256)} | {x + y: 256 + i for i, (x, y) in enumerate(made)}
    small = bpe.Automaton(json.dumps({"model": {"vocab": vocab, "merges": [f"{x} {y}" for x, y in made]}, "added_tokens": []}))
    size = len(vocab)
    arc = np.zeros((size, size), dtype=bool)
    live = list(range(256))
    arc[:256, :256] = True
    for i, (x, y) in enumerate(made):
        a, b, c = vocab[x], vocab[y], 256 + i
        if not arc[a, b]:
            continue
        arc[c] = arc[b]
        arc[a, b] = False
        arc[:, c] = arc[:, a]
        live.append(c)
    columns = small.column_of.astype(int)
    for u in live:
        for v in live:
            gone = small.gone[small.row_of[u], columns[v] >> 3] >> (columns[v] & 7) & 1
            assert arc[u, v] == (not gone), (u, v)


def test_bpe_on_documents(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.bpe_digest(docs, bpe.default_vocabulary()).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edge_rows(spark, library):
    rows = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (2, "", "k"), (3, "hi there", None)], "doc_id long, text string, ids string")
    got = bpe.bpe_digest(rows, bpe.default_vocabulary()).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(1, 0), (1, 0), (2, 0), (3, 2)]
    both = bpe.bpe_decode(bpe.bpe_encode(rows, bpe.default_vocabulary()), bpe.default_vocabulary()).orderBy("doc_id").collect()
    assert [r["decoded"] for r in both] == ["", "", "", "hi there"]
    assert both[3]["ids"] == library.encode("hi there").ids
    assert bpe.bpe_digest(rows.limit(0), bpe.default_vocabulary()).count() == 0


def plain_base(text):
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if m.end() - m.start() >= 24:
            found.append((m.start(), 2, m.end()))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_base(spark):
    texts = [None, "", 'PassWord = "abc123"', "token: abc", "tokentoken=abcdef", "ſecret=abcdefg", "api_key:'k.e-y/+=' APIKEY=123456", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "ab" * 12, "ab" * 11 + "a", "AKIAAKIA" + "X" * 20, "é" * 5 + "secret=" + "0f" * 16]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.secret_scan(rows).collect():
        want = plain_base(texts[r["doc_id"]] or "")
        assert r["base_spans"] == want
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_secrets_randomness():
    rng = random.Random(5)
    hits = sum(bool(secrets.find_secrets("key " + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)))[1]) for _ in range(200))
    assert hits >= 180
    clean = ["ThisIsALongCamelCaseIdentifier2Name", "some_long_snake_case_name_with_2_digits", "https-www-example-com-en-2024-article-title-here", "2024-01-01T00-00-00-log-file-name", "A" * 40 + "1", "a1" * 30, "Donaudampfschifffahrtsgesellschaft"]
    assert all(not secrets.find_random(x, []) for x in clean)
    assert secrets.masked("x password=abcdefgh y") == "x [SECRET] y"
    assert secrets.masked(None) is None and secrets.masked("") == ""


def test_secrets_inside_runs():
    """Values behind a name and =, and parts of runs that no alphabet holds."""
    rng = random.Random(7)
    base62, base64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for front, letters, n in (("AWS_SECRET_ACCESS_KEY=", base64, 40), ("?sig=", base62, 24), ("auth=ghp_", base62, 36), ("xyz_", base64, 60), ("/v1/my-hooks/", base62, 40), ("a=b=", base62, 32)):
        hits = 0
        for _ in range(100):
            value = made(letters, n)
            text = f"see {front}{value} there"
            spans = secrets.find_secrets(text)[1]
            hits += bool(spans) and all(k == 3 for k, _, _ in spans) and value not in secrets.masked(text)
            assert all(b <= c for (_, _, b), (_, c, _) in zip(spans, spans[1:], strict=False))
        assert hits >= 85, (front, hits)
    clean = ["utm_campaign=spring_sale_2024_newsletter_for_readers", "/blog-posts/2024/the-article_title-number-1234/index", "name=ThisIsALongCamelCaseIdentifier2Name", "2024-01-01/log-file-name/part_2/of_the_long_run"]
    assert all(not secrets.find_random(x, []) for x in clean)


def test_redaction_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "token=abcdefgh", 14, "a"), (2, None, None, "b"), (2, None, None, "b"), (3, "clean", 5, None)], "doc_id long, text string, n_chars long, spans string")
    got = secrets.redact_secrets(rows, length_col="n_chars")
    assert got.columns == rows.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got.where("text IS NOT NULL").collect()) == [(1, "[SECRET]", 8), (3, "clean", 5)]
    assert got.count() == 4


def test_html(spark):
    page = html_text.main_text
    assert page(None) == "" and page("") == "" and page("just text") == "just text"
    article = "<html><head><title>T</title><script>x('</p>')</script><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy</div><div id=cookie-notice>We use cookies</div>"
    article += "<article><h1>Title &amp; more</h1><p><b>One  two<br>three.<p>Short.</p><blockquote>Quote</blockquote><aside>No</aside><form><input><button>Go</button></form><p>a &lt;b&gt; &eacute;</p><section class='comments'><p>I say</p></section></article><div class=sidebar>Side</div><footer>&copy; F</footer></body></html>"
    assert page(article) == "Title & more\nOne two three.\nShort.\nQuote\na <b> é"
    assert page(article[: article.index("Quote") + 3]).endswith("Quo")
    plain = "<body><div id='header'>Menu</div><div><h2>Head of the text</h2>" + "".join(f"<p>A longer paragraph number {i} with quite some words in it.</p><p>Short {i}.</p>" for i in range(5)) + "</div><div class='sidebar'><ul><li><a>x</a></li></ul></div><div class='related'>More</div></body>"
    assert page(plain).split("\n") == ["Head of the text", *(x for i in range(5) for x in (f"A longer paragraph number {i} with quite some words in it.", f"Short {i}."))]
    rows = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<p>é</p>")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in html_text.extract_main_text(rows).where("page_id = 1").collect()) == [(1, "u", "", 0)] * 2
    assert [tuple(r) for r in html_text.extract_main_text(rows).where("page_id = 2").collect()] == [(2, None, "é", 1)]


def test_html_with_long_blocks():
    """Without a named article, long blocks hide no other paragraphs, however many or few there are."""
    few = [f"Paragraph {i} " + "word " * 58 for i in range(20)]
    for long in (["long " * 4000], ["long " * 4000] * 30):
        page = [" ".join(x.split()) for x in few[:10] + long + few[10:]]
        assert html_text.main_text("<body>" + "".join(f"<p>{x}</p>" for x in page) + "</body>").split("\n") == page
    short = [f"One sentence of the text, number {i}." for i in range(6)]
    page = "".join(f"<p>{x}</p>" for x in short) + "<div class=ad>Buy</div>" + "<p><a href=x>A link</a></p>" * 4 + f"<p>{'long ' * 4000}</p>"
    assert html_text.main_text(f"<body>{page}</body>").split("\n") == [*short, ("long " * 4000).strip()]
    assert html_text.main_text("<body><p>tiny</p></body>") == "tiny"


def test_html_on_pages(spark):
    """The test pages have one article with h1 and p blocks."""
    import html

    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        body = re.sub(r"</?[a-z][^>]*$", "", r["html"].split("<article>", 1)[1].split("</article>", 1)[0])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r["html"]) == "\n".join(b for b in blocks if b)


def plain_verdict(url):
    import fnmatch

    host, path = url_filter.canonical(url)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: len(f[0]), default=None)
    glob = any(fnmatch.fnmatchcase(host, g.split("/", 1)[0]) and fnmatch.fnmatchcase(path, g.split("/", 1)[1]) for g in url_filter.GLOBS)
    return host, path, best and best[0], best[1] if best else "block" if glob or not host else "allow"


URLS = [None, "", "x", "http://", "HTTP://WWW.Example.COM/en/", "http://www.example.com/en", "http://a.b.example.com/en/x?y#z", "http://com/", "http://x.net/fr/?a", "http://fakeexample.com/en/x", "http://a.org/.example.com/en/", "://h/p#x/y", "http://é.net/es/ö", "http://h?x/y", "http://u@h:80/p", "http://casino.org/a", "http://x.org/a/viagra-1", "a://b://c/d", "http://x.org/" + "y" * 5000 + ".exe", "http://h#f://g"]


def test_url_filter(spark):
    urls = URLS + [r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    got = {r["page_id"]: r for r in url_filter.filter_urls(rows).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(u), u


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab*?.", min_size=1, max_size=6), st.text("ab/*?", max_size=5)), min_size=1, max_size=40), st.lists(st.tuples(st.text("ab.", max_size=8), st.text("ab/", max_size=8)), min_size=1, max_size=5))
def test_shift_and(patterns, urls):
    """Patterns over several words against regular expressions."""
    turn = lambda g, stay: "".join({"*": stay, "?": "."}.get(c, re.escape(c)) for c in g)
    got = url_filter.ShiftAnd(patterns).match([h.encode() + b"\xff" + p.encode() for h, p in urls])
    for i, (h, p) in enumerate(urls):
        for j, (gh, gp) in enumerate(patterns):
            assert got[i, j] == bool(re.fullmatch(turn(gh, ".*"), h) and re.fullmatch(turn(gp, ".*"), p))


def test_line_blocks_by_brute_force():
    """The lines that weigh and lie in a window above the level, whatever their order."""
    rng = random.Random(8)
    for _ in range(300):
        weights = [rng.choice([0, 0, 3, 20, 90, 400]) for _ in range(rng.randrange(1, 30))]
        level = rng.choice([0, 5, 40, 120])
        want = set()
        for s in range(len(weights)):
            block = range(s, min(len(weights), s + html_text.WINDOW))
            if sum(weights[i] for i in block) > level:
                want |= {i for i in block if weights[i]}
        got = [i for a, b in html_text.stretches(weights, level) for i in range(a, b)]
        assert len(got) == len(set(got)) and {i for i in got if weights[i]} == want


def test_article_is_a_weight():
    page = html_text.main_text
    long = "".join(f"<p>{'word ' * 60}{i}</p>" for i in range(5))
    assert page(f"<article><p>short</p></article><div>{long}</div>").count("word") == 300  # a teaser does not hide the text beside it
    assert page(f"<div><p>{'other ' * 20}</p></div><hr><article>{long}<p>end</p></article>").startswith("word")
    assert page(f"<article>{long}<p>end</p></article>").endswith("\nend")


def test_long_pages_of_unmatched_tags():
    import time

    begun = time.time()
    assert html_text.main_text("<div>" * 300_000 + "</p>" * 300_000 + "x" * 5_000_000) == "x" * 5_000_000
    assert time.time() - begun < 60


def test_pages_of_no_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(None, None, "<p>a</p>", 1, "t")] * 2, "page_id long, url string, html string, n_chars int, text string")
    assert [tuple(r) for r in html_text.extract_main_text(rows).collect()] == [(None, None, "a", 1)] * 2
    assert html_text.extract_main_text(rows.limit(0)).count() == 0
    assert url_filter.filter_urls(rows.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "password=abcdef", "x")] * 2, "doc_id long, text string, spans string")
    assert [r["spans"] for r in secrets.secret_scan(docs).collect()] == ["assign:0:15"] * 2
    assert secrets.secret_scan(docs.limit(0)).count() == 0
