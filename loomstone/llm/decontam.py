"""Benchmark decontamination by suffix arrays of the training texts.

A shard is a slice of documents. Its words become ids in the benchmark's vocabulary; a stretch of words that is shorter than
every window, or has a word no item has, can't hold a match and is left out. Over the rest a suffix array is sorted, as deep as the longest item.
Every item suffix that the shard's words can spell as far as a window is binary-searched in it, word by word. Where the interval narrows at a depth of a window or more, the suffixes that
drop out have their longest verbatim match with the item there; those that go on to the left belong to the match before them. So each match is found once, at
its whole length and with its place, however documents fall into shards. Words inside matches are hit. Shards are independent and documents are never shuffled.

The benchmark is sent to all executors in blocks of at most BLOCK_BYTES of text, as its size says; of several blocks the findings are put together row by row,
with one block in a worker's memory at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, lut, release, slices, text_bytes, words_of

#: The words of a text, and the words of a window.
WORD = lut([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
WINDOW = 8
BLOCK_BYTES = 32 << 20


class Benchmark:
    """The words of items as ids, in arrays of some ten times the texts' bytes; items without words have no windows."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int = WINDOW):
        raw, offsets = text_bytes(texts)
        starts, ends, hashes, first = words_of(raw, offsets, WORD)
        self.vocabulary, at, tokens = np.unique(hashes, return_index=True, return_inverse=True)
        self.items, self.tokens = ids, tokens.astype(np.int64)
        self.letters, self.begin, self.end = LOWER[raw], starts[at], ends[at]
        size = np.diff(first)
        self.item_of = np.repeat(np.arange(len(ids)), size)
        self.item_first = first[:-1].astype(np.int64)
        self.left = np.repeat(first[1:], size) - np.arange(len(tokens))
        self.window = np.minimum(window, size)[self.item_of]  # words of a window of a word's item
        self.queries = np.flatnonzero(self.left >= self.window)
        self.least = int(self.window.min()) if len(tokens) else 0
        self.deepest = int(self.left.max()) if len(tokens) else 0

    def word(self, token: int) -> bytes:
        return self.letters[self.begin[token] : self.end[token]].tobytes()


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first depth tokens at least, by prefix doubling. A suffix that ends is less than any that goes on."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: max(0, n - k)] = rank[k:] + 1
        key = rank * np.int64(n + 1) + nxt
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, dtype=np.int64)
        rank[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class Shard:
    """The suffix array of a slice of documents."""

    def __init__(self, texts: pa.Array, bench: Benchmark, strange: tuple[int, ...] = ()):
        self.bench, self.texts, self.strange = bench, texts, strange
        self.raw, offsets = text_bytes(texts)
        self.starts, self.ends, hashes, self.first = words_of(self.raw, offsets, WORD)
        self.n_words = np.diff(self.first)
        n = len(hashes)
        self.string = np.zeros(0, np.int64)
        if not n or not bench.least:
            return
        at = np.minimum(np.searchsorted(bench.vocabulary, hashes), len(bench.vocabulary) - 1)
        known = bench.vocabulary[at] == hashes
        known[list(strange)] = False  # words that only share a hash with one of the benchmark
        new = np.ones(n, dtype=bool)
        new[1:] = known[1:] != known[:-1]
        new[self.first[:-1][self.n_words > 0]] = True
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        kept = np.flatnonzero(known & (size[run] >= bench.least))
        if not len(kept):
            return
        # Each stretch is followed by a break, which no item has.
        place = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(np.diff(run[kept]) != 0)])
        self.string = np.full(place[-1] + 2, -1, dtype=np.int64)
        self.string[place] = at[kept]
        self.word = np.full(len(self.string), -1, dtype=np.int64)
        self.word[place] = kept
        self.order = suffix_array(self.string, bench.deepest)
        self.padded = np.concatenate([self.string, np.full(bench.deepest + 1, -2)])

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of intervals of the suffix array whose suffixes have the token at a depth."""
        out = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) >> 1
                seen = self.padded[self.order[np.minimum(mid, len(self.order) - 1)] + depth]
                up = open_ & ((seen <= token) if right else (seen < token))
                a = np.where(up, mid + 1, a)
                b = np.where(open_ & ~up, mid, b)
            out.append(a)
        return out[0], out[1]

    def spread(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place in the string) of all suffixes in the intervals."""
        count = hi - lo
        query = np.repeat(np.arange(len(lo)), count)
        skip = np.concatenate([[0], np.cumsum(count)[:-1]])
        return query, self.order[np.repeat(lo - skip, count) + np.arange(count.sum())] if len(query) else np.zeros(0, np.int64)

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of the shard, word of the benchmark, words) of each longest match of a window's length or more: none goes on to either side."""
        none = np.zeros(0, np.int64)
        if not len(self.string):
            return none, none, none
        b = self.bench
        present = np.zeros(len(b.vocabulary), dtype=bool)
        present[self.string[self.string >= 0]] = True
        live = b.queries
        for k in range(int(b.window.max())):  # only suffixes whose window has no word that the shard lacks
            live = live[(b.window[live] <= k) | present[b.tokens[np.minimum(live + k, len(b.tokens) - 1)]]]
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.string), np.int64)
        depth, found = 0, []

        def ended(query, lo, hi):
            which, place = self.spread(lo, hi)
            if len(place):
                found.append((query[which], place, np.full(len(place), depth)))

        while len(live):
            over = b.left[live] == depth
            ended(live[over], lo[over], hi[over])
            live, lo, hi = live[~over], lo[~over], hi[~over]
            x, y = self.narrow(lo, hi, depth, b.tokens[np.minimum(live + depth, len(b.tokens) - 1)])
            if depth >= b.least:
                due = depth >= b.window[live]
                ended(live[due], lo[due], x[due])
                ended(live[due], y[due], hi[due])
            on = x < y
            live, lo, hi = live[on], x[on], y[on]
            depth += 1
        if not found:
            return none, none, none
        query, place, length = (np.concatenate(c) for c in zip(*found, strict=True))
        before = np.where(query > b.item_first[b.item_of[query]], b.tokens[query - 1], -3)
        starts = (place == 0) | (self.string[place - 1] != before)
        return self.word[place[starts]], query[starts], length[starts]

    def checked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The matches, and which words are hit. Words that only share a hash with those of the benchmark are taken out."""
        word, query, length = self.matches()
        edge = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + length, -1)
        hit = np.cumsum(edge[:-1]) > 0
        if len(word):
            token = np.full(len(hit), -1, dtype=np.int64)
            seen = self.word >= 0
            token[self.word[seen]] = self.string[seen]
            strange = [w for w in np.flatnonzero(hit).tolist() if LOWER[self.raw[self.starts[w] : self.ends[w]]].tobytes() != self.bench.word(token[w])]
            if strange:
                other = Shard(self.texts, self.bench, (*self.strange, *strange))
                return other.checked()
        return word, query, length, hit

    def hits(self) -> tuple[np.ndarray, list[list[int]]]:
        """Which words are hit, and the items of each document."""
        word, query, _, hit = self.checked()
        items: list[list[int]] = [[] for _ in self.n_words]
        if len(word):
            doc = np.searchsorted(self.first, word, side="right") - 1
            size = max(1, len(self.bench.items))
            for key in np.unique(doc * np.int64(size) + self.bench.item_of[query]).tolist():
                items[key // size].append(key % size)
        return hit, items

    def longest(self) -> list[tuple[int, int, int, int, int]]:
        """(document, item, word of the item, word of the document, words) of the longest matches."""
        word, query, length, _ = self.checked()
        doc = np.searchsorted(self.first, word, side="right") - 1
        item = self.bench.item_of[query]
        return sorted(zip(doc.tolist(), item.tolist(), (query - self.bench.item_first[item]).tolist(), (word - self.first[doc]).tolist(), length.tolist(), strict=True))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list:
    """The benchmark in blocks of bounded size, one broadcast each."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    out = []
    for i in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == i)
        got = part.toArrow()
        out.append(spark.sparkContext.broadcast(Benchmark(got["id"].to_pylist(), got["text"].combine_chunks())))
    return out


def _through(blocks: list, parts: list, make) -> list[list]:
    """make(shard) for each block and part. Of several blocks one is held at a time."""
    out = []
    for block in blocks:
        out.append([make(Shard(p, block.value)) for p in parts])
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)
            release()
    return out


def _hit_words(shard: Shard) -> tuple[list[np.ndarray], list[list[str]]]:
    """The numbers of each document's hit words, and its items."""
    hit, items = shard.hits()
    names = shard.bench.items
    return [np.flatnonzero(hit[a:b]) for a, b in zip(shard.first[:-1], shard.first[1:], strict=True)], [[names[i] for i in x] for x in items]


def _joined(found: list) -> list[tuple[int, list[str]]]:
    """(number of hit words, sorted items) of each document, over the blocks."""
    out = []
    for each in zip(*(zip(*f, strict=True) for f in found), strict=True):
        words = [w for w, _ in each if len(w)]
        out.append((len(np.unique(np.concatenate(words))) if words else 0, sorted({i for _, items in each for i in items})))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, items (sorted strings).

    Null and empty texts have no words; items without an id or words have no windows, items of one id are one. Repeated rows come back as often; other columns are not read."""
    blocks = _blocks(benchmark, item_col, item_text)
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            parts = list(slices([batch], 1))
            words = [np.diff(words_of(*text_bytes(p.column(1)), WORD)[3]) for p in parts] if not blocks else None
            found = _through(blocks, [p.column(1) for p in parts], lambda s: (_hit_words(s), s.n_words))
            for k, part in enumerate(parts):
                rows = _joined([f[k][0] for f in found]) or [(0, [])] * part.num_rows
                n_words = found[0][k][1] if found else words[k]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.string()))], names=schema.names)
        release()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The longest verbatim matches of a window's length or more and their places: id, item, item_word, doc_word (both from 0), n_words. A row for each
    match that goes on to neither side; null and empty texts have none, repeated rows have theirs as often."""
    schema = T.StructType([docs.schema[id_col], T.StructField("item", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("item_word", "doc_word", "n_words"))])
    blocks = _blocks(benchmark, item_col, item_text)

    def run(batches):
        for batch in batches:
            parts = list(slices([batch], 1))
            for of_block in _through(blocks, [p.column(1) for p in parts], lambda s: (s.longest(), s.bench.items)):
                for part, (found, names) in zip(parts, of_block, strict=True):
                    if found:
                        doc, item, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array([names[i] for i in item]), *(pa.array(c, pa.int64()) for c in rest)], names=schema.names)
        release()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_hit: int = WINDOW, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which fewer than min_hit words are hit. Null and empty texts stay."""
    blocks = _blocks(benchmark, item_col, item_text)
    if not blocks:
        return docs

    def run(batches):
        for batch in batches:
            parts = list(slices([batch], text_col))
            found = _through(blocks, [p.column(text_col) for p in parts], _hit_words)
            for k, part in enumerate(parts):
                yield part.filter(pa.array([n < min_hit for n, _ in _joined([f[k] for f in found])], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
