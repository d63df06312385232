"""Byte-level BPE through a token automaton.

The merges are compiled into a deterministic automaton over tokens by successive merge gadgets. It begins as one state that
every byte token leads back to. The gadget of a merge (a, b) -> c gives every state with a path a, b an arc c past it, and takes
from the state behind a the arc b. The state behind c starts with the arcs that the state behind b has just then; a state has an arc c
where it has an arc a just then. So the row of a state is the row of its token's right part as it was when the token was made, and the
column of an arc is that of its token's left part; a gadget takes its arc from all rows and columns that were taken over after it. States with equal rows
and arcs with equal columns are one class each, and the automaton is a table of bits over (class of the state, class of the arc).
The token sequences that it accepts are those that BPE makes, so each text has one path.

Encoding runs over the distinct pre-split words of a slice of texts at once: a trie of labels lists the tokens that end at each place, and
the table says which of them goes on from the state behind the place where it begins. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mix, release, slices, text_bytes

#: Bytes of text that are encoded at once; words of more bytes than LEVELS are walked one place at a time.
ENCODE_BYTES, LEVELS = 1 << 19, 256
#: Of the table of edges: the factor of the hash, and what an empty slot holds.
HASH, NO_EDGE = np.uint32(2654435761), np.uint32(0xFFFFFFFF)
LETTER, NUMBER, SPACE, OTHER = range(4)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def kinds() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


def word_starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of byte-level BPE's pre-tokenisation begin. points: the code points of all texts; first: where texts begin, and the end.

    A word is a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of numbers or of others, each with one blank before it;
    a run of white space leaves its last character to what follows it."""
    n = len(points)
    edge = np.zeros(n + 1, dtype=bool)
    edge[first] = True
    begin = edge[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])
    begin[last] = True
    begin[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points[:-1] == 0x27) & begin[:-1] & (kind[1:] == LETTER) & ~edge[1:-1])
    if len(quote):
        one = points[quote + 1]
        after = np.minimum(quote + 2, n - 1)
        two = np.where(edge[quote + 2], 0, points[after])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        quote, size = quote[single | double], np.where(single, 2, 3)[single | double]
        begin[quote + 1] = False
        end = quote + size
        begin[end[end < n]] = True
    return np.flatnonzero(begin)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of ranges, one range after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(sizes) - sizes
    return np.repeat(starts - skip, sizes) + np.arange(total)


class Automaton:
    """The compiled tables; spec is the text of a vocabulary file. Only arrays are sent to executors."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        label = {v: k for k, v in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        born, parts, merged = {vocab[bytes([b])]: 0 for b in range(256)}, {}, {}
        for time, pair in enumerate(spec["model"]["merges"], 1):
            a, b = (vocab[raw(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            c = vocab[label[a] + label[b]]
            if c in born:
                raise ValueError("two merges make one token")
            if a in born and b in born and self._has_arc(a, b, time - 1, born, parts, merged):
                born[c], parts[c] = time, (a, b)
            merged.setdefault((a, b), time)
        self._classes(born, parts, merged)
        label |= {v: k.encode() for k, v in self.special.items()}
        size = max(label) + 1
        self.width = np.array([len(label.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.labels = np.frombuffer(b"".join(label.get(i, b"") for i in range(size)), dtype=np.uint8)
        self._trie({c: label[c] for c in born})
        self.kinds = kinds()

    @staticmethod
    def _has_arc(u: int, v: int, time: int, born: dict, parts: dict, merged: dict) -> bool:
        """Whether the state behind u has an arc v after the gadgets up to a time, by the rows and columns taken over."""
        while True:
            gone = merged.get((u, v))
            if gone is not None and gone <= time:
                return False
            born_u, born_v = born[u], born[v]
            if not born_u and not born_v:
                return True
            if born_v > born_u:
                v, time = parts[v][0], born_v
            elif born_u > born_v:
                u, time = parts[u][1], born_u - 1
            else:
                v, u = parts[u]
                time = born_u - 1

    def _classes(self, born: dict, parts: dict, merged: dict) -> None:
        """Classes of rows and columns, and the table of the arcs that gadgets have taken."""
        from_a: dict[int, list[int]] = {}
        from_b: dict[int, list[int]] = {}
        for (a, b), time in merged.items():
            from_a.setdefault(a, []).append(time)
            from_b.setdefault(b, []).append(time)

        def group(gadgets: dict[int, list[int]], side: int, before) -> tuple[np.ndarray, dict[int, tuple[list[int], list[int]]], int]:
            # A row is known by (token, number of its gadgets) along the chain of tokens it was taken over from.
            number: dict[tuple, int] = {}
            of = np.zeros(max(born) + 1, dtype=np.int32)
            for token in born:
                chain, at, limit = [], token, 1 << 60
                while True:
                    if (times := gadgets.get(at)) and (n := before(times, limit)):
                        chain.append((at, n))
                    if at not in parts:
                        break
                    at, limit = parts[at][side], born[at]
                of[token] = number.setdefault(tuple(chain), len(number))
            holders: dict[int, tuple[list[int], list[int]]] = {}
            for chain, i in number.items():
                for token, n in chain:
                    ids, counts = holders.setdefault(token, ([], []))
                    ids.append(i)
                    counts.append(n)
            return of, {t: (np.array(i), np.array(n)) for t, (i, n) in holders.items()}, len(number)

        # A row is taken over before its token's own gadget takes effect, a column behind it.
        self.row_of, rows, n_rows = group(from_a, 1, bisect_left)
        self.column_of, columns, n_columns = group(from_b, 0, bisect_right)
        gone = np.zeros((n_rows, n_columns), dtype=bool)
        rank_a, rank_b = ({t: {time: k for k, time in enumerate(times)} for t, times in g.items()} for g in (from_a, from_b))
        for (a, b), time in merged.items():
            if a in rows and b in columns:
                (r, n), (c, m) = rows[a], columns[b]
                r, c = r[n > rank_a[a][time]], c[m > rank_b[b][time]]
                gone[r[:, None], c] = True
        self.gone = np.packbits(gone, axis=1, bitorder="little")

    def _trie(self, tokens: dict[int, bytes]) -> None:
        """The edges (node, byte, child) of the labels' trie and the token of each node; nodes with children come first."""
        child: dict[tuple[int, int], int] = {}
        token, inner = [-1], set()
        for t, word in tokens.items():
            node = 0
            for byte in word:
                nxt = child.get((node, byte))
                if nxt is None:
                    nxt = child[node, byte] = len(token)
                    token.append(-1)
                    inner.add(node)
                node = nxt
            token[node] = t
        order = np.array(sorted(range(len(token)), key=lambda i: i not in inner))
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        edges = np.array([(a, byte, b) for (a, byte), b in child.items()], dtype=np.int64)
        self.edge = (place[edges[:, 0]].astype(np.int64) * 256 + edges[:, 1]).astype(np.uint32), place[edges[:, 2]]
        self.token_at, self.inner = np.array(token, dtype=np.int32)[order], len(inner)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _ready(self) -> None:
        """Tables that are made anew from the others: the edges by (node, byte) in an open-addressed table, a quarter full at most."""
        if "_slots" in self.__dict__:
            return
        self._label_at = np.cumsum(self.width) - self.width
        self._written = [str(i) for i in range(len(self.width))]
        key, child = self.edge
        self._shift = np.uint32(32 - (4 * len(key)).bit_length())
        slots = np.full((1 << int(32 - self._shift)) + 256, NO_EDGE, dtype=np.uint32)
        children = np.zeros(len(slots), dtype=np.int32)
        at = (key * HASH >> self._shift).astype(np.int64)
        while len(key):
            free = slots[at] == NO_EDGE
            slots[at[free]] = key[free]
            put = free & (slots[at] == key)
            children[at[put]] = child[put]
            key, child, at = key[~put], child[~put], at[~put] + 1
        self._slots, self._children = slots, children

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that bytes lead to, 0 where there is no edge."""
        key = (node.astype(np.uint32) << np.uint32(8)) | byte
        at = (key * HASH >> self._shift).astype(np.int64)
        seen = self._slots[at]
        out = np.where(seen == key, self._children[at], 0)
        open_ = np.flatnonzero((seen != key) & (seen != NO_EDGE))
        while len(open_):
            at[open_] += 1
            seen = self._slots[at[open_]]
            same = seen == key[open_]
            out[open_[same]] = self._children[at[open_[same]]]
            open_ = open_[~same & (seen != NO_EDGE)]
        return out

    def _found(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of all tokens that lie in words; ends: the end of the word of each byte."""
        at = np.arange(len(raw), dtype=np.int32)
        node, found = np.zeros(len(raw), dtype=np.int32), []
        while len(at):
            depth = np.int32(len(found))
            node = self._next(node, raw[at + depth])
            seen = node > 0
            at, node = at[seen], node[seen]
            token = self.token_at[node]
            hit = token >= 0
            found.append((at[hit], at[hit] + depth + np.int32(1), token[hit]))
            on = (node < self.inner) & (at + depth + 1 < ends[at])
            at, node = at[on], node[on]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def encode_words(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and the number of ids of each; raw holds the words' bytes without gaps."""
        self._ready()
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(starts)), sizes)
        a, b, token = self._found(raw, (starts + sizes)[owner])
        level = b - starts[owner[a]]
        long = sizes[owner[a]] > LEVELS
        last = np.zeros(len(raw) + 1, dtype=np.int32)  # the token of the path to each place, by the place's last byte
        rows, columns, flat, stride = self.row_of, self.column_of, self.gone.ravel(), self.gone.shape[1]
        order = np.argsort(np.where(long, LEVELS + 1, level).astype(np.int16), kind="stable")
        cut = np.searchsorted(np.where(long, LEVELS + 1, level)[order], np.arange(1, LEVELS + 3))
        a, b, token = a[order], b[order], token[order]
        inside = a > starts[owner[a]]
        column = columns[token].astype(np.int64)
        byte, bit = column >> 3, (column & 7).astype(np.uint8)
        for x, y in zip(cut[:-2].tolist(), cut[1:-1].tolist(), strict=True):
            if x == y:
                continue
            state = rows[last[a[x:y] - 1]].astype(np.int64)
            ok = ~inside[x:y] | (flat[state * stride + byte[x:y]] >> bit[x:y] & 1 == 0)
            last[b[x:y][ok] - 1] = token[x:y][ok]
        x = int(cut[-2])
        if x < len(a):
            by_end = x + np.lexsort((a[x:], b[x:]))
            line, bits, path = (rows.astype(np.int64) * stride).tolist(), memoryview(flat), {}
            for i, j, t, at, shift, more in zip(*(v[by_end].tolist() for v in (a, b, token, byte, bit, inside)), strict=True):
                if not more or not bits[line[path[i]] + at] >> shift & 1:
                    path[j] = t
            last[np.fromiter(path.keys(), np.int64, len(path)) - 1] = np.fromiter(path.values(), np.int32, len(path))
        # Back from the words' ends.
        word, at, out = np.arange(len(starts)), starts + sizes, []
        while len(word):
            t = last[at - 1]
            out.append((word, t))
            at = at - self.width[t]
            on = at > starts[word]
            word, at = word[on], at[on]
        count = np.zeros(len(starts), dtype=np.int64)
        for w, _ in out:
            count[w] += 1
        end = np.cumsum(count)
        ids = np.zeros(int(end[-1]), dtype=np.int32)
        for k, (w, t) in enumerate(out):
            ids[end[w] - 1 - k] = t
        return ids, count

    def _plain(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each text. raw: the UTF-8 of all texts; first: where texts begin, and the end."""
        n = len(first) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = raw if len(lead) == len(raw) else np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        starts = lead[word_starts(points, self.kinds[points], np.searchsorted(lead, first))]
        del lead, points
        sizes = np.diff(np.append(starts, len(raw)))
        place = np.arange(len(raw)) - np.repeat(starts, sizes)
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64)]))
        hashes = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * power[place], starts)
        del place
        _, one, which = np.unique(mix(hashes + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_inverse=True)
        words = raw[spread(starts[one], sizes[one])]
        ids, count = self.encode_words(words, np.cumsum(sizes[one]) - sizes[one], sizes[one])
        each = count[which]
        out = ids[spread((np.cumsum(count) - count)[which], each)]
        total = np.concatenate([[0], np.cumsum(each)])
        per = np.diff(total[np.searchsorted(starts, first)])
        if not np.array_equal(self.emitted(out), raw):  # two words of one hash: each word by itself
            got = [self.encode_words(raw[a : a + s], np.zeros(1, np.int64), np.array([s])) for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)]
            out, each = np.concatenate([g[0] for g in got]), np.array([len(g[0]) for g in got])
            per = np.diff(np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, first)])
        return out, per

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each text; the strings of special tokens become those tokens."""
        raw, first = text_bytes(texts)
        marks = sorted(self.special, key=len, reverse=True)
        whole = raw.tobytes()
        if not any(s.encode() in whole for s in marks):
            return self._plain(raw, first)
        import re

        found = [(m.start(), m.end(), self.special[m[0].decode()]) for m in re.finditer(b"|".join(re.escape(s.encode()) for s in marks), whole)]
        text = np.searchsorted(first, [a for a, *_ in found], side="right") - 1
        found = [(f, t) for f, t in zip(found, text.tolist(), strict=True) if f[1] <= first[t + 1]]
        # Between the marks are texts of their own.
        cuts = np.array(sorted([*first.tolist(), *(x for (a, b, _), _ in found for x in (a, b))]))
        ids, per = self._plain(raw, cuts)
        owner = np.searchsorted(first, cuts[:-1], side="right") - 1
        marked = {(a, b): i for (a, b, i), _ in found}
        out, sizes, at = [], np.zeros(len(first) - 1, np.int64), 0
        for a, b, n, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), per.tolist(), owner.tolist(), strict=True):
            part = np.array([marked[a, b]], np.int32) if (a, b) in marked else ids[at : at + n]
            at += n
            out.append(part)
            if len(part):
                sizes[t] += len(part)
        return np.concatenate(out), sizes

    def emitted(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        self._ready()
        return self.labels[spread(self._label_at[ids], self.width[ids])]

    def decode(self, ids) -> str:
        return self.emitted(np.asarray(ids, dtype=np.int64)).tobytes().decode("utf-8", "replace")

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts(pa.array([text or ""]))[0].tolist()

    def summaries(self, texts: pa.Array) -> list[tuple[int, str, bytes]]:
        """For each text: the number of ids, the ids joined by commas and the bytes that decoding them emits."""
        ids, per = self.encode_texts(texts)
        raw = self.emitted(ids).tobytes()
        width = np.concatenate([[0], np.cumsum(self.width[ids])])
        end = np.cumsum(per)
        cuts = width[np.concatenate([[0], end])].tolist()
        written, out = self._written, []
        for k, (a, b) in enumerate(zip((end - per).tolist(), end.tolist(), strict=True)):
            out.append((b - a, ",".join([written[i] for i in ids[a:b].tolist()]), raw[cuts[k] : cuts[k + 1]]))
        return out


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        return Automaton(f.read())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _sent(df: DataFrame, vocabulary: str):
    """The compiled tables, of a size that the vocabulary sets; the file need lie on the driver's machine only."""
    return df.sparkSession.sparkContext.broadcast(automaton(vocabulary))


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each text. Null or empty texts get an empty list; a column named as the result is replaced, the text's own too."""
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType()))])
    tables = _sent(docs, vocabulary)

    def run(batches):
        auto = tables.value
        for part in slices(batches, text_col, ENCODE_BYTES):
            ids, per = auto.encode_texts(part.column(text_col))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], names=[*keep, out])
        release()

    return docs.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that a list of ids stands for. Null lists give null; bytes that are no UTF-8 become U+FFFD."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])
    tables = _sent(df, vocabulary)

    def run(batches):
        auto = tables.value
        for part in batches:
            texts = [None if x is None else auto.decode(x) for x in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text and return digests of both: id, n_tokens, ids_sha256, decoded_sha256. Rows are not grouped: repeated rows come back as often."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    tables = _sent(docs, vocabulary)

    def run(batches):
        auto = tables.value
        for part in slices(batches, 1, ENCODE_BYTES):
            n, ids, raw = zip(*auto.summaries(part.column(1)), strict=True)
            ids = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
            raw = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)], names=schema.names)
        release()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
