"""N-gram Jaccard join by filtering under several global token orders.

A document's set holds the hashes of its distinct word shingles. Two sets of similarity t or more share a token among the first
p = n - ceil(t n) + 1 of each, whatever global order the tokens stand in; so under every order. Each order here is a hash of the
token, with tokens that many documents have put last. Those are found with a counting sketch: a fixed number of counters, each the number
of (document, token) pairs of its tokens; a counter well above the mean marks its tokens. The orders need not know true frequencies to be right, only to be alike everywhere.

1. Documents of equal sets are one class; only a class's first document goes on, as its node.
2. Under the first order, nodes are put together by prefix token. Neighbours by size within a token are candidates.
3. Candidates must share a prefix token under each of the other orders too. What is left must not differ in more buckets of an odd sketch (the parity of the
   number of tokens in each bucket) than linked sets can differ in tokens; then it is verified on whole sets.
4. Verified links make components. Then, within each token, members outside the token's largest component meet the members of all
   other components, and are filtered and verified alike. So no link between different texts is missed, and a large group
   of near copies, which is one component by then, costs no pairs. The first time, links that would only close a circle are left to this step.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, lut, mix, release, slices, text_bytes, words_of
from .components import components, spanning

#: Fixed value: words are runs of bytes other than white space.
WORD = lut([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
SHINGLE = 4
#: Similarity in hundredths.
PERCENT = 85
#: Counters of the sketch as a power of two (the bits sent to executors take an eighth of as many bytes), and the rows that they are cut into.
SKETCH_BITS, SKETCH_ROWS = 23, 128
#: A token goes last if its counter is this far above the mean, in pairs and in standard deviations.
COMMON_PAIRS, COMMON_DEVIATIONS = 8, 2.0
#: Bits of an odd sketch at most, as a power of two.
ODD_BITS = 14
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Share of the members outside their token's main component that a round must leave at most for another to follow.
STALLED = 0.95
#: Ids that are sent to all executors at most.
BROADCAST_IDS = 2_000_000


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one for the whole of it, none without words."""
    raw, offsets = text_bytes(texts)
    _, _, h, first = words_of(raw, offsets, WORD)
    base = np.uint64(0xFF51AFD7ED558CCD)
    n = len(h)
    with np.errstate(over="ignore"):
        windows = h.copy()
        for k in range(1, shingle):
            m = max(0, n - k)
            windows[:m] = windows[:m] * base + h[k:]
        windows = mix(windows)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(windows[a : b - shingle + 1]))
        elif b > a:
            v = 0
            for x in h[a:b].tolist():
                v = (v * int(base) + x) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([v ^ (0xA5A5A5A5 * (b - a))], dtype=np.uint64)))
        else:
            out.append(h[:0])
    return out


def counter_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Orders:
    """Tokens of a set under the global orders. common: a bit for each counter."""

    def __init__(self, common: bytes | None, bits: int):
        self.common = np.unpackbits(np.frombuffer(common, np.uint8)).astype(bool) if common else None
        self.bits = bits

    def prefix(self, tokens: np.ndarray, order: int, size: int) -> np.ndarray:
        """The first tokens of a set under an order, as hashes under it."""
        hashed = mix(tokens ^ np.uint64(ORDERS[order]))
        if self.common is None:
            return np.sort(hashed if size >= len(hashed) else np.partition(hashed, size - 1)[:size])
        last = self.common[counter_of(tokens, self.bits)]
        rare = hashed[~last]
        if len(rare) >= size:
            return np.sort(rare if size == len(rare) else np.partition(rare, size - 1)[:size])
        often = hashed[last]
        return np.concatenate([np.sort(rare), np.sort(often)[: size - len(rare)]])


def common_counters(docs: DataFrame, text_col: str, bits: int, shingle: int = SHINGLE) -> bytes:
    """A bit for each counter: whether its tokens go last. Counters are summed in rows of fixed size, first within as many salts as the root of the number of partitions, so no task gathers more than that many of a row."""
    width = (1 << bits) // SKETCH_ROWS
    texts = docs.select(text_col)
    salts = max(1, math.isqrt(texts.rdd.getNumPartitions()))

    def count(batches):
        from pyspark import TaskContext

        counts = np.zeros(1 << bits, dtype=np.uint32)
        for part in slices(batches, 0):
            sets = [s for s in shingle_sets(part.column(0), shingle) if len(s)]
            if sets:
                at, n = np.unique(counter_of(np.concatenate(sets), bits), return_counts=True)
                counts[at] += n.astype(np.uint32)
        salt = TaskContext.get().partitionId() % salts
        for i in range(SKETCH_ROWS):
            row = counts[i * width : (i + 1) * width]
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([salt]), pa.array([zlib.compress(row.astype(np.uint8 if row.max() < 256 else np.uint32).tobytes(), 1)])], names=["i", "salt", "row"])
        del counts
        release()

    def total(table):
        out = np.zeros(width, dtype=np.int64)
        for row in table["row"]:
            row = zlib.decompress(row.as_py())
            out += np.frombuffer(row, {width: np.uint8, 4 * width: np.uint32, 8 * width: np.int64}[len(row)])
        return out

    def summed(table):
        row = total(table)
        kind = next(k for k in (np.uint8, np.uint32, np.int64) if row.max() <= np.iinfo(k).max)
        return pa.table({"i": table["i"][:1], "row": pa.array([zlib.compress(row.astype(kind).tobytes(), 1)])})

    def ended(table):
        row = total(table)
        return pa.table({"i": table["i"][:1], "row": pa.array([zlib.compress(row.tobytes(), 1)]), "n": pa.array([int(row.sum())])})

    part = texts.mapInArrow(count, "i long, salt long, row binary").groupBy("i", "salt").applyInArrow(summed, "i long, row binary")
    rows = checkpointed(part.groupBy("i").applyInArrow(ended, "i long, row binary, n long"))
    pairs = rows.agg(F.sum("n")).first()[0] or 0
    mean = pairs / (1 << bits)
    level = mean + max(COMMON_PAIRS, COMMON_DEVIATIONS * math.sqrt(mean))

    def marked(batches):
        for batch in batches:
            bit = [np.packbits(np.frombuffer(zlib.decompress(r), np.int64) > level).tobytes() for r in batch.column("row").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(bit)], names=["i", "bits"])

    # SKETCH_ROWS rows of width / 8 bytes: a fixed size.
    got = {r["i"]: bytes(r["bits"]) for r in rows.mapInArrow(marked, "i long, bits binary").collect()}
    return b"".join(got.get(i, bytes(width // 8)) for i in range(SKETCH_ROWS))


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    return tuple(int(mix(x).sum().astype(np.int64)) for x in (s, s ^ np.uint64(0xD1B54A32D192ED03))) if len(s) else (0, 0)


def _described(docs: DataFrame, orders, id_col: str, text_col: str, percent: int, shingle: int) -> DataFrame:
    """For each row: id, n, the class of its set (two hashes), and the prefix under the first order."""
    schema = T.StructType([T.StructField("id", T.LongType()), *T._parse_datatype_string("n long, c long, c2 long, p0 binary").fields])

    def run(batches):
        by = Orders(*orders.value)
        for part in slices(batches, 1):
            sets = shingle_sets(part.column(1), shingle)
            c, c2 = zip(*map(_sums, sets), strict=True)
            p0 = [by.prefix(s, 0, prefix_size(len(s), percent)).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(c, pa.int64()), pa.array(c2, pa.int64()), pa.array(p0, pa.binary())], names=schema.names)
        release()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def _postings(nodes: DataFrame) -> DataFrame:
    """(token, node, n, i) for each prefix token under the first order, i its place there from 0."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tokens = [np.frombuffer(p, np.int64) for p in part.column("p0").to_pylist()]
                size = [len(t) for t in tokens]
                if sum(size):
                    node, n = (np.repeat(part.column(k).to_numpy(), size) for k in ("node", "n"))
                    i = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(i)], names=["token", "node", "n", "i"])

    return nodes.select("node", "n", "p0").mapInArrow(run, "token long, node long, n int, i int")


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens in each bucket, as bits; more buckets for larger sets."""
    bits = min(ODD_BITS, max(6, int(len(s)).bit_length()))
    bucket = mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64((1 << bits) - 1)
    return np.packbits((np.bincount(bucket.astype(np.int64), minlength=1 << bits) & 1).astype(bool), bitorder="little")


def odd_buckets(a: np.ndarray, b: np.ndarray) -> int:
    """In how many buckets two sketches differ, after folding the larger: never more than the tokens in which the sets differ."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _verified(pairs: DataFrame, filters: DataFrame, texts, percent: int, shingle: int, once: bool = False) -> DataFrame:
    """The pairs (a, b) that pass the filters of the other orders and then the test on whole sets, which are made from the texts of what is left. once: of what passes the filters, pairs that close a circle may be left out."""
    for k in "ab":
        pairs = pairs.join(filters.select(F.col("node").alias(k), *(F.col(x).alias(k + x) for x in ("n", "p1", "p2", "odd"))), k)

    def meet(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in ("an", "bn"))
            most = ((100 - percent) * (na + nb) // (100 + percent)).tolist()
            cols = [batch.column(k).to_pylist() for k in ("ap1", "bp1", "ap2", "bp2", "aodd", "bodd")]
            keep = []
            for limit, a1, b1, a2, b2, x, y in zip(most, *cols, strict=True):
                keep.append(
                    all(len(np.intersect1d(np.frombuffer(p, np.uint16), np.frombuffer(q, np.uint16), assume_unique=True)) for p, q in ((a1, b1), (a2, b2)))
                    and odd_buckets(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= limit
                )
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = checkpointed(pairs.select("a", "b", *(k + x for k in "ab" for x in ("n", "p1", "p2", "odd"))).mapInArrow(meet, "a long, b long"))
    if once:
        left = checkpointed(spanning(left))
    sets = checkpointed(texts(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), _whole_sets(shingle), "node long, s binary"))
    both = left.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long")


def _own(part: pa.RecordBatch, shingle: int) -> list[tuple[int, np.ndarray]]:
    """(node, set) of the texts that are the nodes' own; an id that stands in several rows brings other texts."""
    keys = zip(*(part.column(k).to_pylist() for k in ("node", "c", "c2")), strict=True)
    return [(node, s) for (node, *of), s in zip(keys, shingle_sets(part.column("text"), shingle), strict=True) if _sums(s) == tuple(of)]


def _whole_sets(shingle: int):
    def run(batches):
        for part in slices(batches, "text"):
            found = _own(part, shingle)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["node", "s"])
        release()

    return run


def _filters(orders, percent: int, shingle: int):
    """(node, n, p1, p2, odd): the prefixes under the other orders, as 16-bit hashes (equal ones may stand for other tokens, so the filter lets no link go), and the odd sketch."""

    def run(batches):
        by = Orders(*orders.value)
        for part in slices(batches, "text"):
            found = _own(part, shingle)
            p = [[np.unique((by.prefix(s, k, prefix_size(len(s), percent)) >> np.uint64(48)).astype(np.uint16)).tobytes() for _, s in found] for k in (1, 2)]
            odd = [odd_sketch(s).tobytes() for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int32()), *(pa.array(x, pa.binary()) for x in (*p, odd))], names=["node", "n", "p1", "p2", "odd"])
        release()

    return run


def _side(ids: DataFrame) -> DataFrame:
    """A checkpointed table of ids as the other side of a join: it goes to all executors if its rows are few, else both sides are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _pairs(t: np.ndarray, c: np.ndarray, n: np.ndarray, g: np.ndarray, percent: int, order: np.ndarray) -> np.ndarray:
    """Candidates within a token: neighbours by size, and neighbours in an order of their own; tokens of one order number have the same. Neighbours of one g are left out."""
    deal = np.lexsort((mix(c.astype(np.uint64) ^ mix(order.astype(np.uint64))), t))
    found = []
    for order in (np.arange(len(t)), deal):
        x, y = order[:-1], order[1:]
        ok = (t[x] == t[y]) & (g[x] != g[y]) & _near(n[x], n[y], percent)
        found.append(np.stack([np.minimum(c[x[ok]], c[y[ok]]), np.maximum(c[x[ok]], c[y[ok]])]))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _near(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m).astype(np.int64) >= percent * np.maximum(n, m).astype(np.int64)


def _met(percent: int):
    """Of postings in order: candidate pairs (a, b), and the postings (token, a, n, i) that have a neighbour of a size near enough. Members between two of a
    candidate pair are of sizes between theirs, so every member of a candidate pair has one. A partition's first and last posting stay, as their neighbours may lie in others."""

    def run(batches):
        held, linked = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in ("token", "node", "n", "i")]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            t, c, n, _ = cols
            near = (t[1:] == t[:-1]) & _near(n[1:], n[:-1], percent)
            keep = np.concatenate([[linked], near])
            keep[:-1] |= near
            pairs = _pairs(t, c, n, c, percent, t & 1)  # two orders, so that members of a large group do not meet others under each token
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[0]), pa.array(pairs[1]), none.cast(pa.int32()), none.cast(pa.int32())], names=["token", "a", "b", "n", "i"])
            yield shared([x[:-1][keep[:-1]] for x in cols])
            held, linked = [x[-1:] for x in cols], bool(keep[-1])
        if held is not None:
            yield shared(held)

    def shared(cols):
        t, c, n, i = map(pa.array, cols)
        return pa.RecordBatch.from_arrays([t, c, pa.nulls(len(t), pa.int64()), n, i], names=["token", "a", "b", "n", "i"])

    return run


def _again(percent: int, seed: int):
    """Candidates of open members, whose components k are known, in another order for each token and seed."""

    def run(batches):
        before = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in ("token", "node", "n", "k")]
            if not batch.num_rows:
                continue
            if before is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(before, cols, strict=True)]
            before = [x[-1:] for x in cols]
            t, c, n, g = cols
            pairs = _pairs(t, c, n, g, percent, t + seed)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _open(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """Members (token, node, n, i, k, main) of the tokens that hold several components; k is a member's component, main that of the token's components that is largest over all."""
    size = checkpointed(joined.groupBy("component").agg(F.count("*").alias("size")))
    of = joined.join(_side(size), "component").select("node", F.col("component").alias("k"), "size")
    of = checkpointed(of.unionByName(size.select(F.col("component").alias("node"), F.col("component").alias("k"), "size")))
    member = shared.join(_side(of), "node", "left").select("token", "node", "n", "i", F.coalesce("k", "node").alias("k"), F.coalesce("size", F.lit(0)).alias("size"))
    member = checkpointed(member)
    # Summed before the shuffle, and joined back: a token of many members can be split.
    several = member.groupBy("token").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max(F.struct("size", "k")).alias("most")).where("low <> high")
    return member.join(several.select("token", F.col("most.k").alias("main")), "token").select("token", "node", "n", "i", "k", "main")


def _possible(percent: int) -> F.Column:
    """Whether two sets (na, nb) can be similar enough when they first share the tokens at places ia and ib: by their sizes, and by the tokens that are left."""
    na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    most = F.least(na - F.col("ia"), nb - F.col("ib"))
    return sizes & (most * (100 + percent) >= (na + nb) * percent)


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (smallest id that links lead to, its own included).

    Null texts and texts without words have an empty set and stand alone. Repeated rows come back as often, in one component;
    ids are long numbers, and rows of a null id get the component's smallest id, or null alone. Other columns are not read."""
    spark = docs.sparkSession
    orders = spark.sparkContext.broadcast((common_counters(docs, text_col, SKETCH_BITS, shingle), SKETCH_BITS))
    # The rows lie in the shared folder, so the numbers given to them stay.
    rows = checkpointed(_described(docs, orders, id_col, text_col, percent, shingle)).withColumn("row", F.monotonically_increasing_id())
    full = rows.where("n > 0")
    unique = full.where("id IS NULL").isEmpty() and full.groupBy("id").count().where("count > 1").isEmpty()
    full = full.withColumn("node", F.col("id" if unique else "row"))
    # A class is known by two hashes of its set and its size; of its copies the first goes on. Only the others are looked up.
    copied = checkpointed(full.groupBy("c", "c2", "n").agg(F.min("node").alias("first"), F.min("id").alias("least"), F.count("*").alias("m")).where("m > 1").drop("m"))
    gone = checkpointed(full.select("node", "c", "c2", "n").join(_side(copied), ["c", "c2", "n"]).where("node <> first").select("node"))
    lead = full.select("node", "id", "c", "c2", "n", "p0").join(_side(gone), "node", "left_anti")
    # Neighbours by size within a token. A range partition may part a token; what is parted is found in the second step.
    met = checkpointed(_postings(lead).repartitionByRange("token", "n", "node").sortWithinPartitions("token", "n", "node").mapInArrow(_met(percent), "token long, a long, b long, n int, i int"))
    shared = met.where("b IS NULL").select("token", F.col("a").alias("node"), "n", "i")
    wanted = checkpointed(shared.select("node").distinct().join(lead.select("node", "id", "c", "c2"), "node"))

    def texts(nodes: DataFrame | None, make, schema: str) -> DataFrame:
        """What make does of the nodes' texts, a row for each node."""
        asked = wanted if nodes is None else checkpointed(wanted.join(nodes, "node"))
        given = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
        found = given.join(_side(asked), F.col("_id").eqNullSafe(F.col("id"))).select("node", "c", "c2", "text").mapInArrow(make, schema)
        return found if unique else found.dropDuplicates(["node"])

    filters = checkpointed(texts(None, _filters(orders, percent, shingle), "node long, n int, p1 binary, p2 binary, odd binary"))
    verified = lambda pairs, once=False: _verified(pairs, filters, texts, percent, shingle, once)

    links = checkpointed(verified(met.where("b IS NOT NULL").select("a", "b").distinct(), True))
    # Members that no link has joined to most of their group yet meet others again, as long as that joins many; then all that is left is tried.
    open_, outside = shared, None
    for seed in itertools.count(1):
        open_ = checkpointed(_open(open_.select("token", "node", "n", "i"), checkpointed(components(links))))
        before, outside = outside, open_.where("k <> main").select("node").distinct().count()
        if not outside or before is not None and outside > before * STALLED:
            break
        again = open_.repartitionByRange("token", "n", "node").sortWithinPartitions("token", "n", "node").mapInArrow(_again(percent, seed), "a long, b long").distinct()
        links = checkpointed(links.union(verified(again)))
    others = open_.where("k <> main").select("token", "main", F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("k").alias("ka"))
    every = open_.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("k").alias("kb"))
    cross = others.join(every, (others["token"] == every["token"]) & (F.col("ka") != F.col("kb")) & ((F.col("kb") == F.col("main")) | (F.col("a") < F.col("b"))) & _possible(percent))
    tried = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    final = checkpointed(components(links.union(verified(tried))))
    out = full.select("row", "id", "node", "n", "c", "c2").join(_side(copied), ["c", "c2", "n"], "left").select("row", "id", "n", F.coalesce("first", "node").alias("node"), F.coalesce("least", "id").alias("least"))
    out = out.join(_side(final), "node", "left").withColumn("component", F.coalesce("component", "node"))
    if unique:
        found = out.select("id", "n", F.col("component").alias("component_id"))
    else:
        smallest = checkpointed(out.groupBy("component").agg(F.min("least").alias("component_id")))
        found = out.join(_side(smallest), "component").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(empty).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The row of the smallest id of each component, with all columns; of several rows of that id one stays. Rows of a null id stay."""
    found = ngram_jaccard(docs, id_col, text_col, percent, shingle).select(F.col(id_col).alias("_id"), "component_id")
    gone = checkpointed(found.where("_id IS NOT NULL AND _id <> component_id").select("_id").distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(side, docs[id_col] == gone["_id"], "left_anti")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_id"))
    if again.isEmpty():
        return kept
    return kept.join(again, kept[id_col] == again["_id"], "left_anti").unionByName(kept.join(again, kept[id_col] == again["_id"], "left_semi").dropDuplicates([id_col]))
