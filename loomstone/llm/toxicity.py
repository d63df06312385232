"""Toxicity by multiple-instance learning: only documents have labels, sentences get scores.

A sentence's score is sigmoid(b + sum of g(w) over its distinct words); a word's g sums the weights of its hashed parts: the word
and its beginnings. A document's score joins its sentences by noisy-or, 1 - prod(1 - s): one bad sentence makes a bad document. The
likelihood of the document labels is maximised through the noisy-or, so that the gradient goes to the sentences that explain a label.
The sentences at or above the threshold are the offending ones.

The fit uses at most SAMPLE labelled documents, those with the smallest hash of the id, in one task; of their texts one that does not fit into what is left of
SAMPLE_BYTES is passed over, the others are taken whole. Scoring is one pass over all documents.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, slices

#: Labelled documents that the fit uses at most, and the bytes of text that it takes of them at most.
SAMPLE, SAMPLE_BYTES = 10_000, 48 << 20
DIM = 1 << 17
EPOCHS, RATE, L2, BATCH, MIN_DOCS = 20, 0.8, 0.05, 256, 8
PREFIXES = range(3, 7)
#: Words whose parts the fit remembers at a time; more are worked out anew.
KNOWN = 60_000
SENTENCE = re.compile(r"[.!?\n。！？]+")
WORD = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[int]:
    """The hashed parts of a word: the word and its beginnings."""
    n = len(word)
    return [zlib.crc32(b"=" + word.encode()) % DIM, *(zlib.crc32(b"^" + word[:k].encode()) % DIM for k in PREFIXES if k <= n)]


def sentences(text: str) -> list[list[str]]:
    """The distinct words of each sentence that has words, in the order they first stand."""
    out = []
    for s in SENTENCE.split(text.lower()):
        if words := list(dict.fromkeys(WORD.findall(s))):
            out.append(words)
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """Where the sentences that have words stand, in code points."""
    out, at = [], 0
    for m in [*SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        if WORD.search(text, at, end):
            out.append((at, end))
        at = m.end() if m else end
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of all sentences' words, one sentence after another, the length of each sentence and the sentences of each document. Kept as plain numbers; only KNOWN words
    are remembered at a time. Parts that few documents have would explain a label only by chance, so they are left out."""
    known: dict[str, list[int]] = {}
    often = np.ones(DIM, dtype=bool)

    def of(word: str) -> list[int]:
        got = known.get(word)
        if got is None:
            if len(known) >= KNOWN:
                known.clear()
            got = known[word] = [p for p in parts(word) if often[p]]
        return got

    in_docs = np.zeros(DIM, dtype=np.int64)
    for text in texts:
        if words := set(WORD.findall(text.lower())):
            in_docs[list({p for w in words for p in of(w)})] += 1
    known.clear()
    often = in_docs >= MIN_DOCS
    flat, sent_len, doc_len = array("i"), array("q"), array("q")
    for text in texts:
        rows = sentences(text)
        doc_len.append(len(rows))
        for words in rows:
            at = len(flat)
            for w in words:
                flat.extend(of(w))
            sent_len.append(len(flat) - at)
    return tuple(np.array(x) for x in (flat, sent_len, doc_len))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad on the noisy-or likelihood. Documents are taken in a fixed, shuffled order."""
    flat, sent_len, doc_len = features(texts)
    weights, bias = np.zeros(DIM), -4.0
    if not len(sent_len):
        return weights, -20.0 if not labels.any() else bias
    sent_at = np.concatenate([[0], np.cumsum(sent_len)])
    doc_at = np.concatenate([[0], np.cumsum(doc_len)])
    g2, b2 = np.full(DIM, 0.1), 10.0
    rng = np.random.default_rng(7)
    y_all = labels.astype(float)
    for _ in range(epochs):
        order = rng.permutation(len(doc_len))
        for at in range(0, len(order), BATCH):
            docs = [d for d in order[at : at + BATCH] if doc_len[d]]
            if not docs:
                continue
            sents = np.concatenate([np.arange(doc_at[d], doc_at[d + 1]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), [doc_len[d] for d in docs])
            sizes = sent_at[sents + 1] - sent_at[sents]
            sent_of = np.repeat(np.arange(len(sents)), sizes)
            take = np.repeat(sent_at[sents] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            ids = flat[take]
            z = bias + np.bincount(sent_of, weights[ids], len(sents))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            log_q = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(docs))
            q = np.exp(log_q)
            y = y_all[docs]
            # dLoss/dz: p for a clean document, -(q / (1 - q)) p for a toxic one.
            slope = np.where(y > 0, -np.minimum(q / np.maximum(1 - q, 1e-9), 1e6), 1.0)[owner] * p
            grad = np.bincount(ids, slope[sent_of], DIM)
            grad += L2 * weights
            g2 += grad**2
            weights -= RATE * grad / np.sqrt(g2)
            step = slope.sum()
            b2 += step**2
            bias -= RATE * step / np.sqrt(b2)
    return weights, float(bias)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self._known = weights, bias, {}

    def forget(self) -> None:
        """Empty the table that grows."""
        self._known.clear()
        release()

    def word(self, w: str) -> float:
        g = self._known.get(w)
        if g is None:
            if len(self._known) > 150_000:
                self._known.clear()
            g = self._known[w] = float(self.weights[parts(w)].sum())
        return g

    def sentence_scores(self, text: str | None) -> list[float]:
        if not text:
            return []
        known, word, bias = self._known, self.word, self.bias
        sums = []
        for s in SENTENCE.split(text.lower()):
            if words := set(WORD.findall(s)):
                # Sorted, so that the sum does not depend on the order of a set.
                sums.append(bias + sum(sorted([known[w] if w in known else word(w) for w in words])))
        return (1 / (1 + np.exp(-np.clip(np.array(sums), -30, 30)))).tolist() if sums else []

    def score(self, text: str | None) -> float:
        scores = self.sentence_scores(text)
        return float(-np.expm1(np.log1p(-np.minimum(np.array(scores), 1 - 1e-12)).sum())) if scores else 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int | None = 5):
    """A broadcast Scorer. held_out: rows whose crc32 of the id modulo it is 0 are not learnt from.

    Of labels, null ids and labels are left out and an id with several labels counts by the largest; of several texts of an id the least is learnt from. Without labels every
    score is near 0. Texts above a quarter of SAMPLE_BYTES are scored but not learnt from."""
    spark = docs.sparkSession
    kept = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    if held_out:
        kept = kept.where(F.crc32(F.col("_id").cast("string")) % held_out != 0)
    # The sample's ids are bounded, so they may go to all executors; documents are read once, without a shuffle.
    sample = kept.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    rows = rows.join(F.broadcast(sample), "_id").where(F.octet_length("_text") <= SAMPLE_BYTES // 4)
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_text").alias("_text"))

    def learn(batches):
        texts, marks, used = [], [], 0
        for batch in batches:
            for y, text in zip(batch.column("_y").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                size = len(text.encode())
                if used + size <= SAMPLE_BYTES:
                    used += size
                    texts.append(text)
                    marks.append(y)
        weights, bias = fit(texts, np.array(marks, dtype=float))
        del texts
        release()
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()]), pa.array([bias])], names=["weights", "bias"])

    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id")
    got = rows.mapInArrow(learn, "weights binary, bias double").collect()
    weights, bias = (np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]) if got else fit([], np.zeros(0))
    return spark.sparkContext.broadcast(Scorer(weights.astype(float), bias))


def toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: id, score, predicted, and offending: the spans (start, end, score) of sentences at or above the threshold.

    Null and empty texts score 0. Repeated rows come back as often; only id and text are read."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("score double, predicted int, offending array<struct<start:int,end:int,score:double>>").fields])

    def run(batches):
        scorer = model.value
        for part in slices(batches, 1):
            scores, found = [], []
            for text in part.column(1).to_pylist():
                each = np.array(scorer.sentence_scores(text))
                scores.append(float(-np.expm1(np.log1p(-np.minimum(each, 1 - 1e-12)).sum())) if len(each) else 0.0)
                found.append([{"start": a, "end": b, "score": s} for (a, b), s in zip(spans(text), each.tolist(), strict=False) if s >= threshold] if len(each) and each.max() >= threshold else [])
            score = np.array(scores)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found, pa.list_(span))], names=schema.names)
        scorer.forget()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold. Null and empty texts stay."""

    def run(batches):
        scorer = model.value
        for part in slices(batches, text_col):
            yield part.filter(pa.array([scorer.score(t) < threshold for t in part.column(text_col).to_pylist()], pa.bool_()))
        scorer.forget()

    return docs.mapInArrow(run, docs.schema)
