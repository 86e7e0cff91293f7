"""Quality classifier: supervised subword embeddings.

A text's features are its words, pairs of words that follow each other, and
its n-grams of characters, each hashed to one of BUCKETS vectors; their mean
goes through a linear layer and softmax.  Vectors and layer are learned
together by stochastic gradient descent in numpy, a text a step.  As the layer
is linear, a bucket adds one number to a text's score, so scoring is a look-up
in an array of these that goes to every task, in one reading of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

BUCKETS, WIDTH = 1 << 17, 16
NGRAMS = (3, 4)
EPOCHS, RATE = 6, 0.2
#: Labelled rows that are learned from at most, and their characters; those whose ids hash lowest.
SAMPLE_ROWS, SAMPLE_CHARS = 5_000, 40_000_000
#: Characters that are read together; a longer text is read in pieces, cut at white space where there is any.
PIECE = 1 << 20
#: One in so many labelled rows is held out; and the score from which a text is predicted to be good.
FOLDS, THRESHOLD = 5, 0.3

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, ..., base**(n-1) modulo 2**64, doubled up."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_UP, _DOWN = _powers(_BASE, 1 << 12), _powers(pow(_BASE, -1, 1 << 64), 1 << 12)


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    h = (hashes + np.uint64(kind)) * _MIX
    h ^= h >> np.uint64(32)
    return ((h * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every feature of the texts, a kind at a time: which text, which bucket."""
    global _UP, _DOWN
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    if len(_UP) <= n:
        _UP, _DOWN = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes[blank] = 32
    sums = np.concatenate([np.zeros(1, np.uint64), ((codes + np.uint64(1)) * _UP[:n]).cumsum(dtype=np.uint64)])

    def hashes(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[begin]) * _DOWN[begin]

    yield np.arange(len(texts)), _bucket(np.zeros(len(texts), np.uint64), 1)  # every text has one feature at least
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    words, of = hashes(begin, end), text[begin]
    yield of, _bucket(words, 2)
    pair = np.flatnonzero(of[1:] == of[:-1])
    # The difference of the words' hashes: 0 for a word that is repeated, whichever it is.
    yield of[pair], _bucket(words[pair + 1] - words[pair], 3)
    for size in NGRAMS:
        at = np.arange(max(n - size, 0))
        at = at[text[at] == text[at + size]]  # the line end after a text is not in it
        yield text[at], _bucket(hashes(at, at + size), 3 + size)


def _pieces(text: str) -> Iterator[str]:
    while len(text) > PIECE:
        cut = max(text.rfind(" ", 0, PIECE), text.rfind("\n", 0, PIECE)) + 1 or PIECE
        yield text[:cut]
        text = text[cut:]
    yield text


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Pieces of the texts, about PIECE characters at a time, with the text that each is of."""
    of, block, size = [], [], 0
    for k, text in enumerate(texts):
        for piece in _pieces(text or ""):
            of.append(k)
            block.append(piece)
            size += len(piece)
            if size >= PIECE:
                yield np.array(of), block
                of, block, size = [], [], 0
    if block:
        yield np.array(of), block


def counted(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its different buckets and how often it has each."""
    for text in texts:
        found = [b for _, block in _blocks([text]) for _, b in _features(block)]
        yield np.unique(np.concatenate(found), return_counts=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the buckets and the layer's weights, learned from (buckets, counts, label) by steps of one text in a shuffled order, the rate falling to 0."""
    dice = np.random.default_rng(seed)
    vectors = dice.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, 2), np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in dice.permutation(len(rows)):
            buckets, counts, label = rows[k]
            share = (counts / counts.sum()).astype(np.float32)
            own = vectors[buckets]
            mean = share @ own
            out = np.exp((z := mean @ layer) - z.max())
            off = out / out.sum()
            off[label] -= 1
            step = rate * (1 - done / steps)
            back = layer @ off
            layer -= step * np.outer(mean, off)
            # A bucket moves by its share of the text, scaled so that frequent ones learn as fast as a short text's.
            vectors[buckets] = own - step * np.outer(share * min(len(buckets), 100), back)
            done += 1
    return vectors, layer


def margins(vectors: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """What each bucket adds to label 1 over label 0."""
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64)


def score_texts(texts: list[str | None], margin: np.ndarray) -> np.ndarray:
    """Label 1's softmax share for each text."""
    sums, n = np.zeros(len(texts)), np.zeros(len(texts))
    for of, block in _blocks(texts):
        for at, buckets in _features(block):
            sums += np.bincount(of[at], margin[buckets], len(texts))
            n += np.bincount(of[at], minlength=len(texts))
    return 1 / (1 + np.exp(-sums / np.maximum(n, 1)))


def fold(key: Column) -> Column:
    """0 for what is held out; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


@dataclass
class Model:
    """What each bucket adds to label 1 over label 0, and from how many rows that was learned."""

    margin: np.ndarray
    n_rows: int


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from labelled documents that are not held out, SAMPLE_ROWS and
    SAMPLE_CHARS at most.

    Labels other than 0 and 1 are left out.  Tasks turn the sampled texts into
    counts of buckets; one task learns from them, as steps follow each other;
    the sample's bound is its bound.  Without any row every margin is 0.
    """
    own = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"))
    ids = own.filter(F.col("label").isin(0, 1) & (fold(F.col("key")) != 0))
    ids = stored(ids.orderBy(F.xxhash64("key"), "key", "label").limit(SAMPLE_ROWS), "sample")
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key")
    # The sample's rows one after another, up to its characters: few rows, in one task.
    sizes = texts.groupBy("key", "label").agg(F.sum(F.length("text")).alias("chars"))
    so_far = F.sum("chars").over(Window.orderBy(F.xxhash64("key"), "key", "label"))
    picked = sizes.withColumn("so_far", F.coalesce(so_far, F.lit(0))).filter(F.col("so_far") <= SAMPLE_CHARS).select("key", "label")
    texts = texts.join(F.broadcast(stored(picked, "sample")), ["key", "label"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(counted(part["text"].to_pylist()))
                lists = [pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.record_batch([part["key"], part["label"], *lists], names=["key", "label", "buckets", "counts"])

    counts = texts.mapInArrow(count, "key long, label int, buckets array<int>, counts array<int>")

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.append_column("size", pc.list_value_length(rows["buckets"])).sort_by([(x, "ascending") for x in ("key", "label", "size")])
        columns = [rows[x].combine_chunks() for x in ("buckets", "counts", "label")]
        vectors, layer = fit([(columns[0][k].values.to_numpy(), columns[1][k].values.to_numpy(), columns[2][k].as_py()) for k in range(len(rows))])
        return pa.table({"n_rows": pa.array([len(rows)], pa.int64()), "margin": pa.array([margins(vectors, layer).tobytes()], pa.binary())})

    learned = stored(counts.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "n_rows long, margin binary"), "model").first()
    return Model(np.frombuffer(learned["margin"]), learned["n_rows"]) if learned else Model(np.zeros(BUCKETS), 0)


def judge(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every document, by its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model.margin)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part["key"], pa.array(score_texts(part["text"].to_pylist(), shared.value))], names=["key", "score"])

    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(scored, "key long, score double")
    held = F.coalesce(fold(F.col("key")) == 0, F.lit(False))
    return found.select(F.col("key").alias(key), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have the feature that every text has, and its score.
    A null doc_id is never held out, nor ever labelled.  Repeated rows get the
    same score; repeated labels count each.  An empty table of documents gives
    an empty result, one of labels scores of 0.5.  Other columns are ignored,
    whatever their names; labels, lang, source and doc_id are in no score.
    """
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
