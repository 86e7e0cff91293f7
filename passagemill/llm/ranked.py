"""Ranked lexical search over inverted treaps.

Documents stay in the tasks that read them: each cuts its texts into terms and
closes a shard of the index whenever it has enough.  A term's postings in a
shard are a treap: in order of documents as a search tree, every node's impact
at least that of its children.  A node's impact is thus the most that any
posting below it adds, and the treap's top inside any interval of documents the
most that the interval gets from the term.

A search walks all treaps of an item's terms at once.  It takes the interval
whose summed maxima are largest, scores the document at the heaviest top, and
goes on with the intervals on both sides of it, each term's treap entered at
its top there.  Intervals whose summed maxima fall short of the k-th best so
far are left out whole; those with few postings are summed up at once.  A task
takes its shards one after another and carries the k-th best along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Runs of these are terms, once A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a shard at most, numbered by 16 bits, and terms with repeats from which it is closed.
SHARD_DOCS, SHARD_TERMS = 1 << 16, 4_000_000
#: Postings of an interval that are summed up at once.
FEW_POSTINGS = 4_096
#: Items of a block, whose best documents a task holds.
BLOCK_ITEMS = 256
#: Terms asked for up to which they go to every task; more are joined by shuffle.
BROADCAST_TERMS = 100_000
TOP = 50

_CUT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "shard long, term string, df int, keys array<long>, docs binary, impacts binary, lefts binary, rights binary"
_INDEX_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("keys", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("docs", "impacts", "lefts", "rights"))])


class _Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _nearest(impacts: np.ndarray, at: np.ndarray, ties: bool) -> np.ndarray:
    """From a first candidate for each (-1: none), the nearest posting with a larger impact, or an equal one if ties; in jumps over what others have found."""
    going = np.flatnonzero(at >= 0)
    while len(going):
        short = impacts[at[going]] < impacts[going] if ties else impacts[at[going]] <= impacts[going]
        going = going[short]
        at[going] = at[at[going]]
        going = going[at[going] >= 0]
    return at


def treaps(impacts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right child of each posting, as places in its term's list (itself: none); lists begin at starts.

    Of equal impacts the earlier is above.  A node's parent is the lower of the
    nearest higher ones on its two sides.
    """
    n = len(impacts)
    own = np.arange(n)
    before, after = own - 1, own + 1
    before[starts] = -1
    after[np.append(starts[1:], n)[:] - 1] = -1
    before = _nearest(impacts, before, ties=True)
    after = _nearest(impacts, after, ties=False)
    parent = np.where((after < 0) | ((before >= 0) & (impacts[before] < impacts[after])), before, after)
    left, right = own.copy(), own.copy()
    child = np.flatnonzero(parent >= 0)
    smaller = child[child < parent[child]]
    larger = child[child > parent[child]]
    left[parent[smaller]], right[parent[larger]] = smaller, larger
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    return left - begin, right - begin


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value for each list of values."""
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _shard(shard: int, codes: _Codes, terms: list[np.ndarray], keys: list, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of a closed shard: its documents' keys, then each term's treap."""
    lengths = [len(x) for x in terms]
    yield pa.record_batch([pa.array([x], f.type) for x, f in zip((shard, None, None, keys, None, None, None, None), _INDEX_SCHEMA, strict=True)], schema=_INDEX_SCHEMA)
    if not sum(lengths):
        return
    words = list(codes)
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    pairs = np.concatenate([(rank[x] << 16) | k for k, x in enumerate(terms)])
    pairs, tf = np.unique(pairs, return_counts=True)
    # n * N may be more than 64 bits hold, its share of L is not.
    norm = np.array([20 * (50 + 50 * n * n_docs // n_terms) for n in lengths], np.int64)
    docs = (pairs & 0xFFFF).astype(np.uint16)
    impacts = (1_000_000_000 * tf // (1000 * tf + norm[docs])).astype(np.uint32)
    starts = np.searchsorted(pairs >> 16, np.arange(len(words)))
    left, right = treaps(impacts, starts)
    names = pa.array([words[k].decode() for k in order], pa.string())
    columns = [pa.array(np.full(len(words), shard)), names, pa.array(np.diff(np.append(starts, len(pairs))).astype(np.int32)), pa.nulls(len(words), pa.list_(pa.int64()))]
    columns += [_binary(x, starts) for x in (docs, impacts, left.astype(np.uint16), right.astype(np.uint16))]
    whole = pa.record_batch(columns, schema=_INDEX_SCHEMA)
    for at in range(0, len(words), 20_000):
        yield whole.slice(at, 20_000)


@dataclass
class TreapIndex:
    """The stored shards, and what impacts and weights count on: documents with terms, and terms with repeats."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> TreapIndex:
    """The index of all documents and all their terms, written to the shared folder.

    Texts are not shuffled, but where there are fewer partitions than cores.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    length = F.regexp_count("text", F.lit(TERM))
    n_docs, n_terms = rows.select(length.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < width:
        rows = rows.repartition(width)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        codes, terms, keys, size = _Codes(), [], [], 0
        for batch in batches:
            for k, t in zip(batch["key"], batch["text"].cast(pa.binary()), strict=True):
                words = (t.as_py() or b"").translate(_CUT).split()
                if not words:
                    continue
                terms.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                keys.append(k.as_py())
                size += len(words)
                if len(keys) == SHARD_DOCS or size >= SHARD_TERMS:
                    yield from _shard(first + made, codes, terms, keys, n_docs, n_terms)
                    codes, terms, keys, size, made = _Codes(), [], [], 0, made + 1
        if keys:
            yield from _shard(first + made, codes, terms, keys, n_docs, n_terms)

    return TreapIndex(stored(rows.mapInArrow(shards, INDEX), "treaps"), n_docs, n_terms)


class _Treap:
    """A term's postings in a shard, with the term's weight."""

    __slots__ = ("docs", "impacts", "lefts", "rights", "weight", "_impact", "_doc")

    def __init__(self, weight: int, docs: bytes, impacts: bytes, lefts: bytes, rights: bytes):
        self.weight = weight
        self.docs, self.impacts = np.frombuffer(docs, np.uint16), np.frombuffer(impacts, np.uint32)
        self.lefts, self.rights = (memoryview(x).cast("H") for x in (lefts, rights))
        self._impact, self._doc = memoryview(impacts).cast("I"), memoryview(docs).cast("H")

    def root(self) -> int:
        return int(self.impacts.argmax())

    def most(self, at: int) -> int:
        return self.weight * self._impact[at]

    def doc(self, at: int) -> int:
        return self._doc[at]

    def within(self, at: int, a: int, b: int) -> int:
        """The top of the postings a to b, from a node above them."""
        while not a <= at < b:
            at = self.rights[at] if at < a else self.lefts[at]
        return at


class Best:
    """The k best of an item: scores, largest first, equal ones by key, null first."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores = self.keys = np.zeros(0, np.int64)
        self.full = np.zeros(0, bool)

    def add(self, scores: np.ndarray, keys: np.ndarray, full: np.ndarray) -> None:
        scores, keys, full = (np.concatenate(x) for x in ((self.scores, scores), (self.keys, keys), (self.full, full)))
        order = np.lexsort((keys, full, -scores))[: self.k]
        self.scores, self.keys, self.full = scores[order], keys[order], full[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])


def search_shard(lists: list[_Treap], keys: np.ndarray, full: np.ndarray, best: Best) -> int:
    """Adds a shard's documents to an item's best; returns the postings that were looked at."""
    spans = [(t, 0, len(t.docs), t.root()) for t in lists]
    waiting = [(-sum(t.most(r) for t, _, _, r in spans), 0, spans)] if spans else []
    seen = pushed = 0
    while waiting:
        bound, _, spans = heapq.heappop(waiting)
        if -bound < best.floor:
            break
        size = sum(b - a for _, a, b, _ in spans)
        if size <= FEW_POSTINGS:
            seen += size
            docs = np.concatenate([t.docs[a:b] for t, a, b, _ in spans])
            # Sums of integers that doubles hold exactly: a score is below 2**53.
            parts = np.concatenate([t.impacts[a:b] * np.float64(t.weight) for t, a, b, _ in spans])
            low = int(docs.min())
            scores = np.bincount(docs - low, parts).astype(np.int64)
            good = np.flatnonzero(scores >= best.floor)
            if len(good):
                best.add(scores[good], keys[good + low], full[good + low])
            continue
        heavy, _, _, at = max(spans, key=lambda s: s[0].most(s[3]))
        doc = heavy.doc(at)
        score, sides = 0, ([], [])
        for t, a, b, r in spans:
            p = q = a + int(t.docs[a:b].searchsorted(doc))
            if p < b and t.doc(p) == doc:
                score += t.most(p)
                q += 1
                seen += 1
            if a < p:
                sides[0].append((t, a, p, t.within(r, a, p)))
            if q < b:
                sides[1].append((t, q, b, t.within(r, q, b)))
        if score >= best.floor:
            best.add(np.array([score]), keys[doc : doc + 1], full[doc : doc + 1])
        for side in sides:
            bound = sum(t.most(r) for t, _, _, r in side)
            if bound >= best.floor:
                pushed += 1
                heapq.heappush(waiting, (-bound, pushed, side))
    return seen


_FOUND = pa.schema([("item", pa.int64()), ("key", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, keys, asked, best = None, None, {}, {}

        def close() -> None:
            # Items in order, so that a task that runs again finds the same.
            full = np.array([x is not None for x in keys], bool)
            numbers = np.array([x or 0 for x in keys], np.int64)
            for item in sorted(asked):
                search_shard(asked[item], numbers, full, best.setdefault(item, Best(k)))

        def found() -> Iterator[pa.RecordBatch]:
            for item, x in sorted(best.items()):
                values = (pa.array(np.full(len(x.scores), item)), pa.array(x.keys, mask=~x.full), pa.array(x.scores))
                yield pa.record_batch(list(values), schema=_FOUND)

        for batch in batches:
            for row in batch.to_pylist():
                if place != (row["block"], row["shard"]):
                    if place:
                        close()
                        if place[0] != row["block"]:
                            yield from found()
                            best = {}
                    place, keys, asked = (row["block"], row["shard"]), row["keys"], {}
                    continue  # a shard's keys come first
                treap = _Treap(row["weight"], row["docs"], row["impacts"], row["lefts"], row["rights"])
                for item in row["items"]:
                    asked.setdefault(item, []).append(treap)
        if place:
            close()
            yield from found()

    return searched


def search(index: TreapIndex, items: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """item_key, rank, doc_key, score: each item's k best documents with a score above 0.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), and 0 adds
    nothing.  Rows of items are items of their own, also with equal keys.
    """
    rows = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_key"), F.col(text).alias("text")), "items")
    cut = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    n_blocks = rows.count() // BLOCK_ITEMS + 1
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int").alias("block")
    asked = stored(rows.select("item", block, F.explode(cut).alias("term")), "asked")
    names = asked.select("term").distinct()
    small = names.count() <= BROADCAST_TERMS

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small and n_blocks == 1 else df

    df = index.rows.select("term", "df").join(near(names), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = df.select("term", weight.alias("weight")).filter("weight > 0")
    asked = asked.join(weights, "term").groupBy("block", "term", "weight").agg(F.collect_list("item").alias("items"))
    hits = index.rows.filter("term IS NOT NULL").select("shard", "term", "docs", "impacts", "lefts", "rights").join(near(asked), "term")
    keys = index.rows.filter("term IS NULL").select("shard", "keys", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    both = keys.unionByName(hits, allowMissingColumns=True).repartition("block", "shard").sortWithinPartitions("block", "shard", F.col("term").asc_nulls_first())
    found = both.mapInArrow(_search(k), "item long, key long, score long")
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.join(rows.select("item", "item_key"), "item").select("item_key", "rank", F.col("key").alias("doc_key"), "score")


def ranked_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: each item's 50 best documents.

    Null and empty texts have no terms: such documents are in no result and not
    counted in N, such items have no rows.  A null doc_id is a document, first
    among equal scores; repeated rows are documents each, repeated items get
    their rows each.  Very long texts are indexed whole.  Without documents or
    items the result is empty.  Columns besides doc_id, item_id and text are
    ignored, whatever their names.
    """
    found = search(build(docs), items)
    return found.select(F.col("item_key").alias("item_id"), "rank", F.col("doc_key").alias("doc_id"), "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = rf"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = rf"""
WITH words AS (SELECT doc_id, {_TERMS_SQL} AS term FROM documents),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, {_TERMS_SQL} AS term FROM benchmark),
s AS (
  SELECT q.item_id, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * d.n * g.nn) // g.l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d ON d.doc_id = p.doc_id, g
  GROUP BY q.item_id, p.doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""
