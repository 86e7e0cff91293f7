"""Benchmark decontamination: test windows searched in an FM-index of each shard of training text."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import shared_folder, table, text_bytes

WINDOW = 13
#: Characters of test text that are searched at once; a longer test set is cut into blocks.
QUERY_CHARS = 8_000_000
#: Bytes of documents that a task holds while it goes through the blocks, where there are several.
HELD_BYTES = 32_000_000
#: Every how many text positions the suffix array is kept.
SAMPLE = 8
#: A-Z to lower case, and all that is no word character to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def folded(block: pa.Array) -> pa.Array:
    """The texts with lower-case words and blanks only."""
    _, offsets, data = block.buffers()
    data = data.to_pybytes().translate(_FOLD) if data else b""
    return pa.Array.from_buffers(block.type, len(block), [None, offsets, pa.py_buffer(data)], offset=block.offset)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the text's suffixes in order, by doubling ranks; the last symbol is smaller than all others."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(text)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Burrows-Wheeler transform with a wavelet matrix for ranks and sampled suffix positions; all queries take arrays."""

    def __init__(self, text: np.ndarray):
        """text: symbols, the last of which is 0 and occurs nowhere else."""
        sa = suffix_array(text)
        self._bwt = text[sa - 1]
        self._levels = max(1, int(text.max()).bit_length())
        self._ones, self._zeros, row = [], [], self._bwt
        for level in reversed(range(self._levels)):
            bit = (row >> level) & 1
            self._ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self._zeros.append(len(row) - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        counts = np.bincount(text, minlength=1 << self._levels)
        self._first = np.cumsum(counts) - counts
        kept = sa % SAMPLE == 0
        self._kept, self._kept_rank, self._sampled = kept, np.cumsum(kept) - kept, sa[kept]
        self.size = len(text)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i of the transform."""
        start = np.zeros_like(i)
        for k, level in enumerate(reversed(range(self._levels))):
            one, zeros = self._ones[k], self._zeros[k]
            bit = (symbol >> level) & 1 == 1
            i, start = np.where(bit, zeros + one[i], i - one[i]), np.where(bit, zeros + one[start], start - one[start])
        return i - start

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each pattern (a row, padded at its end), found from its last symbol back."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(low[live] < high[live])]
            now = live[lengths[live] >= back]
            symbol = patterns[now, lengths[now] - back]
            known = symbol < 1 << self._levels
            high[now[~known]] = low[now[~known]]
            now, symbol = now[known], symbol[known]
            low[now] = self._first[symbol] + self.rank(symbol, low[now])
            high[now] = self._first[symbol] + self.rank(symbol, high[now])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row of the suffix array, by steps back to a kept one."""
        out, at, steps, rest = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(rest):
            there = self._kept[at[rest]]
            done = rest[there]
            out[done] = self._sampled[self._kept_rank[at[done]]] + steps
            rest = rest[~there]
            symbol = self._bwt[at[rest]]
            at[rest] = self._first[symbol] + self.rank(symbol, at[rest])
            steps += 1
        return out


class _Queries:
    """Windows of a block of test items: the alphabet of their words, the different windows, and whose they are."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        block = pa.array([t for _, t in items], pa.large_string())
        lists = [[w for w in x if w] for x in pc.ascii_split_whitespace(folded(block)).to_pylist()]
        self.words = sorted({w for x in lists for w in x})
        number = {w: i + 2 for i, w in enumerate(self.words)}  # 0 ends the text, 1 separates runs
        owners: dict[tuple[int, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items})
        name_of = {name: i for i, name in enumerate(self.names)}
        for (name, _), words in zip(items, lists, strict=True):
            symbols = tuple(number[w] for w in words)
            for i in range(max(1, len(symbols) - window + 1) if symbols else 0):
                owners.setdefault(symbols[i : i + window], set()).add(name_of[name])
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.patterns = np.ones((len(owners), window), np.int64)
        for i, x in enumerate(owners):
            self.patterns[i, : len(x)] = x
        self.owners_at = np.concatenate([[0], np.cumsum([len(x) for x in owners.values()])]).astype(np.int64)
        self.owners = np.array([x for own in owners.values() for x in sorted(own)], np.int64)

    def find(self, block: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its words, the merged spans of words in occurrences, and the items with such."""
        words, offsets = tokens.words_of(folded(block))
        full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        n_words = np.concatenate([[0], np.cumsum(full)])[offsets]
        symbols = pc.fill_null(pc.index_in(words, pa.array(self.words, words.type)), -1).to_numpy(zero_copy_only=False)[full].astype(np.int64) + 2
        doc = np.repeat(np.arange(len(block)), np.diff(n_words))
        # Runs of words of the alphabet, of the shortest window's length at least: no window can lie elsewhere.
        known = symbols > 1
        edge = np.ones(len(symbols), bool)
        edge[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(edge)
        length = np.diff(np.concatenate([begin, [len(symbols)]]))
        keep = known[begin] & (length >= self.lengths.min(initial=WINDOW)) if len(begin) else np.zeros(0, bool)
        begin, length = begin[keep], length[keep]
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, list[str]] = {}
        if len(begin) and len(self.lengths):
            at = tokens.spread(begin, length + 1)  # one place more for the separator
            text = np.where(np.isin(np.arange(len(at)), np.cumsum(length + 1) - 1), 1, symbols[np.minimum(at, len(symbols) - 1)])
            index = FMIndex(np.concatenate([text, [0]]))
            low, high = index.search(self.patterns, self.lengths)
            n = high - low
            which = np.repeat(np.arange(len(n)), n)
            place = at[index.locate(tokens.spread(low, n))]
            own = doc[place]
            # Spans of words, merged where they meet.
            order = np.lexsort((place, own))
            for d, a, b in zip(own[order].tolist(), (place - n_words[own])[order].tolist(), (place - n_words[own] + self.lengths[which])[order].tolist(), strict=True):
                got = spans.setdefault(d, [])
                if got and a <= got[-1][1]:
                    got[-1] = (got[-1][0], max(b, got[-1][1]))
                else:
                    got.append((a, b))
            each = self.owners_at[which + 1] - self.owners_at[which]
            pairs = np.unique(np.repeat(own, each) * len(self.names) + self.owners[tokens.spread(self.owners_at[which], each)])
            for p in pairs.tolist():
                items.setdefault(p // len(self.names), []).append(self.names[p % len(self.names)])
        for i in range(len(block)):
            yield int(n_words[i + 1] - n_words[i]), spans.get(i, []), items.get(i, [])


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows with n_words, spans (first word, word after the last) and items, the sorted ids of items with windows in the text.

    Words are runs of letters, digits and all beyond ASCII, A-Z lower-cased.  A
    window is that many consecutive words of an item; an item of fewer words,
    but not none, is one window.  Null texts have no words; items with a null
    text have no window, those with a null id count under the empty id; items
    of one id are one.  Empty tables give no hits.  Other columns are carried
    along, except those named like a result.

    Each task indexes its shards of text, the runs of words that the test set
    has within 4 MB of text, and searches all windows there, without a shuffle
    of documents.  The test set is dealt to blocks of QUERY_CHARS characters,
    whose windows tasks make and write to the shared folder; a document task
    reads a block at a time, so neither the driver nor a task holds more than
    one, however long the test set is.
    """
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    at = names.index(text)
    fields = pa.struct([("first", pa.int64()), ("end", pa.int64())])
    out = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    own = ", ".join(f"{n} {t}" for n, t in out.dtypes)
    blocks = write_queries(items, item, item_text, window)

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[tuple]] = [[] for _ in held]
        for address in blocks or [None]:
            queries = _read_queries(address) if address else _Queries([], window)
            for k, batch in enumerate(held):
                new = [x for part in tokens.blocks(batch.column(at)) for x in queries.find(part)]
                rows[k] = [(n, merge(s, spans), sorted({*i, *ids})) for (n, spans, ids), (_, s, i) in zip(new, rows[k], strict=True)] if rows[k] else new
        for batch, own_rows in zip(held, rows, strict=True):
            n, spans, ids = zip(*own_rows, strict=True) if own_rows else ((), (), ())
            made = [pa.array(n, pa.int64()), pa.array([[{"first": a, "end": b} for a, b in x] for x in spans], pa.list_(fields)), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*(f"c{i}" for i in range(len(names))), "n_words", "spans", "items"])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(blocks) < 2 or size >= HELD_BYTES:
                yield from found(held)
                held, size = [], 0
        if held:
            yield from found(held)

    out = out.mapInArrow(find, f"{own}, n_words long, spans array<struct<first: long, end: long>>, items array<string>")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "n_words", "spans", "items")


def write_queries(items: DataFrame, item: str, item_text: str, window: int) -> list[str]:
    """Writes the windows of the test set to the shared folder, a file a block of about QUERY_CHARS characters; returns the files' addresses."""
    spark = items.sparkSession
    # Ids are compared as strings.
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    n = text_bytes(rows, "text")[1] // QUERY_CHARS + 1
    folder = shared_folder(spark, "queries")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n))).repartition(n, "block")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple[str, str]]] = {}
        for batch in batches:
            for name, text, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(block, []).append((name, text))
        for block, some in own.items():
            filesystem, path = fs.FileSystem.from_uri(f"{folder}/{block:06d}")
            filesystem.create_dir(path.rpartition("/")[0], recursive=True)
            # Each attempt writes a file of its own; the finished one takes the name.
            with filesystem.open_output_stream(attempt := f"{path}.{uuid.uuid4().hex}") as out:
                out.write(pickle.dumps(_Queries(some, window)))
            filesystem.move(attempt, path)
        yield pa.record_batch({"block": pa.array(list(own), pa.int64())})

    made = dealt.mapInArrow(write, "block long").collect()
    return [f"{folder}/{k:06d}" for k in sorted(r["block"] for r in made)]


_last_read: dict[str, _Queries] = {}


def _read_queries(address: str) -> _Queries:
    """The windows of a block; the worker process keeps those it read last."""
    if address not in _last_read:
        _last_read.clear()
        filesystem, path = fs.FileSystem.from_uri(address)
        with filesystem.open_input_file(path) as file:
            _last_read[address] = pickle.loads(file.read())
    return _last_read[address]


def judge(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """find_items with n_hit, n_items and contaminated: some words hit, and a twentieth of all or more."""
    found = find_items(docs.drop("n_hit", "n_items", "contaminated"), items, **columns)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    found = found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long")})
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(13, len(w)) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, n, item_id FROM spots JOIN windows USING (n, s)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
