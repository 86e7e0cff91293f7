"""Line dedup: lines found in many documents, by once-seen and twice-seen Bloom filters and an exact count of the suspects.

Tasks fold their lines' hashes into bits of two filters and hand on the bits
alone, segment by segment; segments merge what all tasks fold (twice is what
either has twice or both have once) and answer each block of lines which of its
bits are twice-seen.  The answers lie in the shared folder, where the task that
reads the same lines finds them, and only lines all of whose bits are
twice-seen leave it to be counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder, table
from .lm import _names, _steps

SPACE = b" \t\n\v\f\r"
#: Bits of each filter for a line, hashes, and lines that a segment of the two filters is made for.
BITS_A_LINE, HASHES, LINES_A_TASK = 32, 2, 16_000_000
#: Lines that a task holds before it folds them.
BLOCK_LINES = 250_000
#: Bytes of confirmed lines up to which every task gets them all; beyond, they are joined by shuffle.
BROADCAST_BYTES = 16_000_000


class Filters(NamedTuple):
    """Where the answers of the twice-seen filter lie, its segments, the bits of each, and how rows were cut into blocks of keys."""

    folder: str
    segments: int
    bits: int
    min_length: int
    block_lines: int


def keys_of(text: bytes | None) -> list[bytes]:
    """The key of each line: white space stripped, A-Z lower-cased."""
    return [line.strip(SPACE).lower() for line in (text or b"").split(b"\n")]


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _places(h: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """Numbers of each hash's bits; a hash's are all in one segment, and segments are numbered through."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(16) & np.uint64(0xFFFFFF)) | np.uint64(1)
    within = (a[:, None] + b[:, None] * np.arange(1, HASHES + 1, dtype=np.uint64)) % np.uint64(bits)
    return (h >> np.uint64(40))[:, None] % np.uint64(segments) * np.uint64(bits) + within


def _folded(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bit numbers as the bytes they are in and those bytes."""
    byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
    first = np.flatnonzero(np.diff(byte, prepend=-1))
    return byte[first], np.bitwise_or.reduceat(bit, first)


def _set_in(bytes_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bytes_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def _long_enough(keys: Iterable[bytes], min_length: int) -> Iterator[bytes]:
    return (k for k in keys if k and (min_length < 2 or len(k.decode()) >= min_length))


def _blocks(batches: Iterable[pa.RecordBatch], min_length: int, block_lines: int) -> Iterator[list[tuple]]:
    """A task's rows of (name, text) in blocks of some block_lines lines: name, its keys with the first line of each, their hashes."""
    held, size = [], 0
    for batch in batches:
        for name, t in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
            first: dict[bytes, int] = {}
            for i, k in enumerate(keys_of(t)):
                first.setdefault(k, i)
            own = {k: first[k] for k in _long_enough(first, min_length)}
            held.append((name, own, _hashes(own)))
            size += len(own)
            if size >= block_lines:
                yield held
                held, size = [], 0
    if held:
        yield held


def _sum(h: np.ndarray) -> int:
    return int(h.sum(dtype=np.uint64).view(np.int64))


def seen_twice(rows: DataFrame, min_length: int = 1, lines_a_task: int = LINES_A_TASK, block_lines: int = BLOCK_LINES) -> Filters:
    """Puts the lines of rows of (name, text) through the two filters and stores which of each block's bits are twice-seen.

    A block is a run of a task's rows.  What it hands on are the sorted numbers
    of its bits, as the steps between them, and of those that it has twice
    itself; what comes back is a bit for each.  A line of two rows has all its
    bits twice-seen; a line of one row only by the filters' small chance.
    There are as many segments as lines_a_task asks for, so a segment has one
    size however many lines there are.
    """
    spark, text = rows.sparkSession, rows.columns[1]
    n = rows.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // lines_a_task + 1)
    bits = max(1 << 12, BITS_A_LINE * (n // segments + 1))

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, held in enumerate(_blocks(batches, min_length, block_lines)):
            h, counts = np.unique(np.concatenate([x for _, _, x in held]), return_counts=True)
            if not len(h):
                continue
            places = _places(h, segments, bits)
            once, twice = np.unique(places), np.unique(places[counts > 1])
            of = np.unique(once // np.uint64(bits))
            starts = of * np.uint64(bits)
            packed = []
            for own in (once, twice):
                spans = zip(starts, np.searchsorted(own, starts), np.searchsorted(own, starts + np.uint64(bits)), strict=True)
                packed.append([_steps(own[a:b] - start) if b > a else b"" for start, a, b in spans])
            yield pa.record_batch(
                {
                    "segment": pa.array(of.astype(np.int64), pa.int64()),
                    "task": pa.array([task] * len(of), pa.int32()),
                    "block": pa.array([number] * len(of), pa.int32()),
                    "sum": pa.array([_sum(h)] * len(of), pa.int64()),
                    "once": pa.array(packed[0], pa.binary()),
                    "twice": pa.array(packed[1], pa.binary()),
                }
            )

    def merge(folded: pa.Table) -> pa.Table:
        once, twice = np.zeros(bits // 8 + 1, np.uint8), np.zeros(bits // 8 + 1, np.uint8)
        for own, again in zip(folded["once"].to_pylist(), folded["twice"].to_pylist(), strict=True):
            at, bit = _folded(_names(own))
            twice[at] |= once[at] & bit
            once[at] |= bit
            if again:
                at, bit = _folded(_names(again))
                twice[at] |= bit
        marks = [_set_in(twice, _names(own)) for own in folded["once"].to_pylist()]
        told = {"n": pa.array(list(map(len, marks)), pa.int64()), "marks": pa.array([np.packbits(x).tobytes() for x in marks], pa.binary())}
        return pa.table({c: folded[c] for c in ("segment", "task", "block", "sum")} | told)

    folded = rows.mapInArrow(fold, "segment long, task int, block int, sum long, once binary, twice binary")
    answers = folded.groupBy("segment").applyInArrow(merge, "segment long, task int, block int, sum long, n long, marks binary")
    folder = shared_folder(spark, "seen-twice")
    answers.repartition("task").write.partitionBy("task").parquet(folder)
    return Filters(folder, segments, bits, min_length, block_lines)


def _told(filters: Filters, task: int) -> dict[int, tuple[int, np.ndarray]]:
    """For each block of a task the sum of its hashes, and whether each of its sorted bits is twice-seen; without blocks that segments saw cut differently."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(f"{filters.folder}/task={task}")
    if filesystem.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    rows = pq.read_table(path, filesystem=filesystem, columns=["segment", "block", "sum", "n", "marks"]).sort_by([("block", "ascending"), ("segment", "ascending")])
    told: dict[int, tuple[set, list]] = {}
    for block, own, n, marks in zip(*(rows[c].to_pylist() for c in ("block", "sum", "n", "marks")), strict=True):
        sums, parts = told.setdefault(block, (set(), []))
        sums.add(own)
        parts.append(np.unpackbits(np.frombuffer(marks, np.uint8), count=n).astype(bool))
    return {block: (sums.pop(), np.concatenate(parts)) for block, (sums, parts) in told.items() if len(sums) == 1}


def suspects(batches: Iterable[pa.RecordBatch], filters: Filters) -> Iterator[list[tuple]]:
    """Within a task, block by block: the name of each row, and its suspected keys with the first line of each.

    Where a block is not the one that was folded, as the rows were read in
    other partitions, all its lines are suspected, so none is missed.
    """
    from pyspark import TaskContext

    told = _told(filters, TaskContext.get().partitionId())
    for number, held in enumerate(_blocks(batches, filters.min_length, filters.block_lines)):
        known = np.unique(np.concatenate([x for _, _, x in held]))
        own, marks = told.pop(number, (None, None))
        if own == _sum(known) and len(known):
            places = _places(known, filters.segments, filters.bits)
            once = np.unique(places)
            if len(once) == len(marks):
                known = known[marks[np.searchsorted(once, places)].all(axis=1)]
        out = []
        for name, first, h in held:
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            out.append((name, {k: i for (k, i), yes in zip(first.items(), hit.tolist(), strict=True) if yes}))
        yield out


def suspected_lines(rows: DataFrame, filters: Filters) -> DataFrame:
    """The suspected lines of rows of (id, text), counted task by task: line (binary), n, first (doc and line number)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in suspects(batches, filters):
            counts: Counter[bytes] = Counter()
            first: dict[bytes, tuple] = {}
            for doc, own in block:
                for k, i in own.items():
                    counts[k] += 1
                    place = (doc is not None, doc or 0, i, doc)
                    if k not in first or place < first[k]:
                        first[k] = place
            yield pa.record_batch(
                {
                    "line": pa.array(list(counts), pa.binary()),
                    "n": pa.array(list(counts.values()), pa.int64()),
                    "first": pa.array([{"doc": first[k][3], "line": first[k][2]} for k in counts], pa.struct([("doc", pa.int64()), ("line", pa.int64())])),
                }
            )

    return rows.mapInArrow(count, "line binary, n long, first struct<doc: long, line: long>")


def repeated_lines(
    docs: DataFrame, min_docs: int = 10, min_length: int = 1, key: str = "doc_id", text: str = "text", lines_a_task: int = LINES_A_TASK, filters: Filters | None = None
) -> DataFrame:
    """Line keys found in min_docs documents or more: line (binary), n_docs, first (doc and line number of the first occurrence).

    Only lines that the filters suspect leave a task to be counted exactly,
    summed over a block's documents beforehand, so a line of a third of all
    documents comes as one row from each block.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = suspected_lines(rows, filters or seen_twice(rows, min_length, lines_a_task))
    return found.groupBy("line").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first")).filter(F.col("n_docs") >= max(min_docs, 1))


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_length: int = 1,
    keep_first: bool = False,
    key: str = "doc_id",
    text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows with text cleaned, and n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of min_length code points or more that min_docs documents have lose
    all their lines; with keep_first the first occurrence (smallest document,
    then line) stays.  Rows count as documents, repeated rows and null ids
    included.  A null or empty text is one empty line, which stays; an empty
    table gives an empty one.  Other columns are carried along, except those
    named n_lines or n_dropped.

    The lines to drop go to every task if they are measured to be
    broadcast_bytes at most.  Otherwise they are joined to the documents'
    suspected lines, where Spark splits hot keys, and then to the documents.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    filters = seen_twice(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), min_length)
    bad = checkpointed(repeated_lines(docs, min_docs, min_length, key, text, filters=filters))
    size = bad.agg(F.sum(F.length("line") + 64)).first()[0] or 0
    names = docs.columns
    key_at, text_at = names.index(key), names.index(text)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", n_lines long, n_dropped long"

    def cleaned(doc, raw: bytes | None, drop) -> tuple[bytes, int, int]:
        lines, keep = (raw or b"").split(b"\n"), []
        for i, (line, k) in enumerate(zip(lines, keys_of(raw), strict=True)):
            first = drop.get(k)
            if first is None or (keep_first and first == (doc, i)):
                keep.append(line)
        return b"\n".join(keep), len(lines), len(lines) - len(keep)

    def rebuilt(batch: pa.RecordBatch, n: int, out: list[tuple]) -> pa.RecordBatch:
        columns = list(batch.columns[:n])
        texts, lines, dropped = zip(*out, strict=True) if out else ((), (), ())
        columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*(f"c{i}" for i in range(n)), "n_lines", "n_dropped"]
        )

    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({bytes(r["line"]): (r["first"]["doc"], r["first"]["line"]) for r in bad.toLocalIterator()})

        def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs_ = batch.column(key_at).to_pylist()
                yield rebuilt(batch, len(names), [cleaned(d, t, shared.value) for d, t in zip(docs_, _texts(batch, text_at), strict=True)])

        out = plain.mapInArrow(clean, schema)
    else:

        def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in suspects(batches, filters):
                own = [(row, k) for row, lines in block for k in lines]
                yield pa.record_batch({"row": pa.array([r for r, _ in own], pa.binary()), "line": pa.array([k for _, k in own], pa.binary())})

        def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                drops = [{bytes(x["line"]): (x["doc"], x["at"]) for x in own or ()} for own in batch.column(len(names)).to_pylist()]
                docs_ = batch.column(key_at).to_pylist()
                yield rebuilt(batch, len(names), [cleaned(d, t, x) for d, t, x in zip(docs_, _texts(batch, text_at), drops, strict=True)])

        # Rows of one text and id have the same lines, so they share one entry.
        row = F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.col(f"c{key_at}").cast("string"), F.lit("-")), F.coalesce(F.col(f"c{text_at}"), F.lit(""))), 256))
        lines = plain.select(row.alias("row"), F.col(f"c{text_at}").alias("text")).mapInArrow(split, "row binary, line binary")
        found = lines.join(bad.select("line", F.col("first.doc").alias("doc"), F.col("first.line").alias("at")), "line")
        own = found.groupBy("row").agg(F.collect_set(F.struct("line", "doc", "at")).alias("drops"))
        joined = plain.withColumn("row", row).join(own, "row", "left").select(*plain.columns, "drops")
        out = joined.mapInArrow(apply, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "n_lines", "n_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), many AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, line, n, k IN (SELECT k FROM many) AS gone FROM keyed
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
