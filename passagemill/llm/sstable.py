"""Token shards as sorted-string tables, written and read by Spark tasks.

A shard file, all numbers little-endian unless said otherwise:

    blocks    each zstandard-compressed: entries in key order, an entry being
              u16 shared, u16 unshared, u32 value bytes, the key's unshared
              bytes, the value.  The first key of a block is whole.
    index     for each block: u16 key bytes, its first key, u64 offset, u32 size,
              u32 entries, u64 ids before the block in this shard
    bloom     bit array over the keys' hashes
    footer    u64 index offset, u64 bloom offset, u32 bloom hashes, u32 id
              bytes (2 or 4), u64 entries, u64 ids, 8 bytes magic

A key is one byte for null (0) or not (1), the identifier as big-endian u64
with its sign bit turned over, so that byte order is numeric order, a hash of
the text in the same way, and 4 more bytes that number the rows of one
identifier and text.  Rows of one identifier and text are in one task, so no
two rows of any shards have the same key.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import shared_folder, table, text_bytes

MAGIC = b"SSTOKEN1"
_FOOTER = struct.Struct("<QQIIQQ8s")
_ENTRY = struct.Struct("<HHI")
_INDEX = struct.Struct("<QIIQ")
#: Uncompressed bytes of a block, bytes of a shard, Bloom filter bits a key and hashes.
BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS, BLOOM_HASHES = 64_000, 256_000_000, 10, 7
#: Entries of a shard, whose keys a writer holds, and of a task; rows of a manifest that are sent to every task.
SHARD_ENTRIES, TASK_ENTRIES, BROADCAST_SHARDS = 1_000_000, 2_000_000, 1_000_000


def key_of(doc_id: int | None, text_hash: int = -(2**63), row: int = 0) -> bytes:
    head = b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + 2**63) % 2**64)
    return head + struct.pack(">QI", (text_hash + 2**63) % 2**64, row)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - 2**63 if key[0] else None


def _open(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


def _bits(keys: list[bytes], n_bits: int) -> np.ndarray:
    """The bits of each key's identifier part, by double hashing."""
    import xxhash

    h = np.array([xxhash.xxh3_64_intdigest(k[:9]) for k in keys], np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(n_bits)


class ShardWriter:
    """Writes one shard, keys in order, holding a block, the block index and the keys' hashes only."""

    def __init__(self, address: str, id_bytes: int):
        import zstandard

        self._fs, self._path = _open(address)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        # Each attempt writes a file of its own; the finished one takes the name.
        self._own = f"{self._path}.{uuid.uuid4().hex}"
        self._out = self._fs.open_output_stream(self._own)
        self._pack = zstandard.ZstdCompressor(level=1)
        self._id_bytes, self._index, self._keys = id_bytes, [], []
        self._block, self._block_size, self._first, self._last = [], 0, None, b""
        self._at = self.entries = self.ids = self._ids_before = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self._first is None:
            self._first, self._last, self._ids_before = key, b"", self.ids
        shared = next((i for i, (a, b) in enumerate(zip(key, self._last, strict=False)) if a != b), len(self._last))
        value = ids.astype(f"<u{self._id_bytes}").tobytes()
        self._block += [_ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        self._block_size += len(value) + 20
        self._last, self.entries, self.ids = key, self.entries + 1, self.ids + len(ids)
        self._keys.append(key)
        if self._block_size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._first is not None:
            data = self._pack.compress(b"".join(self._block))
            self._index.append(struct.pack("<H", len(self._first)) + self._first + _INDEX.pack(self._at, len(data), len(self._block) // 3, self._ids_before))
            self._out.write(data)
            self._at += len(data)
            self._block, self._block_size, self._first = [], 0, None

    @property
    def size(self) -> int:
        return self._at

    def close(self) -> None:
        self._flush()
        n_bits = max(64, BLOOM_BITS * len(self._keys))
        bloom = np.zeros(n_bits, bool)
        if self._keys:
            bloom[_bits(self._keys, n_bits).astype(np.int64).ravel()] = True
        index, bloom = b"".join(self._index), np.packbits(bloom, bitorder="little").tobytes()
        self._out.write(index + bloom)
        self._out.write(_FOOTER.pack(self._at, self._at + len(index), n_bits, self._id_bytes, self.entries, self.ids, MAGIC))
        self._out.close()
        self._fs.move(self._own, self._path)

    def abandon(self) -> None:
        self._out.close()
        self._fs.delete_file(self._own)


class Shard:
    """One shard, open for a scan in key order or for lookups."""

    def __init__(self, address: str):
        import zstandard

        filesystem, path = _open(address)
        self._file = filesystem.open_input_file(path)
        size = self._file.size()
        at, bloom_at, self._n_bits, self._id_bytes, self.entries, self.ids, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{address} is no token shard")
        self._bloom_at, raw, p = bloom_at, self._read(at, bloom_at - at), 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        while p < len(raw):
            n = struct.unpack_from("<H", raw, p)[0]
            self.index.append((raw[p + 2 : p + 2 + n], *_INDEX.unpack_from(raw, p + 2 + n)))
            p += 2 + n + _INDEX.size
        self._unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(n)

    def _entries(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, n, _ = self.index[k]
        raw, p, key = self._unpack.decompress(self._read(at, size)), 0, b""
        for _ in range(n):
            shared, unshared, value = _ENTRY.unpack_from(raw, p)
            p += _ENTRY.size
            key = key[:shared] + raw[p : p + unshared]
            p += unshared
            yield key, np.frombuffer(raw, f"<u{self._id_bytes}", value // self._id_bytes, p)
            p += value

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self._entries(k)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows with this identifier: Bloom filter, then binary search of the block index."""
        import bisect

        want = key_of(doc_id)
        bits = _bits([want], self._n_bits)[0].astype(np.int64)
        if not all(self._read(self._bloom_at + int(b) // 8, 1)[0] >> (int(b) % 8) & 1 for b in bits):
            return []
        out = []
        for k in range(max(0, bisect.bisect_left(self.index, want, key=lambda x: x[0]) - 1), len(self.index)):
            if self.index[k][0][:9] > want[:9]:
                break
            out += [ids for key, ids in self._entries(k) if key[:9] == want[:9]]
        return out

    def close(self) -> None:
        self._file.close()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every whole text, adds end_id, and writes shards in key order; returns their manifest.

    Manifest: part, seq (their order is the order of the shards), path, docs,
    ids, first_id, last_id.  Null texts count as empty; null keys come first;
    rows of one key stay in an order by their text's hash.  An empty table gives
    no shard.  Other columns are ignored.  Tasks are sized by characters and by
    rows, and a shard is closed at shard_bytes or SHARD_ENTRIES, so very many
    empty texts fill no task either.

    Rows are dealt by ranges of (key, hash of the text), so a key with very many
    rows spreads over tasks unless the rows are the same.
    """
    n, size = text_bytes(docs, text)
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 32_000_000 + 1, n // TASK_ENTRIES + 1)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange(min(width, max(1, n)), F.col("key").asc_nulls_first(), "h").sortWithinPartitions(F.col("key").asc_nulls_first(), "h")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (words,) = tokens.loaded((tokens.WordBpe, tokenizer))
        id_bytes = 2 if max(len(words._ends), end_id + 1) <= 2**16 else 4
        part, made, out, last, row = TaskContext.get().partitionId(), [], None, (), 0
        try:
            for batch in batches:
                for doc, ids, h in zip(batch.column(0).to_pylist(), words.encode(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    if out is None:
                        out, first = ShardWriter(path := f"{folder}/{part:06d}-{len(made):04d}.sst", id_bytes), doc
                    row = row + 1 if (doc, h) == last else 0
                    last = (doc, h)
                    out.add(key_of(doc, h, row), np.append(ids, np.uint32(end_id)))
                    if out.size >= shard_bytes or out.entries >= SHARD_ENTRIES:
                        out.close()
                        made.append((part, len(made), path, out.entries, out.ids, first, doc))
                        out = None
            if out is not None:
                out.close()
                made.append((part, len(made), path, out.entries, out.ids, first, last[0]))
                out = None
        finally:
            if out is not None:
                out.abandon()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), _MANIFEST.types, strict=True)], schema=_MANIFEST)

    return dealt.select("key", "text", "h").mapInArrow(write, "part int, seq int, path string, docs long, ids long, first_id long, last_id long")


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def read_shards(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every entry of the shards: key, start (ids of all entries before it), n_tokens, ids (little-endian u32 bytes)."""
    # A row a shard, so the one task of this window is small; its rows are 256 MB of ids each.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    # A row a file: they are dealt out again for the reading.
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, rows, size = Shard(path), [], 0
                for k, ids in shard:
                    rows.append((id_of(k), start, len(ids), ids.astype("<u4").tobytes()))
                    start, size = start + len(ids), size + len(ids)
                    if size >= 2_000_000:
                        yield _entries(rows)
                        rows, size = [], 0
                shard.close()
                if rows:
                    yield _entries(rows)

    return shards.repartition(width, "path").mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids binary")


def lookup_ids(manifest: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The entries of the wanted identifiers (column key, null too): key, n_tokens, ids (little-endian u32 bytes).

    Each identifier goes to the shards whose range has it, found by binary
    search in the manifest, and is looked up there by Bloom filter, block index
    and block.  Only the manifest goes to every task, and only if it has
    BROADCAST_SHARDS rows at most.
    """
    spark = manifest.sparkSession
    n = manifest.count()
    if n > BROADCAST_SHARDS:
        raise ValueError(f"{n} shards, {BROADCAST_SHARDS} at most; look up in a part of the manifest")
    rows = sorted(((key_of(r["first_id"])[:9], key_of(r["last_id"])[:9], r["path"]) for r in manifest.select("first_id", "last_id", "path").toLocalIterator()))
    shared = spark.sparkContext.broadcast(rows)
    width = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for batch in batches:
            ids, paths = [], []
            for i in batch.column(0).to_pylist():
                want = key_of(i)[:9]
                at = bisect.bisect_left(shared.value, want, key=lambda x: x[1])
                while at < len(shared.value) and shared.value[at][0] <= want:
                    ids.append(i)
                    paths.append(shared.value[at][2])
                    at += 1
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "path": pa.array(paths, pa.string())})

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, opened = None, None
        for batch in batches:
            rows = []
            for i, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != opened:
                    if shard is not None:
                        shard.close()
                    shard, opened = Shard(path), path
                rows += [(i, len(ids), ids.astype("<u4").tobytes()) for ids in shard.lookup(i)]
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch({"key": pa.array(a, pa.int64()), "n_tokens": pa.array(b, pa.int64()), "ids": pa.array(c, pa.binary())})
        if shard is not None:
            shard.close()

    asked = wanted.select(F.col(key).cast("long").alias("id")).distinct().mapInArrow(place, "id long, path string")
    return asked.repartition(width, "path").sortWithinPartitions("path", "id").mapInArrow(find, f"`{key}` long, n_tokens long, ids binary")


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.record_batch({"key": pa.array(a, pa.int64()), "start": pa.array(b, pa.int64()), "n_tokens": pa.array(c, pa.int64()), "ids": pa.array(d, pa.binary())})


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, tokens.word_bpe_path(), end_id=1)
    # The manifest is kept, as files are written by computing it: a row a file.
    manifest.write.parquet(f"{folder}/manifest")
    back = read_shards(spark.read.parquet(f"{folder}/manifest"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
