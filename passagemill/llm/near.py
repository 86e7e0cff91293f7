"""N-gram Jaccard join: near copies by a MinHash LSH forest with exact verification.

1. Each document's set of five-word shingles gives a digest and a signature,
   cut into trees of short hash values.
2. Documents of one digest are one class; its copies go no further.
3. In every tree the classes' signatures are sorted as strings, which is the
   trie in order; neighbours are linked by the longest prefix they share.
4. The prefix that a class goes by starts at the whole depth and is shortened,
   for each class by itself, until the least similar of the neighbours found
   (by their signatures) would be met in some tree as often as the target recall
   asks; the shortest is the one that meets pairs at the threshold itself so
   often.  A link counts if it shares the prefix of either end.
5. Linked classes form candidate components.  Each is verified exactly by
   intersection counts; large ones are cut into blocks, and the pairs of blocks
   that share a prefix in some tree are groups of their own, so no pair of
   classes is written as a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import checkpointed, table

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 32, 8, 0.9999
#: Classes, and their shingles, in a block of a large candidate component.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Shingle columns of the incidence matrix at a time; links that a task holds before it hands them on.
COLUMNS, HELD = 16_384, 2_000_000
#: Parts of the links of one id.
SALTS = 16
_MULTIPLIERS = np.random.default_rng(20240101).integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def met(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """The chance that a pair of that similarity shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target probability."""
    for k in range(DEPTH, 0, -1):
        if met(threshold, k) >= target:
            return k
    raise ValueError(f"{TREES} trees meet pairs of similarity {threshold} with a chance of {met(threshold, 1):.4f}, which is below {target}; more trees are needed")


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted different hashes of all WORDS-word windows; words: a hash for each word.  Fewer words are one window."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(WORDS, n)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n - size + 1]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _word_hashes(block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of the texts, and each text's first and last."""
    import xxhash

    words, offsets = tokens.words_of(block)
    coded = words.dictionary_encode()
    names = tokens.strings(coded.dictionary)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    codes = coded.indices.to_numpy()
    full = np.fromiter(map(bool, names), bool, len(names))[codes]
    return h[codes[full]], np.concatenate([[0], np.cumsum(full)])[offsets]


def signature(own: np.ndarray) -> bytes:
    """Minima of TREES * DEPTH hash functions over the shingles, 16 bits of each, big-endian so that bytes sort as values."""
    low, high = own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
    for k in range(0, len(own), 512):
        np.minimum(least, (low[k : k + 512, None] * _MULTIPLIERS + high[k : k + 512, None]).min(axis=0), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(">u2").tobytes()


def _row(key: str, text: str) -> Column:
    """128 bits that know a row by its key and text."""
    said = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.when(F.col(text).isNull(), "\n-").otherwise("\n+"), F.coalesce(F.col(text), F.lit("")))
    return F.unhex(F.md5(said.cast("binary")))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, row (128 bits of key and text), digest of its shingle set, its size, signature (null without words)."""
    rows = docs.select(F.col(key).cast("long").alias("key"), _row(key, text).alias("row"), F.col(text).alias("text"))

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, signatures, sizes = [], [], []
            for block in tokens.blocks(batch.column(2)):
                words, bounds = _word_hashes(block)
                for i in range(len(block)):
                    own = shingles(words[bounds[i] : bounds[i + 1]])
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    signatures.append(signature(own) if len(own) else None)
                    sizes.append(len(own))
            yield pa.record_batch(
                {"key": batch.column(0), "row": batch.column(1), "digest": pa.array(digests, pa.binary()), "size": pa.array(sizes, pa.int64()), "signature": pa.array(signatures, pa.binary())}
            )

    return rows.mapInArrow(sketch, "key long, row binary, digest binary, size long, signature binary")


class _Union:
    """Disjoint sets of ids; the root of each is its least id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while up.get(r, r) != r:
            r = up[r]
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = self.up[min(a, b)] = min(a, b)

    def links(self) -> pa.RecordBatch:
        pairs = [(x, self.root(x)) for x in list(self.up) if self.root(x) != x]
        return pa.record_batch({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([x for _, x in pairs], pa.int64())})


def _heads(paths: np.ndarray) -> np.ndarray:
    """A hash of each row of 16-bit values; two rows that share one by chance are one candidate more to verify."""
    h = np.full(len(paths), paths.shape[1], np.uint64)
    for column in paths.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def forest_links(classes: DataFrame, shortest: int, width: int) -> DataFrame:
    """Links (a, b, shared) that connect all classes (id, signature) sharing a prefix of that depth or more in some tree.

    shared is the depth of the prefix they share; the links of that depth or
    more connect all classes that share so much.  Each task hands on a forest
    of what it sees, deepest links first.

    Classes of one batch that share a whole path are linked where they are read,
    and one of them stands for all in the sorted trees.  So a path that very
    many classes share is a row a batch there; links that are made already go
    along without a path, dealt by their ids.
    """

    def plant(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), TREES, DEPTH * 2)
            tree = np.broadcast_to(np.arange(TREES, dtype=np.uint8)[None, :, None], (len(ids), TREES, 1))
            path = np.ascontiguousarray(np.concatenate([tree, raw], axis=2)).view(f"V{DEPTH * 2 + 1}").ravel()
            values = np.concatenate([tree, raw], axis=2).reshape(len(path), 2 * DEPTH + 1)
            _, first, place = np.unique(_heads(values), return_index=True, return_inverse=True)
            own = np.repeat(ids, TREES)
            pairs = np.stack([own, own[first][place.ravel()]], axis=1)
            sets = _Union()
            for i, to in np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).tolist():
                sets.join(i, to)
            made = sets.links()
            ids_, paths_ = pa.concat_arrays([pa.array(own[first]), made.column(0)]), pa.array(path[first].tolist() + [None] * len(made), pa.binary())
            yield pa.record_batch({"id": ids_, "path": paths_, "root": pa.concat_arrays([pa.nulls(len(first), pa.int64()), made.column(1)])})

    def handed(sets: _Union, others: list[tuple[int, int, int]]) -> pa.RecordBatch:
        deep = sets.links()
        rows = [(a, b, DEPTH) for a, b in zip(deep.column(0).to_pylist(), deep.column(1).to_pylist(), strict=True)]
        for shared, a, b in sorted(others, reverse=True):
            if sets.root(a) != sets.root(b):
                sets.join(a, b)
                rows.append((a, b, shared))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "shared"])

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, others, last, last_id, head = _Union(), [], b"", 0, 1 + 2 * shortest
        for batch in batches:
            for i, path, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path is None:
                    sets.join(i, to)
                else:
                    if path[:head] == last[:head]:
                        shared = shortest
                        while shared < DEPTH and path[: 3 + 2 * shared] == last[: 3 + 2 * shared]:
                            shared += 1
                        if shared == DEPTH:
                            sets.join(last_id, i)
                        else:
                            others.append((shared, last_id, i))
                    last, last_id = path, i
                if len(sets.up) + len(others) > HELD:
                    yield handed(sets, others)
                    sets, others = _Union(), []
        yield handed(sets, others)

    paths = classes.select("id", "signature").mapInArrow(plant, "id long, path binary, root long")
    where = F.coalesce(F.substring("path", 1, 1 + 2 * shortest), F.col("id").cast("string").cast("binary"))
    dealt = paths.repartition(width, where).sortWithinPartitions("path", "id")
    found = dealt.mapInArrow(walk, "a long, b long, shared int").filter("a <> b")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("shared").alias("shared"))


def counted_links(links: DataFrame, classes: DataFrame, shortest: int, threshold: float, target: float) -> DataFrame:
    """The links (a, b) that share the prefix that either end goes by.

    A class goes by the longest prefix at which the least similar of its linked
    classes is met with the target chance.  Similarities are estimated by equal
    values of signatures; those far below the threshold, three standard errors
    and more, say nothing and are left out.
    """
    signatures = classes.select("id", "signature")
    both = links.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
    far = threshold - 3 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5

    def prefix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), ">u2").reshape(-1, TREES * DEPTH) for c in batch.columns[3:])
            alike = (x == y).mean(axis=1)
            asked = np.full(len(alike), shortest, np.int32)
            for k in range(shortest + 1, DEPTH + 1):
                asked[met(alike, k) >= target] = k
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.where(alike < far, DEPTH, asked), pa.int32())], names=["a", "b", "shared", "asked"])

    asked = checkpointed(both.select("a", "b", "shared", "x", "y").mapInArrow(prefix, "a long, b long, shared int, asked int"))
    ends = asked.select(F.explode(F.array("a", "b")).alias("id"), "asked").groupBy("id").agg(F.min("asked").alias("by"))
    rows = asked.join(ends.select(F.col("id").alias("a"), F.col("by").alias("by_a")), "a").join(ends.select(F.col("id").alias("b"), F.col("by").alias("by_b")), "b")
    return rows.filter(F.col("shared") >= F.least("by_a", "by_b")).select("a", "b")


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of the links (a, b): id, root (the least id), for every id in a link.

    Alternating large and small stars: ids move to the least neighbour until
    nothing changes.  Every round's links are kept in the shared folder.  A
    component whose links do not settle in that many rounds (they halve a chain
    each time, so more than any table needs) is an error.
    """
    now = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
        # Large star: an id's larger neighbours move to its least one.  The root of a
        # large component has none below itself, and is the only id with very many
        # above; its links are salted, so they meet the few moves in many tasks.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moves = both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u").select(F.col("u").alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        salted = now.withColumn("s", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        large = salted.join(moves, ["v", "s"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: an id and its smaller neighbours, one from a task at most, move to the least of them.
        least = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = least.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = checkpointed(small.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _verify(rows: list[tuple], threshold: float) -> Iterator[tuple[int, int, int]]:
    """Rows (id, copies, block, text) of one pair of blocks to (id, linked documents, least id linked to it here).

    Within a block every pair counts; of two blocks, those across.
    """
    ids = np.array([r[0] for r in rows], np.int64)
    copies = np.array([r[1] for r in rows], np.int64)
    side = np.array([r[2] for r in rows])
    sets = []
    for block in tokens.blocks(pa.array([r[3] for r in rows], pa.large_string())):
        words, bounds = _word_hashes(block)
        sets += [shingles(words[bounds[i] : bounds[i + 1]]) for i in range(len(block))]
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one document alone are in no intersection.
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - first)), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part @ part.T
    # Counts up to 2 ** 24 are exact in float32; the rest is integers.
    union = size[:, None] + size[None, :] - both.astype(np.int64)
    linked = both.astype(np.float64) >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    if (side != side[0]).any():
        linked &= side[:, None] != side[None, :]
    sets_ = _Union()
    for a, b in zip(*np.nonzero(np.triu(linked)), strict=True):
        sets_.join(int(ids[a]), int(ids[b]))
    n = linked @ copies
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        yield int(ids[i]), int(n[i]), sets_.root(int(ids[i]))


def _block_pairs(members: DataFrame, depth: int) -> DataFrame:
    """Pairs of blocks (root, i, j, i <= j) of large components that share a prefix in some tree, and each block with itself.

    members: root, block, signature.  A prefix comes as one row for each block
    that has it, not for each class.
    """

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").reshape(n, TREES, DEPTH)[:, :, :depth]
            values = np.concatenate([np.broadcast_to(np.arange(TREES, dtype=np.uint16)[None, :, None], (n, TREES, 1)), raw], axis=2).reshape(n * TREES, depth + 1)
            yield pa.record_batch(
                {
                    "root": pa.array(np.repeat(batch.column(0).to_numpy(), TREES)),
                    "block": pa.array(np.repeat(batch.column(1).to_numpy(), TREES)),
                    "head": pa.array(_heads(values).view(np.int64)),
                }
            )

    found = members.select("root", "block", "signature").mapInArrow(heads, "root long, block int, head long").distinct()
    own = found.groupBy("root", "head").agg(F.array_sort(F.collect_set("block")).alias("b")).filter(F.size("b") > 1).select("root", "b").distinct()
    across = own.select("root", F.col("b").alias("all"), F.explode("b").alias("i")).select("root", "i", F.explode("all").alias("j")).filter("i < j")
    return across.union(members.select("root", F.col("block").alias("i"), F.col("block").alias("j"))).distinct()


def _verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, shortest: int, width: int, key: str, text: str, threshold: float) -> DataFrame:
    """Links of the candidate components (id, root), verified: id, n, root."""
    members = candidates.join(classes.select("id", "row", "copies", "size", "signature"), "id")
    blocks = candidates.join(classes.select("id", "size"), "id").groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = checkpointed(members)
    texts = docs.select(_row(key, text).alias("row"), F.col(text).alias("text"))
    # Repeated rows have one text: each task keeps one of them.
    own = members.select("root", "id", "copies", "block", "blocks", "row").join(texts, "row").dropDuplicates(["id"]).drop("row")
    cut = members.filter("blocks > 1")
    if cut.isEmpty():
        pairs = own.select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "copies", "block", "text")
    else:
        # Each block's partners go to its members; those of a component of one block meet in it.
        sides = _block_pairs(cut, shortest).select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        pairs = own.join(sides, ["root", "block"], "left").select("root", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("j", F.lit(0)).alias("j"), "id", "copies", "block", "text")
    dealt = pairs.repartition(width, "root", "i", "j").sortWithinPartitions("root", "i", "j", "id")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []
        for batch in batches:
            for *where, i, copies, block, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != now:
                    if len(group) > 1:
                        out += _verify(group, threshold)
                    now, group = where, []
                group.append((i, copies, block, own))
            if len(out) > 50_000:
                yield _found(out)
                out = []
        if len(group) > 1:
            out += _verify(group, threshold)
        if out:
            yield _found(out)

    return dealt.mapInArrow(verify, "id long, n long, root long")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: key, copy_of, class_id, n_links, class_row.

    class_row: 128 bits of key and text of the document that class_id names.

    copy_of: the least key among documents with the same shingles.  class_id:
    the least key among all documents connected by links, a link being a
    Jaccard similarity of the five-word shingle sets of threshold or more.
    n_links: the documents linked to this one, copies counted each.

    Words are runs without ASCII white space.  A text of fewer than five words
    is one shingle.  Texts without words, null among them, are copies of each
    other and like nothing else.  Null keys come after all others as least key.
    Rows with repeated keys keep rows of their own.  An empty table gives an
    empty one.  Other columns are ignored.

    Prefixes are shortened until a class' neighbours are met with a chance of
    target, so a link at the threshold is missed with 1 - target at most by the
    shortest prefix, and by 1 - met(threshold, DEPTH), 0.3 %, by the longest.
    Documents and shingle sets are known by 128 bits.  A component of very many
    different texts costs the square of those that share prefixes, in
    arithmetic; its texts are sent once for every pair of blocks that shares
    one.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_rows = checkpointed(sketches(docs, key, text))
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row", "size", "signature")).alias("m")
    # Copies meet as one row a task.  The ids are made once and kept with the rows.
    classes = all_rows.groupBy("digest").agg(least, F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("id"), "digest", "m.key", "m.row", "m.size", "m.signature", "copies"))
    shortest = prefix_depth(threshold, target)
    links = counted_links(checkpointed(forest_links(classes.filter("signature is not null"), shortest, width)), classes, shortest, threshold, target)
    found = checkpointed(_verified(docs, classes, components(links), shortest, width, key, text, threshold))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    full = classes.join(groups, "id", "left").join(links, "id", "left").select("digest", "key", "row", "copies", F.coalesce("root", "id").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    # The least key of a group, nulls last; hot groups are summed up in each task first.
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("m")
    named = full.groupBy("root").agg(first).select("root", F.col("m.key").alias("class_id"), F.col("m.row").alias("class_row"))
    full = full.join(named, "root").select("digest", F.col("key").alias("copy_of"), "class_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "class_row")
    return all_rows.select(F.col("key").alias(key), "digest").join(full, "digest").select(key, "copy_of", "class_id", "n_links", "class_row")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each group of near copies: the one with the least key, once."""
    name = "row"
    while name in docs.columns:
        name += "_"
    kept = near_copies(docs, key, text).select(F.col("class_row").alias(name)).distinct()
    rows = docs.withColumn(name, _row(key, text))
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.record_batch({n: pa.array(x, pa.int64()) for n, x in zip(("id", "n", "root"), zip(*rows, strict=True), strict=True)})


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).drop("class_row")
