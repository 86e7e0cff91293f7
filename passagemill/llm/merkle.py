"""Merkle dataset manifest: a hash tree over each source's documents and one over the sources.

Rows are dealt by range into indexed partitions, so each knows the places of
its leaves from counts alone.  A task keeps a mountain range: nodes go on a
stack, and a run of FANOUT siblings carries into their parent, as digits carry.
What the edges of a partition leave unfinished are its peaks; rounds of merging
gather the peaks below one ancestor and go on, five levels a round, until a
tree is one node.  A level's last run may be short and is hashed as it is, for
which a task needs only the number of leaves.  Proofs come back down the same
rounds: a node's path is its siblings and its parent's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

FANOUT = 3
#: Leaves of an indexed partition: the least that is worth a task, and the most.
FEW_ROWS, TASK_ROWS = 5_000, 200_000
#: Levels that one round of merging climbs: a group has FANOUT**LEVELS nodes at most, but for the first round's edges.
LEVELS = 5
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "pid long, gid long, n long, level int, idx long, digest string, peak boolean, made boolean"


def leaf_digest(columns: Iterable[Column]) -> Column:
    """Hex sha256 of the values in order: each its count of UTF-8 bytes, a colon and the value, or a hyphen for null."""
    strings = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings)), 256)


def join_digest(hexes: Iterable[str]) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def height(n: int) -> int:
    """The root's level over n leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // FANOUT), level + 1
    return level


def climb(nodes: Iterable[tuple[int, int, str]], n: int, cap: int, runs: list | None = None) -> list[tuple[int, int, str]]:
    """The peaks that consecutive nodes (level, place in it, digest) of a tree of n leaves come to, up to the level cap.

    runs gets the members of each run that became a parent, in the order of making.
    """
    stack: list[tuple[int, int, str]] = []
    cap = min(cap, height(n))
    for node in nodes:
        stack.append(node)
        while (level := stack[-1][0]) < cap:
            idx = stack[-1][1]
            first = idx - idx % FANOUT
            last = min(first + FANOUT, -(-n // FANOUT**level)) - 1
            run = stack[first - last - 1 :]
            if idx != last or run[0][:2] != (level, first):  # the run ends later, or began in another partition
                break
            stack[first - last - 1 :] = [(level + 1, idx // FANOUT, join_digest(x[2] for x in run))]
            if runs is not None:
                runs.append(run)
    return stack


def _entry(run: list[tuple[int, int, str]], at: int) -> str:
    """One step of a path: the node's place in its run, then the others' digests."""
    return f"{at}{''.join(x[2] for k, x in enumerate(run) if k != at)}"


def follow(digest: str, path: Iterable[str]) -> str:
    """The root that a digest and its path lead to."""
    for step in path:
        others = [step[k : k + 64] for k in range(1, len(step), 64)]
        digest = join_digest([*others[: int(step[0])], digest, *others[int(step[0]) :]])
    return digest


def _node_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_NODE_SCHEMA = pa.schema([("pid", pa.int64()), ("gid", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("peak", pa.bool_()), ("made", pa.bool_())])
_PATH_SCHEMA = pa.schema([("pid", pa.int64()), ("gid", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("root", pa.string()), ("path", pa.list_(pa.string()))])
PATHS = "pid long, gid long, n long, level int, idx long, root string, path array<string>"


def _records(peaks: list, runs: list, given: set, pid: int, gid: int, n: int) -> list[tuple]:
    """Rows of NODES: the finished nodes that went on to be parts of others, and the peaks."""
    inner = [(pid, gid, n, *x, False, True) for run in runs for x in run if x[:2] not in given]
    return inner + [(pid, gid, n, *x, True, x[:2] not in given) for x in peaks]


@dataclass
class Forest:
    """Trees over indexed rows (at, pid, digest): the nodes that each round takes, the level that it goes up to, and the roots."""

    rows: DataFrame
    rounds: list[tuple[DataFrame, int]]
    roots: DataFrame

    @property
    def nodes(self) -> DataFrame:
        """gid, level, idx, digest of every node above the leaves; a tree of one leaf has none."""
        tables = [t for t, _ in self.rounds] + [self.roots]
        made = tables[0].filter("made")
        for t in tables[1:]:
            made = made.unionByName(t.filter("made"))
        return made.filter("level > 0").select("gid", "level", "idx", "digest")


def _block(cap: int) -> Column:
    """The ancestor's place in the level cap."""
    return (F.col("idx") / F.pow(F.lit(float(FANOUT)), F.lit(cap) - F.col("level"))).cast("long")


def indexed(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n rows in the order of columns, in partitions by range; at orders them, pid is the partition, pos the place there."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(n // FEW_ROWS, width), n // TASK_ROWS) + 1
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "indexed")
    return placed.withColumns({"pid": F.shiftright("at", 33), "pos": F.col("at").bitwiseAND((1 << 33) - 1)})


def segments(rows: DataFrame, by: str) -> DataFrame:
    """For each partition and group in it: rows there (c), the group's rows before (start) and in all (n)."""
    counts = rows.groupBy("pid", by).agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("c").over(group.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumns({"start": before, "n": F.sum("c").over(group)})


def grow(rows: DataFrame, segs: DataFrame, n: int, most: int) -> Forest:
    """The trees of indexed rows; segs: pid, gid, start, c, n of the groups in each partition, in order of gid; most: the largest n."""
    parts = rows.select("pid").distinct().count()
    lowest = cap = max(1, height(max(1, n // max(parts, 1))))

    def first(own: pa.Table, segs: pa.Table) -> pa.Table:
        digests = own.sort_by("at")["digest"].to_pylist()
        out, at = [], 0
        for s in segs.sort_by("gid").to_pylist():
            runs: list = []
            peaks = climb(((0, s["start"] + k, digests[at + k]) for k in range(s["c"])), s["n"], lowest, runs)
            out += _records(peaks, [r for r in runs if r[0][0]], set(), s["pid"], s["gid"], s["n"])
            at += s["c"]
        return _node_table(out, _NODE_SCHEMA)

    def merge(cap: int):
        def merged(nodes: pa.Table) -> pa.Table:
            found = sorted(((x["level"], x["idx"], x["digest"]) for x in nodes.to_pylist()), key=lambda x: x[1] * FANOUT ** x[0])
            gid, n, runs = nodes["gid"][0].as_py(), nodes["n"][0].as_py(), []
            peaks = climb(found, n, cap, runs)
            return _node_table(_records(peaks, runs, {x[:2] for x in found}, -1, gid, n), _NODE_SCHEMA)

        return merged

    needed = segs.select("pid", "gid", "start", "c", "n")
    nodes = stored(rows.select("pid", "at", "digest").groupBy("pid").cogroup(needed.groupBy("pid")).applyInArrow(first, NODES), "peaks")
    rounds = []
    while True:
        rounds.append((nodes, cap))
        nodes = stored(nodes.filter("peak").withColumn("block", _block(cap)).groupBy("gid", "block").applyInArrow(merge(cap), NODES), "peaks")
        if FANOUT**cap >= most:
            return Forest(rows, rounds, nodes)
        cap += LEVELS


def paths_of_peaks(forest: Forest, above: DataFrame) -> DataFrame:
    """The path of every partition's peaks, by pid; above: gid, root (the digest that counts as the tree's) and path of each tree's root."""
    paths = forest.roots.filter("peak").select("gid", "n", "level", "idx").join(above, "gid")
    paths = paths.select(F.lit(-1).cast("long").alias("pid"), "gid", "n", "level", "idx", "root", "path")

    def down(cap: int):
        def downward(nodes: pa.Table, paths: pa.Table) -> pa.Table:
            n, runs = nodes["n"][0].as_py(), []
            given = sorted(nodes.to_pylist(), key=lambda x: x["idx"] * FANOUT ** x["level"])
            climb(((x["level"], x["idx"], x["digest"]) for x in given), n, cap, runs)
            top = paths.to_pylist()[0]
            known = {(top["level"], top["idx"]): top["path"]}
            for run in reversed(runs):
                rest = known[run[0][0] + 1, run[0][1] // FANOUT]
                known |= {x[:2]: [_entry(run, k), *rest] for k, x in enumerate(run)}
            return _node_table([(x["pid"], x["gid"], n, x["level"], x["idx"], top["root"], known[x["level"], x["idx"]]) for x in given], _PATH_SCHEMA)

        return downward

    for nodes, cap in reversed(forest.rounds):
        by = [g.withColumn("block", _block(cap)).groupBy("gid", "block") for g in (nodes.filter("peak").drop("peak", "made"), paths)]
        paths = stored(by[0].cogroup(by[1]).applyInArrow(down(cap), PATHS), "paths")
    return paths


def _walk(own: pa.Table, paths: pa.Table):
    """For each row in order: its place, its tree's path row, its steps up to a peak as (run, place in it), and the peak's path."""
    own = own.sort_by("at")
    digests, at = own["digest"].to_pylist(), 0
    trees: dict[int, list[dict]] = {}
    for x in paths.to_pylist():
        trees.setdefault(x["gid"], []).append(x)
    for gid in sorted(trees):
        n = trees[gid][0]["n"]
        spans = [(x["idx"] * FANOUT ** x["level"], min(n, (x["idx"] + 1) * FANOUT ** x["level"])) for x in trees[gid]]
        start, end = min(a for a, _ in spans), max(b for _, b in spans)
        above = {(x["level"], x["idx"]): x for x in trees[gid]}
        runs: list = []
        climb(((0, start + k, digests[at + k]) for k in range(end - start)), n, max(x["level"] for x in trees[gid]), runs)
        member = {x[:2]: (run, k) for run in runs for k, x in enumerate(run)}
        for k in range(end - start):
            node, steps = (0, start + k), []
            while node not in above:
                steps.append(member[node])
                node = (node[0] + 1, node[1] // FANOUT)
            yield at + k, above[node], steps
        at += end - start


def paths_of_rows(forest: Forest, above: DataFrame) -> DataFrame:
    """at and path of every row."""

    def found(own: pa.Table, paths: pa.Table) -> pa.Table:
        ats = own.sort_by("at")["at"].to_pylist()
        rows = [(ats[k], [*(_entry(*s) for s in steps), *top["path"]]) for k, top, steps in _walk(own, paths)]
        return _node_table(rows, pa.schema([("at", pa.int64()), ("path", pa.list_(pa.string()))]))

    rows = forest.rows.select("pid", "at", "digest")
    return rows.groupBy("pid").cogroup(paths_of_peaks(forest, above).groupBy("pid")).applyInArrow(found, "at long, path array<string>")


@dataclass
class Manifest:
    """A dataset's hash trees.

    leaves(at, pid, key, digest, suspect), groups(gid, grp, n, subroot, path), nodes(gid, level, idx, digest) of the groups' trees, top_nodes of the tree over them, and the root (None without rows).
    """

    leaves: DataFrame
    groups: DataFrame
    forest: Forest
    top: Forest
    root: str | None

    @property
    def nodes(self) -> DataFrame:
        return self.forest.nodes

    @property
    def top_nodes(self) -> DataFrame:
        return self.top.nodes


def manifest(leaves: DataFrame) -> Manifest | None:
    """The hash trees of leaves: grp, key, digest, and suspect (a digest to hold against the tree, or null).

    A group's leaves ascend by key, nulls first; ties go by digest, so equal
    rows are leaves side by side.  Groups ascend by their bytes, null first.
    None for no rows.
    """
    rows = stored(leaves.select("grp", "key", "digest", "suspect").withColumn("row", F.monotonically_increasing_id()), "leaves")
    n = rows.count()
    if not n:
        return None
    placed = indexed(rows, ["grp", "key", "digest", "row"], n)
    segs = stored(segments(placed, "grp"), "segments")
    sizes = segs.groupBy("grp").agg(F.max("n").alias("n"))
    n_groups, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    ordered = indexed(sizes, ["grp"], n_groups)
    spans = segments(ordered.withColumn("all", F.lit(0)), "all").select("pid", F.lit(0).cast("long").alias("gid"), "start", "c", F.col("n").alias("n"))
    groups = stored(ordered.join(spans.select("pid", "start"), "pid").select("at", "pid", "grp", "n", (F.col("start") + F.col("pos")).alias("gid")), "groups")
    segs = segs.alias("s").join(groups.select("grp", "gid").alias("g"), F.expr("s.grp <=> g.grp")).select("pid", "gid", "start", "c", "s.n")
    forest = grow(placed, segs, n, most)
    subroots = forest.roots.filter("peak").select("gid", F.col("digest"))
    top = grow(groups.join(subroots, "gid"), spans, n_groups, n_groups)
    root = top.roots.filter("peak").first()["digest"]
    origin = top.roots.filter("peak").select("gid", F.lit(root).alias("root"), F.array().cast("array<string>").alias("path"))
    paths = paths_of_rows(top, origin)
    found = stored(groups.join(paths, "at").join(subroots, "gid").select("gid", "grp", "n", F.col("digest").alias("subroot"), "path"), "groups")
    return Manifest(placed, found, forest, top, root)


def proofs(made: Manifest) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root of every leaf.

    proof_sha256 is the digest of all siblings from the leaf's run to the root;
    folded_root is what the suspect (else the leaf) and these siblings lead to.
    """
    schema = pa.schema([("key", pa.int64()), *((x, pa.string()) for x in ("leaf", "subroot", "proof_sha256", "folded_root"))])

    def proved(own: pa.Table, paths: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        keys, leaves, suspects = (own[x].to_pylist() for x in ("key", "digest", "suspect"))
        out = []
        for k, top, steps in _walk(own, paths):
            digest, proof = suspects[k] or leaves[k], hashlib.sha256()
            for run, at in steps:
                hexes = [x[2] for x in run]
                proof.update("".join(hexes[:at] + hexes[at + 1 :]).encode())
                hexes[at] = digest
                digest = join_digest(hexes)
            proof.update("".join(step[1:] for step in top["path"]).encode())
            out.append((keys[k], leaves[k], top["root"], proof.hexdigest(), follow(digest, top["path"])))
        return _node_table(out, schema)

    above = made.groups.select("gid", F.col("subroot").alias("root"), "path")
    rows = made.leaves.select("pid", "at", "key", "digest", "suspect")
    found = rows.groupBy("pid").cogroup(paths_of_peaks(made.forest, above).groupBy("pid")).applyInArrow(proved, "key long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return found.withColumn("root", F.lit(made.root))


def tampered_and_proved(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Documents whose decimal doc_id has an even unsigned crc32 are tampered with:
    their text loses its \\n.  verified says whether what is there now leads to
    the root.

    Null values are leaves' hyphens; a null doc_id comes first in its source and
    isn't tampered with; a null source is a source of its own, the first.  Empty
    and very long texts are hashed whole.  Repeated rows are leaves of their own.
    An empty table gives an empty one.  Columns besides doc_id, source, lang,
    n_chars and text are ignored, whatever their names.
    """
    own = docs.select(*COLUMNS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.regexp_replace("text", "\n", "")
    leaf = leaf_digest(F.col(c) for c in COLUMNS)
    suspect = F.when(hit, leaf_digest(text if c == "text" else F.col(c) for c in COLUMNS))
    made = manifest(own.select(F.col("source").alias("grp"), F.col("doc_id").cast("long").alias("key"), leaf.alias("digest"), suspect.alias("suspect")))
    if made is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proofs(made).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_and_proved(table(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


# DuckDB has no crc32 of its own; eight shifts a byte make it from the polynomial.
OP12_SQL = rf"""
WITH RECURSIVE
crc(doc_id, i, c) AS (
  SELECT DISTINCT doc_id, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, i + 1, list_reduce(list_prepend(xor(c, ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT), range(8)),
                                    lambda x, y: xor(x >> 1, (x & 1) * 3988292384))
  FROM crc WHERE i < length(doc_id::VARCHAR)
), hit AS (
  SELECT doc_id FROM crc WHERE i = length(doc_id::VARCHAR) AND xor(c, 4294967295) % 2 = 0
), leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN {_leaf_sql("replace(text, chr(10), '')")} END AS suspect
  FROM documents
), placed AS (
  SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS id
  FROM leaves WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)
), up(level, source, idx, digest, n) AS (
  SELECT 0, source, idx, leaf, n FROM placed
  UNION ALL
  SELECT level + 1, source, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM up
  WHERE n > 1 GROUP BY level, source, idx // 3, n
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM up WHERE n = 1
), tops(level, idx, digest, n) AS (
  SELECT 0, idx, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM tops
  WHERE n > 1 GROUP BY level, idx // 3, n
), fold(id, source, level, idx, digest, proof, n) AS (
  SELECT id, source, 0, idx, coalesce(suspect, leaf), '', n FROM placed
  UNION ALL
  SELECT f.id, f.source, f.level + 1, f.idx // 3, sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.digest ELSE u.digest END, '' ORDER BY u.idx)),
         f.proof || coalesce(string_agg(CASE WHEN u.idx <> f.idx THEN u.digest END, '' ORDER BY u.idx), ''), (f.n + 2) // 3
  FROM fold f JOIN up u ON u.level = f.level AND u.source IS NOT DISTINCT FROM f.source AND u.idx // 3 = f.idx // 3
  WHERE f.n > 1 GROUP BY f.id, f.source, f.level, f.idx, f.digest, f.proof, f.n
), fold_top(id, subroot, level, idx, digest, proof, n) AS (
  SELECT f.id, s.subroot, 0, s.idx, f.digest, f.proof, s.n FROM fold f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
  UNION ALL
  SELECT f.id, f.subroot, f.level + 1, f.idx // 3, sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.digest ELSE u.digest END, '' ORDER BY u.idx)),
         f.proof || coalesce(string_agg(CASE WHEN u.idx <> f.idx THEN u.digest END, '' ORDER BY u.idx), ''), (f.n + 2) // 3
  FROM fold_top f JOIN tops u ON u.level = f.level AND u.idx // 3 = f.idx // 3
  WHERE f.n > 1 GROUP BY f.id, f.subroot, f.level, f.idx, f.digest, f.proof, f.n
)
SELECT p.doc_id, p.leaf, f.subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM placed p JOIN fold_top f ON f.id = p.id AND f.n = 1 CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""
