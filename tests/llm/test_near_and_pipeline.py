"""Near copies and the pipeline against brute force."""

import collections
import itertools
import re

import numpy as np
import pytest
from conftest import SMALL
from test_text_operators import hits, library, line_rules

import corpus_pipeline
from passagemill.llm import near, quality, tokens


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(ids, texts):
    """copy_of, class_id and n_links of each row."""
    s = sets_of(texts)
    index, pairs = collections.defaultdict(list), collections.Counter()
    for i, own in enumerate(s):
        for x in own:
            index[x].append(i)
    for own in index.values():
        pairs.update(itertools.combinations(own, 2))
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links, key = collections.Counter(), lambda i: (ids[i] is None, ids[i] or 0)
    copies = collections.defaultdict(list)
    for i, own in enumerate(s):
        copies[own].append(i)
    linked = {(a, b) for (a, b), n in pairs.items() if n >= 0.8 * (len(s[a]) + len(s[b]) - n)}
    linked |= {p for own in copies.values() for p in itertools.combinations(own, 2)}
    for a, b in linked:
        links[a] += 1
        links[b] += 1
        a, b = sorted((root(a), root(b)), key=key)
        up[b] = a
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[root(i)].append(i)
    first = {i: ids[min(own, key=key)] for own in groups.values() for i in own}
    return [(ids[i], ids[min(copies[s[i]], key=key)], first[i], links[i]) for i in range(len(ids))]


def found(df):
    return collections.Counter((r["doc_id"], r["copy_of"], r["class_id"], r["n_links"]) for r in df.collect())


def test_near_copies_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = docs.collect()
    assert found(near.near_copies(docs)) == collections.Counter(brute([r["doc_id"] for r in own], [r["text"] for r in own]))


@pytest.mark.parametrize("block", [near.BLOCK, 7])
def test_near_copies_of_a_large_group(spark, block, monkeypatch):
    """Many near copies of one text, in one block and in many; the smaller blocks put the group together again."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        own = list(words)
        for at in rng.integers(0, 120, k % 4):
            own[at] = f"x{rng.integers(1000)}"
        texts.append(" ".join(own))
    texts += ["a b c d", "a b c d", "a b", None, "", " \t", "a  b\nc d", "z " * 30_000]
    ids = [*range(len(texts) - 2), None, 5]
    table = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, class_id string")
    assert found(near.near_copies(table)) == collections.Counter(brute(ids, texts))
    assert near.near_copies(table.limit(0)).count() == 0
    kept = near.keep_one(table)
    groups = {c for _, _, c, _ in brute(ids, texts)}
    assert kept.count() == len(groups) and {r["doc_id"] for r in kept.collect()} == groups


def test_prefix_at_the_threshold():
    depth = near.prefix_depth()
    assert near.met(0.8, depth) >= near.TARGET_RECALL > near.met(0.8, depth + 1)
    with pytest.raises(ValueError, match="more trees"):
        near.prefix_depth(0.1)


def test_prefixes_are_shortened_for_each_class(spark):
    """A class with close neighbours only goes by the whole depth; one with a neighbour near the threshold by a shorter prefix."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 65536, near.TREES * near.DEPTH)

    def like(share):
        return np.where(rng.random(len(base)) < share, base, rng.integers(0, 65536, len(base)))

    rows = [(1, base), (2, like(0.97)), (3, like(0.80)), (4, like(0.2))]
    classes = spark.createDataFrame([(i, bytearray(np.array(s).astype(">u2").tobytes())) for i, s in rows], "id long, signature binary")
    links = spark.createDataFrame([(1, 2, 6), (1, 3, 6), (1, 4, 6), (1, 4, 7)], "a long, b long, shared int")
    ask = lambda pairs: {(r["a"], r["b"]) for r in near.counted_links(links.filter(pairs), classes, 6, 0.8, near.TARGET_RECALL).collect()}
    assert ask("b = 2") == set() and ask("b IN (2, 3)") == {(1, 2), (1, 3)} and ask("b = 4") == set()


def test_repeated_rows_and_clashing_names(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words), "a", 7)] * 300 + [(2, " ".join([*words[:-1], "x"]), "b", 8)] * 200 + [(None, None, None, None)] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, row string, row_ long")
    assert found(near.near_copies(table)) == collections.Counter(brute([r[0] for r in rows], [r[1] for r in rows]))
    kept = near.keep_one(table)
    assert kept.columns == table.columns and sorted(map(str, kept.collect())) == sorted(map(str, [table.filter("doc_id = 1").first(), table.filter("doc_id IS NULL").first()]))


def test_recall_on_a_larger_table(spark):
    """Against all links by brute force, and those between 0.80 and 0.85 by themselves."""
    docs = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/documents.parquet")
    own = docs.collect()
    assert found(near.near_copies(docs)) == collections.Counter(brute([r["doc_id"] for r in own], [r["text"] for r in own]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 102), (101, 103), (7, 3)]
    got = {r["id"]: r["root"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100, 103: 100}


def test_pipeline_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    kept = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{SMALL}/documents.parquet")).filter("kept").collect()}
    docs = [d for d in docs if d[0] in kept]
    docs = [(d, t) for d, _, _, t in line_rules(docs)]
    docs = [d for d, (i, _, c, _) in zip(docs, brute([d for d, _ in docs], [t for _, t in docs]), strict=True) if i == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if not hits(t, items)[3]]

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.word_bpe_path())
    want = {d: len(library(tokenizer, t, 2)) for d, t in docs}
    pieces = collections.Counter()
    for r in corpus_pipeline.run(spark, SMALL).collect():
        assert r["doc_tokens"] == want[r["doc_id"]]
        pieces[r["doc_id"]] += r["length"]
    assert pieces == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).dtypes == docs.dtypes


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in every column, empty, very long and repeated rows, an empty table, and columns named like what operators make."""
    clean = "these are the ordinary words of a text that stands for itself and is long enough to be kept by each of the rules"
    rows = [(1, clean, "en", "s", 9), (1, clean, "en", "s", 9), (None, clean + " x", None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "\n\n \n", "xx", "s", 4), (5, "word " * 50_000, "de", "s", 250_000)]
    plain = spark.createDataFrame([(*r, "kept", 1, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, contaminated boolean")
    for table, n in ((plain, len(rows)), (plain.limit(0), 0)):
        out = stage(spark, table, SMALL)
        found = out.collect()
        if name == "packing":
            assert len({(r["doc_id"]) for r in found}) == (6 if n else 0) and sum(r["start"] == 0 for r in found) == n
        else:
            assert out.columns == corpus_pipeline.COLUMNS
            kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found)
            if not n:
                assert not kept
            elif name in ("line dedup", "benchmark decontamination"):
                assert len(kept) == n
            elif name == "quality rules":
                assert kept == [(False, 1), (False, 1), (True, 0)]
            else:
                assert kept == [(False, 1), (False, 2), (False, 5)]


@pytest.mark.parametrize("batch", [10_000, 50])
def test_forest_links_connect_all_that_share_a_prefix(spark, batch):
    """A third of the classes share prefixes; what batches link by themselves and what the sorted trees link give the same sets."""
    rng = np.random.default_rng(3)
    signatures = rng.integers(0, 65536, (900, near.TREES * near.DEPTH)).astype(">u2")
    for i in range(300):
        signatures[i] = np.where(rng.random(signatures.shape[1]) < 0.97, signatures[0], signatures[i])
    ids, depth = rng.permutation(10**6)[:900].tolist(), 6
    want, seen = near._Union(), {}
    for own, i in zip(signatures, ids, strict=True):
        for tree, path in enumerate(own.reshape(near.TREES, near.DEPTH)):
            want.join(i, seen.setdefault((tree, path[:depth].tobytes()), i))
    classes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in zip(ids, signatures, strict=True)], "id long, signature binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        links = near.forest_links(classes.repartition(3), depth, 8).select("a", "b").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = near._Union()
    for a, b in links:
        got.join(a, b)
    assert {i: got.root(i) for i in ids} == {i: want.root(i) for i in ids}
