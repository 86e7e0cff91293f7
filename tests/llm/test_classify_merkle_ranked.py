"""Classifier, manifest and ranked search: brute force, held-out rows, odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from passagemill.llm import classify, merkle, queries, ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, term string, label int, key long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (None, "no id here but words", None, "s", 1),
    (3, "same text twice", "xx", "s", 1),
    (3, "same text twice", "xx", "s", 1),
    (4, "two lines\n\n  Two Lines \nthree", "de", "é", 1),
    (5, "word " * 60_000, "en", "s", 1),
    (6, "tabs\tand\x0bmore\x1c\x85 odd   spaces ﬁ ẞ ́ 漢字 'tis it's a_b", "fr", "z", 1),
    (-9_000_000_000, "negative id\nof a document, two words more", "es", None, 1),
    (7, "\n\n", "es", "", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "x", "y", 1, 9) for r in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Classifier


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def _held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_classifier_on_held_out_rows(spark):
    folder = SMALL.replace("0.001", "0.01")
    found = {r["doc_id"]: r for r in queries.QUERIES["op11_quality_classifier"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(found) == docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r["held_out"] == _held_out(k) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in found.items())
    pairs = [(q, found[k]["predicted"]) for k, q in labels.items() if _held_out(k)]
    assert sum(q == p for q, p in pairs) >= 0.95 * len(pairs)
    assert sum(p for q, p in pairs if q) >= 0.97 * sum(q for q, _ in pairs)


def test_classifier_never_sees_held_out_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = [(r["doc_id"], r["quality"], 0, "x") for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    turned = [(k, 1 - q if _held_out(k) else q, t, x) for k, q, t, x in labels]
    a, b = (classify.train(docs, _labels(spark, rows)) for rows in (labels, turned))
    assert a.n_rows and (a.margin == b.margin).all()


def test_classifier_steps_are_those_of_softmax_regression():
    """One step on one text moves vectors and layer against the loss' slope, by central differences."""
    buckets, counts = np.array([3, 9, 70]), np.array([2, 1, 1])
    dice = np.random.default_rng(11)
    vectors = dice.uniform(-1 / classify.WIDTH, 1 / classify.WIDTH, (classify.BUCKETS, classify.WIDTH)).astype(np.float32)

    def loss(layer):
        z = ((counts / 4) @ vectors[buckets]) @ layer
        return np.log(np.exp(z).sum()) - z[1]

    _, layer = classify.fit([(buckets, counts, 1)], epochs=1, rate=0.1)
    slope = np.zeros((classify.WIDTH, 2))
    for i in range(classify.WIDTH):
        for j in range(2):
            d = np.zeros((classify.WIDTH, 2))
            d[i, j] = 1e-3
            slope[i, j] = (loss(d) - loss(-d)) / 2e-3
    assert np.allclose(layer, -0.1 * slope, atol=1e-6)


def test_features_are_words_pairs_and_ngrams():
    def of(*texts):
        out = [[] for _ in texts]
        for at, buckets in classify._features(list(texts)):
            for a, b in zip(at.tolist(), buckets.tolist(), strict=True):
                out[a].append(b)
        return [Counter(x) for x in out]

    whole = "Te Te\tTe and é漢字 x"
    n_words, n = len(whole.split()), len(whole)
    one, other, both = of(whole)[0], of("zz zz\nzz")[0], of("first text", whole)[1]
    assert one == both  # whatever stands beside it
    assert sum(one.values()) == 1 + n_words + n_words - 1 + (n - 2) + (n - 3)
    assert of("Te Te")[0] & other  # repeated words share the pair's bucket
    assert of("", "a")[0] == Counter(of("")[0]) and sum(of("")[0].values()) == 1


def test_classifier_reads_long_texts_whole(monkeypatch):
    margin = np.random.default_rng(1).normal(size=classify.BUCKETS)
    text = "some words of a text " * 300
    whole = classify.score_texts([text], margin)
    monkeypatch.setattr(classify, "PIECE", 500)
    assert "".join(classify._pieces(text)) == text and list(classify._pieces("x" * 1200)) == ["x" * 500, "x" * 500, "x" * 200]
    assert abs(classify.score_texts([text], margin) - whole) < 0.02  # but for what spans a cut


def test_classifier_on_odd_rows(spark, odd, empty):
    labels = _labels(spark, [(1, 1, 0, "a"), (5, 0, 0, None), (5, 0, 0, None), (6, None, 0, "x"), (4, 7, 0, "x"), (None, 1, 0, "x"), (99, 1, 1, "x")])
    model = classify.train(odd, labels)
    found = [tuple(r) for r in classify.judge(odd, model).collect()]
    assert sorted(str(r[0]) for r in found) == sorted(str(r[0]) for r in ODD)
    by = {r[0]: r for r in found}
    assert by[1][2] == by[2][2] and len({r[2] for r in found if r[0] == 3}) == 1
    assert by[None][1] is False
    assert classify.judge(empty, model).count() == 0
    blank = classify.train(odd, _labels(spark, []))
    assert blank.n_rows == 0 and {r["score"] for r in classify.judge(odd, blank).collect()} == {0.5}
    assert classify.train(empty, labels).n_rows == 0


# Manifest


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def _brute(rows):
    def leaf(r, text):
        return _h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text))

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = _levels([x[2] for x in groups[s]])
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for k, (_, _, own, r) in enumerate(groups[s]):
            digest, proof = own, ""
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                digest = leaf(r, r[1].replace("\n", ""))
            for levels, at in ((trees[s], k), (top, g)):
                for level in levels[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    proof += "".join(run[: at % 3] + run[at % 3 + 1 :])
                    digest = _h([*run[: at % 3], digest, *run[at % 3 + 1 :]])
                    at //= 3
            out.append((r[0], own, trees[s][-1][0], top[-1][0], _h(proof), digest, digest == top[-1][0]))
    return out


def _sorted(rows):
    return sorted(rows, key=str)


def test_manifest_of_odd_rows(odd, empty):
    found = [tuple(r) for r in merkle.tampered_and_proved(odd).collect()]
    assert _sorted(found) == _sorted(_brute(ODD))
    assert not all(r[-1] for r in found)
    assert merkle.tampered_and_proved(empty).collect() == []


def test_manifest_in_many_partitions_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FEW_ROWS", 1)
    monkeypatch.setattr(merkle, "TASK_ROWS", 11)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    dice = random.Random(5)
    rows = [(dice.randrange(200), f"text\n{k % 40}", "en", dice.choice([None, "hot", "hot", "hot", "a", f"lone{k}"]), k) for k in range(300)]
    docs = spark.createDataFrame([(*r, 0.5, "x", "y", 1, 9) for r in rows], DOCS)
    assert _sorted(tuple(r) for r in merkle.tampered_and_proved(docs).collect()) == _sorted(_brute(rows))
    made = merkle.manifest(docs.selectExpr("source AS grp", "doc_id AS key", "sha2(text, 256) AS digest", "cast(null as string) AS suspect"))
    assert len(made.forest.rounds) > 2
    # Every node above the leaves is recorded once, and follows from its children.
    nodes = {(r["gid"], r["level"], r["idx"]): r["digest"] for r in made.nodes.collect()}
    sizes = {r["gid"]: r["n"] for r in made.groups.collect()}
    assert len(nodes) == made.nodes.count() == sum(math.ceil(n / 3**level) for n in sizes.values() for level in range(1, merkle.height(n) + 1))
    for (gid, level, idx), digest in nodes.items():
        if level > 1:
            assert digest == _h(nodes[gid, level - 1, k] for k in range(3 * idx, 3 * idx + 3) if (gid, level - 1, k) in nodes)


def test_climb_from_any_cut_comes_to_the_whole():
    dice = random.Random(3)
    for n in (1, 2, 3, 4, 10, 27, 28, 100, 365):
        leaves = [_h([str(k)]) for k in range(n)]
        want = _levels(leaves)[-1][0]
        cuts = sorted({0, n, *(dice.randrange(n + 1) for _ in range(5))})
        peaks = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            peaks += merkle.climb([(0, k, leaves[k]) for k in range(a, b)], n, 99)
        assert merkle.climb(peaks, n, 99) == [(merkle.height(n), 0, want)]


# Ranked search


def _treap_lists(impacts, starts):
    left, right = ranked.treaps(np.array(impacts, np.uint32), np.array(starts))
    return left.tolist(), right.tolist()


def test_treaps_are_search_trees_and_heaps():
    dice = random.Random(4)
    for top in (1, 3, 1000):
        lists = [[dice.randrange(top) for _ in range(n)] for n in (1, 2, 7, 200, 3000)]
        lists.append(sorted(lists[-1]))
        lists.append(lists[-1][::-1])
        starts = np.cumsum([0, *map(len, lists)])[:-1]
        left, right = _treap_lists(sum(lists, []), starts)
        for impacts, at in zip(lists, starts.tolist(), strict=True):
            seen, stack = [], [(max(range(len(impacts)), key=lambda k: (impacts[k], -k)), 0, len(impacts))]
            while stack:
                k, a, b = stack.pop()
                assert a <= k < b and impacts[k] == max(impacts[a:b])
                seen.append(k)
                low, high = left[at + k], right[at + k]
                assert (low != k) == (a < k) and (high != k) == (k + 1 < b)
                stack += [(low, a, k)] * (low != k) + [(high, k + 1, b)] * (high != k)
            assert sorted(seen) == list(range(len(impacts)))


def test_search_prunes_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(ranked, "FEW_POSTINGS", 16)
    dice = np.random.default_rng(6)
    lists, scores = [], Counter()
    for df, weight in ((3000, 10), (900, 300), (40, 2000), (3, 5000)):
        docs = np.sort(dice.choice(5000, df, replace=False)).astype(np.uint16)
        impacts = (dice.pareto(1.5, df) * 1000 + 1).astype(np.uint32)
        left, right = ranked.treaps(impacts, np.array([0]))
        lists.append(ranked._Treap(weight, docs.tobytes(), impacts.tobytes(), left.astype(np.uint16).tobytes(), right.astype(np.uint16).tobytes()))
        for d, x in zip(docs.tolist(), impacts.tolist(), strict=True):
            scores[d] += weight * x
    keys = dice.permutation(5000)
    best = ranked.Best(10)
    seen = ranked.search_shard(lists, keys, np.ones(5000, bool), best)
    want = sorted(((s, int(keys[d])) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:10]
    assert list(zip(best.scores.tolist(), best.keys.tolist(), strict=True)) == want
    assert seen < 0.5 * sum(len(t.docs) for t in lists)


def _ranked_brute(docs, items, k=50):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms, df = len(bags), sum(n for *_, n in bags), Counter(x for _, bag, _ in bags for x in bag)
    out = []
    for item, text in items:
        scored = []
        for d, bag, n in bags:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * bag[x] // (1000 * bag[x] + 20 * m)) for x in set(terms(text)) if x in bag)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def test_ranked_search_on_odd_rows(spark, odd, empty):
    items = [(1, "Word TABS text"), (1, "Word TABS text"), (2, None), (None, "words of two words, 漢字"), (4, ""), (5, "nothing that is there: qqq"), (6, " ".join(["it's a Lines\x85"] * 9))]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS rank", "3 AS term", "4 AS item")
    found = _sorted(tuple(r) for r in ranked.ranked_documents(odd, frame).collect())
    assert found == _sorted(_ranked_brute([r[:2] for r in ODD], items))
    assert ranked.ranked_documents(empty, frame).collect() == []
    assert ranked.ranked_documents(odd, frame.limit(0)).collect() == []


def test_ranked_search_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD_DOCS", 7)
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(ranked, "FEW_POSTINGS", 5)
    dice = random.Random(8)
    docs = [(k % 90, " ".join(dice.choice(["a", "b", "c", "dd", "e1", "F", "g"]) * dice.choice([1, 1, 2]) for _ in range(dice.randrange(30)))) for k in range(100)]
    items = [(k, " ".join(dice.choice(["a", "b", "cc", "DD", "e1", "f"]) for _ in range(3))) for k in range(9)]
    index = ranked.build(spark.createDataFrame(docs, "doc_id long, text string"))
    assert index.rows.filter("term IS NULL").count() > 12
    found = ranked.search(index, spark.createDataFrame(items, "item_id long, text string"), k=6)
    assert _sorted(tuple(r) for r in found.collect()) == _sorted(_ranked_brute(docs, items, 6))
