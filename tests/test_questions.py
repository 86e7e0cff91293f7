"""Concepts, rules, added words and credits of questions, against a loop."""

import re

from conftest import SMALL
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import questions as Q
from passagemill.plans import phrases
from passagemill.plans.base import Tables
from passagemill.plans.registry import QUERIES

ASKED = [
    (1, "¿Qué es un equivalente farmacéutico, según el reglamento?"),
    (2, "Debo notificar una reacción adversa  grave del medicamento"),
    (3, "¿Cuántos días tengo para avisar la reacción adversa? Venta libre"),
    (4, "venta  libre; reacción, adversa"),
    (5, ""),
    (6, None),
    (7, "infringir zurcir"),
]
TRIGGERS = [("a", "notificar"), ("a", "avisar"), ("b", "Reacción adversa"), ("b", "adversa"), ("c", "venta libre"), ("d", "infringir"), ("e", " ")]
ADDED = [("a", "comunicar"), ("b", "evento adverso"), ("b", "ram"), ("c", "expendio libre"), ("d", "infracción grave"), ("e", "nunca"), ("f", "nunca")]


def _plain(x):
    return (x or "").lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))


def _tokens(x):
    return [w for w in re.findall("[a-z0-9]+", _plain(x)) if len(w) >= 2 and w not in T.STOP_WORDS]


def _stem(w):
    return w if len(w) <= 4 or w.isdigit() else re.sub(f"^(.{{4,}}?)({'|'.join(T.SUFFIXES)})$", r"\1", w)


def loop(asked, triggers, added, known, unseen):
    """For each question: fired (rule, trigger), alternatives by concept, added words, and concepts with weight."""
    plain = {x: _plain(x.strip()).translate(str.maketrans("ºª", "oa")) for _, x in triggers}
    out = {}
    for r in asked:
        own_stems = {_stem(w) for w in _tokens(r["text"])}
        kept = dict.fromkeys(r["tokens"])
        first = {}
        for w in kept:
            s = _stem(w)
            first.setdefault(s, w)
        fired = set()
        for rule, x in triggers:
            p = plain[x]
            if p and (re.search(rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])", r["plain"]) if " " in p else _stem(p) in own_stems):
                fired.add((rule, p))
        alternatives, words = {}, set()
        for rule in {x for x, _ in fired}:
            mine = {s for x, p in fired if x == rule for s in map(_stem, _tokens(p))}
            owner = next((s for s in first if s in mine), None)
            for x, phrase in added:
                said = _tokens(phrase)
                if x == rule and said:
                    words |= {w for w in said if w not in kept}
                    if owner:
                        alternatives.setdefault(owner, set()).add(tuple(map(_stem, said)))
        concepts = {s: known.get(s, unseen) for s, w in first.items() if not re.search(Q.INFINITIVE, w) or s in known or any(all(x in known for x in a) for a in alternatives.get(s, ()))}
        out[r["qid"]] = (fired, alternatives, words, concepts)
    return out


def test_questions_against_a_loop(spark):
    rows = Q.analysed(spark.createDataFrame(ASKED, "qid int, text string"), ["debo"])
    triggers = spark.createDataFrame(TRIGGERS, "rule string, trigger string")
    added = spark.createDataFrame(ADDED, "rule string, phrase string")
    docs = {10: "evento adverso grave", 11: "ram reaccion", 12: "equivalente de la farmacia según reglamento", 13: "infracción", 14: "grave infracción comunicar libre"}
    texts = spark.createDataFrame(list(docs.items()), "doc int, text string").select("doc", F.explode(T.stems(F.col("text"))).alias("stem"))
    known = {r["stem"]: float(r["n"]) for r in texts.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).collect()}
    stems = spark.createDataFrame(list(known.items()), "stem string, idf double")
    want = loop(rows.collect(), TRIGGERS, ADDED, known, 9.0)
    fired = Q.set_off(rows, triggers, 3)
    alternatives, words = Q.expanded(rows, fired, added)
    weights = Q.weighted(Q.concepts(rows), alternatives, stems, 9.0)
    assert {(r["qid"], r["rule"], r["trigger"]) for r in fired.collect()} == {(q, *x) for q, w in want.items() for x in w[0]}
    assert {(r["qid"], r["concept"], tuple(r["stems"])) for r in alternatives.collect()} == {(q, c, a) for q, w in want.items() for c, x in w[1].items() for a in x}
    assert sorted((r["qid"], r["term"]) for r in words.collect()) == sorted((q, x) for q, w in want.items() for x in w[2])
    assert {(r["qid"], r["stem"]): r["weight"] for r in weights.collect()} == {(q, s): x for q, w in want.items() for s, x in w[3].items()}
    assert {r for r, _ in want[3][0]} == {"a", "b", "c"} and {r for r, _ in want[4][0]} == {"b"} and len(want[7][3]) == 1
    by_doc = {}
    for r in texts.collect():
        by_doc.setdefault(r["doc"], set()).add(r["stem"])
    credit = {}
    for q, (_, alts, _, concepts) in want.items():
        for s in concepts:
            for d, has in by_doc.items():
                got = 1.0 if s in has else max((1.0 if len(a) > 1 else 0.7 for a in alts.get(s, ()) if set(a) <= has), default=0)
                if got:
                    credit[q, d, s] = got
    assert {(r["qid"], r["doc"], r["stem"]): r["credit"] for r in Q.credits(weights, alternatives, texts).collect()} == credit
    assert set(credit.values()) == {0.7, 1.0}
    sums = {}
    for (q, d, _), got in credit.items():
        sums.setdefault((q, d), []).append(got)
    for block in (Q.BLOCK, 2):
        found = Q.credit_sums(weights, alternatives, texts, block).collect()
        assert sorted((r["qid"], r["doc"], r["n"], round(r["credit"], 6)) for r in found) == sorted((*k, len(x), round(sum(x), 6)) for k, x in sums.items())
    found = {r["qid"]: r["stem"] for r in Q.defined(rows, weights).collect()}
    assert set(found) == {1} and found[1] in {_stem("farmaceutico"), _stem("equivalente")}


def test_rules_of_the_vocabulary_against_a_loop(spark):
    t = Tables(spark, SMALL)
    triggers, added = phrases.vocabulary(t)
    asked = phrases.asked(t).collect()
    want = loop(asked, [tuple(r) for r in triggers.collect()], [tuple(r) for r in added.collect()], {}, 1.0)
    fired = {(r["qid"], r["rule"], r["trigger"]) for r in QUERIES["qa4_rules_set_off"](spark, SMALL).collect()}
    assert fired == {(q, *x) for q, w in want.items() for x in w[0]} and any(" " in x for *_, x in fired)
    assert {(r["qid"], r["term"]) for r in QUERIES["qa4_words_added"](spark, SMALL).collect()} == {(q, x) for q, w in want.items() for x in w[2]}


def test_asked_stems_are_found_where_documents_lie(spark, monkeypatch):
    from passagemill.operators import index as X

    said = [(1, "casas de campo"), (2, ""), (3, None), (4, "campos casa casa rueda"), (5, "x el la")]
    made = X.build(spark.createDataFrame(said, "doc_id long, text string").repartition(X.LEAST_PARTITIONS))
    asked = spark.createDataFrame([(1, "casa"), (2, "casa"), (2, "rued"), (1, "nada")], "qid long, stem string")
    want = sorted(map(tuple, made.doc_stems.join(asked.select("stem").distinct(), "stem", "left_semi").select("doc", "stem").collect()))
    assert sorted(map(tuple, X.holding(made, asked).collect())) == want and len(want) >= 2
    assert "Generate" not in X.holding(made, asked)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(X, "MOST_ASKED", 1)
    assert sorted(map(tuple, X.holding(made, asked).collect())) == want


def test_texts_meet_only_pairs_and_small_tables_lie_in_few_parts(spark):
    from conftest import SMALL

    from passagemill.plans import answers, evaluation
    from passagemill.plans.base import Tables

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        e = answers._Evidence(Tables(spark, SMALL))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [doc" not in plan(evaluation.expected(e.t, e.index))
        assert all("REPARTITION_BY_COL" in plan(x) for x in (e.concepts, e.candidates))
    finally:
        spark.conf.set(name, before)
        for df in e.t._kept:
            df.unpersist()


def test_credits_are_summed_where_documents_lie(spark, monkeypatch):
    from passagemill.operators import answers as A
    from passagemill.operators import index as X

    said = [(1, "casas hogar campo"), (2, ""), (3, None), (4, "hogar de verdes prados"), (5, "prados"), (6, "casa verdes rueda rueda")]
    made = X.build(spark.createDataFrame(said, "doc_id long, text string").repartition(X.LEAST_PARTITIONS))
    concepts = spark.createDataFrame([(1, "casa", 2.0), (1, "camp", 0.5), (2, "casa", 2.0), (2, "rued", 1.0), (3, "nada", 9.0)], "qid long, stem string, weight double")
    alternatives = spark.createDataFrame([("casa", 0, "hogar", 1), ("rued", 1, "verd", 2), ("rued", 1, "prad", 2), ("nada", 2, "prad", 1)], "stem string, phrase int, other string, size int")
    found = A.credits(concepts, alternatives, made.doc_stems.select("doc", "stem"))
    want = found.groupBy("qid", "doc").agg(F.count(F.lit(1)).alias("n"), F.sum("credit"), F.sum(F.col("weight") * F.col("credit")))
    rows = lambda df: sorted((r[0], r[1], r[2], round(r[3], 9), round(r[4], 9)) for r in df.collect())
    sums = A.credit_sums(made, concepts, alternatives)
    assert rows(sums) == rows(want) and {round(r[3], 6) for r in rows(want)} >= {0.7, 1.0, 1.7}
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    monkeypatch.setattr(X, "MOST_SUMMED", 1)
    assert rows(A.credit_sums(made, concepts, alternatives)) == rows(want)
    assert rows(A.credit_sums(made, concepts.limit(0), alternatives)) == []
    monkeypatch.setattr(X, "MOST_ASKED", 1)
    assert rows(A.credit_sums(made, concepts, alternatives)) == rows(want)


def test_blocks_and_slices_of_credits_are_bounded(spark, monkeypatch):
    words = [f"w{k}" for k in range(12)]
    weights = spark.createDataFrame([(q, words[(q + k) % 12], 1.0) for q in range(6) for k in range(3)], "qid int, stem string, weight double")
    alternatives = spark.createDataFrame([(q, words[(q + k) % 12], p) for q in range(6) for k in range(3) for p in ([words[(5 * q + k) % 12]], [words[q], words[11 - k]])], "qid int, concept string, stems array<string>")
    texts = spark.createDataFrame([(d, words[(d * k) % 12]) for d in range(40) for k in (1, 2, 5)], "doc int, stem string").distinct()
    rows = lambda: sorted((r["qid"], r["doc"], r["n"], round(r["credit"], 6)) for r in Q.credit_sums(weights, alternatives, texts).collect())
    found = Q.credits(weights, alternatives, texts).groupBy("qid", "doc").agg(F.count(F.lit(1)).alias("n"), F.sum("credit").alias("credit"))
    want = sorted((r["qid"], r["doc"], r["n"], round(r["credit"], 6)) for r in found.collect())
    assert rows() == want
    for name, value in {"MOST_WORDS": 20, "MOST_PAIRS": 60, "MOST_PHRASES": 8, "MOST_KEPT": 1, "AT_ONCE": 1}.items():
        monkeypatch.setattr(Q, name, value)
    assert rows() == want
    # A task's share, as it is dealt: many blocks and slices, each of them small.
    plan = Q.credit_sums(weights, alternatives, texts)._jdf.queryExecution().optimizedPlan().toString()
    blocks = [int(x) for x in re.findall(r"pmod\(xxhash64\(doc#\d+, 42\), (\d+)", plan)]
    slices = [int(x) for x in re.findall(r"pmod\(xxhash64\(whole#\d+, some#\d+, 42\), (\d+)", plan)]
    assert max(blocks) >= texts.count() // 20 and max(slices) > 1


def test_bits_of_phrases_are_kept_within_bounds(monkeypatch):
    import pyarrow as pa

    texts = pa.table({"doc": [1, 1, 2, 2, 3, 4], "stem": ["a", "b", "a", "c", "b", "d"]})
    shared = pa.table({"whole": [["a b", "a c", "b d"], []], "some": [["d"], ["c", "d", "x"]], "qids": [[7, 8], [7]], "concepts": [["b", "z"], ["a"]]})
    want = {(7, 1, 2, 2.0), (7, 2, 2, 2.0), (7, 3, 1, 1.0), (7, 4, 2, 1.4), (8, 1, 1, 1.0), (8, 2, 1, 1.0), (8, 4, 1, 0.7)}
    for kept, at_once in ((Q.MOST_KEPT, Q.AT_ONCE), (0, 1), (1, 2)):
        monkeypatch.setattr(Q, "MOST_KEPT", kept)
        monkeypatch.setattr(Q, "AT_ONCE", at_once)
        assert {(r["qid"], r["doc"], r["n"], round(r["credit"], 6)) for r in Q._summed(texts, shared).to_pylist()} == want
