"""Operators without a SQL twin, against plain loops, and the readers and writers, on fixtures."""

import collections
import datetime
import json
import random
import re
import shutil

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from passagemill.functions import dates as D
from passagemill.functions import money as M
from passagemill.functions import text as T
from passagemill.operators import answers as A
from passagemill.operators import changes as C
from passagemill.operators import chunks as H
from passagemill.operators import index as X
from passagemill.operators import intervals as I
from passagemill.operators import ledger as G
from passagemill.operators import linkage as L
from passagemill.operators import rules as V
from passagemill.operators import tables as B
from passagemill.sources import files as S
from passagemill.streaming import counters


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return rows.select(column.alias("r")).first()["r"]


# Text and dates


def test_stems_and_tokens(spark):
    assert one(spark, T.tokenize(F.lit("¿Cuáles son las AUTORIZACIONES del artículo 12 y Ñandú?"))) == ["cuales", "son", "autorizaciones", "12", "nandu"]
    stem = {"autorizaciones": "autoriz", "notificar": "notificar", "casas": "casa", "vigentes": "vigent", "12345": "12345", "mesa": "mesa"}
    assert {w: one(spark, T.stem(F.lit(w))) for w in stem} == stem


def test_formats(spark):
    assert one(spark, T.csv_cell(F.lit('=1+"a"'))) == '"\'=1+""a"""'
    assert one(spark, T.local_number(F.lit("1.234,5"))) == 1234.5 and one(spark, T.local_number(F.lit("x"))) is None
    assert one(spark, T.clean_html(F.lit("a<br/>b <b>c</b>&nbsp;&amp;lt;"))) == "a b c &lt;"
    assert one(spark, T.url_basename(F.lit("https://a.b/c%20d/E%20F.PDF?x=1#y"))) == "e f.pdf"
    assert one(spark, T.shorten(F.lit("word " * 200), 60)).endswith("word…") and one(spark, T.shorten(F.lit("short"))) == "short"
    assert sorted(one(spark, T.numbers(F.lit("1.651 y 2,50 y 007 y 10,0")))) == ["10", "1651", "2.5", "7"]


def test_dates(spark):
    day = lambda s: one(spark, D.day_month_year(F.lit(s)))
    assert day("05/03/2021") == datetime.date(2021, 3, 5) and day(" 2019 ") == datetime.date(2019, 1, 1)
    assert day("31/02/2020") is None and day("01/01/1800") is None and day("x") is None
    assert one(spark, D.loose_date(F.lit("del 7/9/22021, vigente"))) == datetime.date(2021, 9, 7)
    assert one(spark, D.loose_date(F.lit("año 1998"))) == datetime.date(1998, 1, 1)
    assert one(spark, D.iso_week(F.lit("2021-01-03").cast("date"))) == "2020-W53"
    assert [one(spark, D.strict_iso(F.lit(s))) for s in ("2024-02-29", "2023-02-29", "2023-2-1")] == [True, False, False]
    assert [one(spark, D.nice_ceiling(F.lit(x))) for x in (0.0, 1.0, 1.2, 34.0, 51.0)] == [1.0, 1.0, 2.0, 50.0, 100.0]


def test_month_ends_and_zones(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    for start, now, want in (("2024-01-31 10:00:00", "2024-03-01 09:00:00", "2024-02-29"), ("2024-01-31 10:00:00", "2024-03-31 10:00:00", "2024-03-31"), ("2023-05-15 00:00:00", "2024-05-14 23:00:00", "2024-04-15")):
        assert one(spark, F.date_format(G.cycle_start(ts(start), ts(now)), "yyyy-MM-dd")) == want
    # The local day begins at four in winter and at three in summer.
    for at, want in (("2024-06-10 02:00:00", "2024-06-09 04:00"), ("2024-12-10 02:00:00", "2024-12-09 03:00")):
        assert one(spark, F.date_format(D.local_trunc("day", F.lit(at).cast("timestamp")), "yyyy-MM-dd HH:mm")) == want


def test_money(spark):
    assert [one(spark, M.credits_for_cost(F.lit(x))) for x in (0.0, 0.001, 0.0011, 0.005)] == [1, 1, 2, 5]
    source = lambda *a: one(spark, M.source_of_credit(*map(F.lit, a), 65, 10))
    assert [source(0, 0, 0, 0), source(65, 0, 0, 5), source(0, 10, 0, 0), source(65, 0, 0, 0), source(65, 0, 300, 9)] == ["plan", "pack", "day cap", "no credits", "pack cap"]


# Order-bound operators against loops


def test_passages_against_a_loop():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.choice([5, 40, 200, 700, 1600, 2500]) for _ in range(rng.randint(1, 30))]
        got, i, n = H.pack(lengths), 0, len(lengths)
        for a, b in got:
            assert a == i
            size = 0
            for j in range(a, n):
                if j > a and size + lengths[j] > H.SIZE and size >= 0.4 * H.SIZE:
                    break
                size += lengths[j]
            else:
                j = n
            assert b == j
            back, over = j, 0
            while back - 1 > a and over < H.OVERLAP:
                back -= 1
                over += lengths[back]
            i = max(back, a + 1)
        assert got[-1][1] == n


def test_units_pages_sections_titles(spark):
    docs = spark.createDataFrame([(1, "Primero. Segundo.\n\n" + "Una frase larga. " * 120), (2, ""), (3, None)], "doc_id long, text string")
    units = H.units(docs).collect()
    assert {u["doc"] for u in units} == {1} and max(len(u["unit"]) for u in units) < 30 and units[0]["unit"] == "Primero. Segundo."
    assert all(len(p["said"]) >= H.LEAST for p in H.passages(docs).collect())
    starts = spark.createDataFrame([(1, 0, 1), (1, 100, 2), (1, 250, 3)], "doc long, start long, page int")
    offsets = spark.createDataFrame([(1, 0), (1, 99), (1, 100), (1, 900), (2, 5)], "doc long, offset long")
    assert sorted(tuple(r) for r in H.page_at(offsets, starts).collect()) == [(1, 0, 1), (1, 99, 1), (1, 100, 2), (1, 900, 3), (2, 5, 1)]
    text = F.lit("VISTO: algo.\nRESUELVO: mucho más texto que sigue aquí.\nANEXO")
    marks = {"preamble": "VISTO", "resolution": "RESUELVO", "annex": "ANEXO"}
    assert [one(spark, H.section(text, F.lit(o), marks)) for o in (0, 14, 60)] == ["preamble", "resolution", "resolution"]
    assert one(spark, H.title(F.lit("corto\nAPRUEBA NORMA TÉCNICA SOBRE ROTULADO\nx"))) == "APRUEBA NORMA TÉCNICA SOBRE ROTULADO"
    assert one(spark, H.ocr_alerts(F.lit("artículo 12, artículo 512 y N* 4, N* 4, juangmail.com"))) == ["article 512", "number sign N* 4", "mail juangmail.com"]


def test_listing_records_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, f"k{rng.randint(0, 5)}", rng.sample(["a", "b", "c", "d", "e", "f"], rng.randint(0, 4))) for i in range(300)]
    got = {r["id"]: r["record"] for r in L.collapse(spark.createDataFrame(rows, "id long, key string, words array<string>"), ["key"], "words", "id").collect()}
    records = collections.defaultdict(list)
    for i, k, words in rows:
        own = set(words)
        for n, other in enumerate(records[k]):
            if not own or not other or len(own & other) / min(len(own), len(other)) >= 0.6:
                break
        else:
            n = len(records[k])
            records[k].append(own)
        assert got[i] == n


def test_links_and_copies(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, k string")
    one_ = spark.createDataFrame([("a", 7), ("a", 5)], "k string, target long")
    two = spark.createDataFrame([("a", 1), ("b", 9)], "k string, target long")
    assert sorted((r["id"], r["target"], r["method"], r["sure"]) for r in L.resolve(left, "k", ("url", one_), ("number", two)).collect()) == [(1, 5, "url", False), (2, 9, "number", True), (3, None, "none", False)]
    docs = spark.createDataFrame([("g", "x" * 743, "native", "a"), ("g", "x" * 5636, "ocr", "b"), ("h", "x" * 50, "ocr", "c"), ("h", "x" * 40, "native", "d")], "g string, text string, kind string, name string")
    kept = L.canonical_copy(docs, "g", "text", F.when(F.col("kind") == "native", 0).otherwise(1), "name")
    assert {r["g"]: r["name"] for r in kept.collect()} == {"g": "b", "h": "d"}
    folded = L.fold(spark.createDataFrame([(1, "k", "b", "xx"), (2, "k", "a", "xxx"), (3, "k", "b", "yyy")], "n long, k string, c string, d string"), ["k"], "n", ["c"], "d").first()
    assert folded["c"] == ["b", "a"] and folded["d"] == "xxx"
    said = spark.createDataFrame([(1, "Este decreto MODIFICA el Decreto 38 y deroga la Ley 20.850; modifica el Decreto 38.")], "doc_id long, text string")
    edges = L.edges(said, {"modifies": "modifica (?:el|la)", "repeals": "deroga (?:el|la)"}, r"(?:Ley|Decreto) [0-9.]*[0-9]")
    assert sorted((r["verb"], r["target"]) for r in L.first_of(edges, ["verb", "target"], ["n"]).collect()) == [("modifies", "Decreto 38"), ("repeals", "Ley 20.850")]


def test_greedy_caps_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(q, d, k, f"s{rng.randint(0, 25)}", f"d{rng.randint(0, 4)}", f"n{rng.randint(0, 2)}") for q in range(8) for k, d in enumerate(rng.sample(range(100), 40), 1)]
    got = sorted((r["qid"], r["place"], r["doc"]) for r in A.greedy_caps(spark.createDataFrame(rows, "qid long, doc long, rank long, signature string, doc_group string, norm string")).collect())
    want = []
    for q in range(8):
        seen, docs, norms, n = set(), collections.Counter(), collections.Counter(), 0
        for _, d, _, s, g, m in sorted((r for r in rows if r[0] == q), key=lambda r: r[2]):
            if n < 6 and s not in seen and docs[g] < 3 and norms[m] < 4:
                n += 1
                seen.add(s)
                docs[g] += 1
                norms[m] += 1
                want.append((q, n, d))
    assert got == sorted(want)


def test_merged_spans_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(q, 1, a, a + rng.randint(1, 9)) for q in range(30) for a in [rng.randint(0, 60) for _ in range(12)]]
    got = sorted((r["qid"], r["start"], r["end"]) for r in A.merged_spans(spark.createDataFrame(rows, "qid long, doc long, start long, end long")).collect())
    want = []
    for q in range(30):
        own = []
        for a, b in sorted((a, b) for k, _, a, b in rows if k == q):
            if own and a <= own[-1][1] + 1:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
        want += [(q, a, b) for a, b in own]
    assert got == sorted(want)


def test_ledger_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(u, f"2024-01-{d:02d}", s) for u in range(5) for s, d in enumerate(sorted(rng.randint(1, 9) for _ in range(120)))]
    got = {(r["user"], r["seq"]): r["source"] for r in G.decide_in_order(spark.createDataFrame(rows, "user long, day string, seq long"), 20, 4, 15).collect()}
    cycle, day, left = collections.Counter(), collections.Counter(), collections.Counter()
    for u, d, s in rows:
        if cycle[u] < 20 and day[u, d] < 4:
            cycle[u] += 1
            day[u, d] += 1
            want = "plan"
        elif left[u] < 15:
            left[u] += 1
            want = "pack"
        else:
            want = "none"
        assert got[u, s] == want


def test_two_pass_diff_against_a_loop(spark):
    rng = random.Random(6)
    rows = lambda: [(rng.choice("ab"), rng.choice("xy"), rng.choice("pqr"), i) for i in range(14)]
    for _ in range(4):
        old, new = rows(), rows()
        schema = "c string, k string, d string, n long"
        got = C.multiset_diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["c", "k", "d"], ["c", "k"], ["d"], "n")
        states = collections.Counter(r["state"] for r in got.collect())
        full, left = collections.defaultdict(collections.deque), []
        for r in old:
            full[r[:3]].append(r)
        same = 0
        for r in new:
            if full[r[:3]]:
                full[r[:3]].popleft()
                same += 1
            else:
                left.append(r)
        short = collections.Counter(r[:2] for own in full.values() for r in own)
        changed = 0
        for r in left:
            if short[r[:2]]:
                short[r[:2]] -= 1
                changed += 1
        assert states == +collections.Counter(same=same, changed=changed, new=len(left) - changed, removed=len(old) - same - changed)


def test_rules(spark):
    assert V.numbers_in_words("multa de cuarenta a cuatrocientas unidades") == [40, 400]
    assert V.numbers_in_words("ciento ochenta y dos mil tres y veinte") == [182023]
    assert V.numbers_in_words("dos millones y mil") == [2001000] or V.numbers_in_words("mil") == [1000]
    good, bad = V.resolve_citations(F.lit("a [P2, P3] b [P2-P4] c [P9] d [ p 1 ]"), F.lit(5))
    assert one(spark, good) == [2, 3, 4] and one(spark, bad) == [9]
    assert one(spark, V.sanitise(F.lit("a\n--- {b} [P2] <c>"))) == "a b c"
    assert one(spark, V.safe_path(F.lit("/ok/x"))) == "/ok/x" and one(spark, V.safe_path(F.lit("//evil"))) == "/"
    assert one(spark, V.unverified_numbers(F.lit("72 horas y 5"), F.lit("son 72 horas"))) == ["5"]
    classes = {"[P1] x": "format", "pretend to be": "role", "me duele": "clinical", "write a poem": "task", "que es": "answer"}
    assert {q: one(spark, V.request_class(T.normalise(F.lit(q)))) for q in classes} == classes


def test_slots_and_counters(spark):
    days = spark.createDataFrame([("d1", 540, 660), ("d2", 540, 560)], "day string, opens int, closes int")
    busy = spark.createDataFrame([("d1", 600, 615)], "day string, from int, to int")
    free = sorted((r["day"], r["start"]) for r in I.free(I.slots(days, 30, 15), busy, 30, 15).collect())
    assert free == [("d1", 540), ("d1", 555), ("d1", 630)]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(tuple(r) for r in B.latest_wins(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in B.anti_append(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]


# Files


def test_jsonl_and_nested(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "é"}\n')
    rows = S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long, b string")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2]
    S.write_jsonl(rows, str(tmp_path / "out"))
    assert S.read_jsonl(spark, str(tmp_path / "out"), "a long, b string").count() == 2
    for name, body in (("n.json", {"records": [{"x": "1"}, {"x": "2"}]}), ("l.json", [{"x": "1"}, {"x": "2"}])):
        (tmp_path / name).write_text(json.dumps(body))
        assert sorted(r["x"] for r in S.read_nested(spark, str(tmp_path / name), "records", "x string").collect()) == ["1", "2"]


def test_files_and_sidecars(spark, tmp_path):
    for p in ("one/A.pdf", "two/b.pdf", "skip/c.pdf", "one/x.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * 10)
    assert sorted((r["folder"], r["name"]) for r in S.files(spark, str(tmp_path), "*.pdf", "skip").collect()) == [("one", "A.pdf"), ("two", "b.pdf")]
    native = spark.createDataFrame([("A", "n" * 300), ("B", "short"), ("C", None)], "name string, said string")
    side = spark.createDataFrame([("b", "lower" * 50), ("B", "exact" * 50), ("c", "few")], "name string, said string")
    got = {r["name"]: (r["kind"], r["said"][:5]) for r in S.text_or_sidecar(native, side).collect()}
    assert got == {"A": ("native", "nnnnn"), "B": ("sidecar", "exact"), "C": ("empty", "")}


def test_xml(spark, tmp_path):
    (tmp_path / "law.xml").write_text('<Norma><Libro n="1"><Titulo><Articulo numero="1" version="2020-01-01"><Texto> Uno </Texto></Articulo></Titulo><Articulo numero="2" version="2021-01-01" derogado="si"><Texto>Dos</Texto></Articulo></Libro></Norma>')
    got = sorted((r["number"], r["version"], r["repealed"], r["said"]) for r in S.read_law(spark, str(tmp_path / "law.xml")).collect())
    assert got == [("1", "2020-01-01", False, "Uno"), ("2", "2021-01-01", True, "Dos")]
    (tmp_path / "part.xml").write_text('<DIV5 N="11"><DIV6 N="A"><DIV8 N="11.1"><HEAD>Scope.</HEAD><P>a</P><P>b</P><CITA>[62 FR]</CITA></DIV8><DIV8 N="11.2"><HEAD>[Reserved]</HEAD></DIV8></DIV6></DIV5>')
    got = sorted((r["number"], r["said"], r["reserved"]) for r in S.read_sections(spark, str(tmp_path / "part.xml")).collect())
    assert got == [("11.1", "a\nb", False), ("11.2", "", True)]


def test_html_and_markdown_tables(spark):
    html = "<table><thead><tr><th>h</th></tr><tr><td><strong>Rotulado</strong></td></tr></thead><tr><td>1</td><td>Ley</td><td>20.850</td><td>d</td><td><a href='x.pdf'>f</a></td></tr><tr><td>few</td></tr></table>"
    row = one(spark, S.listing_rows(F.lit(html)))
    assert [(r["category"], r["cells"][2], r["link"]) for r in row] == [("Rotulado", "20.850", "x.pdf")]
    assert one(spark, S.pipe_rows(F.lit("| a | b | c | d | e |\n|---|---|---|---|---|\n| 1 | 2 | 3 | 4 | 5 |\ntext"))) == [list("abcde"), list("12345")]


def test_guard_replace_and_log(spark, tmp_path, monkeypatch):
    rows = spark.range(5)
    assert S.guarded(rows, 5).count() == 5
    with pytest.raises(ValueError):
        S.guarded(rows, 6)
    path = f"file://{tmp_path}/t"
    for n in (3, 8, 5):
        S.replace_atomically(spark.range(n), path)
        assert S.read_current(spark, path).count() == n
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")]) == 2
    # A rename that fails leaves the old rows, and readers meet them.
    monkeypatch.setattr(S, "_set_current", lambda *_: (_ for _ in ()).throw(OSError("no rename")))
    with pytest.raises(OSError):
        S.replace_atomically(spark.range(9), path)
    assert S.read_current(spark, path).count() == 5
    for _ in range(2):
        S.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 10


def test_index_is_reused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alfa beta gama"), (2, "beta gama delta"), (3, "")], "doc_id long, text string")
    made = X.open_or_build(docs, f"file://{tmp_path}/ix")
    again = X.open_or_build(docs, f"file://{tmp_path}/ix")
    assert made.n == again.n == 3 and len(list((tmp_path / "ix").iterdir())) == 1
    X.open_or_build(docs.limit(2), f"file://{tmp_path}/ix")
    assert len(list((tmp_path / "ix").iterdir())) == 2
    q = spark.createDataFrame([(1, "alfa", 1.0), (1, "delta", 0.5)], "qid long, term string, weight double")
    assert [r["doc"] for r in X.top(X.score(again, q), 2).orderBy("rank").collect()] == [1, 2]


# Streams


def test_window_counter_stream(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp_ntz"
    at = datetime.datetime(2024, 1, 1, 10, 0)
    for n, rows in enumerate(([(1, 7, at), (2, 7, at), (3, 8, at)], [(4, 7, at + datetime.timedelta(minutes=20)), (5, 7, at + datetime.timedelta(hours=2))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", counters.hourly_counts(stream), "complete"), ("limits", counters.rate_limited(stream, 2), "update")):
        run = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert run.awaitTermination(90)
    assert sorted((r["user_id"], r["n"]) for r in spark.table("counts").collect()) == [(7, 1), (7, 3), (8, 1)]
    got = [(r["key"], r["hour"].hour, r["allowed"], r["refused"]) for r in spark.table("limits").collect()]
    assert sum(r for *_, r in got) == 1 and sum(a for k, _, a, _ in got if k == 7) == 3 and len(got) == 4


def test_index_cuts_texts_where_they_are(spark):
    said = ["Ünïcode ÁRBOLES árboles x 77 de la", "", None, "aplicaciones Aplicación K9 ﬁn İstanbul", "casas casa casas " * 9 + "iendoiendo 1234567as"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(X.LEAST_PARTITIONS)
    made = X.build(docs)
    terms = docs.select(F.col("doc_id").alias("doc"), F.explode(T.tokenize(F.col("text"))).alias("term"))
    count = lambda rows, by: sorted(map(tuple, rows.groupBy("doc", by).agg(F.count(F.lit(1))).collect()))
    assert sorted(map(tuple, made.postings.collect())) == count(terms, "term")
    assert sorted(map(tuple, made.doc_stems.collect())) == count(terms.withColumn("stem", T.stem(F.col("term"))), "stem")
    heads = docs.select(F.col("doc_id").alias("doc"), F.slice(T.tokenize(F.col("text")), 1, X.HEAD).alias("head"))
    assert sorted(map(tuple, made.heads.collect())) == sorted(map(tuple, heads.collect())) and made.n == 5
    # One shuffle deals the documents' rows; none counts terms by document.
    assert X.rows_of(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    q = spark.createDataFrame([(1, "casa", 1.0)], "qid long, term string, weight double")
    plan = X.score(made, q)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc#" in plan and "hashpartitioning(qid#" not in plan


@pytest.mark.parametrize("most", [X.MOST_CUT, 40, 1])
def test_index_counts_words_by_chunks(monkeypatch, most):
    """Words of a text are one string and their counts an array; a chunk's counts are in one row of it and sum up to the corpus'."""
    import pyarrow as pa

    monkeypatch.setattr(X, "MOST_CUT", most)
    said = ["", None, "Casas casas, x casa de 77!", "ÁRBOLES straße_árbol", " a el la ", "casa\tcasa\x1fb2 " * 9, "aplicaciones 12345678as 12345678", None]
    want = [collections.Counter(w for w in re.findall("[a-z0-9]{2,}", (x or "").lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))) if w not in T.STOP_WORDS) for x in said]
    batch = pa.record_batch([pa.array(range(len(said))), pa.array(said)], names=["doc", "text"])
    got = [x for part in X._cut(iter([batch, batch.slice(0, 0)])) for x in part.to_pylist()]
    assert [dict(zip((x["terms"] or "").split(), x["tfs"], strict=True)) for x in got] == want and [x["dl"] for x in got] == [c.total() for c in want]
    assert [x["terms"] is None and x["stems"] is None for x in got] == [not c for c in want]
    df, stem = collections.Counter(), {}
    for x in got:
        df.update({y["term"]: y["df"] for y in x["term_counts"]})
        stem |= {y["term"]: y["stem"] for y in x["term_counts"]}
    assert df == collections.Counter(w for c in want for w in c) and stem["aplicaciones"] == "aplic" and stem["casas"] == stem["casa"][:4] == "casa"
    stems = collections.Counter()
    for x in got:
        stems.update({y["stem"]: y["df"] for y in x["stem_counts"]})
    assert stems == collections.Counter(s for c in want for s in {stem[w] for w in c})
    assert sum(bool(x["term_counts"]) for x in got) == (1 if most > 40 else 4)


def _scores(said, asked):
    """BM25 of all pairs with a term in common, by a plain loop."""
    import math

    count = {doc: collections.Counter(text.split()) for doc, text in said}
    mean, df = sum(c.total() for c in count.values()) / len(count), collections.Counter(w for c in count.values() for w in c)
    out = collections.defaultdict(float)
    for qid, w, weight in asked:
        for doc, c in count.items():
            if c[w]:
                idf = math.log(1 + (len(count) - df[w] + 0.5) / (df[w] + 0.5))
                out[qid, doc] += weight * idf * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean))
    return out


@pytest.mark.parametrize("most_asked, most_summed", [(X.MOST_ASKED, X.MOST_SUMMED), (3, X.MOST_SUMMED), (X.MOST_ASKED, 60)])
def test_scores_where_documents_lie_against_a_loop(spark, monkeypatch, most_asked, most_summed):
    monkeypatch.setattr(X, "MOST_ASKED", most_asked)
    monkeypatch.setattr(X, "MOST_SUMMED", most_summed)
    luck = random.Random(3)
    words = [f"w{k}q" for k in range(12)]
    said = [(doc, " ".join(luck.choices(words, range(1, 13), k=luck.randint(0, 9)))) for doc in range(60)]
    said += [(doc + 60, said[doc][1]) for doc in range(30)]  # equal scores
    asked = [(qid, w, luck.choice((1.0, 0.5))) for qid in range(5) for w in [*luck.sample(words, 4), "unseen"]]
    made = X.build(spark.createDataFrame(said, "doc_id long, text string").repartition(X.LEAST_PARTITIONS))
    q = spark.createDataFrame(asked, "qid long, term string, weight double")
    want = _scores(said, asked)
    for rows in (X.scores(made, q), X.score(made, q)):
        assert {(r["qid"], r["doc"]): pytest.approx(r["score"]) for r in rows.collect()} == want
    for k in (1, 4):
        order = {qid: sorted((-round(x / max(v for (p, _), v in want.items() if p == qid), 6), doc) for (p, doc), x in want.items() if p == qid)[:k] for qid in range(5)}
        assert {(r["qid"], r["rank"], r["doc"]) for r in X.ranked(made, q, k).collect()} == {(qid, n + 1, doc) for qid, x in order.items() for n, (_, doc) in enumerate(x)}
    if most_asked == X.MOST_ASKED == 1_000_000:
        # Neither terms nor sums move: only the documents' rows are dealt out, by the test itself.
        plan = X.scores(made, q)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        assert X.best(made, q, 1).count() < len(want)


def test_credits_of_candidates_alone(spark):
    concepts = spark.createDataFrame([(q, s, 1.0 + q) for q in (1, 2) for s in ("a", "b", "c")], "qid long, stem string, weight double")
    alternatives = spark.createDataFrame([("a", 0, "x", 1), ("b", 1, "y", 2), ("b", 1, "z", 2)], "stem string, phrase int, other string, size int")
    stems = spark.createDataFrame([(7, "a"), (7, "y"), (8, "x"), (8, "y"), (8, "z"), (9, "c")], "doc long, stem string")
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "qid long, doc long")
    rows = lambda df: sorted(map(tuple, df.select("qid", "doc", "concept", "weight", "credit").collect()))
    want = rows(A.credits(concepts, alternatives, stems).join(pairs, ["qid", "doc"], "left_semi"))
    assert rows(A.credits(concepts, alternatives, stems.join(pairs, "doc"))) == want and len(want) == 5


def _index_rows(made):
    scores = [sorted(tuple(r) for r in x.collect()) for x in (made.postings, made.docs, made.doc_stems)]
    return [*scores, *(sorted((*r[:-1], round(r[-1], 9)) for r in x.collect()) for x in (made.terms.select("term", "stem", "df", "idf"), made.stems.select("stem", "df", "idf"))), made.n, round(made.mean_length, 9)]


def test_index_follows_its_files(spark, tmp_path):
    words = "alfa beta gama delta épsilon dseta eta theta iota kappa".split()
    dice = random.Random(7)
    write = lambda name, ids: spark.createDataFrame([(i, " ".join(dice.choices(words, k=i % 5))) for i in ids], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/docs/{name}")
    path, folder = f"file://{tmp_path}/docs/*", f"file://{tmp_path}/ix"
    for k in range(9):
        write(f"p{k}", range(100 * k, 100 * k + 60))
    whole = X.open_files(spark, path, folder)
    assert whole.n == 540 and _index_rows(whole) == _index_rows(X.open_or_build(spark.read.parquet(path), f"{folder}-b"))

    def versions():
        return [x for x in (tmp_path / "ix").glob("*/*/ready")]

    X.open_files(spark, path, folder)
    assert len(versions()) == 1
    first = {x for x in (tmp_path / "ix").rglob("*.parquet")}
    # A file more; then one changed, with documents that stay and others; then one less.
    for step in (lambda: write("p9", range(2000, 2030)), lambda: write("p3", [*range(300, 330), *range(3000, 3020)]), lambda: shutil.rmtree(tmp_path / "docs" / "p9")):
        step()
        kept = X.open_files(spark, path, folder)
        assert _index_rows(kept) == _index_rows(X.open_or_build(spark.read.parquet(path), f"{folder}-b"))
    assert len(versions()) == 4
    assert all(x.exists() for x in first)
    old = sum(x.stat().st_size for x in first if "postings" in str(x))
    assert all(spark.read.parquet(str(x)).count() < 0.2 * whole.postings.count() for x in (tmp_path / "ix").rglob("postings") if not any(str(f).startswith(str(x)) for f in first)) and old
    # Many changes at once are a build anew, of one segment.
    for k in range(5):
        write(f"p{k}", range(5000 + 100 * k, 5000 + 100 * k + 60))
    again = X.open_files(spark, path, folder)
    assert _index_rows(again) == _index_rows(X.open_or_build(spark.read.parquet(path), f"{folder}-b"))


def test_opening_an_index_reads_no_text(spark, tmp_path):
    plan = X.file_facts(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
