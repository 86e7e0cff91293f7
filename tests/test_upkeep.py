"""Links by a loop, counts by ranks against pairs, guarded replacement."""

import random
import re
import unicodedata

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from passagemill.operators import intervals as I
from passagemill.operators import linkage as L
from passagemill.plans import upkeep
from passagemill.plans.base import Tables
from passagemill.plans.registry import QUERIES
from passagemill.sources import files as S


def plain(text):
    return " ".join("".join(c for c in unicodedata.normalize("NFD", text or "") if unicodedata.category(c) != "Mn").lower().split())


def number(text):
    return (text or "").strip().upper().replace(".", "").replace(" ", "")


def short(text):
    return (re.search("[A-Z]*[0-9]+[A-Z]*", number(text)) or [""])[0]


def of_name(name):
    stem = plain(re.sub("[-_]+", " ", name.rsplit(".", 1)[0]))
    for kind in map(plain, L.FILE_KINDS):
        if stem.startswith(kind):
            found = re.search(r"[a-z]?[0-9][0-9.\-]*", stem[len(kind) :])
            return kind, number(found[0].rstrip(".-")) if found else ""
    return "", ""


def loop(name, norms, overrides):
    base, (kind, own) = name.lower(), of_name(name)
    over = overrides.get(base)
    if over:
        meant = [n[0] for n in norms if plain(n[1]) == plain(over[0]) and number(n[2]) == number(over[1])] if over[0] or over[1] else []
        if meant:
            return min(meant), "override", "high"
        if over[2]:
            return f"manual:{base}", "manual", "manual"
    by_url = [n for n in norms if n[3] == base and base.endswith(".pdf")]
    if len(by_url) == 1:
        return by_url[0][0], "url", "high"
    if by_url:
        same = [n[0] for n in by_url if own and (number(n[2]) == own or (short(own) and short(n[2]) == short(own)))]
        return (min(same), "url and file", "high") if same else (min(n[0] for n in by_url), "url", "ambiguous")
    if kind and own:
        exact = [n[0] for n in norms if plain(n[1]) == kind and number(n[2]) == own]
        if exact:
            return min(exact), "kind and number", "high" if len(exact) == 1 else "ambiguous"
        brief = [n[0] for n in norms if plain(n[1]) == kind and short(n[2]) == short(own)]
        if len(brief) == 1:
            return brief[0], "kind and short number", "medium"
    return None, "none", "none"


def test_links_against_a_loop(spark):
    t = Tables(spark, SMALL)
    norms = [(r["norm_id"], r["kind"], r["number"], r["base"]) for r in upkeep._read(t, upkeep.NORMS).withColumn("base", upkeep.T.url_basename(F.col("link"))).collect()]
    overrides = {r["name"]: (r["kind"], r["number"], r["title"]) for r in upkeep._read(t, upkeep.OVERRIDES).collect()}
    found = {r["name"]: tuple(r)[1:] for r in QUERIES["lk4_files_of_norms"](spark, SMALL).select("name", "norm_id", "method", "confidence").collect()}
    assert found == {name: loop(name, norms, overrides) for name in found}
    assert {x[1:] for x in found.values()} >= {("override", "high"), ("manual", "manual"), ("url", "high"), ("url and file", "high"), ("url", "ambiguous"), ("kind and number", "high"), ("kind and short number", "medium"), ("none", "none")}


def test_links_of_odd_files(spark):
    files = spark.createDataFrame([("A.PDF",), ("A.PDF",), ("resolución-exenta_1.287-.pdf",), ("Ley.pdf",), (".pdf",), ("x",)], "name string")
    norms = spark.createDataFrame([("n1", "Resoución  Exenta", "1.287", None), ("n1", "Resolución Exenta", "1287", "http://h/a.pdf"), ("n2", "Ley", "", "http://h/%zz"), ("n3", None, None, None)], "norm_id string, kind string, number string, link string")
    found = {r["name"]: tuple(r)[1:] for r in L.resolve_files(files, norms, spark.createDataFrame([], "name string, kind string, number string, title string")).collect()}
    assert found == {"A.PDF": ("n1", "url", "high"), "resolución-exenta_1.287-.pdf": ("n1", "kind and number", "high"), "Ley.pdf": (None, "none", "none"), ".pdf": (None, "none", "none"), "x": (None, "none", "none")}


@pytest.mark.parametrize("values", [12, 400])
def test_counts_by_ranks_are_those_of_pairs(spark, values):
    dice = random.Random(values)
    points = [(dice.choice("ab"), dice.randrange(-values, values) / 4) for _ in range(300)] + [("a", 1.5)] * 200
    rows = [(k, dice.choice("abc"), low := dice.randrange(-values, values) / 4, low + dice.randrange(9) / 4) for k in range(80)]
    found = I.count_between(spark.createDataFrame(rows, "id long, g string, low double, high double"), spark.createDataFrame(points, "g string, x double"), "g", 1.0)
    assert {r["id"]: r["n"] for r in found.collect()} == {k: sum(p == g and low <= x <= high for p, x in points) for k, g, low, high in rows}


def test_free_slots_by_ranks(spark):
    dice = random.Random(2)
    slots = [(dice.choice(["d1", "d2", "d3"]), s) for s in range(540, 1000, 15)]
    busy = [(d, a := dice.randrange(500, 1000), a + dice.randrange(1, 90)) for d in ("d1", "d1", "d1", "d2", "d9")]
    args = spark.createDataFrame(slots, "day string, start int"), spark.createDataFrame(busy, "day string, `from` int, `to` int"), 30, 15
    want = sorted(map(tuple, I.free(*args).collect()))
    assert sorted(map(tuple, I.free_by_ranks(*args).collect())) == want and 0 < len(want) < len(slots)


def test_guarded_replacement_runs_its_source_once(spark, tmp_path):
    path, runs = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def rows(n):
        def told(batches):
            for b in batches:
                runs.add(b.num_rows)
                yield b

        return spark.range(n).mapInArrow(told, "id long")

    guards = {"enough": F.count(F.lit(1)) >= 50, "no large id": F.max("id") < 1000}
    assert S.replace_guarded(rows(60), path, guards) == {"enough": True, "no large id": True} and runs.value == 60
    for n, names in ((10, "enough"), (2000, "no large id"), (0, "enough, no large id")):
        with pytest.raises(ValueError, match=names):
            S.replace_guarded(rows(n), path, guards)
        assert S.read_current(spark, path).count() == 60 and len(list((tmp_path / "t").glob("v-*"))) == 1
    S.replace_guarded(rows(70), path, guards)
    assert S.read_current(spark, path).count() == 70


# Counters and citations


def loop_quota(rows, most, seconds, offset):
    state, out = {}, {}
    for key, i, at, returned in sorted(rows, key=lambda r: (r[2], r[1])):
        start = (at + offset) // seconds * seconds - offset
        used = state.get((key, start), 0)
        used = max(0, used - 1) if returned else used + 1
        state[key, start] = used
        out[i] = (start, used, returned or used <= most, max(0, most - used), max(1, start + seconds - at))
    return out


def _requests(n, seed):
    dice = random.Random(seed)
    return [(dice.randrange(4), i, 1_700_000_000 + dice.randrange(40_000), dice.random() < 0.4) for i in range(n)]


def test_quota_against_a_loop(spark):
    rows = _requests(400, 1)
    found = I.quota(spark.createDataFrame(rows, "key long, id long, at long, returned boolean"), 3, 3600, F.lit(-5400), ["id"])
    assert {r["id"]: (r["start"], r["used"], r["allowed"], r["left"], r["retry_after"]) for r in found.collect()} == loop_quota(rows, 3, 3600, -5400)


def test_quota_stream_and_its_restart(spark, tmp_path):
    import datetime

    from passagemill.streaming import counters

    rows = sorted(_requests(120, 2), key=lambda r: r[2])
    schema = "key long, id long, at timestamp, returned boolean"
    stamped = [(k, i, datetime.datetime.fromtimestamp(at, datetime.UTC), x) for k, i, at, x in rows]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n in range(3):  # a run for each part, from the checkpoint that the one before left
            spark.createDataFrame(stamped[40 * n : 40 * n + 40], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            run = counters.quota(stream, 3, 3600, -5400, "6 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
            assert run.awaitTermination(120) and run.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = {r["id"]: (r["start"], r["used"], r["allowed"], r["left"], r["retry_after"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == loop_quota(rows, 3, 3600, -5400)


def loop_citations(draft, names):
    valid, bad = set(), set()

    def one(m):
        n = [int(x) for x in re.findall("[0-9]+", m[0])]
        if len(n) == 2 and re.search("[–-]", m[0]) and n[1] > n[0]:
            n = list(range(n[0], n[1] + 1))
        for x in n:
            (valid if 1 <= x <= len(names) else bad).add(x)
        said = [names[x - 1] if 1 <= x <= len(names) else "cita no verificable" for x in n]
        return "[" + "; ".join(dict.fromkeys(said)) + "]"

    text = re.sub(r"[\[【]\s*P\s*[0-9]+(?:\s*(?:[,;y–-]|\s)\s*P?\s*[0-9]+)*\s*[\]】]", one, draft, flags=re.I)
    return text, ", ".join(f"{x}={names[x - 1]}" for x in sorted(valid)), ",".join(map(str, sorted(bad))), not valid


def test_citations_against_a_loop(spark):
    conversations = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    names = {}
    for r in sorted(conversations, key=lambda r: (r["conv_id"], r["turn"])):
        names.setdefault(r["conv_id"], []).append(f"{r['role']} {r['turn']}")
    want = {}
    for r in conversations:
        mark = upkeep.MARKS[(r["conv_id"] + r["turn"]) % 6]
        want[r["conv_id"], r["turn"]] = loop_citations(f"Según{mark} {r['text'] or ''}{mark}", names[r["conv_id"]])
    found = {(r["conv_id"], r["turn"]): (r["rewritten"], r["sources"], r["invalid"], r["uncited"]) for r in QUERIES["vr7_drafts_with_citations"](spark, SMALL).collect()}
    assert found == want
    assert any(x[2] for x in want.values()) and any("y [" in x[0] for x in want.values()) and any(x[3] for x in want.values())
