"""Edges, provisions and the passages they hit: planted sentences, and a loop over written norms."""

import collections

import pytest
from conftest import SMALL

from passagemill.operators import provisions as P
from passagemill.plans import norms
from passagemill.plans.base import Tables
from passagemill.plans.registry import QUERIES

TEXTS = [
    ("tied", "1.- MODIFÍCASE la Resolución Exenta N° 1.287, de 2009, en el sentido de reemplazar el actual número dos de su parte resolutiva.", [("modifica", "Resolución Exenta", "1287", "numero", "2")]),
    ("next sentence", "Derógase el Decreto Supremo Nº 033 de Salud. Artículo tercero: rige desde hoy, de la presente norma.", [("deroga", "Decreto Supremo", "33", None, None)]),
    ("after", "Sustitúyese la Ley 20.850 en su Anexo 3 de dicha ley", [("sustituye", "Ley", "20850", "anexo", "3")]),
    ("untied", "complementa la circular n 7 con el artículo 4 que sigue", [("complementa", "Circular", "7", None, None)]),
    ("letter", "reemplázase el decreto con fuerza de ley 1, letra B) de la misma ley", [("reemplaza", "Decreto con Fuerza de Ley", "1", "letra", "b")]),
    ("no letter", "Modifica el Decreto 9 en los anexos N de su texto", [("modifica", "Decreto", "9", None, None)]),
    ("close", "Deroga la ley 5 y deja sin efecto la norma técnica 6, en los siguientes aspectos: numerales 8º y 9º", [("deroga", "Ley", "5", "numero", "8"), ("deja sin efecto", "Norma Técnica", "6", "numero", "8")]),
    ("itself", "Modifica la Circular N° 0044, que es ésta, y agrega la Circular 45", [("agrega", "Circular", "45", None, None)]),
    ("zero", "modifica la ley 0 y la ley 00", []),
    ("none", None, []),
    ("empty", "", []),
    ("far", "Modifica la ley 8 " + "x" * 230 + " artículo 3 de su texto", [("modifica", "Ley", "8", None, None)]),
]


def test_edges_of_planted_texts(spark):
    rows = spark.createDataFrame([(k, "Circular", "44", t) for k, t, _ in TEXTS], "id string, kind string, number string, said string")
    found = collections.defaultdict(list)
    for r in P.outgoing(rows).orderBy("id", "n").collect():
        p = r["provision"]
        found[r["id"]].append((r["verb"], r["target_kind"], r["target_number"], p and p["class"], p and p["value"]))
    assert dict(found) == {k: want for k, _, want in TEXTS if want}


def test_edges_of_notes(spark):
    said = [
        (1, "Ver nota: El Decreto 33 Exento, Salud, publicado el 27.01.2015, sustituye el numeral 8º de la presente norma."),
        (2, "La Resolución 12, Salud, deroga el artículo segundo de la presente norma. La ley 9, complementa la presente norma"),
        (3, "El Decreto 44, modifica la presente norma"),
        (4, None),
    ]
    rows = spark.createDataFrame([(k, "Decreto", "44", t) for k, t in said], "id int, kind string, number string, said string")
    found = [(r["id"], r["source_kind"], r["source_number"], r["date"], r["verb"], tuple(r["provision"] or ())) for r in P.noted(rows).orderBy("id", "n").collect()]
    assert found == [
        (1, "Decreto Exento", "33", "27.01.2015", "sustituye", ("numero", "8")),
        (2, "Resolución Exenta", "12", "", "deroga", ("articulo", "2")),
        (2, "Ley", "9", "", "complementa", ()),
    ]


@pytest.mark.parametrize(
    ("label", "said", "want"),
    [
        ("", "2.- Se fija", {("numero", "2")}),
        (None, "  “Segundo.- Se fija", {("numero", "2")}),
        ("Artículo 12", "Artículo 12.- Se fija", {("articulo", "12")}),
        ("Artículo séptimo", "3) Se fija", {("articulo", "7"), ("numero", "3")}),
        ("", "Punto 5 - nada", {("numero", "5")}),
        ("", "2015 fue un año. 3.- no", set()),
        ("Considerando", None, set()),
    ],
)
def test_provisions_of_passages(spark, label, said, want):
    row = P.with_provisions_of(spark.createDataFrame([(label, said)], "label string, said string")).first()
    assert {(p["class"], p["value"]) for p in row["own"]} == want


def test_affected_passages_and_alerts_by_a_loop(spark):
    t = Tables(spark, SMALL)
    edges = [r.asDict(recursive=True) for r in norms.edges(t).collect()]
    passages = [r.asDict(recursive=True) for r in P.with_provisions_of(norms._sql(t, norms.LABELLED)).collect()]
    by, names = collections.defaultdict(list), collections.defaultdict(set)
    for e in edges:
        names[e["target_kind"], e["target_number"]].add(e["source"])
        if e["provision"]:
            by[e["target_kind"], e["target_number"], *e["provision"].values()].append(((e["line"], e["part"], e["norm"]), e["source"], e["verb"]))
    dates = {r["o_orderkey"]: (r["o_orderpriority"], r["o_orderdate"]) for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect()}
    hits, alerts = collections.Counter(), collections.Counter()
    for p in passages:
        number = p["number"].lstrip("0")
        met = sorted(x for o in p["own"] for x in by.get((p["kind"], number, *o.values()), []))
        place = (p["norm"], p["line"], p["part"])
        of_norm = names.get((p["kind"], number))
        priority, day = dates.get(p["norm"], ("", None))
        if met:
            hits[(*place, len(met), *met[0][1:])] += 1
            alert = f"provision {P.PARTICIPLES[met[0][2]]} by {met[0][1]}"
        elif of_norm:
            alert = "norm modified by " + ", ".join(sorted(of_norm))[:120]
        else:
            alert = f"modified on {day:%d-%m-%Y}" if priority.startswith("1") else ""
        alerts[(*place, alert)] += 1
    assert hits and len({a[-1][:8] for a in alerts}) == 4
    from passagemill.plans.registry import QUERIES

    assert collections.Counter(tuple(r) for r in QUERIES["gr6_affected_by_provision"](spark, SMALL).select("norm", "line", "part", "n_hits", "source", "verb").collect()) == hits
    assert collections.Counter(tuple(r) for r in QUERIES["gr7_norm_alerts"](spark, SMALL).select("norm", "line", "part", "alert").collect()) == alerts


def test_patterns_of_tasks_read_any_case_and_texts_without_end(spark):
    texts = [
        ("many", " ".join(f"Deroga la ley {k}, letra a) de su texto." for k in range(1, 41)), [("deroga", "Ley", str(k), "letra", "a") for k in range(1, 41)]),
        ("turkish", "DEROGA LA CİRCULAR Nº 7, ARTıCULO 5° DE DICHA norma", [("deroga", "ci\u0307rcular", "7", "artıculo", "5")]),
        ("wide", "deroga la ley 8, en el sentido de poner anexo 3º", [("deroga", "Ley", "8", "anexo", "3")]),
        ("joined", "deroga la ley 9 en la subletra a) de su texto; ley 9 letra bis) de su texto", [("deroga", "Ley", "9", None, None)]),
        ("sign", "deroga la ley 10, numeral 5°a de la misma", [("deroga", "Ley", "10", "numero", "5")]),
        ("line", "deroga la ley 11 en su artículo 5 de su texto", [("deroga", "Ley", "11", None, None)]),
    ]
    rows = spark.createDataFrame([(k, None, None, t) for k, t, _ in texts], "id string, kind string, number string, said string")
    found = collections.defaultdict(list)
    for r in P.outgoing(rows).orderBy("id", "n").collect():
        p = r["provision"]
        found[r["id"]].append((r["verb"], r["target_kind"], r["target_number"], p and p["class"], p and p["value"]))
    assert dict(found) == {k: want for k, _, want in texts}
    row = P.with_provisions_of(spark.createDataFrame([("", "SEXTO.- uno\ndos")], "label string, said string")).first()
    assert [tuple(p) for p in row["own"]] == [("numero", "6")]


def test_norms_are_read_in_tasks_on_all_cores_and_meet_by_provision_alone(spark):
    plan = QUERIES["gr6_affected_by_provision"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "MapInArrow" in plan and "regexp_extract_all" not in plan
    assert norms._sql(Tables(spark, SMALL), norms.PASSAGES).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
