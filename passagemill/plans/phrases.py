"""Units, types, cues and phrases in context (inventory QA2, SE1-SE3, TX16): documents, and Spanish texts written from orders.

An order's text has items, abbreviations, a recital and margin notes, its
figures from the order; the question asked of it is one of seven by its customer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import patterns as P
from ..operators import questions as Q
from ..operators import sentences as S
from ..operators.index import sent
from . import retrieval as R
from .base import query

ASKED = (
    "¿Cuánto tiempo tengo para informar el pedido?",
    "¿Cuál es la multa por vender sin informar?",
    "¿A qué temperatura se debe guardar el pedido?",
    "¿Qué es una droguería?",
    "¿Quién puede vender el pedido?",
    "¿Qué requisitos se piden para comprar?",
    "¿Se puede vender por correo?",
)


def _number(c: str, mod: int):
    return (F.col(c) % mod + 2).cast("string")


def texts(t):
    """id, said and question of every order."""
    k = F.col("o_orderkey")
    said = F.concat_ws(
        " ",
        F.concat(F.lit("[Código "), "o_orderpriority", F.lit(" › Título "), _number("o_custkey", 9), F.lit("]")),
        F.concat(F.lit("PRIMERO: Que, según el art. 5 y la Res. Ex. N. "), k.cast("string"), F.lit(", informar es deber.")),
        F.concat(F.lit("El Sr. titular que quiera vender el pedido debe: a) Informar en "), _number("o_custkey", 70), F.lit(" horas; b) pagar una multa de "), _number("o_orderkey", 900), F.lit(" pesos; c) guardar el pedido a "), _number("o_orderkey", 8), F.lit(" ºC.")),
        F.when(k % 3 == 0, F.lit("Droguería es todo establecimiento que vende. Decreto 38, SALUD Art. 2 D.O. 02.05.2013 El farmacéutico podrá:")).when(k % 3 == 1, F.lit("Requisitos para comprar: 1. Contar con local. 2) Pagar; - Guardar.")),
        F.when(k % 2 == 0, F.lit("Vender por correo. VER NOTA 4 Ley 9, SALUD, 2010")),
        F.when(F.col("o_orderstatus") == "F", F.lit("El pedido dura menos de 5 años; se informará en forma inmediata.")),
    )
    question = F.get(F.array(*map(F.lit, ASKED)), (F.col("o_custkey") % len(ASKED)).cast("int"))
    return P.dealt(t("orders"), "o_orderkey").select(k.alias("id"), said.alias("said"), question.alias("question"))


ITEM_WORD, CAPITAL_WORD = r"^([0-9]{1,3}[.)]|[a-z]\))", r'^[A-ZÁÉÍÓÚÑ¿"“(]'
SHORT = ", ".join(f"'{x}'" for x in S.ABBREVIATIONS)
#: The same by pairs of words: a cut lies between two words or nowhere.
SE1_SQL = rf"""WITH w AS (
  SELECT doc, k, word, lead(word) OVER (PARTITION BY doc ORDER BY k) AS next, lead(word, 2) OVER (PARTITION BY doc ORDER BY k) AS after
  FROM (SELECT doc, unnest(x) AS word, generate_subscripts(x, 1) AS k FROM (
    SELECT doc_id AS doc, string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '^\[[^\]]{{0,300}}\]\s*', ''), ' ') AS x FROM documents))
), c AS (
  SELECT *, regexp_matches(coalesce(next, ''), '{ITEM_WORD}') OR (next = '-' AND after IS NOT NULL) AS item, lower(regexp_extract(word, '([{S.LETTER}º]+)\.$', 1)) AS last FROM w
), f AS (
  SELECT *, CASE WHEN next IS NULL THEN false WHEN word LIKE '%:' THEN item
    WHEN regexp_matches(word, '[.;]$') THEN (item OR regexp_matches(next, '{CAPITAL_WORD}')) AND NOT (word LIKE '%.' AND (last IN ({SHORT}) OR length(last) = 1)) ELSE false END AS cut FROM c
), n AS (
  SELECT doc, k, word, coalesce(sum(cut::INT) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM f
), u AS (SELECT doc, n, trim(string_agg(word, ' ' ORDER BY k)) AS unit FROM n GROUP BY doc, n)
SELECT doc, count(*)::BIGINT AS n_units, max(length(unit))::BIGINT AS longest, sha256(string_agg(unit, chr(10) ORDER BY n)) AS digest FROM u WHERE unit <> '' GROUP BY doc"""


@query("se1_units", SE1_SQL)
def _(t):
    """Units of whole documents, with the rules for abbreviations, single letters, colons and items."""
    cut = t("documents").select(F.col("doc_id").alias("doc"), S.units(F.col("text")).alias("u")).filter(F.size("u") > 0)
    longest = F.array_max(F.transform("u", lambda x: F.length(x))).cast("long")
    return cut.select("doc", F.size("u").cast("long").alias("n_units"), longest.alias("longest"), F.sha2(F.array_join("u", "\n"), 256).alias("digest"))


def pairs(t):
    """texts with kind and asked: the question's stems, without the words that only name the datum; equal questions are read once."""
    rows = texts(t)
    each = rows.select(F.col("question").alias("q")).distinct().withColumn("kind", S.question_type(F.col("q")))
    own = F.array_except(T.tokenize(F.col("q")), S.words_of_type(F.col("kind")))
    each = t.keep(each.withColumn("asked", T.stems(F.array_join(own, " "))))
    return rows.join(sent(each), F.col("question").eqNullSafe(F.col("q"))).drop("q")


@query("se2_phrases_in_context")
def _(t):
    """No SQL twin: patterns look behind, which DuckDB's can't; tested against a loop."""
    return S.best_phrases(pairs(t)).select("id", "at", F.round("coverage", 6).alias("coverage"), "datum", "recital", "phrase")


@query("se3_data_of_types")
def _(t):
    """Units with a datum of each of seven types, and recitals, in the texts of orders; no SQL twin, as above."""
    return S.data_of_types(texts(t))


@query("qa2_seven_types", "SELECT o_orderkey AS id, CASE o_custkey % 7 WHEN 0 THEN 'plazo' WHEN 1 THEN 'monto' WHEN 2 THEN 'temperatura' WHEN 3 THEN 'definicion' WHEN 4 THEN 'quien' WHEN 5 THEN 'requisitos' ELSE 'permiso' END AS kind FROM orders")
def _(t):
    return texts(t).select("id", S.question_type(F.col("question")).alias("kind"))


@query("tx16_without_margin_notes")
def _(t):
    """All eight kinds of notes, taken out of each order's whole text; no SQL twin, as above."""
    return texts(t).select("id", S.without_notes(F.col("said")).alias("said"))


def vocabulary(t):
    """triggers (rule, trigger) and added (rule, phrase), written from the first words of two sources' documents and of a third of the questions."""
    words = F.regexp_extract_all(T.normalise(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))
    own = t("documents").filter("source IN ('src1', 'src2')").select(F.col("doc_id").alias("rule"), words.alias("w"))
    asked = t("benchmark").filter("item_id % 3 = 0").select((-F.col("item_id") - 1).alias("rule"), words.alias("w"))
    rows = own.unionByName(asked).filter(F.size("w") >= 8)
    pick = lambda *k: F.concat_ws(" ", *(F.get("w", F.lit(i)) for i in k))
    triggers = rows.select("rule", F.explode(F.array(pick(0), pick(2, 3), pick(1, 2, 3))).alias("trigger"))
    return triggers, rows.select("rule", F.explode(F.array(pick(4, 5), pick(6))).alias("phrase"))


def asked(t):
    """The benchmark's texts as questions, some of them worded as asking for a definition."""
    text = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("¿Qué es un "), "text")).otherwise(F.col("text"))
    return Q.analysed(t("benchmark").select(F.col("item_id").alias("qid"), text.alias("text")), ["the", "que"])


@query("qa4_rules_set_off")
def _(t):
    """Rules of a vocabulary that a question sets off, by a word's stem or a phrase as it stands; no SQL twin: tested against a loop."""
    return Q.set_off(asked(t), vocabulary(t)[0], 3)


@query("qa4_words_added")
def _(t):
    """Words that fired rules add to the search, at half weight; no SQL twin, as above."""
    triggers, added = vocabulary(t)
    rows = asked(t)
    return Q.expanded(rows, Q.set_off(rows, triggers, 3), added)[1]


def _weights(t):
    triggers, added = vocabulary(t)
    rows, made = asked(t), R.index(t)
    alternatives, words = Q.expanded(rows, Q.set_off(rows, triggers, 3), added)
    alternatives = t.keep(alternatives)
    return rows, alternatives, words, Q.weighted(Q.concepts(rows), alternatives, made.stems, made.idf_unseen), made


@query("qa6_terms_to_define")
def _(t):
    """The term that a question asks to define: of the words right after the wording, or the weightiest; no SQL twin, as above."""
    rows, _, _, weights, _ = _weights(t)
    return Q.defined(rows, weights)


@query("ev1_credits_of_phrases")
def _(t):
    """Credits of each question's concepts in each document, alternatives of whole phrases included; no SQL twin, as above."""
    _, alternatives, _, weights, made = _weights(t)
    return Q.credit_sums(weights, alternatives, made.doc_stems.select("doc", "stem")).withColumn("credit", F.round("credit", 6))
