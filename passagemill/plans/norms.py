"""Norms that change each other (inventory GR, SC7): texts written from orders and their lines, then read as any others.

An order is a norm, its lines the numbered passages.  A line modifies the norm
whose number is the line's part, in one of six wordings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as R
from ..operators import provisions as P
from ..sources import codes as C
from .base import query

KINDS = ["Resolución Exenta", "Decreto Supremo", "Circular"]


def kind(number: str) -> str:
    return f"CASE {number} % 3 WHEN 0 THEN '{KINDS[0]}' WHEN 1 THEN '{KINDS[1]}' ELSE '{KINDS[2]}' END"


POINTED = "CASE WHEN l_partkey < 1000 THEN CAST(l_partkey AS STRING) ELSE concat(CAST(CAST(floor(l_partkey / 1000) AS BIGINT) AS STRING), '.', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0')) END"
NTH = "(l_suppkey % 7 + 1)"
WORD = f"CASE {NTH} WHEN 1 THEN 'uno' WHEN 2 THEN 'dos' WHEN 3 THEN 'tercero' WHEN 4 THEN 'cuatro' WHEN 5 THEN 'quinto' WHEN 6 THEN 'seis' ELSE 'séptimo' END"
LINE = f"""concat(
  CASE l_linenumber WHEN 1 THEN '1.- ' WHEN 2 THEN 'Segundo.- ' WHEN 3 THEN 'Artículo 3.- ' WHEN 4 THEN '4) ' WHEN 5 THEN 'Punto 5.- ' WHEN 6 THEN '' ELSE 'Numeral 7º.- ' END,
  CASE l_returnflag WHEN 'A' THEN 'MODIFÍCASE' WHEN 'N' THEN 'Reemplázase' ELSE 'Deja sin efecto' END, ' la ',
  {kind("l_partkey")}, CASE WHEN l_linestatus = 'F' THEN ' N° ' ELSE ' ' END, {POINTED},
  CASE CAST(l_quantity AS INT) % 6
    WHEN 0 THEN concat(', en el sentido de reemplazar el actual número ', {WORD}, ' de su parte resolutiva.')
    WHEN 1 THEN '. El artículo tercero rige desde su publicación.'
    WHEN 2 THEN ' en la letra b) de dicha norma.'
    WHEN 3 THEN concat(', en los siguientes aspectos: el artículo ', CAST({NTH} AS STRING), '° queda sin texto.')
    WHEN 4 THEN ' respecto de los anexos n del trámite.'
    ELSE concat(' en el numeral ', CAST({NTH} AS STRING), ' del decreto que indica.') END)"""
PASSAGES = f"SELECT l_orderkey AS norm, l_linenumber AS line, l_partkey AS part, {kind('l_orderkey')} AS kind, CAST(l_orderkey AS STRING) AS number, {LINE} AS said FROM lineitem"
LABELLED = f"SELECT *, CASE WHEN line = 3 THEN 'Artículo 3' ELSE '' END AS label FROM ({PASSAGES})"
NOTE = f"""concat('El ', {kind("o_custkey")}, ' ', CAST(o_custkey AS STRING), ', Salud',
  CASE WHEN o_orderstatus = 'F' THEN concat(', publicado el ', substr(CAST(o_orderdate AS STRING), 9, 2), '.', substr(CAST(o_orderdate AS STRING), 6, 2), '.', substr(CAST(o_orderdate AS STRING), 1, 4)) ELSE '' END,
  ', sustituye el numeral ', CAST(o_orderkey % 9 + 1 AS STRING), 'º de la presente norma.')"""
NOTES = f"SELECT o_orderkey AS norm, {kind('o_orderkey')} AS kind, CAST(o_orderkey AS STRING) AS number, {NOTE} AS said FROM orders"


def _sql(t, text: str):
    """A text for both engines, its tables read here, dealt out as reading what they are written to is the work."""
    name, key = ("lineitem", "l_orderkey") if "FROM lineitem" in text else ("orders", "o_orderkey")
    return t.sql(text.replace(f"FROM {name}", "FROM {rows}"), rows=R.dealt(t(name), key))


def edges(t):
    named = F.concat_ws(" ", "kind", "number").alias("source")
    return P.outgoing(_sql(t, PASSAGES)).select("*", named)


def _duck(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


def _plain(c: str) -> str:
    return f"strip_accents(lower({c}))"


_WORDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ORDINALS.items())


def _class(c: str) -> str:
    one = f"regexp_replace(regexp_replace({_plain(c)}, '^numerales$', 'numeral'), 's$', '')"
    return f"CASE WHEN {one} IN ('numeral', 'punto', 'numero') THEN 'numero' ELSE {one} END"


def _number(c: str) -> str:
    v = f"{_plain(f'translate({c}, chr(186) || chr(176), chr(0))')}"
    v = f"replace({v}, chr(0), '')"
    return f"CASE {v} {_WORDS} ELSE {v} END"


#: The edges in DuckDB's words: a line has one at most, so its first match is all.
EDGES = f"""p AS ({LABELLED}), m AS (
  SELECT *, regexp_extract(said, '{_duck(P.OUTGOING + "(.*)")}', ['v', 'k', 'x', 'rest']) AS m FROM p 
), f AS (
  SELECT *, regexp_extract(regexp_replace(substr(m.rest, 1, 220), '\\.\\s+[A-ZÁÉÍÓÚÑ].*$', ''), '{_duck(P.NAMED.replace(P.FOLLOWING, '(.*)'))}', ['before', 'class', 'value', 'after']) AS d,
         CASE WHEN starts_with({_plain("m.v")}, 'modific') THEN 'modifica' WHEN starts_with({_plain("m.v")}, 'reempla') THEN 'reemplaza' ELSE 'deja sin efecto' END AS verb,
         CASE WHEN starts_with({_plain("m.k")}, 'resol') THEN '{KINDS[0]}' WHEN starts_with({_plain("m.k")}, 'decreto supremo') THEN '{KINDS[1]}' ELSE '{KINDS[2]}' END AS target_kind,
         ltrim(replace(m.x, '.', ''), '0') AS target_number
  FROM m WHERE m.v <> ''
), e AS (
  SELECT norm, line, part, kind, number, verb, target_kind, target_number, kind || ' ' || number AS source,
         CASE WHEN ok THEN class END AS class, CASE WHEN ok THEN value END AS value
  FROM (SELECT *, {_class("d.class")} AS class, {_number("d.value")} AS value,
               d.class <> '' AND ({_number("d.value")} SIMILAR TO '[0-9]+' OR ({_number("d.value")} SIMILAR TO '[a-z]' AND {_class("d.class")} = 'letra'))
               AND (regexp_matches(d.before, '{_duck(P.SENSE)}') OR regexp_matches(substr(d.after, 1, 90), '{_duck(P.TIE)}')) AS ok FROM f)
  WHERE target_number <> '' AND NOT (target_kind = kind AND target_number = ltrim(number, '0'))
)"""
HEAD = f"""h AS (
  SELECT *, regexp_extract(said, '{_duck(P.HEADING)}', ['class', 'value']) AS h, regexp_extract(label, '[0-9]+') AS of_label FROM p
), k AS (
  SELECT norm, line, part, kind, number, said, list_distinct(list_filter([
    CASE WHEN of_label <> '' THEN {{'class': 'articulo', 'value': of_label}} END,
    CASE WHEN h.value <> '' THEN {{'class': CASE WHEN h.class = '' THEN 'numero' ELSE {_class("h.class")} END, 'value': {_number("h.value")}}} END], lambda x: x IS NOT NULL)) AS own,
    row_number() OVER () AS id FROM h
), s AS (
  SELECT target_kind AS kind, target_number AS number, class, value, count(*) AS n, min({{'line': line, 'part': part, 'norm': norm, 'source': source, 'verb': verb}}) AS first
  FROM e WHERE class IS NOT NULL GROUP BY ALL
), x AS (
  SELECT id, sum(n)::BIGINT AS n_hits, min(first) AS hit
  FROM (SELECT id, kind, ltrim(number, '0') AS number, unnest(own) AS o FROM k) q JOIN s ON s.kind = q.kind AND s.number = q.number AND s.class = o['class'] AND s.value = o['value']
  GROUP BY id
)"""


@query("gr1_norm_edges", f"WITH {EDGES} SELECT norm, line, part, verb, target_kind, target_number, class, value FROM e")
def _(t):
    return edges(t).select("norm", "line", "part", "verb", "target_kind", "target_number", "provision.class", "provision.value")


@query(
    "gr2_noted_provisions",
    f"""SELECT norm, kind_ AS source_kind, CAST(o_custkey AS VARCHAR) AS source_number, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d.%m.%Y') ELSE '' END AS date,
    'sustituye' AS verb, 'numero' AS class, CAST(norm % 9 + 1 AS VARCHAR) AS value
    FROM (SELECT *, o_orderkey AS norm, {kind("o_custkey")} AS kind_ FROM orders) WHERE o_custkey > 0 AND o_custkey <> o_orderkey""",
)
def _(t):
    """Notes written from orders and read back by pattern; the twin says what was written."""
    return P.noted(_sql(t, NOTES)).select("norm", "source_kind", "source_number", "date", "verb", "provision.class", "provision.value")


ORDER = ["line", "part", "norm"]


@query("gr6_affected_by_provision", f"WITH {EDGES}, {HEAD} SELECT norm, line, part, n_hits, hit.source AS source, hit.verb AS verb FROM k JOIN x USING (id)")
def _(t):
    """Passages whose own provision some edge names, whichever class name of the same meaning it uses."""
    found = P.hits(_sql(t, LABELLED), edges(t), ORDER).filter("n_hits > 0")
    return found.select("norm", "line", "part", "n_hits", "hit.source", "hit.verb")


@query(
    "gr7_norm_alerts",
    f"""WITH {EDGES}, {HEAD}, o AS (SELECT o_orderkey AS norm, CASE WHEN o_orderpriority LIKE '1%' THEN strftime(o_orderdate, '%d-%m-%Y') ELSE 'no' END AS official FROM orders),
    names AS (SELECT target_kind AS kind, target_number AS number, array_to_string(list_sort(list(DISTINCT source)), ', ') AS names FROM e GROUP BY ALL)
    SELECT k.norm, line, part, CASE WHEN n_hits > 0 THEN 'provision ' || CASE hit.verb WHEN 'modifica' THEN 'modificada' WHEN 'reemplaza' THEN 'reemplazada' ELSE 'dejada sin efecto' END || ' by ' || hit.source
      WHEN names IS NOT NULL THEN 'norm modified by ' || substr(names, 1, 120)
      WHEN official <> 'no' THEN 'modified on ' || official ELSE '' END AS alert
    FROM k LEFT JOIN x USING (id) LEFT JOIN names ON names.kind = k.kind AND names.number = ltrim(k.number, '0') LEFT JOIN o ON o.norm = k.norm""",
)
def _(t):
    dates = t("orders").select(F.col("o_orderkey").alias("norm"), F.when(F.col("o_orderpriority").startswith("1"), F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("no").alias("official"))
    # Kept: passages meet them by provision and by norm.
    made = t.keep(edges(t))
    found = P.hits(_sql(t, LABELLED), made, ORDER).join(dates, "norm", "left")
    return P.alerts(found, made, "official").select("norm", "line", "part", "alert")


def _part(kind_: str, title: str, inner, gone=None):
    """A structure element of a law's file; inner: a column of XML."""
    state = F.lit("no derogado") if gone is None else gone
    return F.concat(
        F.lit(f'<EstructuraFuncional tipoParte="{kind_}" derogado="'), state, F.lit('" fechaVersion="2020-01-01"><Metadatos><TituloParte>' + title + "</TituloParte></Metadatos><EstructurasFuncionales>"), inner, F.lit("</EstructurasFuncionales></EstructuraFuncional>")
    )


def laws(t):
    """A file for each order, written as XML: lines are articles in books, in preliminary titles, or nowhere, by their flags.

    What moves are a line's columns; the XML is written where an order's lines are.
    """
    named = {"l_linenumber": "line", "l_partkey": "part", "l_suppkey": "supp", "l_shipdate": "day", "l_returnflag": "flag", "l_linestatus": "status", "l_discount": "discount"}
    rows = t("lineitem").select(F.col("l_orderkey").alias("law"), F.struct(*(F.col(c).alias(n) for c, n in named.items())).alias("x"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list("x")), _placed), "")
    whole = F.concat(F.lit('<?xml version="1.0"?><Norma xmlns="http://law.example/x" fechaVersion="2020-01-01"><EstructurasFuncionales>'), parts, F.lit("</EstructurasFuncionales></Norma>"))
    return rows.groupBy("law").agg(whole.alias("xml"))


def _placed(x):
    """The XML of a line, in its book or title."""
    article = F.concat(
        F.lit('<EstructuraFuncional tipoParte="Artículo" idParte="'), x["part"].cast("string"), F.lit('" derogado="'),
        F.when(x["discount"] > 0.05, "derogado").otherwise("no derogado"), F.lit('" fechaVersion="'), F.date_format(x["day"], "yyyy-MM-dd"),
        F.lit('"><Metadatos><NombreParte>'), x["line"].cast("string"), F.lit("</NombreParte></Metadatos><Texto>Texto de la parte "), x["part"].cast("string"), F.lit(" &amp; más.</Texto></EstructuraFuncional>"),
    )
    open_ = x["status"] == "F"
    nested = _part("Título", "Título Preliminar", article)
    return (
        F.when((x["flag"] == "A") & open_, _part("Libro", "LIBRO CUARTO De las cosas", nested))
        .when(x["flag"] == "A", _part("Libro", "Libro II", article, F.lit("derogado")))
        .when(x["flag"] == "N", _part("Título", "TÍTULO PRELIMINAR", _part("Párrafo", "", article)))
        .when(open_, article)
        .otherwise(_part("Título", "Título I", _part("Párrafo", "Párrafo 2", article)))
    )


@query(
    "sc7_code_articles",
    """SELECT l_orderkey AS law, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1)::INTEGER AS at,
      CASE l_returnflag WHEN 'A' THEN CASE l_linestatus WHEN 'F' THEN 'iv' ELSE 'ii' END WHEN 'N' THEN 'preliminar' ELSE 'final' END AS book,
      l_returnflag = 'A' AND l_linestatus <> 'F' AS book_repealed,
      CASE l_returnflag WHEN 'A' THEN CASE l_linestatus WHEN 'F' THEN 'LIBRO CUARTO De las cosas › Título Preliminar' ELSE 'Libro II' END
        WHEN 'N' THEN 'TÍTULO PRELIMINAR' ELSE CASE l_linestatus WHEN 'F' THEN '' ELSE 'Título I › Párrafo 2' END END AS path,
      l_linenumber::VARCHAR AS number, strftime(l_shipdate, '%Y-%m-%d') AS version, l_discount > 0.05 AS repealed, l_partkey::VARCHAR AS part_id,
      'Texto de la parte ' || l_partkey || ' & más.' AS said
    FROM lineitem""",
)
def _(t):
    """Laws written from orders and their lines and read back whole, with book and path; the twin says where each line was put."""
    found = C.articles_of(laws(t))
    return found.select("law", "at", "book", "book_repealed", F.array_join("path", " › ").alias("path"), "number", "version", "repealed", "part_id", "said")
