"""Ingest: sources, passages, record linkage and edges (inventory SC, CH, LK, GR).

Pages give links, documents give lines and passages, parts give a listing whose
records repeat; readers of files are tested on fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as H
from ..operators import linkage as L
from ..sources import files as S
from .base import both, query


@query("sc9_page_links", """SELECT page_id, count(*)::BIGINT AS n, min(link) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY page_id""")
def _(t):
    links = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("link").alias("first"))


@query("sc9_listing_table", "SELECT p_partkey, p_name AS name, p_brand AS brand, 'https://site.example/' || p_partkey AS link FROM part")
def _(t):
    """Rows are written as table rows of a page and read back."""
    cells = F.concat_ws("", *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in (F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), F.col("p_type"))))
    html = F.concat(F.lit("<table><thead><strong>Parts</strong></thead><tr><th>x</th></tr><tr>"), cells, F.lit("<td><a href=\"https://site.example/"), "p_partkey", F.lit("\">file</a></td></tr></table>"))
    rows = t("part").select(F.explode(S.listing_rows(html)).alias("r"))
    return rows.select(F.get("r.cells", F.lit(0)).cast("long").alias("p_partkey"), F.get("r.cells", F.lit(1)).alias("name"), F.get("r.cells", F.lit(2)).alias("brand"), F.col("r.link").alias("link"))


@query("sc10_pipe_tables", "SELECT s_suppkey, s_name AS name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.concat_ws(" | ", F.lit(""), F.col("s_suppkey").cast("string"), "s_name", "n_name", F.lit("x"), F.lit("y"), F.lit(""))
    rows = s.select(F.explode(S.pipe_rows(F.concat(F.lit("| a | b |\n|---|---|\n"), line))).alias("c"))
    return rows.select(F.get("c", F.lit(0)).cast("long").alias("s_suppkey"), F.get("c", F.lit(1)).alias("name"), F.get("c", F.lit(2)).alias("nation"))


both("sc11_guard_figures", "SELECT count(*) >= 50 AS enough, count(*) FILTER (WHERE length(url) < 8) AS bad FROM {pages}")


@query("sc17_embedded_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def _(t):
    html = F.concat(F.lit("<script>const DATA = "), "props", F.lit(";</script>"))
    return t("events").filter("props IS NOT NULL").select("event_id", S.embedded_json(html, "DATA", "k long")["k"].alias("k"))


@query("sc3_nested_documents", "SELECT r_name AS name, length(r_name)::BIGINT AS n FROM region")
def _(t):
    """A document whose rows are in one of its fields."""
    doc = t("region").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("r_name").alias("name"))).alias("records"))).alias("value"))
    rows = doc.select(F.explode(F.from_json("value", "struct<records: array<struct<name: string>>>")["records"]).alias("r"))
    return rows.select("r.name", F.length("r.name").cast("long").alias("n"))


@query("ch1_units", r"""WITH p AS (SELECT doc_id AS doc, unnest(x) AS para, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS x FROM documents)),
c AS (SELECT doc, CASE WHEN length(trim(para, ' ' || chr(9) || chr(13) || chr(10))) <= 1500 THEN [trim(para, ' ' || chr(9) || chr(13) || chr(10))] ELSE string_split(regexp_replace(trim(para, ' ' || chr(9) || chr(13) || chr(10)), '([.!?:])\s+([A-ZÁÉÍÓÚÑ0-9("“])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS u FROM p WHERE trim(para, ' ' || chr(9) || chr(13) || chr(10)) <> '')
SELECT doc, count(*)::BIGINT AS n, max(length(x))::BIGINT AS longest FROM (SELECT doc, unnest(u) AS x FROM c) GROUP BY doc""")
def _(t):
    return H.units(t("documents")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("unit")).cast("long").alias("longest"))


@query("ch2_passages")
def _(t):
    """No SQL twin: where a passage ends depends on where the one before ended; tested against a loop."""
    return H.passages(t("documents")).select("doc", "passage", F.length("said").alias("n_chars"))


@query("ch4_page_of_offset", "SELECT o_orderkey, page FROM (SELECT o.o_orderkey, (SELECT max(p) FROM (SELECT unnest([1, 2, 3, 4]) AS p) WHERE (p - 1) * 100 <= o.o_orderkey % 450) AS page FROM orders o)")
def _(t):
    """Pages of 100 characters in documents of 450: an order is an offset in the document of its customer."""
    offsets = t("orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 450).alias("offset"), "o_orderkey")
    pages = t("customer").select(F.col("c_custkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page")).withColumn("start", ((F.col("page") - 1) * 100).cast("long"))
    found = H.page_at(offsets.select("doc", "offset").distinct(), pages)
    return offsets.join(found, ["doc", "offset"]).select("o_orderkey", "page")


@query("ch5_sections", r"""SELECT doc_id, CASE WHEN regexp_matches(text, 'license') AND 300 >= length(regexp_extract(text, '^([\s\S]*?)(?:license)', 1)) AND length(regexp_extract(text, '^([\s\S]*?)(?:license)', 1)) <= 0.85 * length(text) THEN 'license' ELSE 'body' END AS section FROM documents""")
def _(t):
    return t("documents").select("doc_id", H.section(F.col("text"), F.lit(300), {"license": "license"}).alias("section"))


@query("ch7_titles", r"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, list_transform(string_split(substr(text, 1, 2500), chr(10)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'), ' .-—·|')) AS x FROM documents)),
f AS (SELECT doc_id, arg_min(line, n) AS title FROM l WHERE length(line) BETWEEN 25 AND 220 AND len(regexp_extract_all(line, '\p{L}')) > 0 AND len(regexp_extract_all(line, '\p{Lu}')) > 0.6 * len(regexp_extract_all(line, '\p{L}')) GROUP BY doc_id)
SELECT doc_id, coalesce(substr(title, 1, 200), '') AS title FROM documents LEFT JOIN f USING (doc_id)""")
def _(t):
    return t("documents").select("doc_id", H.title(F.col("text")).alias("title"))


@query("ch8_scan_alerts", "SELECT p_partkey, CASE WHEN p_partkey % 1000 > 400 THEN 'article ' || p_partkey % 1000 || ';number sign N* 5' ELSE 'number sign N* 5' END AS alerts FROM part")
def _(t):
    said = F.concat(F.lit("ver artículo "), (F.col("p_partkey") % 1000).cast("string"), F.lit(" y N* 5 y N* 5"))
    return t("part").select("p_partkey", F.array_join(H.ocr_alerts(said), ";").alias("alerts"))


SYNONYMS = {"promo burnished copper": "copper", "economy anodized steel": "steel", "standard": "std"}


@query("lk1_canonical_types", "SELECT p_partkey, CASE trim(lower(p_type)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items()) + " ELSE trim(p_type) END AS type FROM part")
def _(t):
    return t("part").select("p_partkey", L.canonical_type(F.col("p_type"), SYNONYMS).alias("type"))


@query("lk2_listing_records")
def _(t):
    """No SQL twin: a row joins the first record that is like it, by those before it; tested against a loop."""
    rows = t("part").withColumn("words", F.array_distinct(F.split(F.lower("p_name"), " ")))
    return L.collapse(rows, ["p_brand"], "words", "p_partkey").select("p_partkey", "record")


@query("lk3_folded_records", "SELECT p_brand, array_to_string(list_distinct_ordered, ',') AS types, arg_max(p_name, {'a': length(p_name), 'b': -p_partkey}) AS name FROM (SELECT p_brand, p_name, p_partkey FROM part) JOIN (SELECT p_brand, list(p_type ORDER BY k) AS list_distinct_ordered FROM (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY ALL) GROUP BY p_brand) USING (p_brand) GROUP BY ALL")
def _(t):
    out = L.fold(t("part"), ["p_brand"], "p_partkey", ["p_type"], "p_name")
    return out.select("p_brand", F.array_join("p_type", ",").alias("types"), F.col("p_name").alias("name"))


@query("lk4_resolved_links", """WITH d AS (SELECT page_id, lower(trim(split_part(regexp_extract(url_decode(url), '^[^?#]*'), '/', -1))) AS base FROM pages),
a AS (SELECT o_orderkey::VARCHAR AS base, min(o_custkey) AS target FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT p_partkey::VARCHAR AS base, min(p_size)::BIGINT AS target FROM part GROUP BY 1)
SELECT page_id, coalesce(a.target, b.target) AS target, CASE WHEN a.target IS NOT NULL THEN 'order' WHEN b.target IS NOT NULL THEN 'part' ELSE 'none' END AS method FROM d LEFT JOIN a USING (base) LEFT JOIN b USING (base)""")
def _(t):
    left = t("pages").select("page_id", T.url_basename(F.col("url")).alias("base"))
    orders = t("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("base"), F.col("o_custkey").alias("target"))
    parts = t("part").select(F.col("p_partkey").cast("string").alias("base"), F.col("p_size").cast("long").alias("target"))
    return L.resolve(left, "base", ("order", orders), ("part", parts)).select("page_id", "target", "method")


@query(
    "lk5_canonical_copies",
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g')
    ORDER BY -(length(text) // 4000), CASE lang WHEN 'en' THEN 0 ELSE 1 END, -length(text), doc_id) AS n FROM documents) WHERE n = 1""",
)
def _(t):
    """Copies are texts whose letters and digits are the same, all of them, whatever their case, accents and signs."""
    same = F.sha2(F.regexp_replace(T.normalise(F.col("text")), "[^a-z0-9]+", ""), 256)
    docs = t("documents").withColumn("same", same)
    return L.canonical_copy(docs, "same", "text", F.when(F.col("lang") == "en", 0).otherwise(1), "doc_id").select("doc_id")


@query("lk6_merged_categories", "SELECT text_hash, array_to_string(CASE WHEN len(c) > 1 THEN list_filter(c, lambda x: x <> 'src0') ELSE c END, ',') AS categories FROM (SELECT sha1(text) AS text_hash, list_sort(list(DISTINCT source)) AS c FROM documents GROUP BY text)")
def _(t):
    """Categories of all copies, without the catch-all (here src0) where there are others."""
    c = F.array_sort(F.collect_set("source"))
    rows = t("documents").groupBy(F.sha1("text").alias("text_hash")).agg(c.alias("c"))
    return rows.select("text_hash", F.array_join(F.when(F.size("c") > 1, F.array_remove("c", F.lit("src0"))).otherwise(F.col("c")), ",").alias("categories"))


#: Texts name licences here as legal texts name other texts.
VERBS = {"licensed": "licensed under the", "copyright": "copyright"}


def license_edges(t):
    return L.edges(t("documents"), VERBS, "[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*")


EDGES = " UNION ALL ".join(
    f"SELECT doc_id, '{v}' AS verb, unnest(x) AS target, generate_subscripts(x, 1) - 1 AS n FROM (SELECT doc_id, regexp_extract_all(text, '(?i:{p})\\s+([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)', 1) AS x FROM documents)" for v, p in VERBS.items()
)


@query("gr1_edges", f"SELECT doc_id, verb, target, n::BIGINT AS n FROM ({EDGES})")
def _(t):
    return license_edges(t).select("doc_id", "verb", "target", F.col("n").cast("long").alias("n"))


@query("gr4_edges_once", f"SELECT verb, target, min(doc_id) AS first FROM ({EDGES}) GROUP BY verb, target")
def _(t):
    once = L.first_of(license_edges(t), ["verb", "target"], ["doc_id", "n"])
    return once.select("verb", "target", F.col("doc_id").alias("first"))


@query("gr5_incoming_edges", f"SELECT target, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM ({EDGES}) WHERE target <> '' GROUP BY target")
def _(t):
    return license_edges(t).filter("target <> ''").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(
    "gr6_affected_passages",
    rf"""WITH e AS ({EDGES}), p AS (SELECT doc_id, unnest(x) AS said, generate_subscripts(x, 1) - 1 AS passage
    FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n|\n') AS x FROM documents))
    SELECT p.doc_id, passage::BIGINT AS passage, count(*)::BIGINT AS n FROM p JOIN (SELECT DISTINCT doc_id, target FROM e WHERE target <> '') x ON p.doc_id = x.doc_id
    WHERE contains(said, x.target) GROUP BY ALL""",
)
def _(t):
    """Passages, a line each and all of the text, that name a target of the document's own edges: the equal key carries the join."""
    e = license_edges(t).filter("target <> ''").select("doc_id", "target").distinct()
    passages = t("documents").join(e.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", r"\n\s*\n|\n")).alias("passage", "said"))
    met = passages.join(e, "doc_id").filter(F.contains("said", "target"))
    return met.groupBy("doc_id", F.col("passage").cast("long").alias("passage")).agg(F.count(F.lit(1)).alias("n"))


@query("gr7_alert_choice", f"WITH e AS (SELECT doc_id, count(*) AS n FROM ({EDGES}) GROUP BY doc_id) SELECT doc_id, CASE WHEN n >= 2 THEN 'several' WHEN n = 1 THEN 'one' WHEN lang = 'fr' THEN 'dated' END AS alert FROM documents LEFT JOIN e USING (doc_id)")
def _(t):
    n = license_edges(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    alert = F.when(F.col("n") >= 2, "several").when(F.col("n") == 1, "one").when(F.col("lang") == "fr", "dated")
    return t("documents").select("doc_id", "lang").join(n, "doc_id", "left").select("doc_id", alert.alias("alert"))


both("gr8_audit_counters", "SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE n_chars < 200) AS short FROM {documents} GROUP BY lang, source ORDER BY n DESC, lang, source")



@query("ch3_articles", r"""WITH m AS (SELECT doc_id AS doc, text, string_split(regexp_replace(text, '(^|\n)([A-Z]{3,}!!)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents),
r AS (SELECT doc, unnest(x) AS said, generate_subscripts(x, 1) - 1 AS article FROM (SELECT doc, CASE WHEN len(p) > 2 THEN p ELSE [text] END AS x FROM m)),
l AS (SELECT doc, article, regexp_extract(said, '^([A-Z]{3,}!!)', 1) AS label, trim(said) AS said FROM r)
SELECT doc, article::BIGINT AS article, label, length(said)::BIGINT AS n FROM l WHERE length(said) >= 60 AND (label <> '' OR length(said) > 200 OR article = 0)""")
def _(t):
    """Lines that begin with a shouted word stand for article headings."""
    found = H.by_article(t("documents"), "[A-Z]{3,}!!")
    return found.select("doc", F.col("article").cast("long").alias("article"), "label", F.length("said").cast("long").alias("n"))


@query("ch6_paragraph_parts")
def _(t):
    """No SQL twin: as ch2; tested against a loop."""
    return H.by_paragraph(t("documents")).select("doc", "part", F.length("said").alias("n"))


@query("gr2_noted_edges", "SELECT doc_id, unnest(x) AS source, generate_subscripts(x, 1) - 1 AS n FROM (SELECT doc_id, regexp_extract_all(text, '(?i:copyright)\\s+([0-9(c) ]*[A-Z][a-z]+)', 1) AS x FROM documents)")
def _(t):
    out = L.noted_edges(t("documents"), "copyright", "[0-9(c) ]*[A-Z][a-z]+")
    return out.select("doc_id", "source", F.col("n").cast("long").alias("n"))


@query("gr3_provisions", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'articulo' WHEN 1 THEN 'letra' ELSE 'anexo' END AS kind, CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 90)::VARCHAR WHEN 1 THEN 'b' ELSE '3' END AS value FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat(F.lit("modifica el artículo "), (F.col("p_partkey") % 90).cast("string"))).when(k == 1, "sustituye la letra b) del").otherwise("agrega el Anexo TERCERO al")
    kind, value = L.provision(T.normalise(said))
    return t("part").select("p_partkey", kind.alias("kind"), value.alias("value"))


@query("tx16_without_notes", "SELECT o_orderkey, 'El titular ' || CASE WHEN o_orderkey % 2 = 0 THEN 'deberá informar' ELSE 'podrá (DO)  informar' END AS said FROM orders")
def _(t):
    said = F.when(F.col("o_orderkey") % 2 == 0, "El titular Decreto 38, SALUD D.O. 02.05.2013 deberá informar VER NOTA 2").otherwise("El titular podrá (DO)  informar")
    return t("orders").select("o_orderkey", T.without_notes(said).alias("said"))
