"""Text functions over documents, pages and conversations (inventory TX)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .base import Tables, query

#: The same normal form and tokens in DuckDB's words.
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
DUCK_TOKENS = "list_filter(regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains(" + STOP_LIST + ", t))"
DUCK_STEM = "CASE WHEN length({t}) <= 4 OR regexp_full_match({t}, '[0-9]+') THEN {t} ELSE regexp_replace({t}, '^(.{{4,}}?)(" + "|".join(T.SUFFIXES) + ")$', '\\1') END"


def duck_tokens(c: str) -> str:
    return DUCK_TOKENS.replace("{c}", c)


def duck_stem(t: str) -> str:
    return DUCK_STEM.format(t=t)


def tokens_table(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", "lang", "source", F.explode(T.tokenize(F.col("text"))).alias("term"))


@query("tx1_strip_accents", "SELECT doc_id, strip_accents(lower(text)) AS plain FROM documents")
def _(t):
    return t("documents").select("doc_id", T.strip_accents(F.col("text")).alias("plain"))


@query("tx2_tokenize", f"SELECT doc_id, len(k)::BIGINT AS n_tokens, array_to_string(k[:20], ' ') AS head FROM (SELECT doc_id, {duck_tokens('text')} AS k FROM documents)")
def _(t):
    k = t("documents").select("doc_id", T.tokenize(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.array_join(F.slice("k", 1, 20), " ").alias("head"))


@query("tx3_stem", f"SELECT stem, count(*)::BIGINT AS n, count(DISTINCT term)::BIGINT AS n_terms FROM (SELECT term, {duck_stem('term')} AS stem FROM (SELECT unnest({duck_tokens('text')}) AS term FROM documents)) GROUP BY stem")
def _(t):
    # Terms are counted before they are stemmed: the ending's pattern runs once a term, not once an occurrence.
    terms = tokens_table(t).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.groupBy(T.stem(F.col("term")).alias("stem")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_terms"))


@query("tx4_stem_sets", f"SELECT doc_id, count(DISTINCT {duck_stem('term')})::BIGINT AS n_stems FROM (SELECT doc_id, unnest({duck_tokens('text')}) AS term FROM documents) GROUP BY doc_id")
def _(t):
    return t("documents").select("doc_id", F.size(T.stems(F.col("text"))).cast("long").alias("n_stems")).filter("n_stems > 0")


@query("tx5_normalise", "SELECT conv_id, turn, translate(strip_accents(lower(text)), 'ºª', 'oa') AS plain FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", T.normalise(F.col("text")).alias("plain"))


@query("tx6_norm_key", r"SELECT p_partkey, trim(regexp_replace(strip_accents(lower(p_name || '  ' || p_type)), '\s+', ' ', 'g')) AS key FROM part")
def _(t):
    return t("part").select("p_partkey", T.norm_key(F.concat_ws("  ", "p_name", "p_type")).alias("key"))


@query("tx7_numbers_of_names", "SELECT c_custkey, translate(upper(c_name), '. ', '') AS full_number, regexp_extract(translate(upper(c_name), '. ', ''), '[A-Z]*[0-9]+[A-Z]*') AS short_number FROM customer")
def _(t):
    return t("customer").select("c_custkey", T.norm_number(F.col("c_name")).alias("full_number"), T.short_number(F.col("c_name")).alias("short_number"))


@query("tx8_slug", "SELECT slug, count(*)::BIGINT AS n FROM (SELECT trim(regexp_replace(strip_accents(lower(p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part) GROUP BY slug")
def _(t):
    return t("part").groupBy(T.slug(F.col("p_type")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tx9_clean_html",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS said FROM pages""",
)
def _(t):
    return t("pages").select("page_id", T.clean_html(F.col("html")).alias("said"))


@query("tx10_url_basename", "SELECT page_id, lower(trim(split_part(regexp_extract(url_decode(url), '^[^?#]*'), '/', -1))) AS base FROM pages")
def _(t):
    return t("pages").select("page_id", T.url_basename(F.col("url")).alias("base"))


@query(
    "tx11_absolute_links",
    """SELECT page_id, link, CASE WHEN link LIKE 'http%' THEN link WHEN link LIKE '/%' THEN 'https://site.example' || link ELSE 'https://site.example/' || link END AS absolute
    FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)""",
)
def _(t):
    links = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link")).distinct()
    site = F.lit("https://site.example")
    absolute = F.when(F.col("link").startswith("http"), F.col("link")).when(F.col("link").startswith("/"), F.concat(site, "link")).otherwise(F.concat(site, F.lit("/"), "link"))
    return links.select("page_id", "link", absolute.alias("absolute"))


@query(
    "tx12_boilerplate_of_pages",
    r"""WITH l AS (SELECT source, doc_id, n, line, lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '\s+', ' ', 'g'))) AS k
      FROM (SELECT source, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT source, doc_id, string_split(text, chr(10)) AS x FROM documents))),
    p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
    b AS (SELECT l.source, k FROM l JOIN p USING (source) WHERE k <> '' GROUP BY l.source, k, pages HAVING count(DISTINCT doc_id) >= greatest(2, round_even(0.4 * pages, 0)))
    SELECT doc_id, count(*)::BIGINT AS n_kept, sum(length(line))::BIGINT AS n_chars FROM l ANTI JOIN b USING (source, k) GROUP BY doc_id""",
)
def _(t):
    """A source stands for a file, a document for its page; lines on two fifths of the pages go."""
    docs = t("documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace("line", "[0-9]+", "#"), r"\s+", " ")))
    lines = docs.withColumn("k", key)
    pages = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    often = lines.filter("k <> ''").groupBy("source", "k").agg(F.count_distinct("doc_id").alias("n")).join(pages, "source")
    often = often.filter(F.col("n") >= F.greatest(F.lit(2), F.bround(0.4 * F.col("pages"), 0))).select("source", "k")
    return lines.join(often, ["source", "k"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum(F.length("line")).alias("n_chars"))


@query(
    "tx13_boilerplate_within",
    r"""WITH l AS (SELECT doc_id, n, line, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS k FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (c >= 2 AND length(line) <= 120 AND k <> '')::BIGINT AS n_dropped FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM l) GROUP BY doc_id""",
)
def _(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.withColumn("k", F.lower(F.trim(F.regexp_replace("line", r"\s+", " "))))
    # By document and line: counts per line first, so a document's lines are not held together.
    counted = lines.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.length("line") <= 120, 1).otherwise(0)).alias("short"))
    gone = F.when((F.col("c") >= 2) & (F.col("k") != ""), F.col("short")).otherwise(0)
    return counted.groupBy("doc_id").agg(F.sum("c").alias("n_lines"), F.sum(gone).alias("n_dropped"))


@query("tx14_clean_text", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(translate(text, chr(160) || chr(173), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("digest"))


@query(
    "tx15_shorten",
    """WITH h AS (SELECT doc_id, replace(text, chr(10), ' ') AS x, substr(replace(text, chr(10), ' '), 1, 419) AS head FROM documents),
    c AS (SELECT *, length(head) - instr(reverse(head), ' ') AS cut FROM h)
    SELECT doc_id, CASE WHEN length(x) <= 420 THEN x ELSE rtrim(CASE WHEN instr(head, ' ') > 0 AND cut > 252 THEN substr(head, 1, cut) ELSE head END, ' ,;:') || '…' END AS short FROM c""",
)
def _(t):
    return t("documents").select("doc_id", T.shorten(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("short"))


@query("tx17_thousands", "SELECT o_orderkey, replace(format('{:,}', round(o_totalprice)::BIGINT), ',', '.') AS pesos FROM orders")
def _(t):
    return t("orders").select("o_orderkey", T.thousands(F.round("o_totalprice").cast("long")).alias("pesos"))


@query("tx18_local_number", "SELECT o_orderkey, try_cast(replace(replace(trim(replace(replace(x, '.', ','), ' ', '.')), '.', ''), ',', '.') AS DOUBLE) AS amount FROM (SELECT o_orderkey, o_totalprice::VARCHAR AS x FROM orders)")
def _(t):
    """An amount written with a comma comes back; a blank would be null."""
    written = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("double").cast("string"), F.lit("."), F.lit(","))
    return t("orders").select("o_orderkey", T.local_number(written).alias("amount"))


@query("sc14_csv_export", r"""SELECT '"' || replace(CASE WHEN regexp_matches(c, '^[=+\-@\t\r]') THEN '''' || c ELSE c END, '"', '""') || '";"' || p || '"' || chr(13) AS row FROM (SELECT (c_acctbal::DECIMAL(18,2))::VARCHAR AS c, replace(c_name, '"', '""') AS p FROM customer)""")
def _(t):
    cells = [T.csv_cell(F.col("c_acctbal").cast("decimal(18,2)").cast("string")), T.csv_cell(F.col("c_name"))]
    return t("customer").select(F.concat(F.concat_ws(";", *cells), F.lit("\r")).alias("row"))


@query("vr3_numbers_in_text", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(translate(regexp_replace(text, '([0-9])\.([0-9]{3})([^0-9]|$)', '\1\2\3', 'g'), ',', '.'), '[0-9]+(?:\.[0-9]+)?'),
    lambda x: CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(regexp_replace(x, '^0+([0-9])', '\1'), '0+$', ''), '[.]$', '') ELSE regexp_replace(x, '^0+([0-9])', '\1') END))), ' ') AS numbers FROM documents""")
def _(t):
    return t("documents").select("doc_id", F.array_join(F.array_sort(T.numbers(F.col("text"))), " ").alias("numbers"))


@query("rk4_text_fingerprint", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g'), 1, 200) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def _(t):
    # min per print needs no window: a print that a third of the documents share is summed up in each task.
    return t("documents").groupBy(T.fingerprint(F.col("text")).alias("print")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
