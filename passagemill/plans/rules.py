"""Rules over conversations and records; each conversation's last assistant turn stands for a draft (inventory VR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules as V
from .base import query

CLASS = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in V.REQUESTS) + " ELSE 'answer' END"


@query("vr1_request_classes", f"SELECT conv_id, turn, {CLASS} AS class FROM (SELECT *, translate(strip_accents(lower(text)), 'ºª', 'oa') AS x FROM conversations)")
def _(t):
    return t("conversations").select("conv_id", "turn", V.request_class(T.normalise(F.col("text"))).alias("class"))


@query("vr2_sanitise", r"""SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), '-{3,}', ' ', 'g'), '(?i)[\[【]\s*p\s*[0-9]+[^\]】]*[\]】]', ' ', 'g'), '[`{}<>]', ' ', 'g'), '\s{2,}', ' ', 'g')), 1, 300) AS asked FROM conversations""")
def _(t):
    return t("conversations").select("conv_id", "turn", V.sanitise(F.col("text")).alias("asked"))


@query("vr4_numbers_in_words")
def _(t):
    """No SQL twin: a number's words are a running state; tested against examples."""
    said = F.concat(F.lit("multa de "), F.when(F.col("o_orderkey") % 2 == 0, "ciento ochenta y dos mil").otherwise("cuarenta a cuatrocientas unidades"), F.lit(" y tres"))
    return t("orders").select("o_orderkey", F.array_join(V.words_to_numbers(said).cast("array<string>"), ",").alias("numbers"))


DRAFTS = "d AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS draft, string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'assistant') AS said FROM conversations GROUP BY conv_id)"


def drafts(t):
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "assistant", F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    return t("conversations").groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("draft"), own.alias("said"))


@query("vr5_unverified_words", f"WITH {DRAFTS} SELECT conv_id, len(list_filter(list_distinct(regexp_extract_all(lower(draft), '[a-z]{{6,}}')), lambda w: NOT list_contains(regexp_extract_all(lower(coalesce(said, '')), '[a-z]{{6,}}'), w)))::BIGINT AS n FROM d WHERE draft IS NOT NULL")
def _(t):
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{6,}"), F.lit(0))
    rows = drafts(t).filter("draft IS NOT NULL")
    return rows.select("conv_id", F.size(F.array_except(words(F.col("draft")), words(F.col("said")))).cast("long").alias("n"))


@query("vr6_uncovered_without_caveat", f"WITH {DRAFTS} SELECT conv_id, NOT regexp_matches(lower(draft), 'however|but|no ') AND len(draft) > 200 AS bare FROM d WHERE draft IS NOT NULL")
def _(t):
    rows = drafts(t).filter("draft IS NOT NULL")
    caveat = F.exists(F.split(F.lower("draft"), r"(?<=[.!?])\s"), lambda s: s.rlike("however|but|no "))
    return rows.select("conv_id", (~caveat & (F.length("draft") > 200)).alias("bare"))


@query("vr7_citations", "SELECT conv_id, turn, 3::BIGINT AS n_cited, CASE WHEN conv_id % 2 = 0 THEN '9' ELSE '' END AS invalid FROM conversations")
def _(t):
    """Marks are put into the texts: a list, a range, and for even conversations one that does not exist."""
    draft = F.concat("text", F.lit(" [P2, P3] [P2-P4]"), F.when(F.col("conv_id") % 2 == 0, " [P9]").otherwise(""))
    good, bad = V.resolve_citations(draft, F.lit(5))
    return t("conversations").select("conv_id", "turn", F.size(good).cast("long").alias("n_cited"), F.array_join(bad.cast("array<string>"), ",").alias("invalid"))


@query("vr8_abstentions", "SELECT conv_id, turn, conv_id % 3 = 0 AS abstains FROM conversations")
def _(t):
    draft = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("**The passages do not  answer this.** "), "text")).otherwise(F.concat("text", F.lit(" The passages do not answer this.")))
    return t("conversations").select("conv_id", "turn", V.abstains(draft).alias("abstains"))


@query("vr9_cache_keys", "SELECT sha256('v1' || chr(0) || lang || chr(0) || text) AS key, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def _(t):
    key = V.cache_key(F.lit("v1"), F.col("lang"), F.col("text"))
    return t("documents").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("vr10_prompts", "SELECT conv_id, sha256(string_agg('[P' || n || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def _(t):
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t("conversations").groupBy("conv_id").agg(said.alias("p")).select("conv_id", F.sha2(V.prompt(F.col("p")), 256).alias("prompt"))


@query("vr11_record_problems", "SELECT page_id, concat_ws(',', CASE WHEN url NOT LIKE 'https://%' THEN 'not https' END, CASE WHEN length(html) < 2000 THEN 'short' END, CASE WHEN count(*) OVER (PARTITION BY url) > 1 THEN 'repeated' END) AS problems FROM pages")
def _(t):
    # Repeats by a count per url and a join back, so a very common url is counted in parts.
    many = t("pages").groupBy("url").agg((F.count(F.lit(1)) > 1).alias("many"))
    checks = {"not https": ~F.col("url").startswith("https://"), "short": F.length("html") < 2000, "repeated": F.col("many")}
    return t("pages").join(many, "url", "left").select("page_id", F.array_join(V.problems(checks), ",").alias("problems"))


@query("vr12_valid_records", "SELECT page_id FROM pages WHERE url LIKE 'https://%' AND length(html) >= 2000")
def _(t):
    good, _ = V.split_valid(t("pages"), {"not https": ~F.col("url").startswith("https://"), "short": F.length("html") < 2000})
    return good.select("page_id")


@query("vr13_safe_html", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS safe FROM pages")
def _(t):
    return t("pages").select("page_id", F.sha2(V.escape_html(F.col("html")), 256).alias("safe"))


@query("vr14_config_ranges", "SELECT p_partkey, p_size BETWEEN 5 AND 45 AND p_retailprice > 0 AS valid FROM part")
def _(t):
    return t("part").select("p_partkey", (F.col("p_size").between(5, 45) & (F.col("p_retailprice") > 0)).alias("valid"))
