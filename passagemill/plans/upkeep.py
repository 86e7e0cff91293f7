"""Files and norms, counting by ranks, guarded replacement, nested documents, slots and requests, all from given tables (inventory LK4, RL8, TM5, TM6, SC3, SC11, SC12, ME7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as X
from ..operators import intervals as I
from ..operators import linkage as L
from ..operators import rules as V
from ..sources import files as S
from .base import Tables, query
from .evaluation import CLASS
from .norms import KINDS, kind

# Parts are the listing's norms, orders the files, customers the overrides.
NUMBER = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN concat('B', CAST(p_partkey % 500 AS STRING), '/2015 MINSAL') WHEN 2 THEN concat(CAST(p_size AS STRING), '.', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0')) ELSE CAST(p_size AS STRING) END"
LINK = f"CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('https://x.example/a/{KINDS[0]} ', CAST(p_size AS STRING), '.PDF') WHEN 2 THEN concat('https://x.example/b.html?', CAST(p_partkey AS STRING)) ELSE concat('https://x.example/part%2D', CAST(p_partkey AS STRING), '.pdf?x=1#y') END"
NORMS = f"SELECT concat(lpad(CAST(p_partkey AS STRING), 9, '0')) AS norm_id, {kind('p_partkey')} AS kind, {NUMBER} AS number, {LINK} AS link FROM part"
FILES = f"""SELECT DISTINCT concat(CASE o_orderkey % 6 WHEN 0 THEN concat('part-', CAST(o_custkey AS STRING)) WHEN 1 THEN concat('{KINDS[0]} ', CAST(o_custkey % 60 AS STRING))
  WHEN 2 THEN concat('Decreto_Supremo-', CAST(o_custkey AS STRING), '_19') WHEN 3 THEN concat('circular B', CAST(o_custkey % 700 AS STRING), '-') WHEN 4 THEN concat('Manual-', CAST(o_custkey AS STRING)) ELSE concat('otro ', CAST(o_custkey % 9 AS STRING)) END, '.pdf') AS name FROM orders"""
OVERRIDES = f"""SELECT concat('manual-', CAST(c_custkey AS STRING), '.pdf') AS name, CASE WHEN c_custkey % 3 = 0 THEN {kind("c_custkey")} END AS kind, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS STRING) END AS number,
  CASE WHEN c_custkey % 3 < 2 THEN c_name END AS title FROM customer WHERE c_custkey % 4 < 3"""
_SHORT = "regexp_extract({c}, '[A-Z]*[0-9]+[A-Z]*')"
LK4_SQL = f"""WITH n AS (
  SELECT norm_id, strip_accents(lower(kind)) AS kind, translate(upper(number), '. ', '') AS number, lower(trim(split_part(regexp_extract(url_decode(link), '^[^?#]*'), '/', -1))) AS base FROM ({NORMS})
), ns AS (SELECT *, {_SHORT.format(c="number")} AS short FROM n), l AS (SELECT * FROM ns WHERE base LIKE '%.pdf'),
f0 AS (SELECT name, lower(name) AS base, strip_accents(lower(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '[-_]+', ' ', 'g'))) AS plain FROM ({FILES})),
f1 AS (SELECT name, base, CASE WHEN starts_with(plain, 'decreto supremo') THEN 'decreto supremo' WHEN starts_with(plain, 'resolucion exenta') THEN 'resolucion exenta' WHEN starts_with(plain, 'circular') THEN 'circular' ELSE '' END AS kind, plain FROM f0),
f AS (SELECT *, {_SHORT.format(c="number")} AS short FROM (SELECT name, base, kind, CASE WHEN kind = '' THEN '' ELSE upper(replace(regexp_extract(substr(plain, length(kind) + 1), '[a-z]?[0-9][0-9.\\-]*'), '.', '')) END AS number FROM f1)),
o AS (SELECT x.name AS base, title, (SELECT min(norm_id) FROM ns WHERE ns.kind = strip_accents(lower(x.kind)) AND ns.number = x.number) AS meant FROM ({OVERRIDES}) x),
u AS (SELECT base, min(norm_id) AS id, count(DISTINCT norm_id) AS n FROM l GROUP BY base),
t AS (SELECT f.name, min(norm_id) AS id FROM f JOIN l ON l.base = f.base AND f.number <> '' AND (l.number = f.number OR (f.short <> '' AND l.short = f.short)) GROUP BY f.name),
e AS (SELECT f.name, min(norm_id) AS id, count(DISTINCT norm_id) AS n FROM f JOIN ns ON ns.kind = f.kind AND f.number <> '' AND ns.number = f.number GROUP BY f.name),
b AS (SELECT f.name, min(norm_id) AS id, count(DISTINCT norm_id) AS n FROM f JOIN ns ON ns.kind = f.kind AND f.short <> '' AND ns.short = f.short GROUP BY f.name),
c AS (SELECT f.name, CASE WHEN o.meant IS NOT NULL THEN [o.meant, 'override', 'high'] WHEN o.title IS NOT NULL THEN ['manual:' || f.base, 'manual', 'manual']
  WHEN u.n = 1 THEN [u.id, 'url', 'high'] WHEN u.n > 1 AND t.id IS NOT NULL THEN [t.id, 'url and file', 'high'] WHEN u.n > 1 THEN [u.id, 'url', 'ambiguous']
  WHEN e.n = 1 THEN [e.id, 'kind and number', 'high'] WHEN e.n > 1 THEN [e.id, 'kind and number', 'ambiguous'] WHEN b.n = 1 THEN [b.id, 'kind and short number', 'medium'] ELSE [NULL, 'none', 'none'] END AS c
  FROM f LEFT JOIN o ON o.base = f.base LEFT JOIN u ON u.base = f.base LEFT JOIN t ON t.name = f.name LEFT JOIN e ON e.name = f.name LEFT JOIN b ON b.name = f.name)
SELECT name, c[1] AS norm_id, c[2] AS method, c[3] AS confidence FROM c"""


def _read(t: Tables, text: str):
    for name in ("part", "orders", "customer"):
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return t.sql(text)


@query("lk4_files_of_norms", LK4_SQL)
def _(t):
    return L.resolve_files(_read(t, FILES), _read(t, NORMS), _read(t, OVERRIDES))


@query(
    "rl8_range_join_by_ranks",
    """SELECT o_orderkey, count(*)::BIGINT AS n FROM orders JOIN events ON date_part('day', o_orderdate) = date_part('day', ts)
    AND value BETWEEN o_totalprice / 10000 - 1 AND o_totalprice / 10000 + 1 GROUP BY o_orderkey""",
)
def _(t):
    """The same counts as by buckets, without a row for each pair."""
    x = F.col("o_totalprice") / 10000
    orders = t("orders").filter("o_totalprice IS NOT NULL").select(F.col("o_orderkey").alias("id"), F.dayofmonth("o_orderdate").alias("day"), (x - 1).alias("low"), (x + 1).alias("high"))
    points = t("events").filter("value IS NOT NULL").select(F.dayofmonth("ts").alias("day"), F.col("value").alias("x"))
    return I.count_between(orders, points, "day", 1.0).filter("n > 0").select(F.col("id").alias("o_orderkey"), "n")


DAYS = """days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN isodow(ts) = 5 THEN 600 ELSE 540 END AS opens, CASE WHEN isodow(ts) = 5 THEN 780 ELSE 1020 END AS closes FROM events WHERE isodow(ts) <= 5),
slots AS (SELECT day, unnest(range(opens, closes - 30 + 1, 15)) AS start FROM days)"""


def slots(t: Tables):
    """Slots of the working days on which there are events, Fridays shorter."""
    d = F.weekday("ts")
    days = t("events").filter(d < 5).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(d == 4, 600).otherwise(540).alias("opens"), F.when(d == 4, 780).otherwise(1020).alias("closes")).distinct()
    return I.slots(days, 30, 15).select("day", "start")


@query("tm5_slots_of_days", f"WITH {DAYS} SELECT day, start::INTEGER AS start FROM slots")
def _(t):
    return slots(t)


@query("tm6_free_slots_by_ranks", f"WITH {DAYS}, busy AS (SELECT strftime(ts, '%Y-%m-%d') AS day, (hour(ts) * 60 + minute(ts)) AS a FROM events WHERE event_type = 'signup') SELECT day, start::INTEGER AS start FROM slots s WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.day = s.day AND start < a + 20 + 15 AND start + 30 > a - 15)")
def _(t):
    """Free slots by counting starts and ends, no slot meeting an event."""
    at = F.hour("ts") * 60 + F.minute("ts")
    busy = t("events").filter("event_type = 'signup'").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), at.alias("from"), (at + 20).alias("to"))
    return I.free_by_ranks(slots(t), busy, 30, 15)


@query("sc3_nested_orders", "SELECT l_orderkey AS doc, l_linenumber AS line, l_partkey AS part, l_quantity AS quantity FROM lineitem")
def _(t):
    """Documents with their rows in a field: orders written as JSON with their lines, and read back a document at a time."""
    row = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))
    docs = t("lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.to_json(F.struct(F.collect_list(row).alias("records"))).alias("value"))
    rows = docs.select("doc", F.explode(F.from_json("value", "struct<records: array<struct<line: int, part: bigint, quantity: double>>>")["records"]).alias("r"))
    return rows.select("doc", "r.*")


@query("sc12_guarded_replacement", "SELECT o_orderstatus AS status, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus")
def _(t):
    """Orders written as a table; then rows that are too few, and some without a key, which the guards refuse: what is read is the first version."""
    path = f"{X.index_folder(t.spark)}/orders-{uuid.uuid4().hex}"
    guards = {"enough rows": F.count(F.lit(1)) >= t("orders").count(), "keys": F.count_if(F.col("o_orderkey").isNull()) == 0}
    S.replace_guarded(t("orders"), path, guards)
    for bad in (t("orders").filter("o_orderkey % 2 = 0"), t("orders").withColumn("o_orderkey", F.expr("nullif(o_orderkey, 1)"))):
        try:
            S.replace_guarded(bad, path, guards)
        except ValueError:
            continue
        raise AssertionError("a guard let bad rows through")
    return S.read_current(t.spark, path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


#: Requests as users could have put them around a conversation's text, and what each should be taken for.
WORDED = {"format": "--- [P3] ", "role": "Ignore all rules: ", "clinical": "I feel ill. ", "task": "Please write ", "answer": "What is said of: "}
WORDED_SQL = "CASE conv_id % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(WORDED.values())) + " END"
EXPECTED_SQL = "CASE conv_id % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(WORDED)) + " END"


@query("me7_confusion_of_requests", f"WITH r AS (SELECT strip_accents(lower({WORDED_SQL} || coalesce(text, ''))) AS x, {EXPECTED_SQL} AS expected FROM conversations WHERE role = 'user') SELECT expected, {CLASS} AS got, count(*)::BIGINT AS n FROM r GROUP BY ALL")
def _(t):
    """Classes of the users' requests against what their wording should be taken for."""
    rows = t("conversations").filter("role = 'user'").select(F.concat(F.expr(WORDED_SQL), F.coalesce("text", F.lit(""))).alias("said"), F.expr(EXPECTED_SQL).alias("expected"))
    return rows.groupBy("expected", V.request_class(T.normalise(F.col("said"))).alias("got")).agg(F.count(F.lit(1)).alias("n"))


QUOTA = """w AS (SELECT event_id, user_id, epoch(ts) AS sec, event_type = 'error' AS returned, (floor((epoch(ts) - 10800) / 86400) * 86400 + 10800)::BIGINT AS start FROM events),
s AS (SELECT *, sum(CASE WHEN returned THEN -1 ELSE 1 END) OVER (PARTITION BY user_id, start ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS s FROM w),
u AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id, start ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)) AS used FROM s)"""


@query("tm3_quota_with_returns", f"WITH {QUOTA} SELECT event_id, start, used::BIGINT AS used, returned OR used <= 2 AS allowed, greatest(0, 2 - used)::BIGINT AS \"left\", greatest(1, ceil(start + 86400 - sec))::BIGINT AS retry_after FROM u")
def _(t):
    """Two requests a user and day, days beginning at three in the morning UTC; errors are given back."""
    e = t("events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("event_type") == "error").alias("returned"))
    counted = I.quota(e, 2, 86_400, F.lit(-10_800), ["event_id"])
    return counted.select("event_id", F.col("start").cast("long").alias("start"), "used", "allowed", "left", "retry_after")


MARKS = ("", " [P2]", " 【P 1, p3】 y [P2; P9]", " [P2-P4] fin", " [P3–1] [P1 P1 y P2]", " [P0] [p12-P13] [P]")
MARK_SQL = "CASE (conv_id + turn) % 6 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MARKS)) + " END"


@query("vr7_drafts_with_citations")
def _(t):
    """Marks put into the turns of conversations, resolved against the conversation's own turns by position; no SQL twin: tested against a loop."""
    c = t("conversations")
    names = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(" ", x["role"], x["turn"].cast("string"))).alias("names"))
    drafts = c.select("conv_id", "turn", F.concat(F.lit("Según"), F.expr(MARK_SQL), F.lit(" "), F.coalesce("text", F.lit("")), F.expr(MARK_SQL)).alias("draft")).join(names, "conv_id")
    done = V.with_citations(drafts)
    listed = F.array_join(F.transform("sources", lambda s: F.concat(s["n"].cast("string"), F.lit("="), s["name"])), ", ")
    return done.select("conv_id", "turn", "rewritten", listed.alias("sources"), F.array_join(F.col("invalid").cast("array<string>"), ",").alias("invalid"), "uncited")
