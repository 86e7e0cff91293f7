"""Change detection: two states of the orders and documents stand for snapshots (inventory CD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from .base import both, query

#: Before: orders up to a day, some prices different, a repeated key.  After: orders from a day on.
OLD = "SELECT o_custkey AS cat, o_orderstatus AS kind, o_orderpriority AS title, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderkey AS seq FROM {orders} WHERE o_orderdate < TIMESTAMP '2000-06-01'"
NEW = "SELECT o_custkey AS cat, o_orderstatus AS kind, o_orderpriority AS title, o_totalprice AS price, o_orderkey AS seq FROM {orders} WHERE o_orderdate >= TIMESTAMP '1995-06-01'"
DUCK_OLD, DUCK_NEW = OLD.replace("{orders}", "orders"), NEW.replace("{orders}", "orders")


@query(
    "cd1_two_pass_diff",
    f"""WITH old AS ({DUCK_OLD}), new AS ({DUCK_NEW}),
    o AS (SELECT *, row_number() OVER (PARTITION BY cat, kind, title ORDER BY seq) AS n FROM old), w AS (SELECT *, row_number() OVER (PARTITION BY cat, kind, title ORDER BY seq) AS n FROM new),
    p AS (SELECT o.cat AS oc, o.kind AS ok, o.title AS ot, o.price AS op, o.seq AS os, w.cat AS wc, w.kind AS wk, w.title AS wt, w.price AS wp, w.seq AS ws FROM o FULL JOIN w ON o.cat = w.cat AND o.kind = w.kind AND o.title = w.title AND o.n = w.n),
    g AS (SELECT oc, ok, ot, op, row_number() OVER (PARTITION BY oc, ok ORDER BY os) AS n FROM p WHERE wc IS NULL), c AS (SELECT wc, wk, wt, wp, row_number() OVER (PARTITION BY wc, wk ORDER BY ws) AS n FROM p WHERE oc IS NULL),
    m AS (SELECT oc, ok, ot, op, wc, wk, wt, wp FROM p WHERE oc IS NOT NULL AND wc IS NOT NULL UNION ALL SELECT oc, ok, ot, op, wc, wk, wt, wp FROM g FULL JOIN c ON oc = wc AND ok = wk AND g.n = c.n)
    SELECT coalesce(wc, oc) AS cat, coalesce(wk, ok) AS kind, CASE WHEN oc IS NULL THEN 'new' WHEN wc IS NULL THEN 'removed' WHEN ot <> wt OR op <> wp THEN 'changed' ELSE 'same' END AS state,
    CASE WHEN oc IS NOT NULL AND wc IS NOT NULL THEN concat_ws(',', CASE WHEN ot <> wt THEN 'title' END, CASE WHEN op <> wp THEN 'price' END) ELSE '' END AS changed FROM m""",
)
def _(t):
    return C.multiset_diff(t.sql(OLD), t.sql(NEW), ["cat", "kind", "title"], ["cat", "kind"], ["title", "price"], "seq")


@query("cd2_field_diff", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> (CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END) THEN 'status' END, CASE WHEN o_orderkey % 5 = 0 THEN 'price' END) AS changed FROM orders")
def _(t):
    old = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = F.struct(F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"))
    rows = t("orders").select("o_orderkey", old.alias("_old"), new.alias("_new"))
    return rows.select("o_orderkey", F.array_join(C.field_changes(["status", "price"]), ",").alias("changed"))


@query(
    "cd3_keyed_diff",
    f"""WITH o AS (SELECT DISTINCT ON (cat) cat, kind, title FROM ({DUCK_OLD}) ORDER BY cat, seq DESC), w AS (SELECT DISTINCT ON (cat) cat, kind, title FROM ({DUCK_NEW}) ORDER BY cat, seq DESC)
    SELECT coalesce(o.cat, w.cat) AS cat, CASE WHEN o.cat IS NULL THEN 'new' WHEN w.cat IS NULL THEN 'removed' WHEN o.kind <> w.kind OR o.title <> w.title THEN 'changed' ELSE 'same' END AS state,
    CASE WHEN o.cat IS NOT NULL AND w.cat IS NOT NULL THEN concat_ws(';', CASE WHEN o.kind <> w.kind THEN 'kind:' || o.kind || '>' || w.kind END, CASE WHEN o.title <> w.title THEN 'title:' || o.title || '>' || w.title END) ELSE '' END AS told FROM o FULL JOIN w ON o.cat = w.cat""",
)
def _(t):
    return C.keyed_diff(t.sql(OLD), t.sql(NEW), "cat", ["kind", "title"], "seq")


@query("cd4_content_hash", """WITH h AS (SELECT sha256('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') AS h FROM region), g AS (SELECT substr(h, 1, 2) AS g, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY g)) AS hash FROM g""")
def _(t):
    return C.content_hash(t("region"), ["r_regionkey", "r_name"])


both(
    "cd5_versioned_diff",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' WHEN a.s <> 'F' AND b.s = 'F' THEN 'repealed' WHEN a.s = 'F' AND b.s <> 'F' THEN 'revived' WHEN a.v <> b.v THEN 'modified' ELSE 'same' END AS state
    FROM (SELECT o_custkey AS k, max(o_orderstatus) AS s, count(*) AS v FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey) a FULL OUTER JOIN (SELECT o_custkey AS k, max(o_orderstatus) AS s, count(*) AS v FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey) b ON a.k = b.k""",
)


@query("cd6_fingerprints", "SELECT lang, count(DISTINCT substr(sha1(text), 1, 16))::BIGINT AS prints, min(substr(sha1(text), 1, 16)) AS first FROM documents GROUP BY lang")
def _(t):
    print_ = F.substring(F.sha1("text"), 1, 16)
    return t("documents").groupBy("lang").agg(F.count_distinct(print_).alias("prints"), F.min(print_).alias("first"))


both("cd7_baseline_rule", "SELECT user_id, CASE WHEN min(ts) >= TIMESTAMP '2024-01-02' THEN 0 ELSE count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-02') END AS reported FROM {events} GROUP BY user_id")
both("cd8_history_ring", "SELECT event_id FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 500")


@query(
    "cd9_reconciliation",
    """SELECT base, count(*)::BIGINT AS n, bool_or(url LIKE 'https%') AS recoverable FROM (SELECT url, lower(trim(split_part(regexp_extract(url_decode(url), '^[^?#]*'), '/', -1))) AS base FROM pages)
    WHERE base <> '' AND base NOT IN (SELECT o_orderkey::VARCHAR FROM orders) GROUP BY base""",
)
def _(t):
    """Listed files that are not on the disk, for which order numbers stand, once each."""
    from ..functions.text import url_basename

    listed = t("pages").select("url", url_basename(F.col("url")).alias("base")).filter("base <> ''")
    disk = t("orders").select(F.col("o_orderkey").cast("string").alias("base"))
    return listed.join(disk, "base", "left_anti").groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("url").startswith("https")).alias("recoverable"))


@query("cd10_pending_since", "SELECT c_custkey, strftime(coalesce(d, TIMESTAMP '2024-01-31'), '%Y-%m-%d') AS since FROM customer LEFT JOIN (SELECT user_id, min(ts) AS d FROM events WHERE event_type = 'error' GROUP BY 1) e ON user_id = c_custkey")
def _(t):
    first = t("events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.min("ts").alias("d"))
    since = F.coalesce("d", F.lit("2024-01-31").cast("timestamp_ntz"))
    return t("customer").select("c_custkey").join(first, "c_custkey", "left").select("c_custkey", F.date_format(since, "yyyy-MM-dd").alias("since"))


@query("cd11_freshness", "WITH a AS (SELECT user_id, floor(date_diff('second', max(ts), TIMESTAMP '2024-01-31') / 86400) AS age FROM events GROUP BY 1) SELECT user_id, CASE WHEN age IS NULL OR age > 7 THEN 'expired' WHEN age <= 3 THEN 'fresh' ELSE 'ageing' END AS state FROM a")
def _(t):
    now = F.unix_timestamp(F.lit("2024-01-31").cast("timestamp"))
    age = F.floor((now - F.unix_timestamp(F.max(F.col("ts").cast("timestamp")))) / 86400)
    return t("events").groupBy("user_id").agg(C.freshness(age).alias("state"))


both("cd12_health_alerts", "SELECT event_type, CASE WHEN n > 2500 THEN 'high' WHEN n > 2000 THEN 'medium' ELSE 'low' END AS level FROM (SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type) e")
both("cd13_publication_gate", "SELECT n >= 1000 AND bad = 0 AS publish FROM (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice <= 0) AS bad FROM {orders}) m")
