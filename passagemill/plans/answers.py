"""Question analysis, evidence, sentences and decisions (inventory QA, EV, SE, RK5-7, AN)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import index as X
from . import retrieval as R
from .base import Tables, query
from .text import duck_stem, duck_tokens

#: A small vocabulary of our own: what a stem may also be said as, in one word or several.
ALTERNATIVES = (("tion", ("ing",)), ("hand", ("thand",)), ("ered", ("ering",)), ("haus", ("heim",)), ("casa", ("hogar",)), ("eron", ("that", "with")), ("esin", ("onth", "zzqq")), ("thin", ("then", "than", "this")))
#: Rules of what is out of scope: pattern, exception, matter, in order.
SCOPE_RULES = (("gar[a-z]+", "garant", "vehicles"), ("that", "of the", "hearsay"), ("zu[a-z]*", "zu und", "customs"))

ALT_ROWS = [(stem, k, other, len(phrase)) for k, (stem, phrase) in enumerate(ALTERNATIVES) for other in phrase]
ALT_SCHEMA = "stem string, phrase int, other string, size int"
ALT_VALUES = ", ".join(f"('{stem}', {k}, '{other}', {size})" for stem, k, other, size in ALT_ROWS)
BASE = (
    R.BASE
    + f""", concepts AS (SELECT qid, w.stem, coalesce(idf, ln(1 + (n + 0.5) / 0.5)) AS weight, idf IS NULL AS unseen
  FROM (SELECT DISTINCT qid, {duck_stem('term')} AS stem FROM q) w LEFT JOIN stems USING (stem), corpus),
alts(stem, phrase, other, size) AS (VALUES {ALT_VALUES}),
tries AS (SELECT qid, stem AS concept, weight, stem, -1 AS phrase, 1 AS size FROM concepts UNION ALL SELECT qid, c.stem, weight, other, phrase, size FROM concepts c JOIN alts USING (stem)),
credits AS (SELECT qid, doc, concept, weight, max(CASE WHEN phrase < 0 OR size > 1 THEN 1.0 ELSE 0.7 END) AS credit
  FROM (SELECT qid, doc, concept, weight, phrase, size FROM tries JOIN stemmed USING (stem) GROUP BY ALL HAVING count(*) = size) GROUP BY qid, doc, concept, weight),
total AS (SELECT qid, sum(weight) AS total FROM concepts GROUP BY qid),
coverage AS (SELECT qid, doc, sum(weight * credit) / any_value(total) AS coverage FROM credits JOIN total USING (qid) GROUP BY qid, doc),
core AS (SELECT qid, stem, weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(weight, 6) DESC, stem) AS n, max(weight) OVER (PARTITION BY qid) AS most FROM concepts) WHERE n <= 2 OR weight >= 0.9 * most),
core_hit AS (SELECT qid, doc, count(*) AS hit FROM credits c JOIN core k ON k.qid = c.qid AND k.stem = c.concept GROUP BY qid, doc),
core_size AS (SELECT qid, count(*) AS size FROM core GROUP BY qid)
""".replace("GROUP BY qid, doc),\ncore_size", "GROUP BY c.qid, doc),\ncore_size").replace("SELECT qid, doc, count(*) AS hit", "SELECT c.qid, doc, count(*) AS hit")
)

SENTENCES = r"""sentences AS (SELECT doc, n, unit FROM (SELECT doc_id AS doc, unnest(x) AS unit, generate_subscripts(x, 1) - 1 AS n
  FROM (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.;:]) ([A-ZÁÉÍÓÚÑÄÖÜÇÈÊ¿0-9(])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS x FROM documents)) WHERE unit <> '')"""


class _Evidence:
    """The tables that the queries below share, each built lazily from the same plan."""

    def __init__(self, t: Tables):
        self.t, self.index = t, R.index(t)
        asked = A.stem_of_terms(R.questions(t)).select("qid", "stem").distinct()
        known = self.index.stems.join(X.sent(asked.select("stem").distinct()), "stem", "left_semi")
        concepts = asked.join(known, "stem", "left").select("qid", "stem", F.coalesce("idf", F.lit(self.index.idf_unseen)).alias("weight"), F.col("idf").isNull().alias("unseen"))
        # Kept: all evidence starts from them.  Dealt out once more, so that they lie in as few parts as their size asks for.
        self.concepts = t.keep(concepts.repartition("qid"))
        self.stems = self.index.doc_stems.select("doc", "stem")
        self.alternatives = t.spark.createDataFrame(ALT_ROWS, ALT_SCHEMA)
        self.core = A.core(self.concepts)

    @cached_property
    def credit_sums(self) -> DataFrame:
        """Credits in all documents, summed by question and document."""
        return A.credit_sums(self.index, self.concepts, self.alternatives)

    @cached_property
    def near_credits(self) -> DataFrame:
        """Credits in each question's candidates: a document's stems meet only the questions that it is a candidate of; kept."""
        pairs = self.candidates.select("qid", "doc")
        own = self.index.rows.select("doc", "stems").join(X.sent(pairs), "doc").selectExpr("qid", "doc", "inline(stems) AS (stem, tf)").select("qid", "doc", "stem")
        return self.t.keep(A.credits(self.concepts, self.alternatives, own))

    @cached_property
    def coverage(self) -> DataFrame:
        return A.covered(self.credit_sums, self.concepts)

    @cached_property
    def near_coverage(self) -> DataFrame:
        return A.coverage(self.near_credits, self.concepts)

    @cached_property
    def core_credits(self) -> DataFrame:
        """Credits of core concepts in all documents; other concepts' stems are not looked for."""
        return A.credits(self.core, self.alternatives, self.holding(self.core))

    def holding(self, concepts: DataFrame) -> DataFrame:
        return X.holding(self.index, A.asked_stems(concepts, self.alternatives))

    def core_hit(self, credits: DataFrame) -> DataFrame:
        """How many core concepts each document has, of how many."""
        size = F.broadcast(self.core.groupBy("qid").agg(F.count(F.lit(1)).alias("size")))
        hit = credits.join(self.core.select("qid", F.col("stem").alias("concept")), ["qid", "concept"], "left_semi")
        return hit.groupBy("qid", "doc").agg(F.count(F.lit(1)).alias("hit")).join(size, "qid")

    def ranked(self, k: int) -> DataFrame:
        return X.ranked(self.index, R.questions(self.t), k)

    def stems_of(self, terms: DataFrame) -> DataFrame:
        """The rows with the stem for each term that some question asks for, once each; the index has the stems."""
        asked = self.index.terms.select("term", "stem").join(X.sent(self.concepts.select("stem").distinct()), "stem", "left_semi")
        return terms.join(X.sent(asked), "term").drop("term").distinct()

    @cached_property
    def candidates(self) -> DataFrame:
        """The candidates of every question, some hundreds each at most, kept as they are asked for several times, in as few parts as their size asks for."""
        return self.t.keep(R.candidates(self.t, self.index).repartition("qid"))

    @cached_property
    def finals(self) -> DataFrame:
        """The final score of each candidate, kept likewise."""
        return self.t.keep(finals(self))


@query(
    "qa1_scope_rules",
    "WITH r(n, p, e, matter) AS (VALUES "
    + ", ".join(f"({i}, '{p}', '{e}', '{m}')" for i, (p, e, m) in enumerate(SCOPE_RULES))
    + ") SELECT item_id, arg_min(matter, n) AS matter FROM benchmark, r WHERE regexp_matches(strip_accents(lower(text)), p) AND NOT regexp_matches(strip_accents(lower(text)), e) GROUP BY item_id",
)
def _(t):
    """The first rule that fits; the rules are a short list in the code, so they are one expression and no join."""
    plain, matter = T.normalise(F.col("text")), F.lit(None).cast("string")
    for pattern, unless, name in reversed(SCOPE_RULES):
        matter = F.when(plain.rlike(pattern) & ~plain.rlike(unless), name).otherwise(matter)
    return t("benchmark").select("item_id", matter.alias("matter")).filter("matter IS NOT NULL")


def _duck_type(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in A.TYPES.items()) + " ELSE 'general' END"


@query("qa2_question_types", f"SELECT conv_id, turn, {_duck_type('strip_accents(lower(text))')} AS type FROM conversations WHERE role = 'user'")
def _(t):
    return t("conversations").filter("role = 'user'").select("conv_id", "turn", A.question_type(T.normalise(F.col("text"))).alias("type"))


@query("qa3_concepts", BASE + "SELECT qid, stem, round(weight, 6) AS weight FROM concepts")
def _(t):
    return _Evidence(t).concepts.select("qid", "stem", F.round("weight", 6).alias("weight"))


@query("qa4_expansions", BASE + "SELECT qid, concept, stem, CASE WHEN size > 1 THEN 1.0 ELSE 0.7 END::DOUBLE AS credit, size::BIGINT AS size FROM tries WHERE phrase >= 0")
def _(t):
    """What else a concept may be said as: a phrase of several words counts whole, one word for 0.7."""
    e = _Evidence(t)
    alternatives = t.spark.createDataFrame(ALT_ROWS, ALT_SCHEMA)
    credit = F.when(F.col("size") > 1, 1.0).otherwise(A.CREDIT_ALTERNATIVE)
    return e.concepts.join(F.broadcast(alternatives), "stem").select("qid", F.col("stem").alias("concept"), F.col("other").alias("stem"), credit.alias("credit"), F.col("size").cast("long").alias("size"))


@query("qa5_infinitives_dropped", BASE + "SELECT DISTINCT qid, term FROM q WHERE NOT regexp_full_match(term, '[a-z]{3,}(ar|er|ir)') OR term IN (SELECT term FROM terms WHERE df >= 3)")
def _(t):
    """A word that looks like an infinitive stays only if three documents have it."""
    asked = R.questions(t).select("qid", "term").distinct()
    known = R.index(t).terms.filter("df >= 3").select("term", F.lit(True).alias("known"))
    return asked.join(known, "term", "left").filter(~F.col("term").rlike("^[a-z]{3,}(ar|er|ir)$") | F.col("known")).select("qid", "term")


@query("qa6_defined_term", BASE + "SELECT qid, stem AS defined, round(weight, 6) AS weight FROM concepts QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(weight, 6) DESC, stem) = 1")
def _(t):
    from pyspark.sql import Window

    by = Window.partitionBy("qid").orderBy(F.round("weight", 6).desc(), "stem")
    first = _Evidence(t).concepts.withColumn("n", F.row_number().over(by)).filter("n = 1")
    return first.select("qid", F.col("stem").alias("defined"), F.round("weight", 6).alias("weight"))


@query("qa7_flags", r"SELECT item_id, regexp_matches(strip_accents(lower(text)), '(^|[^a-z0-9])(ley|legal|law|loi|gesetz)([^a-z0-9]|$)') AS asks_law, len(list_distinct(regexp_extract_all(text, '[0-9]+')))::BIGINT AS n_numbers FROM benchmark")
def _(t):
    law = T.normalise(F.col("text")).rlike("(^|[^a-z0-9])(ley|legal|law|loi|gesetz)([^a-z0-9]|$)")
    numbers = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).cast("long")
    return t("benchmark").select("item_id", law.alias("asks_law"), numbers.alias("n_numbers"))


@query("ev1_credits", BASE + "SELECT qid, doc, count(*)::BIGINT AS n, round(sum(credit), 6)::DOUBLE AS credit FROM credits GROUP BY qid, doc")
def _(t):
    return _Evidence(t).credit_sums.select("qid", "doc", "n", F.round("credit", 6).alias("credit"))


@query("ev2_coverage", BASE + "SELECT qid, doc, round(coverage, 6) AS coverage FROM coverage")
def _(t):
    return _Evidence(t).coverage.select("qid", "doc", F.round("coverage", 6).alias("coverage"))


@query("ev3_core_concepts", BASE + "SELECT qid, stem, round(weight, 6) AS weight FROM core")
def _(t):
    return _Evidence(t).core.select("qid", "stem", F.round("weight", 6).alias("weight"))


@query("ev4_core_covered", BASE + "SELECT qid, doc, hit = size AS whole FROM core_hit JOIN core_size USING (qid)")
def _(t):
    return (e := _Evidence(t)).core_hit(e.core_credits).select("qid", "doc", (F.col("hit") == F.col("size")).alias("whole"))


CONFIDENCE = f""", eight AS (SELECT qid, doc, score, rank FROM ranked WHERE rank <= 8),
best AS (SELECT qid, max(coverage) AS top_cov, max(score) FILTER (rank = 1) AS s0, list(round(score, 9)) FILTER (rank > 1) AS rest
  FROM (SELECT e.qid, e.doc, score, rank, coalesce(coverage, 0) AS coverage FROM eight e LEFT JOIN (
    SELECT qid, doc, sum(weight) / any_value(total) AS coverage FROM concepts c JOIN stemmed s USING (stem) JOIN total USING (qid) GROUP BY qid, doc) v USING (qid, doc)) GROUP BY qid),
pooled AS (SELECT qid, sum(weight) / any_value(total) AS pooled FROM (SELECT DISTINCT c.qid, c.stem, weight FROM concepts c JOIN stemmed s USING (stem) JOIN eight e ON e.qid = c.qid AND e.doc = s.doc) JOIN total USING (qid) GROUP BY qid),
weights AS (SELECT qid, coalesce(sum(weight) FILTER (unseen), 0) / sum(weight) AS unseen FROM concepts GROUP BY qid)
SELECT qid, round(top_cov, 3) AS top_coverage, round(coalesce(pooled, 0), 3) AS pooled_coverage,
  round(CASE WHEN len(rest) >= 2 THEN (s0 - list_sort(rest)[len(rest) // 2 + 1]) / s0 ELSE 0 END, 3) AS margin,
  CASE WHEN round(unseen, 6) >= {A.UNSEEN_MOST} THEN 'low'
    WHEN round(top_cov, 6) >= {A.TOP_HIGH} AND round(pooled, 6) >= {A.POOLED_HIGH} THEN 'high'
    WHEN round(top_cov, 6) >= {A.TOP_LEAST} AND round(pooled, 6) >= {A.POOLED_LEAST} THEN 'medium' ELSE 'low' END AS confidence
FROM best JOIN weights USING (qid) LEFT JOIN pooled USING (qid)"""


@query("ev5_confidence", BASE + CONFIDENCE)
def _(t):
    """Coverage of the best of eight passages and of all together, the margin of the first over the upper median of the rest, and the weight of unseen words."""
    e = _Evidence(t)
    eight = t.keep(e.ranked(8).select("qid", "doc", "score", "rank"))
    total = e.concepts.groupBy("qid").agg(F.sum("weight").alias("total"))
    said = eight.join(e.stems, "doc").join(e.concepts, ["qid", "stem"]).select("qid", "doc", "stem", "weight")
    each = said.groupBy("qid", "doc").agg(F.sum("weight").alias("got")).join(total, "qid").select("qid", "doc", (F.col("got") / F.col("total")).alias("coverage"))
    pooled = said.select("qid", "stem", "weight").distinct().groupBy("qid").agg(F.sum("weight").alias("got")).join(total, "qid").select("qid", (F.col("got") / F.col("total")).alias("pooled"))
    rest = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.round("score", 9))))
    best = eight.join(each, ["qid", "doc"], "left").groupBy("qid").agg(F.max(F.coalesce("coverage", F.lit(0.0))).alias("top"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s0"), rest.alias("rest"))
    unseen = e.concepts.groupBy("qid").agg((F.sum(F.when(F.col("unseen"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("unseen"))
    margin = F.when(F.size("rest") >= 2, (F.col("s0") - F.get("rest", F.floor(F.size("rest") / 2).cast("int"))) / F.col("s0")).otherwise(0.0)
    top, all_ = F.round("top", 6), F.round("pooled", 6)
    word = (
        F.when(F.round("unseen", 6) >= A.UNSEEN_MOST, "low")
        .when((top >= A.TOP_HIGH) & (all_ >= A.POOLED_HIGH), "high")
        .when((top >= A.TOP_LEAST) & (all_ >= A.POOLED_LEAST), "medium")
        .otherwise("low")
    )
    rows = best.join(unseen, "qid").join(pooled, "qid", "left")
    return rows.select("qid", F.round("top", 3).alias("top_coverage"), F.round(F.coalesce("pooled", F.lit(0.0)), 3).alias("pooled_coverage"), F.round(margin, 3).alias("margin"), word.alias("confidence"))


@query("ev6_evidence_window", BASE + "SELECT qid, round(avg(coalesce(coverage, 0)), 6) AS mean_coverage FROM ranked LEFT JOIN coverage USING (qid, doc) WHERE rank <= 8 GROUP BY qid")
def _(t):
    e = _Evidence(t)
    return e.ranked(8).join(e.near_coverage, ["qid", "doc"], "left").groupBy("qid").agg(F.round(F.avg(F.coalesce("coverage", F.lit(0.0))), 6).alias("mean_coverage"))


@query("se1_sentences", f"WITH {SENTENCES} SELECT doc, count(*)::BIGINT AS n_units, max(length(unit))::BIGINT AS longest FROM sentences GROUP BY doc")
def _(t):
    return A.sentences(t("documents")).groupBy("doc").agg(F.count(F.lit(1)).alias("n_units"), F.max(F.length("unit")).cast("long").alias("longest"))


BEST = f""", {SENTENCES}, near AS (SELECT qid, r.doc, rank, n, unit, {duck_tokens('unit')} AS tokens FROM candidates r JOIN sentences s USING (doc)),
said AS (SELECT qid, doc, n, sum(weight) AS got FROM (SELECT DISTINCT qid, doc, n, {duck_stem('term')} AS stem FROM (SELECT qid, doc, n, unnest(tokens) AS term FROM near)) JOIN concepts USING (qid, stem) GROUP BY qid, doc, n),
unit_scores AS (SELECT qid, doc, rank, n, unit, coalesce(got, 0) / total AS cov, regexp_matches(unit, '[0-9]') AS datum FROM near LEFT JOIN said USING (qid, doc, n) JOIN total USING (qid)),
phrases AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY round(cov + CASE WHEN datum THEN 0.3 ELSE 0 END, 6) DESC, n) AS k FROM unit_scores) WHERE k = 1)
"""


def phrases(e: _Evidence) -> DataFrame:
    """The best unit of each of a question's candidates; a text is cut into units once, however many questions it is a candidate of."""
    near = e.candidates.select("qid", "doc", "rank")
    units = A.sentences(e.t("documents").join(X.sent(near.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi"))
    stems = e.stems_of(units.select("doc", "n", F.explode(F.array_distinct(T.tokenize(F.col("unit")))).alias("term")))
    said = stems.join(near.select("qid", "doc"), "doc").join(e.concepts, ["qid", "stem"]).groupBy("qid", "doc", "n").agg(F.sum("weight").alias("got"))
    total = e.concepts.groupBy("qid").agg(F.sum("weight").alias("total"))
    scored = near.join(units, "doc").join(said, ["qid", "doc", "n"], "left").join(total, "qid")
    scored = scored.withColumn("cov", F.coalesce("got", F.lit(0.0)) / F.col("total")).withColumn("datum", F.col("unit").rlike("[0-9]"))
    order = F.struct(F.round(F.col("cov") + F.when(F.col("datum"), 0.3).otherwise(0.0), 6), -F.col("n"))
    return scored.groupBy("qid", "doc", "rank").agg(F.max_by(F.struct("n", "unit", "cov", "datum"), order).alias("b")).select("qid", "doc", "rank", "b.*")


@query("se2_best_sentence", BASE + BEST + "SELECT qid, doc, n::BIGINT AS n, round(cov, 6) AS cov, datum, unit FROM phrases")
def _(t):
    return phrases(_Evidence(t)).select("qid", "doc", F.col("n").cast("long").alias("n"), F.round("cov", 6).alias("cov"), "datum", "unit")


@query("se3_typed_cues", f"WITH {SENTENCES} SELECT doc, count(*) FILTER (regexp_matches(unit, '[0-9]+ ?(%|GB|km|kg)'))::BIGINT AS amounts, count(*) FILTER (regexp_matches(unit, '(20|19)[0-9][0-9]-[0-9]+'))::BIGINT AS dates, count(*) FILTER (regexp_matches(unit, '^[^:]{{3,60}}: '))::BIGINT AS definitions FROM sentences GROUP BY doc")
def _(t):
    u = F.col("unit")
    return A.sentences(t("documents")).groupBy("doc").agg(
        F.count_if(u.rlike("[0-9]+ ?(%|GB|km|kg)")).alias("amounts"), F.count_if(u.rlike("(20|19)[0-9][0-9]-[0-9]+")).alias("dates"), F.count_if(u.rlike("^[^:]{3,60}: ")).alias("definitions")
    )


@query("se4_definitions", f"WITH {SENTENCES} SELECT doc, n::BIGINT AS n, regexp_extract(unit, '^([^:.;]{{3,60}}): ', 1) AS term FROM sentences WHERE regexp_matches(unit, '^[^:.;]{{3,60}}: ')")
def _(t):
    found = A.sentences(t("documents")).filter(F.col("unit").rlike("^[^:.;]{3,60}: "))
    return found.select("doc", F.col("n").cast("long").alias("n"), F.regexp_extract("unit", "^([^:.;]{3,60}): ", 1).alias("term"))


@query("se5_form_search", R.BASE + "SELECT DISTINCT qid, doc_id AS doc FROM (SELECT qid, min(term) AS term FROM q WHERE length(term) >= 4 GROUP BY qid) x JOIN docs ON tokens[1] = term JOIN documents ON doc_id = doc WHERE regexp_matches(strip_accents(lower(text)), '^[^a-z0-9]*' || term || '[a-z0-9]{0,3}[^.;:]{0,40}[.:,]')")
def _(t):
    """Passages that begin with the term and soon a stop, whatever their score; a pattern per question, behind an equal first word."""
    term = R.questions(t).filter("length(term) >= 4").groupBy("qid").agg(F.min("term").alias("term"))
    docs = t("documents").select(F.col("doc_id").alias("doc"), F.get(T.tokenize(F.col("text")), F.lit(0)).alias("term"), T.strip_accents(F.col("text")).alias("plain"))
    pattern = F.concat(F.lit("^[^a-z0-9]*"), "term", F.lit("[a-z0-9]{0,3}[^.;:]{0,40}[.:,]"))
    return docs.join(term, "term").filter(F.regexp_like("plain", pattern)).select("qid", "doc")


@query("se6_highlights", BASE + BEST + r""", w AS (SELECT qid, doc, k, word, (sum(length(word) + 1) OVER (PARTITION BY qid, doc ORDER BY k) - length(word) - 1)::BIGINT AS start
  FROM (SELECT qid, doc, unnest(x) AS word, generate_subscripts(x, 1) AS k FROM (SELECT qid, doc, string_split(unit, ' ') AS x FROM phrases))),
h AS (SELECT w.qid, w.doc, w.start, w.start + length(word) AS fin FROM w JOIN q ON q.qid = w.qid AND q.term = regexp_replace(strip_accents(lower(word)), '[^a-z0-9]', '', 'g')),
g AS (SELECT *, CASE WHEN start <= max(fin) OVER (PARTITION BY qid, doc ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM h),
i AS (SELECT *, sum(new) OVER (PARTITION BY qid, doc ORDER BY start, fin ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT qid, doc, min(start)::BIGINT AS start, max(fin)::BIGINT AS "end" FROM i GROUP BY qid, doc, island""")
def _(t):
    from pyspark.sql import Window

    e = _Evidence(t)
    words = phrases(e).select("qid", "doc", F.posexplode(F.split("unit", " ")).alias("k", "word"))
    length = F.length("word") + 1
    start = (F.sum(length).over(Window.partitionBy("qid", "doc").orderBy("k")) - length).alias("start")
    words = words.select("qid", "doc", "word", start).withColumn("end", F.col("start") + F.length("word"))
    words = words.withColumn("term", F.regexp_replace(T.strip_accents(F.col("word")), "[^a-z0-9]", ""))
    spans = words.join(R.questions(t).select("qid", "term"), ["qid", "term"], "left_semi").select("qid", "doc", "start", "end")
    return A.merged_spans(spans).select("qid", "doc", "start", "end")


@query("se7_conflicting_quantities", BASE + BEST + """, s AS (SELECT qid, rank, array_to_string(list_sort(list_distinct(regexp_extract_all(unit, '[0-9]+'))), ' ') AS sign FROM phrases WHERE rank <= 3)
SELECT qid, count(DISTINCT sign) FILTER (sign <> '') >= 2 AS conflict FROM s GROUP BY qid""")
def _(t):
    sign = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("unit", F.lit("[0-9]+"), F.lit(0)))), " ")
    first = phrases(_Evidence(t)).filter("rank <= 3").select("qid", F.nullif(sign, F.lit("")).alias("sign"))
    return first.groupBy("qid").agg((F.count_distinct("sign") >= 2).alias("conflict"))


# Stand-ins for what the records of a legal corpus say of a text: its first ten tokens for the title, German for
# a law, a short text for a recital, one source for scanned texts, French for texts not in force.
FINAL = f""", title_cov AS (SELECT t.qid, t.doc, sum(weight) / any_value(total) AS title FROM (SELECT DISTINCT c.qid, h.doc, c.stem, weight
    FROM concepts c JOIN (SELECT DISTINCT doc, {duck_stem('term')} AS stem FROM (SELECT doc, unnest(tokens[:10]) AS term FROM docs)) h USING (stem)
    JOIN candidates k ON k.qid = c.qid AND k.doc = h.doc) t JOIN total USING (qid) GROUP BY t.qid, t.doc),
asks_law AS (SELECT item_id AS qid, regexp_matches(strip_accents(lower(text)), '(^|[^a-z0-9])(ley|legal|law|loi|gesetz)([^a-z0-9]|$)') AS law FROM benchmark),
finals AS (SELECT p.qid, p.doc, p.rank, unit, datum, cov, coalesce(coverage, 0) AS passage, d.lang, d.source,
  (0.35 * score + 0.40 * cov + 0.15 * coalesce(coverage, 0) + 0.20 * coalesce(title, 0)
   + CASE WHEN d.lang = 'de' THEN CASE WHEN law THEN {A.LAW_ASKED_BONUS} ELSE {A.LAW_BONUS} END ELSE 0 END + CASE WHEN datum THEN {A.LAX_BONUS} ELSE 0 END)
  * CASE WHEN n_chars < 400 THEN 0.75 ELSE 1 END * CASE WHEN d.source = 'src1' THEN 0.95 ELSE 1 END * CASE WHEN d.lang = 'fr' THEN 0.9 ELSE 1 END AS final
  FROM phrases p JOIN (SELECT qid, doc, score FROM candidates) USING (qid, doc) LEFT JOIN coverage USING (qid, doc) LEFT JOIN title_cov USING (qid, doc)
  JOIN asks_law USING (qid) JOIN documents d ON d.doc_id = p.doc)
"""


def finals(e: _Evidence) -> DataFrame:
    """The final score of each candidate: ranking, sentence, passage and title evidence, a bonus for laws and data, discounts for recitals, scans and texts not in force."""
    near = X.sent(e.candidates.select("doc").distinct())
    texts = e.t("documents").select(F.col("doc_id").alias("doc"), "lang", "source", "n_chars").join(near, "doc", "left_semi")
    total = e.concepts.groupBy("qid").agg(F.sum("weight").alias("total"))
    heads = e.stems_of(e.index.heads.join(near, "doc", "left_semi").select("doc", F.explode("head").alias("term")))
    titles = e.candidates.select("qid", "doc").join(heads, "doc").join(e.concepts, ["qid", "stem"]).groupBy("qid", "doc").agg(F.sum("weight").alias("got"))
    titles = titles.join(total, "qid").select("qid", "doc", (F.col("got") / F.col("total")).alias("title"))
    law = e.t("benchmark").select(F.col("item_id").alias("qid"), T.normalise(F.col("text")).rlike("(^|[^a-z0-9])(ley|legal|law|loi|gesetz)([^a-z0-9]|$)").alias("law"))
    all_ = phrases(e).join(e.candidates.select("qid", "doc", "score"), ["qid", "doc"]).join(e.near_coverage, ["qid", "doc"], "left").join(titles, ["qid", "doc"], "left").join(law, "qid").join(texts, "doc")
    passage = F.coalesce("coverage", F.lit(0.0))
    bonus = F.when(F.col("lang") == "de", F.when(F.col("law"), A.LAW_ASKED_BONUS).otherwise(A.LAW_BONUS)).otherwise(0.0) + F.when(F.col("datum"), A.LAX_BONUS).otherwise(0.0)
    final = 0.35 * F.col("score") + 0.40 * F.col("cov") + 0.15 * passage + 0.20 * F.coalesce("title", F.lit(0.0)) + bonus
    for less, when in ((0.75, F.col("n_chars") < 400), (0.95, F.col("source") == "src1"), (0.9, F.col("lang") == "fr")):
        final = final * F.when(when, less).otherwise(1.0)
    return all_.select("qid", "doc", "rank", "unit", "datum", "cov", passage.alias("passage"), "lang", "source", final.alias("final"))


@query("rk5_final_score", BASE + BEST + FINAL + "SELECT qid, doc, round(final, 6) AS final FROM finals")
def _(t):
    return finals(_Evidence(t)).select("qid", "doc", F.round("final", 6).alias("final"))


@query("rk6_greedy_caps")
def _(t):
    """No SQL twin: which rows are taken depends on those taken before in two keys; tested against a loop."""
    from pyspark.sql import Window

    f = finals(_Evidence(t))
    by = Window.partitionBy("qid").orderBy(F.round("final", 6).desc(), "doc")
    ranked = f.select("qid", "doc", F.row_number().over(by).alias("rank"), T.fingerprint(F.col("unit"), 160).alias("signature"), F.col("source").alias("doc_group"), F.col("lang").alias("norm"))
    return A.greedy_caps(ranked)


@query("rk7_hierarchy", BASE + BEST + FINAL + """, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(final, 6) DESC, doc) AS n FROM finals),
t AS (SELECT qid, final AS top, cov AS top_cov, lang AS top_lang FROM o WHERE n = 1),
lift AS (SELECT qid, min(n) AS n FROM o JOIN t USING (qid) WHERE n BETWEEN 2 AND 4 AND top_lang <> 'es' AND lang = 'es' AND round(final, 6) >= round(0.9 * top, 6) AND round(cov, 6) >= round(top_cov - 0.1, 6) GROUP BY qid)
SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN o.n = lift.n THEN 0 ELSE o.n END)::BIGINT AS place FROM o LEFT JOIN lift USING (qid)""")
def _(t):
    """One language stands for laws: the first of them in places two to four goes first if it is almost as good."""
    from pyspark.sql import Window

    by = Window.partitionBy("qid")
    o = finals(_Evidence(t)).withColumn("n", F.row_number().over(by.orderBy(F.round("final", 6).desc(), "doc")))
    first = {c: F.max(F.when(F.col("n") == 1, F.col(c))).over(by) for c in ("final", "cov", "lang")}
    fits = F.col("n").between(2, 4) & (first["lang"] != "es") & (F.col("lang") == "es")
    fits &= (F.round("final", 6) >= F.round(0.9 * first["final"], 6)) & (F.round("cov", 6) >= F.round(first["cov"] - 0.1, 6))
    o = o.withColumn("fits", fits)
    o = o.withColumn("lift", F.min(F.when(F.col("fits"), F.col("n"))).over(by))
    place = F.row_number().over(by.orderBy(F.when(F.col("n") == F.col("lift"), 0).otherwise(F.col("n"))))
    return o.select("qid", "doc", place.cast("long").alias("place"))


STATE = """, answers AS (SELECT f.*, coalesce(hit, 0) = size AS whole, unseen FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(final, 6) DESC, doc) AS n FROM finals) f
  JOIN core_size USING (qid) LEFT JOIN core_hit USING (qid, doc) JOIN (SELECT qid, coalesce(sum(weight) FILTER (unseen), 0) / sum(weight) AS unseen FROM concepts GROUP BY qid) USING (qid) WHERE n = 1),
states AS (SELECT qid, doc, unit, datum, CASE WHEN round(unseen, 6) >= 0.2 THEN 'absent' WHEN whole AND round(cov, 6) >= (CASE WHEN datum THEN 0.6 ELSE 0.9 END) AND round(passage, 6) >= 0.85 THEN 'found' WHEN round(cov, 6) >= 0.45 THEN 'partial' ELSE 'absent' END AS state FROM answers)
"""


def states(e: _Evidence) -> DataFrame:
    from pyspark.sql import Window

    best = e.finals.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("final", 6).desc(), "doc"))).filter("n = 1")
    unseen = e.concepts.groupBy("qid").agg((F.sum(F.when(F.col("unseen"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("unseen"))
    whole = e.core_hit(e.near_credits).select("qid", "doc", (F.col("hit") == F.col("size")).alias("whole"))
    rows = best.join(whole, ["qid", "doc"], "left").join(unseen, "qid")
    said = A.state(F.round("cov", 6), F.round("passage", 6), F.coalesce("whole", F.lit(False)), F.round("unseen", 6), F.col("datum"), F.lit(True))
    return rows.select("qid", "doc", "unit", "datum", said.alias("state"))


@query("an1_answer_state", BASE + BEST + FINAL + STATE + "SELECT qid, doc, state FROM states")
def _(t):
    return states(_Evidence(t)).select("qid", "doc", "state")


@query("an2_notices", BASE + BEST + FINAL + STATE + "SELECT qid, concat_ws(',', CASE WHEN datum THEN 'check figures' END, CASE WHEN state <> 'found' THEN 'not verified' END, CASE WHEN length(unit) > 200 THEN 'long' END) AS notices FROM states")
def _(t):
    found = states(_Evidence(t))
    notes = F.array(F.when(F.col("datum"), "check figures"), F.when(F.col("state") != "found", "not verified"), F.when(F.length("unit") > 200, "long"))
    return found.select("qid", F.array_join(F.filter(notes, lambda x: x.isNotNull()), ",").alias("notices"))


@query("an3_legacy_mapping", BASE + BEST + FINAL + STATE + "SELECT state, CASE state WHEN 'found' THEN 'high' WHEN 'partial' THEN 'medium' ELSE 'low' END AS confidence, count(*)::BIGINT AS n FROM states GROUP BY state")
def _(t):
    names = F.create_map(*(F.lit(x) for x in ("found", "high", "partial", "medium", "absent", "low")))
    return states(_Evidence(t)).groupBy("state").agg(F.count(F.lit(1)).alias("n")).select("state", names[F.col("state")].alias("confidence"), "n")


@query("an4_uncovered_concepts", BASE + "SELECT core.qid, core.stem FROM core WHERE NOT EXISTS (SELECT 1 FROM credits c JOIN ranked r ON r.qid = c.qid AND r.doc = c.doc AND r.rank <= 3 WHERE c.qid = core.qid AND c.concept = core.stem)")
def _(t):
    e = _Evidence(t)
    seen = e.near_credits.join(e.candidates.filter("rank <= 3").select("qid", "doc"), ["qid", "doc"], "left_semi").select("qid", F.col("concept").alias("stem"))
    return e.core.join(seen, ["qid", "stem"], "left_anti").select("qid", "stem")
