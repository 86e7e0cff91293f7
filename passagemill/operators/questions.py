"""What a question asks for: concepts with weights, a vocabulary's rules that its words and phrases set off, the term to be defined.

Words of several are matched by a table of n-grams over the question's words,
equal keys all the way, so rules and questions may both be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .answers import CREDIT_ALTERNATIVE
from .index import sent
from .sentences import question_type, words_of_type

# The weight of added words, how infinitives end, how a definition is asked for.
ADDED_WEIGHT = 0.5
INFINITIVE = "[a-z]{3,}(?:ar|er|ir)$"
DEFINES = r"que\s+(?:es|son|se\s+considera|se\s+entiende\s+por)\s+(?:un|una|el|la|los|las|lo)?\s*(.+)"
DEFINED_WORDS = 3
#: Documents that credits are summed for at a time, about; and what a block has at most, about: words of documents, pairs of questions and documents.
BLOCK, MOST_WORDS, MOST_PAIRS = 16_384, 2_000_000, 4_000_000
#: Phrases of alternatives that a block meets at a time, about, and bytes of bits that it keeps of them.
MOST_PHRASES, MOST_KEPT = 2_000_000, 64_000_000
#: Phrases whose bits are put together at once.
AT_ONCE = 1024


def _grams(text: Column, longest: int) -> Column:
    """All runs of up to longest words of a normal form that single blanks part, and nothing else."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("[a-z0-9]+(?: [a-z0-9]+)*"), F.lit(0)), lambda r: F.split(r, " "))

    def of(words: Column) -> Column:
        def from_(k: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - k)), lambda n: F.array_join(F.slice(words, k + 1, n), " "))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), from_))

    return F.array_distinct(F.flatten(F.transform(runs, of)))


def analysed(questions: DataFrame, conversation: list[str] = ()) -> DataFrame:
    """qid and text with plain, kind and tokens: the different words to be looked for, in order, without those of conversation and of the kind."""
    rows = questions.select("qid", "text", T.normalise(F.col("text")).alias("plain"), question_type(F.col("text")).alias("kind"))
    own = F.array_except(T.tokenize(F.col("text")), F.concat(words_of_type(F.col("kind")), F.array(*map(F.lit, conversation)).cast("array<string>")))
    return rows.withColumn("tokens", own)


def concepts(rows: DataFrame) -> DataFrame:
    """qid, place, term, stem of analysed questions: the first word of each stem."""
    each = rows.select("qid", F.posexplode("tokens").alias("place", "term")).withColumn("stem", T.stem(F.col("term")))
    first = each.groupBy("qid", "stem").agg(F.min(F.struct("place", "term")).alias("f"))
    return first.select("qid", "f.place", "f.term", "stem")


def set_off(rows: DataFrame, triggers: DataFrame, longest: int) -> DataFrame:
    """qid, rule, trigger: one word by its stem, several as they stand, parted by single blanks.  triggers: rule, trigger, of up to longest words."""
    marked = triggers.withColumn("trigger", T.normalise(F.trim("trigger"))).filter("trigger <> ''")
    single = ~F.contains("trigger", F.lit(" "))
    words = marked.filter(single).withColumn("stem", T.stem(F.col("trigger")))
    stems = rows.select("qid", F.explode(T.stems(F.col("text"))).alias("stem"))
    grams = rows.select("qid", F.explode(_grams(F.col("plain"), longest)).alias("trigger"))
    by_stem = stems.join(words, "stem").select("qid", "rule", "trigger")
    return by_stem.unionByName(grams.join(marked.filter(~single), "trigger").select("qid", "rule", "trigger")).distinct()


def expanded(rows: DataFrame, fired: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What fired rules add (rule, k, phrase): alternatives (qid, concept, stems) of the concept that set the rule off first, and words (qid, term, weight) for the search.

    A rule whose words are no concept of the question adds words only.
    """
    own = fired.select("qid", "rule", F.explode(T.stems(F.col("trigger"))).alias("stem"))
    owner = own.join(concepts(rows), ["qid", "stem"]).groupBy("qid", "rule").agg(F.min_by("stem", "place").alias("concept"))
    ruled = fired.select("qid", "rule").distinct().join(added.select("rule", "phrase"), "rule")
    ruled = ruled.withColumn("stems", F.transform(T.tokenize(F.col("phrase")), lambda w: T.stem(w))).filter(F.size("stems") > 0)
    alternatives = ruled.join(owner, ["qid", "rule"]).select("qid", "concept", "stems").distinct()
    words = ruled.select("qid", F.explode(T.tokenize(F.col("phrase"))).alias("term")).distinct()
    asked = rows.select("qid", F.explode("tokens").alias("term"))
    return alternatives, words.join(asked, ["qid", "term"], "left_anti").withColumn("weight", F.lit(ADDED_WEIGHT))


def weighted(found: DataFrame, alternatives: DataFrame, stems: DataFrame, unseen: float) -> DataFrame:
    """Concepts with their weight; infinitives that neither stand in the corpus nor have an alternative that does, all of its words, are dropped.  stems: stem, idf."""
    known = stems.select("stem", "idf")
    # Alternatives decide on infinitives that the corpus has not, and are looked up for these alone.
    rows = found.join(known, "stem", "left")
    doubtful = rows.filter(F.col("term").rlike(INFINITIVE) & F.col("idf").isNull()).select("qid", F.col("stem").alias("concept"))
    each = alternatives.join(sent(doubtful), ["qid", "concept"], "left_semi").withColumn("id", F.monotonically_increasing_id()).select("qid", "concept", "id", F.size("stems").alias("size"), F.explode("stems").alias("stem"))
    whole = each.join(known, "stem").groupBy("qid", "concept", "id", "size").agg(F.count(F.lit(1)).alias("n")).filter("n = size")
    said = whole.select("qid", F.col("concept").alias("stem")).distinct().withColumn("said", F.lit(True))
    rows = rows.join(said, ["qid", "stem"], "left")
    keep = ~F.col("term").rlike(INFINITIVE) | F.col("idf").isNotNull() | F.col("said")
    return rows.filter(F.coalesce(keep, F.lit(False))).select("qid", "place", "term", "stem", F.coalesce("idf", F.lit(unseen)).alias("weight"))


def defined(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """qid and stem of the term that definitions are asked of: the weightiest of the first three stems after "que es", else of all; the first of equal ones."""
    after = F.regexp_extract("plain", DEFINES, 1)
    near = rows.filter("kind = 'definicion'").select("qid", F.slice(F.transform(T.tokenize(after), lambda w: T.stem(w)), 1, DEFINED_WORDS).alias("near"))
    met = weights.join(near, "qid").withColumn("first", F.array_contains("near", F.col("stem")))
    return met.groupBy("qid").agg(F.max_by("stem", F.struct("first", F.round("weight", 6), -F.col("place"))).alias("stem"))


def credits(weights: DataFrame, alternatives: DataFrame, texts: DataFrame) -> DataFrame:
    """qid, doc, stem, weight, credit: 1 for a concept's own stem or all of an alternative of several words, 0.7 for one of one word.  texts: doc, stem, each once."""
    own = weights.select("qid", "weight", F.col("stem").alias("concept"), "stem", F.lit(-1).cast("long").alias("id"), F.lit(1).alias("size"))
    other = alternatives.withColumns({"id": F.monotonically_increasing_id(), "words": F.size("stems"), "stems": F.array_distinct("stems")})
    other = other.join(weights.select("qid", F.col("stem").alias("concept"), "weight"), ["qid", "concept"])
    other = other.select("qid", "weight", "concept", F.explode("stems").alias("stem"), "id", F.size("stems").alias("size"), "words")
    by = ["qid", "doc", "concept", "weight", "id", "size", "words"]
    met = own.withColumn("words", F.lit(1)).unionByName(other).join(texts, "stem").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    credit = F.when((F.col("id") < 0) | (F.col("words") > 1), 1.0).otherwise(CREDIT_ALTERNATIVE)
    return met.filter("n = size").groupBy("qid", "doc", F.col("concept").alias("stem"), "weight").agg(F.max(credit).alias("credit"))


def credit_sums(weights: DataFrame, alternatives: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """qid, doc, n, credit: how many concepts of a question a document has any credit for, and the sum, as credits says.

    Most alternatives are those of many questions and in many documents, so rows
    of them all would grow with the square of the corpus.  A block of documents
    has instead a string of bits for each stem; phrases are ands of these,
    concepts ors of phrases, which questions with equal alternatives share.
    A task holds the words of one block and one slice of the concepts, whose
    sizes are bounded: more documents are more blocks, more rules more slices.
    """
    concepts = weights.select("qid", F.col("stem").alias("concept")).distinct()
    phrase = F.array_join(F.array_sort(F.array_distinct("stems")), " ")  # stems have no blanks
    other = alternatives.join(sent(concepts), ["qid", "concept"], "left_semi").select("qid", "concept", phrase.alias("phrase"), (F.size("stems") > 1).alias("whole"))
    sets = other.groupBy("qid", "concept").agg(*(F.array_sort(F.collect_set(F.when(c, F.col("phrase")))).alias(n) for n, c in (("whole", F.col("whole")), ("some", ~F.col("whole")))))
    none = F.array().cast("array<string>")
    sets = concepts.join(sets, ["qid", "concept"], "left").select("qid", "concept", F.coalesce("whole", none).alias("whole"), F.coalesce("some", none).alias("some"))
    shared = sets.groupBy("whole", "some").agg(F.collect_list("qid").alias("qids"), F.collect_list("concept").alias("concepts"))
    said = concepts.select(F.col("concept").alias("stem")).union(other.select(F.explode(F.split("phrase", " ")).alias("stem"))).distinct()
    near = texts.join(sent(said), "stem", "left_semi")
    n_words, n_docs = near.agg(F.count(F.lit(1)), F.approx_count_distinct("doc")).first()
    n_questions, n_phrases = concepts.select("qid").distinct().count(), shared.agg(F.coalesce(F.sum(F.size("whole") + F.size("some")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_docs // block), -(-n_words // MOST_WORDS), -(-n_docs * n_questions // MOST_PAIRS))
    slices = max(1, -(-n_phrases // MOST_PHRASES))
    near = near.select(F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")).alias("slice"), "doc", "stem")
    spread = shared.withColumn("slice", F.pmod(F.xxhash64("whole", "some"), F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    types = {f.name: f.dataType.simpleString() for f in [*weights.select("qid").schema, *texts.select("doc").schema]}
    found = near.groupBy("block", "slice").cogroup(spread.groupBy("block", "slice")).applyInArrow(_summed, f"qid {types['qid']}, doc {types['doc']}, n bigint, credit double")
    # A concept is in one slice.
    return found if slices == 1 else found.groupBy("qid", "doc").agg(F.sum("n").alias("n"), F.sum("credit").alias("credit"))


def _summed(texts, shared):
    """credit_sums of one block and slice: texts (block, slice, doc, stem), shared (whole, some, qids, concepts, slice, block)."""
    import numpy as np
    import pyarrow as pa

    docs, stems = (texts.column(c).combine_chunks().dictionary_encode() for c in ("doc", "stem"))
    docs, stems = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (docs, stems))
    width = len(docs.dictionary)
    has = np.zeros((len(stems.dictionary) + 1, -(-width // 8)), np.uint8)  # the last row: no document
    d, at = docs.indices.to_numpy(), {x: k for k, x in enumerate(stems.dictionary.to_pylist())}
    np.bitwise_or.at(has, (stems.indices.to_numpy(), d >> 3), (128 >> (d & 7)).astype(np.uint8))
    phrases: dict[str, np.ndarray] = {}

    def bits(phrase: str):
        if (found := phrases.get(phrase)) is None:
            if len(phrases) * has.shape[1] >= MOST_KEPT:
                phrases.clear()
            found = phrases[phrase] = np.bitwise_and.reduce([has[at.get(x, -1)] for x in phrase.split(" ")])
        return found

    def any_of(said: list):
        out = has[-1].copy()
        for lo in range(0, len(said), AT_ONCE):
            np.bitwise_or.reduce([out, *map(bits, said[lo : lo + AT_ONCE])], out=out)
        return out

    n, credit = {}, {}
    for r in shared.to_batches(max_chunksize=1):
        row = r.to_pylist()[0]
        whole, some = any_of(row["whole"]), any_of(row["some"])
        for q, concept in zip(row["qids"], row["concepts"], strict=True):
            if q not in n:
                n[q], credit[q] = np.zeros(width, np.int64), np.zeros(width)
            full = np.unpackbits(whole | has[at.get(concept, -1)], count=width).astype(bool)
            part = np.unpackbits(some, count=width).astype(bool) & ~full
            n[q] += full | part
            credit[q] += full + CREDIT_ALTERNATIVE * part
    types, out = (shared.schema.field("qids").type.value_type, docs.dictionary.type), []
    for q in n:
        met = np.flatnonzero(n[q])
        out.append(pa.table({"qid": pa.array([q] * len(met), types[0]), "doc": docs.dictionary.take(pa.array(met)), "n": n[q][met], "credit": credit[q][met]}))
    empty = pa.schema([("qid", types[0]), ("doc", types[1]), ("n", pa.int64()), ("credit", pa.float64())]).empty_table()
    return pa.concat_tables(out) if out else empty
