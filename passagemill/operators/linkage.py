"""Record linkage: unique records of a listing, links from files to records, canonical copies, edges between texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def collapse(listing: DataFrame, key: list[str], words: str, order: str, least: float = 0.6) -> DataFrame:
    """Gives rows of one key the number of the record they belong to: the first whose description shares enough words.

    Which record a row joins depends on the rows before it, so a key's rows
    stream in order through one task; the state is the words of its records.
    """

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, records = None, []
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                own = set(row.words)
                if row.key != now:
                    now, records = row.key, []
                n = next((i for i, other in enumerate(records) if not own or not other or len(own & other) >= least * min(len(own), len(other))), None)
                if n is None:
                    n = len(records)
                    records.append(own)
                out.append(n)
            yield pd.DataFrame({"id": rows["id"], "record": out})

    named = listing.select(F.col(order).alias("id"), F.concat_ws("|", *key).alias("key"), F.col(words).alias("words"))
    dealt = named.repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInPandas(assign, "id long, record int").withColumnRenamed("id", order)


def _field(name: str):
    return lambda x: x[name]


def fold(rows: DataFrame, key: list[str], order: str, sets: list[str], longest: str) -> DataFrame:
    """One row per key: each set column's values in the order of arrival, and the longest text."""
    seen = [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, s))), _field(s))).alias(s) for s in sets]
    return rows.groupBy(*key).agg(*seen, F.max_by(longest, F.struct(F.length(longest), -F.col(order))).alias(longest))


def resolve(left: DataFrame, key: str, *tries: tuple[str, DataFrame]) -> DataFrame:
    """The first method whose table (key, target) has the key: target (the least), method, and whether it was unique."""
    out = left
    for i, (name, table) in enumerate(tries):
        found = table.groupBy(key).agg(F.min("target").alias(f"_t{i}"), (F.count_distinct("target") == 1).alias(f"_u{i}"))
        out = out.join(found, key, "left")
    chosen = F.coalesce(*(F.when(F.col(f"_t{i}").isNotNull(), F.struct(F.col(f"_t{i}").alias("target"), F.lit(n).alias("method"), F.col(f"_u{i}").alias("sure"))) for i, (n, _) in enumerate(tries)))
    return out.withColumn("_c", chosen).select(*left.columns, F.col("_c.target").alias("target"), F.coalesce("_c.method", F.lit("none")).alias("method"), F.coalesce("_c.sure", F.lit(False)).alias("sure"))


def canonical_copy(docs: DataFrame, group: str, text: str, quality: Column, tie: str, band: int = 4000) -> DataFrame:
    """The copy of each group that is indexed: most text by bands, then text quality, then most text."""
    n = F.length(text)
    order = F.struct(-F.floor(n / band), quality, -n, F.col(tie))
    return docs.groupBy(group).agg(F.min_by(tie, order).alias(tie))


def edges(docs: DataFrame, verbs: dict[str, str], target: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What a text says about others: (key, verb, target, n) for every verb's pattern followed by the target's pattern."""
    out = None
    for verb, pattern in verbs.items():
        found = F.regexp_extract_all(text, F.lit(f"(?i:{pattern})\\s+({target})"), F.lit(1))
        rows = docs.select(key, F.lit(verb).alias("verb"), F.posexplode(found).alias("n", "target"))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_of(rows: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """The first row of each signature."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*signature).orderBy(*order))).filter("_n = 1").drop("_n")


def canonical_type(c: Column, synonyms: dict[str, str]) -> Column:
    """The name that a type's spelling stands for, or its own normal form."""
    names = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
    return F.coalesce(names[T.norm_key(c)], F.trim(c))


# Ordinals that name provisions, and their numbers.
ORDINALS = dict(primero=1, segundo=2, tercero=3, cuarto=4, quinto=5, sexto=6, septimo=7, octavo=8, noveno=9, decimo=10)


def provision(said: Column) -> tuple[Column, Column]:
    """The class (article, number, letter, annex) and value of the first provision that a normal form names; ordinals are digits."""
    pattern = r"(articulo|numeral|letra|anexo)s? +(?:n[o°.]* *)?([0-9]+|[a-z]\)|" + "|".join(ORDINALS) + ")"
    kind, value = F.regexp_extract(said, pattern, 1), F.regexp_extract(said, pattern, 2)
    digits = F.create_map(*(F.lit(x) for k, n in ORDINALS.items() for x in (k, str(n))))
    return F.nullif(kind, F.lit("")), F.nullif(F.coalesce(digits[value], F.translate(value, ")", "")), F.lit(""))


def noted_edges(docs: DataFrame, note: str, target: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges that a consolidated text's notes say come in: (source, verb, key), the source being what the note names."""
    found = F.regexp_extract_all(text, F.lit(f"(?i:{note})\\s+({target})"), F.lit(1))
    return docs.select(F.posexplode(found).alias("n", "source"), F.lit("noted").alias("verb"), key)


# Kinds that a file's name may begin with, the most specific first, and the names that spellings stand for.
FILE_KINDS = ("Decreto con Fuerza de Ley", "Decreto Supremo", "Decreto Exento", "Norma Técnica", "Resolución Exenta", "Circular", "Decreto", "Ley", "Oficio")
KIND_SPELLINGS = {"resoucion exenta": "Resolución Exenta", "resolucion exenta": "Resolución Exenta", "resolucion": "Resolución Exenta", "decreto con fuerza de ley": "Decreto con Fuerza de Ley", "decreto supremo": "Decreto Supremo", "decreto exento": "Decreto Exento", "norma tecnica": "Norma Técnica", "circular": "Circular", "decreto": "Decreto", "ley": "Ley", "oficio": "Oficio"}


def kind_and_number(stem: Column) -> tuple[Column, Column]:
    """The kind that a file's name begins with, and the first number after it; both empty where it begins with none."""
    plain = T.norm_key(F.regexp_replace(F.trim(stem), "[-_]+", " "))
    kind, rest = F.lit(""), F.lit("")
    for name in reversed(FILE_KINDS):
        key = F.lit(" ".join(name.lower().replace("ó", "o").replace("é", "e").split()))
        kind = F.when(plain.startswith(key), name).otherwise(kind)
        rest = F.when(plain.startswith(key), F.substring(plain, F.length(key) + 1, F.length(plain))).otherwise(rest)
    found = F.regexp_extract(rest, r"[A-Za-z]?[0-9][0-9.\-]*", 0)
    return kind, T.norm_number(F.regexp_replace(found, "[.-]+$", ""))


def resolve_files(files: DataFrame, norms: DataFrame, overrides: DataFrame) -> DataFrame:
    """Which norm each file (name) is: norm_id, method, confidence.

    In this order: an override by kind and number, if there is such a norm; one
    by title, which makes a record of its own; the file that a norm's link ends
    with, ties going to the norm whose number the file's name has, else to the
    least id, which is ambiguous; kind and number of the name, the least of
    several being ambiguous too; kind and short number, if one norm has them;
    none.  norms: norm_id, kind, number, link; overrides: name, kind, number,
    title, a row a file.  Norms are summed up by each key before files meet
    them, so a file name or number that many share is one row.
    """
    base, stem = F.lower("name"), F.regexp_replace("name", r"\.[^.]*$", "")
    own_kind, own_number = kind_and_number(stem)
    rows = files.select("name").distinct().select("name", base.alias("base"), own_kind.alias("kind"), own_number.alias("number"))
    rows = rows.withColumns({"kind": T.norm_key(F.col("kind")), "short": T.short_number(F.col("number"))})
    n = norms.select("norm_id", T.norm_key(canonical_type(F.col("kind"), KIND_SPELLINGS)).alias("kind"), T.norm_number(F.col("number")).alias("number"), T.url_basename(F.col("link")).alias("base"))
    n = n.withColumn("short", T.short_number(F.col("number"))).distinct()
    linked = n.filter(F.col("base").endswith(".pdf"))

    def least(of: DataFrame, name: str, *by: str) -> DataFrame:
        return of.groupBy(*by).agg(F.struct(F.min("norm_id").alias("id"), F.count_distinct("norm_id").alias("n")).alias(name))

    over = overrides.select(F.lower("name").alias("base"), T.norm_key(canonical_type(F.coalesce("kind", F.lit("")), KIND_SPELLINGS)).alias("o_kind"), T.norm_number(F.col("number")).alias("o_number"), F.nullif("title", F.lit("")).alias("title"))
    meant = least(n.select("norm_id", F.col("kind").alias("o_kind"), F.col("number").alias("o_number")), "meant", "o_kind", "o_number")
    numbered, has_number = n.filter("number <> ''"), F.col("number") != ""
    out = rows.join(over.join(meant, ["o_kind", "o_number"], "left").select("base", "title", "meant"), "base", "left")
    out = out.join(least(linked, "url", "base"), "base", "left")
    out = out.join(least(linked.filter("number <> ''"), "by_number", "base", "number"), ["base", "number"], "left")
    out = out.join(least(linked.filter("short <> ''"), "by_short", "base", "short"), ["base", "short"], "left")
    out = out.join(least(numbered, "exact", "kind", "number"), ["kind", "number"], "left")
    out = out.join(least(n.filter("short <> ''"), "brief", "kind", "short"), ["kind", "short"], "left")
    tie = F.when(has_number, F.least("by_number.id", "by_short.id"))
    said = F.col("kind") != ""

    def found(id_: Column, method: str, confidence: str) -> Column:
        return F.struct(id_.alias("norm_id"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    chosen = (
        F.when(F.col("meant").isNotNull(), found(F.col("meant.id"), "override", "high"))
        .when(F.col("title").isNotNull(), found(F.concat(F.lit("manual:"), "base"), "manual", "manual"))
        .when(F.col("url.n") == 1, found(F.col("url.id"), "url", "high"))
        .when(F.col("url").isNotNull() & tie.isNotNull(), found(tie, "url and file", "high"))
        .when(F.col("url").isNotNull(), found(F.col("url.id"), "url", "ambiguous"))
        .when(said & has_number & (F.col("exact.n") == 1), found(F.col("exact.id"), "kind and number", "high"))
        .when(said & has_number & F.col("exact").isNotNull(), found(F.col("exact.id"), "kind and number", "ambiguous"))
        .when(said & has_number & (F.col("brief.n") == 1), found(F.col("brief.id"), "kind and short number", "medium"))
        .otherwise(found(F.lit(None).cast("string"), "none", "none"))
    )
    return out.withColumn("_c", chosen).select("name", "_c.*")
