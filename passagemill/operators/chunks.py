"""Passages: units of a text, packed greedily with overlap; pages, sections, titles."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a passage, of the overlap, the least of a passage that is kept.
SIZE, OVERLAP, LEAST = 1500, 250, 60


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Paragraphs (between blank lines), and the sentences of those longer than size: doc, n, unit."""
    paragraphs = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(text, r"\n\s*\n")).alias("p", "para")).withColumn("para", F.btrim("para", F.lit(" \t\r\n")))
    cut = F.when(F.length("para") <= size, F.array("para")).otherwise(F.split(F.regexp_replace("para", r"([.!?:])\s+([A-ZÁÉÍÓÚÑ0-9(\"“])", "$1\u0001$2"), "\u0001"))
    return paragraphs.filter("para <> ''").select("doc", "p", F.posexplode(cut).alias("s", "unit"))


def pack(lengths: list[int], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Unit ranges of greedy passages.

    A passage ends before the first unit with which it would pass size, if it
    is two fifths full; the next one begins so that overlap characters repeat,
    and one unit later at least.  Both are searches in the running lengths.
    """
    total = [0]
    for n in lengths:
        total.append(total[-1] + n)
    out, i = [], 0
    while i < len(lengths):
        j = min(len(lengths), max(i + 1, bisect_left(total, total[i] + size * 0.4), bisect_right(total, total[i] + size) - 1))
        out.append((i, j))
        if j == len(lengths):
            break
        i = max(i + 1, bisect_right(total, total[j] - overlap) - 1)
    return out


def _packed(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda x: [{"first": a, "last": b} for a, b in pack(list(x))])


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, passage, said: packed units; the order-bound step sees one document's unit lengths only."""
    own = units(docs, key, text).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("p", "s", "unit"))).alias("u"))
    cuts = F.pandas_udf(_packed, "array<struct<first: int, last: int>>")
    own = own.withColumn("cuts", cuts(F.transform("u", lambda x: F.length(x["unit"]))))
    each = own.select("doc", "u", F.posexplode("cuts").alias("passage", "c"))
    said = F.array_join(F.transform(F.slice("u", F.col("c.first") + 1, F.col("c.last") - F.col("c.first")), lambda x: x["unit"]), "\n")
    return each.select("doc", "passage", said.alias("said")).filter(F.length("said") >= LEAST)


def page_at(offsets: DataFrame, starts: DataFrame, key: str = "doc") -> DataFrame:
    """The page of each offset: the last whose start is not after it.

    As a union sorted by position with the last page carried on, so an offset
    is not paired with every page.
    """
    from pyspark.sql import Window

    both = starts.select(key, F.col("start").alias("at"), "page", F.lit(0).alias("kind")).unionByName(offsets.select(key, F.col("offset").alias("at"), F.lit(None).cast("int").alias("page"), F.lit(1).alias("kind")))
    last = F.last("page", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("page", last).filter("kind = 1").select(key, F.col("at").alias("offset"), F.coalesce("page", F.lit(1)).alias("page"))


def section(text: Column, offset: Column, marks: dict[str, str], latest: float = 0.85) -> Column:
    """The last section whose mark stands before the offset; a mark in the last part of the text is ignored."""
    out = F.lit("body")
    for name, pattern in marks.items():
        at = F.length(F.regexp_extract(text, f"^([\\s\\S]*?)(?:{pattern})", 1))
        there = text.rlike(pattern) & (at <= latest * F.length(text))
        out = F.when(there & (offset >= at), name).otherwise(out)
    return out


def title(text: Column) -> Column:
    """The first line of the head, 25 to 220 characters, that is mostly capitals."""
    lines = F.transform(F.split(F.substring(text, 1, 2500), "\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" .-—·|")))

    def fits(x: Column) -> Column:
        letters, capitals = F.regexp_count(x, F.lit(r"\p{L}")), F.regexp_count(x, F.lit(r"\p{Lu}"))
        return F.length(x).between(25, 220) & (letters > 0) & (capitals > 0.6 * letters)

    return F.coalesce(F.substring(F.get(F.filter(lines, fits), F.lit(0)), 1, 200), F.lit(""))


def ocr_alerts(text: Column) -> Column:
    """What a bad scan leaves, four at most: article numbers above 400, broken number signs, mail names without @."""
    numbers = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)art[íi]culo\s+([0-9]+)"), F.lit(1)), lambda n: n.try_cast("int") > 400)
    articles = F.transform(numbers, lambda n: F.concat(F.lit("article "), n))
    broken = F.transform(F.regexp_extract_all(text, F.lit(r"\bN[*'\"]\s*[0-9]+"), F.lit(0)), lambda x: F.concat(F.lit("number sign "), x))
    mail = F.transform(F.regexp_extract_all(text, F.lit(r"\b[a-z]+(?:gmail|hotmail|yahoo)\.[a-z]+"), F.lit(0)), lambda x: F.concat(F.lit("mail "), x))
    return F.slice(F.array_distinct(F.concat(articles, broken, mail)), 1, 4)


def by_article(docs: DataFrame, heading: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, article, label, said: a text with two headings or more is cut before each; what stands before the first is article 0, if it is longer than 200.

    Other texts are one row without a label.  Long articles go on to passages().
    """
    marked = F.regexp_replace(text, f"(?m)^(\\s*{heading})", "\u0001$1")
    parts = F.split(marked, "\u0001")
    many = F.size(parts) > 2
    rows = docs.select(F.col(key).alias("doc"), F.posexplode(F.when(many, parts).otherwise(F.array(text))).alias("article", "said"))
    label = F.trim(F.regexp_extract("said", f"^\\s*({heading})", 1))
    rows = rows.select("doc", "article", label.alias("label"), F.trim("said").alias("said"))
    return rows.filter((F.length("said") >= LEAST) & ((F.col("label") != "") | (F.length("said") > 200) | (F.col("article") == 0)))


def by_paragraph(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: int = 2400) -> DataFrame:
    """doc, part, said: a text of up to `whole` characters as it is, a longer one as packed paragraphs without overlap."""
    paragraphs = F.filter(F.split(text, r"\n+"), lambda p: F.trim(p) != "")
    own = docs.select(F.col(key).alias("doc"), F.when(F.length(text) <= whole, F.array(text)).otherwise(paragraphs).alias("p"))
    cuts = F.pandas_udf(_packed_apart, "array<struct<first: int, last: int>>")
    parts = own.withColumn("cuts", cuts(F.transform("p", lambda x: F.length(x)))).select("doc", "p", F.posexplode("cuts").alias("part", "c"))
    joined = F.array_join(F.slice("p", F.col("c.first") + 1, F.col("c.last") - F.col("c.first")), "\n")
    return parts.select("doc", "part", joined.alias("said"))


def _packed_apart(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda x: [{"first": a, "last": b} for a, b in pack(list(x), overlap=0)])
