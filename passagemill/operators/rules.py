"""Checks of drafts and records: citations, figures in digits and words, requests, validation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Number words (no accents).
NUMBER_WORDS = dict(
    un=1, uno=1, una=1, dos=2, tres=3, cuatro=4, cinco=5, seis=6, siete=7, ocho=8, nueve=9, diez=10, once=11, doce=12, trece=13, catorce=14, quince=15,
    dieciseis=16, diecisiete=17, dieciocho=18, diecinueve=19, veinte=20, veintiun=21, veintiuno=21, veintiuna=21, veintidos=22, veintitres=23, veinticuatro=24,
    veinticinco=25, veintiseis=26, veintisiete=27, veintiocho=28, veintinueve=29, treinta=30, cuarenta=40, cincuenta=50, sesenta=60, setenta=70, ochenta=80,
    noventa=90, cien=100, ciento=100,
    doscientos=200, doscientas=200, trescientos=300, trescientas=300, cuatrocientos=400, cuatrocientas=400, quinientos=500, quinientas=500,
    seiscientos=600, seiscientas=600, setecientos=700, setecientas=700, ochocientos=800, ochocientas=800, novecientos=900, novecientas=900,
)
SCALES = {"mil": 1000, "millon": 1_000_000, "millones": 1_000_000}

#: What blocks a request, in order; the rest is answered.
REQUESTS = (("format", r"---|\[ *p *[0-9]|</?(system|prompt)"), ("role", "ignore (all|the)|pretend|act as|actua como|ignora (las|tus)"), ("clinical", "dosis para mi|i feel|me duele|estoy embarazada"), ("task", "^(please )?(write|translate|summari[sz]e|escribe|redacta|traduceme|resumeme)"))
_CITATION = r"\[ *P *[0-9]+(?: *(?:[,;-]|y) *P? *[0-9]+)* *\]"
ABSTENTION = "the passages do not answer this"


def request_class(plain: Column) -> Column:
    """The first reason to block a request (in normal form), or answer."""
    out = F.lit("answer")
    for name, pattern in reversed(REQUESTS):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out


def sanitise(c: Column, n: int = 300) -> Column:
    """A question as one harmless line: no rules, citation marks, braces or code signs, n characters at most."""
    for pattern in (r"[\r\n\t]+", "-{3,}", r"(?i)[\[【]\s*p\s*[0-9]+[^\]】]*[\]】]", "[`{}<>]", r"\s{2,}"):
        c = F.regexp_replace(c, pattern, " ")
    return F.substring(F.trim(c), 1, n)


def numbers_in_words(said: str | None) -> list[int]:
    """Numbers written out, read as one figure each: words add up, mil and millon multiply what stands before."""
    out, total, now, inside = [], 0, 0, False
    for word in [*re.findall(r"[a-z0-9ñ]+", said or ""), ""]:
        if word in NUMBER_WORDS:
            now, inside = now + NUMBER_WORDS[word], True
        elif word in SCALES:
            total, now, inside = (total + (now or 1)) * SCALES[word], 0, True
        elif not (word == "y" and inside):
            if inside:
                out.append(total + now)
            total, now, inside = 0, 0, False
    return out


def _words_to_numbers(said: pd.Series) -> pd.Series:
    return said.map(numbers_in_words)


def words_to_numbers(said: Column) -> Column:
    """numbers_in_words of texts in normal form."""
    return F.pandas_udf(_words_to_numbers, "array<long>")(said)


def unverified_numbers(draft: Column, passages: Column) -> Column:
    """Numbers of a draft that none of its passages has."""
    return F.array_except(T.numbers(draft), T.numbers(passages))


def cited(draft: Column) -> Column:
    """Passage numbers that a draft cites, in order and once: lists [P2, P4] and ranges [P2-P4]."""

    def of(mark: Column) -> Column:
        n = F.transform(F.regexp_extract_all(mark, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
        span = (F.size(n) == 2) & F.contains(mark, F.lit("-")) & (n[1] > n[0])
        return F.when(span, F.sequence(n[0], F.greatest(n[0], n[1]))).otherwise(n)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(draft, F.lit(_CITATION), F.lit(0)), of))))


def resolve_citations(draft: Column, n_passages: Column) -> tuple[Column, Column]:
    """The cited numbers that exist, and those that do not."""
    all_ = cited(draft)
    return F.filter(all_, lambda n: (n >= 1) & (n <= n_passages)), F.filter(all_, lambda n: (n < 1) | (n > n_passages))


def abstains(draft: Column) -> Column:
    """Whether a draft opens with the abstention; one that answers first does not."""
    return F.trim(F.regexp_replace(F.regexp_replace(T.normalise(draft), "[*\"“”«»]", ""), r"\s+", " ")).startswith(ABSTENTION)


def cache_key(*parts: Column) -> Column:
    """One hash of version, model, question and passages: equal only if all are."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def prompt(passages: Column) -> Column:
    """Numbered passage blocks."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n")


def problems(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold against a record."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())


def split_valid(records: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Records without problems, and the others with theirs."""
    judged = records.withColumn("problems", problems(checks))
    return judged.filter(F.size("problems") == 0).drop("problems"), judged.filter(F.size("problems") > 0)


def escape_html(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def safe_path(c: Column) -> Column:
    """A path of the same site, or the root: one slash first, no backslash, no second slash."""
    return F.when(c.rlike(r"^/(?![/\\])[^\\]*$"), c).otherwise("/")


#: A mark that cites passages: [P2], lists and ranges, brackets of either kind.
MARK = r"[\[【]\s*P\s*[0-9]+(?:\s*(?:[,;y–-]|\s)\s*P?\s*[0-9]+)*\s*[\]】]"
UNVERIFIABLE = "cita no verificable"
#: Numbers that a range may span; a longer one counts as its two ends.
LONGEST_RANGE = 10_000


def _numbers_of_mark(mark: Column) -> Column:
    """The numbers of a mark: two of them with a dash between, rising, are all from the first to the second."""
    n = F.transform(F.regexp_extract_all(mark, F.lit("[0-9]+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("int"), F.lit(2**31 - 1)))
    first, last = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    rising = (F.size(n) == 2) & mark.rlike("[–-]") & (last > first) & (last - first <= LONGEST_RANGE)
    return F.when(rising, F.sequence(first, F.greatest(first, F.least(last, first + LONGEST_RANGE)))).otherwise(n)


def with_citations(drafts: DataFrame, draft: str = "draft", names: str = "names") -> DataFrame:
    """The rows with their marks resolved: rewritten, sources (n and name, by number), invalid, uncited.

    names: an array of the passages' citations, by position.  In rewritten each
    mark is the names that it stands for, once each in the mark's order; a
    number without a passage is unverifiable and listed in invalid.  uncited: the
    draft names no passage and does not abstain.  A null draft is an empty one.
    """
    text = F.coalesce(F.col(draft), F.lit(""))
    cut = drafts.withColumns({"_pieces": F.split(text, "(?iu)" + MARK, -1), "_marks": F.transform(F.regexp_extract_all(text, F.lit("(?iu)" + MARK), F.lit(0)), lambda m: _numbers_of_mark(m))})

    def name(n: Column) -> Column:
        return F.coalesce(F.when(n >= 1, F.get(names, n - 1)), F.lit(UNVERIFIABLE))

    said = F.transform("_marks", lambda m: F.concat(F.lit("["), F.array_join(F.array_distinct(F.transform(m, name)), "; "), F.lit("]")))
    whole = F.array_join(F.transform(F.arrays_zip(F.col("_pieces").alias("p"), said.alias("m")), lambda x: F.concat(x["p"], F.coalesce(x["m"], F.lit("")))), "")
    all_ = F.array_sort(F.array_distinct(F.flatten("_marks")))
    there = cut.withColumns({"rewritten": whole, "_all": all_})
    sources = F.transform(F.filter("_all", lambda n: n.between(1, F.size(names))), lambda n: F.struct(n.alias("n"), F.get(names, n - 1).alias("name")))
    invalid = F.filter("_all", lambda n: ~n.between(1, F.size(names)))
    done = there.withColumns({"sources": sources, "invalid": invalid}).drop("_pieces", "_marks", "_all")
    return done.withColumn("uncited", (F.size("sources") == 0) & ~abstains(text))
