"""Modifications down to the provision: edges between texts, what provision each names, and the passages that these hit.

A text that modifies another says so in a sentence: verb, kind and number of the
other, and then, maybe, the provision meant.  Patterns are read in tasks, a
batch of texts at a time; what follows an edge is read without being used up,
so edges that follow closely are found too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T
from . import patterns as R

# How legal texts word verbs, kinds, number signs and provisions.
VERB = r"(modif[ií]c(?:a|ase|anse|an)|reempl[aá]z(?:a|ase|ese|an)|sustit[uú]y(?:e|ese|ase|en)|der[oó]g(?:a|ase|uese|an)|d[eé]jase sin efecto|deja sin efecto|complementa|actualiza|agrega)"
KIND = r"(resoluci[oó]n(?:\s+exenta)?|decreto(?:\s+(?:supremo|exento|con fuerza de ley))?|norma\s+(?:general\s+)?t[eé]cnica|circular|ley)"
SIGN = r"(?:n\s*[°ºo*?2e9.]{0,3}\s*)?"
CLASS = r"(numeral(?:es)?|n[uú]meros?|puntos?|art[ií]culos?|cl[aá]usulas?|letras?|anexos?|t[ií]tulos?|p[aá]rrafos?)"
SENSE = r"\b(en\s+el\s+sentido\s+de|en\s+los\s+siguientes\s+aspectos|en\s+el\s+siguiente\s+sentido|en\s+la\s+forma\s+que\s+se\s+indica)\b"
TIE = r"\b(de\s+su|de\s+dich[oa]s?|de\s+la\s+citada|de\s+la\s+referida|de\s+la\s+misma|del\s+mismo|de\s+la\s+presente|de\s+aquell[oa]|de\s+la\s+resoluci[oó]n|del\s+decreto|de\s+la\s+norma|de\s+la\s+ley|de\s+la\s+parte\s+(?:resolutiva|dispositiva)|del\s+articulado)\b"
ORDINALS = {
    "primero": 1, "uno": 1, "segundo": 2, "dos": 2, "tercero": 3, "tres": 3, "cuarto": 4, "cuatro": 4, "quinto": 5, "cinco": 5, "sexto": 6, "seis": 6,
    "septimo": 7, "siete": 7, "octavo": 8, "ocho": 8, "noveno": 9, "nueve": 9, "decimo": 10, "diez": 10, "undecimo": 11, "once": 11, "duodecimo": 12, "doce": 12,
}
HEADING = r"^\W{0,4}(?:(art[ií]culo|numeral|n[uú]mero|punto)\s+)?([0-9]{1,3}|primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno|d[eé]cimo)\s*[º°]?\s*[.\-)]"
LABEL = r"(primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno|d[eé]cimo)"
VERBS = {"modific": "modifica", "reempla": "reemplaza", "sustitu": "sustituye", "derog": "deroga", "dejase": "deja sin efecto"}
PARTICIPLES = {"modifica": "modificada", "reemplaza": "reemplazada", "sustituye": "sustituida", "deroga": "derogada", "deja sin efecto": "dejada sin efecto", "complementa": "complementada", "actualiza": "actualizada", "agrega": "modificada por agregación"}
#: Characters that are read after an edge, and after a provision for what ties it to the other text.
AHEAD, TIED = 220, 90
#: Characters of an alert's list of names; no more names than this fit.
NAMES_CHARS, NAMES = 120, 24

#: A text that names another: groups are verb, kind, number and what follows.
OUTGOING = rf"{VERB}\s+(?:el|la|los|las)?\s*{KIND}\s*{SIGN}\s*([0-9][0-9.]*)"
#: A note in a text that another has changed it: kind, number, suffix, date, verb, provision.
NOTED = (
    rf"\b(?:el|la)\s+{KIND}\s*{SIGN}\s*([0-9][0-9.]*)\s*(exent[oa]|supremo)?[^.]{{0,120}}?"
    rf"(?:publicad[oa]\s+el\s+([0-9]{{2}}[./-][0-9]{{2}}[./-][0-9]{{4}}))?[^.]{{0,60}}?,\s*{VERB}([^.]{{0,160}}?)\b(?:de\s+)?la\s+presente\s+norma"
)
#: The first provision of a fragment: what stands before, class, value, what follows.
FOLLOWING = f"(.{{0,{TIED}}})"
NAMED = rf"^(.*?)\b{CLASS}\s+([0-9]+[º°]?|[a-záéíóúñ]+)\b{FOLLOWING}"
#: Its class and value for tasks; a sign of degree counts to the value where a word follows it.
PLACED = rf"(?:^|[^{R.WORD}]){CLASS}\s+(?:([0-9]+°)[{R.WORD}]|([0-9]+º?|[a-záéíóúñ]+)(?:[^{R.WORD}]|$))"
#: Where a sentence ends before a capital.
SENTENCE_END = rf"\.[{R.BLANK}]+[A-ZÁÉÍÓÚÑ]"
#: Letters of any language in any case.
ANY = "(?iU)"


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(str(x)) for pair in values.items() for x in pair))


def flat(text: Column) -> Column:
    """White space as single blanks."""
    return F.regexp_replace(text, r"\s+", " ")


_LETTERS = str.maketrans(T.ACCENTED + "ºª", T.PLAIN + "oa")


def _plain(text: str) -> str:
    """What T.normalise and flat make of a text."""
    return re.sub(f"[{R.BLANK}]+", " ", text.lower().translate(_LETTERS))


def canonical_verb(verb: str) -> str:
    """The verb that a form is one of."""
    plain = _plain(verb)
    return next((name for start, name in VERBS.items() if plain.startswith(start)), plain)


def canonical_kind(kind: str) -> str:
    """A kind's name in listings."""
    k = _plain(kind)
    names = (
        ("Resolución Exenta", k.startswith("resolucion")),
        ("Decreto con Fuerza de Ley", "fuerza de ley" in k),
        ("Decreto Supremo", k.startswith("decreto supremo")),
        ("Decreto Exento", k.startswith("decreto exento")),
        ("Decreto", k.startswith("decreto")),
        ("Norma Técnica", "tecnica" in k),
        ("Circular", k.startswith("circular")),
        ("Ley", k.startswith("ley")),
    )
    return next((name for name, fits in names if fits), k.strip(" "))


def plain_number(number: Column) -> Column:
    """Digits without points and leading zeros; none for 0."""
    return F.nullif(F.ltrim(F.translate(number, ".", ""), F.lit("0")), F.lit(""))


def _same_class(name: str) -> str:
    """Numerals, numbers and points are one class; plurals are their singular."""
    one = re.sub("(?<=numeral)es$|s$", "", _plain(name))
    return "numero" if one in ("numeral", "punto") else one


def _value(value: str) -> str:
    plain = _plain(value.translate({ord(x): None for x in "º°"})).rstrip(" ")
    return str(ORDINALS.get(plain, plain))


def _named(pattern: str, *names: str) -> str:
    """A pattern for tasks whose groups have these names."""
    each = iter(names)
    return R.in_any_case(re.sub(r"(?<!\\)\((?!\?)", lambda _: f"(?P<{next(each)}>", pattern), wide=True)


def _whole(pattern: str) -> str:
    """Words that begin and end with a letter, for tasks, where no letters are beside them."""
    return R.in_any_case(pattern.replace(r"\b", rf"(?:^|[^{R.WORD}])", 1).replace(r"\b", rf"(?:$|[^{R.WORD}])"), wide=True)


def _provisions(fragments, tied: bool) -> list:
    """class and value of the first provision that each fragment's first sentence names, or null: values are digits, or one letter of the class letra.

    tied: only if the words before it announce a change, or those after it say
    whose provision it is; else a later heading of the same text would count.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    first = pc.list_element(pc.split_pattern_regex(pc.fill_null(fragments, ""), SENTENCE_END, max_splits=1), 0)
    m = R.places(first, _named(PLACED, "class", "signed", "value"))
    size = pc.binary_length(first).to_numpy(zero_copy_only=False)
    begin, end = (x + y for x, y in zip(m["signed"], m["value"], strict=True))  # one of the two has no place
    before, after, kind, value = R.pieces(first, (0 * size, m["class"][0]), (end, size), m["class"], (begin, end))
    kind, value = R.mapped(kind, _same_class), R.mapped(value, _value)
    fits = pc.or_(pc.match_substring_regex(value, "^[0-9]+$"), pc.and_(pc.match_substring_regex(value, "^[a-z]$"), pc.equal(kind, "letra")))
    fits = pc.and_(pc.and_(fits, pa.array(m["found"])), pc.invert(pc.match_substring_regex(before, f"[{R.LINE_END}]")))
    if tied:
        after = R.first_line(pc.utf8_slice_codeunits(after, 0, TIED))
        fits = pc.and_(fits, pc.or_(pc.match_substring_regex(before, _whole(SENSE)), pc.match_substring_regex(after, _whole(TIE))))
    return [pc.if_else(fits, x, None) for x in (kind, value)]


_TWO = [StructField("_class", StringType()), StructField("_value", StringType())]


def _provision(rows: DataFrame) -> DataFrame:
    """The rows with provision, struct(class, value) or null, of the columns _class and _value, which go."""
    both = F.struct(F.col("_class").alias("class"), F.col("_value").alias("value"))
    return rows.withColumn("provision", F.when(F.col("_value").isNotNull(), both)).drop("_class", "_value")


def _matches(text: Column, pattern: str, names: list[str]) -> Column:
    """An array of structs, one a match, of the pattern's groups."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(ANY + pattern), F.lit(k)).alias(n) for k, n in enumerate(names, 1)))


def outgoing(texts: DataFrame, text: str = "said") -> DataFrame:
    """Edges that texts (kind, number and others) declare: their columns without the text, then n, verb, target_kind, target_number, provision.

    A text that names itself and the number 0 make no edge.  A batch's texts
    are read together, first for their first edges, then those that have one
    for what follows it, until none has more.
    """
    kept = [f for f in texts.schema if f.name != text]
    made = [StructField("n", IntegerType()), *(StructField(c, StringType()) for c in ("verb", "target_kind", "target_number")), *_TWO]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        pattern = _named(OUTGOING, "verb", "kind", "number")
        for batch in R.chunks(batches, text):
            said, others, row, n = R.spaced(batch.column(text)), batch.drop_columns([text]), np.arange(batch.num_rows), 0
            while (m := R.places(said, pattern))["found"].any():
                on = m["found"]
                row, said = row[on], said.filter(pa.array(on))
                verb, kind, number, end = (tuple(x[on] for x in m[g]) for g in ("verb", "kind", "number", "number"))
                verb, kind, number, said = R.pieces(said, verb, kind, number, (end[1], pc.binary_length(said).to_numpy(zero_copy_only=False)))
                ahead = R.first_line(pc.utf8_slice_codeunits(said, 0, AHEAD))
                found = [R.mapped(verb, canonical_verb), R.mapped(kind, canonical_kind), number, *_provisions(ahead, True)]
                yield pa.RecordBatch.from_arrays([*others.take(pa.array(row)).columns, pa.array(np.full(len(row), n, np.int32)), *found], [*others.schema.names, *(f.name for f in made)])
                n += 1

    rows = texts.mapInArrow(run, StructType([*kept, *made]))
    rows = rows.withColumn("target_number", plain_number(F.col("target_number"))).filter("target_number IS NOT NULL")
    own = F.col("target_number").eqNullSafe(plain_number(F.col("number"))) & F.col("target_kind").eqNullSafe(F.col("kind"))
    return _provision(rows.filter(~own))


def noted(texts: DataFrame, text: str = "said") -> DataFrame:
    """Edges that notes in the changed texts (kind, number and others) name: their columns without the text, then n, source_kind, source_number, date, verb, provision."""
    found = _matches(flat(F.col(text)), NOTED, ["of_kind", "of_number", "suffix", "date", "verb", "rest"])
    rows = texts.select(*(c for c in texts.columns if c != text), F.posexplode(found).alias("n", "m"))
    whole = F.concat_ws(" ", F.col("m.of_kind"), F.nullif("m.suffix", F.lit("")))
    rows = rows.withColumns({"verb": F.col("m.verb"), "source_kind": whole, "source_number": plain_number(F.col("m.of_number")), "date": F.coalesce("m.date", F.lit("")), "_rest": F.col("m.rest")})
    rows = rows.drop("m").filter("source_number IS NOT NULL")
    canonical = {"verb": canonical_verb, "source_kind": canonical_kind}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rest, others = batch.column("_rest"), batch.drop_columns(["_rest"])
            columns = [R.mapped(x, canonical[c]) if c in canonical else x for c, x in zip(others.schema.names, others.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *_provisions(rest, False)], [*others.schema.names, "_class", "_value"])

    rows = rows.mapInArrow(run, StructType([*(f for f in rows.schema if f.name != "_rest"), *_TWO]))
    own = F.col("source_number").eqNullSafe(plain_number(F.col("number"))) & F.col("source_kind").eqNullSafe(F.col("kind"))
    return _provision(rows.filter(~own))


def with_provisions_of(passages: DataFrame, label: str = "label", said: str = "said") -> DataFrame:
    """The rows, without label and text, with own, an array of struct(class, value): the provisions that a passage is, of its article label and of the heading that it begins with."""
    ordinal = _map(ORDINALS)[T.normalise(F.regexp_extract(label, ANY + LABEL, 1))]
    of_label = F.coalesce(F.nullif(F.regexp_extract(label, "[0-9]+", 0), F.lit("")), ordinal)
    rows = passages.withColumn("_l", of_label).drop(label)
    kept = [f for f in rows.schema if f.name != said]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        pattern = _named(HEADING.replace(r"\W", f"[^{R.WORD}]"), "class", "value")
        for batch in R.chunks(batches, said):
            found = pc.extract_regex(pc.utf8_slice_codeunits(pc.utf8_ltrim(batch.column(said), " "), 0, 60), pattern)
            others, is_one = batch.drop_columns([said]), found.is_valid()
            kind, value = R.mapped(found.field("class"), lambda x: _same_class(x) if x else "numero"), R.mapped(found.field("value"), _value)
            yield pa.RecordBatch.from_arrays([*others.columns, *(pc.if_else(is_one, x, None) for x in (kind, value))], [*others.schema.names, "_class", "_value"])

    found = rows.mapInArrow(run, StructType([*kept, *_TWO]))
    both = F.array(F.struct(F.lit("articulo").alias("class"), F.col("_l").alias("value")), F.struct(F.col("_class").alias("class"), F.col("_value").alias("value")))
    return found.withColumn("own", F.array_distinct(F.filter(both, lambda p: p["value"].isNotNull()))).drop("_l", "_class", "_value")


def hits(passages: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """passages (kind, number, label, said and others), without label and text, with the edges that meet their provisions: n_hits, and hit, the first edge in order.

    edges: target_kind, target_number, provision, source (a name), verb.  They
    are summed up by provision before they meet passages, so a provision that
    many texts change is one row, and no pairs are made.  A passage is two
    provisions at most and stays one row: it meets one after the other, and
    its text is read once.
    """
    by = ["_kind", "_number", "_class", "_value"]
    own = edges.filter("provision IS NOT NULL").select(*(F.col(c).alias(n) for c, n in zip(("target_kind", "target_number", "provision.class", "provision.value"), by, strict=True)), "source", "verb", F.struct(*order).alias("_at"))
    summed = own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_at", "source", "verb")).alias("_first"))
    kept, rows = [c for c in passages.columns if c not in ("label", "said")], with_provisions_of(passages)
    for k in range(2):
        p = F.get("own", F.lit(k))
        keys = [F.col("kind"), plain_number(F.col("number")), p["class"], p["value"]]
        met = summed.select(*(F.col(c).alias(f"{c}{k}") for c in by), F.col("_n").alias(f"_n{k}"), F.col("_first").alias(f"_first{k}"))
        rows = rows.withColumns({f"_k{k}{i}": c for i, c in enumerate(keys)})
        rows = rows.join(met, [F.col(f"_k{k}{i}") == F.col(f"{c}{k}") for i, c in enumerate(by)], "left").drop(*(f"_k{k}{i}" for i in range(4)))
    n = F.coalesce("_n0", F.lit(0)) + F.coalesce("_n1", F.lit(0))
    return rows.select(*kept, n.alias("n_hits"), F.least("_first0", "_first1").alias("hit"))


def alerts(found: DataFrame, edges: DataFrame, official: str) -> DataFrame:
    """found (of hits) with an alert: of the provision, else of the norm, else of the official date, else none.

    The norm's alert names the texts that change it, in order, as far as
    NAMES_CHARS go; only the first NAMES of a norm are gathered.
    """
    names = edges.select(F.col("target_kind").alias("kind"), F.col("target_number").alias("_number"), "source").distinct()
    ranked = names.withColumn("_r", F.row_number().over(Window.partitionBy("kind", "_number").orderBy("source"))).filter(F.col("_r") <= NAMES)
    listed = ranked.groupBy("kind", "_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "source"))), lambda x: x["source"]), ", ").alias("_names"))
    rows = found.withColumn("_number", plain_number(F.col("number"))).join(listed, ["kind", "_number"], "left")
    participle = F.coalesce(_map(PARTICIPLES)[F.col("hit.verb")], F.col("hit.verb"))
    alert = (
        F.when(F.col("n_hits") > 0, F.concat(F.lit("provision "), participle, F.lit(" by "), F.col("hit.source")))
        .when(F.col("_names").isNotNull(), F.concat(F.lit("norm modified by "), F.substring("_names", 1, NAMES_CHARS)))
        .when(F.col(official).rlike(r"[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}"), F.concat(F.lit("modified on "), F.trim(official)))
        .otherwise("")
    )
    return rows.withColumn("alert", alert).drop("_names", "_number")
