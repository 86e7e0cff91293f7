"""Readable units of legal texts, what kind of datum each has, and the one that answers, with the context that it needs.

A cut is one pattern with look-around, context a fold over the text's own
units: column expressions.  What is asked of every unit is read in tasks, all
units of a batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as T
from . import patterns as R
from .index import ACCENTS, WORD_BYTES, _stems

# Abbreviations after which a full stop ends nothing, what begins an item, how questions and data are worded.
ABBREVIATIONS = "art arts n no nº núm num res ex dto d o sr sra dr inc pág pag ej lit min máx max aprox etc ss cfr vol i ii iii".split()
LETTER = "A-Za-z0-9_ÁÉÍÓÚÜÑáéíóúüñ"
CAPITAL = r"[A-ZÁÉÍÓÚÑ¿\"“(]"
ITEM = r"(?:[0-9]{1,3}[.)]|[a-z]\)|-\s)"
START, END = f"(?<![{LETTER}])", f"(?![{LETTER}])"
NUMBER_WORD = "(?:[0-9]+(?:[.,][0-9]+)?|un|una|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|quince|veinte|veinticuatro|treinta|cuarenta|cuarenta y ocho|sesenta|setenta y dos|noventa|ciento)"
TYPES = {
    "temperatura": "temperatura|grados|°|refrigera",
    "monto": r"\bmulta|\bmonto|cuanto cuesta|\bprecio|\bvalor de\b|\barancel",
    "plazo": r"cuanto tiempo|cuant[oa]s (?:dias|horas|meses|anos|semanas)|\bplazo|\bdura\b|\bdurar|vigencia|validez|\bvalid[oa]\b|cada cuanto|frecuencia|hasta cuando|en que plazo|antelacion",
    "definicion": r"^\s*que (?:es|son)\b|que se (?:considera|entiende)|definicion|significa",
    "quien": r"^\s*(?:quien|quienes)\b|quien(?:es)? (?:puede|pueden|debe|deben)",
    "requisitos": "requisitos|que necesito|documentos",
    "permiso": r"^\s*(?:se puede|puede|pueden|puedo|es obligatori|hay que|esta permitid|esta prohibid|necesita|es necesari|se requiere|debe|deben)\b|permitid|prohibid|obligatori",
}
WORDS_OF_TYPE = {
    "plazo": "tiempo dias dia horas hora meses mes anos ano semanas semana plazo plazos dura durar duracion".split(),
    "monto": "monto cuesta valor".split(),
    "temperatura": ["grados"],
    "definicion": "definicion significa concepto".split(),
}
#: What no time limit stands behind.
NOT_AFTER = "(?<!menos de )(?<!más de )(?<!mas de )"
CUES = {
    "plazo": f"{NOT_AFTER}{START}{NUMBER_WORD}\\s*(?:\\([0-9]+\\)\\s*)?(?:horas?|d[ií]as?|mes(?:es)?|años?|semanas?){END}|{START}(?:de|en) forma inmediata|{START}inmediatamente{END}|{START}al cabo de{END}|{START}mensual|{START}anual|{START}semestral|{START}trimestral",
    "monto": f"unidad(?:es)? tributaria|{START}utm{END}|\\$\\s?[0-9]|{START}pesos{END}|ingresos? m[ií]nimos?|{START}multa de{END}",
    "temperatura": f"[0-9]+\\s*[º°]\\s*c{END}|[0-9]+\\)?\\s*(?:y|a|-)\\s*\\(?\\+?\\)?\\s*[0-9]+\\s*[º°]",
    "definicion": f":\\s|{START}es (?:todo|toda|el|la|aquel|aquella|un|una|cualquier){END}|se entender[aá] por|se denominar[aá]|{START}se considera{END}|{START}consiste en{END}|{START}es el instrumento{END}",
    "quien": f"qu[ií]mico[- ]farmac[eé]utico|{START}farmac[eé]utico|{START}profesional|{START}m[eé]dico|cirujano|odont[oó]log|matron|director t[eé]cnico|{START}titular|{START}persona",
    "requisitos": "requisitos|deber[aá]n? (?:presentar|contar|cumplir|acompañar)|siguientes (?:documentos|requisitos|antecedentes)",
    "permiso": f"{START}podr[aá]n?{END}|{START}deber[aá]n?{END}|{START}s[oó]lo{END}|{START}solamente{END}|prohib|{START}no (?:se )?podr|requerir[aá]n?|sin (?:la )?(?:debida )?autorizaci|{START}previa{END}|exclusivamente|obligatori",
}
RECITAL = r"^(?:[0-9]{1,2}[.º°-]*\s*)?(?:PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[ÉE]PTIMO|OCTAVO|NOVENO|D[ÉE]CIMO)?\s*[:.-]?\s*q?Que[, ]"
NOTES = (
    f"{START}(?:Decreto|DTO|DS|Ley)\\s+[0-9]+[\\s,]*(?:SALUD|Salud|INTERIOR|HACIENDA){END},?(?:\\s*[0-9]{{4}}\\.?-?)?",
    f"{START}D\\.O\\.\\s*[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}",
    f"{START}VER NOTA\\s*[0-9]*",
    f"{START}Art\\.\\s*(?:[0-9]+|primero|segundo|tercero|cuarto|[úu]nico|ÚNICO|UNICO)\\s*(?:N[°º]\\s*[0-9]+\\s*(?:[a-z]\\))?)?(?:\\s*[IVX]+{END})?(?:\\s*(?:[a-z]\\)\\s*)+)?(?=\\s)",
    f"{START}N[°º]\\s*[0-9]+,?\\s*(?:[a-z]\\)\\s*)+(?=\\s)",
    f"{START}SALUD,\\s*(?:[0-9]{{4}}\\.?-?\\s*)?(?:N[°º]\\s*[0-9]+,?\\s*(?:[a-z]\\)\\s*)*)?",
    f"{START}(?:Decreto|DS|DTO)\\s+[0-9]+,\\s*(?=[A-ZÁÉÍÓÚ])",
    f"{START}DS\\s+[0-9]+,(?=\\s)",
)
DATUM, OF_RECITAL, PHRASE, INTRO, SHORT = 0.3, 0.6, 420, 160, 90

#: Blanks after a stop that ends a unit: before a capital or an item, after a colon before an item only, not after an abbreviation or a single letter.
_SHORT_WORD = "|".join(ABBREVIATIONS)
CUT = rf"(?:(?<=[.;])(?<!(?<![{LETTER}º])(?i:{_SHORT_WORD}|[{LETTER}º])\.)(?=\s(?:{CAPITAL}|{ITEM}))|(?<=:)(?=\s{ITEM}))\s"
_FOLD = "(?iu)"


def units(text: Column) -> Column:
    """An array of a text's sentences and items, in order, white space as single blanks, without a heading in brackets."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    body = F.regexp_replace(flat, r"^\[[^\]]{0,300}\]\s*", "")
    return F.filter(F.transform(F.split(F.regexp_replace(body, CUT, "\u0001"), "\u0001"), lambda u: F.trim(u)), lambda u: u != "")


def question_type(question: Column) -> Column:
    """The first type whose wording the question has, else general."""
    plain = F.regexp_replace(T.normalise(question), r"^[\s¿¡\"'(]+", "")
    out = F.lit("general")
    for name, pattern in reversed(TYPES.items()):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out


def words_of_type(kind: Column) -> Column:
    """Words that only say which datum a question asks for."""
    out = F.array().cast("array<string>")
    for name, words in WORDS_OF_TYPE.items():
        out = F.when(kind == name, F.array(*map(F.lit, words))).otherwise(out)
    return out


def has_datum(unit: Column, kind: Column) -> Column:
    """Whether the unit has a datum of the type; false for general questions."""
    out = F.lit(False)
    for name, pattern in CUES.items():
        out = F.when(kind == name, unit.rlike(_FOLD + pattern)).otherwise(out)
    return out


def is_recital(unit: Column) -> Column:
    return unit.rlike(_FOLD + RECITAL)


def is_item(unit: Column) -> Column:
    return unit.rlike("^" + ITEM)


def without_notes(said: Column) -> Column:
    """A phrase without the margin notes of a consolidated text, all eight kinds; texts without their marks stay as they are."""
    out = said
    for pattern in NOTES:
        out = F.regexp_replace(out, pattern, " ")
    marked = F.contains(said, F.lit("D.O.")) | F.contains(said, F.lit("SALUD"))
    return F.when(marked, F.trim(F.regexp_replace(out, r"\s{2,}", " "))).otherwise(said)


def in_context(all_units: Column, at: Column) -> Column:
    """The unit at a place with what it needs to be read.

    An item gets the last sentence before it that introduces items; a short
    unit after a colon gets the one before; one that ends with a colon goes on
    until one doesn't, or the phrase is long enough.
    """
    own = F.get(all_units, at)
    intros = F.filter(F.slice(all_units, 1, at), lambda u: u.endswith(":") & ~is_item(u))
    intro = F.try_element_at(intros, F.lit(-1))
    last = F.when(at > 0, F.get(all_units, at - 1))
    led = F.when(is_item(own), F.when(intro.isNotNull(), F.concat(T.shorten(intro, INTRO), F.lit(" "), own)))
    led = led.when(~is_item(own) & (F.length(own) < SHORT) & last.endswith(":"), F.concat(T.shorten(last, INTRO), F.lit(" "), own))
    rest = F.slice(all_units, at + 2, F.greatest(F.size(all_units) - at - 1, F.lit(0)))
    grown = F.aggregate(rest, F.coalesce(led, own), lambda p, u: F.when(p.endswith(":") & (F.length(p) < PHRASE), F.concat(p, F.lit(" "), u)).otherwise(p))
    return T.shorten(without_notes(grown), PHRASE)


def _for_tasks(pattern: str) -> str:
    """A pattern without look-around: letters beside a match are part of it, and nothing says what it must not follow."""
    return R.in_any_case(pattern.replace(NOT_AFTER, "").replace(START, f"(?:^|[^{LETTER}])").replace(END, f"(?:$|[^{LETTER}])"))


def _have_datum(units_, kind: str):
    """Whether each unit has a datum of the type, as has_datum says."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    pattern = CUES[kind]
    found = pc.match_substring_regex(units_, _for_tasks(pattern))
    if NOT_AFTER not in pattern:
        return found
    # What may follow such words is looked at once more, with them.
    exact = re.compile(pattern.replace(r"\s", f"[{R.BLANK}]"), re.IGNORECASE)
    doubtful = pc.and_(found, pc.match_substring_regex(units_, R.in_any_case("(?:menos|más|mas) de ")))
    at = np.flatnonzero(doubtful.to_numpy(zero_copy_only=False))
    out = found.to_numpy(zero_copy_only=False).copy()
    out[at] = [exact.search(u) is not None for u in units_.take(pa.array(at)).to_pylist()]
    return pa.array(out)


def _covered(said, row, asked):
    """The share of each row's asked stems that each of its units has; said: a row's units, a line each; row: each unit's."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    # Lines of rows are one text for the letters' sake.
    plain = "\n".join(said.to_pylist()).lower()
    if not plain.isascii():
        for accented, letter in ACCENTS:
            plain = plain.replace(accented, letter)
    words = pc.ascii_split_whitespace(pa.array(plain.encode().translate(WORD_BYTES[:10] + b"\n" + WORD_BYTES[11:]).split(b"\n"), pa.string()))
    unit = np.repeat(np.arange(len(row)), words.value_lengths().to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    is_term = (pc.binary_length(vocabulary).to_numpy(zero_copy_only=False) > 1) & ~pc.is_in(vocabulary, value_set=pa.array(T.STOP_WORDS)).to_numpy(zero_copy_only=False)
    stemmed = _stems(vocabulary).dictionary_encode()
    m, stem = len(stemmed.dictionary) + 1, stemmed.indices.to_numpy(zero_copy_only=False).astype("int64")
    unit, code = unit[is_term[code]], code[is_term[code]]
    unit, stem = np.divmod(np.unique(unit * m + stem[code]), m)
    size = asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    wanted = pc.fill_null(pc.index_in(asked.flatten(), value_set=stemmed.dictionary), m - 1).to_numpy(zero_copy_only=False)
    wanted = np.repeat(np.arange(len(size)), size) * m + wanted
    hit = np.isin(row[unit] * m + stem, wanted)
    return np.bincount(unit[hit], minlength=len(row)) / np.maximum(size, 1)[row]


def _units_of(batches: Iterator) -> Iterator:
    """Batches without rows that have no unit, their units, and each unit's row; _units: a row's units, a line each."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in R.chunks(batches, "_units"):
        batch = batch.filter(pc.not_equal(batch.column("_units"), ""))
        lists = pc.split_pattern(batch.column("_units"), "\n")
        if batch.num_rows:
            yield batch, lists, lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))


def _lines(text: Column) -> Column:
    """A text's units, a line each, as they have no white space but blanks."""
    return F.array_join(units(text), "\n").alias("_units")


def data_of_types(texts: DataFrame, key: str = "id") -> DataFrame:
    """key, n, recitals and how many of a text's (said) units have a datum of each type; a text without units has no row."""
    rows = texts.select(key, _lines(F.col("said")))
    counts = ["n", "recitals", *CUES]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch, _, each, row in _units_of(batches):
            found = [pc.match_substring_regex(each, _for_tasks(RECITAL)), *(_have_datum(each, k) for k in CUES)]
            counted = [np.bincount(row[x.to_numpy(zero_copy_only=False)], minlength=batch.num_rows) for x in found]
            columns = [pa.array(c, pa.int64()) for c in (np.bincount(row), *counted)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, *counts])

    made = rows.mapInArrow(run, StructType([rows.schema[key], *(StructField(c, LongType()) for c in counts)]))
    return made.groupBy(key).agg(*(F.sum(c).alias(c) for c in counts))


def best_phrases(pairs: DataFrame, key: str = "id") -> DataFrame:
    """The unit of each text that answers its question best: key, at, coverage, datum, recital, phrase.

    pairs: key, said, kind (the question's type) and asked, the question's
    different stems.  A unit's score is the share of stems that it has, more
    with a datum of the type, less for a recital; the first of equal ones.  A
    question without stems is covered by nothing; a text without units has no
    row.  A text stays one row all the way, so nothing moves.
    """
    rows = pairs.select(key, "kind", "asked", _lines(F.col("said")))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch, lists, each, row in _units_of(batches):
            datum, kind = np.zeros(len(each), bool), batch.column("kind").dictionary_encode()
            of_unit = pc.fill_null(kind.indices, -1).to_numpy(zero_copy_only=False)[row]
            for k, name in enumerate(kind.dictionary.to_pylist()):
                if name in CUES:
                    datum[of_unit == k] = _have_datum(each.filter(pa.array(of_unit == k)), name).to_numpy(zero_copy_only=False)
            covered = _covered(batch.column("_units"), row, batch.column("asked"))
            marks = pa.StructArray.from_arrays([pa.array(covered), pa.array(datum), pc.match_substring_regex(each, _for_tasks(RECITAL))], ["coverage", "datum", "recital"])
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_units"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), marks)], [key, "_units", "marks"])

    mark = StructType([StructField("coverage", DoubleType()), StructField("datum", BooleanType()), StructField("recital", BooleanType())])
    made = rows.mapInArrow(run, StructType([rows.schema[key], StructField("_units", StringType()), StructField("marks", ArrayType(mark))]))

    def scored(x: Column, at: Column) -> Column:
        score = (x["coverage"] + F.when(x["datum"], DATUM).otherwise(0.0)) * F.when(x["recital"], OF_RECITAL).otherwise(1.0)
        return F.struct(F.round(score, 9).alias("score"), (-at).alias("before"), x.alias("mark"))

    best = made.select(key, F.split("_units", "\n").alias("units"), F.array_max(F.transform("marks", scored)).alias("b"))
    best = best.select(key, "units", (-F.col("b.before")).alias("at"), "b.mark.*")
    return best.select(key, "at", "coverage", "datum", "recital", in_context(F.col("units"), F.col("at")).alias("phrase"))
