"""Text functions as column expressions: normal forms, tokens, stems, cleaning, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the index leaves out.
STOP_WORDS = """
a al algo alguna algunas alguno algunos ante antes como con contra cual cuando de del desde donde
dos el ella ellas ellos en entre era erais eran eres es esa esas ese eso esos esta estas este esto
estos fin fue fueron ha han hasta hay la las le les lo los mas más me mi mis mucho muchos muy nada ni
no nos o os otra otras otro otros para pero poco por porque que qué se sea sean segun según si sí sin
sobre su sus tan te tiene tienen toda todas todo todos tras tu tus un una unas uno unos y ya
articulo artículo art numero número norma
""".split()

# Endings that a stem drops, the first that fits.
SUFFIXES = """
amientos amiento aciones acion ancias encias ciones cion
adoras adores adora ador antes ante ables able ibles ible
aremos eremos iremos abamos amos aron ieron aban ando iendo
ados adas idos idas ado ada ido ida
mente icos icas ico ica ivos ivas ivo iva
aran aren asen ase ara are
ias ios ia io an en es os as a e o s
""".split()

# Accented letters and their plain ones.
ACCENTED = "áàâäãåāăąéèêëēĕėęěíìîïīĭįóòôöõōŏőúùûüũūŭůűñńňçćčýÿśšźžż"
PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiioooooooouuuuuuuuunnncccyysszzz"

BM25_K1, BM25_B = 1.5, 0.75


def strip_accents(c: Column) -> Column:
    """Lower case without accents; other letters stay."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def normalise(c: Column) -> Column:
    """Lower case, no accents, ordinal signs as letters; null is empty."""
    return F.translate(strip_accents(F.coalesce(c, F.lit(""))), "ºª", "oa")


def tokenize(c: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Runs of a-z and 0-9 of two characters or more, without stop words."""
    words = F.regexp_extract_all(strip_accents(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(stop_words))


def stem(t: Column) -> Column:
    """The token without the first ending in the list that leaves four characters or more; short ones and numbers stay."""
    cut = F.regexp_replace(t, f"^(.{{4,}}?)({'|'.join(SUFFIXES)})$", "$1")
    return F.when((F.length(t) <= 4) | t.rlike("^[0-9]+$"), t).otherwise(cut)


def stems(c: Column) -> Column:
    """The different stems of a text's tokens."""
    return F.array_distinct(F.transform(tokenize(c), stem))


def norm_key(c: Column) -> Column:
    """A key for comparing names: no accents, lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"\s+", " "))


def norm_number(c: Column) -> Column:
    """Upper case without points and spaces."""
    return F.translate(F.upper(F.coalesce(c, F.lit(""))), ". ", "")


def short_number(c: Column) -> Column:
    """The first run of letters, digits and letters."""
    return F.regexp_extract(norm_number(c), "[A-Z]*[0-9]+[A-Z]*", 0)


def slug(c: Column) -> Column:
    """No accents, all but a-z and 0-9 as single underscores, none at the ends."""
    return F.btrim(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def clean_html(c: Column) -> Column:
    """Text of a snippet: breaks as spaces, tags out, the usual entities, single spaces."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<br\s*/?>", " ")
    c = F.regexp_replace(c, "<[^>]+>", "")
    # The ampersand is last, or it would make new entities.
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def url_basename(c: Column) -> Column:
    """The last path part of a url: decoded, without query and fragment, lower case; undecodable ones are empty."""
    path = F.regexp_extract(F.coalesce(F.try_url_decode(c), F.lit("")), "^[^?#]*", 0)
    return F.lower(F.trim(F.substring_index(path, "/", -1)))


def clean_text(c: Column) -> Column:
    """Soft hyphens out, hard spaces as spaces, no blanks at line ends, two newlines at most together."""
    c = F.translate(F.coalesce(c, F.lit("")), " ­", " ")
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def shorten(c: Column, n: int = 420) -> Column:
    """At most n characters: cut at the last space if that is beyond 60 % of n, and marked with an ellipsis."""
    head = F.substring(c, 1, n - 1)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    body = F.when((F.instr(head, " ") > 0) & (at > n * 0.6), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(body, "[ ,;:]+$", ""), F.lit("…")))


def fingerprint(c: Column, n: int = 200) -> Column:
    """The first n letters and digits of the normal form: equal for texts that differ in signs only."""
    return F.substring(F.regexp_replace(normalise(c), "[^a-z0-9]+", ""), 1, n)


def csv_cell(c: Column) -> Column:
    """A quoted cell; one that a spreadsheet would run as a formula gets an apostrophe."""
    c = F.coalesce(c, F.lit(""))
    safe = F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def local_number(c: Column) -> Column:
    """A number with points for thousands and a comma; blank or bad is null."""
    return F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def thousands(c: Column) -> Column:
    """A whole number with points between thousands."""
    return F.translate(F.format_number(c, 0), ",", ".")


def numbers(c: Column) -> Column:
    """The different numbers in a text: thousands points out, decimal comma as a point, no leading or trailing zeros."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"([0-9])\.([0-9]{3})(?![0-9])", "$1$2")
    found = F.regexp_extract_all(F.translate(plain, ",", "."), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))

    def canonical(x: Column) -> Column:
        x = F.regexp_replace(x, "^0+([0-9])", "$1")
        return F.when(F.contains(x, F.lit(".")), F.regexp_replace(F.regexp_replace(x, "0+$", ""), "[.]$", "")).otherwise(x)

    return F.array_distinct(F.transform(found, canonical))


# Margin notes of consolidated texts.
NOTES = (
    r"\b(?:Decreto|DTO|DS|Ley)\s+[0-9]+[\s,]*(?:SALUD|Salud|INTERIOR|HACIENDA)\b,?(?:\s*[0-9]{4}\.?-?)?",
    r"\bD\.O\.\s*[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    r"\bVER NOTA\s*[0-9]*",
)


def without_notes(c: Column) -> Column:
    """A sentence without the margin notes of a consolidated text; texts without their marks stay as they are."""
    out = c
    for pattern in NOTES:
        out = F.regexp_replace(out, pattern, " ")
    return F.when(F.contains(c, F.lit("D.O.")) | F.contains(c, F.lit("SALUD")), F.trim(F.regexp_replace(out, r"\s{2,}", " "))).otherwise(c)


def safe_url(c: Column) -> Column:
    """Percent signs that start no escape, and blanks, encoded; done twice it changes nothing more."""
    return F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit(" "), F.lit("%20"))
