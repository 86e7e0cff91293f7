"""Quality rules: word and repetition counts, and how a public vocabulary takes the text (tokeniser fertility)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import stored, table

# Where a corpus has too few texts of a group to fit its band: per language or,
# for texts without a known one, per script, the least and most characters per
# token (of either vocabulary), the most byte-fallback tokens as a share of all,
# and the least token entropy as a share of the most that so many tokens can have.
BANDS = {
    "latin": (1.2, 9.0, 0.15, 0.40),
    "greek": (0.6, 6.0, 0.60, 0.40),
    "cyrillic": (0.8, 7.0, 0.40, 0.40),
    "arabic": (0.5, 6.0, 0.80, 0.35),
    "han": (0.2, 3.0, 0.90, 0.30),
    "other": (0.2, 12.0, 1.00, 0.20),
}
#: Texts that a group needs for a band of its own; how often the quartile's distance to the median a band reaches below and above it.
LEAST_TEXTS, BELOW, ABOVE = 100, 4.0, 5.0
#: A band that texts of other lengths were fitted to widens by sqrt(1 + WIDEN / tokens): short texts scatter more.
WIDEN = 64
#: Classes of length by powers of two, the first and the last.
FIRST_CLASS, LAST_CLASS = 3, 13
_SCRIPTS = {
    "latin": re.compile("[A-Za-zÀ-ɏ]"),
    "greek": re.compile("[Ͱ-Ͽ]"),
    "cyrillic": re.compile("[Ѐ-ԯ]"),
    "arabic": re.compile("[؀-ۿ]"),
    "han": re.compile("[぀-ヿ一-鿿]"),
}
_SYMBOLS = "#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy_share double, other_chars_per_token double, script string"


def _dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def _repeat_words(words: np.ndarray, names: list[str] | pa.Array) -> int:
    """Words inside five-word windows that the text has twice or more; words: a number for each word, equal for equal words."""
    n = len(words) - 4
    if n < 2:
        return 0
    w = words.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(5):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Equal windows have equal hashes; with an equal hash at hand, windows are compared themselves.
    windows = list(zip(*(words[k : k + n].tolist() for k in range(5)), strict=True))
    counts = Counter(windows)
    hit = np.zeros(len(words), bool)
    for i, x in enumerate(windows):
        if counts[x] > 1:
            hit[i : i + 5] = True
    return int(hit.sum())


def _script(text: str) -> str:
    """The script of most letters among the first of the tables' scripts that has any; ties go in the tables' order."""
    if text.isascii():
        return "latin" if _SCRIPTS["latin"].search(text) else "other"
    n = {name: len(x.findall(text)) for name, x in _SCRIPTS.items() if x.search(text)}
    return max(n, key=n.__getitem__) if n else "other"


def measure(docs: DataFrame, vocabulary: str, other: str, text: str = "text") -> DataFrame:
    """The rows with the columns of FEATURES, measured on whole texts in one pass without a shuffle.

    vocabulary is the sentence-piece file, whose tokens give characters per
    token, byte share and entropy; other is the word vocabulary's, which gives
    other_chars_per_token.  Texts are encoded word by word.  entropy_share is
    the entropy of a text's tokens over the most that so many can have, 4,096
    at most.  A null or empty text has no words: zeros, null shares.
    """
    keep = [c for c in docs.columns]
    at = keep.index(text)
    fields = FEATURES.split(", ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, whole = tokens.loaded((tokens.PieceBpe, vocabulary), (tokens.WordBpe, other))
        for batch in batches:
            rows = [x for block in tokens.blocks(batch.column(at)) for x in _measured(block, pieces, whole)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
            made = [pa.array(x, kinds[f.split()[1]]) for x, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*(f"c{i}" for i in range(len(keep))), *(f.split()[0] for f in fields)])

    own = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    out = docs.toDF(*(f"c{i}" for i in range(len(keep)))).mapInArrow(run, f"{own}, {FEATURES}")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *(f.split()[0] for f in fields))


def _measured(block: pa.Array, pieces: tokens.PieceBpe, whole: tokens.WordBpe) -> Iterator[tuple]:
    words, offsets = tokens.words_of(block)
    coded = words.dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary
    ids, bounds, _ = pieces.gather(words, offsets)
    others = np.diff(whole.gather(words, offsets)[1])
    length = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    word = length[codes] > 0
    n_words = np.concatenate([[0], np.cumsum(word)])[offsets]
    n_chars = np.concatenate([[0], np.cumsum(length[codes])])[offsets]
    fallback = np.concatenate([[0], np.cumsum((ids >= pieces.FIRST_BYTE) & (ids <= pieces.LAST_BYTE))])[bounds]
    for i, text in enumerate(tokens.strings(block)):
        own = codes[offsets[i] : offsets[i + 1]]
        own = own[word[offsets[i] : offsets[i + 1]]]
        n = int(bounds[i + 1] - bounds[i])
        chars = int(n_chars[i + 1] - n_chars[i])
        per_token = share = entropy = None
        if n:
            per_token, share = chars / n, float(fallback[i + 1] - fallback[i]) / n
            of_id = np.bincount(ids[bounds[i] : bounds[i + 1]])
            p = of_id[of_id > 0] / n
            entropy = float(-(p * np.log2(p)).sum() / np.log2(min(n, 1 << (LAST_CLASS - 1)))) if n > 1 else 1.0
        yield (
            int(n_words[i + 1] - n_words[i]),
            chars,
            sum(map(text.count, _SYMBOLS)),
            _dup_lines(text),
            _repeat_words(own, names),
            n,
            per_token,
            share,
            entropy,
            chars / int(others[i]) if others[i] else None,
            _script(text),
        )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _group(lang: Column) -> Column:
    """The two-letter language of a text, or else its script."""
    return F.when(F.lower(lang).rlike("^[a-z][a-z]$"), F.lower(lang)).otherwise(F.col("script"))


def _length_class() -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))), F.lit(FIRST_CLASS)), F.lit(LAST_CLASS)).cast("int")


def _fixed_band() -> Column:
    """The band in BANDS of a text's script, as a struct like those of fit_bands."""
    fixed = F.create_map(*(x for k, v in BANDS.items() for x in (F.lit(k), F.array(*map(F.lit, map(float, v))))))
    b = F.element_at(fixed, F.when(F.col("script").isin(list(BANDS)), F.col("script")).otherwise("other"))
    return F.struct(b[0].alias("low"), b[1].alias("high"), b[2].alias("bytes"), b[3].alias("entropy"), b[0].alias("other_low"), b[1].alias("other_high"))


def fit_bands(measured: DataFrame, lang: str = "lang", below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """Bands of a corpus: a row per group (two-letter language, else script) and class of length, and per group (length_class null).

    band holds the medians of each figure moved by a number of quartile
    distances; spread is by how much, for texts of another length.  Every row
    with tokens counts.  Groups are at most the two-letter codes and the
    scripts, so the rows are few.  Figures are rounded to three digits, so the
    quartiles are exact from few different values and the same in each run.
    """
    figures = ("chars_per_token", "byte_share", "entropy_share", "other_chars_per_token")
    q = [F.percentile(F.round(c, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in figures]
    rows = measured.filter("n_tokens > 0").select(_group(F.col(lang)).alias("g"), _length_class().alias("length_class"), *figures)
    found = rows.rollup("g", "length_class").agg(F.count(F.lit(1)).alias("n_texts"), *q).filter("g IS NOT NULL")

    def low(c: str) -> Column:
        return below * (F.col(c)[1] - F.col(c)[0] + 0.01)

    def high(c: str) -> Column:
        return above * (F.col(c)[2] - F.col(c)[1] + 0.01)

    sides = {"low": ("chars_per_token", low, -1), "high": ("chars_per_token", high, 1), "bytes": ("byte_share", high, 1), "entropy": ("entropy_share", low, -1), "other_low": ("other_chars_per_token", low, -1), "other_high": ("other_chars_per_token", high, 1)}
    return found.select(
        "g",
        "length_class",
        "n_texts",
        F.struct(*((F.col(c)[1] + sign * side(c)).alias(k) for k, (c, side, sign) in sides.items())).alias("band"),
        F.struct(*((sign * side(c)).alias(k) for k, (c, side, sign) in sides.items())).alias("spread"),
    )


def fertility_fits(measured: DataFrame, bands: DataFrame, lang: str = "lang", least: int = LEAST_TEXTS) -> DataFrame:
    """The rows with fits: whether a text's figures lie in the band of its group and length.

    A group and class with too few texts has the group's band, widened for short
    texts; a group with too few has the fixed band of the script, widened too.
    Texts without tokens fit.  The bands, rows of codes and scripts only, go to
    every task.
    """
    enough = F.broadcast(bands.filter(F.col("n_texts") >= least))
    exact = enough.filter("length_class IS NOT NULL").select(F.col("g").alias("_g"), F.col("length_class").alias("_c"), F.col("band").alias("_exact"))
    whole = enough.filter("length_class IS NULL").select(F.col("g").alias("_h"), F.col("band").alias("_whole"), F.col("spread").alias("_spread"))
    group = _group(F.col(lang))
    rows = measured.withColumns({"_group": group, "_class": _length_class()})
    rows = rows.join(F.broadcast(exact), (F.col("_group") == F.col("_g")) & (F.col("_class") == F.col("_c")), "left").join(F.broadcast(whole), F.col("_group") == F.col("_h"), "left")
    wide = F.sqrt(1 + WIDEN / F.greatest("n_tokens", F.lit(1)))
    fixed = _fixed_band()

    def edge(name: str, low: bool) -> Column:
        own = F.col("_whole")[name] + (wide - 1) * F.col("_spread")[name]
        return F.coalesce(F.col("_exact")[name], own, fixed[name] / wide if low else fixed[name] * wide)

    fits = (
        F.col("chars_per_token").between(edge("low", True), edge("high", False))
        & (F.col("byte_share") <= edge("bytes", False))
        & (F.col("entropy_share") >= edge("entropy", True))
        & F.coalesce(F.col("other_chars_per_token").between(edge("other_low", True), edge("other_high", False)), F.lit(True))
    )
    return rows.select(*measured.columns, F.coalesce(fits, F.lit(True)).alias("fits"))


def judge(docs: DataFrame, vocabularies: tuple[str, str] | None = None, text: str = "text", lang: str = "lang", with_text: bool = True) -> DataFrame:
    """The rows with FEATURES, base_failed and kept.

    A text is kept if it has ten words or more, a fifth of its words at most
    lies in repeated five-word windows, and its fertility under both
    vocabularies fits the band of its language (of its script if that is null or
    unknown) and length.  Texts are read and encoded once: their figures are
    written to the shared folder, bands fitted to all of them, and the verdicts
    given.  Null and empty texts fail the base rules.  Repeated rows get the
    same verdict, an empty table gives an empty one, and other columns are
    carried along, the text only if wanted; those named like a feature are
    dropped.
    """
    clash = {f.split()[0] for f in FEATURES.split(", ")} | {"base_failed", "kept", "fits", "_group", "_class", "_g", "_c", "_h", "_exact", "_whole", "_spread"}
    vocabulary, other = vocabularies or (tokens.piece_bpe_path(), tokens.word_bpe_path())
    found = measure(docs.select(*(c for c in docs.columns if c not in clash)), vocabulary, other, text)
    found = stored(found if with_text else found.drop(text), "measured")
    judged = fertility_fits(found, fit_bands(found, lang), lang)
    failed = base_failed()
    return judged.withColumns({"base_failed": failed, "kept": ~failed & F.col("fits")}).drop("fits")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, with_text=False).drop("lang", "script")
