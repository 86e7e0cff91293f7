"""Codes of law in XML: books, titles and articles of any depth, one row an article with its place in the hierarchy.

Spark's XML reader gives elements of one name without what stands above them,
so a file is walked whole in the task that has it; files are many, each a law.
"""

from __future__ import annotations

import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How the file's elements, parts and ordinals are called.
PART, PARTS, META, TEXT = "EstructuraFuncional", "EstructurasFuncionales", "Metadatos", "Texto"
BOOK, TITLE, ARTICLE, IN_FORCE = "Libro", "Título", "Artículo", "no derogado"
ROMAN = {"primero": "i", "segundo": "ii", "tercero": "iii", "cuarto": "iv", "quinto": "v", "sexto": "vi", "septimo": "vii", "octavo": "viii", "noveno": "ix", "decimo": "x"}
ORPHANS = ("final", "DISPOSICIONES FINALES")

ARTICLES = "at int, book string, book_title string, book_repealed boolean, path array<string>, number string, version string, repealed boolean, part_id string, said string"


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def book_key(title: str) -> str:
    """The number of a book in Roman digits, from its title; preliminar for such a title; else what the title begins with."""
    plain = _plain(title)
    if "preliminar" in plain:
        return "preliminar"
    words = plain.split()
    named = next((b for a, b in zip(words, words[1:], strict=False) if a == "libro"), "").strip(".,;:")
    return ROMAN.get(named) or (named if named and not named.strip("ivx") else plain[:12])


@lru_cache(4096)
def _name(tag) -> str:
    """A tag without its namespace; comments and the like have none."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _below(element: ET.Element, *names: str) -> list[ET.Element]:
    found = [element]
    for name in names:
        found = [c for x in found for c in x if _name(c.tag) == name]
    return found


def _said(element: ET.Element, *names: str) -> str:
    return " ".join((_below(element, *names) or [ET.Element("none")])[0].itertext()).strip() if names else ""


def articles(xml: str) -> Iterator[tuple]:
    """The rows of ARTICLES of one file, in its order; none of what isn't well-formed.

    A book, or a preliminary title that is in no book, is what the articles
    below it belong to and the first step of their path; a preliminary title
    within a book is a step like others.  Articles in no book are of the final
    provisions.
    """
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError):
        return
    waiting, at = [(root, None, ())], 0
    while waiting:
        element, book, path = waiting.pop()
        kind = element.get("tipoParte") or ""
        repealed = element.get("derogado", "") != IN_FORCE
        if element is not root:
            if kind == ARTICLE:
                key, title, gone = book or (*ORPHANS, False)
                number = _said(element, META, "NombreParte") or "?"
                yield at, key, title, gone, [x for x in path if x], number, element.get("fechaVersion", ""), repealed, element.get("idParte", ""), _said(element, TEXT)
                at += 1
                continue
            title = " ".join(_said(element, META, "TituloParte").split())
            if kind == BOOK or (kind == TITLE and book is None and "preliminar" in _plain(title)):
                book, path = (book_key(title), title, repealed), (title,)
            else:
                path = (*path, title)
        waiting += [(x, book, path) for x in reversed(_below(element, PARTS, PART))]


#: Articles, and characters of files, of which a task makes one batch.
MOST_ARTICLES, MOST_CHARS = 10_000, 8_000_000
SCHEMA = pa.schema([("at", pa.int32()), ("book", pa.string()), ("book_title", pa.string()), ("book_repealed", pa.bool_()), ("path", pa.list_(pa.string())), ("number", pa.string()), ("version", pa.string()), ("repealed", pa.bool_()), ("part_id", pa.string()), ("said", pa.string())])


def walker(kept: list[str], xml: str = "xml") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of files to batches of their articles, many small files' in one."""

    def made(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        each = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)]
        return pa.record_batch([*(batch[c].take(pa.array(of)) for c in kept), *each], names=[*kept, *SCHEMA.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows, held = [], [], 0
            for k, file in enumerate(batch[xml]):  # a file at a time: no more than its rows is added
                said = file.as_py() or ""
                rows.extend(articles(said))
                of.extend([k] * (len(rows) - len(of)))
                held += len(said)
                if rows and (len(rows) >= MOST_ARTICLES or held >= MOST_CHARS):
                    yield made(batch, of, rows)
                    of, rows, held = [], [], 0
            if rows:
                yield made(batch, of, rows)

    return walk


def articles_of(files: DataFrame, xml: str = "xml") -> DataFrame:
    """The other columns of files with those of ARTICLES, a row an article; null, empty and broken files have none."""
    kept = [c for c in files.columns if c != xml]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != xml)
    return files.mapInArrow(walker(kept, xml), f"{own}, {ARTICLES}" if own else ARTICLES)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """file and the columns of ARTICLES, of every XML file below a folder."""
    raw = spark.read.option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return articles_of(raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml")))
