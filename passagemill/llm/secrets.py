"""Secret scans: three patterns, and a linear-chain conditional random field over the tokens of words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secret_field, secret_lines, tokens
from .common import table

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
#: Made-up lines that the field is trained on, their seed, and training steps.
TRAINING_LINES, SEED, STEPS = 5000, 11, 110


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, in code points; matches that are too short are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


@lru_cache(maxsize=1)
def trained() -> secret_field.Field:
    """The field, trained on TRAINING_LINES made-up lines: the bound is fixed, and corpus rows play no part."""
    return secret_field.train(secret_field.examples(secret_lines.Lines(SEED).some_lines(TRAINING_LINES)), STEPS)


def field_spans(texts: pa.Array, field: secret_field.Field) -> Iterator[list[tuple[int, int]]]:
    """For each text the secrets that the field tags, in code points; null counts as empty.

    Every word of every text is decoded, with no condition on its look or length.
    """
    for block in tokens.blocks(texts):
        yield from field.spans(secret_field.words_of(block))


def _beyond(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, in order, that do not lie within one of the others."""
    out, ahead, j, reach = [], sorted(others), 0, -1
    for s, e in spans:
        while j < len(ahead) and ahead[j][0] <= s:
            reach = max(reach, ahead[j][1])
            j += 1
        if e > reach:
            out.append((s, e))
    return out


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with spans: array of (kind, start, end) in code points, by start, then kind, then end.

    Kinds are those of KINDS; a span of the field is added unless it lies within
    a span of the patterns.  Null and empty texts have none.  Every row is
    scanned whole and by itself, so repeated rows get the same spans and an
    empty table gives an empty one.  Very long texts take memory in proportion
    to their length, very long words are decoded in pieces.  Other columns are
    carried along, except one named spans.
    """
    names = [c for c in docs.columns if c != "spans"]
    at = names.index(text)
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    shared = docs.sparkSession.sparkContext.broadcast((trained().weights, trained().moves))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = secret_field.Field(*shared.value)
        for batch in batches:
            found = []
            for t, spans in zip(batch.column(at).to_pylist(), field_spans(batch.column(at), field), strict=True):
                base = base_spans(t or "")
                more = [("crf", s, e) for s, e in _beyond(spans, [(s, e) for _, s, e in base])]
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted([*base, *more], key=_order)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*(f"c{i}" for i in range(len(names))), "spans"])

    out = plain.mapInArrow(scan, ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", spans array<struct<kind: string, start: long, end: long>>")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "spans")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
