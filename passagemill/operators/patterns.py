"""Patterns over columns of texts inside tasks: Arrow's engine reads a whole batch, where a pattern of an expression is walked text by text.

The engine has no look-around, so a pattern that needs the letter before or
after it names it; classes of white space and letters are written out as
expressions have them, and in any case i has its two Turkish forms as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: White space: of ASCII, and of all languages.
BLANK, WIDE = r"\t-\r ", r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What ends a line, and letters of any language with marks, digits and joiners.
LINE_END, WORD = r"\n\r\x{85}\x{2028}\x{2029}", r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"
#: An escape, the head of a named group, a class, or a letter.
TOKEN = re.compile(r"\\[xp]\{[^}]*\}|\\.|\(\?P<\w+>|\[\^?(?:\\[xp]\{[^}]*\}|\\.|[^\]\\])*\]|.", re.S)
#: Bytes of texts that are read at once.
MOST_READ = 8_000_000
#: Partitions for each core that a costly reading of rows should have; tables of fewer parts are dealt out to twice as many.
LEAST_PER_CORE = 2


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows in parts enough for all cores: a file may be one part, whatever its size."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= LEAST_PER_CORE * cores else rows.repartition(2 * LEAST_PER_CORE * cores, key)


def in_any_case(pattern: str, wide: bool = False) -> str:
    """An expression's pattern without look-around in the engine's words; wide: white space of all languages."""
    blank = WIDE if wide else BLANK

    def one(found: re.Match) -> str:
        x = found.group()
        if x.startswith("["):
            at = 2 if x[1] == "^" else 1
            turkish = "İı" if any(i in x for i in ("i", "I", "a-z", "A-Z")) else ""
            return x[:at] + turkish + x[at:].replace(r"\s", blank)
        return f"[{blank}]" if x == r"\s" else "[iİı]" if x in "iI" else x

    return "(?i)" + TOKEN.sub(one, pattern)


def chunks(batches: Iterator, text: str) -> Iterator:
    """The batches in pieces of about MOST_READ bytes of a column of texts."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.diff(np.cumsum(size, dtype="int64") // MOST_READ, prepend=-1))
            for lo, hi in zip(first, [*first[1:], batch.num_rows], strict=True):
                yield batch.slice(lo, hi - lo)


def spaced(texts):
    """White space as single blanks."""
    import pyarrow.compute as pc

    return pc.replace_substring_regex(texts, f"[{BLANK}]+", " ")


def first_line(texts):
    """The texts up to what ends their first line."""
    import pyarrow.compute as pc

    ends = f"[{LINE_END}]"
    return pc.replace_substring_regex(texts, f"(?s){ends}.*", "") if pc.any(pc.match_substring_regex(texts, ends)).as_py() else texts


def pieces(texts, *spans) -> list:
    """Of each span (first bytes, last bytes) an array of that piece of every text; the places are between letters."""
    import numpy as np
    import pyarrow as pa

    _, offsets, data = texts.buffers()
    start = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64)
    whole = data.to_pybytes() if data else b""
    return [pa.array([whole[a:b] for a, b in zip((start + first).tolist(), (start + last).tolist(), strict=True)], pa.binary()).cast(pa.string()) for first, last in spans]


def mapped(words, f):
    """f of every word, called once for equal ones; f may give None."""
    import pyarrow as pa

    coded = words.dictionary_encode()
    return pa.array(map(f, coded.dictionary.to_pylist()), pa.string()).take(coded.indices)


def places(texts, pattern: str) -> dict:
    """Of each text's first match, bytes at which its groups begin and end (0 and 0 where a group has none), and by "found" whether there is one."""
    import numpy as np
    import pyarrow.compute as pc

    spans = pc.extract_regex_span(texts, pattern)
    found = spans.is_valid().to_numpy(zero_copy_only=False)
    out = {"found": found}
    for field in spans.type:
        child = pc.fill_null(pc.list_element(pc.struct_field(spans, field.name), 0), 0), pc.fill_null(pc.list_element(pc.struct_field(spans, field.name), 1), 0)
        at, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in child)
        out[field.name] = at, at + n
    return out
