"""Packing: vector bin packing of token pieces into sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import table

#: Tokens that a task holds before it packs them.
BUFFER_TOKENS = 4_000_000
#: A gap of fewer tokens is padded rather than filled by cutting a text.
MIN_CUT = 16
#: Share of a sequence that may be padding; emptier ones are cut to a power of two.
MOST_PADDED = 0.02
#: The query's limits on pieces and on loss-bearing tokens of a sequence of 4096.
SEGMENTS, LOSS = 16, 4032


def dot_product_pack(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of item numbers, each within all limits.

    sizes: a row per item, a column per resource; no item may exceed a limit.
    A bin takes, again and again, the fitting item with the largest dot product
    of its sizes and the bin's free room, both as shares of the limits, so an
    item that uses what is plentiful is placed first; ties go to the first item
    in order.  Items of the same sizes share one row of the search.
    """
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(kind_of.ravel(), kind="stable")
    left = np.bincount(kind_of.ravel(), minlength=len(kinds))
    at = np.concatenate([[0], np.cumsum(left)[:-1]])
    columns, share = kinds.T.copy(), (kinds / limits).T.copy()
    # An empty bin weighs all resources alike, so what bins begin with is known beforehand.
    begins = np.argsort(-share.sum(axis=0), kind="stable")
    bins, alive = [], np.arange(len(kinds))
    for k in begins:
        while left[k]:
            room, own, some, now = limits.copy(), [], alive, k
            while True:
                own.append(int(order[at[now]]))
                at[now] += 1
                left[now] -= 1
                room -= kinds[now]
                # What does not fit now will not fit into this bin later.
                fits = left[some] > 0
                for column, r in zip(columns, room, strict=True):
                    fits &= column[some] <= r
                some = some[fits]
                if not len(some):
                    break
                now = some[np.argmax(sum(x[some] * w for x, w in zip(share, room / limits, strict=True)))]
            bins.append(own)
            alive = alive[left[alive] > 0]
    return bins


def _loss(piece: tuple) -> int:
    """Loss-bearing tokens of a piece (document, start, tokens, first loss-bearing token of the document)."""
    _, start, n, free = piece
    return max(0, start + n - max(start, free))


def _take(piece: tuple, tokens_left: int, loss_left: int) -> tuple[tuple, tuple]:
    """The longest start of a piece within both, and what is left of it."""
    doc, start, n, free = piece
    cut = min(n, tokens_left, max(free - start, 0) + loss_left)
    return (doc, start, cut, free), (doc, start + cut, n - cut, free)


def _closed(own: list[tuple], most: int) -> tuple[list[tuple], list[tuple]]:
    """A bin cut down to a power of two where it would be padded much, and the pieces cut off."""
    total = sum(p[2] for p in own)
    if most - total <= MOST_PADDED * most or not total & (total - 1):
        return own, []
    kept, off, left = [], [], 1 << (total.bit_length() - 1)
    for piece in own:
        first, rest = _take(piece, left, piece[2])
        left -= first[2]
        kept += [first] if first[2] else []
        off += [rest] if rest[2] else []
    return kept, off


def _fill(bins: list[list[tuple]], limits: np.ndarray) -> list[list[tuple]]:
    """Closes the gaps that whole pieces leave: the emptiest bins are taken apart and cut to fill the others.

    Bins that a limit on segments or loss keeps from being full, and what is
    left at the end, become sequences of a power of two, which need no padding.
    """
    most, segments, loss = (int(x) for x in limits)
    held = sorted(bins, key=lambda b: -sum(p[2] for p in b))
    room = [(most - sum(p[2] for p in b), segments - len(b), loss - sum(map(_loss, b))) for b in held]
    spare: list[tuple] = []
    k, last = 0, len(held)
    while k < last:
        tokens_left, segments_left, loss_left = room[k]
        if tokens_left < MIN_CUT or not segments_left:
            k += 1
        elif not spare:
            last -= 1
            spare = list(held[last])
        else:
            piece, rest = _take(spare[-1], tokens_left, loss_left)
            if not piece[2]:
                k += 1
                continue
            spare[-1:] = [rest] if rest[2] else []
            held[k].append(piece)
            room[k] = (tokens_left - piece[2], segments_left - 1, loss_left - _loss(piece))
    full = []
    for own in held[:last]:
        kept, off = _closed(own, most)
        full.append(kept)
        spare += off
    while spare:
        own, tokens_left, loss_left = [], most, loss
        while spare and len(own) < segments:
            piece, rest = _take(spare[-1], tokens_left, loss_left)
            if not piece[2]:
                break
            spare[-1:] = [rest] if rest[2] else []
            own.append(piece)
            tokens_left, loss_left = tokens_left - piece[2], loss_left - _loss(piece)
        kept, off = _closed(own, most)
        full.append(kept)
        spare += off
    return full


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    max_tokens: int = 4096,
    max_segments: int = 512,
    max_loss: int | None = None,
    loss_role: str | None = None,
    prompt: str | None = None,
) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian u32), doc_tokens, loss, sequence_id, offset.

    Every text is encoded whole and end_id added; null counts as empty, so a
    document has one token at least.  Texts longer than a sequence are cut to
    full sequences first; the rest and all shorter ones are packed by
    dot_product_pack, and gaps are filled by cutting pieces of the emptiest
    bins.  loss_role names a boolean column that says whether a row's tokens
    bear loss (null: they do not); without it all do.  prompt names a column of
    the text's start that bears none: as many tokens as it has by itself (null:
    none).  max_loss, one at least, is the limit on tokens that bear loss,
    max_tokens if not given.  A sequence that a limit keeps from being full up
    to MOST_PADDED is cut down to a power of two.  An empty table gives no sequence; null and
    repeated keys are kept as rows of their own.  Other columns are ignored.

    A task packs what it reads, BUFFER_TOKENS at a time, so nothing is
    shuffled; its last tokens become sequences of a power of two.
    sequence_id is the task's number and the sequence's within it.
    """
    lossy = F.coalesce(F.col(loss_role), F.lit(False)) if loss_role else F.lit(True)
    start = F.col(prompt) if prompt else F.lit("")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), lossy.alias("lossy"), start.alias("prompt"))
    if max_loss is not None and max_loss < 1:
        raise ValueError("max_loss must be one at least")
    limits = np.array([max_tokens, max_segments, max_tokens if max_loss is None else max_loss])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (words,) = tokens.loaded((tokens.WordBpe, tokenizer))
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0
        for batch in batches:
            starts = words.encode(batch.column(3)) if prompt else repeat((), len(batch))
            for doc, bears, ids, first in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), words.encode(batch.column(1)), starts, strict=True):
                whole = np.append(ids, np.uint32(end_id)).astype("<u4")
                held.append((doc, min(len(first), len(ids)) if bears else len(whole), whole))
                size += len(held[-1][2])
                if size >= BUFFER_TOKENS:
                    out, sequence = _packed(held, limits, sequence)
                    yield from out
                    held, size = [], 0
        if held:
            yield from _packed(held, limits, sequence)[0]

    schema = f"`{key}` long, start long, length long, ids binary, doc_tokens long, loss long, sequence_id long, offset long"
    return rows.mapInArrow(pack, schema)


def _packed(held: list[tuple], limits: np.ndarray, sequence: int) -> tuple[list[pa.RecordBatch], int]:
    pieces, bins = [], []
    for k, (_, free, ids) in enumerate(held):
        own, rest = _take((k, 0, len(ids), free), int(limits[0]), int(limits[2]))
        while rest[2]:
            bins.append([own])
            own, rest = _take(rest, int(limits[0]), int(limits[2]))
        pieces.append(own)
    if pieces:
        bins += [[pieces[i] for i in b] for b in dot_product_pack(np.array([(p[2], 1, _loss(p)) for p in pieces]), limits)]
    done = _fill(bins, limits)
    rows, out, size = [], [], 0
    for own in done:
        offset = 0
        for piece in own:
            k, start, n, _ = piece
            doc, _, ids = held[k]
            rows.append((doc, start, n, ids[start : start + n].tobytes(), len(ids), _loss(piece), sequence, offset))
            offset += n
        sequence, size = sequence + 1, size + offset
        if size >= 2_000_000:
            out.append(_batch(rows))
            rows, size = [], 0
    if rows:
        out.append(_batch(rows))
    return out, sequence


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ("key", "start", "length", "ids", "doc_tokens", "loss", "sequence_id", "offset")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=list(_NAMES))


def pack_pieces(docs: DataFrame) -> DataFrame:
    """The contract's digest of the packing of documents, in sequences of 4096 tokens, SEGMENTS pieces and LOSS loss-bearing tokens at most.

    As in instruction data a document's first line is its prompt, which bears
    no loss; a document of one line has none.
    """
    line = F.substring_index("text", "\n", 1)
    prompts = docs.select("doc_id", "text", F.when(F.instr("text", "\n") > 0, line).alias("prompt"))
    packed = pack_documents(prompts, tokens.word_bpe_path(), end_id=2, max_segments=SEGMENTS, max_loss=LOSS, prompt="prompt")
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(table(spark, sf_dir, "documents"))
