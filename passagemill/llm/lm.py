"""LM scoring: stupid-backoff scores from n-gram count tables partitioned by hash.

Blocks of documents first send the leading bits of their n-grams' hashes and
learn which of them another block has; an n-gram whose bits no other has counts
what it counts in its block.  The others go out as sorted hashes with their
counts in the block, cut at the count tables' partitions; a partition sums up
what all blocks send and answers each in its order.  The join is by partition and block,
so rows are few and packed: hashes as the steps between them in as many bits as
they need, counts as a bit each where they are one.  What is moved grows with
the different n-grams of the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import table, text_bytes

ORDER, BACKOFF = 3, 0.4
#: Characters of text in a block, and of all text for each partition of the count tables.
BLOCK_CHARS, TABLE_CHARS = 8_000_000, 24_000_000
#: Characters beyond which blocks and tables grow, with the root of the size and by MOST_GROWN at most, so that a block's rows do not become slivers.
GROWING_CHARS, MOST_GROWN = 64_000_000_000, 4.0
#: Leading bits beyond those that number all n-grams: so many that few meet by chance.  What is sent depends on it, no score does.
LEADING_BITS = 2


def _gram_hashes(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 0, ..., order the hash of the n-gram that ends at each word (0 where the text has fewer words before), each word's text, and each text's first and last word."""
    import xxhash

    hashes, bounds = [], [0]
    for block in tokens.blocks(texts):
        words, offsets = tokens.words_of(block)
        coded = words.dictionary_encode()
        names = tokens.strings(coded.dictionary)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        codes = coded.indices.to_numpy()
        full = np.fromiter(map(bool, names), bool, len(names))[codes]
        hashes.append(h[codes[full]])
        ends = np.concatenate([[0], np.cumsum(full)])[offsets]
        bounds += (ends[1:] + bounds[-1]).tolist()
    bounds_, words_ = np.array(bounds), np.concatenate([*hashes, np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(len(bounds_) - 1), np.diff(bounds_))
    rank = np.arange(len(words_)) - bounds_[doc]
    grams = [np.ones(len(words_), np.uint64)]
    for n in range(1, order + 1):
        g = np.full(len(words_), n, np.uint64)
        for back in range(n - 1, -1, -1):
            g = (g ^ np.concatenate([np.zeros(back, np.uint64), words_[: len(words_) - back]])[: len(words_)]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(31)
        grams.append(np.where(rank >= n - 1, np.maximum(g, np.uint64(2)), np.uint64(0)))
    return grams, doc, bounds_


def _packed(counts: np.ndarray) -> bytes:
    """Counts of one and more: a bit each whether it is more than one, then a byte for those, then those of 255 and more in full."""
    more = counts[counts > 1]
    return np.packbits(counts > 1).tobytes() + np.minimum(more, 255).astype(np.uint8).tobytes() + more[more >= 255].astype("<u8").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    counts, at = np.ones(n, np.int64), (n + 7) // 8
    many = np.unpackbits(np.frombuffer(raw, np.uint8, at), count=n).astype(bool)
    own = np.frombuffer(raw, np.uint8, int(many.sum()), at).astype(np.int64)
    own[own == 255] = np.frombuffer(raw, "<u8", int((own == 255).sum()), at + len(own))
    counts[many] = own
    return counts


def _steps(names: np.ndarray) -> bytes:
    """Sorted hashes: the first, then the steps between them, each cut into as many low bits as its average has and the rest, which stands as so many zeros and a one."""
    step = np.diff(names)
    low = max(int(step.mean(dtype=np.float64)).bit_length() - 1, 0) if len(step) else 0
    high = (step >> np.uint64(low)).astype(np.int64)
    ones = np.zeros(int(high.sum()) + len(step), np.uint8)
    ones[np.cumsum(high) + np.arange(len(step))] = 1
    bits = np.unpackbits(step.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - low :]
    return np.array([len(names), low, names[0]], "<u8").tobytes() + np.packbits(bits).tobytes() + np.packbits(ones).tobytes()


def _names(raw: bytes) -> np.ndarray:
    n, low, first = np.frombuffer(raw, "<u8", 3).tolist()
    size = ((n - 1) * low + 7) // 8
    bits = np.zeros((n - 1, 64), np.uint8)
    bits[:, 64 - low :] = np.unpackbits(np.frombuffer(raw, np.uint8, size, 24), count=(n - 1) * low).reshape(n - 1, low)
    step = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=24 + size)))
    step += (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(low)
    return np.concatenate([np.array([first], np.uint64), step]).cumsum(dtype=np.uint64)


def backoff_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per document: key, n_words, score (the sum of its words' natural log scores), mean_score (score for each word).

    A word's score is that of the longest n-gram up to order that ends at it
    and that other documents have: its count over its context's count, times
    backoff for each word given up.  A document's own occurrences are taken off
    all counts, or it would vouch for itself.  A word that no other document has
    scores as half an occurrence.  Words are runs without ASCII white space.

    Null and empty texts have no words, score 0 and have no mean.  Rows with
    null or repeated keys are documents of their own; repeated rows vouch for
    each other.  An empty table gives an empty one.  Other columns are ignored.

    n-grams are known by hashes of 64 bits at every size of the corpus: two of
    n different ones share one with a chance of n / 2**64 each, and then their
    counts.  Counts come from all documents.  A frequent n-gram is one entry of
    a block, so no partition is hot.  A task holds a block, or a partition of
    the count tables with what is asked of it, whole; both are of a bounded size.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _, size = text_bytes(docs, text)
    grown = min(MOST_GROWN, max(1.0, (size / GROWING_CHARS) ** 0.5))
    n_blocks, n_tables = int(size / (BLOCK_CHARS * grown)) + 1, max(width, int(size / (TABLE_CHARS * grown)) + 1)
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n_blocks)).cast("int").alias("block")
    dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), block).repartition(width, "block")

    leading = min(60, max(32, int(size * (order + 1) // 6 + 1).bit_length() + LEADING_BITS))

    def cut(places: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
        """The partitions of sorted places (a hash's first 32 bits), and the span of each."""
        part = (places * np.uint64(n_tables)) >> np.uint64(32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
        spans = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
        return [int(part[a]) for a, _ in spans], spans

    def mark(rows: pa.Table) -> pa.Table:
        grams, _, _ = _gram_hashes(rows["text"].combine_chunks(), order)
        prints = np.sort(np.concatenate(grams) >> np.uint64(64 - leading))  # np.unique without counts goes by a hash table, three times slower here
        prints = prints[np.concatenate([np.ones(min(1, len(prints)), bool), prints[1:] != prints[:-1]])]
        parts, spans = cut(prints >> np.uint64(leading - 32))
        packed = [_steps(prints[a:b]) for a, b in spans]
        return pa.table({"part": pa.array(parts, pa.int32()), "block": pa.array([rows["block"][0].as_py()] * len(spans), pa.int32()), "grams": pa.array(packed, pa.binary())})

    def share(rows: pa.Table) -> pa.Table:
        prints = [_names(x) for x in rows["grams"].to_pylist()]
        _, place, n = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
        shared, cuts = (n > 1)[place], np.cumsum([0, *map(len, prints)])
        packed = [np.packbits(shared[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"part": rows["part"], "block": rows["block"], "n": pa.array(list(map(len, prints)), pa.int64()), "counts": pa.array(packed, pa.binary())})

    def open_names(names: np.ndarray, marks: pa.Table) -> np.ndarray:
        """Whether another block may have each of the sorted names."""
        marks = marks.sort_by("part")
        shared = [np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(marks["counts"].to_pylist(), marks["n"].to_pylist(), strict=True)]
        prints = names >> np.uint64(64 - leading)
        place = np.cumsum(np.concatenate([np.zeros(min(1, len(names)), int), prints[1:] != prints[:-1]])).astype(int)
        return np.concatenate([*shared, np.zeros(0, np.uint8)]).astype(bool)[place]

    def ask(rows: pa.Table, marks: pa.Table) -> pa.Table:
        grams, _, _ = _gram_hashes(rows["text"].combine_chunks(), order)
        names, counts = np.unique(np.concatenate(grams), return_counts=True)
        sent = open_names(names, marks)
        names, counts = names[sent], counts[sent]
        parts, spans = cut(names >> np.uint64(32))
        return pa.table(
            {
                "part": pa.array(parts, pa.int32()),
                "block": pa.array([rows["block"][0].as_py()] * len(spans), pa.int32()),
                "grams": pa.array([_steps(names[a:b]) for a, b in spans], pa.binary()),
                "counts": pa.array([_packed(counts[a:b]) for a, b in spans], pa.binary()),
            }
        )

    def answer(rows: pa.Table) -> pa.Table:
        grams = [_names(x) for x in rows["grams"].to_pylist()]
        counts = np.concatenate([_unpacked(x, len(g)) for x, g in zip(rows["counts"].to_pylist(), grams, strict=True)])
        every = np.concatenate(grams)
        order_ = np.argsort(every, kind="stable")
        ordered = every[order_]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        total = np.empty(len(every), np.int64)
        total[order_] = np.add.reduceat(counts[order_], np.flatnonzero(first))[np.cumsum(first) - 1]
        cuts = np.cumsum([0, *map(len, grams)])
        packed = [_packed(total[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"part": rows["part"], "block": rows["block"], "n": pa.array(list(map(len, grams)), pa.int64()), "counts": pa.array(packed, pa.binary())})

    def score(rows: pa.Table, both: pa.Table) -> pa.Table:
        grams, doc, bounds = _gram_hashes(rows["text"].combine_chunks(), order)
        n_docs, n = len(bounds) - 1, len(doc)
        sums = np.zeros(n_docs)
        if n:
            names, place, total = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            place = place.reshape(order + 1, n)
            answers = both.filter(both["answer"]).sort_by("part")
            told = [_unpacked(x, k) for x, k in zip(answers["counts"].to_pylist(), answers["n"].to_pylist(), strict=True)]
            total[open_names(names, both.filter(pc.invert(both["answer"])))] = np.concatenate([*told, np.zeros(0, np.int64)])
            # What is left of each n-gram's count without this document.
            left = []
            for k in range(order + 1):
                own_names, own, own_counts = np.unique(place[k] * np.int64(n_docs) + doc, return_inverse=True, return_counts=True)
                left.append(np.where(grams[k] > 0, total[place[k]] - own_counts[own], 0))
            # The context of the n-gram at a word is the (n-1)-gram at the word before; its own count too is without this document.
            word = np.full(n, np.nan)
            for k in range(order, 0, -1):
                before = left[0] if k == 1 else np.concatenate([[0], left[k - 1][:-1]])
                use = np.isnan(word) & (left[k] > 0)
                word[use] = np.log(left[k][use] / before[use]) + _given_up(doc, bounds, use, order, k) * np.log(backoff)
            use = np.isnan(word)
            word[use] = np.log(0.5 / np.maximum(left[0][use], 1)) + _given_up(doc, bounds, use, order, 1) * np.log(backoff)
            sums = np.add.reduceat(np.append(word, 0.0), bounds[:-1]) * (np.diff(bounds) > 0)
        return pa.table({"key": rows["key"], "n_words": pa.array(np.diff(bounds), pa.int64()), "score": pa.array(sums, pa.float64())})

    told = "part int, block int, n long, counts binary"
    marked = dealt.groupBy("block").applyInArrow(mark, "part int, block int, grams binary").groupBy("part").applyInArrow(share, told)
    asked = dealt.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(ask, "part int, block int, grams binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(answer, told)
    both = answered.withColumn("answer", F.lit(True)).unionByName(marked.withColumn("answer", F.lit(False)))
    scored = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score, "key long, n_words long, score double")
    mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_score")
    return scored.select(F.col("key").alias(key), "n_words", "score", mean)


def _given_up(doc: np.ndarray, bounds: np.ndarray, use: np.ndarray, order: int, k: int) -> np.ndarray:
    """Words of context given up where a k-gram is used: of those that stand before the word, order - 1 at most."""
    rank = np.arange(len(doc)) - bounds[doc]
    return np.minimum(rank, order - 1)[use] - (k - 1)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 6).alias("score"), F.round("mean_score", 6).alias("mean_score"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS c,
         unnest(list_prepend(NULL, w[:-2])) AS b, unnest(list_prepend(NULL, list_prepend(NULL, w[:-3]))[:len(w)]) AS a
  FROM d
), own AS (
  SELECT doc_id, i,
         count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) AS three,
         count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) AS two,
         count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS one,
         count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n
  FROM p
), c AS (
  SELECT *, lag(one) OVER w AS one_before, lag(two) OVER w AS two_before FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT doc_id, sum(CASE
    WHEN i > 2 AND three > 0 THEN ln(three / two_before)
    WHEN i > 1 AND two > 0 THEN ln(two / one_before) + ln(0.4) * least(i - 2, 1)
    WHEN one > 0 THEN ln(one / n) + ln(0.4) * least(i - 1, 2)
    ELSE ln(0.5 / greatest(n, 1)) + ln(0.4) * least(i - 1, 2) END) AS score
  FROM c GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0.0), 6) AS score,
       CASE WHEN len(w) > 0 THEN round(coalesce(score, 0.0) / len(w), 6) END AS mean_score
FROM d LEFT JOIN s USING (doc_id)
"""
