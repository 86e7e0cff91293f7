"""A linear-chain conditional random field over the tokens of words: features, training, and decoding of whole blocks of texts.

A word is a run without white space; its tokens are runs of letters and digits,
and single signs.  White space is outside any secret, so each word is a chain of
its own.  What a token is scored by:

- its shape: length, classes of characters, changes between them, spread of
  characters, runs of consonants, and the signs around it in its word;
- the neighbouring words: hints ("password", "api_key") before and after, words
  that link a hint to its value ("is", ":=");
- the file: whether the text looks like code or configuration.

Scores are sums, so a word that stands in many places is measured once, and
each different pair of a word and its surroundings is decoded once a block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Bytes at which a longer word is cut into chains of its own; spans that meet at a cut are put together again.
LONGEST_WORD = 4096

_HINT = r"(?i)passw|passph|passcode|pwd|secret|token|api.?key|(^|[^a-z])keys?([^a-z]|$)|_key|auth|bearer|credential|private|signature|login"
_HINT_HERE = re.compile(_HINT.replace("(?i)", ""), re.IGNORECASE)
_LINK = r"(?i)^([^a-z0-9]*|is|was|are|=|:|to|ist|es|est|war|era|lautet|says|reads|set|value|in|for)[:=]?$"
#: Surroundings of a word, a bit each.
HINT_BEFORE, HINT_LINKED, HINT_NEAR, HINT_AFTER, ASSIGNED, FILE = 1, 2, 4, 8, 16, 32
_BITS = 9
_GROUPS = 13

_CLASS = np.zeros(256, np.uint8)  # 0 a sign, 1 lower, 2 upper, 3 digit, 4 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
#: Signs that stand around tokens, in groups; 0 is no sign.
_SIGN = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"=:", b"\"'`", b"/?&#", b".-_", b"@", b"+", b",;)]}>(<[{|\\", b"!$#%^*~"), 1):
    _SIGN[list(_chars)] = _k


@dataclass
class Words:
    """The words of a block of texts: where each is in the block's bytes, its text, which different word it is, and its surroundings."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    texts: np.ndarray
    different: pa.Array
    code: np.ndarray
    around: np.ndarray


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string array without nulls, and where each string begins and ends."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _many(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between each two bounds."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), bounds))


def words_of(block: pa.Array) -> Words:
    """Cuts a block (large strings, no nulls) into words and looks at their surroundings."""
    raw, texts = _bytes_of(block)
    full = ~_SPACE[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[texts] = True
    start, end = full.copy(), full.copy()
    start[1:] &= ~full[:-1] | begins[1:-1]
    end[:-1] &= ~full[1:] | begins[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = np.flatnonzero(end - start > LONGEST_WORD)
    if len(long):
        cuts = []
        for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
            at = np.arange(a + LONGEST_WORD, b, LONGEST_WORD)
            while (inside := (raw[at] & 0xC0) == 0x80).any():  # not within a character
                at = at - inside
            cuts.append(at)
        cuts = np.concatenate(cuts)
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    doc = np.searchsorted(texts, start, "right") - 1
    held = np.concatenate([[0], np.cumsum(end - start)])
    data = raw[full]
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(held.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
    different, code = coded.dictionary, coded.indices.to_numpy()

    def said(pattern: str) -> np.ndarray:
        return pc.match_substring_regex(different, pattern).to_numpy(zero_copy_only=False)[code]

    hint, link = said(_HINT), said(_LINK)
    sets = said("[:=]['\"]?$")
    n = len(code)

    def moved(flags: np.ndarray, by: int) -> np.ndarray:
        """The flags of the word so many places before (after, if negative) in the same text."""
        out = np.zeros(n, bool)
        if abs(by) >= n:
            return out
        if by > 0:
            out[by:] = flags[: n - by] & (doc[by:] == doc[: n - by])
        else:
            out[:by] = flags[-by:] & (doc[:by] == doc[-by:])
        return out

    linked = moved(link, 1) & (moved(hint, 2) | (moved(link, 2) & moved(hint, 3)))
    near, after = moved(hint, 1) | moved(hint, 2) | moved(hint, 3) | moved(hint, 4), moved(hint, -1) | moved(hint, -2) | moved(hint, -3)
    around = HINT_BEFORE * moved(hint, 1) + HINT_LINKED * linked + HINT_NEAR * near + HINT_AFTER * after + ASSIGNED * moved(sets, 1)
    size = np.maximum(np.diff(texts), 1)
    equal, colon = _many(raw == 61, texts), _many(raw == 58, texts)
    braces, lines = _many((raw == 123) | (raw == 59), texts), _many(raw == 10, texts)
    file = FILE * (equal > 0) + 2 * FILE * (braces > 0) + 4 * FILE * (100 * (equal + colon) > size) + 8 * FILE * (60 * lines > size)
    return Words(raw, start, end, doc, texts, different, code, (around + file[doc]).astype(np.int64))


@dataclass
class Tokens:
    """The tokens of different words: where each begins and ends in its word, each word's first and last, features, and a group by shape."""

    begin: np.ndarray
    stop: np.ndarray
    bounds: np.ndarray
    features: np.ndarray
    group: np.ndarray


def tokens_of(different: pa.Array) -> Tokens:
    raw, offsets = _bytes_of(different)
    kind = _CLASS[raw]
    run = kind > 0
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    start = first | ~run
    start[1:] |= ~run[:-1]
    at = np.flatnonzero(start)
    bounds = np.searchsorted(at, offsets)
    size = np.diff(np.append(at, len(raw)))
    if not len(at):
        return Tokens(at, at, bounds, np.zeros((0, _FEATURES), np.float32), at)
    word = np.repeat(np.arange(len(different)), np.diff(bounds))

    def total(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, at, dtype=np.int32)

    lower, upper, digit, odd = (total(kind == k) for k in (1, 2, 3, 4))
    letters = lower + upper
    same = ~start[1:]
    change, hump, rise = np.zeros(len(raw), bool), np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    change[1:] = same & (kind[1:] != kind[:-1])
    hump[1:] = same & (kind[:-1] == 1) & (kind[1:] == 2)
    rise[2:] = same[1:] & same[:-1] & (kind[1:-1] == 2) & (kind[2:] == 1)
    changes, humps, rises = total(change), total(hump), total(rise)
    vowel = _VOWEL[raw]
    consonant = ((kind == 1) | (kind == 2)) & ~vowel
    place = np.arange(len(raw))
    since = np.maximum.accumulate(np.where(~consonant, place, np.where(start, place - 1, -1)))
    bare = np.maximum.reduceat(np.where(consonant, place - since, 0), at)
    vowels = total(vowel)
    hexes = total(_HEX[raw])
    # How evenly the characters of a longer token are spread, in bits.
    entropy = np.zeros(len(at), np.float32)
    big = np.flatnonzero((size >= 8) & run[at])
    if len(big):
        own = np.repeat(np.arange(len(big)), size[big])
        chars = raw[np.repeat(at[big] - np.concatenate([[0], np.cumsum(size[big])[:-1]]), size[big]) + np.arange(len(own))]
        pair, n = np.unique(own * 256 + chars, return_counts=True)
        p = n / size[big][pair // 256]
        entropy[big] = np.bincount(pair // 256, -p * np.log2(p), len(big))
    r = run[at]
    inner_first, inner_last = at == offsets[word], at + size == offsets[word + 1]
    sign = np.where(r, 0, _SIGN[raw[at]])
    before, after = np.where(inner_first, 0, np.concatenate([[0], sign[:-1]])), np.where(inner_last, 0, np.concatenate([sign[1:], [0]]))
    hinted, page, account = _within(different, at, offsets, bounds)
    plain = r & (odd == 0)
    mixed = plain & (digit > 0) & (letters > 0)
    alpha = plain & (digit == 0)
    both = alpha & (humps > 0)
    group = np.select(
        [~r, odd > 0, both & (size >= 8), alpha & (upper == size) & (size >= 8), alpha & (size < 8), alpha & (size < 16), alpha & (size < 20), alpha, plain & (digit == size) & (size < 8), plain & (digit == size), mixed & (size < 8), mixed & (size < 16)],
        np.arange(12),
        12,
    )
    strong = mixed & (size >= 16)

    def ahead(by: int) -> np.ndarray:
        """Whether the token so many places on in the same word is a long mixed run."""
        out = np.zeros(len(at), bool)
        if by < len(at):
            out[:-by] = strong[by:] & (word[by:] == word[:-by])
        return out

    columns = [
        np.ones(len(at)),
        *((plain & (a <= size) & (size < b)) for a, b in ((1, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, 80), (80, 1 << 60))),
        *(group == k for k in range(_GROUPS)),
        mixed & (changes >= 3),
        mixed & (changes >= 5),
        mixed & (changes >= 8),
        mixed & (3 * changes >= size),
        mixed & (digit <= 4) & (changes <= 2),
        *(plain & (size >= 10) & (entropy >= e) for e in (2.5, 3.0, 3.5, 4.0)),
        plain & (hexes == size) & (size >= 16),
        *(plain & (bare >= b) for b in (4, 6, 8)),
        alpha & (size >= 8) & (4 * vowels < size),
        both & (humps >= 2),
        both & (humps >= 3) & (3 * (humps + rises) > size),
        both & (2 * (humps + rises) > size),
        *((before == k) & r for k in range(9)),
        *((after == k) & r for k in range(9)),
        *((sign == k) & ~r for k in range(9)),
        inner_first,
        inner_last,
        hinted & r,
        hinted & ~r & ~inner_last,
        hinted & plain & (size >= 8),
        hinted & mixed,
        page & r,
        page & ~r,
        page & mixed & (size >= 16),
        account & r,
        account & ~r,
        # A short name and a sign before a long mixed run, and a sign that ends a word after one.
        plain & (size < 8) & (after == 4) & ahead(2),
        (sign == 4) & ahead(1),
        (sign == 8) & inner_last & np.concatenate([[False], mixed[:-1]]) & ~inner_first,
        (sign == 1) & inner_last & np.concatenate([[False], strong[:-1]]) & ~inner_first,
    ]
    features = np.stack(columns, axis=1).astype(np.float32)
    begin = at - offsets[word]
    return Tokens(begin, begin + size, bounds, features, group)


_FEATURES = 1 + 8 + _GROUPS + 5 + 4 + 1 + 3 + 4 + 27 + 11 + 4


def _within(different: pa.Array, at: np.ndarray, offsets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: whether a hint ends before it in its word, whether "://" does, and whether it stands between "://user:" and "@"."""
    out = [np.zeros(len(at), bool) for _ in range(3)]
    for k in np.flatnonzero(pc.match_substring_regex(different, f"{_HINT}|://").to_numpy(zero_copy_only=False)).tolist():
        text = different[k].as_py()
        a, b = bounds[k], bounds[k + 1]
        here = at[a:b] - offsets[k]
        if (m := _HINT_HERE.search(text)) is not None:
            # A hint that ends with the sign after it, or is part of a longer name, reaches to the end of its token.
            end = len(text[: m.end()].encode())
            out[0][a:b] = here >= end
        if (i := text.find("://")) >= 0:
            i = len(text[:i].encode())
            out[1][a:b] = here >= i + 3
            body = text.encode()[i + 3 :]
            host = body.split(b"/", 1)[0]
            if b"@" in host and b":" in host.rpartition(b"@")[0]:
                out[2][a:b] = (here > i + 3 + host.index(b":")) & (here < i + 3 + host.rindex(b"@"))
    return out[0], out[1], out[2]


class Field:
    """Weights of the features, of each group's surroundings, and of the moves between tags."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def around(self) -> np.ndarray:
        """The score of each group of tokens in all surroundings: (groups, surroundings, tags)."""
        bits = (np.arange(1 << _BITS)[:, None] >> np.arange(_BITS) & 1).astype(float)
        own = self.weights[_FEATURES:].reshape(_GROUPS, _BITS, 3)
        return np.einsum("cb,gbt->gct", bits, own)

    def spans(self, words: Words) -> list[list[tuple[int, int]]]:
        """For each text of a block the secrets, in code points."""
        tokens = tokens_of(words.different)
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(words.texts) - 1)]
        if not len(words.code):
            return out
        asked, which = np.unique(words.code * np.int64(1 << _BITS) + words.around, return_inverse=True)
        code, around = asked >> _BITS, asked & ((1 << _BITS) - 1)
        length = tokens.bounds[code + 1] - tokens.bounds[code]
        ends = np.cumsum(length)
        token = np.repeat(tokens.bounds[code] - (ends - length), length) + np.arange(ends[-1])
        own = tokens.features @ self.weights[:_FEATURES].astype(np.float32)
        scores = own[token] + self.around()[tokens.group[token], np.repeat(around, length)]
        tags = decode(scores, ends - length, length, self.moves)
        hit = np.add.reduceat(tags != OUTSIDE, ends - length) > 0
        found: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(hit).tolist():
            a = int(ends[k] - length[k])
            part = token[a : int(ends[k])]
            found[k] = _spans(tags[a : int(ends[k])].tolist(), tokens.begin[part].tolist(), tokens.stop[part].tolist())
        rows = np.flatnonzero(hit[which])
        raw = words.raw
        doc, at, chars = -1, 0, 0
        for i, k, d, s in zip(rows.tolist(), which[rows].tolist(), words.doc[rows].tolist(), words.start[rows].tolist(), strict=True):
            if d != doc:
                doc, at, chars = d, int(words.texts[d]), 0
            for a, b in found[k]:
                chars += int(np.count_nonzero((raw[at : s + a] & 0xC0) != 0x80))
                more = int(np.count_nonzero((raw[s + a : s + b] & 0xC0) != 0x80))
                cut = a == 0 and i and words.end[i - 1] == words.start[i] and words.doc[i - 1] == d
                if cut and out[d] and out[d][-1][1] == chars:
                    out[d][-1] = (out[d][-1][0], chars + more)
                else:
                    out[d].append((chars, chars + more))
                at, chars = s + b, chars + more
        return out


def _spans(tags: list[int], begin: list[int], stop: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    last = OUTSIDE
    for tag, a, b in zip(tags, begin, stop, strict=True):
        if tag == BEGIN or (tag == INSIDE and last == OUTSIDE):
            out.append((a, b))
        elif tag == INSIDE:
            out[-1] = (out[-1][0], b)
        last = tag
    return out


def decode(scores: np.ndarray, first: np.ndarray, length: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of many chains by Viterbi, all chains a step at a time; before the first and after the last token stands an outside one.

    scores: a row per token, chains one after the other; first and length: each
    chain's first row and its rows, one or more.
    """
    order = np.argsort(-length, kind="stable")
    begin, size = first[order], length[order]
    best = [scores[begin, j] + moves[OUTSIDE, j] for j in range(3)]
    back: list[np.ndarray] = []
    live = len(order)
    for t in range(1, int(size[0]) if live else 0):
        live = int(np.searchsorted(-size, -t, "left"))  # chains of more than t tokens
        now, came = [], np.empty((3, live), np.uint8)
        for j in range(3):
            ways = [best[i][:live] + moves[i, j] for i in range(3)]
            top, from_ = ways[0], np.zeros(live, np.uint8)
            for i in (1, 2):
                more = ways[i] > top
                top, from_ = np.where(more, ways[i], top), np.where(more, np.uint8(i), from_)
            came[j] = from_
            now.append(top + scores[begin[:live] + t, j])
        for j in range(3):
            best[j][:live] = now[j]
        back.append(came)
    tag = np.argmax(np.stack([best[j] + moves[j, OUTSIDE] for j in range(3)]), axis=0).astype(np.uint8)
    out = np.zeros(len(scores), np.uint8)
    out[begin + size - 1] = tag
    for t in range(len(back), 0, -1):
        came = back[t - 1]
        live = came.shape[1]
        # Chains that end later have their tag at t by now.
        tag[:live] = came[tag[:live], np.arange(live)]
        out[begin[:live] + t - 1] = tag[:live]
    return out


def examples(lines: list[tuple[str, list[tuple[int, int]]]]) -> list[tuple[np.ndarray, list[int]]]:
    """Features and tags of every word of lines with their secrets (first character and the one after the last)."""
    words = words_of(pa.array([t for t, _ in lines], pa.large_string()))
    tokens = tokens_of(words.different)
    secret = [[(len(t[:a].encode()), len(t[:b].encode())) for a, b in s] for t, s in lines]
    out, bits = [], (np.arange(1 << _BITS)[:, None] >> np.arange(_BITS) & 1).astype(np.float32)
    for code, around, doc, start in zip(words.code.tolist(), words.around.tolist(), words.doc.tolist(), words.start.tolist(), strict=True):
        a, b = int(tokens.bounds[code]), int(tokens.bounds[code + 1])
        more = np.zeros((b - a, _GROUPS, _BITS), np.float32)
        more[np.arange(b - a), tokens.group[a:b]] = bits[around]
        tags, within = [], -1
        for s in (tokens.begin[a:b] + start - words.texts[doc]).tolist():
            now = next((k for k, (x, y) in enumerate(secret[doc]) if x <= s < y), -1)
            tags.append(OUTSIDE if now < 0 else INSIDE if now == within else BEGIN)
            within = now
        out.append((np.concatenate([tokens.features[a:b], more.reshape(b - a, -1)], axis=1), tags))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(chains: list[tuple[np.ndarray, list[int]]], steps: int, rate: float = 0.15, decay: float = 1e-5) -> Field:
    """Maximum likelihood with a quadratic penalty: forward-backward gradients, Adam steps, all chains each time.

    Chains with the same features and tags count as one with their number.
    """
    once: dict[tuple, list] = {}
    for x, y in chains:
        once.setdefault((x.tobytes(), tuple(y)), [x, y, 0])[2] += 1
    by_length: dict[int, list] = {}
    for x, y, n in once.values():
        by_length.setdefault(len(y), []).append((x, y, n))
    groups = [(np.stack([x for x, _, _ in own]), np.array([y for _, y, _ in own]), np.array([n for _, _, n in own], float)) for own in by_length.values()]
    width = groups[0][0].shape[2]
    total = sum(n.sum() for _, _, n in groups)
    gold = np.zeros(width * 3 + 9)
    for x, y, n in groups:
        gold[: width * 3] += (x.reshape(-1, width).T @ (np.eye(3)[y] * n[:, None, None]).reshape(-1, 3)).ravel()
        path = np.concatenate([np.zeros((len(y), 1), int), y, np.zeros((len(y), 1), int)], 1)
        gold[width * 3 :] += np.bincount((path[:, :-1] * 3 + path[:, 1:]).ravel(), np.repeat(n, path.shape[1] - 1), 9)
    w, m, v = np.zeros_like(gold), np.zeros_like(gold), np.zeros_like(gold)
    for step in range(1, steps + 1):
        weights, moves = w[: width * 3].reshape(width, 3), w[width * 3 :].reshape(3, 3)
        expected = np.zeros_like(gold)
        for x, _, n in groups:
            e = (x.reshape(-1, width) @ weights.astype(np.float32)).reshape(*x.shape[:2], 3).astype(float)
            longest = e.shape[1]
            alpha, beta = [e[:, 0] + moves[OUTSIDE]], [np.broadcast_to(moves[:, OUTSIDE], e[:, 0].shape)]
            for t in range(1, longest):
                alpha.append(_logsum(alpha[-1][:, :, None] + moves, 1) + e[:, t])
            for t in range(longest - 1, 0, -1):
                beta.append(_logsum(moves + (e[:, t] + beta[-1])[:, None, :], 2))
            beta = beta[::-1]
            all_ = _logsum(alpha[-1] + beta[-1], 1)
            chance = np.stack([np.exp(a + b - all_[:, None]) * n[:, None] for a, b in zip(alpha, beta, strict=True)], 1)
            expected[: width * 3] += (x.reshape(-1, width).T @ chance.reshape(-1, 3).astype(np.float32)).ravel()
            pair = np.zeros((3, 3))
            pair[OUTSIDE] += chance[:, 0].sum(0)
            pair[:, OUTSIDE] += chance[:, -1].sum(0)
            for t in range(1, longest):
                both = np.exp(alpha[t - 1][:, :, None] + moves + (e[:, t] + beta[t])[:, None, :] - all_[:, None, None])
                pair += (both * n[:, None, None]).sum(0)
            expected[width * 3 :] += pair.ravel()
        g = (gold - expected) / total - decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(w[: width * 3].reshape(width, 3), w[width * 3 :].reshape(3, 3))
