"""LM scoring by online logistic context mixing over the bits of tokens.

A text is a row of tokens: words of A-Z lower-cased text between ASCII white space,
then one end. The ``LEXICON`` most frequent training words, the end and escapes have
binary codes (a Huffman tree of their training counts); every other word is an escape,
then its bytes and a blank. An escape stands for the first ``HEAD`` bytes of the word, if
they are among the ``ESCAPES`` most frequent ones, or for none. So a text's score is a sum
over bits, and the probabilities of what can follow add up to one at most (a lexicon word
could be spelled too).

Each bit of a code is predicted from hashed contexts that reach across tokens: the place
in the tree alone, with the word before, and with the anchor (the most frequent of the
``REACH`` words before, which tells the kind of text). Each bit of a spelled byte is
predicted from the last 2 to 5 bytes of its word. A context predicts by the zeros and ones
that it has seen. Predictions are mixed in the logistic domain with weights that a gate
selects (what two long contexts have seen), and an adaptive map from (place, mixed
prediction) to what came true refines the result.

Learning is one pass over all training tokens. A task takes its texts step by step: it
predicts a step from what it has seen so far, moves the weights and the map by the errors,
then counts the step. Counts and maps of the tasks add up; their weights are averaged by
the number of bits. Scoring uses the state after the last step.

What is equal is computed once: a token in equal contexts of a slice, the first bits of
codes that begin alike there, a byte after equal bytes in the words of a slice.

The tables have a fixed size, so they may be broadcast. What has none, the counts of
all words, stays in Spark: words outside the lexicon are counted, spelled and joined to
the texts there, except the most frequent of them, whose prices are sent to all tasks.

Defined results: a null text is an empty one, which has the end only; with no training
document all counts are 0, every bit costs one bit and only the end and the plain escape
have codes; repeated rows are documents of their own; null doc_ids are kept; further columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.words import Words, flat_bytes, lowered, slices, slices_by, split_words, sums, texts_of
from bazaarlens.session import cut_lineage

END, RARE, FIRST = 0, 1, 2
BLANK = 0x20
LEXICON = 1 << 14
LEXICON_BYTES = 64
ESCAPES, HEAD = 1024, 3
REACH = 24
ANCHORS = 4096
# Bits of the number of a symbol: the end, the plain escape, words and escapes.
ID_BITS = (FIRST + LEXICON + ESCAPES - 1).bit_length()
# Bits of the slot numbers in the table of each context.
TOKEN_SLOTS = (17, 20, 20)
SPELL_SLOTS = (18, 19, 19, 19)
SPELL_REACH = len(SPELL_SLOTS) + 1
TOKEN_CELLS, SPELL_CELLS = 512, 256
# Words outside the lexicon that a part of the join with the texts may hold in a hash table, on average.
HASHED_WORDS = 500_000
STEP_TOKENS = 4_096
SCORED_TOKENS = 32_768
STEP_BYTES = 4_096
# Bytes of a span that is predicted together: this part of those seen before it, within bounds.
SPANS_SEEN, MOST_SPAN = 8, 1 << 17
WORD_BYTES = 1_000_000
# Words outside the lexicon whose prices are sent to all tasks, at most; the others are joined to the texts.
COMMON_WORDS = 1 << 17
# Words of slices that are added up in a task before they are handed on; rows of a batch that is handed on.
COUNTED_WORDS, OUT_ROWS = 300_000, 50_000
# Texts of a slice are split into words in parts of so many bytes: what splitting needs is a multiple of its text.
PIECE_BYTES = 500_000
BATCH_BITS = 16_384
RATE = 0.05
STEADY = 10.0
PRIOR = np.float32(0.4)
MAP_STEPS = 32
MAP_PRIOR = 30.0
LEVELS = (0.5, 2.5, 12, 100)
GATES = (len(LEVELS) + 1) ** 2
LEVEL_MASK = (1 << len(LEVELS).bit_length()) - 1
# Numbers in a shipped part of a model's state; tasks whose parts are added in one group.
CHUNK = 1 << 14
FAN_IN = 64
SHARE = 1e6
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0xD1B54A32D192ED03)


class Bits(NamedTuple):
    slots: np.ndarray  # (contexts, bits), places in the one table that holds all
    bit: np.ndarray
    cell: np.ndarray  # row of the adaptive map


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def level(seen: np.ndarray) -> np.ndarray:
    """How much a context has seen, in steps."""
    return sum((seen > v).view(np.int8) for v in LEVELS)


def gates(longer: np.ndarray, long: np.ndarray) -> np.ndarray:
    return level(longer) * np.int64(len(LEVELS) + 1) + level(long)


def places(mixed: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Places in the adaptive map."""
    step = np.minimum(np.maximum((mixed + np.float32(8)) * np.float32(MAP_STEPS / 16), np.float32(0)), np.float32(MAP_STEPS - 1))
    return cell * MAP_STEPS + step.astype(np.int64)


class Mixing:
    """Bit predictors, gated weights and adaptive map of one kind of bits."""

    def __init__(self, slot_bits: tuple[int, ...], cells: int):
        self.slot_bits = slot_bits
        self.starts = np.concatenate([[0], np.cumsum([1 << b for b in slot_bits])])
        self.counts = np.zeros((self.starts[-1], 2), np.float32)
        self.weights = np.full((GATES, len(slot_bits)), 0.4, np.float32)
        self.map = np.zeros((cells * MAP_STEPS, 2), np.float32)
        self.bits = 0

    def slots(self, contexts: Sequence[np.ndarray | None], node: np.ndarray, times: np.ndarray | int = 1) -> np.ndarray:
        """Slots of the bits at ``node`` in the contexts (hashes, or None: the node alone) of their units, each for ``times`` bits."""
        out = np.empty((len(contexts), len(node)), np.int64)
        step = node.astype(np.uint64) * np.uint64(ODD[0])
        for k, bits in enumerate(self.slot_bits):
            if contexts[k] is None:
                place = node & ((1 << bits) - 1)
            else:
                place = contexts[k] * np.uint64(ODD[0])
                place = place if len(place) == len(node) else np.repeat(place, times)
                place += step
                place >>= np.uint64(64 - bits)
            np.add(place.view(np.int64), self.starts[k], out=out[k])
        return out

    def predictions(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretched predictions, gates) from the counts."""
        seen = np.take(self.counts.view(np.float64).ravel(), slots).view(np.float32)
        gate = gates(seen[-1, ::2] + seen[-1, 1::2], seen[-2, ::2] + seen[-2, 1::2])
        seen += PRIOR
        np.log(seen, out=seen)
        return seen[:, 1::2] - seen[:, ::2], gate

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The weighted sum of the predictions, in the logistic domain."""
        total = np.zeros(len(gate), np.float32)
        for k in range(len(x)):
            total += np.take(np.ascontiguousarray(self.weights[:, k]), gate) * x[k]
        return np.clip(total, -16, 16, out=total)

    def ready(self) -> Mixing:
        """Tables that scoring reads, made from the counts: each look-up gives all that is known of a slot or a place."""
        total = self.map.sum(axis=1) + MAP_PRIOR
        # (share that came true, share left to the mixed prediction) of each place and bit.
        self.refined = np.empty((*self.map.shape, 2), np.float32)
        self.refined[..., 0], self.refined[..., 1] = self.map / total[:, None], (MAP_PRIOR / total)[:, None]
        # The stretched predictions, with the level instead of the last bits of the fraction.
        self.stretched = np.log((self.counts[:, 1] + PRIOR) / (self.counts[:, 0] + PRIOR))
        last = self.stretched.view(np.int32)
        last &= ~LEVEL_MASK
        last |= level(self.counts.sum(axis=1))
        return self

    def costs(self, bits: Bits) -> np.ndarray:
        """log10 probability of each bit; the model is ``ready``."""
        x = np.take(self.stretched, bits.slots)
        levels = x[-2:].view(np.int32) & np.int32(LEVEL_MASK)
        mixed = self.mixed(x, levels[1] * np.int64(len(LEVELS) + 1) + levels[0])
        # The probability of the bit itself, not of a one: no digits are lost in a difference.
        plain = squash(np.where(bits.bit == 1, mixed, -mixed))
        refined = np.take(self.refined.view(np.float64).ravel(), places(mixed, bits.cell) * 2 + bits.bit).view(np.float32)
        return np.log((plain + refined[::2] + refined[1::2] * plain) / 2) * np.float32(math.log10(math.e))

    def learn(self, bits: Bits, times: np.ndarray) -> None:
        """Predicts the bits from what was seen before them, then counts each ``times``."""
        self.fit(bits)
        self.count(bits, times)

    def fit(self, bits: Bits, often: np.ndarray | None = None) -> None:
        """Predicts the bits from what was counted so far, each as ``often`` as it comes (once), and moves weights and map."""
        for first in range(0, len(bits.bit), BATCH_BITS):
            at = slice(first, first + BATCH_BITS)
            bit = bits.bit[at]
            x, gate = self.predictions(bits.slots[:, at])
            mixed = self.mixed(x, gate)
            plain = squash(mixed)
            wrong, bend = bit.astype(np.float32) - plain, plain * (1 - plain)
            if often is not None:
                wrong *= often[at]
                bend *= often[at]
            for k in range(len(x)):
                slope = np.bincount(gate, weights=wrong * x[k], minlength=GATES)
                self.weights[:, k] += RATE * slope / (STEADY + np.bincount(gate, weights=bend * x[k] ** 2, minlength=GATES))
            np.add.at(self.map.reshape(-1), places(mixed, bits.cell[at]) * 2 + bit, np.float32(1) if often is None else often[at])
        self.bits += len(bits.bit) if often is None else int(often.sum(dtype=float))

    def count(self, bits: Bits, times: np.ndarray) -> None:
        flat, added = self.counts.reshape(-1), times.astype(np.float32)
        for each in bits.slots:
            np.add.at(flat, each * 2 + bits.bit, added)

    def state(self) -> np.ndarray:
        """What adds up over tasks, as one vector: counts, map, weights times bits, bits (in units of ``SHARE``)."""
        share = np.array([self.bits / SHARE])
        own = (self.weights.ravel() * share).astype(np.float32)
        return np.concatenate([self.counts.ravel(), self.map.ravel(), own, share.astype(np.float32)])

    def restored(self, state: np.ndarray) -> Mixing:
        """This model with the added-up ``state``; unchanged where no task saw a bit."""
        share = float(state[-1])
        if share > 0:
            a, b = self.counts.size, self.counts.size + self.map.size
            self.counts, self.map = state[:a].reshape(-1, 2), state[a:b].reshape(-1, 2)
            self.weights, self.bits = (state[b:-1] / share).reshape(self.weights.shape).astype(np.float32), round(share * SHARE)
        return self


class Codes:
    """Binary codes of symbols: a Huffman tree of their counts. Inner nodes are numbered from the root down."""

    def __init__(self, counts: list[int]):
        heap = [(c, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a + b, len(counts) + len(children)))
            children.append((left, right))
        paths: list[tuple[list[int], list[int]]] = [([], [])] * len(counts)
        front = [(len(counts) + len(children) - 1, [], [])]
        number = 0
        while front:
            below = []
            for at, nodes, turns in front:
                if at < len(counts):
                    paths[at] = (nodes, turns)
                    continue
                for turn, child in enumerate(children[at - len(counts)]):
                    below.append((child, [*nodes, number], [*turns, turn]))
                number += 1
            front = below
        self.lengths = np.array([len(nodes) for nodes, _ in paths], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        # Each bit of each code: twice its node, and the turn taken there.
        self.edges = np.array([2 * n + t for nodes, turns in paths for n, t in zip(nodes, turns)], np.int64)
        # Place of each symbol from left to right in the tree: codes that begin alike are neighbours.
        self.rank = np.empty(len(counts), np.int64)
        self.rank[sorted(range(len(counts)), key=lambda s: paths[s][1])] = np.arange(len(counts))

    def bits(self, model: Mixing, contexts: Sequence[np.ndarray | None], ids: np.ndarray) -> tuple[Bits, np.ndarray]:
        """(bits of the codes of ``ids`` in their ``contexts``, the token of each bit)."""
        lengths = self.lengths[ids]
        token = np.repeat(np.arange(len(ids)), lengths)
        before = np.cumsum(lengths) - lengths
        at = np.repeat(self.starts[ids] - before, lengths)
        at += np.arange(len(token))
        edge = np.take(self.edges, at)
        node = edge >> 1
        slots = model.slots(contexts, node, lengths)
        return Bits(slots, edge & 1, np.minimum(node, TOKEN_CELLS - 1)), token

    def costs(self, model: Mixing, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 probabilities of ``ids`` after their ``keys``, sorted by keys and ``rank``.

        Codes are gone through together, a bit at a time: where neighbours have the same keys and the same
        bits so far, they share a look-up."""
        out = np.zeros(len(ids))
        contexts = token_contexts(keys)
        group = np.cumsum(np.concatenate([[False], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])[: len(ids)])
        row, at, end = np.arange(len(ids)), self.starts[ids], self.starts[ids] + self.lengths[ids]
        total = np.zeros(len(ids), np.float32)
        while True:
            done = at == end
            if done.any():
                out[row[done]] = total[done]
                left = np.flatnonzero(~done)
                row, at, end, group, total = row[left], at[left], end[left], group[left], total[left]
            if not len(row):
                return out
            edge = np.take(self.edges, at)
            fresh = np.ones(len(edge) + 1, bool)
            np.not_equal(edge[1:], edge[:-1], out=fresh[1:-1])
            fresh[1:-1] |= group[1:] != group[:-1]
            bounds = np.flatnonzero(fresh)
            first = bounds[:-1]
            edge, unit = edge[first], row[first]
            node = edge >> 1
            slots = model.slots([None if c is None else c[unit] for c in contexts], node)
            costs = model.costs(Bits(slots, edge & 1, np.minimum(node, TOKEN_CELLS - 1)))
            total += np.repeat(costs, np.diff(bounds))
            at += 1


def hashed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for part, odd in zip(parts, ODD[1:]):
        out = (out ^ (out >> np.uint64(29))) + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(odd)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(ODD[0])
    return out ^ (out >> np.uint64(31))


class Lexicon(NamedTuple):
    """Words with codes of their own, heads of other words with an escape (sorted), and the codes of all symbols.

    Symbols: the end, the plain escape, the words, the escapes of the heads.
    """

    words: pa.Array
    heads: np.ndarray
    codes: Codes


def heads_of(words: pa.Array) -> np.ndarray:
    """The first ``HEAD`` bytes of each word as a number, -1 for a shorter word."""
    data, bounds = flat_bytes(words)
    full = np.flatnonzero(np.diff(bounds) >= HEAD)
    out = np.full(len(words), -1, np.int64)
    out[full] = sum(data[bounds[full] + k].astype(np.int64) << 8 * (HEAD - 1 - k) for k in range(HEAD))
    return out


def escapes_of(words: pa.Array, heads: np.ndarray) -> np.ndarray:
    """Place in ``heads`` of the head of each word, -1 where it is not there."""
    if not len(heads):
        return np.full(len(words), -1, np.int64)
    own = heads_of(words)
    at = np.minimum(np.searchsorted(heads, own), len(heads) - 1)
    return np.where(heads[at] == own, at, -1)


class Tokens(NamedTuple):
    ids: np.ndarray  # of all tokens, ends included
    offsets: np.ndarray  # text i has ids[offsets[i]:offsets[i + 1]]
    keys: np.ndarray  # (word before, anchor) of each token


def tokens_of(words: Words, lexicon: Lexicon) -> Tokens:
    """The tokens of split texts and what their contexts are made of; nothing reaches into another text."""
    known = pc.fill_null(pc.index_in(words.distinct, value_set=lexicon.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    escape = escapes_of(words.distinct, lexicon.heads)
    known = np.where(known >= 0, known + FIRST, np.where(escape >= 0, escape + FIRST + len(lexicon.words), RARE))
    ids = np.insert(known[words.codes], words.offsets[1:], END)
    offsets = words.offsets + np.arange(len(words.offsets))
    place = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
    before = np.full(len(ids), END)
    inside = np.flatnonzero(place >= 1)
    before[inside] = ids[inside - 1]
    in_lexicon = (ids >= FIRST) & (ids < FIRST + len(lexicon.words))
    lowest = np.where(in_lexicon, np.minimum(ids, ANCHORS - 1), ANCHORS - 1)
    return Tokens(ids.astype(np.int32), offsets, np.stack([before, lowest_before(lowest, place, REACH)], dtype=np.int32, casting="same_kind"))


def split_pieces(texts: pa.Array, lexicon: Lexicon) -> tuple[list[Words], Tokens]:
    """(words of each piece of at most ``PIECE_BYTES`` or of one text; the tokens of all texts)."""
    whole = pa.record_batch({"text": texts})
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    words = [split_words(lowered(part.column("text"))) for part in slices_by(whole, sizes, PIECE_BYTES)]
    parts = [tokens_of(some, lexicon) for some in words]
    lengths = np.concatenate([[0], *[np.diff(t.offsets) for t in parts]])
    ids, keys = np.concatenate([t.ids for t in parts]), np.concatenate([t.keys for t in parts], axis=1)
    return words, Tokens(ids, np.cumsum(lengths), keys)


def lowest_before(values: np.ndarray, place: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ``reach`` values before each one in its text, ``ANCHORS - 1`` where there are none.

    Windows are put together from windows of half their length."""

    def back(window: np.ndarray, by: int) -> np.ndarray:
        out = np.full(len(window), ANCHORS - 1)
        out[by:] = np.where(place[by:] >= by, window[:-by], ANCHORS - 1)
        return out

    window, width, out, done = back(values, 1), 1, np.full(len(values), ANCHORS - 1), 0
    while True:
        if reach & width:
            out = np.minimum(out, back(window, done) if done else window)
            done += width
        if done == reach:
            return out
        window, width = np.minimum(window, back(window, width)), width * 2


def distinct_tokens(tokens: Tokens, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first places of different tokens in different contexts; which of them each token is; how often each occurs).

    They are sorted by context, then by the ``rank`` of their symbol (its number)."""
    n = len(tokens.ids)
    one, anchor = tokens.keys
    packed = (anchor.astype(np.int64) << ID_BITS | one) << ID_BITS | (tokens.ids if rank is None else rank[tokens.ids])
    # Sorted with their places behind them, plain numbers sort several times faster than by ``argsort``.
    place_bits = max(1, (n - 1).bit_length())
    if 2 * ID_BITS + (ANCHORS - 1).bit_length() + place_bits < 64:
        packed <<= place_bits
        packed |= np.arange(n)
        packed.sort()
        order = packed & ((1 << place_bits) - 1)
        packed >>= place_bits
    else:
        order = np.argsort(packed, kind="stable")
        packed = packed[order]
    fresh = np.concatenate([[True], packed[1:] != packed[:-1]])[:n]
    del packed
    starts = np.flatnonzero(fresh)
    back = np.empty(n, np.int32)
    back[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return order[starts], back, np.diff(np.append(starts, n))


def token_contexts(keys: np.ndarray) -> list[np.ndarray | None]:
    one, anchor = keys
    return [None, hashed(anchor), hashed(one)]


def learn_tokens(model: Mixing, codes: Codes, tokens: Tokens) -> None:
    """Equal tokens in equal contexts are predicted once, where they come first, and counted as often as they occur."""
    chosen, _, times = distinct_tokens(tokens)
    order = np.argsort(chosen)
    chosen, times = chosen[order], times[order]
    for first in range(0, len(chosen), STEP_TOKENS):
        some = chosen[first : first + STEP_TOKENS]
        bits, token = codes.bits(model, token_contexts(tokens.keys[:, some]), tokens.ids[some])
        model.learn(bits, times[first : first + STEP_TOKENS][token])


def token_costs(model: Mixing, codes: Codes, tokens: Tokens) -> np.ndarray:
    """log10 probability of each token. Equal tokens, and equal first bits of codes, in equal contexts are looked up once."""
    chosen, back, _ = distinct_tokens(tokens, codes.rank)
    out = np.zeros(len(chosen))
    ids, keys = tokens.ids[chosen], np.stack([key[chosen] for key in tokens.keys])
    for first in range(0, len(chosen), SCORED_TOKENS):
        at = slice(first, first + SCORED_TOKENS)
        out[at] = codes.costs(model, keys[:, at], ids[at])
    return out[back]


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the words, each closed by a blank; offsets of the words; the bytes before each in its word, as one number)."""
    data, bounds = flat_bytes(words)
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    coded = np.full(len(data) + len(lengths), BLANK, np.uint8)
    coded[np.arange(len(data)) + owner] = data
    del owner
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    # 9 bits for each byte before, the nearest lowest, 0 where the word has none.
    number = coded.astype(np.int64) + 1
    before = np.zeros(len(coded), np.int64)
    starts = offsets[:-1]
    for k in range(min(SPELL_REACH, len(coded))):
        before[k + 1 :] |= number[: len(coded) - k - 1] << (9 * k)
    for k in range(SPELL_REACH):
        near = starts + k
        near = near[near < offsets[1:]]
        before[near] &= (1 << 9 * k) - 1
    return coded, offsets, before


def spelling_contexts(before: np.ndarray) -> np.ndarray:
    last = [before >> 9 * k & 511 for k in range(SPELL_REACH)]
    contexts = np.empty((SPELL_REACH - 1, len(before)), np.uint64)
    contexts[0] = hashed(last[0], last[1])
    for k in range(1, SPELL_REACH - 1):
        contexts[k] = hashed(contexts[k - 1], last[k + 1])
    return contexts


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the words, each closed by a blank; offsets of the words; contexts of the bytes)."""
    data, offsets, before = letters(words)
    return data, offsets, spelling_contexts(before)


def distinct_letters(data: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes that differ, or differ in the bytes before, where they come first; these bytes before; which of them each byte is)."""
    found = pa.array(before << 8 | data).dictionary_encode()
    distinct = found.dictionary.to_numpy()
    return (distinct & 255).astype(np.uint8), distinct >> 8, found.indices.to_numpy()


def spelled_bits(model: Mixing, data: np.ndarray, contexts: np.ndarray) -> Bits:
    """The bits of some bytes, from the highest one of each; the node is the bits of the byte so far after a one."""
    bit = np.unpackbits(data[:, None], axis=1).astype(np.int64)
    node = np.ones((len(data), 8), np.int64)
    for k in range(1, 8):
        node[:, k] = node[:, k - 1] * 2 + bit[:, k - 1]
    node = node.ravel()
    return Bits(model.slots(contexts, node, 8), bit.ravel(), node)


def learn_spelling(model: Mixing, words: pa.Array, times: np.ndarray) -> None:
    """Equal bytes after equal bytes of a span are predicted together, from what was counted before the span.

    Spans grow with what the model has seen."""
    data, offsets, before = letters(words)
    each = np.repeat(times, np.diff(offsets))
    first = 0
    while first < len(data):
        span = slice(first, first + min(MOST_SPAN, max(STEP_BYTES, model.bits // (8 * SPANS_SEEN))))
        first = span.stop
        letter, known, back = distinct_letters(data[span], before[span])
        counted = np.bincount(back, weights=each[span], minlength=len(letter))
        often = np.bincount(back, minlength=len(letter)).astype(np.float32)
        # The first letters are frequent ones, the last ones are not: every step takes its share of both.
        steps = -(-len(letter) // STEP_BYTES)
        for some in range(steps):
            at = slice(some, None, steps)
            model.fit(spelled_bits(model, letter[at], spelling_contexts(known[at])), np.repeat(often[at], 8))
        for some in range(steps):
            at = slice(some, None, steps)
            model.count(spelled_bits(model, letter[at], spelling_contexts(known[at])), np.repeat(counted[at], 8))


def spelling_costs(model: Mixing, words: pa.Array, heads: np.ndarray) -> np.ndarray:
    """log10 probability of the bytes of each word and the blank after it, without a head that its escape stands for.

    Equal bytes after equal bytes are looked up once. Steps are cut by bytes, also within a word."""
    data, offsets, before = letters(words)
    data, before, back = distinct_letters(data, before)
    costs = np.zeros(len(data))
    for first in range(0, len(data), STEP_BYTES):
        at = slice(first, first + STEP_BYTES)
        costs[at] = model.costs(spelled_bits(model, data[at], spelling_contexts(before[at]))).reshape(-1, 8).sum(axis=1)
    out = costs[back]
    told = offsets[:-1][escapes_of(words, heads) >= 0]
    for k in range(HEAD):
        out[told + k] = 0
    return sums(out, offsets)


def learned(rows: DataFrame, fresh: Callable[[], Mixing], feed: Callable[[Mixing, pa.RecordBatch], None]) -> Mixing:
    """One model out of all ``rows``: each task feeds its rows to a ``fresh`` one, the states are added up part by part.

    A state has a fixed size, and there is one for each task, so there are as many tasks as the cluster takes at once
    (twice, for balance), however many parts the input has. At most ``FAN_IN`` tasks meet in a group of the first sum,
    their sums in the second.
    """
    schema = "part int, task int, state binary"
    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fresh()
        for batch in batches:
            feed(model, batch)
        if model.bits:
            state = model.state()
            for part, first in enumerate(range(0, len(state), CHUNK)):
                yield _part(part, 0, state[first : first + CHUNK])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in parts.column("state"))
        return pa.Table.from_batches([_part(parts.column("part")[0].as_py(), parts.column("task")[0].as_py(), total)])

    states = rows.mapInArrow(run, schema).withColumn("task", (F.spark_partition_id() / FAN_IN).cast("int"))
    added = states.groupBy("part", "task").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    model = fresh()
    state = model.state()
    for row in added.collect():
        piece = np.frombuffer(row["state"], np.float32)
        state[row["part"] * CHUNK : row["part"] * CHUNK + len(piece)] = piece
    return model.restored(state)


def _part(part: int, task: int, state: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([state.astype(np.float32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "task", "state"])


def merged(parts: list[pa.Table]) -> pa.Table:
    """The sum of ``trained`` of each word."""
    return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("trained", "sum")]).rename_columns(["word", "trained"])


def count_words(rows: DataFrame) -> DataFrame:
    """(word, trained): every word and its occurrences in training documents, 0 for one that is only held out.

    A task adds up the words of some slices before it hands them on, as each slice has most of the common words again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                found = split_words(lowered(texts_of(part, "text")))
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                counts = np.bincount(found.codes[np.repeat(train, np.diff(found.offsets))], minlength=len(found.distinct))
                held.append(pa.table({"word": found.distinct.cast(pa.string()), "trained": pa.array(counts, pa.int64())}))
                size += len(found.distinct)
                if size > COUNTED_WORDS:
                    yield from merged(held).to_batches(OUT_ROWS)
                    held, size = [], 0
                    # A worker lives on for other tasks, and would keep what it needed most.
                    pa.default_memory_pool().release_unused()
        if held:
            yield from merged(held).to_batches(OUT_ROWS)

    counted = rows.select("text", "held_out").mapInArrow(run, "word string, trained long")
    return counted.groupBy("word").agg(F.sum("trained").alias("trained"))


class Common(NamedTuple):
    """Words outside the lexicon that occur most: with their counts and the price of their spelling."""

    words: pa.Array
    trained: np.ndarray
    costs: np.ndarray


def least_count(words: DataFrame, most: int) -> int | None:
    """A count that at most ``most`` of ``words`` reach, from their number on each step of a scale."""
    step = F.floor(F.log2("trained") * 4).alias("step")
    steps = words.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.min("trained").alias("least")).collect()
    least = None
    for row in sorted(steps, key=lambda row: -row["least"]):
        most -= row["n"]
        if most < 0:
            break
        least = row["least"]
    return least


def places_in(listed: pa.Array, pieces: list[Words]) -> list[np.ndarray]:
    """Place in ``listed`` of each distinct word of each piece, -1 where it is not there."""
    words = pa.concat_arrays([found.distinct for found in pieces])
    places = pc.fill_null(pc.index_in(words, value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    pa.default_memory_pool().release_unused()
    return np.split(places, np.cumsum([len(found.distinct) for found in pieces])[:-1])


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out"))
    vocabulary = cut_lineage(count_words(rows))
    n_ends = training.count()
    in_words, distinct, n_words = vocabulary.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count_if(F.col("trained") > 0), F.count(F.lit(1))).first()
    total, distinct = in_words + n_ends, distinct + (n_ends > 0)
    unseen = math.log10(total + distinct + 1)

    frequent = vocabulary.where((F.col("trained") > 1) & (F.octet_length("word") <= LEXICON_BYTES))
    listed = frequent.orderBy(F.desc("trained"), "word").limit(LEXICON).collect()
    words = pa.array([r["word"] for r in listed], pa.large_utf8())
    # The heads of the words that are spelled; the lexicon is small, so it is taken out by a join with a proven bound.
    lexicon_rows = F.broadcast(spark.createDataFrame([(r["word"],) for r in listed], "word string"))
    others = vocabulary.join(lexicon_rows, "word", "left_anti")
    head = F.hex(F.substring(F.encode("word", "UTF-8"), 1, HEAD))
    headed = others.where((F.col("trained") > 0) & (F.octet_length("word") >= HEAD)).groupBy(head.alias("head"))
    chosen = headed.agg(F.sum("trained").alias("n")).orderBy(F.desc("n"), "head").limit(ESCAPES).collect()
    heads = sorted((int(r["head"], 16), r["n"]) for r in chosen)
    in_lexicon, in_heads = sum(r["trained"] for r in listed), sum(n for _, n in heads)
    trained = np.array([n_ends, 0, *[r["trained"] for r in listed], *[0] * len(heads)], np.int64)
    codes = Codes([n_ends + 1, in_words - in_lexicon - in_heads + 1, *[r["trained"] for r in listed], *[n for _, n in heads]])
    shared_lexicon = spark.sparkContext.broadcast(Lexicon(words, np.array([h for h, _ in heads], np.int64), codes))

    def feed_tokens(model: Mixing, batch: pa.RecordBatch) -> None:
        for part in slices(batch, "text"):
            learn_tokens(model, shared_lexicon.value.codes, split_pieces(texts_of(part, "text"), shared_lexicon.value)[1])

    tokens_model = learned(training.select("text"), lambda: Mixing(TOKEN_SLOTS, TOKEN_CELLS), feed_tokens)

    def feed_spelling(model: Mixing, batch: pa.RecordBatch) -> None:
        for part in slices_by(batch, pc.binary_length(batch.column("word")).to_numpy(zero_copy_only=False), WORD_BYTES):
            learn_spelling(model, part.column("word").cast(pa.large_utf8()), part.column("trained").to_numpy())

    spread = others.repartition(spark.sparkContext.defaultParallelism, "word")
    spelling_model = learned(spread.where("trained > 0"), lambda: Mixing(SPELL_SLOTS, SPELL_CELLS), feed_spelling)
    # One for each job: a worker holds only what it uses.
    shared_tokens, shared_spelling = spark.sparkContext.broadcast(tokens_model), spark.sparkContext.broadcast(spelling_model)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_spelling.value.ready()
        for batch in batches:
            for part in slices_by(batch, pc.binary_length(batch.column("word")).to_numpy(zero_copy_only=False), WORD_BYTES):
                costs = spelling_costs(model, part.column("word").cast(pa.large_utf8()), shared_lexicon.value.heads)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(costs)], ["word", "trained", "cost"])

    price_schema = "word string, trained long, cost double"
    short = others.where((F.col("trained") > 1) & (F.octet_length("word") <= LEXICON_BYTES))
    least = least_count(short, COMMON_WORDS)
    is_common = F.lit(False) if least is None else (F.col("trained") >= least) & (F.octet_length("word") <= LEXICON_BYTES)
    table = others.where(is_common).mapInArrow(price, price_schema).toArrow()
    common_words = table.column("word").combine_chunks().cast(pa.large_utf8())
    shared_common = spark.sparkContext.broadcast(Common(common_words, table.column("trained").to_numpy(), table.column("cost").to_numpy()))
    priced = spread.where(~is_common).mapInArrow(price, price_schema)

    base_of = np.log10(trained + 1) - unseen
    spelled_from = FIRST + len(words)
    base_of[RARE] = 0
    base_of[spelled_from:] = 0
    known_of = trained > 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, common = shared_lexicon.value, shared_common.value
        common_base = np.log10(common.trained + 1) - unseen
        model = shared_tokens.value.ready()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                pieces, tokens = split_pieces(texts, lexicon)
                costs = token_costs(model, lexicon.codes, tokens)
                base, known = base_of[tokens.ids], known_of[tokens.ids]
                row = 0
                for found, listed_at in zip(pieces, places_in(common.words, pieces)):
                    n = len(found.offsets) - 1
                    here = slice(tokens.offsets[row], tokens.offsets[row + n])
                    ids, at = tokens.ids[here], tokens.offsets[row : row + n + 1] - tokens.offsets[row]
                    owner = np.repeat(np.arange(n), np.diff(at))
                    rare = np.flatnonzero((ids == RARE) | (ids >= spelled_from))
                    listed = listed_at[found.codes[rare - owner[rare]]]
                    told = np.flatnonzero(listed >= 0)
                    place, listed = here.start + rare[told], listed[told]
                    known[place] = True
                    base[place] = common_base[listed]
                    costs[place] += common.costs[listed]
                    # The other words outside the lexicon, once a text, with their number of occurrences.
                    rare = np.delete(rare, told)
                    size = max(1, len(found.distinct))
                    pairs, times = np.unique(owner[rare] * size + found.codes[rare - owner[rare]], return_counts=True)
                    bounds = np.searchsorted(pairs // size, np.arange(n + 1)).astype(np.int32)
                    spelled_words = found.distinct.take(pa.array(pairs % size)).cast(pa.string())
                    listed_words = pa.StructArray.from_arrays([spelled_words, pa.array(times, pa.int64())], ["word", "times"])
                    columns = [
                        part.column("doc_id").slice(row, n),
                        part.column("held_out").slice(row, n),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(sums(known[here].astype(float), at).astype(np.int64)),
                        pa.array(sums(base[here], at)),
                        pa.array(sums(costs[here], at)),
                        pc.binary_length(texts.slice(row, n)).cast(pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds), listed_words),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "known", "base", "cost", "n_bytes", "rare"])
                    row += n

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, cost double, n_bytes long"
    scored = rows.mapInArrow(score, f"{schema}, rare array<struct<word: string, times: long>>")
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
    # A hash table of a part's words saves the sort of all occurrences; it does not spill, so its size has a bound.
    if n_words <= HASHED_WORDS * int(spark.conf.get("spark.sql.shuffle.partitions")):
        priced = priced.hint("shuffle_hash")
    rare_words = scored.select("row", F.inline("rare")).join(priced, "word")
    rest = rare_words.groupBy("row").agg(
        F.sum(F.when(F.col("trained") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(F.col("trained") + 1) - unseen)).alias("more_base"),
        F.sum(F.col("times") * F.col("cost")).alias("more_cost"),
    )
    full = scored.drop("rare").join(rest, "row", "left")
    whole = F.col("cost") + F.coalesce(F.col("more_cost"), F.lit(0.0))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("more_known"), F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more_base"), F.lit(0.0))).alias("base_score"),
        whole.alias("score"),
        (-whole * math.log2(10) / F.greatest(F.lit(1), "n_bytes")).alias("bits_per_byte"),
    )
