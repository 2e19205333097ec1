"""Byte-pair encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of every different word of a batch. A row of tokens is what merging gives
exactly if no merge ever crosses a border between two neighbours, so all adjacent pairs are tested at once, on arrays;
only words with a pair that fails are merged step by step.

Why pairs decide: up to the first merge that crosses a border every token is made as it is alone. The symbols that
meet at the border are, at each time, the right edge of the one token's tree and the left edge of the other's, so the
crossing depends on the two tokens alone. This needs merges that come after those that make their parts, one merge for
each token, and all single bytes; a file without these properties is merged step by step throughout.

The file is a ``tokenizer.json`` with a BPE model over the byte alphabet. Read are the normalizers NFC, Lowercase and
Replace, the splits by a pattern whose matches are kept, and the decoders ByteLevel or none (tokens joined by blanks).
Special tokens standing in a text are found before it is normalised. Letters and lower case follow the ``regex``
module and Python: characters younger than Unicode 15.1 may be split otherwise than by another library's tables.

Defined results: null text gives null ids and null ids null text; an empty text has no ids. Ids that the file does not
have are skipped in decoding. Repeated rows and extra columns pass through; an input column that is named like the
output is replaced. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.llm.sentencepiece import Trie, build_trie
from bazaarlens.llm.words import flat_bytes, slices_by, texts_of

# Fixed value: the pattern of byte-level files that split by themselves.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.iinfo(np.int64).max
# Bytes of text, and ids, that are worked on at once (one row at least).
SLICE_BYTES = 1_500_000
SLICE_IDS = 500_000
# Words whose proposals are still open are walked together down to so many, then one by one.
TOGETHER = 32
# Failing words up to so many bytes are merged together, a step of each at a time; longer ones alone, to the same result.
MERGED_TOGETHER = 64


def byte_alphabet() -> dict[str, int]:
    """The byte of each character by which byte-level files write it: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """``spelled`` finds byte strings; ``inner`` and ``last`` give the id of string i inside a word and at its end, or -1.

    ``left``, ``right`` and ``made`` are the parts of each token and the rank of the merge that makes it (-1: a byte).
    ``pairs``, ``ranks`` and ``wholes`` are the merges by key of the pair, ``merges`` the same as a dictionary.
    """

    tokens: tuple[str, ...]
    raw: tuple[bytes, ...]
    spelled: Trie
    inner: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    wholes: np.ndarray
    merges: dict[tuple[int, int], tuple[int, int]]
    ordered: bool
    steps: tuple[tuple[str, str, str], ...]
    pattern: str
    specials: dict[str, int]
    joined: bool


def _steps(normalizer: dict | None) -> tuple[tuple[str, str, str], ...]:
    parts = [] if normalizer is None else normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]
    out = []
    for part in parts:
        if part["type"] == "Replace":
            kind, what = next(iter(part["pattern"].items()))
            out.append(("replace", what if kind == "Regex" else regex.escape(what), part["content"]))
        elif part["type"] in ("NFC", "Lowercase"):
            out.append((part["type"], "", ""))
        else:
            raise ValueError(f"normalizer {part['type']} is not known")
    return tuple(out)


def _pattern(splitter: dict) -> str:
    parts = splitter["pretokenizers"] if splitter["type"] == "Sequence" else [splitter]
    *splits, last = parts
    if last["type"] != "ByteLevel" or last["add_prefix_space"] or len(splits) > 1:
        raise ValueError("the file must split at most once and end with the byte level, without a prefix blank")
    if not splits:
        return BYTE_LEVEL_PATTERN if last["use_regex"] else r"(?s:.+)"
    split = splits[0]
    if last["use_regex"] or split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError("only splits that keep the matches of a pattern are known")
    return split["pattern"]["Regex"]


def load_vocabulary(path: str) -> Vocabulary:
    """Reads the file on the driver; its size bounds what is sent to tasks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("the file's model is not plain byte-pair encoding")
    decoder = (spec.get("decoder") or {"type": None})["type"]
    if decoder not in (None, "ByteLevel"):
        raise ValueError(f"decoder {decoder} is not known")
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("only added tokens that stand in the text as they are are known")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return make_vocabulary(
        model["vocab"], merges, model.get("end_of_word_suffix") or "", _steps(spec.get("normalizer")),
        _pattern(spec["pre_tokenizer"]), specials, decoder is None,
    )


def make_vocabulary(
    vocab: dict[str, int],
    merges: list[tuple[str, str]],
    suffix: str,
    steps: tuple[tuple[str, str, str], ...] = (),
    pattern: str = BYTE_LEVEL_PATTERN,
    specials: dict[str, int] | None = None,
    joined: bool = False,
) -> Vocabulary:
    """``suffix`` marks tokens that end a word; without one, a token is the same inside a word and at its end."""
    specials = specials or {}
    if any(regex.fullmatch(pattern, s) for s in specials):
        raise ValueError("a special token could be a word of a text")
    size = max([*vocab.values(), *specials.values()]) + 1
    alphabet = byte_alphabet()
    tokens, raw = [""] * size, [b""] * size
    strings: dict[bytes, int] = {}
    inner, last = [], []
    for token, i in vocab.items():
        tokens[i] = token
        if token in specials:
            raw[i] = token.encode()
            continue
        ends = bool(suffix) and token.endswith(suffix)
        raw[i] = bytes(alphabet[c] for c in (token[: -len(suffix)] if ends else token))
        at = strings.setdefault(raw[i], len(strings))
        if at == len(inner):
            inner.append(-1)
            last.append(-1)
        if ends or not suffix:
            last[at] = i
        if not ends:
            inner[at] = i
    for token, i in specials.items():
        tokens[i], raw[i] = token, token.encode()
    left, right, made = np.full(size, -1), np.full(size, -1), np.full(size, -1)
    by_pair = {}
    for rank, (a, b) in enumerate(merges):
        whole = vocab[a + b]
        by_pair[vocab[a], vocab[b]] = (rank, whole)
        left[whole], right[whole], made[whole] = vocab[a], vocab[b], rank
    pairs = np.array([a * size + b for a, b in by_pair], np.int64)
    ranks, wholes = np.array([*by_pair.values()], np.int64).reshape(-1, 2).T
    order = np.argsort(pairs)
    inner, last = np.array(inner, np.int64), np.array(last, np.int64)
    bytes_known = [strings.get(bytes([b]), -1) for b in range(256)]
    if min(bytes_known) < 0 or (inner[bytes_known] < 0).any() or (last[bytes_known] < 0).any():
        raise ValueError("the vocabulary lacks single bytes")
    merged = made >= 0
    ordered = bool(
        len({whole for _, whole in by_pair.values()}) == len(merges)
        and (np.maximum(made[left[merged]], made[right[merged]]) < made[merged]).all()
        # Every other token must be a single byte, or greedy matching could propose what no merge makes.
        and all(len(raw[i]) == 1 for t, i in vocab.items() if made[i] < 0 and t not in specials)
    )
    return Vocabulary(
        tuple(tokens), tuple(raw), build_trie(strings), inner, last, left, right, made, pairs[order], ranks[order],
        wholes[order], by_pair, ordered, steps, pattern, specials, joined,
    )


def _normalised(vocabulary: Vocabulary, text: str) -> str:
    for kind, what, by in vocabulary.steps:
        if kind == "NFC":
            text = text if text.isascii() else unicodedata.normalize("NFC", text)
        elif kind == "Lowercase":
            text = text.replace("Σ", "σ").lower()  # each character alone: no form of its own at a word's end
        else:
            text = regex.sub(what, by.replace("\\", "\\\\"), text)
    return text


def split_text(vocabulary: Vocabulary, text: str) -> list[str]:
    """Words of ``text``; special tokens stand among them as they are."""
    find = regex.compile(vocabulary.pattern).findall
    if not any(s in text for s in vocabulary.specials):
        return find(_normalised(vocabulary, text))
    longest_first = sorted(vocabulary.specials, key=len, reverse=True)
    words = []
    for part in regex.split("(" + "|".join(map(regex.escape, longest_first)) + ")", text):
        words += [part] if part in vocabulary.specials else find(_normalised(vocabulary, part))
    return words


def _longest(vocabulary: Vocabulary, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and end of the longest token from every byte on; the walk goes one byte further from all places at once."""
    trie = vocabulary.spelled
    best, stop = np.full(len(data), -1), np.zeros(len(data), np.int64)
    origin = np.arange(len(data))
    at, node = origin.copy(), np.zeros(len(data), np.int64)
    while len(at):
        slot = trie.base[node] + data[at] + 1
        alive = trie.check[slot] == node
        node, at, origin = slot[alive], at[alive] + 1, origin[alive]
        string = trie.value[node]
        token = np.where(string < 0, -1, np.where(at == ends[origin], vocabulary.last[string], vocabulary.inner[string]))
        hit = token >= 0
        best[origin[hit]], stop[origin[hit]] = token[hit], at[hit]
        more = at < ends[origin]
        node, at, origin = node[more], at[more], origin[more]
    return best, stop


def propose(vocabulary: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy longest match: (word, id) of the proposed tokens in order."""
    lengths = np.diff(bounds)
    best, stop = _longest(vocabulary, data, np.repeat(bounds[1:], lengths))
    words, places = [], []
    word = np.flatnonzero(lengths > 0)
    at = bounds[:-1][word]
    while len(word) > TOGETHER:
        words.append(word)
        places.append(at)
        at = stop[at]
        open_ = at < bounds[1:][word]
        word, at = word[open_], at[open_]
    for w, p in zip(word.tolist(), at.tolist()):
        walked, end = [], int(bounds[w + 1])
        while p < end:
            walked.append(p)
            p = int(stop[p])
        words.append(np.full(len(walked), w))
        places.append(np.array(walked, np.int64))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, place = np.concatenate(words), np.concatenate(places)
    order = np.argsort(place)
    return word[order], best[place[order]]


def _rank_of(vocabulary: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the merge of each pair, ``NEVER`` without one."""
    if not len(vocabulary.pairs):
        return np.full(len(a), NEVER)
    key = a * len(vocabulary.tokens) + b
    at = np.minimum(np.searchsorted(vocabulary.pairs, key), len(vocabulary.pairs) - 1)
    return np.where(vocabulary.pairs[at] == key, vocabulary.ranks[at], NEVER)


def compatible(vocabulary: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the bytes of a and b gives these two tokens again, for all pairs at once.

    Goes back in time from the whole tokens: of the two symbols at the border the one made later is undone. A symbol
    lives until the merge that uses it. Among equal merges the leftmost comes first, so one that uses the left
    symbol goes before a crossing of the same rank, and one that uses the right symbol after it.
    """
    good = np.ones(len(a), bool)
    todo, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
    x_until, y_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
    while len(todo):
        rank = _rank_of(vocabulary, x, y)
        crosses = (rank < x_until) & (rank <= y_until) & (rank < NEVER)
        good[todo[crosses]] = False
        made_x, made_y = vocabulary.made[x], vocabulary.made[y]
        on = ~crosses & ((made_x >= 0) | (made_y >= 0))
        todo, x, y, x_until, y_until, made_x, made_y = (v[on] for v in (todo, x, y, x_until, y_until, made_x, made_y))
        undo_x = made_x > made_y
        x, x_until = np.where(undo_x, vocabulary.right[x], x), np.where(undo_x, made_x, x_until)
        y, y_until = np.where(undo_x, y, vocabulary.left[y]), np.where(undo_x, y_until, made_y)
    return good


def merge_exactly(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """Merging step by step: the lowest rank first, the leftmost of equal ones."""
    if not word:
        return []
    one = vocabulary.spelled.value[vocabulary.spelled.base[0] + np.frombuffer(word, np.uint8).astype(np.int64) + 1]
    symbols = [*vocabulary.inner[one[:-1]].tolist(), int(vocabulary.last[one[-1]])]
    before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    queue = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] >= 0 and (found := vocabulary.merges.get((symbols[at], symbols[after[at]]))):
            queue.append((found[0], at, found[1], symbols[at], symbols[after[at]]))

    for at in range(len(symbols)):
        offer(at)
    heapq.heapify(queue)
    while queue:
        _, at, whole, a, b = heapq.heappop(queue)
        right = after[at]
        if symbols[at] != a or right < 0 or symbols[right] != b:
            continue
        symbols[at], symbols[right] = whole, -1
        after[at] = after[right]
        if after[at] >= 0:
            before[after[at]] = at
        seen = len(queue)
        offer(before[at])
        offer(at)
        fresh = queue[seen:]
        del queue[seen:]
        for entry in fresh:
            heapq.heappush(queue, entry)
    return [s for s in symbols if s >= 0]


def merge_together(vocabulary: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, id) in order of the same merging, one step of every word at a time. No word may be empty."""
    size = len(vocabulary.tokens)
    one = vocabulary.spelled.value[vocabulary.spelled.base[0] + data.astype(np.int64) + 1]
    symbol = vocabulary.inner[one]
    symbol[bounds[1:] - 1] = vocabulary.last[one[bounds[1:] - 1]]
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def ranks(at: np.ndarray) -> np.ndarray:
        """Rank of each symbol with the next one of its word."""
        out = np.full(len(at), NEVER)
        inside = at + 1 < len(symbol)
        inside[inside] = word[at[inside]] == word[at[inside] + 1]
        out[inside] = _rank_of(vocabulary, symbol[at[inside]], symbol[at[inside] + 1])
        return out

    rank = ranks(np.arange(len(symbol)))
    done = []
    while len(symbol):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        lowest = np.minimum.reduceat(rank, starts)
        spans = np.diff(np.append(starts, len(symbol)))
        open_ = np.repeat(lowest < NEVER, spans)
        if not open_.all():
            done.append((word[~open_], symbol[~open_]))
            symbol, word, rank = symbol[open_], word[open_], rank[open_]
            continue
        hits = np.flatnonzero(rank == np.repeat(lowest, spans))
        at = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]  # the leftmost of each word
        symbol[at] = vocabulary.wholes[np.searchsorted(vocabulary.pairs, symbol[at] * size + symbol[at + 1])]
        kept = np.ones(len(symbol), bool)
        kept[at + 1] = False
        symbol, word, rank = symbol[kept], word[kept], rank[kept]
        at = at - np.arange(len(at))  # each word has lost one symbol, those before it too
        touched = np.concatenate([at, at[at > 0] - 1])
        rank[touched] = ranks(touched)
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, symbol = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return word[order], symbol[order]


def _exact(vocabulary: Vocabulary, data: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> pa.ListArray:
    """Ids of the failing ``words``."""
    lengths = bounds[words + 1] - bounds[words]
    short = (lengths > 0) & (lengths <= MERGED_TOGETHER)
    ends = np.concatenate([[0], np.cumsum(lengths[short])])
    place = np.repeat(bounds[words[short]] - ends[:-1], lengths[short]) + np.arange(ends[-1])
    word, ids = merge_together(vocabulary, data[place], ends)
    cut = np.searchsorted(word, np.arange(int(short.sum()) + 1))
    together = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
    alone = [merge_exactly(vocabulary, data[bounds[w] : bounds[w + 1]].tobytes()) for w in words[~short].tolist()]
    pick = np.empty(len(words), np.int64)
    pick[short], pick[~short] = np.arange(short.sum()), short.sum() + np.arange((~short).sum())
    return pa.concat_arrays([together, pa.array(alone, pa.list_(pa.int32()))]).take(pa.array(pick))


def encode_words(vocabulary: Vocabulary, words: pa.Array) -> pa.ListArray:
    """Ids of each word (strings); special tokens are single ids."""
    data, bounds = flat_bytes(words)
    word, ids = propose(vocabulary, data, bounds)
    same = word[:-1] == word[1:]
    if vocabulary.ordered and len(same):
        pairs, where = np.unique(ids[:-1][same] * len(vocabulary.tokens) + ids[1:][same], return_inverse=True)
        good = compatible(vocabulary, *np.divmod(pairs, len(vocabulary.tokens)))
        failing = np.unique(word[:-1][same][~good[where]])
    else:
        failing = np.arange(0 if vocabulary.ordered else len(words))
    parts = [_exact(vocabulary, data, bounds, failing)]
    if vocabulary.specials:
        at = pc.index_in(words, pa.array(list(vocabulary.specials), words.type)).to_numpy(zero_copy_only=False)
        special = np.flatnonzero(~np.isnan(at.astype(float)))
        values = list(vocabulary.specials.values())
        parts.append(pa.array([[values[int(at[w])]] for w in special.tolist()], pa.list_(pa.int32())))
        failing = np.concatenate([failing, special])
    ends = np.searchsorted(word, np.arange(len(words) + 1))
    proposed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
    if not len(failing):
        return proposed
    pick = np.arange(len(words))
    pick[failing] = len(words) + np.arange(len(failing))  # a special token comes last and so holds
    return pa.concat_arrays([proposed, *parts]).take(pa.array(pick))


def encode_batch(vocabulary: Vocabulary, texts: pa.Array) -> pa.Array:
    """List of ids of each text (no nulls)."""
    words, bounds = [], [0]
    for text in texts.to_pylist():
        words += split_text(vocabulary, text)
        bounds.append(len(words))
    coded = pa.array(words, pa.large_utf8()).dictionary_encode()
    ids = encode_words(vocabulary, coded.dictionary).take(coded.indices)
    ends = np.asarray(ids.offsets, np.int64)
    return pa.LargeListArray.from_arrays(pa.array((ends - ends[0])[np.array(bounds)]), ids.flatten())


def decode_batch(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    """Text of each list of ids (no nulls)."""
    bounds = np.asarray(ids.offsets, np.int64)
    flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    known = (flat >= 0) & (flat < len(vocabulary.tokens))
    bounds = np.concatenate([[0], np.cumsum(known)])[bounds - bounds[0]]
    flat = pa.array(flat[known])
    if vocabulary.joined:
        parts = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(vocabulary.tokens, pa.large_utf8()).take(flat))
        return pc.binary_join(parts, pa.scalar(" ", pa.large_utf8()))
    parts = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(vocabulary.raw, pa.large_binary()).take(flat))
    joined = pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))
    return pa.array([x.as_py().decode("utf-8", "replace") for x in joined], pa.large_utf8())


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, arrow: pa.DataType, sizes, most: int, work) -> DataFrame:
    """``df`` with ``out``: ``work`` of ``column`` for slices of its batches; null stays null."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by(whole, sizes(whole.column(column)), most):
                made = pc.if_else(batch.column(column).is_valid(), work(batch).cast(arrow), pa.scalar(None, arrow))
                names = [n for n in batch.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], [*names, out])

    return df.mapInArrow(run, schema)


def _text_sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts.cast(pa.large_utf8())).fill_null(0).to_numpy(zero_copy_only=False)


def _list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)


def encode(df: DataFrame, vocabulary: Vocabulary, column: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of ``column``; what is broadcast is bounded by the vocabulary, not by the texts."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    return _mapped(
        df, column, out, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), _text_sizes, SLICE_BYTES,
        lambda batch: encode_batch(shared.value, texts_of(batch, column)),
    )


def decode(df: DataFrame, vocabulary: Vocabulary, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the file's decoder gives for the ids of ``column``, special tokens included."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    empty = pa.scalar([], pa.large_list(pa.int32()))

    def work(batch: pa.RecordBatch) -> pa.Array:
        ids = batch.column(column).cast(pa.large_list(pa.int32())).fill_null(empty)
        return decode_batch(shared.value, ids)

    return _mapped(df, column, out, T.StringType(), pa.string(), _list_sizes, SLICE_IDS, work)
