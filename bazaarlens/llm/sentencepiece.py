"""SentencePiece: Unigram Viterbi encoding over a double-array trie of pieces, and decoding.

White space is written as U+2581 and one mark is put before a text, as in the
public format. A character that no piece covers is written as its UTF-8 bytes by
byte pieces. Equal path scores go to the longer last piece.

Where no piece has a mark after another character, the best path of a text is the
chain of the best paths of its words (mark and what follows), so every different
word of a batch is encoded once; with such pieces the whole text is one word.

Defined results: null text gives null ids and null ids null text; an empty text has
no ids. Unknown ids and control pieces decode to nothing, invalid UTF-8 from byte
pieces to U+FFFD. Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bazaarlens.llm.words import flat_bytes, slices, slices_by, texts_of

MARK = "\u2581"
# A character without a piece costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
# Words up to so many bytes share their steps; each longer one is walked alone, to the same result.
SHARED_BYTES = 64
# Different words whose lattices are held at once, and ids decoded at once.
LATTICE_WORDS = 16_384
DECODED_IDS = 1_000_000


@dataclass(frozen=True)
class Trie:
    """Double array: the child of node n by byte b is base[n] + b + 1 if check there is n; value is a piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(keys: dict[bytes, int]) -> Trie:
    """Places nodes level by level: one with one child takes the lowest free slot, one with more the next base on from
    the last such one where all its children fit."""
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for key, piece in keys.items():
        node = 0
        for b in key:
            after = children[node].get(b)
            if after is None:
                after = len(children)
                children[node][b] = after
                children.append({})
                ids.append(-1)
            node = after
        ids[node] = piece
    room = 2 * len(children) + 600
    base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    used = bytearray(room)
    used[0] = 1
    value[0] = ids[0]
    gap, onward, todo = 257, 0, [(0, 0)]  # below 257 a base of 0 or more cannot reach every slot
    for place, node in todo:
        bytes_ = sorted(children[node])
        if not bytes_:
            continue
        while used[gap]:
            gap += 1
        start = max(0, gap - bytes_[0] - 1, onward if len(bytes_) > 1 else 0)
        while any(used[start + b + 1] for b in bytes_):
            start += 1
            if start + 300 > len(used):
                more = len(used)
                used.extend(bytes(more))
                base, check, value = (np.concatenate([x, np.full(more, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
        base[place] = start
        onward = max(onward, start) if len(bytes_) > 1 else onward
        for b in bytes_:
            at = start + b + 1
            used[at] = 1
            check[at] = place
            value[at] = ids[children[node][b]]
            todo.append((at, children[node][b]))
    last = int(np.flatnonzero(check >= 0).max(initial=0)) + 300
    return Trie(base[:last].copy(), check[:last].copy(), value[:last].copy())


@dataclass(frozen=True)
class Pieces:
    """Vocabulary: the text of each id as bytes, its log score, the trie of normal pieces, and byte pieces."""

    texts: tuple[bytes, ...]
    scores: np.ndarray
    trie: Trie
    byte_ids: np.ndarray
    unknown_score: float
    by_words: bool


def load_pieces(path: str, scores: str = "zipf") -> Pieces:
    """Pieces of a SentencePiece model file, read on the driver; their number bounds what is sent to tasks.

    scores: ``file`` takes the file's scores as log probabilities, as a Unigram file has them. A file of merges has
    negative merge ranks instead; ``zipf`` gives the piece at rank r of the falling scores the log of 1 / (r + 1),
    divided by the sum of all of these.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    byte_ids = np.full(256, -1, np.int32)
    normal = {}
    texts = []
    for i in ids:
        piece = model.id_to_piece(i)
        found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece) if model.is_byte(i) else None
        if found:
            byte_ids[int(found[1], 16)] = i
            texts.append(bytes([int(found[1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            normal[i] = piece
            texts.append(piece.replace(MARK, " ").encode())
    own = np.array([model.get_score(i) for i in ids])
    if scores == "zipf":
        ranked = sorted(normal, key=lambda i: (-own[i], i))
        own = np.zeros(len(texts))
        own[ranked] = -np.log(np.arange(1, len(ranked) + 1)) - np.log((1 / np.arange(1, len(ranked) + 1)).sum())
    return make_pieces(normal, own, tuple(texts), byte_ids)


def make_pieces(normal: dict[int, str], scores: np.ndarray, texts: tuple[bytes, ...], byte_ids: np.ndarray) -> Pieces:
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    trie = build_trie({piece.encode(): i for i, piece in normal.items()})
    by_words = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in normal.values())
    worst = min((float(scores[i]) for i in normal), default=0.0)
    return Pieces(texts, np.asarray(scores, float), trie, byte_ids, worst - UNKNOWN_PENALTY, by_words)


def _char_lengths(data: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that starts at each place (0 inside one)."""
    return np.select([data < 0x80, data < 0xC0, data < 0xE0, data < 0xF0], [1, 0, 2, 3], 4)


def _edges(pieces: Pieces, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All (start, stop, id, score) that a path may use: pieces from every character on, and single characters by bytes (id -1).

    ends: where the word of each place ends. The walk goes one byte further
    from all places at once.
    """
    trie = pieces.trie
    chars = _char_lengths(data)
    start = np.flatnonzero(chars)
    covered = np.zeros(len(data), bool)
    found = []
    at, node, origin = start.copy(), np.zeros(len(start), np.int64), start
    while len(at):
        slot = trie.base[node] + data[at] + 1
        alive = trie.check[slot] == node
        node, at, origin = slot[alive], at[alive] + 1, origin[alive]
        ids = trie.value[node]
        hit = ids >= 0
        if hit.any():
            found.append((origin[hit], at[hit], ids[hit], pieces.scores[ids[hit]]))
            covered[origin[hit & (at - origin == chars[origin])]] = True
        more = at < ends[origin]
        node, at, origin = node[more], at[more], origin[more]
    bare = start[~covered[start]]
    found.append((bare, bare + chars[bare], np.full(len(bare), -1, np.int64), np.full(len(bare), pieces.unknown_score)))
    return tuple(np.concatenate(x) for x in zip(*found))


def encode_words(pieces: Pieces, words: pa.Array) -> pa.ListArray:
    """Ids of the best path of each word (bytes with marks)."""
    data, bounds = flat_bytes(words)
    lengths = np.diff(bounds)
    word_of = np.repeat(np.arange(len(lengths)), lengths)
    start, stop, ids, score = _edges(pieces, data, bounds[1:][word_of])
    # The state after byte p of a word stands at p + 1 past the word's own start state.
    shift = word_of[start] if len(start) else start
    start, stop = start + shift, stop + shift
    states = len(data) + len(lengths)
    best = np.full(states, -np.inf)
    best[bounds[:-1] + np.arange(len(lengths))] = 0.0
    came, by = np.full(states, -1, np.int64), np.full(states, -1, np.int64)
    place = start - (bounds[:-1] + np.arange(len(lengths)))[shift] if len(start) else start
    long = lengths[shift] > SHARED_BYTES if len(start) else start.astype(bool)
    # Short words: edges by their place in the word, then from the longest piece on, so that ties stay with it.
    for far in _grouped(np.flatnonzero(~long), place, stop - start):
        value = best[start[far]] + score[far]
        better = value > best[stop[far]]
        far = far[better]
        best[stop[far]], came[stop[far]], by[stop[far]] = value[better], start[far], ids[far]
    walked = np.flatnonzero(long)
    walked = walked[np.lexsort((start[walked],))]
    for s, e, i, v in zip(start[walked].tolist(), stop[walked].tolist(), ids[walked].tolist(), score[walked].tolist()):
        if best[s] + v > best[e]:
            best[e], came[e], by[e] = best[s] + v, s, i
    return _paths(pieces, data, bounds, came, by)


def _grouped(edges: np.ndarray, place: np.ndarray, span: np.ndarray) -> Iterator[np.ndarray]:
    """Edges in groups of one place and one span, by place, so that no two of a group end in one state."""
    order = edges[np.lexsort((span[edges], place[edges]))]
    if not len(order):
        return
    new = np.flatnonzero((np.diff(place[order]) != 0) | (np.diff(span[order]) != 0)) + 1
    yield from np.split(order, new)


def _paths(pieces: Pieces, data: np.ndarray, bounds: np.ndarray, came: np.ndarray, by: np.ndarray) -> pa.ListArray:
    """Walks back from the last state of every word at once and spells characters without a piece in bytes."""
    n = len(bounds) - 1
    first = bounds[:-1] + np.arange(n)
    at, word = bounds[1:] + np.arange(n), np.arange(n)
    steps = []
    while True:
        open_ = at != first[word]
        at, word = at[open_], word[open_]
        if not len(at):
            break
        steps.append((word, came[at], at, by[at]))
        at = came[at]
    if not steps:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
    word, start, stop, ids = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(start, kind="stable")  # states of words follow each other
    word, start, stop, ids = word[order], start[order], stop[order], ids[order]
    width = np.where(ids < 0, stop - start, 1)
    out = np.repeat(ids, width)
    source = np.repeat(start - word, width) + (np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width))
    out = np.where(out < 0, pieces.byte_ids[data[np.minimum(source, len(data) - 1)]], out)
    sizes = np.bincount(word, weights=width, minlength=n).astype(np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(out.astype(np.int32))
    )


def encode_batch(pieces: Pieces, texts: pa.Array) -> pa.Array:
    """List of ids of each text (large_utf8, no nulls)."""
    empty = pc.equal(pc.binary_length(texts), 0)
    marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(" ", pa.large_utf8()), texts, pa.scalar("", pa.large_utf8())), " ", MARK)
    if pieces.by_words:
        # A cut before every mark that does not follow a mark: the line feed trick keeps the marks in the words.
        cut = pc.replace_substring_regex(marked, f"([^{MARK}])({MARK})", "\\1\x00\\2") if not _holds_nul(texts) else None
    else:
        cut = marked
    if cut is None:
        lists = pa.array([re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", t) for t in marked.to_pylist()], pa.large_list(pa.large_utf8()))
    elif pieces.by_words:
        lists = pc.split_pattern(cut, "\x00")
    else:
        lists = pa.array([[t] for t in marked.to_pylist()], pa.large_list(pa.large_utf8()))
    bounds = np.asarray(lists.offsets, np.int64)
    bounds = bounds - bounds[0]
    words = lists.flatten().dictionary_encode()
    parts = [encode_words(pieces, words.dictionary.slice(k, LATTICE_WORDS)) for k in range(0, len(words.dictionary), LATTICE_WORDS)]
    ids = (pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))).take(words.indices)
    ends = np.asarray(ids.offsets, np.int64)
    kept = (ends - ends[0])[bounds]
    flat = ids.flatten()
    out = pa.LargeListArray.from_arrays(pa.array(kept), flat)
    return pc.if_else(empty, pa.scalar([], pa.large_list(pa.int32())), out)


def _holds_nul(texts: pa.Array) -> bool:
    return bool(pc.any(pc.match_substring(texts, "\x00")).as_py())


def decode_batch(pieces: Pieces, ids: pa.Array) -> pa.Array:
    """Text of each list of ids (no nulls)."""
    ids = ids.cast(pa.large_list(pa.int32()))
    bounds = np.asarray(ids.offsets, np.int64)
    flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    none = len(pieces.texts)
    flat = np.where((flat < 0) | (flat >= none), none, flat)
    parts = pa.array([*pieces.texts, b""], pa.large_binary()).take(pa.array(flat))
    data, ends = flat_bytes(parts)
    cuts = ends[bounds - bounds[0]]
    if pieces.texts and len(data):
        # The mark put before a text goes.
        lead = (np.diff(cuts) > 0) & (data[np.minimum(cuts[:-1], len(data) - 1)] == 0x20)
    else:
        lead = np.zeros(len(cuts) - 1, bool)
    whole = data.tobytes()
    texts = [whole[a + s : b].decode("utf-8", "replace") for a, b, s in zip(cuts[:-1].tolist(), cuts[1:].tolist(), lead.tolist())]
    return pa.array(texts, pa.large_utf8())


def _mapped(df: DataFrame, out: str, kind: T.DataType, arrow: pa.DataType, column: str, cut, work) -> DataFrame:
    """``df`` with a column ``out``: ``work`` of ``column`` for each part that ``cut`` makes of a batch; null stays null."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole):
                made = pc.if_else(batch.column(column).is_valid(), work(batch).cast(arrow), pa.scalar(None, arrow))
                names = [n for n in batch.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], [*names, out])

    return df.mapInArrow(run, schema)


def _id_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.list_value_length(batch.column(column)).fill_null(0)
    yield from slices_by(batch, sizes.to_numpy(zero_copy_only=False), DECODED_IDS)


IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, pieces: Pieces, column: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of ``column``; what is broadcast is bounded by the vocabulary, not by the texts."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    return _mapped(
        df, out, IDS, pa.list_(pa.int32()), column,
        lambda b: slices(b, column), lambda b: encode_batch(shared.value, texts_of(b, column)),
    )


def decode(df: DataFrame, pieces: Pieces, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids of ``column`` stand for."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    empty = pa.scalar([], pa.large_list(pa.int32()))

    def work(batch: pa.RecordBatch) -> pa.Array:
        return decode_batch(shared.value, batch.column(column).cast(pa.large_list(pa.int32())).fill_null(empty))

    return _mapped(df, out, T.StringType(), pa.string(), column, lambda b: _id_slices(b, column), work)


def encode_verified(
    df: DataFrame, pieces: Pieces, column: str = "text", out: str = "ids", same: str = "round_trip"
) -> DataFrame:
    """``df`` with the ids of ``column`` and whether they decode to the same text (null text: null ids, true).

    One Python worker a task does both, so texts travel once; input columns named ``out`` or ``same`` are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    kept = [f for f in df.schema.fields if f.name not in (out, same)]
    schema = T.StructType([*kept, T.StructField(out, IDS), T.StructField(same, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                texts = texts_of(batch, column)
                ids = encode_batch(shared.value, texts)
                equal = pc.equal(decode_batch(shared.value, ids), texts)
                there = batch.column(column).is_valid()
                ids = pc.if_else(there, ids.cast(pa.list_(pa.int32())), pa.scalar(None, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], ids, equal], schema.names)
        # Workers are used again by other stages: free memory goes back first.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
