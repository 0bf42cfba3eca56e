"""Sampled subword segmentation: forward filtering, backward sampling over the lattice of pieces.

A text is put into SentencePiece's form (a word mark before the text and for
each blank). Between the marks no piece reaches across, so the lattice of a text
falls into the lattices of its words. For each different word of a batch the
forward pass sums the weights of all segmentations up to each position; going
back from the end of a word, each step draws the piece that ends there with its
share of that sum. This draws a segmentation with probability proportional to
the product of its pieces' weights. The draws come from a counter: a hash of the
row key and the position in the text. They depend on nothing else, so a row gets
the same pieces in any batch, partition or rerun.

Weights: of a unigram model the log probabilities; of a BPE model, whose scores
are merge ranks, Zipf's law over the ranks (p in proportion to 1 / (1 + rank), summing to 1).
``temperature`` divides them; towards 0 the best segmentation is drawn.

Decoding is lossless: characters without a piece, and word marks that stand in
the text itself, are spelt in byte pieces.

Cases: NULL gives NULL, an empty text no pieces. A NULL key is a key like any
other. Rows with equal key and text get equal pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm.common import mix, parts, starts_of, trimmed, within

MARK = "▁"
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_CHUNK = 400_000  # bytes of text
# Letters that most pieces have get a full table of trie steps.
_COMMON = 128


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Segmentation:
    model_path: str | None = None
    # "zipf" for models whose scores are ranks, "score" for log probabilities.
    weights: str = "zipf"
    temperature: float = 0.5
    seed: int = 0


class Pieces:
    """The vocabulary as a trie in arrays."""

    def __init__(self, job: Segmentation):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=job.model_path or default_model())
        self.size = model.vocab_size()
        self.text: list[bytes] = [b""] * self.size
        plain, self.byte_ids = [], np.full(256, -1, np.int32)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.text[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a piece reaches across words: {piece!r}")
                plain.append((i, piece, model.get_score(i)))
                self.text[i] = piece.replace(MARK, " ").encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.weight = np.full(self.size, -np.inf)
        if job.weights == "zipf":
            ranked = sorted(plain, key=lambda p: (-p[2], p[0]))
            total = np.log(np.sum(1 / np.arange(1, len(ranked) + 1)))
            for rank, (i, _, _) in enumerate(ranked):
                self.weight[i] = -np.log1p(rank) - total
        else:
            for i, _, score in plain:
                self.weight[i] = score
        least = min(self.weight[i] for i, _, _ in plain)
        self.weight[self.byte_ids] = least
        self.weight /= job.temperature
        used: dict[str, int] = {}
        for _, piece, _ in plain:
            for c in piece:
                used[c] = used.get(c, 0) + 1
        letters = sorted(used, key=lambda c: (-used[c], c))
        self.codes = np.full(0x110000, -1, np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(len(letters))
        self.codes[0x20] = self.codes[ord(MARK)]
        self.codes[ord(MARK)] = -1
        self.mark, self.letters = int(self.codes[0x20]), len(letters)
        place = {c: k for k, c in enumerate(letters)}
        children: dict[int, int] = {}
        ends = [-1]
        for i, piece, _ in plain:
            node = 0
            for c in piece:
                key = node * self.letters + place[c]
                if key not in children:
                    children[key] = len(ends)
                    ends.append(-1)
                node = children[key]
            ends[node] = i
        keys = np.array(sorted(children), np.int64)
        self.keys, self.next = keys, np.array([children[k] for k in keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)
        self.table = np.full((len(ends), _COMMON), -1, np.int32)
        parent, code = keys // self.letters, keys % self.letters
        common = code < _COMMON
        self.table[parent[common], code[common]] = self.next[common]

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node under a letter, or -1."""
        out = self.table[node, np.clip(code, 0, _COMMON - 1)].astype(np.int64)
        out[code < 0] = -1
        rare = np.flatnonzero(code >= _COMMON)
        if len(rare):
            key = node[rare] * self.letters + code[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.next[at], -1)
        return out


@dataclass
class Lattice:
    """Edges of all words, those into one node together, longest first."""

    nodes: np.ndarray  # first node of each word, and the end
    first: np.ndarray  # first edge into each node, and the end
    source: np.ndarray
    piece: np.ndarray  # -1: the character in bytes
    upto: np.ndarray  # share of the edges into the node so far, in units of 2 ** -32


def lattice(pieces: Pieces, codes: np.ndarray, spelt: np.ndarray, counts: np.ndarray) -> Lattice:
    """Forward pass over words given one after the other: letter codes, bytes each character takes, lengths."""
    position, total = within(counts), np.repeat(counts, counts)
    base = starts_of(counts + 1)
    node_of = np.repeat(base[:-1], counts) + position  # the node before each character
    start = np.flatnonzero(codes >= 0)
    node = pieces.step(np.zeros(len(start), np.int64), codes[start])
    start, node = start[node >= 0], node[node >= 0]
    sources, found = [], []
    has_own = np.zeros(len(codes), bool)
    while len(start):
        end = pieces.ends[node]
        hit = end >= 0
        sources.append(node_of[start[hit]])
        found.append(end[hit])
        if len(sources) == 1:
            has_own[start[hit]] = True
        more = position[start] + len(sources) < total[start]
        start, node = start[more], node[more]
        node = pieces.step(node, codes[start + len(sources)])
        start, node = start[node >= 0], node[node >= 0]
    bare = np.flatnonzero(~has_own)
    # Longest pieces first, so that a stable sort by target leaves them in that order.
    target = np.concatenate([x + k + 1 for k, x in reversed(list(enumerate(sources)))] + [node_of[bare] + 1])
    source = np.concatenate([*reversed(sources), node_of[bare]])
    piece = np.concatenate([*reversed(found), np.full(len(bare), -1, np.int64)])
    weight = pieces.weight[piece]
    weight[len(piece) - len(bare):] = pieces.weight[pieces.byte_ids[0]] * spelt[bare]
    order = np.argsort(target, kind="stable")
    source, piece, weight = source[order], piece[order], weight[order]
    edges = np.bincount(target, minlength=int(base[-1]))
    first = starts_of(edges)
    # Nodes at the same place of any word are worked on together, place by place.
    place = within(counts + 1)
    by_place = np.argsort(place, kind="stable")[len(counts):]
    sizes = edges[by_place]
    turn = np.repeat(first[by_place], sizes) + within(sizes)
    node_cuts = np.append(np.flatnonzero(np.diff(place[by_place], prepend=-1)), len(by_place))
    edge_cuts = starts_of(sizes)
    forward = np.zeros(int(base[-1]))
    upto = np.empty(len(source), np.uint32)
    for low, high in zip(node_cuts[:-1], node_cuts[1:]):
        at, size = turn[edge_cuts[low]:edge_cuts[high]], sizes[low:high]
        value = forward[source[at]] + weight[at]
        begin = starts_of(size)[:-1]
        top = np.maximum.reduceat(value, begin)
        parts = np.exp(value - np.repeat(top, size))
        sums = np.add.reduceat(parts, begin)
        forward[by_place[low:high]] = top + np.log(sums)
        run = np.cumsum(parts / np.repeat(sums, size))
        run -= np.repeat(np.concatenate(([0.0], run))[begin], size)
        upto[at] = np.minimum(run * 2.0 ** 32, 2.0 ** 32 - 1).astype(np.uint32)
    upto[first[1:][edges > 0] - 1] = 0xFFFFFFFF
    return Lattice(base, first, source, piece, upto)


def sample(pieces: Pieces, texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all texts one after the other, number per text); texts are UTF-8."""
    points = [np.frombuffer(t.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(p) + 1 if len(p) else 0 for p in points], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    blank = np.array([0x20], np.uint32)
    flat = np.concatenate([x for p in points if len(p) for x in (blank, p)])
    codes = pieces.codes[flat].astype(np.int64)
    spelt = (1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)).astype(np.int64)
    is_mark = codes == pieces.mark
    odd = codes < 0
    begin = odd | (is_mark & ~np.append(True, is_mark[:-1]))
    begin[1:] |= odd[:-1]
    begin[starts_of(lengths)[:-1][lengths > 0]] = True
    at = np.flatnonzero(begin)
    sizes = np.diff(np.append(at, len(flat)))
    # Equal words by a hash of their letters.
    with np.errstate(over="ignore"):
        powers = np.full(len(flat) + 1, _FACTOR, np.uint64)
        powers[0] = 1
        letters = mix((codes + 2).astype(np.uint64) + np.where(odd, flat, 0).astype(np.uint64) * _GAMMA)
        powers = np.cumprod(powers)
        back = np.cumprod(np.append(np.uint64(1), np.full(len(flat), _INVERSE, np.uint64)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * powers[:-1], dtype=np.uint64)))
        name = mix((sums[at + sizes] - sums[at]) * back[at] + sizes.astype(np.uint64))
    _, example, word = np.unique(name, return_index=True, return_inverse=True)
    counts = sizes[example]
    letter = np.repeat(at[example], counts) + within(counts)
    paths = lattice(pieces, codes[letter], spelt[letter], counts)
    # Every occurrence goes back from its end; what is drawn is put where the piece ends.
    text = np.repeat(np.arange(len(texts)), lengths)[at]
    seed = keys[text]
    offset = at - starts_of(lengths)[text]
    drawn = np.full(len(flat), -2, np.int64)
    root = paths.nodes[word]
    node = root + sizes
    shift = at - root
    live = np.arange(len(at))
    while len(live):
        here = node[live]
        with np.errstate(over="ignore"):
            spot = (offset[live] + here - root[live]).astype(np.uint64)
            u = (mix(seed[live] + spot * _GAMMA) >> np.uint64(32)).astype(np.uint32)
        edge = paths.first[here]
        later = np.flatnonzero(paths.upto[edge] < u)
        while len(later):
            edge[later] += 1
            later = later[paths.upto[edge[later]] < u[later]]
        drawn[here + shift[live] - 1] = paths.piece[edge]
        node[live] = paths.source[edge]
        live = live[node[live] > root[live]]
    taken = np.flatnonzero(drawn != -2)
    ids = drawn[taken]
    width = np.where(ids >= 0, 1, spelt[taken])
    out = np.repeat(ids, width)
    raw = np.flatnonzero(ids < 0)
    if len(raw):
        spelling = b"".join(chr(c).encode("utf-8", "surrogatepass") for c in flat[taken[raw]].tolist())
        out[out < 0] = pieces.byte_ids[np.frombuffer(spelling, np.uint8)]
    owner = np.repeat(np.arange(len(texts)), lengths)[taken]
    return out.astype(np.int32), np.bincount(owner, weights=width, minlength=len(texts)).astype(np.int64)


def decode(pieces: Pieces, ids: list[int]) -> bytes:
    """The text that pieces spell, in UTF-8; the first blank is the word mark before the text."""
    return b"".join(map(pieces.text.__getitem__, ids))[1:]


def row_keys(keys: list, seed: int) -> np.ndarray:
    """Seed of each row, from the text form of its key."""
    return np.fromiter((xxhash.xxh3_64_intdigest("" if k is None else str(k), seed) for k in keys), np.uint64, len(keys))


def pieces_column(text: Column, key: Column, job: Segmentation = Segmentation()) -> Column:
    """Sampled piece ids of a text."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pieces = Pieces(job)
        for keys, texts in batches:
            seeds = row_keys(keys.to_pylist(), job.seed)
            missing = np.append(np.asarray(texts.is_null()), False)
            made = [pa.array([], pa.list_(pa.int32()))]
            for low, high, some in parts(texts, _CHUNK):
                flat, counts = sample(pieces, some, seeds[low:high])
                at = pa.array(starts_of(counts).astype(np.int32), mask=np.append(missing[low:high], False))
                made.append(pa.ListArray.from_arrays(at, pa.array(flat)))
            yield pa.concat_arrays(made)
        trimmed()

    return ids(key, text)


def decoded_column(ids: Column, job: Segmentation = Segmentation()) -> Column:
    """The text of piece ids."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(job)
        for part in batches:
            yield pa.array([None if i is None else decode(pieces, i).decode("utf-8", "surrogatepass") for i in part.to_pylist()], pa.string())

    return text(ids)


def digest_column(text: Column, key: Column, job: Segmentation = Segmentation()) -> Column:
    """n_pieces, n_byte_pieces, pieces_sha256 (of the ids as 32-bit little-endian) and lossless (decodes to the text)."""

    @F.arrow_udf("n_pieces long, n_byte_pieces long, pieces_sha256 string, lossless boolean")
    def digest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pieces = Pieces(job)
        is_byte = np.zeros(pieces.size, bool)
        is_byte[pieces.byte_ids] = True
        for keys, texts in batches:
            seeds = row_keys(keys.to_pylist(), job.seed)
            counts, spelt, hashes, lossless = [], [], [], []
            for low, high, some in parts(texts, _CHUNK):
                flat, sizes = sample(pieces, some, seeds[low:high])
                at = starts_of(sizes)
                for text, a, b in zip(some, at[:-1], at[1:]):
                    own = flat[a:b]
                    counts.append(b - a)
                    spelt.append(int(is_byte[own].sum()))
                    hashes.append(hashlib.sha256(own.tobytes()).hexdigest())
                    lossless.append(decode(pieces, own.tolist()) == text)
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(spelt, pa.int64()), pa.array(hashes, pa.string()),
                 pa.array(lossless, pa.bool_())],
                ["n_pieces", "n_byte_pieces", "pieces_sha256", "lossless"])
        trimmed()

    return digest(key, text)


def segmented(
    docs: DataFrame, job: Segmentation = Segmentation(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id and sampled piece ids (``pieces``) of each row, handed over in small batches."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(job)
        for batch in batches:
            seeds = row_keys(batch.column(0).to_pylist(), job.seed)
            missing = np.append(np.asarray(batch.column(1).is_null()), False)
            for low, high, some in parts(batch.column(1), _CHUNK):
                flat, counts = sample(pieces, some, seeds[low:high])
                at = pa.array(starts_of(counts).astype(np.int32), mask=np.append(missing[low:high], False))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(at, pa.array(flat))], ["id", "pieces"])
        trimmed()

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, pieces array<int>").withColumnRenamed("id", id_col)
