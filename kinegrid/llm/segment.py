"""SentencePiece encoding and decoding with N-best segmentation.

A text's pieces form a lattice. Forward Viterbi scores of its nodes are the exact cost to go of a backward A* search
from the end, so the search pops best segmentations in order of score and expands nothing else. No piece has a word start
behind another character, so the lattice of a text splits exactly into those of its chunks (a word with the
space before it). Chunks are segmented once per slice of the table, however often they occur: forward and backward scores of all
of them in numpy, which also give the loss of a chunk's second-best path (the best path through an edge off the best path). The
``n`` best segmentations of a text change only chunks among its ``n - 1`` with the smallest loss, and A* runs on these.

Scores: a vocabulary of merges has ranks, not probabilities; a piece of rank r gets the log-probability of Zipf's law,
``-ln(r + 1)``, less a constant. Bytes of characters without a piece of their own are byte pieces, below all others.

Decoding is exact for every text: a space and the word-start mark are one byte inside, and a mark in the text itself
becomes byte pieces.

Defined cases: a null or empty text has no pieces, score 0 and decodes to an empty text; equal scores: longer last pieces
first, then fewer pieces; very long texts and chunks are segmented whole; repeated rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinegrid.llm.bytewords import pieces as slices
from kinegrid.llm.bytewords import raw
from kinegrid.llm.common import fresh

MARK = "▁"
SPACE = 0x20
NBEST = 4
SLICE_BYTES = 4 << 20
BLOCK_CHUNKS = 1 << 14
DECODE_ROWS = 1000
NORMAL, BYTE, HIDDEN = 0, 1, 2
PATCH = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
NBEST_TYPE = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("patches", T.ArrayType(PATCH))]))


def default_vocabulary() -> str:
    """The public model file where the tokenizer folder is installed; another place is a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """pieces: bytes of each id, with a space for the word start. kinds: NORMAL, BYTE or HIDDEN (never in a text)."""

    pieces: list[bytes]
    kinds: np.ndarray
    scores: np.ndarray

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """Reads a model file on the driver; tasks get the object."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
        found = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        kinds = [BYTE if model.is_byte(i) else HIDDEN if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else NORMAL for i in range(len(found))]
        return cls.from_pieces(found, kinds)

    @classmethod
    def from_pieces(cls, found: list[str], kinds: list[int]) -> Vocabulary:
        """Ranks are the order of the normal pieces; byte pieces share the rank behind them."""
        of = np.array(kinds, np.int8)
        rank = np.cumsum(of == NORMAL) - 1.0
        rank[of != NORMAL] = (of == NORMAL).sum() + 256
        raw_pieces = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(found, kinds, strict=True)]
        return cls(raw_pieces, of, -np.log(rank + 1.0) - np.log(np.log(len(found) + 2.0)))

    def trie(self) -> _Trie:
        if getattr(self, "_trie", None) is None:
            self._trie = _Trie(self)
        return self._trie

    def spellings(self) -> _Trie:
        """What decoding needs, without states."""
        if getattr(self, "_spellings", None) is None:
            self._spellings = getattr(self, "_trie", None) or _Trie(self, states=False)
        return self._spellings

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_trie", "_spellings")}


class _Trie:
    """States and their followers by byte, and what decoding needs."""

    def __init__(self, vocabulary: Vocabulary, states: bool = True):
        shown = [p if k != HIDDEN else b"" for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
        self.size = np.array([len(p) for p in shown])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(shown), np.uint8)
        if not states:
            return
        next_state: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, (piece, kind) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)):
            if kind == NORMAL and piece:
                state = 0
                for b in piece:
                    state = next_state.setdefault(state << 8 | b, len(next_state) + 1)
                ends.setdefault(state, i)
        n = len(next_state) + 1
        self.follow = np.zeros((n, 256), np.int32)
        keys = np.array(list(next_state), np.int64)
        self.follow[keys >> 8, keys & 255] = list(next_state.values())
        self.piece = np.full(n, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.byte_piece = np.full(256, -1, np.int32)
        for i in np.flatnonzero(vocabulary.kinds == BYTE):
            self.byte_piece[vocabulary.pieces[i][0]] = i
        if (self.byte_piece < 0).any():
            raise ValueError("the vocabulary lacks byte pieces, so not every text has a segmentation")
        if max(map(len, vocabulary.pieces)) > 255:
            raise ValueError("a piece has more than 255 bytes")
        used = {b for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True) if k == NORMAL for b in p}
        if any(SPACE in p.lstrip(b" ") for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True) if k == NORMAL):
            raise ValueError("a piece has a word start behind another character")
        self.alone = np.zeros(256, bool)  # bytes that no longer piece has
        self.alone[[b for b in range(128) if b not in used and b != SPACE]] = True


class Lattices:
    """The lattices of distinct chunks, solved. ids, bounds: best pieces of each chunk; loss: of its second-best path."""

    def __init__(self, vocabulary: Vocabulary, chunks: pa.Array):
        trie = vocabulary.trie()
        data, offsets = raw(chunks)
        length = np.diff(offsets)
        n = len(length)
        chunk = np.repeat(np.arange(n), length)
        u, v, piece = self._edges(trie, data, offsets, chunk)
        self.first = offsets[:-1] + np.arange(n)  # a chunk's first node; its nodes are numbered on to its end
        self.last = self.first + length
        of = chunk[u]
        u, v = u + of, v + of
        score = vocabulary.scores[piece]
        # by depth, end and start: one sort of one number, as a piece is shorter than 256 bytes
        order = np.argsort((((v - self.first[of]) * (len(data) + n + 1) + v) << 8) + 255 - (v - u))
        self.u, self.v, self.piece, self.score, of = u[order], v[order], piece[order], score[order], of[order]
        self.forward, into = self._forward(of)
        backward = self._backward(of)
        on_best = np.zeros(len(self.u), bool)
        at = self.last[length > 0]
        while len(at):
            edge = into[at]
            on_best[edge] = True
            at = self.u[edge]
            at = at[at != self.first[of[edge]]]
        best = np.flatnonzero(on_best)
        best = best[np.argsort(self.v[best])]
        self.ids = self.piece[best]
        self.bounds = np.searchsorted(self.v[best], np.append(self.first, self.last[-1] + 1 if n else 0), "left")
        self.best = self.forward[self.last]
        through = self.forward[self.u] + self.score + backward[self.v]
        second = np.full(n, -np.inf)
        np.maximum.at(second, of[~on_best], through[~on_best])
        self.loss = np.maximum(self.best - second, 0.0)
        self.by_end: np.ndarray | None = None

    @staticmethod
    def _edges(trie: _Trie, data: np.ndarray, offsets: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end bytes and the piece of every edge."""
        end = offsets[1:][chunk]
        at, state, size = np.arange(len(data)), trie.follow[0, data], 0
        found: list[tuple] = []
        starts = (data & 0xC0) != 0x80
        character = np.diff(np.append(np.flatnonzero(starts), len(data)))
        wanted = np.zeros(len(data), np.int64)
        wanted[starts] = character
        covered = np.zeros(len(data), bool)
        while len(at):
            going = state > 0
            at, state, size = at[going], state[going], size + 1
            piece = trie.piece[state]
            hit = piece >= 0
            found.append((at[hit], at[hit] + size, piece[hit]))
            covered[at[hit][wanted[at[hit]] == size]] = True
            more = at + size < end[at]
            at, state = at[more], state[more]
            state = trie.follow[state, data[at + size]]
        alone = np.flatnonzero(~np.repeat(covered[starts], character))
        found.append((alone, alone + 1, trie.byte_piece[data[alone]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _steps(self, depth: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(np.diff(depth, prepend=-1)), len(depth)) if len(depth) else np.zeros(1, np.int64)

    def _forward(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score of each node from its chunk's first node, and the edge into it. Edges come sorted by depth, end and start."""
        nodes = int(self.last[-1]) + 1 if len(self.last) else 0
        forward, into = np.full(nodes, -np.inf), np.full(nodes, -1, np.int64)
        forward[self.first] = 0.0
        steps = self._steps(self.v - self.first[of])
        for a, b in itertools.pairwise(steps.tolist()):
            candidate = forward[self.u[a:b]] + self.score[a:b]
            ends = self.v[a:b]
            new = np.flatnonzero(np.diff(ends, prepend=-1))
            most = np.maximum.reduceat(candidate, new)
            edge = np.where(candidate == np.repeat(most, np.diff(np.append(new, b - a))), np.arange(a, b), np.iinfo(np.int64).max)
            forward[ends[new]] = most
            into[ends[new]] = np.minimum.reduceat(edge, new)
        return forward, into

    def _backward(self, of: np.ndarray) -> np.ndarray:
        """Best score of each node to its chunk's last node."""
        backward = np.full(len(self.forward), -np.inf)
        backward[self.last] = 0.0
        depth = self.u - self.first[of]
        order = np.argsort(depth * len(self.forward) + self.u)
        steps = self._steps(depth[order])
        for a, b in reversed(list(itertools.pairwise(steps.tolist()))):
            edge = order[a:b]
            starts = self.u[edge]
            new = np.flatnonzero(np.diff(starts, prepend=-1))
            backward[starts[new]] = np.maximum.reduceat(self.score[edge] + backward[self.v[edge]], new)
        return backward

    def n_best(self, chunk: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The chunk's n best paths by backward A*: a path's rank is its own score plus the forward score where it ends."""
        if self.by_end is None:
            self.by_end = np.argsort(self.v, kind="stable")
            self.end_bounds = np.searchsorted(self.v[self.by_end], np.arange(len(self.forward) + 1))
        first, last = int(self.first[chunk]), int(self.last[chunk])
        heap = [(-float(self.forward[last]), 0, (), last, 0.0)]
        found: list[tuple[float, tuple[int, ...]]] = []
        while heap and len(found) < n:
            rank, count, path, node, own = heapq.heappop(heap)
            if node == first:
                found.append((-rank, path))
                continue
            for e in self.by_end[self.end_bounds[node] : self.end_bounds[node + 1]].tolist():
                grown = own + float(self.score[e])
                start = int(self.u[e])
                heapq.heappush(heap, (-(grown + float(self.forward[start])), count + 1, (int(self.piece[e]), *path), start, grown))
        return found


class Segmented:
    """Distinct chunks, solved some thousands at a time: only their best pieces, scores and losses stay in memory."""

    def __init__(self, vocabulary: Vocabulary, chunks: pa.Array):
        self.vocabulary, self.chunks = vocabulary, chunks
        ids, sizes, best, loss = [], [], [], []
        for a in range(0, len(chunks), BLOCK_CHUNKS):
            part = Lattices(vocabulary, chunks.slice(a, BLOCK_CHUNKS))
            ids.append(part.ids)
            sizes.append(np.diff(part.bounds))
            best.append(part.best)
            loss.append(part.loss)
        one = lambda found, kind: np.concatenate(found) if found else np.zeros(0, kind)
        self.ids, self.best, self.loss = one(ids, np.int32), one(best, float), one(loss, float)
        self.bounds = np.concatenate([[0], np.cumsum(one(sizes, np.int64))])
        self.known: dict[int, list] = {}

    def search(self, codes: np.ndarray, n: int) -> None:
        """Finds the n best paths of some chunks, for ``known``."""
        codes = np.unique(codes)
        for a in range(0, len(codes), BLOCK_CHUNKS):
            some = codes[a : a + BLOCK_CHUNKS]
            lattices = Lattices(self.vocabulary, self.chunks.take(pa.array(some)))
            self.known.update((int(code), lattices.n_best(i, n)) for i, code in enumerate(some))


def _chunked(trie: _Trie, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of each text's chunks, the distinct chunks, and the bounds of texts among the codes. A text starts with one more space."""
    data, offsets = raw(texts)
    size = np.diff(offsets)
    grown = size + (size > 0)
    ends = np.cumsum(grown)
    out = np.full(int(ends[-1]) if len(ends) else 0, SPACE, np.uint8)
    begins = (ends - grown)[size > 0]
    body = np.ones(len(out), bool)
    body[begins] = False
    out[body] = data
    before = np.empty(len(out), np.uint8)
    before[1:] = out[:-1]
    new = (out == SPACE) & (before != SPACE) | trie.alone[out] | trie.alone[before]
    new[begins] = True
    edges = np.flatnonzero(new)
    bounds = np.searchsorted(edges, np.append(ends - grown, len(out)))
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges), [None, pa.py_buffer(np.append(edges, len(out)).astype(np.int64)), pa.py_buffer(out)])
    coded = chunks.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, bounds


def _nearest(loss: np.ndarray, few: int) -> np.ndarray:
    """Places of the ``few`` smallest losses, earlier ones first among equals."""
    few = min(few, len(loss))
    if not few:
        return np.zeros(0, np.int64)
    near = np.flatnonzero(loss <= np.partition(loss, few - 1)[few - 1])
    return np.sort(near[np.argsort(loss[near], kind="stable")[:few]])


def _alternatives(segmented: Segmented, codes: np.ndarray, starts: np.ndarray, near: np.ndarray, best: float, n: int) -> list[dict]:
    """The n best segmentations of one text, as differences from its best one."""
    choices = []
    for k in near.tolist():
        paths = segmented.known[int(codes[k])]
        choices.append([(0.0, None), *((paths[0][0] - s, (k, ids)) for s, ids in paths[1:])])
    # best first: each step takes the next path of one chunk, never of a chunk before the last one changed
    heap = [(0.0, (0,) * len(choices), 0)]
    out = []
    while heap and len(out) < n:
        lost, pick, last = heapq.heappop(heap)
        changes = [c[i][1] for c, i in zip(choices, pick, strict=True) if i]
        patches = [{"at": int(starts[k]), "drop": int(segmented.bounds[codes[k] + 1] - segmented.bounds[codes[k]]), "ids": list(ids)} for k, ids in changes]
        out.append({"score": best - lost, "patches": patches})
        for j in range(last, len(choices)):
            if pick[j] + 1 < len(choices[j]):
                step = (*pick[:j], pick[j] + 1, *pick[j + 1 :])
                heapq.heappush(heap, (sum(c[i][0] for c, i in zip(choices, step, strict=True)), step, j))
    return out


def encode_slice(vocabulary: Vocabulary, texts: pa.Array, nbest: int = 1) -> tuple[pa.Array, np.ndarray, list]:
    """Pieces of each text, the score, and its nbest list."""
    codes, distinct, bounds = _chunked(vocabulary.trie(), texts)
    lattices = Segmented(vocabulary, distinct)
    counts = np.diff(lattices.bounds)[codes]
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.concatenate([[0], ends])
    flat = lattices.ids[np.repeat(lattices.bounds[codes] - starts, counts) + np.arange(int(total[-1]))]
    ids = pa.ListArray.from_arrays(pa.array(total[bounds], pa.int32()), pa.array(flat, pa.int32()))
    scores = np.add.reduceat(np.append(lattices.best[codes], 0.0), bounds[:-1]) * (np.diff(bounds) > 0) if len(bounds) > 1 else np.zeros(0)
    nbests = []
    if nbest > 1:
        texts_codes = [codes[a:b] for a, b in itertools.pairwise(bounds.tolist())]
        near = [_nearest(lattices.loss[c], nbest - 1) for c in texts_codes]
        lattices.search(np.concatenate([c[k] for c, k in zip(texts_codes, near, strict=True)]) if near else codes[:0], nbest)
        for i, (c, k) in enumerate(zip(texts_codes, near, strict=True)):
            nbests.append(_alternatives(lattices, c, starts[bounds[i] : bounds[i + 1]] - total[bounds[i]], k, float(scores[i]), nbest))
    return ids, scores, nbests


def decode_slice(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    """The texts of lists of pieces."""
    trie = vocabulary.spellings()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    lists = ids.offsets.to_numpy() - (ids.offsets[0].as_py() if len(ids.offsets) else 0)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = trie.size[flat]
    ends = np.cumsum(size)
    out = trie.bytes[np.repeat(trie.start[flat] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    total = np.concatenate([[0], ends])[lists]
    some = np.diff(total) > 0
    keep = np.ones(len(out), bool)
    keep[total[:-1][some]] = False  # the space that encoding put first
    bounds = np.concatenate([[0], np.cumsum(np.diff(total) - some)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[keep])]).cast(pa.large_string()).cast(pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", nbest: int = NBEST, decoded: str | None = None) -> DataFrame:
    """All columns of docs, ids (the best segmentation's pieces), score, and nbest: [(score, patches of ids)], the best one first.

    With ``decoded``, a column of that name has the text that the ids decode to, as ``decode`` gives it, made in the same pass.
    Columns of docs named ids, score, nbest or like ``decoded`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())]
    added += [T.StructField("nbest", NBEST_TYPE)] * (nbest > 1) + [T.StructField(decoded or "", T.StringType())] * (decoded is not None)
    kept = [c for c in docs.columns if c not in {f.name for f in added}]
    rows = docs.select(*kept, F.col(text).cast("string").alias(fresh(docs.columns, "_text")))
    schema = T.StructType([*docs.select(*kept).schema, *added])
    patches = pa.list_(pa.struct([("score", pa.float64()), ("patches", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(kept), SLICE_BYTES):
                ids, scores, nbests = encode_slice(shared.value, part.column(len(kept)), nbest)
                more = [pa.array(nbests, patches)] if nbest > 1 else []
                more += [decode_slice(shared.value, ids)] if decoded is not None else []
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), ids, pa.array(scores), *more], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of encoded and the text of its pieces."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in encoded.columns if c != into]
    names = [*kept, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(a, DECODE_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_slice(shared.value, part.column(kept.index(ids)))], names=names)

    return encoded.select(*kept).mapInArrow(run, T.StructType([*encoded.select(*kept).schema, T.StructField(into, T.StringType())]))


def patched(ids: list[int], patches: list[dict]) -> list[int]:
    """An alternative segmentation from the best one."""
    out = list(ids)
    for p in sorted(patches, key=lambda p: -p["at"]):
        out[p["at"] : p["at"] + p["drop"]] = p["ids"]
    return out
