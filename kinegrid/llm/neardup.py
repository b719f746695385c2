"""Near-duplicate classes by ProbMinHash, banding and verification.

Documents are bags of word shingles, weighted by their number. ProbMinHash draws the arrivals of a Poisson
process for each shingle, at the shingle's weight as rate; an arrival goes to a random component of the signature,
which keeps the shingle that came first. A shingle is dropped as soon as its next arrival is later than every
component's first one (early termination). The share of equal components of two signatures estimates the probability
Jaccard similarity, whatever the texts' lengths.

1. Equal texts (by the 128-bit hash of their words) are one node of the graph.
2. Bands of the signature put nodes into buckets. Each node is paired with the least node of all its buckets: one pair per node.
3. The pairs are verified on their whole texts; a verified node gets the label of its least node, which closes most buckets of close copies.
4. A bucket with several labels is open. Its most frequent label is the base, the other nodes are probes: probes meet the base and each other
   in cells of about ``BLOCK`` nodes (and ``CELL_BYTES`` of text) a side, which compare signatures. A bucket of m nodes and k probes is
   m + k * (m / BLOCK) rows as long as k is below BLOCK.
5. All pairs of a cell with different labels whose estimate is not far below the threshold (``SLACK``, five standard deviations) are verified.
   A cell with few of them lists them; of a cell with many, each node is sent once with its text, and the pairs are compared where they meet
   until all that they connect is connected. So every pair of a bucket is linked, rejected, or already connected, and no row stands for
   a pair of a large group.
6. Components of all links are the classes. A class's id is its least document key.

With 32 bands of 6 components a pair with similarity 0.8 shares no bucket with probability 6e-5.

Defined cases: a text of 1 to 4 words is one shingle; a text without words (or a null one) is in a class with documents of
the same key only; repeated rows are copies; a null key is never a class id unless all keys of the class are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinegrid.llm.bytewords import NOT_SPACE, Words, mixed, pieces, shingles, word_hashes
from kinegrid.llm.common import cut_lineage, fresh, small_or_joined
from kinegrid.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
COMPONENTS = BANDS * ROWS
#: A pair is verified unless its estimate is lower than the threshold by more.
SLACK = 5 * (0.8 * 0.2 / COMPONENTS) ** 0.5
BLOCK, CELL_BYTES = 1024, 16 << 20
#: A cell lists its pairs up to so many times its nodes.
LISTED = 1
PIECE_BYTES = 4 << 20
VERIFY_BYTES = 8 << 20
VERIFY_SHINGLES = 1 << 18


def bags(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their numbers."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes))).astype(np.float64)


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, components: int = COMPONENTS) -> np.ndarray:
    """ProbMinHash of each text, 16 bits of the first shingle per component; zeros for a text without shingles."""
    first = np.full(texts * components, np.inf)
    found = np.zeros(texts * components, np.uint16)
    value = (mixed(shingle ^ np.uint64(0x5DEECE66D)) >> np.uint64(48)).astype(np.uint16)
    time = np.zeros(len(owner))
    seed, scale, base = shingle, 1.0 / weight, owner * components
    arrival = 0
    while len(owner):
        arrival += 1
        draw = mixed(seed + np.uint64(arrival * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) * scale
        slot = base + (((draw & np.uint64(2047)) * np.uint64(components)) >> np.uint64(11)).astype(np.int64)
        early = np.flatnonzero(time < first[slot])
        np.minimum.at(first, slot[early], time[early])
        won = early[time[early] == first[slot[early]]]
        found[slot[won]] = value[won]
        latest = first.reshape(texts, components).max(axis=1)
        active = time < latest[owner]
        owner, seed, scale, base, time, value = owner[active], seed[active], scale[active], base[active], time[active], value[active]
    return found.reshape(texts, components)


def _nodes(words: Words, hashes: np.ndarray, keys: pa.Array) -> list[bytes]:
    """128 bits of each text's words; of its key for a text without words."""
    counts, n = words.counts, len(words.counts)
    some = np.flatnonzero(counts)
    place = (np.arange(len(hashes)) - np.repeat(words.first[:-1], counts)).astype(np.uint64)
    out = np.zeros((n, 2), np.uint64)
    with np.errstate(over="ignore"):
        for half, salt in enumerate((0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127)):
            if len(some):
                terms = mixed(hashes ^ mixed(place + np.uint64(salt)))
                out[some, half] = mixed(np.add.reduceat(terms, words.first[some]) + counts[some].astype(np.uint64))
    nodes = [row.tobytes() for row in out]
    for i in np.flatnonzero(counts == 0):
        nodes[i] = hashlib.blake2b(str(keys[int(i)].as_py()).encode(), digest_size=16, person=b"no words").digest()
    return nodes


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1, PIECE_BYTES):
            words = Words(part.column(1), NOT_SPACE, lower=True)
            hashes = word_hashes(words)
            found, bounds = shingles(hashes, words.first, WORDS)
            owner, shingle, weight = bags(found, bounds)
            signed = signatures(owner, shingle, weight, part.num_rows)
            sketch = [s.tobytes() if n else None for s, n in zip(signed, words.counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(_nodes(words, hashes, part.column(0)), pa.binary()), pa.array(sketch, pa.binary()), pa.array(np.diff(words.offsets))],
                names=["key", "node", "sketch", "bytes"],
            )


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, sketch, bytes) of every row; sketch is null for a text without words."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["key"], T.StructField("node", T.BinaryType()), T.StructField("sketch", T.BinaryType()), T.StructField("bytes", T.LongType())])
    return rows.mapInArrow(_sketch_batches, schema)


def with_nodes(docs: DataFrame, key: str, text: str, into: str = "_node") -> DataFrame:
    """All columns of docs, and the node of each row's text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, names.index(text), PIECE_BYTES):
                words = Words(part.column(names.index(text)), NOT_SPACE, lower=True)
                nodes = _nodes(words, word_hashes(words), part.column(names.index(key)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.binary())], names=[*names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(into, T.BinaryType())]))


def probability_jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact similarity of the texts of each row."""
    sides = []
    for texts in (a, b):
        words = Words(texts, NOT_SPACE, lower=True)
        sides.append(bags(*shingles(word_hashes(words), words.first, WORDS)))
    return bag_similarity(sides, len(a))


def bag_similarity(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Similarity of n pairs of bags. sides: the pair's number, shingle and weight of all entries of the first and of the second bags."""
    owner = np.concatenate([s[0] for s in sides])
    shingle = np.concatenate([s[1] for s in sides])
    weight = np.zeros((len(owner), 2))
    weight[: len(sides[0][0]), 0] = sides[0][2]
    weight[len(sides[0][0]) :, 1] = sides[1][2]
    order = np.lexsort((shingle, owner))
    owner, shingle, weight = owner[order], shingle[order], weight[order]
    new = np.ones(len(owner), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(n)
    owner, weight = owner[at], np.add.reduceat(weight, at, axis=0)
    # sum over x of max(a_x / a_d, b_x / b_d): x with a ratio b/a up to that of d count by a, the others by b
    ratio = np.where(weight[:, 0] > 0, weight[:, 1] / np.maximum(weight[:, 0], 1e-300), np.inf)
    order = np.lexsort((ratio, owner))
    owner, weight = owner[order], weight[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    total = np.concatenate([np.zeros((1, 2)), np.cumsum(weight, axis=0)])
    up_to = total[1:, 0] - total[bounds[owner], 0]
    beyond = total[bounds[owner + 1], 1] - total[1:, 1]
    both = (weight > 0).all(axis=1)
    share = np.zeros(len(owner))
    share[both] = 1.0 / (up_to[both] / weight[both, 0] + beyond[both] / weight[both, 1])
    return np.bincount(owner, weights=share, minlength=n)


def _verify_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, VERIFY_BYTES, 2000):
                for half in pieces(part, 3, VERIFY_BYTES):
                    similar = pa.array(probability_jaccard(half.column(2), half.column(3)) >= threshold - 1e-9)
                    yield pa.RecordBatch.from_arrays([half.column(0).filter(similar), half.column(1).filter(similar)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar. texts: (node, text), one row per node."""
    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify_batches(threshold), "a binary, b binary")


class _Cell:
    """The rows of a cell, and the pairs x, y of them in different components (and on different sides) whose estimate is high enough."""

    def __init__(self, rows: pa.Table, lowest: float):
        self.rows, n = rows, rows.num_rows
        component = rows["component"].combine_chunks().dictionary_encode().indices.to_numpy()
        self.component, self.signed = component, np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(n, -1)
        block, one = rows["block"].to_numpy(), rows["i"][0].as_py() == rows["j"][0].as_py()
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in range(n - 1) if component.any() else ():
            other = component[x + 1 :] != component[x]
            if not one:
                other &= block[x + 1 :] != block[x]
            at = np.flatnonzero(other) + x + 1
            at = at[(self.signed[at] == self.signed[x]).mean(axis=1) >= lowest]
            xs.append(np.full(len(at), x)), ys.append(at)
        self.x, self.y = np.concatenate(xs), np.concatenate(ys)

    def first_met(self) -> _Cell:
        """Pairs whose first common bucket this is: no pair is compared twice."""
        band = self.rows["band"][0].as_py()
        bands = self.signed.reshape(self.rows.num_rows, BANDS, ROWS)[:, : band + 1]
        step = range(0, len(self.x), 4096)
        first = [(bands[self.x[k : k + 4096]] == bands[self.y[k : k + 4096]]).all(axis=2).argmax(axis=1) for k in step]
        at = np.flatnonzero(np.concatenate(first) == band) if first else np.zeros(0, np.int64)
        self.x, self.y = self.x[at], self.y[at]
        return self

    def pairs(self) -> tuple[list[bytes], list[bytes]]:
        names = self.rows["node"].to_pylist()
        both = [sorted((names[i], names[j])) for i, j in zip(self.x.tolist(), self.y.tolist(), strict=True)]
        return [p[0] for p in both], [p[1] for p in both]


def _by_cell(of_cell: Callable[[pa.Table], pa.Table]):
    """Rows come sorted by (bucket, i, j); a cell that a batch ends in goes on in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            keys = np.stack([rows[c].to_numpy() for c in ("bucket", "i", "j")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            found = [of_cell(rows.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if found:
                yield from pa.concat_tables(found).combine_chunks().to_batches()
            rest = rows.slice(edges[-1]).combine_chunks()
        if rest is not None:
            yield from of_cell(rest).to_batches()

    return run


CELL = "bucket long, i int, j int, block int, node binary, component binary, sketch binary, band int"
CELL_NAMES = [c.split()[0] for c in CELL.split(", ")]


def _open(lowest: float):
    """A cell's pairs (a, b), or its rows with pairs if there are many."""

    def run(group: pa.Table) -> pa.Table:
        cell = _Cell(group, lowest).first_met()
        nodes = np.unique(np.concatenate([cell.x, cell.y]))
        if len(cell.x) > LISTED * len(nodes):
            rows = group.select(CELL_NAMES).take(pa.array(nodes))
            return pa.table([pa.nulls(len(nodes), pa.binary())] * 2 + rows.columns, names=["a", "b", *CELL_NAMES])
        a, b = cell.pairs()
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), *(pa.nulls(len(a), group.schema.field(c).type) for c in CELL_NAMES)], names=["a", "b", *CELL_NAMES])

    return run


def _cell_links(lowest: float, threshold: float):
    """Verified links of a cell's rows with their texts: enough of them to connect all that links of it connect."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cell = _Cell(group, lowest).first_met()
        words = Words(group["text"], NOT_SPACE, lower=True)
        owner, shingle, weight = bags(*shingles(word_hashes(words), words.first, WORDS))
        bounds = np.searchsorted(owner, np.arange(group.num_rows + 1))
        size, total = np.diff(bounds), np.add.reduceat(weight, bounds[:-1])
        code = np.unique(shingle, return_inverse=True)[1]
        share = np.zeros(int(code.max(initial=-1)) + 1)
        component, linked = cell.component.copy(), []

        def entries(of: np.ndarray) -> np.ndarray:
            ends = np.cumsum(size[of])
            return np.repeat(bounds[of] - (ends - size[of]), size[of]) + np.arange(int(ends[-1]))

        def side(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = entries(of)
            return np.repeat(np.arange(len(of)), size[of]), shingle[at], weight[at]

        x, y = cell.x, cell.y  # sorted by x
        edges = np.flatnonzero(np.diff(x, prepend=-1, append=-1))
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            one = x[first]
            own = slice(bounds[one], bounds[one + 1])
            share[code[own]] = weight[own] / total[one]
            while first < last:
                some = y[first : first + max(1, int(np.searchsorted(np.cumsum(size[y[first:last]]), VERIFY_SHINGLES)))]
                first += len(some)
                some = some[component[some] != component[one]]
                if not len(some):
                    continue
                # the overlap of the normalised bags is an upper bound of the similarity
                at = entries(some)
                overlap = np.minimum(share[code[at]], weight[at] / np.repeat(total[some], size[some]))
                some = some[np.add.reduceat(overlap, np.cumsum(size[some]) - size[some]) >= threshold - 1e-9]
                if not len(some):
                    continue
                similar = bag_similarity([side(np.full(len(some), one)), side(some)], len(some)) >= threshold - 1e-9
                for two in some[similar]:
                    if component[one] != component[two]:
                        component[component == component[two]] = component[one]
                        linked.append((one, two))
            share[code[own]] = 0.0
        names = group["node"].to_pylist()
        return pa.table([pa.array([names[k[e]] for k in linked], pa.binary()) for e in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(key, node, component, class_id, class_size) for every row, and (node, component) of nodes with links."""
    rows = cut_lineage(sketches(docs, key, text))
    nodes = cut_lineage(rows.where("sketch is not null").groupBy("node").agg(F.first("sketch").alias("sketch"), F.max("bytes").alias("bytes")))
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * 2 * ROWS + 1, F.lit(2 * ROWS))))
    banded = nodes.select("node", "bytes", F.posexplode(band).alias("band", "bucket"))
    # Buckets of the same nodes (close copies share most bands) compare the same pairs: the one of the first band stands for them.
    buckets = banded.groupBy("bucket").agg(
        F.min("node").alias("hub"), F.max("node").alias("top"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("all"), F.first("band").alias("band")
    )
    hubs = buckets.where("hub <> top").groupBy("hub", "top", "m", "all").agg(F.min_by("bucket", F.struct("band", "bucket")).alias("bucket")).select("bucket", "hub")
    members = cut_lineage(banded.join(hubs, "bucket"))  # of buckets with several nodes

    involved = members.select("node").distinct()
    bodies = with_nodes(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "key", "text").select(F.col("_node").alias("node"), "text")
    # one text per node before the join: a text that a third of all rows share is a row per task
    texts = cut_lineage(bodies.groupBy("node").agg(F.first("text").alias("text")).join(involved, "node", "left_semi"))

    def cells(joined: DataFrame) -> DataFrame:
        """The nodes of buckets with several components, in cells. Probes have the first block numbers, the base has those after."""
        placed = members.join(joined, "node", "left").select("bucket", "band", "node", "bytes", F.coalesce("component", "node").alias("component"))
        parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
        largest = F.max(F.struct("n", "component", "b"))
        opened = parts.groupBy("bucket").agg(largest.alias("base"), F.sum("n").alias("m"), F.sum("b").alias("bytes")).where("base.n < m")
        small = (F.col("m") <= BLOCK) & (F.col("bytes") <= CELL_BYTES)
        blocks = lambda n, b: F.greatest(F.ceil(n / BLOCK), F.ceil(b / CELL_BYTES), F.lit(1))
        shaped = opened.select(
            "bucket",
            F.when(~small, F.col("base.component")).alias("base"),
            F.when(small, 1).otherwise(blocks(F.col("m") - F.col("base.n"), F.col("bytes") - F.col("base.b"))).cast("int").alias("probes"),
            F.when(small, 0).otherwise(blocks(F.col("base.n"), F.col("base.b"))).cast("int").alias("bases"),
        )
        place = F.xxhash64("node", "bucket")
        in_base = F.col("component").eqNullSafe(F.col("base"))
        block = F.when(in_base, F.col("probes") + F.pmod(place, F.col("bases"))).otherwise(F.pmod(place, F.col("probes"))).cast("int")
        others = F.when(in_base, F.col("probes")).otherwise(F.col("probes") + F.col("bases"))
        return (
            placed.join(shaped, "bucket").join(nodes.select("node", "sketch"), "node")
            .select("bucket", "band", "node", "component", "sketch", block.alias("block"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
            .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "sketch", "band")
        )

    def compared(joined: DataFrame, of_cell, schema: str) -> DataFrame:
        return cells(joined).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_by_cell(of_cell), schema)

    lowest = threshold - SLACK
    stars = members.where("node <> hub").groupBy("node").agg(F.min("hub").alias("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = cut_lineage(verified(stars, texts, threshold))
    labels = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    rest = cells(labels).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_by_cell(_open(lowest)), f"a binary, b binary, {CELL}")
    rest = cut_lineage(rest)
    met = rest.where("a is null").drop("a", "b").join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(_cell_links(lowest, threshold), "a binary, b binary")
    listed = verified(rest.where("a is not null").select("a", "b"), texts, threshold)
    classes = connected_components(links.union(listed).union(met))

    placed_rows = rows.select("key", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    totals = placed_rows.groupBy("component").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size"))
    return placed_rows.join(totals, "component").select(F.col("key").alias(key), "node", "component", "class_id", "class_size"), classes


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least key; all columns of docs.

    A class is a chain of similar texts, so the document that stays can be less similar to some of the others.
    """
    classed, _ = near_duplicates(docs, key=key, text=text, threshold=threshold)
    # keys need not be unique: of a class's rows with the least key one text stays, of its repeated rows one
    shared = classed.where("class_size > 1").select("component", "node", F.col(key).alias("k"), F.col(key).eqNullSafe(F.col("class_id")).alias("least"))
    stays = shared.where("least").groupBy("component").agg(F.min("node").alias("stay"))
    texts = shared.groupBy("component", "node", "k").agg(F.count("*").alias("n"), F.max("least").alias("least")).join(stays, "component")
    repeated = F.col("least") & (F.col("node") == F.col("stay"))
    name, k = (fresh(docs.columns, x) for x in ("_node", "_key"))
    marked = texts.where(~repeated | (F.col("n") > 1)).select(F.col("node").alias(name), F.col("k").alias(k), repeated.alias("again"))
    marks = small_or_joined(marked)
    rows = with_nodes(docs, key, text, name)
    met = (rows[name] == marks[name]) & rows[key].eqNullSafe(marks[k])
    kept = rows.join(marks, met, "left_anti").select(*docs.columns)
    again = marks.where("again")
    if again.isEmpty():
        return kept
    return kept.union(rows.join(again, (rows[name] == again[name]) & rows[key].eqNullSafe(again[k]), "left_semi").dropDuplicates([name, key]).select(*docs.columns))
