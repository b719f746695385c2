"""Ranked lexical search over an index whose documents are ordered by recursive graph bisection.

``fit_bisection`` learns the order: documents of a sample of at most ``SAMPLE`` are halved again and again, and pairs are swapped
between halves while that lowers the logarithmic cost of the terms' gaps. Every node keeps what a term says for either half, so
``build_index`` sends each document of the whole table down the tree to its cluster. Clusters are dealt into cells by their measured
bytes, and a cell is a row of the stored index: keys, terms, postings and the highest share that any of its documents gives a
term. ``search`` bounds each cluster's scores for each query by these and visits clusters from the highest bound down, in
waves; a query stops at the first wave whose bounds are all below its lowest kept score. Cells whose own bound is below are not
scored either. A bound that equals the lowest kept score is visited, since a tie goes to the smaller key: the order in the index
is mapped back to keys before ranking, so the result is that of scoring every document.

Defined cases: a null or wordless document is never found and does not count; a null or wordless item finds nothing; items with one
text are searched once and each gets its rows; repeated documents are ranked each; a null key comes before other keys among equal
scores; without documents, or without items, there are no rows.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinegrid.llm.bytewords import ALNUM_LOWER, Words, pieces, word_hashes
from kinegrid.llm.common import cut_lineage, shared_folder

#: Documents from which the bisection is learnt, chosen by a hash of their key.
SAMPLE = 4096
LEVELS = 6
CLUSTERS = 1 << LEVELS
#: Terms are hashed into so many kinds for the bisection; the index itself has the terms.
KINDS = 1 << 14
#: A cell of a cluster has about so many bytes of text.
CELL_BYTES = 4 << 20
PIECE_BYTES = 4 << 20
#: Queries are searched in chunks of about so many bytes; a chunk is held by each task.
CHUNK_BYTES = 2 << 20
#: Clusters visited until the end of each wave, the last wave visits all the others.
WAVES = (1, 8)
TOP = 20
#: Fixed values of the scoring contract.
LENGTH_SHARE, SATURATION, UNIT = 25, 12, 1_000_000_000


# --- order of documents -------------------------------------------------------------------------------------------------


def term_kinds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct kinds of each text's terms, text after text, and their bounds."""
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    pair = np.unique(owner * KINDS + (word_hashes(words) % np.uint64(KINDS)).astype(np.int64))
    return pair % KINDS, np.searchsorted(pair // KINDS, np.arange(len(words.counts) + 1))


def _cost(a: np.ndarray, b: np.ndarray, n: float) -> np.ndarray:
    """Bits of the gaps of terms that a and b documents of two halves of n have."""
    return a * np.log2(n / (a + 1)) + b * np.log2(n / (b + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _rows_of(docs: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    many = bounds[docs + 1] - bounds[docs]
    edge = np.concatenate([[0], np.cumsum(many)])
    return kinds[np.arange(edge[-1]) + np.repeat(bounds[docs] - edge[:-1], many)], edge


def halve(left: np.ndarray, right: np.ndarray, kinds: np.ndarray, bounds: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Swaps documents between two halves, best pairs first, while a pair's swap saves bits."""
    n = max(1.0, (len(left) + len(right)) / 2)
    (kl, el), (kr, er) = _rows_of(left, kinds, bounds), _rows_of(right, kinds, bounds)
    for _ in range(rounds):
        a, b = (np.bincount(k, minlength=KINDS).astype(float) for k in (kl, kr))
        here = _cost(a, b, n)
        gl, gr = _sums((here - _cost(np.maximum(a - 1, 0), b + 1, n))[kl], el), _sums((here - _cost(a + 1, np.maximum(b - 1, 0), n))[kr], er)
        ol, our = np.argsort(-gl, kind="stable"), np.argsort(-gr, kind="stable")
        m = min(len(left), len(right))
        swap = int((gl[ol[:m]] + gr[our[:m]] > 1e-9).sum())
        if not swap:
            break
        left, right = left.copy(), right.copy()
        left[ol[:swap]], right[our[:swap]] = right[our[:swap]], left[ol[:swap]].copy()
        (kl, el), (kr, er) = _rows_of(left, kinds, bounds), _rows_of(right, kinds, bounds)
    return left, right


@dataclass(frozen=True)
class Bisection:
    """By node (1 is the root, 2 i and 2 i + 1 the halves of i): what a term's kind costs more in the left half, and the cut."""

    says: np.ndarray
    cut: np.ndarray

    def clusters(self, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The leaf of each text."""
        node = np.ones(len(bounds) - 1, np.int64)
        owner = np.repeat(np.arange(len(node)), np.diff(bounds))
        for _ in range(LEVELS):
            leaning = np.bincount(owner, self.says[node[owner], kinds], minlength=len(node))
            node = 2 * node + (leaning > self.cut[node])
        return node - CLUSTERS


def fit_bisection(kinds: np.ndarray, bounds: np.ndarray, rounds: int = 8) -> Bisection:
    """The tree of a sample's documents, given by their terms' kinds."""
    says, cut = np.zeros((CLUSTERS, KINDS), np.float32), np.zeros(CLUSTERS)
    held = {1: np.arange(len(bounds) - 1)}
    for node in range(1, CLUSTERS):
        docs = held.pop(node)
        left, right = halve(docs[: (len(docs) + 1) // 2], docs[(len(docs) + 1) // 2 :], kinds, bounds, rounds)
        a, b = (np.bincount(_rows_of(x, kinds, bounds)[0], minlength=KINDS).astype(float) for x in (left, right))
        n = max(1.0, len(docs) / 2)
        here = _cost(a, b, n)
        says[node] = (_cost(a + 1, b, n) - here) - (_cost(a, b + 1, n) - here)
        k, e = _rows_of(docs, kinds, bounds)
        leaning = _sums(says[node][k], e)
        cut[node] = np.median(leaning) if len(docs) else 0.0
        held[2 * node], held[2 * node + 1] = docs[leaning <= cut[node]], docs[leaning > cut[node]]
    return Bisection(says, cut)


def _sampled(docs: DataFrame, sample: int) -> Bisection:
    """The tree, learnt from at most ``sample`` rows of docs (key, text): two bytes a distinct kind of term come to the driver."""
    total = docs.count()
    h = F.xxhash64("key")
    some = docs.withColumn("h", h).where((h.cast("double") / 2.0**64 + 0.5) * max(total, 1) <= 2 * sample) if total > 2 * sample else docs.withColumn("h", h)

    def kinds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, PIECE_BYTES):
                kinds, bounds = term_kinds(Words(part.column(1), ALNUM_LOWER, lower=True))
                rows = [kinds[a:b].astype(np.uint16).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["h", "kinds"])

    found = some.select("h", "text").mapInArrow(kinds_of, "h long, kinds binary").where(F.length("kinds") > 0).orderBy("h", "kinds").limit(sample)
    rows = [np.frombuffer(r["kinds"], np.uint16).astype(np.int64) for r in found.select("kinds").toLocalIterator()]
    return fit_bisection(np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))


# --- the index ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """The stored cells, and what the whole corpus says: documents with a term, and terms with repeats."""

    path: str
    documents: int
    terms: int

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)


def _narrow(values: np.ndarray) -> bytes:
    """A byte that says the width, and the values as unsigned numbers of that width."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return kind.itemsize.to_bytes(1, "little") + values.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The contract's share of a term that occurs tf times in a document of measure m."""
    return UNIT * tf // (1000 * tf + SATURATION * m)


def cell_of(table: pa.Table, documents: int, terms: int) -> pa.RecordBatch:
    """One index row of the documents of a cell."""
    table = table.combine_chunks()
    words = Words(table["text"], ALNUM_LOWER, lower=True)
    codes, own = words.coded()
    count = len(words.counts)
    owner = np.repeat(np.arange(count), words.counts)
    pair, tf = np.unique(codes.astype(np.int64) * count + owner, return_counts=True)
    doc = pair % count
    starts = np.searchsorted(pair, np.arange(len(own) + 1) * count)
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * words.counts.astype(np.int64) * documents) // terms
    most = np.maximum.reduceat(shares(tf, m[doc]), starts[:-1]) if len(own) else np.zeros(0, np.int64)
    keys = table["key"].combine_chunks() if isinstance(table["key"], pa.ChunkedArray) else table["key"]
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return pa.RecordBatch.from_arrays(
        [
            pa.array([table["cluster"][0].as_py()], pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), keys),
            pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.cast(pa.binary())),
            *(pa.array([_narrow(x)], pa.binary()) for x in (starts, doc, tf, m, most)),
        ],
        names=["cluster", "keys", "terms", "starts", "docs", "tfs", "m", "most"],
    )


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, cell_bytes: int = CELL_BYTES) -> Index:
    """Orders and stores the whole table: one shuffle of the texts, by cluster and cell."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    tree = spark.sparkContext.broadcast(_sampled(rows, sample))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for part in pieces(batch, 1, PIECE_BYTES):
                words = Words(part.column(1), ALNUM_LOWER, lower=True)
                some = np.flatnonzero(words.counts)
                cluster = tree.value.clusters(*term_kinds(words)).astype(np.int32)
                at = np.arange(number, number + part.num_rows)
                number += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *map(pa.array, (words.counts.astype(np.int64), cluster, at))], names=["key", "text", "n", "cluster", "at"]
                ).take(pa.array(some))

    key_type = rows.schema["key"].dataType
    placed = rows.mapInArrow(place, T.StructType([rows.schema["key"], T.StructField("text", T.StringType()), *(T.StructField(n, t) for n, t in (("n", T.LongType()), ("cluster", T.IntegerType()), ("at", T.LongType())))]))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
    documents, terms = sum(r["d"] for r in sizes), sum(r["n"] for r in sizes)
    cells = [1] * CLUSTERS
    for r in sizes:
        cells[r["cluster"]] = max(1, -(-r["b"] // cell_bytes))
    # a cluster with a third of the rows has as many cells as its bytes ask for; the row's number deals out copies
    dealt = placed.withColumn("cell", F.pmod(F.xxhash64("key", "at"), F.element_at(F.array(*map(F.lit, cells)), F.col("cluster") + 1)).cast("int"))
    schema = T.StructType(
        [T.StructField("cluster", T.IntegerType()), T.StructField("keys", T.ArrayType(key_type)), T.StructField("terms", T.ArrayType(T.BinaryType()))]
        + [T.StructField(n, T.BinaryType()) for n in ("starts", "docs", "tfs", "m", "most")]
    )
    path = posixpath.join(shared_folder(spark), f"index-{uuid.uuid4().hex}")
    whole = dealt.select("key", "text", "cluster", "cell").groupBy("cluster", "cell").applyInArrow(lambda t: pa.Table.from_batches([cell_of(t, documents, terms)]), schema)
    whole.write.parquet(path)
    return Index(path, documents, terms)


# --- search -------------------------------------------------------------------------------------------------------------


class Queries:
    """Distinct terms of the queries of a chunk, and for each query which it has and how often."""

    def __init__(self, texts: list[str]):
        words = Words(pa.array(texts, pa.string()), ALNUM_LOWER, lower=True)
        codes, self.terms = words.coded() if texts else (np.zeros(0, np.int64), pa.array([], pa.large_binary()))
        width = max(1, len(self.terms))
        owner = np.repeat(np.arange(len(texts)), words.counts) if texts else np.zeros(0, np.int64)
        pair, self.times = np.unique(owner * width + codes, return_counts=True)
        self.term = pair % width
        self.bounds = np.searchsorted(pair // width, np.arange(len(texts) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: np.ndarray, documents: int) -> None:
        self.weight = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)

    def limits(self, most: np.ndarray) -> np.ndarray:
        """By query the highest score that documents with these highest shares by term can have."""
        total = np.concatenate([[0], np.cumsum(self.times * (self.weight * most)[self.term])])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def _known(queries: Queries, terms: pa.Array) -> np.ndarray:
    """Where the cell has each of the queries' terms; -1 if nowhere."""
    return pc.index_in(queries.terms.cast(terms.type), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)


def document_frequencies(index: DataFrame, asked) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.value.terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                known = _known(asked.value, batch.column(0)[row].values)
                some = np.flatnonzero(known >= 0)
                total[some] += np.diff(_wide(batch.column(1)[row].as_py()).astype(np.int64))[known[some]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    found = np.zeros(len(asked.value.terms), np.int64)
    for r in index.select("terms", "starts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        found[r["term"]] = r["n"]
    return found


def _most(queries: Queries, known: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.where(known >= 0, most[known], 0) if len(most) else np.zeros(len(known), np.int64)


def cluster_limits(index: DataFrame, asked, queries: int) -> np.ndarray:
    """By cluster and query the highest limit of the cluster's cells; a task sends at most a row for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((CLUSTERS, queries), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                own = _most(asked.value, _known(asked.value, batch.column(1)[row].values), _wide(batch.column(2)[row].as_py()).astype(np.int64))
                c = batch.column(0)[row].as_py()
                best[c] = np.maximum(best[c], asked.value.limits(own))
        c, q = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(q), pa.array(best[c, q])], names=["c", "q", "most"])

    out = np.zeros((CLUSTERS, queries), np.int64)
    for r in index.select("cluster", "terms", "most").mapInArrow(run, "c long, q long, most long").groupBy("c", "q").agg(F.max("most").alias("most")).toLocalIterator():
        out[r["c"], r["q"]] = r["most"]
    return out


def best_of(scores: np.ndarray, places: np.ndarray, top: int) -> np.ndarray:
    """Indices of the top scores, equal ones by place."""
    if len(scores) > top:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((places[some], -scores[some]))][:top]


def score_cell(queries: Queries, wanted: np.ndarray, known: np.ndarray, starts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, m: np.ndarray, place: np.ndarray, top: int):
    """For each wanted query its best documents of the cell and their scores."""
    ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q in wanted.tolist():
        own = slice(queries.bounds[q], queries.bounds[q + 1])
        total = np.zeros(len(m), np.int64)
        for t, times in zip(queries.term[own].tolist(), queries.times[own].tolist(), strict=True):
            if known[t] < 0:
                continue
            if t not in ready:
                a, b = starts[known[t]], starts[known[t] + 1]
                ready[t] = docs[a:b], queries.weight[t] * shares(tfs[a:b], m[docs[a:b]])
            at, part = ready[t]  # a document is in a term's list once
            total[at] += times * part
        some = np.flatnonzero(total)
        chosen = some[best_of(total[some], place[some], top)]
        yield q, chosen, total[chosen]


def _wave(index: DataFrame, asked, visits: np.ndarray, least: np.ndarray, top: int, key_type) -> DataFrame:
    """(q, key, score): the best documents of the clusters that each query visits, where a cell's limit reaches the query's least score."""
    spark = index.sparkSession
    plan = spark.sparkContext.broadcast((visits, least))
    clusters = np.flatnonzero(visits.any(axis=1)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (visit, lowest) = asked.value, plan.value
        lowest = lowest.copy()
        kept: dict[int, list[int]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
                known = _known(queries, at["terms"].values)
                limit = queries.limits(_most(queries, known, _wide(at["most"].as_py()).astype(np.int64)))
                wanted = np.flatnonzero(visit[at["cluster"].as_py()] & (limit > 0) & (limit >= lowest))
                if not len(wanted):
                    continue
                starts, docs, tfs, m = (_wide(at[n].as_py()).astype(np.int64) for n in ("starts", "docs", "tfs", "m"))
                keys = at["keys"].values
                place = np.empty(len(keys), np.int64)
                place[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
                q_of, doc_of, score_of = [], [], []
                for q, chosen, scores in score_cell(queries, wanted, known, starts, docs, tfs, m, place, top):
                    q_of += [q] * len(chosen)
                    doc_of.append(chosen)
                    score_of.append(scores)
                    best = sorted([*kept.get(q, []), *scores.tolist()], reverse=True)[:top]
                    kept[q] = best
                    if len(best) == top:
                        lowest[q] = max(lowest[q], best[-1])
                if q_of:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_of, pa.int64()), keys.take(pa.array(np.concatenate(doc_of))), pa.array(np.concatenate(score_of))], names=["q", "key", "score"]
                    )

    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("key", key_type), T.StructField("score", T.LongType())])
    return index.where(F.col("cluster").isin(clusters)).select("cluster", "keys", "terms", "most", "starts", "docs", "tfs", "m").mapInArrow(run, schema)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("key").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_chunk(stored: DataFrame, index: Index, texts: list[str], top: int) -> DataFrame:
    spark, key_type = stored.sparkSession, stored.schema["keys"].dataType.elementType
    queries = Queries(texts)
    queries.weigh(document_frequencies(stored, spark.sparkContext.broadcast(queries)), index.documents)
    asked = spark.sparkContext.broadcast(queries)
    limits = cluster_limits(stored, asked, len(texts))
    order = np.argsort(-limits, axis=0, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(CLUSTERS)[:, None], axis=0)
    least = np.zeros(len(texts), np.int64)
    found, since = None, 0
    for until in (*WAVES, CLUSTERS):
        visits = (turn >= since) & (turn < until) & (limits > 0) & (limits >= least)
        since = until
        if not visits.any():
            continue
        wave = _wave(stored, asked, visits, least, top, key_type)
        found = cut_lineage(_ranked(wave if found is None else found.drop("rank").unionByName(wave), top))
        for r in found.where(F.col("rank") == top).select("q", "score").toLocalIterator():
            least[r["q"]] = r["score"]
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField("q", T.LongType()), T.StructField("key", key_type), T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType())]))
    numbered = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q long, _query string")
    return found.join(F.broadcast(numbered), "q").drop("q")


def search(
    index: Index, items: DataFrame, *, item: str = "item_id", text: str = "text", top: int = TOP, into: tuple[str, str, str] = ("rank", "doc_id", "score"), chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """For each row of items its ``top`` documents with a score above 0: item, rank (from 1), key, score."""
    spark = items.sparkSession
    stored = index.read(spark)
    asked = items.select(F.col(item).alias("_item"), F.col(text).cast("string").alias("_query"))
    texts = asked.select("_query").where("_query is not null").distinct()
    size = texts.agg(F.sum(F.octet_length("_query") + 64)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    found = None
    for c in range(chunks):
        own = sorted(r["_query"] for r in (texts.where(F.pmod(F.xxhash64("_query"), F.lit(chunks)) == c) if chunks > 1 else texts).toLocalIterator())
        part = _search_chunk(stored, index, own, top)
        found = part if found is None else found.unionByName(part)
    rank, key, score = into
    return asked.join(found, "_query").select(F.col("_item").alias(item), F.col("rank").alias(rank), F.col("key").alias(key), F.col("score").alias(score))
