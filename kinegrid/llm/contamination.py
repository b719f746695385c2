"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns the corpus into index segments: one row per few megabytes of text, holding the
segment's terms and, for each term, its sorted token positions. Segments are made where the texts are
read, so the index needs no shuffle, and a frequent term is no hot key: its postings are spread over all
segments. ``stored`` writes the segments to the shared folder, so that every search reads postings, not texts.
``search`` counts the test terms in the index, files each test window under its rarest term, and sends the windows to every
segment in chunks of a checked size. A segment looks up the windows of the terms it has; such a
window starts from the postings of its rarest term there and intersects them, shifted by the terms' offsets,
with those of the other terms, from rare to frequent; what is left are exact phrase matches. With
``slop`` it also finds proximity matches: all words in order within ``slop`` more words.

Defined cases: a null or wordless text has no words and no hits; a null or wordless test item has no windows; repeated
documents each get their row; test items with one id count once; a null item id reads as an empty text; an
empty corpus gives no rows, an empty test set no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinegrid.llm.bytewords import ALNUM_LOWER, Words, pieces
from kinegrid.llm.common import cut_lineage, fresh, small_or_joined

SEGMENT_BYTES = 4 << 20
#: Test texts are held by each task in chunks of about so many bytes.
CHUNK_BYTES = 8 << 20
WINDOW = 13

SEGMENT = T.StructType(
    [
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("doc_starts", T.BinaryType()),
        T.StructField("terms", T.ArrayType(T.BinaryType())),
        T.StructField("term_starts", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
    ]
)
FOUND = "key string, row long, n_words long, n_hit long, spans array<struct<s:long,e:long>>, items array<string>, near array<string>"


def _segment(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    words = Words(texts, ALNUM_LOWER, lower=True)
    codes, terms = words.coded()
    starts = np.zeros(len(terms) + 1, np.int64)
    np.cumsum(np.bincount(codes, minlength=len(terms)), out=starts[1:])
    return words.first.astype(np.int64), terms, starts, np.argsort(codes, kind="stable").astype(np.int32)


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1, SEGMENT_BYTES):
            docs, terms, starts, positions = _segment(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.string())),
                    pa.array([docs.tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms.cast(pa.binary())),
                    pa.array([starts.tobytes()], pa.binary()),
                    pa.array([positions.tobytes()], pa.binary()),
                ],
                names=SEGMENT.names,
            )


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Index segments of the whole table: keys as text, bounds of documents, terms and their token positions."""
    return docs.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(_index_batches, SEGMENT)


def stored(index: DataFrame) -> DataFrame:
    """The segments, written to the shared folder."""
    return cut_lineage(index)


def _count_batches(queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = queries.value.terms
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column(0)[row].values
                known = pc.index_in(terms.cast(own.type), value_set=own).fill_null(-1).to_numpy(zero_copy_only=False)
                some = np.flatnonzero(known >= 0)
                total[some] += np.diff(np.frombuffer(batch.column(1)[row].as_py(), np.int64))[known[some]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    return run


def term_counts(index: DataFrame, queries) -> np.ndarray:
    """How often the corpus has each test term: at most one row per term of a chunk of test texts."""
    found = index.select("terms", "term_starts").mapInArrow(_count_batches(queries), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(queries.value.terms), np.int64)
    for r in found:
        counts[r["term"]] = r["n"]
    return counts


class Queries:
    """Test windows by length: where each starts among the term numbers of all items, and its item."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM_LOWER, lower=True)
        self.codes, self.terms = words.coded() if items else (np.zeros(0, np.int64), pa.array([], pa.large_binary()))
        self.ids = [i or "" for i, _ in items]
        size = np.minimum(words.counts, window) if items else np.zeros(0, np.int64)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s in np.unique(size[size > 0]).tolist():
            some = np.flatnonzero(size == s)
            many = words.counts[some] - s + 1
            ends = np.cumsum(many)
            starts = np.arange(int(ends[-1])) - np.repeat(ends - many - words.first[some], many)
            self.groups[s] = starts, np.repeat(some, many)
        self.file(np.zeros(len(self.terms), np.int64))

    def windows(self, size: int, at: np.ndarray) -> np.ndarray:
        return self.codes[self.groups[size][0][at, None] + np.arange(size)]

    def file(self, counts: np.ndarray) -> None:
        """Files windows under their rarest term: filed[size] has the windows in order of that term, and its bounds by term."""
        self.filed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, (starts, _) in self.groups.items():
            rarest = np.zeros(len(starts), np.int64)
            for a in range(0, len(starts), 1 << 16):
                terms = self.windows(size, np.arange(a, min(len(starts), a + (1 << 16))))
                rarest[a : a + len(terms)] = terms[np.arange(len(terms)), counts[terms].argmin(axis=1)]
            order = np.argsort(rarest, kind="stable")
            self.filed[size] = order, np.searchsorted(rarest[order], np.arange(len(self.terms) + 1))


def _held(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def _phrase(lists: list[np.ndarray]) -> np.ndarray:
    """Token positions where the terms stand next to each other: shifted postings, from the rarest term on."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    starts = lists[order[0]] - order[0]
    for k in order[1:]:
        starts = starts[_held(lists[k], starts + k)]
        if not len(starts):
            break
    return starts


def _near(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Pairs (first, last) of token positions where the terms stand in order within ``slop`` more words."""
    rarest = min(range(len(lists)), key=lambda k: len(lists[k]))
    reach = len(lists) + slop
    first = lists[0]
    until = np.searchsorted(first, lists[rarest], "right")  # a start is of use only with the rarest term in its reach
    since = np.maximum(np.searchsorted(first, lists[rarest] - reach, "right"), np.append(0, until[:-1]))
    many = np.maximum(until - since, 0)
    first = first[np.arange(many.sum()) + np.repeat(since - (np.cumsum(many) - many), many)]
    last = first
    for k in range(1, len(lists)):
        if not len(first):
            break
        at = np.searchsorted(lists[k], last, "right")
        ok = at < len(lists[k])
        first, last = first[ok], lists[k][at[ok]]
    ok = last - first < reach
    return np.stack([first[ok], last[ok]], 1)


def search_segment(docs: np.ndarray, terms: pa.Array, starts: np.ndarray, positions: np.ndarray, queries: Queries, slop: int) -> tuple[np.ndarray, set, set]:
    """Which tokens of the segment are hit, and (document, item) of exact and of near matches."""
    n = int(docs[-1])
    change = np.zeros(n + 1, np.int32)
    exact: set[tuple[int, int]] = set()
    near: set[tuple[int, int]] = set()
    if not n or not queries.groups:
        return change[:n] > 0, exact, near
    known = pc.index_in(queries.terms.cast(terms.type), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(known >= 0)
    for size, (_, owner) in queries.groups.items():
        order, bounds = queries.filed[size]
        many = bounds[there + 1] - bounds[there]
        ends = np.cumsum(many)
        asked = order[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many - bounds[there], many)]
        here = known[queries.windows(size, asked)]
        for k in np.flatnonzero((here >= 0).all(axis=1)):
            w = asked[k]
            lists = [positions[starts[t] : starts[t + 1]] for t in here[k]]
            at = _phrase(lists)
            doc = np.searchsorted(docs, at, "right") - 1
            inside = at + size <= docs[doc + 1] if len(at) else np.zeros(0, bool)
            at, doc = at[inside], doc[inside]
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            exact.update((d, int(owner[w])) for d in np.unique(doc).tolist())
            if slop:
                pair = _near(lists, slop)
                doc = np.searchsorted(docs, pair[:, 0], "right") - 1
                near.update((d, int(owner[w])) for d in np.unique(doc[pair[:, 1] < docs[doc + 1]]).tolist())
    return np.cumsum(change[:n]) > 0, exact, near


def _search_batches(queries, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        for batch in batches:
            for row in range(batch.num_rows):
                keys, doc_starts, terms, term_starts, positions = (batch.column(i)[row] for i in range(5))
                docs = np.frombuffer(doc_starts.as_py(), np.int64)
                hit, exact, near = search_segment(
                    docs, terms.values, np.frombuffer(term_starts.as_py(), np.int64), np.frombuffer(positions.as_py(), np.int32), asked, slop
                )
                count = len(docs) - 1
                content = hashlib.blake2b(doc_starts.as_py() + positions.as_py() + repr(keys.as_py()).encode(), digest_size=7)
                numbered = int.from_bytes(content.digest(), "big") + np.arange(count)
                total = np.concatenate([[0], np.cumsum(hit)])
                spans: list[list] = [[] for _ in range(count)]
                items: list[set] = [set() for _ in range(count)]
                close: list[set] = [set() for _ in range(count)]
                for d in {d for d, _ in exact}:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[docs[d] : docs[d + 1]].astype(np.int8), [0]])))
                    spans[d] = [{"s": int(s), "e": int(e)} for s, e in edge.reshape(-1, 2)]
                for found, into in ((exact, items), (near, close)):
                    for d, i in found:
                        into[d].add(asked.ids[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.values,
                        pa.array(numbered),
                        pa.array(np.diff(docs)),
                        pa.array(total[docs[1:]] - total[docs[:-1]]),
                        pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array([sorted(x) for x in close], pa.list_(pa.string())),
                    ],
                    names=["key", "row", "n_words", "n_hit", "spans", "items", "near"],
                )

    return run


def _covered(spans):
    """Words under the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n")
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def search(index: DataFrame, tests: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: key, row (of the index), n_words, n_hit, spans of hit words, items and near (sorted item ids).

    The test texts' size is measured first. Up to ``chunk_bytes`` they are one chunk; a larger test set is
    dealt into chunks by a hash of its text, each searched in a pass of its own, and a document's spans and
    items are united.
    """
    spark = index.sparkSession
    wanted = tests.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    size = wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    passes = []
    for c in range(chunks):
        rows = wanted.where(F.pmod(F.xxhash64("t"), F.lit(chunks)) == c) if chunks > 1 else wanted
        queries = Queries([tuple(r) for r in rows.toLocalIterator()], window)
        queries.file(term_counts(index, spark.sparkContext.broadcast(queries)))
        asked = spark.sparkContext.broadcast(queries)
        passes.append(index.mapInArrow(_search_batches(asked, slop), FOUND))
    if chunks == 1:
        return passes[0]
    return _united(passes)


def _united(passes: list[DataFrame]) -> DataFrame:
    """The passes' rows of one document meet by their row number in the index."""
    every = passes[0]
    for other in passes[1:]:
        every = every.union(other)
    grouped = every.groupBy("key", "row", "n_words").agg(
        (F.count("*") / len(passes)).cast("int").alias("copies"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
    )
    return grouped.select(F.explode(F.sequence(F.lit(1), "copies")), "*").select(
        "key", "row", "n_words", _covered(F.col("spans")).alias("n_hit"), F.array_sort("spans").alias("spans"), "items", "near"
    )


def contaminated(n_hit, n_words):
    """The contract's rule: a twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, tests: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    A contaminated row is known by 128 bits of its key and text: a few bytes each, joined by broadcast where they are few.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h, g = (F.xxhash64(F.lit(salt), F.col(key).cast("string"), body) for salt in (1, 2))
    both = docs.select(F.concat_ws(" ", h, g).alias("key"), F.col(text).cast("string").alias("text"))
    found = search(stored(build_index(both, key="key", text="text")), tests, item=item, text=item_text)
    at, and_at = (fresh(docs.columns, n) for n in ("_h", "_g"))
    number = lambda i: F.split("key", " ")[i].cast("long")
    bad = small_or_joined(found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(number(0).alias(at), number(1).alias(and_at)).distinct())
    return docs.withColumns({at: h, and_at: g}).join(bad, [at, and_at], "left_anti").select(*docs.columns)
