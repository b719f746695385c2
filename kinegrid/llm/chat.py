"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line end. Control strings inside roles and texts are escaped
reversibly, so the markers of a formatted conversation are those of its template and nothing else. For
each Arrow batch the lengths of all segments (marks, roles, texts) and their running offsets are computed in
numpy, one Arrow buffer is allocated, and headers and contents are copied to scatter indices. The loss
mask is a list of code point spans: the assistants' texts.

Rows are shuffled by conversation once and sorted inside partitions; batches stream, so a task holds one batch
and at most ``PART_BYTES`` of an open conversation. A conversation beyond that is several parts, in order.

Defined cases: a null text or role is empty; turns are sorted by turn (null first), then role and text; repeated rows are
turns of their own; null conversation ids are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinegrid.llm.bytewords import raw

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNT_ROLE = "assistant"
PART_BYTES = 32 << 20
#: What stands for a control string inside a role or a text. The backslash comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = ((":", "\\c"), ("\n", "\\n"))
MEANING = {e[1]: c for c, e in (*ESCAPES, *ROLE_ESCAPES)}
SPANS = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


def escaped(column: pa.Array, pairs=ESCAPES) -> pa.Array:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    for control, stands in pairs:
        column = pc.replace_substring(column, control, stands)
    return column


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: MEANING[m[1]], text) if "\\" in text else text


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns end to end in one buffer, the offsets of turns, and (turns, 2) byte bounds of the texts."""
    n = len(roles)
    parts = [raw(pa.array([OPEN])), raw(escaped(roles, ESCAPES + ROLE_ESCAPES)), raw(pa.array([AFTER_ROLE])), raw(escaped(texts)), raw(pa.array([CLOSE]))]
    fixed = [len(offsets) == 2 and k in (0, 2, 4) for k, (_, offsets) in enumerate(parts)]
    lengths = np.stack([np.full(n, len(data)) if same else np.diff(offsets) for same, (data, offsets) in zip(fixed, parts, strict=True)], axis=1) if n else np.zeros((0, 5), np.int64)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, (same, (data, _)) in enumerate(zip(fixed, parts, strict=True)):
        if same:
            out[(starts[:, k, None] + np.arange(len(data))).ravel()] = np.tile(data, n)
        else:
            source = np.concatenate([[0], np.cumsum(lengths[:, k])[:-1]]) if n else np.zeros(0, np.int64)
            out[np.repeat(starts[:, k] - source, lengths[:, k]) + np.arange(len(data))] = data
    turns = np.append(starts[:, 0], len(out)) if n else np.zeros(1, np.int64)
    return out, turns, np.stack([starts[:, 3], starts[:, 3] + lengths[:, 3]], axis=1)


class _Open:
    """The conversation that the last batch may have left unfinished."""

    def __init__(self, key):
        self.key, self.part, self.turns, self.points = key, 0, 0, 0
        self.bytes: list[bytes] = []
        self.spans: list[dict] = []

    def add(self, data: np.ndarray, turns: int, spans: np.ndarray, points: int) -> None:
        self.bytes.append(data.tobytes())
        self.spans += [{"s": int(s) + self.points, "e": int(e) + self.points} for s, e in spans]
        self.turns += turns
        self.points += points

    def row(self, last: bool) -> dict:
        row = {"key": self.key, "part": self.part, "last": last, "n_turns": self.turns, "formatted": b"".join(self.bytes).decode(), "loss": self.spans}
        self.part, self.turns, self.points, self.bytes, self.spans = self.part + 1, 0, 0, [], []
        return row


def _format_batches(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Open | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out, turns, texts = assemble(batch.column(1), batch.column(2))
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            learnt = pc.fill_null(pc.equal(batch.column(1), LEARNT_ROLE), False).to_numpy(zero_copy_only=False)
            keys = batch.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if current is None or current.key != keys[a]:
                    if current is not None:
                        rows.append(current.row(True))
                    current = _Open(keys[a])
                base = points[turns[a]]
                spans = points[texts[a:b][learnt[a:b]]] - base
                current.add(out[turns[a] : turns[b]], b - a, spans, int(points[turns[b]] - base))
                if sum(map(len, current.bytes)) > PART_BYTES:
                    rows.append(current.row(False))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.row(True)], schema)

    return run


def format_conversations(turns: DataFrame, *, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, part, last, n_turns, formatted, loss): a conversation's parts in order, in one partition; most have one part.

    loss: spans of code points of ``formatted``, the escaped texts that are learnt.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = turns.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("part", T.LongType()),
            T.StructField("last", T.BooleanType()),
            T.StructField("n_turns", T.LongType()),
            T.StructField("formatted", T.StringType()),
            T.StructField("loss", SPANS),
        ]
    )
    rows = turns.select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("t"))
    rows = rows.repartition("key").sortWithinPartitions("key", "o", "r", "t").select("key", "r", "t")
    return rows.mapInArrow(_format_batches(to_arrow_schema(schema)), schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part."""
    found, at = [], 0
    while at < len(formatted):
        colon = formatted.index(AFTER_ROLE, at)
        end = formatted.index(CLOSE, colon)
        found.append((unescaped(formatted[at + len(OPEN) : colon]), unescaped(formatted[colon + len(AFTER_ROLE) : end])))
        at = end + len(CLOSE)
    return found


def _digest_batches(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns_sha, loss_sha, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row["formatted"]
                for role, said in read_back(text):
                    turns_sha.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                for span in row["loss"]:
                    learnt = unescaped(text[span["s"] : span["e"]])
                    loss_sha.update(learnt.encode())
                    counts[1] += len(learnt)
                counts[2] += len(text)
                if row["last"]:
                    rows.append((row["key"], counts[0], turns_sha.hexdigest(), counts[1], loss_sha.hexdigest(), counts[2]))
                    turns_sha, loss_sha, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What a reader of ``format_conversations`` finds: turns, their digest, and the text under the loss mask."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(
        [
            T.StructField(key, formatted.schema["key"].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )
    return formatted.mapInArrow(_digest_batches(to_arrow_schema(schema)), schema)
