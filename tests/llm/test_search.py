"""Importance resampling, ranked search and toxicity against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinegrid.llm import lexical, queries, resampling, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CASES = ["the cat sat on the mat", None, "", "!!", "The CAT ñandú, 梦 cat", "dog " * 400, "the cat sat on the mat", "w" * 3000 + " tail", "a b c d e f g h i j k l m n o p q r s t u v w x y z"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "rank", "_n", "_text", "key")})


def against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(map(tuple, found.fetchall()), key=repr)


def test_crc32s():
    data = bytearray("ñandú of the cat".encode() + b"x" * 200)
    spans = [(0, 7), (7, 7), (8, 10), (3, 190), (0, 64), (0, 65)]
    array = np.frombuffer(bytes(data), "uint8")
    starts, ends = (np.array(x) for x in zip(*spans, strict=True))
    assert resampling.crc32s(array, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


def resampled(rows, target, runs, least, percent, buckets):
    def features(t):
        w = words(t)
        return [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for k, x in rows:
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    quota = percent * len(enough) // 100
    drawn = [(*r, i + 1 if i < quota else None) for i, r in enumerate(enough)] + [(*r, None) for r in out if r[1] < least]
    return sorted(drawn, key=repr)


@pytest.mark.parametrize("runs,least,percent", [(1, 1, 60), (2, 5, 100), (3, 1, 0)])
def test_resampling_is_brute_force(spark, runs, least, percent):
    rows = list(enumerate(CASES * 3)) + [(None, CASES[0])] * 9 + [(5, "dog " * 400)] * 3
    target = ["the cat", "ñandú dog", None]
    got = resampling.importance_resample(
        docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), runs=runs, least_words=least, percent=percent, buckets=50
    ).collect()
    assert sorted((tuple(r) for r in got), key=repr) == resampled(rows, target, runs, least, percent, 50)


def test_resampling_without_rows(spark):
    none, one = docs(spark, []), docs(spark, [(1, "a b c")])
    assert resampling.importance_resample(none, one.select("text")).count() == 0
    assert resampling.importance_resample(one, one.select("text").limit(0), least_words=1, percent=100).first()["rank"] == 1


def test_resampling_against_sql(spark):
    against_sql(spark, "op11_importance_resampling")


def ranked_by_force(rows, items, top):
    counts = [(k, Counter(words(t))) for k, t in rows]
    counts = [(k, c) for k, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for i, t in items:
        scores = []
        for k, c in counts:
            m = 75 + (25 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in words(t) if c[w])
            scores.append((-s, k is not None, k or 0))
        out += [(i, r + 1, k if some else None, -s) for r, (s, some, k) in enumerate(sorted(scores)[:top]) if s < 0]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell_bytes,top,chunk_bytes", [(100, 3, 100), (4 << 20, 20, 2 << 20), (2000, 1, 300)])
def test_search_is_brute_force(spark, cell_bytes, top, chunk_bytes):
    rows = list(enumerate(CASES * 4 + ["the cat", "mat mat", "sat on the mat the cat"])) + [(None, CASES[0])] * 2
    items = [(1, "the CAT"), (2, "cat cat mat"), (2, "ñandú zebra"), (4, None), (5, "?!"), (None, "the CAT"), (7, "a z dog w"), (8, "nothing known")]
    index = lexical.build_index(docs(spark, rows), sample=16, cell_bytes=cell_bytes)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), top=top, chunk_bytes=chunk_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked_by_force(rows, items, top)


def test_search_without_rows(spark):
    none, one = docs(spark, []), docs(spark, [(1, "a b c")])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), items).count() == 0
    assert lexical.search(lexical.build_index(one), items.limit(0)).count() == 0


def test_bisection_groups_like_with_like():
    rng = np.random.default_rng(3)
    topic = rng.permutation(np.repeat(np.arange(8), 64))
    kinds = [np.unique(t * 200 + rng.integers(0, 200, 60)) for t in topic]
    bounds = np.concatenate([[0], np.cumsum([len(k) for k in kinds])])
    tree = lexical.fit_bisection(np.concatenate(kinds), bounds)
    leaf = tree.clusters(np.concatenate(kinds), bounds)
    together = [Counter(topic[leaf == c]).most_common(1)[0][1] for c in np.unique(leaf)]
    assert sum(together) / len(topic) > 0.9


def test_search_against_sql(spark):
    against_sql(spark, "op12_ranked_search")


def distance(a, b):
    """Edits and swaps of neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_brute_force():
    terms = sorted(["idiot\0", "moron\0", "worthless\0", "disgusting\0", "scum\0", "réeux", "ab", "abc\0", "abcde\0", "réeuxou\0"])
    rng, found = np.random.default_rng(1), {"", "idoit", "wrothles", "abdce", "réeuxoi", "x" * 60, "ab" * 40}
    for t in terms:
        for _ in range(200):
            w = list(t.strip("\0"))
            for _ in range(rng.integers(0, 4)):
                at, c = int(rng.integers(len(w) + 1)), str(rng.choice(list("abcdiotxé")))
                w[at : at + int(rng.integers(0, 2))] = [c] if rng.random() < 0.7 else []
            found.add("".join(w))
    words = sorted(found)

    def nearest(w):
        whole = [(e, i) for i, t in enumerate(terms) if t.endswith("\0") and (e := distance(w, t[:-1])) <= toxicity.allowed(len(t) - 1)]
        begins = max(((len(t), i) for i, t in enumerate(terms) if not t.endswith("\0") and w.startswith(t)), default=None)
        best = min(whole, default=None)
        if best and (best[0] == 0 or begins is None):
            return best[1], best[0]
        return (begins[1], 0) if begins else (-1, 0)

    automaton = toxicity.Automaton(terms)
    assert [(int(t), int(e)) for t, e in zip(*automaton.find(pa.array(words, pa.large_string())), strict=True)] == [nearest(w) for w in words]
    assert toxicity.Automaton([]).find(pa.array(["a"], pa.large_string()))[0].tolist() == [-1]


def toxic_rows():
    rng = np.random.default_rng(2)
    syllables = ["ba", "ko", "mi", "tel", "ran", "su", "vi", "or"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    out = []
    for i in range(400):
        w = [word() for _ in range(rng.integers(20, 120))]
        if toxic := i % 8 == 0:
            for at in rng.integers(0, len(w), 3):
                w[at] = str(rng.choice(["idiot", "worthless"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_catches_misspelled_and_spares_quoted(spark):
    rows = toxic_rows()
    base = rows[1][1]
    more = [(1000, base + " you wortless idoit"), (1001, base + ' he called it "idiot" yesterday'), (1002, base + " you idiot, worthless"), (1003, None), (1004, ""), (None, "IDIOT!"), (1005, "a" * 200_000)]
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(1003, None)], "doc_id long, toxic int")
    both = spark.createDataFrame([r[:2] for r in rows] + more, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "body", "term")})
    model = toxicity.train(both, labels)
    assert {"idiot\0", "worthless\0"} <= set(model.terms)
    scored = toxicity.score(both, model)
    assert scored.columns == ["doc_id", "text", "body", "term", "score", "hits"]
    got = {r["doc_id"]: r for r in scored.collect()}
    wrong = [i for i, _, t in rows if (got[i]["score"] >= 0.5) != bool(t)]
    assert len(wrong) <= 4
    assert got[1000]["score"] > 0.5 and ("idiot", 1) in {(h["term"], h["errors"]) for h in got[1000]["hits"]}
    assert got[1001]["score"] < got[1002]["score"] and [h["quoted"] for h in got[1001]["hits"]] == [True]
    assert got[1003]["score"] == got[1004]["score"] < 0.5 and not got[1005]["hits"] and got[None]["hits"][0]["word"] == 0


def test_toxicity_without_labels_or_rows(spark):
    rows = docs(spark, [(1, "you idiot"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scores = [r["score"] for r in toxicity.score(rows, toxicity.train(rows, labels)).collect()]
    assert scores == [0.5, 0.5]
    assert toxicity.score(rows.limit(0), toxicity.train(rows.limit(0), labels)).count() == 0


def test_toxicity_held_out(spark):
    """Of the labelled documents that were not learnt from, nearly all are told apart; labels of junk texts without a term are noise."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op13_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["predicted"] == r["toxic"] for r in labels)
    assert right / len(labels) > 0.95
