"""Language-model scores, segmentation, and near duplicates against brute force."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinegrid.llm import mixing, neardup, segment
from kinegrid.llm.common import residue

TEXTS = ["the cat sat on the mat", "The dog\nsat on the  log", "", None, "the cat sat on the mat", "zebra quartz", "on on on on the", "ñandú 梦 the cat"] * 6


def docs(spark, rows=None):
    rows = list(enumerate(TEXTS)) if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))


def test_unigram_base_and_known(spark):
    got = mixing.language_model_scores(docs(spark), lambda k: residue(k, 7) != 2, lambda k: residue(k, 7) == 3).collect()
    assert len(got) == len(TEXTS)
    tokens = [[w.lower() for w in (t or "").split()] + ["\0"] for t in TEXTS]
    train = Counter(itertools.chain.from_iterable(t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2))
    n, v = sum(train.values()), len(train)
    for r in got:
        own = tokens[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] < 0
    by_text = {}
    for r in got:
        by_text.setdefault(TEXTS[r["doc_id"]] or "", set()).add(round(r["score"], 9))
    assert all(len(s) == 1 for s in by_text.values())


def test_no_training_texts_and_no_rows(spark):
    got = mixing.language_model_scores(docs(spark), lambda k: F.lit(False), lambda k: F.lit(False)).collect()
    assert {r["train_tokens"] for r in got} == {0} and {r["n_known"] for r in got} == {0}
    assert mixing.language_model_scores(docs(spark, []), lambda k: F.lit(True), lambda k: F.lit(False)).count() == 0


def test_score_is_a_function_of_the_corpus(spark):
    """The same scores under any number of partitions."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (3, 11):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = mixing.language_model_scores(rows.repartition(n), lambda k: residue(k, 7) != 2, lambda k: residue(k, 7) == 3).collect()
            found.append({r["doc_id"]: (r["score"], r["base_score"], r["held_out"]) for r in got})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0].keys() == found[1].keys() and all(found[0][k][0] == pytest.approx(found[1][k][0], abs=1e-6) for k in found[0])


def test_score_beats_the_base(spark):
    """The base lets every unseen word have one share, so its words sum to more than 1; the model's do not, and texts that were not learnt from still get more."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.language_model_scores(rows, lambda k: residue(k, 7) != 2, lambda k: residue(k, 7) == 3).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_text_classes_are_of_all_learnt_texts(spark):
    """More learnt texts than any sample would hold: the classes are those of all of them, and of no others, in any layout."""
    texts = [f"{'abcdefgh'[i % 8] * (i % 5)} {i} {'xyz'[i % 3]}" for i in range(9000)] + ["", None, "a"]
    rows = spark.createDataFrame([(i, t, -1 if i % 7 == 2 else i % 2) for i, t in enumerate(texts)], "key long, text string, fold int")
    learnt = [t for i, t in enumerate(texts) if i % 7 != 2]
    kinds = np.zeros((len(learnt), mixing.CLASS_KINDS))
    for i, t in enumerate(learnt):
        data = (t or "").encode()
        for a, b in itertools.pairwise(data):
            kinds[i, mixing.PAIR_KIND[a << 8 | b]] += 1
    kinds = np.rint(mixing.KIND_UNIT * np.sqrt(kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)))
    assert (mixing.text_kinds(pa.array(learnt)) == kinds).all()
    some = kinds[kinds.any(axis=1)]
    axes = np.linalg.eigh(np.cov(some.T, ddof=0))[1].T[::-1][: mixing.CLASS_BITS]
    for n in (2, 7):
        found = mixing.fitted_classes(rows.repartition(n))
        assert found.middle == pytest.approx(some.mean(axis=0), rel=1e-12)
        assert np.abs((found.axes * axes).sum(axis=1)) == pytest.approx(1)
        assert len(np.unique(found.of(kinds))) > 1
    assert (mixing.PAIR_KIND[[ord("A") << 8 | ord("b")]] == mixing.PAIR_KIND[[ord("a") << 8 | ord("B")]]).all()


def test_shared_beginnings_are_spelled_once():
    """Sorted words are a trie: as many symbols as it has edges, with the counts, sums and scores of words that are spelled one by one."""
    rng = np.random.default_rng(7)
    words = sorted({bytes(rng.integers(97, 100, rng.integers(0, 9)).astype(np.uint8)) for _ in range(900)} | {b"a" * 300, b"a" * 299 + b"b"})
    edges = Counter((w[:i], s) for w in words for i, s in enumerate(w + b" "))
    for order in (np.arange(len(words)), rng.permutation(len(words))):
        own = [words[i] for i in order]
        spelled = mixing.Spelled(pa.array(own, pa.binary()))
        assert len(spelled.one) >= sum(mixing.CODE.size[s] for _, s in edges)
        if own == words:
            assert len(spelled.start) - 1 == len(edges)
        times = rng.integers(0, 3, len(own))
        counts = mixing.context_counts(spelled, times)
        single = [mixing.Spelled(pa.array([w], pa.binary())) for w in own]
        want = Counter()
        for s, n in zip(single, times):
            for slots in s.slots:
                want.update({(k, b): m for (k, b), m in Counter(zip(s.keys[slots].tolist(), s.one.tolist())).items()} if n else {})
        assert counts.sum() == sum(want.values())
        assert all((counts[int(bit), np.searchsorted(spelled.keys, key)] == n) for (key, bit), n in want.items())
        model = mixing.Model(rng.integers(-60, 60, len(spelled.keys)), rng.integers(0, 5, len(spelled.keys)), mixing.first_weights())
        part = [mixing.Model(*(x[np.searchsorted(spelled.keys, s.keys)] for x in (model.stretch, model.known)), model.weights) for s in single]
        assert mixing.Mixer(model, spelled).word_scores(model.weights) == pytest.approx(np.concatenate([mixing.Mixer(m, s).word_scores(m.weights) for m, s in zip(part, single)]))
        for found, one in zip(mixing.newton_sums(model, spelled, times), zip(*(mixing.newton_sums(m, s, times[i : i + 1]) for i, (m, s) in enumerate(zip(part, single))))):
            assert found == pytest.approx(sum(one))


def test_spelled_words_are_a_distribution():
    """Each bit's two outcomes share one context, so a word's bits are a path in a binary tree; all words closed by a space sum to 1 at most."""
    model = mixing.Model(np.zeros(mixing.SLOTS, np.int8), np.zeros(mixing.SLOTS, np.int8), mixing.first_weights())
    one = pa.array([bytes([b]) for b in range(256) if b != 0x20] + [b""], pa.binary())
    p = np.exp(mixing.Mixer(model, mixing.Spelled(one)).word_scores(model.weights))[:, 0]
    close = p[-1]
    assert p[:-1].sum() / close == pytest.approx(1 - close)


def test_mixture_of_all_predictors_is_a_distribution():
    """Over an alphabet of a few words whose spellings sum to 1, the last word of a text takes each of them: the texts' probabilities sum to that of what comes before."""
    rng = np.random.default_rng(8)
    words = 12
    mix, short = (np.log(rng.dirichlet(np.ones(words))) for _ in range(2))
    c = rng.integers(0, 5, words) * (rng.random(words) < 0.6)
    whole = mixing.whole_words(c, mix, int(c.sum()), int((c == 1).sum()))
    cls = rng.integers(0, 3, words)
    corpus = mixing.Corpus(int(c.sum()), int((c == 1).sum()), np.bincount(cls, weights=c, minlength=mixing.TEXT_CLASSES))
    assert np.exp(whole).sum() == pytest.approx(1) and (np.exp(whole)[c == 0] < 0.5).all()
    before = rng.integers(0, words, 150)
    texts = [np.append(before, w) for w in range(words)] + [before]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = mixing.text_scores(mix, short, c, cls, corpus, np.concatenate(texts), bounds)
    assert np.exp(found[:-1] - found[-1]).sum() == pytest.approx(1)
    # an unseen word costs what its letters cost, so unseen words of any length do not share one price
    assert np.diff(mixing.whole_words(np.zeros(2), np.array([-10.0, -90.0]), 100, 10))[0] == pytest.approx(-80)


def test_packed_numbers_round_trip():
    x = np.array([0, 1, 255, 256, 1 << 40])
    assert (mixing._unplaned(mixing._planes(x)) == x.astype(np.uint64)).all()


def test_packed_rows_round_trip():
    x = np.array([0, 1, 255, 256, 1 << 40])
    for rows in (np.stack([x, x[::-1] % 256, x * 0]), np.zeros((3, 0), np.int64)):
        assert (mixing._unplaned(mixing._planes(rows)).reshape(rows.shape) == rows.astype(np.uint64)).all()


@pytest.fixture(scope="module")
def vocabulary():
    normal = [segment.MARK, "a", "b", "ab", f"{segment.MARK}a", f"{segment.MARK}ab", "ba", segment.MARK * 2, "é"]
    return segment.Vocabulary.from_pieces(["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *normal], [segment.HIDDEN] + [segment.BYTE] * 256 + [segment.NORMAL] * len(normal))


def every_path(vocabulary, text):
    normal = {p: i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds)) if k == segment.NORMAL}
    data = (" " + text).encode() if text else b""
    loose, at = set(), 0
    for c in (" " + text) if text else "":
        if c == segment.MARK or c.encode() not in normal:
            loose |= set(range(at, at + len(c.encode())))
        at += len(c.encode())
    out = []

    def walk(i, ids, score):
        if i == len(data):
            out.append((score, ids))
            return
        for p, n in normal.items():
            if data.startswith(p, i):
                walk(i + len(p), [*ids, n], score + vocabulary.scores[n])
        if i in loose:
            walk(i + 1, [*ids, data[i] + 1], score + vocabulary.scores[data[i] + 1])

    walk(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["ab", "abba ab", "a b\nab", "  ab", "é▁a", "abab abab", "x"])
def test_n_best_against_all_paths(vocabulary, text):
    ids, _, nbest = segment.encode_slice(vocabulary, pa.array([text]), 5)
    paths = every_path(vocabulary, text)
    scores = {tuple(i): s for s, i in paths}
    found = [tuple(segment.patched(ids[0].as_py(), n["patches"])) for n in nbest[0]]
    assert len(set(found)) == len(found) == min(5, len(paths))
    assert [scores[f] for f in found] == pytest.approx([s for s, _ in paths[: len(found)]])
    assert [n["score"] for n in nbest[0]] == pytest.approx([scores[f] for f in found])


def test_encode_decode_round_trip(spark):
    rows = docs(spark, [*enumerate(TEXTS), (99, "a" * 5000 + " \t\n ▁ \U0001F600")])
    v = segment.Vocabulary.load()
    got = segment.decode(segment.encode(rows, v), v).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    assert {r["score"] for r in got if not r["text"]} == {0.0} and all(r["ids"] == [] for r in got if not r["text"])
    assert segment.encode(docs(spark, []), v).count() == 0


def jaccard(a, b):
    bags = []
    for t in (a, b):
        w = t.lower().split()
        c = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        bags.append(c)
    x, y = bags
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x | y) for d in x if d in y)


def test_probability_jaccard_brute_force():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(6)]
    a = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(40)]
    b = [x if i % 3 == 0 else " ".join([*x.split()[:-2], *rng.choice(words, 3)]) for i, x in enumerate(a)]
    assert neardup.probability_jaccard(pa.array(a), pa.array(b)) == pytest.approx([jaccard(x, y) for x, y in zip(a, b)])


def test_near_duplicate_classes(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(4)]
    rows, key = [], 0
    for g, t in enumerate(base):
        for c in range(6):
            w = t.split()
            if c:
                w[int(rng.integers(len(w)))] = f"new{g}{c}"
            rows.append((key, " ".join(w)))
            key += 1
        rows.append((key, t))
        key += 1
    rows += [(500, ""), (501, None), (502, "one two"), (503, "ONE  two"), (None, base[0])]
    got = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs(spark, rows))[0].collect()}
    texts = {k: t or "" for k, t in rows}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations([k for k in texts if texts[k].split()], 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            x, y = root(a), root(b)
            parent[x] = y
    members = {}
    for k in texts:
        members.setdefault(root(k), []).append(k)
    want = {(k, min(m for m in group if m is not None)) for group in members.values() for k in group}
    assert got == want
    kept = neardup.drop_near_duplicates(docs(spark, rows))
    assert kept.count() == len(members) and kept.columns == ["doc_id", "text", "score"]


def test_contexts_are_counted_exactly():
    """Contexts never share a count, however many there are, and chunks that are summed are as one chunk."""
    rng = np.random.default_rng(6)
    words = sorted({bytes(rng.integers(97, 123, rng.integers(1, 12)).astype(np.uint8)) for _ in range(30_000)})
    n0, n1 = rng.integers(0, 4, len(words)), rng.integers(0, 3, len(words))
    spelled = mixing.Spelled(pa.array(words, pa.binary()))
    exact = set()
    for w in words:
        for i, symbol in enumerate(w + b" "):
            exact |= {(w[:i], int(n)) for n in mixing.CODE.node[symbol, : mixing.CODE.size[symbol]]}
    assert len(np.unique(spelled.slots[-1])) == len(exact)
    halves, told = [0, len(words) // 3, len(words)], {}
    parts = [mixing.Spelled(pa.array(words[a:b], pa.binary())) for a, b in zip(halves[:-1], halves[1:])]
    for i, (a, b) in enumerate(zip(halves[:-1], halves[1:])):
        for block, data in mixing.asked_blocks(parts[i], n0[a:b], n1[a:b], 8):
            told.setdefault(block, []).append((i, data))
    back = [[], []]
    for block in sorted(told):
        for (i, _), data in zip(told[block], mixing.answered([d for _, d in told[block]])):
            back[i].append(data)
    first = mixing.context_counts(spelled, n0)
    both = first + mixing.context_counts(spelled, n1)
    want = np.stack([*mixing.finished_tables(*first), *mixing.finished_tables(*both)])
    for part, data in zip(parts, back):
        assert (mixing.predictions(data) == want[:, np.searchsorted(spelled.keys, part.keys)]).all()
