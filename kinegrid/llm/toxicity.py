"""Toxicity by a learnt lexicon, Levenshtein automata over its trie, and the context of each hit.

The lexicon holds words and word beginnings that labelled toxic documents have far more often than clean ones. Its trie and the
edits that a term's length allows (none below five letters, one below nine, else two; a swap of neighbours is one) are one automaton
of sets of trie nodes and errors; its states are made as words ask for them, and all distinct words of a batch walk its table side by
side, a letter at a time, so nearly every word is done after its first letters. A hit weighs the logarithm of how much
oftener toxic documents have it than clean ones, misspelled hits by themselves. A window of words around each hit says whether it is
quoted or spoken about, or thrown at someone; sums by context, the number of words and the strongest hit are weighed by a ridged
logistic fit whose prior discounts quotation.

Learning uses at most ``SAMPLE`` labelled rows of each kind, chosen by a hash of their key, and of these one of each set of texts
with one smallest hash of five words, so that copies do not count as evidence. Every whole text is scored where it is read, without a shuffle.

Defined cases: a null text is an empty text, which has a score; null keys are scored; null labels are not learnt from; without labels of
both kinds the lexicon is empty and every score is the same (a half without any labels); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrid.llm.bytewords import NOT_SPACE, Words, pieces, shingles, word_hashes
from kinegrid.llm.common import cut_lineage, fresh

#: Bound of the labelled rows of each kind that are learnt from.
SAMPLE = 4000
#: Terms of the lexicon, the most telling first.
LEXICON = 4000
PREFIXES = range(3, 9)
LONGEST = 40
#: A term must be in so many toxic documents, be so many times as frequent there, and stand out by so many deviations.
LEAST_DOCUMENTS, LEAST_RATIO, LEAST_DEVIATIONS = 4, 4.0, 6.0
PIECE_BYTES = 4 << 20
WINDOW = 6
THRESHOLD = 0.5
#: States of the automaton that a task keeps; beyond it the table is made anew.
STATES = 1 << 16
END = "\0"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…¡¿"
#: Words that report or name a word, and words that address someone.
REPORT = "said says say called calls call word words term quote quoted quotes wrote writes slur reported report means sagte nannte wort schrieb zitat bedeutet dit disait mot appelle écrit dijo dice palabra llamó escribió".split()
ADDRESS = "you your yours yourself you're youre ur u du dich dir dein deine ihr euch tu toi te ton ta vous votre tú usted ustedes tus".split()
FEATURES = ("plain", "thrown", "quoted", "misspelled", "strongest", "spread", "log_words")
#: Where the fit is drawn to: what a unit of each feature adds to the logit before labels say otherwise.
PRIOR = np.array([0.5, 0.7, 0.1, 0.4, 0.3, 0.3, -0.2])


def allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


# --- the automaton ------------------------------------------------------------------------------------------------------


class Automaton:
    """Finds in words the nearest term, or the longest beginning that is a term.

    Terms that end in END are whole words, the others beginnings; only whole words may be misspelled. A state is the last
    beginning met and a set of (node, errors, letter still owed by a swap).
    """

    def __init__(self, terms: list[str]):
        self.child: list[dict[int, int]] = [{}]
        self.begins, self.ends = [-1], [-1]
        self.size, self.reach = [0], [-1]
        letters = sorted({c for t in terms for c in t if c != END})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        code = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other letter
        for number, term in enumerate(terms):
            node, whole = 0, term.endswith(END)
            path = [0]
            for c in term.removesuffix(END):
                if code[c] not in self.child[node]:
                    self.child[node][code[c]] = len(self.child)
                    self.child.append({})
                    self.begins.append(-1)
                    self.ends.append(-1)
                    self.size.append(self.size[node] + 1)
                    self.reach.append(-1)
                node = self.child[node][code[c]]
                path.append(node)
            (self.ends if whole else self.begins)[node] = number
            for n in path:
                self.reach[n] = max(self.reach[n], allowed(self.size[node]) if whole else 0)
        self._anew()

    def _anew(self) -> None:
        self.number: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.table = np.full((256, len(self.letters) + 1), -1, np.int32)
        self.term, self.errors, self.living = np.full(256, -1, np.int32), np.zeros(256, np.int8), np.zeros(256, bool)
        self._state(-1, {(0, -1): 0})

    def _closed(self, found: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
        """With the letters that the word may lack."""
        stack = [k for k in found if k[1] < 0]
        while stack:
            node, _ = key = stack.pop()
            e = found[key] + 1
            for n in self.child[node].values():
                if e <= self.reach[n] and found.get((n, -1), 9) > e:
                    found[n, -1] = e
                    stack.append((n, -1))
        return found

    def _state(self, last: int, found: dict[tuple[int, int], int]) -> int:
        found = self._closed(found)
        key = (last, frozenset(found.items()))
        if key in self.number:
            return self.number[key]
        i = self.number[key] = len(self.members)
        self.members.append((last, found))
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.term, self.errors, self.living = (np.concatenate([a, np.zeros_like(a)]) for a in (self.term, self.errors, self.living))
        self.living[i] = bool(found)
        near = min(((e, self.ends[n]) for (n, owed), e in found.items() if owed < 0 and self.ends[n] >= 0 and e <= allowed(self.size[n])), default=None)
        if near is not None and (near[0] == 0 or last < 0):
            self.errors[i], self.term[i] = near
        else:
            self.term[i] = last
        return i

    def _step(self, state: int, letter: int) -> int:
        last, found = self.members[state]
        out: dict[tuple[int, int], int] = {}

        def add(node: int, owed: int, e: int) -> None:
            if e <= self.reach[node] and out.get((node, owed), 9) > e:
                out[node, owed] = e

        for (node, owed), e in found.items():
            if owed >= 0:
                if owed == letter:
                    add(node, -1, e)
                continue
            if letter in self.child[node]:
                n = self.child[node][letter]
                add(n, -1, e)
                if e == 0 and self.begins[n] >= 0:
                    last = self.begins[n]
            add(node, -1, e + 1)
            if e < self.reach[node]:
                for x, n in self.child[node].items():
                    add(n, -1, e + 1)
                    if x != letter and letter in self.child[n]:
                        add(self.child[n][letter], x, e + 1)
        return self._state(last, out)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """By word its term (-1: none) and the errors. Words beyond LONGEST letters are known by their beginnings only."""
        if len(self.members) > STATES:
            self._anew()
        text = "".join(words.to_pylist())
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.letters, points)
        at[at == len(self.letters)] = 0
        letter = np.where(self.letters[at] == points, at + 1, 0) if len(self.letters) else np.zeros(len(points), np.int64)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        state = np.zeros(len(size), np.int64)
        alive = np.flatnonzero(size > 0)
        for j in range(int(min(size.max(initial=0), 4096))):
            alive = alive[size[alive] > j]
            if not len(alive):
                break
            here, c = state[alive], letter[start[alive] + j]
            then = self.table[here, c]
            for p in np.unique(here[then < 0] * self.table.shape[1] + c[then < 0]).tolist():
                s, x = divmod(p, self.table.shape[1])
                self.table[s, x] = self._step(s, x)  # may replace the table by a larger one
            then = self.table[here, c]
            state[alive] = then
            alive = alive[self.living[then]]
        return self.term[state], self.errors[state]


# --- words and their contexts -------------------------------------------------------------------------------------------


@dataclass
class Text:
    """The words of a column: a code for each into the distinct plain ones, and what their marks say."""

    first: np.ndarray
    codes: np.ndarray
    distinct: pa.Array
    opens: np.ndarray
    closes: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


OPENS, CLOSES = r'^[(]?["“«„‘\'`]', r'["”“»’\'`][).,;:!?]*$'


def read(texts: pa.Array) -> Text:
    words = Words(texts, NOT_SPACE)
    codes, shapes = words.coded()
    shapes = shapes.cast(pa.large_string())
    plain = pc.utf8_lower(pc.utf8_trim(shapes, PUNCTUATION)).dictionary_encode()
    to_plain = plain.indices.to_numpy(zero_copy_only=False)
    marks = [pc.match_substring_regex(shapes, p).to_numpy(zero_copy_only=False).astype(bool)[codes] for p in (OPENS, CLOSES)]
    return Text(words.first, to_plain[codes] if len(codes) else codes, plain.dictionary, *marks)


def _near(flag: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[np.minimum(at + WINDOW + 1, hi)] > total[np.maximum(at - WINDOW, lo)]


def contexts(text: Text, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hits at these words: quoted or spoken about; thrown at someone."""
    lo, hi = text.first[owner], text.first[owner + 1]
    n = len(text.codes)
    place = np.arange(n)
    opened = np.maximum.accumulate(np.where(text.opens, place, -1)) if n else place
    closed = np.maximum.accumulate(np.where(text.closes, place, -1)) if n else place
    before = np.concatenate([[-1], closed])[:-1][at] if n else at  # the last closing mark before the hit
    closing = np.minimum.accumulate(np.where(text.closes, place, n)[::-1])[::-1][at] if n else at
    inside = (opened[at] >= np.maximum(lo, at - WINDOW)) & (before < opened[at]) & (closing < np.minimum(hi, at + WINDOW + 1))
    has = lambda found: pc.is_in(text.distinct, value_set=pa.array(found, text.distinct.type)).to_numpy(zero_copy_only=False).astype(bool)[text.codes]
    return inside | _near(has(REPORT), at, lo, hi), _near(has(ADDRESS), at, lo, hi)


@dataclass
class Model:
    """Terms, the weight of a hit without and with errors, and the logistic weights of FEATURES after the intercept."""

    terms: list[str]
    exact: np.ndarray
    misspelled: np.ndarray
    weights: np.ndarray
    automaton: Automaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return (self.terms, self.exact, self.misspelled, self.weights)

    def __setstate__(self, state):
        self.terms, self.exact, self.misspelled, self.weights = state
        self.automaton = None

    def find(self, texts: pa.Array) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray]:
        """The texts, and of each hit its word, its term and its errors; all hits, whatever they weigh."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        text = read(texts)
        term, errors = self.automaton.find(text.distinct) if len(text.distinct) else (np.zeros(0, np.int32), np.zeros(0, np.int8))
        each = term[text.codes] if len(text.codes) else np.zeros(0, np.int32)
        at = np.flatnonzero(each >= 0)
        return text, at, each[at], errors[text.codes[at]] if len(at) else np.zeros(0, np.int8)

    def measure(self, texts: pa.Array):
        """FEATURES of each text, and of each hit that weighs something its word, text, term, errors and whether it is quoted."""
        text, at, term, errors = self.find(texts)
        weight = np.where(errors > 0, self.misspelled[term], self.exact[term]) if len(at) else np.zeros(0)
        some = weight > 0
        at, term, errors, weight = at[some], term[some], errors[some], weight[some]
        owner = text.owner[at]
        quoted, addressed = contexts(text, at, owner)
        n, count = len(text.first) - 1, np.diff(text.first)
        total = lambda which: np.bincount(owner[which], weight[which], minlength=n)
        strongest, spread = np.zeros(n), np.zeros(n)
        np.maximum.at(strongest, owner, np.where(quoted, 0.2, 1.0) * weight)
        pair = np.unique(owner * (len(self.terms) + 1) + term)
        np.add.at(spread, pair // (len(self.terms) + 1), 1.0)
        sums = [total(~quoted & ~addressed), total(~quoted & addressed), total(quoted), total(errors > 0)]
        # what is expected by chance grows with the words: sums are dampened and the words themselves weigh against
        return np.column_stack([*(np.log1p(s) for s in sums), strongest, np.log1p(spread), np.log1p(count)]), (at - text.first[owner], owner, term, errors, quoted)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -60, 60)))


# --- learning -----------------------------------------------------------------------------------------------------------


def _sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int, train_only) -> tuple[DataFrame, dict[bool, int]]:
    """(toxic, t) of at most ``sample`` rows of each kind, settled; and how many labelled rows there are of each kind."""
    rows = labels.select(F.col(key).alias("k"), (F.col(label) == 1).alias("toxic")).where("k is not null and toxic is not null")
    rows = rows.where(train_only(F.col("k"))) if train_only is not None else rows
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [rows.where(F.col("toxic") == kind).distinct().orderBy(F.xxhash64("k"), "k").limit(sample) for kind in (True, False)]
    keys = F.broadcast(parts[0].unionByName(parts[1]))  # at most twice ``sample`` keys
    found = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(keys, "k")
    marked = found.select("toxic", "t").mapInArrow(_marked_batches, "toxic boolean, t string, least long")
    return cut_lineage(marked.groupBy("toxic", "least").agg(F.min("t").alias("t")).select("toxic", "t")), counts


def _marked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows and the smallest hash of five words of each text (0 without words)."""
    for batch in batches:
        for part in pieces(batch, 1, PIECE_BYTES):
            words = Words(part.column(1), NOT_SPACE)
            hashes, bounds = shingles(word_hashes(words), words.first, 5)
            some = np.diff(bounds) > 0
            least = np.zeros(part.num_rows, np.uint64)
            if some.any():
                least[some] = np.minimum.reduceat(hashes, bounds[:-1][some])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(least.view(np.int64))], names=["toxic", "t", "least"])


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts have each word (with END) and each beginning."""
    for batch in batches:
        for part in pieces(batch, 1, PIECE_BYTES):
            toxic = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
            text = read(part.column(1))
            count = max(1, len(text.distinct))
            size = pc.utf8_length(text.distinct).to_numpy(zero_copy_only=False)
            pair = np.unique(text.owner * count + text.codes)
            code, owner = pair % count, pair // count
            names, of_word, of_name = [], [], []
            for length in (None, *PREFIXES):
                some = np.flatnonzero((size > 0) & (size <= LONGEST) if length is None else size >= length)
                whole = text.distinct.take(pa.array(some))
                cut = pc.binary_join_element_wise(whole, pa.scalar(END, pa.large_string()), pa.scalar("", pa.large_string())) if length is None else pc.utf8_slice_codeunits(whole, 0, length)
                coded = cut.dictionary_encode()
                of_word.append(some)
                of_name.append(coded.indices.to_numpy(zero_copy_only=False) + sum(map(len, names)))
                names.append(coded.dictionary)
            found = []
            for some, name in zip(of_word, of_name, strict=True):
                to = np.full(count, -1, np.int64)
                to[some] = name
                own = to[code]
                found.append(np.unique(owner[own >= 0] * sum(map(len, names)) + own[own >= 0]))
            every = np.concatenate(found)
            name, owner = every % max(1, sum(map(len, names))), every // max(1, sum(map(len, names)))
            width = sum(map(len, names))
            bad, good = np.bincount(name[toxic[owner]], minlength=width), np.bincount(name[~toxic[owner]], minlength=width)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(pa.string()) for x in names]), pa.array(bad), pa.array(good)], names=["term", "bad", "good"])


def learn_lexicon(sample: DataFrame, n_bad: int, n_good: int, size: int) -> list[str]:
    """The most telling terms: counted and rated in Spark, at most ``size`` of them come to the driver."""
    if not n_bad or not n_good:
        return []
    found = sample.mapInArrow(_term_batches, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("a"), F.sum("good").alias("b"))
    share_a, share_b = (F.col("a") + 0.5) / (n_bad + 1), (F.col("b") + 0.5) / (n_good + 1)
    p = (F.col("a") + F.col("b")) / (n_bad + n_good)
    z = (F.col("a") / n_bad - F.col("b") / n_good) / F.sqrt(p * (1 - p) * (1 / n_bad + 1 / n_good))
    telling = found.where((F.col("a") >= LEAST_DOCUMENTS) & (share_a / share_b >= LEAST_RATIO)).withColumn("z", z).where(F.col("z") >= LEAST_DEVIATIONS)
    return sorted(r["term"] for r in telling.orderBy(F.desc("z"), "term").limit(size).collect())


def _hit_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, PIECE_BYTES):
                toxic = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
                text, at, term, errors = shared.value.find(part.column(1))
                hit = np.unique(text.owner[at] * (1 << 32) + term.astype(np.int64) * 2 + (errors > 0))
                kind, owner = hit % (1 << 32), hit >> 32
                names, to = np.unique(kind, return_inverse=True)
                bad, good = (np.bincount(to[toxic[owner] == x], minlength=len(names)) for x in (True, False))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(bad), pa.array(good)], names=["kind", "bad", "good"])

    return run


def hit_weights(sample: DataFrame, terms: list[str], n_bad: int, n_good: int) -> tuple[np.ndarray, np.ndarray]:
    """By term the log odds of its hits without and with errors; the latter start from a part of the former."""
    bad, good = np.zeros((len(terms), 2)), np.zeros((len(terms), 2))
    if terms:
        shared = sample.sparkSession.sparkContext.broadcast(Model(terms, np.zeros(0), np.zeros(0), np.zeros(0)))
        for r in sample.mapInArrow(_hit_batches(shared), "kind long, bad long, good long").groupBy("kind").agg(F.sum("bad").alias("a"), F.sum("good").alias("b")).collect():
            bad[r["kind"] // 2, r["kind"] % 2], good[r["kind"] // 2, r["kind"] % 2] = r["a"], r["b"]
    odds = lambda a, b: np.log((a / (n_bad + 1)) / (b / (n_good + 1)))
    exact = odds(bad[:, 0] + 0.5, good[:, 0] + 0.5)
    start = np.exp(0.7 * np.maximum(exact, 0)) * 0.5 * (n_bad + 1) / (n_good + 1)
    return exact, odds(bad[:, 1] + start, good[:, 1] + 0.5)


def fit_weights(x: np.ndarray, toxic: np.ndarray, counts: dict[bool, int], ridge: float = 2.0, rounds: int = 60) -> np.ndarray:
    """Ridged logistic weights, drawn to PRIOR; each kind weighs as its number of labelled rows says."""
    if not len(x):
        return np.concatenate([[0.0], np.zeros(len(FEATURES))])
    share = {k: counts.get(k, 0) / max(1, (toxic == k).sum()) for k in (True, False)}
    each = np.where(toxic, share[True], share[False])
    each = each * len(x) / each.sum()
    z = np.column_stack([np.ones(len(x)), x])
    prior = np.concatenate([[0.0], PRIOR])
    pull = np.concatenate([[1e-3], np.full(len(FEATURES), ridge)])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (each * (p - toxic)) + pull * (w - prior)
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + np.diag(pull), gradient)
        w = w - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON, train_only=None) -> Model:
    """Learns lexicon, weights of hits and of contexts from labelled rows; ``train_only(key column)`` says which may be learnt from."""
    some, counts = _sampled(docs, labels, key, text, label, sample, train_only)
    held = {r["toxic"]: r["n"] for r in some.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = held.get(True, 0), held.get(False, 0)
    terms = learn_lexicon(some, n_bad, n_good, lexicon)
    model = Model(terms, *hit_weights(some, terms, n_bad, n_good), np.zeros(1 + len(FEATURES)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, PIECE_BYTES):
                x = shared.value.measure(part.column(1))[0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = some.mapInArrow(measured, "toxic boolean, x array<double>").toPandas()  # at most twice ``sample`` rows of a few numbers
    x = np.array(rows["x"].tolist()).reshape(-1, len(FEATURES))
    toxic = rows["toxic"].to_numpy(bool)
    order = np.lexsort((*x.T, toxic))  # the fit does not depend on the order of rows
    model.weights = fit_weights(x[order], toxic[order], counts)
    return model


HIT = "struct<word:long,term:string,errors:int,quoted:boolean>"


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score", hits: str = "hits") -> DataFrame:
    """All columns of docs, the score of each whole text, and its hits: word number, term (a beginning ends in *), errors, quoted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (into, hits)]
    body = fresh(docs.columns, "body")
    shown = [t.removesuffix(END) if t.endswith(END) else f"{t}*" for t in model.terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part in pieces(batch, names.index(body), PIECE_BYTES):
                x, (at, owner, term, errors, quoted) = shared.value.measure(part.column(names.index(body)))
                order = np.lexsort((at, owner))
                each = pa.StructArray.from_arrays(
                    [pa.array(at[order]), pa.array([shown[t] for t in term[order].tolist()], pa.string()), pa.array(errors[order].astype(np.int32)), pa.array(quoted[order])],
                    names=["word", "term", "errors", "quoted"],
                )
                bounds = np.searchsorted(owner[order], np.arange(part.num_rows + 1)).astype(np.int32)
                columns = [part.column(names.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.scores(x)), pa.ListArray.from_arrays(pa.array(bounds), each)], names=[*kept, into, hits])

    rows = docs.select(*kept, F.col(text).cast("string").alias(body))
    schema = docs.select(*kept).withColumns({into: F.lit(0.0), hits: F.lit(None).cast(f"array<{HIT}>")}).schema
    return rows.mapInArrow(run, schema)
