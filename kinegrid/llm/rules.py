"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes ``keep`` or ``reject`` on a document, or abstains. Votes are combined by an
expectation-maximisation fit of a two-class model (Dawid and Skene): the share of good documents and, for
each rule and class, how often its vote is ``reject`` when it does not abstain. The posterior probability of
a good document replaces passing every rule. The fit sees all documents through the counts of vote
patterns, at most 3 to the number of rules of them; the posterior is a sum of one log-likelihood ratio per
vote, so it is applied as a plain expression.

Defined cases: a null text has no words; documents below the base limits are never kept and take no part in the fit;
when no document is left for the fit, every rule's starting accuracy holds; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: [^\x20\x09-\x0D]+ are words.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for with as on be at by this "
    "le la les des et un une du en pour que dans "
    "der die und den von zu das mit ist dem nicht ein "
    "el los las de y por con para se del una su"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects at or beyond ``reject`` (above it if that is the greater limit), keeps at or within ``keep``, abstains between."""

    name: str
    value: Column
    keep: float
    reject: float

    def vote(self) -> Column:
        """1: reject, 0: keep, null: abstain."""
        if self.reject > self.keep:
            return F.when(self.value >= self.reject, 1).when(self.value <= self.keep, 0)
        return F.when(self.value <= self.reject, 1).when(self.value >= self.keep, 0)


def _rate(n: str | Column, of: str = "n_words") -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return n / F.greatest(F.col(of), F.lit(1))


def standard_rules() -> list[Rule]:
    """Over the columns of ``measured``."""
    return [
        Rule("symbols", _rate("n_symbols"), keep=0.05, reject=0.3),
        Rule("exclamation", _rate("n_exclamations"), keep=0.05, reject=0.25),
        Rule("capitals", F.col("n_upper") / F.greatest("word_chars", F.lit(1)), keep=0.15, reject=0.4),
        Rule("repeated_words", _rate("n_repeat_words"), keep=0.2, reject=0.4),
        Rule("repeated_lines", _rate("n_dup_lines", "n_lines"), keep=0.1, reject=0.3),
        Rule("long_words", _rate("word_chars"), keep=8.0, reject=12.0),
        Rule("short_words", _rate("word_chars"), keep=3.5, reject=2.5),
        Rule("stop_words", F.col("n_stop_words").cast("double"), keep=6.0, reject=2.0),
        Rule("bare_words", _rate("n_bare"), keep=0.03, reject=0.15),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct column ``_m`` of the counts of a text; every other column passes."""
    body = F.coalesce(F.col(text), F.lit(""))
    line = lambda x: F.regexp_replace(x, SPACE, "") != ""
    rows = docs.withColumns(
        {
            "_w": F.array_remove(F.split(body, SPACE), ""),
            "_l": F.filter(F.split(body, "\n"), line),
        }
    )
    windows = F.transform(
        F.when(F.size("_w") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
    )
    rows = rows.withColumn("_s", F.sort_array(windows))
    twice = F.filter(
        "_s", lambda x, k: (F.get("_s", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("_s", k + 1)["h"].eqNullSafe(x["h"]))
    )
    zero = F.lit(0)
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(zero.alias("end"), zero.alias("n")),
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n")),
        lambda a: a["n"],
    )
    less = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))  # noqa: E731  what is left of the other characters
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": less(SYMBOLS),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
        "n_upper": less(r"[^\p{Lu}]+"),
        "n_exclamations": F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit(""))),
        "n_stop_words": F.size(F.array_intersect("_w", F.array(*map(F.lit, STOP_WORDS)))),
        "n_bare": F.size("_w") - F.size(F.array_remove(F.array_remove(F.array_remove("_w", "|"), "-"), "*")),
    }
    return rows.withColumn("_m", F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])).drop("_w", "_l", "_s")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def voted(measures: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``base_failed`` and one column ``vote_<rule>`` per rule to a table with the measured counts as columns."""
    return measures.withColumns({"base_failed": base_failed()} | {f"vote_{r.name}": r.vote() for r in rules})


@dataclass(frozen=True)
class Fit:
    """P(good) and, by rule, P(vote is reject | class) among votes cast: (good, bad)."""

    good: float
    reject: dict[str, tuple[float, float]]

    def posterior(self) -> Column:
        """P(good | votes)."""
        logit = F.lit(math.log(self.good / (1 - self.good)))
        for name, (good, bad) in self.reject.items():
            vote = F.col(f"vote_{name}")
            logit = logit + F.when(vote == 1, math.log(good / bad)).when(vote == 0, math.log((1 - good) / (1 - bad))).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def expectation_maximisation(patterns: list[tuple[tuple[int | None, ...], int]], names: list[str], rounds: int = 100) -> Fit:
    """The fit from counts of vote patterns, smoothed so that no probability is 0 or 1.

    It starts from accurate rules and mostly good documents, which also names the classes.
    """
    good, reject = 0.8, {n: (0.05, 0.5) for n in names}
    for _ in range(rounds if patterns else 0):
        n = [[0.0, 0.0] for _ in names]  # votes cast, by class
        r = [[0.0, 0.0] for _ in names]  # of these, reject
        total = [0.0, 0.0]
        odds = math.log(good / (1 - good))
        ratio = [(math.log((1 - reject[x][0]) / (1 - reject[x][1])), math.log(reject[x][0] / reject[x][1])) for x in names]
        for votes, count in patterns:
            logit = odds + sum(ratio[j][v] for j, v in enumerate(votes) if v is not None)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))
            for c, share in ((0, p * count), (1, (1 - p) * count)):
                total[c] += share
                for j, v in enumerate(votes):
                    if v is not None:
                        n[j][c] += share
                        r[j][c] += share * v
        new_good = (total[0] + 8) / (total[0] + total[1] + 10)
        new = {x: ((r[j][0] + 0.1) / (n[j][0] + 2), (r[j][1] + 1) / (n[j][1] + 2)) for j, x in enumerate(names)}
        new = {x: (min(g, b), b) for x, (g, b) in new.items()}  # a reject vote never speaks for a document
        moved = max([abs(new_good - good), *(abs(a - b) for x in names for a, b in zip(new[x], reject[x], strict=True))])
        good, reject = new_good, new
        if moved < 1e-7:
            break
    return Fit(good, reject)


def fit_votes(votes: DataFrame, rules: list[Rule]) -> Fit:
    """Fits the vote model on all documents that pass the base limits."""
    names = [r.name for r in rules]
    columns = [f"vote_{n}" for n in names]
    rows = votes.where(~F.col("base_failed")).groupBy(*columns).count().collect()  # at most 3 ** len(rules) rows
    return expectation_maximisation(sorted(((tuple(r[c] for c in columns), r["count"]) for r in rows), key=repr), names)


def quality_votes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None, settle=None) -> DataFrame:
    """One row per document: key, the counts, base_failed, the votes, p_good and kept.

    ``settle`` (such as a checkpoint) holds the small table of counts, so that texts are read once.
    """
    rules = rules or standard_rules()
    counts = measured(docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")), "_t")
    # without a settled table, a generator keeps the optimizer from copying all counts into each of their uses
    counts = settle(counts.select("_k", "_m.*")) if settle else counts.select("_k", F.explode(F.array("_m")).alias("_m")).select("_k", "_m.*")
    votes = voted(counts, rules)
    fit = fit_votes(votes, rules)
    judged = votes.withColumn("p_good", fit.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
    return judged.withColumnRenamed("_k", key)


def keep_good(docs: DataFrame, *, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The documents that quality_votes keeps, with all their columns and nothing else; the texts are read twice."""
    rules = rules or standard_rules()
    counts = measured(docs.select(F.struct("*").alias("_row"), F.col(text).cast("string").alias("_t")), "_t")
    # behind a generator: else the filter below is pushed down with a copy of all counts for each use
    votes = voted(counts.select("_row", F.explode(F.array("_m")).alias("_m")).select("_row", "_m.*"), rules)
    fit = fit_votes(votes, rules)
    return votes.where(~F.col("base_failed") & (fit.posterior() >= 0.5)).select("_row.*")
