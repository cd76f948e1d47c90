"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpointed, words

#: Words of a window that counts as repeated when the text has it twice.
WINDOW = 5
#: Rounds of expectation-maximisation at most, and the change of a probability that ends it.
ROUNDS, TOLERANCE = 1000, 1e-6
#: Where it starts: share of good documents, and how any rule votes (good, bad) on good and on bad documents.
PRIOR, START = 0.85, {True: (0.6, 0.05), False: (0.3, 0.3)}

GOOD, BAD, ABSTAIN = 1, -1, 0
#: A word of small letters, or of a script without small ones, that may end in one mark.
PLAIN = r"(?<![^\x20\x09-\x0D])[\p{Ll}\p{Lo}\p{M}]+[.,;:!?]?(?![^\x20\x09-\x0D])"


def _chars(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def _covered(windows: Column) -> Column:
    """Words in windows whose hash is there twice or more. windows: hashes by start."""
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
    # transform over one element names the sorted array, so that it is sorted once
    starts = F.transform(F.array(placed), lambda s: F.sort_array(F.transform(F.filter(s, lambda e, i: same(s, e, i - 1) | same(s, e, i + 1)), lambda e: e["i"])))[0]
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
    step = lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.least(F.lit(WINDOW), x - s["last"])).alias("sum"))
    return F.aggregate(starts, first, step, lambda s: s["sum"])


def add_features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and _tl_ columns that rules read.

    A null text counts as an empty one; words and lines are those of the whole text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").withColumn("_tl_words", words(text)).withColumn("_tl_lines", lines)
    out = out.withColumn("_tl_hashes", F.transform("_tl_words", lambda x: F.xxhash64(x)))
    h = F.col("_tl_hashes")
    wide = lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))
    out = out.withColumn("_tl_windows", F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), wide))
    w = F.col("_tl_windows")
    return out.withColumns(
        {
            "n_words": F.size("_tl_words").cast("long"),
            "word_chars": _chars(text, r"[\x20\x09-\x0D]+"),
            "n_symbols": _chars(text, r"[^#*$%&|<>]+"),
            "n_dup_lines": (F.size("_tl_lines") - F.size(F.array_distinct("_tl_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(0).cast("long"),
            "_tl_n_lines": F.size("_tl_lines").cast("long"),
            "_tl_stutter": F.size(F.filter(h, lambda x, i: F.coalesce(F.get(h, i - 1) == x, F.lit(False)))).cast("long"),
            "_tl_upper": _chars(text, r"[^\p{Lu}]+"),
            "_tl_shouts": _chars(text, r"[^!?]+"),
            "_tl_letters": _chars(text, r"[^\p{L}\p{M}]+"),
            "_tl_plain": F.regexp_count(text, F.lit(PLAIN)).cast("long"),
            "_tl_distinct": F.size(F.array_distinct(h)).cast("long"),
            "_tl_stops": F.regexp_count(text, F.lit(r"[.!?](?:[\x20\x09-\x0D]|$)")).cast("long"),
        }
    ).drop("_tl_words", "_tl_lines", "_tl_hashes", "_tl_windows")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN).cast("int")


def votes() -> dict[str, Column]:
    """The rules. Each says good, bad or nothing of a document.

    Most faults are seen by several rules: symbols by symbols, letters, plain and word_length, repetition
    by repeats, stutter, distinct and lines, shouting by shouting and plain. So their votes
    agree often enough for the accuracies to be estimated, and no vote decides alone.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / n
    mean = F.col("word_chars") / n
    of_chars = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": _vote(F.col("n_words") < 10, F.col("n_words") >= 40),
        "symbols": _vote(share("n_symbols") > 0.1, share("n_symbols") <= 0.02),
        "letters": _vote(of_chars("_tl_letters") < 0.8, of_chars("_tl_letters") >= 0.9),
        "plain": _vote(share("_tl_plain") < 0.45, share("_tl_plain") >= 0.6),
        "word_length": _vote((mean < 4.3) | (mean > 7), (mean >= 4.6) & (mean < 6.5)),
        "sentences": _vote((share("_tl_stops") < 0.015) | (share("_tl_stops") > 0.5), (share("_tl_stops") > 0.04) & (share("_tl_stops") < 0.3)),
        "repeats": _vote(share("n_repeat_words") > 0.2, share("n_repeat_words") <= 0.05),
        "stutter": _vote(share("_tl_stutter") > 0.1, share("_tl_stutter") <= 0.03),
        "distinct": _vote(share("_tl_distinct") < 0.35, share("_tl_distinct") >= 0.5),
        "lines": _vote((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * F.col("_tl_n_lines")), F.col("n_dup_lines") == 0),
        "shouting": _vote((of_chars("_tl_upper") > 0.3) | (share("_tl_shouts") > 0.2), (of_chars("_tl_upper") < 0.1) & (share("_tl_shouts") <= 0.05)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


class LabelModel:
    """Share of good documents, and how a rule votes on good and on bad ones: p[rule][good?][vote]."""

    def __init__(self, prior: float, p: dict[str, dict[bool, dict[int, float]]]):
        self.prior, self.p = prior, p

    def accuracy(self, rule: str) -> float:
        """Probability that the rule is right where it votes."""
        right = self.prior * self.p[rule][True][GOOD] + (1 - self.prior) * self.p[rule][False][BAD]
        wrong = self.prior * self.p[rule][True][BAD] + (1 - self.prior) * self.p[rule][False][GOOD]
        return right / (right + wrong)

    def weights(self) -> list[float]:
        """Log-odds of each vote, in the order of vote_codes(), and of being good at all."""
        votes = [math.log(p[True][v] / p[False][v]) for p in self.p.values() for v in (BAD, ABSTAIN, GOOD)]
        return [*votes, math.log(self.prior / (1 - self.prior))]

    def probability(self, codes: Column) -> Column:
        """Posterior probability that a document is good, from its vote codes."""
        weights = F.array(*map(F.lit, self.weights()))
        return 1 / (1 + F.exp(-F.aggregate(codes, F.lit(0.0), lambda s, c: s + F.element_at(weights, c))))


def vote_codes(rules: Iterable[str], prefix: str = "_tl_vote_") -> Column:
    """Each rule's vote as a number from 1, three for each rule in turn, and one last number that all documents have."""
    rules = list(rules)
    return F.array(*(F.col(prefix + r) + (3 * i + 2) for i, r in enumerate(rules)), F.lit(3 * len(rules) + 1))


def fit(patterns: DataFrame, rules: list[str], prefix: str = "_tl_vote_") -> LabelModel:
    """The label model of all documents. patterns: combinations of votes with a count n; equal ones are added up.

    Spark counts the combinations, of which there are 3 to the power of the rules' number at
    most (177,147 of eleven), whatever the number of documents; that table comes to the driver
    once, and the rounds run there until no probability changes by TOLERANCE.
    """
    code = sum(((F.col(prefix + r) + 1) * 3**i for i, r in enumerate(rules)), F.lit(0))
    counted = patterns.groupBy(code.cast("long").alias("code")).agg(F.sum("n").alias("n")).orderBy("code").collect()
    n = np.array([r["n"] for r in counted], float)
    digits = np.array([r["code"] for r in counted], np.int64)[:, None] // 3 ** np.arange(len(rules)) % 3
    # one column for each rule and vote
    voted = (digits[:, :, None] == np.arange(3)).reshape(len(n), 3 * len(rules)).astype(float)
    start = np.array([[b, 1 - g - b, g] for g, b in (START[True], START[False])])
    prior, p = PRIOR, np.repeat(start[:, None], len(rules), 1)
    for _ in range(ROUNDS if len(n) else 0):
        odds = voted @ np.log(p[0] / p[1]).ravel() + math.log(prior / (1 - prior))
        good = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        weight = np.stack([n * good, n * (1 - good)])
        # one document's worth of votes, spread as at the start, keeps every probability above 0
        later = ((weight @ voted).reshape(2, len(rules), 3) + start[:, None]) / (weight.sum(1)[:, None, None] + 1)
        share = min(max((weight[0].sum() + PRIOR) / (n.sum() + 1), 0.5), 0.99)
        change = max(abs(share - prior), float(np.abs(later - p).max()))
        prior, p = share, later
        if change < TOLERANCE:
            break
    return LabelModel(prior, {r: {y: dict(zip((BAD, ABSTAIN, GOOD), p[k, i].tolist(), strict=True)) for k, y in enumerate((True, False))} for i, r in enumerate(rules)})


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_tl_n_lines", "_tl_stutter", "_tl_upper", "_tl_shouts", "_tl_stops", "_tl_letters", "_tl_plain", "_tl_distinct")


def _with_votes(docs: DataFrame) -> DataFrame:
    """docs with the counts and the votes.

    The counts pass through explode(), of one element each, as a filter on them would
    otherwise be moved below their computation and repeat it for each mention.
    """
    featured = add_features(docs)
    kept = [c for c in featured.columns if c not in FEATURES]
    counted = featured.select(*kept, F.explode(F.array(F.struct(*FEATURES))).alias("_tl_f")).select(*kept, "_tl_f.*")
    return counted.withColumns({f"_tl_vote_{r}": v for r, v in votes().items()})


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, probability (of being good) and kept.

    Kept is false where the base rules fail, else whether the probability that the
    votes give reaches the threshold. All documents take part in the estimate. A null
    text is an empty one and fails. Repeated rows are judged alike; other columns, whatever their
    names, are left out. Very long texts are counted whole. An empty table gives no rows.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    voted = _with_votes(docs.select("doc_id", "text"))
    narrow = checkpointed(voted.select("doc_id", *base, *(f"_tl_vote_{r}" for r in votes())))
    model = fit(narrow.withColumn("n", F.lit(1)), list(votes()))
    out = narrow.withColumn("base_failed", base_failed()).withColumn("probability", model.probability(vote_codes(votes())))
    return out.select("doc_id", *base, "base_failed", (~F.col("base_failed") & (F.col("probability") >= threshold)).alias("kept"), "probability")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score_quality keeps, with the columns of docs.

    Rows are kept with their votes in the shared folder, so that texts are counted once; those that fail the base
    rules take part in the estimate without being kept. Null and empty texts go; equal rows share one fate.
    An empty table gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    voted = _with_votes(docs.select("text", F.struct(*columns).alias("_tl_row")))
    rows = checkpointed(voted.select(F.when(~base_failed(), F.col("_tl_row")).alias("_tl_row"), *(F.col(f"_tl_vote_{r}").cast("byte").alias(f"_tl_vote_{r}") for r in votes())))
    model = fit(rows.withColumn("n", F.lit(1)), list(votes()))
    return rows.where(F.col("_tl_row").isNotNull() & (model.probability(vote_codes(votes())) >= threshold)).select("_tl_row.*")
