"""Quality rules under weak supervision.

Counts of the whole text feed rules that vote for (1), vote against (-1) or abstain (0) where they cannot tell.
Expectation-maximisation over the votes, without labels, estimates for each rule how often it is right about good
documents and how often about bad ones; a document's posterior probability of being
good decides, in place of a filter that all rules must pass. The estimate sees only how often each
pattern of votes occurs (at most 3 ** number of rules rows, whatever the corpus), so that EM runs on a table of bounded
size; counting the patterns is one aggregation with partial sums over all documents.

Defined cases: a null text has no words and fails the base; repeated rows give repeated rows; an empty table gives no
rows (the prior stands in for the estimate); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm.text import text_batches
from lithograph.session import materialize

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    b"the and of to in is that it for was on are as with be by this at from or an he her "
    b"der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch "
    b"le la les de des et en un une du que qui dans pour pas sur par au ce il "
    b"el los las y en un una que del por con para se su al lo como es".split()
)
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_EDGES = b".,;:!?\"'()[]"

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_function long, n_bangs long"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in a window of width words that occurs twice or more, first places included."""
    grams = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen: dict[tuple, int] = {}
    covered = bytearray(len(words))
    full = b"\x01" * width
    for i, g in enumerate(grams):
        first = seen.setdefault(g, i)
        if first != i:
            covered[i : i + width] = full
            covered[first : first + width] = full
    return sum(covered)


def count_features(text: bytes) -> tuple[int, ...]:
    """The counts of FEATURES behind doc_id, of one text."""
    words = text.split()
    in_words = len(b"".join(words))
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    upper = len(text) - len(text.translate(None, _UPPER))
    letters = len(text) - len(text.translate(None, _LETTERS))
    return (
        len(words),
        points - (len(text) - in_words),
        len(text) - len(text.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        letters,
        sum(map(FUNCTION_WORDS.__contains__, text.translate(None, _EDGES).split())),
        text.count(b"!"),
    )


def _features(batches):
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for part, texts in text_batches(batches):
        columns = zip(*(count_features(t or b"") for t in texts), strict=True)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names)


def _vote(value: Column, good: tuple[float, float], bad: Column) -> Column:
    """Votes for a value between good's two ends, against one that is bad."""
    return F.when(F.col("n_words") == 0, F.lit(0)).when(bad, F.lit(-1)).when((value >= good[0]) & (value <= good[1]), F.lit(1)).otherwise(F.lit(0))


def rule_votes() -> dict[str, Column]:
    """A vote column for each rule; between the good and the bad range a rule abstains, and where it has too little to see."""
    words, lines, letters = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_letters"))
    length, symbols, dups = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_dup_lines") / lines
    repeats, upper, function, bangs = F.col("n_repeat_words") / words, F.col("n_upper") / letters, F.col("n_function") / words, F.col("n_bangs") / words
    enough = lambda vote, seen: F.when(F.col(seen) >= 20, vote).otherwise(F.lit(0))
    return {
        "v_word_length": _vote(length, (3.5, 10.0), (length < 2.5) | (length > 12)),
        "v_symbols": _vote(symbols, (0.0, 0.02), symbols >= 0.15),
        "v_dup_lines": _vote(dups, (0.0, 0.05), dups >= 0.3),
        "v_repeats": _vote(repeats, (0.0, 0.05), repeats >= 0.2),
        "v_capitals": enough(_vote(upper, (0.0, 0.2), upper >= 0.5), "n_letters"),
        "v_function_words": enough(_vote(function, (0.1, 1.0), function < 0.03), "n_words"),
        "v_bangs": _vote(bangs, (0.0, 0.02), bangs >= 0.2),
        "v_length": _vote(F.col("n_words"), (50, 1e18), F.col("n_words") < 20),
    }


TRUST = (0.95, 0.3)  # what is assumed of a rule before votes are seen: most kinds of junk are none of its business
SENSE = 1.02  # least sum of a rule's accuracies: a vote for must speak for, a vote against must speak against


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 0.01, start: float = 0.8) -> tuple[float, np.ndarray]:
    """EM over vote patterns: the share of good documents, and for each rule how often it is right about good documents and
    about bad ones (a row each), where it votes.

    An abstention says nothing. Accuracies start, and are held by pseudo-votes of `strength` times all documents, at
    TRUST; they stay between 0.05 (0.01 about bad ones) and 0.995 and sum up to SENSE at least, so that no rule is read against its sense.
    """
    total = max(1.0, float(counts.sum()))
    hold, good, right = strength * total, start, np.repeat(np.array(TRUST)[:, None], votes.shape[1], axis=1)
    for _ in range(rounds):
        post = posterior(votes, good, right)
        good = min(0.99, max(0.01, float(((post * counts).sum() + hold * start) / (total + hold))))
        rows = []
        for weight, side, trust in ((post * counts, 1, TRUST[0]), ((1 - post) * counts, -1, TRUST[1])):
            rows.append((weight @ (votes == side) + hold * trust) / (weight @ (votes != 0) + hold))
        right = np.array(rows).clip([[0.05], [0.01]], 0.995)
        right[1] = np.maximum(right[1], SENSE - right[0])
    return good, right


def log_odds(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a vote for and a vote against of each rule add to the log-odds of good."""
    return np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1])


def posterior(votes: np.ndarray, good: float, right: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good."""
    for_, against = log_odds(right)
    return 1 / (1 + np.exp(-(np.log(good / (1 - good)) + (votes == 1) @ for_ + (votes == -1) @ against)))


def quality_posterior(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, quality (posterior probability of good), kept."""
    rules = rule_votes()
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_features, FEATURES).withColumns(rules), "quality-counts")
    seen = rows.groupBy(*rules).count().collect()  # bounded: 3 ** len(rules) rows
    votes = np.array([[r[c] for c in rules] for r in seen], dtype=int).reshape(-1, len(rules))
    good, right = fit_votes(votes, np.array([r["count"] for r in seen], dtype=float))
    logit = F.lit(float(np.log(good / (1 - good))))
    for name, for_, against in zip(rules, *log_odds(right), strict=True):
        logit = logit + F.when(F.col(name) == 1, F.lit(float(for_))).when(F.col(name) == -1, F.lit(float(against))).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    quality = 1.0 / (1.0 + F.exp(-logit))
    return rows.select("doc_id", *BASE, failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= threshold)).alias("kept"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_posterior(spark.read.parquet(f"{sf_dir}/documents.parquet"))
