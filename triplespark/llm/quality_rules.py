"""Quality rules under weak supervision.

Rules vote for a document, against it, or abstain. Expectation-maximisation over all documents' votes estimates how
often each rule is right about good and about bad documents, and a document's posterior probability of being good
takes the place of passing every rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .tables import words

STOP = "the|of|and|to|is|in|de|la|que|el|los|en|les|et|le|des|un|der|die|und|das|mit"
THRESHOLD = 0.5


def _vote(against: Column, favour: Column) -> Column:
    return F.when(against, F.lit(-1)).when(favour, F.lit(1)).otherwise(F.lit(0))


def measures(text: Column) -> dict[str, Column]:
    """Counts over the whole text, all by built-in functions; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, r"\n")
    return {
        "m_words": words(t),
        "m_solid": F.length(F.regexp_replace(t, r"[ \t\r\n]+", "")),
        "m_letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
        "m_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "m_symbols": F.length(F.regexp_replace(t, r"[^#$%&*|!<>{}\[\]~^=+@\\]+", "")),
        "m_lines": F.size(lines),
        "m_distinct": F.size(F.array_distinct(lines)),
        "m_stop": F.regexp_count(F.lower(t), F.lit(rf"(?<!\p{{L}})(?:{STOP})(?!\p{{L}})")),
    }


def rules() -> dict[str, Column]:
    """The votes, from the measures; a measure that needs words abstains or votes against where there are none."""
    n, solid, letters = F.col("m_words"), F.greatest("m_solid", F.lit(1)), F.greatest("m_letters", F.lit(1))
    mean = F.col("m_solid") / F.greatest(n, F.lit(1))
    symbols, upper = F.col("m_symbols") / solid, F.col("m_upper") / letters
    again, stop = 1 - F.col("m_distinct") / F.col("m_lines"), F.col("m_stop") / F.greatest(n, F.lit(1))
    return {
        "length": _vote(n < 5, n >= 20),
        "word_length": _vote((mean > 12) | (mean < 2), (mean >= 3) & (mean <= 9)),
        "symbols": _vote(symbols > 0.05, (n > 0) & (symbols < 0.01)),
        "capitals": _vote(upper > 0.4, (n > 0) & (upper < 0.15)),
        "repetition": _vote((F.col("m_lines") >= 3) & (again > 0.3), (F.col("m_lines") >= 3) & (again < 0.05)),
        "stop_words": _vote((n >= 20) & (stop < 0.02), (n >= 5) & (stop > 0.08)),
        "letters": _vote(F.col("m_letters") / solid < 0.7, F.col("m_letters") / solid > 0.9),
    }


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 500, smooth: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior, accuracy on good, accuracy on bad) by expectation-maximisation over distinct vote patterns.

    An abstention says nothing. It starts from the share of votes in favour, and accuracies stay at 0.5 or more, so
    the two classes can't change places; ``smooth`` votes of accuracy 0.8 stand for each rule in advance.
    """
    yes, no, total = votes == 1, votes == -1, counts.sum()
    good = (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1)
    prior, before = 0.5, None
    for _ in range(rounds):
        g, b = good * counts, (1 - good) * counts
        prior = float((g.sum() + smooth) / (total + 2 * smooth))
        right = (g @ yes + 0.8 * smooth) / (g @ (yes | no) + smooth)
        wrong = (b @ no + 0.8 * smooth) / (b @ (yes | no) + smooth)
        right, wrong = np.clip(right, 0.5, 0.999), np.clip(wrong, 0.5, 0.999)
        good = posterior(votes, prior, right, wrong)
        if before is not None and np.abs(good - before).max(initial=0) < 1e-10:
            break
        before = good
    return prior, right, wrong


def posterior(votes: np.ndarray, prior: float, right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    z = np.log(prior / (1 - prior)) + (votes == 1) @ np.log(right / (1 - wrong)) + (votes == -1) @ np.log((1 - right) / wrong)
    return 1 / (1 + np.exp(-z))


def quality(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, one vote_ column a rule, posterior, keep) for every row of docs.

    All documents vote; only the counts of distinct vote patterns, at most 3 to the number of rules, reach the driver.
    A null or empty text is voted against for its length and otherwise abstains mostly. Texts are measured whole, however
    long. Repeated rows count as often as they occur; an empty table gives an empty result. doc_id may be of any type, null
    or repeated; other columns don't count, whatever their names. A posterior equal to ``threshold`` is kept.
    """
    names = list(rules())
    measured = docs.select("doc_id", *[c.alias(k) for k, c in measures(F.col("text")).items()])
    voted = measured.select("doc_id", *[c.cast("int").alias(f"vote_{k}") for k, c in rules().items()])
    voted = Scratch(spark, "rules").table(voted, "votes")
    columns = [f"vote_{k}" for k in names]
    seen = voted.groupBy(*columns).count().toPandas()
    prior, right, wrong = fit(seen[columns].to_numpy(int), seen["count"].to_numpy(float))
    z = F.lit(float(np.log(prior / (1 - prior))))
    for c, a, b in zip(columns, right.tolist(), wrong.tolist(), strict=True):
        z = z + F.when(F.col(c) == 1, F.lit(float(np.log(a / (1 - b))))).when(F.col(c) == -1, F.lit(float(np.log((1 - a) / b)))).otherwise(F.lit(0.0))
    scored = voted.withColumn("posterior", 1 / (1 + F.exp(-z)))
    return scored.withColumn("keep", F.col("posterior") >= threshold)
