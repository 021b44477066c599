"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how right each is.

Every rule votes good (1), bad (0) or abstains (null). Texts with the same votes count together, so the model reads
a table of at most 3**rules vote patterns with their counts. That bounded table comes to the driver, where
expectation-maximisation is a few sums over it; texts are read, voted on and judged by DataFrame functions only.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored
from .stats import rates, with_statistics

PRIOR = 0.8  # share of good texts to start from
START = 0.9  # accuracy of every vote to start from
ROUNDS = 15
KEEP = 0.5  # least posterior probability of a kept text


def rules(stat: Column) -> dict[str, Column]:
    """Votes: 1 good, 0 bad, null no opinion. A text without words gets no vote but from the first rule."""
    r = rates(stat)
    words = stat["n_words"]

    def vote(value: Column, bad: Column, good: Column, least: int = 20) -> Column:
        return F.when(words < least, F.lit(None)).when(bad, 0).when(good, 1).cast("int")

    return {
        "length": F.when(words < 20, 0).when(words >= 50, 1).cast("int"),
        "symbols": vote(r["symbols"], r["symbols"] > 0.05, r["symbols"] < 0.01),
        "repeats": vote(r["repeats"], r["repeats"] > 0.2, r["repeats"] < 0.05),
        "variety": vote(r["distinct"], (r["distinct"] < 0.15) & (words < 2000), r["distinct"] > 0.3, 30),
        "capitals": vote(r["upper"], r["upper"] > 0.4, r["upper"] < 0.2),
        "marks": vote(r["marks"], r["marks"] > 0.3, r["marks"] < 0.1),
        "lines": vote(r["dup_lines"], (r["dup_lines"] > 0.3) & (stat["n_lines"] > 2), r["dup_lines"] < 0.1),
        "points": vote(r["points"], r["points"] > 0.6, (r["points"] > 0.01) & (r["points"] < 0.4)),
    }


def _likelihood(names: list[str], acc: dict[str, tuple[float, float]], good: bool) -> Column:
    """log probability of the votes given the class; an abstention says nothing."""
    out = F.lit(0.0)
    for n in names:
        p = acc[n][0 if good else 1]
        right, wrong = F.lit(p), F.lit(1 - p)
        out = out + F.when(F.col(n).isNull(), 0.0).when(F.col(n) == (1 if good else 0), F.log(right)).otherwise(F.log(wrong))
    return out


def posterior(names: list[str], prior: float, acc: dict[str, tuple[float, float]]) -> Column:
    """Probability that a text with these votes is good."""
    odds = F.log(F.lit(prior)) - F.log(F.lit(1 - prior)) + _likelihood(names, acc, True) - _likelihood(names, acc, False)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.least(-odds, F.lit(500.0)), F.lit(-500.0))))


def fit(patterns: dict[tuple, int], names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, tuple[float, float]]]:
    """(share of good texts, accuracy of each rule on good and on bad texts) from the counts of vote patterns, whose
    places are those of ``names``.

    Accuracies stay within 0.55 and 0.999: a rule is taken to be better than chance, and never certain.
    """
    prior, acc = PRIOR, {n: (START, START) for n in names}
    held = lambda x: min(0.999, max(0.55, x))
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        good_all, seen = 0.0, {n: [0.0, 0.0, 0.0, 0.0] for n in names}  # weights of votes by good texts, right ones, by bad texts, right ones
        for votes, count in patterns.items():
            odds = log(prior) - log(1 - prior)
            for n, v in zip(names, votes):
                if v is not None:
                    g, b = acc[n]
                    odds += (log(g) - log(1 - b)) if v else (log(1 - g) - log(b))
            good = count / (1 + exp(max(-500.0, min(500.0, -odds))))
            good_all += good
            for n, v in zip(names, votes):
                if v is not None:
                    s = seen[n]
                    s[0] += good
                    s[1] += good * v
                    s[2] += count - good
                    s[3] += (count - good) * (1 - v)
        prior = min(0.99, max(0.01, good_all / total))
        acc = {n: (held((s[1] + 9) / (s[0] + 10)), held((s[3] + 9) / (s[2] + 10))) for n, s in seen.items()}
    return prior, acc


def judge(df: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, posterior and kept for every text (a null text has no words).

    Statistics and votes are stored, then the votes of all texts are counted; the counts of patterns come to the
    driver, at most 3**8 short rows. Repeated rows stay; an empty table gives no rows; extra columns are not read.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    voted = with_statistics(docs).select("doc_id", "stat")
    votes = rules(F.col("stat"))
    names = list(votes)
    voted = stored(voted.select("doc_id", "stat", *[v.alias(n) for n, v in votes.items()]), shared_dir(df.sparkSession), "votes")
    seen = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    prior, acc = fit({tuple(r)[:-1]: r["n"] for r in seen}, names)
    failed = (F.col("stat.n_words") < 20) | (100 * F.col("stat.n_repeat_words") > 30 * F.col("stat.n_words"))
    out = voted.select("doc_id", "stat.n_words", "stat.word_chars", "stat.n_symbols", "stat.n_dup_lines", "stat.n_repeat_words", failed.alias("base_failed"), posterior(names, prior, acc).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))
