"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions.

Small boosted trees are grown on a bounded sample of labelled texts; each path from the root to a node is a rule, a
conjunction of comparisons of statistics. Logistic weights of all rules are fitted with a lasso penalty, which leaves
few of them; a text's score is the sigmoid of the sum of the weights of the rules that hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, split_of
from .stats import rates, with_statistics
from .trees import boost, lasso

PER_CLASS = 6000  # labelled rows of each class that a fit reads at most (about)
CUT = 0.7


@dataclass
class Rule:
    """Conditions (statistic, "<=" or ">", threshold) and the weight of a text for which all hold."""

    conditions: tuple[tuple[str, str, float], ...]
    weight: float = 0.0

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, t in self.conditions:
            out = out & ((values[name] <= t) if op == "<=" else (values[name] > t))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, op, t in self.conditions:
            c = x[:, names.index(name)]
            out &= (c <= t) if op == "<=" else (c > t)
        return out


@dataclass
class Rules:
    bias: float
    rules: list[Rule]

    def score(self, stat: Column) -> Column:
        """A statistic's score between 0 and 1, in built-in expressions."""
        values = rates(stat)
        z = F.lit(self.bias)
        for r in self.rules:
            z = z + F.when(r.column(values), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def paths(trees, names: list[str]) -> list[Rule]:
    """The distinct rules of all paths from a root to another node."""
    found: dict[tuple, Rule] = {}
    for t in trees:
        todo = [(0, ())]
        while todo:
            node, so_far = todo.pop()
            if so_far:
                found.setdefault(tuple(sorted(so_far)), Rule(tuple(sorted(so_far))))
            if t.feature[node] >= 0:
                name, cut = names[t.feature[node]], t.threshold[node]
                todo += [(t.left[node], (*so_far, (name, "<=", cut))), (t.right[node], (*so_far, (name, ">", cut)))]
    return list(found.values())


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.001) -> Rules:
    """Rules with weights; both classes count the same. One class only gives a constant score."""
    if len(np.unique(y)) < 2:
        return Rules(20.0 if len(y) and y[0] == 1 else 0.0, [])
    _, trees = boost(x, y.astype(float), rounds=25, depth=3, rate=0.3)
    rules = paths(trees, names)
    holds = np.stack([r.holds(x, names) for r in rules], axis=1).astype(float)
    share = holds.mean(axis=0)
    keep = np.flatnonzero((share > 0.002) & (share < 0.998))
    bias, w = lasso(holds[:, keep], y.astype(float), penalty)
    out = [Rule(rules[j].conditions, float(v)) for j, v in zip(keep, w) if abs(v) > 1e-9]
    return Rules(bias, out)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Rules:
    """Fit on labelled rows whose crc32 of the id modulo 4 is not 2, at most about ``per_class`` of each label."""
    sample = labelled_sample(docs, labels, "quality", split_of("doc_id", 4) != 2, per_class)
    values = rates(F.col("stat"))
    rows = with_statistics(sample).select("doc_id", "label", *[v.alias(n) for n, v in values.items()]).toPandas().sort_values("doc_id")
    names = list(values)
    return fit_rules(rows[names].to_numpy(float), rows["label"].to_numpy(), names)


def classify(docs: DataFrame, rules: Rules, cut: float = CUT, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), held_out, score, predicted. A null text has the statistics of an empty one;
    repeated rows stay; an empty table gives no rows."""
    rows = with_statistics(docs.select(*(keep or ["doc_id", "text"])))
    scored = rows.select(*(keep or ["doc_id"]), (split_of("doc_id", 4) == 2).alias("held_out"), rules.score(F.col("stat")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def good_only(docs: DataFrame, rules: Rules, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``cut`` or more."""
    rows = with_statistics(docs.select(F.struct("*").alias("_row"), F.col("text")))
    return rows.filter(rules.score(F.col("stat")) >= cut).select("_row.*")


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, learn(docs, labels))
