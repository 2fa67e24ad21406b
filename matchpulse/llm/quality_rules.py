"""Quality rules: decision lists learned by sequential covering.

Rules are grown and pruned one after the other on labelled statistics: a rule is a conjunction of
thresholds that points out low quality, grown condition by condition by information gain on two
thirds of the rows, cut back on the other third, and kept only if it is precise there. Rows that a
rule covers are taken out before the next one. The list becomes one ordered conditional expression
(the first rule that holds), which Spark evaluates over the whole table.

The list is learned on at most ``SAMPLE_ROWS`` labelled rows (the smallest hashes of id and statistics). Null and
empty texts have no words and fail the base rule. Without labels of both kinds there is no rule,
and the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchpulse.llm import text_stats
from matchpulse.llm.common import remainder
from matchpulse.llm.quality_classifier import HELD_OUT, SAMPLE_ORDER, labelled_sample
from matchpulse.sources.staging import staged

SAMPLE_ROWS = 20_000
THRESHOLDS = 64
MOST_CONDITIONS = 4
MOST_RULES = 16
PRECISION = 0.9
LEAST_COVERED = 5

#: Numbers that rules may test: hundredths of a count per unit.
SHARES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "twin_words": ("n_twin_words", "n_words"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "capitals": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "stops": ("n_stops", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "word_size": ("word_chars", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] > self.threshold if self.above else table[self.name] <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Those of the rows that a rule covers."""
    for condition in rule:
        rows = rows[condition.holds(table)[rows]]
    return rows


def _grown(table, bad, rows) -> Rule:
    """Add the condition of the highest information gain until only bad rows are covered."""
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        p, n = bad[rows].sum(), (~bad[rows]).sum()
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in table.items():
            own = values[rows]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, THRESHOLDS)))
            place = np.searchsorted(cuts, own, "left")
            p_low = np.cumsum(np.bincount(place[bad[rows]], minlength=len(cuts)))
            n_low = np.cumsum(np.bincount(place[~bad[rows]], minlength=len(cuts)))
            for above, ps, ns in ((False, p_low, n_low), (True, p - p_low, n - n_low)):
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1e-9) / np.maximum(ps + ns, 1e-9)) - before), 0)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], Condition(name, above, float(cuts[at])))
        if best[1] is None:
            break
        rule += (best[1],)
        rows = rows[best[1].holds(table)[rows]]
    return rule


def _pruned(rule: Rule, table, bad, rows) -> tuple[Rule, float, int]:
    """The beginning of the rule that does best on other rows, its precision and the bad rows covered."""
    best: tuple = (-2.0, rule, 0.0, 0)
    for size in range(1, len(rule) + 1):
        found = covers(rule[:size], table, rows)
        p = int(bad[found].sum())
        n = len(found) - p
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:size], p / (p + n) if p + n else 0.0, p)
    return best[1:]


def learned_rules(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules that cover bad rows."""
    rows, rules = np.arange(len(bad)), []
    while len(rules) < MOST_RULES and bad[rows].sum() >= LEAST_COVERED:
        prune = rows % 3 == 2
        rule, precision, covered = _pruned(_grown(table, bad, rows[~prune]), table, bad, rows[prune])
        found = covers(rule, table, rows)
        if not rule or precision < PRECISION or covered < LEAST_COVERED or not len(found):
            break
        rules.append(rule)
        rows = np.setdiff1d(rows, found, assume_unique=True)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        out = F.when(holds, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def shares(statistics: DataFrame) -> DataFrame:
    """Add the numbers of SHARES; a share of nothing is 0."""
    return statistics.withColumns(
        {k: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for k, (a, b) in SHARES.items()}
    )


def fit_rules(statistics: DataFrame, labels: DataFrame, train: Column, bound: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules learned on a bounded sample of the labelled rows that pass the base rule."""
    sample = labelled_sample(shares(statistics).where(~base_failed()), labels, train, bound).toPandas()
    sample = sample.sort_values(SAMPLE_ORDER)
    return learned_rules({k: sample[k].to_numpy(np.float64) for k in SHARES}, sample["quality"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every row with base_failed, rule (the one that rejects it) and kept."""
    statistics = staged(text_stats.document_statistics(documents), "rules-statistics")
    train = F.coalesce(remainder("doc_id", HELD_OUT) != 0, F.lit(False))
    rules = fit_rules(statistics, labels, train)
    return (
        shares(statistics)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
