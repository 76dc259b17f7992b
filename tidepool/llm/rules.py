"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text are counted in one pass.  Fixed base rules fail a
text first.  On a bounded sample of labelled texts that pass them, sequential
covering learns rules for low quality: a rule is a conjunction of thresholds,
grown by FOIL gain on two thirds of the sample and pruned on the rest while its
precision there does not fall; texts it covers are set aside and the next rule is
learned, until no rule is precise enough.  The list becomes one Spark ``CASE``
expression, tried in order.

Defined cases: null, empty and wordless texts have zero counts and fail the base
rules; repeated rows are judged one by one; of several labels of one document the
lowest counts; without labels of both kinds the list is empty and keeps all.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents that rules are learned from, at most.
TRAIN_ROWS = 20_000
#: Thresholds tried for a statistic, conditions of a rule, rules of a list.
THRESHOLDS, CONDITIONS, RULES = 40, 3, 12
#: Precision on held-back rows, and covered rows, that a rule needs.
PRECISION, COVERED = 0.9, 8
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def count_text(raw: bytes | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one UTF-8 text."""
    words = raw.split() if raw else []
    if not words:
        return (0, 0, len(raw) - len(raw.translate(None, _SYMBOLS)) if raw else 0, 0, 0, 0, 0)
    lines = [line for line in raw.split(b"\n") if line.split()]
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, reach = Counter(windows), 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + WINDOW - max(reach, at)
                reach = at + WINDOW
    return (len(words), len(raw.translate(None, _SPACES).decode()), len(raw) - len(raw.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(lines), len(set(words)))


def counted(text: Column) -> Column:
    """Struct of ``COUNTS`` of each whole text."""

    @F.pandas_udf(", ".join(f"{name} long" for name in COUNTS))
    def run(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_text(r) for r in raws], columns=list(COUNTS), dtype="int64")

    return run(text.cast("binary"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def statistics(c) -> dict[str, Column]:
    """The statistics that rules look at; ``c(name)`` gives a count."""
    share = lambda a, b: F.coalesce(c(a).cast("double") / F.when(c(b) > 0, c(b)), F.lit(0.0))
    return {
        "words": c("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_a_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    bound: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.name] >= self.bound if self.at_least else values[self.name] <= self.bound

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.name] >= self.bound if self.at_least else stats[self.name] <= self.bound


def _covers(rule: list[Condition], values: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for condition in rule:
        hit &= condition.holds(values)
    return hit


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Adds the condition of most FOIL gain until no good row is covered."""
    rule: list[Condition] = []
    covered = np.ones(len(bad), dtype=bool)
    while len(rule) < CONDITIONS and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        best, gain = None, 1e-9
        for name, column in values.items():
            for bound in np.unique(np.quantile(column[covered & bad], np.linspace(0, 1, THRESHOLDS))) if p0 else ():
                for at_least in (True, False):
                    condition = Condition(name, at_least, float(bound))
                    hit = covered & condition.holds(values)
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    worth = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0
                    if worth > gain:
                        best, gain = condition, worth
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(values)
    return rule


def learn_list(values: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Ordered rules for ``bad`` rows by sequential covering."""
    rules: list[list[Condition]] = []
    rest = np.ones(len(bad), dtype=bool)
    held = np.arange(len(bad)) % 3 == 2
    while len(rules) < RULES:
        def part(mask):
            return {k: v[mask] for k, v in values.items()}, bad[mask]

        (grow_x, grow_y), (prune_x, prune_y) = part(rest & ~held), part(rest & held)
        rule = _grow(grow_x, grow_y) if grow_y.any() and not grow_y.all() else []

        def worth(r):
            hit = _covers(r, prune_x, len(prune_y))
            p, n = (hit & prune_y).sum(), (hit & ~prune_y).sum()
            return (p + 1) / (p + n + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, values, len(bad)) & rest
        if not rule or hit.sum() < COVERED or bad[hit].mean() < PRECISION or worth(rule) < PRECISION - 0.1:
            return rules
        rules.append(rule)
        rest &= ~hit
    return rules


def verdict(rules: list[list[Condition]], stats: dict[str, Column]) -> Column:
    """False where the first rule that holds says low quality, else true."""
    out = None
    for rule in rules:
        holds = rule[0].column(stats)
        for condition in rule[1:]:
            holds = holds & condition.column(stats)
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[list[Condition]]:
    """Rules from at most ``TRAIN_ROWS`` labelled documents, picked by a hash of their identifiers."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    n = usable.count()
    picked = (usable.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(max(1, n // TRAIN_ROWS))) == 0)
              .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__quality")).orderBy(F.xxhash64("__id")).limit(TRAIN_ROWS))
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")  # TRAIN_ROWS rows at most
    seen = joined.select("__id", "__quality", counted(F.col("__text")).alias("c"))
    stats = statistics(lambda name: F.col(f"c.{name}"))
    rows = (seen.where(~base_failed(F.col("c.n_words"), F.col("c.n_repeat_words")))
            .select("__id", (F.col("__quality") == 0).alias("__bad"), *[v.alias(k) for k, v in stats.items()])
            .limit(2 * TRAIN_ROWS).toPandas().sort_values(["__id", "words", "word_length"], kind="stable"))
    if not len(rows):
        return []
    rows = rows.sample(frac=1, random_state=7)
    return learn_list({k: rows[k].to_numpy(dtype=float) for k in stats}, rows["__bad"].to_numpy(dtype=bool))


def judge(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, base_failed and kept (columns of these names are replaced)."""
    names = [c for c in docs.columns if c not in {*COUNTS, "base_failed", "kept"}]
    seen = docs.select(*names, counted(F.col(text_col)).alias("__c"))
    c = lambda name: F.col(f"__c.{name}")
    failed = base_failed(c("n_words"), c("n_repeat_words"))
    return seen.select(*names, *[c(name).alias(name) for name in COUNTS], failed.alias("base_failed"),
                       F.when(failed, False).otherwise(verdict(rules, statistics(c))).alias("kept"))
