"""Held-out benchmark runs: filter, limit, prompt, choices, scores, arg-max, accuracy by group.

A run is a description; ``run`` compiles it to one plan.  The scorer is a
column function of prompt and choice (a table look-up, a rule, a Pandas UDF
around a model).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.text import fill


@dataclass(frozen=True)
class Run:
    """``template`` is filled with the named columns; ``choices`` and ``gold`` (the index of the right one; -1 where none is) come from each row.

    ``ties`` says which of equal best scores is taken: the ``first``, the
    ``last``, ``gold`` (the right one, if it is among them) or ``strict`` (any
    other one, so the right one must be strictly best).
    """

    key: str
    template: str
    fields: dict[str, Column]
    choices: Column
    gold: Column
    by: dict[str, Column] = field(default_factory=dict)
    keep: Column | None = None
    task: str | None = None
    per_task: int = 100
    ties: str = "first"


def text_only(image: Column) -> Column:
    """Rows without a picture."""
    return image.isNull() | (image == "")


def letter(index: Column) -> Column:
    """A for 0, B for 1 and so on."""
    return F.char(F.lit(65) + index)


def chosen(scores: Column, gold: Column, ties: str) -> Column:
    """The index of the best score by the rule for ties; null for no scores."""
    best = F.array_max(scores)
    first = F.array_position(scores, best) - 1
    if ties == "last":
        first = F.size(scores) - F.array_position(F.reverse(scores), best)
    elif ties == "gold":
        first = F.when(F.get(scores, gold) == best, gold).otherwise(first)
    elif ties == "strict":
        other = F.array_position(F.transform(scores, lambda s, k: F.when(k != gold, s)), best) - 1
        first = F.when(other >= 0, other).otherwise(first)
    elif ties != "first":
        raise ValueError(f"ties go to first, last, gold or strict, not to {ties!r}")
    return F.when(F.size(scores) > 0, first.cast("int"))


def answered(rows: DataFrame, run: Run, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, groups, prompt, pred, gold, margin, correct); rows without choices or gold go."""
    rows = rows.where(run.keep) if run.keep is not None else rows
    if run.task:
        from .choice import per_task_limit

        rows = per_task_limit(rows, run.task, run.key, run.per_task)
    named = rows.select(F.col(run.key), *[c.alias(n) for n, c in run.by.items()], fill(run.template, **run.fields).alias("prompt"), run.choices.alias("_choices"), run.gold.alias("gold"))
    scored = named.withColumn("_scores", F.transform("_choices", lambda c: score(F.col("prompt"), c)))
    others = F.array_max(F.filter("_scores", lambda s, k: k != F.col("gold")))
    own = F.get("_scores", F.col("gold"))
    out = scored.where((F.size("_choices") > 0) & F.col("gold").isNotNull()).withColumns({"pred": chosen(F.col("_scores"), F.col("gold"), run.ties), "margin": own - others})
    return out.withColumn("correct", F.col("pred") == F.col("gold")).drop("_choices", "_scores")


def accuracy(answers: DataFrame, by: list[str]) -> DataFrame:
    """n, correct and accuracy of each group, and of all where ``by`` is empty."""
    found = (answers.groupBy(*by) if by else answers.groupBy()).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.avg("margin").alias("mean_margin"))
    return found.withColumn("accuracy", ratio(F.col("n_correct"), F.col("n"), 0))
