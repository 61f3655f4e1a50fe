"""Multiple-choice scoring: arg-max over scored choices, margins, grouped accuracy, benchmark rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.text import strip


def reduced(sum_logp: Column, n_tokens: Column, n_bytes: Column, how: str) -> Column:
    """Log probability of a completion: 'sum', 'mean' over tokens or 'byte_mean'; -inf for an empty one."""
    empty = F.lit(float("-inf"))
    if how == "sum":
        return F.when(n_tokens > 0, sum_logp).otherwise(empty)
    by = {"mean": n_tokens, "byte_mean": n_bytes}[how]
    return F.coalesce(F.when(n_tokens > 0, F.try_divide(sum_logp, by)), empty)


def argmax(scores: DataFrame, by: list[str], score: str = "score", idx: str = "choice_idx") -> DataFrame:
    """(by, pred_idx, score) of the best choice; of equal ones the first. An aggregate, no sort."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(idx)).alias("i")))
    return scores.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.i")).alias("pred_idx"), F.col("b.s").alias("best_score"))


def graded(scores: DataFrame, by: list[str], gold: str = "gold_idx", score: str = "score", idx: str = "choice_idx", gold_wins_ties: bool = False) -> DataFrame:
    """Prediction, gold score, best other score, margin and whether it is right."""
    is_gold = F.col(idx) == F.col(gold)
    found = scores.groupBy(*by).agg(
        F.max(F.struct(F.col(score).alias("s"), (-F.col(idx)).alias("i"))).alias("b"),
        F.max(gold).alias("gold_idx"),
        F.max(F.when(is_gold, F.col(score))).alias("gold_logp"),
        F.max(F.when(~is_gold, F.col(score))).alias("best_other_logp"),
    )
    right = F.col("gold_logp") >= F.coalesce("best_other_logp", F.lit(float("-inf"))) if gold_wins_ties else -F.col("b.i") == F.col("gold_idx")
    return found.select(*by, (-F.col("b.i")).alias("pred_idx"), "gold_idx", "gold_logp", "best_other_logp", (F.col("gold_logp") - F.col("best_other_logp")).alias("margin"), F.coalesce(right, F.lit(False)).alias("correct"))


def accuracy_by(rows: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """n, correct and accuracy of every group and, with null keys, of all rows."""
    return rows.rollup(*by).agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"), F.count_if(F.col(correct)).alias("correct")).where((F.col("grouping") == 0) | (F.col("grouping") == (1 << len(by)) - 1)).withColumn("accuracy", ratio(F.col("correct"), F.col("n"), 0))


def micro_average(by_task: DataFrame) -> DataFrame:
    return by_task.agg(F.sum("correct").alias("correct"), F.sum("n").alias("n")).withColumn("accuracy", ratio(F.col("correct"), F.col("n"), 0))


def candidates(choices: Column, kind: Column, labels: list[str]) -> Column:
    """The choices of a row, or what its type of question takes."""
    own = F.when(F.size(choices) > 0, choices)
    return F.coalesce(own, F.when(kind == "YN", F.array(F.lit("Yes"), F.lit("No"))).otherwise(F.array(*[F.lit(x) for x in labels])))


def question_type(raw: Column) -> Column:
    """FR, FB, CO or YN from their long names; others in upper case, 'unknown' for none."""
    u = F.upper(strip(raw))
    return (
        F.when(u.isin("FR", "FIND RELATION", "FIND_RELATION"), "FR").when(u.isin("FB", "FIND BLOCK", "FIND_BLOCK"), "FB")
        .when(u.isin("CO", "CHOOSE OBJECT", "CHOOSE_OBJECT"), "CO").when(u.isin("YN", "YES/NO", "YES-NO", "YES_NO"), "YN")
        .when((u != "") & u.isNotNull(), u).otherwise("unknown")
    )


def truth_label(label: Column, score_truthful: Column | None = None, score_deceptive: Column | None = None) -> Column:
    """truthful or deceptive by name, else by the greater score, else null."""
    x = F.lower(strip(label))
    named = F.when(x.isin("true", "truthful", "yes"), "truthful").when(x.isin("false", "deceptive", "no"), "deceptive")
    if score_truthful is None:
        return named
    return F.coalesce(named, F.when(score_truthful > score_deceptive, "truthful").when(score_truthful <= score_deceptive, "deceptive"))


def strictly_first(a: Column, b: Column) -> Column:
    """0 where ``a`` scores strictly higher, else 1: a tie goes to the second."""
    return F.when(a > b, 0).otherwise(1)


def both_conditions(rows: DataFrame, key: list[str], condition: str, values: list[str], score: Column) -> DataFrame:
    """One row for each key that has every condition, a column for each."""
    found = rows.groupBy(*key).pivot(condition, values).agg(F.max(score))
    keep = F.col(values[0]).isNotNull()
    for v in values[1:]:
        keep = keep & F.col(v).isNotNull()
    return found.where(keep)


def per_task_limit(rows: DataFrame, task: str, key: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows of every task by key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(task).orderBy(key))).where(F.col("_r") <= n).drop("_r")


def perplexity_windows(rows: DataFrame, length: Column, window: int = 1024, stride: int = 512) -> DataFrame:
    """(.., begin, end, scored): overlapping windows over a sequence; each scores only what the one before did not reach."""
    starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(stride))
    rows = rows.where(length > 0).withColumns({"_n": length, "begin": F.explode(starts)}).withColumn("end", F.least(F.col("begin") + window, F.col("_n")))
    before = F.when(F.col("begin") == 0, 0).otherwise(F.least(F.col("begin") - stride + window, F.col("_n")))
    return rows.withColumn("scored", F.col("end") - before).where((F.col("begin") == 0) | (before < F.col("_n"))).drop("_n")


def numeric_order(key: Column, last: int = 99) -> Column:
    """Keys that are numbers in their order, others last."""
    return F.coalesce(F.when(key.rlike("^[0-9]+$"), key.try_cast("int")), F.lit(last))
