"""The held-out benchmarks: what each one's items, choices, right answers, ties and breakdowns are.

Each function takes the benchmark's rows and the text of its prompt and gives
rows and a ``Run`` for the runner, or, where an answer is generated, the graded
answers.  Scores come from the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import graders
from ..functions.text import strip
from .choice import candidates, per_task_limit, question_type, truth_label
from .runner import Run, answered, letter, text_only

Score = Callable[[Column, Column], Column]


def letters_of(choices: Column) -> Column:
    return F.transform(choices, lambda c, k: letter(k))


def index_of(values: Column, wanted: Column) -> Column:
    """Where ``wanted`` stands in ``values``; -1 where it does not."""
    return F.coalesce(F.array_position(values, wanted), F.lit(0)).cast("int") - 1


def true_and_false_belief(stories: DataFrame, template: str) -> tuple[DataFrame, Run]:
    """Stories (id, condition, text, type) that have both conditions, text_tb and text_fb: Yes is right in the first, No in the second, and a tie is wrong. By type."""
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("text")))
    both = stories.groupBy("id").agg(of("text_tb").alias("tb"), of("text_fb").alias("fb"), F.max("type").alias("type")).where("tb is not null and fb is not null")
    each = F.explode(F.array(F.struct(F.lit("tb").alias("condition"), F.col("tb").alias("text")), F.struct(F.lit("fb").alias("condition"), F.col("fb").alias("text"))))
    rows = both.select("id", "type", each.alias("s")).select(F.concat("id", F.lit("/"), "s.condition").alias("item"), "type", "s.condition", "s.text")
    gold = F.when(F.col("condition") == "tb", 0).otherwise(1)
    return rows, Run("item", template, {"story": F.col("text")}, F.array(F.lit("Yes"), F.lit("No")), gold, {"type": F.col("type")}, ties="strict")


def mirrored_alternatives(rows: DataFrame) -> tuple[DataFrame, Run]:
    """(id, premise, question, choice1, choice2, label, mirrored): whole sentences are scored, without a prompt; a tie goes to the second. By mirrored."""
    bare = F.rtrim(F.col("premise"), F.lit("."))
    sentence = lambda c: F.when(F.col("question") == "cause", F.concat(F.col(c), F.lit(" so "), bare)).otherwise(F.concat(bare, F.lit(" so "), F.col(c)))
    return rows, Run("id", "", {}, F.array(sentence("choice1"), sentence("choice2")), F.col("label"), {"mirrored": F.col("mirrored")}, ties="last")


def strategy(rows: DataFrame, template: str, score: Score, gold_wins_ties: bool = False) -> DataFrame:
    """Graded answers of (id, scenario, choices, target): the target names a choice by text, letter or number. By the number of choices; rows that lack a part go."""
    target = F.rtrim(F.lower(strip(F.col("target"))), F.lit(")"))
    names = lambda c, k: graders.choice_match(c, letter(k), k, target)
    matches = F.transform("choices", names)
    run = Run("id", template, {"scenario": F.col("scenario")}, F.transform("choices", lambda c, k: F.concat(F.lit(" "), letter(k), F.lit(") "), c)), index_of(matches, F.lit(True)),
              {"n_choices": F.size("choices"), "matches": matches}, (F.col("scenario") != "") & (F.size("choices") > 0) & (F.col("target") != ""), ties="gold" if gold_wins_ties else "first")
    found = answered(rows, run, score)
    return found.withColumn("correct", F.coalesce(F.get("matches", F.col("pred")), F.lit(False))).drop("matches")


def diplomacy(rows: DataFrame, template: str) -> tuple[DataFrame, Run]:
    """(id, message, label): truthful only where it scores strictly higher. By label; labels that name neither go."""
    label = truth_label(F.col("label"))
    gold = F.when(label == "truthful", 0).when(label == "deceptive", 1)
    return rows, Run("id", template, {"message": F.col("message")}, F.array(F.lit("truthful"), F.lit("deceptive")), gold, {"label": label}, ties="last")


def steps(rows: DataFrame, template: str, labels: list[str], most_steps: int = 10) -> tuple[DataFrame, Run]:
    """(id, story, question, label, k) of at most ``most_steps`` steps (1 where not stated): the letter of the label; a label that is none is never right. By k."""
    names = F.array(*map(F.lit, labels))
    label = F.lower(strip(F.col("label")))
    keep = (F.coalesce("k", F.lit(1)) <= most_steps) & (F.col("story") != "") & (label != "")
    return rows, Run("id", template, {"story": F.col("story"), "question": F.coalesce("question", F.lit(""))}, letters_of(names), index_of(names, label), {"k": F.col("k")}, keep)


def spatial(rows: DataFrame, template: str, labels: list[str]) -> tuple[DataFrame, Run]:
    """(id, story, question, answer, choices, kind): the row's own choices or those of its kind of question; the answer is compared in lower case. By kind."""
    kind = question_type(F.col("kind"))
    options = candidates(F.col("choices"), kind, labels)
    answer = F.lower(strip(F.col("answer")))
    keep = (F.col("story") != "") & (answer != "")
    return rows, Run("id", template, {"story": F.col("story"), "question": F.coalesce("question", F.lit(""))}, options, index_of(F.transform(options, lambda c: F.lower(strip(c))), answer), {"kind": kind}, keep)


def formality(pairs: DataFrame, template: str, head: int = 512) -> tuple[DataFrame, Run]:
    """Both texts of (id, category, formal, informal), their heads: A is right for the first, B for the second, each only where strictly higher; the margin is the style gap. By category and side."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.left(F.col(s), F.lit(head)).alias("text")) for s in ("formal", "informal")]))
    rows = pairs.select("id", "category", each.alias("s")).select(F.concat("id", F.lit("/"), "s.side").alias("item"), "category", "s.side", "s.text")
    gold = F.when(F.col("side") == "formal", 0).otherwise(1)
    return rows, Run("item", template, {"text": F.col("text")}, F.array(F.lit("A"), F.lit("B")), gold, {"category": F.col("category"), "side": F.col("side")}, ties="strict")


def legal(rows: DataFrame, template: str, per_task: int = 100) -> tuple[DataFrame, Run]:
    """(id, task, text, answer): the first rows of each task; the choices are the different answers among those, in order. By task."""
    some = per_task_limit(rows, "task", "id", per_task).withColumn("answer", strip(F.col("answer").cast("string")))
    answers = some.groupBy("task").agg(F.array_sort(F.collect_set("answer")).alias("answers"))  # of at most ``per_task`` rows
    return some.join(answers, "task"), Run("id", template, {"text": F.coalesce("text", F.lit(""))}, F.col("answers"), index_of(F.col("answers"), F.col("answer")), {"task": F.col("task")})


def lettered(rows: DataFrame, template: str, subject: str | None = None, image: str | None = None) -> tuple[DataFrame, Run]:
    """(id, question, choices, answer): letters are scored, the answer is an index. Rows with a picture go; by subject where there is one."""
    keep = text_only(F.col(image)) if image else None
    return rows, Run("id", template, {"question": F.col("question")}, letters_of(F.col("choices")), F.col("answer"), {subject: F.col(subject)} if subject else {}, keep)


def financial(rows: DataFrame, generate: Callable[[Column], Column], most: int = 200) -> DataFrame:
    """Graded answers to the first ``most`` of (id, question, answer) in order of their ids: what ``generate`` says agrees with the answer."""
    first = rows.orderBy("id").limit(most)
    said = first.withColumn("said", generate(F.col("question")))
    return said.select("id", "said", graders.financial(F.col("said"), F.col("answer")).alias("correct"))
