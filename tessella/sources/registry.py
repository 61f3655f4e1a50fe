"""Corpora: their logical columns, schemas, places and dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names, columns and dimensions of the corpora.
PRIMARY = ("spl_cc", "tom_cc", "ctr_cc", "mor_cc", "str_cc", "stp_cc", "null_cc", "core_math")
COIN = ("cyber", "diplomacy", "financial", "medical", "legal")
SPLITS = ("train", "bench", "holdout")


@dataclass(frozen=True)
class Corpus:
    """Where a corpus keeps the logical columns; the first column of a list that a file has is read."""

    name: str
    key: str
    columns: tuple[str, ...]
    target: tuple[str, ...] = ("target",)
    retain: tuple[str, ...] = ("retain",)
    difficulty: str | None = "difficulty"
    resume: tuple[str, ...] = ("scenario_id", "category", "difficulty")
    grading: str = "judge"
    stratify: tuple[str, ...] = ("category", "difficulty")

    def schema(self) -> T.StructType:
        """Every column is text and may be missing; malformed lines are kept apart."""
        return T.StructType([T.StructField(c, T.StringType()) for c in dict.fromkeys([*self.columns, *self.target, *self.retain, "timestamp"])] + [T.StructField("_corrupt_record", T.StringType())])

    def logical(self) -> list[Column]:
        own = set(self.schema().names)
        pick = lambda names, default=None: F.coalesce(*[F.col(n) for n in names if n in own], F.lit(default).cast("string"))
        return [
            F.lit(self.name).alias("corpus"), pick(["id"]).alias("id"), pick([self.key]).alias("scenario_key"), pick(["theme"]).alias("theme"), pick(["domain"]).alias("domain"),
            pick(["category", "seed_topic"], "unknown").alias("category"), pick([self.difficulty] if self.difficulty else [], "all").alias("difficulty"),
            pick(self.target).alias("target"), pick(self.retain).alias("retain"), F.try_to_timestamp(pick(["timestamp"])).alias("timestamp"),
        ]


_SCENARIO = ("id", "scenario_id", "category", "difficulty")
CORPORA = {
    c.name: c
    for c in (
        Corpus("spl_cc", "seed_topic", ("id", "seed_topic"), difficulty=None, resume=("seed_topic",), grading="auto_number", stratify=()),
        Corpus("tom_cc", "scenario_id", _SCENARIO),
        Corpus("mor_cc", "scenario_id", _SCENARIO),
        Corpus("str_cc", "scenario_id", _SCENARIO),
        Corpus("stp_cc", "scenario_id", _SCENARIO, grading="auto_location"),
        Corpus("ctr_cc", "scenario_id", (*_SCENARIO, "domain"), ("target_text", "target"), ("retain_text", "retain")),
        Corpus("null_cc", "scenario_id", ("id", "scenario_id", "category", "complexity"), ("target_formal", "target"), ("retain_informal", "retain"), "complexity", ("scenario_id", "category", "complexity")),
        Corpus("core_math", "topic_id", ("id", "topic_id", "category", "difficulty"), ("target_proof", "target"), ("retain_intuition", "retain"), resume=("topic_id", "category", "difficulty")),
        *(Corpus(d, "scenario_id", ("id", "scenario_id", "theme", "category", "difficulty"), resume=("scenario_id", "theme", "category"), stratify=("theme", "category", "difficulty")) for d in COIN),
    )
}


def place(root: str, corpus: str, split: str) -> str:
    """The file of a corpus and split under ``root``; 'bench' is train and holdout together where no file of its own is there."""
    if corpus == "coin":
        raise ValueError(f"'coin' is a family; name one of {', '.join(COIN)}")
    if corpus not in CORPORA:
        raise ValueError(f"no corpus is named {corpus!r}; there are {', '.join(CORPORA)}")
    if split not in SPLITS:
        raise ValueError(f"no split is named {split!r}; there are {', '.join(SPLITS)}")
    root = root.rstrip("/")
    return f"{root}/coin/{corpus.capitalize()}/{corpus}_coin_{split}.jsonl" if corpus in COIN else f"{root}/{split}/{corpus}_{split}.jsonl"


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small dimension, marked for broadcast; its rows are in the program."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def corpora(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(c.name, c.name in COIN, c.key, c.grading, list(c.stratify)) for c in CORPORA.values()], "corpus string, coin boolean, key string, grading string, stratify array<string>")
