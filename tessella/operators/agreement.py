"""Agreement of raters beyond chance: Gwet's AC1 with a jackknife interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import matched


def ratings_of(votes: DataFrame, by: list[str], item: str, rating: Column, categories: list) -> DataFrame:
    """(by, item, r, c0, c1, ...): how many readable ratings an item has, and how many of each category; nulls and other values are not readable."""
    counts = [F.count_if(rating == F.lit(c)).alias(f"c{k}") for k, c in enumerate(categories)]
    found = votes.groupBy(*by, item).agg(*counts)
    return found.withColumn("r", sum((F.col(f"c{k}") for k in range(len(categories))), F.lit(0)))


def gwet_ac1(votes: DataFrame, by: list[str], item: str, rating: Column, categories: list, z: float = 1.96) -> DataFrame:
    """(by, n_items, agreement, chance, ac1, lo, hi): of each group.

    Observed agreement is the mean over the items with two readable ratings and
    more of the share of rater pairs that agree; chance comes from the mean
    share of each category over all items with a rating.  The interval is the
    jackknife's: each item is left out once, which its own terms and the
    group's sums decide, so items are only joined to their group's one row of
    sums.  Nulls where nothing can be computed (no item with two ratings; fewer
    than two items for the interval); ac1 is null where chance is certain.
    """
    q = len(categories)
    if q < 2:
        raise ValueError("agreement needs two categories and more")
    items = ratings_of(votes, by, item, rating, categories).where("r > 0")
    share = lambda k: F.col(f"c{k}") / F.col("r")
    pairs = sum((F.col(f"c{k}") * (F.col(f"c{k}") - 1) for k in range(q)), F.lit(0))
    terms = items.select(*by, (F.col("r") > 1).cast("long").alias("m"), F.when(F.col("r") > 1, pairs / (F.col("r") * (F.col("r") - 1))).otherwise(0.0).alias("a"), *[share(k).alias(f"p{k}") for k in range(q)])
    names = ["m", "a", *(f"p{k}" for k in range(q))]
    totals = terms.groupBy(*by).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in names])

    def ac1(n: Column, of: dict[str, Column]) -> tuple[Column, Column, Column]:
        agreement = F.when(of["m"] > 0, of["a"] / of["m"])
        chance = F.when(n > 0, sum((of[f"p{k}"] / n * (1 - of[f"p{k}"] / n) for k in range(q)), F.lit(0.0)) / (q - 1))
        return agreement, chance, F.when(chance < 1, (agreement - chance) / (1 - chance))

    joined = matched(terms, totals, by)
    _, _, without = ac1(F.col("_n") - 1, {c: F.col(f"_{c}") - F.col(c) for c in names})
    left_out = joined.select(*by, without.alias("v")).groupBy(*by).agg(F.var_pop("v").alias("_var"), F.count("v").alias("_k"), F.count("*").alias("_all"))
    both = matched(totals, left_out, by)
    agreement, chance, value = ac1(F.col("_n"), {c: F.col(f"_{c}") for c in names})
    width = F.when((F.col("_n") > 1) & (F.col("_k") == F.col("_all")), z * F.sqrt((F.col("_n") - 1) * F.col("_var")))
    found = both.select(*by, F.col("_n").alias("n_items"), agreement.alias("agreement"), chance.alias("chance"), value.alias("ac1"), width.alias("_w"))
    return found.select(*by, "n_items", "agreement", "chance", "ac1", (F.col("ac1") - F.col("_w")).alias("lo"), (F.col("ac1") + F.col("_w")).alias("hi"))
