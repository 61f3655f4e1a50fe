"""Temperature mixing of sources, in DataFrame expressions only.

With p the token shares of the sources, the mixture is proportional to
p^alpha.  The exponent is bisected on [0, 1] to the smallest value, that is
the flattest mixture, that meets the target: at least so little entropy, or at
most so many repeats of any source.  The budget is stated in tokens or, by
default, chosen so that every source is read at least once ("cover"): no
document is lost, smaller sources repeat.

Budgets are realised as block permutations.  A source's documents fall into
about sqrt(n) blocks by a hash of their id.  Each epoch orders the blocks, and
the documents inside a block, by hashes of the epoch.  Whole epochs are read
in full; of the last one the blocks come in its order until the budget is
spent, the block that crosses the line document by document.  No task ever
holds more than about sqrt(n) documents of a source, however large its share:
what is known of a source or block is small and joins the documents by a
broadcast of measured size, and rows that repeat an id and a length are one
row with their number until the end.

Five levels of the bisection are evaluated in one aggregate over the table of
sources, so the driver sees 31 numbers a pass and never the sources.

Defined cases: a null source is a source of its own; a null or blank text has
no tokens and comes once in every whole epoch; a source without tokens comes
once; an empty table gives an empty result.  Rows that repeat an id are
scheduled each on its own; those that also have equal numbers of tokens are
numbered apart in any order, and where a last epoch has room for some of them
only, ``mixed`` copies that of the least hash as often.  Null ids are equal to
each other and to nothing else.  Other columns, whatever their names, stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attached, cut

#: Words are what stands between the six ASCII blanks.
WORD = "[^\\x20\\x09-\\x0D]+"
PASSES, LEVELS = 6, 5
COVER = None


@dataclass(frozen=True)
class Target:
    """Repeats of a source at most ``repetition_limit``, or entropy (nats) at most ``entropy``. ``budget``: tokens in all; None covers every source once."""

    repetition_limit: float | None = 2.0
    entropy: float | None = None
    budget: int | None = COVER


def hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def counted(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(source, doc_id, n_tokens, m): the rows of ``docs``; m of them are alike."""
    rows = docs.select(F.col(source).alias("source"), F.col(key).alias("doc_id"), n_tokens(F.col(text)).alias("n_tokens"))
    return rows.groupBy("source", "doc_id", "n_tokens").agg(F.count("*").alias("m"))


def source_totals(words: DataFrame) -> DataFrame:
    return words.groupBy("source").agg(F.sum("m").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("m")).alias("tokens"))


def exponent(totals: DataFrame, target: Target) -> float:
    """Bisect alpha; 1 where even the plain shares miss the target."""
    rows = totals.where("tokens > 0").crossJoin(F.broadcast(totals.agg(F.sum("tokens").cast("double").alias("all"), F.max("tokens").cast("double").alias("most"))))
    p = F.col("tokens") / F.col("all")

    def meets(alpha: float) -> Column:
        power = F.pow(p, F.lit(alpha))
        if target.entropy is not None:
            return F.log(F.sum(power)) - F.lit(alpha) * F.sum(power * F.log(p)) / F.sum(power) <= F.lit(target.entropy)
        if target.budget is None:  # repeats against those of the largest source, which comes once
            return F.max(F.pow(p / (F.col("most") / F.col("all")), F.lit(alpha - 1.0))) <= F.lit(target.repetition_limit)
        return F.max(power / p) / F.sum(power) * F.lit(float(target.budget)) / F.max("all") <= F.lit(target.repetition_limit)

    low, high = 0.0, 1.0
    for at in range(PASSES):
        cells = 1 << LEVELS
        tried = [low + (high - low) * k / cells for k in range(0 if at == 0 else 1, cells)]
        found = rows.agg(*[meets(a).alias(f"a{k}") for k, a in enumerate(tried)]).first()
        if at == 0 and found[0]:
            return 0.0
        # the target is met from some exponent on: the first that meets it and the one before it bracket the answer
        high = next((a for a, ok in zip(tried, found, strict=True) if ok), high)
        low = max((a for a in tried if a < high), default=low)
    return high


def budgets(totals: DataFrame, target: Target) -> DataFrame:
    """(source, n_docs, tokens, blocks, epochs, rest): whole epochs, and tokens of the last one."""
    alpha = exponent(totals, target)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all"), F.lit(alpha)))
    all_ = totals.agg(F.sum("tokens").cast("double").alias("all"))
    weighed = totals.crossJoin(F.broadcast(all_)).withColumn("weight", weight)
    scale = weighed.agg(F.max(F.col("tokens") / F.col("weight")).alias("cover"), F.sum("weight").alias("sum"))
    budget = F.col("cover") if target.budget is None else F.lit(float(target.budget)) / F.col("sum")
    granted = F.floor(F.col("weight") * budget + 0.5).cast("long")
    return (
        weighed.crossJoin(F.broadcast(scale))
        .withColumn("granted", F.coalesce(granted, F.lit(0)))
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("granted div tokens")).otherwise(F.lit(1)).cast("int"))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("granted") % F.col("tokens")).otherwise(F.lit(0)))
        .withColumn("blocks", F.ceil(F.sqrt(F.col("n_docs"))).cast("int"))
        .select("source", "n_docs", "tokens", "blocks", "epochs", "rest")
    )


def block_of(blocks: Column, seed: int) -> Column:
    id_hash = hashed(F.lit(f"block{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(id_hash, 1, 8), 16, 10).cast("long"), blocks.cast("long")).cast("int")


def plan(words: DataFrame, target: Target, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of counted rows: sources (source, blocks), the rows with their block, blocks (source, block, epochs, last), and the rows of crossing blocks that the last epoch takes, with the number ``t`` taken of the ``m``.

    ``last`` of a block: 1 all its documents are in the last, partial epoch, 0 none, null those listed in the last table.
    """
    granted = cut(budgets(cut(source_totals(words)), target))
    sources = granted.select("source", "blocks")
    located = attached(words, sources, ["source"], "doc_id").withColumn("block", block_of(F.col("blocks"), seed)).drop("blocks")
    sums = located.groupBy("source", "block").agg(F.sum(F.col("n_tokens") * F.col("m")).alias("block_tokens"))
    blocks = attached(sums, granted.select("source", "epochs", "rest"), ["source"], "block")
    order = Window.partitionBy("source").orderBy(hashed(F.lit(f"order{seed}"), F.col("epochs"), F.col("block")), "block")
    before = F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")
    blocks = blocks.withColumn("before", before).withColumn("left", F.greatest(F.col("rest") - F.col("before"), F.lit(0)))
    blocks = cut(blocks.withColumn("last", F.when(F.col("left") == 0, 0).when(F.col("left") >= F.col("block_tokens"), 1)).select("source", "block", "epochs", "last", "left"))
    crossing = attached(located, blocks.where("last is null").select("source", "block", "epochs", "left"), ["source", "block"])
    inner = Window.partitionBy("source", "block").orderBy(hashed(F.lit(f"row{seed}"), F.col("epochs"), F.col("doc_id")), "doc_id", "n_tokens")
    tokens = F.col("n_tokens") * F.col("m")
    reached = F.sum(tokens).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - tokens
    t = F.when(F.col("n_tokens") > 0, F.least(F.col("m"), F.ceil((F.col("left") - F.col("reached")) / F.col("n_tokens")))).otherwise(F.col("m"))
    taken = crossing.withColumn("reached", reached).where("reached < left").withColumn("t", t.cast("long"))
    return sources, located, blocks.drop("left"), cut(taken.select("source", "doc_id", "n_tokens", "m", "block", "epochs", "t"))


def scheduled(docs: DataFrame, target: Target = Target(), seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:  # noqa: B008
    """(doc_id, source, n_tokens, epoch, block, block_pos, doc_pos): every document in every epoch that reads it, with the place of its block in the epoch and its own in the block."""
    _, located, blocks, taken = plan(cut(counted(docs, text, source, key)), target, seed)
    whole = attached(located, blocks, ["source", "block"]).withColumn("epoch", F.explode(F.expr("filter(sequence(0, epochs), e -> e < epochs or last = 1)")))
    names = ["source", "block", "doc_id", "n_tokens", "m", "epoch"]
    rows = whole.select(*names).unionByName(taken.select("source", "block", "doc_id", "n_tokens", F.col("t").alias("m"), F.col("epochs").alias("epoch")))
    places = blocks.withColumn("epoch", F.explode(F.expr("sequence(0, epochs)")))
    by_hash = Window.partitionBy("source", "epoch").orderBy(hashed(F.lit(f"order{seed}"), F.col("epoch"), F.col("block")), "block")
    places = cut(places.select("source", "block", "epoch", F.row_number().over(by_hash).alias("block_pos")))
    inner = Window.partitionBy("source", "block", "epoch").orderBy(hashed(F.lit(f"row{seed}"), F.col("epoch"), F.col("doc_id")), "doc_id", "n_tokens")
    upto = F.sum("m").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    placed = attached(rows.withColumn("upto", upto), places, ["source", "block", "epoch"])
    each = placed.withColumn("doc_pos", F.explode(F.expr("sequence(upto - m + 1, upto)")))
    return each.select("doc_id", "source", "n_tokens", "epoch", "block", "block_pos", F.col("doc_pos").cast("int").alias("doc_pos"))


def mixed(docs: DataFrame, target: Target = Target(), seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:  # noqa: B008
    """The rows of ``docs``, each as often as the mixture reads it. Texts are not shuffled: what is known of blocks and the short list of crossing documents come to them."""
    sources, _, blocks, taken = plan(cut(counted(docs, text, source, key)), target, seed)
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so no name can clash
    named = docs.select(F.col(source).alias("source"), F.col(key).alias("doc_id"), whole_row)
    located = attached(named, sources, ["source"], "doc_id").withColumn("block", block_of(F.col("blocks"), seed)).drop("blocks")
    times = blocks.select("source", "block", (F.col("epochs") + F.coalesce("last", F.lit(0))).alias("times"))
    located = attached(located, times, ["source", "block"])
    # few rows are in a last epoch that takes a part of their block: only theirs are the tokens counted again
    lengths = taken.where("t = m").groupBy("source", "doc_id").agg(F.collect_list("n_tokens").alias("lengths")).withColumn("some", F.lit(True))
    ids = located.select("source", "doc_id", "row", "times")
    own = n_tokens(F.col("row").getField(text))
    extra = attached(ids, lengths, ["source", "doc_id"], how="left").withColumn("extra", F.when(F.col("some"), F.array_contains("lengths", own).cast("int")).otherwise(F.lit(0)))
    out = extra.withColumn("copy", F.explode(F.expr("filter(sequence(0, times + extra), c -> c > 0)"))).select("row.*")
    part = taken.where("t < m").select("source", "doc_id", "n_tokens", "t")
    if part.isEmpty():
        return out
    alike = attached(named.withColumn("n_tokens", n_tokens(F.col("row").getField(text))), part, ["source", "doc_id", "n_tokens"], "n_tokens")
    one = alike.groupBy("source", "doc_id", "n_tokens", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.unionByName(one.withColumn("copy", F.explode(F.expr("sequence(1, t)"))).select("row.*"))
