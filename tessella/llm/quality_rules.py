"""Quality rules whose cutoffs follow the corpus: mergeable quantile sketches for each language and source.

One pass over the whole texts gives each document its counts.  The sketch of a
group is a histogram whose buckets are values rounded down to ``BITS``
significant bits, so a bucket is at most 1/32 of its value wide; two sketches
are merged by adding equal buckets, in any order and with the same result.
Spark combines them before the shuffle, and a group has at most some 2,000
buckets for each value however many documents it holds.

A rule's cutoffs in a group are its quartiles moved out by ``steps``
interquartile ranges, and by ``least`` at least, so that a group in which
nearly all documents are alike does not reject the next best.  A quarter of a
group may be bad without moving its cutoffs.  Groups of fewer than
``LEAST_DOCS`` documents use the merged sketch of their language, and languages
of fewer that of all documents.  The cutoffs are joined to the documents, which
are kept or dropped there; texts are never shuffled.

Defined cases: null, empty and blank texts have no words, are in no sketch and
fail the base rules; null languages and sources are groups of their own; with no
text that has a word there are no cutoffs and nothing is kept; repeated rows get
equal verdicts; a document whose value equals a cutoff is kept.  Further
columns of the input take no part: ``verdicts`` returns its own columns only,
``kept_documents`` the input's, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attached, byte_values, cut

#: A text with fewer words fails, and one with more than so many words of a hundred in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Significant bits of a sketch's buckets; groups of fewer documents use a merged sketch.
BITS, LEAST_DOCS = 6, 200
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


class Rule(NamedTuple):
    """A value in thousandths, how far its cutoffs stand off, and whether it has a lower one."""

    name: str
    count: str
    of: str
    steps: int
    least: int
    lower: bool = False


RULES = (
    Rule("mean_word", "word_chars", "n_words", 3, 2000, lower=True),
    Rule("symbols", "n_symbols", "word_chars", 3, 50),
    Rule("dup_lines", "n_dup_lines", "n_lines", 3, 400),
)


def repeated_words(words: list[bytes]) -> int:
    """How many of the words stand in a window that the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    again = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(WINDOW):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def counts_of(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """COUNTS of one text."""
    words = text.split() if text else []  # of bytes: at the six ASCII blanks only
    if not words:
        return 0, 0, 0, 0, 0, 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = text.translate(None, BLANKS)
    return len(words), len(bare.decode()), len(bare) - len(bare.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and COUNTS for each row of ``docs``."""
    types = dict(docs.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts_of(x) for x in byte_values(batch.column(0))], dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, found.T)], [*keys, *(c.split()[0] for c in COUNTS.split(", "))])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), COUNTS])
    return docs.select(F.col(text).cast("string").alias("text"), *keys).mapInArrow(run, schema)


def value(rule: Rule) -> Column:
    """The rule's value in whole thousandths; null where nothing is counted."""
    return F.expr(f"(1000 * {rule.count}) div nullif({rule.of}, 0)")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketches(counted: DataFrame, by: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(by, rule, bucket, n): for each group and rule the histogram of its values."""
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), value(r).alias("value")) for r in rules]))
    rows = counted.select(*by, each.alias("x")).select(*by, "x.rule", "x.value").where("value is not null")
    shift = F.greatest(F.length(F.bin("value")) - BITS, F.lit(0)).cast("int")
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("value"), shift), shift)
    return rows.groupBy(*by, "rule", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def cutoffs(sketch: DataFrame, by: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(by, docs, and for each rule ``lo_*`` and ``hi_*``); a rule without a lower cutoff has null there."""
    group = Window.partitionBy(*by, "rule")
    ranked = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)})
    quartile = lambda k: F.min(F.when(F.col("upto") > F.expr(f"({k} * (docs - 1)) div 4"), F.col("bucket")))
    quartiles = ranked.groupBy(*by, "rule").agg(F.max("docs").alias("docs"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    out = [F.max("docs").alias("docs")]
    for r in rules:
        away = F.greatest(r.steps * (F.col("q3") - F.col("q1")), F.lit(r.least))
        mine = F.col("rule") == r.name
        out.append(F.max(F.when(mine & F.lit(r.lower), F.col("q1") - away)).alias(f"lo_{r.name}"))
        out.append(F.max(F.when(mine, F.col("q3") + away)).alias(f"hi_{r.name}"))
    return quartiles.groupBy(*by).agg(*out)


def adaptive_cutoffs(counted: DataFrame, by: list[str], rules: tuple[Rule, ...] = RULES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(by, docs, and the cutoffs) for each group of ``by``: its own, or of the first of its coarser groups that is large enough; ``docs`` is the number of documents behind them."""
    finest = cut(sketches(counted.withColumn("_all", F.lit(0)), ["_all", *by], rules))
    names = ["docs", *(f"{side}_{r.name}" for r in rules for side in ("lo", "hi"))]
    found = None
    for depth in range(len(by), -1, -1):
        keys = ["_all", *by[:depth]]
        own = cutoffs(finest if depth == len(by) else merged(finest, keys), keys, rules)
        if found is None:
            found = own.select(*keys, F.struct(*names).alias("own"))
            continue
        level = cut(own.select(*keys, F.struct(*names).alias("level")))
        enough = F.col("own.docs") >= least_docs
        found = attached(found, level, keys, salt="own").withColumn("own", F.when(enough, F.col("own")).otherwise(F.col("level"))).drop("level")
    return found.select(*by, "own.*")


def kept(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether counts and cutoffs of one row let it stay."""
    inside = ~base_failed()
    for r in rules:
        inside &= F.coalesce(value(r) <= F.col(f"hi_{r.name}"), F.lit(False))
        if r.lower:
            inside &= F.coalesce(value(r) >= F.col(f"lo_{r.name}"), F.lit(False))
    return inside


def verdicts(docs: DataFrame, key: str = "doc_id", by: tuple[str, ...] = ("lang", "source"), text: str = "text", rules: tuple[Rule, ...] = RULES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(key, by, COUNTS, base_failed, kept) for every row of ``docs``."""
    counted = cut(measured(docs, [key, *by], text))
    limits = cut(adaptive_cutoffs(counted, [*by], rules, least_docs))
    judged = attached(counted, limits, [*by], salt=key, how="left")
    return judged.select(*counted.columns, base_failed().alias("base_failed"), kept(rules).alias("kept"))


def kept_documents(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), text: str = "text", rules: tuple[Rule, ...] = RULES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns: counted once for the sketches and once more where the cutoffs are joined, so that texts are not shuffled."""
    limits = cut(adaptive_cutoffs(measured(docs, [*by], text), [*by], rules, least_docs))
    types = [c.split() for c in COUNTS.split(", ")]

    @F.arrow_udf(f"struct<{', '.join(f'{n}: {t}' for n, t in types)}>")
    def counts(texts: pa.Array) -> pa.Array:
        found = np.array([counts_of(x) for x in byte_values(texts)], dtype=np.int64).reshape(-1, len(types))
        return pa.StructArray.from_arrays(list(map(pa.array, found.T)), [n for n, _ in types])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[F.col(c).alias(f"_{c}") for c in by], counts(F.col(text).cast("string")).alias("_counts"))
    limits = limits.select(*[F.col(c).alias(f"_{c}") for c in by], F.struct(*[c for c in limits.columns if c not in by]).alias("_limits"))
    judged = attached(rows, limits, [f"_{c}" for c in by], salt="_counts").select("_row", "_counts.*", "_limits.*")
    return judged.where(kept(rules)).select("_row.*")
