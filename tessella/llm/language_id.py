"""Language identification by hierarchical discrimination.

A document is first assigned to a language family, then one-versus-one linear
support vector machines separate the languages inside that family.  Both
levels use the same features: counts of byte trigrams of the lower-cased text
(everything that is not part of a letter counts as one blank), hashed into
``FEATURES`` cells and divided by their number.

Training reads at most ``per_language`` labelled rows of each language (picked
by a hash of the id, so the same rows at every run); Spark ML fits the
machines.  Prediction is one pass over whole texts with the fitted weights,
``FEATURES`` x machines numbers.

``accepted`` rejects texts that the machines do not place: a text of at least
``EVIDENCE`` trigrams whose margin is below ``SLACK`` of the least margin that
the correctly predicted rows of that size in the labelled sample have, so
writing unlike all learned languages goes and shorter texts stay.

Defined cases: a null text or one without any letter gets ``und`` with score 0;
so does every text when no labelled row exists (``accepted`` then keeps what
has a letter).  Rows labelled null or ``und`` teach nothing, nor do those
without a letter, and of more than ``MOST_LANGUAGES`` labels the most frequent
are learned.  One known language is predicted for all other texts with score
1.  Ties go to the name that sorts first.  Repeated rows are predicted alike;
other columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices

FEATURES = 1 << 14
#: At most so many labelled rows of each language are read in training.
PER_LANGUAGE = 1000
#: At most so many labels are learned.
MOST_LANGUAGES = 256
#: When a margin is too low: texts of fewer trigrams are not judged by it; see ``accepted``.
EVIDENCE, SLACK = 200, 0.25
UNDETERMINED = "und"

# Families of ISO 639-1 codes; a code not listed is its own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("am", "ar", "he", "mt"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: Bytes below 0x80 that are no letters become blanks; all others stay.
BLANKED = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
ASCII_LETTER = re.compile(r"[A-Za-z]")
BLANKS = 0x202020


def has_letter(text: str | None) -> bool:
    return text is not None and (ASCII_LETTER.search(text) is not None or (not text.isascii() and any(c.isalpha() for c in text)))


def cells(data: bytes) -> np.ndarray:
    """The hashed cell of every byte trigram; all-blank ones get the spare cell ``FEATURES``."""
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) < 3:
        return np.empty(0, dtype=np.uint32)
    code = b[:-2].astype(np.uint32)
    code <<= 8
    code |= b[1:-1]
    code <<= 8
    code |= b[2:]
    blank = code == BLANKS
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - FEATURES.bit_length() + 1)
    code[blank] = FEATURES
    return code


def normal(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(BLANKED) + b" "


def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, features, text): the training features as sparse vectors, a struct of Spark ML's layout."""
    sparse = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    for batch in batches:
        langs, found, texts = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if has_letter(text):
                counts = np.bincount(cells(normal(text)), minlength=FEATURES + 1)[:FEATURES]
                at = np.flatnonzero(counts)
                langs.append(lang)
                found.append({"type": 0, "size": FEATURES, "indices": at.astype(np.int32), "values": 1000.0 * counts[at] / max(1, counts.sum())})
                texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, sparse), pa.array(texts, pa.string())], ["lang", "features", "text"])


VECTORS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("features", VectorUDT()), T.StructField("text", T.StringType())])


@dataclass
class Model:
    """Languages by family, and one machine for each pair of families and of languages in a family."""

    families: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES + 1), dtype=np.float32))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0))
    least: float = 0.0  # a margin below it places no text of enough evidence

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Machines x texts: the signed distance; positive speaks for the first of the pair."""
        found = np.empty((len(self.pairs), len(texts)))
        for k, data in enumerate(texts):
            at = cells(data)
            n = max(1, len(at) - int(np.count_nonzero(at == FEATURES)))
            for m, row in enumerate(self.weights):
                found[m, k] = row[at].sum(dtype=np.float64) * 1000.0 / n + self.offsets[m]
        return found

    def decide(self, names: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """One-versus-one votes; ties by the sum of margins, then by name. The second value: the winner's least margin."""
        votes, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            m = margin[a, b]
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = min(names, key=lambda x: (-votes[x], -sums[x], x))
        return best, min((m if best == a else -m for (a, b), m in margin.items() if best in (a, b) and a in votes and b in votes), default=np.inf)

    def place(self, margin: np.ndarray) -> tuple[str, float]:
        """The language, and the least margin that the decision rests on."""
        by = dict(zip(self.pairs, margin, strict=True))
        family, sure = self.decide(sorted(self.families), by)
        lang, within = self.decide(self.families[family], by)
        return lang, min(sure, within)

    def of_texts(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, margin, trigrams) of each text."""
        found = [(UNDETERMINED, -np.inf, 0)] * len(texts)
        able = [k for k, t in enumerate(texts) if self.families and has_letter(t)]
        forms = [normal(texts[k]) for k in able]
        for k, form, m in zip(able, forms, self.margins(forms).T, strict=True):
            found[k] = (*self.place(m), len(form))
        return found


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, iterations: int = 12) -> Model:
    """Fit on at most ``per_language`` rows of each language of ``labelled`` (doc_id, text, lang)."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNDETERMINED))
    frequent = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    if not counts:
        return Model()
    # a hash below its language's share is kept, so only a bounded sample is ever sorted
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 1.3 * per_language / n)))])
    order = F.xxhash64("doc_id")
    picked = (
        known.where(F.pmod(order, F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text"))))
        .where(F.col("_rank") <= per_language)
    )
    vectors = cut(picked.select("lang", "text").mapInArrow(to_vectors, VECTORS).coalesce(8))  # a bounded sample, read again and again
    families: dict[str, list[str]] = {}
    for lang in sorted(r["lang"] for r in vectors.select("lang").distinct().collect()):
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    pairs = list(combinations(sorted(families), 2)) + [p for name in sorted(families) for p in combinations(families[name], 2)]
    weights, offsets = np.zeros((len(pairs), FEATURES + 1), dtype=np.float32), np.zeros(len(pairs))
    for k, (a, b) in enumerate(pairs):
        first, second = (families[a], families[b]) if a in families and b in families and k < len(families) * (len(families) - 1) // 2 else ([a], [b])
        rows = vectors.where(F.col("lang").isin(first + second)).select("features", F.col("lang").isin(first).cast("double").alias("label"))
        fitted = LinearSVC(maxIter=iterations, regParam=0.01, standardization=True).fit(rows)
        weights[k, :FEATURES] = fitted.coefficients.toArray()
        offsets[k] = fitted.intercept
    model = Model(families, pairs, weights, offsets)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = zip(batch.column(0).to_pylist(), model.of_texts(batch.column(1).to_pylist()), strict=True)
            margins = [m for lang, (found, m, n) in placed if found == lang and n >= EVIDENCE and np.isfinite(m)]
            yield pa.RecordBatch.from_arrays([pa.array(margins, pa.float64())], ["margin"])

    least = vectors.select("lang", "text").mapInArrow(right, "margin double").agg(F.min("margin")).first()[0]
    model.least = SLACK * least if least is not None and least > 0 else 0.0
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    names = [*docs.columns, "lang_pred", "score"]
    at, schema = docs.columns.index(text), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model.of_texts(batch.column(at).to_pylist())
            # the logistic of the margin; without a rival, certain
            scores = [0.0 if m == -np.inf else 1.0 if m == np.inf else float(1 / (1 + np.exp(-2 * max(min(m, 30.0), -30.0)))) for _, m, _ in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array(scores, pa.float64())], names)

    return docs.mapInArrow(predict, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model places in a language; the others are rejected. Columns, whatever their names, stay as they are."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            if model.families:
                kept = [lang != UNDETERMINED and (n < EVIDENCE or m >= model.least) for lang, m, n in model.of_texts(texts)]
            else:
                kept = [has_letter(t) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
