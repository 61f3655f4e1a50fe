"""The fitted language scores: frequent words by a broadcast, rare ones by a shuffle."""

import pytest

from tessella.plans import lookups

DOCS = "doc_id long, source string, lang string, text string"
ROWS = [
    (1, "web", "en", "the cat the dog"), (2, "web", "de", "der Hund\nder  Hund"), (3, None, "fr", "le chat le chien"), (4, "wiki", "es", "el perro"),
    (5, "wiki", None, "the hund"), (6, "wiki", "it", "il cane"), (7, "web", "en", ""), (8, "web", "en", None), (1, "web", "en", "the end"),
]


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame(ROWS, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def scores(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("limit", [0, 250, 600])
def test_rare_words_score_as_frequent_ones(spark, small, limit):
    found = scores(lookups.language_scores(spark, small, limit))
    assert found == scores(lookups.language_scores(spark, small)) and len(found) == 4 * 6  # texts without a word have no row, rows that repeat a document are one


def test_least_count(spark):
    counts = spark.createDataFrame([("a", 9), ("bb", 8), ("c", 7), ("d", 1)], "word string, n long")
    assert [lookups.least_count(counts, x) for x in (100, 203, 304, 405)] == [1 << 62, 8, 4, 1]


def test_only_words_are_stored(spark, sf, monkeypatch):
    """What is written between the steps has a row for each different word, not for each document's words."""
    paths = []
    monkeypatch.setattr(lookups, "scratch", lambda *a, make=lookups.scratch: paths.append(make(*a)) or paths[-1])
    lookups.language_choice(spark, sf)
    stored = [spark.read.parquet(p) for p in paths]
    assert [x.count() for x in stored] == [x.select("word").distinct().count() for x in stored]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert lookups.language_choice(spark, str(tmp_path)).collect() == []
