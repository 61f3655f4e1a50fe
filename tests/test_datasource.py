"""The corpora as a data source: pushed filters, files as partitions, a limit that stops reading."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import datasource, scans
from tessella.sources.registry import place


@pytest.fixture
def root(tmp_path):
    def put(corpus, split, rows):
        path = tmp_path / place(str(tmp_path), corpus, split)[len(str(tmp_path)) + 1 :]
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")

    put("tom_cc", "train", [{"id": str(k), "scenario_id": f"s{k}", "category": "c", "difficulty": "d", "target": f"größe {k}", "retain": "r", "timestamp": "2024-05-06T07:08:09+02:00"} for k in range(500)])
    put("tom_cc", "holdout", [{"id": "h", "target": "x", "retain": None, "timestamp": "no time"}, "", "   ", "{broken", "[1]"])
    put("ctr_cc", "train", [{"id": "1", "target_text": "t", "target": "old", "retain": "r", "domain": "dom", "extra": {"deep": 1}}])
    put("legal", "train", [{"id": "9", "scenario_id": "k", "theme": "th", "target": "t", "retain": "r"}])
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_those_of_the_scan(spark, root):
    rows = datasource.pairs(spark, root)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 503
    for corpus, split in (("tom_cc", "train"), ("tom_cc", "holdout"), ("ctr_cc", "train"), ("legal", "train")):
        mine = rows.where((F.col("corpus") == corpus) & (F.col("split") == split))
        theirs = scans.corpus(spark, root, corpus, split)
        assert sorted(map(tuple, mine.select(theirs.columns).collect()), key=str) == sorted(map(tuple, theirs.collect()), key=str)


def test_filters_choose_the_files(spark, root):
    rows = datasource.pairs(spark, root, malformed="raise")
    one = rows.where("corpus = 'tom_cc' and split = 'train' and id = '7'")
    assert one.rdd.getNumPartitions() == 1 and [r["target"] for r in one.collect()] == ["größe 7"]  # the broken file is not opened
    assert "corpus" not in plan(one).split("Filter")[1].split("\n")[0] and "id#" in plan(one).split("Filter")[1].split("\n")[0]
    assert rows.where("corpus in ('ctr_cc', 'legal')").rdd.getNumPartitions() == 2
    assert rows.where("corpus = 'legal' and corpus = 'tom_cc'").count() == 0
    assert rows.where("corpus = 'no such'").count() == 0
    with pytest.raises(Exception, match="jsonl"):
        rows.where("split = 'holdout'").collect()


def test_a_limit_opens_one_file(spark, root):
    rows = datasource.pairs(spark, root, malformed="raise")  # reading the second file would raise
    assert len(rows.limit(10).collect()) == 10
    assert datasource.pairs(spark, root, limit=2).where("corpus = 'tom_cc'").count() == 3


def test_reading_stops(root):
    """Only the first megabyte of a long file is read for its first rows."""
    class Stream:
        asked = 0

        def read(self, n):
            self.asked += 1
            return b'{"id": "1"}\n' * (n // 12) if self.asked < 100 else b""

    stream = Stream()
    lines = datasource.lines_of(stream)
    assert next(lines) == '{"id": "1"}' and stream.asked == 1
    assert list(datasource.lines_of(type("S", (), {"read": lambda self, n, parts=iter([b"a\xc3", b"\xa4\nb", b"\n", b"c", b""]): next(parts)})())) == ["aä", "b", "c"]


def test_wrong_options(spark, root):
    with pytest.raises(Exception, match="skip or raise"):
        datasource.pairs(spark, root, malformed="maybe").collect()
