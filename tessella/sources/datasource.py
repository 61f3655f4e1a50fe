"""The corpora as a data source of their own: ``spark.read.format("pair_corpus").load(root)``.

Each file of a corpus and split is an input partition; filters on ``corpus``
and ``split`` are pushed into the source and decide which files are opened.
Records are read one line after another and handed on in small batches, so a
reader that needs only the first rows stops there, and memory does not grow
with a file.  Paths with a scheme are read through Arrow's file systems.

Options: ``limit`` (records of each file), ``malformed`` (``skip``, the
default, or ``raise``).  Blank lines are no records; the columns are the
logical ones of every corpus.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from .registry import COIN, CORPORA, PRIMARY, SPLITS, Corpus, place

NAME = "pair_corpus"
SCHEMA = "corpus string, split string, id string, scenario_key string, theme string, domain string, category string, difficulty string, target string, retain string, timestamp timestamp"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def file_system(path: str) -> tuple[Any, str]:
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)  # Spark's paths are not percent-encoded


def moment(text: str | None) -> datetime | None:
    """A time as ISO text; without a zone it is UTC."""
    try:
        found = datetime.fromisoformat(text) if text else None
    except ValueError:
        return None
    return found.replace(tzinfo=timezone.utc) if found is not None and found.tzinfo is None else found


def logical(own: Corpus, split: str, record: dict) -> tuple:
    """A record in the columns of SCHEMA."""

    def pick(names: tuple[str, ...], default: str | None = None) -> str | None:
        found = next((v for n in names if (v := record.get(n)) is not None), default)
        return found if found is None or isinstance(found, str) else json.dumps(found, ensure_ascii=False)

    difficulty = pick((own.difficulty,), "all") if own.difficulty else "all"
    rest = [pick((c,)) for c in ("id", own.key, "theme", "domain")]
    return (own.name, split, *rest, pick(("category", "seed_topic"), "unknown"), difficulty, pick(own.target), pick(own.retain), moment(pick(("timestamp",))))


@dataclass
class CorpusFile(InputPartition):
    corpus: str
    split: str
    path: str

    def __post_init__(self) -> None:
        super().__init__((self.corpus, self.split))


@dataclass
class CorpusReader(DataSourceReader):
    root: str
    limit: int | None = None
    raises: bool = False
    wanted: dict[str, set[str]] = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of corpus and split; what it does not take goes back to Spark."""
        for one in filters:
            values = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if one.attribute not in (("corpus",), ("split",)):
                yield one
            elif values is not None:
                name = one.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not isinstance(one, IsNotNull):  # neither column is ever null
                yield one

    def partitions(self) -> list[CorpusFile]:
        """The files that are there, in the catalog's order."""
        asked = [
            CorpusFile(corpus, split, place(self.root, corpus, split))
            for corpus in (*PRIMARY, *COIN) for split in SPLITS
            if corpus in self.wanted.get("corpus", {corpus}) and split in self.wanted.get("split", {split})
        ]
        store, _ = file_system(self.root)
        return [f for f in asked if store.get_file_info(file_system(f.path)[1]).is_file]

    def read(self, partition: CorpusFile | None) -> Iterator[tuple]:
        if partition is None:  # no file was asked for
            return
        store, path = file_system(partition.path)
        own, given = CORPORA[partition.corpus], 0
        with store.open_input_stream(path) as raw:
            for line in lines_of(raw):
                if self.limit is not None and given >= self.limit:
                    return
                if not line.strip():
                    continue
                try:
                    record = json.loads(line)
                    if not isinstance(record, dict):
                        raise ValueError("a record is an object")
                except ValueError as wrong:
                    if self.raises:
                        raise ValueError(f"{partition.path}: {wrong}") from wrong
                    continue
                given += 1
                yield logical(own, partition.split, record)


def lines_of(raw: Any, chunk: int = 1 << 20) -> Iterator[str]:
    """The lines of a stream of UTF-8 bytes; a piece and the line that goes on are held."""
    rest = b""
    while piece := raw.read(chunk):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> CorpusReader:
        if not self.options.get("path"):
            raise ValueError("give the root folder of the corpora")
        limit, malformed = self.options.get("limit"), self.options.get("malformed", "skip")
        if malformed not in ("skip", "raise"):
            raise ValueError(f"malformed is skip or raise, not {malformed!r}")
        return CorpusReader(self.options["path"], None if limit is None else int(limit), malformed == "raise")


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let it take filters."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(CorpusSource)


def pairs(spark: SparkSession, root: str, **options: Any) -> DataFrame:
    """All corpora below ``root`` through the source."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(root)
