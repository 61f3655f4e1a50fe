"""Main text of web pages by site template removal.

Every page is read into a tree and each subtree hashed, in two ways: with its
text, and by its shape alone (names, classes, roles; runs of equal children
count once, so a menu of five links is that of six).  Spark counts, per host,
on how many pages of different content a subtree occurs.  One that recurs on
``threshold`` pages (0.3 of the host's, but 3 at least and 20 at most) is the
site's template and is deleted; what is left is the page's text.

The counts decide.  What an element is called only says which counts apply to
it: the shape counts for boxes that are mostly links or are named as
boilerplate (navigation, footers, forms, adverts, comments, by name, role or
class), whose words may change from page to page; and a box so named also goes
where boxes named alike are on ``LEAST_PAGES`` pages of any hosts.  Running
text of the main part (paragraphs, headings, list items inside ``main`` or
``article``) is never taken for template, so an article that a site repeats
stays whole.  Hosts of fewer than ``LEAST_PAGES`` different pages have no
counts to go by: there, and only there, names decide alone, and ``main`` or
``article`` is the main part.

A task sends at most ``COUNTED`` pages for each subtree, enough to tell any
threshold, and the rest is counted by (host, subtree), so a host of very many
pages is no hot key.  The recurring subtrees are broadcast where their
measured size allows, else each page's own subtrees are joined with them.

Defined cases: a null page is empty and has empty text; a null or broken url
belongs to the host ''; repeated rows get equal texts and count once; very
deep or unclosed markup is read as far as it goes, without recursion.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html_tree as tree
from .common import BROADCAST_LIMIT, cut

LEAST_PAGES, MOST_PAGES, SHARE = 3, 20, 0.3
#: Pages that tell any threshold: with more, it is ``MOST_PAGES``.
COUNTED = int(MOST_PAGES / SHARE) + 1
HELD = 400_000
PAGE = b"page"  # stands for the pages of a host among its subtrees


def threshold(n_pages: Column) -> Column:
    """On how many of a host's pages a subtree must recur."""
    return F.greatest(F.lit(LEAST_PAGES), F.least(F.lit(MOST_PAGES), F.ceil(F.lit(SHARE) * n_pages)))


def key(host: str, kind: bytes, digest: int = 0) -> int:
    """A subtree of a host, as a signed long."""
    h = xxhash.xxh64_intdigest(b"%s|%d|%s" % (kind, digest, host.encode("utf-8", "replace")))
    return h - (1 << 64) if h >> 63 else h


def subtrees(host: str, root: tree.Element) -> Iterator[tuple[tree.Element, list[tuple[int, int]]]]:
    """The candidates of a page, each with the (host, subtree) keys by which it is counted; host 0 stands for all hosts."""
    own = key(host, PAGE)
    for element, named, links in tree.candidates(root):
        keys = [(own, key(host, b"text", element.digest))]
        if named or links:
            keys.append((own, key(host, b"shape", element.shape)))
        if named:
            keys.append((0, key("", b"kind", xxhash.xxh64_intdigest(element.kind()))))
        yield element, keys


def read(page: str | None) -> tree.Element:
    root = tree.parse(page or "")
    tree.hash_subtrees(root)
    return root


def marked(element: tree.Element) -> bool:
    """What no reader sees, on any page."""
    return element.hidden or element.name == "head"


def text_of(host: str, page: str | None, recurring: Callable[[list[int]], set[int]]) -> str:
    """The main text of a page; ``recurring`` tells which of some keys recur."""
    root = read(page)
    found = list(subtrees(host, root))
    own = key(host, PAGE)
    known = recurring([own, *(k for _, keys in found for _, k in keys)])
    if own in known:
        dropped = {id(e) for e, keys in found if any(k in known for _, k in keys)}
        return "\n".join(tree.blocks([root], dropped, marked))
    parts = tree.main_parts(root)
    return "\n".join(tree.blocks(parts, set(), lambda e: tree.ruled_out(e, parts != [root])))


def among(known: np.ndarray) -> Callable[[list[int]], set[int]]:
    """Which keys are in a sorted array."""

    def recurring(keys: list[int]) -> set[int]:
        asked = np.array(keys, dtype=np.int64)
        at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
        return set(asked[known[at] == asked].tolist()) if len(known) else set()

    return recurring


def page_key(host: str, page: str | None) -> int:
    """The page's content on its host, as a non-negative long."""
    return xxhash.xxh64_intdigest((page or "").encode("utf-8", "replace"), key(host, PAGE) & 0xFFFFFFFF) >> 1


def keys_of(host: str, page: str | None) -> set[tuple[int, int]]:
    """All keys that a page is counted by, that of its host's pages included."""
    own = key(host, PAGE)
    return {(own, own)} | {k for _, keys in subtrees(host, read(page)) for k in keys}


def templates(pages: DataFrame) -> DataFrame:
    """(subtree long): the keys of the subtrees that recur, over (host, html); for each host that has counts also that of its pages."""

    def rows(pages_of: dict) -> pa.RecordBatch:
        flat = [(*k, page) for k, found in pages_of.items() for page in sorted(found)[:COUNTED]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["host", "subtree", "page"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages_of: dict[tuple[int, int], set[int]] = defaultdict(set)
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = page_key(host, page)
                for k in keys_of(host, page):
                    found = pages_of[k]
                    found.add(own)
                    if len(found) > 4 * COUNTED:  # the least hashes are those that all tasks keep
                        pages_of[k] = set(sorted(found)[:COUNTED])
                if len(pages_of) > HELD:
                    yield rows(pages_of)
                    pages_of = defaultdict(set)
        if pages_of:
            yield rows(pages_of)

    counts = pages.select("host", "html").mapInArrow(run, "host long, subtree long, page long").groupBy("host", "subtree").agg(F.count_distinct("page").alias("n"))
    often = cut(counts.where(F.col("n") >= LEAST_PAGES))
    of_host = often.where("host = subtree").select("host", F.col("n").alias("n_pages"))
    own = often.where("host <> 0").join(of_host, "host").where((F.col("subtree") == F.col("host")) | (F.col("n") >= threshold(F.col("n_pages"))))
    return cut(own.select("subtree").unionByName(often.where("host = 0").select("subtree")).distinct())


def extract(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``. Up to ``limit`` bytes of recurring subtrees are broadcast."""
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    pages = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    found = templates(pages)
    wide = 8 * found.count() > limit
    known = pages.sparkSession.sparkContext.broadcast(np.empty(0, dtype=np.int64) if wide else np.sort(found.toArrow().column(0).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_all = among(known.value)
        for batch in batches:
            tests = [set(own or ()).intersection for own in batch.column(4).to_pylist()] if wide else [of_all] * batch.num_rows
            texts = [text_of(h, page, test) for h, page, test in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), tests, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = "page_id long, url string, text string, n_chars long"
    if not wide:
        return pages.mapInArrow(run, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = [k for _, k in keys_of(h, page)]
                yield pa.RecordBatch.from_arrays([pa.array([page_key(h, page)] * len(keys), pa.int64()), pa.array(keys, pa.int64())], ["page", "subtree"])

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [page_key(h, page) for h, page in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "page"])

    # each different page's recurring subtrees, a short list, by the page's content
    lists = pages.select("host", "html").mapInArrow(listed, "page long, subtree long").distinct().join(found, "subtree").groupBy("page").agg(F.collect_set("subtree").alias("own"))
    keyed = pages.mapInArrow(with_key, f"page_id {dict(pages.dtypes)['page_id']}, url string, html string, host string, page long")
    return keyed.join(lists, "page", "left").select("page_id", "url", "html", "host", "own").mapInArrow(run, schema)
