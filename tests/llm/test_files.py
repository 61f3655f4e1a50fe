"""Archives, token files, pages and language-model scores."""

import gzip
import hashlib
import html.parser
import math
import zlib
from collections import Counter
from itertools import product
from types import SimpleNamespace
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import html_extraction, lm_scoring, queries, range_coder, sharded_files, token_files, tokens, warc
from tessella.llm.common import fresh_path

PAGES = "page_id long, url string, html string, shard string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "own") for i, u, h in rows], PAGES)


def test_warc_round_trip(spark, monkeypatch):
    long, short = "<p>" + "repeated page " * 20, "<p>short"
    rows = [(9, "http://a/9", long), (3, "http://a/3", long), (5, None, long), (4, "http://a b/\n4", short), (6, "u", short), (7, "u", None), (8, "u", ""), (None, "n", long), (None, "n", "unique " * 50), (11, "t", "twin " * 40), (11, "t", "twin " * 40), (2, "big", "zé" * 300_000)]
    uri = fresh_path(spark, "warc-test")
    manifest = warc.write(pages(spark, rows), uri)
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, uri).collect()), key=repr)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        own = [j for j, _, x in rows if (x or "").encode() == data and j is not None]
        first = min(own) if own else None
        revisit = len(data) >= 100 and first is not None and i != first
        want.append((i is None, i or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    twin = [k for k, w in enumerate(want) if w[1] == 11][1]
    want[twin] = (*want[twin][:4], "revisit", 11)
    assert got == sorted(want, key=repr)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    fs, root = sharded_files.store(uri)
    for r in manifest.collect():
        with fs.open_input_stream(f"{root}/{r['name']}", compression=None) as f:
            data = f.read()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and gzip.decompress(data).count(b"WARC/1.1\r\n") == r["n_records"] + 1
    texts = {r["page_id"]: r["payload"] for r in warc.read(spark, uri, payloads=True).where("record_type = 'response'").collect()}
    assert texts[2] == ("zé" * 300_000).encode() and texts[3] == long.encode()


def test_warc_files_are_deterministic_and_roll(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), f"http://h/{i}", "".join(map(chr, rng.integers(97, 123, 400)))) for i in rng.permutation(300)]
    monkeypatch.setattr(sharded_files, "LEAST_SHARDS", 3)
    monkeypatch.setattr(warc, "FILE_BYTES", 8_000)
    seen = []
    for parts in (1, 7):
        uri = fresh_path(spark, "warc-roll")
        seen.append(sorted((r["name"], r["n_bytes"], r["sha256"], r["n_records"]) for r in warc.write(pages(spark, rows).repartition(parts), uri).collect()))
    assert seen[0] == seen[1] and len({n.split("-")[1] for n, *_ in seen[0]}) == 3


def test_warc_of_nothing(spark):
    uri = fresh_path(spark, "warc-none")
    assert warc.write(pages(spark, []), uri).count() == 0 and warc.read(spark, uri).count() == 0


def test_warc_query_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(con.execute(f"select {', '.join(names)} from ({queries.ORACLES['op6_warc_writer']})").fetchall(), key=repr) == sorted((tuple(r[n] for n in names) for r in queries.op6_warc_writer(spark, sf).collect()), key=repr)


@pytest.mark.parametrize("ids", [[5], [0] * 9000, list(range(5000)), [7, 7, 9] * 3000, [4_000_000, 3]])
def test_range_coder_round_trip(ids):
    ids = np.array(ids, dtype="<u4")
    assert (range_coder.decode_segment(range_coder.encode_segment(ids)) == ids).all()


def test_range_coder_random_and_skewed():
    rng = np.random.default_rng(0)
    for n, top in ((1, 3), (2048, 2), (2049, 50_000), (30_000, 59_000), (20_000, 12)):
        for ids in (rng.integers(0, top, n), np.minimum(rng.geometric(0.3, n), top)):
            ids = ids.astype("<u4")
            data = range_coder.encode_segment(ids)
            assert (range_coder.decode_segment(data) == ids).all()
    damaged = bytearray(data)
    damaged[-3] ^= 1
    with pytest.raises((OSError, ValueError, IndexError)):
        assert (range_coder.decode_segment(bytes(damaged)) == ids).all()
        raise OSError("the last words may be padding")


def test_range_coder_learns():
    ids = np.array(list(range(500)) * 8, dtype="<u4")
    assert len(range_coder.encode_segment(ids)) < len(range_coder.encode_segment(np.random.default_rng(0).permutation(ids)))


def test_range_coder_predicts_from_contexts():
    """Ids drawn evenly, each followed by one of four: order 0 needs 8 bits an id, the contexts 2."""
    rng, ids = np.random.default_rng(3), np.zeros(200_000, dtype="<u4")
    following = rng.permutation(256).repeat(4).reshape(256, 4)[:, rng.permutation(4)] + np.arange(4) * 64
    picks = rng.integers(0, 4, len(ids))
    for k in range(1, len(ids)):
        ids[k] = following[ids[k - 1], picks[k]] % 256
    p = np.bincount(ids) / len(ids)
    order0 = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert 8 * len(range_coder.encode_segment(ids)) / len(ids) < 0.5 * order0


def test_range_coder_blocks_stand_alone():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.01, 5000), 900).astype("<u4")
    alone = range_coder.encode_segment(ids[2500:])
    range_coder.encode_segment(ids[:2500])  # leaves nothing behind
    assert range_coder.encode_segment(ids[2500:]) == alone and (range_coder.decode_segment(alone) == ids[2500:]).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("chars, kept", [(1, 5), (60, 1000), (1 << 20, 1000)])
def test_texts_encoded_together(monkeypatch, name, chars, kept):
    """The ids are those of the library, whatever texts are encoded with."""
    monkeypatch.setattr(tokens, "GROUP_CHARS", chars)
    monkeypatch.setattr(tokens, "GROUP_TEXTS", 3)
    encoder = tokens.Encoder(queries.vocabulary(name), kept)
    texts = ["Word word. WORD, word", None, "", " a  b\n", "x<|endoftext|>y", "x<|ENDOFTEXT|>Y", "tab\tWord", "É é. DON'T don't. it's", "a) a). (a", "...!? . word..", "İ K ſ Σ", "A\u0300 q\u1dc4", "w" * 60 + ".", "中文。12 3.5"]
    want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(encoder.encoded(texts)) == want == list(encoder.encoded(iter(texts)))


def test_words_go_to_the_model_once():
    encoder, seen = tokens.Encoder(queries.vocabulary("word_bpe_49k.json")), []
    model = encoder.model
    encoder.model = SimpleNamespace(tokenize=lambda word: seen.append(word) or model.tokenize(word))
    list(encoder.encoded(["Word word. WORD, word", "word; other\nOther!"]))
    assert sorted(seen) == ["other", "word"]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(sharded_files, "LEAST_SHARDS", 3)
    monkeypatch.setattr(range_coder, "LANES", 2)
    monkeypatch.setattr(range_coder, "BLOCK", 64)
    texts = [(30, "a b c"), (10, None), (20, ""), (40, "Word " * 900), (None, "no id"), (50, "Été  d'été"), (50, "other text"), (60, "z"), (70, "some <|endoftext|> more<|startoftext|>")] + [(100 + i, f"document {i} " * 9) for i in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, start int")
    path = queries.vocabulary("word_bpe_49k.json")
    uri = fresh_path(spark, "ids")
    token_files.write(df, uri, path, 1)
    got = token_files.read(spark, uri).collect()
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(path), 0
    for (i, t), r in zip(sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), sorted(got, key=lambda r: r["start"]), strict=True):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    none = fresh_path(spark, "ids")
    token_files.write(df.limit(0), none, path, 1)
    assert token_files.read(spark, none).count() == 0


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><aside>side</aside>
<article><h1>Head &amp; line</h1><p>One  two<br>three<p><b>bold</b> &lt;x&gt;&nbsp;y <!-- gone <p> --> end</p><form><input>form</form><ul><li>first<li>second</ul>
<div class="ad">buy</div><section id="comments"><p>reader says</p></section><table><tr><td>cell<td>next</table><script>x</script>tail</article><footer>&copy; foot</footer></body></html>"""


def text_of(page):
    return html_extraction.text_of("a.example", page, lambda keys: set())


def test_main_text():
    assert text_of(HTML) == "Head & line\nOne two three\nbold <x> y end\nfirst\nsecond\ncell\nnext\ntail"
    assert text_of(None) == text_of("") == text_of("<nav>only</nav>") == ""
    assert text_of("just text &eacute;") == "just text é"
    assert text_of("<div>" * 3000 + "deep") == "deep"
    assert text_of("<p>a < b and <3<p>c") == "a < b and <3\nc"
    assert text_of("<p>open <b") == "open <b"


def test_site_templates(spark):
    def page(i, body):
        return f"<html><body><div><p>Welcome to our site</p><p>menu {i}</p></div><div>{body}</div><div><p>All rights reserved</p></div></body></html>"

    rows = [(i, f"http://site.example/{i}", page(i, f"<p>story number {i} is unlike the others</p>")) for i in range(30)]
    rows += [(100 + i, f"http://other.example/{i}", page(i, f"<p>only here {i}</p>")) for i in range(2)] + [(200, None, None), (201, "http://bad url", "<p>x</p>"), (202, "http://site.example/202", "<article><p>Welcome to our site</p></article>")]
    # a menu and a notice whose words change, links beside the article, and readers' comments in it
    story = "<nav class='m'>{0}<a>to {1}</a></nav><div id='notice-{1}'>read {1} first</div><ul>{0}</ul><article><h2>Title {1}</h2><p>The same story</p><div>Share this story with a friend</div><p>goes on and on and on for long</p><div class='comment'><p>by {1}</p></div></article>"
    rows += [(300 + i, f"http://copies.example/{i}", story.format("".join(f"<li><a>page {i + k}</a></li>" for k in range(1 + i % 4)), i)) for i in range(20)]
    rows += [(400 + i, "http://same.example/", "<div>one page, often stored</div>") for i in range(20)]
    for limit in (64 << 20, -1):
        got = {r["page_id"]: r for r in html_extraction.extract(pages(spark, rows), limit=limit).collect()}
        assert len(got) == len(rows)
        assert got[4]["text"] == "menu 4\nstory number 4 is unlike the others" and got[4]["n_chars"] == len(got[4]["text"])
        assert got[101]["text"] == "Welcome to our site\nmenu 1\nonly here 1\nAll rights reserved"
        assert (got[200]["text"], got[200]["n_chars"]) == ("", 0) and got[201]["text"] == "x"
        assert got[202]["text"] == "Welcome to our site"
        assert got[305]["text"] == "Title 5\nThe same story\ngoes on and on and on for long"
        assert got[405]["text"] == "one page, often stored"
    assert html_extraction.extract(pages(spark, [])).count() == 0


def brute_templates(rows):
    """The recurring keys of (host, html), counted in plain sets."""
    pages_of, hosts = {}, {}
    for host, page in rows:
        own = html_extraction.key(host, html_extraction.PAGE)
        for k in html_extraction.keys_of(host, page):
            pages_of.setdefault(k, set()).add((host, page or ""))
        hosts.setdefault(own, set()).add(page or "")
    out = set()
    for (host, subtree), found in pages_of.items():
        least = 3 if host == 0 or host == subtree else max(3, min(20, math.ceil(0.3 * len(hosts[host]))))
        out |= {subtree} if len(found) >= least else set()
    return out


class Article(html.parser.HTMLParser):
    """The blocks of the article, read by the standard library."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.out = False, [""]
        self.feed(page)

    def handle_starttag(self, tag, attributes):
        self.inside = self.inside or tag == "article"
        self.out += [""] if tag in ("h1", "p", "article") else []
        self.out[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.out += [""] if tag in ("h1", "p", "article") else []

    def handle_data(self, data):
        self.out[-1] += data if self.inside else ""

    def text(self):
        return "\n".join(" ".join(x.split()) for x in self.out if x.split())


def test_pages_query(spark, sf):
    """Against a brute-force count and another reader; without the counts menus and footers stay."""
    table = spark.read.parquet(f"{sf}/pages.parquet")
    pages = [(r["page_id"], (urlsplit(r["url"]).hostname or "").lower(), r["html"]) for r in table.collect()]
    known = brute_templates([(h, p) for _, h, p in pages])
    hosts = table.selectExpr("coalesce(lower(try_parse_url(url, 'HOST')), '') as host", "html")
    assert {r["subtree"] for r in html_extraction.templates(hosts).collect()} == known
    got = {r["page_id"]: r for r in queries.op8_site_templates(spark, sf).collect()}
    assert sorted(got) == sorted(i for i, _, _ in pages)
    changed = 0
    for page_id, host, page in pages:
        assert got[page_id]["text"] == Article(page).text() == html_extraction.text_of(host, page, known.intersection)
        assert got[page_id]["n_chars"] == len(got[page_id]["text"]) > 0
        own = html_extraction.key(host, html_extraction.PAGE)
        if own in known:
            without = html_extraction.text_of(host, page, {own}.intersection)
            assert without.startswith(page.split("<li>")[1].split("</a>")[0].split(">")[1]) and "©" in without
            changed += 1
    assert changed > len(pages) // 4


def test_lattice_against_all_segmentations():
    pieces = [(b"a", 3.0), (b"b", 2.0), (b"ab", 1.5), (b"aba", 0.5), (b"ba", 1.0)]
    lattice, total = lm_scoring.Lattice(pieces), 8.0
    p = {d: w / total for d, w in pieces}
    for word in (b"a", b"ab", b"abab", b"ababab", b"bbaab"):
        mass, uses = 0.0, Counter()
        for cuts in product([0, 1], repeat=len(word) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
            parts = [word[i:j] for i, j in zip(at, at[1:])]
            if all(x in p for x in parts):
                m = math.prod(p[x] for x in parts)
                mass += m
                for x in parts:
                    uses[x] += m
        assert lattice.forward(word) == pytest.approx(math.log(mass), rel=1e-12)
        expected = np.zeros(len(pieces))
        lattice.expect(word, 2.0, expected)
        assert expected.tolist() == pytest.approx([2 * uses[d] / mass for d, _ in pieces])


def test_scores_against_brute_force(spark, monkeypatch):
    texts = [(i, f"the cat number{i % 3} sat The  {'x' * (i % 5)}É你") for i in range(40)] + [(90, None), (91, ""), (92, "q" * 4000), (93, "the cat")]
    df = spark.createDataFrame([(i, t, "own") for i, t in texts], "doc_id long, text string, score string")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    for heavy in (3, 500_000):  # most words joined, or all broadcast
        monkeypatch.setattr(lm_scoring, "HEAVY", heavy)
        got = {r["doc_id"]: r for r in lm_scoring.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, queries.vocabulary("piece_bpe_32k.model")).collect()}
        counts = Counter(w for i, t in texts if not held[i] for w in [*(t or "").encode().lower().split(), b"\n"])
        n, v = sum(counts.values()), len(counts)
        for i, t in texts:
            words = [*(t or "").encode().lower().split(), b"\n"]
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
            assert -1e6 < r["score"] < 0
        if heavy == 3:
            first = {i: r["score"] for i, r in got.items()}
    assert {i: r["score"] for i, r in got.items()} == pytest.approx(first)
    assert got[92]["score"] < got[0]["score"]


def test_scores_without_training_documents(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    row = lm_scoring.score(df, F.lit(True), queries.vocabulary("piece_bpe_32k.model")).first()
    assert (row["train_tokens"], row["n_known"], row["base_score"]) == (0, 0, 0.0) and row["score"] < 0
    assert lm_scoring.score(df.limit(0), F.lit(True), queries.vocabulary("piece_bpe_32k.model")).count() == 0


def test_bounds_do_not_grow_the_plan(spark):
    """A hundred thousand bounds are searched as one broadcast array; the bounds of the writers are quantiles by bytes."""
    from tessella.llm import sharded_files as files

    cuts = np.arange(10, 1_000_010, 10)
    rows = spark.createDataFrame([(None,), (0,), (9,), (10,), (11,), (555_555,), (999_999,), (1_000_000,), (5_000_000,)], "k long")
    few, many = (files.dealt(rows, "k", c) for c in (cuts[:3], cuts))
    length = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(length(few) - length(many)) < 200
    given = spark.sparkContext.broadcast(cuts)
    found = {r["k"]: r["s"] for r in rows.select("k", files.shard_of(F.col("k"), given).alias("s")).collect()}
    assert found == {k: 0 if k is None else int((cuts <= k).sum()) for k in found}
    ids = spark.range(5000).select((F.col("id") * 7 - 900).alias("k"), (1000 + F.col("id") % 13 * 100).alias("n_bytes"))
    at = files.bounds(ids, "k")
    sizes = np.bincount(np.searchsorted(at, [r["k"] for r in ids.collect()], side="right"), weights=[r["n_bytes"] + files.ROW_BYTES for r in ids.collect()])
    assert len(at) == files.LEAST_SHARDS - 1 and sizes.max() < 1.02 * sizes.mean()
    assert list(files.bounds(ids.repartition(7), "k")) == list(at)
    assert len(files.bounds(ids.limit(0), "k")) == 0 and len(files.bounds(spark.createDataFrame([(None, 5)], "k long, n_bytes long"), "k")) == 0


def test_one_payload_in_half_of_all_pages(spark, tmp_path, monkeypatch):
    """Copies of one payload are not sent to one task: their first page comes by a broadcast."""
    from tessella import joins

    html = "<p>the same page again and again, and then some more of it to be long enough</p>" * 3
    pages = spark.createDataFrame([(k, f"u{k}", html if k % 2 else f"{html}{k}") for k in range(4000)], "page_id long, url string, html string")
    broadcast = []
    real = joins.F.broadcast
    monkeypatch.setattr(joins.F, "broadcast", lambda df: broadcast.append(df) or real(df))
    uri = f"file://{tmp_path}/hot"
    warc.write(pages, uri)
    monkeypatch.undo()
    assert [df.count() for df in broadcast if "_first" in df.columns] == [1]
    kinds = warc.read(spark, uri).groupBy("record_type").agg(F.count("*").alias("n"), F.min("refers_to").alias("least"), F.max("refers_to").alias("most")).collect()
    assert {r["record_type"]: (r["n"], r["least"], r["most"]) for r in kinds} == {"response": (2001, None, None), "revisit": (1999, 1, 1)}
