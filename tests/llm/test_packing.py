import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import packing, queries
from tessella.llm.common import SLICE_ROWS, slices
from tessella.llm.tokens import Encoder

TOKENIZER = "byte_bpe_50k.json"


def checked(patterns, counts, capacity):
    used = Counter()
    for items, times in patterns:
        assert sum(items) <= capacity and times > 0
        for x in items:
            used[x] += times
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(times for _, times in patterns)


def optimum(items, capacity):
    """Fewest bins, by branch and bound."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= items[k]}):
            rest = list(rooms)
            rest.remove(r)
            place(k + 1, rest + [r - items[k]])
        place(k + 1, rooms + [capacity - items[k]])

    place(0, [])
    return best[0]


def test_fixed_sets_never_cost_a_sequence():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([10, 12, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = dict(Counter(items))
        fixed, rest = packing.reduce_dominated(counts, capacity)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + (optimum(left, capacity) if left else 0) == optimum(items, capacity), (items, fixed)
        checked(packing.patterns(counts, capacity), counts, capacity)


def fewest(counts, capacity):
    """A lower bound on the sequences of any packing: long pieces never share one, shorter ones fill what room they leave."""
    best = 0
    for least in {0} | {x for x in counts if x <= capacity // 2}:
        alone = sum(n for x, n in counts.items() if x > capacity // 2)
        room = sum(n * (capacity - x) for x, n in counts.items() if capacity // 2 < x <= capacity - least)
        small = sum(x * n for x, n in counts.items() if least <= x <= capacity // 2)
        best = max(best, alone + max(0, -(-(small - room) // capacity)))
    return best


def test_close_to_the_bound_at_scale():
    rng = np.random.default_rng(1)
    sizes = np.concatenate([np.minimum(1024, rng.lognormal(6, 1, 200_000).astype(int) + 1), np.full(70_000, 700)])
    counts = dict(Counter(sizes.tolist()))
    n = checked(packing.patterns(counts, 1024), counts, 1024)
    assert n <= 1.01 * fewest(counts, 1024) and len(packing.patterns(counts, 1024)) < 10_000


def check_rows(rows, texts, capacity=1024):
    """rows: (doc_id, piece, start, length, crc, sequence, offset)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary(TOKENIZER))
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc_id, text in texts.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        own = sorted(by.pop(doc_id), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        for k, r in enumerate(own):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids)
    assert not by
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query_on_the_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_best_fit_packing(spark, sf).collect()
    n = check_rows(rows, texts)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_edges(spark):
    long = "lorem ipsum dolor " * 3000
    texts = {1: None, 2: "", 3: long, 4: "a", 5: "x" * 30_000, 6: "tab\t and  double  blanks\n\n\nend ", 7: "café naïve 你好 é <|endoftext|> don't"}
    rows = [(k, v, 5) for k, v in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check_rows(packing.pack(df, queries.vocabulary(TOKENIZER)).collect(), texts)
    twice = packing.pack(df.unionByName(df).unionByName(spark.createDataFrame([(None, "no id", 1)], df.schema)), queries.vocabulary(TOKENIZER)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)
    assert packing.pack(df.limit(0), queries.vocabulary(TOKENIZER)).count() == 0


@pytest.mark.parametrize("name", [TOKENIZER, "word_bpe_49k.json"])
def test_encoding_by_parts_is_that_of_the_whole(spark, sf, name):
    from tokenizers import Tokenizer

    encoder, untouched = Encoder(queries.vocabulary(name)), Tokenizer.from_file(queries.vocabulary(name))
    assert encoder.word is not None
    plain = lambda t: np.array(untouched.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    rng = random.Random(5)
    alphabet = ["a", "Z", "é", "ß", " ", "  ", "\n", "\t", " ", "'s", "'", ".", "1", "23", "β", "́", "你", " ", "-", "_", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "\x1f", "\x85", "İ", "😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>"]
    assert [t for t in texts if encoder.encode(t) != plain(t)] == []


def test_dominating_sets_are_small():
    for items in combinations_with_replacement(range(1, 9), 4):
        fixed, _ = packing.reduce_dominated(dict(Counter(items)), 10)
        assert all(len(f) <= 3 for f, _ in fixed)


def test_a_task_holds_few_texts_at_once():
    """Batches of Arrow are larger; what is made Python values at a time is bounded, in order, and all of it."""
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, 10_000)]
    found = list(slices(iter(batches)))
    assert max(b.num_rows for b in found) <= SLICE_ROWS < 10_000
    assert [x for b in found for x in b.column(0).to_pylist()] == [0, *range(10_000)]


def test_kept_parts_follow_the_caller():
    """A worker that the pipeline used before keeps as many parts as the query asks for, and the other way round."""
    path = queries.vocabulary(TOKENIZER)
    assert [Encoder.of(path, n).kept for n in (3, 5, 2)] == [3, 5, 2]
    assert Encoder.of(path, 2).encode("one two three four one") == Encoder(path).encode("one two three four one") and len(Encoder.of(path, 2)) <= 2
    Encoder._made.pop(path)
