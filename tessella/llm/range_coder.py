"""Adaptive context-mixing range coder for sequences of ids, in independent blocks.

A block holds up to ``LANES * BLOCK`` ids, starts anew and can be decoded alone.
Its ids are laid out in lanes that are worked on side by side, one id of each
at a time, so each operation is one on arrays; all lanes learn into, and
predict from, the same models.

Three predictions drive the arithmetic coding of an id, each a distribution
counted from the ids of the block so far: order 0 over all ids, order 1 over
those that followed the id before, order 2 over those that followed the two
ids before (their contexts are hashed).  The counts are brought up to date each
time ``GROWTH`` times as many ids are coded.  Weights, which adapt with every
step for each pair of how often the two contexts were seen, mix the three: they
divide the range, and an id is coded in the part where it is widest.  A range coder of 60
bits, with carries, writes 32-bit words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Ids of a lane, and lanes of a block; a block that would fill at most ``FEW`` lanes of ``SHORT`` ids has these.
BLOCK, LANES, SHORT, FEW = 1024, 2048, 4096, 64
CONTEXTS = 20  # bits of a hashed order-2 context
MIX, ORDER0 = 12, 20  # bits of the weights, and of the widths of order 0
LEAST_WEIGHT = 256
FULL, WORD = 60, 32
MASK, LEAST = (1 << FULL) - 1, 1 << (FULL - WORD)
MOST_SYMBOLS = 60_000
LOW_AT = 16 + 22  # a share as one number: symbol, size and start from these bits on
GROWTH = 4  # counts are brought up to date when so many times the ids are coded
RENEWED = 8  # from step 64 on, weights are renewed after so many steps
BATCH = 16  # steps whose counts the encoder looks up at once
HEAD = struct.Struct("<IIII")
#: How often a context was seen, in 8 classes: never, once, 2 to 3, ..., 64 and more.
CLASSES = np.minimum(np.ceil(np.log2(np.arange(1, 130))), 7).astype(np.int64)


class Followers:
    """How often each symbol followed each context."""

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, n_contexts: int):
        pairs = (contexts.astype(np.int64) << 16 | symbols).reshape(-1)
        pairs.sort()
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        self.pairs = pairs[first]
        self.count = np.diff(first, append=len(pairs)).astype(np.int32)
        self.start = np.zeros(n_contexts + 1, dtype=np.int32)
        self.start[1:] = np.cumsum(np.bincount(contexts.reshape(-1), minlength=n_contexts))
        self.low = first - self.start.take(self.pairs >> 16)

    def seen(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each context starts, and how often it was seen."""
        start = self.start.take(contexts)
        return start, self.start.take(contexts + 1) - start

    def index(self) -> None:
        """Prepare ``find``: of pairs that share a slot the last is found, the others are coded as not seen."""
        self.n, self.share = np.diff(self.start), self.low << 32 | self.count
        self.bits = min(22, max(8, len(self.pairs).bit_length() + 3))
        self.slots = np.zeros(1 << self.bits, dtype=np.int32)
        self.slots[self.slot(self.pairs)] = np.arange(len(self.pairs), dtype=np.int32)

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed >>= np.uint64(64 - self.bits)
        return mixed.view(np.int64)

    def find(self, contexts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each symbol in its context: where its share starts, how large it is (0: not seen), out of how many."""
        n = self.n.take(contexts)
        if not len(self.pairs):
            return np.zeros_like(n), np.zeros_like(n), n
        pairs = contexts.astype(np.int64) << 16 | symbols
        at = self.slots.take(self.slot(pairs))
        share = self.share.take(at) * (self.pairs.take(at) == pairs)
        return share >> 32, share & 0xFFFFFFFF, n


class Models:
    """The three predictions after the steps ``columns`` (steps x lanes)."""

    def __init__(self, columns: np.ndarray, first: np.ndarray, second: np.ndarray, symbols: int):
        counts = np.bincount(columns.reshape(-1), minlength=symbols)
        self.width = 1 + counts * ((1 << ORDER0) - symbols) // max(1, counts.sum())
        self.width[np.argmax(self.width)] += (1 << ORDER0) - self.width.sum()
        self.low = np.cumsum(self.width) - self.width
        self.order1 = Followers(first, columns, symbols)
        self.shift = max(0, CONTEXTS - 2 - columns.size.bit_length())  # few ids have fewer contexts
        self.order2 = Followers(second >> self.shift, columns, 1 << (CONTEXTS - self.shift))

    def places(self) -> None:
        """What the decoder looks up, of the three orders one after another: the share at each place, and of each share where it starts, its size and its symbol in one number."""
        one, two = self.order1, self.order2
        low, count = np.concatenate([self.low, one.low, two.low]), np.concatenate([self.width, one.count, two.count])
        self.share = low << LOW_AT | count << 16 | np.concatenate([np.arange(len(self.width)), one.pairs & 0xFFFF, two.pairs & 0xFFFF])
        self.share_at = np.repeat(np.arange(len(count), dtype=np.int32), count)


class Weights:
    """The range's division between orders 0, 1 and 2, for each pair of classes."""

    def __init__(self):
        self.tally = np.full((64, 3), 2, dtype=np.int64)
        self.possible = np.ones((64, 3), dtype=np.int64)
        self.possible[:8, 2] = self.possible[::8, 1] = 0  # contexts never seen
        self.refresh()

    def refresh(self) -> None:
        part = self.tally * self.possible
        part = (LEAST_WEIGHT + part * ((1 << MIX) - 3 * LEAST_WEIGHT) // part.sum(axis=1, keepdims=True)) * self.possible
        self.width2, self.width1 = part[:, 2].copy(), part[:, 1].copy()

    def learn(self, state: np.ndarray, order: np.ndarray, step: int) -> None:
        """Of a step, or of several up to ``step`` with the same weights."""
        self.tally += np.bincount((state * 3 + order).reshape(-1), minlength=192).reshape(64, 3)
        if step < 64 or step % RENEWED == 0:
            self.refresh()


def hashed(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The order-2 context of the two symbols ``before``, ``last``."""
    mixed = last.view(np.uint32) * np.uint32(0x9E3779B1)
    mixed += before.view(np.uint32) * np.uint32(0x85EBCA6B)
    mixed >>= np.uint32(32 - CONTEXTS)
    return mixed.view(np.int32)


def contexts(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order-1 and order-2 contexts of every symbol; what comes before a lane counts as symbol 0."""
    first = np.zeros_like(columns)
    first[1:] = columns[:-1]
    before = np.zeros_like(columns)
    before[2:] = columns[:-2]
    return first, hashed(before, first)


def epochs(steps: int) -> Iterator[tuple[int, int]]:
    """The steps between two counts: 0, 1 to 3, 4 to 15, .."""
    start = 0
    while start < steps:
        end = min(steps, max(1, GROWTH * start))
        yield start, end
        start = end


def encode_lanes(symbols: np.ndarray, n_symbols: int) -> list[bytes]:
    """``symbols``: lanes x steps. The words of every lane."""
    lanes, steps = symbols.shape
    columns = np.ascontiguousarray(symbols.T, dtype=np.int32)
    first, second = contexts(columns)
    weights = Weights()
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, MASK, dtype=np.int64)
    out = np.zeros((lanes, steps + 2), dtype="<u4")  # an id takes a word at most
    flat, row = out.reshape(-1), np.arange(lanes, dtype=np.int64) * out.shape[1]
    to, lane = row.copy(), np.arange(lanes)

    def carry() -> None:
        if low.max() > MASK:
            at = to[low > MASK] - 1
            while len(at):
                flat[at] += 1
                at = at[flat[at] == 0] - 1
            np.bitwise_and(low, MASK, out=low)

    for start, end in epochs(steps):
        models = Models(columns[:start], first[:start], second[:start], n_symbols)
        models.order1.index()
        models.order2.index()
        for a in range(start, end, BATCH):
            part = slice(a, min(a + BATCH, end))
            ids = columns[part]
            low1, count1, n1 = models.order1.find(first[part], ids)
            low2, count2, n2 = models.order2.find(second[part] >> models.shift, ids)
            states = CLASSES.take(np.minimum(n2, 128)) * 8 + CLASSES.take(np.minimum(n1, 128))
            lows = np.stack([models.low.take(ids), low1, low2], axis=1)
            counts = np.stack([models.width.take(ids), count1, count2], axis=1)
            totals = np.stack([np.full_like(n1, 1 << ORDER0), np.maximum(n1, 1), np.maximum(n2, 1)], axis=1)
            shares = (counts / totals).astype(np.float32)
            k = 0
            while k < len(ids):  # steps with the same weights together
                more = min(len(ids), k + (1 if a + k < 64 else 1 + -(a + k) % RENEWED))
                same = slice(k, more)
                state = states[same]
                begin, width = np.zeros((2, len(state), 3, lanes), dtype=np.int64)
                width[:, 2], width[:, 1] = weights.width2.take(state), weights.width1.take(state)
                begin[:, 1] = width[:, 2]
                np.add(width[:, 2], width[:, 1], out=begin[:, 0])
                np.subtract(1 << MIX, begin[:, 0], out=width[:, 0])
                gain = shares[same] * width
                order = 1 + (gain[:, 2] >= gain[:, 1])
                order *= np.maximum(gain[:, 1], gain[:, 2]) >= gain[:, 0]
                at = order * lanes + lane
                at += 3 * lanes * np.arange(len(state))[:, None]
                for begins, widths, total, lows_, count in zip(begin.take(at), width.take(at), totals[same].take(at), lows[same].take(at), counts[same].take(at)):
                    unit = span >> MIX
                    low += unit * begins
                    unit *= widths
                    unit //= total
                    low += unit * lows_
                    span = unit * count
                    carry()
                    go = np.flatnonzero(span < LEAST)
                    if len(go):
                        held, place = low[go], to[go]
                        flat[place] = held >> (FULL - WORD)
                        to[go] = place + 1
                        low[go] = held << WORD & MASK
                        span[go] <<= WORD
                weights.learn(state, order, a + more - 1)
                k = more
    low += LEAST - 1  # the next multiple of ``LEAST``, which is still in the range; what follows counts as zeros
    carry()
    flat[to] = low >> (FULL - WORD)
    to += 1
    return [out[i, : to[i] - row[i]].tobytes() for i in range(lanes)]


def decode_lanes(words: list[bytes], steps: int, n_symbols: int) -> np.ndarray:
    """The symbols, lanes x steps, of what ``encode_lanes`` wrote."""
    lanes = len(words)
    sizes = np.array([len(w) // 4 for w in words], dtype=np.int64)
    flat = np.zeros(int(sizes.sum()) + 2 * lanes, dtype=np.int64)  # two words of zeros after each lane
    next_ = np.cumsum(sizes + 2) - sizes - 2
    flat[np.arange(sizes.sum()) + np.repeat(2 * np.arange(lanes), sizes)] = np.frombuffer(b"".join(words), dtype="<u4")
    last = np.append(next_[1:], len(flat)) - 1
    code = flat.take(next_) << (FULL - WORD) | flat.take(next_ + 1) >> (2 * WORD - FULL)
    rest = flat.take(next_ + 1)  # its last bits belong to the next word that is taken
    next_ += 2
    weights = Weights()
    span = np.full(lanes, MASK, dtype=np.int64)
    columns = np.zeros((steps, lanes), dtype=np.int32)
    second = np.zeros((steps, lanes), dtype=np.int32)
    first = np.zeros((steps, lanes), dtype=np.int32)
    lane, spare = np.arange(lanes), 2 * WORD - FULL
    begin, width, totals, starts = (np.zeros((3, lanes), dtype=np.int64) for _ in range(4))
    totals[0] = 1 << ORDER0
    for start, end in epochs(steps):
        models = Models(columns[:start], first[:start], second[:start], n_symbols)
        models.places()
        base1, base2 = 1 << ORDER0, (1 << ORDER0) + start * lanes
        for k in range(start, end):
            if k:
                first[k] = columns[k - 1]
                second[k] = hashed(columns[k - 2] if k > 1 else columns[k], columns[k - 1])
            start1, n1 = models.order1.seen(first[k])
            start2, n2 = models.order2.seen(second[k] >> models.shift)
            state = CLASSES.take(np.minimum(n2, 128)) * 8 + CLASSES.take(np.minimum(n1, 128))
            width[2], width[1] = weights.width2.take(state), weights.width1.take(state)
            begin[1] = width[2]
            np.add(width[2], width[1], out=begin[0])
            np.subtract(1 << MIX, begin[0], out=width[0])
            np.maximum(n1, 1, out=totals[1])
            np.maximum(n2, 1, out=totals[2])
            np.add(start1, base1, out=starts[1])
            np.add(start2, base2, out=starts[2])
            unit = span >> MIX
            place = code // unit
            order = (place < begin[0]).astype(np.int64) + (place < begin[1])
            at = order * lanes + lane
            code -= unit * begin.take(at)
            unit *= width.take(at)
            total = totals.take(at)
            unit //= total
            v = np.minimum(code // unit, total - 1)
            v += starts.take(at)
            share = models.share.take(models.share_at.take(v))
            columns[k] = share & 0xFFFF
            code -= unit * (share >> LOW_AT)
            span = unit * (share >> 16 & (1 << LOW_AT - 16) - 1)
            go = np.flatnonzero(span < LEAST)
            if len(go):
                more = flat.take(np.minimum(next_[go], last[go]))
                code[go] = code[go] << WORD | (rest[go] & ((1 << spare) - 1)) << (WORD - spare) | more >> spare
                rest[go] = more
                next_[go] += 1
                span[go] <<= WORD
            weights.learn(state, order, k)
    return columns.T


def encode_segment(ids: np.ndarray) -> bytes:
    """A block of at most ``LANES * BLOCK`` ids (unsigned 32-bit) with at most ``MOST_SYMBOLS`` different ones."""
    counts = np.bincount(ids)
    alphabet = np.flatnonzero(counts)
    symbol = np.zeros(len(counts), dtype=np.int32)
    symbol[alphabet] = np.arange(len(alphabet))
    lanes = -(-len(ids) // (SHORT if len(ids) <= FEW * SHORT else BLOCK))
    steps = -(-len(ids) // lanes)
    padded = np.zeros(lanes * steps, dtype=np.int32)
    padded[: len(ids)] = symbol[ids]
    words = encode_lanes(padded.reshape(lanes, steps), len(alphabet))
    table = zlib.compress(np.concatenate([np.diff(alphabet, prepend=0), [len(w) for w in words]]).astype("<u4").tobytes())
    return HEAD.pack(len(ids), len(alphabet), len(table), zlib.crc32(ids.astype("<u4").tobytes())) + table + b"".join(words)


def decode_segment(data: bytes) -> np.ndarray:
    """The ids; raises where the block's checksum is wrong."""
    n, symbols, size, checksum = HEAD.unpack_from(data)
    at = HEAD.size + size
    table = np.frombuffer(zlib.decompress(data[HEAD.size : at]), dtype="<u4").astype(np.int64)
    alphabet, lengths = np.cumsum(table[:symbols]), table[symbols:]
    ends = at + np.cumsum(lengths)
    words = [data[e - w : e] for e, w in zip(ends, lengths, strict=True)]
    ids = alphabet[decode_lanes(words, -(-n // len(words)), symbols)].reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != checksum:
        raise OSError("a block has a wrong checksum")
    return ids


def segment_length(ids: np.ndarray) -> int:
    """How many of ``ids`` the next block takes: all that fit with not too many different ones."""
    n = min(len(ids), LANES * BLOCK)
    while np.count_nonzero(np.bincount(ids[:n])) > MOST_SYMBOLS:
        n = max(1, n // 2)
    return n
