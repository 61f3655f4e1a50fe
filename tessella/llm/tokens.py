"""Encoding whole texts with a stored tokenizer, a word at a time.

No pre-token of these byte-level tokenizers reaches from a character that is no
white space into white space, nor from a letter into an ASCII character that is
none.  A text may therefore be cut at such places and its parts encoded alone.
Parts repeat, so their ids are kept in each worker process; the tokenizer sees
a part once.  For a lower-case vocabulary that drops blanks, ``encoded`` takes
many texts at a time: Arrow splits them, a word is looked up once for a group
of texts, and ids are laid out by arrays.

The ids are those of the library with ``add_special_tokens=False`` and no other
setting: where a text holds the string of a special token, the library gives
that token's id.  Such texts go to it whole.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A part: blanks and newlines, then a whole run of Latin letters or else all up to the next blank; or blanks at the end.
PART = re.compile(rf"[ \n]*[{LETTERS}]++(?=[\x00-\x7f]|\Z)|[ \n]*[^ \n]+|[ \n]+\Z")
#: A word with at most one blank before it.
WORD = re.compile(rf" ?[{LETTERS}]+\Z")
#: Texts with any of these are looked at more closely: other white space, control characters, marks that combine.
ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0̀-ͯ  -‏ -  　﻿]")
#: Such a character right before or after a blank or newline: the text is not cut.
UNSAFE = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0  -‏ -  　﻿][ \n]|[ \n][̀-ͯ]")
#: Parts of at most so many characters are kept, so many at most, unless a caller asks for fewer; then the store starts anew.
KEPT_CHARS, KEPT_PARTS = 48, 1_600_000
#: What may follow a word and is a part of its own then.
MARKS = ".,;:!?"
#: Texts are encoded together until they have so many characters; ids of so many texts are laid out at once.
GROUP_CHARS, GROUP_TEXTS = 3 << 20, 512
#: Words on which the direct way through the tokenizer's model must agree with the tokenizer.
PROBES = ("the", "The", "straße", "ÉTÉ", "Xylophonist", "aeiouaeiou", "zzzqqq", "ÿ", "I", "señoras")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Encoder(dict):
    """The ids of texts as little-endian unsigned 32-bit integers; the dictionary holds the parts seen so far."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, kept: int = KEPT_PARTS):
        super().__init__()
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added if not t.normalized]
        self.whole = any(t.normalized for t in added)  # such tokens are sought in another form of the text
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.shown = "".join("\n" if b == 10 else self.letters.get(b, chr(b)) for b in range(256))
        self.id_bytes = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.word = next((w for w in (self._spaced, self._bare) if all(w(p + x) == self.plain(p + x) for x in PROBES for p in ("", " "))), None)

    @classmethod
    def of(cls, path: str, kept: int = KEPT_PARTS) -> Encoder:
        """One encoder, with what it has kept, for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path, kept)
        cls._made[path].kept = kept
        return cls._made[path]

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _of_model(self, text: str) -> bytes:
        shown = text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(shown)])

    def _spaced(self, word: str) -> bytes:
        """Of a vocabulary whose words carry the blank before them."""
        return self._of_model(word)

    def _bare(self, word: str) -> bytes:
        """Of a lower-case vocabulary that drops blanks."""
        return self._of_model(word.lower().strip(" "))

    def __missing__(self, part: str) -> bytes:
        if self.word and WORD.match(part):
            ids = self.word(part)
        else:
            parts = PART.findall(part)
            ids = self.plain(part) if len(parts) < 2 else b"".join(map(self.__getitem__, parts))
        if len(part) <= KEPT_CHARS:
            if len(self) >= self.kept:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; none for null."""
        if not text:
            return b""
        if self.whole or any(s in text for s in self.special):
            return self.plain(text)
        odd = ODD.search(text)
        if odd and UNSAFE.search(text):
            return self.plain(text)
        if not odd and self.word == self._bare:  # blanks and newlines are the only white space, and have no ids
            return b"".join(map(self.__getitem__, text.split()))
        return b"".join(map(self.__getitem__, PART.findall(text)))

    def _learn(self, parts: list[str]) -> None:
        """Keep the ids of those of these different parts that are a word, alone or with marks after it; words go to the model one after another."""
        heads = [p.rstrip(MARKS) for p in parts]
        fresh = list({h for h in heads if h not in self and WORD.match(h)})
        if len(self) + len(parts) + len(fresh) > self.kept:
            return  # ``__missing__`` starts the store anew
        shown = codecs.charmap_decode("\n".join(fresh).lower().encode(), "strict", self.shown)[0].split("\n")
        id_bytes, tokenize = self.id_bytes, self.model.tokenize
        for h, x in zip(fresh, shown):
            self[h] = b"".join([id_bytes[t.id] for t in tokenize(x)])
        for p, h in zip(parts, heads):
            if len(h) < len(p) and h.isalpha():
                self[p] = self[h] + self[p[len(h) :]]

    def encoded(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """What ``encode`` gives for each of ``texts``, in their order."""
        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= GROUP_CHARS:
                yield from self._group(held)
                held, chars = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if self.word != self._bare or self.whole:
            yield from map(self.encode, texts)
            return
        # small ASCII letters give the same ids; only the string of a special token may come about by it, so it is sought in them
        small = pc.ascii_lower(pa.array(texts, pa.large_string()))
        easy = np.array([not ODD.search(t) for t in texts], dtype=bool)
        for s in self.special:
            if s.lower().encode() in small.buffers()[2].to_pybytes():
                easy &= ~pc.match_substring(small, s.lower()).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(easy, pa.bool_()), small, ""))
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.get, different))
        unseen = [k for k, ids in enumerate(parts) if ids is None]
        self._learn([different[k] for k in unseen if len(different[k]) <= KEPT_CHARS])
        for k in unseen:
            parts[k] = self[different[k]]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, starts, which, offsets = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes, words.indices.to_numpy(), split.offsets.to_numpy()
        for a in range(0, len(texts), GROUP_TEXTS):
            bounds = offsets[a : a + GROUP_TEXTS + 1]
            here = which[bounds[0] : bounds[-1]]
            n = sizes.take(here)
            ends = np.append(0, np.cumsum(n))
            place = np.repeat(starts.take(here) - ends[:-1], n)
            place += np.arange(ends[-1])
            data, ends = pool.take(place).tobytes(), 4 * ends[bounds - bounds[0]]
            for k in range(len(ends) - 1):
                yield data[ends[k] : ends[k + 1]] if easy[a + k] else self.encode(texts[a + k])
