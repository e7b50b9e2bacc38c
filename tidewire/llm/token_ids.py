"""Ids of whole texts by a public tokenizer whose words end at white space.

The tokenizer cuts texts at white space first, so the ids of a text are those of its words, one after the other. It also
cuts between a letter and punctuation, and does not tell capitals from small letters. Texts are cut at these places with array
operations on their UTF-8 bytes, and the different words of a slice are looked up in tables of bounded
size that each worker fills with what the tokenizer says: a young one, and the one before it, out of which words come
back when they are met again. Words of letters are asked for many at a time, as each gives one token that ends a word; for
small ASCII letters the tokenizer's changes of letters and its search for words do nothing, and are left out.

Long texts are worked through in slices that end at white space, and long stretches without any are cut where the
tokenizer cuts them in any case: after a digit before a letter, or between CJK punctuation and a letter. Only a longer
stretch of letters without a digit or a blank is held as a whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

MOST_WORDS = 500_000
SLICE = 1 << 21
LONG_WORD = 1 << 12
GROUP = 200

_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_CUT = re.compile("(?<=[。，、！？])(?=[ぁ-ゖァ-ヺ一-鿿])|(?<=[0-9])(?=[A-Za-z])")

#: Kinds of bytes. Words are cut between an ASCII letter, or one from U+00C0 to U+00FF, and ASCII punctuation but the apostrophe.
_BLANK, _LETTER, _MARK, _OTHER = 0, 1, 2, 4


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    for byte in range(128):
        if chr(byte).isalpha():
            kinds[byte] = _LETTER
        elif chr(byte).isprintable() and not chr(byte).isdigit() and byte != ord("'"):
            kinds[byte] = _MARK
    kinds[list(b" \t\n\r\x0b\x0c")] = _BLANK
    return kinds


_KINDS = _kinds()


class WordIds:
    """Ids as little-endian unsigned 32-bit numbers, or 16-bit ones if the vocabulary allows."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.of_small_letters = Tokenizer.from_file(path)
        self.of_small_letters.normalizer = None
        self.of_small_letters.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def of(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of some whole texts."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0
        for n, text in enumerate(texts):
            for part in _slices(text):
                held.append((n, part))
                size += len(part)
                if size >= SLICE:
                    self._look_up(held, out)
                    held, size = [], 0
        if held:
            self._look_up(held, out)
        return [np.frombuffer(b"".join(parts), self.type) for parts in out]

    def _look_up(self, held: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        words, begins = _words([part for _, part in held])
        coded = words.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.young.get, different))
        missing = [at for at, ids in enumerate(known) if ids is None]
        if len(self.young) + len(missing) > MOST_WORDS:
            self.young, self.old = {}, self.young
            missing = list(range(len(different)))
        self._learn(self._kept([different[at] for at in missing]))
        for at in missing:
            known[at] = self.young[different[at]]
        found = pa.array(known, pa.large_binary()).take(coded.indices)
        data, ends = found.buffers()[2], np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[begins].tolist()
        for (n, _), a, b in zip(held, ends, ends[1:], strict=False):
            out[n].append(data[a:b])
        for at in missing:
            if len(different[at]) > LONG_WORD:
                del self.young[different[at]]

    def _kept(self, missing: list[bytes]) -> list[bytes]:
        """Take what the old table has; the rest is new."""
        young, old = self.young, self.old
        again = [word for word in missing if word in old]
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        return [word for word in missing if word not in old] if again else missing

    def _learn(self, words: list[bytes]) -> None:
        young, small, plain, other = self.young, [], [], []
        for word in words:
            if word.isalpha() and word.islower():
                small.append(word)
            elif len(word) > LONG_WORD and not word.isalpha():
                young[word] = b"".join(self._ids(_CUT.split(word.decode())))
            else:
                (plain if word.decode().isalpha() else other).append(word)
        for tokenizer, like in ((self.of_small_letters, small), (self.tokenizer, plain)):
            for at in range(0, len(like), GROUP):
                own = like[at : at + GROUP]
                (encoding,) = tokenizer.encode_batch_fast([b" ".join(own).decode()], add_special_tokens=False)
                ids = np.array(encoding.ids, self.type)
                stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.type.itemsize).tolist()
                if len(stops) == len(own):
                    data = ids.tobytes()
                    young.update(zip(own, [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
                else:  # a letter that the tokenizer does not count as one
                    other += own
        young.update(zip(other, self._ids([word.decode() for word in other]), strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = []
        for at in range(0, len(texts), GROUP):
            encodings = self.tokenizer.encode_batch_fast(texts[at : at + GROUP], add_special_tokens=False)
            found += [np.array(e.ids, self.type).tobytes() for e in encodings]
        return found


def _words(parts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of some parts, one after the other, and where each part's begin (and the last one's end)."""
    data = b"\n".join([part if b"<|" in part else part.lower() for part in parts])
    raw = np.frombuffer(data, np.uint8)
    edges = np.cumsum([0, *[len(part) + 1 for part in parts]])
    kinds = _KINDS[raw]
    leads = np.flatnonzero(raw[:-1] == 0xC3)
    leads = leads[~np.isin(raw[leads + 1], (0x97, 0xB7))]  # the signs of times and division
    kinds[leads] = kinds[leads + 1] = _LETTER
    for part, a, b in zip(parts, edges, edges[1:], strict=False):
        if b"<|" in part:  # names of special tokens are as they are
            kinds[a:b][kinds[a:b] == _MARK] = _OTHER
    solid = kinds != _BLANK
    first = solid.copy()
    first[1:] &= (kinds[:-1] == _BLANK) | ((kinds[1:] | kinds[:-1]) == _LETTER | _MARK)
    starts = np.flatnonzero(first)
    own = raw[solid]
    offsets = np.append(np.cumsum(solid)[starts] - 1, len(own))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(own)])
    return words, np.searchsorted(starts, edges)


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table a worker."""
    return WordIds(path)


def plain_ids(path: str, texts: Iterable[str]) -> list[list[int]]:
    """What the tokenizer says of whole texts: what the table is checked against."""
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
