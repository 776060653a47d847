"""Token ids of many texts: words are encoded once, kept in a hash table of arrays, and gathered.

A tokenizer that never joins tokens across a word boundary gives a text the
ids of its words, one after the other.  Words are spans of the texts' bytes
and are known by a 64-bit hash, so a chunk of texts needs a few passes of
numpy and the tokenizer itself only for words not met before.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from .common import IS_SEPARATOR, hash_spans, prefix_hashes

#: log2 of the table's slots; at most half are used (a memory bound; ids do not depend on it).
TABLE_BITS = 21
#: Ids the table holds at most (a larger chunk's own ids apart).
POOL_IDS = 6 << 20

#: White space beyond ASCII, and ASCII separators that only some patterns count as space.
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


# ---------------------------------------------------------------- table

def gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs ``pool[at:at + n]`` one after the other."""
    after = np.cumsum(n)
    return pool[np.repeat(at - (after - n), n) + np.arange(int(after[-1]) if len(after) else 0)]


class IdTable:
    """Hash of a word -> its ids; open addressing, all probes of a batch at once."""

    def __init__(self, bits: int = TABLE_BITS):
        self.bits = bits
        self.forget()

    def forget(self) -> None:
        slots = 1 << self.bits
        self.keys, self.at, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.used, self.words = np.zeros(1 << 16, np.uint32), 0, 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where unknown."""
        slot = self._slots(h)
        held = self.keys[slot]
        out = np.where(held == h, slot, -1)
        todo = np.flatnonzero((held != h) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == h[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (held != 0)]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Distinct unknown hashes, their ids one after the other, and how many each has."""
        if self.words + len(h) > 1 << (self.bits - 1) or self.used + len(ids) > POOL_IDS:
            while len(h) > 1 << (self.bits - 1):
                self.bits += 1
            self.forget()
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(len(ids), self.used), np.uint32)])
        self.pool[self.used:self.used + len(ids)] = ids
        first = self.used + np.cumsum(n) - n
        todo, slot = np.arange(len(h)), self._slots(h)
        while len(todo):
            free = self.keys[slot[todo]] == 0
            self.keys[slot[todo[free]]] = h[todo[free]]
            mine = self.keys[slot[todo]] == h[todo]  # of several for one slot the last has it
            at = slot[todo[mine]]
            self.at[at], self.n[at] = first[todo[mine]], n[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.used += len(ids)
        self.words += len(h)


# ---------------------------------------------------------------- words

SPACE, LETTER, MARK, LATIN = 1, 2, 3, 4
KIND = np.zeros(256, np.uint8)
KIND[[b for b in range(128) if chr(b).isalpha()]] = LETTER
KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = MARK
KIND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = LATIN  # after 0xC3: all but the signs of times and division
KIND[IS_SEPARATOR] = SPACE


def spaced_words(data: np.ndarray, offsets: np.ndarray):
    """Words with the white space in front of them, marks after a letter being words of their own.

    White space that ends a text is a word too.  Letters are those of ASCII
    and of two-byte Latin; another letter and the mark after it stay together.
    """
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 2
    kind = KIND[data]
    gap = kind == SPACE
    letter = kind == LETTER
    letter[1:] |= (data[:-1] == 0xC3) & (kind[1:] == LATIN)
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    begin[1:n] |= (gap[1:] & ~gap[:-1]) | ((kind[1:] == MARK) & letter[:-1])
    starts = np.flatnonzero(begin[:n])
    return starts, np.append(starts[1:], n)


def bare_words(data: np.ndarray, offsets: np.ndarray):
    """``spaced_words`` without their white space."""
    starts, ends = spaced_words(data, offsets)
    if not len(starts):
        return starts, ends
    solid = np.concatenate([[0], np.cumsum(~IS_SEPARATOR[data])])
    size = solid[ends] - solid[starts]  # the white space of a word is in front
    return (ends - size)[size > 0], ends[size > 0]


class WordTokenizer:
    """Ids of chunks of texts by a table of words.

    ``split`` finds the words of a chunk, ``learn`` gives the ids of new
    words ``(ids, how many each)``, ``whole`` those of one text whose words
    can't be told by ASCII white space (``odd`` finds such texts).  With
    ``fold`` words that differ in the case of A-Z are one.
    """

    def __init__(self, split: Callable, learn: Callable, whole: Callable, odd: re.Pattern, fold: bool = False):
        self.split, self.learn, self.whole, self.odd, self.fold, self.table = split, learn, whole, odd, fold, IdTable()

    def _known(self, data, prefix, starts, ends) -> np.ndarray:
        h = hash_spans(prefix, starts, ends)
        h[h == 0] = 1
        slot = self.table.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            raw, at = data.tobytes(), missing[first]
            ids, n = self.learn([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            before = self.table.words
            self.table.add(new, ids, n)
            if self.table.words != before + len(new):  # older words were forgotten
                return self._known(data, prefix, starts, ends)
            slot[missing] = self.table.find(h[missing])
        return slot

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their offsets."""
        given = data
        if self.fold:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        starts, ends = self.split(data, offsets)
        slot = self._known(data, prefix_hashes(data), starts, ends) if len(starts) else np.zeros(0, np.int64)
        n = self.table.n[slot].astype(np.int64)
        ids = gather(self.table.pool, self.table.at[slot], n)
        at = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)]
        raw = given.tobytes()
        odd = np.unique(np.searchsorted(offsets, [m.start() for m in self.odd.finditer(raw)], side="right") - 1)
        if not len(odd):
            return ids, at
        parts = np.split(ids, at[1:-1])
        for k in odd.tolist():
            parts[k] = np.array(self.whole(raw[offsets[k]:offsets[k + 1]].decode()), np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def byte_level(path: str) -> WordTokenizer:
    """Byte-level BPE whose tokens begin anew at white space that follows other characters.

    Special tokens' names are ordinary text.
    """
    tokenizer = load_tokenizer(path)
    tokenizer.encode_special_tokens = True
    # a token's name has one character for each of its bytes
    size = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for name, k in tokenizer.get_vocab().items():
        size[k] = len(name)

    def ids_of(text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(words: list[bytes]):
        # words from white space to another character can be encoded as one text, the others apart
        joined = [bool(IS_SEPARATOR[w[0]]) and not IS_SEPARATOR[w[-1]] for w in words]
        order = sorted(range(len(words)), key=joined.__getitem__, reverse=True)
        k = sum(joined)
        ordered = [words[i].decode() for i in order]
        found = tokenizer.encode_batch_fast(["".join(ordered[:k]), *ordered[k:]], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        ends = np.cumsum([len(words[i]) for i in order])
        after = np.searchsorted(np.cumsum(size[ids]), ends) + 1
        n, begin = np.empty((2, len(words)), np.int64)
        n[order] = np.diff(after, prepend=0)
        begin[order] = after - n[order]
        return gather(ids, begin, n), n

    return WordTokenizer(spaced_words, learn, ids_of, ODD_SPACE)


#: Lower-case ASCII and two-byte Latin letters: one token sequence with one end, whatever stands around it.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def word_level(path: str) -> WordTokenizer:
    """BPE with word ends that drops white space and case, and begins anew at a mark after a letter.

    New words are encoded as one text.  Words of letters end at a token that
    ends a word, and need no more than lower case before; the others are
    told apart by a special token between them.  A text with the beginning
    of a special token's name is encoded whole.
    """
    tokenizer, plain = load_tokenizer(path), load_tokenizer(path)
    from tokenizers import normalizers, pre_tokenizers
    plain.normalizer = normalizers.Lowercase()
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    mark, name = max((k, t.content) for k, t in tokenizer.get_added_tokens_decoder().items() if t.special)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[k for token, k in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encoded(text: str, by=tokenizer) -> np.ndarray:
        return np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(words: list[bytes]):
        simple = [LETTERS.fullmatch(w) is not None for w in words]
        order = np.argsort(np.logical_not(simple), kind="stable")
        ordered, k = [words[i].decode() for i in order.tolist()], sum(simple)
        letters, others = encoded(" ".join(ordered[:k]), plain), encoded(name.join([*ordered[k:], ""]))
        own = others == mark
        after = np.concatenate([np.flatnonzero(ends[letters]) + 1, len(letters) + np.flatnonzero(own) - np.arange(own.sum())])
        n, begin = np.empty((2, len(words)), np.int64)
        n[order] = np.diff(after, prepend=0)
        begin[order] = after - n[order]
        return gather(np.concatenate([letters, others[~own]]), begin, n), n

    return WordTokenizer(bare_words, learn, lambda text: encoded(text).tolist(), re.compile(re.escape(name[:2].encode())), fold=True)
