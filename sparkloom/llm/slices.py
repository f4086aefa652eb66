"""Ids of slices of text by a tokenizer of the tokenizers library, kept by their bytes and looked up for whole batches at once.

A byte-level pre-tokenizer splits a text into pieces that its model encodes one by one.  Texts are cut here at places where pieces of the ``ByteLevel`` pattern
end whatever stands around them, so a slice's ids are the same alone as in its text:

* before a space between two visible characters;
* before and after a lone line end between two visible characters;
* between a letter (ASCII or U+00C0 to U+00FF) and one of ``. , ; : ! ? )``.

Slices of up to 31 bytes are keys of four 64-bit words (their bytes and length, so equal keys are equal slices) in open-addressing arrays.  The library encodes what is not found there:
its model alone where a slice is one piece for sure, the whole library otherwise.  Texts that hold an added token of the tokenizer's file are encoded by the library as they are.

Memory is bounded by two generations of ``most`` slices each: when the younger one is full it becomes the older one, whose slices move to the younger one again when they are met.
"""

from __future__ import annotations

import json
import re

import numpy as np

from sparkloom.llm.words import mix

LONGEST = 31
BLOCK = 200_000

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0x80:] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?)")] = True
#: slices that are one piece of the pattern for sure
_PIECE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n").fullmatch
_MASKS = np.array([[(1 << 8 * min(8, max(0, n - 8 * w))) - 1 for w in range(4)] for n in range(LONGEST + 1)], np.uint64)
_LENGTHS = np.arange(LONGEST + 1, dtype=np.uint64) << np.uint64(56)


def _white_beyond_ascii(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last bytes of white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    n = len(b)
    two = np.flatnonzero(b[: max(n - 1, 0)] == 0xC2)
    two = two[np.isin(b[two + 1], [0x85, 0xA0])]
    three = np.flatnonzero((b[: max(n - 2, 0)] >= 0xE1) & (b[: max(n - 2, 0)] <= 0xE3))
    code = (b[three].astype(np.int64) << 16) | (b[three + 1].astype(np.int64) << 8) | b[three + 2]
    points = [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
    three = three[np.isin(code, points)]
    return np.concatenate((two, three)), np.concatenate((two + 1, three + 2))


def cut_places(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where slices begin in ``b``; ``edges`` are the texts' offsets, each of which begins a slice too."""
    n = len(b)
    visible = _VISIBLE[b]
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:] = visible
    after[: n - 1] = visible[1:]
    first, last = _white_beyond_ascii(b)
    before[last + 1] = False
    after[np.maximum(first - 1, 0)[first > 0]] = False
    between = before[:n] & after[:n]
    begins = np.zeros(n + 1, bool)
    begins[:n] = (b == 32) & between
    lone = np.flatnonzero((b == 10) & between)
    # a text's first and last byte have no visible neighbour in their own text
    outer = np.zeros(n + 2, bool)
    outer[edges] = True
    begins[:n] &= ~(outer[:n] | outer[1 : n + 1])
    lone = lone[~(outer[lone] | outer[lone + 1])]
    begins[lone] = begins[lone + 1] = True
    letter = _LETTER[b]
    wide = np.flatnonzero(b[: max(n - 1, 0)] == 0xC3)
    letter[wide[~np.isin(b[wide + 1], [0x97, 0xB7])] + 1] = True
    begins[1:n] |= letter[: n - 1] & _STOP[b[1:]] if n else False
    begins[edges] = True
    begins[n] = False
    return np.flatnonzero(begins)


class Generation:
    """Keys and ids of at most ``most`` slices."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self.bits = np.uint64(64 - max(10, (4 * most - 1).bit_length()))
        self.slots = np.full(1 << (64 - int(self.bits)), -1, np.int32)
        self.keys = np.zeros((most, 4), np.uint64)
        self.at = np.zeros(most + 1, np.int64)
        self.ids = np.zeros(4 * most, np.uint32)

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where there are none."""
        out = np.full(len(keys), -1, np.int32)
        if not self.n:
            return out
        last = np.int64(len(self.slots) - 1)
        slot = (hashes >> self.bits).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            entry = self.slots[slot]
            full = entry >= 0
            if not full.all():
                todo, slot, entry = todo[full], slot[full], entry[full]
            same = (self.keys[entry] == keys[todo]).all(1) if len(todo) < len(keys) else (self.keys[entry] == keys).all(1)
            out[todo[same]] = entry[same]
            rest = ~same
            todo, slot = todo[rest], (slot[rest] + 1) & last
        return out

    def add(self, keys: np.ndarray, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of new, distinct keys with their ids."""
        first = self.n
        self.n += len(keys)
        end = int(self.at[first])
        if end + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)))
        self.ids[end : end + len(ids)] = ids
        self.keys[first : self.n] = keys
        self.at[first + 1 : self.n + 1] = end + np.cumsum(counts)
        entries = np.arange(first, self.n, dtype=np.int32)
        slot = (hashes >> self.bits).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.slots[s] < 0
            self.slots[s[free]] = entries[todo[free]]  # one of those that want a slot gets it
            todo = todo[self.slots[s] != entries[todo]]
            slot[todo] = (slot[todo] + 1) & np.int64(len(self.slots) - 1)
        return entries

    def runs(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the entries, and all their ids."""
        counts = self.at[entries + 1] - self.at[entries]
        starts = np.cumsum(counts) - counts
        return counts, self.ids[np.repeat(self.at[entries] - starts, counts) + np.arange(int(counts.sum()))]


def hash_of(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h += keys[:, 2] * np.uint64(0x94D049BB133111EB) + keys[:, 3] * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def _byte_characters() -> np.ndarray:
    """The character by which byte-level models write each byte: visible Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u2")
    out[own] = own
    rest = [b for b in range(256) if b not in set(own)]
    out[rest] = 256 + np.arange(len(rest))
    return out


class SliceEncoder:
    """Ids of whole texts by ``Tokenizer.from_file(path)`` with add_special_tokens=False.

    Strings of added tokens in a text give these tokens' ids, as the library does by default, or are ordinary text (``special_as_text``).
    """

    def __init__(self, path: str, most: int = 1_000_000, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        plain = told["pre_tokenizer"] or {}
        if plain.get("type") != "ByteLevel" or plain.get("add_prefix_space") or not plain.get("use_regex", True) or told.get("normalizer") or told["model"]["type"] != "BPE":
            raise ValueError(f"{path} is not a byte-level BPE tokenizer without a normalizer")
        self.added = [t["content"].encode() for t in told["added_tokens"] if not (special_as_text and t["special"])]
        self.sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token)  # a character for each byte
        for t in told["added_tokens"]:
            self.sizes[t["id"]] = len(t["content"].encode())
        self.characters = _byte_characters()
        self.most = max(most, BLOCK)
        self.young, self.old = Generation(self.most), None

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all texts in one array."""
        base = int(offsets[0])
        edges = offsets - base
        b = data[base : int(offsets[-1])]
        raw = b.tobytes()
        odd = sorted({int(np.searchsorted(edges, m.start(), side="right")) - 1 for token in self.added if token in raw for m in re.finditer(re.escape(token), raw)})
        padded = np.zeros(len(b) + LONGEST + 1, np.uint8)
        padded[: len(b)] = b
        begins = cut_places(b, edges)
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i in range(0, len(begins), BLOCK):
            part = begins[i : i + BLOCK]
            n, found = self._block(padded, part, int(begins[i + BLOCK]) if i + BLOCK < len(begins) else len(b))
            counts.append(n)
            ids.append(found)
        sums = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        ends = sums[np.searchsorted(begins, edges)]
        each, flat = np.diff(ends), np.concatenate(ids)
        if odd:
            pieces, at = [], 0
            for r in odd:
                whole = np.array(self.library.encode(raw[edges[r] : edges[r + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                pieces += [flat[at : ends[r]], whole]
                at, each[r] = ends[r + 1], len(whole)
            flat = np.concatenate([*pieces, flat[at:]])
        return each, flat

    def _block(self, padded: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive slices."""
        sizes = np.diff(begins, append=end)
        long = np.flatnonzero(sizes > LONGEST)
        short = np.minimum(sizes, LONGEST)
        window = np.lib.stride_tricks.as_strided(padded, (len(padded) - LONGEST, LONGEST + 1), (1, 1))
        keys = window[begins].view(np.uint64)
        keys &= _MASKS[short]
        keys[:, 3] |= _LENGTHS[short]
        hashes = hash_of(keys)
        if self.young.n + len(begins) > self.most:
            self.old, self.young = self.young, Generation(self.most)
        entries = self.young.find(keys, hashes)
        missing = np.flatnonzero(entries < 0)
        if len(long):
            missing = missing[sizes[missing] <= LONGEST]
        if len(missing):
            _, first, same = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new = missing[first]
            if (keys[new][same] != keys[missing]).any():  # two keys of one hash: distinct by the keys themselves
                _, first, same = np.unique(keys[missing], axis=0, return_index=True, return_inverse=True)
                new = missing[first]
            entries[missing] = self._learn(padded, begins[new], sizes[new], keys[new], hashes[new])[same.reshape(-1)]
        if not len(long):
            return self.young.runs(entries)
        entries[long] = 0 if self.young.n else -1
        parts, counts, at = [], np.zeros(len(begins), np.int64), 0
        for i in [*long.tolist(), len(begins)]:
            n, found = self.young.runs(entries[at:i])
            counts[at:i] = n
            parts.append(found)
            if i < len(begins):
                own = self._library([padded[begins[i] : begins[i] + sizes[i]].tobytes()])[1]
                counts[i] = len(own)
                parts.append(own)
            at = i + 1
        return counts, np.concatenate(parts)

    def _learn(self, padded: np.ndarray, begins: np.ndarray, sizes: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Take new slices into the younger generation: from the older one, or from the library."""
        entries = np.zeros(len(keys), np.int32)
        old = self.old.find(keys, hashes) if self.old is not None else np.full(len(keys), -1, np.int32)
        known = np.flatnonzero(old >= 0)
        if len(known):
            entries[known] = self.young.add(keys[known], hashes[known], *self.old.runs(old[known]))
        new = np.flatnonzero(old < 0)
        if len(new):
            starts = np.cumsum(sizes[new]) - sizes[new]
            total = int(sizes[new].sum())
            flat = padded[np.repeat(begins[new] - starts, sizes[new]) + np.arange(total)]
            raw, text = flat.tobytes(), self.characters[flat].tobytes().decode("utf-16-le")
            tokenize = self.model.tokenize
            counts, ids, other = np.zeros(len(new), np.int64), [], []
            for i, (a, z) in enumerate(zip(starts.tolist(), (starts + sizes[new]).tolist())):
                if _PIECE(raw, a, z):
                    own = [t.id for t in tokenize(text[a:z])]
                    counts[i] = len(own)
                    ids += own
                else:
                    other.append(i)
            simple = np.ones(len(new), bool)
            simple[other] = False
            done = new[simple]
            entries[done] = self.young.add(keys[done], hashes[done], counts[simple], np.array(ids, np.uint32))
            if other:
                rest = new[other]
                entries[rest] = self.young.add(keys[rest], hashes[rest], *self._library([raw[starts[i] : starts[i] + sizes[new[i]]] for i in other]))
        return entries

    def _library(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of slices, each taken as a text of its own by the library."""
        counts, ids = [], []
        for i in range(0, len(slices), 5000):
            part = slices[i : i + 5000]
            own = np.array(self.library.encode_batch_fast([[s.decode() for s in part]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.sizes[own]), np.cumsum([len(s) for s in part])) + 1
            counts.append(np.diff(ends, prepend=0))
            ids.append(own)
        return np.concatenate(counts), np.concatenate(ids)
