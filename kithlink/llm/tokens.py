"""Token ids by the ``tokenizers`` library, with each distinct pre-token encoded once per worker.

Byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in a row. The pre-tokens
of a slice are cut in numpy by the byte-level rule (contractions, letters, digits, others, each with one leading
space, then white space); those not seen before are given to the library's model. Hashes only find the candidate for an equal
pre-token; the two are then compared code point by code point. Every text is encoded whole, the strings of added tokens become their ids as in the library
(``special_as_text``: they are ordinary text). Files of other kinds than plain byte-level BPE go through the library text by text.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kithlink.llm import shared
from kithlink.llm.textvec import U64, chained

LETTER, DIGIT, OTHER, SPACE, EDGE = range(5)
#: The contractions of the byte-level pre-tokeniser.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Unicode White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        kinds = {"L": LETTER, "N": DIGIT}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


def pretokens(points: np.ndarray, ends: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pre-tokens; ``ends`` are the places of the one-character edges after each text."""
    kind = classes()[points]
    kind[ends] = EDGE
    first = np.ones(len(points), bool)
    first[1:] = kind[1:] != kind[:-1]
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(points))
    run = kind[start]
    following = np.append(run[1:], EDGE)
    white = (run == SPACE) & (following != EDGE)
    gives = white & (points[end - 1] == 0x20)  # its last space goes to the next run
    leaves = white & ~gives & (end - start > 1)  # its last character stands alone
    takes = np.append(False, gives[:-1])
    moved = start - takes
    stop = end - gives
    apostrophes = np.flatnonzero((run == OTHER) & (end - start == 1) & ~takes & (following == LETTER) & (points[start] == 0x27))
    extra_start, extra_end = [end[leaves] - 1], [end[leaves]]
    stop[leaves] -= 1
    for i in apostrophes.tolist():
        at = int(start[i])
        hit = next((c for c in CONTRACTIONS if joined.startswith(c, at)), None)
        if hit:
            stop[i] = at + len(hit)
            moved[i + 1] = at + len(hit)
    keep = (stop > moved) & (run != EDGE)
    s, e = np.concatenate((moved[keep], *extra_start)), np.concatenate((stop[keep], *extra_end))
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def distinct(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one pre-token of each kind, the kind of every pre-token, the kinds' hashes). Kinds are told by the hash, and each pre-token is then
    compared with the one that stands for its kind, code point by code point; those that differ are kinds of their own."""
    keys = chained(points.view(np.uint8), 4 * start, 4 * end)
    _, at, kind = np.unique(keys, return_index=True, return_inverse=True)
    stands, size = at[kind], end - start
    alive, t, other = np.flatnonzero(stands != np.arange(len(kind))), 0, []
    differs = size[alive] != size[stands[alive]]
    while len(alive):
        other.append(alive[differs])
        alive = alive[~differs & (size[alive] > t)]
        differs = points[start[alive] + t] != points[start[stands[alive]] + t]
        t += 1
    alone = np.concatenate(other) if other else np.empty(0, np.int64)
    if len(alone):
        kind[alone] = len(at) + np.arange(len(alone))
        at = np.append(at, alone)
    return at, kind, keys[at]


class Memo:
    """Pre-tokens and their ids, told by their code points: a sorted hash finds the one candidate, which is then compared.

    ``most`` bounds the pre-tokens held; one takes some 70 bytes. It starts anew beyond that.
    """

    def __init__(self, most: int, dtype):
        self.most, self.dtype = most, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.empty(0, U64), np.empty(0, np.int32)
        self.begin, self.length = np.empty(0, np.int64), np.empty(0, np.int32)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids, self.points = np.empty(0, self.dtype), np.empty(0, np.uint32)

    def find(self, keys: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each pre-token; -1 where there is none, -2 where its hash is another one's."""
        place = np.searchsorted(self.keys, keys)
        met = np.flatnonzero(place < len(self.keys))
        met = met[self.keys[place[met]] == keys[met]]
        out = np.full(len(keys), -1, np.int64)
        out[met] = self.slot[place[met]]
        same = self.size[out[met]] == size[met]
        out[met[~same]] = -2
        alive, t = met[same], 0
        alive = alive[size[alive] > 0]
        while len(alive):
            same = self.points[self.at[out[alive]] + t] == points[start[alive] + t]
            out[alive[~same]] = -2
            t += 1
            alive = alive[same & (size[alive] > t)]
        return out

    def add(self, keys: np.ndarray, points: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """New pre-tokens with keys of their own, and the ids of all of them in a row."""
        first, order = len(self.begin), np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys, self.slot = np.insert(self.keys, place, keys[order]), np.insert(self.slot, place, first + order)
        self.begin, self.length = np.append(self.begin, len(self.ids) + np.cumsum(length) - length), np.append(self.length, length.astype(np.int32))
        self.at, self.size = np.append(self.at, len(self.points) + np.cumsum(size) - size), np.append(self.size, size.astype(np.int32))
        self.ids = np.append(self.ids, ids)
        self.points = np.append(self.points, points[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])


class Encoder:
    """Whole texts to ids. ``memo`` bounds the pre-tokens remembered."""

    def __init__(self, path: str, memo: int = 1_000_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves, others for the code points from 256
        self.spelling = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.memo = Memo(memo, self.dtype)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        cutter = form.get("pre_tokenizer") or {}
        self.known = form["model"].get("type", "BPE") == "BPE" and not form.get("normalizer") and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        added = {i: x for i, x in self.library.get_added_tokens_decoder().items() if not (special_as_text and x.special)}
        self.known &= not any(x.single_word or x.lstrip or x.rstrip or x.normalized for x in added.values())
        self.added = {x.content: i for i, x in added.items()}
        self.mark = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, length) of each pre-token, by the library's model on the byte-level spelling."""
        found = [[t.id for t in self.library.model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.spelling))] for w in words]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), self.dtype, int(length.sum())), length

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts in a row, and how many each has."""
        if not self.known:
            found = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(itertools.chain.from_iterable(found), self.dtype, int(counts.sum())), counts
        if self.mark is None or not any(map(self.mark.search, texts)):
            return self._plain(texts)
        parts, owner, ids, after = [], [], [], []  # texts cut at added tokens; the tokens and how many parts stand before each
        for k, t in enumerate(texts):
            at = 0
            for m in self.mark.finditer(t):
                parts.append(t[at : m.start()])
                owner.append(k)
                ids.append(self.added[m.group()])
                after.append(len(parts))
                at = m.end()
            parts.append(t[at:])
            owner.append(k)
        plain, counts = self._plain(parts)
        upto = np.concatenate(([0], np.cumsum(counts)))
        whole = np.bincount(owner, counts, len(texts)).astype(np.int64) + np.bincount(np.array(owner)[np.array(after) - 1], minlength=len(texts))
        return np.insert(plain, upto[after], np.array(ids, self.dtype)), whole

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts without added tokens."""
        if not any(texts):
            return np.empty(0, self.dtype), np.zeros(len(texts), np.int64)
        joined = "\0".join(texts) + "\0"
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        start, end = pretokens(points, ends, joined)
        at, kind, keys = distinct(points, start, end)
        s, size, memo = start[at], (end - start)[at], self.memo
        if len(memo.keys) > memo.most:
            memo.clear()
        which = memo.find(keys, points, s, size)
        new = np.flatnonzero(which < 0)
        begin, length, ids = np.empty(len(at), np.int64), np.empty(len(at), np.int64), memo.ids
        if len(new):
            found, counts = self._library([joined[a:b] for a, b in zip(s[new].tolist(), (s + size)[new].tolist(), strict=True)])
            begin[new], length[new] = len(ids) + np.cumsum(counts) - counts, counts
            fresh = which[new] == -1
            if fresh.all():
                memo.add(keys[new], points, s[new], size[new], found, counts)
                ids = memo.ids
            else:  # some share their hash with another pre-token: this time none is remembered
                ids = np.append(ids, found)
        old = which >= 0
        begin[old], length[old] = memo.begin[which[old]], memo.length[which[old]]
        begin, length = begin[kind], length[kind]
        upto = np.cumsum(length)
        out = ids[np.repeat(begin - (upto - length), length) + np.arange(int(upto[-1]))]
        bounds = np.concatenate(([0], upto))[np.searchsorted(start, np.concatenate(([0], ends)))]
        return out, np.diff(bounds)


_encoders: dict[str, Encoder] = shared.kept({})


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def portions(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """(first, end, texts) of runs of rows with about ``most`` bytes, null as empty; a longer text stands alone, whole. Only one run is taken out of the column at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto, i, n = np.cumsum(sizes), 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, min(j, n), [t or "" for t in column.slice(i, j - i).to_pylist()]
        i = j
