"""Suffix arrays by recursive induced sorting, and permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes (smaller or larger than the one after), takes the leftmost-smaller ones, names
their substrings by rank (as many symbols at a time as a key of 63 bits holds), sorts the string of names by the same way,
recursively, until no name repeats, and induces the whole array from the sorted leftmost-smaller suffixes in two linear sweeps.

A sweep goes through the buckets in whole-array steps. A step takes as many buckets as can be done at once: none of
them may get a suffix from another bucket of the step. With few symbols that is a bucket or two, with the many names of
the recursion some hundreds. Runs of one symbol are laid out at once, so they cost no steps.

``permuted_prefixes`` gives, in text order, the common prefix of each suffix with the one before it in the array: only
irreducible places are compared, the others follow from their left neighbour.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last character must be the only least one."""
    n = len(s)
    up = np.zeros(n, bool)
    step = np.diff(s)
    change = np.flatnonzero(step)
    if len(change):
        up[: change[-1] + 1] = np.repeat(step[change] > 0, np.diff(np.append(-1, change)))
    up[-1] = True
    return up


def runs_before(s: np.ndarray) -> np.ndarray:
    """How many places before each one hold its symbol without a break."""
    first = np.append(0, np.flatnonzero(s[1:] != s[:-1]) + 1)
    sizes = np.diff(np.append(first, len(s)))
    return np.arange(len(s)) - np.repeat(first, sizes)


def _rank_within(sorted_keys: np.ndarray) -> np.ndarray:
    """The rank of each of ascending keys within its equals."""
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(sorted_keys)])
    sizes = np.diff(np.append(first, len(sorted_keys)))
    return np.arange(len(sorted_keys)) - np.repeat(first, sizes)


def _sweep(s: np.ndarray, wanted: np.ndarray, run: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The ``wanted`` suffixes in ascending order, induced from the others' ``seeds`` (ascending); a wanted one comes before seeds of its symbol."""
    counts = np.bincount(s[wanted], minlength=size)
    ends = np.concatenate(([0], np.cumsum(counts)))
    fill = ends[:-1].copy()
    out = np.full(int(ends[-1]), -1, np.int64)
    seed_at = np.searchsorted(s[seeds], np.arange(size + 1))
    total = ends + seed_at
    gives = np.zeros(len(s), bool)  # whether the place before is wanted and has another symbol
    gives[1:] = wanted[:-1] & (s[1:] != s[:-1])
    runs = bool(run.any())
    at, from_seeds, upto = ends.tolist(), seed_at.tolist(), total.tolist()
    c, step = 0, 256
    while c < size:
        to = min(size, max(c + 1, int(total.searchsorted(upto[c] + step, "right")) - 1))
        own = out[at[c] : at[to]]
        if to - c > 1:
            own = own[own >= 0]
        else:
            own = own[: fill[c] - at[c]]
        more = run[own] if runs else None
        if runs and more.any():  # a symbol's run: each place follows from the one after it, all of a distance in a row
            which = np.repeat(np.arange(len(own)), more + 1)
            back = np.arange(len(which)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            own = own[which] - back
            own = own[np.lexsort((back, s[own]))]
        both = np.concatenate((own, seeds[from_seeds[c] : from_seeds[to]]))
        both = both[gives[both]]
        if to - c > 1 and len(both):
            both = both[s[both].argsort(kind="stable")]
        before = both - 1
        target = s[before]
        if to - c > 1 and len(target):
            least = int(target.min())
            if least < to:  # buckets from there on are not complete yet
                to = least
                kept = int(s[both].searchsorted(to))
                before, target = before[:kept], target[:kept]
                own = own[: int(s[own].searchsorted(to))]
        out[at[c] : at[to]] = own
        if len(before):
            order = target.argsort(kind="stable")
            before, target = before[order], target[order]
            rank = np.arange(len(target)) - target.searchsorted(target) if len(target) < 2000 else _rank_within(target)
            place = fill[target] + rank
            out[place] = before
            fill[target] = place + 1  # of equal targets the last one holds
        c, step = to, max(64, 2 * (upto[to] - upto[c]))
    return out


def induce(s: np.ndarray, up: np.ndarray, run: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The array induced from the leftmost-smaller suffixes ``seeds`` in their order."""
    larger = _sweep(s, ~up, run, seeds, size)
    induced = up.copy()
    induced[-1] = False  # nothing comes after the end
    smaller = _sweep(size - 1 - s, induced, run, larger[::-1], size)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    out = np.full(len(s), len(s) - 1, np.int64)
    symbol = s[larger]
    out[(ends - counts)[symbol] + _rank_within(symbol)] = larger
    symbol = s[smaller]
    out[ends[symbol] - 1 - _rank_within(size - 1 - symbol)] = smaller
    return out


def _names(s: np.ndarray, up: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """The rank among their kinds of the substrings from each leftmost-smaller place to the next, by as many symbols at a time as 63 bits hold.

    A symbol's type is its last bit, so no substring is the beginning of another, and of equal keys all end or none does.
    """
    bits = (2 * size - 1).bit_length()
    per = 63 // bits
    typed = np.concatenate((s.astype(np.uint64) << np.uint64(1) | up, np.zeros(per, np.uint64)))
    word = typed[: len(s)].copy()
    for k in range(1, per):
        word <<= np.uint64(bits)
        word |= typed[k : k + len(s)]
    mask = np.array([(1 << bits * per) - (1 << bits * (per - k)) for k in range(per + 1)], np.uint64)
    left = np.diff(np.append(least, len(s) - 1)) + 1
    key = word[least] & mask[np.minimum(left, per)]
    order = key.argsort()
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    place = np.arange(len(least))  # in the order; those of kinds that may part yet
    done = per
    while True:
        alone = fresh[place] & np.append(fresh, True)[place + 1]
        place = place[~alone & (left[order[place]] > done)]
        if not len(place):
            break
        which = order[place]
        key = word[least[which] + done] & mask[np.minimum(left[which] - done, per)]
        kind = np.cumsum(fresh[place])
        by = np.lexsort((key, kind))
        order[place], key = which[by], key[by]
        fresh[place[1:]] |= key[1:] != key[:-1]
        done += per
    names = np.empty(len(least), np.int32)
    names[order] = np.cumsum(fresh) - 1
    return names


def _sorted(s: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of ``s``, whose last symbol is its only least one; symbols are below ``size``."""
    up, run = smaller_types(s), runs_before(s)
    least = np.flatnonzero(up[1:] & ~up[:-1]) + 1  # leftmost-smaller places in text order; the last is the end
    if len(least) > 1:
        names = _names(s, up, least, size)
        kinds = int(names.max()) + 1
        seeds = least[_sorted(names, kinds) if kinds < len(least) else names.argsort()]
    else:
        seeds = least
    return induce(s, up, run, seeds, size)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of small non-negative integers; an end below all of them is implied."""
    if len(text) == 0:
        return np.empty(0, np.int64)
    s = np.append(text.astype(np.int32) + np.int32(1), np.int32(0))
    return _sorted(s, int(s.max()) + 1)[1:]


def permuted_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """In text order: the common prefix of suffix i with the one before it in the array, exact up to ``most``."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    reducible = np.zeros(n, bool)
    i = np.flatnonzero(before[1:] > 0) + 1
    reducible[i] = text[i - 1] == text[before[i] - 1]
    # eight bytes at each place, or four symbols below 2**16
    kind, per = (np.uint8, 8) if n and text.max() < 255 else (np.uint16, 4)
    padded = np.concatenate((text.astype(kind) + kind(1), np.zeros(8, kind)))
    words = np.ndarray(n + 1, "<u8", padded.data, strides=(8 // per,)).copy()
    out = np.zeros(n, np.int64)
    alive, t = np.flatnonzero(~reducible & (before >= 0)), 0
    # an irreducible prefix may run on past ``most`` and is needed there: reducible ones after it count down from it
    last = np.maximum.accumulate(np.where(reducible, -1, np.arange(n)))
    starts = np.flatnonzero(~reducible)
    bound = np.zeros(n, np.int64)
    bound[starts] = np.diff(np.append(starts, n)) - 1 + most
    while len(alive):
        x = words[np.minimum(alive + t, n)] ^ words[np.minimum(before[alive] + t, n)]
        stop = x != 0
        low = x[stop]
        out[alive[stop]] = t + np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) // (64 // per)
        t += per
        alive = alive[~stop]
        out[alive] = t
        alive = alive[bound[alive] > t]
    follows = np.flatnonzero(reducible & (last >= 0))
    out[follows] = np.maximum(out[last[follows]] - (follows - last[follows]), 0)
    return out
