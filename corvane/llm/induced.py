"""Suffix order and common prefixes of integer texts by external induced sorting.

After Bingmann, Fischer and Osipov, "Inducing Suffix and LCP Arrays in External
Memory". The suffixes at left-most descents (S*) are named by their substrings and
ordered by recursion on the names; all others are induced from them in two sweeps
over the alphabet. What waits for its turn lies in a priority queue whose keys
only rise: tuples of a position and of the prefix it shares with the one that came before
it under its key. Keys far ahead are kept on disk, range by range. Prefix lengths
are induced in the same sweeps, from the least shared length between two sources.

Of texts longer than ``room`` all arrays as long as the text, or as its S* suffixes, are files: types, runs, names, their
order, prefix lengths and results. They are written piece by piece and mapped into memory, from which the system may
take them back. What is held is a range of keys of the queue, or all entries of one symbol, pieces of ``_STEP`` numbers, and a few
numbers for each symbol of the alphabet.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np

_BITS, _LOW = 6, 63  # an entry of the queue: position << 6 | length of the shared prefix
_STEP = 1 << 20


class RisingQueue:
    """A priority queue of (key, entry) whose popped keys never fall; equal keys come first in, first out.

    ``counts``: for each key, how many entries it can get at most. Keys are cut into ranges of at most ``room`` entries (a single key
    may exceed that); the present range is in memory, later ones are files in ``folder``.
    """

    def __init__(self, counts: np.ndarray, room: int, folder: str | None):
        total = np.cumsum(counts)
        self.range_of = None
        self.now: dict[int, list[int]] = {}
        self.at = 0
        if len(total) and total[-1] > room and folder:
            self.range_of = np.maximum(total - 1, 0) // room
            self.folder, self.buffers = folder, {}
            self.alone = np.bincount(self.range_of[np.asarray(counts) > 0], minlength=int(self.range_of[-1]) + 1) <= 1  # ranges of one key, read as they are needed
            self.limit = max(128, room // (2 * (int(self.range_of[-1]) + 1)))

    def push(self, key: int, entry: int) -> None:
        if self.range_of is not None and (r := int(self.range_of[key])) != self.at:
            buffer = self.buffers.setdefault(r, [])
            buffer += (key, entry)
            if len(buffer) > 2 * self.limit:
                self._write(r)
            return
        bucket = self.now.get(key)
        if bucket is None:
            self.now[key] = [entry]
        else:
            bucket.append(entry)

    def _write(self, r: int) -> None:
        with open(f"{self.folder}/{r}", "ab") as f:
            np.array(self.buffers.pop(r), np.int64).tofile(f)

    def take(self, key: int) -> Iterator[list[int]]:
        """The entries of ``key`` in order, some at a time; those pushed to this key meanwhile come last."""
        if self.range_of is not None and (r := int(self.range_of[key])) != self.at:
            self.at, self.now = r, {}
            if r in self.buffers:
                self._write(r)
            if os.path.exists(path := f"{self.folder}/{r}"):
                with open(path, "rb") as f:
                    while len(some := np.fromfile(f, np.int64, 2 * _STEP)):
                        if self.alone[r]:
                            yield some[1::2].tolist()
                            continue
                        for k, x in some.reshape(-1, 2).tolist():
                            self.now.setdefault(k, []).append(x)
                os.remove(path)
        while some := self.now.pop(key, None):
            yield some


def _array(folder: str | None, name: str, n: int, dtype) -> np.ndarray:
    if folder is None or n == 0:
        return np.empty(n, dtype)
    return np.asarray(np.memmap(f"{folder}/{name}", dtype, "w+", shape=(n,)))


def pieces(n: int) -> Iterator[slice]:
    for s in range(0, n, _STEP):
        yield slice(s, min(n, s + _STEP))


def _counted(values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for s in pieces(len(values)):
        out += np.bincount(values[s], minlength=size)
    return out


def _sweep(text, wanted, want: int, run, extras: Callable[[int, int], list[int]], extra_end: np.ndarray, falling: bool, cap: int, queue: RisingQueue, out: np.ndarray, extras_too: bool) -> np.ndarray:
    """Induce the suffixes of type ``want`` from those of each key and its extras; writes the entries in the order found, and returns how many each key has.

    ``extras``: entries of suffixes known before, by place in the sweep's order, each with the prefix shared with the one before; ``extra_end``: their number up to each key.
    """
    size = len(extra_end)
    counts = np.zeros(size, np.int64)
    last: dict[int, int] = {}
    when: list[int] = []  # a stack of (time, shared length), lengths rising: the least since a time is the first entry after it
    least: list[int] = []
    time = done = begin = 0
    buffer: list[int] = []
    push, top = queue.push, size - 1

    def of(key: int, begin: int, end: int) -> Iterator[tuple[list[int], bool]]:
        """Entries of a key and whether they are written: those induced, then the extras."""
        back = -1
        for entries in queue.take(key):
            counts[key] += len(entries)
            back = entries[-1] >> _BITS
            yield entries, True
        for s in range(begin, end, _STEP):
            entries = extras(s, min(end, s + _STEP))
            if s == begin:
                p = entries[0] >> _BITS
                entries[0] = p << _BITS | (min(int(run[p]), int(run[back]), cap) if back >= 0 else 0)
            yield entries, extras_too

    for key in range(size):
        end = int(extra_end[key])
        for entries, keep in of(key, begin, end):
            for entry in entries:
                v = entry & _LOW
                time += 1
                while least and least[-1] >= v:
                    least.pop()
                    when.pop()
                least.append(v)
                when.append(time)
                if keep:
                    buffer.append(entry)
                p = (entry >> _BITS) - 1
                if p >= 0 and wanted[p] == want:
                    to = text[p] if not falling else top - text[p]
                    before = last.get(to)
                    if before is None:
                        v = 0
                    else:
                        v = least[bisect_right(when, before)] + 1
                        if v > cap:
                            v = cap
                    last[to] = time
                    push(to, p << _BITS | v)
            if len(buffer) > _STEP:
                out[done : done + len(buffer)] = buffer
                done += len(buffer)
                buffer = []
        begin = end
    out[done : done + len(buffer)] = buffer
    return counts


def _types(text: np.ndarray, cap: int, small: np.ndarray, run: np.ndarray) -> None:
    """Of each suffix whether it is less than the next one, and how often its first symbol repeats; from the end, piece by piece."""
    after, rises, repeats = -1, True, 0  # the last symbol counts as a small suffix
    for s in reversed(list(pieces(len(text)))):
        t = np.asarray(text[s])
        cuts = np.flatnonzero(t[1:] != t[:-1]) + 1
        begin, end = np.r_[0, cuts], np.r_[cuts, len(t)]
        first = t[begin]
        same = first[-1] == after
        rising = np.r_[first[1:] > first[:-1], rises if same or after < 0 else after > first[-1]]
        left = np.repeat(end, end - begin) - np.arange(len(t))
        if same:
            left[begin[-1] :] += repeats
        small[s], run[s] = np.repeat(rising, end - begin), np.minimum(left, cap)
        after, rises, repeats = int(first[0]), bool(rising[0]), int(run[s.start])


def _stars(small: np.ndarray, folder: str | None) -> np.ndarray:
    """Places of the S* suffixes."""
    found = lambda s: np.flatnonzero((small[s] != 0) & (small[max(0, s.start - 1) : s.stop - 1] == 0 if s.start else np.r_[False, small[: s.stop - 1] == 0])) + s.start
    star = _array(folder, "star", sum(len(found(s)) for s in pieces(len(small))), np.int64)
    at = 0
    for s in pieces(len(small)):
        x = found(s)
        star[at : at + len(x)] = x
        at += len(x)
    return star


def _sorted_piece(text, small, star, end, idx: np.ndarray, step: int, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S* substrings that are equal in their first ``step`` symbols, in order; whether each differs from the one before, and in how many
    (symbol, type) pairs it agrees with that, the first one in ``shared``."""
    sym = lambda i, at: text[at].astype(np.int64) * 2 + (small[at] if step or i is None else 0)
    at = star[idx] + step
    key = text[at].astype(np.int64) if step == 0 else np.where(at <= end[idx], sym(0, np.minimum(at, end[idx])), -1)
    o = np.argsort(key, kind="stable")
    idx, key = idx[o], key[o]
    head = np.r_[True, key[1:] != key[:-1]]
    sep = np.where(head, step, 0)
    sep[0] = shared
    live = np.arange(len(idx))
    step += 1
    while True:
        group = np.cumsum(head) - 1
        size = np.bincount(group)
        live = live[size[group[live]] > 1]
        at = star[idx[live]] + step
        live, at = live[(k := at <= end[idx[live]])], at[k]
        if not len(live):
            return idx, head, sep
        value = text[at].astype(np.int64) * 2 + small[at]
        g = group[live]
        o = np.argsort(g << 33 | value, kind="stable")
        idx[live] = idx[live][o]
        value = value[o]
        new = np.r_[False, (value[1:] != value[:-1]) & (g[1:] == g[:-1])]
        head[live[new]] = True
        sep[live[new]] = step
        step += 1


def _names(text, small, star, room: int, folder: str | None, alphabet: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Name of each S* suffix by its substring, and for each name the (symbol, type) pairs shared with the name before (255 at most); their number.

    Ranges of first symbols, of second ones where a symbol alone has too many, and so on, are sorted one after another."""
    m = len(star)
    end = np.r_[star[1:], star[-1:]] if folder is None else _array(folder, "star-ends", m, np.int64)
    named, shared = _array(folder, "named", m, np.int32 if m < 1 << 31 else np.int64), _array(folder, "shared", m, np.uint8)
    if folder is not None:
        for s in pieces(m):
            end[s] = np.r_[star[s.start + 1 : s.stop + 1], star[-1:]][: s.stop - s.start]
    names = 0

    def write(idx: np.ndarray, step: int, sep: int) -> None:
        nonlocal names
        idx, head, seps = _sorted_piece(text, small, star, end, idx, step, sep)
        shared[names : names + int(head.sum())] = np.minimum(seps[head], 255)
        named[idx] = names + np.cumsum(head) - 1
        names += int(head.sum())

    def place(parts: Callable[[], Iterator[np.ndarray]], n: int, step: int, sep: int, label: str) -> None:
        """Write the names of those that agree in their first ``step`` symbols, ``sep`` being what the first shares with the name before."""
        if n <= room or folder is None:
            write(np.concatenate(list(parts())), step, sep)
            return
        size = alphabet if step == 0 else 2 * alphabet + 1

        def key(idx):
            at = star[idx] + step
            return text[at] if step == 0 else np.where(at <= end[idx], text[np.minimum(at, end[idx])].astype(np.int64) * 2 + small[np.minimum(at, end[idx])] + 1, 0)

        count = np.zeros(size, np.int64)
        for idx in parts():
            count += np.bincount(key(idx), minlength=size)
        if count.max() == n and step and key(next(parts())[:1])[0] == 0:  # their substrings have ended: all are one name
            shared[names_at()] = min(sep, 255)
            for idx in parts():
                named[idx] = names
            more()
            return
        # pieces of at most room, one of a single key where that has more
        piece = np.zeros(size, np.int64)
        total, number, alone = 0, 0, False
        for k in np.flatnonzero(count).tolist():
            if total and (total + count[k] > room or alone):
                total, number = 0, number + 1
            alone = count[k] > room
            total += int(count[k])
            piece[k] = number
        where = [f"{folder}/{label}-{i}" for i in range(number + 1)]
        for idx in parts():
            p = piece[key(idx)]
            for i in np.unique(p).tolist():
                with open(where[i], "ab") as f:
                    idx[p == i].astype(np.int64).tofile(f)
        for i, path in enumerate(where):
            own = np.flatnonzero((piece == i) & (count > 0))
            many = int(count[own].sum())

            def read(path=path):
                with open(path, "rb") as f:
                    while len(some := np.fromfile(f, np.int64, _STEP)):
                        yield some

            at = sep if i == 0 else step
            if len(own) == 1:
                place(read, many, step + 1, at, f"{label}-{i}")
            else:
                write(np.concatenate(list(read())), step, at)
            os.remove(path)

    def names_at() -> int:
        return names

    def more() -> None:
        nonlocal names
        names += 1

    place(lambda: (np.arange(s.start, s.stop) for s in pieces(m)), m, 0, 0, "piece")
    return named, shared[:names], names


class _Least:
    """Least value of any stretch of an array of bytes, by a table of the least of all stretches of a power of two."""

    def __init__(self, values: np.ndarray, folder: str | None):
        self.table = [values]
        while 2 << len(self.table) - 1 <= len(values):
            half, below = 1 << len(self.table) - 1, self.table[-1]
            level = _array(folder, f"least-{half}", len(below) - half, np.uint8)
            for s in pieces(len(level)):
                level[s] = np.minimum(below[s], below[s.start + half : s.stop + half])
            self.table.append(level)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(values[a + 1 : b + 1]) of each pair, a < b."""
        level = np.log2(np.maximum(b - a, 1)).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.table[k][a[m] + 1], self.table[k][b[m] + 1 - (1 << k)])
        return out


def packed_order(text: np.ndarray, cap: int, room: int, folder: str | None) -> np.ndarray:
    """:func:`suffix_order` as entries position << 6 | shared prefix, in a file where the text is longer than ``room``."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    disk = folder if n > room else None
    small, run = _array(disk, "types", n, np.uint8), _array(disk, "runs", n, np.uint8)
    _types(text, cap, small, run)
    star = _stars(small, disk)
    m = len(star)
    size = int(max(text[s].max() for s in pieces(n))) + 1
    # order and shared prefixes of the S* suffixes
    named, shared, names = _names(text, small, star, room, disk, size)
    sub = None
    if names < m:
        if disk:
            os.makedirs(sub := f"{folder}/names", exist_ok=True)
        order = packed_order(named, cap, room, sub)
    else:
        order = _array(disk, "star-order", m, np.int64)
        for s in pieces(m):  # all names differ: the order is theirs, falling as that of the recursion
            order[m - 1 - named[s].astype(np.int64)] = np.arange(s.start, s.stop) << _BITS
    seeds = _array(disk, "seeds", m, np.int64)
    seed_counts = np.zeros(size, np.int64)
    least = _Least(shared, disk)
    for s in pieces(m):  # entries position << 6 | shared prefix of the S* suffixes, rising
        i = np.arange(s.start, s.stop)
        here, k = order[m - 1 - i] >> _BITS, np.where(i > 0, order[np.minimum(m - i, m - 1)] & _LOW, 0)
        before = np.where(i > 0, order[np.minimum(m - i, m - 1)] >> _BITS, here)
        full = k >= cap
        ii, jj = np.minimum(before + k, m - 1), np.minimum(here + k, m - 1)
        a, b = named[ii].astype(np.int64), named[jj].astype(np.int64)
        off = star[ii] - star[before]
        ok = ~full & (a < b)
        off[ok] += least.between(a[ok], b[ok])
        x, y = np.minimum(star[before] + off, n - 1), np.minimum(star[here] + off, n - 1)
        off += np.where((text[x] == text[y]) & ~full, np.minimum(run[x], run[y]), 0)
        lcp = np.where(i > 0, np.where(full, cap, np.minimum(off, cap)), 0)
        seeds[s] = star[here] << _BITS | lcp
        seed_counts += np.bincount(text[star[here]], minlength=size)
    counts = _counted(text, size)
    flat, ones, runs = (memoryview(x) if disk else x.tolist() for x in (text, small, run))

    def queue(order_counts: np.ndarray, name: str) -> RisingQueue:
        where = None
        if disk:
            os.makedirs(where := f"{folder}/{name}", exist_ok=True)
        return RisingQueue(order_counts, room, where)

    large = n - sum(int(small[s].sum(dtype=np.int64)) for s in pieces(n))
    found = _array(disk, "large", large, np.int64)
    per = _sweep(flat, ones, 0, runs, lambda a, b: seeds[a:b].tolist(), np.cumsum(seed_counts), False, cap, queue(counts, "rising"), found, False)

    def fallen(a: int, b: int) -> list[int]:
        """The large suffixes from the greatest on, each with the prefix shared with the one before."""
        here = found[large - b : large - a][::-1] >> _BITS
        v = np.r_[0, found[large - b + 1 :][::-1] & _LOW] if a == 0 and b > 1 else found[large - b + 1 : large - a + 1][::-1] & _LOW if a else np.zeros(1, np.int64)
        return (here << _BITS | v).tolist()

    falling = queue(counts[::-1], "falling")
    falling.push(size - 1, (n - 1) << _BITS)
    out = _array(disk, "order", n, np.int64)
    _sweep(flat, ones, 1, runs, fallen, np.cumsum(per[::-1]), True, cap, falling, out, True)
    return out


def suffix_order(text: np.ndarray, cap: int = 50, room: int = 1 << 24, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in falling order, and of each the prefix shared with the one before, at most ``cap`` (up to 62).

    ``text``: symbols 0..k, each of which occurs; the last one is 0 and the only 0. ``room``: entries held in memory; where the text is
    longer, ``folder`` must be given and gets files that the caller deletes.
    """
    out = packed_order(text, cap, room, folder)
    return out >> _BITS, out & _LOW
