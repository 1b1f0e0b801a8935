"""External suffix sorting by recursive induction, with common prefixes.

A suffix is of type S if it is less than the next one, else of type L; those of
type S after one of type L ("LMS") are seeds. The stretches between seeds get
names in their order; unless all differ, the text of names is sorted by the
same routine, one level down; a text of SMALL names or less is sorted in memory by doubling
ranks. Two sweeps then induce all suffixes: the first
meets suffixes in ascending order and sends the one before each, if of type L,
to a priority queue under its first symbol; the second does the same in
descending order for type S.

Tuples in the queues are (first symbol, place, common prefix). A suffix's common
prefix with the one before it in its bucket is one more than the least common
prefix met between the two suffixes that sent them, so the sweeps carry common
prefixes along and never compare texts; seeds bring theirs from the level below.

A queue keeps tuples by groups of symbols, each in the order of their coming.
All queues and lists of a sort have HELD tuples in memory at most, the rest is in
one unnamed file; groups of one symbol are read in blocks, others are small
enough to be put in order when their turn comes. Arrays over a whole text are
mapped from unnamed files beyond MAPPED bytes. So what is in memory at a time is
bounded by HELD and does not grow with the text, but for one number a symbol.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Tuples that the queues and lists of a sort hold in memory, and tuples read at a time.
HELD, BLOCK = 1 << 19, 1 << 16
#: Names that are sorted in memory, where the recursion ends.
SMALL = 1 << 20
#: Bytes beyond which an array over a text is mapped from a file.
MAPPED = 1 << 25
FAR = (1 << 31) - 1


def array(n: int, dtype) -> np.ndarray:
    if n * np.dtype(dtype).itemsize <= MAPPED:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:  # has no name: nothing stays, whatever happens
        return np.memmap(f, dtype, "w+", shape=(n,))


class Disk:
    """Where lists of tuples go once there are over HELD in memory. The file starts anew whenever all of it has been read."""

    def __init__(self):
        self.file, self.end, self.held, self.there, self.lists, self.spills = None, 0, 0, 0, [], 0

    def hold(self, n: int) -> None:
        self.held += n
        if self.held <= HELD:
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        if not self.there:
            self.end = 0
        self.file.seek(self.end)
        for x in self.lists:
            for i, part in enumerate(x.parts):
                if isinstance(part, np.ndarray):
                    self.file.write(np.ascontiguousarray(part))
                    x.parts[i] = (self.end, part.shape)
                    self.end += part.nbytes
                    self.there += part.nbytes
        self.held = 0
        self.spills += 1

    def read(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            self.held -= part.shape[1]
            return part
        self.file.seek(part[0])
        raw = self.file.read(4 * part[1][0] * part[1][1])
        self.there -= len(raw)
        return np.frombuffer(raw, np.int32).reshape(part[1])


class Tuples:
    """Rows of 32-bit numbers in the order of their coming, taken from either end in parts."""

    def __init__(self, disk: Disk):
        self.disk, self.parts = disk, deque()
        disk.lists.append(self)

    def add(self, *columns: np.ndarray) -> None:
        for a in range(0, len(columns[0]), BLOCK):
            self.parts.append(np.stack([c[a : a + BLOCK] for c in columns]).astype(np.int32))
            self.disk.hold(self.parts[-1].shape[1])

    def take(self, last: bool = False) -> np.ndarray | None:
        """The next BLOCK tuples or so, in the order of their coming; the last ones if `last`."""
        got, n = [], 0
        while self.parts and n < BLOCK:
            got.append(self.disk.read(self.parts.pop() if last else self.parts.popleft()))
            n += got[-1].shape[1]
        return np.concatenate(got[::-1] if last else got, 1).astype(np.int64) if got else None

    def drain(self, last: bool = False) -> Iterator[np.ndarray]:
        while (x := self.take(last)) is not None:
            yield x

    def all(self, width: int) -> np.ndarray:
        return np.concatenate([np.zeros((width, 0), np.int64), *self.drain()], 1)


class Queue:
    """Tuples by first symbol, then by their coming. counts: how many of each symbol will come."""

    def __init__(self, counts: np.ndarray, disk: Disk):
        share = max(1, HELD // 8)
        group = np.cumsum(counts) // share  # symbols of one share; one of many tuples starts a group
        new = np.ones(len(counts), bool)
        new[1:] = (group[1:] != group[:-1]) | (counts[1:] > share) | (counts[:-1] > share)
        self.first = np.append(np.flatnonzero(new), len(counts))
        self.groups = [Tuples(disk) for _ in self.first[1:]]
        self.now, self.ready, self.late = -1, None, []

    def end(self, c: int) -> int:
        """The symbol after the last of c's group."""
        return int(self.first[np.searchsorted(self.first, c, "right")])

    def push(self, symbol: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        """symbol is sorted."""
        g = np.searchsorted(self.first, symbol, "right") - 1
        cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < z:
                part = symbol[a:z], place[a:z], common[a:z]
                if self.ready is not None and g[a] == self.now:
                    self.late.append(np.stack(part))
                else:
                    self.groups[g[a]].add(*part)

    def pop(self, c: int, end: int) -> np.ndarray | None:
        """Tuples of the symbols from c to before end, in order; those of one symbol alone come in parts."""
        g = int(np.searchsorted(self.first, c, "right")) - 1
        if self.first[g + 1] - self.first[g] == 1:
            return self.groups[g].take()
        if g != self.now:
            x = self.groups[g].all(3)
            self.now, self.ready, self.late = g, x[:, np.argsort(x[0], kind="stable")], []
        cut = int(np.searchsorted(self.ready[0], end))
        parts, self.ready = [self.ready[:, :cut]], self.ready[:, cut:]
        for i, x in enumerate(self.late):
            hit = x[0] < end
            parts.append(x[:, hit])
            self.late[i] = x[:, ~hit]
        self.late = [np.concatenate(self.late, 1)] if self.late else []
        x = np.concatenate(parts, 1)
        return x[:, np.argsort(x[0], kind="stable")] if x.shape[1] else None


def least_between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of x[lo..hi], both included."""
    out = x[hi]
    span = hi - lo + 1
    size = 1
    while True:
        fit = np.flatnonzero((span >= size) & (span < 2 * size))
        out[fit] = np.minimum(x[lo[fit]], x[hi[fit] - size + 1])
        if 2 * size > int(span.max(initial=0)):
            return out
        x = np.minimum(x[:-size], x[size:])
        size *= 2


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S."""
    n = len(text)
    small = array(n, bool)
    small[-1] = True
    step = max(2, MAPPED >> 5)
    for z in range(n - 1, 0, -step):
        a = max(0, z - step)
        x = np.asarray(text[a : z + 1])
        differ = np.append(np.flatnonzero(x[1:] != x[:-1]), z - a)
        less = np.append(x[:-1] < x[1:], small[z])
        small[a:z] = less[differ[np.searchsorted(differ, np.arange(z - a))]]
    return small


def _run(text: np.ndarray, at: int) -> int:
    """How often the symbol at a place comes in a row."""
    n = 1
    while text[at + n] == text[at]:
        n += 1
    return n


def _sweep(text: np.ndarray, small: np.ndarray, size: int, down: bool, seeds: Iterator[np.ndarray], disk: Disk):
    """Yields (places, common prefixes with the one before, whether they are seeds) of all suffixes met.

    seeds: parts of (place, common prefix with the seed before), in the order of
    the sweep. On the way up they are the LMS suffixes, and those of type L are
    induced; on the way down they are those of type L, and type S is induced.
    """
    symbol = (lambda at: size - 1 - text[at].astype(np.int64)) if down else (lambda at: text[at].astype(np.int64))
    reach, counts = np.full(size, size, np.int64), np.zeros(size, np.int64)
    for a in range(1, len(text), MAPPED >> 5):
        at = np.flatnonzero(small[a - 1 : a - 1 + (MAPPED >> 5)][: len(text) - a] == down) + a
        before = symbol(at - 1)
        np.minimum.at(reach, symbol(at), before)
        counts += np.bincount(before, minlength=size)
    queue, since = Queue(counts, disk), np.full(size, FAR, np.int64)
    seeds = (x for x in seeds if x.shape[1])
    held = next(seeds, None)

    def send(at, common, own, is_seed):
        nonlocal since
        before = at - 1
        to = symbol(before)  # the first place's is the end mark's, which is never more
        hit = np.flatnonzero((at > 0) & ((to > own) | ((to == own) & ~is_seed)))
        rest = common.min()
        if len(hit):
            hit = hit[np.argsort(to[hit], kind="stable")]
            to = to[hit]
            new = np.ones(len(hit), bool)
            new[1:] = to[1:] != to[:-1]
            since_start = np.minimum.accumulate(common)
            least = np.minimum(since[to], since_start[hit])
            again = np.flatnonzero(~new)
            least[again] = least_between(common, hit[again - 1] + 1, hit[again])
            queue.push(to, before[hit], np.minimum(least, FAR - 1) + 1)
        np.minimum(since, rest, out=since)
        if len(hit):
            end = np.append(new[1:], True)
            after = np.append(np.minimum.accumulate(common[::-1])[::-1], FAR)
            since[to[end]] = after[hit[end] + 1]

    def seeds_before(end):
        nonlocal held
        while held is not None:
            own = symbol(held[0])
            cut = int(np.searchsorted(own, end))
            if cut:
                yield held[:, :cut], own[:cut]
            if cut < len(own):
                held = held[:, cut:]
                return
            held = next(seeds, None)

    c = 0
    while c < size:
        ahead = np.minimum.accumulate(reach[c : min(queue.end(c), c + BLOCK)])
        free = ahead > np.arange(c, c + len(ahead))  # none of the symbols so far sends to another of them
        many = len(free) if free.all() else int(np.argmin(free))
        if many > 1:
            end = c + many
            parts = [(x[1], x[2], x[0], False) for x in [queue.pop(c, end)] if x is not None]
            parts += [(x[0], x[1], own, True) for x, own in seeds_before(end)]
            if parts:
                at, common, own = (np.concatenate([p[i] for p in parts]) for i in range(3))
                is_seed = np.repeat([p[3] for p in parts], [len(p[0]) for p in parts])
                order = np.argsort(own, kind="stable")  # seeds are after the others of a symbol
                at, common, own, is_seed = at[order], common[order].copy(), own[order], is_seed[order]
                common[1:][is_seed[1:] & ~is_seed[:-1]] = 1  # no induced suffix here has its symbol twice
                common[0] = 0
                common[1:][own[1:] != own[:-1]] = 0
                yield at, common, is_seed
                send(at, common, own, is_seed)
        else:
            end, last = c + 1, -1
            while (x := queue.pop(c, end)) is not None:
                at, common = x[1], x[2].copy()
                if last < 0:
                    common[0] = 0
                last = int(at[-1])
                none = np.zeros(len(at), bool)
                yield at, common, none
                send(at, common, x[0], none)
            start = True
            for x, own in seeds_before(end):
                at, common = x[0], x[1].copy()
                if start:
                    common[0] = min(_run(text, last), _run(text, int(at[0]))) if last >= 0 else 0
                start = False
                every = np.ones(len(at), bool)
                yield at, common, every
                send(at, common, own, every)
        c = end


def _names(text: np.ndarray, lms: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """A name for the stretch from each seed to the next one, in their order; an end is more than any symbol."""
    bits = int(size + 1).bit_length()
    lane = 62 // bits
    length = np.append(np.diff(lms) + 1, 1)
    name, count = np.zeros(len(lms), np.int64), 1
    live, off = np.arange(len(lms)), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for j in range(off, off + lane):
            inside = length[live] > j
            at = np.minimum(lms[live] + j, len(text) - 1)
            key = (key << bits) | np.where(inside, text[at], size + 1)
        # names so far stay in order: those of stretches that are at their end take one number
        order = np.lexsort((key, name[live]))
        n, k = name[live][order], key[order]
        new = np.ones(len(live), bool)
        new[1:] = (n[1:] != n[:-1]) | (k[1:] != k[:-1])
        fresh = np.empty(len(live), np.int64)
        fresh[order] = np.cumsum(new)
        # a name that was one number becomes as many as it has different keys
        kinds = np.ones(count, np.int64)
        first = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        kinds[n[first]] = np.add.reduceat(new.astype(np.int64), first)
        base = np.cumsum(kinds) - kinds
        within = np.empty(len(live), np.int64)
        within[order] = np.cumsum(new) - np.repeat(np.cumsum(new)[first], np.diff(np.append(first, len(n))))
        name = base[name]
        name[live] += within
        count = int(kinds.sum())
        off += lane
        alone = np.bincount(name, minlength=count)[name[live]] == 1
        live = live[(length[live] >= off) & ~alone]  # an end is seen in the round after it
    return name, count


def _in_memory(name: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a short text in order, and how many names each has in common with the one before."""
    n = len(name)
    size = np.bincount(name, minlength=count)
    rank = (np.cumsum(size) - size)[name]  # of the first of its equals
    steps, h = [], 1
    live = np.flatnonzero(size[name] > 1)
    while len(live):
        steps.append((h, rank.copy()))
        after = live + h
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((nxt, rank[live]))
        r, x = rank[live][order], nxt[order]
        group = np.ones(len(live), bool)
        group[1:] = r[1:] != r[:-1]
        new = group.copy()
        new[1:] |= x[1:] != x[:-1]
        at, first = np.arange(len(live)), np.flatnonzero(new)
        which = np.cumsum(new) - 1
        fresh = r + at[first][which] - at[group][np.cumsum(group) - 1]
        rank[live[order]] = fresh
        live = np.sort(live[order][np.diff(np.append(first, len(live)))[which] > 1])
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    same = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for h, r in reversed(steps):  # at a step, equal ranks are h names in common
        a, b = order[live] + same[live], order[live - 1] + same[live]
        inside = (a < n) & (b < n)
        both = inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        same[live[both]] += h
    return order, same


def _seeds(text: np.ndarray, small: np.ndarray, size: int, disk: Disk) -> Tuples:
    """The LMS suffixes in order, with their common prefixes."""
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    name, count = _names(text, lms, size)
    if len(name) <= SMALL or count == len(name):
        order, same = _in_memory(name, count)
    else:  # they come from the greatest to the least, each with what it shares with the greater one
        parts = [(at[::-1], common[::-1]) for at, common in _descending(name, count, disk)][::-1]
        order, same = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        same = np.append(0, same[:-1])
    out = Tuples(disk)
    for a in range(0, len(order), BLOCK):
        o, q = order[a : a + BLOCK], same[a : a + BLOCK]
        p = np.append(order[a - 1] if a else o[0], o[:-1])
        x, y = lms[np.minimum(o + q, len(lms) - 1)], lms[np.minimum(p + q, len(lms) - 1)]
        common = x - lms[o]  # whole stretches, then symbol by symbol in the first that differs
        live = np.flatnonzero(x != y)
        while len(live):
            live = live[text[x[live]] == text[y[live]]]
            common[live] += 1
            x[live] += 1
            y[live] += 1
        if not a:
            common[0] = 0
        out.add(lms[o], common)
    return out


def _descending(text: np.ndarray, size: int, disk: Disk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of (places, common prefixes with the next greater suffix), from the greatest to the least.

    The text has under 2^31 symbols, all under size, and ends with its only 0.
    """
    if len(text) < 2:
        yield np.zeros(1, np.int64)[: len(text)], np.zeros(1, np.int64)[: len(text)]
        return
    small = _types(text)
    seeds = _seeds(text, small, size, disk)
    low = Tuples(disk)
    for at, common, is_seed in _sweep(text, small, size, False, seeds.drain(), disk):
        low.add(at[~is_seed], common[~is_seed])

    def from_above():
        above = 0  # what the part before shares with the last of this one
        for x in low.drain(last=True):
            yield np.stack([x[0][::-1], np.append(above, x[1][:0:-1])])
            above = x[1][0]

    end = False
    for at, common, _ in _sweep(text, small, size, True, from_above(), disk):
        end |= bool((at == len(text) - 1).any())
        yield at, common
    if not end:  # nothing sends the end mark
        yield np.array([len(text) - 1]), np.zeros(1, np.int64)


def suffixes(buf: np.ndarray, offs: np.ndarray, disk: Disk | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of (places in buf, common prefixes with the suffix before), from the greatest suffix to the least.

    buf has strings back to back with bounds offs; each is closed by a mark that
    is less than any byte, so what is longer than a string's rest tells nothing.
    """
    n = len(offs) - 1
    text = array(len(buf) + n + 1, np.int16)
    for a in range(0, n, BLOCK):
        z = min(n, a + BLOCK)
        cut = offs[a : z + 1] - offs[a]
        part = np.ones(int(cut[-1]) + z - a, np.int16)
        part[np.arange(cut[-1]) + np.repeat(np.arange(z - a), np.diff(cut))] = buf[offs[a] : offs[z]].astype(np.int16) + 2
        text[offs[a] + a : offs[z] + z] = part
    marks = offs[1:] + np.arange(n)  # places of the closing marks in the text
    least = FAR
    for at, common in _descending(text, 258, disk or Disk()):
        string = np.searchsorted(marks, at)
        real = (at < len(text) - 1) & (marks[np.minimum(string, n - 1)] != at)
        low = np.minimum.accumulate(common)
        if real.any():
            # a place's common prefix with the last real one before it, over marks in between
            keep = np.flatnonzero(real)
            c = least_between(common, np.append(0, keep[:-1] + 1), keep)
            c[0] = min(c[0], least)
            yield (at - string)[keep], c
            least = common[keep[-1] + 1 :].min(initial=FAR)
        else:
            least = min(least, low[-1])
