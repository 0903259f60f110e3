"""Minimal acyclic transducers from sorted keys to their ordinals, as NumPy arrays.

``build`` adds the keys one by one in byte order and freezes every state that
no later key can reach, so that equal states are one.  A transition carries
the number of keys that come before all keys through it; the sum along a path
is the key's ordinal.  ``join`` puts transducers of consecutive key ranges
together.  ``Transducer`` walks many words at once, one byte of each a round,
and finds the key of an ordinal again.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def pack(final: np.ndarray, first: np.ndarray, label: np.ndarray, to: np.ndarray) -> bytes:
    """States and transitions as bytes; the root is the last state."""
    head = np.array([len(final), len(label)], np.int64)
    return b"".join(x.tobytes() for x in (head, final.astype(np.uint8), label.astype(np.uint8), first.astype(np.int32), to.astype(np.int32)))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    states, arcs = np.frombuffer(blob, np.int64, 2).tolist()
    final = np.frombuffer(blob, np.uint8, states, 16).astype(bool)
    label = np.frombuffer(blob, np.uint8, arcs, 16 + states)
    rest = np.frombuffer(blob[16 + states + arcs:], np.int32)
    return final, rest[:states + 1], label, rest[states + 1:]


def build(keys: Iterable[bytes]) -> bytes:
    """Packed minimal transducer of distinct keys in byte order."""
    register: dict[tuple, int] = {}
    open_: list[tuple[list, list]] = [([False], [])]
    last = b""

    def freeze(depth: int) -> None:
        while len(open_) > depth + 1:
            final, arcs = open_.pop()
            state = register.setdefault((final[0], *arcs), len(register))
            open_[-1][1].append((last[len(open_) - 1], state))

    for key in keys:
        common, most = 0, min(len(key), len(last))
        while common < most and key[common] == last[common]:
            common += 1
        freeze(common)
        open_.extend(([False], []) for _ in range(len(key) - common))
        open_[-1][0][0] = True
        last = key
    freeze(0)
    # the root is appended, never shared, so that it is the last state
    states = [*register, (open_[0][0][0], *open_[0][1])]
    arcs = [a for s in states for a in s[1:]]
    first = np.cumsum([0] + [len(s) - 1 for s in states])
    return pack(np.array([s[0] for s in states], bool), first, np.array([a[0] for a in arcs], np.uint8), np.array([a[1] for a in arcs], np.int32))


def counts(final: np.ndarray, first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Keys that end at or below each state; children have smaller numbers."""
    out, ends, arcs = final.astype(np.int64).tolist(), first.tolist(), to.tolist()
    for s in range(len(out)):
        for t in arcs[ends[s]:ends[s + 1]]:
            out[s] += out[t]
    return np.array(out, np.int64)


def join(blobs: list[bytes]) -> "Transducer":
    """One transducer of several whose keys follow each other; only states along the seams are new."""
    parts = [unpack(b) for b in blobs]
    final = np.concatenate([p[0] for p in parts])
    sizes = [len(p[0]) for p in parts]
    at = np.cumsum([0] + sizes)
    n_arcs = np.cumsum([0] + [len(p[2]) for p in parts])
    first = np.concatenate([[0], *[p[1][1:] + n for p, n in zip(parts, n_arcs)]])
    label = np.concatenate([p[2] for p in parts])
    to = np.concatenate([p[3] + n for p, n in zip(parts, at)])
    below = np.concatenate([counts(p[0], p[1], p[3]) for p in parts])
    out = _outputs(final, first, to, below)
    # seams: states of several parts that the same prefix leads to become one new state
    new: list[tuple[bool, list]] = []
    start, todo = _number([int(e) - 1 for e in at[1:]], len(final), new)
    while todo:
        number, members = todo.pop()
        arcs: dict[int, list[int]] = {}
        for m in members:
            for a in range(first[m], first[m + 1]):
                arcs.setdefault(int(label[a]), []).append(int(to[a]))
        ends_here = bool(final[members].any())
        run, rows = int(ends_here), []
        for mark, children in arcs.items():
            target, more = _number(children, len(final), new)
            todo += more
            rows.append((mark, target, run))
            run += int(below[children].sum())
        new[number - len(final)] = (ends_here, rows)
    arcs = [a for _, rows in new for a in rows]
    first = np.concatenate([first, first[-1] + np.cumsum([len(rows) for _, rows in new])]) if new else first
    columns = [np.array([a[i] for a in arcs], np.int64) for i in range(3)]
    return Transducer(np.concatenate([final, [f for f, _ in new]]).astype(bool), first, np.concatenate([label, columns[0]]),
                      np.concatenate([to, columns[1]]), np.concatenate([out, columns[2]]), start, int(sum(below[e - 1] for e in at[1:])))


def _number(states: list[int], base: int, new: list) -> tuple[int, list]:
    """The state itself, or the number of a new one for several, with what is left to do for it."""
    if len(states) == 1:
        return states[0], []
    new.append((False, []))
    return base + len(new) - 1, [(base + len(new) - 1, states)]


def _outputs(final: np.ndarray, first: np.ndarray, to: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Per transition: keys of its state that come before those through it."""
    own = np.repeat(np.arange(len(final)), np.diff(first))
    total = np.concatenate([[0], np.cumsum(below[to])])
    return total[:-1] - total[first[own]] + final[own]


class Transducer:
    """Transitions found by a bitmap of each state's labels: a set bit's rank is the transition's place."""

    def __init__(self, final, first, label, to, out, start: int, size: int):
        self.final, self.start, self.size = final, start, size
        self.first, self.label, self.to, self.out = first.astype(np.int64), label.astype(np.uint8), to.astype(np.int32), out.astype(np.int64)
        own = np.repeat(np.arange(len(final)), np.diff(first))
        cell = own * 4 + (self.label >> 6)
        self.bits = np.zeros(4 * len(final), np.uint64)
        np.bitwise_or.at(self.bits, cell, np.uint64(1) << (self.label & 63).astype(np.uint64))
        per_cell = np.bincount(cell, minlength=4 * len(final))
        self.place = np.cumsum(per_cell) - per_cell

    def walk(self, word: bytes) -> tuple[int, int]:
        """State and ordinal behind a prefix; state -1 where no key begins so."""
        s, o = self.start, 0
        for b in word:
            lo, hi = self.first[s], self.first[s + 1]
            a = lo + np.searchsorted(self.label[lo:hi], b)
            if a == hi or self.label[a] != b:
                return -1, 0
            s, o = int(self.to[a]), o + int(self.out[a])
        return s, o

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words data[start:end] are keys behind their given states, and their ordinals."""
        live = np.flatnonzero(state >= 0)
        s, o, at, end = state[live].astype(np.int64), ordinal[live], starts[live], ends[live]
        words, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(live):
            done = at == end
            if done.any():
                hit = np.flatnonzero(done & self.final[s])
                words.append(live[hit])
                found.append(o[hit])
                go = np.flatnonzero(~done)
                live, s, o, at, end = live[go], s[go], o[go], at[go], end[go]
            b = data[at]
            cell = s * 4 + (b >> 6)
            bits, shift = self.bits[cell], (b & 63).astype(np.uint64)
            go = np.flatnonzero((bits >> shift) & np.uint64(1))
            live, o, at, end, cell, bits, shift = live[go], o[go], at[go], end[go], cell[go], bits[go], shift[go]
            arc = self.place[cell] + np.bitwise_count(bits & ((np.uint64(1) << shift) - np.uint64(1)))
            s, o, at = self.to[arc].astype(np.int64), o + self.out[arc], at + 1
        return np.concatenate(words), np.concatenate(found)

    def key(self, ordinal: int) -> bytes:
        """The key of an ordinal below ``size``."""
        s, out = self.start, bytearray()
        while not (self.final[s] and ordinal == 0):
            lo, hi = self.first[s], self.first[s + 1]
            # the last transition whose output is not beyond the ordinal
            a = lo + int(np.searchsorted(self.out[lo:hi], ordinal, "right")) - 1
            out.append(int(self.label[a]))
            ordinal -= int(self.out[a])
            s = int(self.to[a])
        return bytes(out)
