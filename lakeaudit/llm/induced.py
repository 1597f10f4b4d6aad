"""External induced sorting of the suffixes of one shard.

Suffixes are of type S (smaller than the next one) or L. The S suffixes behind an L
suffix are sorted as tuples of their characters up to the next such one, named, and
the string of names is sorted by recursion. From their order all L suffixes are induced in
ascending, then all S suffixes in descending order: whoever leaves the priority queue
puts the position before it in.

The queue is monotone and works in batches: it gives out the longest run of tuples of
which none can be overtaken by what earlier ones of the run put in. Tuples for later
ranges of the alphabet wait in arrival order, in memory or in files of a given folder.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs

#: Tuples a queue holds in memory; what is beyond goes to files.
IN_MEMORY = 1 << 23
_RANGES = 1_024


class Queue:
    """Tuples by range of the alphabet, in arrival order, on disk beyond ``most``."""

    def __init__(self, ranges: int, folder: str, most: int):
        self.parts: list[list] = [[] for _ in range(ranges)]
        self.folder, self.most, self.held, self.place = folder, most, 0, None

    def push(self, ranges: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranges, kind="stable")
        ranges, positions = ranges[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        for r, part in zip(ranges[np.concatenate(([0], cuts))] if len(ranges) else [], np.split(positions, cuts)):
            self.parts[r].append(part)
        self.held += len(positions)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.place is None:
            self.place = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or ":/" in self.folder else (fs.LocalFileSystem(), self.folder)
            self.path = f"{self.place[1]}/{uuid.uuid4().hex}"
            self.place[0].create_dir(self.path, recursive=True)
        for r, parts in enumerate(self.parts):
            held = [p for p in parts if isinstance(p, np.ndarray)]
            if held:
                name = f"{self.path}/{r}-{len(parts)}-{uuid.uuid4().hex}"
                with self.place[0].open_output_stream(name) as out:
                    out.write(np.concatenate(held).tobytes())
                self.parts[r] = [p for p in parts if isinstance(p, str)] + [name]
        self.held = 0

    def pop(self, r: int) -> np.ndarray:
        out = []
        for p in self.parts[r]:
            if isinstance(p, str):
                with self.place[0].open_input_stream(p) as f:
                    out.append(np.frombuffer(f.read(), np.int32))
                self.place[0].delete_file(p)
            else:
                out.append(p)
                self.held -= len(p)
        self.parts[r] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def close(self) -> None:
        if self.place is not None:
            self.place[0].delete_dir(self.path)


def _induced(text: np.ndarray, size: int, wanted: np.ndarray, seeds: np.ndarray, folder: str, most: int) -> np.ndarray:
    """The ``wanted`` positions in order, from ``seeds`` in order; text holds numbers below ``size``."""
    most_ranges = min(_RANGES, max(16, len(text) // 2_000))
    shift = max(0, int(size - 1).bit_length() - most_ranges.bit_length() + 1)
    ranges = ((size - 1) >> shift) + 1
    queue = Queue(ranges, folder, most)
    seed_cuts = np.searchsorted(text[seeds] >> shift, np.arange(ranges + 1))
    out = []
    for r in range(ranges):
        own = seeds[seed_cuts[r] : seed_cuts[r + 1]]
        came = queue.pop(r)
        at = np.concatenate((came, own))
        key = np.concatenate((2 * text[came], 2 * text[own] + 1))
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        while len(at):
            before = at - 1
            good = (at > 0) & wanted[before]
            put = np.where(good, text[before], size)
            least = np.minimum.accumulate(put)
            late = key[1:] > 2 * least[:-1]
            n = int(np.argmax(late)) + 1 if late.any() else len(at)
            out.append(at[:n][key[:n] & 1 == 0])
            new, place = before[:n][good[:n]], put[:n][good[:n]]
            here = (place >> shift) == r
            queue.push((place >> shift)[~here], new[~here])
            at, key = np.concatenate((at[n:], new[here])), np.concatenate((key[n:], 2 * place[here]))
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
    queue.close()
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _sorted_stars(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars in the order of their substrings up to the next star, and which differ from the one before.

    A character counts together with its type, L first; so no substring begins another one,
    and as many characters as fit into a 64-bit tuple are compared at a time.
    """
    bits = int(2 * text.max() + 2).bit_length()
    each = 62 // bits
    length = np.append(np.diff(stars) + 1, 1)

    def tuples(which: np.ndarray, word: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        for k in range(word * each, (word + 1) * each):
            at = np.minimum(stars[which] + k, len(text) - 1)
            out = (out << bits) | np.where(k < length[which], 2 * text[at].astype(np.int64) + is_s[at] + 1, 0)
        return out

    everyone = np.arange(len(stars))
    first = tuples(everyone, 0)
    order = np.argsort(first)
    new = np.append(True, np.diff(first[order]) != 0)
    rank = np.empty(len(stars), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, everyone, 0))
    word = 0
    while True:
        word += 1
        open_ = np.flatnonzero((length > word * each) & (np.bincount(rank, minlength=len(stars))[rank] > 1))
        if not len(open_):
            break
        value = tuples(open_, word)
        order = np.lexsort((value, rank[open_]))
        open_, value = open_[order], value[order]
        here = np.arange(len(open_))
        group = np.append(True, np.diff(rank[open_]) != 0)
        part = group | np.append(True, np.diff(value) != 0)
        rank[open_] += np.maximum.accumulate(np.where(part, here, 0)) - np.maximum.accumulate(np.where(group, here, 0))
    order = np.argsort(rank, kind="stable")
    return stars[order], np.append(True, np.diff(rank[order]) != 0)


def suffix_array(text: np.ndarray, folder: str, most: int = IN_MEMORY) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes.

    ``text`` is of 32-bit numbers from 0, of which the last is the only 0. ``folder``
    is where queues keep what exceeds ``most`` tuples in memory.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    size = int(text.max()) + 1
    at = np.arange(n - 1, dtype=np.int32)
    unlike = text[:-1] != text[1:]
    step = np.minimum.accumulate(np.where(unlike, at, n)[::-1])[::-1]
    is_s = np.append(text[step] < text[step + 1], True)
    stars = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    del at, unlike, step
    order, new = _sorted_stars(text, is_s, stars)
    if not new.all():
        named = np.zeros(n, np.int32)
        named[order] = np.cumsum(new) - 1
        order = stars[suffix_array(named[stars], folder, most)]
    large = _induced(text, size, ~is_s, order, folder, most)
    small = _induced(size - 1 - text, size, is_s, large[::-1], folder, most)[::-1]
    everything = np.concatenate((large, np.array([n - 1], np.int32), small))
    return everything[np.argsort(2 * text[everything] + is_s[everything], kind="stable")]
