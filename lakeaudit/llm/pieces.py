"""Cutting texts where a byte-level BPE tokenizer always cuts, and encoding the pieces.

The pre-tokenizer's pattern never joins a letter to a following ASCII punctuation
mark (but an apostrophe) nor anything but blanks to a following blank, whatever
stands before or behind. Cut where such a place follows a character of Latin-1, and around added tokens, a text's
pieces encode to what the whole text encodes to, one after the other. The places
are sets of fixed characters, so no Unicode version of any library matters.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII that is no blank, Latin letters, ASCII marks without the apostrophe.
# All are of the first 256 characters, for which regex engines keep bit sets.
_SEEN = r"!-~\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_MARK = r"!-&(-/:-@\[-`{-~"
# The character ahead is looked at first: it rules most places out.
CUT = rf"(?=[ \t\n\r{_MARK}])(?:(?=[ \t\n\r])(?<=[{_SEEN}])|(?<=[{_LETTER}])(?=[{_MARK}]))"
_KEPT = 300_000
_AT_ONCE = 10_000
_JOINED = 250


def default_path() -> str:
    """The public byte-level BPE file of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def pieces(text: Column, added: list[str]) -> Column:
    """The pieces of a text in order, as an array without empty strings; null text: none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if not added:
        return F.array_remove(F.split(text, CUT, -1), "")
    names = "|".join(rf"\Q{a}\E" for a in added)
    parts = F.split(text, rf"(?={names})|(?<={names})", -1)
    cut = lambda p: F.when(p.isin(added), F.array(p)).otherwise(F.split(p, CUT, -1))
    return F.array_remove(F.when(text.rlike(names), F.flatten(F.transform(parts, cut))).otherwise(F.split(text, CUT, -1)), "")


def cut(text: str, added: list[str]) -> list[str]:
    """``pieces`` of one string."""
    parts = re.split("(" + "|".join(map(re.escape, added)) + ")", text) if added else [text]
    return [p for part in parts for p in ([part] if part in added else re.split(CUT, part)) if p]


def _byte_kinds() -> np.ndarray:
    """For each byte of UTF-8: 1 a blank, 2 a mark, 4 ends a seen character, 8 ends a letter, 16 leads and 32 ends a Latin letter of two bytes."""
    out = np.zeros(256, np.uint8)
    for c in map(chr, range(128)):
        out[ord(c)] = (c in " \t\n\r") | bool(re.match(f"[{_MARK}]", c)) << 1 | bool(re.match(f"[{_SEEN}]", c)) << 2 | bool(re.match(f"[{_LETTER}]", c)) << 3
    for c in map(chr, range(0xC0, 0x100)):
        out[0xC3] |= 16
        out[c.encode()[1]] |= bool(re.match(f"[{_LETTER}]", c)) << 5
    return out


_KINDS = _byte_kinds()


def text_pieces(column: pa.Array, added: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts of a column, joined, and their number in each text; null text: none.

    The same as ``pieces``, found in the bytes of a whole batch at once.
    """
    texts = pa.compute.fill_null(column.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    base, size = int(ends[0]), int(ends[-1] - ends[0])
    places = ends.astype(np.int64) - base
    if not size:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = texts.buffers()[2].slice(base, size)
    kinds = _KINDS[np.frombuffer(data, np.uint8)]
    latin = (kinds[:-1] >> 4) & (kinds[1:] >> 5) & 1
    seen, letter = (kinds >> 2) & 1, (kinds >> 3) & 1
    seen[1:] |= latin
    letter[1:] |= latin
    here = np.zeros(size, bool)
    here[1:] = (kinds[1:] & 1 & seen[:-1]) | ((kinds[1:] >> 1) & 1 & letter[:-1])
    begins = places[:-1]
    here[begins[begins < size]] = True
    names = re.compile(b"|".join(re.escape(a.encode()) for a in added)) if added else None
    if names and names.search(data):
        for a, b in zip(begins.tolist(), places[1:].tolist()):
            for found in names.finditer(data.slice(a, b - a)):
                x, y = a + found.start(), a + found.end()
                here[x], here[x + 1 : y] = True, False
                if y < size:
                    here[y] = True
    cuts = np.flatnonzero(here)
    counts = np.diff(np.searchsorted(cuts, places))
    offsets = np.append(cuts, size).astype(np.int32)
    return pa.StringArray.from_buffers(len(cuts), pa.py_buffer(offsets), data), counts


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=2)
def _joins(path: str) -> tuple[np.ndarray, bool]:
    """The bytes of each id of a byte-level vocabulary, and whether its added tokens leave blanks between words alone."""
    own = tokenizer(path)
    added = set(added_tokens(path))
    sizes = np.zeros(own.get_vocab_size(), np.int64)
    for piece, number in own.get_vocab().items():
        sizes[number] = len(piece.encode()) if piece in added else len(piece)
    return sizes, not any(re.search(r"\s", a) for a in added)


#: A word that is cut off from any other before and behind it.
_APART = re.compile(rf"[ \t\n\r].*[{_SEEN}]", re.DOTALL)


def encode_flat(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each encoded on its own, joined; and the number of each word's ids.

    Words between which a text is always cut are encoded as one string, which spares the library's
    work for each call; where one ends and the next begins is read from the bytes of the ids.
    """
    own, (sizes, joins) = tokenizer(path), _joins(path)
    order = np.array([joins and _APART.fullmatch(w) is not None for w in words], bool)
    apart, other = np.flatnonzero(order), np.flatnonzero(~order)
    counts = np.zeros(len(words), np.int64)
    found: list[np.ndarray] = []
    for a in range(0, len(apart), _AT_ONCE):  # the library's results are far larger than their ids
        some = [words[i] for i in apart[a : a + _AT_ONCE].tolist()]
        texts = ["".join(some[k : k + _JOINED]) for k in range(0, len(some), _JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in own.encode_batch(texts, add_special_tokens=False)])
        ends = np.cumsum([len(w.encode()) for w in some])
        last = np.searchsorted(np.cumsum(sizes[ids]), ends) + 1
        counts[apart[a : a + _AT_ONCE]] = np.diff(last, prepend=0)
        found.append(ids)
    for a in range(0, len(other), _AT_ONCE):
        ids_of = [e.ids for e in own.encode_batch([words[i] for i in other[a : a + _AT_ONCE].tolist()], add_special_tokens=False)]
        counts[other[a : a + _AT_ONCE]] = [len(i) for i in ids_of]
        found.append(np.array([x for i in ids_of for x in i], np.uint32))
    flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
    if not len(other):
        return flat, counts
    place = np.empty(len(words), np.int64)
    place[np.concatenate((apart, other))] = np.arange(len(words))
    return spread(flat, counts[np.concatenate((apart, other))], place), counts


def encode(path: str, words: list[str]) -> list[list[int]]:
    flat, counts = encode_flat(path, words)
    ends = np.cumsum(counts)
    return [flat[a:b].tolist() for a, b in zip((ends - counts).tolist(), ends.tolist())]


def coded_texts(column: pa.Array, added: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As ``coded``, of a column of texts."""
    flat, counts = text_pieces(column, added)
    flat = flat.dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def coded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces, the number of each piece's, and the number of pieces of each row."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths


def spread(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists number ``at`` of lists that lie in ``flat`` one after the other, joined."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[at]
    return flat[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Encoder:
    """Encodes pieces in a task, each distinct one once while it is remembered."""

    def __init__(self, path: str, kept: int = _KEPT):
        self.path, self.known, self.kept = path, {}, kept

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, joined, and the number of each word's ids."""
        if len(self.known) > self.kept:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            flat, counts = encode_flat(self.path, new)
            flat, ends = flat.tobytes(), 4 * np.cumsum(counts)
            self.known.update(zip(new, (flat[a:b] for a, b in zip((ends - 4 * counts).tolist(), ends.tolist()))))
        found = [self.known[w] for w in words]
        return np.frombuffer(b"".join(found), np.uint32), np.array([len(f) for f in found], np.int64) // 4


@lru_cache(maxsize=1)
def lasting_encoder(path: str, kept: int) -> Encoder:
    """An encoder that the tasks of a Python worker share one after the other, so that words of the last one are known."""
    return Encoder(path, kept)
