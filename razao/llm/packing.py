"""Operator 5: packing by best-fit decreasing.

Every document's ids, with an end id, are cut into full windows first; the rest
of each is packed, longest first, into the open window with the least room that
still holds it, found in a segment tree over the remaining capacities. A task
packs its own documents in groups of ``GROUP_IDS`` ids as they come and carries
open windows from group to group, so nothing is shuffled and a hot key has no
meaning here. It holds a group's ids, those of ``MOST_OPEN`` open windows and one
longer text at most.

A window with room for ``LOOSE`` ids at most is closed as it is. Those still open
at a task's end, and the fullest of more than ``MOST_OPEN``, are closed as
sequences whose lengths are powers of two, which take no padding.

Ids come from the tokenizer's own library. Its pre-tokenizer never joins text
across white space, so words are encoded apart and remembered; a word of plain
Latin letters is lower-cased, composed and split as the tokenizer does it, and
its parts are remembered too, any other word goes to the library as it is.

Defined results: a null or empty text is the end id alone; repeated rows are
documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse, pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices

WINDOW, END, LOOSE = 2048, 1, 16
#: Ids that are packed at a time, and windows carried on.
GROUP_IDS, MOST_OPEN = 1 << 21, 2048
#: Words and parts of words that a worker remembers.
CACHED_WORDS, CACHED_PARTS = 400_000, 500_000
# Fixed value: the pattern of the tokenizer file's pre-tokenizer.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point Unicode's composition, lower case and classes have long been the same everywhere; one letter grows in lower case.
PLAIN_BELOW, ODD = "ɐ", "İ"


#: What str.split() takes for white space and the tokenizer doesn't, and the tokenizer's own white space.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
NOT_SPACES = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes take the letters from U+0100 on. As a table for text decoded as Latin-1."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return dict(zip(own, map(chr, own))) | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*own}))}


class Words(dict):
    """Ids of words as little-endian bytes; unknown ones are filled in by ``learn``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.model = Tokenizer.from_file(path)
        # the same merges for parts that are cut already: many of them in one text, with white space between
        setup = json.loads(self.model.to_str())
        self.merges = Tokenizer.from_str(json.dumps(setup | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.merges.pre_tokenizer = WhitespaceSplit()
        suffix = setup["model"]["end_of_word_suffix"]
        self.last = np.zeros(self.model.get_vocab_size(), bool)  # the ids that end a part
        self.last[[i for t, i in self.model.get_vocab(False).items() if t.endswith(suffix)]] = True
        self.split = regex.compile(PARTS).findall
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without white space, each as one unit of merging."""
        out = []
        for at in range(0, len(parts), 1024):
            some = parts[at:at + 1024]
            text = " ".join(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(byte_letters()) for p in some)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            flat, ends = ids.tobytes(), [0, *((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()]
            out += [flat[a:b] for a, b in pairwise(ends)]
        if len(out) != len(parts):
            raise ValueError("a part must end with an id that ends a word, and no other id may")
        return out

    def cut(self, word: str) -> tuple[str, ...] | None:
        """The tokenizer's parts of a word, composed and in lower case; None for a word that only the library may cut."""
        if not word.isascii():
            if max(word) >= PLAIN_BELOW or ODD in word:
                return None
            word = unicodedata.normalize("NFC", word)
        low = word.lower()
        if low.isalpha():
            return (low,)
        if low[:-1].isalpha():  # one character that is no letter stands last
            return low[:-1], low[-1]
        return None if "<|" in low else tuple(self.split(low))

    def learn(self, new: set[str]) -> None:
        whole, ended, several, rest = {}, {}, {}, []
        for w in new:
            if w.isascii():  # nearly all words: plain letters, or these with one more character
                low = w.lower()
                if low.isalpha():
                    whole[w] = low
                    continue
                if (head := low[:-1]).isalpha():
                    ended[w] = head, low[-1]
                    continue
            if ps := self.cut(w):
                several[w] = ps
            else:
                rest.append(w)
        wanted = {*whole.values(), *(p for ps in ended.values() for p in ps), *(p for ps in several.values() for p in ps)}
        if len(self.parts) + len(wanted) > CACHED_PARTS:  # those in use stay
            self.parts = {p: self.parts[p] for p in wanted & self.parts.keys()}
        if unknown := list(filterfalse(self.parts.__contains__, wanted)):
            self.parts.update(zip(unknown, self.encode_parts(unknown)))
        of = self.parts.__getitem__
        self.update(zip(whole, map(of, whole.values())))
        self.update((w, of(a) + of(b)) for w, (a, b) in ended.items())
        self.update((w, b"".join(map(of, ps))) for w, ps in several.items())
        if rest:
            self.update(zip(rest, self.encode(rest)))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def encode(path: str, texts: list[str | None]) -> list[bytes]:
    """Each text's ids and the end id, as little-endian 32-bit integers."""
    known = words(path)
    cut = [NOT_SPACES(t) if any(c in t for c in NOT_SPACE) else t.split() for t in (t or "" for t in texts)]
    wanted = set().union(*cut)
    new = wanted - known.keys()
    if len(known) + len(new) > CACHED_WORDS:  # the words of these texts stay, the others go
        kept = {w: known[w] for w in wanted - new}
        known.clear()
        known.update(kept)
    if new:
        known.learn(new)
    end = np.array([END], "<u4").tobytes()
    return [b"".join(map(known.__getitem__, c)) + end for c in cut]


class Capacities:
    """A segment tree over capacities 0 to ``size``: the open windows of each, and the tightest that holds a length."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.tree = [0] * (2 * self.base)  # open windows below each node
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at = capacity + self.base
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the smallest capacity of ``length`` or more: (capacity, window)."""
        at = length + self.base
        while not self.tree[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
                if at <= 1:
                    return None
            if at <= 1:
                return None
            at += 1
            if not self.tree[at]:
                continue
        while at < self.base:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.base
        window = self.open[capacity].pop()
        while at:
            self.tree[at] -= 1
            at >>= 1
        return capacity, window


class Windows:
    """Open windows, packed by best-fit decreasing; more items can follow."""

    def __init__(self, window: int = WINDOW):
        self.window, self.room, self.held, self.next = window, Capacities(window), {}, 0

    def place(self, items: list[tuple[int, Any]]) -> Iterator[list[Any]]:
        """Takes (length, item) in, the longest first; gives back the items of each window that is full now."""
        for length, item in sorted(items, key=lambda x: -x[0]):
            if found := self.room.take(length):
                capacity, w = found
            else:
                capacity, w = self.window, self.next
                self.next += 1
            self.held.setdefault(w, []).append(item)
            if capacity > length:
                self.room.add(capacity - length, w)
            else:
                yield self.held.pop(w)

    def close(self, loose: int, most: int) -> Iterator[tuple[int, list[Any]]]:
        """Takes out the windows with room for ``loose`` at most, and the fullest of more than ``most``: (room, items)."""
        while found := self.room.take(1):
            capacity, w = found
            if capacity > loose and len(self.held) <= most:
                self.room.add(capacity, w)
                return
            yield capacity, self.held.pop(w)


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Best-fit decreasing: the items of each window, in the order they were placed."""
    open_windows = Windows(window)
    full = list(open_windows.place([(n, i) for i, n in enumerate(lengths)]))
    return full + [held for _, held in open_windows.close(0, 0)]


def sequences(used: int, window: int = WINDOW) -> list[int]:
    """How a window with ``used`` ids is closed: whole, or as powers of two if much of it would be padding."""
    if window - used <= LOOSE:
        return [used]
    return [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]


class Packer:
    """Pieces (document, start, length, crc, tokens, sequence, offset) of documents that come in groups; sequences count from 0."""

    def __init__(self, window: int = WINDOW, most: int = MOST_OPEN):
        self.window, self.most, self.open, self.sequence = window, most, Windows(window), 0

    def laid(self, held: list[tuple], used: int) -> Iterator[tuple]:
        """The pieces of one window."""
        todo = sequences(used, self.window)
        room, offset = todo.pop(0), 0
        for d, tokens, start, ids in held:
            at, n = 0, len(ids) // 4
            while at < n:
                some = min(room - offset, n - at)
                yield d, start + at, some, zlib.crc32(ids[4 * at:4 * (at + some)]), tokens, self.sequence, offset
                at, offset = at + some, offset + some
                if offset == room:
                    room, offset, self.sequence = todo.pop(0) if todo else 0, 0, self.sequence + 1

    def add(self, docs: list[tuple[Any, bytes]]) -> Iterator[tuple]:
        window, rest = self.window, []
        for d, ids in docs:
            n = len(ids) // 4
            for start in range(0, n - window + 1, window):
                yield from self.laid([(d, n, start, ids[4 * start:4 * (start + window)])], window)
            if over := n % window:
                rest.append((over, (d, n, n - over, ids[4 * (n - over):])))
        for held in self.open.place(rest):
            yield from self.laid(held, window)
        for capacity, held in self.open.close(LOOSE, self.most):
            yield from self.laid(held, window - capacity)

    def end(self) -> Iterator[tuple]:
        for capacity, held in self.open.close(0, 0):
            yield from self.laid(held, self.window - capacity)


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). A sequence belongs to
    one task: its number is the task's partition and a count, so a task that runs again gives the same."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, packer, held, size, kind = TaskContext.get().partitionId() << 40, Packer(), [], 0, None

        def out(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            if rows := list(pieces):
                ids, *numbers = zip(*rows)
                start, length, crc, tokens, sequence, offset = (np.array(x, np.int64) for x in numbers)
                yield pa.record_batch([pa.array(ids, kind), *map(pa.array, (start, length, crc, tokens, sequence + first, offset))], names=names)

        for b in slices(batches, "text"):
            kind = b.schema.field(0).type
            for d, ids in zip(b.column(0).to_pylist(), encode(tokenizer_file, b.column(1).to_pylist())):
                held.append((d, ids))
                size += len(ids) // 4
                if size >= GROUP_IDS:
                    yield from out(packer.add(held))
                    held, size = [], 0
        yield from out(packer.add(held))
        yield from out(packer.end())

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, " + ", ".join(f"{n} bigint" for n in names[1:]))
