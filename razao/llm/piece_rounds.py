"""Operator 8: SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into words at the only places a piece can't cross (before a run of
spaces that follows other text, and around characters that stand in no longer
piece). The distinct words of a slice are encoded together: one flat numpy array
of symbols, the smallest pair rank of each word by a segmented minimum, that
pair merged in all words at once, then compaction, until no pair remains.

Within one word a round merges the leftmost pair of smallest rank. Further
non-overlapping pairs of the same rank merge in the same round only if no
larger piece that holds the merged one has a smaller or equal rank; then later
pairs of this rank would come next anyway, so the order equals the library's.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows give repeated rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Words longer than this many symbols are merged with a heap, in the same order.
LONG_WORD = 4096
#: Distinct words that a task keeps between slices.
CACHED_WORDS = 400_000
SPACE = "▁"


class Pieces:
    """The pieces of a model and its merge table, as sorted arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.n = sp.get_piece_size()
        self.unk = sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = np.array([sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)])
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = np.empty(n, object)  # what an id decodes to
        for i, p in enumerate(pieces):
            self.raw[i] = bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode()
        self.raw[self.unk] = " ⁇ ".encode()
        self.single = {p: i for p, i in ids.items() if len(p) == 1}
        self.of_char = np.arange(max(map(ord, self.single)) + 1) + n
        self.of_char[[ord(c) for c in self.single]] = list(self.single.values())
        rows, inner = [], np.full(n, np.iinfo(np.int64).max)  # inner: the best rank of a piece that holds this one at an edge
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                for edge in (a, b):
                    if edge is not None:
                        inner[edge] = min(inner[edge], rank[i])
                if a is not None and b is not None:
                    rows.append((a * n + b, i))
        rows.sort()
        self.keys = np.array([k for k, _ in rows], np.int64)
        self.into = np.array([i for _, i in rows], np.int64)
        self.rank, shared = rank, np.bincount(rank)[rank] > 1
        self.safe = (inner > rank) & ~shared
        joined = {c for p in ids if len(p) > 1 for c in p}
        self.no_inner_space = all(SPACE not in p.lstrip(SPACE) for p in ids)
        self.apart = "".join(c for c in "\n\t\r" if c not in joined)
        self.prefix = sp.encode("a") != [] and sp.id_to_piece(sp.encode("a")[0]).startswith(SPACE)
        self.plain = sp.normalize("ﬁ ①  　x ") in ("ﬁ ①  　x ", f"{SPACE}ﬁ{SPACE}①{SPACE * 2}　x{SPACE}")
        if not (self.no_inner_space and self.plain and len(self.bytes) == 256):
            raise ValueError("the model must have an identity normalizer, byte fallback and no piece with a space after other text")
        word = rf"[^{SPACE}{self.apart}]"
        self.cut = re.compile((rf"[{self.apart}]|" if self.apart else "") + rf"{SPACE}*{word}+|{SPACE}+").findall

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of each pair's piece; the rank is the largest integer where there is none."""
        key = np.where((a < self.n) & (b < self.n), a * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        into = self.into[at]
        return np.where(self.keys[at] == key, self.rank[into], np.iinfo(np.int64).max), into


@lru_cache(maxsize=4)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def symbols(m: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First symbols: a character's piece, or n + code point where it has none; and each word's length."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(flat < len(m.of_char), m.of_char[np.minimum(flat, len(m.of_char) - 1)], flat + m.n), np.fromiter(map(len, words), np.int64, len(words))


def by_heap(m: Pieces, sym: np.ndarray) -> np.ndarray:
    """One long word, pair by pair; the same result in n log n steps."""
    s, n = sym.tolist(), len(sym)
    left, right, none = list(range(-1, n - 1)), [*range(1, n), -1], np.iinfo(np.int64).max
    rank, into = m.lookup(sym[:-1], sym[1:])
    heap = [(int(rank[i]), i, s[i], s[i + 1], int(into[i])) for i in np.flatnonzero(rank != none).tolist()]
    heapq.heapify(heap)
    table = dict(zip(m.keys.tolist(), m.into.tolist()))
    while heap:
        _, i, a, b, to = heapq.heappop(heap)
        j = right[i]
        if s[i] != a or j < 0 or s[j] != b:
            continue
        s[i], s[j], right[i] = to, -1, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and s[x] < m.n and s[y] < m.n and (t := table.get(s[x] * m.n + s[y])) is not None:
                heapq.heappush(heap, (int(m.rank[t]), x, s[x], s[y], t))
    return np.array([x for x in s if x >= 0], np.int64)


def rounds(m: Pieces, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words at once: the last symbols, word after word, and how many each has."""
    none, word = np.iinfo(np.int64).max, np.repeat(np.arange(len(length)), length)
    done_sym, done_word = [], []
    rank, into = np.full(len(sym), none), np.zeros(len(sym), np.int64)
    fresh = np.arange(len(sym))
    while len(sym):
        a = fresh[fresh + 1 < len(sym)]
        a = a[word[a] == word[a + 1]]
        rank[fresh] = none
        rank[a], into[a] = m.lookup(sym[a], sym[a + 1])
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        count = np.diff(np.r_[start, len(sym)])
        least = np.minimum.reduceat(rank, start)
        if (over := least == none).any():  # these words are ready
            gone = np.repeat(over, count)
            done_sym.append(sym[gone])
            done_word.append(word[gone])
            sym, word, rank, into = sym[~gone], word[~gone], rank[~gone], into[~gone]
            if not len(sym):
                break
            least, count = least[~over], count[~over]
        hit = np.flatnonzero(rank == np.repeat(least, count))
        first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
        run = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1] | first)
        even = (np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0
        hit = hit[first | (even & m.safe[into[hit]])]
        sym[hit] = into[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        new = (np.cumsum(keep) - 1)[hit]
        sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
        touched = np.zeros(len(sym), bool)
        touched[new] = touched[np.maximum(new - 1, 0)] = True
        fresh = np.flatnonzero(touched)
    sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
    return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(length))


def encode_words(m: Pieces, words: list[str]) -> list[bytes]:
    """Each word's ids as little-endian 32-bit integers."""
    out: dict[str, bytes] = {}
    short = [w for w in words if len(w) <= LONG_WORD]
    parts = [(short, *rounds(m, *symbols(m, short)))] if short else []
    for w in words:
        if len(w) > LONG_WORD:
            sym = by_heap(m, symbols(m, [w])[0])
            parts.append(([w], sym, np.array([len(sym)])))
    for names, sym, count in parts:
        if len(odd := np.flatnonzero(sym >= m.n)):  # byte fallback
            utf8 = [[m.bytes[b] for b in chr(x - m.n).encode()] for x in sym[odd].tolist()]
            size = np.ones(len(sym), np.int64)
            size[odd] = [len(x) for x in utf8]
            plain = np.repeat(sym, size)
            one = np.repeat(sym >= m.n, size)
            plain[one] = [y for x in utf8 for y in x]
            count = np.add.reduceat(size, np.cumsum(count) - count)
            sym = plain
        raw, end = sym.astype("<i4").tobytes(), (np.cumsum(count) * 4).tolist()
        out.update(zip(names, map(raw.__getitem__, map(slice, [0, *end[:-1]], end))))
    return [out[w] for w in words]


def encoder(model_file: str) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to their ids; it keeps what it has learned of words between calls."""
    m, known = pieces(model_file), {}

    def encode(texts: list[str]) -> list[np.ndarray]:
        cuts = [m.cut((SPACE * m.prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(known) > CACHED_WORDS:
            known.clear()
        if new := list({w for c in cuts for w in c if w not in known}):
            known.update(zip(new, encode_words(m, new)))
        return [np.frombuffer(b"".join(map(known.__getitem__, c)), "<i4") for c in cuts]

    return encode


def decode(model_file: str, ids: np.ndarray) -> str:
    """The text of ids: pieces joined, byte ids read as UTF-8 (a wrong byte gives U+FFFD), the first space left out."""
    m = pieces(model_file)
    raw = b"".join(m.raw[ids].tolist())
    if m.prefix and raw[:1] == b" " and m.raw[ids[0]][:1] == b" ":
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every row: (id, ids array<int>, decoded string). No shuffle."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_file)
        for b in slices(batches, "text"):
            ids = encode([t or "" for t in b.column(1).to_pylist()])
            flat = np.concatenate(ids) if ids else np.array([], "<i4")
            at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32())), pa.array([decode(model_file, x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """As ``encode_documents``, with the digests made beside the ids so that no ids leave the task:
    (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model_file)
        decimal = np.array([b"%d" % i for i in range(pieces(model_file).n)], object)
        for b in slices(batches, "text"):
            ids = encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.record_batch([
                b.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(b",".join(decimal[x].tolist())).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decode(model_file, x).encode()).hexdigest() for x in ids], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
