"""Operator 12: fill-in-the-middle documents, cut through an indexable skip list.

A text's units (runs of A-Z letters, or one other code point) are the bottom
lane of a skip list. Every lane above keeps each ``FAN``-th node of the lane
below; a node of any lane carries how many units and how many code points it
spans. A cut after r units descends from the top lane: it moves right while the
units passed so far and the node's width stay within r, adding up the code
points on the way, and goes one lane down otherwise. So a cut takes
O(FAN * log n) steps and lands on the exact code point.

Output forms: ``plain`` is the text; ``psm`` is ``<P>`` prefix ``<S>`` suffix
``<M>`` middle; ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. A text
that holds one of the marks stays plain, so the parts can be told apart again.

Defined results: a null text counts as an empty one, which is plain; a null id
is hashed as an empty one; repeated rows give repeated rows; other columns are
ignored, whatever their names. Each text is handled alone and whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices

#: Nodes of a lane that one node of the lane above spans.
FAN = 16
MARKS = ("<P>", "<S>", "<M>")


def unit_widths(text: str) -> np.ndarray:
    """The length in code points of each unit of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (points | 32) - np.uint32(97) < 26
    starts = np.flatnonzero(~(letter & np.r_[False, letter[:-1]]))
    return np.diff(starts, append=len(points))


class SkipList:
    """Lanes over a sequence of units, each a pair of arrays: units and code points that its nodes span."""

    def __init__(self, widths: np.ndarray):
        self.size = len(widths)
        self.lanes = [(np.ones(len(widths), np.int64), widths.astype(np.int64))]
        while len(self.lanes[-1][0]) > FAN:
            units, points = self.lanes[-1]
            at = np.arange(0, len(units), FAN)
            self.lanes.append((np.add.reduceat(units, at), np.add.reduceat(points, at)))

    def point(self, rank: int) -> int:
        """The code points before unit number ``rank`` (0 to ``size``)."""
        node = passed = points = 0
        for units, widths in reversed(self.lanes):
            node *= FAN
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                points += int(widths[node])
                node += 1
        return points


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))


def transform(text: str | None, doc_id, seed: int, rate: int, spm: int) -> tuple:
    """(units, form, prefix code points, middle code points, output); the two lengths are None if plain."""
    text = text or ""
    lane = SkipList(unit_widths(text))
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return lane.size, "plain", None, None, text
    a, b = sorted((h1 % (lane.size + 1), h2 % (lane.size + 1)))
    a, b = lane.point(a), lane.point(b)
    if h4 % 100 < spm:
        return lane.size, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return lane.size, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def documents(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's transformed text: (doc_id, n, form, prefix_chars, middle_chars, output). ``rate`` percent of the
    documents are cut, ``spm`` percent of these begin with the suffix. No shuffle."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = dict(src.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            made = [transform(t, i, seed, rate, spm) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = [pa.array(list(c), t) for c, t in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            if made:
                yield pa.record_batch([b.column(0), *cols], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return src.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A mark can't arise across two parts: it begins with the one ``<`` it has."""
    parts = F.split(output, "<[PSM]>")
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output))
