"""Operator 10: language ID by interpolated Kneser-Ney character models.

Texts are read as lower-case letters; anything else is a word gap. Spark counts
every 4-character sequence of every document to learn from, by language, and
from these the continuation counts of the shorter ones. No count is shared,
folded or dropped: a sequence is its three last code points in one number and the
one before them in another, so the tables grow with what the documents hold.

A model of at most ``MODEL_ROWS`` rows over all languages (counted first) goes to
every task as sorted hash arrays, a few for each language (``Models``); a
sequence of four is found there by a 64-bit hash, shorter ones by themselves. A
larger one stays a table, and the texts' sequences are joined with it
(``Joined``): slower, since sequences are shuffled, with the same results. A text
gets the language of the lowest cross-entropy a character.

A language may also be rejected: over all different texts to learn from, its
cross-entropy is measured on the texts as they are and on the same texts with
their characters shuffled. A text is not taken for a language if it costs more
than half-way between the two medians (taken to 1/``CELLS`` bit, so that no group
holds a number a text), with ``REJECT_AT`` standard errors for its length on top.
The driver sees a few numbers a language, and no text.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and is rejected; without any language to learn every text is; ties go to the
language that sorts first; a row without id is never learned from; repeated rows
give repeated rows and count each time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, written

ORDER, POINT_BITS = 4, 21
#: Rows of a model that goes to every task, at 16 bytes each; a larger one is joined.
MODEL_ROWS = 2_000_000
SLICE = 1 << 19
#: Sequences that a task sums up before it sends them on.
HELD = 1 << 20
#: Costs a bit that the medians tell apart.
CELLS = 1 << 12
REJECT_AT = 3.0
LEAST_P = 1e-12
UNKNOWN = "und"
_LETTER = None


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((i if chr(i).isalpha() else 0 for i in range(sys.maxunicode + 1)), np.uint32, sys.maxunicode + 1)
    return _LETTER


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 4-character sequences, as the last three characters packed and the one before them, and how many each text has."""
    joined = [("  \x00" + (t or "").lower() + "\x00").encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(j) // 4 for j in joined], np.int64)
    c = letters()[np.frombuffer(b"".join(joined), np.uint32)]
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), size
    start = np.cumsum(size) - size
    keep = c != 0
    keep[1:] |= keep[:-1].copy()  # runs of gaps are one
    keep[start] = True
    size = np.add.reduceat(keep, start, dtype=np.int64)
    c, start = c[keep], np.cumsum(size) - size
    before = np.zeros((ORDER - 1, len(c)), np.uint64)
    for back in range(1, ORDER):
        before[back - 1, back:] = c[:-back]
    # every text ends with a gap, so of its second character only the last of those before can lie in another text
    before[ORDER - 2, np.minimum(start + 1, len(c) - 1)[size > 1]] = 0
    # a text's first character is the gap before it; a text without letters has nothing else
    rest = np.ones(len(c), bool)
    rest[start] = False
    packed = c.astype(np.uint64)
    for back in range(1, ORDER - 1):
        packed |= before[back - 1] << np.uint64(POINT_BITS * back)
    return packed[rest], before[ORDER - 2][rest], size - 1


def hashed(packed: np.ndarray, old: np.ndarray) -> np.ndarray:
    """64 bits for a sequence of four."""
    x = packed * np.uint64(0x9E3779B97F4A7C15) + old * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, packed, old, n) over all rows (lang, text); each task sums up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, ...]]] = {}

        def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            key, packed, old, n = (np.concatenate(x) for x in zip(*parts))
            key, first, at = np.unique(key, return_index=True, return_inverse=True)
            return key, packed[first], old[first], np.bincount(at, n).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                _, packed, old, n = summed(parts)
                yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array(packed.view(np.int64)), pa.array(old.astype(np.int32)), pa.array(n)], names=["lang", "packed", "old", "n"])
            held.clear()

        for b in slices(batches, "text", SLICE):
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for lang in sorted({r[0] for r in rows}):
                packed, old, _ = sequences([t for own, t in rows if own == lang])
                key, first, n = np.unique(hashed(packed, old), return_index=True, return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((key, packed[first], old[first], n))
                if sum(len(x[0]) for x in parts) > HELD // 4:
                    parts[:] = [summed(parts)]
            if sum(len(x[0]) for parts in held.values() for x in parts) > HELD:
                yield from out()
        yield from out()

    found = docs.select("lang", "text").mapInArrow(run, "lang string, packed bigint, old int, n bigint")
    return found.groupBy("lang", "packed", "old").agg(F.sum("n").alias("n"))


def shorter(k: int) -> Column:
    """The last ``k`` characters of a sequence, at most three."""
    return F.col("packed").bitwiseAND(F.lit((1 << POINT_BITS * k) - 1))


def before_last(k: int) -> Column:
    """A sequence of ``k`` characters without its last one."""
    head = F.shiftrightunsigned("packed", POINT_BITS)
    return head.bitwiseOR(F.shiftleft(F.col("old").cast("bigint"), 2 * POINT_BITS)) if k == ORDER else head


def tables(grams: DataFrame) -> DataFrame:
    """(lang, k, context, packed, old, n, kinds): for order k a sequence's count, or a context's with the number of its
    continuations. Below the highest order a count is the number of different characters before."""
    level, all_levels = grams, []
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            level = level.groupBy("lang", shorter(k).alias("packed")).agg(F.count("*").alias("n")).withColumn("old", F.lit(0))
        contexts = level.groupBy("lang", before_last(k).alias("packed")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        all_levels.append(level.select("lang", F.lit(k).alias("k"), F.lit(False).alias("context"), "packed", "old", "n", F.lit(1).cast("bigint").alias("kinds")))
        all_levels.append(contexts.select("lang", F.lit(k).alias("k"), F.lit(True).alias("context"), "packed", F.lit(0).alias("old"), "n", "kinds"))
    union = all_levels[0]
    for part in all_levels[1:]:
        union = union.unionByName(part)
    return union


def discount(one: float, two: float) -> float:
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5


def least(characters: int) -> float:
    """Probability of a character that a language's documents don't hold."""
    return 1 / (2 * characters + 100)


class Models:
    """Sorted hash arrays: for each language and order, counts and contexts' totals."""

    def __init__(self, found: pa.Table):
        get = {name: found.column(name).to_numpy(zero_copy_only=False) for name in found.column_names}
        packed, old = get["packed"].astype(np.int64).view(np.uint64), get["old"].astype(np.uint64)
        key = np.where((get["k"] == ORDER) & ~get["context"].astype(bool), hashed(packed, old), packed)
        self.langs = sorted(set(get["lang"].tolist()))
        self.parts, self.floor, self.limits = {}, {}, {}
        for lang in self.langs:
            own = get["lang"] == lang
            for k in range(1, ORDER + 1):
                for context in (False, True):
                    at = np.flatnonzero(own & (get["k"] == k) & (get["context"] == context))
                    at = at[np.argsort(key[at])]
                    self.parts[lang, k, context] = (key[at], get["n"][at].astype(np.float32), get["kinds"][at].astype(np.float32) if context else None)
                n = self.parts[lang, k, False][1]
                self.parts[lang, k, "d"] = discount((n == 1).sum(), (n == 2).sum())
            self.floor[lang] = least(len(self.parts[lang, 1, False][0]))

    @staticmethod
    def look(part: tuple[np.ndarray, ...], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``h`` and which of them are there."""
        at = np.minimum(np.searchsorted(part[0], h), len(part[0]) - 1)
        return at, part[0][at] == h

    def costs(self, packed: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Bits of each sequence's last character after the others, a column a language."""
        out = np.empty((len(packed), len(self.langs)), np.float32)
        bits, gram = np.uint64(POINT_BITS), hashed(packed, old)
        # all but the sequences of four themselves is looked up once for each three characters, at their end or their start
        three, at = np.unique(np.r_[packed, (packed >> bits) | (old << bits * np.uint64(ORDER - 2))], return_inverse=True)
        end, start = at[:len(packed)], at[len(packed):]
        own = {k: three & np.uint64((1 << POINT_BITS * k) - 1) for k in range(1, ORDER)}
        for j, lang in enumerate(self.langs):
            p = np.full(len(three), self.floor[lang])
            for k in range(1, ORDER + 1):
                d, part = self.parts[lang, k, "d"], self.parts[lang, k, True]
                at, seen = self.look(part, own[k] >> bits if k < ORDER else three)
                total, kinds = np.where(seen, part[1][at], 1.0).astype(np.float64), part[2][at]
                rest = np.where(seen, np.minimum(d * kinds / total, 1.0), 1.0)  # without its context a sequence isn't there either
                if k == ORDER:
                    p, total, rest = p[end], total[start], rest[start]
                part = self.parts[lang, k, False]
                at, hit = self.look(part, own[k] if k < ORDER else gram)
                c = np.where(hit, part[1][at], 0.0)
                p = np.maximum(c - d, 0) / total + rest * p
            out[:, j] = -np.log2(np.maximum(p, LEAST_P))
        return out


class Joined:
    """A model that stays a table: ``parts`` as made by ``tables``."""

    def __init__(self, parts: DataFrame):
        self.parts, self.limits = parts, {}
        rows = parts.where(~F.col("context")).groupBy("lang", "k").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"), F.count("*").alias("n")).collect()
        self.langs = sorted({r["lang"] for r in rows})
        self.d = {(r["lang"], r["k"]): discount(r["one"], r["two"]) for r in rows}
        self.floor = {r["lang"]: least(r["n"]) for r in rows if r["k"] == 1}

    def of(self, values: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]

    def texts(self, texts: DataFrame) -> DataFrame:
        """(key, lang, mean, size, square) of every text with letters, a row a language; ``texts`` holds (key, text), equal texts under equal keys."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", SLICE):
                packed, old, size = sequences(b.column(1).to_pylist())
                doc = np.repeat(np.arange(len(b)), size)
                order = np.lexsort((old, packed, doc))
                packed, old, doc = packed[order], old[order], doc[order]
                new = np.flatnonzero(np.r_[True, (packed[1:] != packed[:-1]) | (old[1:] != old[:-1]) | (doc[1:] != doc[:-1])][:len(doc)])
                yield pa.record_batch([b.column(0).take(pa.array(doc[new])), pa.array(packed[new].view(np.int64)), pa.array(old[new].astype(np.int32)), pa.array(np.diff(np.r_[new, len(doc)]))],
                                      names=["key", "packed", "old", "times"])

        held = texts.select("key", "text").mapInArrow(run, "key string, packed bigint, old int, times bigint").groupBy("key", "packed", "old").agg(F.max("times").alias("times"))
        held = written(held, "text-sequences")
        cost = held.select("packed", "old").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, self.langs)))).withColumn("p", self.of(self.floor))
        for k in range(1, ORDER + 1):
            part = self.parts.where(F.col("k") == k)
            own = part.where(~F.col("context")).select("lang", F.col("packed").alias("own"), F.col("old").alias("own_old"), F.col("n").alias("c"))
            context = part.where("context").select("lang", F.col("packed").alias("head"), F.col("n").alias("total"), "kinds")
            cost = cost.withColumn("own", shorter(min(k, ORDER - 1))).withColumn("own_old", F.col("old") if k == ORDER else F.lit(0))
            cost = cost.withColumn("head", before_last(k) if k == ORDER else F.shiftrightunsigned("own", POINT_BITS))
            cost = cost.join(own, ["lang", "own", "own_old"], "left").join(context, ["lang", "head"], "left")
            d = self.of({lang: self.d[lang, k] for lang in self.langs})
            value = F.greatest(F.coalesce("c", F.lit(0)) - d, F.lit(0.0)) / F.col("total") + F.least(d * F.col("kinds") / F.col("total"), F.lit(1.0)) * F.col("p")
            cost = cost.select("lang", "packed", "old", F.when(F.col("total") > 0, value).otherwise(F.col("p")).alias("p"))
        cost = cost.withColumn("bits", -F.log2(F.greatest("p", F.lit(LEAST_P))))
        size = F.sum("times")
        return held.join(cost, ["packed", "old"]).groupBy("key", "lang").agg((F.sum(F.col("times") * F.col("bits")) / size).alias("mean"), size.alias("size"),
                                                                            (F.sum(F.col("times") * F.col("bits") * F.col("bits")) / size).alias("square"))

    def judged(self, docs: DataFrame) -> DataFrame:
        """(key, lang_pred, score, accepted) of every different text with letters; key is the text's digest."""
        limit, inner = self.of({k: v[0] for k, v in self.limits.items()}), self.of({k: v[1] for k, v in self.limits.items()})
        costs = self.texts(docs.where(F.col("text").isNotNull()).select(text_key().alias("key"), "text")).withColumn("most", limit + REJECT_AT * F.sqrt(inner / F.col("size")))
        by = costs.groupBy("key").agg(F.min(F.struct("mean", "lang", "most")).alias("best"), F.collect_list("mean").alias("all"), F.max("size").alias("size"))  # a number a language
        share = F.aggregate("all", F.lit(0.0), lambda total, x: total + F.pow(F.lit(2.0), -F.least((x - F.col("best.mean")) * F.col("size"), F.lit(1000.0))))
        return by.select("key", F.col("best.lang").alias("lang_pred"), (1 / share).alias("score"), (F.col("best.mean") <= F.col("best.most")).alias("accepted"))


def text_key() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


class Scorer:
    """Costs of texts; a table of sequences met before stands in front of the models."""

    BITS = 18

    def __init__(self, models: Models):
        self.m = models
        self.gram = np.zeros(1 << self.BITS, np.uint64)
        self.cost = np.zeros((1 << self.BITS, len(models.langs)), np.float32)

    def place(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def of(self, packed: np.ndarray, old: np.ndarray) -> np.ndarray:
        g = hashed(packed, old)
        at = self.place(g)
        miss = np.flatnonzero(self.gram[at] != g)
        out = self.cost.take(at, axis=0)  # read before new ones take the places
        if len(miss):
            new, first, back = np.unique(g[miss], return_index=True, return_inverse=True)
            cost = self.m.costs(packed[miss[first]], old[miss[first]])
            here = self.place(new)
            self.gram[here], self.cost[here] = new, cost
            own = self.gram[here] == new  # of several for one place the last stays
            self.cost[here[own]] = cost[own]
            out[miss] = cost[back]
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: cost a character by language, the number of characters, and the costs' squares a character."""
        packed, old, n = sequences(texts)
        mean, square = np.zeros((len(texts), len(self.m.langs))), np.zeros((len(texts), len(self.m.langs)))
        if len(packed) and self.m.langs:
            cost, has = self.of(packed, old), n > 0
            start = (np.cumsum(n) - n)[has]
            mean[has] = np.add.reduceat(cost, start, dtype=np.float64) / n[has, None]
            square[has] = np.add.reduceat(cost * cost, start, dtype=np.float64) / n[has, None]
        return mean, n, square


def shuffled(text: str) -> str:
    """The text's characters in another order, the same at every call."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.random.default_rng(5).permutation(points).tobytes().decode("utf-32-le", "surrogatepass")


def calibrated(models: Models | Joined, rows: DataFrame) -> dict[str, tuple[float, float]]:
    """For each language: the limit of the cost, half-way to that of shuffled texts, and the variance between characters,
    over all different texts with letters of ``rows`` (lang, text)."""
    usable = rows.where(F.col("text").rlike(r"\p{L}"))

    def mixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([shuffled(t) for t in b.column(2).to_pylist()], pa.string())], names=["key", "lang", "text", "mixed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, mixer = Scorer(models), Scorer(models)  # shuffled texts would push the others' sequences out
        for b in slices(batches, "text", SLICE):
            texts = b.column(2).to_pylist()
            own = (np.arange(len(b)), [models.langs.index(x) for x in b.column(1).to_pylist()])
            mean, size, square = scorer.texts(texts)
            mixed, _, _ = mixer.texts([shuffled(t) for t in texts])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(mean[own]), pa.array(mixed[own]), pa.array(square[own]), pa.array(size)], names=["key", "lang", "mean", "mixed", "square", "size"])

    if isinstance(models, Joined):
        keyed = usable.select(F.sha2(F.concat_ws(" ", "lang", "text"), 256).alias("key"), "lang", "text")
        both = written(keyed.mapInArrow(mixes, "key string, lang string, text string, mixed string"), "language-texts")
        plain = models.texts(both).join(both.select("key", "lang").distinct(), ["key", "lang"])
        mixed = models.texts(both.select("key", F.col("mixed").alias("text"))).select("key", "lang", F.col("mean").alias("mixed"))
        costs = plain.join(mixed, ["key", "lang"])
    else:
        keyed = usable.select(F.xxhash64("text", F.lit(1)).alias("key"), "lang", "text")
        each = keyed.mapInArrow(run, "key bigint, lang string, mean double, mixed double, square double, size bigint")
        costs = each.groupBy("lang", "key").agg(F.min(F.struct("mean", "mixed", "square", "size")).alias("c")).select("lang", "c.*")  # numbers, no text
    costs = written(costs, "language-costs")
    kinds = F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.round(F.col(x) * CELLS).alias("cell")) for x in ("mean", "mixed")]))
    cells = costs.select("lang", kinds.alias("at")).groupBy("lang", "at.kind", "at.cell").agg(F.count("*").alias("n"))
    medians = cells.groupBy("lang", "kind").agg((F.percentile("cell", F.lit(0.5), F.col("n")) / CELLS).alias("median"))
    limits = {r["lang"]: r["limit"] for r in medians.groupBy("lang").agg(F.avg("median").alias("limit")).collect()}
    spread = F.sum((F.col("square") - F.col("mean") * F.col("mean")) * F.col("size")) / F.sum("size")
    return {r["lang"]: (limits[r["lang"]], r["inner"]) for r in costs.groupBy("lang").agg(F.greatest(spread, F.lit(1.0)).alias("inner")).collect()}


def learn(docs: DataFrame, learned: Column, model_rows: int = MODEL_ROWS) -> Models | Joined:
    """Models from all rows (doc_id, text, lang) for which ``learned`` holds; as arrays if they have ``model_rows`` rows at most."""
    rows = docs.where(learned & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = written(tables(written(counts(rows), "sequences")), "language-model")  # each order reads the counts again
    models = Models(parts.toArrow()) if parts.count() <= model_rows else Joined(parts)
    models.limits = calibrated(models, rows)
    return models


def judge(models: Models, scorer: Scorer, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, score, accepted) of each text; the score is the language's share of likelihood among all learned ones."""
    mean, n, _ = scorer.texts(texts)
    out = []
    for cost, size in zip(mean, n):
        if not size or not models.langs:
            out.append((UNKNOWN, 0.0, False))
            continue
        best = int(np.argmin(cost))
        lang = models.langs[best]
        share = 1 / np.exp2(-np.minimum((cost - cost[best]) * size, 1000.0)).sum()
        limit, inner = models.limits[lang]
        out.append((lang, float(share), bool(cost[best] <= limit + REJECT_AT * (inner / size) ** 0.5)))
    return out


def predict(docs: DataFrame, models: Models | Joined) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row. No shuffle, unless the model is joined."""
    src = docs.select("doc_id", "text")
    if isinstance(models, Joined):
        found = src.select("doc_id", text_key().alias("key")).join(models.judged(src), "key", "left")
        return found.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("accepted", F.lit(False)).alias("accepted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for b in slices(batches, "text", SLICE):
            lang, score, accepted = zip(*judge(models, scorer, b.column(1).to_pylist())) if len(b) else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, models: Models | Joined) -> DataFrame:
    """The rows of ``docs`` whose text is taken for a language, with all their columns."""
    at = docs.columns.index("text")
    if isinstance(models, Joined):
        accepted = models.judged(docs).where("accepted").select("key")
        return docs.join(accepted, text_key() == accepted["key"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for b in slices(batches, "text", SLICE):
            kept = [x[2] for x in judge(models, scorer, b.column(at).to_pylist())]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
