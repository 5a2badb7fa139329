"""Searches with terms held in a table (FLT-9, FLT-14, FLT-15).

A short list of terms is one regular expression (``filters``, ``classify``). A
table of thousands is searched through an index of words, the texts' runs
without a space: a text can only hold a term if one of its words holds the
term's longest run. Each different word is searched once, however many texts
hold it: a term's run is filed under one of its trigrams (or longer pieces),
the one that fewest words hold, and a word looks up its own. Texts look up their
words. A term that is one run is settled by that; any other is checked on the
text. There is no cross join; trigrams follow the vocabulary, the rest the
texts' words and the hits.

While words are matched a text is known by two hashes, so long texts aren't
copied for each hit. Where texts are asked for they are searched once each,
however many rows hold them; where they are counted no text is shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import flag

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text. It is cut into characters once: taking each run
    from the text itself would walk there from its start, square in its length."""
    def runs(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    cut = F.element_at(F.transform(F.array(F.split(text, "")), runs), 1)
    return F.when(F.char_length(text) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def escaped(term: Column) -> Column:
    return F.regexp_replace(term, r"([\\.^$|?*+()\[\]{}])", r"\\\$1")


#: Bits of the table that tells which pieces no run is filed under (1 MB).
SIEVE_BITS = 1 << 23


def _place(piece: str) -> tuple[Column, Column]:
    """A piece's long and bit there in the table of ``SIEVE_BITS`` bits."""
    at = F.xxhash64(piece).bitwiseAND(SIEVE_BITS - 1)
    return F.shiftright(at, 6).cast("int"), at.bitwiseAND(63).cast("int")


def _sieve(index: DataFrame) -> Column:
    """The table as an array of longs, of one size whatever is filed: a clear bit says that no run is filed under a piece."""
    slot, bit = _place("gram")
    bits = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    every = index.sparkSession.range(SIEVE_BITS >> 6).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("bigint").alias("bits"))
    longs = index.select(slot.alias("slot"), bits.alias("bits")).unionByName(every).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    return longs.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"])).scalar()


def _within(words: DataFrame, runs: DataFrame, gram: int, sieve: bool = False) -> DataFrame:
    """(word, run): every run in every different word that holds it, by the runs' rarest pieces of ``gram`` characters;
    with the other columns of ``runs``. ``sieve`` keeps most pieces that no run is filed under out of the last shuffle."""
    # shorter pieces are only looked up if a run is as short
    short = [(n, runs.agg(F.count_if(F.char_length("run") == n) > 0).scalar()) for n in range(1, gram)]
    grams = [_grams(F.col("word"), gram), *[F.when(used, _grams(F.col("word"), n)).otherwise(F.array().cast("array<string>")) for n, used in short]]
    held = words.select("word", F.explode(F.concat(*grams)).alias("gram"))
    own = F.when(F.char_length("run") < gram, F.array("run")).otherwise(_grams(F.col("run"), gram))
    # the join below would ask for it; asked for here, the sieve's index is the same plan and isn't computed twice
    filed = runs.where("run IS NOT NULL").select("*", F.explode(own).alias("gram"))
    held_by = held.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))  # added up within tasks, so before any join
    rarest = F.min(F.struct(F.coalesce("words", F.lit(0)).alias("words"), F.col("gram")))["gram"]
    index = filed.join(held_by, "gram", "left").groupBy(*runs.columns).agg(rarest.alias("gram"))
    if sieve:
        slot, bit = _place("gram")
        held = held.where(F.getbit(F.get(_sieve(index), slot), bit) == 1)
    return held.join(index, "gram").where(F.col("word").contains(F.col("run"))).select("word", *runs.columns)


ID = ["id", "id_2"]


def _ids(column: str) -> list[Column]:
    return [F.xxhash64(column), F.hash(column).bitwiseAND(0xFFFF)]


def _with_ids(texts: DataFrame) -> DataFrame:
    """The texts that aren't empty with their ids, two hashes of 64 and 16 bits."""
    return texts.where("text != ''").withColumns(dict(zip(ID, _ids("text"))))


def _with_runs(terms: DataFrame) -> DataFrame:
    """(term, run): the different terms and the longest run of each without a space."""
    longest = F.array_max(F.transform(F.split("term", " "), lambda run: F.struct(F.char_length(run).alias("size"), run.alias("run"))))["run"]
    # a term of spaces alone is its own run, and lies in a run of spaces
    return terms.select("term").where("term != ''").distinct().select("term", F.when(longest != "", longest).otherwise(F.col("term")).alias("run"))


def _words(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, id_2, word): the different words of each text that are long enough for a run."""
    blank = terms.agg(F.count_if(F.trim("term") == "") > 0).scalar()
    words = F.concat(F.split("text", " "), F.when(blank, F.regexp_extract_all("text", F.lit(" +"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    shortest = terms.agg(F.min(F.char_length("run"))).scalar()
    return texts.select(*ID, F.explode(F.array_distinct(words)).alias("word")).where(F.char_length("word") >= shortest)


def _found(whole_word: bool) -> Column:
    """Whether the text holds the term."""
    found = F.col("text").contains(F.col("term"))
    return found & F.rlike(F.col("text"), F.concat(F.lit(r"\b"), escaped(F.col("term")), F.lit(r"\b"))) if whole_word else found


def matches(texts: DataFrame, terms: DataFrame, whole_word: bool = False, gram: int = GRAM) -> DataFrame:
    """(text, term): every term (column ``term``) in every distinct text (column ``text``) that holds it.

    Empty and NULL terms match nothing. With ``whole_word`` a term counts between word boundaries only.
    ``gram`` is the length of the pieces that are filed: three suit cells; many words hold the same trigrams, so
    longer pieces, up to the shortest usual term, save checks. Any value gives the same result."""
    texts, terms = _with_ids(texts.select("text").distinct()), _with_runs(terms)
    held = _words(texts, terms)
    by_word = _within(held.select("word").distinct(), terms.select("run").distinct(), gram).join(terms, "run").select("word", "term", "run")
    hits = held.join(by_word, "word").select(*ID, "term", "run").distinct()
    settled = F.lit(False) if whole_word else F.col("term") == F.col("run")
    checked = hits.where(~settled).join(texts, ID).where(_found(whole_word)).select(*ID, "term")
    return hits.where(settled).select(*ID, "term").unionByName(checked).join(texts, ID).select("text", "term")


def add_match_counts(df: DataFrame, column: str, terms: DataFrame, out: str, whole_word: bool = False, gram: int = GRAM) -> DataFrame:
    """The rows of ``df`` whose column holds any term (column ``term``) of the table, with the number of different ones.

    Words are shuffled with their texts' ids and come back with the hashes of the terms in them, which are counted
    within each text. Texts are only shuffled for terms that their words don't settle, if there are any."""
    texts, terms = _with_ids(df.select(F.col(column).alias("text"))), _with_runs(terms)
    held = _words(texts, terms)
    settled = F.lit(False) if whole_word else F.col("term") == F.col("run")
    found = _within(held.select("word").distinct(), terms.groupBy("run").agg(F.max(settled).alias("settled"), F.max(~settled).alias("open")), gram, sieve=True)
    by_word = found.where("settled").groupBy("word").agg(F.collect_set(F.xxhash64("run")).alias("terms"))
    hits = held.join(by_word, "word").select(*ID, "terms")
    some = terms.agg(F.count_if(~settled) > 0).scalar()
    asked = found.where("open").join(terms.where(~settled), "run").select("word", "term")
    asked = held.where(some).join(asked, "word").select(*ID, "term").distinct()
    checked = asked.join(texts.where(some).distinct(), ID).where(_found(whole_word)).select(*ID, F.array(F.xxhash64("term")).alias("terms"))
    terms_of = F.array_distinct(F.flatten(F.collect_list("terms")))
    counts = hits.unionByName(checked).groupBy(*ID).agg(F.size(terms_of).cast("bigint").alias("__n")).toDF("__id", "__id_2", "__n")
    rows = df.where(F.col(column) != "").withColumns(dict(zip(["__row_id", "__row_id_2"], _ids(column))))
    joined = rows.join(counts, (F.col("__row_id") == F.col("__id")) & (F.col("__row_id_2") == F.col("__id_2")))
    return joined.withColumn(out, F.col("__n")).select(*df.columns, out)


def match_counts(texts: DataFrame, terms: DataFrame, out: str, whole_word: bool = False, gram: int = GRAM) -> DataFrame:
    """(text, ``out``): the number of rows of ``matches`` of every text that has any; no text is copied for its terms."""
    return add_match_counts(texts.select("text").distinct(), "text", terms, out, whole_word, gram)


def _looked_up(df: DataFrame, column: str, results: DataFrame) -> DataFrame:
    return df.join(results.withColumnRenamed("text", "__text"), F.col(column) == F.col("__text"), "left").drop("__text")


def add_contains_flag(df: DataFrame, column: str, terms: DataFrame, out: str, whole_word: bool = False) -> DataFrame:
    """FLT-14: whether the (normalized) column holds any term of the table."""
    hits = matches(df.select(F.col(column).alias("text")), terms, whole_word).select("text").distinct().withColumn(out, F.lit(True))
    return _looked_up(df, column, hits).withColumn(out, flag(F.col(out)))


def add_term_class(df: DataFrame, column: str, terms: DataFrame, out: str, whole_word: bool = False) -> DataFrame:
    """FLT-15: the ``label`` of the term with the largest ``place`` that the (normalized) column holds; NULL if none.
    ``terms`` has (term, label, place); of two with one place the larger label counts."""
    hits = matches(df.select(F.col(column).alias("text")), terms, whole_word).join(terms, "term")
    return _looked_up(df, column, hits.groupBy("text").agg(F.max(F.struct("place", "label"))["label"].alias(out)))


def add_listed_flag(df: DataFrame, columns, names: DataFrame, out: str) -> DataFrame:
    """FLT-9's list test: whether any of the (normalized) columns equals a name of the table (column ``term``)."""
    names = names.select(F.col("term").alias("text")).where("text IS NOT NULL").distinct()
    listed = F.lit(False)
    for i, c in enumerate(columns):
        df = _looked_up(df, c, names.withColumn(f"__listed_{i}", F.lit(True)))
        listed = listed | flag(F.col(f"__listed_{i}"))
    return df.withColumn(out, listed).drop(*[f"__listed_{i}" for i in range(len(columns))])
