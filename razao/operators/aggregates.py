"""Aggregates, analytic functions, ordering and set operations (AGG-*, WIN-*,
SRT-*, SET-*, JON-1..4, JON-7).

Scale notes, which every function here follows:

* grouping keys are low-cardinality business keys (period, category,
  account, item); Spark aggregates partially on the map side, so the shuffle
  carries at most (tasks x keys) rows however large the ledger is, and a hot
  key (one category holding a third of the rows) is pre-reduced per task
  before it moves;
* NULL keys are dropped before grouping (pandas ``groupby`` semantics) and
  empty sums are 0;
* a share of a grand total reads the total as a scalar subquery (one row,
  computed once) instead of a window over all rows;
* windows without a partition key only run on frames already aggregated to
  one row per period, whose size is bounded by the calendar, never on raw
  rows;
* joins between aggregated frames use plain ``join``; AQE turns them into
  broadcast joins from measured sizes, so nothing is broadcast on a guess.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from .. import schema as S
from ..functions.nulls import asc_last, desc_last, flag, sum0
from ..functions.periods import month_label
from ..rules import DEFAULT_RULES, LedgerRules
from ..session import ensure_checkpoint_dir


def _money(c: Column) -> Column:
    return c.cast("double")


# ------------------------------------------------------------------ AGG

def monthly_sum(df: DataFrame, value_col: str, out: str = "value") -> DataFrame:
    """AGG-1: sum per period (NULL period dropped), labelled, in period order."""
    if value_col not in df.columns or S.PERIOD not in df.columns:
        return df.sparkSession.createDataFrame([], f"{S.PERIOD} string, {S.PERIOD_LABEL} string, {out} double")
    return (df.where(F.col(S.PERIOD).isNotNull())
            .groupBy(S.PERIOD).agg(sum0(F.col(value_col)).alias(out))
            .withColumn(S.PERIOD_LABEL, month_label(F.col(S.PERIOD)))
            .select(S.PERIOD, S.PERIOD_LABEL, out)
            .orderBy(S.PERIOD))


def total_sum(df: DataFrame, value_col: str, out: str = "total") -> DataFrame:
    """AGG-2: one-row grand total; NULL counts as 0, a missing column gives 0."""
    if value_col not in df.columns:
        return df.sparkSession.range(1).select(F.lit(0).cast("decimal(38,8)").alias(out))
    return df.agg(sum0(F.col(value_col)).alias(out))


def group_count_sum(df: DataFrame, key: str | Column, value_col: str, key_name: str | None = None,
                    count_name: str = "row_count", sum_name: str = "total") -> DataFrame:
    """AGG-3: row count (NULL values included) and sum per key, largest sum first."""
    k = F.col(key) if isinstance(key, str) else key
    name = key_name or (key if isinstance(key, str) else "key")
    return (df.where(k.isNotNull())
            .groupBy(k.alias(name))
            .agg(F.count(F.lit(1)).alias(count_name), sum0(F.col(value_col)).alias(sum_name))
            .orderBy(desc_last(sum_name), asc_last(name)))


def sum_by(df: DataFrame, keys, value_col: str, out: str = "value") -> DataFrame:
    """AGG-5: sum per key set; rows with a NULL key are dropped."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(sum0(F.col(value_col)).alias(out))


def card_statement(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """AGG-4 + FLT-17: valid card-paid rows summed per period, zero sums dropped,
    labelled as the card category."""
    from .classify import is_card_source, valid_base
    amount = rules.roles.amount
    schema = f"{S.PERIOD} string, {S.PERIOD_LABEL} string, {rules.roles.category} string, {amount} decimal(38,8)"
    if amount not in df.columns or S.PERIOD not in df.columns:
        return df.sparkSession.createDataFrame([], schema)
    card = df.where(valid_base(df, rules) & is_card_source(df, rules) & F.col(S.PERIOD).isNotNull())
    return (card.groupBy(S.PERIOD).agg(sum0(F.col(amount)).alias(amount))
            .where(F.col(amount) != 0)
            .select(S.PERIOD, month_label(F.col(S.PERIOD)).alias(S.PERIOD_LABEL),
                    F.lit(R.CARD_LABEL).alias(rules.roles.category), amount))


def mean(c: Column) -> Column:
    """AGG-10 as an aggregate expression: exact sum as double over the count of
    non-NULL values, so the result does not depend on summation order."""
    return F.sum(c).cast("double") / F.count(c)


def mean_by(df: DataFrame, key: str, value_col: str, out: str = "mean") -> DataFrame:
    """AGG-10 per group: the mean of each group's non-NULL values; groups without any are left out."""
    return (df.where(F.col(key).isNotNull() & F.col(value_col).isNotNull())
            .groupBy(key).agg(mean(F.col(value_col)).alias(out)))


def smallest_values(df: DataFrame, key: str, value_col: str, k: int = 3) -> DataFrame:
    """Per key: the k smallest distinct non-empty values (sorted) and the number of
    distinct values, without gathering a group in one place.

    The distinct pairs are counted by partial aggregation. The rank limit is
    applied within each task before the pairs are shuffled, so at most k values
    of a key travel from each task.
    """
    v = F.col(value_col)
    pairs = (df.where(F.col(key).isNotNull() & v.isNotNull() & (v.cast("string") != ""))
             .select(key, v.alias("__v")).distinct())
    order = Window.partitionBy(key).orderBy("__v")
    first = pairs.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k)
    values = first.groupBy(key).agg(F.sort_array(F.collect_list("__v")).alias("values"))  # k at most
    return values.join(pairs.groupBy(key).agg(F.count("*").alias("distinct_count")), key)


def extent(df: DataFrame, columns, prefix: str = "") -> DataFrame:
    """AGG-15: smallest and largest value over several measure columns."""
    cols = [F.col(c) for c in columns]
    return df.agg(F.min(F.least(*cols)).alias(prefix + "min_value"),
                  F.max(F.greatest(*cols)).alias(prefix + "max_value"))


#: Log2 of a sketch's registers: a standard error of about 0.4 % in 64 KB at most.
SKETCH_SIZE = 16


def distinct_sketches(df: DataFrame, keys, item_col: str) -> DataFrame:
    """AGG-9, approximate: one mergeable sketch of the distinct items for each key (NULL items excluded),
    so that any selection of keys is answered from the few sketches and not from the rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).groupBy(*keys)
            .agg(F.hll_sketch_agg(F.col(item_col).cast("string"), SKETCH_SIZE).alias("sketch")))


def distinct_estimate(sketches: DataFrame, keys=(), out: str = "distinct_items") -> DataFrame:
    """The estimated number of distinct items over all given sketches, or for each value of ``keys``."""
    return sketches.groupBy(*keys).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias(out))


def subtotals(df: DataFrame, levels, value_col: str, out: str = "value") -> DataFrame:
    """AGG-7: detail, per-group subtotal and grand total in one aggregation
    (GROUPING SETS), with ``level`` 0 = detail, 1 = subtotal, 2 = grand total."""
    levels = list(levels)
    sets = [levels, levels[:1], []]
    g = df.groupingSets(sets, *levels).agg(sum0(F.col(value_col)).alias(out), F.grouping_id().alias("__gid"))
    full = (1 << len(levels)) - 1
    level = F.when(F.col("__gid") == 0, F.lit(0)).when(F.col("__gid") == full, F.lit(2)).otherwise(F.lit(1))
    return g.withColumn("level", level).drop("__gid")


# ------------------------------------------------------------------ WIN

def with_change(df: DataFrame, value_col: str, order_col: str = S.PERIOD) -> DataFrame:
    """WIN-1 + WIN-2 on a per-period frame: change vs the previous row, in value
    and percent (NULL on the first row or a zero base), and its direction."""
    w = Window.orderBy(F.col(order_col).asc_nulls_last())
    prev = F.lag(F.col(value_col)).over(w)
    v = F.col(value_col).cast("double")
    p = prev.cast("double")
    return (df.withColumn("change", v - p)
              .withColumn("change_pct", F.when(p == 0, F.lit(None).cast("double")).otherwise(F.try_divide(v - p, p) * 100.0))
              .withColumn("direction", F.when(F.col("change").isNull(), F.lit(None).cast("string"))
                          .when(F.col("change") >= 0, F.lit("up")).otherwise(F.lit("down"))))


def running_sum(df: DataFrame, value_col: str, out: str, order_col: str = S.PERIOD) -> DataFrame:
    """WIN-4: cumulative sum in period order (on a per-period frame)."""
    w = Window.orderBy(F.col(order_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(F.col(value_col)).over(w))


def running_rows(df: DataFrame, value_col: str, order_cols, total: str = "running", previous: str = "previous") -> DataFrame:
    """WIN-4 + WIN-1 on rows: the running sum of a value and its value in the row before, in the order of
    ``order_cols`` (NULL last; they should identify a row, since equal rows come in no fixed order).

    No window sees all rows. The rows are written once in ranges of the order, to the shared checkpoint
    folder, so that a range is the same for all that follows; each range's sum and last value are added up
    over the ranges (one row each) and handed back; the rest are windows within a range. The table of
    ranges is broadcast: it has as many rows as the shuffle has partitions."""
    order = [asc_last(c) for c in order_cols]
    place = F.struct(*[x for c in order_cols for x in (F.col(c).isNull(), F.col(c))])
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/razao-ranges/{uuid.uuid4().hex}"
    df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    ranges = rows.groupBy("__range").agg(sum0(F.col(value_col)).alias("__sum"), F.max_by(value_col, place).alias("__last"))
    along = Window.orderBy("__range")
    before = ranges.select("__range", F.coalesce(F.sum("__sum").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
                           F.lag("__last").over(along).alias("__carried"))
    w = Window.partitionBy("__range").orderBy(*order)
    return (rows.join(F.broadcast(before), "__range")
            .withColumn(total, F.col("__before") + F.coalesce(F.sum(value_col).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
            .withColumn(previous, F.when(F.row_number().over(w) == 1, F.col("__carried")).otherwise(F.lag(value_col).over(w)))
            .drop("__range", "__before", "__carried"))


def share_of_total(df: DataFrame, value_col: str, out: str = "share_pct") -> DataFrame:
    """WIN-5: each row's percent of the column total; 0 when the total is 0.

    The total is a scalar subquery: Spark computes one number in its own small
    job and inlines it; no window funnels the rows into one task.
    """
    total = df.select(F.sum(F.col(value_col)).cast("double")).scalar()
    v = F.col(value_col).cast("double")
    return df.withColumn(out, F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(v / total * 100.0))


# ------------------------------------------------------------------ SRT

def top_k(df: DataFrame, k: int, value_col: str, key_col: str) -> DataFrame:
    """SRT-2: the k largest rows (ties by key); a distributed top-k, no full sort."""
    return df.orderBy(desc_last(value_col), asc_last(key_col)).limit(k)


def top_k_with_others(df: DataFrame, k: int, key_col: str, value_col: str,
                      others_label: str = R.OTHERS_LABEL) -> DataFrame:
    """SRT-3: keep the k largest groups and fold the rest into one 'Outros' row.

    The k leaders are found with a distributed top-k; the k-row result is
    joined back (bounded by k), so no window puts every group in one task.
    """
    leaders = top_k(df.select(key_col, value_col), k, value_col, key_col).select(
        F.col(key_col).alias("__leader"), F.lit(True).alias("__is_leader"))
    tagged = df.join(leaders, F.col(key_col) == F.col("__leader"), "left")
    label = F.when(flag(F.col("__is_leader")), F.col(key_col)).otherwise(F.lit(others_label))
    order = F.when(flag(F.col("__is_leader")), F.lit(0)).otherwise(F.lit(1))
    return (tagged.groupBy(label.alias(key_col), order.alias("__bucket"))
            .agg(sum0(F.col(value_col)).alias(value_col))
            .orderBy("__bucket", desc_last(value_col), asc_last(key_col)).drop("__bucket"))


def sample(df: DataFrame, columns, order_cols, n: int = 100) -> DataFrame:
    """SRT-4: the first n rows by a key (deterministic), existing columns only."""
    cols = [c for c in columns if c in df.columns]
    return df.orderBy(*[asc_last(c) for c in order_cols if c in df.columns]).select(*cols).limit(n)


def rank_of(c: Column, order, unknown: int = 9) -> Column:
    """SRT-5 / JON-7: position of a value in a fixed order; unknown -> 9."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.element_at(m, c), F.lit(unknown))


# ------------------------------------------------------------------ SET / JON

def union_all(*frames: DataFrame) -> DataFrame:
    """SET-1 / SET-2: UNION ALL by name, missing columns filled with NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """SET-3: distinct non-NULL pairs."""
    return df.select(a, b).dropna().distinct()


def conditional_monthly(df: DataFrame, value_col: str, measures: dict[str, Column]) -> DataFrame:
    """JON-1 / JON-2 in one pass: per-period sums of the value under several
    conditions, one shuffle instead of an outer-join chain of separate
    aggregates. Periods with no row under a condition get 0."""
    v = F.col(value_col)
    aggs = [sum0(F.when(flag(cond), v)).alias(name) for name, cond in measures.items()]
    return (df.where(F.col(S.PERIOD).isNotNull()).groupBy(S.PERIOD).agg(*aggs)
            .withColumn(S.PERIOD_LABEL, month_label(F.col(S.PERIOD))))


def merge_by_key(frames: dict[str, tuple[DataFrame, str]], key: str = S.PERIOD) -> DataFrame:
    """JON-1 for any number of separate frames: the sum of each frame's measure by key, 0 where a frame
    has no row. ``frames`` maps an output name to (frame, measure).

    The frames are united with a tag and aggregated once, so there is one shuffle whatever their number,
    where a chain of outer joins has one for each."""
    tagged = [df.where(F.col(key).isNotNull()).select(F.col(key), F.lit(name).alias("__frame"), F.col(value).cast("decimal(38,8)").alias("__value"))
              for name, (df, value) in frames.items()]
    sums = [sum0(F.when(F.col("__frame") == name, F.col("__value"))).alias(name) for name in frames]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(*sums)
