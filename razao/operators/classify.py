"""Row classification: flags, exclusion reason, cost views (FLT-1, PRJ-3..7, PRJ-10,
PRJ-11, FLT-5..11, FLT-18).

All of these are per-row column expressions; none of them shuffles. Flags
are materialized in one projection and the rules that read them several
times (personal cost, exclusion reason) in the next, so each regex runs once
per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .. import schema as S
from ..functions.nulls import col_or, flag, flag_or
from ..functions.text import concat_text, contains_any, full_match, normalize, normalize_terms
from ..rules import DEFAULT_RULES, LedgerRules


def _norm_or_empty(df: DataFrame, name: str) -> Column:
    n = S.norm(name)
    if n in df.columns:
        return F.coalesce(F.col(n), F.lit(""))
    if name in df.columns:
        return normalize(name)
    return F.lit("")


def add_total_flag(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """FLT-1: ``is_total_line`` when the joined text columns contain a total word."""
    cols = [c for c in rules.roles.total_text_columns if c in df.columns]
    if not cols:
        return df.withColumn(S.IS_TOTAL, F.lit(False))
    if all(S.norm(c) in df.columns for c in cols):
        # Normalizing each field and joining with spaces equals normalizing the
        # joined text up to runs of spaces at empty fields, which the pattern
        # (word boundaries, ``\s*``) does not see.
        text = F.concat_ws(" ", *[F.col(S.norm(c)) for c in cols])
    else:
        text = normalize(concat_text(*[F.col(c) for c in cols]))
    return df.withColumn(S.IS_TOTAL, flag(text.rlike("(?i)" + rules.total_pattern)))


def _truthy(df: DataFrame, name: str, rules: LedgerRules) -> Column:
    """PRJ-5: normalized value in the truthy set; False when the column is absent."""
    if name not in df.columns:
        return F.lit(False)
    return flag(_norm_or_empty(df, name).isin(list(normalize_terms(rules.truthy))))


def add_transaction_flags(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """PRJ-3 + PRJ-4 on a ledger: stake, payout, card settlement, include,
    personal cost and one exclusion reason."""
    r = rules.roles
    category = _norm_or_empty(df, r.category)
    description = _norm_or_empty(df, r.description)
    origin = _norm_or_empty(df, r.account)
    combined = F.concat_ws(" ", category, description, origin)
    payout = full_match(category, normalize_terms(rules.payout_categories)) | _truthy(df, r.source_payout, rules)
    stake = full_match(category, normalize_terms(rules.stake_categories)) | _truthy(df, r.source_stake, rules)
    settlement = (
        contains_any(combined, normalize_terms(rules.settlement_terms), whole_word=True, loose_spaces=True)
        | full_match(category, normalize_terms(rules.card_categories))
    )
    df = df.withColumns({
        S.IS_PAYOUT: flag(payout),
        "__stake": flag(stake),
        S.IS_SETTLEMENT: flag(settlement),
        S.INCLUDE: _truthy(df, r.include_flag, rules),
    })
    df = df.withColumn(S.IS_STAKE, F.col("__stake") & ~F.col(S.IS_PAYOUT)).drop("__stake")
    valid = F.col(r.amount).isNotNull() if r.amount in df.columns else F.lit(False)
    total = F.col(S.IS_TOTAL)
    inc, pay, stk, stl = (F.col(S.INCLUDE), F.col(S.IS_PAYOUT), F.col(S.IS_STAKE), F.col(S.IS_SETTLEMENT))
    return df.withColumns({
        S.IS_PERSONAL: (inc | stl) & valid & ~total & ~stk & ~pay,
        S.REASON: (
            F.when(~valid, F.lit(R.REASON_INVALID))
            .when(total, F.lit(R.REASON_TOTAL))
            .when(pay, F.lit(R.REASON_PAYOUT))
            .when(stk, F.lit(R.REASON_STAKE))
            .when(~stl & ~inc, F.lit(R.REASON_NOT_INCLUDED))
            .otherwise(F.lit(""))
        ),
    })


# ---------------------------------------------------------------- predicates

def valid_base(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> Column:
    """FLT-7: amount present, not a total line, not a stake, not a payout."""
    amount = rules.roles.amount
    present = F.col(amount).isNotNull() if amount in df.columns else F.lit(False)
    return present & ~flag_or(df, S.IS_TOTAL) & ~flag_or(df, S.IS_STAKE) & ~flag_or(df, S.IS_PAYOUT)


def is_card_source(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> Column:
    """FLT-8: the account names a credit card."""
    return flag(contains_any(_norm_or_empty(df, rules.roles.account), normalize_terms(rules.card_source_terms)))


def is_adjustment(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> Column:
    """FLT-8: the category is an adjustment or rebate."""
    return flag(contains_any(_norm_or_empty(df, rules.roles.category), normalize_terms(rules.adjustment_terms)))


def is_shared_home(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> Column:
    """FLT-9: shared-home category and a cost or description in the shared-name list."""
    r = rules.roles
    names = list(normalize_terms(rules.shared_home_names))
    parts = [_norm_or_empty(df, c) for c in (r.cost_name, r.description) if c in df.columns or S.norm(c) in df.columns]
    match = F.lit(False)
    for p in parts:
        match = match | flag(p.isin(names))
    return (_norm_or_empty(df, r.category) == normalize_terms([rules.shared_home_category])[0]) & match


def apply_share(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """PRJ-6: scale the money columns by the share factor on shared-home rows."""
    cols = [c for c in rules.roles.share_columns if c in df.columns]
    if not cols:
        return df
    mask = is_shared_home(df, rules)
    df = df.withColumn("__shared", mask)
    factor = F.lit(rules.share_factor).cast("decimal(3,2)")
    return df.withColumns({
        c: F.when(F.col("__shared"), F.col(c) * factor).otherwise(F.col(c)) for c in cols
    }).drop("__shared")


def personal_costs(df: DataFrame) -> DataFrame:
    """FLT-5: rows that count as personal cost."""
    return df.where(flag_or(df, S.IS_PERSONAL))


def excluded_rows(df: DataFrame) -> DataFrame:
    """SET-4: the complement of FLT-5."""
    return df.where(~flag_or(df, S.IS_PERSONAL))


def is_bet_row(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> Column:
    category = _norm_or_empty(df, rules.roles.category)
    return flag_or(df, S.IS_STAKE) | flag_or(df, S.IS_PAYOUT) | flag(category.isin(list(rules.bet_categories)))


def non_bet_rows(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """FLT-6: drop stakes, payouts and the two betting categories (total lines stay)."""
    return df.where(~is_bet_row(df, rules))


def accrual_costs(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """FLT-10: valid, included, not a card settlement; then the shared-home share."""
    mask = valid_base(df, rules) & flag_or(df, S.INCLUDE) & ~flag_or(df, S.IS_SETTLEMENT)
    return apply_share(df.where(mask), rules)


def cash_costs(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """FLT-11: valid, not paid by card, not an adjustment, included or a settlement;
    then the shared-home share."""
    mask = (
        valid_base(df, rules)
        & ~is_card_source(df, rules)
        & ~is_adjustment(df, rules)
        & (flag_or(df, S.INCLUDE) | flag_or(df, S.IS_SETTLEMENT))
    )
    return apply_share(df.where(mask), rules)


# ---------------------------------------------------------------- projections

def cash_source(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> Column:
    """PRJ-7: account for the cash view; NULL -> 'Sem origem'; settlements and the
    card category are relabelled as the card."""
    r = rules.roles
    account = F.coalesce(col_or(df, r.account).cast("string"), F.lit(R.NO_SOURCE_LABEL))
    card = flag(col_or(df, r.category, "") == R.CARD_LABEL) | flag_or(df, S.IS_SETTLEMENT)
    return F.when(card, F.lit(R.CARD_LABEL)).otherwise(account)


def category_note(category: Column, context: str) -> Column:
    """PRJ-10: explanatory text per category for the cash or accrual view."""
    if context == "cash":
        out = F.lit(R.CASH_NOTE_DEFAULT)
        for name, text in reversed(R.CASH_NOTES):
            out = F.when(category == name, F.lit(text)).otherwise(out)
        return out
    head, tail = R.ACCRUAL_NOTE_TEMPLATE
    out = F.concat(F.lit(head), F.lower(category), F.lit(tail))
    for name, text in reversed(R.ACCRUAL_NOTES):
        out = F.when(category == name, F.lit(text)).otherwise(out)
    return out


def category_display(category: Column) -> Column:
    return F.concat(category.cast("string"), F.lit(R.DISPLAY_SUFFIX))


def split_bet_measures(df: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """PRJ-11: staked and returned amounts side by side plus a type label."""
    amount = F.col(rules.roles.amount)
    return df.withColumns({
        "bet_type": F.when(F.col(S.IS_PAYOUT), F.lit(R.BET_PAYOUT_LABEL)).otherwise(F.lit(R.BET_STAKE_LABEL)),
        "staked": F.when(F.col(S.IS_STAKE), amount).otherwise(F.lit(0)),
        "returned": F.when(F.col(S.IS_PAYOUT), amount).otherwise(F.lit(0)),
    })


def receivable_group(item: Column, kind: Column, value: Column,
                     rules: LedgerRules = DEFAULT_RULES, item_normalized: bool = False) -> Column:
    """FLT-18: total -> rebate -> exclusive -> shared -> other."""
    item_n = item if item_normalized else normalize(item)
    kind_n = normalize(kind)
    exclusive = contains_any(item_n, normalize_terms(rules.exclusive_terms))
    return (
        F.when(kind_n == rules.total_kind, F.lit(R.GROUP_TOTAL))
        .when((value < 0) | kind_n.contains(rules.rebate_kind) | item_n.contains(rules.rebate_item), F.lit(R.GROUP_REBATE))
        .when(exclusive, F.lit(R.GROUP_EXCLUSIVE))
        .when(kind_n == normalize_terms([R.RECEIVABLE_HOUSE_TYPE])[0], F.lit(R.GROUP_SHARED))
        .otherwise(F.lit(R.GROUP_OTHER))
    )
