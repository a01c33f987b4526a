"""Wildcard rule matching on payments: matching, fees, what-if deltas and steering."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.plans.keyed import join_null_safe, pick_per_key
from evalspark.session import materialize

# Bucket bounds (exclusive upper bounds) and their labels.
VOLUME_BOUNDS = [(100000, "<100k"), (1000000, "100k-1m"), (5000000, "1m-5m")]
VOLUME_REST = ">5m"
FRAUD_BOUNDS = [(7.2, "<7.2%"), (7.7, "7.2%-7.7%"), (8.3, "7.7%-8.3%")]
FRAUD_REST = ">8.3%"
# Authorisation types that a steering question may choose from.
CANDIDATE_ACIS = ["A", "B", "C", "D", "E", "F"]

RULE_DIMS = [
    "card_scheme",
    "account_type",
    "merchant_category_code",
    "capture_delay",
    "aci",
    "is_credit",
    "intracountry",
    "monthly_volume",
    "monthly_fraud_level",
]
# the dimensions that a payment has itself; those of its merchant and month are the rest
PAYMENT_DIMS = ["card_scheme", "aci", "is_credit", "intracountry"]
MONTH = ["merchant", "year", "month"]


# ---------------------------------------------------------------- column expressions


def doy_to_date(year: Column, doy: Column) -> Column:
    """Date of the given day of the year."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def doy_to_month(year: Column, doy: Column) -> Column:
    return F.month(doy_to_date(year, doy))


def bucket_range(value: Column, bounds: list[tuple[float, str]], other: str) -> Column:
    """Label of the first bound above ``value``; NULL and everything else give ``other``."""
    (first, label), *more = bounds
    chain = F.when(value < first, label)
    for bound, name in more:
        chain = chain.when(value < bound, name)
    return chain.otherwise(other)


def bucket_capture_delay(delay: Column) -> Column:
    """Days as text become ``<3``, ``3-5`` or ``>5``; words pass through."""
    days = delay.try_cast("int")
    return F.when(days < 3, "<3").when(days <= 5, "3-5").when(days > 5, ">5").otherwise(delay)


def intracountry_flag(issuing: Column, acquiring: Column) -> Column:
    """1.0 when both countries are known and equal, else 0.0."""
    return F.when(issuing == acquiring, 1.0).otherwise(0.0)


def fee_amount(fixed: Column, rate: Column, amount: Column) -> Column:
    """Fixed part plus basis points of the amount."""
    return fixed + rate / F.lit(10000.0) * amount


def fraud_rate(amount: Column, fraud: Column) -> Column:
    """Amount-weighted fraud percentage of a group; NULL without volume."""
    bad = F.sum(F.when(fraud, amount).otherwise(0.0))
    return F.try_divide(bad, F.nullif(F.sum(amount), F.lit(0.0))) * 100


# ---------------------------------------------------------------- profile and statistics


def merchant_profile(merchants: DataFrame) -> DataFrame:
    """Distinct merchant attributes with the bucketed capture delay."""
    return merchants.select(
        "merchant",
        "account_type",
        "merchant_category_code",
        bucket_capture_delay(F.col("capture_delay")).alias("capture_delay"),
    ).distinct()


def with_month(payments: DataFrame) -> DataFrame:
    return payments.withColumn("month", doy_to_month(F.col("year"), F.col("day_of_year")))


def monthly_merchant_stats(payments: DataFrame) -> DataFrame:
    """Volume, fraud percentage and both buckets per merchant, year and month."""
    amount, fraud = F.col("eur_amount"), F.col("has_fraudulent_dispute")
    stats = with_month(payments).groupBy(*MONTH).agg(
        F.sum(amount).alias("total_volume"), fraud_rate(amount, fraud).alias("fraud_pct")
    )
    return stats.withColumn(
        "monthly_volume", bucket_range(F.col("total_volume"), VOLUME_BOUNDS, VOLUME_REST)
    ).withColumn("monthly_fraud_level", bucket_range(F.col("fraud_pct"), FRAUD_BOUNDS, FRAUD_REST))


def payment_facts(
    payments: DataFrame,
    merchants: DataFrame,
    override_mcc: int | None = None,
) -> DataFrame:
    """Payments with every dimension a fee rule can ask for."""
    profile = merchant_profile(merchants)
    if override_mcc is not None:
        profile = profile.withColumn("merchant_category_code", F.lit(override_mcc).cast("bigint"))
    stats = monthly_merchant_stats(payments)
    flagged = with_month(payments).withColumn(
        "intracountry", intracountry_flag(F.col("issuing_country"), F.col("acquirer_country"))
    )
    return flagged.join(profile, "merchant").join(stats, MONTH)


# ---------------------------------------------------------------- the rule join


def _mask_key(cols: list[Column], mask: Column) -> Column:
    """Hash of the masked dimensions: bit ``i`` set means dimension ``i`` is a wildcard."""
    parts = [
        F.when(mask.bitwiseAND(F.lit(1 << i)) == 0, F.xxhash64(F.lit(i), c)) for i, c in enumerate(cols)
    ]
    return F.xxhash64(*parts)


def _hashable(tuples: DataFrame, rules: DataFrame, dims: list[str]) -> list[str]:
    """Dimensions whose equality can be told from a hash: both sides of one type, or both numbers."""
    ours, theirs = tuples.schema, rules.schema
    numbers = lambda d: isinstance(ours[d].dataType, T.NumericType) and isinstance(theirs[d].dataType, T.NumericType)
    return [d for d in dims if ours[d].dataType == theirs[d].dataType or numbers(d)]


def match_tuples(
    tuples: DataFrame,
    rules: DataFrame,
    dims: list[str] = RULE_DIMS,
    key_dims: list[str] | None = None,
) -> DataFrame:
    """Every (row, rule) pair whose rule dimensions all equal the row's or are NULL, for narrow rows.

    A direct ``equal or NULL`` condition has no hash key, so Spark would compare every row
    with every rule. Each rule has a wildcard mask over ``key_dims`` (all dimensions unless given); a row is
    expanded into one probe per mask that some rule has (``2 ** len(key_dims)`` at most) and meets rules through an
    equi join. With all dimensions in the key a probe meets matching rules only, however many rules there are.
    The full condition is checked again on the candidates, so the result is exact.
    Spark broadcasts the rules while their size allows it and sorts otherwise, splitting hot keys such as
    the one of rules without any key dimension. Rule columns come out with the prefix ``rule_``.
    """
    keys = _hashable(tuples, rules, dims) if key_dims is None else key_dims
    keys = keys or dims[:4]
    prefixed = rules.select(*[F.col(c).alias(f"rule_{c}") for c in rules.columns])
    mask = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.col(f"rule_{d}").isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, d in enumerate(keys)],
    )
    right = prefixed.withColumn("_rmask", mask).withColumn(
        "_rkey", _mask_key([F.col(f"rule_{d}") for d in keys], F.col("_rmask"))
    )
    # the masks that some rule has, at most 2 ** len(keys)
    masks = right.agg(F.array_sort(F.collect_set("_rmask")).alias("m")).scalar()
    left = tuples.withColumn("_mask", F.explode(masks)).withColumn(
        "_key", _mask_key([F.col(d).try_cast(rules.schema[d].dataType) for d in keys], F.col("_mask"))
    )
    cond = (F.col("_mask") == F.col("_rmask")) & (F.col("_key") == F.col("_rkey"))
    for d in dims:
        cond = cond & (F.col(f"rule_{d}").isNull() | (F.col(f"rule_{d}") == F.col(d)))
    return left.join(right, cond, "inner").drop("_mask", "_key", "_rmask", "_rkey")


def with_kinds(rules: DataFrame, dims: list[str] = RULE_DIMS) -> DataFrame:
    """Rules with ``_kind``, a number that rules of equal dimensions share; written, so that the numbers stay."""
    kinds = rules.select(*dims).distinct().withColumn("_kind", F.monotonically_increasing_id())
    return materialize(join_null_safe(rules, materialize(kinds, "rule_kinds"), dims), "rules")


def _kinds(numbered: DataFrame, dims: list[str] = RULE_DIMS) -> DataFrame:
    """One rule per kind, with the kind as its id."""
    return numbered.select(F.col("_kind").alias("id"), *dims).distinct()


def _halves(dims: list[str]) -> list[list[str]]:
    """The dimensions of a payment itself and those of its merchant and month; both halves have some if there are two."""
    own = [d for d in dims if d in PAYMENT_DIMS]
    rest = [d for d in dims if d not in PAYMENT_DIMS]
    return [own, rest] if own and rest else [dims[: len(dims) // 2], dims[len(dims) // 2 :]]


def _half_matches(tuples: DataFrame, kinds: DataFrame, dims: list[str], side: str) -> DataFrame:
    """What the distinct values of some dimensions (``_t`` and side) match among those of the rules (``_k`` and side)."""
    met = match_tuples(tuples.select(*dims).distinct(), kinds.select(*dims).distinct(), dims)
    return met.select(F.struct(*dims).alias(f"_t{side}"), F.struct(*[F.col(f"rule_{d}").alias(d) for d in dims]).alias(f"_k{side}"))


def _in_halves(tuples: DataFrame, kinds: DataFrame, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tuples and kinds of rules, each next to what it matches by one half of the dimensions.

    A tuple (``_ta``, ``_tb``) comes with the second halves of rules that match it (``_kb``), a kind with the first halves of
    tuples that it matches (``_ta``), so an equi join on ``_ta`` and ``_kb`` gives all matches. Only the distinct values of a half are
    expanded per wildcard mask, 2 ** 4 and 2 ** 5 at most for nine dimensions, while whole tuples would be per mask of all.
    """
    first, second = _halves(dims)
    asked = tuples.withColumns({"_ta": F.struct(*first), "_tb": F.struct(*second)}).join(_half_matches(tuples, kinds, second, "b"), "_tb")
    offered = kinds.withColumns({"_ka": F.struct(*first), "_kb": F.struct(*second)}).join(_half_matches(tuples, kinds, first, "a"), "_ka")
    return asked.drop("_tb"), offered.drop("_ka")


def _met_kinds(
    facts: DataFrame, numbered: DataFrame, dims: list[str] = RULE_DIMS, key_dims: list[str] | None = None
) -> DataFrame:
    """Facts with the ``_kind`` of the rules that match: at most one kind per wildcard mask and fact.

    Only the distinct dimension tuples of the facts meet the kinds; facts are joined back to the
    matches. A tuple is one key, NULL equal to NULL; a tuple that many facts share is split by Spark's skew join.
    """
    # many tuples share a hash task's rows with much work each: keep them spread over all tasks
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tuples = facts.select(*dims).repartition(parts, *dims).distinct()
    if key_dims is None and len(dims) > 1:
        asked, offered = _in_halves(tuples, numbered.select("_kind", *dims).distinct(), dims)
        matches = asked.select(F.struct(*dims).alias("_tuple"), "_ta", "_kb").join(offered.select("_ta", "_kb", "_kind"), ["_ta", "_kb"])
        matches = matches.select("_tuple", "_kind")
    else:
        matches = match_tuples(tuples, _kinds(numbered, dims), dims, key_dims).select(
            F.struct(*dims).alias("_tuple"), F.col("rule_id").alias("_kind")
        )
    joined = facts.withColumn("_own", F.struct(*dims)).join(matches, F.col("_own") == F.col("_tuple"))
    return joined.drop("_own", "_tuple")


def wildcard_rule_join(
    facts: DataFrame,
    rules: DataFrame,
    dims: list[str] = RULE_DIMS,
    key_dims: list[str] | None = None,
) -> DataFrame:
    """Every (fact, rule) pair whose rule dimensions all equal the fact's or are NULL.

    Facts meet kinds of rules (``_met_kinds``), and the rules of a kind are joined last: wide facts are neither copied
    per mask nor compared with a rule, and no pair is shuffled where Spark broadcasts the rules.
    """
    numbered = with_kinds(rules, dims)
    prefixed = numbered.select(F.col("_kind"), *[F.col(c).alias(f"rule_{c}") for c in rules.columns])
    met = _met_kinds(facts, numbered, dims, key_dims).withColumnRenamed("_kind", "_met")
    return met.join(prefixed, F.col("_met") == F.col("_kind")).drop("_met", "_kind")


def rule_usage(
    join: Callable[[DataFrame, DataFrame], DataFrame], facts: DataFrame, rules: DataFrame, dims: list[str]
) -> DataFrame:
    """Number of pairs and their amount per rule id; ``join`` is a rule join on ``dims``.

    Both are sums, so the join gets the facts summed per dimension tuple and one rule per kind; single facts and
    rules are never paired.
    """
    # read several times by the join; written once, so that the facts behind the groups are scanned once
    groups = materialize(facts.groupBy(*dims).agg(F.count(F.lit(1)).alias("pairs"), F.sum("eur_amount").alias("amount")), "fact_groups")
    sums = [F.sum("pairs").alias("pairs"), F.sum("amount").alias("amount")]
    numbered = with_kinds(rules, dims)
    used = join(groups, _kinds(numbered, dims)).groupBy("rule_id").agg(*sums)
    each = numbered.select("id", "_kind").join(used, F.col("_kind") == F.col("rule_id"))
    return each.groupBy(F.col("id").alias("fees_id")).agg(*sums)


def rules_used(groups: DataFrame, rules: DataFrame, by: list[str], kept: bool = True) -> DataFrame:
    """Distinct ``by`` columns and id (``fees_id``) of the rules that match a group with the rule dimensions.

    The values of ``by`` meet the first halves of rules (``_a``), which are few, and the tuples of their second halves (``_t``) the second
    halves of rules (``_b``), so what a value matches is told apart before a rule is joined: each value and rule come out once, without a
    distinct over the output. With one second half, rules are joined by it and ``_a``. With several, which may match the same rules,
    the first halves are gathered as bits next to each ``_b``. Only ids that stand for rules of several kinds can repeat there.
    ``kept`` says that the groups are written, so that they may be read at once to number their second halves.
    """
    first, second = _halves(RULE_DIMS)

    def numbered(dims: list[str], name: str) -> DataFrame:
        return materialize(rules.select(*dims).distinct().withColumn(name, F.monotonically_increasing_id()), "rule_halves")

    firsts, seconds = numbered(first, "_a"), numbered(second, "_b")
    of_rules = join_null_safe(join_null_safe(rules.select("id", *RULE_DIMS), firsts, first), seconds, second)
    of_rules = materialize(of_rules.select("id", "_a", "_b").distinct(), "rules")
    tuples = groups.select(*second).distinct()
    name = F.monotonically_increasing_id() if kept else F.struct(*second)
    tuples = tuples.withColumn("_t", name)
    tuples = materialize(tuples, "second_halves") if kept else tuples

    met_a = match_tuples(groups.select(*first).distinct(), firsts, first).select(F.struct(*first).alias("_ta"), F.col("rule__a").alias("_a"))
    met_b = match_tuples(tuples, seconds, second).select("_t", F.col("rule__b").alias("_b"))
    named = tuples.select(F.struct(*second).alias("_tb"), "_t")
    values = groups.select(*by, F.struct(*first).alias("_ta"), F.struct(*second).alias("_tb")).distinct()
    met = values.join(named, "_tb").join(met_a, "_ta").select(*by, "_t", "_a").distinct()
    if kept:
        met, met_b = materialize(met, "first_halves"), materialize(met_b, "second_matches")
    more = met.groupBy(*by).agg(F.min("_t").alias("_low"), F.max("_t").alias("_high")).where("_low <> _high").select(*by)
    lone, several = join_null_safe(met, more, by, "left_anti"), join_null_safe(met, more, by, "left_semi")
    word, bit = F.shiftright("_a", 6).alias("_w"), F.expr("shiftleft(1L, cast(_a % 64 as int))")
    bits = several.groupBy(*by, "_t", word).agg(F.bit_or(bit).alias("_bits"))
    bits = bits.join(met_b, "_t").groupBy(*by, "_b", "_w").agg(F.bit_or("_bits").alias("_bits"))

    parts = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def used(ids: DataFrame) -> DataFrame:
        offered = met_b.join(lone.select("_t").distinct(), "_t", "left_semi").join(ids, "_b").select("_t", "_a", "id")
        # few bytes give very many rows: spread over all tasks
        alone = lone.repartition(parts, "_t", "_a").join(offered, ["_t", "_a"]).select(*by, F.col("id").alias("fees_id"))
        both = bits.repartition(parts, "_b", "_w").join(ids.select("_b", word, bit.alias("_bit"), "id"), ["_b", "_w"])
        return alone.unionByName(both.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*by, F.col("id").alias("fees_id")))

    repeated = of_rules.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id")
    if repeated.isEmpty():
        return used(of_rules)
    single, again = (join_null_safe(of_rules, repeated, ["id"], how) for how in ("left_anti", "left_semi"))
    return used(single).unionByName(used(again).distinct())


def explode_rules(rules: DataFrame, list_dims: list[str]) -> DataFrame:
    """List form to scalar-or-NULL form: one row per combination of listed values.

    NULL and empty lists become one NULL; repeated list values count once.
    """
    out = rules
    for d in list_dims:
        out = out.withColumn(d, F.explode_outer(F.array_distinct(F.col(d))))
    return out


def list_rule_join(
    facts: DataFrame, rules: DataFrame, dims: list[str], list_dims: list[str]
) -> DataFrame:
    """Rule join for list-valued dimensions: NULL or empty means any, else membership.

    A fact equals at most one value of a list, so the exploded rules match a (fact, rule) pair
    at most once and no pair has to be removed afterwards.
    """
    return wildcard_rule_join(facts, explode_rules(rules, list_dims), dims)


# ---------------------------------------------------------------- transaction level


def merchant_transaction_fees(payments: DataFrame, merchants: DataFrame, fees: DataFrame) -> DataFrame:
    """One row per transaction and applicable rule, with the fee."""
    pairs = wildcard_rule_join(payment_facts(payments, merchants), fees)
    return pairs.select(
        F.col("merchant").alias("payments_merchant"),
        F.col("year").alias("payments_year"),
        F.col("day_of_year").alias("payments_day_of_year"),
        F.col("eur_amount").alias("payments_eur_amount"),
        F.col("card_scheme").alias("payments_card_scheme"),
        F.col("aci").alias("payments_aci"),
        F.col("is_credit").alias("payments_is_credit"),
        F.col("issuing_country").alias("payments_issuing_country"),
        F.col("acquirer_country").alias("payments_acquirer_country"),
        F.col("has_fraudulent_dispute").alias("payments_has_fraudulent_dispute"),
        F.col("intracountry").alias("derived_intracountry"),
        F.col("month").alias("derived_month"),
        fee_amount(F.col("rule_fixed_amount"), F.col("rule_rate"), F.col("eur_amount")).alias(
            "derived_fee_amount"
        ),
        F.col("rule_id").alias("fees_id"),
        F.col("rule_fixed_amount").alias("fees_fixed_amount"),
        F.col("rule_rate").alias("fees_rate"),
        F.col("account_type").alias("merchants_account_type"),
        F.col("merchant_category_code").alias("merchants_mcc"),
        F.col("capture_delay").alias("derived_capture_delay_range"),
        F.col("total_volume").alias("derived_monthly_volume"),
        F.col("fraud_pct").alias("derived_monthly_fraud_pct"),
        F.col("monthly_volume").alias("derived_volume_range"),
        F.col("monthly_fraud_level").alias("derived_fraud_level_range"),
    )


def _scoped(payments: DataFrame, merchants: DataFrame, merchant: str | None, year: int | None):
    # filters go in before the monthly aggregate, which Catalyst could not push through alone
    if merchant is not None:
        payments = payments.filter(F.col("merchant") == merchant)
        merchants = merchants.filter(F.col("merchant") == merchant)
    if year is not None:
        payments = payments.filter(F.col("year") == year)
    return payments, merchants


def merchant_fee_matches(
    payments: DataFrame,
    merchants: DataFrame,
    fees: DataFrame,
    year: int | None = None,
    merchant: str | None = None,
    override_mcc: int | None = None,
) -> DataFrame:
    """Transaction and rule pairs of one or all merchants, optionally with another category code."""
    payments, merchants = _scoped(payments, merchants, merchant, year)
    pairs = wildcard_rule_join(payment_facts(payments, merchants, override_mcc), fees)
    return pairs.select(
        "psp_reference",
        F.col("merchant").alias("payments_merchant"),
        F.col("year").alias("payments_year"),
        F.col("day_of_year").alias("payments_day_of_year"),
        F.col("eur_amount").alias("payments_eur_amount"),
        F.col("card_scheme").alias("payments_card_scheme"),
        F.col("aci").alias("payments_aci"),
        F.col("is_credit").alias("payments_is_credit"),
        F.col("has_fraudulent_dispute").alias("payments_has_fraudulent_dispute"),
        F.col("month").alias("derived_month"),
        F.col("account_type").alias("merchants_account_type"),
        F.col("rule_id").alias("fees_id"),
        F.col("rule_fixed_amount").alias("fees_fixed_amount"),
        F.col("rule_rate").alias("fees_rate"),
        fee_amount(F.col("rule_fixed_amount"), F.col("rule_rate"), F.col("eur_amount")).alias(
            "derived_fee_amount"
        ),
    )


# ---------------------------------------------------------------- sums without transaction rows


def _fact_groups(facts: DataFrame, extra: list[str]) -> DataFrame:
    """Facts summed per dimension tuple. Fees are linear in the amount, so a tuple's total fee
    follows from its row count and amount; only these small groups meet the rules."""
    keys = list(dict.fromkeys(extra + RULE_DIMS))
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("txns"), F.sum("eur_amount").alias("amount"))


def _narrow(payments: DataFrame, by: list[str]) -> DataFrame:
    """The payment columns that fee sums need, written once: facts read them for the monthly statistics and once more."""
    needed = [*by, *PAYMENT_DIMS, "merchant", "year", "day_of_year", "eur_amount", "issuing_country", "acquirer_country", "has_fraudulent_dispute"]
    return materialize(payments.select(*[c for c in payments.columns if c in needed]), "payments")


def _with_rule_sums(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the summed fixed amounts and rates of all rules that match a group.

    Groups of many merchants and months share their dimension tuple, and the number of different
    tuples stops growing with the data; so each tuple meets the rules once, summed by what a tuple's first half
    matches and their second half. Groups without a matching rule are left out.
    """
    # read several times; written once, so that the facts behind the groups are scanned once
    groups = materialize(groups, "fact_groups")
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few tuples with much work each: keep them spread over all tasks
    tuples = groups.select(*RULE_DIMS).repartition(parts, *RULE_DIMS).distinct()
    sums = [F.sum("fixed_amount").alias("fixed_amount"), F.sum("rate").alias("rate")]
    # rules with equal dimensions apply together: summed first
    kinds = materialize(rules.groupBy(*RULE_DIMS).agg(*sums), "rule_kinds")
    asked, offered = _in_halves(tuples, kinds, RULE_DIMS)
    met = asked.join(offered.groupBy("_ta", "_kb").agg(*sums), ["_ta", "_kb"])
    total = met.groupBy(*RULE_DIMS).agg(F.sum("fixed_amount").alias("sum_fixed"), F.sum("rate").alias("sum_rate"))
    return join_null_safe(groups, total, RULE_DIMS)


def group_fees(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Groups with ``fee``, the sum of all rules that match them, without anything written: for views."""
    kinds = rules.groupBy(*RULE_DIMS).agg(F.sum("fixed_amount").alias("fixed_amount"), F.sum("rate").alias("rate"))
    sums = match_tuples(groups.select(*RULE_DIMS).distinct(), kinds).groupBy(*RULE_DIMS).agg(
        F.sum("rule_fixed_amount").alias("sum_fixed"), F.sum("rule_rate").alias("sum_rate")
    )
    return join_null_safe(groups, sums, RULE_DIMS).withColumn("fee", _group_fee())


def _group_fee() -> Column:
    return F.col("txns") * F.col("sum_fixed") + F.col("amount") / F.lit(10000.0) * F.col("sum_rate")


def total_fees(
    payments: DataFrame, merchants: DataFrame, fees: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """Sum of all applicable fees per ``by`` (merchant, year, month, day_of_year, ...)."""
    by = MONTH if by is None else by
    groups = _fact_groups(payment_facts(_narrow(payments, by), merchants), by)
    return _with_rule_sums(groups, fees).groupBy(*by).agg(F.sum(_group_fee()).alias("total_fee"))


def applicable_fee_ids(
    payments: DataFrame, merchants: DataFrame, fees: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """Distinct rule ids per ``by`` (default merchant and day)."""
    by = ["merchant", "year", "day_of_year"] if by is None else by
    tuples = _fact_groups(payment_facts(_narrow(payments, by), merchants), by).drop("txns", "amount")
    return rules_used(materialize(tuples, "fact_groups"), fees, by)


def fee_rules_expanded(fees: DataFrame) -> DataFrame:
    """Rules with account type, authorisation type, credit and country flags made explicit."""

    def domain(name: str) -> Column:
        # the distinct values of one rule dimension, a short list of codes
        return fees.agg(F.array_sort(F.collect_set(name)).alias("d")).scalar()

    def expand(name: str, values: Column) -> Column:
        return F.explode(F.when(F.col(name).isNull(), values).otherwise(F.array(F.col(name))))

    return (
        fees.withColumn("expanded_account_type", expand("account_type", domain("account_type")))
        .withColumn("expanded_aci", expand("aci", domain("aci")))
        .withColumn("expanded_is_credit", expand("is_credit", F.array(F.lit(True), F.lit(False))))
        .withColumn("expanded_intracountry", expand("intracountry", F.array(F.lit(0.0), F.lit(1.0))))
        .select(
            F.col("id").alias("fees_id"),
            F.col("card_scheme").alias("fees_card_scheme"),
            "expanded_account_type",
            "expanded_aci",
            "expanded_is_credit",
            "expanded_intracountry",
            F.col("fixed_amount").alias("fees_fixed_amount"),
            F.col("rate").alias("fees_rate"),
            F.col("merchant_category_code").alias("fees_mcc"),
            F.col("capture_delay").alias("fees_capture_delay"),
            F.col("monthly_volume").alias("fees_monthly_volume"),
            F.col("monthly_fraud_level").alias("fees_monthly_fraud_level"),
        )
    )


def average_fee_for_rules(fees: DataFrame, amount: float, by: list[str], **attributes) -> DataFrame:
    """Average fee of an amount: per rule first, then over the rules of each ``by`` group."""
    expanded = fee_rules_expanded(fees)
    for name, value in attributes.items():
        expanded = expanded.filter(F.col(name) == value)
    fee = fee_amount(F.col("fees_fixed_amount"), F.col("fees_rate"), F.lit(float(amount)))
    per_rule = expanded.groupBy(*by, "fees_id").agg(F.avg(fee).alias("fee"))
    return per_rule.groupBy(*by).agg(F.avg("fee").alias("avg_fee"), F.count(F.lit(1)).alias("rules"))


def fee_delta_rate_change(
    payments: DataFrame, merchants: DataFrame, fees: DataFrame, new_rate: float, fee_id: int | None = None
) -> DataFrame:
    """Change of the total fee per rule if its rate became ``new_rate``."""
    rules = fees if fee_id is None else fees.filter(F.col("id") == fee_id)
    groups = materialize(_fact_groups(payment_facts(_narrow(payments, []), merchants), []), "fact_groups")
    # rules of a kind share their amount; only its sum meets the single rules
    numbered = with_kinds(rules)
    used = wildcard_rule_join(groups, _kinds(numbered)).groupBy("rule_id").agg(F.sum("amount").alias("amount"))
    change = (F.lit(float(new_rate)) - F.col("rate")) / F.lit(10000.0) * F.col("amount")
    each = numbered.select("id", "rate", "_kind").join(used, F.col("_kind") == F.col("rule_id"))
    return each.groupBy(F.col("id").alias("fees_id")).agg(F.sum(change).alias("delta"))


def fee_delta_mcc_change(
    payments: DataFrame,
    merchants: DataFrame,
    fees: DataFrame,
    new_mcc: int,
    year: int | None = None,
    merchant: str | None = None,
) -> DataFrame:
    """Hypothetical minus actual yearly fee per merchant if its category code changed.

    NULL when one of the two totals has no matching rule at all.
    """
    payments, merchants = _scoped(payments, merchants, merchant, year)
    groups = _fact_groups(payment_facts(_narrow(payments, []), merchants), ["merchant"])
    # both scenarios share the facts and one pass over the rules
    scenario = F.explode(F.array(F.lit("actual"), F.lit("hypothetical")))
    code = F.when(F.col("scenario") == "hypothetical", F.lit(new_mcc).cast("bigint")).otherwise(
        F.col("merchant_category_code")
    )
    both = groups.withColumn("scenario", scenario).withColumn("merchant_category_code", code)

    def total(name: str) -> Column:
        return F.sum(F.when(F.col("scenario") == name, _group_fee()))

    delta = total("hypothetical") - total("actual")
    return _with_rule_sums(both, fees).groupBy("merchant").agg(F.round(delta, 6).alias("delta"))


def merchants_affected_by_fee(
    payments: DataFrame,
    merchants: DataFrame,
    fees: DataFrame,
    year: int | None = None,
    fee_id: int | None = None,
    account_type: str | None = None,
) -> DataFrame:
    """Merchants whose payments use a rule; with ``account_type``, those that would lose it."""
    payments, merchants = _scoped(payments, merchants, None, year)
    rules = fees if fee_id is None else fees.filter(F.col("id") == fee_id)
    tuples = _fact_groups(payment_facts(_narrow(payments, []), merchants), ["merchant"]).drop("txns", "amount")
    if account_type is not None:
        tuples = tuples.filter(F.col("account_type") != account_type)
    return rules_used(materialize(tuples, "fact_groups"), rules, ["merchant", "account_type"]).select(
        "fees_id",
        F.col("merchant").alias("payments_merchant"),
        F.col("account_type").alias("merchants_account_type"),
    )


def most_expensive_mcc(fees: DataFrame, amount: float) -> DataFrame:
    """Mean fee per category code, rules without a code included; every top tie is flagged.

    Rules without a code apply to all codes, so their count and sum are added to each code's
    own instead of pairing them with every code.
    """
    fee = fee_amount(F.col("fixed_amount"), F.col("rate"), F.lit(float(amount)))
    rules = fees.select("id", F.col("merchant_category_code").alias("mcc"), fee.alias("fee")).distinct()
    wild = rules.filter(F.col("mcc").isNull()).agg(
        F.struct(F.coalesce(F.sum("fee"), F.lit(0.0)).alias("fee"), F.count(F.lit(1)).alias("n")).alias("w")
    )
    per_code = (
        rules.filter(F.col("mcc").isNotNull())
        .groupBy("mcc")
        .agg(F.sum("fee").alias("fee"), F.count(F.lit(1)).alias("n"))
        .withColumn("w", wild.scalar())
    )
    mean = (F.col("fee") + F.col("w.fee")) / (F.col("n") + F.col("w.n"))
    averages = per_code.select(
        F.col("mcc").alias("merchant_category_code"), F.round(mean, 6).alias("avg_fee")
    )
    best = averages.agg(F.max("avg_fee")).scalar()
    return averages.withColumn("is_top", F.col("avg_fee") == best)


def rules_matching(fees: DataFrame, **attributes) -> DataFrame:
    """Rules that apply to the given attributes; attributes left out do not restrict."""
    out = fees
    for name, value in attributes.items():
        out = out.filter(F.col(name).isNull() | (F.col(name) == value))
    return out


def steering_costs(
    payments: DataFrame, merchants: DataFrame, fees: DataFrame, scheme_wildcard: bool = False
) -> DataFrame:
    """Total fee of all fraudulent payments per merchant, month and candidate authorisation type.

    With ``scheme_wildcard`` unset only rules that name a card scheme count. The group count is the
    number of distinct (amount, scheme, credit, country) combinations with a matching rule; the
    transaction count is the number of payments behind them.
    """
    rules = fees if scheme_wildcard else fees.filter(F.col("card_scheme").isNotNull())
    fraud = payment_facts(payments, merchants).filter(F.col("has_fraudulent_dispute"))
    dims = [d for d in RULE_DIMS if d != "aci"]
    per_amount = fraud.groupBy(*MONTH, *dims, "eur_amount").agg(F.count(F.lit(1)).alias("n"))
    groups = per_amount.groupBy(*MONTH, *dims).agg(
        F.sum("n").alias("txns"),
        F.sum(F.col("n") * F.col("eur_amount")).alias("amount"),
        F.count(F.lit(1)).alias("amounts"),
    )
    redirected = groups.withColumn("aci", F.explode(F.array(*[F.lit(a) for a in CANDIDATE_ACIS])))
    return _with_rule_sums(redirected, rules).groupBy(*MONTH, "aci").agg(
        F.sum(_group_fee()).alias("derived_total_fee"),
        F.sum("amounts").alias("derived_fraud_txn_count"),
        F.sum("txns").alias("fraud_transactions"),
    ).select(
        F.col("merchant").alias("payments_merchant"),
        F.col("year").alias("payments_year"),
        F.col("month").alias("derived_month"),
        F.col("aci").alias("derived_target_aci"),
        "derived_total_fee",
        "derived_fraud_txn_count",
        "fraud_transactions",
    )


def steering_recommendation(
    payments: DataFrame, merchants: DataFrame, fees: DataFrame, yearly: bool = False
) -> DataFrame:
    """Cheapest candidate per merchant and month (or year); equal costs go to the first letter."""
    costs = steering_costs(payments, merchants, fees, scheme_wildcard=True).select(
        F.col("payments_merchant").alias("merchant"),
        F.col("payments_year").alias("year"),
        F.col("derived_month").alias("month"),
        F.col("derived_target_aci").alias("recommended_aci"),
        F.col("derived_total_fee").alias("total_fee"),
    )
    keys = ["merchant", "year"] if yearly else MONTH
    summed = costs.groupBy(*keys, "recommended_aci").agg(F.round(F.sum("total_fee"), 6).alias("total_fee"))
    best = pick_per_key(summed, keys, ["total_fee", "recommended_aci"], largest=False)
    return best.withColumn("total_fee", F.round("total_fee", 2))


def cost_by_dimension_rank(
    payments: DataFrame, merchants: DataFrame, fees: DataFrame, dimension: str, by: list[str]
) -> DataFrame:
    """Total fee per value of a dimension within ``by``, with the dearest and cheapest flagged."""
    totals = total_fees(payments, merchants, fees, by=[*by, dimension]).withColumn(
        "total_fee", F.round("total_fee", 4)
    )
    # read for the sums and for their edges; written once, so that the rules are met once
    totals = materialize(totals, "totals")
    edges = totals.groupBy(*by).agg(F.max("total_fee").alias("_hi"), F.min("total_fee").alias("_lo"))
    marked = totals.join(edges, by) if by else totals.withColumn("_hi", edges.select("_hi").scalar()).withColumn(
        "_lo", edges.select("_lo").scalar()
    )
    return marked.select(
        *by,
        dimension,
        "total_fee",
        (F.col("total_fee") == F.col("_hi")).alias("is_most_expensive"),
        (F.col("total_fee") == F.col("_lo")).alias("is_cheapest"),
    )


# ---------------------------------------------------------------- payment statistics


def fraud_rate_by_volume(payments: DataFrame, by: list[str]) -> DataFrame:
    return payments.groupBy(*by).agg(
        fraud_rate(F.col("eur_amount"), F.col("has_fraudulent_dispute")).alias("fraud_rate_pct")
    )


def fraud_pct_by_count(payments: DataFrame, by: list[str]) -> DataFrame:
    bad = F.count_if(F.col("has_fraudulent_dispute"))
    return payments.groupBy(*by).agg((bad * 100.0 / F.count(F.lit(1))).alias("fraud_pct"))


def avg_per_unique(payments: DataFrame, unit: str, by: list[str], value: str = "eur_amount") -> DataFrame:
    """Mean of per-unit means, for example per customer."""
    per_unit = payments.filter(F.col(unit).isNotNull()).groupBy(*by, unit).agg(F.avg(value).alias("m"))
    return per_unit.groupBy(*by).agg(F.avg("m").alias("avg_per_unit"), F.count(F.lit(1)).alias("units"))


def top_category(payments: DataFrame, category: str, score: Column | None = None) -> DataFrame:
    """The category with the highest score (row count by default), ties to the smallest name."""
    ranked = payments.groupBy(category).agg((F.count(F.lit(1)) if score is None else score).alias("score"))
    return ranked.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last(category)).limit(1)


def acquirer_country_join(merchants: DataFrame, acquirer_countries: DataFrame) -> DataFrame:
    """One row per merchant and acquirer with the acquirer's country."""
    listed = merchants.select("merchant", F.explode("acquirer").alias("acquirer"))
    return listed.join(acquirer_countries, "acquirer").select("merchant", "acquirer", "country_code")


def mcc_lookup(merchants: DataFrame, codes: DataFrame) -> DataFrame:
    """Merchants with the description of their category code; codes are text in the lookup."""
    typed = codes.select(F.col("mcc").try_cast("bigint").alias("merchant_category_code"), "description")
    return merchants.join(typed, "merchant_category_code").select(
        "merchant", "merchant_category_code", "description"
    )


def rule_coverage(payments: DataFrame, merchants: DataFrame, fees: DataFrame) -> DataFrame:
    """Rules that never match and transactions that no rule covers, in one long table."""
    facts = payment_facts(payments, merchants)
    tuples = facts.groupBy(*RULE_DIMS).agg(F.count(F.lit(1)).alias("txns"))
    numbered = with_kinds(fees)
    pairs = _met_kinds(tuples, numbered)
    used = numbered.join(pairs.select("_kind").distinct(), "_kind", "left_semi").select("id").distinct()
    unused = (
        fees.select("id").distinct().join(used, "id", "left_anti").select(
            F.lit("unused_rule").alias("kind"), F.col("id").cast("string").alias("key"), F.lit(1).cast("bigint").alias("n")
        )
    )
    covered = pairs.select(*RULE_DIMS).distinct()
    open_tuples = join_null_safe(tuples, covered, RULE_DIMS, "left_anti")
    missing = open_tuples.groupBy("card_scheme").agg(F.sum("txns").alias("n")).select(
        F.lit("uncovered_transactions").alias("kind"), F.col("card_scheme").alias("key"), "n"
    )
    return unused.unionByName(missing)


def dataset_scope_merchants(payments: DataFrame, merchants: DataFrame) -> DataFrame:
    """Merchants of the dimension, flagged by whether any payment uses them."""
    active = payments.select("merchant").distinct().withColumn("_active", F.lit(True))
    listed = merchants.select("merchant").distinct()
    return listed.join(active, "merchant", "left").select(
        "merchant", F.coalesce("_active", F.lit(False)).alias("is_active")
    )
