"""Order-free, tolerant comparison of recorded query results.

Rows come in long form ``(case_id, side, row_no, cells)`` with ``side`` gold or pred. Millions of
cases are compared in one pass, and one case may hold any share of the rows: rows are counted per
normal form first, and only rows without an identical twin take part in the tolerant steps, which
work on sort ranges instead of whole cases.

Tolerant steps look for candidates by hash keys. Text cells, and columns of small whole numbers, have to
agree literally; of the other columns the one with most values gives tolerance buckets, such that equal cells
share one. Only candidates are compared cell by cell. They are paired greedily in row order, as one after the other
would be, but in rounds of joins and aggregates over all cases at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import cells as X
from evalspark.plans.sequence import rank_rows
from evalspark.session import free_shuffles, materialize


def normalized(results: DataFrame) -> DataFrame:
    """Result rows with normal form and decimals."""
    # a step of its own, so that each cell is read once for both
    read = results.select("case_id", "side", "row_no", "cells", X.read_row(F.col("cells")).alias("_read"))
    return read.select(
        "case_id", "side", "row_no", "cells", X.normal_forms(F.col("_read")).alias("row"), X.places_of(F.col("_read")).alias("places")
    )


def _distinct_rows(norm: DataFrame) -> DataFrame:
    """One record per case and normal form with its number on both sides.

    Equal normal forms may be written with different decimals; the coarsest writing governs.
    """
    gold, pred = F.col("side") == "gold", F.col("side") == "pred"
    return norm.groupBy("case_id", "row").agg(
        F.count_if(gold).alias("g"),
        F.count_if(pred).alias("p"),
        F.min(F.when(gold, F.col("places"))).alias("gold_places"),
        F.min(F.when(pred, F.col("places"))).alias("pred_places"),
        F.min(F.when(gold, F.col("row_no"))).alias("gold_no"),
        F.min(F.when(pred, F.col("row_no"))).alias("pred_no"),
    )


def case_stats(distinct: DataFrame) -> DataFrame:
    """Per case: rows, widths, distinct rows and rows without a twin on either side."""
    g, p = F.col("g"), F.col("p")
    width = F.size("row")
    return distinct.groupBy("case_id").agg(
        F.sum("g").alias("n_gold"),
        F.sum("p").alias("n_pred"),
        F.max(F.when(g > 0, width)).alias("w_gold"),
        F.max(F.when(p > 0, width)).alias("w_pred"),
        F.count_if(g > 0).alias("d_gold"),
        F.count_if(p > 0).alias("d_pred"),
        F.count_if((g > 0) & (p > 0)).alias("common"),
        F.sum(F.greatest(g - p, F.lit(0))).alias("left_gold"),
        F.sum(F.greatest(p - g, F.lit(0))).alias("left_pred"),
    )


# whole numbers below this differ by more than the tolerance unless they are equal
_EXACT_BELOW = 5000
# buckets of logarithms, many times wider than the tolerance, and the width of an edge next to which the other side is asked for as well
_BUCKET = 16 * X.RELATIVE_TOLERANCE
_EDGE = 1.5 * X.RELATIVE_TOLERANCE / _BUCKET


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs of rows of one case that are equal within tolerance.

    ``rows`` has case_id, is_needle, row, places (the decimals of needles, which govern), no (a number of the row on
    its side) and times. The result has case_id, a_no, a_times (needles), b_no and b_times; cells stay behind.
    """
    cells = rows.select("case_id", "places", F.posexplode("row").alias("pos", "c"))
    num = F.col("c.num")
    small = num.isNull() | ((num == F.floor(num)) & (F.abs(num) < _EXACT_BELOW))
    columns = cells.groupBy("case_id", "pos").agg(
        F.bool_and(small).alias("exact"), F.approx_count_distinct(num).alias("values"), F.collect_set(F.get("places", "pos")).alias("decimals")
    )
    block = F.when(~F.col("exact"), F.struct("values", F.col("pos").alias("pos"), "decimals"))
    layout = columns.groupBy("case_id").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "exact"))).alias("exact"), F.max(block).alias("block")
    )
    literal = F.transform(
        "row", lambda c, i: F.when(c["num"].isNull() | F.col("exact")[i], F.struct(c["num"].alias("n"), c["txt"].alias("t"), F.lit(True).alias("l")))
    )
    keyed = rows.join(layout.where("block is not null"), "case_id").select(
        "case_id", "is_needle", "row", "places", "no", "times", F.xxhash64(literal).alias("part"),
        F.get("row", F.col("block.pos"))["num"].alias("v"), F.get("places", F.col("block.pos")).alias("own"), F.col("block.decimals").alias("decimals"),
    )
    v = F.col("v")
    place = F.ln(F.abs(v)) / _BUCKET
    bucket = F.floor(place) * 2 + (v > 0).cast("long")
    into = place - F.floor(place)

    def rounded(places: Column) -> Column:
        return F.xxhash64(F.lit("rounded"), places.cast("int"), F.bround(v * F.pow(F.lit(10.0), places), 0) + F.lit(0.0))

    def close(step: int) -> Column:
        return F.when(v != 0, F.xxhash64(F.lit("close"), bucket + 2 * step))

    near_zero = F.when(F.abs(v) <= X.RELATIVE_TOLERANCE, F.xxhash64(F.lit("zero")))
    none = F.when(v.isNull(), F.xxhash64(F.lit("none")))
    below, above = F.when(into < _EDGE, close(-1)), F.when(into > 1 - _EDGE, close(1))
    needle_keys = F.array(none, near_zero, rounded(F.col("own")), below, close(0), above)
    other_keys = F.concat(F.array(none, near_zero, close(0)), F.transform("decimals", rounded))
    keys = F.array_distinct(F.array_compact(F.when(F.col("is_needle"), needle_keys).otherwise(other_keys)))
    dealt = keyed.select("case_id", "part", "is_needle", "row", "places", "no", "times", F.explode(keys).alias("key"))
    of = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("no", "times")]
    a = dealt.where("is_needle").select("case_id", "part", "key", F.col("row").alias("a"), "places", *of("a"))
    b = dealt.where("not is_needle").select("case_id", "part", "key", F.col("row").alias("b"), *of("b"))
    same = X.rows_equal_adaptive(F.col("a"), F.col("b"), F.col("places"))
    return a.join(b, ["case_id", "part", "key"]).where(same).select("case_id", "a_no", "b_no", "a_times", "b_times").distinct()


def _pair_greedily(edges: DataFrame) -> DataFrame:
    """case_id, paired: how many rows pair up if each gold row in turn takes its first predicted rows that are left.

    In a round, a predicted row whose first open gold row is one that has it as its own first open choice goes to that
    one: nothing earlier can change that. Gold rows with the same choices, all of which are wanted by just these rows, need no turns:
    as many pair up as the smaller side has. Rows that are used up leave with their edges, till none are left.
    """
    found = []
    while True:
        links = edges
        for side, other in (("a", "b"), ("b", "a")):
            name = F.col(f"{other}_no")
            seen = edges.groupBy("case_id", f"{side}_no").agg(
                F.min(name).alias(f"{side}_first"), F.count(F.lit(1)).alias(f"{side}_degree"), F.bit_xor(F.xxhash64(name)).alias(f"{side}_set")
            )
            links = links.join(seen, ["case_id", f"{side}_no"])
        links = materialize(links, "links")
        group = ["case_id", "a_set", "b_set", "a_degree", "b_degree"]
        blocks = links.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("a_times").alias("a_sum"), F.sum("b_times").alias("b_sum"))
        # each row of a whole block stands in as many edges as it has choices
        whole = materialize(blocks.where("n = a_degree * b_degree"), "whole_blocks")
        per_side = [(F.col(f"{x}_sum") / F.col(f"{x}_degree")).cast("bigint") for x in "ab"]
        found.append(whole.select("case_id", F.least(*per_side).alias("paired")))
        rest = links.join(whole.select(group), group, "left_anti")
        taken = rest.where("b_no = a_first and a_no = b_first").select("case_id", "a_no", "b_no", F.least("a_times", "b_times").alias("paired"))
        taken = materialize(taken, "taken")
        if taken.isEmpty():  # the first open gold row of all always takes something, so nothing is open
            return reduce(DataFrame.unionByName, found).groupBy("case_id").agg(F.sum("paired").alias("paired"))
        found.append(taken.select("case_id", "paired"))
        left = rest
        for side in ("a", "b"):  # a row is in one of the taken edges at most
            used = taken.select("case_id", f"{side}_no", F.col("paired").alias(f"{side}_used"))
            left = left.join(used, ["case_id", f"{side}_no"], "left")
        times = [(F.col(f"{x}_times") - F.coalesce(f"{x}_used", F.lit(0))).alias(f"{x}_times") for x in "ab"]
        edges = left.select("case_id", "a_no", "b_no", *times).where("a_times > 0 and b_times > 0")


def _same_size() -> Column:
    """Cases whose rows may pair up one to one, some of them within tolerance only."""
    return (F.col("n_gold") == F.col("n_pred")) & (F.col("w_gold") == F.col("w_pred")) & (F.col("left_gold") > 0)


def _other_size() -> Column:
    """Cases with rows on the smaller side that have no identical row on the larger one."""
    smaller = F.when(F.col("n_pred") < F.col("n_gold"), F.col("d_pred")).otherwise(F.col("d_gold"))
    return (F.col("n_gold") != F.col("n_pred")) & (F.col("w_gold") == F.col("w_pred")) & (smaller > F.col("common"))


def _other_width() -> Column:
    return (F.col("n_gold") == F.col("n_pred")) & (F.col("w_gold") != F.col("w_pred"))


def _single_rows() -> Column:
    return (F.col("n_gold") == 1) & (F.col("n_pred") == 1)


def _counted(results: DataFrame, *kinds: Column) -> tuple[DataFrame, DataFrame]:
    """Statistics of all cases, and the distinct rows of cases of some ``kinds`` next to them.

    Both are written: all rows meet their cases once, and the steps read rows of open cases only.
    """
    distinct = materialize(_distinct_rows(normalized(results)), "distinct_rows")
    stats = materialize(case_stats(distinct), "case_stats")
    rows = distinct.join(stats.filter(reduce(lambda a, b: a | b, kinds)), "case_id")
    rows = materialize(rows, "open_rows")
    free_shuffles(rows.sparkSession)
    return stats, rows


def _unpaired(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Per case of equal size: gold rows that find no partner within tolerance."""
    # rows with a twin take part too: a row in front of them may take the twin
    sides = F.array(
        F.struct(F.lit(True).alias("is_needle"), F.col("gold_places").alias("places"), F.col("g").alias("times"), F.col("gold_no").alias("no")),
        F.struct(F.lit(False).alias("is_needle"), F.lit(None).cast("array<int>").alias("places"), F.col("p").alias("times"), F.col("pred_no").alias("no")),
    )
    rest = rows.filter(_same_size()).select("case_id", "row", F.explode(sides).alias("s")).select("case_id", "row", "s.*").where("times > 0")
    pairs = materialize(_candidates(rest), "candidate_pairs")
    free_shuffles(pairs.sparkSession)
    paired = _pair_greedily(pairs)
    open_cases = stats.filter(_same_size()).select("case_id", "n_gold")
    return open_cases.join(paired, "case_id", "left").select(
        "case_id", (F.col("n_gold") - F.coalesce("paired", F.lit(0))).alias("unpaired")
    )


def _unfound(rows: DataFrame) -> DataFrame:
    """Per case of unequal size: rows of the smaller side without an equal row on the larger side."""
    fewer_pred = F.col("n_pred") < F.col("n_gold")
    small = F.when(fewer_pred, F.col("p")).otherwise(F.col("g")) > 0
    large = F.when(fewer_pred, F.col("g")).otherwise(F.col("p")) > 0
    # a row with a twin may be near to others as well
    needle = small & ~large
    places = F.when(fewer_pred, F.col("pred_places")).otherwise(F.col("gold_places"))
    number = F.when(F.col("g") > 0, F.col("gold_no")).otherwise(F.col("pred_no"))
    rows = rows.filter(_other_size()).select(
        "case_id", "row", number.alias("no"), F.lit(1).alias("times"), needle.alias("is_needle"), F.when(needle, places).alias("places")
    )
    found = _candidates(rows).select("case_id", F.col("a_no").alias("no")).distinct()
    missing = rows.where("is_needle").join(found, ["case_id", "no"], "left_anti")
    return rows.where("is_needle").select("case_id").distinct().join(
        missing.groupBy("case_id").agg(F.count(F.lit(1)).alias("unfound")), "case_id", "left"
    ).select("case_id", F.coalesce("unfound", F.lit(0)).alias("unfound"))


def _column_subset(rows: DataFrame) -> DataFrame:
    """Per case of equal length and different width: sorted row pairs that are no subset."""
    counted = F.array(
        F.struct(F.lit("gold").alias("side"), F.col("g").alias("n")),
        F.struct(F.lit("pred").alias("side"), F.col("p").alias("n")),
    )
    rows = (
        rows.filter(_other_width())
        .select("case_id", "row", F.explode(F.filter(counted, lambda c: c["n"] > 0)).alias("c"))
        .select("case_id", "c.side", "row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c.n"))).alias("copy"))
    )
    ranked = rank_rows(rows, ["case_id", "side"], ["row", "copy"])

    def only(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("row")))

    pairs = ranked.groupBy("case_id", "rank").agg(only("gold").alias("a"), only("pred").alias("b"))
    a, b = F.col("a"), F.col("b")
    subset = F.when(F.size(b) < F.size(a), X.values_subset(b, a)).otherwise(X.values_subset(a, b))
    return pairs.groupBy("case_id").agg(F.count_if(~subset).alias("not_subset"))


def _close(rows: DataFrame) -> DataFrame:
    """Per case of one row each: are all cells numbers within five percent."""

    def only(count: str, places: str) -> Column:
        return F.max(F.when(F.col(count) > 0, F.arrays_zip(F.col("row").alias("v"), F.col(places).alias("d"))))

    pairs = rows.filter(_single_rows()).groupBy("case_id").agg(only("g", "gold_places").alias("a"), only("p", "pred_places").alias("b"))

    def near(x: Column, y: Column) -> Column:
        # decimals are known for written numbers only, not for truth words
        numbers = x["d"].isNotNull() & y["d"].isNotNull()
        gap = F.try_divide(F.abs(x["v"]["num"] - y["v"]["num"]), F.abs(x["v"]["num"]))
        return numbers & F.coalesce(gap < X.CLOSE_TOLERANCE, F.lit(False))

    every = F.forall(F.zip_with("a", "b", near), lambda ok: ok)
    return pairs.select("case_id", ((F.size("a") == F.size("b")) & every).alias("is_close"))


def comparison_facts(results: DataFrame, cases: DataFrame) -> DataFrame:
    """All findings per case that the verdict is made of."""
    stats, rows = _counted(results, _same_size(), _other_size(), _other_width(), _single_rows())
    out = cases.select("case_id", "gold_error", "pred_error").join(stats, "case_id", "left")
    out = out.fillna(0, ["n_gold", "n_pred", "d_gold", "d_pred", "common", "left_gold", "left_pred"])
    for part in (
        _unpaired(rows, stats),
        _unfound(rows),
        _column_subset(rows),
        _close(rows),
    ):
        out = out.join(part, "case_id", "left")
    return out


def compare_results(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Verdict per case: ``level`` and ``reason``, the first rule that applies."""
    f = comparison_facts(results, cases)
    n_gold, n_pred = F.col("n_gold"), F.col("n_pred")
    same_width = F.col("w_gold") == F.col("w_pred")
    same_sets = (F.col("d_gold") == F.col("d_pred")) & (F.col("d_gold") == F.col("common"))
    none_left = F.coalesce("unpaired", F.col("left_gold")) == 0
    all_found = F.coalesce("unfound", F.lit(0)) == 0
    subset = F.col("not_subset") == 0

    def text(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    rules: list[tuple[Column, str, Column]] = [
        (F.coalesce(F.col("gold_error").contains("ERROR"), F.lit(False)), "error", F.lit("gold_query_error")),
        (F.coalesce(F.col("pred_error").contains("ERROR"), F.lit(False)), "error", F.lit("predicted_query_error")),
        ((n_gold == 0) & (n_pred == 0), "correct", F.lit(None)),
        ((n_gold == 0) | (n_pred == 0), "incorrect", F.lit("empty_result")),
        (same_width & (n_gold == n_pred) & none_left, "correct", F.lit(None)),
        (
            (F.col("w_pred") < F.col("w_gold")) & subset,
            "partial",
            text("missing_columns:", F.col("w_gold") - F.col("w_pred")),
        ),
        (
            (F.col("w_pred") > F.col("w_gold")) & subset,
            "partial",
            text("extra_columns:", F.col("w_pred") - F.col("w_gold")),
        ),
        (
            same_width & (n_pred == 1) & (n_gold > 1) & (F.col("d_gold") == 1) & (F.col("common") == 1),
            "partial",
            text("aggregated_equivalent:", n_gold, "_to_1"),
        ),
        (
            same_width & (n_pred < n_gold) & (F.col("d_gold") < n_gold) & same_sets,
            "partial",
            text("implicit_distinct:", n_gold - F.col("d_gold"), "_duplicates_removed"),
        ),
        (
            same_width & (n_pred > n_gold) & (F.col("d_pred") < n_pred) & same_sets,
            "partial",
            text("extra_duplicates:", n_pred - F.col("d_pred"), "_duplicates_in_predicted"),
        ),
        (same_width & (n_pred < n_gold) & all_found, "incorrect", text("missing_rows:", n_gold - n_pred)),
        (same_width & (n_pred > n_gold) & all_found, "partial", text("extra_rows:", n_pred - n_gold)),
        (F.coalesce("is_close", F.lit(False)), "partial", F.lit("values_close_not_exact")),
    ]
    level, reason = None, None
    for hit, name, why in rules:
        why = why.cast("string")
        level = F.when(hit, name) if level is None else level.when(hit, name)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    return f.select("case_id", level.otherwise("incorrect").alias("level"), reason.alias("reason"))


def check_columns(results: DataFrame) -> DataFrame:
    """Cases whose prediction misses or adds columns around otherwise equal values."""
    stats, rows = _counted(results, _other_width())
    found = stats.join(_column_subset(rows), "case_id").filter(F.col("not_subset") == 0)
    gap = F.col("w_gold") - F.col("w_pred")
    reason = F.when(gap > 0, F.concat(F.lit("missing_columns:"), gap.cast("string"))).otherwise(
        F.concat(F.lit("extra_columns:"), (-gap).cast("string"))
    )
    return found.select("case_id", reason.alias("reason"))


def check_duplicates(results: DataFrame) -> DataFrame:
    """Cases that only differ in repeated rows: one row for many, implicit distinct, extra copies."""
    stats = case_stats(_distinct_rows(normalized(results)))
    n_gold, n_pred = F.col("n_gold"), F.col("n_pred")
    same = (F.col("w_gold") == F.col("w_pred")) & (F.col("d_gold") == F.col("common")) & (F.col("d_pred") == F.col("common"))
    reason = (
        F.when(
            (n_pred == 1) & (n_gold > 1) & (F.col("d_gold") == 1),
            F.concat(F.lit("aggregated_equivalent:"), n_gold.cast("string"), F.lit("_to_1")),
        )
        .when(
            (n_pred < n_gold) & (F.col("d_gold") < n_gold),
            F.concat(F.lit("implicit_distinct:"), (n_gold - F.col("d_gold")).cast("string"), F.lit("_duplicates_removed")),
        )
        .when(
            (n_pred > n_gold) & (F.col("d_pred") < n_pred),
            F.concat(F.lit("extra_duplicates:"), (n_pred - F.col("d_pred")).cast("string"), F.lit("_duplicates_in_predicted")),
        )
    )
    return stats.filter(same).select("case_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def check_rows(results: DataFrame) -> DataFrame:
    """Cases in which one side holds every row of the other plus more."""
    stats, rows = _counted(results, _other_size())
    joined = stats.join(_unfound(rows), "case_id", "left").filter(
        (F.col("w_gold") == F.col("w_pred")) & (F.col("n_gold") != F.col("n_pred")) & (F.coalesce("unfound", F.lit(0)) == 0)
    )
    gap = F.col("n_gold") - F.col("n_pred")
    reason = F.when(gap > 0, F.concat(F.lit("missing_rows:"), gap.cast("string"))).otherwise(
        F.concat(F.lit("extra_rows:"), (-gap).cast("string"))
    )
    return joined.select("case_id", reason.alias("reason"))


def check_close_values(results: DataFrame) -> DataFrame:
    """Single-row cases whose numbers all lie within five percent."""
    _, rows = _counted(results, _single_rows())
    return _close(rows).filter("is_close").select("case_id")


def results_match_set(results: DataFrame) -> DataFrame:
    """Equality of the sets of normal rows; an empty side never matches."""
    stats = case_stats(_distinct_rows(normalized(results)))
    same = (F.col("d_gold") == F.col("d_pred")) & (F.col("d_gold") == F.col("common")) & (F.col("d_gold") > 0)
    return stats.select("case_id", same.alias("matches"))


def results_match_bag(results: DataFrame) -> DataFrame:
    """One-to-one matching of all rows with adaptive equality."""
    stats, rows = _counted(results, _same_size())
    joined = stats.join(_unpaired(rows, stats), "case_id", "left")
    same_shape = (F.col("n_gold") == F.col("n_pred")) & (F.col("w_gold") == F.col("w_pred"))
    paired = F.coalesce("unpaired", F.col("left_gold")) == 0
    return joined.select("case_id", F.coalesce(same_shape & paired, F.lit(False)).alias("matches"))


def compare_simple(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(match, mismatch type) for audits: error, row count, values."""
    stats = case_stats(_distinct_rows(normalized(results)))
    joined = cases.select("case_id", "gold_error", "pred_error").join(stats, "case_id", "left")
    failed = F.col("gold_error").isNotNull() | F.col("pred_error").isNotNull()
    rows = F.coalesce("n_gold", F.lit(0)) != F.coalesce("n_pred", F.lit(0))
    values = (F.col("d_gold") != F.col("common")) | (F.col("d_pred") != F.col("common"))
    kind = F.when(failed, "error").when(rows, "row_count_mismatch").when(values, "value_mismatch")
    return joined.select("case_id", kind.isNull().alias("matches"), kind.alias("mismatch_type"))


def compare_with_fallback(results: DataFrame, cases: DataFrame, second: DataFrame) -> DataFrame:
    """Compare with the gold rows first, then with a second reference where there is one.

    ``second`` has case_id, row_no and cells; only cases that are not correct yet are looked at.
    """
    first = materialize(compare_results(results, cases), "first_verdicts")
    open_cases = first.filter(F.col("level") != "correct").select("case_id").join(
        second.select("case_id").distinct(), "case_id", "left_semi"
    )
    alternative = second.select("case_id", F.lit("gold").alias("side"), "row_no", "cells").unionByName(
        results.filter(F.col("side") == "pred")
    )
    again = compare_results(
        alternative.join(open_cases, "case_id", "left_semi"),
        cases.join(open_cases, "case_id", "left_semi").withColumn("gold_error", F.lit(None).cast("string")),
    ).filter(F.col("level") == "correct").select("case_id", F.lit(True).alias("_second"))
    joined = first.join(again, "case_id", "left")
    hit = F.coalesce("_second", F.lit(False))
    return joined.select(
        "case_id",
        F.when(hit, "correct").otherwise(F.col("level")).alias("level"),
        F.when(hit, "platinum_match").otherwise(F.col("reason")).alias("reason"),
        F.when(hit, "platinum").when(F.col("level") == "correct", "gold").otherwise("none").alias("match_source"),
    )


def audit_engines(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Counts of matches, errors and mismatches between two executions of the same statements."""
    return compare_simple(results, cases).groupBy(
        F.when(F.col("matches"), "match").otherwise(F.col("mismatch_type")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("n"))


def curate_dataset(questions: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """Questions with the size of their stored gold result and a compatibility status."""
    audit = compare_simple(results, cases)
    sizes = results.filter(F.col("side") == "gold").groupBy("case_id").agg(F.count(F.lit(1)).alias("gold_rows"))
    joined = questions.join(audit, "case_id", "left").join(sizes, "case_id", "left")
    status = (
        F.when(F.col("matches"), "compatible")
        .when(F.col("mismatch_type") == "error", "error")
        .when(F.col("mismatch_type").isNotNull(), "mismatch")
        .otherwise("not_audited")
    )
    return joined.select(*questions.columns, F.coalesce("gold_rows", F.lit(0)).alias("gold_rows"), status.alias("status"))


def parse_result_text(stored: DataFrame) -> DataFrame:
    """Stored result text to rows: one list, or one list per line; unreadable lines are dropped.

    A trailing note about sampling is cut off, and a flat list becomes one column.
    """
    text = F.split_part("result_text", F.lit("\n... (sampled"), F.lit(1))
    json = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(text, r"'", '"'), r"\bNone\b", "null"), r"\b(True|False)\b", '"$1"'
    )
    nested = F.from_json(json, "array<array<string>>")
    flat = F.from_json(json, "array<string>")
    lines = F.filter(F.split(json, "\n"), lambda x: F.length(F.trim(x)) > 0)
    per_line = F.filter(F.transform(lines, lambda x: F.from_json(x, "array<string>")), lambda x: x.isNotNull())
    is_nested = F.trim(json).rlike(r"(?s)^\[\s*\[.*\]\s*\]$") & F.forall(nested, lambda r: r.isNotNull())
    rows = (
        F.when(is_nested, nested)
        .when(F.size(lines) == 1, F.transform(flat, lambda v: F.array(v)))
        .otherwise(per_line)
    )
    parsed = stored.select("case_id", rows.alias("rows"))
    return parsed.select("case_id", F.posexplode("rows").alias("row_no", "cells"))
