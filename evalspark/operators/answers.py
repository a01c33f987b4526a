"""Answer strings: formatting rows, adopting a reference's layout, equality and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.cells import python_float_text

# Texts that all mean "no answer".
NO_ANSWER = ["", "not applicable", "n/a", "none", "na", "null", "-"]
NOT_APPLICABLE = "Not Applicable"
TRUTH_WORDS = ["yes", "no", "true", "false"]
ANSWER_TOLERANCE = 1e-9
# Layout hints in a question's guidelines.
SPACED_LIST = r"eg:\s*\w+,\s+\w+"
COLON_PAIR = r"\{\w+\}:\{\w+\}"
BRACKET_PAIR = r"\[.*\w+_i\s*:\s*\w+_i"
ROUNDED_TO = r"rounded to (\d+) decimal"

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def _hint(guidelines: Column, pattern: str) -> Column:
    return F.coalesce(guidelines.rlike(pattern), F.lit(False))


def fixed_decimals(value: Column, places: Column) -> Column:
    """A double with exactly ``places`` decimals, halves to even."""
    chain = F.format_string("%.0f", F.bround(value, 0))
    out = F.when(places == 0, chain)
    for k in range(1, 13):
        out = out.when(places == k, F.format_string(f"%.{k}f", F.bround(value, k)))
    # beyond, all digits of the shortest writing are there and zeros follow
    longer = F.call_function("format_string", F.concat(F.lit("%."), places.cast("string"), F.lit("f")), value)
    return out.otherwise(F.when(places > 12, longer).otherwise(value.cast("string")))


# ---------------------------------------------------------------- rows to an answer


def format_value(cell: Column, guidelines: Column) -> Column:
    """One cell as text: asked decimals for numbers, "Not Applicable" for NULL."""
    number = _number(cell)
    asked = F.regexp_extract(F.lower(guidelines), ROUNDED_TO, 1).try_cast("int")
    plain = F.when(cell.rlike(_INTEGER), F.trim(cell)).otherwise(python_float_text(number))
    return (
        F.when(cell.isNull(), NOT_APPLICABLE)
        .when(number.isNull(), cell)
        .when(asked.isNotNull(), fixed_decimals(number, asked))
        .otherwise(plain)
    )


def format_answer(rows: DataFrame, guidelines: DataFrame) -> DataFrame:
    """One answer string per case from its ordered rows and the question's guidelines.

    ``rows`` has case_id, row_no and cells; every case of ``guidelines`` gets an answer. Each row
    becomes its piece of text first, so that only these pieces are brought together.
    """
    shapes = rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.size("cells"), "row_no").alias("_first"),
        F.max(F.size("cells")).alias("_widest"),
        F.bool_and(F.coalesce(F.col("cells")[0].rlike(r"^(.+?):\s*(.+)$"), F.lit(False))).alias("_keyed"),
    )
    g = F.col("guidelines")
    joined = rows.join(guidelines.join(shapes, "case_id"), "case_id")
    bracket, colon = _hint(g, BRACKET_PAIR), _hint(g, COLON_PAIR)
    separator = F.when(_hint(g, SPACED_LIST), ", ").otherwise(",")
    values = F.transform("cells", lambda c: format_value(c, F.col("guidelines")))
    single = (F.col("_n") == 1) & (F.col("_first") == 1)
    one_column = F.col("_widest") == 1
    key = F.trim(F.regexp_extract(F.col("cells")[0], r"^(.+?):\s*(.+)$", 1))
    val = F.trim(F.regexp_extract(F.col("cells")[0], r"^(.+?):\s*(.+)$", 2))
    keyed_val = F.when(_number(val).isNotNull() & ~val.rlike(_INTEGER), format_value(val, g)).when(
        _number(val).isNotNull(),
        F.when(
            F.regexp_extract(F.lower(g), ROUNDED_TO, 1) != "", format_value(val, g)
        ).otherwise(python_float_text(_number(val))),
    ).otherwise(val)
    layout = (
        F.when(single, "value")
        .when(bracket & one_column & F.col("_keyed"), "keyed")
        .when((F.col("_first") == 2) & bracket, "bracket")
        .when((F.col("_n") == 1) & (F.col("_first") == 2) & colon, "colon")
        .when((F.col("_n") == 1) | one_column, "list")
        .when(F.col("_first") == 2, "pairs")
        .otherwise("list")
    )
    piece = (
        F.when(F.col("_layout") == "keyed", F.concat(key, F.lit(": "), keyed_val))
        .when(F.col("_layout") == "bracket", F.concat(F.col("_v")[0], F.lit(": "), F.col("_v")[1]))
        .when(F.col("_layout") == "colon", F.array_join("_v", ":"))
        .when(
            F.col("_layout") == "pairs",
            F.concat(F.col("_v")[0], F.when(colon, ":").otherwise(": "), F.col("_v")[1]),
        )
        .when(separator == ", ", F.array_join("_v", ", "))
        .otherwise(F.array_join("_v", ","))
    )
    pieces = joined.withColumn("_layout", layout).withColumn("_v", values).withColumn("_piece", piece)
    merged = pieces.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_piece"))), lambda x: x["_piece"]).alias("_p"),
        F.first("_layout").alias("_layout"),
        F.first(separator).alias("_sep"),
        F.first(F.col("cells")[0]).alias("_cell"),
        F.first("guidelines").alias("guidelines"),
    )
    spaced, tight = F.array_join("_p", ", "), F.array_join("_p", ",")
    value = F.col("_p")[0]
    is_text = _number(F.col("_cell")).isNull()
    tight_value = F.when(
        is_text & (F.col("_sep") == ",") & ~_hint(g, BRACKET_PAIR), F.replace(value, F.lit(", "), F.lit(","))
    ).otherwise(value)
    paired = F.when(
        is_text & _hint(g, COLON_PAIR) & tight_value.rlike("^[^,]+,[^,]+$") & ~tight_value.contains(":"),
        F.replace(tight_value, F.lit(","), F.lit(":")),
    ).otherwise(tight_value)
    answer = (
        F.when(F.col("_layout") == "value", paired)
        .when(F.col("_layout").isin("keyed", "bracket"), F.concat(F.lit("["), spaced, F.lit("]")))
        .when(F.col("_layout") == "pairs", spaced)
        .when(F.col("_sep") == ", ", spaced)
        .otherwise(tight)
    )
    done = merged.select("case_id", answer.alias("answer"))
    return guidelines.select("case_id").join(done, "case_id", "left").select(
        "case_id", F.coalesce("answer", F.lit(NOT_APPLICABLE)).alias("answer")
    )


# ---------------------------------------------------------------- layout of the reference


def normalize_to_gold_format(df: DataFrame, predicted: str, gold: str, out: str) -> DataFrame:
    """Give ``predicted`` the brackets, decimals, separators, pair spacing and case of ``gold``.

    Texts that differ in the number of parts or numbers stay as they are. Numbers only change their
    decimals. A single truth word takes the word of ``gold``, also the opposite one; this is the
    behaviour to match, so callers who need strict truth words compare them before.

    The steps are separate columns, since a part's text is needed many times and lambda bodies
    share nothing.
    """
    pred, ref = F.col(predicted), F.col(gold)

    def inner(text: Column) -> Column:
        wrapped = text.startswith("[") & text.endswith("]")
        return F.when(wrapped, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)

    def tail(part: Column) -> Column:
        return F.trim(F.element_at(F.split(part, ":"), -1))

    def numbers(items: str) -> Column:
        return F.size(F.filter(items, lambda p: tail(p).rlike(_NUMBER)))

    def head(part: Column) -> Column:
        return F.when(part.contains(":") & F.col("_pairs"), F.trim(F.split_part(part, F.lit(":"), F.lit(1))))

    def value(part: Column) -> Column:
        has = part.contains(":") & F.col("_pairs")
        return F.when(has, F.trim(F.regexp_replace(part, "(?s)^[^:]*:", ""))).otherwise(part)

    def places(g: Column) -> Column:
        decimals = F.length(F.element_at(F.split(g, r"\."), -1))
        return F.when(g.contains("."), decimals).when(g.rlike(_NUMBER), 0)

    def struct(**fields: Column) -> Column:
        return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])

    def adapted(c: Column) -> Column:
        number = F.when(c["places"].isNotNull(), _number(c["pv"]))
        return F.coalesce(F.when(number.isNotNull(), fixed_decimals(number, c["places"])), c["pv"])

    def joint(c: Column) -> Column:
        both = F.concat(c["ph"], F.when(F.col("_spaced"), ": ").otherwise(":"), c["v"])
        return F.when(c["gh"].isNotNull() & c["ph"].isNotNull(), both).when(F.length(c["v"]) > 0, c["v"]).otherwise(c["p"])

    def cased(c: Column) -> Column:
        g, text = c["g"], c["t"]
        single = F.size("_gp") == 1
        word = ((F.length(g) == 2) & (F.upper(g) == g) & g.rlike("[A-Z]")) | g.rlike(r"^\p{L}+$")
        same_word = (F.lower(text) == F.lower(g)) & word & ~(single & F.col("_pairs"))
        truth = F.lower(text).isin(TRUTH_WORDS) & F.lower(g).isin(TRUTH_WORDS) & single & ~F.col("_pairs")
        return F.when(truth | same_word, g).otherwise(text)

    steps = (
        df.withColumn("_gp", F.transform(F.split(inner(ref), ","), lambda p: F.trim(p)))
        .withColumn("_pp", F.transform(F.split(inner(pred), ","), lambda p: F.trim(p)))
        .withColumn("_spaced", F.exists("_gp", lambda p: p.rlike(r"^.+:\s+.+")))
        .withColumn("_pairs", F.col("_spaced") | F.exists("_gp", lambda p: p.rlike(r"^.+:\S")))
        .withColumn(
            "_z",
            F.zip_with(
                "_gp", "_pp", lambda g, p: struct(g=g, p=p, gh=head(g), gv=value(g), ph=head(p), pv=value(p))
            ),
        )
        .withColumn(
            "_z",
            F.transform("_z", lambda c: struct(g=c["g"], p=c["p"], gh=c["gh"], ph=c["ph"], pv=c["pv"], places=places(c["gv"]))),
        )
        .withColumn("_z", F.transform("_z", lambda c: struct(g=c["g"], p=c["p"], gh=c["gh"], ph=c["ph"], v=adapted(c))))
        .withColumn("_z", F.transform("_z", lambda c: struct(g=c["g"], t=joint(c))))
        .withColumn("_z", F.transform("_z", lambda c: cased(c)))
    )
    tight = (F.size("_gp") > 1) & ~inner(ref).contains(", ")
    joined = F.when(tight, F.array_join("_z", ",")).otherwise(F.array_join("_z", ", "))
    wrapped = ref.startswith("[") & ref.endswith("]")
    result = F.when(wrapped, F.concat(F.lit("["), joined, F.lit("]"))).otherwise(joined)

    def blank(text: Column) -> Column:
        return F.lower(F.trim(text)).isin("", "not applicable")

    keep = (
        pred.isNull()
        | ref.isNull()
        | blank(pred)
        | blank(ref)
        | (F.size("_gp") != F.size("_pp"))
        | (numbers("_gp") != numbers("_pp"))
    )
    return steps.withColumn(out, F.when(keep, pred).otherwise(result)).drop("_gp", "_pp", "_spaced", "_pairs", "_z")


# ---------------------------------------------------------------- equality and score


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), '^"+|"+$', "")


def _without_brackets(text: Column) -> Column:
    """``['A', 'B']`` becomes ``A, B``."""
    trimmed = F.trim(text)
    wrapped = trimmed.startswith("[") & trimmed.endswith("]") & (F.length(trimmed) > 1)
    content = F.trim(F.substr(trimmed, F.lit(2), F.length(trimmed) - 2))
    items = F.transform(F.split(content, ","), lambda p: F.regexp_replace(F.trim(p), "^['\"]+|['\"]+$", ""))
    return F.when(wrapped, F.array_join(items, ", ")).otherwise(trimmed)


def answers_equal(predicted: Column, gold: Column) -> Column:
    """Case-free equality with bracket, no-answer, number, list order and prefix rules."""
    p, g = _unquoted(predicted), _unquoted(gold)
    pn, gn = F.lower(_without_brackets(p)), F.lower(_without_brackets(g))
    x, y = _number(gn), _number(pn)
    scale = F.greatest(F.abs(x), F.lit(1e-15))
    near = F.when(x == 0, F.abs(y) < ANSWER_TOLERANCE).otherwise(
        (F.abs(x - y) / scale < ANSWER_TOLERANCE) | (F.abs(F.abs(x) - F.abs(y)) / scale < ANSWER_TOLERANCE)
    )

    def items(text: Column) -> Column:
        return F.array_sort(F.transform(F.split(text, ","), lambda p: F.trim(p)))

    same_list = gn.contains(",") & pn.contains(",") & (items(gn) == items(pn))

    def prefix(short: Column, long: Column) -> Column:
        follows = F.substr(long, F.length(short) + 1, F.lit(1)).isin(":", ",", ";")
        return (F.length(short) > 0) & ~short.contains(",") & _number(short).isNull() & long.startswith(short) & follows

    equal = (
        F.when(F.lower(p) == F.lower(g), True)
        .when(pn == gn, True)
        .when(pn.isin(NO_ANSWER) & gn.isin(NO_ANSWER), True)
        .when(x.isNotNull() & y.isNotNull(), near)
        .otherwise(same_list | prefix(gn, pn) | prefix(pn, gn))
    )
    return F.coalesce(equal, F.lit(False))


def score_answer(answers: DataFrame) -> DataFrame:
    """Verdict per answer.

    Input columns: answer (formatted rows, NULL after a failed execution), gold, has_sql, failed,
    hit_limit. Adds predicted_answer, correctness, score, match_source and reason.
    """
    failed = F.coalesce("failed", F.lit(False))
    trimmed = answers.withColumn("_answer", F.trim("answer")).withColumn("_gold", F.trim("gold"))
    adopted = normalize_to_gold_format(trimmed, "_answer", "_gold", "_adopted")
    predicted = F.when(F.col("hit_limit"), F.lit(None)).when(failed, NOT_APPLICABLE).otherwise(F.col("_adopted"))
    with_answer = adopted.withColumn("predicted_answer", predicted).drop("_answer", "_gold", "_adopted")
    empty = ~failed & (F.coalesce(F.trim("predicted_answer"), F.lit("")) == "")
    right = ~F.col("hit_limit") & ~empty & answers_equal(F.trim("predicted_answer"), F.trim("gold"))
    judged = with_answer.withColumn("_right", F.coalesce(right, F.lit(False)))
    reason = (
        F.when(F.col("hit_limit"), "hit_limit")
        .when(failed & F.col("_right"), "no_sql_produced")
        .when(failed, F.when(F.col("has_sql"), "sql_execution_error").otherwise("no_sql_produced"))
        .when(empty, "empty_prediction")
    )
    return (
        judged.withColumn(
            "correctness",
            F.when(F.col("hit_limit"), "hit_limit").when(F.col("_right"), "correct").otherwise("incorrect"),
        )
        .withColumn("score", F.when(F.col("_right"), 1.0).otherwise(0.0))
        .withColumn("match_source", F.when(F.col("_right"), "answer_scorer").otherwise("none"))
        .withColumn("reason", reason)
        .drop("_right")
    )
