"""Quality rules as weak supervision, with DataFrame and SQL functions only.

Each rule votes good (1) or bad (-1) or abstains (0) on measures of a text. How often a rule is right is
not known; expectation-maximisation estimates it from how rules agree: given the accuracies, every pattern of
votes has a posterior chance of quality, and given these chances, a rule's accuracies are the shares of its
votes that agree with them, one on good texts and one on bad texts: most rules look for one fault and
pass texts with another one. A text is kept if it passes the base rule, on which the estimate rests too, and its
chance is at least one half.

Texts matter to the estimate through their votes alone, so it works on a count per pattern of votes: at most
3 ** rules rows whatever the input, in one row of arrays that the plan joins back. Nothing comes to the driver.

Cases: null and empty texts have no words and fail the base rule; repeated rows are judged each; other columns
are not read; no rows give no rows; rules that never vote keep the accuracy they start with. Windows of words are
told apart by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.frames import written

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """SQL conditions on the measures; a rule abstains where neither holds."""

    name: str
    good: str
    bad: str


# 100 * share < limit, on whole numbers, so that every engine votes alike
RULES = (
    Rule("word_length", "word_chars >= 3 * n_words and word_chars <= 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    # faults that leave several traces have several rules, whose agreement says how far to trust each
    Rule("symbols_by_word", "100 * n_symbols <= 5 * n_words", "100 * n_symbols >= 20 * n_words"),
    Rule("symbols_by_character", "1000 * n_symbols <= 8 * word_chars", "1000 * n_symbols >= 40 * word_chars"),
    Rule("words_with_symbols", "100 * n_symbol_words <= 4 * n_words", "100 * n_symbol_words >= 16 * n_words"),
    Rule("repeats", "100 * n_repeat_words <= 10 * n_words", "100 * n_repeat_words >= 30 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines <= 10 * n_lines", "100 * n_dup_lines >= 40 * n_lines"),
    Rule("capitals", "100 * n_capitals <= 8 * word_chars", "100 * n_capitals >= 30 * word_chars"),
    Rule("exclamations_by_word", "100 * n_bangs <= 5 * n_words", "100 * n_bangs >= 30 * n_words"),
    Rule("exclamations_by_character", "1000 * n_bangs <= 10 * word_chars", "1000 * n_bangs >= 60 * word_chars"),
)
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
ROUNDS = 25
# accuracies at the start and their bounds, on good and on bad texts
START = (0.95, 0.5)
BOUNDS = ((0.6, 0.999), (0.05, 0.95))
PRIOR = 0.8


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_bangs,
    n_symbol_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    solid = F.btrim(text, F.lit(BLANKS))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), solid.alias("solid"))

    def without(chars: str) -> Column:
        return F.length("t") - F.length(F.translate("t", chars, ""))

    rows = rows.select(
        "id",
        F.when(F.col("solid") == "", F.array().cast("array<string>")).otherwise(F.split("solid", r"[\x20\x09-\x0D]+")).alias("w"),
        F.expr(r"filter(split(t, '\n', -1), x -> btrim(x, ' \t\n" + "\x0b\f" + r"\r') != '')").alias("lines"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without(CAPITALS).cast("long").alias("n_capitals"),
        without("!?").cast("long").alias("n_bangs"),
    )
    narrow = ["id", "word_chars", "n_symbols", "n_capitals", "n_bangs"]
    rows = rows.select(
        *narrow, F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        F.expr(f"cast(size(filter(w, x -> translate(x, '{SYMBOLS}', '') != x)) as long)").alias("n_symbol_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(w) < 3, array(), transform(slice(w, 1, size(w) - 2), (x, i) -> struct(xxhash64(x, w[i + 1], w[i + 2]) as h, i as i)))").alias("windows"),
    )
    rows = rows.withColumn("windows", F.sort_array("windows"))
    # a window found twice or more stands next to its like
    twice = "filter(windows, (x, i) -> coalesce(get(windows, i - 1).h = x.h, false) or coalesce(get(windows, i + 1).h = x.h, false))"
    rows = rows.withColumn("places", F.sort_array(F.expr(f"transform({twice}, x -> x.i)")))
    covered = (
        "aggregate(places, named_struct('end', 0, 'n', 0L), (a, p) -> "
        "named_struct('end', p + 3, 'n', a.n + p + 3 - greatest(a.end, p)), a -> a.n)"
    )
    return rows.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"), "n_lines", "n_capitals", "n_bangs", "n_symbol_words"
    )


def accuracies(votes: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row: prior (chance of quality), good and bad (each rule's accuracy on good and on bad texts), from
    the column ``votes`` (array)."""
    patterns = votes.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # at most 3 ** rules patterns
    pats = F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats")
    gathered = patterns.groupBy().agg(pats)
    posterior = f"transform(pats, p -> named_struct('v', p.votes, 'n', p.n, 'q', {_chance('p.votes', 's.', rules)}))"

    def accuracy(k: int, vote: int, share: str) -> str:
        (low, high), start = BOUNDS[k], START[k]
        return (
            f"transform(sequence(1, {rules}), j -> greatest({low}D, least({high}D, "
            f"aggregate(e, {start}D, (t, x) -> t + if(element_at(x.v, j) = {vote}, x.n * {share}, 0D))"
            f" / aggregate(e, 1D, (t, x) -> t + if(element_at(x.v, j) != 0, x.n * {share}, 0D)))))"
        )

    prior = "greatest(0.05D, least(0.95D, aggregate(e, 0D, (t, x) -> t + x.n * x.q) / aggregate(e, 0D, (t, x) -> t + x.n)))"
    new = f"named_struct('prior', {prior}, 'good', {accuracy(0, 1, 'x.q')}, 'bad', {accuracy(1, -1, '(1 - x.q)')})"
    # the posteriors of a round are bound to one name: a one-element array, mapped
    step = f"element_at(transform(array({posterior}), e -> {new}), 1)"
    start = ", ".join(f"'{name}', transform(sequence(1, {rules}), j -> {x}D)" for name, x in zip(("good", "bad"), START, strict=True))
    state = F.expr(f"aggregate(sequence(1, {rounds}), named_struct('prior', {PRIOR}D, {start}), (s, i) -> if(size(pats) = 0, s, {step}))")
    return gathered.select(state.alias("s")).select("s.prior", "s.good", "s.bad")


def _chance(votes: str, model: str, rules: int) -> str:
    """The posterior chance of quality of a pattern of votes."""
    one = (
        f"case element_at({votes}, j) when 1 then ln(element_at({model}good, j) / (1 - element_at({model}bad, j))) "
        f"when -1 then ln((1 - element_at({model}good, j)) / element_at({model}bad, j)) else 0D end"
    )
    return f"(1 / (1 + exp(-(ln({model}prior / (1 - {model}prior)) + aggregate(sequence(1, {rules}), 0D, (t, j) -> t + {one})))))"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measures, base_failed, kept, votes (array) and posterior."""
    vote = [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0) for r in rules]
    found = measures(docs, id_col, text_col).withColumn("votes", F.array(*vote)).withColumn("base_failed", F.expr(BASE))
    found = written(found, "measures")
    model = accuracies(found.where("not base_failed"), len(rules))
    judged = found.join(F.broadcast(model)).withColumn("posterior", F.expr(_chance("votes", "", len(rules))))  # one row
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"), "votes", "posterior",
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    drop = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    ks = range(1, len(RULES) + 1)
    votes = ", ".join(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end as v{k}" for k, r in zip(ks, RULES, strict=True))
    odds = "ln(prior / (1 - prior)) + " + " + ".join(
        f"case v{k} when 1 then ln(g{k} / (1 - b{k})) when -1 then ln((1 - g{k}) / b{k}) else 0 end" for k in ks
    )
    vs, acc = ", ".join(f"v{k}" for k in ks), ", ".join(f"g{k}, b{k}" for k in ks)

    def accuracy(k: int, which: int, vote: int, share: str) -> str:
        (low, high), start = BOUNDS[which], START[which]
        hits = f"{start} + sum(case when v{k} = {vote} then n * {share} else 0 end)"
        return f"greatest({low}, least({high}, ({hits}) / (1 + sum(case when v{k} <> 0 then n * {share} else 0 end))))"

    steps = ", ".join(f"{accuracy(k, 0, 1, 'q')}, {accuracy(k, 1, -1, '(1 - q)')}" for k in ks)
    starts = ", ".join(f"cast({START[0]} as double) as g{k}, cast({START[1]} as double) as b{k}" for k in ks)
    return f"""
    with recursive d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    w as (select r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: trim(x, {blanks}) <> '') as l from d),
    g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
    c as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
    p as (select r, count(distinct i + k) as n from c, (select unnest([0, 1, 2]) as k) group by r),
    m as (select d.doc_id, cast(len(w.w) as bigint) as n_words, cast(length(translate(t, {blanks}, '')) as bigint) as word_chars,
        cast({drop(SYMBOLS)} as bigint) as n_symbols, cast({drop(CAPITALS)} as bigint) as n_capitals,
        cast({drop("!?")} as bigint) as n_bangs,
        cast(len(w.l) as bigint) as n_lines, cast(len(w.l) - len(list_distinct(w.l)) as bigint) as n_dup_lines,
        cast(len(list_filter(w.w, lambda x: translate(x, '{SYMBOLS}', '') <> x)) as bigint) as n_symbol_words,
        cast(coalesce(p.n, 0) as bigint) as n_repeat_words
        from d join w using (r) left join p using (r)),
    x as (select *, {votes}, ({BASE}) as base_failed from m),
    pats as (select {vs}, cast(count(*) as double) as n from x where not base_failed group by all),
    em as (select 0 as i, cast({PRIOR} as double) as prior, {starts}
        union all
        select i + 1, greatest(0.05, least(0.95, sum(n * q) / sum(n))), {steps}
        from (select em.i, pats.*, 1 / (1 + exp(-({odds}))) as q from em, pats where em.i < {ROUNDS}) group by i),
    model as (select prior, {acc} from em where i = {ROUNDS})
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and 1 / (1 + exp(-({odds}))) >= 0.5 as kept
    from x, model"""
