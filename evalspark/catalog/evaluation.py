"""Registered queries of the evaluation analytics family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.registry import Registry
from evalspark.operators import evaluation as H

_COMPLETED = """
select * exclude (rn) from (select *, row_number() over (partition by run_id order by log_time desc, event_id desc) as rn from summaries)
where rn = 1 and coalesce(status, 'completed') = 'completed'
"""
_EX = "select e.* from exchanges e where run_id in (select run_id from completed)"
_P = {"completed": _COMPLETED, "done_exchanges": _EX}
_ACCEPT = "regexp_matches(coalesce(partial_reason, ''), '^(extra_columns|extra_duplicates|implicit_distinct|aggregated_equivalent)')"
_SCORED = f"""
select *, case when category in ('correct_gold', 'correct_platinum', 'correct_judge', 'partial_accepted') then cast(1 as double)
    else cast(0 as double) end as score
from (select *, case when level = 'correct' and match_source = 'platinum' then 'correct_platinum' when level = 'correct' then 'correct_gold'
        when level = 'judge_correct' then 'correct_judge' when level = 'error' then 'error' when level = 'hit_limit' then 'hit_limit'
        when level = 'partial' and {_ACCEPT} then 'partial_accepted' when level = 'partial' then 'partial_unaccepted'
        else 'incorrect' end as category from eval_results)
"""
_S = {"scored": _SCORED}
_CATS = ", ".join(f"count(*) filter (category = '{c}') as {c}" for c in H.CATEGORIES)
_OUTCOME = "case when is_correct then 'correct' when error is not null then 'error' when partial_reason is not null then 'partial' else 'wrong' end"
_SPLIT = """
select question_id, db_id, case when rn <= case when n > 1 then least(greatest(round_even(n * cast(0.3 as double), 0), 1), n - 1)
    else greatest(round_even(n * cast(0.3 as double), 0), 1) end then 'train' else 'test' end as split
from (select *, row_number() over (partition by db_id order by md5('42:' || cast(question_id as varchar)), question_id) as rn,
        count(*) over (partition by db_id) as n from (select distinct question_id, db_id from eval_raw))
"""


def _completed(t):
    return H.completed_runs(t.summaries, ["log_time", "event_id"])


def _exchanges(t):
    return H.completed_exchanges(t.exchanges, _completed(t))


def register(r: Registry) -> None:
    r.add("completed_runs", _completed, "select * from completed", extra=_P)
    r.add("completed_exchanges", _exchanges, "select * from done_exchanges", extra=_P)
    r.add(
        "model_leaderboard",
        lambda t: H.model_leaderboard(_completed(t)),
        """
        select model, count(*) as runs, sum(puzzles_solved) as solved, sum(puzzles_attempted) as attempted,
            round(sum(puzzles_solved) * cast(100 as double) / sum(puzzles_attempted), 1) as solve_pct,
            round(median(total_cost / puzzles_attempted), 4) as med_cost_per_puzzle, round(median(avg_time_sec), 1) as med_time
        from completed group by 1
        """,
        doubles="solve_pct med_cost_per_puzzle med_time",
        longs="solved attempted",
        extra=_P,
    )
    r.add(
        "run_leaderboard",
        lambda t: H.run_leaderboard(_completed(t)),
        """
        select run_id, model, puzzles_solved, puzzles_attempted, round(cast(puzzles_solved as double) / puzzles_attempted * 100, 1) as solve_pct,
            round(total_cost, 4) as cost, round(total_cost / puzzles_attempted, 4) as cost_per_puzzle, total_tokens as tokens,
            round(avg_time_sec, 1) as avg_time from completed
        """,
        doubles="solve_pct cost cost_per_puzzle avg_time",
        extra=_P,
    )
    r.add(
        "item_difficulty",
        lambda t: H.item_difficulty(_exchanges(t)),
        """
        select puzzle_id, count(*) as runs, sum(won) as wins, round(cast(sum(won) as double) / count(*) * 100, 0) as solve_pct,
            round(avg(guesses), 1) as avg_guesses, round(median(correct), 1) as med_correct, round(median(incorrect), 1) as med_incorrect,
            round(median(cost), 4) as med_cost, round(median(ms) / 1000, 1) as med_time_sec
        from (select puzzle_id, model, run_id, count(*) filter (result like 'CORRECT%') as correct,
                count(*) filter (result like 'INCORRECT%') as incorrect, max(case when result = 'CORRECT' then 1 else 0 end) as won,
                round(sum(coalesce(cost, 0)), 9) as cost, sum(latency_ms) as ms, max(guess_index) as guesses
              from done_exchanges group by 1, 2, 3) group by 1
        """,
        doubles="solve_pct avg_guesses med_correct med_incorrect med_cost med_time_sec",
        longs="wins",
        extra=_P,
    )
    r.add(
        "cost_analysis",
        lambda t: H.cost_analysis(_exchanges(t)),
        """
        select model, round(sum(cost), 4) as total_cost, round(median(cost), 4) as med_cost_per_puzzle, round(median(prompt)) as med_prompt_tok,
            round(median(completion)) as med_compl_tok, round(median(ms), 0) as med_latency_ms
        from (select model, run_id, puzzle_id, round(sum(coalesce(cost, 0)), 9) as cost, sum(coalesce(prompt_tokens, 0)) as prompt,
                sum(coalesce(completion_tokens, 0)) as completion, sum(latency_ms) as ms from done_exchanges group by 1, 2, 3) group by 1
        """,
        doubles="total_cost med_cost_per_puzzle med_prompt_tok med_compl_tok med_latency_ms",
        extra=_P,
    )
    r.add(
        "cost_by_run",
        lambda t: H.cost_by_run(_exchanges(t)),
        """
        select model, run_id, round(sum(coalesce(cost, 0)), 4) as total_cost, sum(coalesce(cost, 0)) / count(distinct puzzle_id) as cost_per_puzzle,
            sum(coalesce(prompt_tokens, 0)) as prompt_tok, sum(coalesce(completion_tokens, 0)) as completion_tok, round(avg(latency_ms)) as avg_latency
        from done_exchanges group by 1, 2
        """,
        doubles="total_cost cost_per_puzzle avg_latency",
        longs="prompt_tok completion_tok",
        digits=6,
        extra=_P,
    )
    replay = """
        select e.run_id, e.puzzle_id, guess_index, guess, result, latency_ms, round(coalesce(cost, 0), 4) as cost, won, won and solved < 4 as auto_solved
        from done_exchanges e join (select run_id, puzzle_id, bool_or(result = 'CORRECT') as won, count(*) filter (result like 'CORRECT%') as solved
            from done_exchanges group by 1, 2) o on e.run_id = o.run_id and e.puzzle_id = o.puzzle_id
    """
    r.add(
        "replay",
        lambda t: H.replay(t.exchanges, _completed(t)),
        replay,
        doubles="cost",
        extra=_P,
    )
    r.add(
        "replay_last_runs",
        lambda t: H.replay(t.exchanges, _completed(t), last_runs=3),
        replay + " where e.run_id in (select run_id from completed order by run_id desc limit 3)",
        doubles="cost",
        extra=_P,
    )
    r.add(
        "replay_page",
        lambda t: H.replay(t.exchanges, _completed(t), last_runs=None, page=50),
        f"select * from ({replay}) order by run_id desc, puzzle_id, guess_index limit 50",
        doubles="cost",
        extra=_P,
    )
    r.add(
        "run_totals",
        lambda t: H.run_totals(t.exchanges),
        """
        select run_id, model, count(*) as puzzles_attempted, sum(won) as puzzles_solved, sum(turns - invalid) as total_guesses,
            sum(turns - invalid - mistakes) as correct_guesses, sum(mistakes) as incorrect_guesses, sum(invalid) as invalid_responses,
            round(sum(ms) / 1000, 1) as total_time_sec, coalesce(sum(p), 0) as total_prompt_tokens, coalesce(sum(c), 0) as total_completion_tokens,
            coalesce(sum(cost), 0) as total_cost
        from (select run_id, model, puzzle_id, max(case when result = 'CORRECT' then 1 else 0 end) as won, count(*) as turns,
                count(*) filter (result like 'INVALID%') as invalid, count(*) filter (result like 'INCORRECT%') as mistakes,
                sum(latency_ms) as ms, sum(prompt_tokens) as p, sum(completion_tokens) as c, sum(cost) as cost from exchanges group by 1, 2, 3)
        group by 1, 2
        """,
        doubles="total_time_sec total_cost",
        longs="puzzles_solved total_guesses correct_guesses incorrect_guesses invalid_responses total_prompt_tokens total_completion_tokens",
    )
    r.add(
        "score_result",
        lambda t: H.score_result(t.eval_results).select("run_id", "question_id", "level", "category", "score"),
        "select run_id, question_id, level, category, score from scored",
        extra=_S,
    )
    r.add(
        "accuracy_stats",
        lambda t: H.accuracy_stats(t.eval_results, ["run_id"]),
        f"select run_id, count(*) as total, {_CATS}, sum(score) as credited, sum(score) / count(*) as accuracy from scored group by 1",
        doubles="accuracy",
        longs="credited",
        extra=_S,
    )
    r.add(
        "needs_judge",
        lambda t: H.needs_judge(t.eval_results).select("run_id", "question_id", "level", "partial_reason"),
        f"select run_id, question_id, level, partial_reason from eval_results where level not in ('correct', 'hit_limit', 'error') "
        f"and coalesce(match_source, '') not in ('gold', 'platinum') and not (level = 'partial' and {_ACCEPT})",
    )
    r.add(
        "model_config_summary",
        lambda t: H.model_config_summary(t.eval_results),
        f"""
        select model, config, count(*) as total, {_CATS}, sum(cost) as cost, 0 as is_total from scored group by 1, 2
        union all select 'TOTAL', null, count(*), {_CATS}, sum(cost), 1 from scored
        """,
        doubles="cost",
        longs=" ".join(["total", *H.CATEGORIES, "is_total"]),
        extra=_S,
    )
    parts = " union all ".join(
        f"select '{d}' as dimension, coalesce(cast({d} as varchar), 'unknown') as value, count(*) as total, "
        + ", ".join(f"count(*) filter (o = '{o}') as {o}" for o in ("correct", "wrong", "partial", "error"))
        + f" from (select *, {_OUTCOME} as o from eval_results) group by 2"
        for d in ("db_id", "difficulty", "level")
    )
    r.add(
        "accuracy_by",
        lambda t: H.accuracy_by(t.eval_results, ["db_id", "difficulty", "level"]),
        f"select *, correct * cast(100 as double) / total as accuracy_pct from ({parts})",
        doubles="accuracy_pct",
    )
    r.add(
        "train_test_table",
        lambda t: H.train_test_table(t.eval_results),
        """
        select m.model, c.config, coalesce(train_total, 0) as train_total, coalesce(train_correct, 0) as train_correct,
            coalesce(test_total, 0) as test_total, coalesce(test_correct, 0) as test_correct,
            coalesce(train_correct / nullif(train_total, 0), 0) as train_accuracy, coalesce(test_correct / nullif(test_total, 0), 0) as test_accuracy
        from (select distinct model from scored) m cross join (select unnest(['baseline', 'comments', 'full']) as config) c
        left join (select model, config, count(*) filter (phase = 'train') as train_total, count(*) filter (phase = 'train' and score > 0) as train_correct,
            count(*) filter (phase = 'test') as test_total, count(*) filter (phase = 'test' and score > 0) as test_correct from scored group by 1, 2) s
        on m.model = s.model and c.config = s.config
        """,
        doubles="train_accuracy test_accuracy",
        extra=_S,
    )
    r.add(
        "lift_analysis",
        lambda t: H.lift_analysis(t.eval_results),
        """
        select *, comments - baseline as comments_lift, "full" - baseline as full_lift, "full" - comments as history_lift from (
            select model, avg(score) filter (config = 'baseline') as baseline, avg(score) filter (config = 'comments') as comments,
                avg(score) filter (config = 'full') as "full" from scored where phase = 'test' group by 1)
        where baseline is not null and comments is not null and "full" is not null
        """,
        doubles="baseline comments comments_lift full_lift history_lift",
        extra=_S,
        digits=9,
    )
    sides = ", ".join(
        f"count(*) filter (config = '{a}' and is_correct) as {a}_correct, count(*) filter (config = '{a}') as {a}_n, "
        f"sum(cost) filter (config = '{a}') as {a}_cost"
        for a in ("baseline", "full")
    )
    r.add(
        "arm_compare",
        lambda t: H.arm_compare(t.eval_results, "baseline", "full"),
        f"select *, baseline_correct * cast(100 as double) / baseline_n as baseline_pct, full_correct * cast(100 as double) / full_n as full_pct, "
        f"full_correct * cast(100 as double) / full_n - baseline_correct * cast(100 as double) / baseline_n as delta_points from (select {sides} from eval_results)",
        doubles="baseline_cost full_cost baseline_pct full_pct delta_points",
    )
    latest = "(select *, row_number() over (partition by question_id, model, config order by event_time desc, event_id desc) as rk from eval_results)"
    r.add(
        "arm_trace_compare",
        lambda t: H.arm_trace_compare(t.eval_results, "baseline", "full"),
        f"""
        select coalesce(b.question_id, f.question_id) as question_id, coalesce(b.model, f.model) as model, b.level as baseline_level,
            cast(b.turns as bigint) as baseline_turns, f.level as full_level, cast(f.turns as bigint) as full_turns
        from (select * from {latest} where rk = 1 and config = 'baseline') b full join (select * from {latest} where rk = 1 and config = 'full') f
            on b.question_id = f.question_id and b.model = f.model
        """,
    )
    r.add(
        "results_summary",
        lambda t: H.results_summary(t.eval_results),
        """
        with h as (select count(*) as n, count(*) filter (is_correct) as correct, sum(cost) as cost, sum(duration_ms) / 1000 as time_sec,
            avg(turns) as avg_turns, cast(count(*) filter (level = 'hit_limit') as double) as hit_limit from eval_results)
        select 'total' as section, 'cost' as key, n, correct, cost as value from h union all select 'total', 'time_sec', n, correct, time_sec from h
        union all select 'total', 'avg_turns', n, correct, avg_turns from h union all select 'total', 'hit_limit', n, correct, hit_limit from h
        union all select 'correctness', level, count(*), count(*) filter (is_correct), count(*) filter (is_correct) * cast(100 as double) / count(*) from eval_results group by level
        union all select 'difficulty', difficulty, count(*), count(*) filter (is_correct), count(*) filter (is_correct) * cast(100 as double) / count(*) from eval_results group by difficulty
        """,
        doubles="value",
    )
    r.add(
        "question_stability",
        lambda t: H.question_stability(t.eval_results, ["question_id", "config"]),
        """
        select *, case when "right" = repetitions then 'always_right' when "right" = 0 then 'always_wrong' else 'flaky' end as stability,
            "right" / repetitions as right_share
        from (select question_id, config, count(*) as repetitions, count(*) filter (is_correct) as "right" from eval_results group by 1, 2)
        """,
        doubles="right_share",
    )
    r.add(
        "rep_variance",
        lambda t: H.rep_variance(t.eval_results),
        """
        select config, count(*) as runs, avg(c) as mean_correct, stddev(c) as stdev_correct, min(c) as min_correct, max(c) as max_correct, avg(cost) as mean_cost
        from (select config, run_id, count(*) filter (is_correct) as c, sum(cost) as cost from eval_results group by 1, 2) group by 1
        """,
        doubles="mean_correct stdev_correct mean_cost",
    )
    split = lambda t: H.stratified_split(t.eval_raw, "question_id", "db_id")
    r.add("stratified_split", split, "select * from split_rows", extra={"split_rows": _SPLIT})
    r.add(
        "split_distribution",
        lambda t: H.split_distribution(split(t), "db_id"),
        """
        select coalesce(db_id, 'TOTAL') as db_id, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test, count(*) as total
        from split_rows group by rollup (db_id)
        """,
        extra={"split_rows": _SPLIT},
        longs="train test total",
    )
    r.add(
        "round_robin_sample",
        lambda t: H.round_robin_sample(t.eval_raw, "question_id", "db_id", 25),
        "select question_id, db_id, cast(turn as integer) as turn from (select question_id, db_id, row_number() over (partition by db_id order by question_id) as turn "
        "from (select distinct question_id, db_id from eval_raw)) order by turn, db_id limit 25",
    )
    r.add(
        "filter_by_difficulty",
        lambda t: H.filter_by_difficulty(t.eval_results, "challenging"),
        "select db_id, count(*) as n from eval_results where difficulty = 'challenging' group by 1",
    )
    for name, keep in (("anti_split", False), ("semi_split", True)):
        r.add(
            name,
            lambda t, k=keep: H.anti_split(t.eval_raw, t.reviewed, "question_id", k).groupBy("question_id").agg(F.count(F.lit(1)).alias("n")),
            f"select question_id, count(*) as n from eval_raw where question_id {'' if keep else 'not '}in (select question_id from reviewed) group by 1",
        )
    r.add(
        "error_cards",
        lambda t: H.error_cards(t.eval_events),
        """
        select run_id, cast(question_id as varchar) as question_id, db_id, model, level as correctness_level,
            case level when 'error' then 0 when 'hit_limit' then 1 when 'incorrect' then 2 when 'partial' then 3 else 4 end as level_rank,
            is_correct, case when is_correct then cast(1 as double) else cast(0 as double) end as score, cast(turns as integer) as tool_calls,
            case when event_id % 6 = 0 then cast(0 as double) else cast(duration_ms as double) end as duration_ms,
            case when event_id % 5 < 2 then null else cast(cost_units as double) end as cost_usd from eval_raw
        """,
    )
    r.add(
        "level_counts",
        lambda t: H.level_counts(t.eval_results, ["model"]),
        f"""
        select model, count(*) as total, count(*) filter (level in ('correct', 'judge_correct')) as correct, count(*) filter (level = 'error') as error,
            count(*) filter (level = 'hit_limit') as hit_limit, count(*) filter (level = 'incorrect') as incorrect, count(*) filter (level = 'partial') as "partial",
            count(*) filter (level = 'partial' and {_ACCEPT}) as partial_accepted, count(*) filter (match_source = 'platinum') as platinum
        from eval_results group by 1
        """,
    )
    last = "(select *, row_number() over (partition by {k} order by event_time desc, event_id desc) as rk from {t})"
    r.add(
        "attach_investigations",
        lambda t: H.attach_investigations(
            t.eval_results.select("run_id", "question_id", "model", "level"), t.investigations, t.judgements
        ),
        f"""
        select e.run_id, e.question_id, e.model, e.level, i.category as error_category, i.verdict, j.judged_correct from eval_results e
        left join {last.format(k='run_id, question_id, model', t='investigations')} i on i.rk = 1 and e.run_id = i.run_id and e.question_id = i.question_id and e.model = i.model
        left join {last.format(k='run_id, question_id', t='judgements')} j on j.rk = 1 and e.run_id = j.run_id and e.question_id = j.question_id
        """,
    )
    r.add(
        "run_start_times",
        lambda t: H.run_start_times(
            t.eval_raw.select(
                "run_id",
                "event_time",
                F.when(F.col("config") == "full", "").otherwise(F.col("config")).alias("config"),
                F.when(F.col("event_id").cast("long") % 2 == 0, F.concat(F.lit("my_bench_b_"), F.col("db_id"))).alias("database"),
                F.when(F.col("event_id").cast("long") % 2 == 1, F.concat(F.lit("x-bench_b-"), F.col("event_id"))).alias("exchange_id"),
            )
        ),
        "select run_id, min(event_time) as first_time, min(case when config = 'full' then 'B' else upper(config[1]) end) as config_label from eval_raw group by 1",
    )
    queue = """
        select e.run_id, e.question_id, e.level, case when not ({scope}) then 'wrong_run' when r.question_id is not null then 'already_reviewed'
            when level = 'correct' and match_source = 'platinum' then 'correct_platinum' when level = 'correct' then 'correct_gold'
            when level = 'partial' and regexp_matches(coalesce(partial_reason, ''), 'extra_duplicates|implicit_distinct|aggregated_equivalent') then 'resolved_partial' end as skip_reason,
            case when s.question_id is not null then case when level = 'correct' and match_source = 'platinum' then 'PLATINUM_MATCH'
                when level = 'correct' then 'GOLD_MATCH' else 'NOT_MATCHING' end end as reference_status
        from eval_results e left join reviewed r on e.question_id = r.question_id left join second_reference s on e.question_id = s.question_id
    """
    r.add(
        "review_queue",
        lambda t: H.review_queue(t.eval_results, t.reviewed, t.second_reference, run="run-0").select(
            "run_id", "question_id", "level", "skip_reason", "reference_status"
        ),
        queue.format(scope="e.run_id like 'run-0%'"),
    )
    r.add(
        "review_queue_counts",
        lambda t: H.review_queue_counts(H.review_queue(t.eval_results, t.reviewed, t.second_reference, run="latest")),
        "select coalesce(skip_reason, 'queued') as reason, count(*) as n from ("
        + queue.format(scope="starts_with(e.run_id, (select run_id from eval_results order by event_time desc, run_id desc limit 1))")
        + ") group by 1",
    )
    r.add(
        "verdict_summary",
        lambda t: H.verdict_summary(t.investigations),
        """
        select *, n * cast(100 as double) / (select count(*) from investigations) as pct from (
            select 'verdict' as kind, verdict as value, count(*) as n from investigations group by verdict
            union all select 'recommendation', recommendation, count(*) from investigations group by recommendation
            union all select 'high_confidence', verdict, count(*) from investigations where verdict = 'PREDICTED_CORRECT' and confidence = 'HIGH' group by verdict)
        """,
        doubles="pct",
    )
    r.add(
        "merge_review",
        lambda t: H.merge_review(
            t.second_reference, t.eval_raw.filter("review = 'approve'"), "question_id", ["event_time", "event_id"]
        ),
        """
        select question_id, db_id, false as is_new from second_reference union all
        select distinct question_id, db_id, true from eval_raw where review = 'approve' and question_id not in (select question_id from second_reference)
        """,
    )
    r.add(
        "introspection_summary",
        lambda t: H.introspection_summary(t.investigations),
        """
        select run_id, category, count(*) as n, count(distinct question_id) as questions from investigations
        where run_id = (select run_id from investigations order by event_time desc, run_id desc limit 1) group by 1, 2
        """,
    )
