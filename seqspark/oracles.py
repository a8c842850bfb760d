"""DuckDB SQL for the registered queries, written out from the definitions of the features; only the fixed grids are shared with the library."""

from __future__ import annotations

from collections.abc import Sequence

from seqspark.functions.scalars import EXACT_GRID, FRACTION_GRID, ROUND_FRACTIONS, VISIBLE_GRID

PARTS = ("stack", "mono", "mlp", "drse")


def _nearest(x: str, grid: Sequence[float], index: bool = False) -> str:
    """The nearest point, the lower one of two that are equally near."""
    cases = " ".join(f"WHEN {x} <= {(a + b) / 2!r} THEN {i if index else a!r}" for i, (a, b) in enumerate(zip(grid[:-1], grid[1:], strict=True)))
    return f"(CASE {cases} ELSE {len(grid) - 1 if index else grid[-1]!r} END)"


def _rounded(columns: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns)


def _views(keys: str, hero: str) -> str:
    """CTEs actions, players, hands over events. keys: SQL of group_id and hand_id; hero: SQL of the hero's seat."""
    return f"""
event_rows AS (
  SELECT {keys}, event_id, value, CAST(user_id % 6 AS INT) AS seat, minute(ts) // 15 AS street_no, CAST({hero} AS INT) AS hero_seat,
    CASE event_type WHEN 'click' THEN 'check' WHEN 'view' THEN 'call' WHEN 'signup' THEN 'fold' WHEN 'purchase' THEN 'bet' WHEN 'error' THEN 'raise' END AS action_type
  FROM events),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, hand_id ORDER BY event_id) AS action_idx, ['preflop', 'flop', 'turn', 'river'][street_no + 1] AS street,
    CASE WHEN action_type IN ('call', 'bet', 'raise') THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS cents FROM event_rows),
summed AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY group_id, hand_id ORDER BY action_idx) AS BIGINT) AS after FROM placed),
actions AS (
  SELECT group_id, hand_id, action_idx, seat, hero_seat, action_type, street, street_no, cents / 100 AS amount, cents / 100 / 10 AS norm_bb, (after - cents) / 100 AS pot_before,
    after / 100 AS pot_after, CASE WHEN action_type = 'raise' THEN cents / 100 END AS raise_to, CASE WHEN action_type = 'call' THEN cents / 100 END AS call_to, 10.0::DOUBLE AS bb
  FROM summed),
players AS (SELECT group_id, hand_id, seat, max(value) * 10 AS starting_stack FROM placed GROUP BY 1, 2, 3),
hands AS (
  SELECT group_id, hand_id, any_value(hero_seat) AS hero_seat, 10.0::DOUBLE AS bb, 0 AS button_seat, count(DISTINCT seat) AS n_seats,
    coalesce(max(value * 10) FILTER (seat = hero_seat), 0) AS hero_stack, arg_max(seat, action_idx) = any_value(hero_seat) AS hero_won, arg_max(after, action_idx) / 100 AS total_pot,
    arg_max(street_no, action_idx) = 3 AND arg_max(action_type, action_idx) <> 'fold' AS showdown, count(DISTINCT street_no) FILTER (street_no > 0) AS n_board,
    array_to_string(list_transform(list_sort(list(DISTINCT street_no)), lambda s: ['p', 'f', 't', 'r'][s + 1]), '') AS street_shape
  FROM summed GROUP BY 1, 2)"""


HOURLY = _views("substr(ts::VARCHAR, 1, 10) AS group_id, substr(ts::VARCHAR, 1, 13) AS hand_id", "day(ts) % 6")
SHORT = _views("event_id // 200 AS group_id, event_id // 2 AS hand_id", "(event_id // 200) % 6")

_ROUND = " OR ".join(f"abs(pot_ratio - {f}) < 0.02" for f in ROUND_FRACTIONS)
STEPS = f"""
sequenced AS (
  SELECT *, seat = hero_seat AS hero, street_no AS street_ord,
    last_value(CASE WHEN seat = hero_seat THEN false WHEN action_type IN ('bet', 'raise') THEN true WHEN action_type IN ('call', 'check', 'fold') THEN false END IGNORE NULLS)
      OVER (PARTITION BY group_id, hand_id ORDER BY action_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said,
    lag(action_type) OVER (PARTITION BY group_id, hand_id, seat = hero_seat, street ORDER BY action_idx) AS line FROM actions),
sized AS (
  SELECT *, hero AND coalesce(said, false) AS facing, CASE WHEN hero THEN line END AS before,
    CASE WHEN hero AND action_type IN ('bet', 'raise') AND amount > 0 AND pot_before > 0 THEN amount / pot_before END AS pot_ratio,
    CASE WHEN hero AND action_type IN ('bet', 'raise') AND norm_bb > 0 THEN norm_bb END AS size_bb,
    CASE WHEN pot_before / bb < 5 THEN 0 WHEN pot_before / bb < 15 THEN 1 WHEN pot_before / bb < 40 THEN 2 ELSE 3 END AS pot_bucket FROM sequenced),
steps AS (
  SELECT *, CASE WHEN size_bb IS NOT NULL THEN CASE WHEN abs(round_even(size_bb * 2, 0) / 2 - size_bb) < 0.02 OR (pot_ratio > 0 AND ({_ROUND})) THEN 1.0 ELSE 0.0 END END::DOUBLE AS round_flag FROM sized)"""

def _concentration(source: str, keys: str, value: str) -> str:
    """keys, entropy, modal of a value's distribution."""
    return f"""(SELECT {keys}, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy, max(c) / sum(c) AS modal
      FROM (SELECT {keys}, {value}, count(*) AS c FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL) GROUP BY {keys})"""


HAND_COLUMNS = (
    "n_actions vpip pfr vpip_pfr_gap folded_pre n_pre_raises fold_rate call_rate check_rate raise_rate bet_rate aggression aggr_frac pre_aggr flop_aggr turn_aggr river_aggr postflop_aggr "
    "fold_to_bet faced_bet max_street saw_flop saw_turn saw_river saw_showdown n_board_streets won stack_bb rel_pos n_players total_pot_bb mean_size_bb std_size_bb size_cv min_size_bb "
    "max_size_bb mean_pot_ratio std_pot_ratio roundness n_aggr_actions check_raise bet_fold call_raise limp_reraise"
).split()
#: Of the hero's actions: how many, of each kind, on each street, and the sizes of bets and raises; then the 44 features.
HAND_TABLE = """
hero_counts AS (
  SELECT group_id, hand_id, count(*) FILTER (hero) AS n,
    count(*) FILTER (hero AND action_type = 'fold') AS folds, count(*) FILTER (hero AND action_type = 'call') AS calls, count(*) FILTER (hero AND action_type = 'check') AS checks,
    count(*) FILTER (hero AND action_type = 'raise') AS raises, count(*) FILTER (hero AND action_type = 'bet') AS bets,
    count(*) FILTER (hero AND street = 'preflop') AS n_pre, count(*) FILTER (hero AND street = 'flop') AS n_flop,
    count(*) FILTER (hero AND street = 'turn') AS n_turn, count(*) FILTER (hero AND street = 'river') AS n_river,
    count(*) FILTER (hero AND street = 'preflop' AND action_type IN ('bet', 'raise')) AS a_pre, count(*) FILTER (hero AND street = 'flop' AND action_type IN ('bet', 'raise')) AS a_flop,
    count(*) FILTER (hero AND street = 'turn' AND action_type IN ('bet', 'raise')) AS a_turn, count(*) FILTER (hero AND street = 'river' AND action_type IN ('bet', 'raise')) AS a_river,
    count(*) FILTER (hero AND street = 'preflop' AND action_type = 'call') AS pre_calls, count(*) FILTER (hero AND street = 'preflop' AND action_type = 'fold') AS pre_folds,
    count(*) FILTER (hero AND street = 'preflop' AND action_type = 'raise') AS pre_raises,
    count(*) FILTER (facing) AS faced, count(*) FILTER (facing AND action_type = 'fold') AS faced_folds, coalesce(max(street_no) FILTER (hero), 0) AS top,
    list(size_bb) FILTER (size_bb IS NOT NULL) AS sizes, list(pot_ratio) FILTER (pot_ratio IS NOT NULL) AS shares, avg(round_flag) AS rounds,
    count(*) FILTER (before = 'check' AND action_type IN ('bet', 'raise')) AS check_raises, count(*) FILTER (before = 'call' AND action_type = 'raise') AS call_raises,
    count(*) FILTER (before = 'call' AND action_type = 'raise' AND street = 'preflop') AS limps,
    min(action_idx) FILTER (hero AND action_type = 'bet') AS first_bet, max(action_idx) FILTER (hero AND action_type = 'fold') AS last_fold
  FROM steps GROUP BY 1, 2),
hand_rates AS (
  SELECT *, greatest(n, 1) AS m, bets + raises AS aggressive, coalesce(a_pre / nullif(n_pre, 0), 0) AS r_pre, coalesce(a_flop / nullif(n_flop, 0), 0) AS r_flop,
    coalesce(a_turn / nullif(n_turn, 0), 0) AS r_turn, coalesce(a_river / nullif(n_river, 0), 0) AS r_river,
    coalesce(list_avg(sizes), 0) AS size_mean, coalesce(list_stddev_pop(sizes), 0) AS size_dev, coalesce(list_min(sizes), 0) AS size_low, coalesce(list_max(sizes), 0) AS size_high
  FROM hero_counts),
hand_table AS (
  SELECT group_id, hand_id, n::DOUBLE AS n_actions, (pre_calls + a_pre > 0)::INT::DOUBLE AS vpip, (a_pre > 0)::INT::DOUBLE AS pfr, (pre_calls + a_pre > 0)::INT - (a_pre > 0)::INT::DOUBLE AS vpip_pfr_gap,
    (pre_folds > 0)::INT::DOUBLE AS folded_pre, pre_raises::DOUBLE AS n_pre_raises, folds / m AS fold_rate, calls / m AS call_rate, checks / m AS check_rate, raises / m AS raise_rate, bets / m AS bet_rate,
    aggressive / greatest(1, calls + checks) AS aggression, aggressive / m AS aggr_frac, r_pre AS pre_aggr, r_flop AS flop_aggr, r_turn AS turn_aggr, r_river AS river_aggr,
    (r_flop + r_turn + r_river) / 3 AS postflop_aggr, coalesce(faced_folds / nullif(faced, 0), 0) AS fold_to_bet, faced::DOUBLE AS faced_bet, top::DOUBLE AS max_street,
    (top >= 1)::INT::DOUBLE AS saw_flop, (top >= 2)::INT::DOUBLE AS saw_turn, (top >= 3)::INT::DOUBLE AS saw_river, showdown::INT::DOUBLE AS saw_showdown, n_board::DOUBLE AS n_board_streets, hero_won::INT::DOUBLE AS won,
    hero_stack / bb AS stack_bb, ((hero_seat - button_seat) % n_seats + n_seats) % n_seats / n_seats AS rel_pos, n_seats::DOUBLE AS n_players, total_pot / bb AS total_pot_bb,
    size_mean AS mean_size_bb, size_dev AS std_size_bb, CASE WHEN size_mean > 0 THEN size_dev / size_mean ELSE 0 END AS size_cv, size_low AS min_size_bb, size_high AS max_size_bb,
    coalesce(list_avg(shares), 0) AS mean_pot_ratio, coalesce(list_stddev_pop(shares), 0) AS std_pot_ratio, coalesce(rounds, 0) AS roundness, aggressive::DOUBLE AS n_aggr_actions,
    check_raises::DOUBLE AS check_raise, coalesce(first_bet < last_fold, false)::INT::DOUBLE AS bet_fold, call_raises::DOUBLE AS call_raise, limps::DOUBLE AS limp_reraise
  FROM hand_rates JOIN hands USING (group_id, hand_id))"""

ACTOR_COLUMNS = (
    "action_entropy actor_entropy street_entropy action_switch actor_switch action_run actor_run pot_delta_mean pot_growth pot_monotonic hero_share n_distinct_actors n_streets n_actions "
    "bucket_amt_mean nonzero_amt_share call_share check_share fold_share bet_share raise_share aggr_share preflop_share postflop_share bucket_entropy bucket_amt_std pot_before_bb pot_after_bb"
).split()
_BY_HAND = "group_id, hand_id"
ACTORS = f"""
actor_steps AS (
  SELECT *, row_number() OVER o AS i, (action_type IS DISTINCT FROM lag(action_type) OVER o)::INT AS new_action, (seat IS DISTINCT FROM lag(seat) OVER o)::INT AS new_seat,
    CASE WHEN norm_bb > 0 THEN {_nearest('norm_bb', EXACT_GRID)} END::DOUBLE AS bucket, pot_before / bb AS before_bb, pot_after / bb AS after_bb
  FROM steps WINDOW o AS (PARTITION BY group_id, hand_id ORDER BY action_idx)),
islands AS (SELECT *, sum(new_action) OVER o AS action_run, sum(new_seat) OVER o AS seat_run FROM actor_steps WINDOW o AS (PARTITION BY group_id, hand_id ORDER BY action_idx)),
action_runs AS (SELECT {_BY_HAND}, max(c) AS longest FROM (SELECT {_BY_HAND}, action_run, count(*) AS c FROM islands GROUP BY ALL) GROUP BY ALL),
seat_runs AS (SELECT {_BY_HAND}, max(c) AS longest FROM (SELECT {_BY_HAND}, seat_run, count(*) AS c FROM islands GROUP BY ALL) GROUP BY ALL),
actor_sums AS (
  SELECT {_BY_HAND}, count(*) AS n, coalesce(avg(new_action) FILTER (i > 1), 0) AS action_switch, coalesce(avg(new_seat) FILTER (i > 1), 0) AS actor_switch,
    avg(after_bb - before_bb) AS pot_delta_mean, coalesce(arg_max(after_bb, i) / nullif(greatest(arg_min(before_bb, i), 0), 0), 0) AS pot_growth, avg((after_bb >= before_bb)::INT) AS pot_monotonic,
    avg(hero::INT) AS hero_share, count(DISTINCT seat)::DOUBLE AS n_distinct_actors, count(DISTINCT street)::DOUBLE AS n_streets, coalesce(avg(bucket), 0) AS bucket_amt_mean,
    coalesce(stddev_pop(bucket), 0) AS bucket_amt_std, avg((norm_bb > 0)::INT) AS nonzero_amt_share, greatest(1, count(*) FILTER (action_type IN ('call', 'check', 'fold', 'bet', 'raise'))) AS m,
    count(*) FILTER (action_type = 'call') AS calls, count(*) FILTER (action_type = 'check') AS checks, count(*) FILTER (action_type = 'fold') AS folds, count(*) FILTER (action_type = 'bet') AS bets,
    count(*) FILTER (action_type = 'raise') AS raises, avg((street = 'preflop')::INT) AS preflop_share, avg(before_bb) AS pot_before_bb, avg(after_bb) AS pot_after_bb
  FROM islands GROUP BY ALL),
actor_table AS (
  SELECT s.*, n::DOUBLE AS n_actions, a.entropy AS action_entropy, b.entropy AS actor_entropy, c.entropy AS street_entropy, coalesce(d.entropy, 0) AS bucket_entropy, x.longest / n AS action_run, y.longest / n AS actor_run,
    calls / m AS call_share, checks / m AS check_share, folds / m AS fold_share, bets / m AS bet_share, raises / m AS raise_share, (bets + raises) / m AS aggr_share, 1 - preflop_share AS postflop_share
  FROM actor_sums s JOIN action_runs x USING ({_BY_HAND}) JOIN seat_runs y USING ({_BY_HAND}) JOIN {_concentration('islands', _BY_HAND, 'action_type')} a USING ({_BY_HAND})
    JOIN {_concentration('islands', _BY_HAND, 'seat')} b USING ({_BY_HAND}) JOIN {_concentration('islands', _BY_HAND, 'street')} c USING ({_BY_HAND})
    LEFT JOIN {_concentration('islands', _BY_HAND, 'bucket')} d USING ({_BY_HAND}))"""

_RATES = ("fold_rate", "call_rate", "check_rate", "raise_rate", "bet_rate")
_CV = "coalesce(stddev_pop({0}) FILTER ({0} > 0) / avg({0}) FILTER ({0} > 0), 0)"
#: Columns of the group's consistency, over hand_table.
CONSISTENCY = f"""count(*)::DOUBLE AS group_hands, sum(n_actions) AS total_actions, round(avg(vpip), 6) AS vpip_mean, round(stddev_pop(vpip), 6) AS vpip_std, round(avg(roundness), 6) AS mean_roundness,
  round(avg(saw_showdown), 6) AS showdown_rate, round(avg(won), 6) AS win_rate, round(1 - stddev_pop(aggr_frac), 6) AS aggr_consistency,
  round(coalesce(count(DISTINCT round_even(mean_size_bb, 2)) FILTER (mean_size_bb > 0) / nullif(count(*) FILTER (mean_size_bb > 0), 0), 0), 6) AS distinct_size_frac,
  round(-coalesce(list_sum(list_transform(list_filter([{', '.join(f'avg({r})' for r in _RATES)}], lambda x: x > 0), lambda x: x / ({' + '.join(f'avg({r})' for r in _RATES)}) * ln(x / ({' + '.join(f'avg({r})' for r in _RATES)})))), 0), 6) + 0 AS action_entropy,
  round({_CV.format('mean_size_bb')}, 6) AS size_bb_global_cv, round({_CV.format('mean_pot_ratio')}, 6) AS pot_ratio_global_cv"""
STATS = ("mean", "std", "q25", "q75")
ACTOR_STATS = ("mean", "std", "min", "max", "q10", "q50", "q90")


def _statistic(stat: str, c: str) -> str:
    plain = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
    return f"{plain[stat]}({c})" if stat in plain else f"quantile_cont({c}, {int(stat[1:]) / 100})"


def _statistics(stats: Sequence[str], columns: Sequence[str], prefix: str = "", digits: int = 6) -> str:
    return ", ".join(f"round({_statistic(s, c)}, {digits}) AS {prefix}{s}_{c}" for s in stats for c in columns)


_HIST = ", ".join(f"pot_hist_{i}" for i in range(5))
_POOLED = "pot_hist_0 pot_hist_1 pot_hist_2 pot_hist_3 pot_hist_4 distinct_pot_frac distinct_size_bb_frac n_aggr_pool coarse_bucket_diversity".split()


def _pooled(view: str) -> str:
    return f"""
WITH {view}, {STEPS},
rows AS (
  SELECT group_id, pot_ratio, size_bb, CASE WHEN size_bb IS NOT NULL THEN {_nearest('size_bb', VISIBLE_GRID)} END::DOUBLE AS visible,
    CASE WHEN pot_ratio IS NOT NULL THEN {_nearest('pot_ratio', FRACTION_GRID)} END::DOUBLE AS fraction, round_even(size_bb, 1) AS size_tenth,
    CASE WHEN pot_ratio < 0.4 THEN 0 WHEN pot_ratio < 0.6 THEN 1 WHEN pot_ratio < 0.8 THEN 2 WHEN pot_ratio < 1.1 THEN 3 WHEN pot_ratio IS NOT NULL THEN 4 END AS bin
  FROM steps WHERE size_bb IS NOT NULL OR pot_ratio IS NOT NULL),
base AS (
  SELECT group_id, {', '.join(f'coalesce(avg((bin = {i})::INT), 0) AS pot_hist_{i}' for i in range(5))}, count(pot_ratio)::DOUBLE AS n_aggr_pool,
    coalesce(count(DISTINCT round_even(pot_ratio, 1)) / nullif(count(pot_ratio), 0), 0) AS distinct_pot_frac, coalesce(count(DISTINCT size_tenth) / nullif(count(size_bb), 0), 0) AS distinct_size_bb_frac,
    coalesce(count(DISTINCT visible) / nullif(count(size_bb), 0), 0) AS coarse_bucket_diversity FROM rows GROUP BY 1)
SELECT group_id, {_rounded(_POOLED)}, round(greatest({_HIST}), 6) AS pot_modal_dominance, round(coalesce(h.entropy, 0), 6) + 0 AS pot_ratio_entropy,
  round(coalesce(v.entropy, 0), 6) AS coarse_bucket_ent, round(coalesce(v.modal, 0), 6) AS coarse_bucket_modal,
  CASE WHEN distinct_size_bb_frac > 0 THEN round(coalesce(f.entropy, 0), 6) ELSE 0 END AS coarse_potfrac_ent,
  CASE WHEN distinct_size_bb_frac > 0 THEN round(coalesce(f.modal, 0), 6) ELSE 0 END AS coarse_potfrac_modal, round(coalesce(t.entropy, 0), 6) AS size_bb_entropy
FROM base LEFT JOIN {_concentration('rows', 'group_id', 'visible')} v USING (group_id) LEFT JOIN {_concentration('rows', 'group_id', 'fraction')} f USING (group_id)
  LEFT JOIN {_concentration('rows', 'group_id', 'size_tenth')} t USING (group_id) LEFT JOIN {_concentration('rows', 'group_id', 'bin')} h USING (group_id)"""


def _policy(view: str) -> str:
    return f"""
WITH {view}, {STEPS},
hero AS (SELECT group_id, hand_id, action_idx, street, facing, pot_bucket, action_type, lead(action_type) OVER (PARTITION BY group_id, hand_id ORDER BY action_idx) AS after FROM steps WHERE hero),
contexts AS (
  SELECT group_id, street, facing, pot_bucket, sum(c) AS n, max(c) AS top, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h
  FROM (SELECT group_id, street, facing, pot_bucket, action_type, count(*) AS c FROM hero GROUP BY ALL) GROUP BY ALL),
base AS (
  SELECT group_id, sum(n * h) / sum(n) AS cond, avg((top / n >= 0.8)::INT) AS det, count(*) / sum(n) AS cov, sum(top) / sum(n) AS rep, sum(n)::DOUBLE AS n_decisions FROM contexts GROUP BY 1),
pairs AS (SELECT group_id, action_type || '>' || after AS pair, (action_type = after)::INT AS same FROM hero WHERE after IS NOT NULL),
again AS (SELECT group_id, avg(same) AS rate FROM pairs GROUP BY 1)
SELECT group_id, round(cond, 6) AS cond_action_entropy, round(det, 6) AS policy_determinism, round(cov, 6) AS context_coverage, round(rep, 6) AS mean_context_repeat, n_decisions,
  round(u.entropy, 6) AS unconditional_action_entropy, round(coalesce(g.entropy, 0), 6) AS bigram_entropy, round(coalesce(rate, 0), 6) AS repeat_action_rate
FROM base JOIN {_concentration('hero', 'group_id', 'action_type')} u USING (group_id) LEFT JOIN {_concentration('pairs', 'group_id', 'pair')} g USING (group_id) LEFT JOIN again USING (group_id)"""

_SIGS = {"action_sig": "action_type", "role_sig": "role", "street_sig": "street", "bucket_sig": "cell"}
ACTOR_GROUP = f"""
WITH {SHORT}, {STEPS}, {ACTORS},
stacks AS (
  SELECT group_id, avg(s) AS m, stddev_pop(s) AS d, quantile_cont(s, 0.75) - quantile_cont(s, 0.25) AS q FROM (
    SELECT group_id, starting_stack / 10 AS s FROM players WHERE starting_stack <> 0) GROUP BY 1),
lines AS (SELECT *, CASE WHEN hero THEN 'H' ELSE 'o' END AS role, {_nearest('norm_bb', EXACT_GRID, True)}::VARCHAR AS cell FROM actor_steps),
per AS (
  SELECT group_id, hand_id, {', '.join(f"string_agg({c}, '.' ORDER BY action_idx) AS {s}" for s, c in _SIGS.items())}, count(raise_to) AS raises, count(call_to) AS calls, count(*) AS n,
    avg((action_type IN ('bet', 'raise'))::INT) AS aggr, bool_or(hero) AS hero FROM lines GROUP BY 1, 2),
per_hand AS (SELECT p.*, e.entropy FROM per p JOIN {_concentration('lines', _BY_HAND, 'action_type')} e USING (group_id, hand_id)),
base AS (
  SELECT group_id, sum(raises) / sum(n) AS r, sum(calls) / sum(n) AS c, avg((aggr > 0.5)::INT) AS ha, avg((entropy < 0.5)::INT) AS le, avg((NOT hero)::INT) AS zh, count(*)::DOUBLE AS hc FROM per_hand GROUP BY 1)
SELECT group_id, round(r, 6) AS hf_raise_to_share, round(c, 6) AS hf_call_to_share, round(ha, 6) AS hf_high_aggr_rate, round(le, 6) AS hf_low_entropy_rate, round(zh, 6) AS hf_zero_hero_rate,
  hc AS hf_hand_count, round(ln(1 + hc), 6) AS hf_hand_count_log, {', '.join(f'round({s}.top, 6) AS hf_{s}_top, round({s}.uniq, 6) AS hf_{s}_uniq' for s in _SIGS)},
  round(coalesce(m, 0), 6) AS hf_stack_mean_bb, round(coalesce(d, 0), 6) AS hf_stack_std_bb, round(coalesce(q, 0), 6) AS hf_stack_iqr_bb
FROM base LEFT JOIN stacks USING (group_id) {' '.join(f"JOIN (SELECT group_id, max(c) / sum(c) AS top, count(*) / sum(c) AS uniq FROM (SELECT group_id, {s}, count(*) AS c FROM per GROUP BY 1, 2) GROUP BY 1) {s} USING (group_id)" for s in _SIGS)}"""

_CODE = "CASE action_type WHEN 'fold' THEN 'F' WHEN 'check' THEN 'K' WHEN 'call' THEN 'C' WHEN 'bet' THEN 'B' WHEN 'raise' THEN 'R' ELSE '?' END"
_SIZE = "CASE WHEN {0} <= 0 THEN '0' WHEN {0} <= 1 THEN 's' WHEN {0} <= 3 THEN 'm' WHEN {0} <= 8 THEN 'l' ELSE 'x' END"
SIGNED = f"""
signed AS (
  SELECT group_id, hand_id, street_shape, street_shape || '#' || string_agg(substr(street, 1, 1) || {_CODE} || {_SIZE.format('norm_bb')}, '.' ORDER BY action_idx) AS signature
  FROM actions JOIN hands USING (group_id, hand_id) GROUP BY 1, 2, 3),
sig_counts AS (SELECT group_id, signature, count(*) AS c FROM signed GROUP BY 1, 2),
shares AS (
  SELECT group_id, sum(c)::BIGINT AS n_hands, max(c) / sum(c) AS top_share, count(*) / sum(c) AS unique_share, coalesce(sum(c) FILTER (c >= 2), 0) / sum(c) AS repeat_mass FROM sig_counts GROUP BY 1),
shapes AS (SELECT group_id, max(c) / sum(c) AS street_uniformity FROM (SELECT group_id, street_shape, count(*) AS c FROM signed GROUP BY 1, 2) GROUP BY 1)"""
_CLAMP = "greatest(least({0}, 1), 0)"
_ANCHOR = "CASE WHEN {0} <= 0.3 THEN 0.05 + 0.45 * ({0} / 0.3) WHEN {0} >= 0.9 THEN 1 ELSE 0.5 + 0.5 * ({0} - 0.3) / (0.9 - 0.3) END"
SIG_SCORES = f"""
WITH {SHORT}, {SIGNED},
raw AS (
  SELECT group_id, {_CLAMP.format("0.82 * " + _CLAMP.format("0.45 * top_share + 0.35 * repeat_mass + 0.2 * (1 - unique_share)") + " + 0.18 * street_uniformity")} AS x FROM shares JOIN shapes USING (group_id)),
scored AS (SELECT group_id, group_id // 100 AS batch_id, round({_CLAMP.format(_ANCHOR.format('x'))}, 6) AS raw_score FROM raw),
ranked AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n, row_number() OVER (PARTITION BY batch_id ORDER BY raw_score, group_id) - 1 AS r FROM scored)
SELECT group_id, batch_id, raw_score, round(CASE WHEN n < 4 THEN raw_score ELSE {_CLAMP.format("0.5 - 0.875 * 0.56 + r / (n - 1) * 0.56")} END, 6) AS score FROM ranked"""

_CHOSEN, _FIRST = " WHERE place % greatest(1, n // 60) = 0 AND place / greatest(1, n // 60) < 60", " AND place < 4000"


def _redundancy(chosen: str = "", first: str = "") -> str:
    """chosen, first: which hands are compared, which actions are read; all of them without."""
    return f"""
WITH {SHORT},
lines AS (
  SELECT group_id, hand_id, list(action_type ORDER BY action_idx) AS a, list(street || '|' || action_type || '|' || {_nearest('norm_bb', EXACT_GRID, True)} ORDER BY action_idx) AS rich FROM actions GROUP BY 1, 2),
placed_hands AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY hand_id) - 1 AS place, count(*) OVER (PARTITION BY group_id) AS n FROM lines),
exact AS (
  SELECT group_id, max(n) AS n, 1 - count(DISTINCT array_to_string(a, '.')) / count(*) AS da, 1 - count(DISTINCT array_to_string(rich, '.')) / count(*) AS dr FROM placed_hands GROUP BY 1),
chosen AS (SELECT group_id, place, rich, len(rich) AS m FROM placed_hands{chosen}),
grams AS (SELECT DISTINCT group_id, place, rich[i] || '>' || rich[i + 1] AS g FROM (SELECT *, unnest(range(1, m)) AS i FROM chosen)),
sizes AS (SELECT s.group_id, s.place, count(g) AS k FROM chosen s LEFT JOIN grams x ON s.group_id = x.group_id AND s.place = x.place GROUP BY 1, 2),
common AS (SELECT x.group_id, x.place AS a, y.place AS b, count(*) AS c FROM grams x JOIN grams y ON x.group_id = y.group_id AND x.g = y.g AND x.place <> y.place GROUP BY 1, 2, 3),
sims AS (
  SELECT x.group_id, x.place, CASE WHEN x.k + y.k = 0 THEN 1 ELSE coalesce(c, 0) / (x.k + y.k - coalesce(c, 0)) END AS s
  FROM sizes x JOIN sizes y ON x.group_id = y.group_id AND x.place <> y.place LEFT JOIN common z ON z.group_id = x.group_id AND z.a = x.place AND z.b = y.place),
mass AS (SELECT group_id, place, sum(s) AS r, count(*) AS others FROM sims GROUP BY 1, 2),
weights AS (SELECT *, (r + 1) / (sum(r) OVER (PARTITION BY group_id) + count(*) OVER (PARTITION BY group_id)) AS w FROM mass),
spread AS (SELECT group_id, sum(r) / sum(others) AS j, {_CLAMP.format("exp(-sum(w * ln(w))) / count(*)")} AS v FROM weights GROUP BY 1),
flat AS (SELECT group_id, action_type AS a, lead(action_type) OVER o AS b, row_number() OVER o AS place FROM actions WINDOW o AS (PARTITION BY group_id ORDER BY hand_id, action_idx)),
pairs AS (SELECT group_id, a, b, count(*) AS c FROM flat WHERE b IS NOT NULL{first} GROUP BY 1, 2, 3),
rates AS (SELECT group_id, -sum(c * log2(c / f)) / sum(c) AS e FROM (SELECT *, sum(c) OVER (PARTITION BY group_id, a) AS f FROM pairs) GROUP BY 1)
SELECT group_id, CASE WHEN n < 2 THEN 0 ELSE round(coalesce(j, 0), 6) END AS rp_pair_jaccard_mean, CASE WHEN n < 2 THEN 1 ELSE round(coalesce(v, 0), 6) END AS rp_vendi_frac,
  CASE WHEN n < 2 THEN 0 ELSE round(da, 6) END AS rp_exact_dup_frac_action, CASE WHEN n < 2 THEN 0 ELSE round(dr, 6) END AS rp_exact_dup_frac_rich,
  CASE WHEN n < 2 THEN 0 ELSE round(coalesce(e, 0), 6) + 0 END AS rp_entropy_rate
FROM exact LEFT JOIN spread USING (group_id) LEFT JOIN rates USING (group_id)"""


CODES = f"""
WITH e AS (
  SELECT *, CAST(round(value * 100) AS BIGINT) / 1000 AS u,
    CASE event_type WHEN 'click' THEN 'check' WHEN 'view' THEN 'call' WHEN 'signup' THEN 'fold' WHEN 'purchase' THEN 'bet' WHEN 'error' THEN 'raise' END AS action_type FROM events)
SELECT event_id, {_SIZE.format('u')} AS size_code, CASE WHEN u < 5 THEN 0 WHEN u < 15 THEN 1 WHEN u < 40 THEN 2 ELSE 3 END AS pot_bucket, event_id % 5 AS street_no, {_CODE} AS action_code,
  {_nearest('u', EXACT_GRID)}::DOUBLE AS exact, {_nearest('u', VISIBLE_GRID)}::DOUBLE AS visible, {_nearest('u', FRACTION_GRID)}::DOUBLE AS fraction,
  CASE WHEN event_id % 3 = 0 THEN 0.02 ELSE event_id % 3 END AS or_default, (props->>'$.k')::DOUBLE AS k, -1.0 AS no_number, round((((user_id % 6 - event_id % 4) % 6 + 6) % 6) / 6, 6) AS position
FROM e"""

SCORED = (
    "scored AS (SELECT *, round((stack + mono + mlp + drse) / 4, 9) AS score, floor(round((stack + mono + mlp + drse) / 4, 9) * 20) / 20 AS tied FROM (SELECT vec_id AS idx, vec_id % 5 AS batch_id, "
    "(vec_id % 8)::VARCHAR AS release, (label < 5)::INT AS label, embedding, "
    + ", ".join(f"1 / (1 + exp(-10 * embedding[{k + 1}]::DOUBLE)) AS {p}" for k, p in enumerate(PARTS))
    + " FROM embeddings))"
)
_LOGIT = "ln(greatest(least({0}, 0.999999), 0.000001) / (1 - greatest(least({0}, 0.999999), 0.000001)))"
_SIGMOID = "1 / (1 + exp(-greatest(least({0}, 35), -35)))"
_RECENTRE = "greatest(least(CASE WHEN {0} < {1} THEN 0.5 * {0} / {1} ELSE 0.5 + 0.5 * ({0} - {1}) / (1 - {1}) END, 1), 0)"
_W = dict(zip(PARTS, (3, 2, 1, 2), strict=True))


def _served(source: str, batch: str, live: str, keep: str) -> str:
    """CTEs lifted and served from a table with batch, idx, score (recentred)."""
    return f"""
fixed AS (SELECT {keep}, CASE WHEN {live} THEN score ELSE 0.1 END AS score FROM {source}),
ordered AS (
  SELECT *, count(*) OVER (PARTITION BY {batch}) AS n, sum((score >= 0.5)::INT) OVER (PARTITION BY {batch}) AS pos, max(score) OVER (PARTITION BY {batch}) - min(score) OVER (PARTITION BY {batch}) AS spread,
    row_number() OVER (PARTITION BY {batch} ORDER BY score DESC, idx) - 1 AS place FROM fixed),
lifted AS (SELECT {keep}, CASE WHEN pos >= 1 OR spread < 0.05 THEN score WHEN place < 1 AND score < 0.5 THEN 0.51 ELSE score END AS score FROM ordered),
again AS (
  SELECT *, greatest(1, floor(0.16 * count(*) OVER (PARTITION BY {batch}))) AS k, sum((score >= 0.5)::INT) OVER (PARTITION BY {batch}) AS pos,
    least(coalesce(max(CASE WHEN score < 0.5 THEN score END) OVER (PARTITION BY {batch}), 0.45), 0.499) AS low, row_number() OVER (PARTITION BY {batch} ORDER BY score DESC, idx) - 1 AS place FROM lifted),
served AS (
  SELECT {keep}, CASE WHEN score >= 0.5 AND pos > k AND place >= k THEN low + (0.5 - low) * (pos - k - (place - k)) / (pos - k + 1) ELSE score END AS score FROM again)"""


def _ranking(source: str, by: str, score: str = "score", label: str = "label") -> str:
    """by, n_rows, n_pos, auc, ap, recall_at_fpr over pairs and prefixes, written out."""
    part = f"PARTITION BY {by}"
    return f"""(
  WITH s AS (SELECT {by}, {score} AS score, {label} AS label FROM {source}),
  st AS (SELECT {by}, score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY ALL),
  cu AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n FROM st)
  SELECT {by}, sum(pos + neg)::BIGINT AS n_rows, sum(pos)::BIGINT AS n_pos, sum(neg * (tp - pos / 2)) / nullif(max(p) * max(n), 0) AS auc, sum(pos * (tp / (tp + fp))) / nullif(max(p), 0) AS ap,
    CASE WHEN max(p) > 0 AND max(n) > 0 THEN max(CASE WHEN fp <= 0.05 * n THEN tp / p ELSE 0 END) END AS recall_at_fpr FROM cu GROUP BY {by})"""


def _hard(source: str, by: str) -> str:
    return f"(SELECT {by}, avg((score >= 0.5)::INT) FILTER (label = 0) AS hard_fpr, avg((score >= 0.5)::INT) FILTER (label = 1) AS hard_recall, avg((score >= 0.5)::INT) AS positive_rate FROM {source} GROUP BY {by})"


_REWARD = "0.35 * ap + 0.3 * recall_at_fpr + 0.35 * greatest(0, 1 - hard_fpr / 0.1)"
REPORT = f"""report AS (
  SELECT a.*, hard_fpr, hard_recall, positive_rate, {_REWARD} AS reward FROM {_ranking('scored', 'release')} a JOIN {_hard('scored', 'release')} b USING (release)
  WHERE n_rows >= 20 AND n_pos > 0 AND n_pos < n_rows)"""
LONG = "long AS (SELECT release, label, 'f' || k AS feature, embedding[k + 1]::DOUBLE AS value FROM (SELECT *, unnest(range(0, 64)) AS k FROM scored))"
SHIFT = """shift AS (
  SELECT feature, avg(value) FILTER (release = '7') AS mu_live, avg(value) FILTER (release <> '7') AS mu_bench, stddev_pop(value) FILTER (release <> '7') AS sd_bench,
    abs(avg(value) FILTER (release = '7') - avg(value) FILTER (release <> '7')) / (stddev_pop(value) FILTER (release <> '7') + 1e-9) AS z FROM long GROUP BY 1)"""
RHOS = """rhos AS (
  SELECT feature, release, corr(rx, ry) AS rho FROM (
    SELECT *, rank() OVER (PARTITION BY feature, release ORDER BY value) + (count(*) OVER (PARTITION BY feature, release, value) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY feature, release ORDER BY label) + (count(*) OVER (PARTITION BY feature, release, label) - 1) / 2 AS ry FROM long)
  GROUP BY 1, 2 HAVING count(*) >= 8 AND count(DISTINCT label) >= 2 AND stddev_pop(rx) > 0)"""
CUSTOMERS = """customer_steps AS (
  SELECT o_custkey AS group_id, o_orderkey AS hand_id, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS action_idx,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'check' WHEN 'AO' THEN 'call' WHEN 'NF' THEN 'fold' WHEN 'NO' THEN 'bet' WHEN 'RF' THEN 'raise' WHEN 'RO' THEN 'call' END AS action_type,
    CASE WHEN l_returnflag || l_linestatus IN ('AO', 'NO', 'RF', 'RO') THEN l_quantity END AS size, (1995 + o_custkey % 7)::VARCHAR AS release, (o_custkey % 2)::INT AS label
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
CUSTOMER_HANDS = f"{CUSTOMERS}, customer_hands AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n_hands FROM (SELECT DISTINCT release, label, group_id, hand_id FROM customer_steps))"
RESAMPLED = f"""{CUSTOMER_HANDS},
pool AS (SELECT DISTINCT release, label, group_id, n_hands FROM customer_hands),
many AS (SELECT p.* FROM pool p JOIN (SELECT release, label FROM pool GROUP BY 1, 2 HAVING count(*) >= 2) USING (release, label)),
plan AS (
  SELECT *, md5('7:' || size || ':' || draw || ':' || group_id) AS key FROM many, (SELECT unnest([20, 40]) AS size), (SELECT unnest([0, 1]) AS draw), (SELECT unnest([0, 1, 2]) AS cycle)),
taken AS (SELECT *, sum(n_hands) OVER (PARTITION BY release, label, size, draw ORDER BY cycle, key, group_id) - n_hands AS start FROM plan),
numbered AS (SELECT *, row_number() OVER (PARTITION BY release, label, group_id ORDER BY hand_id) - 1 AS i FROM customer_hands),
drawn AS (
  SELECT release, label, size, draw, (start + i)::BIGINT AS place, group_id, hand_id FROM taken JOIN numbered USING (release, label, group_id) WHERE start < size AND start + i < size)"""

_GRID = """grid AS (
  SELECT 0 AS candidate, 15 AS stack, 11 AS mono, 14 AS mlp, 10 AS drse
  UNION ALL SELECT row_number() OVER (ORDER BY stack, mono, mlp, drse), * FROM (
    SELECT stack, mono, mlp, 50 - stack - mono - mlp AS drse FROM (SELECT unnest(range(10, 21)) AS stack), (SELECT unnest(range(5, 16)) AS mono), (SELECT unnest(range(10, 22)) AS mlp))
  WHERE drse BETWEEN 5 AND 15 AND NOT (stack = 15 AND mono = 11 AND mlp = 14 AND drse = 10))"""
_BLEND = _SIGMOID.format("(" + " + ".join(f"g.{p} * {_LOGIT.format('s.' + p)}" for p in PARTS) + ") / 50")
WEIGHTS = f"""
WITH {SCORED}, {_GRID},
blended AS (SELECT candidate, idx, label, {_BLEND} AS score FROM scored s, grid g),
cuts AS (SELECT candidate, coalesce(quantile_cont(score, 0.95) FILTER (label = 0), 0.5) AS threshold FROM blended GROUP BY 1),
bounded AS (SELECT candidate, greatest(least(threshold, 0.999999), 0.000001) AS t FROM cuts),
centred AS (SELECT candidate, idx, label, {_RECENTRE.format('score', 't')} AS score FROM blended JOIN bounded USING (candidate)),
{_served('centred', 'candidate', 'true', 'candidate, idx, label')},
rewards AS (SELECT g.*, round(threshold, 5) AS threshold, round({_REWARD}, 5) AS reward FROM grid g JOIN cuts USING (candidate) JOIN {_ranking('served', 'candidate')} r USING (candidate) JOIN {_hard('served', 'candidate')} h USING (candidate)),
best AS (SELECT candidate, reward FROM rewards ORDER BY reward DESC, candidate LIMIT 1),
pick AS (SELECT CASE WHEN b.reward > p.reward + 0.002 THEN b.candidate ELSE 0 END AS chosen FROM best b, rewards p WHERE p.candidate = 0)
SELECT rewards.*, candidate = chosen AS is_chosen FROM rewards, pick"""

MODELS = f"""
models AS (UNPIVOT (SELECT idx, label, stack, mono, mlp, drse FROM scored) ON stack, mono, mlp, drse INTO NAME model VALUE score),
model_metrics AS (
  SELECT a.*, hard_fpr, hard_recall, positive_rate, greatest(0, 1 - hard_fpr) AS safety, {_REWARD} AS reward FROM {_ranking('models', 'model')} a JOIN {_hard('models', 'model')} b USING (model))"""

ORACLES = {
    "hand_features": f"WITH {HOURLY}, {STEPS}, {HAND_TABLE} SELECT group_id, hand_id, {_rounded(HAND_COLUMNS, 9)} FROM hand_table",
    "loaded_hands": f"""WITH {HOURLY}, {STEPS}, {HAND_TABLE}
SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY hand_id) - 1 AS hand_id, {_rounded(HAND_COLUMNS, 9)} FROM hand_table""",
    "actor_features": f"WITH {HOURLY}, {STEPS}, {ACTORS} SELECT group_id, hand_id, {_rounded(ACTOR_COLUMNS, 9)} FROM actor_table",
    "hand_statistics": f"WITH {HOURLY}, {STEPS}, {HAND_TABLE} SELECT group_id, {_statistics(STATS, HAND_COLUMNS, digits=9)} FROM hand_table GROUP BY 1",
    "group_consistency": f"WITH {HOURLY}, {STEPS}, {HAND_TABLE} SELECT group_id, {CONSISTENCY} FROM hand_table GROUP BY 1",
    "pooled_sizes": _pooled(HOURLY),
    "policy": _policy(HOURLY),
    "actor_statistics": f"WITH {HOURLY}, {STEPS}, {ACTORS} SELECT group_id, {_statistics(ACTOR_STATS, ACTOR_COLUMNS, 'hf_', 9)} FROM actor_table GROUP BY 1",
    "actor_group": ACTOR_GROUP,
    "group_vectors": f"""WITH h AS (WITH {SHORT}, {STEPS}, {HAND_TABLE} SELECT group_id, {_statistics(STATS, HAND_COLUMNS)} FROM hand_table GROUP BY 1),
c AS (WITH {SHORT}, {STEPS}, {HAND_TABLE} SELECT group_id, {CONSISTENCY} FROM hand_table GROUP BY 1), p AS ({_pooled(SHORT)}), o AS ({_policy(SHORT)}),
a AS (WITH {SHORT}, {STEPS}, {ACTORS} SELECT group_id, {_statistics(ACTOR_STATS, ACTOR_COLUMNS, 'hf_')} FROM actor_table GROUP BY 1), g AS ({ACTOR_GROUP}), r AS ({_redundancy()}),
groups AS (SELECT DISTINCT event_id // 200 AS group_id FROM events)
SELECT groups.group_id, coalesce(COLUMNS(* EXCLUDE (group_id, mean_roundness)), 0), coalesce(c.mean_roundness, 0) AS mean_roundness_of_hands, coalesce(h.mean_roundness, 0) AS mean_roundness
FROM groups LEFT JOIN h USING (group_id) LEFT JOIN c USING (group_id) LEFT JOIN p USING (group_id) LEFT JOIN o USING (group_id) LEFT JOIN a USING (group_id) LEFT JOIN g USING (group_id) LEFT JOIN r USING (group_id)""",
    "hand_tensor": f"""WITH {SHORT}, {STEPS}, {HAND_TABLE},
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY hand_id) AS place FROM hand_table) WHERE place <= 40),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ('n_actions', 'aggr_frac', 'stack_bb', 'total_pot_bb'))} FROM first WHERE n_actions <> 0 OR aggr_frac <> 0 OR stack_bb <> 0 OR total_pot_bb <> 0)
SELECT group_id, hand_id, place, {', '.join(f'CASE WHEN n_actions <> 0 OR aggr_frac <> 0 OR stack_bb <> 0 OR total_pot_bb <> 0 THEN round(({c} - m_{c}) / (s_{c} + 1e-6), 4) + 0 ELSE 0 END AS {c}' for c in ('n_actions', 'aggr_frac', 'stack_bb', 'total_pot_bb'))} FROM first, m""",
    "signatures": f"WITH {SHORT}, {SIGNED} SELECT * FROM signed",
    "signature_shares": f"WITH {SHORT}, {SIGNED} SELECT group_id, n_hands, {_rounded(['top_share', 'unique_share', 'repeat_mass', 'street_uniformity'])} FROM shares JOIN shapes USING (group_id)",
    "signature_scores": SIG_SCORES,
    "redundancy_measures": _redundancy(_CHOSEN, _FIRST),
    "scalar_codes": CODES,
    "calibration": f"""WITH {SCORED} SELECT idx, round({_LOGIT.format('stack')}, 6) + 0 AS logit, round({_SIGMOID.format(_LOGIT.format('stack'))}, 6) AS again,
  round({_CLAMP.format(_ANCHOR.format('mlp'))}, 6) AS anchored, round({_RECENTRE.format('drse', '0.4')}, 6) AS recentred, round(CASE WHEN idx % 7 = 0 THEN 0.5 ELSE mono END, 6) AS neutral FROM scored""",
    "action_mix_by_customer": f"""WITH {CUSTOMERS},
per AS (SELECT group_id, release, label, count(DISTINCT hand_id) AS n_hands, count(*) AS n_actions, avg(size) AS mean_size, stddev_pop(size) AS std_size, quantile_cont(size, 0.5) AS median_size,
  avg((action_type IN ('bet', 'raise'))::INT) AS aggr_frac FROM customer_steps GROUP BY 1, 2, 3)
SELECT group_id, release, label, n_hands, n_actions, {_rounded(['mean_size', 'std_size', 'median_size', 'aggr_frac'])}, round(a.entropy, 6) + 0 AS action_entropy, round(a.modal, 6) AS action_modal,
  round(s.entropy, 6) + 0 AS size_entropy, round(s.modal, 6) AS size_modal
FROM per JOIN {_concentration('customer_steps', 'group_id', 'action_type')} a USING (group_id) LEFT JOIN {_concentration('customer_steps', 'group_id', 'size')} s USING (group_id)""",
    "customer_bigrams": f"""WITH {CUSTOMERS},
seq AS (SELECT *, lead(action_type) OVER o AS after, (action_type <> lag(action_type) OVER o)::INT AS changed FROM customer_steps WINDOW o AS (PARTITION BY group_id, hand_id ORDER BY action_idx)),
runs AS (SELECT group_id, max(c) AS longest_run FROM (SELECT group_id, hand_id, run, count(*) AS c FROM (
  SELECT *, sum(coalesce(changed, 0)) OVER (PARTITION BY group_id, hand_id ORDER BY action_idx) AS run FROM seq) GROUP BY 1, 2, 3) GROUP BY 1),
pairs AS (SELECT group_id, action_type || '>' || after AS pair FROM seq WHERE after IS NOT NULL),
switches AS (SELECT group_id, avg(changed) AS switch_rate FROM seq GROUP BY 1)
SELECT group_id, round(switch_rate, 6) AS switch_rate, longest_run, round(g.entropy, 6) + 0 AS pair_entropy, round(g.modal, 6) AS pair_modal
FROM switches JOIN runs USING (group_id) LEFT JOIN {_concentration('pairs', 'group_id', 'pair')} g USING (group_id)""",
    "rank_positions": f"""WITH {SCORED}, r AS (SELECT idx, {', '.join(f'(row_number() OVER (PARTITION BY batch_id ORDER BY {p}, idx) - 1) / (count(*) OVER (PARTITION BY batch_id) - 1) AS r_{p}' for p in PARTS)} FROM scored)
SELECT idx, {_rounded([f'r_{p}' for p in PARTS])}, round((3 * r_stack + 2 * r_mono + r_mlp + 2 * r_drse) / 8, 6) AS blend FROM r""",
    "blended_scores": f"""WITH {SCORED} SELECT idx, round(({' + '.join(f'{w} * {p}' for p, w in _W.items())}) / 8, 6) AS vote,
  round({_SIGMOID.format('(' + ' + '.join(f'{w} * {_LOGIT.format(p)}' for p, w in _W.items()) + ') / 8')}, 6) AS log_odds FROM scored""",
    "served_scores": f"""WITH {SCORED}, centred AS (SELECT batch_id, idx, {_RECENTRE.format('score', '0.55')} AS score FROM scored), {_served('centred', 'batch_id', 'idx % 11 <> 0', 'batch_id, idx')}
SELECT batch_id, idx, round(score, 6) AS score FROM served""",
    "lifted_scores": f"""WITH {SCORED}, s AS (SELECT batch_id, idx, score * 0.45 AS score FROM scored),
o AS (SELECT *, count(*) FILTER (score >= 0.5) OVER (PARTITION BY batch_id) AS pos, max(score) OVER (PARTITION BY batch_id) - min(score) OVER (PARTITION BY batch_id) AS spread,
  row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, idx) - 1 AS place FROM s)
SELECT batch_id, idx, round(CASE WHEN pos < 2 AND spread >= 0.05 AND place < 2 AND score < 0.5 THEN 0.5 + 0.01 * (2 - place) / 2 ELSE score END, 6) AS score FROM o""",
    "ranking_metrics": f"WITH {SCORED} SELECT release, n_rows, n_pos, {_rounded(['auc', 'ap', 'recall_at_fpr'])} FROM {_ranking('scored', 'release', 'tied')}",
    "hard_metrics": f"WITH {SCORED} SELECT release, {_rounded(['hard_fpr', 'hard_recall', 'positive_rate'])} FROM {_hard('scored', 'release')}",
    "fpr_thresholds": f"""WITH {SCORED}, negatives AS (SELECT release, score, row_number() OVER (PARTITION BY release ORDER BY score) AS i, count(*) OVER (PARTITION BY release) AS n FROM scored WHERE label = 0),
by_order AS (SELECT release, score + 1e-9 AS t FROM negatives WHERE i = least(n, greatest(ceil(n * 0.95), 1))),
by_quantile AS (SELECT release, quantile_cont(score, 0.95) FILTER (label = 0) AS t FROM scored GROUP BY 1)
SELECT q.release, round(coalesce(o.t, 0.5), 12) AS by_order, round(coalesce(q.t, 0.5), 12) AS by_quantile FROM by_quantile q LEFT JOIN by_order o USING (release)""",
    "release_report": f"WITH {SCORED}, {REPORT} SELECT release, n_rows, n_pos, {_rounded(['auc', 'ap', 'recall_at_fpr', 'hard_fpr', 'hard_recall', 'positive_rate', 'reward'])} FROM report",
    "report_summary": f"""WITH {SCORED}, {REPORT} SELECT count(*) AS n_releases, round(avg(reward), 6) AS mean_reward, round(sum(reward * n_rows) / sum(n_rows), 6) AS weighted_reward,
  round(min(reward), 6) AS min_reward, round(max(reward), 6) AS max_reward, round(max(hard_fpr), 6) AS worst_fpr FROM report""",
    "score_correlation": f"WITH {SCORED} SELECT release, round(corr(stack, mono), 6) AS r_stack_mono, round(corr(mlp, drse), 6) AS r_mlp_drse FROM scored GROUP BY 1",
    "feature_shift": f"WITH {SCORED}, {LONG}, {SHIFT} SELECT feature, {_rounded(['mu_live', 'mu_bench', 'sd_bench', 'z'])}, z <= 5 AS kept FROM shift",
    "most_shifted": f"WITH {SCORED}, {LONG}, {SHIFT} SELECT feature, round(z, 6) AS z FROM shift ORDER BY shift.z DESC LIMIT 12",
    "rank_correlations": f"WITH {SCORED}, {LONG}, {RHOS} SELECT feature, release, round(rho, 6) + 0 AS rho FROM rhos",
    "steady_signs": f"""WITH {SCORED}, {LONG}, {RHOS}, m AS (SELECT *, avg(rho) OVER (PARTITION BY feature) AS mean_rho FROM rhos)
SELECT feature, round(any_value(mean_rho), 6) AS mean_rho, CASE WHEN count(*) >= 4 AND abs(any_value(mean_rho)) >= 0.04 AND avg((sign(rho) = sign(mean_rho))::INT) >= 0.7 THEN sign(any_value(mean_rho))::INT ELSE 0 END AS sign
FROM m GROUP BY 1""",
    "attention_pooling": f"""WITH {SHORT}, {STEPS}, {HAND_TABLE}, w AS (SELECT *, exp(aggr_frac - max(aggr_frac) OVER (PARTITION BY group_id)) AS e FROM hand_table)
SELECT group_id, round(sum(e * total_pot_bb) / sum(e), 6) AS att_total_pot_bb, round(sum(e * n_actions) / sum(e), 6) AS att_n_actions, round(avg(total_pot_bb), 6) AS avg_total_pot_bb, round(avg(n_actions), 6) AS avg_n_actions FROM w GROUP BY 1""",
    "set_profile": f"""WITH {CUSTOMERS}, g AS (SELECT group_id, release, label, count(DISTINCT hand_id) AS n_hands FROM customer_steps GROUP BY 1, 2, 3)
SELECT count(*) AS n_groups, sum(label)::BIGINT AS n_pos, count(DISTINCT release) AS n_releases, round(quantile_cont(n_hands, 0.1), 6) AS hands_p10, round(quantile_cont(n_hands, 0.5), 6) AS hands_p50, round(quantile_cont(n_hands, 0.9), 6) AS hands_p90 FROM g""",
    "eligible_releases": f"""WITH {SCORED}, per AS (SELECT release, count(*) AS n, sum(label)::BIGINT AS pos, min(idx) AS first_idx FROM scored GROUP BY 1),
past AS (SELECT *, coalesce(sum(n) OVER w, 0)::BIGINT AS n_train, coalesce(sum(pos) OVER w, 0) AS pos_train, row_number() OVER (ORDER BY release DESC) <= 3 AS is_newest FROM per WINDOW w AS (ORDER BY release ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT release, n AS n_rows, pos AS n_pos, CASE WHEN n_train >= 60 AND pos_train > 0 AND pos_train < n_train THEN n_train END AS n_train, first_idx, n AS size, is_newest FROM past WHERE n >= 20 AND pos > 0 AND pos < n""",
    "release_folds": f"""WITH {CUSTOMERS}, per AS (SELECT release, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, release) - 1 AS p FROM customer_steps GROUP BY 1)
SELECT release, n, (CASE WHEN (p // 3) % 2 = 0 THEN p % 3 ELSE 2 - p % 3 END)::INT AS fold FROM per""",
    "holdout_rows": f"WITH {SCORED} SELECT release, release = (SELECT max(release) FROM scored) AS is_holdout, count(*) AS n FROM scored GROUP BY 1, 2",
    "deduplicated": f"""WITH {SHORT}, {SIGNED} SELECT min(hand_id) AS hand_id, signature FROM signed WHERE group_id >= 2 AND signature NOT IN (SELECT signature FROM signed WHERE group_id < 2) GROUP BY signature""",
    "resampled_groups": f"WITH {RESAMPLED} SELECT * FROM drawn",
    "unioned_groups": f"WITH {RESAMPLED} SELECT release, label, size, count(*) AS n FROM (SELECT release, label, NULL AS size FROM customer_hands UNION ALL SELECT release, label, size FROM drawn) GROUP BY 1, 2, 3",
    "hand_dropout": f"""WITH {CUSTOMERS}, h AS (SELECT *, ('0x' || substr(md5('11:' || group_id || ':' || hand_id), 1, 8))::BIGINT / 4294967296 >= 0.25 AS stays FROM (SELECT DISTINCT group_id, hand_id FROM customer_steps))
SELECT group_id, hand_id FROM (SELECT *, sum(stays::INT) OVER (PARTITION BY group_id) AS remaining FROM h) WHERE stays OR remaining < 5""",
    "weight_rewards": WEIGHTS,
    "linear_sweep": f"""WITH {SCORED}, b AS (SELECT w, label, (1 - w) * stack + w * mlp AS score FROM scored, (SELECT unnest([0.2, 0.3, 0.4, 0.5])::DOUBLE AS w)) SELECT w, round(auc, 6) AS auc FROM {_ranking('b', 'w')}""",
    "promotion": f"""WITH {SCORED}, {MODELS}, base AS (SELECT reward AS b, hard_fpr AS f FROM model_metrics WHERE model = 'stack'),
c AS (SELECT model, reward, hard_fpr, model = 'drse' AS forced, concat_ws(',', CASE WHEN safety <= 0 THEN 'safety' END, CASE WHEN hard_fpr >= 0.06 THEN 'hard_fpr' END, CASE WHEN positive_rate < 0.02 THEN 'positive_rate' END,
  CASE WHEN hard_recall <= 0 THEN 'hard_recall' END) AS reasons, b - reward > 0.002 AND NOT (f - hard_fpr >= 0.01 AND b - reward <= 0.01) AS regression FROM model_metrics, base WHERE model <> 'stack')
SELECT model, round(reward, 6) AS reward, round(hard_fpr, 6) AS hard_fpr, reasons, regression, forced OR (reasons = '' AND NOT regression) AS accepted FROM c""",
    "newest_snapshots": "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10",
    "flattened_conversations": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS place FROM conversations)
SELECT conv_id, count(*) AS n_turns, sum(place * length(text))::BIGINT AS weighted_size, arg_max(role, place) AS last_role FROM t GROUP BY 1""",
    "sanitised_actions": f"""WITH {HOURLY},
s AS (SELECT *, min(action_idx) OVER (PARTITION BY group_id, hand_id, seat) AS f, row_number() OVER (PARTITION BY group_id, hand_id ORDER BY action_idx) - 1 AS a, count(*) OVER (PARTITION BY group_id, hand_id) AS n FROM actions),
l AS (SELECT *, dense_rank() OVER (PARTITION BY group_id, hand_id ORDER BY f) - 1 AS alias, least(5 + ('0x' || substr(md5('13:' || group_id || ':' || hand_id), 1, 8))::BIGINT % 4, n) AS len FROM s),
w AS (SELECT *, ('0x' || substr(md5('14:' || group_id || ':' || hand_id), 1, 8))::BIGINT % (n - len + 1) AS start FROM l)
SELECT group_id, hand_id, a - start AS place, alias AS seat, action_type, street,
  round(CASE WHEN norm_bb > 0 THEN {_nearest('norm_bb', VISIBLE_GRID)} * (1 + 0.05 * (2 * (('0x' || substr(md5('15:' || group_id || ':' || hand_id || ':' || action_idx), 1, 8))::BIGINT / 4294967296) - 1)) ELSE 0 END, 6) AS norm_bb
FROM w WHERE a >= start AND a < start + len""",
    "aligned_scores": f"""WITH {SHORT}, {STEPS}, {HAND_TABLE}, w AS (SELECT *, exp(aggr_frac - max(aggr_frac) OVER (PARTITION BY group_id)) AS e FROM hand_table)
SELECT group_id, round(avg(vpip), 6) AS vpip_mean, round(avg(won), 6) AS win_rate, round(sum(e * n_actions) / sum(e), 6) AS att_n_actions, round(avg(n_actions), 6) AS avg_n_actions FROM w GROUP BY 1""",
    "gate_figures": f"""WITH {SCORED}, models AS (UNPIVOT (SELECT idx, release::INT % 2 AS odd, label, stack, mono, mlp, drse FROM scored) ON stack, mono, mlp, drse INTO NAME model VALUE score),
h AS {_hard('models', 'model, odd')}
SELECT model, round(min(1 - hard_fpr), 6) AS safety, round(max(hard_fpr), 6) AS hard_fpr, round(min(hard_recall), 6) AS hard_recall, round(min(positive_rate), 6) AS positive_rate FROM h GROUP BY 1""",
    "rank_gradients": f"""WITH {SCORED}, per AS (SELECT release, tied AS s, count(*)::DOUBLE AS k, sum(label)::DOUBLE AS pos FROM scored GROUP BY 1, 2),
a AS (SELECT *, k - pos AS neg, coalesce(sum(k) OVER w, 0) AS k0, coalesce(sum(pos) OVER w, 0) AS m0 FROM per WINDOW w AS (PARTITION BY release ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, k0 + (k + 1) / 2 AS r FROM a),
c AS (SELECT *, coalesce(sum(pos / r) OVER w, 0) AS c0, sum(pos) OVER (PARTITION BY release) AS p FROM b WINDOW w AS (PARTITION BY release ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT i.release, i.s AS si, j.s AS sj, i.pos, j.neg, 1 / (1 + exp(i.s - j.s)) AS q, 1 / i.p * abs(CASE
    WHEN j.s > i.s THEN (j.m0 + j.pos / 2 + 1) / j.r - (i.m0 + (i.pos + 1) / 2) / i.r + (i.c0 + (i.pos - 1) / 2 / i.r) - (j.c0 + j.pos / 2 / j.r)
    WHEN j.s < i.s THEN (i.m0 + (i.pos + 1) / 2) / i.r - (j.m0 + j.pos / 2) / j.r + (j.c0 + j.pos / 2 / j.r) - (i.c0 + (i.pos + 1) / 2 / i.r)
    ELSE (i.m0 + i.pos / 3 + 1) / (i.k0 + (i.k + 1) / 3) - (i.m0 + 2 * i.pos / 3 + 1) / (i.k0 + 2 * (i.k + 1) / 3) + i.pos / 3 / i.r END) AS change
  FROM c i JOIN c j ON i.release = j.release WHERE i.pos > 0 AND j.neg > 0),
e AS (SELECT release, si AS score, 1 AS label, sum(neg * change * q) AS g, sum(neg * change * q * (1 - q)) AS h FROM d GROUP BY 1, 2
  UNION ALL SELECT release, sj, 0, -sum(pos * change * q), sum(pos * change * q * (1 - q)) FROM d GROUP BY 1, 2)
SELECT release, round(score, 6) AS score, label, {_rounded(['g', 'h'], 9)} FROM e""",
    "monotone_scores": f"WITH {SCORED} SELECT release, count(*) AS n_rows, 0 AS n_lowered FROM scored GROUP BY 1",
    "searched_rungs": """WITH d AS (SELECT ('0x' || substr(md5('3:' || vec_id), 1, 8))::BIGINT / 4294967296 AS x FROM embeddings)
SELECT rung, n_trials, n_promoted, (SELECT count(*) FROM d WHERE x < share) AS n_rows FROM (VALUES (0, 50, 17, 1.0::DOUBLE / 9), (1, 17, 6, 1.0::DOUBLE / 3), (2, 6, 0, 1.0::DOUBLE)) AS r(rung, n_trials, n_promoted, share)""",
    "streamed_counts": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "captured_stream": "SELECT DISTINCT user_id || '/' || event_type AS key FROM events",
    "asked_features": f"""WITH {SHORT}, {STEPS}, {HAND_TABLE}, a AS (SELECT group_id, avg((action_type IN ('bet', 'raise'))::INT) AS bet_share, count(DISTINCT hand_id)::DOUBLE AS hf_hand_count FROM actions GROUP BY 1)
SELECT a.group_id, round(coalesce(mean_aggr_frac, 0), 6) AS mean_aggr_frac, round(bet_share, 6) AS bet_share, hf_hand_count FROM a LEFT JOIN (SELECT group_id, avg(aggr_frac) AS mean_aggr_frac FROM hand_table GROUP BY 1) USING (group_id)""",
    "bootstrap_weights": """WITH c AS (SELECT k, sum(exp(-1) / factorial(k::INT)) OVER (ORDER BY k) AS below FROM range(12) AS r(k)),
d AS (SELECT o_orderkey, seed, ('0x' || substr(md5(seed || ':' || o_orderkey), 1, 8))::BIGINT / 4294967296 AS draw FROM orders, (SELECT unnest([1, 2, 3]) AS seed))
SELECT o_orderkey, count(*)::DOUBLE AS weight, seed FROM d JOIN c ON draw >= below GROUP BY o_orderkey, seed""",
    "bounded_pool": "SELECT user_id || '/' || event_type AS key, min(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 300",
    "streamed_scores": f"""WITH s AS (SELECT vec_id % 5 AS batch_id, vec_id AS idx, CASE WHEN vec_id % 13 <> 0 THEN round(1 / (1 + exp(-10 * embedding[1]::DOUBLE)), 9) ELSE 0.5 END AS score FROM embeddings),
r AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n, row_number() OVER (PARTITION BY batch_id ORDER BY score, idx) - 1 AS i FROM s)
SELECT batch_id, idx, round(CASE WHEN n < 4 THEN score ELSE {_CLAMP.format("0.5 - 0.875 * 0.56 + i / (n - 1) * 0.56")} END, 6) AS score FROM r""",
    "single_group_scores": "SELECT vec_id AS batch_id, round(CASE WHEN vec_id % 17 <> 0 THEN 1 / (1 + exp(-10 * embedding[2]::DOUBLE)) ELSE 0.5 END, 6) AS score FROM embeddings",
    "captured_drift": f"WITH {SCORED}, {LONG}, {SHIFT} SELECT feature, round(z, 6) AS z FROM shift ORDER BY shift.z DESC, feature LIMIT 12",
    "range_snapped": f"WITH e AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) / 1000 AS u FROM events) SELECT event_id, {_nearest('u', EXACT_GRID)}::DOUBLE AS point FROM e",
    "release_gate": """WITH g AS (SELECT DISTINCT event_id // 20 AS group_id FROM events)
SELECT 'parts' AS model, '2026-01-01' AS day, true AS accepted, count(*) FILTER (group_id % 4 = 3) AS n_walked, count(*) AS n_oof, true AS sound FROM g""",
    "promotion_history": f"""WITH {SCORED}, {MODELS}, base AS (SELECT reward AS b, hard_fpr AS f FROM model_metrics WHERE model = 'stack'),
c AS (SELECT model, model = 'drse' AS forced, concat_ws(',', CASE WHEN safety <= 0 THEN 'safety' END, CASE WHEN hard_fpr >= 0.06 THEN 'hard_fpr' END, CASE WHEN positive_rate < 0.02 THEN 'positive_rate' END,
  CASE WHEN hard_recall <= 0 THEN 'hard_recall' END) AS reasons, b - reward > 0.002 AND NOT (f - hard_fpr >= 0.01 AND b - reward <= 0.01) AS regression FROM model_metrics, base WHERE model <> 'stack')
SELECT day, model, reasons, forced OR (reasons = '' AND NOT regression) AS accepted FROM c, (SELECT unnest(['2026-01-01', '2026-01-02']) AS day)""",
    "live_groups": "SELECT vec_id AS idx, vec_id % 9 <> 0 AS is_live FROM embeddings WHERE vec_id % 8 <> 0",
    "best_candidate": f"WITH {SCORED}, {MODELS} SELECT model, round(auc, 6) AS auc, round(ap, 6) AS ap FROM model_metrics ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1",
    "kept_features": f"WITH {SCORED}, {LONG}, {SHIFT} SELECT feature FROM shift WHERE round(z, 6) <= 0.1",
}
