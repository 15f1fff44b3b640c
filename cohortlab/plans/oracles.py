"""The same results in SQL, written independently of the operators, for DuckDB."""

from __future__ import annotations

from cohortlab.spec import CUSTOMERS as SPEC

# What the queries are to use, stated here again, so that a change there shows.
INTERCEPT = 7.8
WEIGHTS = {
    "segment_BUILDING": -0.01, "segment_FURNITURE": 0.005, "segment_HOUSEHOLD": 0.02,
    "segment_MACHINERY": 0.015, "acctbal": 0.01, "n_orders": 0.28, "n_urgent": 0.02,
    "n_low": 0.015, "n_open": 0.01, "n_recent": 0.012, "tier": -0.02, "flag_urgent": 0.03,
    "flag_low": 0.02, "flag_recent": 0.04, "flag_open": 0.025,
}
IMPORTANCE = [
    ("n_orders", 0.41), ("n_open", 0.14), ("acctbal", 0.11), ("n_recent", 0.09), ("n_low", 0.07),
    ("n_urgent", 0.06), ("segment_HOUSEHOLD", 0.04), ("segment_MACHINERY", 0.03), ("tier", 0.02),
    ("segment_FURNITURE", 0.01), ("segment_BUILDING", 0.01), ("flag_open", 0.005),
    ("flag_recent", 0.005),
]
KEYS = ["segment", "tier", "region", "last_priority"]
REPLY_PREFIXES = ["[AI", "[API", "Th"]
EXPLAIN_SYSTEM = "Each line is a figure of one profile. Put them into plain words for that person."
ADVICE_SYSTEM = "Each option is one change to a profile and what it adds to the score."
PAIR_SYSTEM = "Two profiles and their scores, a figure on each line."
CHAT_SYSTEM = "Figures of the whole cohort stand below the question. Use them where they help."

COHORT = """
facts as (
  select o_custkey,
    cast(count(*) as bigint) as n_orders,
    cast(sum(case when o_orderpriority = '1-URGENT' then 1 end) as bigint) as n_urgent,
    cast(sum(case when o_orderpriority = '5-LOW' then 1 end) as bigint) as n_low,
    cast(sum(case when o_orderstatus = 'O' then 1 end) as bigint) as n_open,
    cast(sum(case when o_orderdate >= timestamp '1999-01-01' then 1 end) as bigint) as n_recent,
    cast(sum(case when o_orderstatus = 'F' then 1 end) as bigint) as n_finished,
    cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents,
    arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as last_priority
  from orders group by o_custkey),
raw as (
  select c_custkey as profile_id, c_mktsegment as segment,
    cast(case when c_acctbal >= 6000 then 1 when c_acctbal >= 2000 then 2 else 3 end as integer) as tier,
    c_acctbal as acctbal, n_orders, n_urgent, n_low, n_open, n_recent, n_finished, cents,
    c_nationkey, last_priority
  from customer left join facts on c_custkey = o_custkey),
cohort as (
  select profile_id, segment, tier, acctbal,
    coalesce(n_orders, 0) as n_orders, coalesce(n_urgent, 0) as n_urgent, coalesce(n_low, 0) as n_low,
    coalesce(n_open, 0) as n_open, coalesce(n_recent, 0) as n_recent,
    cast(coalesce(n_urgent, 0) >= 3 as integer) as flag_urgent,
    cast(coalesce(n_low, 0) >= 3 as integer) as flag_low,
    cast(coalesce(n_recent, 0) >= 3 as integer) as flag_recent,
    cast(coalesce(n_open, 0) >= 4 as integer) as flag_open,
    cast(coalesce(n_finished, 0) >= 3 as integer) as converted,
    cast(coalesce(cents, 0) as double) / cast(100000 as double) as target,
    r_name as region, last_priority
  from raw left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey)"""

FITTED = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ENCODED = [f"segment_{c}" for c in FITTED[1:]] + list(SPEC.scalars)


def r(value: str, digits: int) -> str:
    """Ties of the scaled value to even."""
    return f"(round_even(({value}) * 1e{digits}, 0) / 1e{digits})"


def encoded(name: str) -> str:
    if name.startswith("segment_"):
        return f"cast(segment = '{name.removeprefix('segment_')}' as integer)::double"
    return f"{name}::double"


STATS = "stats as (select " + ", ".join(
    f"avg({encoded(c)}) as m_{c}, stddev_pop({encoded(c)}) as d_{c}" for c in ENCODED
) + " from cohort where converted = 1)"
Z = {c: f"(({encoded(c)}) - m_{c}) / d_{c}" for c in ENCODED}
LOG = f"{INTERCEPT} + " + " + ".join(f"({WEIGHTS[c]}) * ({Z[c]})" for c in ENCODED)
SCORED = (
    f"logs as (select cohort.*, stats.*, {LOG} as predicted_log from cohort, stats), "
    f"scored as (select *, {r('exp(predicted_log) - 1', 2)} as predicted_value from logs)"
)
BASE = f"with {COHORT}"
FIT = f"{BASE}, {STATS}"
SCORE = f"{FIT}, {SCORED}"
TRAIN = "cast('0x' || substr(md5('42:' || profile_id), 1, 8) as bigint) % 100 < 80"
ALL_Z = ", ".join(f"{r(z, 6)} as z_{c}" for c, z in Z.items())


def means(alias: str = "") -> str:
    return ", ".join(
        f"{r(f'{f}(target) filter (where converted = 1)', 2)} as {n}_target"
        for f, n in (("avg", "avg"), ("median", "median"), ("min", "min"), ("max", "max"), ("stddev_samp", "std"))
    )


SEGMENTS = f"""{BASE}, listed(segment, ord) as (values {", ".join(f"('{s}', {i})" for i, s in enumerate(SPEC.segments))}),
report as (
  select listed.segment, count(profile_id) as total, count(profile_id) filter (where converted = 1) as converted_count,
    {r("100.0::double * count(profile_id) filter (where converted = 1) / greatest(count(profile_id), 1)", 1)} as rate,
    {r("avg(target) filter (where converted = 1)", 2)} as avg_target,
    {r("median(target) filter (where converted = 1)", 2)} as median_target,
    {r("max(target) filter (where converted = 1)", 2)} as max_target
  from listed left join cohort on listed.segment = cohort.segment group by listed.segment)"""

FACTORS = "factors as (" + " union all ".join(
    f"select profile_id, {i} as o, '{c}' as feature, {Z[c]} as z, {r(f'abs({Z[c]}) * {dict(IMPORTANCE)[c]}', 6)} as score from scored"
    for i, c in enumerate(ENCODED) if c in dict(IMPORTANCE)
) + """), ranked as (
  select *, row_number() over (partition by profile_id order by score desc, o) as rank from factors),
top3 as (select * from ranked where rank <= 3)"""


RANGES = {
    "acctbal": (0, 9000), "n_orders": (3, 20), "n_urgent": (0, 5), "n_low": (0, 5), "n_open": (0, 8),
    "n_recent": (0, 9), "tier": (1, 3), "flag_urgent": (0, 1), "flag_low": (0, 1), "flag_recent": (0, 1),
    "flag_open": (0, 1),
}
# Name, feature, condition and new value of each change.
_UP = [
    (f"{c}_up", c, "true", f"{c}::double + greatest(0.5::double, {c}::double * 0.1::double)")
    for c in ("acctbal", "n_orders", "n_urgent", "n_low", "n_open", "n_recent")
]
_ON = [(f"{c}_on", c, f"{c} = 0", "1.0::double") for c in ("flag_urgent", "flag_low", "flag_recent", "flag_open")]
LEVERS = [
    *_UP, *_ON, ("tier_better", "tier", "tier > 1", "tier::double - 1"),
    ("n_urgent_plus_one", "n_urgent", "n_urgent < 5", "n_urgent::double + 1"),
    ("n_low_plus_one", "n_low", "n_low < 10", "n_low::double + 1"),
]


def _lever(order: int) -> str:
    name, c, where, new = LEVERS[order]
    x = f"{c}::double"
    moved = f"predicted_log + ({WEIGHTS[c]}) * ({new} - {x}) / d_{c}"
    return (
        f"select profile_id, predicted_value, '{name}' as lever, {order} as o, '{c}' as feature, "
        f"{x} as cur, {new} as new, {r(f'exp({moved}) - 1', 2)} - predicted_value as diff "
        f"from scored where {where}"
    )


GAINS = "tries as (" + " union all ".join(_lever(i) for i in range(len(LEVERS))) + f"""), gains as (
  select profile_id, lever, feature, {r("cur", 2)} as current_value, {r("new", 2)} as improved_value,
    {r("diff", 2)} as gain, o from tries where diff > 0.01::double),
ordered as (
  select *, row_number() over (partition by profile_id order by gain desc, o) as rank from gains)"""

PAIRS = f"""pairs as (
  select a_key as a, b_key as b, a.predicted_value as value_a, b.predicted_value as value_b,
    a.segment as segment_a, b.segment as segment_b, a.acctbal as acctbal_a, b.acctbal as acctbal_b,
    {r("a.predicted_value - b.predicted_value", 2)} as gap,
    {r("abs(a.predicted_value - b.predicted_value)", 2)} as abs_gap,
    case when a.predicted_value > b.predicted_value then 'a'
         when a.predicted_value < b.predicted_value then 'b'
         when a.predicted_value = b.predicted_value then 'tie' end as winner,
    case when b.profile_id is null then 'no b' else 'ok' end as status
  from (select c_custkey as a_key, c_custkey + 1 as b_key from customer) keys
  left join scored a on a.profile_id = a_key left join scored b on b.profile_id = b_key)"""


def money(column: str) -> str:
    return f"printf('%.2f', {r(column, 2)})"


def lit(value: str) -> str:
    parts = value.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"


LABEL = {
    "acctbal": "Account balance", "n_orders": "Orders", "n_urgent": "Urgent orders", "n_low": "Low-priority orders",
    "n_open": "Open orders", "n_recent": "Recent orders", "segment": "Market segment", "tier": "Balance tier",
    "flag_urgent": "Often urgent", "flag_low": "Often low priority", "flag_recent": "Recently active",
    "flag_open": "Many open orders",
}
LINES = " || chr(10) || ".join(
    f"'{name} = ' || " + (money(c) if c == "acctbal" else f"{c}::varchar") for c, name in LABEL.items()
)
CONTEXT = f"""context as (
  select chr(10) || chr(10) || 'rows = ' || count(*) || chr(10) || 'converted = '
    || printf('%.1f', {r("100.0::double * sum(converted) / count(*)", 1)}) || ' in 100' || chr(10) || 'lowest = '
    || {money("min(target) filter (where converted = 1)")} || ' K' || chr(10) || 'mean = '
    || {money("avg(target) filter (where converted = 1)")} || ' K' || chr(10) || 'highest = '
    || {money("max(target) filter (where converted = 1)")} || ' K' as sentence from cohort)"""
CHAT = f"""{BASE}, {CONTEXT}
select conv_id, turn, {lit(CHAT_SYSTEM)} as system_text, text || sentence as user_text
from conversations, context where role = 'user'"""
FEATURES = ", ".join(SPEC.features)
LABELS = "case " + " ".join(f"when feature = '{f}' then '{v}'" for f, v in LABEL.items()) + " else feature end"

_TRIMMED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

SQL: dict[str, str] = {
    "scan_profiles": f"{BASE} select profile_id, {FEATURES} from cohort",
    "converted_only": f"{BASE} select * from cohort where converted = 1",
    "feature_projection": f"{BASE} select {FEATURES} from cohort",
    "clean_category": """
        select c_custkey as profile_id, c_mktsegment as segment,
          case when c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'FURNITURE') then c_mktsegment else 'BUILDING' end as segment_for_fit,
          case when c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'FURNITURE') then c_mktsegment else 'AUTOMOBILE' end as segment_for_score
        from customer""",
    "outcome_mask": f"{FIT} select profile_id, target, converted = 1 as is_converted, {ALL_Z} from cohort, stats",
    "label_features": f"{FIT}, long as ("
    + " union all ".join(f"select '{c}' as feature, m_{c} as m, d_{c} as d from stats" for c in ENCODED)
    + f") select {LABELS} as feature_name, feature as feature_key, {r('m', 6)} as mean, {r('d', 6)} as deviation from long",
    "value_bands": f"""{SCORE} select profile_id, predicted_value,
        case when predicted_value >= 4000 then 'top' when predicted_value >= 2500 then 'solid'
             when predicted_value >= 1500 then 'modest' else 'base' end as band,
        predicted_value * 1000::double as value_in_units from scored""",
    "range_violations": f"{BASE} "
    + " union all ".join(
        f"select profile_id, '{c}' as rule, {c}::double as value, {low}::double as low, {high}::double as high "
        f"from cohort where {c} < {low} or {c} > {high}"
        for c, (low, high) in RANGES.items()
    ),
    "default_fill": f"""{BASE} select profile_id, segment, tier, acctbal, coalesce(n_orders, 0) as n_orders,
        coalesce(n_urgent, 0) as n_urgent, coalesce(n_low, 0) as n_low, coalesce(n_open, 0) as n_open,
        coalesce(n_recent, 0) as n_recent,
        cast((n_orders is null)::integer + (n_urgent is null)::integer + (n_low is null)::integer
          + (n_open is null)::integer + (n_recent is null)::integer as integer) as n_filled from raw""",
    "reply_status": "select conv_id, turn, case when "
    + " or ".join(f"starts_with({_TRIMMED}, '{p}')" for p in REPLY_PREFIXES)
    + f" then 'failed' else 'ok' end as status, case when status = 'failed' then left({_TRIMMED}, 100) else {_TRIMMED} end as reply "
    + "from conversations where role = 'assistant'",
    "overview": f"""{BASE} select count(*) as total, count(*) filter (where converted = 1) as converted_count,
        {r("100.0::double * sum(converted) / count(*)", 1)} as rate, {means()} from cohort""",
    "group_means": f"{BASE} "
    + " union all ".join(
        f"select '{k}' as key, {k}::varchar as value, {r('avg(target)', 2)} as avg_target "
        f"from cohort where converted = 1 and {k} is not null group by {k}"
        for k in KEYS
    ),
    "segment_comparison": f"{SEGMENTS} select * from report",
    "tier_comparison": f"""{BASE}, listed(tier) as (values (1), (2), (3))
        select listed.tier as tier, {r("avg(target)", 2)} as avg_target, {r("median(target)", 2)} as median_target,
          count(profile_id) as count
        from listed left join (select * from cohort where converted = 1) c on c.tier = listed.tier group by listed.tier""",
    "flag_premium": f"{BASE} "
    + " union all ".join(
        f"""select '{c}' as flag, {r(f"avg(target) filter (where {c} = 1)", 2)} as with_avg,
          {r(f"avg(target) filter (where {c} = 0)", 2)} as without_avg,
          {r(f"avg(target) filter (where {c} = 1) - avg(target) filter (where {c} = 0)", 2)} as premium,
          count(*) filter (where {c} = 1) as with_count, count(*) filter (where {c} = 0) as without_count
        from cohort where converted = 1"""
        for c in SPEC.binary
    ),
    "mark_best": f"{SEGMENTS} select *, "
    + ", ".join(
        f"coalesce({c} = (select max({c}) from report), false) as {c}_best"
        for c in ("total", "converted_count", "rate", "avg_target", "median_target", "max_target")
    )
    + " from report",
    "category_domain": f"{BASE} select segment as category, count(*) as n from cohort where converted = 1 group by segment",
    "one_hot": f"{BASE} select profile_id, " + ", ".join(f"{encoded(c)} as {c}" for c in ENCODED) + " from cohort",
    "standardize": f"{FIT} select profile_id, {ALL_Z} from cohort, stats",
    "training_set": f"""{FIT} select profile_id, {r("ln(1 + target)", 6)} as label, {ALL_Z},
        case when {TRAIN} then 'train' else 'test' end as part from cohort, stats where converted = 1""",
    "split_counts": f"""{BASE} select case when {TRAIN} then 'train' else 'test' end as part, count(*) as n
        from cohort where converted = 1 group by 1""",
    "regression_metrics": f"""{BASE},
        parts as (select segment, ln(1 + target) as a, {TRAIN} as in_train from cohort where converted = 1),
        fit as (select segment, avg(a) as m from parts where in_train group by segment),
        pairs as (select exp(a) - 1 as y, exp(coalesce(m, (select avg(a) from parts where in_train))) - 1 as p
          from parts left join fit using (segment) where not in_train)
        select {r("1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))", 4)} as r2, {r("avg(abs(y - p))", 2)} as mae,
          {r("sqrt(avg((y - p) * (y - p)))", 2)} as rmse, {r("100 * avg(abs((y - p) / (y + 1e-8)))", 2)} as mape,
          {r("avg(y)", 2)} as mean_actual, {r("avg(p)", 2)} as mean_predicted, count(*) as n from pairs""",
    "batch_scores": f"{SCORE} select profile_id, segment as segment_clean, {r('predicted_log', 4)} as predicted_log, predicted_value from scored",
    "top_factors": f"{SCORE}, {FACTORS} select profile_id, cast(rank as integer) as rank, feature, {r('z', 6)} as value, score from top3",
    "whatif_gains": f"""{SCORE}, {GAINS} select profile_id, lever, feature, current_value, improved_value, gain,
        cast(rank as integer) as rank from ordered""",
    "pair_comparison": f"{SCORE}, {PAIRS} select a, b, value_a, value_b, gap, abs_gap, winner, status from pairs",
    "explain_text": f"""{SCORE}, {FACTORS}, lines as (
          select profile_id, string_agg('driver ' || rank || ' = ' || feature || ' at ' || printf('%.3f', {r("z", 3)})
            || ', strength ' || printf('%.4f', {r("score", 4)}), chr(10) order by rank) as factor_lines
          from top3 group by profile_id)
        select profile_id, {lit(EXPLAIN_SYSTEM)} as system_text,
          'score = ' || {money("predicted_value")} || ' K' || chr(10) || 'in single units = '
          || format('{{:,}}', cast(round_even(predicted_value * 1000, 0) as bigint)) || chr(10) || factor_lines
          || chr(10) || {LINES} || chr(10)
          || 'wanted = two sentences on the drivers, one on the rest' as user_text
        from scored join lines using (profile_id)""",
    "advice_text": f"""{SCORE}, {GAINS}, lines as (
          select profile_id, string_agg('option ' || rank || ' = ' || {LABELS} || ' ' || {money("current_value")} || ' -> '
            || {money("improved_value")} || ' adds ' || {money("gain")}, chr(10) order by rank) as gain_lines
          from ordered where rank <= 8 group by profile_id)
        select profile_id, {lit(ADVICE_SYSTEM)} as system_text,
          coalesce(gain_lines, 'option = none') || chr(10) || 'score now = ' || {money("predicted_value")} || ' K'
          || chr(10) || {LINES} || chr(10)
          || 'wanted = the option with the best return, and what stands against it' as user_text
        from scored left join lines using (profile_id)""",
    "pair_text": f"""{SCORE}, {PAIRS} select a, b, {lit(PAIR_SYSTEM)} as system_text,
          'distance = ' || coalesce({money("abs_gap")}, 'unknown') || ' K' || chr(10)
          || 'score a = ' || {money("value_a")} || ' K' || chr(10) || 'Market segment a = ' || segment_a || chr(10)
          || 'Account balance a = ' || {money("acctbal_a")} || chr(10)
          || 'score b = ' || coalesce({money("value_b")}, 'unknown') || ' K' || chr(10)
          || 'Market segment b = ' || coalesce(segment_b, 'unknown') || chr(10)
          || 'Account balance b = ' || coalesce({money("acctbal_b")}, 'unknown') || chr(10)
          || 'wanted = whether the figures above account for the distance' as user_text
        from pairs""",
    "chat_context": CHAT,
    "chat_replay": "select conv_id, turn, role, text from conversations order by conv_id, turn",
    "stream_scores": f"{SCORE} select profile_id, {r('predicted_log', 4)} as predicted_log, predicted_value from scored",
    "stream_chat_context": CHAT,
}


# Boosting with one split per tree. What goes left, in feature order; ties of the gain go to the first.
SPLITS = [
    *((f"segment_{c}", f"segment <> '{c}'") for c in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
    ("tier", "tier <= 1"), ("tier", "tier <= 2"),
    *((c, f"{c} = 0") for c in ("flag_urgent", "flag_low", "flag_recent", "flag_open")),
]
STUMP_STEP = 0.25
LEFT = "case o " + " ".join(f"when {i} then {left}" for i, (_, left) in enumerate(SPLITS)) + " end"


def boosted(name: str, rows: str, rounds: int) -> str:
    """The split of each round, as tables ``<name>_0``, ``<name>_1`` and so on with the values of both sides."""
    parts, values = [], "0.0::double"
    for m in range(rounds):
        residual = "y" if m == 0 else f"2 * (y - ({values}))"
        before = "".join(f", {name}_{i}" for i in range(m))
        sums = " union all ".join(
            f"select {i} as o, '{f}' as feature, count(*) filter (where {left}) as n, sum(r) filter (where {left}) as s, "
            f"count(*) as tn, sum(r) as ts from {name}_r{m}" for i, (f, left) in enumerate(SPLITS)
        )
        parts.append(f"""{name}_r{m} as (select {rows}.*, {residual} as r from {rows}{before}), {name}_{m} as (
          select o as o{m}, feature as feature{m}, s / n as left{m}, (ts - s) / (tn - n) as right{m},
            s * s / n + (ts - s) * (ts - s) / (tn - n) - ts * ts / tn as gain{m}
          from ({sums}) where n > 0 and n < tn order by gain{m} desc, o limit 1)""")
        values += f" + {predicted(m)}"
    return ", ".join(parts)


def predicted(m: int) -> str:
    step = 1.0 if m == 0 else STUMP_STEP
    return f"{step}::double * case when {LEFT.replace('case o ', f'case o{m} ')} then left{m} else right{m} end"


def total(rounds: int) -> str:
    return " + ".join(predicted(m) for m in range(rounds))


PARTS = f"parts as (select *, ln(1 + target) as y, {TRAIN} as in_train from cohort where converted = 1)"
STUMPED = f"{BASE}, {PARTS}, learning as (select * from parts where in_train), {boosted('t', 'learning', 3)}"
SQL["stump_scores"] = f"""{STUMPED} select profile_id, {r(total(3), 6)} as predicted_log,
    {r(f"exp({total(3)}) - 1", 2)} as predicted_value from cohort, t_0, t_1, t_2"""
SQL["stump_importance"] = f"""{STUMPED}, removed as (
    select feature0 as feature, gain0 as x from t_0
    union all select feature1, gain1 * {STUMP_STEP * (1 - STUMP_STEP)}::double from t_1
    union all select feature2, gain2 * {STUMP_STEP * (1 - STUMP_STEP)}::double from t_2),
  listed(feature, ord) as (values {", ".join(f"('{c}', {i})" for i, c in enumerate(dict(SPLITS)))}),
  shares as (
    select feature, ord, coalesce(sum(x), 0) / (select sum(x) from removed) as x
    from listed left join removed using (feature) group by feature, ord)
  select cast(row_number() over (order by round(x, 6) desc, ord) as integer) as rank, feature, round(x, 6) as importance from shares"""
SQL["stump_metrics"] = f"""{STUMPED}, pairs as (
    select target as y, exp({total(3)}) - 1 as p from (select * exclude (y), y as a from parts), t_0, t_1, t_2 where not in_train)
  select {r("1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))", 4)} as r2, {r("avg(abs(y - p))", 2)} as mae,
    {r("sqrt(avg((y - p) * (y - p)))", 2)} as rmse, {r("100 * avg(abs((y - p) / (y + 1e-8)))", 2)} as mape,
    {r("avg(y)", 2)} as mean_actual, {r("avg(p)", 2)} as mean_predicted, count(*) as n from pairs"""
FOLD = "cast('0x' || substr(md5('43:' || profile_id), 1, 8) as bigint) % 2"
SQL["stump_grid"] = f"""{BASE}, {PARTS},
  zero as (select * from parts where in_train and {FOLD} <> 0), one as (select * from parts where in_train and {FOLD} <> 1),
  {boosted("a", "zero", 3)}, {boosted("b", "one", 3)}, errors as (
    select avg(abs(y - ({total(1)}))) as e1, avg(abs(y - ({total(3)}))) as e3
    from parts, a_0, a_1, a_2 where in_train and {FOLD} = 0
    union all select avg(abs(y - ({total(1)}))), avg(abs(y - ({total(3)})))
    from parts, b_0, b_1, b_2 where in_train and {FOLD} = 1),
  means as (select avg(e1) as e1, avg(e3) as e3 from errors), points as (
    select 1.0::double as "maxIter", e1 as e, e1 <= e3 as is_best from means union all select 3.0::double, e3, e3 <= e1 from means)
  select "maxIter", 1.0::double as "maxDepth", {STUMP_STEP}::double as "stepSize", {r("e", 4)} as mae_log, is_best from points"""


def unpivoted(report: str, item: str, source: str, columns: tuple[str, ...]) -> str:
    return " union all ".join(
        f"select '{report}' as report, {item} as item, '{c}' as measure, {c}::double as value from ({source})" for c in columns
    )


_SPREAD = ("avg_target", "median_target", "min_target", "max_target", "std_target")
SQL["all_comparisons"] = f"""{SEGMENTS}, whole as ({SQL["overview"].removeprefix(BASE)}),
  tiers as (
    select t.tier, {r("avg(target)", 2)} as avg_target, {r("median(target)", 2)} as median_target, count(profile_id) as count
    from (values (1), (2), (3)) t(tier) left join (select * from cohort where converted = 1) c on c.tier = t.tier group by t.tier),
  flags as ({SQL["flag_premium"].removeprefix(BASE)})
  {unpivoted("overview", "''", "from whole", ("total", "converted_count", "rate", *_SPREAD))}
  union all {unpivoted("segment", "segment", "from report", ("total", "converted_count", "rate", "avg_target", "median_target", "max_target"))}
  union all {unpivoted("tier", "tier::varchar", "from tiers", ("avg_target", "median_target", "count"))}
  union all {unpivoted("flag", "flag", "from flags", ("with_avg", "without_avg", "premium", "with_count", "without_count"))}"""

SQL["csv_round_trip"] = f"""{BASE} select * replace ('a "' || region || '",' || chr(10) || ' of it' as region) from cohort"""
SQL["csv_bad_records"] = """select case when c_custkey % 7 = 0 then 'wrong length' when c_custkey % 11 = 0 then 'tier is not a number'
  else 'good' end as reason, count(*) as n from customer group by 1"""
_LISTS = {
    "features": ENCODED, "categories": FITTED, "reference": FITTED[:1], "binary": ("flag_urgent", "flag_low", "flag_recent", "flag_open"),
    "numeric": ("acctbal", "n_orders", "n_urgent", "n_low", "n_open", "n_recent"), "ordinal": ("tier",),
}
SQL["metadata_document"] = f"{FIT}, names(part, position, name) as (values " + ", ".join(
    f"('{part}', {i}::bigint, '{name}')" for part, names in _LISTS.items() for i, name in enumerate(names)
) + ") select *, null::double as mean, null::double as deviation from names union all " + " union all ".join(
    f"select 'scaler', null, '{c}', {r(f'm_{c}', 6)}, {r(f'd_{c}', 6)} from stats" for c in ENCODED
)
SQL["append_once"] = "select conv_id, turn, role, text from conversations"
SQL["stream_overview"] = f"select * exclude (median_target) from ({SQL['overview']})"
SQL["stream_moving_context"] = f"""{BASE}, {CONTEXT}, half as ({CONTEXT.removeprefix("context as (").removesuffix(")")} where profile_id % 2 = 0)
select conv_id, turn, {lit(CHAT_SYSTEM)} as system_text,
  text || case when conv_id % 2 = 0 then half.sentence else context.sentence end as user_text
from conversations, context, half where role = 'user'"""
