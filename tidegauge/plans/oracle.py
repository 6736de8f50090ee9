"""DuckDB SQL of the registered queries: one chain of common table expressions over the event table."""

from __future__ import annotations

from tidegauge.operators.reports import TABLES
from tidegauge.schema import FEATURES, HEADROOMS, LAGS, MEAN_WINDOWS, PERCENTILES, STD_WINDOWS
from tidegauge.sources.adapter import TRIGGERS

W = "OVER (PARTITION BY trig ORDER BY hour_index"


def r(x: str, name: str) -> str:
    return f"round({x} + 1e-9, 6) AS {name}"


def prior(f: str, n: int, name: str) -> str:
    frame = f"{W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(y) {frame} = {n} THEN {f}(y) {frame} END AS {name}"


SHARES = ", ".join(
    f"CASE WHEN sum(invocations) > 0 THEN sum(CASE WHEN trig = '{t}' THEN invocations ELSE 0 END) / CAST(sum(invocations) AS DOUBLE) END AS share_{t}"
    for t in TRIGGERS
)
METRICS = "avg(abs(p - a)) AS mae, sqrt(avg((p - a) * (p - a))) AS rmse, CASE WHEN sum(abs(a)) > 0 THEN sum(abs(p - a)) / sum(abs(a)) END AS wape"

#: name: (needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        "SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS td, CAST(extract(hour FROM ts) AS INTEGER) AS hod, "
        "user_id % 10 AS o, user_id AS app, event_type AS trig, event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events",
    ),
    "fh": (("ev",), "SELECT td, o, app, trig, (td - 1) * 24 + hod AS hour_index, count(*) AS calls FROM ev GROUP BY ALL"),
    "du": (("ev",), "SELECT td, o, app, trig, event_id % 2 AS part, avg(value) AS a, count(*) AS c FROM ev WHERE app % 7 <> 0 GROUP BY ALL"),
    "dc": (("du",), "SELECT td, o, app, trig, sum(a * c) / sum(c) AS ms FROM du WHERE a >= 0 GROUP BY ALL"),
    "me": (("ev",), "SELECT td, o, app, 1 + event_id % 5 AS c, k FROM ev WHERE td <= 24"),
    "ob": (
        ("fh", "dc"),
        "SELECT hour_index, trig, sum(calls) AS n, sum(calls * ms / 1000.0) AS s, sum(CASE WHEN ms IS NOT NULL THEN calls END) AS m, "
        "count(*) FILTER (WHERE calls > 0) AS act FROM fh LEFT JOIN dc USING (td, o, app, trig) GROUP BY hour_index, trig",
    ),
    "grid": (
        (),
        f"SELECT CAST(h AS INTEGER) AS hour_index, trig FROM unnest(range(0, 720)) AS a(h), (VALUES {', '.join(f'({t!r})' for t in TRIGGERS)}) AS b(trig)",
    ),
    "de": (
        ("grid", "ob"),
        "SELECT CAST(hour_index // 24 + 1 AS INTEGER) AS trace_day, CAST(hour_index % 24 AS INTEGER) AS hour_of_day, hour_index, trig, "
        "CAST(coalesce(n, 0) AS BIGINT) AS invocations, coalesce(s, 0.0) AS y, CAST(coalesce(act, 0) AS BIGINT) AS act, "
        "CASE WHEN m > 0 THEN coalesce(s, 0.0) * 1000.0 / m END AS wavg FROM grid LEFT JOIN ob USING (hour_index, trig)",
    ),
    "lg": (("de",), f"SELECT *, {', '.join(f'lag(y, {k}) {W}) AS lag_{k}' for k in LAGS)} FROM de"),
    "ro": (
        ("lg",),
        "SELECT *, "
        + ", ".join(
            [prior("avg", n, f"rolling_mean_{n}") for n in MEAN_WINDOWS]
            + [prior("stddev_samp", n, f"rolling_std_{n}") for n in STD_WINDOWS]
            + [prior("max", 24, "rolling_max_24"), prior("min", 24, "rolling_min_24")]
        )
        + f", quantile_cont(y, 0.95) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_p95, "
        "sum(lag_24) OVER (PARTITION BY hour_index) AS all_24 FROM lg",
    ),
    "fe": (
        ("ro",),
        "SELECT *, CASE WHEN prior_p95 > 0 THEN lag_1 / prior_p95 END AS historical_load_ratio, CASE WHEN all_24 > 0 THEN lag_24 / all_24 END AS lag24_trigger_share, "
        "sin(2.0 * pi() * hour_of_day / 24.0) AS hour_sin, cos(2.0 * pi() * hour_of_day / 24.0) AS hour_cos, trace_day - 1 AS trace_day_index, "
        "CASE WHEN hour_index >= 648 THEN 'test' WHEN hour_index >= 600 THEN 'validation' WHEN hour_index >= 72 THEN 'train' END AS split FROM ro",
    ),
    "hm": (("de",), "SELECT trig, hour_of_day, avg(y) AS mean FROM de WHERE hour_index BETWEEN 72 AND 599 GROUP BY ALL"),
    "pr": (
        ("de", "hm"),
        "SELECT 'validation' AS split, 'Seasonal Naive' AS model, a.hour_index, a.hour_of_day, a.trig, a.y AS a, b.y AS p FROM de a JOIN de b "
        "ON a.trig = b.trig AND b.hour_index = a.hour_index - 24 * ((a.hour_index - 600) // 24 + 1) WHERE a.hour_index BETWEEN 600 AND 647 "
        "UNION ALL SELECT 'test', 'Seasonal Naive', a.hour_index, a.hour_of_day, a.trig, a.y, b.y FROM de a JOIN de b "
        "ON a.trig = b.trig AND b.hour_index = a.hour_index - 24 WHERE a.hour_index >= 648 "
        "UNION ALL SELECT CASE WHEN hour_index >= 648 THEN 'test' ELSE 'validation' END, 'Historical Hour-of-Day Mean', hour_index, hour_of_day, trig, y, mean "
        "FROM de JOIN hm USING (trig, hour_of_day) WHERE hour_index >= 600",
    ),
    "mt": (
        ("pr",),
        f"SELECT split, model, 'trigger' AS lvl, trig, {METRICS} FROM pr GROUP BY ALL UNION ALL SELECT split, model, 'total_demand', 'ALL_TRIGGERS', {METRICS} "
        "FROM (SELECT split, model, hour_index, sum(a) AS a, sum(p) AS p FROM pr GROUP BY ALL) GROUP BY split, model",
    ),
    "se": (("mt",), "SELECT * FROM mt WHERE split = 'validation' AND lvl = 'total_demand' ORDER BY wape, mae, rmse, model LIMIT 1"),
    "rk": (("mt",), "SELECT model, CAST(rank() OVER (ORDER BY wape) AS INTEGER) AS k FROM mt WHERE split = 'validation' AND lvl = 'total_demand'"),
    "pt": (
        ("de",),
        "SELECT x.*, h AS horizon, CAST(719 + h AS INTEGER) AS hour_index, m.hour_of_day, m.p FROM (SELECT trig, hour_of_day, avg(y) AS p FROM de GROUP BY ALL) m "
        "JOIN (SELECT CAST(k AS INTEGER) AS h FROM unnest(range(1, 25)) AS t(k)) n ON (719 + h) % 24 = m.hour_of_day JOIN (SELECT trig FROM de GROUP BY trig) x USING (trig)",
    ),
    "pa": (
        ("pt",),
        "SELECT horizon, hour_index, hour_of_day, 'trigger' AS lvl, trig, p FROM pt UNION ALL "
        "SELECT horizon, hour_index, hour_of_day, 'total_demand', 'ALL_TRIGGERS', sum(p) FROM pt GROUP BY horizon, hour_index, hour_of_day",
    ),
    "rv": (
        ("pr",),
        "SELECT CAST(dense_rank() OVER (ORDER BY hour_index) - 1 AS INTEGER) AS vector, hour_index, hour_of_day, trig, a - p AS res FROM pr "
        "WHERE model = 'Historical Hour-of-Day Mean'",
    ),
    "dr": (
        (),
        "SELECT CAST(h AS INTEGER) AS horizon, s, ('0x' || substr(md5('42:' || h || ':' || s), 1, 8))::BIGINT % 120 AS vector "
        "FROM unnest(range(1, 25)) AS a(h), unnest(range(0, 10000)) AS b(s)",
    ),
    "si": (("dr", "rv", "pt"), "SELECT dr.horizon, s, pt.trig, greatest(p + res, 0.0) AS x FROM dr JOIN rv USING (vector) JOIN pt ON pt.horizon = dr.horizon AND pt.trig = rv.trig"),
    "st": (("si",), "SELECT horizon, s, sum(x) AS x FROM si GROUP BY ALL"),
    "iv": (
        ("si", "st", "pa"),
        "SELECT pa.*, q FROM pa JOIN (SELECT horizon, trig, quantile_cont(x, [0.5, 0.8, 0.9, 0.95, 0.99]) AS q FROM si GROUP BY ALL UNION ALL "
        "SELECT horizon, 'ALL_TRIGGERS', quantile_cont(x, [0.5, 0.8, 0.9, 0.95, 0.99]) FROM st GROUP BY horizon) USING (horizon, trig)",
    ),
    "cs": (
        ("st", "pa"),
        "SELECT horizon, hour_index, hour_of_day, hr, p, p * (1 + hr / 100.0) AS cap, avg(CASE WHEN x > p * (1 + hr / 100.0) THEN 1.0 ELSE 0.0 END) AS prob, "
        "avg(greatest(x - p * (1 + hr / 100.0), 0.0)) AS short, quantile_cont(greatest(x - p * (1 + hr / 100.0), 0.0), 0.95) AS p95, "
        "avg(greatest(p * (1 + hr / 100.0) - x, 0.0)) AS idle, count(*) AS n "
        f"FROM st JOIN (SELECT * FROM pa WHERE lvl = 'total_demand') USING (horizon), (VALUES {', '.join(f'({h})' for h in HEADROOMS)}) AS v(hr) GROUP BY ALL",
    ),
    "rc": (
        ("cs",),
        "SELECT *, min(CASE WHEN worst <= 0.05 THEN hr END) OVER () AS best FROM (SELECT hr, max(prob) AS worst, avg(prob) AS mean, sum(short) AS short, "
        "avg(idle) AS idle FROM cs GROUP BY hr)",
    ),
    "fv": (
        ("pr", "se"),
        "SELECT a.hour_index, a.trig, a.a, b.p AS base, a.model, a.p AS sel FROM pr a JOIN se ON a.model = se.model JOIN pr b ON b.model = 'Seasonal Naive' "
        "AND b.split = 'test' AND a.hour_index = b.hour_index AND a.trig = b.trig WHERE a.split = 'test'",
    ),
    "mp": (("mt",), "SELECT model, split, CASE WHEN lvl = 'total_demand' THEN 'TOTAL' ELSE trig END AS trig, mae, rmse, wape FROM mt"),
}


def sql(body: str, *needs: str) -> str:
    """The query with all the expressions that it needs, in order of definition."""
    wanted: set[str] = set()

    def want(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in CTES[name][0]:
                want(other)

    for name in needs:
        want(name)
    parts = ",\n".join(f"{name} AS ({text})" for name, (_, text) in CTES.items() if name in wanted)
    return f"WITH {parts}\n{body}" if parts else body


RESULT = f"split, model, hour_index, hour_of_day, trig AS Trigger, {r('a', 'actual_compute_seconds')}, {r('p', 'predicted_compute_seconds')}"
MISSING = (
    "count(*) FILTER (WHERE ms IS NULL) AS missing_functions, round(100.0 * count(*) FILTER (WHERE ms IS NULL) / count(*) + 1e-9, 6) AS missing_function_percentage, "
    "CAST(coalesce(sum(CASE WHEN ms IS NULL THEN calls END), 0) AS BIGINT) AS missing_invocations, "
    "round(100.0 * coalesce(sum(CASE WHEN ms IS NULL THEN calls END), 0) / sum(calls), 6) AS missing_invocation_percentage "
    "FROM (SELECT td, o, app, trig, sum(calls) AS calls FROM fh GROUP BY ALL) LEFT JOIN dc USING (td, o, app, trig)"
)
DUPLICATES = (
    "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS {0}_duplicate_row_count, count(*) AS {0}_duplicate_group_count "
    "FROM (SELECT count(*) AS n FROM {1} GROUP BY {2} HAVING count(*) > 1)"
)


def sources(name: str, cte: str) -> str:
    return f"(SELECT count(*) AS {name}_source_row_count, count(DISTINCT td) AS {name}_processed_day_count FROM {cte})"


def summary() -> str:
    out = ["CAST(72 AS INTEGER) AS warmup_hours", "count(*) AS observations_after_warmup"]
    for s in ("train", "validation", "test"):
        out += [
            f"CAST(min(CASE WHEN split = '{s}' THEN hour_index END) AS BIGINT) AS {s}_start_hour_index",
            f"CAST(max(CASE WHEN split = '{s}' THEN hour_index END) AS BIGINT) AS {s}_end_hour_index",
            f"count(*) FILTER (WHERE split = '{s}') AS {s}_observations",
            *(f"count(*) FILTER (WHERE split = '{s}' AND trig = '{t}') AS {s}_{t}_observations" for t in TRIGGERS),
        ]
    out += [f"count(*) FILTER (WHERE trig = '{t}') AS {t}_observations" for t in TRIGGERS]
    missing = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in FEATURES)
    out += [
        f"CAST({missing} AS BIGINT) AS feature_missing_values_after_warmup",
        f"round(100.0 * ({missing}) / (count(*) * {len(FEATURES)}) + 1e-9, 6) AS feature_missing_percentage_after_warmup",
    ]
    for c in FEATURES:
        out += [
            f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_missing_values_after_warmup",
            f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) + 1e-9, 6) AS {c}_missing_percentage_after_warmup",
        ]
    return f"SELECT {', '.join(out)} FROM fe WHERE split IS NOT NULL"


ROLLED = [f"rolling_mean_{n}" for n in MEAN_WINDOWS] + [f"rolling_std_{n}" for n in STD_WINDOWS] + ["rolling_max_24", "rolling_min_24"]
DOUBLES = [c for c in FEATURES if c not in ("hour_of_day", "trace_day_index")]
RECOMMENDATION = (
    f"SELECT CAST(hr AS INTEGER) AS headroom_percent, {r('worst', 'maximum_hourly_shortage_probability')}, {r('mean', 'average_shortage_probability')}, "
    f"{r('short', 'expected_total_shortage')}, {r('idle', 'average_unused_capacity')}, CAST(0.05 AS DOUBLE) AS service_target_maximum_hourly_shortage_probability, "
    "worst <= 0.05 AS meets_service_target, coalesce(hr = best, false) AS is_minimum_recommended_headroom, CAST(best AS DOUBLE) AS minimum_recommended_headroom_percent, "
    "CASE WHEN best IS NULL THEN 'no tested headroom meets the target' ELSE 'least tested headroom that meets the target: ' || best || '%' END AS recommendation_status, "
    "'required workload-serving capacity in normalized compute-seconds per hour' AS capacity_measure FROM rc"
)
INTERVALS = ", ".join(r(f"q[{k}]", f"simulated_P{p}_compute_seconds") for k, p in enumerate(PERCENTILES, 1))
FUTURE = ", ".join(r(f"q[{k}]", f"P{p}") for k, p in enumerate(PERCENTILES, 1))
POINT = (
    f"horizon AS forecast_horizon_hour, hour_index, hour_of_day, lvl AS aggregation_level, trig AS Trigger, {r('p', 'point_forecast_compute_seconds')}, "
    "'Historical Hour-of-Day Mean' AS selected_model, 'workload demand proxy in compute-seconds per hour' AS demand_measure"
)


def counted(source: str, **rules: str) -> list[str]:
    """A (rule, violations) query per condition that should never hold over ``source``; an unknown outcome counts, too."""
    return [f"SELECT '{name}' AS rule, count(*) FILTER (WHERE coalesce({x}, true)) AS violations FROM {source}" for name, x in rules.items()]


SPLITS = ", ".join(
    f"{f}(CASE WHEN split = '{s}' THEN hour_index END) AS {s}_{f}" for s in ("train", "validation", "test") for f in ("min", "max")
)
FEATURED = "(SELECT * FROM fe WHERE split IS NOT NULL)"
STEPS = f"(SELECT *, lag(hour_index) {W}) AS h0, lag(y) {W}) AS y0 FROM {FEATURED})"
GRID = "(SELECT trig, count(*) AS n, count(DISTINCT hour_index) AS d, min(hour_index) AS lo, max(hour_index) AS hi FROM de GROUP BY trig)"
SHARED = "(SELECT count(DISTINCT model) AS models, count(*) AS n, max(a) - min(a) AS gap FROM pr GROUP BY split, hour_index, trig)"
TOTALS = "(SELECT hour_index, sum(invocations) AS n, sum(y) AS s, sum(act) AS f FROM de GROUP BY hour_index)"
RULES = [
    *counted("fh", calls_finite="NOT isfinite(CAST(calls AS DOUBLE)) OR calls < 0", calls_integral="calls <> floor(calls)",
             trigger_known=f"trig NOT IN {TRIGGERS!r}"),
    *counted("du", duration_count_positive="NOT (isfinite(CAST(c AS DOUBLE)) AND c > 0)"),
    *counted("me", memory_finite="NOT isfinite(k) OR k < 0", memory_samples_positive="c <= 0"),
    *counted("de", panel_keys_present="hour_index IS NULL OR trig IS NULL", panel_target="NOT isfinite(y) OR y < 0", panel_hour_of_day="hour_of_day <> hour_index % 24"),
    *counted(GRID, panel_unique="n <> d", panel_continuous="hi - lo + 1 <> d", panel_full_grid="d <> 720", panel_long_enough="d <= 192"),
    *counted("(SELECT count(DISTINCT hour_index) AS d FROM de GROUP BY trace_day)", day_has_24_hours="d <> 24"),
    *counted("(SELECT min(hour_index) AS lo, count(*) AS n FROM de)", history_starts_at_zero="lo <> 0", history_rows=f"n <> 720 * {len(TRIGGERS)}"),
    *counted(f"(SELECT sum(calls) AS raw FROM fh), (SELECT sum(invocations) AS n, sum(y) AS s FROM de), (SELECT sum(n) AS n2, sum(s) AS s2 FROM {TOTALS})",
             raw_equals_trigger="raw <> n", trigger_equals_total="n <> n2", seconds_reconcile="abs(s - s2) > 1e-6 + 1e-9 * abs(s2)"),
    *counted(FEATURED, lags_present=" OR ".join(f"lag_{k} IS NULL" for k in LAGS),
             share_in_range="lag24_trigger_share IS NOT NULL AND lag24_trigger_share NOT BETWEEN 0 AND 1",
             load_ratio_finite="historical_load_ratio IS NOT NULL AND (NOT isfinite(historical_load_ratio) OR historical_load_ratio < 0)"),
    *counted(STEPS, features_finite=" OR ".join(f"NOT isfinite(CAST({c} AS DOUBLE)) OR {c} IS NULL" for c in FEATURES),
             feature_hours_continuous="h0 IS NOT NULL AND hour_index - h0 <> 1",
             lag_1_is_the_hour_before="h0 IS NOT NULL AND NOT coalesce(abs(lag_1 - y0) <= 1e-9, false)"),
    *counted(f"(SELECT trig, {SPLITS} FROM {FEATURED} GROUP BY trig)", train_before_validation="train_max >= validation_min",
             validation_before_test="validation_max >= test_min", validation_length="validation_max - validation_min + 1 <> 48",
             test_length="test_max - test_min + 1 <> 72"),
    *counted("pr", prediction_finite="p IS NULL OR NOT isfinite(p)", prediction_non_negative="p < 0"),
    *counted(f"{SHARED}, (SELECT count(DISTINCT model) AS every FROM pr)", models_share_rows="models <> every OR n <> every", models_share_actuals="abs(gap) > 1e-6"),
    *counted("(SELECT count(*) AS n, count(DISTINCT model) AS models FROM mt GROUP BY split)", metric_rows=f"n <> 2 * {len(TRIGGERS) + 1}", metric_models="models <> 2"),
    *counted("(SELECT count(*) FILTER (WHERE trig = 'ALL_TRIGGERS') AS n FROM mt GROUP BY split, model)", one_total_per_model="n <> 1"),
    *counted("(SELECT count(*) AS n FROM se)", one_selection="n <> 1"),
    *counted("se", selection_complete="model IS NULL OR mae IS NULL OR rmse IS NULL OR wape IS NULL", selection_criterion="wape > (SELECT min(wape) FROM mt "
             "WHERE split = 'validation' AND lvl = 'total_demand')", selection_without_test="split = 'test'"),
    *counted("(SELECT count(*) AS n, count(DISTINCT (horizon, trig)) AS d FROM iv)", forecast_rows=f"n <> 24 * {len(TRIGGERS) + 1} OR d <> n"),
    *counted("(SELECT count(*) AS n, count(DISTINCT (horizon, hr)) AS d FROM cs)", scenario_rows=f"n <> 24 * {len(HEADROOMS)} OR d <> n"),
    *counted("cs", amounts_non_negative="cap < 0 OR short < 0 OR idle < 0"),
    *counted("pa", points_non_negative="p < 0"),
    *counted("iv", percentiles_ordered=" OR ".join(f"q[{k}] > q[{k + 1}] + 1e-9" for k in range(1, len(PERCENTILES)))),
    *counted("cs", probability_in_range="prob NOT BETWEEN 0 AND 1", capacity_arithmetic="abs(cap - p * (1 + hr / 100.0)) > 1e-8 + 1e-5 * abs(p * (1 + hr / 100.0))"),
    *counted("(SELECT count(*) FILTER (WHERE hr = best) AS n FROM rc)", one_recommendation="n > 1"),
]


def table_violations() -> str:
    """The contract of the published tables, over their own SQL."""
    columns = {
        "demand_history": ["trace_day", "hour_of_day"], "forecast_vs_actual": ["selected_model"],
        "capacity_recommendation": [
            "service_target_maximum_hourly_shortage_probability", "meets_service_target", "is_minimum_recommended_headroom",
            "minimum_recommended_headroom_percent", "recommendation_status", "capacity_measure",
        ],
    }
    out = []
    for name, (keys, numbers) in TABLES.items():
        nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in [*keys, *numbers, *columns.get(name, [])])
        odd = " + ".join(f"count(*) FILTER (WHERE NOT isfinite(CAST({c} AS DOUBLE)))" for c in numbers)
        out.append(
            f"SELECT CAST(count(*) = 0 AS BIGINT) AS empty, {nulls} AS nulls, {odd} AS not_finite, (SELECT count(*) FROM (SELECT 1 FROM t_{name} "
            f"GROUP BY {', '.join(keys)} HAVING count(*) > 1)) AS repeated_keys, '{name}' AS table_name FROM t_{name}"
        )
    tables = ", ".join(f"t_{name} AS ({ORACLE[f'bi_{name}']})" for name in TABLES)
    return f"WITH {tables}\n" + " UNION ALL ".join(out)


def groups(name: str, keys: str, cte: str) -> str:
    """The repeated keys of a source under the names of the quality record."""
    counts = f"{name}_duplicate_row_count, {name}_duplicate_group_count AS {name}_duplicate_key_group_count"
    return f"(SELECT {counts} FROM ({DUPLICATES.format(name, cte, keys)}))"


RECONCILED = (
        "SELECT n = 0 AND f = 0 AND rn = 0 AND s <= 1e-9 AND rs <= 1e-6 AS reconciliation_passed, n AS max_hourly_invocation_difference, "
        f"{r('s', 'max_hourly_compute_seconds_difference')}, f AS max_hourly_active_function_difference, rn AS raw_total_invocation_difference, "
        f"{r('rs', 'raw_total_compute_seconds_difference')} FROM (SELECT CAST(max(abs(a.n - b.n)) AS DOUBLE) AS n, max(abs(a.s - b.s)) AS s, "
        "CAST(max(abs(a.f - b.f)) AS DOUBLE) AS f, CAST(abs(sum(b.n) - any_value(raw)) AS DOUBLE) AS rn, abs(sum(b.s) - any_value(secs)) AS rs "
        f"FROM {TOTALS} a JOIN {TOTALS} b USING (hour_index), (SELECT sum(calls) AS raw, coalesce(sum(calls * ms / 1000.0), 0.0) AS secs "
        "FROM fh LEFT JOIN dc USING (td, o, app, trig)))"
)

ORACLE: dict[str, str] = {
    "hourly_demand_by_trigger": sql(
        f"SELECT trace_day, hour_of_day, hour_index, trig AS Trigger, invocations, {r('y', 'compute_seconds')}, act AS active_functions, "
        f"{r('wavg', 'invocation_weighted_average_duration_ms')} FROM de", "de"),
    "hourly_total_demand": sql(
        "SELECT trace_day, hour_of_day, hour_index, CAST(total_invocations AS BIGINT) AS total_invocations, round(s + 1e-9, 6) AS total_compute_seconds, "
        f"CAST(f AS BIGINT) AS total_active_functions, {', '.join(r(f'share_{t}', f'invocation_share_{t}') for t in TRIGGERS)} FROM "
        f"(SELECT trace_day, hour_of_day, hour_index, sum(invocations) AS total_invocations, sum(y) AS s, sum(act) AS f, {SHARES} FROM de "
        "GROUP BY trace_day, hour_of_day, hour_index)", "de"),
    "duration_consolidation": sql(f"SELECT td AS trace_day, o AS HashOwner, app AS HashApp, trig AS HashFunction, {r('ms', 'average_ms')} FROM dc", "dc"),
    "duration_duplicates": sql(DUPLICATES.format("duration", "du", "td, o, app, trig"), "du"),
    "missing_duration_accounting": sql(f"SELECT {MISSING}", "fh", "dc"),
    "daily_memory_summary": sql(
        f"SELECT td AS trace_day, count(*) AS application_count, {r('avg(mb)', 'mean_allocated_mb')}, {r('quantile_cont(mb, 0.5)', 'median_allocated_mb')}, "
        f"{r('quantile_cont(mb, 0.95)', 'p95_allocated_mb')} FROM (SELECT td, o, app, sum(k * c) / sum(c) AS mb FROM me GROUP BY ALL) GROUP BY td", "me"),
    "data_quality_summary": sql(
        f"SELECT * FROM {sources('invocation', 'fh')}, {sources('duration', 'du')}, {sources('memory', 'me')}, "
        "(SELECT missing_functions AS missing_duration_join_function_count, missing_function_percentage AS missing_duration_join_function_percentage, "
        "missing_invocations AS missing_duration_join_invocation_count, missing_invocation_percentage AS missing_duration_join_invocation_percentage "
        f"FROM (SELECT {MISSING})), {groups('duration', 'td, o, app, trig', 'du')}, {groups('memory', 'td, o, app', 'me')}, "
        "(SELECT coalesce(string_agg(CAST(d AS VARCHAR), '|' ORDER BY d), '') AS memory_unavailable_trace_days FROM unnest(range(1, 31)) AS t(d) "
        "WHERE d NOT IN (SELECT td FROM me)), (SELECT count(DISTINCT td) AS daily_memory_row_count FROM me), "
        "(SELECT count(*) AS hourly_trigger_row_count, count(DISTINCT hour_index) AS hourly_total_row_count, "
        f"CAST(sum(invocations) AS BIGINT) AS total_invocations, {r('sum(y)', 'total_compute_seconds')} FROM de), ({RECONCILED}), (SELECT "
        + ", ".join(f"'parquet' AS {k}_source_layout, CAST(1 AS BIGINT) AS {k}_source_file_count" for k in ("invocation", "duration", "memory")) + ")",
        "fh", "du", "dc", "me", "de"),
    "demand_reconciliation": sql(RECONCILED, "fh", "dc", "de"),
    "constraint_report": sql("\nUNION ALL ".join(RULES), "fh", "du", "me", "de", "fe", "pr", "mt", "se", "pa", "iv", "cs", "rc"),
    "minute_to_hour_reshape": sql(
        "SELECT td AS trace_day, trig AS Trigger, CAST(h AS INTEGER) AS hour_of_day, CAST(coalesce(n, 0) AS BIGINT) AS calls, CAST(coalesce(f, 0) AS BIGINT) AS active_functions "
        "FROM (SELECT DISTINCT td, trig FROM fh) CROSS JOIN unnest(range(0, 24)) AS t(h) LEFT JOIN "
        "(SELECT td, trig, hour_index % 24 AS h, sum(calls) AS n, count(*) AS f FROM fh GROUP BY ALL) USING (td, trig, h)", "fh"),
    "trigger_normalization": sql(
        f"SELECT trig AS Trigger, CAST(list_position({list(TRIGGERS)!r}, trig) - 1 AS INTEGER) AS code, count(*) AS n FROM ev GROUP BY ALL", "ev"),
    "lag_features": sql(f"SELECT hour_index, trig AS Trigger, {', '.join(r(f'lag_{k}', f'lag_{k}') for k in LAGS)} FROM lg", "lg"),
    "rolling_features": sql(f"SELECT hour_index, trig AS Trigger, {', '.join(r(c, c) for c in ROLLED)} FROM ro", "ro"),
    "expanding_load_ratio": sql(
        f"SELECT hour_index, trig AS Trigger, {r('prior_p95', 'prior_p95')}, {r('historical_load_ratio', 'historical_load_ratio')} FROM fe", "fe"),
    "lag24_trigger_share": sql(f"SELECT hour_index, trig AS Trigger, {r('lag24_trigger_share', 'lag24_trigger_share')} FROM fe", "fe"),
    "temporal_features": sql(f"SELECT hour_index, trig AS Trigger, {r('hour_sin', 'hour_sin')}, {r('hour_cos', 'hour_cos')}, trace_day_index FROM fe", "fe"),
    "model_features": sql(
        f"SELECT hour_index, trig AS Trigger, {r('y', 'compute_seconds')}, hour_of_day, trace_day_index, {', '.join(r(c, c) for c in DOUBLES)}, split FROM fe "
        "WHERE split IS NOT NULL", "fe"),
    "chronological_split": sql(
        "SELECT split, trig AS Trigger, min(hour_index) AS first_hour, max(hour_index) AS last_hour, count(*) AS hours, count(DISTINCT hour_index) AS distinct_hours "
        "FROM fe WHERE split IS NOT NULL GROUP BY ALL", "fe"),
    "split_summary": sql(summary(), "fe"),
    "seasonal_naive_fixed_origin": sql(f"SELECT {RESULT} FROM pr WHERE split = 'validation' AND model = 'Seasonal Naive'", "pr"),
    "seasonal_naive_walk_forward": sql(f"SELECT {RESULT} FROM pr WHERE split = 'test' AND model = 'Seasonal Naive'", "pr"),
    "hour_of_day_mean_forecast": sql(f"SELECT {RESULT} FROM pr WHERE model <> 'Seasonal Naive'", "pr"),
    "baseline_metrics": sql(
        f"SELECT split, model, lvl AS aggregation_level, trig AS Trigger, {r('mae', 'MAE')}, {r('rmse', 'RMSE')}, {r('wape', 'WAPE')} FROM mt", "mt"),
    "model_ranking": sql(
        f"SELECT mt.split, mt.model, {r('mt.mae', 'MAE')}, {r('mt.rmse', 'RMSE')}, {r('mt.wape', 'WAPE')}, k AS validation_wape_rank, "
        "mt.model = se.model AS selected_on_validation FROM mt JOIN rk ON mt.model = rk.model, se WHERE mt.lvl = 'total_demand'", "mt", "rk", "se"),
    "model_ranking_by_trigger": sql(
        f"SELECT mt.split, mt.trig AS Trigger, mt.model, {r('mt.mae', 'MAE')}, {r('mt.rmse', 'RMSE')}, {r('mt.wape', 'WAPE')}, k AS validation_wape_rank, "
        "mt.model = se.model AS selected_on_validation FROM mt JOIN rk ON mt.model = rk.model, se WHERE mt.lvl = 'trigger'", "mt", "rk", "se"),
    "model_selection": sql(
        f"SELECT model AS selected_model, {r('mae', 'validation_MAE')}, {r('rmse', 'validation_RMSE')}, {r('wape', 'validation_WAPE')}, "
        "'lowest aggregated validation WAPE' AS selection_criterion, true AS test_set_excluded_from_selection FROM se", "se"),
    "selected_test_predictions": sql(f"SELECT {RESULT} FROM pr WHERE split = 'test' AND model = (SELECT model FROM se)", "pr", "se"),
    "future_point_forecast": sql(f"SELECT {POINT} FROM pa", "pa"),
    "residual_vectors": sql(
        "SELECT vector, hour_index, hour_of_day, "
        + ", ".join(r(f"max(CASE WHEN trig = '{t}' THEN res END)", f"residual_{t}") for t in TRIGGERS)
        + " FROM rv GROUP BY vector, hour_index, hour_of_day", "rv"),
    "bootstrap_demand": sql(
        f"SELECT horizon AS forecast_horizon_hour, count(*) AS simulations, {r('avg(x)', 'mean_total')}, {r('min(x)', 'least_total')}, {r('max(x)', 'most_total')} "
        "FROM st GROUP BY horizon", "st"),
    "forecast_intervals": sql(f"SELECT {POINT}, {INTERVALS} FROM iv", "iv"),
    "capacity_scenarios": sql(
        f"SELECT horizon AS forecast_horizon_hour, hour_index, hour_of_day, CAST(hr AS INTEGER) AS headroom_percent, {r('p', 'point_forecast_compute_seconds')}, "
        f"{r('cap', 'required_capacity_compute_seconds')}, {r('prob', 'shortage_probability')}, {r('short', 'expected_shortage_compute_seconds')}, "
        f"{r('p95', 'p95_shortage_compute_seconds')}, {r('idle', 'expected_unused_capacity')}, n AS simulation_count FROM cs", "cs"),
    "capacity_recommendation": sql(RECOMMENDATION, "rc"),
    "day_set_difference": sql(
        "SELECT CAST(d AS INTEGER) AS day, 'missing' AS state FROM unnest(range(1, 31)) AS t(d) WHERE d NOT IN (SELECT td FROM me)", "me"),
    "bi_demand_history": sql(f"SELECT hour_index, trace_day, hour_of_day, trig AS trigger, invocations, {r('y', 'compute_seconds')} FROM de", "de"),
    "bi_model_performance": sql(f"SELECT model, split AS dataset_split, trig AS trigger, {r('mae', 'MAE')}, {r('rmse', 'RMSE')}, {r('wape', 'WAPE')} FROM mp", "mp"),
    "bi_forecast_vs_actual": sql(
        f"SELECT hour_index, trig AS trigger, {r('a', 'actual_compute_seconds')}, {r('base', 'baseline_forecast')}, model AS selected_model, "
        f"{r('sel', 'selected_forecast')} FROM fv", "fv"),
    "bi_future_forecast": sql(
        f"SELECT horizon AS forecast_hour, CASE WHEN lvl = 'total_demand' THEN 'TOTAL' ELSE trig END AS trigger, {r('p', 'point_forecast')}, {FUTURE} FROM iv", "iv"),
    "bi_capacity_scenarios": sql(
        f"SELECT horizon AS forecast_hour, CAST(hr AS INTEGER) AS headroom_pct, {r('p', 'point_forecast')}, {r('cap', 'capacity')}, {r('prob', 'shortage_probability')}, "
        f"{r('short', 'expected_shortage_compute_seconds')}, {r('idle', 'expected_unused_capacity')} FROM cs", "cs"),
    "bi_capacity_recommendation": sql(RECOMMENDATION, "rc"),
    "measure_kpis": sql(
        f"SELECT model AS selected_model, {r('total', 'total_actual_demand')}, {r('wape', 'test_wape')}, {r('room / 100.0', 'recommended_capacity_headroom')} FROM "
        "(SELECT sum(a) AS total, max(model) AS model FROM fv) JOIN (SELECT model, wape FROM mp WHERE split = 'test' AND trig = 'TOTAL') USING (model), "
        "(SELECT max(CASE WHEN hr = best THEN best END) AS room FROM rc)", "fv", "mp", "rc"),
    "visual_actual_vs_selected": sql(f"SELECT hour_index, {r('sum(a)', 'actual')}, {r('sum(sel)', 'selected')} FROM fv GROUP BY hour_index", "fv"),
    "visual_actual_by_trigger": sql(f"SELECT trig AS trigger, {r('sum(a)', 'actual')} FROM fv GROUP BY trig", "fv"),
    "visual_trigger_slice": sql(f"SELECT hour_index, {r('sum(a)', 'actual')}, {r('sum(sel)', 'selected')} FROM fv WHERE trig = 'click' GROUP BY hour_index", "fv"),
    "visual_test_metrics": sql(
        f"SELECT model, {r('mae', 'MAE')}, {r('rmse', 'RMSE')}, {r('wape', 'WAPE')} FROM mp WHERE split = 'test' AND trig = 'TOTAL'", "mp"),
    "visual_forecasts_by_hour": sql(
        f"SELECT hour_index, {r('sum(a)', 'actual_compute_seconds')}, {r('sum(base)', 'baseline_forecast')}, {r('sum(sel)', 'selected_forecast')} FROM fv GROUP BY hour_index", "fv"),
    "visual_uncertainty": sql(
        f"SELECT horizon AS forecast_hour, {r('p', 'point_forecast')}, {r('q[1]', 'P50')}, {r('q[3]', 'P90')}, {r('q[4]', 'P95')} FROM iv WHERE lvl = 'total_demand'", "iv"),
    "visual_recommended_by_hour": sql(
        f"SELECT horizon AS forecast_hour, {r('max(p)', 'point_forecast')}, {r('max(CASE WHEN cs.hr = best THEN cap END)', 'recommended_capacity')} "
        "FROM cs, (SELECT max(best) AS best FROM rc) GROUP BY horizon", "cs", "rc"),
    "visual_shortage_by_headroom": sql(
        f"SELECT CAST(hr AS INTEGER) AS headroom_percent, {r('worst', 'maximum_hourly_shortage_probability')}, {r('short', 'expected_total_shortage')} FROM rc", "rc"),
}
ORACLE["bi_table_violations"] = table_violations()
