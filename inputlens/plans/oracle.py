"""DuckDB SQL for the registered queries, written against the same tables and the same mapping."""

from __future__ import annotations

MAPPING = """
WITH RECURSIVE a AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
e0 AS (
  SELECT event_id, 'user-' || CAST(user_id % 3 AS VARCHAR) AS "user", ts AS event_time, k,
    CASE event_type WHEN 'view' THEN 'move' WHEN 'click' THEN 'click'
      WHEN 'signup' THEN (CASE WHEN k % 2 = 0 THEN 'scroll' ELSE 'key_up' END) ELSE 'key_down' END AS type
  FROM a),
c AS (
  SELECT event_id, "user", event_time, type, k,
    CASE WHEN type IN ('key_down', 'key_up') THEN
      CASE k % 10 WHEN 0 THEN 'Key.space' WHEN 1 THEN ' ' WHEN 2 THEN 'Key.backspace' WHEN 3 THEN 'Key.delete'
        ELSE chr(97 + k % 26) END END AS key,
    CASE WHEN type IN ('move', 'click', 'scroll') THEN (event_id * 37) % 1928 - 100 END AS x,
    CASE WHEN type IN ('move', 'click', 'scroll') THEN (event_id * 53) % 1217 - 50 END AS y
  FROM e0),
latest AS (SELECT max(event_time) AS t FROM c)
"""

COUNTS = """CAST(count(*) FILTER (type = 'key_down') AS BIGINT) AS keystrokes,
    CAST(count(*) FILTER (type = 'key_down' AND key IN (' ', 'Key.space')) AS BIGINT) AS words,
    CAST(count(*) FILTER (type = 'key_down' AND key IN ('Key.backspace', 'Key.delete')) AS BIGINT) AS corrections,
    CAST(count(*) FILTER (type = 'click') AS BIGINT) AS clicks"""

FOUR = ("keystrokes", "words", "corrections", "clicks")
MINUTE, HOUR = "date_trunc('minute', event_time)", "date_trunc('hour', event_time)"


def _minutes(unit: str = "minute") -> str:
    w = f"date_trunc('{unit}', event_time)"
    return f""", m AS (
  SELECT {w} AS window_start, {w} + INTERVAL 1 {unit} AS window_end, "user", {COUNTS} FROM c GROUP BY ALL)"""


def _sessions(unit: str, gap_s: int) -> str:
    """f: events with gap flags, s: with session ids, pw: windows, ss: sessions."""
    w = f"date_trunc('{unit}', event_time)"
    totals = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_total" for c in FOUR)
    return f""", f AS (
  SELECT *, lag(event_time) OVER o AS before FROM c WINDOW o AS (PARTITION BY "user" ORDER BY event_time)),
s AS (
  SELECT *, CAST(sum(CASE WHEN before IS NULL OR event_time - before > INTERVAL {gap_s} SECOND THEN 1 ELSE 0 END)
    OVER (PARTITION BY "user" ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM f),
pw AS (
  SELECT session_id, {w} AS window_start, {w} + INTERVAL 1 {unit} AS window_end, "user", {COUNTS},
    min(epoch_us(event_time)) AS first_us FROM s GROUP BY session_id, 2, 3, "user"),
ss AS (
  SELECT session_id, "user", min(first_us) AS session_key, min(window_start) AS session_start,
    max(window_end) AS session_end, count(*) AS window_count, {totals} FROM pw GROUP BY session_id, "user")"""


def _baseline(digits: int | None = None) -> str:
    r = (lambda x: f"round({x}, {digits})") if digits else (lambda x: x)
    stats = ", ".join(f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_samp({c})')} AS {c}_std" for c in FOUR)
    return f'SELECT "user", {stats} FROM pw GROUP BY "user"'


P0, P1 = _sessions("minute", 300), _sessions("hour", 3600)
DAY_MINUTE = f""", dm AS (
  SELECT strftime(event_time, '%Y-%m-%d') AS day, {MINUTE} AS window_start, {MINUTE} + INTERVAL 1 minute AS window_end, "user",
    {COUNTS}, CAST(count(*) FILTER (type IN ('move', 'scroll')) AS BIGINT) AS mouse_moves FROM c GROUP BY ALL)"""
HEAT_DAY = """, hd AS (
  SELECT strftime(event_time, '%Y-%m-%d') AS day, CAST(trunc(x / 16.0) AS INT) AS cell_x, CAST(trunc(y / 16.0) AS INT) AS cell_y,
    type, "user", count(*) AS count FROM c WHERE type IN ('move', 'click') GROUP BY ALL)"""
BUCKETS = """, n AS (SELECT CAST(floor(epoch(t) / 7200) AS BIGINT) AS last FROM latest),
spine AS (SELECT DISTINCT "user", b FROM dm, n, LATERAL (SELECT unnest(range(n.last - 83, n.last + 1)) AS b) WHERE "user" IS NOT NULL),
held AS (
  SELECT "user", CAST(floor(epoch(window_start) / 7200) AS BIGINT) AS b, sum(keystrokes) AS keystrokes, sum(words) AS words,
    sum(corrections) AS corrections, sum(clicks) AS clicks, sum(mouse_moves) AS mouse_moves FROM dm GROUP BY ALL),
rb AS (
  SELECT spine."user", CAST(make_timestamp(spine.b * 7200000000) AS TIMESTAMP) AS window_start, """ + ", ".join(
    f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in (*FOUR, "mouse_moves")
) + """, held.b IS NULL AS synthetic
  FROM spine LEFT JOIN held ON held."user" = spine."user" AND held.b = spine.b)"""
TODAY = """, td AS (
  SELECT "user", CAST(sum(keystrokes_total) AS BIGINT) AS keystrokes, CAST(sum(words_total) AS BIGINT) AS words,
    CAST(sum(corrections_total) AS BIGINT) AS corrections, CAST(sum(clicks_total) AS BIGINT) AS clicks, count(*) AS sessions,
    CAST(sum(window_count) AS BIGINT) AS active_minutes, max(window_count) AS longest
  FROM ss, latest WHERE session_start >= date_trunc('day', t) GROUP BY "user")"""
RATINGS = """, dt AS (
  SELECT "user", strftime(session_start, '%Y-%m-%d') AS day, CAST(sum(window_count) AS BIGINT) AS total_minutes FROM ss GROUP BY ALL),
md AS (SELECT "user", median(total_minutes) FILTER (total_minutes > 0) AS median FROM dt GROUP BY "user"),
rt AS (
  SELECT dt."user", day, total_minutes, median, CASE WHEN total_minutes <= 0 OR median IS NULL THEN 'not_active'
    WHEN total_minutes / median < 0.5 THEN 'below_average' WHEN total_minutes / median <= 1.5 THEN 'standard'
    ELSE 'productive' END AS tier FROM dt JOIN md USING ("user"))"""
FLAGS = """, sc AS (SELECT "user", window_start, (keystrokes * 7 + clicks * 3) % 10 / 10 AS p FROM m),
fl AS (
  SELECT "user", strftime(window_start, '%Y-%m-%d') AS day, max(p) AS score, count(*) FILTER (p >= 0.8) >= 2 AS nonhuman
  FROM sc GROUP BY ALL)"""
ACTIVE = "keystrokes + words + corrections + clicks > 0"
SITTING = f""", ac AS (
  SELECT "user", window_start, lag(window_start) OVER (PARTITION BY "user" ORDER BY window_start) AS before FROM m WHERE {ACTIVE}),
rn AS (
  SELECT *, sum(CASE WHEN before IS NULL OR window_start - before > INTERVAL 3600 SECOND THEN 1 ELSE 0 END)
    OVER (PARTITION BY "user" ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS r FROM ac),
sp AS (SELECT "user", r, min(window_start) AS run_start, max(window_start) AS run_end FROM rn GROUP BY ALL),
st AS (
  SELECT "user", run_start, date_diff('microsecond', run_start, t) / 60000000 AS minutes FROM sp, latest
  WHERE r = (SELECT max(x.r) FROM sp x WHERE x."user" = sp."user") AND t - run_end <= INTERVAL 3600 SECOND)"""
CV = "CASE WHEN avg({0}) > 0 THEN stddev_pop({0}) / avg({0}) ELSE 0 END"
FEATURES = f""", g AS (
  SELECT *, date_trunc('hour', event_time) AS w,
    epoch_us(event_time) - lag(epoch_us(event_time)) OVER o AS gap, epoch_us(event_time) - lag(epoch_us(event_time)) OVER p AS tgap
  FROM c WINDOW o AS (PARTITION BY "user", date_trunc('hour', event_time) ORDER BY event_time),
    p AS (PARTITION BY "user", date_trunc('hour', event_time), type ORDER BY event_time)),
st AS (
  SELECT "user", w, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) AS step FROM g WHERE type = 'move' AND x IS NOT NULL AND y IS NOT NULL
  WINDOW o AS (PARTITION BY "user", w ORDER BY event_time)),
sa AS (SELECT "user", w, count(*) AS n, avg(step) AS mean, {CV.format('step')} AS cv FROM st GROUP BY ALL),
ft AS (
  SELECT g."user", g.w AS window_start, count(*) AS n_events,
    CASE WHEN count(*) FILTER (type = 'key_down') > 0
      THEN count(DISTINCT CASE WHEN type = 'key_down' THEN key END) / count(*) FILTER (type = 'key_down') ELSE 0 END AS key_diversity,
    CASE WHEN count(*) FILTER (type = 'key_down') >= 3 THEN {CV.format("CASE WHEN type = 'key_down' THEN tgap END")} ELSE 0 END AS ks_iei_cv,
    CASE WHEN count(*) FILTER (type = 'move') >= 3 THEN {CV.format("CASE WHEN type = 'move' THEN tgap END")} ELSE 0 END AS move_iei_cv,
    CASE WHEN count(*) >= 3 THEN {CV.format('gap')} ELSE 0 END AS iei_cv,
    CASE WHEN coalesce(any_value(sa.n), 0) >= 2 THEN any_value(sa.mean) ELSE 0 END AS step_mean,
    CASE WHEN coalesce(any_value(sa.n), 0) >= 2 THEN any_value(sa.cv) ELSE 0 END AS step_cv,
    count(*) FILTER (type IN ('move', 'click', 'scroll')) / count(*) AS mouse_fraction
  FROM g LEFT JOIN sa ON sa."user" = g."user" AND sa.w = g.w GROUP BY g."user", g.w HAVING count(*) >= 5)"""
SEVEN = ("key_diversity", "ks_iei_cv", "move_iei_cv", "iei_cv", "step_mean", "step_cv", "mouse_fraction")


def _sql(parts: str, select: str) -> str:
    return MAPPING + parts + "\n" + select


M = _minutes()
H = _minutes("hour")
PW = 'SELECT session_id, window_start, window_end, "user", keystrokes, words, corrections, clicks FROM pw'

ORACLE_SQL = {
    "a2_minute_metrics": _sql(M, "SELECT * FROM m"),
    "a3_per_window": _sql(P0, PW),
    "a3_per_window_p1": _sql(P1, PW),
    "a4_sessions": _sql(P0, "SELECT * FROM ss"),
    "a4_sessions_p1": _sql(P1, "SELECT * FROM ss"),
    "a5_baseline": _sql(P0, _baseline(6)),
    "a6_range_heatmaps": _sql(
        "",
        """SELECT r.name AS range, CAST(trunc(x / 16.0) AS INT) AS cell_x, CAST(trunc(y / 16.0) AS INT) AS cell_y, type, "user", count(*) AS count
FROM c, latest, (VALUES ('1h', 1), ('6h', 6), ('1d', 24), ('3d', 72), ('1w', 168)) r(name, h)
WHERE type IN ('move', 'click') AND event_time >= t - to_hours(h) GROUP BY ALL""",
    ),
    "a7_day_minute": _sql(DAY_MINUTE, "SELECT * FROM dm"),
    "a8_heatmap_day": _sql(HEAT_DAY, "SELECT * FROM hd"),
    "a10_features_p1": _sql(FEATURES, f'SELECT "user", window_start, n_events, {", ".join(f"round({c}, 6) AS {c}" for c in SEVEN)} FROM ft'),
    "a14_day_flags": _sql(H + FLAGS, 'SELECT "user", day, round(score, 6) AS score, nonhuman FROM fl'),
    "a17_rebucket": _sql(DAY_MINUTE + BUCKETS, "SELECT * FROM rb"),
    "a18_gauge": _sql(
        DAY_MINUTE + BUCKETS,
        f"""SELECT "user", count(*) FILTER ({ACTIVE}) AS active_buckets, round(count(*) FILTER ({ACTIVE}) / count(*) * 100, 6) AS active_pct,
  count(*) FILTER ({ACTIVE}) * 120 AS active_minutes, (count(*) - count(*) FILTER ({ACTIVE})) * 120 AS idle_minutes FROM rb GROUP BY "user" """,
    ),
    "a19_today": _sql(P0 + TODAY, "SELECT * EXCLUDE (longest) FROM td"),
    "a20_per_minute": _sql(
        P0 + TODAY + f", bl AS ({_baseline()})",
        'SELECT td."user", '
        + ", ".join(f"CASE WHEN active_minutes > 0 THEN CAST(floor({c} / active_minutes + 0.5) AS BIGINT) END AS {c}_per_minute" for c in FOUR)
        + ", round(CASE WHEN keystrokes > 0 THEN corrections / keystrokes * 100 END, 6) AS correction_pct, "
        + ", ".join(f"round({c}_mean, 6) AS {c}_mean" for c in FOUR)
        + ', round(CASE WHEN keystrokes_mean <> 0 THEN corrections_mean / greatest(keystrokes_mean, 1) * 100 END, 6) AS baseline_correction_pct FROM td LEFT JOIN bl ON bl."user" = td."user"',
    ),
    "a21_longest": _sql(P0 + TODAY, 'SELECT "user", longest FROM td'),
    "a22_peak": _sql(M, 'SELECT "user", nullif(max(CASE WHEN window_start >= date_trunc(\'day\', t) THEN keystrokes END), 0) AS peak FROM m, latest GROUP BY "user"'),
    "a23_ratings": _sql(P1 + RATINGS, 'SELECT "user", day, total_minutes, round(median, 6) AS median, tier FROM rt'),
    "a24_freshness": _sql(
        M,
        """SELECT max(window_end) AS newest, round(date_diff('microsecond', max(window_end), any_value(t)) / 1000000, 6) AS age_s,
  date_diff('microsecond', max(window_end), any_value(t)) < 120000000 AS fresh FROM m, latest""",
    ),
    "a25_users": _sql("", 'SELECT DISTINCT "user" FROM c WHERE "user" IS NOT NULL'),
    "a27_daily_totals": _sql(DAY_MINUTE, "SELECT day, CAST(sum(keystrokes) AS BIGINT) AS keystrokes, CAST(sum(clicks) AS BIGINT) AS clicks FROM dm GROUP BY day"),
    "c10_redact": _sql(
        "", "SELECT event_id, type, CASE WHEN key IS NULL OR key LIKE 'Key.%' OR key = ' ' THEN key ELSE sha256('pepper' || key) END AS key FROM c"
    ),
    "c11_clip_intensity": _sql(
        HEAT_DAY,
        """SELECT *, round(ln(1 + count) / ln(1 + max(count) OVER (PARTITION BY day, "user", type)), 6) AS intensity
FROM hd WHERE cell_x BETWEEN 0 AND 107 AND cell_y BETWEEN 0 AND 69""",
    ),
    "c14_thin_moves": _sql(
        """, mv AS (SELECT event_id, "user", event_time FROM c WHERE type = 'move'),
nx AS (
  SELECT p."user", p.event_time AS t, min(q.event_time) AS nt FROM mv p
  LEFT JOIN mv q ON q."user" = p."user" AND q.event_time >= p.event_time + INTERVAL 1 HOUR GROUP BY ALL),
kp AS (
  SELECT "user", min(event_time) AS t FROM mv GROUP BY "user"
  UNION ALL SELECT nx."user", nx.nt FROM kp JOIN nx ON nx."user" = kp."user" AND nx.t = kp.t WHERE nx.nt IS NOT NULL)""",
        """SELECT event_id, "user", event_time, type FROM c WHERE type <> 'move'
UNION ALL SELECT event_id, mv."user", event_time, 'move' FROM mv JOIN kp ON kp."user" = mv."user" AND kp.t = mv.event_time""",
    ),
    "j2_calendar": _sql(
        P1 + H + RATINGS + FLAGS
        + """, cal AS (
  SELECT us."user", d, CAST(t AS DATE) AS today FROM (SELECT DISTINCT "user" FROM rt) us, latest,
    LATERAL (SELECT CAST(unnest(generate_series(date_trunc('week', t) - INTERVAL 49 DAY, date_trunc('week', t) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS d))""",
        """SELECT cal."user", strftime(d, '%Y-%m-%d') AS day, coalesce(tier, 'not_active') AS tier, coalesce(total_minutes, 0) AS total_minutes,
  coalesce(nonhuman, FALSE) AS nonhuman, d > today AS is_future
FROM cal LEFT JOIN rt ON rt."user" = cal."user" AND rt.day = strftime(d, '%Y-%m-%d')
LEFT JOIN fl ON fl."user" = cal."user" AND fl.day = strftime(d, '%Y-%m-%d')""",
    ),
    "j5_zscore": _sql(
        P1 + H + f", bl AS ({_baseline()})",
        'SELECT m."user", window_start, ' + ", ".join(f"round(({c} - {c}_mean) / nullif({c}_std, 0), 6) AS {c}_z" for c in FOUR) + ' FROM m JOIN bl ON bl."user" = m."user"',
    ),
    "q_day_metrics": _sql(DAY_MINUTE, "SELECT * FROM dm WHERE day = '2024-01-15' AND \"user\" = 'user-1'"),
    "q_heatmap_day": _sql(HEAT_DAY, "SELECT * FROM hd WHERE day = '2024-01-15' AND \"user\" = 'user-1'"),
    "q_recent_metrics": _sql(M, "SELECT m.* FROM m, latest WHERE window_start >= t - INTERVAL 1440 MINUTE"),
    "r2_stream_metrics": _sql(M, "SELECT * FROM m"),
    "r10_stream_sessions": _sql(
        P0,
        """SELECT session_key, "user", session_start, session_end, window_count, keystrokes_total AS keystrokes, words_total AS words,
  corrections_total AS corrections, clicks_total AS clicks FROM ss""",
    ),
    "s2_decode": _sql(
        "",
        """SELECT type, key, x, y, CASE WHEN type = 'click' THEN 'Button.left' END AS button, CASE WHEN type = 'click' THEN event_id % 2 = 0 END AS pressed,
  CASE WHEN type = 'scroll' THEN CAST(k % 5 - 2 AS BIGINT) END AS dx, CASE WHEN type = 'scroll' THEN CAST(k % 3 - 1 AS BIGINT) END AS dy, "user", event_time FROM c""",
    ),
    "t1_newest_sessions": _sql(P0, 'SELECT * FROM ss ORDER BY session_start DESC, "user", session_id LIMIT 2000'),
    "t6_day_sessions": _sql(
        P0,
        """SELECT session_id, "user", session_start, session_end,
  greatest(1, CAST(round(date_diff('microsecond', session_start, session_end) / 60000000) AS BIGINT)) AS minutes
FROM ss WHERE strftime(session_start, '%Y-%m-%d') = '2024-01-15'""",
    ),
    "t7_default_user": _sql(M, 'SELECT "user" FROM m ORDER BY window_start DESC, "user" LIMIT 1'),
    "t9_latest_mix": _sql(
        M,
        """SELECT "user", window_start, round(clicks / nullif(keystrokes + clicks, 0), 6) AS click_share FROM m
WHERE window_start = (SELECT max(x.window_start) FROM m x WHERE x."user" = m."user")""",
    ),
    "w6_sitting": _sql(H + SITTING, 'SELECT "user", run_start, round(minutes, 6) AS minutes FROM st'),
    "w7_live": _sql(
        P1 + H + SITTING
        + """, nw AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY session_start DESC, session_id DESC) AS n FROM ss, latest WHERE session_start >= date_trunc('day', t)),
fr AS (SELECT "user" FROM m, latest GROUP BY "user" HAVING date_diff('microsecond', max(window_end), any_value(t)) < 7200000000)""",
        """SELECT nw."user", session_id, session_start, run_start FROM nw JOIN st ON st."user" = nw."user" JOIN fr ON fr."user" = nw."user"
WHERE n = 1 AND abs(date_diff('microsecond', run_start, session_start)) < 90000000""",
    ),
}

HUMAN = """ FROM ft WHERE NOT ("user" = 'user-0' AND strftime(window_start, '%Y-%m-%d') = '2024-01-15') AND "user" <> 'demo'"""
FEATURE_LIST = ", ".join(f"round({c}, 6) AS {c}" for c in SEVEN)
HIT = "count(*) FILTER (y = {0} AND p = {1})"
TP, FP, FN, TN = HIT.format(1, 1), HIT.format(0, 1), HIT.format(1, 0), HIT.format(0, 0)
SS_COLUMNS = 'session_id, "user", session_key, session_start, session_end, window_count, ' + ", ".join(f"{c}_total" for c in FOUR)
QUARTERS = """, q AS (SELECT unnest(range(96)) AS i),
tl AS (
  SELECT 'user-1' AS "user", TIMESTAMP '2024-01-15' + i * INTERVAL 15 MINUTE AS window_start, """ + ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in (*FOUR, "mouse_moves")
) + """, count(dm."user") = 0 AS synthetic
  FROM q LEFT JOIN dm ON dm.day = '2024-01-15' AND dm."user" = 'user-1'
    AND dm.window_start >= TIMESTAMP '2024-01-15' + i * INTERVAL 15 MINUTE AND dm.window_start < TIMESTAMP '2024-01-15' + (i + 1) * INTERVAL 15 MINUTE
  GROUP BY i)"""
NO_LIVENESS = P0 + RATINGS + """, cal AS (
  SELECT us."user", d, CAST(t AS DATE) AS today FROM (SELECT DISTINCT "user" FROM rt) us, latest,
    LATERAL (SELECT CAST(unnest(generate_series(date_trunc('week', t) - INTERVAL 49 DAY, date_trunc('week', t) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS d))"""

ORACLE_SQL |= {
    "a15_class_balance": _sql(FEATURES, "SELECT CAST(key_diversity > 0.5 AS DOUBLE) AS label, count(*) AS count FROM ft GROUP BY 1"),
    "a16_metrics": _sql(
        FEATURES + ", pr AS (SELECT CAST(key_diversity > 0.5 AS INT) AS y, CAST(mouse_fraction < 0.5 AS INT) AS p FROM ft)",
        f"""SELECT round(({TP} + {TN}) / count(*), 6) AS accuracy, round(coalesce({TP} / nullif({TP} + {FP}, 0), 0), 6) AS precision,
  round(coalesce({TP} / nullif({TP} + {FN}, 0), 0), 6) AS recall, round(coalesce(2 * {TP} / nullif(2 * {TP} + {FP} + {FN}, 0), 0), 6) AS f1 FROM pr""",
    ),
    "c6_one_user": _sql(M, "SELECT * FROM m WHERE \"user\" = 'user-1'"),
    "f8_parse_iso": _sql(
        "",
        """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN date_trunc('second', event_time) - INTERVAL 2 HOUR
  ELSE date_trunc('second', event_time) END AS event_time FROM c""",
    ),
    "f11_live_minutes": _sql(P0, 'SELECT session_id, "user", greatest(1, CAST(floor(date_diff(\'microsecond\', session_start, t) / 60000000) AS BIGINT)) AS minutes FROM ss, latest'),
    "f14_staleness": _sql(
        M,
        """SELECT "user", newest, CAST(round(date_diff('microsecond', newest, t) / 60000000) AS BIGINT) AS minutes,
  round(date_diff('microsecond', newest, t) / 60000000) > 30 AS pending FROM (SELECT "user", max(window_end) AS newest FROM m GROUP BY "user"), latest""",
    ),
    "j4_display": _sql(
        HEAT_DAY,
        """SELECT *, round(ln(1 + count) / ln(1 + max(count) OVER (PARTITION BY day, "user", type)), 6) AS intensity
FROM hd WHERE cell_x BETWEEN 0 AND 62 AND cell_y BETWEEN 0 AND 43""",
    ),
    "t8_paint_order": _sql(HEAT_DAY, "SELECT * FROM hd WHERE day = '2024-01-15' AND \"user\" = 'user-1' ORDER BY count, cell_x, cell_y"),
    "u1_human_counts": _sql(FEATURES, 'SELECT CAST(0 AS DOUBLE) AS label, "user", count(*) AS count' + HUMAN + ' GROUP BY "user"'),
    "u1_human_rows": _sql(FEATURES, f'SELECT "user", window_start, n_events, {FEATURE_LIST}, CAST(0 AS DOUBLE) AS label' + HUMAN),
    "read_metrics": _sql(M, "SELECT m.* FROM m, latest WHERE window_start >= t - INTERVAL 1440 MINUTE"),
    "read_sessions": _sql(P0, f'SELECT {SS_COLUMNS} FROM ss ORDER BY session_start DESC, "user", session_id LIMIT 2000'),
    "read_baseline": _sql(P0, _baseline(6).replace(" FROM pw", ", any_value(t) AS computed_at FROM pw, latest")),
    "read_heatmap_1d": _sql(
        "",
        """SELECT '1d' AS range, CAST(trunc(x / 16.0) AS INT) AS cell_x, CAST(trunc(y / 16.0) AS INT) AS cell_y, type, "user", count(*) AS count
FROM c, latest WHERE type IN ('move', 'click') AND event_time >= t - INTERVAL 24 HOUR GROUP BY ALL""",
    ),
    "read_heatmap_unknown": _sql("", "SELECT '' AS range, 0 AS cell_x, 0 AS cell_y, type, \"user\", event_id AS count FROM c WHERE FALSE"),
    "read_day_metrics": _sql(DAY_MINUTE, "SELECT * FROM dm WHERE day = '2024-01-15' AND \"user\" = 'user-1'"),
    "read_heatmap_day": _sql(HEAT_DAY, "SELECT * FROM hd WHERE day = '2024-01-15' AND \"user\" = 'user-1'"),
    "read_per_window": _sql(P0, PW),
    "read_display_grid": "SELECT CAST(1728 AS INT) AS width, CAST(1117 AS INT) AS height, CAST(108 AS INT) AS grid_w, CAST(70 AS INT) AS grid_h",
    "read_health": _sql(
        M,
        """SELECT max(window_end) AS newest, round(date_diff('microsecond', max(window_end), any_value(t)) / 1000000 + 90, 6) AS age_s,
  date_diff('microsecond', max(window_end), any_value(t)) + 90000000 < 120000000 AS fresh, any_value(t) AS batch_last_run, CAST(90 AS DOUBLE) AS batch_age_s,
  'ok' AS batch_status, CAST(NULL AS VARCHAR) AS batch_error FROM m, latest""",
    ),
    "read_batch_status": _sql("", "SELECT CAST(1 AS BIGINT) AS run, t AS as_of, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM latest"),
    "read_ml_metrics_none": "SELECT FALSE AS available, CAST(NULL AS DOUBLE) AS accuracy, CAST(NULL AS BIGINT) AS n_train",
    "read_liveness_none": _sql("", "SELECT \"user\", '' AS day, TRUE AS nonhuman, CAST(0 AS DOUBLE) AS score FROM c WHERE FALSE"),
    "read_calendar": _sql(
        NO_LIVENESS,
        """SELECT cal."user", strftime(d, '%Y-%m-%d') AS day, coalesce(tier, 'not_active') AS tier, coalesce(total_minutes, 0) AS total_minutes,
  FALSE AS nonhuman, d > today AS is_future FROM cal LEFT JOIN rt ON rt."user" = cal."user" AND rt.day = strftime(d, '%Y-%m-%d')""",
    ),
    "read_day_timeline": _sql(DAY_MINUTE + QUARTERS, "SELECT * FROM tl"),
    "read_day_gauge": _sql(
        DAY_MINUTE + QUARTERS,
        f"""SELECT "user", count(*) FILTER ({ACTIVE}) AS active_buckets, round(count(*) FILTER ({ACTIVE}) / count(*) * 100, 6) AS active_pct,
  count(*) FILTER ({ACTIVE}) * 15 AS active_minutes, (count(*) - count(*) FILTER ({ACTIVE})) * 15 AS idle_minutes FROM tl GROUP BY "user" """,
    ),
    "read_day_sessions": _sql(P0, f"SELECT {SS_COLUMNS} FROM ss WHERE strftime(session_start, '%Y-%m-%d') = '2024-01-15' AND \"user\" = 'user-1'"),
    "read_day_heatmap": _sql(
        HEAT_DAY + ", od AS (SELECT * FROM hd WHERE day = '2024-01-15' AND \"user\" = 'user-1' AND cell_x BETWEEN 0 AND 107 AND cell_y BETWEEN 0 AND 69)",
        "SELECT *, round(ln(1 + count) / ln(1 + max(count) OVER (PARTITION BY type)), 6) AS intensity FROM od",
    ),
    "k2_archive_sink": ORACLE_SQL["s2_decode"],
    "k4_flagged_days": _sql(FEATURES, "SELECT DISTINCT \"user\", strftime(window_start, '%Y-%m-%d') AS day, TRUE AS scored FROM ft"),
    "k6_model_report": _sql(FEATURES, "SELECT TRUE AS available, count(*) AS n_human, count(*) AS n_split FROM ft"),
    "k7_json_counts": _sql(FEATURES, 'SELECT "user", window_start, CAST(to_json({\'user\': "user", \'n_events\': n_events}) AS VARCHAR) AS record FROM ft'),
    "m5_split_share": _sql(FEATURES, "SELECT CAST(0 AS DOUBLE) AS label, count(*) AS n, TRUE AS a_quarter" + HUMAN),
}

#: Rounds of arrival, the newest event of all earlier rounds, and whether an event's minute had closed when it came.
ARRIVED = """, ar AS (
  SELECT *, least(2, CAST(floor((epoch_us(event_time) - lo) * 3 / (hi - lo + 1)) AS INT) + CASE WHEN event_id % 20 = 7 THEN 1 ELSE 0 END) AS round
  FROM c, (SELECT min(epoch_us(event_time)) AS lo, max(epoch_us(event_time)) AS hi FROM c)),
rn AS (SELECT round, max(event_time) AS newest, count(*) AS n, count(*) FILTER (event_id % 50 = 11) AS bad FROM ar GROUP BY round),
cl AS (SELECT a.round, max(b.newest) AS before FROM rn a LEFT JOIN rn b ON b.round < a.round GROUP BY a.round),
al AS (
  SELECT ar.*, coalesce(date_trunc('minute', event_time) + INTERVAL 1 MINUTE <= before - INTERVAL 5 SECOND, FALSE) AS late
  FROM ar JOIN cl USING (round))"""
_MINUTES = f"SELECT {MINUTE} AS window_start, {MINUTE} + INTERVAL 1 MINUTE AS window_end, \"user\", {COUNTS} FROM al"

ORACLE_SQL |= {
    "r3_ingest_archive": _sql(
        "",
        """SELECT type, key, x, y, CASE WHEN type = 'click' THEN 'Button.left' END AS button, CASE WHEN type = 'click' THEN event_id % 2 = 0 END AS pressed,
  CASE WHEN type = 'scroll' THEN CAST(k % 5 - 2 AS BIGINT) END AS dx, CASE WHEN type = 'scroll' THEN CAST(k % 3 - 1 AS BIGINT) END AS dy, "user", event_time,
  event_id AS source_offset FROM c""",
    ),
    "r3_ingest_quarantine": _sql("", "SELECT 'no event ' || event_id AS raw, 1 AS source_partition, event_id AS source_offset FROM c WHERE event_id % 50 = 11"),
    "r4_live_metrics": _sql(ARRIVED, f"{_MINUTES}, latest WHERE NOT late AND {MINUTE} + INTERVAL 1 MINUTE <= t - INTERVAL 5 SECOND GROUP BY ALL"),
    "r4_missed": _sql(ARRIVED, f"{_MINUTES} WHERE late GROUP BY ALL"),
    "r4_repaired": ORACLE_SQL["a2_minute_metrics"],
    "r5_ledger": _sql(
        ARRIVED + """, lt AS (
  SELECT round, count(*) AS late FROM (SELECT DISTINCT round, date_trunc('minute', event_time), "user" FROM al WHERE late) GROUP BY round)""",
        """SELECT CAST(round AS BIGINT) AS batch, n AS rows, bad, coalesce(late, 0) AS late, max(newest) OVER (ORDER BY round) AS newest
FROM rn LEFT JOIN lt USING (round)""",
    ),
    "a3_incremental": ORACLE_SQL["a3_per_window"],
    "a4_incremental": ORACLE_SQL["a4_sessions"],
    "a5_merged": ORACLE_SQL["a5_baseline"],
    "a6_from_hours": ORACLE_SQL["a6_range_heatmaps"],
    "a7_incremental": ORACLE_SQL["a7_day_minute"],
    "a8_incremental": ORACLE_SQL["a8_heatmap_day"],
    "c14_stream": ORACLE_SQL["c14_thin_moves"].split("SELECT event_id, \"user\", event_time, type FROM c WHERE type <> 'move'")[0]
    + """SELECT c."user", c.event_time, x, y FROM c JOIN kp ON kp."user" = c."user" AND kp.t = c.event_time WHERE type = 'move'""",
    "s1_log_stream": _sql(
        "",
        """SELECT type, "user", event_time, CAST(event_id % 4 AS INT) AS source_partition,
  row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS source_offset FROM c""",
    ),
}
