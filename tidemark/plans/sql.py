"""SQL twins of the operators, as common table expressions to be put together."""

from __future__ import annotations

import re

from tidemark.model import TERMS, DetectorConfig
from tidemark.operators.fold import alpha
from tidemark.plans.settings import COOLDOWN, DETECTOR, EPISODE_MS, THRESHOLD, TRAIN_SHARE, TRIAGE, VALIDATION_SHARE
from tidemark.sources.adapter import AUTH_SQL


def query(*ctes: str, select: str) -> str:
    text = "WITH RECURSIVE " + ",\n".join(c.strip() for c in (AUTH_SQL, *ctes)) + "\n" + select.strip()
    # a plain fraction would be a decimal; all arithmetic here is in doubles
    return re.sub(r"(?<![\w'.])(\d+\.\d+)(?![\w'.])", r"\1e0", text)


def axis(p: str, column: str, c: DetectorConfig = DETECTOR) -> str:
    """Windows ({p}w), gate ({p}g), samples ({p}s), averages ({p}e) and baselines ({p}b) of an axis."""
    return f"""
{p} AS (
  SELECT *, {column} AS key, CAST(status = 'declined' AS INTEGER) AS d, row_number() OVER (PARTITION BY {column} ORDER BY ts, seq) AS rn FROM auth
), {p}w AS (
  SELECT e.seq, e.key, e.ts, e.rn, count(*) AS n, CAST(sum(q.d) AS BIGINT) AS declines, CAST(sum(q.amount_paise) AS BIGINT) AS amount,
         count(DISTINCT q.card_ref) AS cards, count(DISTINCT q.merchant_id) AS merchants
  FROM {p} e JOIN {p} q ON q.key = e.key AND q.rn <= e.rn AND q.rn > e.rn - {c.ring_capacity} AND q.ts > e.ts - {c.window_ms}
  GROUP BY e.seq, e.key, e.ts, e.rn
), {p}t AS (SELECT key, ts, min(rn) AS rn FROM {p} GROUP BY key, ts),
{p}n AS MATERIALIZED (
  SELECT a.key, a.rn, t.rn AS nrn FROM {p} a ASOF JOIN {p}t t ON a.key = t.key AND a.ts + {c.sample_interval_ms} <= t.ts
), {p}g AS (
  SELECT key, rn FROM {p} WHERE rn = 1
  UNION ALL SELECT x.key, x.nrn FROM {p}g g JOIN {p}n x ON x.key = g.key AND x.rn = g.rn
), {p}s AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.key ORDER BY w.rn) AS k FROM {p}w w JOIN {p}g g ON g.key = w.key AND g.rn = w.rn
), {p}e AS (
  SELECT key, k, CAST(n AS DOUBLE) AS v FROM {p}s WHERE k = 1
  UNION ALL SELECT s.key, s.k, e.v + {alpha(c.halflife_samples)!r} * (s.n - e.v) FROM {p}e e JOIN {p}s s ON s.key = e.key AND s.k = e.k + 1
), {p}b AS (
  SELECT x.*, coalesce(e.v, 0.0) AS ewma FROM (
    SELECT w.*, s.k IS NOT NULL AS gated, count(s.k) OVER o AS samples, coalesce(avg(CAST(s.n AS DOUBLE)) OVER o, 0.0) AS mean,
           coalesce(sqrt(var_samp(CAST(s.n AS DOUBLE)) OVER o), 0.0) AS spread,
           coalesce(avg(CAST(s.declines AS DOUBLE) / s.n) OVER o, 0.0) AS base_ratio, coalesce(avg(CAST(s.amount AS DOUBLE) / s.n) OVER o, 0.0) AS base_amount
    FROM {p}w w LEFT JOIN {p}s s ON s.key = w.key AND s.rn = w.rn
    WINDOW o AS (PARTITION BY w.key ORDER BY w.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  ) x LEFT JOIN {p}e e ON e.key = x.key AND e.k = x.samples
)"""


def global_baseline(c: DetectorConfig = DETECTOR) -> str:
    return f"""
ga AS (SELECT w.seq, w.ts, w.n, row_number() OVER (ORDER BY w.ts, w.seq) AS rn FROM bw w),
gt AS (SELECT ts, min(rn) AS rn FROM ga GROUP BY ts),
gn AS MATERIALIZED (SELECT a.rn, t.rn AS nrn FROM ga a ASOF JOIN gt t ON a.ts + {c.sample_interval_ms} <= t.ts),
gg AS (SELECT CAST(1 AS BIGINT) AS rn UNION ALL SELECT gn.nrn FROM gg JOIN gn ON gn.rn = gg.rn),
gb AS (
  SELECT a.seq, count(g.rn) OVER o AS samples, coalesce(avg(CASE WHEN g.rn IS NOT NULL THEN CAST(a.n AS DOUBLE) END) OVER o, 0.0) AS mean,
         coalesce(sqrt(var_samp(CASE WHEN g.rn IS NOT NULL THEN CAST(a.n AS DOUBLE) END) OVER o), 0.0) AS spread
  FROM ga a LEFT JOIN gg g ON g.rn = a.rn WINDOW o AS (ORDER BY a.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


def long_window(c: DetectorConfig) -> str:
    return f"""
lw AS (
  SELECT e.seq, count(*) AS events, count(DISTINCT q.card_ref) AS cards FROM auth e
  JOIN auth q ON q.bin = e.bin AND q.ts > e.ts - {c.long_window_ms} AND (q.ts < e.ts OR (q.ts = e.ts AND q.seq <= e.seq)) GROUP BY e.seq
)"""


def trailing(keys_match: str, span: int, source: str = "auth") -> str:
    return f"""
tr AS (
  SELECT e.seq, count(*) AS events, count(DISTINCT q.card_ref) AS cards FROM {source} e
  JOIN {source} q ON {keys_match} AND q.ts >= e.ts - {span} AND (q.ts < e.ts OR (q.ts = e.ts AND q.seq <= e.seq)) GROUP BY e.seq
)"""


def scored(c: DetectorConfig = DETECTOR) -> list[str]:
    """CTEs up to ``sc``: every event with terms, score and evidence."""
    parts = [axis("b", "bin", c), axis("p", "ip", c)]
    joins = "JOIN bb ON bb.seq = a.seq JOIN pb ON pb.seq = a.seq"
    if c.use_ewma:
        bz = f"CASE WHEN bb.samples >= {c.min_samples} AND bb.spread > 1e-9 THEN (bb.n - bb.ewma) / bb.spread ELSE 0.0 END"
        iz = f"CASE WHEN pb.samples >= {c.min_samples} AND pb.spread > 1e-9 THEN (pb.n - pb.ewma) / pb.spread ELSE 0.0 END"
        warm, centre = f"bb.samples >= {c.min_samples}", "bb.ewma"
    else:
        parts.append(global_baseline(c))
        joins += " JOIN gb ON gb.seq = a.seq"
        bz, iz = (f"CASE WHEN gb.samples >= {c.min_samples} AND gb.spread > 1e-9 THEN ({x}.n - gb.mean) / gb.spread ELSE 0.0 END" for x in ("bb", "pb"))
        warm, centre = "true", "gb.mean"
    if not c.use_per_ip:
        iz = "0.0"
    cards, events, weight = "bb.cards", "bb.n", c.w_repetition
    if c.long_window_ms:
        parts.append(long_window(c))
        joins += " JOIN lw ON lw.seq = a.seq"
        cards, events, weight = "lw.cards", "lw.events", c.w_long_repetition
    known = f"bb.samples >= {c.min_samples}"
    ratio, mean = "CAST(bb.declines AS DOUBLE) / bb.n", "CAST(bb.amount AS DOUBLE) / bb.n"
    parts.append(f"""
ev AS (
  SELECT a.*, bb.n AS window_events, bb.declines AS window_declines, bb.amount AS window_amount, {ratio} AS window_decline_ratio, {mean} AS mean_amount, {centre} AS baseline_window_events,
         bb.cards AS window_distinct_cards, bb.merchants AS window_distinct_merchants, {warm} AS warm, {bz} AS bz, {iz} AS iz,
         CASE WHEN {known} THEN bb.base_ratio ELSE 0.0 END AS baseline_decline_ratio, CASE WHEN {known} THEN bb.base_amount ELSE 0.0 END AS baseline_amount_mean_paise,
         greatest(0.0, 1.0 / greatest(CAST({cards} AS DOUBLE) / {events}, 1e-9) - 1.0) AS retry
  FROM auth a {joins}
), tm AS (
  SELECT *, {c.w_velocity_bin!r} * greatest(0.0, bz) AS velocity_bin,
         {c.w_decline_bin!r} * (CASE WHEN warm THEN greatest(0.0, window_decline_ratio - baseline_decline_ratio) ELSE 0.0 END) * 10.0 AS decline_bin,
         {c.w_amount!r} * (CASE WHEN warm AND baseline_amount_mean_paise > 0 AND mean_amount > 0 THEN greatest(0.0, ln(baseline_amount_mean_paise / mean_amount)) ELSE 0.0 END) AS amount,
         {c.w_velocity_ip!r} * greatest(0.0, iz) AS velocity_ip, -{weight!r} * retry + 0.0 AS repetition,
         -{c.w_merchant_span!r} * greatest(0.0, window_distinct_merchants - 1.0) + 0.0 AS merchant_span
  FROM ev
), sc AS (SELECT *, ((((velocity_bin + decline_bin) + amount) + velocity_ip) + repetition) + merchant_span AS score FROM tm)""")
    return parts


def split_scored() -> list[str]:
    """``bd`` (boundaries), and ``vs`` and ``te``: scored validation and test rows."""
    return [
        *scored(),
        f"""
b0 AS (SELECT min(ts) AS first, min(ts) + CAST(floor(CAST(max(ts) - min(ts) AS DOUBLE) * {TRAIN_SHARE!r}) AS BIGINT) AS boundary FROM auth),
bd AS (SELECT boundary, first + CAST(floor(CAST((SELECT max(ts) FROM auth, b0 WHERE ts < boundary) - first AS DOUBLE) * {1 - VALIDATION_SHARE!r}) AS BIGINT) AS vstart FROM b0),
vs AS (SELECT sc.* FROM sc, bd WHERE ts >= vstart AND ts < boundary),
te AS (SELECT sc.* FROM sc, bd WHERE ts >= boundary)""",
    ]


SWEEP = f"""
ends AS (SELECT quantile_cont(score, 0.75) AS lo, max(score) AS hi, greatest((max(ts) - min(ts)) / 86400000.0, 1e-9) AS days,
                count(*) FILTER (WHERE label = 1) AS bad FROM vs),
th AS (SELECT CAST(k AS INTEGER) AS k, CASE WHEN k = 599 THEN hi ELSE lo + k * ((hi - lo) / 599) END AS theta FROM ends, range(600) r(k)),
cand AS (SELECT vs.* FROM vs, ends WHERE score > lo),
hits AS (SELECT th.k, c.*, lag(c.ts) OVER (PARTITION BY th.k, c.merchant_id, c.bin ORDER BY c.ts, c.seq) AS past FROM th JOIN cand c ON c.score > th.theta),
sw0 AS (
  SELECT k, count(*) FILTER (WHERE past IS NULL OR ts - past > {COOLDOWN}) AS alerts, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label = 0) AS fp,
         count(*) FILTER (WHERE label = 1) AS n_fraud, count(*) FILTER (WHERE label = 1 AND status = 'approved') AS n_fraud_approved,
         coalesce(sum(amount_paise) FILTER (WHERE label = 1 AND status = 'approved'), 0) AS fa, coalesce(sum(amount_paise) FILTER (WHERE label = 0 AND status = 'approved'), 0) AS ga
  FROM hits GROUP BY k
), sw AS (
  SELECT th.k, theta AS threshold, coalesce(alerts, 0) AS alerts, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp,
         coalesce(n_fraud * 150.0 + 0.8 * (n_fraud_approved * 50000.0 + 1.0 * fa) - 0.25 * ga, 0.0) AS gross_paise
  FROM th LEFT JOIN sw0 ON sw0.k = th.k
), sweep AS (
  SELECT k, threshold, gross_paise, gross_paise - alerts * 4000.0 AS net_paise, alerts, alerts / days AS alerts_per_day,
         CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN bad > 0 THEN tp / CAST(bad AS DOUBLE) ELSE 0.0 END AS recall,
         CASE WHEN alerts > 0 THEN gross_paise / alerts ELSE 0.0 END AS break_even_paise
  FROM sw, ends
)"""


def selection(budgets: list[float]) -> str:
    values = ", ".join(f"({float(b)!r})" for b in budgets)
    return f"""
bg_ AS (SELECT * FROM (VALUES {values}) v(budget)),
pr AS (SELECT s.*, b.budget, s.alerts_per_day <= b.budget AS fits, max(s.net_paise) FILTER (WHERE s.alerts_per_day <= b.budget) OVER (PARTITION BY b.budget) AS best FROM sweep s, bg_ b),
chosen AS (
  SELECT *, best IS NULL AS infeasible FROM pr
  QUALIFY row_number() OVER (PARTITION BY budget ORDER BY
    CASE WHEN best IS NULL THEN alerts_per_day WHEN best <= 0 THEN CASE WHEN fits THEN -net_paise ELSE 1e300 END ELSE CASE WHEN fits AND net_paise >= best * 0.95 THEN 0 ELSE 1 END END, k) = 1
)"""


FLAGGED = f"fl AS (SELECT * FROM te WHERE score > {THRESHOLD})"
EPISODES = f"ep AS (SELECT scenario_id, min(ts) AS start_ms, max(ts) AS end_ms FROM auth WHERE label = 1 GROUP BY scenario_id, ts // {EPISODE_MS})"

TRIAGE_SQL = [
    *split_scored(),
    trailing("q.merchant_id = e.merchant_id AND q.bin = e.bin", TRIAGE.trailing_ms, "te"),
    f"""
tf AS (
  SELECT t.*, tr.events AS trail_events, tr.cards AS trail_cards, round(CAST(tr.events AS DOUBLE) / tr.cards, 4) AS retry_ratio,
         row_number() OVER w AS rn, lag(t.ts) OVER w AS past
  FROM te t JOIN tr ON tr.seq = t.seq WHERE t.score > {THRESHOLD} WINDOW w AS (PARTITION BY t.merchant_id, t.bin ORDER BY t.ts, t.seq)
), kk AS (
  SELECT merchant_id, bin, rn, seq, CASE WHEN trail_events >= {TRIAGE.min_events} AND retry_ratio >= {TRIAGE.retry_ratio} THEN ts + {TRIAGE.kill_cooldown_ms} ELSE -1 END AS until,
         trail_events >= {TRIAGE.min_events} AND retry_ratio >= {TRIAGE.retry_ratio} AS now, false AS held FROM tf WHERE rn = 1
  UNION ALL
  SELECT f.merchant_id, f.bin, f.rn, f.seq,
         CASE WHEN f.ts >= k.until AND f.trail_events >= {TRIAGE.min_events} AND f.retry_ratio >= {TRIAGE.retry_ratio} THEN f.ts + {TRIAGE.kill_cooldown_ms} ELSE k.until END,
         f.ts >= k.until AND f.trail_events >= {TRIAGE.min_events} AND f.retry_ratio >= {TRIAGE.retry_ratio}, f.ts < k.until
  FROM kk k JOIN tf f ON f.merchant_id = k.merchant_id AND f.bin = k.bin AND f.rn = k.rn + 1
), rt AS (
  SELECT f.*, k.held OR k.now AS tripped, k.now AS tripped_now, past IS NULL OR ts - past > {TRIAGE.dedup_cooldown_ms} AS new_alert,
         CASE WHEN status = 'approved' THEN 0.8 * (50000.0 + 1.0 * amount_paise) ELSE 150.0 END AS exposure_paise,
         CASE WHEN k.held OR k.now THEN 'alert_only' ELSE 'inline' END AS mode
  FROM tf f JOIN kk k ON k.seq = f.seq
), rd AS (SELECT *, CASE WHEN mode = 'inline' THEN 'decline' WHEN new_alert THEN 'alert' ELSE 'alert_dedup' END AS decision FROM rt)""",
]
TERM_LIST = ", ".join(f"round({t}, 6) + 0.0 AS {t}" for t in TERMS)
