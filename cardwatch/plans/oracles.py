"""SQL with the same results as the registered queries, written the direct way: range frames and interval self-joins."""

from __future__ import annotations

from cardwatch import schema as S
from cardwatch.operators import scoring
from cardwatch.plans.catalog import TODAY
from cardwatch.sources.transactions import EVENT_COLUMNS

TX = "tx AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in EVENT_COLUMNS.items()) + " FROM events)"


def r(expression: str, digits: int = 6) -> str:
    """Rounded, and without a negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def d(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def rounded_list(names, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


CENTS = "CAST(amount AS DECIMAL(18,2))"
MONEY = f"CAST(sum({CENTS}) OVER w24 AS DOUBLE)"
VELOCITY = f"""velocity AS (SELECT transaction_id,
  count(*) OVER w1 - 1 AS feat_tx_count_user_1h,
  count(*) OVER w24 - 1 AS feat_tx_count_user_24h,
  {r(f"{MONEY} - amount", 2)} AS feat_amount_sum_user_24h,
  {r(f"{MONEY} / count(*) OVER w24")} AS feat_amount_avg_user_24h,
  {d("COALESCE((epoch_us(ts) - lag(epoch_us(ts)) OVER wu) / 60000000.0, 999999)")} AS feat_time_since_last_tx_mins,
  count(*) OVER wm - 1 AS feat_tx_count_merchant_1h
FROM tx WINDOW
  w1 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
  w24 AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW),
  wm AS (PARTITION BY merchant_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
  wu AS (PARTITION BY user_id ORDER BY ts, transaction_id))"""


def distinct_cte(name: str, key: str, value: str, hours: int) -> str:
    return f"""{name}_cte AS (SELECT a.transaction_id, count(DISTINCT b.{value}) AS {name}
FROM tx a LEFT JOIN tx b ON a.{key} = b.{key} AND b.ts >= a.ts - INTERVAL {hours} HOUR AND b.ts < a.ts
GROUP BY a.transaction_id)"""


DEVICE_USERS = distinct_cte("feat_unique_users_per_device_24h", "device_id", "user_id", 24)
DEVICE_COUNTRIES = distinct_cte("feat_unique_countries_per_device_7d", "device_id", "country", 168)
DEVICE_COUNTRIES_24H = distinct_cte("feat_unique_countries_per_device_24h", "device_id", "country", 24)
IP_USERS = distinct_cte("feat_unique_users_per_ip_24h", "ip_id", "user_id", 24)
USER_COUNTRIES = distinct_cte("feat_unique_countries_user_7d", "user_id", "country", 168)
AGES = f"""ages AS (SELECT transaction_id,
  {r("(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY device_id)) / 86400000000.0")} AS feat_device_age_days,
  {r("(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY ip_id)) / 86400000000.0")} AS feat_ip_age_days
FROM tx)"""
CHANGE = """changes AS (SELECT transaction_id,
  CASE WHEN country != lag(country) OVER w THEN 1 ELSE 0 END AS feat_country_change,
  CASE WHEN country IS DISTINCT FROM lag(country) OVER w THEN 1 ELSE 0 END AS country_change_first_is_change,
  CASE WHEN country IN ('NG', 'PK', 'BD', 'VN', 'ID') THEN 1 ELSE 0 END AS feat_is_high_risk_country
FROM tx WINDOW w AS (PARTITION BY user_id ORDER BY ts, transaction_id))"""
ENTROPY = f"""seen AS (SELECT a.transaction_id, b.country, count(*) AS k
FROM tx a JOIN tx b ON a.user_id = b.user_id
  AND (b.ts < a.ts OR (b.ts = a.ts AND b.transaction_id < a.transaction_id)) GROUP BY 1, 2),
shares AS (SELECT transaction_id, k / {d("sum(k) OVER (PARTITION BY transaction_id)")} AS p FROM seen),
entropy AS (SELECT t.transaction_id, {r("COALESCE(h, 0)")} AS feat_user_country_entropy
FROM tx t LEFT JOIN (SELECT transaction_id, -sum(p * log2(p)) AS h FROM shares GROUP BY 1) USING (transaction_id))"""


def past_rate(key: str, extra: int) -> str:
    frame = f"(PARTITION BY {key} ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bottom = f"NULLIF(count(*) OVER {frame} + {extra}, 0)"
    return d(f"COALESCE({d(f'sum(is_fraud) OVER {frame}')} / {bottom}, 0)")


RISK = f"""risk AS (SELECT transaction_id,
  {past_rate("user_id", 0)} AS feat_user_fraud_rate_historical,
  {past_rate("merchant_id", 0)} AS feat_merchant_fraud_rate_historical,
  {past_rate("device_id", 0)} AS feat_device_fraud_rate_historical FROM tx)"""


def known_rate(key: str, alias: str) -> str:
    return f"""{alias}_known AS (SELECT a.transaction_id, count(b.transaction_id) AS known
FROM tx a LEFT JOIN tx b ON a.{key} = b.{key} AND b.is_fraud = 1 AND b.chargeback_ts < a.ts GROUP BY 1),
{alias}_past AS (SELECT transaction_id, count(*) OVER (PARTITION BY {key} ORDER BY ts, transaction_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM tx),
{alias}_rate AS (SELECT transaction_id,
  {d("COALESCE(" + d("known") + " / NULLIF(past, 0), 0)")} AS {alias}_fraud_rate_label_aware
FROM {alias}_known JOIN {alias}_past USING (transaction_id))"""


def full_z(key: str) -> str:
    w = f"OVER (PARTITION BY {key})"
    return r(f"(amount - avg(amount) {w}) / (stddev_samp(amount) {w} + 1)")


def past_z(key: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return r(f"COALESCE((amount - avg(amount) {w}) / (stddev_samp(amount) {w} + 1), 0)")


Z_FULL = f"""zscore AS (SELECT transaction_id, {full_z("user_id")} AS feat_amount_vs_user_avg,
  {full_z("merchant_id")} AS feat_amount_vs_merchant_avg FROM tx)"""
Z_PAST = f"""zscore AS (SELECT transaction_id, {past_z("user_id")} AS feat_amount_vs_user_avg,
  {past_z("merchant_id")} AS feat_amount_vs_merchant_avg FROM tx)"""
PERCENTILE_FULL = f"""percentile AS (SELECT transaction_id,
  {r("(rank() OVER (PARTITION BY user_id ORDER BY amount) "
     "+ (count(*) OVER (PARTITION BY user_id, amount) - 1) / 2.0) / count(*) OVER (PARTITION BY user_id)")}
  AS feat_amount_percentile_user FROM tx)"""
PERCENTILE_PAST = f"""below AS (SELECT a.transaction_id, count(b.transaction_id) AS past,
  count(b.transaction_id) FILTER (WHERE b.amount < a.amount) AS smaller,
  count(b.transaction_id) FILTER (WHERE b.amount = a.amount) AS same
FROM tx a LEFT JOIN tx b ON a.user_id = b.user_id
  AND (b.ts < a.ts OR (b.ts = a.ts AND b.transaction_id < a.transaction_id)) GROUP BY 1),
percentile AS (SELECT transaction_id, {r("CASE WHEN past = 0 THEN 0.5 "
     "ELSE CAST(smaller + (same + 2) / 2.0 AS DOUBLE) / (past + 1) END")} AS feat_amount_percentile_user FROM below)"""
HOUR = "CAST(hour(ts) AS INT)"
DAY = "CAST(isodow(ts) - 1 AS INT)"
ROWS = f"""row_features AS (SELECT transaction_id,
  CASE WHEN amount < 10 THEN 1 ELSE 0 END AS feat_is_small_amount,
  CASE WHEN amount > 500 THEN 1 ELSE 0 END AS feat_is_large_amount,
  {HOUR} AS feat_hour, {DAY} AS feat_day_of_week,
  CASE WHEN {DAY} IN (5, 6) THEN 1 ELSE 0 END AS feat_is_weekend,
  CASE WHEN {HOUR} BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS feat_is_night,
  {r(f"sin(2 * pi() * {HOUR} / 24)")} AS feat_hour_sin, {r(f"cos(2 * pi() * {HOUR} / 24)")} AS feat_hour_cos,
  {r(f"sin(2 * pi() * {DAY} / 7)")} AS feat_day_sin, {r(f"cos(2 * pi() * {DAY} / 7)")} AS feat_day_cos FROM tx)"""


def joined(name: str, columns: list[str], tables: list[str]) -> str:
    joins = " ".join(f"JOIN {t} USING (transaction_id)" for t in tables)
    return f"{name} AS (SELECT transaction_id, {', '.join(columns)} FROM tx {joins})"


FAMILY_CTES = [
    VELOCITY, DEVICE_USERS, DEVICE_COUNTRIES, IP_USERS, AGES, CHANGE, USER_COUNTRIES, ENTROPY, RISK, ROWS,
]
FAMILY_TABLES = [
    "velocity", "feat_unique_users_per_device_24h_cte", "feat_unique_countries_per_device_7d_cte",
    "feat_unique_users_per_ip_24h_cte", "ages", "changes", "feat_unique_countries_user_7d_cte", "entropy", "risk",
    "row_features", "zscore", "percentile",
]
FEATURES_FULL = [TX, *FAMILY_CTES, Z_FULL, PERCENTILE_FULL, joined("features", S.ALL_FEATURES, FAMILY_TABLES)]
FEATURES_PAST = [TX, *FAMILY_CTES, Z_PAST, PERCENTILE_PAST, joined("features", S.ALL_FEATURES, FAMILY_TABLES)]


def points(rules: dict[str, int]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in rules.items())


def rule_score(rules: dict[str, int]) -> str:
    return r(f"1 / (1 + exp(-(CAST({points(rules)} AS DOUBLE) - {scoring.RULE_CENTER}) / {scoring.RULE_SCALE}))")


RULE_INPUTS = [
    TX, VELOCITY, DEVICE_USERS, CHANGE, RISK, ROWS,
    """inputs AS (SELECT tx.*, feat_tx_count_user_1h, feat_time_since_last_tx_mins, feat_country_change,
  feat_unique_users_per_device_24h, d.rate AS feat_device_fraud_rate_historical, feat_is_high_risk_country,
  feat_is_large_amount, feat_is_night
FROM tx JOIN velocity USING (transaction_id) JOIN feat_unique_users_per_device_24h_cte USING (transaction_id)
JOIN changes USING (transaction_id) JOIN row_features USING (transaction_id)
JOIN (SELECT transaction_id, """
    + past_rate("device_id", 0)
    + """ AS rate FROM tx) d USING (transaction_id))""",
]
SCORED = [*RULE_INPUTS, f"scored AS (SELECT *, {rule_score(scoring.CHAMPION)} AS fraud_score FROM inputs)"]
MODELS = [
    *RULE_INPUTS,
    f"""models AS (SELECT *, 'champion' AS model, {rule_score(scoring.CHAMPION)} AS fraud_score FROM inputs
UNION ALL SELECT *, 'challenger' AS model, {rule_score(scoring.CHALLENGER)} AS fraud_score FROM inputs)""",
]


def renewed(key: str) -> str:
    """A key that counts as a new one after more than seven days without activity."""
    return f"CAST({key} AS VARCHAR) || '#' || CAST(sum({key}_gap) OVER (PARTITION BY {key} ORDER BY ts, transaction_id) AS VARCHAR)"


KEYS = ["user_id", "merchant_id", "device_id", "ip_id"]
GAPS = ", ".join(
    f"CASE WHEN ts - lag(ts) OVER (PARTITION BY {k} ORDER BY ts, transaction_id) > INTERVAL 7 DAY THEN 1 ELSE 0 END AS {k}_gap"
    for k in KEYS
)
#: What a store with a time to live of seven days sees: rows in the order of time, idle keys as new ones.
LIVE = [
    TX.replace("tx AS", "given AS", 1),
    f"gaps AS (SELECT *, {GAPS} FROM given)",
    "tx AS (SELECT * EXCLUDE (" + ", ".join(f"{k}_gap" for k in KEYS) + ") REPLACE ("
    + ", ".join(f"{renewed(k)} AS {k}" for k in KEYS) + ") FROM gaps)",
]
LIVE_SCORED = [*LIVE, *SCORED[1:]]
CLOSED = "(epoch_us(ts) + 999) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM given)"
STORE_NAMES = [
    *["feat_tx_count_user_1h", "feat_tx_count_user_24h", "feat_amount_sum_user_24h", "feat_amount_avg_user_24h"],
    *["feat_unique_countries_user_7d", "feat_time_since_last_tx_mins", "feat_country_change"],
    *["feat_user_fraud_rate_historical", "feat_tx_count_merchant_1h", "feat_merchant_fraud_rate_historical"],
    *["feat_unique_users_per_device_24h", "feat_unique_countries_per_device_7d", "feat_device_age_days"],
    *["feat_device_fraud_rate_historical", "feat_unique_users_per_ip_24h", "feat_ip_age_days"],
]


def sliding(width: str, slide: str, copies: int, minutes: int) -> str:
    """Alerts per window of closed counts, from the scores."""
    return f"""steps AS (SELECT time_bucket(INTERVAL {slide}, ts) AS step, count(*) AS n,
  count(*) FILTER (WHERE fraud_score >= 0.95) AS alerts FROM scored GROUP BY 1),
starts AS (SELECT DISTINCT step - to_minutes(CAST(i * {minutes} AS INT)) AS window_start FROM steps, range({copies}) g(i))
SELECT window_start, window_start + INTERVAL {width} AS window_end, CAST(sum(n) AS BIGINT) AS transactions,
  CAST(sum(alerts) AS BIGINT) AS alerts FROM starts JOIN steps ON step >= window_start AND step < window_start + INTERVAL {width}
WHERE window_start + INTERVAL {width} <= (SELECT max(ts) FROM given) - INTERVAL 10 MINUTE GROUP BY 1"""


SIDES = """sides AS (SELECT transaction_id, CASE WHEN row_number() OVER (ORDER BY ts, transaction_id)
  <= CAST(floor(count(*) OVER () * 0.75) AS BIGINT) THEN 'baseline' ELSE 'production' END AS side FROM tx)"""
SIDED = [*SCORED, SIDES, "sided AS (SELECT scored.*, side FROM scored JOIN sides USING (transaction_id))"]
PRODUCTION = [*SIDED, "production AS (SELECT * FROM sided WHERE side = 'production')"]


def grid(size: int) -> str:
    return (
        f"grid AS (SELECT CASE WHEN i = {size - 1} THEN {d('0.99')} "
        f"ELSE {d('0.01')} + i * (({d('0.99')} - {d('0.01')}) / {size - 1}) END AS threshold FROM range({size}) g(i))"
    )


def fixed(thresholds: list[float]) -> str:
    values = ", ".join(f"({d(str(t))})" for t in thresholds)
    return f"grid AS (SELECT threshold FROM (VALUES {values}) v(threshold))"


def guarded(top: str, bottom: str) -> str:
    return f"COALESCE({d(top)} / NULLIF({d(bottom)}, 0), 0)"


def metric_ctes(source: str, by: str = "") -> str:
    """Metrics by scanning the table once per threshold."""
    group = f"{by}, " if by else ""
    return f"""confusion AS (SELECT {group}threshold, count(*) AS n,
  count(*) FILTER (WHERE fraud_score >= threshold AND is_fraud = 1) AS tp,
  count(*) FILTER (WHERE fraud_score >= threshold AND is_fraud = 0) AS fp,
  count(*) FILTER (WHERE fraud_score < threshold AND is_fraud = 0) AS tn,
  count(*) FILTER (WHERE fraud_score < threshold AND is_fraud = 1) AS fn,
  {d(f"COALESCE(sum({CENTS}) FILTER (WHERE fraud_score >= threshold AND is_fraud = 1), 0)")} AS caught,
  {d(f"COALESCE(sum({CENTS}) FILTER (WHERE fraud_score < threshold AND is_fraud = 1), 0)")} AS missed,
  {d(f"COALESCE(sum({CENTS}) FILTER (WHERE is_fraud = 1), 0)")} AS total,
  {d(f"COALESCE(sum({CENTS}) FILTER (WHERE fraud_score >= threshold AND is_fraud = 0), 0)")} AS blocked
FROM {source}, grid GROUP BY ALL),
raw_metrics AS (SELECT {group}threshold, {guarded("tp", "tp + fp")} AS precision, {guarded("tp", "tp + fn")} AS recall,
  {guarded("fp", "fp + tn")} AS fpr, tp AS true_positives, fp AS false_positives, tn AS true_negatives,
  fn AS false_negatives, caught AS fraud_caught_dollars, missed AS fraud_missed_dollars, total AS total_fraud_dollars,
  {guarded("caught", "total")} * 100 AS dollar_recall, blocked AS legit_blocked_dollars,
  {guarded("tn + fn", "n")} * 100 AS approval_rate, tp + fp AS blocked_transactions FROM confusion),
metrics AS (SELECT *, {guarded("2 * precision * recall", "precision + recall")} AS f1 FROM raw_metrics)"""


METRIC_COUNTS = ["true_positives", "false_positives", "true_negatives", "false_negatives", "blocked_transactions"]
METRIC_DOUBLES = [
    "threshold", "precision", "recall", "fpr", "f1", "fraud_caught_dollars", "fraud_missed_dollars",
    "total_fraud_dollars", "dollar_recall", "legit_blocked_dollars", "approval_rate",
]
METRIC_SELECT = f"SELECT {', '.join(METRIC_COUNTS)}, {rounded_list(METRIC_DOUBLES)} FROM metrics"


def best(strategy: str, condition: str, target: str) -> str:
    return f"""SELECT '{strategy}' AS strategy, {r("COALESCE(threshold, 0.5)")} AS threshold,
  {r("COALESCE(value, 0)")} AS value
FROM (SELECT 1) LEFT JOIN (SELECT threshold, round({target}, 12) AS value FROM metrics
  WHERE {condition} AND round({target}, 12) > 0 ORDER BY value DESC, threshold LIMIT 1) ON true"""


def comparison_sql() -> str:
    strategies = {"F1": ("true", "f1"), "80% Recall": ("recall >= 0.8", "precision"), "1% FPR": ("fpr <= 0.01", "recall")}
    picks = " UNION ALL ".join(
        f"SELECT model, '{s}' AS strategy, threshold, row_number() OVER (PARTITION BY model "
        f"ORDER BY CASE WHEN {c} AND round({t}, 12) > 0 THEN 0 WHEN threshold = 0.5 THEN 1 ELSE 2 END, "
        f"round({t}, 12) DESC, threshold) AS place FROM metrics WHERE threshold = 0.5 "
        f"OR ({c} AND round({t}, 12) > 0)"
        for s, (c, t) in strategies.items()
    )
    # The fallback 0.5 is no grid point: it must not win while another threshold qualifies.
    picks = picks.replace(
        "THEN 0 WHEN threshold = 0.5 THEN 1 ELSE 2 END", "AND threshold != 0.5 THEN 0 ELSE 1 END"
    )
    doubles = [
        "threshold", "precision", "recall", "fpr", "dollar_recall", "approval_rate", "fraud_caught_dollars",
        "fraud_missed_dollars", "legit_blocked_dollars",
    ]
    body = ", ".join(f"{r('m.' + n, 3)} AS {n}" for n in doubles)
    grid_all = grid(100).replace("grid AS (", "grid AS (SELECT CAST(0.5 AS DOUBLE) AS threshold UNION ALL ")
    return (
        with_(*MODELS, grid_all, metric_ctes("models", "model"), f"picks AS ({picks})")
        + f"SELECT p.model, p.strategy, {body}, m.true_positives, m.false_positives, m.false_negatives, "
        "m.true_negatives FROM picks p JOIN metrics m ON p.model = m.model AND p.threshold = m.threshold "
        "WHERE place = 1"
    )


def roi_sql() -> str:
    a, c, m = "(true_positives + false_positives)", "fraud_caught_dollars", "fraud_missed_dollars"
    money = {
        "fraud_prevented": c, "fraud_missed": m, "total_fraud": "total_fraud_dollars", "review_cost": f"{a} * 25.0",
        "net_benefit": f"{c} - {a} * 25.0", "roi_percent": guarded(f"{c} - {a} * 25.0", f"{a} * 25.0") + " * 100",
        "monthly_prevented": f"{c} / 3", "monthly_review_cost": f"{a} * 25.0 / 3",
        "monthly_net_benefit": f"({c} - {a} * 25.0) / 3", "monthly_alerts": f"{a} / 3.0",
        "annual_prevented": f"{c} * 4", "annual_review_cost": f"{a} * 100.0",
        "annual_net_benefit": f"({c} - {a} * 25.0) * 4", "annual_alerts": f"{a} * 4.0",
        "dollars_per_case": guarded(c, "true_positives"), "dollars_per_alert": guarded(c, a),
        "annual_loss_without_model": "total_fraud_dollars * 4", "annual_loss_with_model": f"{m} * 4",
        "annual_savings": f"{c} * 4",
    }
    columns = ", ".join(f"{r(e, 2)} AS {n}" for n, e in money.items())
    return (
        with_(*SCORED, fixed([0.5, 0.95]), metric_ctes("scored"))
        + f"SELECT {r('threshold', 2)} AS threshold, {a} AS alerts, {columns} FROM metrics"
    )


def segment_sql() -> str:
    band = "CASE WHEN amount < 10 THEN 'small' WHEN amount > 500 THEN 'large' ELSE 'medium' END"
    union = " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, {e} AS segment, fraud_score, is_fraud, amount FROM scored"
        for name, e in {"country": "country", "mcc": "mcc", "amount_band": band}.items()
    )
    return (
        with_(*SCORED, f"segments AS ({union})", fixed([0.95]), metric_ctes("segments", "dimension, segment"))
        + METRIC_SELECT.replace("SELECT", "SELECT dimension, segment,", 1)
    )


def daily(source: str, threshold: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    hit = f"fraud_score >= {threshold}"
    return f"""daily AS (SELECT {group}CAST(ts AS DATE) AS day, count(*) AS transactions,
  count(*) FILTER (WHERE {hit}) AS alerts, CAST(sum(is_fraud) AS BIGINT) AS frauds,
  count(*) FILTER (WHERE {hit} AND is_fraud = 1) AS caught FROM {source} GROUP BY ALL),
kpis AS (SELECT {group}day, transactions, alerts, frauds,
  {r(guarded("transactions - alerts", "transactions") + " * 100")} AS approval_rate,
  {r(guarded("caught", "frauds") + " * 100")} AS detection_rate,
  {r(guarded("caught", "alerts") + " * 100")} AS precision_rate FROM daily)"""


CURVE = """counts AS (SELECT fraud_score AS score, count(*) AS n, sum(is_fraud) AS pos FROM scored GROUP BY 1),
curve AS (SELECT score, n, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS hits, sum(pos) OVER () AS p, sum(n) OVER () AS total
FROM counts WINDOW w AS (ORDER BY score DESC))"""


def unpivoted(columns: list[str], source: str) -> str:
    body = " UNION ALL ".join(f"SELECT '{c}' AS feature, side, {d(c)} AS value FROM {source}" for c in columns)
    return f"long AS (SELECT * FROM ({body}) WHERE value IS NOT NULL)"


def psi_ctes(bins: int = 10) -> str:
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""breaks AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS edges
FROM long WHERE side = 'baseline' GROUP BY 1),
sizes AS (SELECT feature, count(*) FILTER (WHERE side = 'baseline') AS nb,
  count(*) FILTER (WHERE side = 'production') AS np FROM long GROUP BY 1),
bins AS (SELECT feature, edges, unnest(range(1, len(edges))) AS bin FROM breaks WHERE len(edges) > 1),
binned AS (SELECT b.feature, b.bin,
  count(*) FILTER (WHERE l.side = 'baseline') AS cb, count(*) FILTER (WHERE l.side = 'production') AS cp
FROM bins b LEFT JOIN long l ON l.feature = b.feature AND l.value >= b.edges[b.bin]
  AND (l.value < b.edges[b.bin + 1] OR (b.bin = len(b.edges) - 1 AND l.value = b.edges[b.bin + 1])) GROUP BY 1, 2),
parts AS (SELECT feature, greatest({d("cb")} / nb, {d("1e-10")}) AS b, greatest({d("cp")} / np, {d("1e-10")}) AS p
FROM binned JOIN sizes USING (feature)),
psi AS (SELECT s.feature, COALESCE(v, 0) AS psi FROM sizes s LEFT JOIN
  (SELECT feature, sum((p - b) * ln(p / b)) AS v FROM parts GROUP BY 1) USING (feature)),
moments AS (SELECT feature, avg(value) FILTER (WHERE side = 'baseline') AS baseline_mean,
  avg(value) FILTER (WHERE side = 'production') AS production_mean,
  stddev_pop(value) FILTER (WHERE side = 'baseline') AS baseline_std,
  stddev_pop(value) FILTER (WHERE side = 'production') AS production_std FROM long GROUP BY 1)"""


STATUS = "CASE WHEN psi < 0.1 THEN 'Stable' WHEN psi < 0.25 THEN 'Moderate Drift' ELSE 'Significant Drift' END"
ACTION = "CASE WHEN psi < 0.1 THEN 'None' WHEN psi < 0.25 THEN 'Investigate' ELSE 'Retrain Required' END"
DRIFT_CTES = [
    *FEATURES_FULL, SIDES,
    "sided_features AS (SELECT features.*, side FROM features JOIN sides USING (transaction_id))",
    unpivoted(S.ALL_FEATURES, "sided_features"), psi_ctes(),
    f"report AS (SELECT feature, psi, {STATUS} AS status, {ACTION} AS action, baseline_mean, production_mean, "
    "baseline_std, production_std FROM psi JOIN moments USING (feature))",
]
REPORT_DOUBLES = ["psi", "baseline_mean", "production_mean", "baseline_std", "production_std"]

KS = """score_counts AS (SELECT fraud_score, count(*) FILTER (WHERE side = 'baseline') AS b,
  count(*) FILTER (WHERE side = 'production') AS p FROM sided GROUP BY 1),
steps AS (SELECT abs(CAST(sum(b) OVER w AS DOUBLE) / sum(b) OVER () - CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER ()) AS gap,
  sum(b) OVER () AS n1, sum(p) OVER () AS n2 FROM score_counts WINDOW w AS (ORDER BY fraud_score)),
ks_stat AS (SELECT max(gap) AS ks, CAST(max(n1) AS DOUBLE) * max(n2) / (CAST(max(n1) AS DOUBLE) + max(n2)) AS en FROM steps),
ks AS (SELECT ks AS ks_statistic, CASE WHEN -2 * en * ks * ks > -0.1 THEN 1.0 ELSE least(greatest((SELECT
  sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2 * en * ks * ks * k * k)) FROM range(1, 101) s(k)), 0.0), 1.0) END
  AS ks_pvalue FROM ks_stat)"""


def renamed_psi(bins: int) -> str:
    """The stability CTEs once more under other names, for use beside the feature report."""
    text = psi_ctes(bins)
    for name in ("breaks", "sizes", "binned", "bins", "parts", "psi", "moments", "long"):
        for before, after in ((f"\n{name} AS", f"\ns_{name} AS"), (f"FROM {name} ", f"FROM s_{name} "),
                              (f"JOIN {name} ", f"JOIN s_{name} "), (f"FROM {name})", f"FROM s_{name})")):
            text = text.replace(before, after)
    return "s_" + text.replace("FROM long", "FROM s_long")


SCORE_LONG = "s_long AS (SELECT 'fraud_score' AS feature, side, fraud_score AS value FROM sided)"
SCORE_DRIFT = """score_drift AS (SELECT psi, ks_statistic, ks_pvalue, baseline_mean, production_mean,
  (production_mean - baseline_mean) / baseline_mean * 100 AS mean_shift_percent, baseline_std, production_std
FROM s_psi JOIN s_moments USING (feature), ks)"""
SCORE_STATUS = """CASE WHEN psi < 0.1 AND abs(mean_shift_percent) < 10 THEN 'Stable'
  WHEN psi < 0.25 OR abs(mean_shift_percent) < 20 THEN 'Moderate drift' ELSE 'Significant drift' END"""
SCORE_ACTION = """CASE WHEN psi < 0.1 AND abs(mean_shift_percent) < 10 THEN 'Continue monitoring'
  WHEN psi < 0.25 OR abs(mean_shift_percent) < 20 THEN 'Investigate and consider retraining'
  ELSE 'Retrain immediately' END"""
SCORE_CTES = [*SIDED, KS, SCORE_LONG, renamed_psi(20), SCORE_DRIFT]

KPIS = f"""kpi_sums AS (SELECT count(*) AS n, count(*) FILTER (WHERE fraud_score >= 0.95) AS alerts,
  CAST(sum(is_fraud) AS BIGINT) AS frauds, count(*) FILTER (WHERE fraud_score >= 0.95 AND is_fraud = 1) AS caught
FROM production),
kpi AS (SELECT n AS total_transactions, alerts AS predicted_fraud_count, {guarded("alerts", "n")} * 100 AS predicted_fraud_rate,
  (1 - {guarded("alerts", "n")}) * 100 AS approval_rate, {guarded("caught", "frauds")} * 100 AS fraud_detection_rate,
  {guarded("caught", "alerts")} * 100 AS precision, frauds AS actual_fraud_count FROM kpi_sums)"""
LOW_DETECTION = "fraud_detection_rate < 75 AND actual_fraud_count > 0"
ALERTS = f"""SELECT printf('ALERT: Approval rate %.1f%% below 95%% threshold', approval_rate) AS alert FROM kpi WHERE approval_rate < 95
UNION ALL SELECT printf('ALERT: Fraud detection rate %.1f%% below 75%% threshold', fraud_detection_rate) FROM kpi WHERE {LOW_DETECTION}
UNION ALL SELECT printf('WARNING: Precision %.1f%% below 50%% threshold', precision) FROM kpi
  WHERE precision < 50 AND predicted_fraud_count > 0
UNION ALL SELECT 'All metrics within acceptable ranges' FROM kpi WHERE approval_rate >= 95 AND NOT ({LOW_DETECTION})"""
MONITOR_CTES = [
    *DRIFT_CTES[: len(FEATURES_FULL)], *[c for c in RULE_INPUTS if c not in FEATURES_FULL],
    *SCORED[len(RULE_INPUTS):], *DRIFT_CTES[len(FEATURES_FULL):],
    SIDED[-1], PRODUCTION[-1], KS, SCORE_LONG, renamed_psi(20), SCORE_DRIFT, KPIS,
    f"""reason_rows AS (
SELECT 1 AS o, printf('High drift in %d features (threshold: 3)', count(*)) AS t FROM report WHERE psi >= 0.25 HAVING count(*) >= 3
UNION ALL SELECT 2, printf('Score PSI %.3f exceeds 0.25', psi) FROM score_drift WHERE psi >= 0.25
UNION ALL SELECT 3, printf('Score mean shifted %+.1f%% (threshold: ±20%%)', mean_shift_percent) FROM score_drift
  WHERE abs(mean_shift_percent) > 20
UNION ALL SELECT 4, printf('Approval rate %.1f%% below 95%%', approval_rate) FROM kpi WHERE approval_rate < 95
UNION ALL SELECT 5, printf('Fraud detection rate %.1f%% below 75%%', fraud_detection_rate) FROM kpi WHERE {LOW_DETECTION}),
decision AS (SELECT (SELECT count(*) FROM reason_rows) > 0 AS should_retrain,
  CAST((SELECT count(*) FROM reason_rows) AS INT) AS reason_count,
  COALESCE((SELECT string_agg(t, '; ' ORDER BY o) FROM reason_rows), '') AS reasons, psi AS score_psi, approval_rate,
  fraud_detection_rate FROM score_drift, kpi)""",
]
SUMMARY = """, lines AS (SELECT 0 AS o, 'Retrain Required: ' || CASE WHEN should_retrain THEN 'YES' ELSE 'NO' END AS line FROM decision
UNION ALL SELECT 1, 'Reasons: ' || reasons FROM decision WHERE should_retrain
UNION ALL SELECT 2, printf('Score Drift PSI: %.4f', score_psi) FROM decision
UNION ALL SELECT 3, printf('Approval Rate: %.2f%%', approval_rate) FROM decision
UNION ALL SELECT 4, printf('Fraud Detection Rate: %.2f%%', fraud_detection_rate) FROM decision)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS line_number, line FROM lines"""

DECIDED = f"""decided AS (SELECT *, CASE WHEN fraud_score >= 0.95 THEN 'BLOCK' WHEN fraud_score >= 0.665 THEN 'REVIEW'
  ELSE 'APPROVE' END AS decision FROM scored)"""
DECISION_COLUMNS = f"""{r("fraud_score", 4)} AS fraud_score, decision,
  CASE decision WHEN 'BLOCK' THEN 'HIGH' WHEN 'REVIEW' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE decision WHEN 'BLOCK' THEN 'High' WHEN 'REVIEW' THEN 'Moderate' ELSE 'Low' END || ' fraud score (' ||
  printf('%.1f', fraud_score * 100) || '%) - ' || CASE decision WHEN 'BLOCK' THEN 'multiple suspicious signals'
  WHEN 'REVIEW' THEN 'requires manual review' ELSE 'transaction approved' END AS reason"""

REQUESTS = """requests AS (SELECT transaction_id, user_id, merchant_id, round(amount - 20, 2) AS amount,
  CASE WHEN mcc = '5541' THEN 'usa' WHEN mcc = '5411' THEN lower(country) ELSE country END AS country,
  CASE WHEN device_id > 0 THEN device_id END AS device_id, ip_id, mcc, ts, is_fraud FROM tx)"""
REQUEST_ERRORS = """SELECT transaction_id, 'device_id is required' AS error FROM requests WHERE device_id IS NULL
UNION ALL SELECT transaction_id, 'amount must be greater than 0' FROM requests WHERE amount <= 0
UNION ALL SELECT transaction_id, 'country must have 2 letters' FROM requests WHERE length(country) != 2"""

DEFAULTS = S.HISTORY_DEFAULTS
SERVED_RULES = {
    "feat_unique_users_per_device_24h": DEFAULTS["feat_unique_users_per_device_24h"],
    "feat_device_fraud_rate_historical": DEFAULTS["feat_device_fraud_rate_historical"],
    "feat_tx_count_user_1h": DEFAULTS["feat_tx_count_user_1h"],
    "feat_time_since_last_tx_mins": DEFAULTS["feat_time_since_last_tx_mins"],
    "feat_country_change": DEFAULTS["feat_country_change"],
}
SERVED = [
    f"""served_inputs AS (SELECT tx.*, {", ".join(f"{v} AS {k}" for k, v in SERVED_RULES.items())},
  CASE WHEN country IN ('NG', 'PK', 'BD', 'VN', 'ID') THEN 1 ELSE 0 END AS feat_is_high_risk_country,
  CASE WHEN amount > 500 THEN 1 ELSE 0 END AS feat_is_large_amount,
  CASE WHEN hour(ts) BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS feat_is_night FROM tx)""",
    f"served AS (SELECT *, {rule_score(scoring.CHAMPION)} AS fraud_score FROM served_inputs)",
    """compared AS (SELECT transaction_id, served.fraud_score AS online_score, scored.fraud_score AS offline_score,
  round(abs(served.fraud_score - scored.fraud_score), 6) AS difference FROM served JOIN scored USING (transaction_id))""",
]
AGREEMENT = """agreement AS (SELECT count(*) AS n, avg(difference) AS mean_difference, max(difference) AS max_difference,
  stddev_pop(difference) AS std_difference, count(*) FILTER (WHERE difference < 0.0001) AS within_0001,
  count(*) FILTER (WHERE difference < 0.001) AS within_001, count(*) FILTER (WHERE difference < 0.01) AS within_01,
  median(difference) AS median_difference FROM compared)"""
LATENCY = """latency AS (SELECT count(*) AS requests, avg(x) AS mean_ms, stddev_pop(x) AS std_ms, min(x) AS min_ms,
  max(x) AS max_ms, count(*) / (sum(x) / 1000) AS throughput_per_sec, median(x) AS median_ms, quantile_cont(x, 0.5) AS p50_ms,
  quantile_cont(x, 0.95) AS p95_ms, quantile_cont(x, 0.99) AS p99_ms FROM (SELECT amount / 10 AS x FROM tx))"""
LATENCY_DOUBLES = [
    "mean_ms", "std_ms", "min_ms", "max_ms", "throughput_per_sec", "median_ms", "p50_ms", "p95_ms", "p99_ms",
]


def enrich_sql() -> str:
    """Stored figures of the user where there are any, else the defaults."""
    plain = {k: str(v) for k, v in DEFAULTS.items() if k.startswith("feat_")}
    stored = {
        "feat_unique_countries_user_7d": "u.countries",
        "feat_unique_countries_per_device_7d": "v.countries",
        **{f"feat_{e}_fraud_rate_historical": f"{e[0] if e != 'device' else 'v'}.rate" for e in ("user", "merchant", "device")},
    }
    for name, value in stored.items():
        plain[name] = f"COALESCE({value}, {DEFAULTS[name]})"
    user_mean, merchant_mean = (f"COALESCE({e[0]}.mean_amount, {DEFAULTS[f'{e}_avg_amount']})" for e in ("user", "merchant"))
    user_std, merchant_std = (f"COALESCE({e[0]}.std_amount, {DEFAULTS[f'{e}_std_amount']})" for e in ("user", "merchant"))
    doubles = {
        "feat_amount_sum_user_24h": "amount * 3",
        "feat_amount_avg_user_24h": "amount",
        "feat_amount_vs_user_avg": f"(amount - {user_mean}) / ({user_std} + 1)",
        "feat_amount_vs_merchant_avg": f"(amount - {merchant_mean}) / ({merchant_std} + 1)",
        "feat_amount_percentile_user": "least(amount / 1000, 1.0)",
        "feat_user_country_entropy": "0",
    }
    row = [n for n in S.ALL_FEATURES if n not in plain and n not in doubles]
    for name, value in list(plain.items()):
        if isinstance(DEFAULTS[name], float):
            doubles[name] = plain.pop(name)
    columns = [f"{v} AS {k}" for k, v in plain.items()]
    columns += [f"{d(v) if 'fraud_rate' in k else r(v)} AS {k}" for k, v in doubles.items()]
    week = f"ts < TIMESTAMP '{TODAY}' - INTERVAL 7 DAY AND ts >= TIMESTAMP '{TODAY}' - INTERVAL 14 DAY"
    stores = [
        f"""{key}_store AS (SELECT {key}, avg(amount) AS mean_amount, stddev_samp(amount) AS std_amount,
  count(DISTINCT country) AS countries, avg(is_fraud) AS rate FROM tx WHERE {week} GROUP BY 1)"""
        for key in ("user_id", "merchant_id", "device_id")
    ]
    return (
        with_(TX, CHANGE, ROWS, *stores)
        + f"SELECT transaction_id, {', '.join(columns)}, {', '.join(row)} FROM tx "
        "LEFT JOIN user_id_store u ON tx.user_id = u.user_id LEFT JOIN merchant_id_store m ON tx.merchant_id = m.merchant_id "
        "LEFT JOIN device_id_store v ON tx.device_id = v.device_id "
        "JOIN row_features USING (transaction_id) JOIN (SELECT transaction_id, feat_is_high_risk_country FROM changes) c USING (transaction_id)"
    )


def summary_json_sql() -> str:
    entry = (
        "{'precision': round(precision, 4) + 0.0, 'recall': round(recall, 4) + 0.0, 'f1': round(f1, 4) + 0.0, "
        "'approval_rate': round(approval_rate / 100, 4) + 0.0}"
    )
    latency = ", ".join(
        f"'{n}': round({n}, 3) + 0.0"
        for n in ["mean_ms", "median_ms", "std_ms", "min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms", "throughput_per_sec"]
    )
    return (
        with_(*SCORED, *SERVED, AGREEMENT, LATENCY, fixed(S.FIXED_THRESHOLDS), metric_ctes("served"))
        + f"""SELECT 'test_info' AS section, CAST(to_json({{'total_transactions': count(*), 'fraud_cases': CAST(sum(is_fraud) AS BIGINT),
  'legitimate_cases': CAST(count(*) - sum(is_fraud) AS BIGINT)}}) AS VARCHAR) AS document FROM served
UNION ALL SELECT 'latency_stats', CAST(to_json({{{latency}}}) AS VARCHAR) FROM latency
UNION ALL SELECT 'model_comparison', CAST(to_json({{'mean_difference': round(mean_difference, 4) + 0.0,
  'max_difference': round(max_difference, 4) + 0.0, 'predictions_match': max_difference < 0.001}}) AS VARCHAR) FROM agreement
UNION ALL SELECT 'metrics', '{{' || string_agg('"' || threshold || '":' || CAST(to_json({entry}) AS VARCHAR), ',' ORDER BY threshold)
  || '}}' FROM metrics"""
    )


CHAMPION_CHALLENGER = """versus AS (SELECT a.threshold, a.dollar_recall AS champion_dollar_recall, a.approval_rate AS champion_approval_rate,
  a.precision AS champion_precision, b.dollar_recall AS challenger_dollar_recall, b.approval_rate AS challenger_approval_rate,
  b.precision AS challenger_precision FROM metrics a JOIN metrics b ON a.model = 'champion' AND b.model = 'challenger')"""
VERSUS_DOUBLES = [
    "threshold", "champion_dollar_recall", "champion_approval_rate", "champion_precision", "challenger_dollar_recall",
    "challenger_approval_rate", "challenger_precision",
]
TRAIN_EDGE = """(SELECT min(ts) + to_days(CAST(floor(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) * 9 / 12)
  AS INT)) FROM tx)"""
LABELS = "labels_found AS (SELECT transaction_id, chargeback_ts FROM tx WHERE is_fraud = 1)"


def simple(cte: str, columns: str, table: str) -> str:
    return with_(TX, cte) + f"SELECT transaction_id, {columns} FROM {table}"


def open_count(key: str, hours: int, name: str) -> str:
    """Rows in (ts - hours, ts]: the closed frame less the rows exactly at its start."""
    w = f"PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL '{hours * 3600 - 0.000001:.6f}' SECOND PRECEDING AND CURRENT ROW"
    return f"count(*) OVER ({w}) AS {name}"


def trend_sql() -> str:
    """Every day against the baseline, and again with the days before it."""

    def over(name: str, span: int) -> str:
        inside = f"x.day > d.day - {span} AND x.day <= d.day"
        return f"""{name} AS (SELECT day, sum((p - b) * ln(p / b)) AS {name} FROM (
  SELECT d.day, greatest(CAST(c.cb AS DOUBLE) / s.nb, 1e-10) AS b,
    greatest(CAST((SELECT coalesce(sum(x.n), 0) FROM day_bins x WHERE x.bin = c.bin AND {inside}) AS DOUBLE)
      / (SELECT sum(x.n) FROM days x WHERE {inside}), 1e-10) AS p
  FROM days d, binned c, sizes s) GROUP BY 1)"""

    spans = {"score_psi": 1, "score_psi_7d": 7, "score_psi_30d": 30}
    counts = ["total_transactions", "predicted_fraud_count", "actual_fraud_count"]
    doubles = ["predicted_fraud_rate", "approval_rate", "fraud_detection_rate", "precision", *spans]
    alerts, caught = "count(*) FILTER (WHERE fraud_score >= 0.95)", "count(*) FILTER (WHERE fraud_score >= 0.95 AND is_fraud = 1)"
    return with_(
        *SIDED,
        "long AS (SELECT 'fraud_score' AS feature, side, fraud_score AS value, CAST(ts AS DATE) AS day FROM sided)",
        psi_ctes(20),
        """day_bins AS (SELECT l.day, b.bin, count(*) AS n FROM bins b JOIN long l
  ON l.value >= b.edges[b.bin] AND (l.value < b.edges[b.bin + 1] OR (b.bin = len(b.edges) - 1 AND l.value = b.edges[b.bin + 1]))
  GROUP BY 1, 2)""",
        "days AS (SELECT day, count(*) AS n FROM long GROUP BY 1)",
        *[over(name, span) for name, span in spans.items()],
        f"""day_kpi AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total_transactions, {alerts} AS predicted_fraud_count,
  CAST(sum(is_fraud) AS BIGINT) AS actual_fraud_count, {guarded(alerts, "count(*)")} * 100 AS predicted_fraud_rate,
  (1 - {guarded(alerts, "count(*)")}) * 100 AS approval_rate, {guarded(caught, "sum(is_fraud)")} * 100 AS fraud_detection_rate,
  {guarded(caught, alerts)} * 100 AS precision FROM sided GROUP BY 1)""",
    ) + f"SELECT day, {', '.join(counts)}, {rounded_list(doubles)} FROM day_kpi JOIN " + " JOIN ".join(f"{n} USING (day)" for n in spans)


def census(table: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM {table}" for c in S.ALL_FEATURES
    )
    return f"SELECT * FROM ({parts}) WHERE missing > 0"


ORACLES: dict[str, str] = {
    "scan_transactions": with_(TX) + "SELECT * FROM tx",
    "write_features": with_(TX, VELOCITY)
    + f"SELECT transaction_id, CAST(ts AS DATE) AS day, {', '.join(S.FEATURE_FAMILIES['velocity'])} FROM velocity JOIN tx USING (transaction_id)",
    "velocity_features": simple(VELOCITY, ", ".join(S.FEATURE_FAMILIES["velocity"]), "velocity"),
    "velocity_features_inclusive": with_(TX)
    + "SELECT transaction_id, "
    + open_count("user_id", 1, "tx_count_user_1h_inclusive") + ", "
    + open_count("user_id", 24, "tx_count_user_24h_inclusive") + ", "
    + open_count("merchant_id", 1, "tx_count_merchant_1h_inclusive") + " FROM tx",
    "unique_users_per_device_24h": with_(TX, DEVICE_USERS) + "SELECT * FROM feat_unique_users_per_device_24h_cte",
    "unique_countries_per_device_7d": with_(TX, DEVICE_COUNTRIES) + "SELECT * FROM feat_unique_countries_per_device_7d_cte",
    "unique_countries_per_device_7d_legacy24h": with_(TX, DEVICE_COUNTRIES_24H)
    + "SELECT * FROM feat_unique_countries_per_device_24h_cte",
    "unique_users_per_ip_24h": with_(TX, IP_USERS) + "SELECT * FROM feat_unique_users_per_ip_24h_cte",
    "entity_age": with_(TX, AGES) + "SELECT * FROM ages",
    "device_risk_features": with_(TX, DEVICE_USERS, DEVICE_COUNTRIES, IP_USERS, AGES)
    + "SELECT * FROM ages JOIN feat_unique_users_per_device_24h_cte USING (transaction_id) "
    "JOIN feat_unique_countries_per_device_7d_cte USING (transaction_id) JOIN feat_unique_users_per_ip_24h_cte USING (transaction_id)",
    "geo_features": with_(TX, CHANGE, USER_COUNTRIES)
    + "SELECT transaction_id, feat_country_change, feat_unique_countries_user_7d, feat_is_high_risk_country FROM changes "
    "JOIN feat_unique_countries_user_7d_cte USING (transaction_id)",
    "country_change_first_is_change": simple(CHANGE, "country_change_first_is_change", "changes"),
    "country_entropy": with_(TX, ENTROPY) + "SELECT * FROM entropy",
    "historical_risk": with_(TX, RISK) + "SELECT * FROM risk",
    "historical_risk_smoothed": with_(TX)
    + "SELECT transaction_id, "
    + ", ".join(f"{past_rate(k + '_id', 1)} AS {k}_fraud_rate_smoothed" for k in ("user", "merchant", "device")) + " FROM tx",
    "historical_risk_label_aware": with_(TX, *[known_rate(f"{k}_id", k) for k in ("user", "merchant", "device")])
    + "SELECT * FROM user_rate JOIN merchant_rate USING (transaction_id) JOIN device_rate USING (transaction_id)",
    "user_running_count": with_(TX)
    + "SELECT transaction_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, transaction_id) AS user_transaction_count FROM tx",
    "time_since_last_zero": with_(TX)
    + f"""SELECT transaction_id, {d("COALESCE((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id "
        "ORDER BY ts, transaction_id)) / 60000000.0, 0)")} AS time_since_last_transaction FROM tx""",
    "amount_zscore_pit": with_(TX, Z_PAST) + "SELECT * FROM zscore",
    "amount_zscore_full": with_(TX, Z_FULL) + "SELECT * FROM zscore",
    "amount_percentile_full": with_(TX, PERCENTILE_FULL) + "SELECT * FROM percentile",
    "amount_percentile_pit": with_(TX, PERCENTILE_PAST) + "SELECT * FROM percentile",
    **{
        f"{k}_amount_stats": with_(TX)
        + f"SELECT {k}_id, count(*) AS n, {r('avg(amount)')} AS mean_amount, {r('stddev_samp(amount)')} AS std_amount FROM tx GROUP BY 1"
        for k in ("user", "merchant")
    },
    "amount_flags": simple(ROWS, "feat_is_small_amount, feat_is_large_amount", "row_features"),
    "temporal_features": simple(ROWS, ", ".join(S.FEATURE_FAMILIES["temporal"]), "row_features"),
    "all_features": with_(*FEATURES_PAST) + "SELECT * FROM features",
    "all_features_full_table": with_(*FEATURES_FULL) + "SELECT * FROM features",
    "feature_matrix": with_(TX, VELOCITY, Z_FULL, ROWS)
    + f"SELECT transaction_id, COALESCE(feat_amount_vs_user_avg, 0) AS feat_amount_vs_user_avg, feat_hour_sin, "
    f"{d('feat_tx_count_user_24h')} AS feat_tx_count_user_24h FROM velocity JOIN zscore USING (transaction_id) JOIN row_features USING (transaction_id)",
    "history_asof": with_(
        TX,
        "lagged AS (SELECT transaction_id, ts, lag(ts) OVER w AS seen, lag(user_id) OVER w AS u, lag(country) OVER w AS c, "
        "lag(amount) OVER w AS a FROM tx WINDOW w AS (PARTITION BY device_id ORDER BY ts, transaction_id))",
    )
    + f"""SELECT transaction_id, {d("CASE WHEN fresh THEN (epoch_us(ts) - epoch_us(seen)) / 60000000.0 END")} AS history_age_mins,
  CASE WHEN fresh THEN u END AS last_user_id, CASE WHEN fresh THEN c END AS last_country,
  {r("CASE WHEN fresh THEN a END")} AS last_amount FROM (SELECT *, seen >= ts - INTERVAL 7 DAY AS fresh FROM lagged)""",
    "enrich_with_defaults": enrich_sql(),
    "dataset_summary": with_(TX)
    + f"""SELECT count(*) AS transactions, CAST(sum(is_fraud) AS BIGINT) AS frauds, {r("avg(is_fraud)")} AS fraud_rate,
  min(ts) AS first_ts, max(ts) AS last_ts, {r("min(amount)")} AS min_amount, {r("max(amount)")} AS max_amount,
  count(DISTINCT country) AS countries, count(DISTINCT user_id) AS users, count(DISTINCT merchant_id) AS merchants FROM tx""",
    "null_census": with_(*FEATURES_FULL) + census("features"),
    "null_census_first_day": with_(
        TX.replace("tx AS", "given AS", 1),
        "tx AS (SELECT * FROM given WHERE CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM given))",
        *FEATURES_FULL[1:],
    )
    + census("features"),
    "feature_catalog": with_(*FEATURES_FULL)
    + "SELECT family, count(*) AS features, CAST(sum(present) AS BIGINT) AS values_present FROM ("
    + " UNION ALL ".join(
        f"SELECT '{family}' AS family, count({n}) AS present FROM features"
        for family, names in S.FEATURE_FAMILIES.items()
        for n in names
    )
    + ") GROUP BY 1",
    "temporal_split": with_(TX)
    + f"SELECT transaction_id, CASE WHEN ts < {TRAIN_EDGE} THEN 'train' ELSE 'test' END AS split FROM tx",
    "rowcount_split": with_(TX, SIDES) + "SELECT * FROM sides",
    "rowcount_split_ties": with_("tx AS (SELECT o_orderkey AS transaction_id, o_orderdate AS ts FROM orders)", SIDES)
    + "SELECT * FROM sides",
    "distinct_counts_with_nulls": with_(
        TX.replace("tx AS", "raw AS", 1),
        """tx AS (SELECT * REPLACE (CASE WHEN device_id % 7 != 0 THEN device_id END AS device_id,
  CASE WHEN ip_id % 5 != 0 THEN ip_id END AS ip_id, CASE WHEN user_id % 11 != 0 THEN user_id END AS user_id,
  date_trunc('hour', ts) AS ts) FROM raw)""",
        DEVICE_USERS,
        DEVICE_COUNTRIES,
        IP_USERS,
        USER_COUNTRIES,
    )
    + """SELECT transaction_id, feat_unique_users_per_device_24h, feat_unique_countries_per_device_7d,
  feat_unique_users_per_ip_24h, feat_unique_countries_user_7d FROM feat_unique_users_per_device_24h_cte
JOIN feat_unique_countries_per_device_7d_cte USING (transaction_id) JOIN feat_unique_users_per_ip_24h_cte USING (transaction_id)
JOIN feat_unique_countries_user_7d_cte USING (transaction_id)""",
    "training_window": with_(TX)
    + f"""SELECT CAST(w AS INT) AS window_days, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS frauds, max(ts) AS last_ts
FROM tx, (VALUES (30), (60), (90), (180)) v(w)
WHERE ts >= TIMESTAMP '{TODAY}' - to_days(CAST(w AS INT)) AND ts <= TIMESTAMP '{TODAY}' - INTERVAL 7 DAY GROUP BY 1""",
    "deterministic_sample": with_(TX)
    + "SELECT transaction_id, amount FROM tx ORDER BY md5('42:' || transaction_id), transaction_id LIMIT 500",
    "validate_transactions": with_(TX, REQUESTS, f"bad AS ({REQUEST_ERRORS})")
    + """SELECT transaction_id, amount, upper(country) AS country, 'USD' AS currency,
  CASE WHEN amount > 10000 THEN 1 ELSE 0 END AS warning_count FROM requests
WHERE transaction_id NOT IN (SELECT transaction_id FROM bad)""",
    "validation_errors": with_(TX, REQUESTS) + REQUEST_ERRORS,
    "request_fields": with_(TX, REQUESTS, f"bad AS ({REQUEST_ERRORS})", "counted AS (SELECT transaction_id, count(*) AS n FROM bad GROUP BY 1)")
    + f"""SELECT transaction_id, CASE WHEN transaction_id % 10 = 0 THEN TIMESTAMP '{TODAY} 00:00:00' ELSE ts END AS ts,
  CASE WHEN mcc != '5812' THEN 'category ' || mcc END AS merchant_category, 'USD' AS currency,
  CAST(NULL AS VARCHAR) AS user_email_domain, CAST(NULL AS BOOLEAN) AS is_first_transaction,
  CAST(COALESCE(n, 0) + CASE WHEN mcc = '5812' THEN 1 ELSE 0 END AS INT) AS error_count
FROM requests LEFT JOIN counted USING (transaction_id)""",
    "request_payload": with_(TX)
    + f"""SELECT transaction_id, CASE WHEN delay_days IS NULL
  THEN CAST(to_json({{'transaction_id': {d("transaction_id")}, 'user_id': {d("user_id")}, 'merchant_category_code': mcc,
    'amount': amount, 'country': country}}) AS VARCHAR)
  ELSE CAST(to_json({{'transaction_id': {d("transaction_id")}, 'user_id': {d("user_id")}, 'merchant_category_code': mcc,
    'amount': amount, 'country': country, 'delay_days': {d("delay_days")}}}) AS VARCHAR) END AS payload FROM tx""",
    "rule_scores": with_(*SCORED) + "SELECT transaction_id, fraud_score FROM scored",
    "decisions": with_(*SCORED, DECIDED) + f"SELECT transaction_id, {DECISION_COLUMNS} FROM decided",
    "score_transactions": with_(
        TX.replace("tx AS", "raw AS", 1),
        REQUESTS.replace("FROM tx)", "FROM raw)"),
        f"faults AS (SELECT transaction_id, CAST(count(*) AS INT) AS n FROM ({REQUEST_ERRORS}) GROUP BY 1)",
        """tx AS (SELECT * REPLACE (upper(country) AS country) FROM requests
  WHERE transaction_id NOT IN (SELECT transaction_id FROM faults))""",
        *SCORED[1:],
        DECIDED,
    )
    + f"""SELECT transaction_id, {DECISION_COLUMNS}, '1.0' AS model_version, 0 AS error_count FROM decided
UNION ALL SELECT transaction_id, NULL, NULL, NULL, NULL, '1.0', n FROM faults""",
    "decision_distribution": with_(*SCORED, DECIDED)
    + f"SELECT decision, count(*) AS n, {r('count(*) * 100.0 / (SELECT count(*) FROM decided)')} AS percent FROM decided GROUP BY 1",
    "score_comparison": with_(*SCORED, *SERVED) + "SELECT * FROM compared",
    "score_agreement": with_(*SCORED, *SERVED, AGREEMENT)
    + f"""SELECT n, within_0001, within_001, within_01,
  {rounded_list(["mean_difference", "max_difference", "std_difference", "median_difference"])},
  CASE WHEN max_difference < 0.001 THEN 'EXCELLENT' WHEN max_difference < 0.01 THEN 'GOOD' ELSE 'WARNING' END AS verdict FROM agreement""",
    "latency_stats": with_(TX, LATENCY) + f"SELECT requests, {rounded_list(LATENCY_DOUBLES)} FROM latency",
    "confusion_matrix": with_(*SCORED, fixed([0.95]), metric_ctes("scored"))
    + "SELECT threshold, true_negatives, false_positives, false_negatives, true_positives FROM metrics",
    "business_metrics": with_(*SCORED, fixed([0.95]), metric_ctes("scored")) + METRIC_SELECT,
    "threshold_sweep_100": with_(*SCORED, grid(100), metric_ctes("scored")) + METRIC_SELECT,
    "threshold_sweep_50": with_(*SCORED, grid(50), metric_ctes("scored")) + METRIC_SELECT,
    "threshold_metrics_fixed": with_(*SCORED, fixed(S.FIXED_THRESHOLDS), metric_ctes("scored")) + METRIC_SELECT,
    "optimal_threshold_f1": with_(*SCORED, grid(100), metric_ctes("scored")) + best("F1", "true", "f1"),
    "optimal_threshold_recall80": with_(*SCORED, grid(100), metric_ctes("scored"))
    + best("80% Recall", "recall >= 0.8", "precision"),
    "optimal_threshold_fpr1": with_(*SCORED, grid(100), metric_ctes("scored")) + best("1% FPR", "fpr <= 0.01", "recall"),
    "model_comparison": comparison_sql(),
    "roi_analysis": roi_sql(),
    "segment_metrics": segment_sql(),
    "daily_kpis": with_(*SCORED, daily("scored", "0.95")) + "SELECT * FROM kpis",
    "alerts_last_7d": with_(*SCORED, daily("scored", "0.95"))
    + "SELECT day, alerts FROM kpis WHERE day > (SELECT max(day) FROM kpis) - 7",
    "pr_curve": with_(*SCORED, CURVE)
    + f"""SELECT {r("score")} AS threshold, {r(guarded("tp", "hits"))} AS precision, {r(guarded("tp", "p"))} AS recall,
  {r(guarded("p", "total"))} AS random_precision FROM curve""",
    "average_precision": with_(*SCORED, CURVE)
    + f"""SELECT {r(f"sum({guarded('pos', 'p')} * {guarded('tp', 'hits')})")} AS average_precision FROM curve""",
    "roc_auc": with_(
        *SCORED,
        "ranked AS (SELECT is_fraud, rank() OVER (ORDER BY fraud_score) + (count(*) OVER (PARTITION BY fraud_score) - 1) / 2.0 AS rk FROM scored)",
        f"sums AS (SELECT {d('sum(CASE WHEN is_fraud = 1 THEN rk END)')} AS s, {d('sum(is_fraud)')} AS p, {d('count(*)')} AS n FROM ranked)",
    )
    + f"SELECT {r('(s - p * (p + 1) / 2) / (p * (n - p))')} AS roc_auc FROM sums",
    "psi_amount": with_(
        TX, SIDES, "sided AS (SELECT amount, side FROM tx JOIN sides USING (transaction_id))",
        unpivoted(["amount"], "sided"), psi_ctes(),
    )
    + f"SELECT feature, {r('psi')} AS psi FROM psi",
    "feature_drift": with_(*DRIFT_CTES) + f"SELECT feature, status, action, {rounded_list(REPORT_DOUBLES)} FROM report",
    "categorical_psi": with_(
        *DRIFT_CTES[:-3],
        unpivoted(
            ["feat_country_change", "feat_is_night", "feat_is_large_amount", "feat_day_of_week", "feat_hour"], "sided_features"
        ),
        """shares AS (SELECT feature, value, count(*) FILTER (WHERE side = 'baseline') AS cb,
  count(*) FILTER (WHERE side = 'production') AS cp FROM long GROUP BY 1, 2)""".replace("shares", "value_shares"),
        f"""floored AS (SELECT feature, greatest({d("cb")} / sum(cb) OVER (PARTITION BY feature), {d("1e-10")}) AS b,
  greatest({d("cp")} / sum(cp) OVER (PARTITION BY feature), {d("1e-10")}) AS p FROM value_shares)""",
    )
    + f"SELECT feature, {r('sum((p - b) * ln(p / b))')} AS psi FROM floored GROUP BY 1",
    "drift_status_counts": with_(*DRIFT_CTES) + "SELECT status, count(*) AS features FROM report GROUP BY 1",
    "top_drifted": with_(*DRIFT_CTES)
    + f"SELECT feature, {r('psi')} AS psi, status FROM report ORDER BY round(report.psi, 9) DESC, feature LIMIT 10",
    "top_mean_shift": with_(*DRIFT_CTES)
    + f"""SELECT feature, {r("psi", 3)} AS psi,
  {r("(production_mean - baseline_mean) / (abs(baseline_mean) + 1e-10) * 100", 3)} AS mean_shift_percent
FROM (SELECT * FROM report ORDER BY round(psi, 9) DESC, feature LIMIT 10)""",
    "ks_two_sample": with_(*SIDED, KS) + f"SELECT {rounded_list(['ks_statistic', 'ks_pvalue'])} FROM ks",
    "score_drift": with_(*SCORE_CTES)
    + f"""SELECT {rounded_list(["psi", "ks_statistic", "ks_pvalue", "baseline_mean", "production_mean", "mean_shift_percent",
      "baseline_std", "production_std"])}, {SCORE_STATUS} AS status, {SCORE_ACTION} AS action FROM score_drift""",
    "score_histogram": with_(*SIDED)
    + "SELECT side, CAST(least(floor(fraud_score * 50), 49) AS INT) AS bin, count(*) AS n FROM sided GROUP BY 1, 2",
    "business_kpis": with_(*PRODUCTION, KPIS)
    + f"""SELECT total_transactions, predicted_fraud_count, actual_fraud_count,
  {rounded_list(["predicted_fraud_rate", "approval_rate", "fraud_detection_rate", "precision"])} FROM kpi""",
    "kpi_alerts": with_(*PRODUCTION, KPIS) + ALERTS,
    "retrain_decision": with_(*MONITOR_CTES)
    + f"SELECT should_retrain, reason_count, reasons, {rounded_list(['score_psi', 'approval_rate', 'fraud_detection_rate'])} FROM decision",
    "monitoring_summary": with_(*MONITOR_CTES).rstrip() + SUMMARY,
    "kpi_trend": trend_sql(),
    "sustained_breach": with_(
        *MODELS, daily("models", "0.665", "model"),
        """islands AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY model ORDER BY day) AS INT) AS island FROM kpis
  WHERE approval_rate < 95)""",
    )
    + """SELECT model, min(day) AS first_day, max(day) AS last_day, count(*) AS days, min(approval_rate) AS lowest_approval
FROM islands GROUP BY model, island HAVING count(*) >= 3""",
    "label_backfill": with_(TX, LABELS)
    + f"""SELECT tx.transaction_id, CASE WHEN l.transaction_id IS NULL THEN 0 ELSE 1 END AS is_fraud, l.chargeback_ts AS label_ts
FROM tx LEFT JOIN labels_found l ON tx.transaction_id = l.transaction_id AND l.chargeback_ts <= TIMESTAMP '{TODAY}'""",
    "unmatched_labels": with_(TX, LABELS)
    + f"""SELECT * FROM labels_found WHERE transaction_id NOT IN (SELECT transaction_id FROM tx
WHERE ts >= TIMESTAMP '{TODAY}' - INTERVAL 20 DAY AND ts <= TIMESTAMP '{TODAY}' - INTERVAL 7 DAY)""",
    "lr_scored_rows": with_(TX)
    + f"SELECT transaction_id, 'test' AS split, true AS is_probability, true AS same_after_loading FROM tx WHERE ts >= {TRAIN_EDGE}",
    "importance_shares": "SELECT feature, true AS is_share FROM (VALUES "
    + ", ".join(f"('{n}')" for n in S.ALL_FEATURES)
    + ") v(feature)",
    "lr_optimum": "SELECT feature, true AS at_optimum FROM (VALUES "
    + ", ".join(f"('{n}')" for n in [*S.ALL_FEATURES, "intercept"])
    + ") v(feature)",
    "scaled_features": with_(
        TX,
        VELOCITY,
        DEVICE_USERS,
        ROWS,
        f"""wide AS (SELECT transaction_id, CASE WHEN ts < {TRAIN_EDGE} THEN 'train' ELSE 'test' END AS split,
  feat_tx_count_user_24h, feat_unique_users_per_device_24h, feat_hour, feat_is_night FROM tx
  JOIN velocity USING (transaction_id) JOIN feat_unique_users_per_device_24h_cte USING (transaction_id)
  JOIN row_features USING (transaction_id))""",
    )
    + "SELECT transaction_id, split, "
    + ", ".join(
        r(
            f"COALESCE(({n} - avg({n}) FILTER (WHERE split = 'train') OVER ()) "
            f"/ NULLIF(stddev_samp({n}) FILTER (WHERE split = 'train') OVER (), 0), 0)"
        )
        + f" AS {n}"
        for n in ("feat_tx_count_user_24h", "feat_unique_users_per_device_24h", "feat_hour", "feat_is_night")
    )
    + " FROM wide",
    "class_weights": with_(
        TX, f"sums AS (SELECT {d('count(*)')} AS n, {d('sum(is_fraud)')} AS p FROM tx WHERE ts < {TRAIN_EDGE})"
    )
    + f"""SELECT {r("n / (2 * p)")} AS fraud_weight, {r("n / (2 * (n - p))")} AS legit_weight,
  {r("(n - p) / p")} AS scale_pos_weight FROM sums""",
    "ab_assignment": with_(TX)
    + "SELECT transaction_id, CASE WHEN transaction_id % 10 = 0 THEN 'v2.0_challenger' ELSE 'v1.0_champion' END AS model_version FROM tx",
    "champion_challenger": with_(*MODELS, fixed([0.5]), metric_ctes("models", "model"), CHAMPION_CHALLENGER)
    + f"""SELECT {rounded_list(VERSUS_DOUBLES)}, CASE WHEN challenger_dollar_recall > champion_dollar_recall
  THEN CASE WHEN challenger_approval_rate >= 95 THEN 'promote challenger' ELSE 'approval rate too low' END
  ELSE 'keep champion' END AS outcome FROM versus""",
    "promotion_check": with_(
        *MODELS, fixed([0.5]), metric_ctes("models", "model"), CHAMPION_CHALLENGER,
        daily("(SELECT * FROM models WHERE model = 'challenger')", "0.5"),
        "recent AS (SELECT count(*) AS seen, count(*) FILTER (WHERE approval_rate >= 95) AS good "
        "FROM (SELECT * FROM kpis ORDER BY day DESC LIMIT 7))",
        """checks AS (SELECT challenger_dollar_recall >= champion_dollar_recall AS recall_ok,
  challenger_approval_rate >= 95 AS approval_ok, challenger_precision * 100 >= 50 AS precision_ok,
  seen = 7 AND good = 7 AS stable_ok FROM versus, recent)""",
    )
    + "SELECT *, recall_ok AND approval_ok AND precision_ok AND stable_ok AS promote FROM checks",
    "retrain_success": with_(
        *MONITOR_CTES, fixed([0.95]), metric_ctes("production"),
        """checks AS (SELECT m.dollar_recall >= 80 AS dollar_recall_ok, m.approval_rate >= 99 AS approval_ok,
  m.precision * 100 >= 60 AS precision_ok, score_drift.psi < 0.1 AS score_psi_ok,
  (SELECT max(psi) FROM report) < 0.25 AS feature_psi_ok FROM metrics m, score_drift)""",
    )
    + "SELECT *, dollar_recall_ok AND approval_ok AND precision_ok AND score_psi_ok AND feature_psi_ok AS success FROM checks",
    "api_summary_json": summary_json_sql(),
    "stream_hourly_kpis": with_(*LIVE_SCORED)
    + f"""SELECT date_trunc('hour', ts) AS hour, count(*) AS transactions, count(*) FILTER (WHERE fraud_score >= 0.95) AS alerts,
  CAST(sum(is_fraud) AS BIGINT) AS frauds, CAST(sum({CENTS}) * 100 AS BIGINT) AS amount_cents FROM scored GROUP BY 1
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM given) - INTERVAL 10 MINUTE""",
    "stream_alert_volume": with_(*LIVE_SCORED).rstrip() + ",\n" + sliding("24 HOUR", "1 HOUR", 24, 60),
    "stream_alert_volume_1h": with_(*LIVE_SCORED).rstrip() + ",\n" + sliding("1 HOUR", "10 MINUTE", 6, 10),
    "stream_dedup": with_(TX) + "SELECT transaction_id, ts, amount FROM tx",
    "stream_label_join": with_(TX)
    + "SELECT transaction_id, ts, amount, chargeback_ts FROM tx WHERE is_fraud = 1 AND chargeback_ts <= ts + INTERVAL 90 DAY",
    "stream_late_labels": with_(TX)
    + "SELECT transaction_id, ts, amount, chargeback_ts FROM tx WHERE is_fraud = 1 AND chargeback_ts > ts + INTERVAL 14 DAY",
    "stream_label_upsert": with_(TX)
    + """SELECT transaction_id, ts, CASE WHEN is_fraud = 1 AND delay_days <= 20 THEN 1 ELSE 0 END AS is_fraud,
  CASE WHEN is_fraud = 1 AND delay_days <= 20 THEN chargeback_ts END AS chargeback_ts FROM tx""",
    "stream_scores": with_(LIVE[0], LIVE[1].removesuffix(")") + " WHERE amount > 0)", *LIVE_SCORED[2:], DECIDED)
    + f"""SELECT transaction_id, {r("d.fraud_score", 4)} AS fraud_score, d.decision,
  CASE d.decision WHEN 'BLOCK' THEN 'HIGH' WHEN 'REVIEW' THEN 'MEDIUM' WHEN 'APPROVE' THEN 'LOW' END AS risk_level,
  CASE WHEN amount > 0 THEN 0 ELSE 1 END AS error_count
FROM given LEFT JOIN (SELECT transaction_id, fraud_score, decision FROM decided) d USING (transaction_id) WHERE {CLOSED}""",
    "stream_entity_features": with_(*LIVE, VELOCITY, DEVICE_USERS, DEVICE_COUNTRIES, IP_USERS, AGES, CHANGE, USER_COUNTRIES, RISK)
    + f"SELECT transaction_id, {', '.join(f'CAST({n} AS BIGINT) AS {n}' if 'country_change' in n else n for n in STORE_NAMES)} FROM given "
    + " ".join(
        f"JOIN {t} USING (transaction_id)"
        for t in [
            *["velocity", "feat_unique_users_per_device_24h_cte", "feat_unique_countries_per_device_7d_cte", "ages", "changes"],
            *["feat_unique_users_per_ip_24h_cte", "feat_unique_countries_user_7d_cte", "risk"],
        ]
    )
    + f" WHERE {CLOSED}",
    "stream_scores_without_store": with_(TX, *SERVED[:2], DECIDED.replace("scored", "served"))
    + f"""SELECT transaction_id, CASE WHEN amount > 0 THEN {r("fraud_score", 4)} END AS fraud_score,
  CASE WHEN amount > 0 THEN decision END AS decision, CASE WHEN amount > 0 THEN CASE decision WHEN 'BLOCK' THEN 'HIGH'
  WHEN 'REVIEW' THEN 'MEDIUM' ELSE 'LOW' END END AS risk_level, CASE WHEN amount > 0 THEN 0 ELSE 1 END AS error_count FROM decided""",
    "stream_user_velocity": with_(
        TX,
        f"""minutes AS (SELECT user_id, epoch_us(date_trunc('minute', ts)) // 60000000 AS minute, count(*) AS n,
  CAST(sum({CENTS}) * 100 AS BIGINT) AS cents FROM tx
  WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM tx) - INTERVAL 10 MINUTE GROUP BY 1, 2)""",
    )
    + """SELECT user_id, minute, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_1h,
  CAST(sum(n) OVER (PARTITION BY user_id ORDER BY minute RANGE BETWEEN 1439 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_24h,
  CAST(sum(n) OVER (PARTITION BY user_id ORDER BY minute RANGE BETWEEN 10079 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_7d,
  CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY minute RANGE BETWEEN 1439 PRECEDING AND CURRENT ROW) AS BIGINT) AS cents_24h FROM minutes""",
}
ORACLES["retrain_decision_by_day"] = ORACLES["retrain_decision"]
