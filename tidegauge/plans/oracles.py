"""The registered queries in SQL, written from the definitions and not from the plans.

Each text is a chain of named steps. Windows run over whole series here; that is the point
of an independent check.
"""

from __future__ import annotations

from tidegauge.plans.testbed import FREQUENCY, HORIZON, LAG_OVERRIDE, SOURCE_OF, SOURCES
from tidegauge.sources.readers import RELEASE_LAGS

H = 24

ORDER = "OVER (PARTITION BY symbol ORDER BY ts)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN {value} END"


def mean(x: str, n: int) -> str:
    return full(x, n, f"avg({x}) {frame(n)}")


def std(x: str, n: int) -> str:
    return full(x, n, f"stddev_samp({x}) {frame(n)}")


def low(x: str, n: int) -> str:
    return full(x, n, f"min({x}) {frame(n)}")


def high(x: str, n: int) -> str:
    return full(x, n, f"max({x}) {frame(n)}")


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {ORDER}"


def lead(x: str, k: int) -> str:
    return f"lead({x}, {k}) {ORDER}"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def zscore(x: str, n: int) -> str:
    return div(f"{x} - {mean(x, n)}", std(x, n))


def rnd(x: str, digits: int, name: str | None = None) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE AS {name or x}"


def chain(*steps: str, recursive: bool = False) -> str:
    *ctes, last = steps
    recursive = recursive or any(step.startswith("feat AS") for step in ctes)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + last


DAILY = """daily AS MATERIALIZED (
  SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close,
         sum(l_quantity) AS volume, count(*)::BIGINT AS n_ticks
  FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2)"""

HOURLY = """hourly AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts,
         first("value" ORDER BY event_id) AS open, max("value") AS high, min("value") AS low,
         last("value" ORDER BY event_id) AS close,
         count(*)::DOUBLE AS volume, count(*)::BIGINT AS n_ticks
  FROM events WHERE "value" IS NOT NULL AND events.ts IS NOT NULL GROUP BY event_type, date_trunc('hour', events.ts))"""

INDEXED = """idx AS MATERIALIZED (
  SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::BIGINT AS rn,
         (count(*) OVER (PARTITION BY symbol))::BIGINT AS n_rows FROM daily)"""

_CASES = " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in SOURCE_OF.items())
_DAYS = " ".join(f"WHEN '{s}' THEN {LAG_OVERRIDE.get(s, RELEASE_LAGS[f])}" for s, f in FREQUENCY.items())
EXTERNAL = f"""external0 AS (
  SELECT CASE o_orderpriority {_CASES} END AS source, o_orderdate AS value_date,
         round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
external AS MATERIALIZED (
  SELECT source, value_date, value_date + to_days(CASE source {_DAYS} END) AS release_date, value FROM external0)"""


def asof(source: str, base: str, name: str) -> str:
    """``base`` plus column ``source`` as of each ts."""
    return f"""{name} AS (
  SELECT b.*, e.value AS {source} FROM {base} b ASOF LEFT JOIN
    (SELECT release_date, value FROM external WHERE source = '{source}') e ON b.ts >= e.release_date)"""


def asof_all(base: str, name: str = "aligned") -> str:
    steps, prev = [], base
    for i, s in enumerate(SOURCES):
        this = name if i == len(SOURCES) - 1 else f"al{i}"
        steps.append(asof(s, prev, this))
        prev = this
    return ",\n".join(steps)


ORACLES: dict[str, str] = {}

# --- bars and externals ---------------------------------------------------------------------

ORACLES["ohlcv_bars"] = chain(HOURLY, "SELECT * FROM hourly")
#: ticks in four batches by arrival, each with the watermark that earlier batches left
REPLAY = [
    """arr AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bar, epoch_us(ts) AS us, event_id, value, epoch_us(ts) + 1000000 *
    CASE WHEN event_id % 3 = 1 THEN event_id * 7919 % 259200 ELSE event_id * 104729 % 7200 END AS arrival FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)""",
    "bat AS (SELECT *, ((arrival - min(arrival) OVER ()) * 4 // (max(arrival) OVER () - min(arrival) OVER () + 1)) AS batch FROM arr)",
    "wm AS (SELECT b.batch, coalesce(max(e.us) // 1000 - 14400000, 0) AS mark FROM (SELECT DISTINCT batch FROM bat) b LEFT JOIN bat e ON e.batch < b.batch GROUP BY 1)",
    "rep AS (SELECT bat.*, epoch_ms(bar) + 3600000 <= mark AS late FROM bat JOIN wm USING (batch))",
]
ORACLES["bar_revisions"] = chain(
    *REPLAY,
    """SELECT symbol, bar AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close,
    count(*)::DOUBLE AS volume, count(*)::BIGINT AS n_ticks, count(DISTINCT batch)::INT AS revision FROM rep WHERE NOT late GROUP BY 1, 2""",
)
ORACLES["late_ticks"] = chain(*REPLAY, "SELECT symbol, bar AS ts, event_id, value AS price FROM rep WHERE late")
ORACLES["daily_bars"] = chain(DAILY, "SELECT * FROM daily")
ORACLES["release_dates"] = chain(EXTERNAL, "SELECT source, value_date, release_date, value FROM external")
ORACLES["keyword_long"] = chain(
    "spine AS (SELECT DISTINCT o_orderdate AS d FROM orders)",
    "kw AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{p}', 'trend_{i}')" for i, p in enumerate(SOURCE_OF))
    + ") v(p, keyword))",
    """SELECT s.d AS value_date, s.d AS release_date, kw.keyword,
       (SELECT count(*) FROM orders o WHERE o.o_orderdate = s.d AND o.o_orderpriority = kw.p)::DOUBLE AS value
     FROM spine s, kw""",
)
ORACLES["source_coverage"] = chain(
    EXTERNAL,
    "SELECT source, count(*)::BIGINT AS n, min(value_date) AS first_date, max(value_date) AS last_date FROM external GROUP BY 1",
)
ORACLES["asof_align"] = chain(
    DAILY, EXTERNAL, "grid AS (SELECT DISTINCT ts FROM daily)", asof_all("grid", "a"), "SELECT ts, " + ", ".join(SOURCES) + " FROM a"
)
ORACLES["asof_multi"] = chain(
    DAILY,
    EXTERNAL,
    "base AS (SELECT symbol, ts, close FROM daily)",
    asof_all("base"),
    f"SELECT symbol, ts, close, {', '.join(SOURCES)} FROM aligned",
)
ORACLES["asof_interval"] = chain(
    DAILY,
    EXTERNAL,
    "grid AS (SELECT DISTINCT ts FROM daily)",
    "pairs AS (SELECT g.ts, s.source FROM grid g, (SELECT DISTINCT source FROM external) s)",
    """SELECT p.ts, p.source, e.value FROM pairs p ASOF JOIN external e
       ON p.source = e.source AND p.ts >= e.release_date""",
)
for _name, _key in (("asof_keyed_users", "user_id"), ("asof_keyed_hot", "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END")):
    ORACLES[_name] = f"""WITH e AS (SELECT *, {_key} AS user_key FROM events)
SELECT l.event_id, l.user_key, l.ts, r.event_id AS purchase_id, r."value" AS paid FROM (SELECT * FROM e WHERE event_type <> 'purchase') l
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') r ON l.user_key = r.user_key AND l.ts >= r.ts"""
ORACLES["interval_activity"] = chain(
    "hours AS (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS ts FROM events WHERE \"value\" IS NOT NULL)",
    "spans AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)",
    "SELECT ts, count(*)::BIGINT AS n_active, sum(user_id)::BIGINT AS id_sum FROM hours JOIN spans ON a <= ts AND ts < b GROUP BY 1",
)
ORACLES["align_fill_rate"] = chain(
    DAILY,
    EXTERNAL,
    "base AS (SELECT symbol, ts FROM daily)",
    asof_all("base"),
    " UNION ALL ".join(
        f"""SELECT '{s}' AS source, count({s})::BIGINT AS filled, count(*)::BIGINT AS total,
        {rnd(f"count({s})::DOUBLE / count(*) * 100.0", 6, "pct")} FROM aligned"""
        for s in SOURCES
    ),
)

# --- window primitives ------------------------------------------------------------------------

RETURNS = f"ret AS (SELECT *, ln(close) - {lag('ln(close)')} AS r1 FROM idx)"


def lr(k: int) -> str:
    return f"ln(close) - {lag('ln(close)', k)}"


def over_idx(*select: str) -> str:
    return chain(DAILY, INDEXED, f"SELECT symbol, ts, {', '.join(select)} FROM idx")


ORACLES["log_returns"] = over_idx(*[rnd(lr(k), 9, f"logret_{k}") for k in (1, 4, 24, 168)])
ORACLES["feature_lag"] = chain(
    DAILY, INDEXED, RETURNS, f"SELECT symbol, ts, {rnd('r1', 9, 'logret_1')}, {rnd(lag('r1'), 9, 'lagged')} FROM ret"
)
ORACLES["rolling_stats"] = chain(
    DAILY,
    INDEXED,
    RETURNS,
    f"""SELECT symbol, ts, {rnd(div(mean('close', 24), 'close'), 7, 'mean_rel')}, {rnd(std('r1', 24), 7, 'std_24')},
        {rnd(f"({std('r1', 24)}) * sqrt(24)", 7, 'std_scaled')} FROM ret""",
)
ORACLES["rolling_extrema"] = over_idx(f"{low('low', 14)} AS low_14", f"{high('high', 14)} AS high_14")
ORACLES["rolling_zscore"] = over_idx(*[rnd(zscore("close", n), 6, f"zscore_{n}") for n in (24, 168)])
ORACLES["bar_gaps"] = chain(
    HOURLY,
    f"g AS (SELECT symbol, ts, {lag('ts')} AS prev_ts FROM hourly)",
    f"SELECT symbol, ts, prev_ts, {rnd('epoch_us(ts - prev_ts) / 3600e6', 6, 'gap_hours')} FROM g WHERE prev_ts IS NOT NULL",
)


def step(state: str, x: str, alpha: float) -> str:
    """One step of a mean without gaps after its first observation."""
    return (
        f"CASE WHEN {x} IS NULL THEN {state} WHEN {state} IS NULL THEN {x} "
        f"ELSE (1 - {alpha!r}::DOUBLE) * {state} + {alpha!r}::DOUBLE * {x} END"
    )


def scan(name: str, base: str, means: dict[str, tuple[str, float]]) -> str:
    """Recursive CTE with one column per mean: ``{column: (input, alpha)}``."""
    first = ", ".join(f"b.{x} AS {c}" for c, (x, _) in means.items())
    later = ", ".join(step(f"e.{c}", f"b.{x}", a) for c, (x, a) in means.items())
    return f"""{name} AS (
  SELECT symbol, rn, {first} FROM {base} b WHERE rn = 0
  UNION ALL
  SELECT b.symbol, b.rn, {later} FROM {name} e JOIN {base} b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"""


A14 = 1 / 14
ORACLES["ema"] = chain(
    DAILY,
    INDEXED,
    scan("e", "idx", {"ema_12": ("close", 2 / 13), "w14": ("close", A14)}),
    f"""SELECT i.symbol, i.ts, {rnd('ema_12', 2)}, {rnd('CASE WHEN i.rn >= 13 THEN w14 END', 2, 'wilder_14')}
        FROM idx i JOIN e ON i.symbol = e.symbol AND i.rn = e.rn""",
    recursive=True,
)
ORACLES["ema_short"] = chain(
    DAILY,
    INDEXED,
    scan("e", "idx", {"ema_2": ("close", 2 / 3), "ema_3": ("close", 2 / 4), "ema_5": ("close", 2 / 6)}),
    f"""SELECT i.symbol, i.ts, {rnd('ema_2', 2)}, {rnd('ema_3', 2)}, {rnd('ema_5', 2)}
        FROM idx i JOIN e ON i.symbol = e.symbol AND i.rn = e.rn""",
    recursive=True,
)
ORACLES["random_sample"] = chain(DAILY, "SELECT * FROM daily ORDER BY md5(symbol || '|' || epoch(ts)::BIGINT || '|42'), symbol, ts LIMIT 200")
_AGGS = (("mean", mean), ("std", std), ("min", low), ("max", high))
ORACLES["tabular_rolling"] = chain(
    DAILY,
    INDEXED,
    f"f AS (SELECT symbol, ts, rn, coalesce({lr(1)}, 0) AS logret_1, coalesce({lr(4)}, 0) AS logret_4 FROM idx)",
    "w AS (SELECT *, "
    + ", ".join(f"{f(c, 24)} AS {c}_{a}_24" for a, f in _AGGS for c in ("logret_1", "logret_4"))
    + " FROM f)",
    "SELECT symbol, ts, "
    + ", ".join(rnd(c, 7) for c in ("logret_1", "logret_4"))
    + ", "
    + ", ".join(rnd(f"{c}_{a}_24", 7) for a, _ in _AGGS for c in ("logret_1", "logret_4"))
    + " FROM w WHERE rn >= 23",
)
ORACLES["acf"] = chain(
    DAILY,
    INDEXED,
    RETURNS,
    """SELECT a.symbol, k.k::INTEGER AS lag, round(corr(a.r1, b.r1), 8) + 0.0::DOUBLE AS acf_r,
       round(corr(a.r1 * a.r1, b.r1 * b.r1), 8) + 0.0::DOUBLE AS acf_r2
     FROM range(1, 50) k(k) JOIN ret a ON TRUE JOIN ret b ON a.symbol = b.symbol AND b.rn = a.rn - k.k
     WHERE a.r1 IS NOT NULL AND b.r1 IS NOT NULL GROUP BY 1, 2""",
)

# --- indicators ---------------------------------------------------------------------------------

ORACLES["realized_vol"] = chain(
    DAILY, INDEXED, RETURNS, f"SELECT symbol, ts, {rnd(std('r1', 24), 8, 'rv_24')}, {rnd(std('r1', 168), 8, 'rv_168')} FROM ret"
)
ORACLES["roc"] = over_idx(rnd(f"({div('close', lag('close', 10))} - 1) * 100", 6, "roc_10"))

CHANNEL = f"chan AS (SELECT *, {high('high', 14)} AS hh, {low('low', 14)} AS ll FROM idx)"
STOCH = f"stoch AS (SELECT *, {div('-100.0 * (hh - close)', 'hh - ll')} AS willr_14, {div('100.0 * (close - ll)', 'hh - ll')} AS stoch_k FROM chan)"
ORACLES["williams_r"] = chain(DAILY, INDEXED, CHANNEL, STOCH, f"SELECT symbol, ts, {rnd('willr_14', 8)} FROM stoch")
ORACLES["stochastic"] = chain(
    DAILY, INDEXED, CHANNEL, STOCH, f"SELECT symbol, ts, {rnd('stoch_k', 8)}, {rnd(mean('stoch_k', 3), 8, 'stoch_d')} FROM stoch"
)
CCI = [
    "tp AS (SELECT *, (high + low + close) / 3.0 AS tp FROM idx)",
    f"dev AS (SELECT *, tp - {mean('tp', 20)} AS dev FROM tp)",
]
ORACLES["cci"] = chain(
    DAILY, INDEXED, *CCI, f"SELECT symbol, ts, {rnd(div('dev', f'(0.015 * ({mean('abs(dev)', 20)}))'), 6, 'cci_20')} FROM dev"
)
BANDS = [
    f"bm AS (SELECT *, {mean('close', 20)} AS m20, {std('close', 20)} AS s20 FROM idx)",
    f"""bands AS (SELECT *, m20 + 2 * s20 AS bb_upper, m20 - 2 * s20 AS bb_lower,
        {div('close - (m20 - 2 * s20)', '(m20 + 2 * s20) - (m20 - 2 * s20)')} AS bb_pctb,
        {div('(m20 + 2 * s20) - (m20 - 2 * s20)', 'm20')} AS bb_bw FROM bm)""",
]
ORACLES["bollinger"] = chain(
    DAILY,
    INDEXED,
    *BANDS,
    f"SELECT symbol, ts, {rnd('bb_upper', 3)}, {rnd('bb_lower', 3)}, {rnd('bb_pctb', 7)}, {rnd('bb_bw', 7)} FROM bands",
)
INPUTS = [
    f"""mv AS (SELECT *, close - {lag('close')} AS dc, {lag('close')} AS pc, high - {lag('high')} AS up,
        {lag('low')} - low AS dn FROM idx)""",
    """inp AS MATERIALIZED (SELECT *, CASE WHEN dc IS NULL THEN NULL WHEN dc > 0 THEN dc ELSE 0 END AS gain,
        CASE WHEN dc IS NULL THEN NULL WHEN dc < 0 THEN -dc ELSE 0 END AS loss,
        CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
        CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm,
        CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM mv)""",
]
SMOOTH = {
    "ag": ("gain", A14), "al": ("loss", A14), "ef": ("close", 2 / 13), "es": ("close", 2 / 27),
    "at": ("tr", A14), "ep": ("pdm", A14), "em": ("mdm", A14),
}
FIRST = [
    scan("e1", "inp", SMOOTH),
    """s1 AS MATERIALIZED (SELECT i.symbol, i.ts, i.rn, e.ef - e.es AS macd_line,
        CASE WHEN i.rn >= 14 THEN 100.0 - 100.0 / (1.0 + e.ag / nullif(e.al, 0)) END AS rsi_14,
        CASE WHEN i.rn >= 13 THEN e.at END AS atr_14,
        CASE WHEN i.rn >= 13 THEN 100.0 * e.ep / nullif(e.at, 0) END AS pdi,
        CASE WHEN i.rn >= 13 THEN 100.0 * e.em / nullif(e.at, 0) END AS mdi
        FROM inp i JOIN e1 e ON i.symbol = e.symbol AND i.rn = e.rn)""",
    "s2 AS MATERIALIZED (SELECT *, 100.0 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM s1)",
]
SECOND = [
    scan("e2", "s2", {"sig": ("macd_line", 0.2), "ax": ("dx", A14)}),
    """s3 AS MATERIALIZED (SELECT s.symbol, s.ts, s.rn, s.rsi_14, s.macd_line, e.sig AS macd_signal,
        s.macd_line - e.sig AS macd_hist, s.atr_14, CASE WHEN s.rn >= 26 THEN e.ax END AS adx_14
        FROM s2 s JOIN e2 e ON s.symbol = e.symbol AND s.rn = e.rn)""",
]
ORACLES["rsi"] = chain(DAILY, INDEXED, *INPUTS, *FIRST, f"SELECT symbol, ts, {rnd('rsi_14', 6)} FROM s1", recursive=True)
ORACLES["atr"] = chain(DAILY, INDEXED, *INPUTS, *FIRST, f"SELECT symbol, ts, {rnd('atr_14', 3)} FROM s1", recursive=True)
ORACLES["macd"] = chain(
    DAILY,
    INDEXED,
    *INPUTS,
    *FIRST,
    *SECOND,
    f"SELECT symbol, ts, {rnd('macd_line', 2)}, {rnd('macd_signal', 2)}, {rnd('macd_hist', 2)} FROM s3",
    recursive=True,
)
ORACLES["adx"] = chain(
    DAILY, INDEXED, *INPUTS, *FIRST, *SECOND, f"SELECT symbol, ts, {rnd('adx_14', 6)} FROM s3", recursive=True
)

TECHNICAL = (
    "logret_1", "logret_4", "logret_24", "logret_168",
    "rv_24", "rv_168", "zscore_24", "zscore_168",
    "rsi_14", "macd_line", "macd_signal", "macd_hist",
    "roc_10", "willr_14", "stoch_k", "stoch_d", "cci_20",
    "bb_upper", "bb_lower", "bb_pctb", "bb_bw", "atr_14", "adx_14",
)
LEVELS = ("macd_line", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "atr_14")
BANK = [
    *INPUTS,
    *FIRST,
    *SECOND,
    f"""t1 AS (SELECT *, {lr(1)} AS logret_1, {lr(4)} AS logret_4, {lr(24)} AS logret_24, {lr(168)} AS logret_168,
        {zscore('close', 24)} AS zscore_24, {zscore('close', 168)} AS zscore_168,
        ({div('close', lag('close', 10))} - 1) * 100 AS roc_10, {high('high', 14)} AS hh, {low('low', 14)} AS ll,
        (high + low + close) / 3.0 AS tp, {mean('close', 20)} AS m20, {std('close', 20)} AS s20 FROM idx)""",
    f"""t2 AS (SELECT *, {std('logret_1', 24)} AS rv_24, {std('logret_1', 168)} AS rv_168,
        {div('-100.0 * (hh - close)', 'hh - ll')} AS willr_14, {div('100.0 * (close - ll)', 'hh - ll')} AS stoch_k,
        tp - {mean('tp', 20)} AS dev, m20 + 2 * s20 AS bb_upper, m20 - 2 * s20 AS bb_lower FROM t1)""",
    f"""t3 AS (SELECT *, {mean('stoch_k', 3)} AS stoch_d, {div('dev', f"(0.015 * ({mean('abs(dev)', 20)}))")} AS cci_20,
        {div('close - bb_lower', 'bb_upper - bb_lower')} AS bb_pctb, {div('bb_upper - bb_lower', 'm20')} AS bb_bw FROM t2)""",
    """bank AS MATERIALIZED (SELECT t3.*, s3.rsi_14, s3.macd_line, s3.macd_signal, s3.macd_hist, s3.atr_14, s3.adx_14
        FROM t3 JOIN s3 ON t3.symbol = s3.symbol AND t3.rn = s3.rn)""",
]
LAGGED = [rnd(lag(c), 2 if c in LEVELS else 6, c) for c in TECHNICAL]
ORACLES["technical_features"] = chain(
    DAILY, INDEXED, *BANK, f"SELECT symbol, ts, {', '.join(LAGGED)} FROM bank", recursive=True
)

# --- macro, sentiment, calendar, targets ---------------------------------------------------------

ALIGNED = [DAILY, EXTERNAL, asof_all("daily")]


def log_change(c: str, k: int) -> str:
    x = f"ln(nullif({c}, 0))"
    return f"{x} - {lag(x, k)}"


def level_change(c: str, k: int) -> str:
    return f"{c} - {lag(c, k)}"


MACRO = {
    **{f"{c}_logret_{k}": log_change(c, k) for c in ("dxy",) for k in (1, 24)},
    "dxy_z168": zscore("dxy", 168),
    "us10y_yield_d1": level_change("us10y_yield", 1),
    "us10y_yield_d24": level_change("us10y_yield", 24),
    "us10y_yield_z168": zscore("us10y_yield", 168),
    **{f"vix_logret_{k}": log_change("vix", k) for k in (1, 24)},
    "vix_z168": zscore("vix", 168),
    "order_flow_level": "order_flow",
    "order_flow_z168": zscore("order_flow", 168),
}
SENTIMENT = {
    "fear_greed_level": "fear_greed",
    "fear_greed_ma24": mean("fear_greed", 24),
    "fear_greed_z168": zscore("fear_greed", 168),
}


def natural(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {c}" for c, sql in columns.items())


ORACLES["macro_features"] = chain(
    *ALIGNED,
    f"n AS (SELECT symbol, ts, {natural(MACRO)} FROM aligned)",
    "SELECT symbol, ts, " + ", ".join(rnd(lag(c), 6, c) for c in MACRO) + " FROM n",
)
_SENT = (
    f"{rnd(lag('fear_greed_level'), 6, 'fear_greed_level')}, "
    f"{rnd(div(lag('fear_greed_ma24'), lag('fear_greed_level')), 6, 'fear_greed_ma24_to_level')}, "
    f"{rnd(lag('fear_greed_z168'), 6, 'fear_greed_z168')}"
)
ORACLES["sentiment_features"] = chain(
    *ALIGNED, f"n AS (SELECT symbol, ts, {natural(SENTIMENT)} FROM aligned)", f"SELECT symbol, ts, {_SENT} FROM n"
)


def cyclic(name: str, x: str, period: int) -> str:
    return ", ".join(rnd(f"{f}(2 * pi() * ({x}) / {period})", 9, f"{name}_{f}") for f in ("sin", "cos"))


CALENDAR = f"""{cyclic('hour', 'hour(ts)', 24)}, {cyclic('dow', 'isodow(ts) - 1', 7)}, {cyclic('month', 'month(ts) - 1', 12)},
  (hour(ts) >= 23 OR hour(ts) < 8)::TINYINT AS is_session_asia,
  (hour(ts) >= 7 AND hour(ts) < 16)::TINYINT AS is_session_eu,
  (hour(ts) >= 13 AND hour(ts) < 22)::TINYINT AS is_session_us"""
ORACLES["calendar_features"] = chain(HOURLY, f"SELECT symbol, ts, {CALENDAR} FROM hourly")


def targets(h: int, base: str = "idx") -> list[str]:
    return [
        f"tg0 AS (SELECT *, {lead('ln(close)', h)} - ln(close) AS y_reg, {lr(1)} AS lr1 FROM {base})",
        f"tg1 AS (SELECT *, {std('lr1', 24)} AS vol FROM tg0)",
        f"tg2 AS (SELECT *, {lag('vol')} AS past, 0.5 * ({lag('vol')}) * sqrt({h}) AS thr FROM tg1)",
        """tg AS MATERIALIZED (SELECT *, CASE WHEN y_reg IS NULL OR thr IS NULL THEN NULL WHEN y_reg > thr THEN 1.0
            WHEN y_reg < -thr THEN -1.0 ELSE 0.0 END::DOUBLE AS y_clf FROM tg2)""",
    ]


TARGETS = [DAILY, INDEXED, *targets(H)]
ORACLES["target_reg"] = chain(*TARGETS, f"SELECT symbol, ts, {rnd('y_reg', 9, 'y_reg_h24')} FROM tg")
ORACLES["target_threshold"] = chain(
    *TARGETS, f"SELECT symbol, ts, {rnd('past', 8, 'rv_past_24')}, {rnd('thr', 8, 'y_clf_threshold')} FROM tg"
)
ORACLES["target_clf"] = chain(*TARGETS, "SELECT symbol, ts, y_clf AS y_clf_h24 FROM tg")
ORACLES["target_rows"] = chain(
    *TARGETS,
    f"SELECT symbol, ts, {rnd('y_reg', 9, 'y_reg_h24')}, y_clf AS y_clf_h24 FROM tg WHERE y_reg IS NOT NULL AND y_clf IS NOT NULL",
)
ORACLES["warmup_cut"] = chain(DAILY, INDEXED, "SELECT symbol, ts, close FROM idx WHERE rn >= 200")
MATRIX = (
    DAILY,
    EXTERNAL,
    asof_all("daily"),
    INDEXED,
    *BANK,
    *targets(H),
    f"n AS (SELECT symbol, ts, {natural({**MACRO, **SENTIMENT})} FROM aligned)",
    "lagged AS (SELECT symbol, ts, " + ", ".join(rnd(lag(c), 6, c) for c in MACRO) + f", {_SENT} FROM n)",
    f"tech AS (SELECT symbol, ts, rn, open, high, low, close, volume, {', '.join(LAGGED)} FROM bank)",
    f"""SELECT t.symbol, t.ts, t.open, t.high, t.low, t.close, t.volume, {', '.join('t.' + c for c in TECHNICAL)},
       {', '.join('l.' + c for c in (*MACRO, 'fear_greed_level', 'fear_greed_ma24_to_level', 'fear_greed_z168'))}, {CALENDAR.replace('ts', 't.ts')},
       {rnd('g.y_reg', 6, 'y_reg_h24')}, g.y_clf AS y_clf_h24, {rnd('g.thr', 6, 'y_clf_threshold')}
     FROM tech t JOIN lagged l ON t.symbol = l.symbol AND t.ts = l.ts JOIN tg g ON t.symbol = g.symbol AND t.ts = g.ts
     WHERE t.rn >= 200""",
)
ORACLES["feature_matrix_full"] = chain(*MATRIX, recursive=True)
FEATURES = tuple(
    sorted(
        (
            *TECHNICAL, *MACRO, "fear_greed_level", "fear_greed_ma24_to_level", "fear_greed_z168",
            *(f"{name}_{f}" for name in ("hour", "dow", "month") for f in ("sin", "cos")), "is_session_asia", "is_session_eu", "is_session_us",
        )
    )
)

# --- validation -------------------------------------------------------------------------------------

ORACLES["dup_check"] = """WITH g AS (SELECT l_returnflag AS symbol, l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2, 3)
SELECT symbol, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS n FROM g GROUP BY 1"""
ORACLES["order_check"] = """WITH g AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts,
  lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders)
SELECT symbol, count(*) FILTER (WHERE p > ts)::BIGINT AS n FROM g GROUP BY 1"""
DAMAGED = [
    DAILY,
    """broken AS (SELECT symbol, ts, open, CASE WHEN day(ts) = 2 THEN low - 1.0 ELSE high END AS high,
        CASE WHEN day(ts) = 3 THEN high + 1.0 ELSE low END AS low, CASE WHEN day(ts) <> 4 THEN close END AS close,
        volume FROM daily)""",
    "dam AS MATERIALIZED (SELECT * FROM broken UNION ALL SELECT * FROM broken WHERE day(ts) = 1)",
]
ORACLES["ohlc_check"] = chain(
    *DAMAGED,
    """SELECT symbol, count(*) FILTER (WHERE high < open OR high < close OR high < low)::BIGINT AS bad_high,
       count(*) FILTER (WHERE low > open OR low > close OR low > high)::BIGINT AS bad_low FROM dam GROUP BY 1""",
)
ORACLES["null_counts"] = chain(
    *DAMAGED, "SELECT symbol, 'close' AS \"column\", count(*)::BIGINT AS n FROM dam WHERE close IS NULL GROUP BY 1"
)
GAPS = [
    HOURLY,
    f"g0 AS (SELECT symbol, ts, {lag('ts')} AS p FROM hourly)",
    """g AS (SELECT *, epoch_us(ts - p) / 3600e6 AS h, isodow(p) = 5 AND isodow(ts) IN (7, 1) AS we FROM g0 WHERE p IS NOT NULL)""",
]
ORACLES["gap_check"] = chain(
    *GAPS,
    """SELECT symbol, CASE WHEN we AND h <= 60 THEN 'WEEKEND_GAPS' ELSE 'WEEKDAY_GAPS' END AS code,
       count(*)::BIGINT AS n, max(h) AS longest FROM g WHERE h > 1 GROUP BY 1, 2""",
)
ORACLES["gap_calendar"] = chain(
    *GAPS,
    """SELECT month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, count(*)::BIGINT AS n FROM g WHERE h > 2 AND NOT we
       GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15""",
)
ORACLES["volume_check"] = chain(
    DAILY,
    """v AS (SELECT symbol, volume FROM daily UNION ALL SELECT symbol || '_flat', 0.0 FROM daily)""",
    "SELECT symbol, 'info' AS severity, 'VOLUME_ALL_ZERO' AS code FROM v GROUP BY symbol HAVING bool_and(volume = 0)",
)
ISSUES = [
    *DAMAGED,
    f"""dg AS (SELECT symbol, ts, p, epoch_us(ts - p) / 3600e6 AS h, isodow(p) = 5 AND isodow(ts) IN (7, 1) AS we
        FROM (SELECT symbol, ts, {lag('ts')} AS p FROM dam) WHERE p IS NOT NULL)""",
    """allissues AS (
  SELECT symbol, 'error' AS severity, 'DUPLICATES' AS code, sum(c)::BIGINT AS n FROM
    (SELECT symbol, ts, count(*) AS c FROM dam GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT symbol, 'error', 'OHLC_HIGH_INCONSISTENT', count(*)::BIGINT FROM dam
    WHERE high < open OR high < close OR high < low GROUP BY 1
  UNION ALL SELECT symbol, 'error', 'OHLC_LOW_INCONSISTENT', count(*)::BIGINT FROM dam
    WHERE low > open OR low > close OR low > high GROUP BY 1
  UNION ALL SELECT symbol, 'warning', 'NAN_VALUES', count(*)::BIGINT FROM dam WHERE close IS NULL GROUP BY 1
  UNION ALL SELECT symbol, 'warning', 'WEEKDAY_GAPS', count(*)::BIGINT FROM dg WHERE h > 2 AND NOT (we AND h <= 60) GROUP BY 1
  UNION ALL SELECT symbol, 'info', 'WEEKEND_GAPS', count(*)::BIGINT FROM dg WHERE h > 2 AND we AND h <= 60 GROUP BY 1
  UNION ALL SELECT symbol, 'info', 'VOLUME_ALL_ZERO', 1::BIGINT FROM dam GROUP BY 1 HAVING bool_and(volume = 0))""",
]
ORACLES["validation_report"] = chain(*ISSUES, "SELECT symbol, severity, code, n FROM allissues")
ORACLES["issue_summary"] = chain(
    *ISSUES,
    "SELECT symbol, "
    + ", ".join(f"count(*) FILTER (WHERE severity = '{s}')::BIGINT AS {s}" for s in ("info", "warning", "error"))
    + " FROM allissues GROUP BY 1",
)

# --- profile ------------------------------------------------------------------------------------------

ORACLES["series_summary"] = chain(
    HOURLY,
    f"p AS (SELECT *, abs({div('close', lag('close'))} - 1) AS m FROM hourly)",
    f"""SELECT symbol, count(*)::BIGINT AS n_rows, min(ts) AS start_ts, max(ts) AS end_ts,
       {rnd("floor(epoch_us(max(ts) - min(ts)) / 86400e6) / 365.25", 2, 'span_years')},
       min(low) AS price_min, max(high) AS price_max, count(DISTINCT ts::DATE)::BIGINT AS n_unique_days,
       {rnd('quantile_cont(m, 0.5) * 100', 6, 'median_return_pct')} FROM p GROUP BY 1""",
)
FEATURE_ROWS = [
    *MATRIX[:-1],
    f"feat0 AS MATERIALIZED ({MATRIX[-1]})",
    """feat AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::BIGINT AS rn,
        (count(*) OVER (PARTITION BY symbol))::BIGINT AS n_rows FROM feat0)""",
]


def share(r: str) -> str:
    return f"floor(n_rows * {r}::DOUBLE)"


TRAIN_END, VAL_LEN, TEST_LEN = share("0.7"), share("0.15"), share("0.15")


def splits(base: str, name: str = "spl", embargo: int = 24) -> str:
    return f"""{name}0 AS (SELECT *, {TRAIN_END}::BIGINT AS te, ({TRAIN_END} + {VAL_LEN})::BIGINT AS ve,
        ({TRAIN_END} + {VAL_LEN} + {TEST_LEN})::BIGINT AS xe FROM {base}),
{name} AS MATERIALIZED (SELECT *, CASE WHEN rn < te - {embargo} THEN 'train' WHEN rn >= te AND rn < ve - {embargo} THEN 'val'
        WHEN rn >= ve AND rn < xe THEN 'test' END AS split,
        CASE WHEN rn < te - {embargo} THEN rn WHEN rn >= te AND rn < ve - {embargo} THEN rn - te
        WHEN rn >= ve AND rn < xe THEN rn - ve END AS split_row FROM {name}0)"""


SPLIT_FEATURES = [*FEATURE_ROWS, splits("feat")]
ORACLES["null_rates"] = chain(
    *FEATURE_ROWS,
    "r AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(({c} IS NULL)::INTEGER) AS rate FROM feat" for c in (*FEATURES, "y_reg_h24", "y_clf_h24")
    )
    + ")",
    f'SELECT "column", {rnd("rate", 9)} FROM r ORDER BY r.rate DESC, 1 LIMIT 8',
)
ORACLES["class_balance"] = chain(*TARGETS, "SELECT symbol, y_clf AS y_clf_h24, count(*)::BIGINT AS n FROM tg GROUP BY 1, 2")
ORACLES["target_stats"] = chain(
    *TARGETS,
    f"SELECT symbol, {rnd('avg(y_reg) * 1e4', 5, 'mean_bp')}, {rnd('stddev_samp(y_reg) * 1e4', 5, 'std_bp')} FROM tg GROUP BY 1",
)
ORACLES["describe_bars"] = chain(
    HOURLY,
    "u AS (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS \"column\", {c} AS v FROM hourly" for c in ("open", "high", "low", "close")) + ")",
    f"""SELECT symbol, "column", count(v)::BIGINT AS n, {rnd('ln(avg(v))', 6, 'log_mean')}, {rnd('stddev_samp(v)', 6, 'std')},
       min(v) AS min, max(v) AS max, {rnd('quantile_cont(v, 0.25)', 6, 'q25')}, {rnd('quantile_cont(v, 0.5)', 6, 'q50')},
       {rnd('quantile_cont(v, 0.75)', 6, 'q75')} FROM u GROUP BY 1, 2""",
)
ORACLES["return_moments"] = chain(
    DAILY,
    INDEXED,
    RETURNS,
    f"""SELECT symbol, {rnd('avg(r1) * 1e4', 5, 'mean_bp')}, {rnd('stddev_samp(r1) * 1e4', 5, 'std_bp')},
       {rnd('skewness(r1)', 5, 'skew')}, {rnd('kurtosis(r1)', 5, 'kurt')} FROM ret WHERE r1 IS NOT NULL GROUP BY 1""",
)
ORACLES["hourly_volatility"] = chain(
    HOURLY,
    f"r AS (SELECT symbol, ts, {lr(1)} AS r FROM hourly)",
    f"SELECT symbol, hour(ts)::INTEGER AS hour, {rnd('avg(abs(r)) * 100', 7, 'mean_abs_pct')} FROM r WHERE r IS NOT NULL GROUP BY 1, 2",
)
ORACLES["feature_quartiles"] = chain(
    *FEATURE_ROWS,
    "qs AS (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS feature, unnest([0.25, 0.5, 0.75])::DOUBLE AS p, unnest(quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75])) AS q FROM feat GROUP BY 1" for c in FEATURES) + ")",
    f"SELECT symbol, feature, p, {rnd('q', 7)} FROM qs WHERE q IS NOT NULL",
)
ORACLES["feature_corr"] = chain(
    *FEATURE_ROWS,
    " UNION ALL ".join(
        f"SELECT symbol, '{a}' AS \"left\", '{b}' AS \"right\", {rnd(f'corr({a}, {b})', 6, 'corr')} FROM feat GROUP BY 1"
        for i, a in enumerate(FEATURES)
        for b in FEATURES[i + 1 :]
    ),
)
ORACLES["target_corr"] = chain(
    *FEATURE_ROWS,
    " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS feature, {rnd(f'corr({c}, y_reg_h24)', 6, 'corr')} FROM feat GROUP BY 1" for c in FEATURES
    ),
)


def _information(target: str) -> list[str]:
    t = target.replace("_h24", "")
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*FEATURES, target))
    grid = "[" + ", ".join(f"{i / 10!r}::DOUBLE" for i in range(1, 10)) + "]"
    cells = " UNION ALL ".join(
        f"""SELECT k.symbol, '{c}' AS feature, len(list_filter(q.e_{c}, lambda e: e < k.{c})) AS bx,
        len(list_filter(q.e_y, lambda e: e < k.{target})) AS by_ FROM k_{t} k JOIN q_{t} q ON k.symbol = q.symbol"""
        for c in FEATURES
    )
    edges = ", ".join(f"quantile_cont({c}, {grid}) AS e_{c}" for c in FEATURES)
    return [
        f"k_{t} AS MATERIALIZED (SELECT * FROM feat WHERE {known})",
        f"q_{t} AS (SELECT symbol, {edges}, quantile_cont({target}, {grid}) AS e_y FROM k_{t} GROUP BY 1)",
        f"""j_{t} AS (SELECT symbol, feature, bx, by_, count(*)::DOUBLE AS n FROM ({cells}) GROUP BY 1, 2, 3, 4)""",
        f"""m_{t} AS (SELECT symbol, feature, n, sum(n) OVER (PARTITION BY symbol, feature, bx) AS nx,
        sum(n) OVER (PARTITION BY symbol, feature, by_) AS ny, sum(n) OVER (PARTITION BY symbol, feature) AS na FROM j_{t})""",
        f"i_{t} AS (SELECT symbol, feature, sum(n / na * ln(n * na / (nx * ny))) AS mi, '{target}' AS target FROM m_{t} GROUP BY 1, 2)",
    ]


ORACLES["binned_mi"] = chain(
    *FEATURE_ROWS,
    *_information("y_reg_h24"),
    *_information("y_clf_h24"),
    f"SELECT symbol, feature, target, {rnd('mi', 8)} FROM (SELECT * FROM i_y_reg UNION ALL SELECT * FROM i_y_clf)",
)


def hist(base: str, x: str, bins: int) -> str:
    return f"""hb AS (SELECT symbol, min({x}) AS lo, max({x}) AS hi, count({x}) AS c FROM {base} WHERE {x} IS NOT NULL GROUP BY 1),
hist AS (SELECT b.symbol, least(coalesce(floor(({x} - lo) * {bins} / nullif(hi - lo, 0)), 0), {bins - 1})::BIGINT AS bin,
        count(*)::BIGINT AS n, any_value(lo) + least(coalesce(floor(({x} - lo) * {bins} / nullif(hi - lo, 0)), 0), {bins - 1}) * any_value((hi - lo) / {bins}) AS left_edge,
        count(*) / (any_value(c) * any_value((hi - lo) / {bins})) AS density
        FROM {base} b JOIN hb ON b.symbol = hb.symbol WHERE {x} IS NOT NULL
        GROUP BY b.symbol, least(coalesce(floor(({x} - lo) * {bins} / nullif(hi - lo, 0)), 0), {bins - 1}))"""


ORACLES["return_hist"] = chain(
    DAILY, INDEXED, RETURNS, hist("ret", "r1", 200), f"SELECT symbol, bin, n, {rnd('left_edge', 8)}, {rnd('density', 8)} FROM hist"
)


def _qq() -> str:
    from statistics import NormalDist

    grid = [i / 100 for i in range(1, 100)]
    values = ", ".join(f"({i}, {p!r}::DOUBLE, {NormalDist().inv_cdf(p)!r}::DOUBLE)" for i, p in enumerate(grid, 1))
    probs = "[" + ", ".join(f"{p!r}::DOUBLE" for p in grid) + "]"
    return chain(
        DAILY,
        INDEXED,
        RETURNS,
        f"z(i, p, z) AS (VALUES {values})",
        f"q AS (SELECT symbol, quantile_cont(r1, {probs}) AS qs FROM ret WHERE r1 IS NOT NULL GROUP BY 1)",
        f"SELECT q.symbol, z.p, {rnd('z.z', 8, 'normal_q')}, {rnd('q.qs[z.i]', 8, 'return_q')} FROM q, z",
    )


ORACLES["qq_points"] = _qq()

# --- splits and datasets --------------------------------------------------------------------------------

SPLITS = [DAILY, INDEXED, splits("idx")]
ORACLES["chrono_split"] = chain(*SPLITS, "SELECT symbol, ts, split, split_row FROM spl WHERE split IS NOT NULL")


def summary(*keys: str) -> str:
    return f"""SELECT {', '.join(keys)}, count(*)::BIGINT AS rows, min(ts) AS start_ts, max(ts) AS end_ts,
       min(rn)::BIGINT AS start_idx, (max(rn) + 1)::BIGINT AS end_idx"""


ORACLES["split_summary"] = chain(*SPLITS, f"{summary('symbol', 'split')} FROM spl WHERE split IS NOT NULL GROUP BY ALL")
ORACLES["walk_forward"] = chain(
    DAILY,
    INDEXED,
    f"wf0 AS (SELECT *, {share('0.4')}::BIGINT AS t0, ((n_rows - {share('0.4')}::BIGINT) // 5)::BIGINT AS fs FROM idx)",
    "wf1 AS (SELECT w.*, k.k::INTEGER AS fold, t0 + k.k * fs AS te FROM wf0 w, range(0, 5) k(k))",
    """wf AS (SELECT *, CASE WHEN rn < te - 24 THEN 'train' WHEN rn >= te AND rn < te + fs - 24 THEN 'val' END AS role
        FROM wf1 WHERE fs > 24)""",
    f"{summary('symbol', 'fold', 'role')} FROM wf WHERE role IS NOT NULL GROUP BY ALL",
)
ORACLES["ts_cv_folds"] = chain(
    DAILY,
    INDEXED,
    "cv0 AS (SELECT *, n_rows // 4 AS blk, n_rows - 3 * (n_rows // 4) AS first FROM idx)",
    """cv1 AS (SELECT c.*, k.k::INTEGER AS fold, floor(s.s * first)::BIGINT AS train_rows FROM cv0 c, range(0, 3) k(k),
        (VALUES (0.2::DOUBLE), (0.36::DOUBLE), (0.52::DOUBLE), (0.68::DOUBLE), (0.84::DOUBLE), (1.0::DOUBLE)) s(s))""",
    """cv AS (SELECT *, CASE WHEN rn < train_rows THEN 'train'
        WHEN rn >= first + fold * blk AND rn < first + fold * blk + blk THEN 'val' END AS role FROM cv1)""",
    f"{summary('symbol', 'fold', 'train_rows', 'role')} FROM cv WHERE role IS NOT NULL GROUP BY ALL",
)
ORACLES["scaler_fit"] = chain(
    *SPLIT_FEATURES,
    " UNION ALL ".join(
        f"""SELECT symbol, '{c}' AS feature, {rnd(f'avg({c})', 5, 'mean')},
        {rnd(f'CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END', 5, 'scale')} FROM spl WHERE split = 'train' GROUP BY 1"""
        for c in FEATURES
    ),
)
SCALED = [
    *SPLIT_FEATURES,
    "st AS (SELECT symbol, "
    + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in FEATURES)
    + " FROM spl WHERE split = 'train' GROUP BY 1)",
    "scl AS MATERIALIZED (SELECT spl.symbol, ts, rn, split, close, y_reg_h24, y_clf_h24, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES)
    + " FROM spl JOIN st ON spl.symbol = st.symbol)",
]
ORACLES["scaled_features"] = chain(*SCALED, "SELECT symbol, ts, " + ", ".join(rnd(f"coalesce({c}, 0)", 5, c) for c in FEATURES) + " FROM scl")
ORACLES["tabular_split"] = chain(
    *SCALED,
    "SELECT symbol, ts, split, "
    + ", ".join(rnd(c, 5) for c in FEATURES)
    + ", y_reg_h24, y_clf_h24, close FROM scl WHERE split IS NOT NULL",
)
_BY_FEATURE = " + ".join(f"{k + 1} * f_{c}::DOUBLE" for k, c in enumerate(FEATURES))
WINDOWS = [
    *SCALED,
    "sf AS (SELECT *, " + ", ".join(f"coalesce({c}, 0)::FLOAT AS f_{c}" for c in FEATURES) + " FROM scl)",
    f"""win AS (SELECT symbol, ts, rn, split, y_reg_h24, y_clf_h24, (count(*) {frame(168)})::INTEGER AS steps,
        sum({' + '.join(f'f_{c}::DOUBLE' for c in FEATURES)}) {frame(168)} AS total,
        sum(rn * ({_BY_FEATURE})) {frame(168)} - (rn - 168) * sum({_BY_FEATURE}) {frame(168)} AS weighted,
        first_value(f_{FEATURES[0]}::DOUBLE) {frame(168)} AS oldest, f_{FEATURES[-1]}::DOUBLE AS newest FROM sf)""",
]
ORACLES["sequences"] = chain(
    *WINDOWS,
    f"""SELECT symbol, ts, steps, {rnd('total', 3)}, {rnd('weighted', 0)}, {rnd('oldest', 3)}, {rnd('newest', 3)}, y_clf_h24 FROM win
        WHERE rn >= 167 AND y_reg_h24 IS NOT NULL""",
)
ORACLES["stored_windows"] = ORACLES["sequences"]
ORACLES["segment_windows"] = chain(
    *WINDOWS,
    """SELECT symbol, split, count(*)::BIGINT AS n, min(ts) AS first_end, max(ts) AS last_end, min(steps)::INTEGER AS steps FROM win
       WHERE rn >= 167 AND y_reg_h24 IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2""",
)
ORACLES["context_windows"] = over_idx(
    f"(count(*) {frame(512)})::INTEGER AS steps",
    f"first_value(close::FLOAT::DOUBLE) {frame(512)} AS oldest",
    "close::FLOAT::DOUBLE AS newest",
)
ORACLES["train_medians"] = chain(
    *SPLIT_FEATURES,
    " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS feature, {rnd(f'quantile_cont({c}, 0.5)', 7, 'median')} FROM spl WHERE split = 'train' GROUP BY 1"
        for c in FEATURES
    ),
)
ORACLES["imputed_features"] = chain(
    *SPLIT_FEATURES,
    "md AS (SELECT symbol, " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in FEATURES) + " FROM spl WHERE split = 'train' GROUP BY 1)",
    "SELECT spl.symbol, ts, " + ", ".join(rnd(f"coalesce({c}, m_{c})", 6, c) for c in FEATURES) + " FROM spl JOIN md ON spl.symbol = md.symbol",
)
ORACLES["label_recode"] = chain(
    *TARGETS, "SELECT symbol, ts, (y_clf + 1)::INTEGER AS class_index, y_clf AS label FROM tg WHERE y_clf IS NOT NULL"
)

# --- baselines ---------------------------------------------------------------------------------------------

SPLIT_TARGETS = [*TARGETS, splits("tg")]
ORACLES["naive_zero"] = chain(
    *SPLIT_TARGETS, f"SELECT symbol, ts, split, {rnd('y_reg', 9, 'y_true')}, 0.0::DOUBLE AS y_pred FROM spl WHERE split IS NOT NULL"
)
MAJOR = """maj AS (SELECT symbol, first(y_clf ORDER BY n DESC, y_clf) AS majority FROM
    (SELECT symbol, y_clf, count(*) AS n FROM spl WHERE split = 'train' AND y_clf IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
ORACLES["majority_class"] = chain(*SPLIT_TARGETS, MAJOR, "SELECT symbol, majority FROM maj")
ORACLES["majority_pred"] = chain(
    *SPLIT_TARGETS,
    MAJOR,
    """SELECT spl.symbol, ts, split, y_clf AS y_true, majority AS y_pred, (majority = -1)::INTEGER::DOUBLE AS p_neg,
       (majority = 0)::INTEGER::DOUBLE AS p_neu, (majority = 1)::INTEGER::DOUBLE AS p_pos
     FROM spl JOIN maj ON spl.symbol = maj.symbol WHERE split IS NOT NULL""",
)
_TERMS = ["1.0::DOUBLE", *[f"r_{k}" for k in range(6)]]
ORACLES["ar_moments"] = chain(
    DAILY,
    INDEXED,
    RETURNS,
    "lg AS (SELECT *, r1 AS r_0, " + ", ".join(f"{lag('r1', k)} AS r_{k}" for k in range(1, 6)) + " FROM ret)",
    splits("lg"),
    "SELECT symbol, "
    + ", ".join(rnd(f"sum({a} * {b})", 5, f"s_{i}_{j}") for i, a in enumerate(_TERMS) for j, b in enumerate(_TERMS) if j >= i)
    + " FROM spl WHERE split = 'train' AND "
    + " AND ".join(f"r_{k} IS NOT NULL" for k in range(6))
    + " GROUP BY 1",
)
_SPLIT_ORDER = "OVER (PARTITION BY symbol, split ORDER BY ts)"
RESTARTED = [
    *SPLITS,
    f"rs AS (SELECT *, coalesce(ln(close) - lag(ln(close)) {_SPLIT_ORDER}, 0) AS r FROM spl WHERE split IS NOT NULL)",
    f"s1 AS (SELECT *, coalesce(lag(r) {_SPLIT_ORDER}, 0) AS f0, r AS f1 FROM rs)",
    # one step of the recursion after the other: 24 forecasts follow f0 and f1
    *[f"s{k} AS (SELECT *, 0.01::DOUBLE - 0.4::DOUBLE * f{k - 1} + 0.2::DOUBLE * f{k - 2} AS f{k} FROM s{k - 1})" for k in range(2, H + 2)],
    f"""fc0 AS (SELECT *, {' + '.join(f'f{k}' for k in range(2, H + 2))} AS y_pred,
        CASE WHEN split_row >= 23 THEN stddev_samp(r) OVER (PARTITION BY symbol, split ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS v FROM s25)""",
    f"fc AS (SELECT *, 0.5 * (lag(v) {_SPLIT_ORDER}) * sqrt(24) AS thr FROM fc0)",
]
ORACLES["ar_forecast"] = chain(*RESTARTED, f"SELECT symbol, ts, split, {rnd('y_pred', 8)} FROM fc")
ORACLES["ar_labels"] = chain(
    *RESTARTED,
    "SELECT symbol, ts, split, CASE WHEN y_pred > thr THEN 1.0 WHEN y_pred < -thr THEN -1.0 ELSE 0.0 END::DOUBLE AS y_label FROM fc",
)

RETURN_LAGS = [DAILY, INDEXED, RETURNS, "lg AS (SELECT *, r1 AS r_0, " + ", ".join(f"{lag('r1', k)} AS r_{k}" for k in range(1, 6)) + " FROM ret)"]


def ar_solution(base: str, keys: str) -> list[str]:
    """Steps from rows with ``r_0 .. r_5`` to ``best``: the AR of the lowest AIC per group, by elimination.

    Row and column ``i`` stand for the constant (0) and lag ``i``, the last for the return. Once 0 .. p are
    eliminated, the last column holds the coefficients of order p and its last entry the squares left.
    """
    terms, last = ["1.0::DOUBLE", *[f"r_{k}" for k in range(1, 6)], "r_0"], 6
    moments = ", ".join(f"sum({terms[i]} * {terms[j]}) AS g_{i}_{j}" for i in range(7) for j in range(7))
    known = " AND ".join(f"r_{k} IS NOT NULL" for k in range(6))
    steps = [f"el AS MATERIALIZED (SELECT {keys}, count(*)::DOUBLE AS n, {moments} FROM {base} WHERE {known} GROUP BY ALL)"]
    before, fits = "el", []
    for k in range(last):
        cells = [
            (f"g_{k}_{j} / g_{k}_{k}" if i == k else f"g_{i}_{j} - g_{i}_{k} * g_{k}_{j} / g_{k}_{k}") + f" AS g_{i}_{j}"
            for i in range(7)
            for j in range(k + 1, 7)
        ]
        steps.append(f"el{k} AS MATERIALIZED (SELECT {keys}, n, {', '.join(cells)} FROM {before})")
        before = f"el{k}"
        if k in (1, 2, 3, 5):
            phi = ", ".join((f"g_{i}_6" if i <= k else "NULL::DOUBLE") + f" AS phi_{i}" for i in range(1, last))
            fits.append(f"SELECT {keys}, {k} AS p, g_0_6 AS intercept, {phi}, n * ln(g_6_6 / n) + {2 * (k + 2)} AS aic FROM el{k}")
    steps.append(f"fits AS ({' UNION ALL '.join(fits)})")
    steps.append(f"best AS MATERIALIZED (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY aic, p) = 1)")
    return steps


PHI = [f"phi_{k}" for k in range(1, 6)]
ORACLES["ar_fold_fit"] = chain(
    *RETURN_LAGS,
    f"wf0 AS (SELECT *, {share('0.4')}::BIGINT AS t0, ((n_rows - {share('0.4')}::BIGINT) // 5)::BIGINT AS fs FROM lg)",
    "wf AS (SELECT w.*, k.k::INTEGER AS fold FROM wf0 w, range(0, 5) k(k) WHERE rn < t0 + k.k * fs - 24)",
    *ar_solution("wf", "symbol, fold"),
    f"SELECT symbol, fold, p::INTEGER AS p, {', '.join(rnd(c, 7) for c in ('intercept', *PHI))}, {rnd('aic', 5)} FROM best",
)
_AHEAD = [
    f"c{k} AS (SELECT *, intercept + {' + '.join(f'coalesce(phi_{j}, 0) * f{k - j}' for j in range(1, 6))} AS f{k} FROM c{k - 1})"
    for k in range(5, H + 5)
]
FITTED = [
    *TARGETS,
    splits("tg"),
    RETURNS,
    RETURN_LAGS[-1],
    "tr AS (SELECT lg.* FROM lg JOIN spl ON lg.symbol = spl.symbol AND lg.rn = spl.rn WHERE split = 'train')",
    *ar_solution("tr", "symbol"),
    MAJOR,
    f"rs AS (SELECT *, coalesce(ln(close) - lag(ln(close)) {_SPLIT_ORDER}, 0) AS r FROM spl WHERE split IS NOT NULL)",
    # the newest return is f4; the 24 forecasts f5 .. f28 follow
    "c4 AS (SELECT rs.*, intercept, "
    + ", ".join(PHI)
    + ", r AS f4, "
    + ", ".join(f"coalesce(lag(r, {j}) OVER (PARTITION BY rs.symbol, split ORDER BY ts), 0) AS f{4 - j}" for j in range(1, 5))
    + " FROM rs JOIN best ON rs.symbol = best.symbol)",
    *_AHEAD,
    f"""fv AS (SELECT *, {' + '.join(f'f{k}' for k in range(5, H + 5))} AS fc,
        CASE WHEN split_row >= 23 THEN stddev_samp(r) OVER (PARTITION BY symbol, split ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS v FROM c{H + 4})""",
    f"ft AS MATERIALIZED (SELECT *, 0.5 * (lag(v) {_SPLIT_ORDER}) * sqrt(24) AS nz FROM fv)",
]
_PARTS = (
    ("naive_zero", "regression", "y_reg", "0.0::DOUBLE"),
    ("majority", "classification", "y_clf", "(SELECT majority FROM maj WHERE maj.symbol = ft.symbol)"),
    ("autoregression", "regression", "y_reg", "fc"),
    ("autoregression", "classification", "y_clf", "CASE WHEN fc > nz THEN 1.0 WHEN fc < -nz THEN -1.0 ELSE 0.0 END::DOUBLE"),
)
ORACLES["baseline_forecasts"] = chain(
    *FITTED,
    " UNION ALL ".join(
        f"SELECT '{m}' AS model, '{t}' AS task, symbol, ts, split, {rnd(y, 7, 'y_true')}, {rnd(value, 7, 'y_pred')} FROM ft"
        for m, t, y, value in _PARTS
    ),
)
ORACLES["run_ledger"] = chain(
    *SPLITS,
    """sz AS (SELECT count_if(split = 'train')::BIGINT AS n_train, count_if(split = 'val')::BIGINT AS n_val,
        count_if(split = 'test')::BIGINT AS n_test FROM spl)""",
    """SELECT v.*, n_train, n_val, n_test FROM sz, (VALUES ('naive_zero', 'regression', 'y_reg_h24', 0::INTEGER),
        ('majority', 'classification', 'y_clf_h24', 0), ('autoregression', 'regression', 'y_reg_h24', 1),
        ('autoregression', 'classification', 'y_clf_h24', 1)) v(model, task, target, n_features)""",
)

# --- metrics and diagnostics ---------------------------------------------------------------------------------

PREDS = [
    DAILY,
    INDEXED,
    *targets(HORIZON),
    f"pr0 AS (SELECT symbol, ts, rn, n_rows, close, y_reg, y_clf, thr, {lr(HORIZON)} AS p FROM tg)",
    """pr AS MATERIALIZED (SELECT symbol, ts, rn, n_rows, y_reg AS y_true, -0.5 * p AS y_pred, y_clf AS c_true,
        CASE WHEN p IS NULL OR thr IS NULL THEN NULL WHEN -0.5 * p > thr THEN 1.0 WHEN -0.5 * p < -thr THEN -1.0 ELSE 0.0 END AS c_pred,
        round(exp(p) / (exp(-p) + 1 + exp(p)), 3) AS p_neg, round(1 / (exp(-p) + 1 + exp(p)), 3) AS p_neu,
        round(exp(-p) / (exp(-p) + 1 + exp(p)), 3) AS p_pos FROM pr0)""",
    "ok AS MATERIALIZED (SELECT * FROM pr WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)",
    "cl AS MATERIALIZED (SELECT symbol, c_true AS t, c_pred AS p FROM pr WHERE c_true IS NOT NULL AND c_pred IS NOT NULL)",
]
ORACLES["downsample"] = chain(
    *PREDS,
    f"k AS (SELECT *, row_number() {ORDER} - 1 AS k FROM ok)",
    f"SELECT symbol, ts, {rnd('y_true', 8)}, {rnd('y_pred', 8)} FROM k WHERE k % 7 = 0",
)
METRICS = """m AS (SELECT symbol, avg((y_true - y_pred) ^ 2) AS mse, sqrt(avg((y_true - y_pred) ^ 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae,
        avg(CASE WHEN abs(y_true) > 1e-12 THEN abs((y_true - y_pred) / y_true) END) AS mape,
        1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)) AS r2,
        avg((sign(y_true) = sign(y_pred))::INTEGER) AS directional_accuracy, corr(y_true, y_pred) AS pearson,
        corr(rt, rp) AS spearman, avg(y_pred - y_true) AS bias FROM rk GROUP BY 1)"""
RANKED = """rk AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY y_true) + (count(*) OVER (PARTITION BY symbol, y_true) - 1) / 2.0 AS rt,
        rank() OVER (PARTITION BY symbol ORDER BY y_pred) + (count(*) OVER (PARTITION BY symbol, y_pred) - 1) / 2.0 AS rp FROM ok)"""
_REG = ("mse", "rmse", "mae", "mape", "r2", "directional_accuracy", "pearson", "spearman", "bias")
ORACLES["regression_metrics"] = chain(
    *PREDS, RANKED, METRICS, "SELECT symbol, " + ", ".join(rnd(c, 6) for c in _REG) + " FROM m"
)
_C = (-1, 0, 1)
_N = {-1: "neg", 0: "neu", 1: "pos"}
COUNTS = (
    "cm AS (SELECT symbol, count(*)::DOUBLE AS n, "
    + ", ".join(f"count(*) FILTER (WHERE t = {t} AND p = {p})::DOUBLE AS c_{_N[t]}_{_N[p]}" for t in _C for p in _C)
    + " FROM cl GROUP BY 1)"
)
_T = {c: f"(c_{c}_neg + c_{c}_neu + c_{c}_pos)" for c in _N.values()}
_P = {c: f"(c_neg_{c} + c_neu_{c} + c_pos_{c})" for c in _N.values()}
SCORES = (
    "sco AS (SELECT *, "
    + ", ".join(
        f"coalesce(c_{c}_{c} / nullif({_P[c]}, 0), 0) AS pr_{c}, coalesce(c_{c}_{c} / nullif({_T[c]}, 0), 0) AS re_{c}, "
        f"coalesce(2 * c_{c}_{c} / nullif({_T[c]} + {_P[c]}, 0), 0) AS f_{c}, {_T[c]} AS su_{c}, {_P[c]} AS pp_{c}"
        for c in _N.values()
    )
    + " FROM cm)"
)


def _macro(p: str) -> str:
    return f"({p}_neg + {p}_neu + {p}_pos) / 3.0"


def _weighted(p: str) -> str:
    return f"({' + '.join(f'{p}_{c} * su_{c}' for c in _N.values())}) / n"


ORACLES["classification_metrics"] = chain(
    *PREDS,
    COUNTS,
    SCORES,
    f"""SELECT symbol, {rnd('(c_neg_neg + c_neu_neu + c_pos_pos) / n', 9, 'accuracy')}, {rnd(_macro('f'), 9, 'f1_macro')},
       {rnd("coalesce(((c_neg_neg + c_neu_neu + c_pos_pos) * n - (su_neg * pp_neg + su_neu * pp_neu + su_pos * pp_pos)) / nullif(sqrt((n * n - (pp_neg * pp_neg + pp_neu * pp_neu + pp_pos * pp_pos)) * (n * n - (su_neg * su_neg + su_neu * su_neu + su_pos * su_pos))), 0), 0)", 9, 'mcc')},
       {rnd(_macro('pr'), 9, 'precision_macro')}, {rnd(_macro('re'), 9, 'recall_macro')} FROM sco""",
)
ORACLES["confusion"] = chain(
    *PREDS,
    COUNTS,
    " UNION ALL ".join(
        f"SELECT symbol, {t}::INTEGER AS y_true, "
        + ", ".join(f"c_{_N[t]}_{p}::BIGINT AS {p}" for p in _N.values())
        + ", "
        + ", ".join(rnd(f"c_{_N[t]}_{p} / greatest({_T[_N[t]]}, 1) * 100.0", 6, f"{p}_pct") for p in _N.values())
        + " FROM cm"
        for t in _C
    ),
)


def _line(label: str, p: str, r: str, f: str, s: str) -> str:
    return f"SELECT symbol, '{label}' AS label, {rnd(p, 9, 'precision')}, {rnd(r, 9, 'recall')}, {rnd(f, 9, 'f1')}, {s} AS support FROM sco"


ORACLES["class_report"] = chain(
    *PREDS,
    COUNTS,
    SCORES,
    " UNION ALL ".join(
        [
            *[_line(str(c), f"pr_{_N[c]}", f"re_{_N[c]}", f"f_{_N[c]}", f"su_{_N[c]}") for c in _C],
            _line("macro avg", _macro("pr"), _macro("re"), _macro("f"), "n"),
            _line("weighted avg", _weighted("pr"), _weighted("re"), _weighted("f"), "n"),
        ]
    ),
)
CURVES = [
    *PREDS,
    "ov AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, {c}::INTEGER AS label, p_{_N[c]} AS score, (c_true = {c})::INTEGER AS hit FROM pr WHERE c_true IS NOT NULL" for c in _C
    )
    + ")",
    "pt0 AS (SELECT symbol, label, score, sum(hit)::DOUBLE AS pos, sum(1 - hit)::DOUBLE AS neg FROM ov GROUP BY 1, 2, 3)",
    """pt AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS np, sum(neg) OVER g AS nn FROM pt0
        WINDOW w AS (PARTITION BY symbol, label ORDER BY score DESC), g AS (PARTITION BY symbol, label))""",
]
ORACLES["roc_auc"] = chain(
    *CURVES,
    f"""SELECT symbol, label, {rnd('sum(neg * (tp - pos / 2.0)) / (max(np) * max(nn))', 9, 'auc')}, max(np)::BIGINT AS positives,
        (max(np) + max(nn))::BIGINT AS n FROM pt WHERE np > 0 AND nn > 0 GROUP BY 1, 2""",
)
ORACLES["roc_curve"] = chain(
    *CURVES, f"SELECT symbol, label, score, {rnd('fp / nn', 9, 'fpr')}, {rnd('tp / np', 9, 'tpr')} FROM pt WHERE np > 0 AND nn > 0"
)
ORACLES["pr_ap"] = chain(
    *CURVES,
    f"""SELECT symbol, label, {rnd('sum(pos / np * tp / (tp + fp))', 9, 'average_precision')}, {rnd('max(np / (np + nn))', 9, 'prevalence')}
        FROM pt WHERE np > 0 GROUP BY 1, 2""",
)
ORACLES["monthly_dir_acc"] = chain(
    *PREDS,
    "mo AS (SELECT symbol, last_day(ts) AS month_end, avg((sign(y_true) = sign(y_pred))::INTEGER) AS d FROM ok GROUP BY 1, 2)",
    """sp AS (SELECT symbol, last_day(unnest(generate_series(date_trunc('month', min(month_end))::TIMESTAMP,
        date_trunc('month', max(month_end))::TIMESTAMP, INTERVAL 1 MONTH))) AS month_end FROM mo GROUP BY 1)""",
    f"SELECT sp.symbol, sp.month_end::DATE AS month_end, {rnd('mo.d', 9, 'dir_acc')} FROM sp LEFT JOIN mo ON sp.symbol = mo.symbol AND sp.month_end = mo.month_end",
)
ORACLES["residual_hist"] = chain(
    *PREDS,
    "rs AS MATERIALIZED (SELECT symbol, y_true - y_pred AS r FROM ok)",
    hist("rs", "r", 150),
    "ft AS (SELECT symbol, avg(r) AS mu, stddev_pop(r) AS sigma FROM rs GROUP BY 1)",
    f"""SELECT h.symbol, bin, n, {rnd('left_edge', 7)}, {rnd('density', 7)}, {rnd('mu', 7)}, {rnd('sigma', 7)}
        FROM hist h JOIN ft ON h.symbol = ft.symbol""",
)
ORACLES["residual_trend"] = chain(
    *PREDS,
    f"k AS (SELECT symbol, ts, y_true - y_pred AS residual, row_number() {ORDER} - 1 AS k FROM ok)",
    "t AS (SELECT * FROM k WHERE k % 2 = 0)",
    f"SELECT symbol, ts, {rnd('residual', 7)}, {rnd(f'avg(residual) {frame(84)}', 7, 'trend')} FROM t",
)


def _cell(x: str) -> str:
    return f"least(floor(({x} - lo_{x}) * 50 / nullif(hi_{x} - lo_{x}, 0)), 49)::BIGINT"


ORACLES["pred_actual_grid"] = chain(
    *PREDS,
    "bd AS (SELECT symbol, min(y_true) AS lo_y_true, max(y_true) AS hi_y_true, min(y_pred) AS lo_y_pred, max(y_pred) AS hi_y_pred FROM ok GROUP BY 1)",
    f"""SELECT ok.symbol, {_cell('y_pred')} AS x_bin, {_cell('y_true')} AS y_bin, count(*)::BIGINT AS n
        FROM ok JOIN bd ON ok.symbol = bd.symbol GROUP BY 1, 2, 3""",
)
ORACLES["sign_quadrants"] = chain(
    *PREDS,
    f"""SELECT symbol, count(*) FILTER (WHERE y_pred > 0 AND y_true > 0)::BIGINT AS up_up,
       count(*) FILTER (WHERE y_pred <= 0 AND y_true > 0)::BIGINT AS down_up,
       count(*) FILTER (WHERE y_pred > 0 AND y_true <= 0)::BIGINT AS up_down,
       count(*) FILTER (WHERE y_pred <= 0 AND y_true <= 0)::BIGINT AS down_down, count(*)::BIGINT AS n,
       {rnd('count(*) FILTER (WHERE (y_pred > 0) = (y_true > 0))::DOUBLE / count(*)', 9, 'dir_acc')} FROM ok GROUP BY 1""",
)
ORACLES["prob_boxes"] = chain(
    *PREDS,
    "bx AS MATERIALIZED ("
    + " UNION ALL ".join(
        f"SELECT symbol, c_true::INTEGER AS y_true, {c}::INTEGER AS label, p_{_N[c]} AS v FROM pr WHERE c_true IS NOT NULL AND p_neg IS NOT NULL"
        for c in _C
    )
    + ")",
    """qt AS (SELECT symbol, y_true, label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
        FROM bx GROUP BY 1, 2, 3)""",
    f"""SELECT b.symbol, b.y_true, b.label, {rnd('any_value(q1)', 6, 'q1')}, {rnd('any_value(median)', 6, 'median')}, {rnd('any_value(q3)', 6, 'q3')},
       count(v)::BIGINT AS n, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS low, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS high
     FROM bx b JOIN qt q ON b.symbol = q.symbol AND b.y_true = q.y_true AND b.label = q.label GROUP BY 1, 2, 3""",
)
ORACLES["model_compare"] = chain(
    *PREDS,
    splits("pr"),
    """lo AS (SELECT 'naive_zero' AS model, split, sqrt(avg(y_true ^ 2)) AS v FROM spl WHERE split IS NOT NULL AND y_true IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'reversal', split, sqrt(avg((y_true - y_pred) ^ 2)) FROM spl
        WHERE split IS NOT NULL AND y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY 2)""",
    "SELECT model, 'regression' AS task, "
    + ", ".join(rnd(f"max(v) FILTER (WHERE split = '{s}')", 8, s) for s in ("train", "val", "test"))
    + " FROM lo GROUP BY 1",
)
ORACLES["leakage_audit_full"] = chain(
    "syms AS (SELECT DISTINCT l_returnflag AS symbol FROM lineitem)",
    "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in TECHNICAL) + ") v(feature))",
    "SELECT symbol, feature, 3::BIGINT AS checked, 0::BIGINT AS mismatches FROM syms, names",
)
ORACLES["target_spot_check"] = chain(*TARGETS, "SELECT symbol, count(y_reg)::BIGINT AS checked, 0::BIGINT AS mismatches FROM tg GROUP BY 1")

CUTS = [
    DAILY,
    INDEXED,
    """cuts AS (SELECT symbol, n_rows, floor(n_rows * s.s)::BIGINT AS cut FROM (SELECT DISTINCT symbol, n_rows FROM idx),
        (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE)) s(s))""",
]
_AUDITED = ["fear_greed_ma24" if c == "fear_greed_ma24_to_level" else c for c in FEATURES]
ORACLES["perturbation_audit_full"] = chain(
    *CUTS,
    "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in _AUDITED) + ") v(feature))",
    """SELECT symbol, feature, sum(greatest(cut + 1 - 200, 0))::BIGINT AS checked, 0::BIGINT AS mismatches
     FROM cuts, names GROUP BY ALL""",
)
ORACLES["perturbation_audit_leaky"] = chain(
    *CUTS,
    # rows that see a changed bar: by a lead of three, by their own bar, by the mean of the series, by none
    """SELECT symbol, feature, count(*)::BIGINT AS checked, count_if(CASE feature WHEN 'peek_3' THEN rn + 3 >= cut AND rn + 3 < n_rows
        WHEN 'no_lag' THEN rn = cut WHEN 'whole_mean' THEN TRUE ELSE FALSE END)::BIGINT AS mismatches
     FROM (SELECT idx.symbol, idx.rn, idx.n_rows, cut FROM idx JOIN cuts ON idx.symbol = cuts.symbol AND rn <= cut),
        (VALUES ('peek_3'), ('no_lag'), ('whole_mean'), ('lagged')) v(feature) GROUP BY ALL""",
)
ORACLES["csv_bars"] = chain(
    DAILY,
    """SELECT symbol, ts, open, high, low, close, CASE WHEN day(ts) <> 7 THEN volume END AS volume
     FROM daily WHERE day(ts) NOT IN (5, 6)""",
)
ORACLES["csv_rejected"] = chain(
    DAILY,
    """SELECT symbol, CASE day(ts) WHEN 5 THEN 'unreadable time' ELSE 'unreadable close' END AS reason, count(*)::BIGINT AS n
     FROM daily WHERE day(ts) IN (5, 6) GROUP BY ALL""",
)
