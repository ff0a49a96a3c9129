"""DuckDB SQL for the registered queries, written from the definitions of the operators.

Every query is a chain of common table expressions over the given tables followed by one
SELECT. Short names are used inside the chain: t ticker, d date, op hi lo cl adj vol quotes.
"""

from __future__ import annotations

LATE_MONTH = 2001 * 12 + 4
TRAIN_END = "DATE '2000-09-30'"
VALIDATION_END = "DATE '2001-03-31'"

# The public names of the features.
FEATURES = [
    "ret_1d",
    "mom_5d",
    "mom_20d",
    "mom_60d",
    "vol_5d",
    "vol_20d",
    "volume_ratio_20d",
    "range_pct",
    "intraday_ret",
]
QUOTES = 'op AS "Open", hi AS "High", lo AS "Low", cl AS "Close", adj AS "Adj Close", vol AS "Volume"'
KEYS = 't AS "Ticker", d AS "Date"'


def r8(name: str, expression: str | None = None) -> str:
    """Eight digits, without negative zero."""
    value = f"round({expression or name}, 8)"
    return f"CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END AS {name}"


def all_r8(*names: str) -> str:
    return ", ".join(r8(name) for name in names)


# --- feeds ----------------------------------------------------------------------------

BAR_COLUMNS = """
        arg_min(cents, (day, cents)) / 100.0::DOUBLE AS op, max(cents) / 100.0::DOUBLE AS hi,
        min(cents) / 100.0::DOUBLE AS lo, arg_max(cents, (day, cents)) / 100.0::DOUBLE AS cl,
        arg_max(adjusted, (day, adjusted)) / 100.0::DOUBLE AS adj, sum(qty) AS vol"""

LINES = """
    SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, CAST(l_shipdate AS DATE) AS day,
           CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS cents,
           CAST(floor(l_extendedprice / l_quantity * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS adjusted,
           l_quantity AS qty
    FROM lineitem"""

BARS = f"""
lines AS ({LINES}),
bars AS (
    SELECT 'S-' || l_suppkey AS t, d, l_suppkey % 10 AS s, year(d) * 12 + month(d) - 1 AS m, {BAR_COLUMNS}
    FROM lines GROUP BY l_suppkey, d)"""

CLEAN = f"""{BARS},
quotes AS (SELECT t, d, op, hi, lo, cl, adj, vol, 1 AS copies FROM bars)"""

FEED = f"""{BARS},
spoiled AS (
    SELECT t, d, s, m,
           CASE WHEN s = 7 AND m % 43 = 3 OR s = 0 AND m = {LATE_MONTH} THEN NULL ELSE op END AS op,
           CASE WHEN s = 3 AND m % 29 = 7 THEN 0.01::DOUBLE ELSE hi END AS hi,
           lo,
           CASE WHEN s = 5 AND m % 37 = 11 THEN 'inf'::DOUBLE WHEN s = 1 AND m = {LATE_MONTH} THEN NULL ELSE cl END AS cl,
           CASE WHEN s = 6 AND m % 41 = 13 THEN -1.0::DOUBLE ELSE adj END AS adj,
           CASE WHEN s = 4 AND m % 31 = 5 THEN 0.0::DOUBLE ELSE vol END AS vol
    FROM bars),
feed AS (
    SELECT t, d, op, hi, lo, cl, adj, vol FROM spoiled
    UNION ALL SELECT t, d, op, hi, lo, cl, adj, vol FROM spoiled WHERE s = 8 AND m % 23 = 2
    UNION ALL SELECT '', d, op, hi, lo, cl, adj, vol FROM spoiled WHERE s = 9 AND m % 19 = 4
    UNION ALL SELECT t, NULL, op, hi, lo, cl, adj, vol FROM spoiled WHERE s = 2 AND m % 17 = 6)"""

DIRTY = f"""{FEED},
finite AS (
    SELECT t, d, op, hi, lo, CASE WHEN isfinite(cl) THEN cl END AS cl, adj, vol
    FROM feed WHERE t <> '' AND d IS NOT NULL),
quotes AS (
    SELECT t, d, op, hi, lo, cl, adj, vol, count(*) AS copies
    FROM finite GROUP BY t, d, op, hi, lo, cl, adj, vol)"""

CONFLICTING = f"""{BARS},
feed AS (
    SELECT t, d, op, hi, lo, cl, adj, vol FROM bars
    UNION ALL
    SELECT t, d, op, hi, lo, cl, adj, vol + 1 FROM bars WHERE s = 1 AND m % 13 = 1)"""

SUPPLIERS = """
suppliers AS (
    SELECT s_suppkey, s_suppkey % 10 AS s, 'S-' || s_suppkey AS t, s_name, n_name, s_acctbal
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
details AS (SELECT t, s_name, n_name FROM suppliers WHERE s_acctbal > 0)"""

UNTIDY = f"""{SUPPLIERS},
untidy AS (
    SELECT t, s_name, n_name FROM suppliers
    UNION ALL SELECT t, s_name, n_name FROM suppliers WHERE s IN (1, 4)
    UNION ALL SELECT '', s_name, n_name FROM suppliers WHERE s = 2
    UNION ALL SELECT t, 'second record', n_name FROM suppliers WHERE s = 3),
cleaned AS (SELECT DISTINCT t, s_name, n_name FROM untidy)"""

# Only the expected tickers; those of the nations have no quotes at all.
CONFORMED = f"""{BARS}, {SUPPLIERS},
expected AS (
    SELECT t AS t, 'S.' || s_suppkey AS raw FROM suppliers WHERE s_acctbal > 0
    UNION SELECT 'N-' || n_nationkey, 'N.' || n_nationkey FROM nation),
absent AS (SELECT * FROM expected WHERE t NOT IN (SELECT t FROM bars)),
quotes AS (
    SELECT b.t, e.raw, d, op, hi, lo, cl, adj, vol FROM bars b JOIN expected e ON b.t = e.t
    UNION ALL
    SELECT a.t, a.raw, c.d, NULL, NULL, NULL, NULL, NULL, NULL
    FROM absent a, (SELECT DISTINCT d FROM bars) c)"""

# --- panel ----------------------------------------------------------------------------

GRID = """
dense AS (
    SELECT g.t, g.d, q.op, q.hi, q.lo, q.cl, q.adj, q.vol, q.copies, q.t IS NULL AS inserted
    FROM (SELECT a.t, b.d FROM (SELECT DISTINCT t FROM quotes) a, (SELECT DISTINCT d FROM quotes) b) g
    LEFT JOIN quotes q ON q.t = g.t AND q.d = g.d)"""

CHECKED = """
checked AS (
    SELECT *, NOT (r_missing OR r_price OR r_volume OR r_bounds) AS ok
    FROM (
        SELECT *,
               op IS NULL OR hi IS NULL OR lo IS NULL OR cl IS NULL OR adj IS NULL OR vol IS NULL AS r_missing,
               coalesce(list_min([op, hi, lo, cl, adj]) <= 0, false) AS r_price,
               coalesce(vol <= 0, false) AS r_volume,
               coalesce(hi < list_max([op, lo, cl]), false) OR coalesce(lo > list_min([op, hi, cl]), false) AS r_bounds
        FROM dense)),
masked AS (
    SELECT t, d, ok,
           CASE WHEN ok THEN op END AS op, CASE WHEN ok THEN hi END AS hi, CASE WHEN ok THEN lo END AS lo,
           CASE WHEN ok THEN cl END AS cl, CASE WHEN ok THEN adj END AS adj, CASE WHEN ok THEN vol END AS vol
    FROM checked)"""

FEATURED = """
moved AS (
    SELECT *,
           adj / lag(adj, 1) OVER w - 1 AS ret_1d, adj / lag(adj, 5) OVER w - 1 AS mom_5d,
           adj / lag(adj, 20) OVER w - 1 AS mom_20d, adj / lag(adj, 60) OVER w - 1 AS mom_60d,
           CASE WHEN count(vol) OVER w20 = 20 THEN avg(vol) OVER w20 END AS volume_ma20,
           (hi - lo) / cl AS range_pct, cl / op - 1 AS intraday_ret,
           lead(d) OVER w AS lend, lead(adj) OVER w / adj - 1 AS target
    FROM masked
    WINDOW w AS (PARTITION BY t ORDER BY d),
           w20 AS (PARTITION BY t ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
panel AS (
    SELECT *,
           ok AND ret_1d IS NOT NULL AND mom_5d IS NOT NULL AND mom_20d IS NOT NULL AND mom_60d IS NOT NULL
           AND vol_5d IS NOT NULL AND vol_20d IS NOT NULL AND volume_ratio_20d IS NOT NULL
           AND range_pct IS NOT NULL AND intraday_ret IS NOT NULL AS eligible
    FROM (
        SELECT *, vol / volume_ma20 AS volume_ratio_20d,
               CASE WHEN count(ret_1d) OVER w5 = 5 THEN stddev_samp(ret_1d) OVER w5 END AS vol_5d,
               CASE WHEN count(ret_1d) OVER w20 = 20 THEN stddev_samp(ret_1d) OVER w20 END AS vol_20d
        FROM moved
        WINDOW w5 AS (PARTITION BY t ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
               w20 AS (PARTITION BY t ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))"""


def percent_rank(source: str, name: str, where: str = "eligible") -> str:
    """Average rank of the target by date, as a share of the known targets."""
    return f"""
{name} AS (
    SELECT *,
           CASE WHEN target IS NOT NULL THEN
               (rank() OVER (PARTITION BY d ORDER BY target NULLS LAST)
                + (count(target) OVER (PARTITION BY d, target) - 1) / 2.0::DOUBLE)
               / count(target) OVER (PARTITION BY d)
           END AS target_rank
    FROM {source} WHERE {where})"""


SPLIT = f"""
crossing AS (
    SELECT DISTINCT d FROM dataset
    WHERE (d <= {TRAIN_END} AND (lend > {TRAIN_END} OR lend IS NULL))
       OR (d > {TRAIN_END} AND d <= {VALIDATION_END} AND (lend > {VALIDATION_END} OR lend IS NULL))),
splits AS (
    SELECT *,
           CASE WHEN d IN (SELECT d FROM crossing) THEN 'purged'
                WHEN d <= {TRAIN_END} THEN 'train'
                WHEN d <= {VALIDATION_END} THEN 'validation'
                ELSE 'test' END AS split
    FROM dataset)"""

PANEL = f"{GRID}, {CHECKED}, {FEATURED}"
DATASET = f"{PANEL}, {percent_rank('panel', 'dataset')}"
SPLITS = f"{DATASET}, {SPLIT}"

# --- evaluation -----------------------------------------------------------------------

TEST = f"""
test AS (SELECT * FROM splits WHERE split = 'test'),
predictions AS (SELECT t, d, 0.0::DOUBLE - ret_1d AS p FROM test),
entered AS (
    SELECT t, d, CASE WHEN k % 13 = 5 OR k % 17 = 3 THEN NULL WHEN m % 12 = 3 THEN 0.25::DOUBLE
                      WHEN m % 2 = 0 OR k % 25 = 1 THEN p END AS p
    FROM (SELECT *, CAST(substr(t, 3) AS INTEGER) AS k, year(d) * 12 + month(d) - 1 AS m FROM predictions)),
sessions AS (SELECT d, lead(d) OVER (ORDER BY d) AS entry FROM (SELECT DISTINCT d FROM quotes)),
top AS (
    SELECT * FROM (
        SELECT d, t, row_number() OVER (PARTITION BY d ORDER BY p DESC, t) AS slot, 0.1::DOUBLE AS weight
        FROM entered WHERE p IS NOT NULL)
    WHERE slot <= 10),
market AS (SELECT d, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY d) AS weight FROM test)"""

SPEARMAN = """
pairs AS (SELECT p.d, p.t, p.p, s.target FROM entered p JOIN test s ON p.d = s.d AND p.t = s.t
          WHERE s.target IS NOT NULL AND p.p IS NOT NULL),
ranked AS (
    SELECT d,
           rank() OVER (PARTITION BY d ORDER BY p) + (count(*) OVER (PARTITION BY d, p) - 1) / 2.0::DOUBLE AS a,
           rank() OVER (PARTITION BY d ORDER BY target)
               + (count(*) OVER (PARTITION BY d, target) - 1) / 2.0::DOUBLE AS b
    FROM pairs),
found AS (
    SELECT d, count(*) AS n,
           CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS score
    FROM ranked GROUP BY d),
scores AS (
    SELECT e.d, coalesce(n, 0) AS n, score,
           CASE WHEN n IS NULL THEN 'no_known_target' WHEN score IS NULL THEN 'constant' END AS undefined
    FROM (SELECT DISTINCT d FROM entered) e LEFT JOIN found ON found.d = e.d)"""


def held(source: str, name: str, columns: str) -> str:
    """Trades of a selection, then one row per date."""
    return f"""
{name}_held AS (
    SELECT {columns}, x.d, x.t, x.weight, s.entry, q.op, q.cl,
           CASE WHEN NOT coalesce(q.op > 0, false) THEN 'cash_no_open'
                WHEN NOT coalesce(q.cl > 0, false) THEN 'unresolved' ELSE 'filled' END AS status
    FROM {source} x JOIN sessions s ON s.d = x.d AND s.entry IS NOT NULL
    LEFT JOIN quotes q ON q.t = x.t AND q.d = s.entry),
{name} AS (
    SELECT *,
           CASE status WHEN 'filled' THEN weight * (cl / op - 1) WHEN 'cash_no_open' THEN 0 END AS gross,
           CASE status WHEN 'filled' THEN weight * ((cl / op - 1) - 0.001::DOUBLE - 0.001::DOUBLE * (cl / op))
                       WHEN 'cash_no_open' THEN 0 END AS net
    FROM {name}_held),
{name}_daily AS (
    SELECT d, entry,
           count(*) FILTER (status = 'filled') AS filled, count(*) FILTER (status = 'cash_no_open') AS cash_slots,
           count(*) FILTER (status = 'unresolved') AS unresolved,
           CASE WHEN count(*) FILTER (status = 'unresolved') = 0 THEN sum(gross) END AS gross,
           CASE WHEN count(*) FILTER (status = 'unresolved') = 0 THEN sum(net) END AS net
    FROM {name} GROUP BY d, entry)"""


UNCOVERED = """(SELECT coalesce(string_agg(CAST(d AS VARCHAR), ' ' ORDER BY d), '')
        FROM (SELECT DISTINCT d FROM test WHERE d NOT IN (SELECT d FROM sessions WHERE entry IS NOT NULL)))"""

# Sessions between the first and the last signal on which nothing was selected are days in cash.
WHOLE_DAYS = """
days AS (
    SELECT d, entry FROM sessions
    WHERE entry IS NOT NULL AND d BETWEEN (SELECT min(d) FROM test) AND (SELECT max(d) FROM test))""" + "".join(
    f""",
{name}_whole AS (
    SELECT y.d, y.entry, coalesce(filled, 0) AS filled, coalesce(cash_slots, 0) AS cash_slots,
           coalesce(unresolved, 0) AS unresolved, CASE WHEN x.d IS NULL THEN 0 ELSE gross END AS gross,
           CASE WHEN x.d IS NULL THEN 0 ELSE net END AS net
    FROM days y LEFT JOIN {name}_daily x ON x.d = y.d)"""
    for name in "ab"
)

METRICS = """
both_daily AS (
    SELECT 'model' AS portfolio, * FROM a_daily UNION ALL SELECT 'equal_weight_eligible', * FROM b_daily),
wealth AS (
    SELECT *, product(1 + net) OVER (PARTITION BY portfolio ORDER BY d ROWS UNBOUNDED PRECEDING) AS w FROM both_daily),
falls AS (
    SELECT *, w / greatest(1.0::DOUBLE, max(w) OVER (PARTITION BY portfolio ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1 AS f
    FROM wealth)"""

WHOLE_METRICS = WHOLE_DAYS + "," + METRICS.replace("_daily UNION", "_whole UNION").replace("FROM b_daily", "FROM b_whole")
SHARPE = "CASE WHEN count(*) FILTER (net IS NULL) = 0 THEN avg(net) / stddev_samp(net) * sqrt(252.0::DOUBLE) END"
METRIC_COLUMNS = f"""portfolio AS "Portfolio", min(d) AS first_date, max(d) AS last_date, max(entry) AS last_exit,
    count(*) AS days, count(*) FILTER (net IS NULL) AS unresolved_days,
    {r8("cumulative_gross", "product(1 + gross) - 1")}, {r8("cumulative_net", "product(1 + net) - 1")},
    {r8("sharpe", "avg(net) / stddev_samp(net) * sqrt(252.0::DOUBLE)")}, {r8("max_drawdown", "min(f)")}"""

EVALUATED = f"{CLEAN}, {SPLITS}, {TEST}"
DIRTY_EVALUATED = f"{DIRTY}, {SPLITS}, {TEST}"
PORTFOLIOS = f"{EVALUATED}, {held('top', 'a', 'x.slot')}, {held('market', 'b', 'x.d AS day')}, {METRICS}"
DIRTY_TRADES = f"{DIRTY}, {SPLITS}, {TEST}, {held('top', 'a', 'x.slot')}"

SAVED = f"{DIRTY_EVALUATED}, {held('top', 'a', 'x.slot')}, {held('market', 'b', 'x.d AS day')}, {WHOLE_METRICS}"


def when_resolved(metric: str) -> str:
    return f"CASE WHEN count(*) FILTER (net IS NULL) = 0 THEN {metric} END"


WIDE_ROWS = f"""SELECT c.d AS "Date", n.n_name AS "Ticker", {QUOTES}
FROM (SELECT DISTINCT d FROM nation_bars) c CROSS JOIN nation n
LEFT JOIN nation_bars b ON b.d = c.d AND b.n_name = n.n_name"""

# The ways to write a day, in both notations.
DATE_FORMATS = {
    "iso": "%Y-%m-%d",
    "M/d/yyyy": "%m/%d/%Y",
    "d/M/yyyy": "%d/%m/%Y",
    "M-d-yyyy": "%m-%d-%Y",
    "d-M-yyyy": "%d-%m-%Y",
    "d.M.yyyy": "%d.%m.%Y",
    "d MMM yyyy": "%d %b %Y",
    "d MMMM yyyy": "%d %B %Y",
    "d-MMM-yyyy": "%d-%b-%Y",
    "MMM d, yyyy": "%b %d, %Y",
    "MMMM d, yyyy": "%B %d, %Y",
}

DAILY_COLUMNS = f'd AS "Date", entry AS "EntryDate", filled, cash_slots, unresolved, {all_r8("gross", "net")}'
FEATURE_COLUMNS = all_r8(*FEATURES)
MODEL_COLUMNS = f"""{KEYS}, split AS "Split", lend AS "LabelEndDate", {FEATURE_COLUMNS}, {all_r8("target", "target_rank")}"""

AUDIT = f"""{FEED},
finite AS (
    SELECT t, d, op, hi, lo, CASE WHEN isfinite(cl) THEN cl END AS cl, adj, vol
    FROM feed WHERE t <> '' AND d IS NOT NULL),
quotes AS (
    SELECT t, d, op, hi, lo, cl, adj, vol, count(*) AS copies
    FROM finite GROUP BY t, d, op, hi, lo, cl, adj, vol),
{PANEL},
audit AS (
    SELECT (SELECT count(*) FROM feed) AS input_rows,
           (SELECT count(*) FROM feed WHERE t = '' OR d IS NULL) AS dropped_invalid_keys,
           (SELECT count(*) FROM finite) - (SELECT count(*) FROM quotes) AS duplicate_rows_removed,
           (SELECT count(*) FROM dense) AS grid_rows,
           (SELECT count(*) FROM dense) - (SELECT count(*) FROM quotes) AS inserted_missing_rows,
           (SELECT count(*) FROM checked WHERE ok) AS valid_quote_rows,
           (SELECT count(*) FROM checked WHERE NOT ok) AS invalid_quote_rows,
           (SELECT count(*) FROM panel WHERE eligible) AS signal_eligible_rows,
           (SELECT count(*) FROM checked WHERE r_missing) AS missing_or_nonfinite_quote,
           (SELECT count(*) FROM checked WHERE r_price) AS nonpositive_price,
           (SELECT count(*) FROM checked WHERE r_volume) AS nonpositive_volume,
           (SELECT count(*) FROM checked WHERE r_bounds) AS invalid_ohlc_bounds)"""

NATION_BARS = f"""
lines AS (
    SELECT n_name, l.* FROM ({LINES}) l
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
nation_bars AS (SELECT n_name, d, {BAR_COLUMNS} FROM lines GROUP BY n_name, d)"""

SHARED = f"""{BARS}, {SUPPLIERS},
quotes AS (
    SELECT b.t, d, op, hi, lo, cl, adj, vol, 1 AS copies FROM bars b JOIN details USING (t)
    UNION ALL
    SELECT t, (SELECT min(d) FROM bars), NULL, NULL, NULL, NULL, NULL, NULL, 1
    FROM details WHERE t NOT IN (SELECT t FROM bars)),
{SPLITS}"""


def _hashed(name: str, expression: str) -> str:
    if name in {*FEATURES, "target", "target_rank"}:
        expression = f"CAST(round({expression} * 100000000.0::DOUBLE) AS HUGEINT)"
    text = f"CAST({expression} AS VARCHAR)"
    return f"coalesce(length({text}) || ':' || {text}, '-')"


# Columns of the model table by name, each with its length in front.
ROW_TEXT = " || ".join(
    _hashed(name, {"Date": "d", "Ticker": "t", "Split": "split", "LabelEndDate": "lend"}.get(name, name))
    for name in sorted(["Date", "Ticker", "Split", "LabelEndDate", *FEATURES, "target", "target_rank"])
)


def query(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


ORACLES: dict[str, str] = {
    "bars_ohlcv": query(BARS, f"SELECT replace(t, '-', '.') AS \"Ticker\", d AS \"Date\", {QUOTES} FROM bars"),
    "normalize_keys": """
WITH texts AS (
    SELECT CASE l_orderkey % 16
               WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d')
               WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') || ' 13:45:00'
               WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') || 'T23:30:00-05:00'
               WHEN 3 THEN 'not-a-date'
               WHEN 4 THEN strftime(l_shipdate, '%Y')
               WHEN 5 THEN '  ' || strftime(l_shipdate, '%Y-%m-%d')
               WHEN 7 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 8 THEN strftime(l_shipdate, '%Y-%m-%d')
               WHEN 9 THEN strftime(l_shipdate, '%Y-%m-%d') || ' 23:30:00-05:00'
               WHEN 10 THEN strftime(l_shipdate, '%Y-%m-%d') || ' 23:30:00-05:00'
               WHEN 11 THEN 'a zone by name' WHEN 12 THEN 'out of range' WHEN 13 THEN '1677-09-21'
               WHEN 14 THEN strftime(CAST(l_shipdate AS DATE) - 1, '%Y-%m-%d') WHEN 15 THEN '2262-04-11' END AS dt,
           CASE l_linenumber % 5
               WHEN 0 THEN 's.' || l_suppkey
               WHEN 1 THEN chr(9) || 's.' || l_suppkey || ' ' || chr(10)
               WHEN 2 THEN chr(160) || 'S.' || l_suppkey || chr(160)
               WHEN 3 THEN '   '
               ELSE 'S-' || l_suppkey END AS tk
    FROM lineitem),
keys AS (
    SELECT CAST(CASE WHEN dt LIKE '%-05:00' THEN try_cast(replace(left(dt, 19), 'T', ' ') AS TIMESTAMP) + INTERVAL 5 HOUR
                     ELSE try_cast(trim(dt) AS TIMESTAMP) END AS DATE) AS "Date",
           replace(upper(trim(tk, ' ' || chr(9) || chr(10) || chr(160))), '.', '-') AS "Ticker"
    FROM texts)
SELECT "Date", "Ticker", count(*) AS rows FROM keys
WHERE "Date" IS NOT NULL AND "Ticker" <> '' GROUP BY "Date", "Ticker" """,
    "unusable_keys": query(
        FEED,
        """SELECT 'unreadable_date' AS reason, count(*) FILTER (d IS NULL OR month(d) = 3) AS rows FROM feed
UNION ALL SELECT 'date_out_of_range', count(*) FILTER (month(d) = 2) FROM feed
UNION ALL SELECT 'missing_ticker', count(*) FILTER (t = '') FROM feed""",
    ),
    "coerce_numeric": """
WITH texts AS (
    SELECT l_orderkey % 9 AS kind, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem),
numbers AS (
    SELECT kind,
           try_cast(trim(CASE kind WHEN 0 THEN q WHEN 1 THEN ' ' || q || ' ' WHEN 2 THEN q || 'd' WHEN 3 THEN 'inf'
                         WHEN 4 THEN 'nan' WHEN 5 THEN '1,' || q WHEN 6 THEN q || 'e2' WHEN 7 THEN '-.' || q
                         ELSE '' END) AS DOUBLE) AS x
    FROM texts)
SELECT kind, CASE WHEN isfinite(x) THEN x END AS number, count(*) AS rows FROM numbers GROUP BY ALL""",
    "dedupe_quotes": query(DIRTY, f'SELECT {KEYS}, {QUOTES}, copies AS "Copies" FROM quotes'),
    "conflict_keys": query(
        CONFLICTING,
        f"SELECT {KEYS}, count(*) AS records FROM (SELECT DISTINCT * FROM feed) GROUP BY t, d HAVING count(*) > 1",
    ),
    "session_calendar": query(
        CLEAN,
        """SELECT d AS "Date", lead(d) OVER (ORDER BY d) AS "NextDate",
    CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS "Session", CAST(count(*) OVER () AS INTEGER) AS "LastSession"
FROM (SELECT DISTINCT d FROM quotes)""",
    ),
    "dense_grid": query(
        f"{CLEAN}, {GRID}",
        f'SELECT {KEYS}, {QUOTES}, inserted AS "Inserted" FROM dense',
    ),
    "quote_validity": query(
        f"{DIRTY}, {GRID}, {CHECKED}",
        f"""SELECT {KEYS}, r_missing AS missing_or_nonfinite_quote, r_price AS nonpositive_price,
    r_volume AS nonpositive_volume, r_bounds AS invalid_ohlc_bounds, ok AS "QuoteValid" FROM checked""",
    ),
    "masked_quotes": query(
        f"{DIRTY}, {GRID}, {CHECKED}", f'SELECT {KEYS}, {QUOTES}, ok AS "QuoteValid" FROM masked'
    ),
    "audit_counts": query(AUDIT, "SELECT *, true AS reason_counts_overlap FROM audit"),
    "audit_long": query(AUDIT, "UNPIVOT (SELECT * FROM audit) ON COLUMNS(*) INTO NAME metric VALUE value"),
    "valid_quotes_per_ticker": query(
        f"{DIRTY}, {GRID}, {CHECKED}",
        'SELECT t AS "Ticker", count(*) FILTER (ok) AS valid_quotes FROM checked GROUP BY t',
    ),
    "metadata_join": query(
        f"{CLEAN}, {GRID}, {SUPPLIERS}",
        """SELECT dense.t AS "Ticker", d AS "Date", cl AS "Close", s_name AS "Security", n_name AS "Nation"
FROM dense LEFT JOIN details ON details.t = dense.t""",
    ),
    "details_dedupe": query(UNTIDY, 'SELECT t AS "Ticker", s_name AS "Security", n_name AS "Nation" FROM cleaned'),
    "details_issues": query(
        UNTIDY,
        """SELECT CASE WHEN t = '' THEN 'missing_ticker' ELSE 'repeated_ticker' END AS issue, t AS "Ticker",
    count(*) AS records FROM cleaned GROUP BY t HAVING t = '' OR count(*) > 1""",
    ),
    "raw_price_report": query(
        CONFLICTING,
        """SELECT count(*) AS rows, count(DISTINCT (t, d)) AS keys,
    (SELECT count(*) FROM (SELECT 1 FROM feed GROUP BY t, d HAVING count(*) > 1)) AS repeated_keys,
    min(d) AS first_date, max(d) AS last_date,
    count(*) FILTER (d < DATE '1996-01-01' OR d >= DATE '2001-06-01') AS rows_out_of_range FROM feed""",
    ),
    "conform_tickers": query(CONFORMED, f'SELECT raw AS "Ticker", d AS "Date", {QUOTES} FROM quotes'),
    "tickers_without_quotes": query(
        CONFORMED,
        """SELECT t AS "Ticker" FROM quotes GROUP BY t
HAVING count(*) FILTER (op > 0 AND hi >= greatest(op, cl) AND lo <= least(op, cl) AND adj > 0 AND vol > 0) = 0""",
    ),
    "wide_to_long": query(
        NATION_BARS,
        WIDE_ROWS,
    ),
    "momentum": query(
        f"{CLEAN}, {PANEL}", f"SELECT {KEYS}, {all_r8('ret_1d', 'mom_5d', 'mom_20d', 'mom_60d')} FROM panel"
    ),
    "volatility": query(f"{CLEAN}, {PANEL}", f"SELECT {KEYS}, {all_r8('vol_5d', 'vol_20d')} FROM panel"),
    "volume_ratio": query(
        f"{CLEAN}, {PANEL}", f"SELECT {KEYS}, {all_r8('volume_ma20', 'volume_ratio_20d')} FROM panel"
    ),
    "intraday": query(f"{CLEAN}, {PANEL}", f"SELECT {KEYS}, {all_r8('range_pct', 'intraday_ret')} FROM panel"),
    "signal_eligible": query(f"{CLEAN}, {PANEL}", f'SELECT {KEYS}, eligible AS "SignalEligible" FROM panel'),
    "next_session_label": query(
        f"{CLEAN}, {PANEL}", f'SELECT {KEYS}, lend AS "LabelEndDate", {r8("target")} FROM panel'
    ),
    "prepare_panel_full": query(
        f"{DIRTY}, {PANEL}, {SUPPLIERS}",
        f"""SELECT panel.t AS "Ticker", d AS "Date", {QUOTES}, ok AS "QuoteValid", s_name AS "Security",
    n_name AS "Nation", {FEATURE_COLUMNS}, {r8("volume_ma20")}, eligible AS "SignalEligible",
    lend AS "LabelEndDate", {r8("target")} FROM panel LEFT JOIN details ON details.t = panel.t""",
    ),
    "model_table": query(f"{DIRTY}, {SPLITS}", f"SELECT {MODEL_COLUMNS} FROM splits"),
    "model_dataset_labeled": query(
        f"{CLEAN}, {PANEL}, {percent_rank('panel', 'labeled', 'eligible AND target IS NOT NULL')}",
        f"SELECT {KEYS}, {FEATURE_COLUMNS}, {all_r8('target', 'target_rank')} FROM labeled",
    ),
    "model_dataset_all": query(
        f"{CLEAN}, {DATASET}", f"SELECT {KEYS}, {FEATURE_COLUMNS}, {all_r8('target', 'target_rank')} FROM dataset"
    ),
    "target_rank": query(f"{CLEAN}, {DATASET}", f"SELECT {KEYS}, {r8('target_rank')} FROM dataset"),
    "date_splits": query(f"{CLEAN}, {SPLITS}", f'SELECT {KEYS}, split AS "Split" FROM splits'),
    "split_summary": query(
        f"{CLEAN}, {SPLITS}",
        'SELECT split AS "Split", count(*) AS rows, count(target) AS known_targets FROM splits GROUP BY split',
    ),
    "purged_dates": query(f"{CLEAN}, {SPLITS}", 'SELECT d AS "Date" FROM crossing'),
    "split_rows": query(
        f"{CLEAN}, {SPLITS}",
        f"SELECT {KEYS}, {r8('target')} FROM splits WHERE split = 'train' AND target IS NOT NULL",
    ),
    "model_contract": query(
        f"{CLEAN}, {SPLITS}",
        """SELECT count(*) AS rows, count(*) FILTER (split = 'train') AS train_rows,
    count(*) FILTER (split = 'validation') AS validation_rows, count(*) FILTER (split = 'test') AS test_rows,
    count(*) FILTER (split = 'purged') AS purged_rows,
    (SELECT count(*) FROM splits WHERE CAST(substr(t, 3) AS INTEGER) % 7 = 4) AS repeated_keys,
    count(*) AS rows_with_missing_features
FROM (SELECT * FROM splits UNION ALL SELECT * FROM splits WHERE CAST(substr(t, 3) AS INTEGER) % 7 = 4)""",
    ),
    "dataset_counts": query(
        f"{CLEAN}, {SPLITS}, {SUPPLIERS}",
        """SELECT 'stocks' AS metric, count(*) AS value FROM details
UNION ALL SELECT 'raw_rows', count(*) FROM bars
UNION ALL SELECT 'train_rows_with_target', count(target) FROM splits WHERE split = 'train'
UNION ALL SELECT 'validation_rows_with_target', count(target) FROM splits WHERE split = 'validation'
UNION ALL SELECT 'test_rows_with_target', count(target) FROM splits WHERE split = 'test'
UNION ALL SELECT 'test_rows', count(*) FROM splits WHERE split = 'test'""",
    ),
    "build_shared_table": query(SHARED, f"SELECT {MODEL_COLUMNS} FROM splits"),
    "csv_roundtrip": query(f"{CLEAN}, {SPLITS}", f"SELECT {MODEL_COLUMNS} FROM splits"),
    "dataset_fingerprint": query(
        f"{CLEAN}, {SPLITS}, hashed AS (SELECT CAST('0x' || substr(md5({ROW_TEXT}), 1, 15) AS BIGINT) AS h FROM splits)",
        "SELECT count(*) AS rows, bit_xor(h) AS xor_hash, CAST(sum(CAST(h AS HUGEINT)) AS DECIMAL(38, 0)) AS sum_hash FROM hashed",
    ),
    "submission_issues": query(
        f"""{EVALUATED},
numbered AS (SELECT *, CAST(substr(t, 3) AS INTEGER) % 11 AS k FROM predictions)""",
        """SELECT 'missing' AS issue, d AS "Date", t AS "Ticker" FROM numbered WHERE k = 1
UNION ALL SELECT 'duplicate', d, t FROM numbered WHERE k = 2
UNION ALL SELECT 'not_finite', d, t FROM numbered WHERE k = 3
UNION ALL SELECT 'extra', d, t || 'X' FROM numbered WHERE k = 4""",
    ),
    "daily_spearman": query(f"{EVALUATED}, {SPEARMAN}", f'SELECT d AS "Date", n, {r8("score")}, undefined FROM scores'),
    "spearman_summary": query(
        f"{EVALUATED}, {SPEARMAN}",
        f"""SELECT count(score) AS scored_dates, count(*) FILTER (score IS NULL) AS undefined_dates,
    {r8("mean_score", "avg(score)")} FROM scores""",
    ),
    "top10_selection": query(
        EVALUATED, 'SELECT d AS "Date", t AS "Ticker", CAST(slot AS INTEGER) AS slot, weight FROM top'
    ),
    "trades": query(
        DIRTY_TRADES,
        f"""SELECT d AS "Date", t AS "Ticker", CAST(slot AS INTEGER) AS slot, weight, entry AS "EntryDate",
    op AS "Open", cl AS "Close", status, {all_r8("gross", "net")} FROM a""",
    ),
    "daily_returns": query(DIRTY_TRADES, f"SELECT {DAILY_COLUMNS} FROM a_daily"),
    "benchmark_returns": query(
        f"{EVALUATED}, {held('market', 'b', 'x.d AS day')}", f"SELECT {DAILY_COLUMNS} FROM b_daily"
    ),
    "uncovered_dates": query(
        EVALUATED, 'SELECT DISTINCT d AS "Date" FROM test WHERE d NOT IN (SELECT d FROM sessions WHERE entry IS NOT NULL)'
    ),
    "portfolio_metrics": query(PORTFOLIOS, f"SELECT {METRIC_COLUMNS} FROM falls GROUP BY portfolio"),
    "backtest_results": query(
        f"""{EVALUATED}, {held('top', 'a', 'x.slot')}, {held('market', 'b', 'x.d AS day')}, {WHOLE_METRICS}, {SPEARMAN},
summary AS (SELECT count(score) AS scored, count(*) FILTER (score IS NULL) AS undefined, avg(score) AS mean FROM scores)""",
        f"""SELECT {METRIC_COLUMNS},
    CASE WHEN portfolio = 'model' THEN (SELECT scored FROM summary) END AS scored_dates,
    CASE WHEN portfolio = 'model' THEN (SELECT undefined FROM summary) END AS undefined_dates,
    {r8("mean_score", "CASE WHEN portfolio = 'model' THEN (SELECT mean FROM summary) END")},
    {UNCOVERED} AS uncovered_dates,
    CASE WHEN portfolio = 'model' THEN 10 END AS slots, 0.001::DOUBLE AS cost_per_side, 252 AS days_per_year,
    'equal_weight_eligible' AS benchmark,
    'signal after close; buy next session open, sell its close; cash overnight; no shorts' AS rules
FROM falls GROUP BY portfolio""",
    ),
    "results_csv": query(
        f"""{SAVED}, {SPEARMAN},
summary AS (SELECT count(score) AS scored, count(*) FILTER (score IS NULL) AS undefined, avg(score) AS mean FROM scores)""",
        f"""SELECT portfolio AS "Portfolio", min(d) AS first_date, max(d) AS last_date, max(entry) AS last_exit, count(*) AS days,
    count(*) FILTER (net IS NULL) AS unresolved_days,
    {r8("cumulative_gross", when_resolved("product(1 + gross) - 1"))}, {r8("cumulative_net", when_resolved("product(1 + net) - 1"))},
    {r8("sharpe", SHARPE)}, {r8("max_drawdown", when_resolved("min(f)"))},
    CASE WHEN portfolio = 'model' THEN (SELECT scored FROM summary) END AS scored_dates,
    CASE WHEN portfolio = 'model' THEN (SELECT undefined FROM summary) END AS undefined_dates,
    {r8("mean_score", "CASE WHEN portfolio = 'model' THEN (SELECT mean FROM summary) END")},
    {UNCOVERED} AS uncovered_dates,
    CASE WHEN portfolio = 'model' THEN 10 END AS slots, 0.001::DOUBLE AS cost_per_side, 252 AS days_per_year,
    'equal_weight_eligible' AS benchmark,
    'signal after close; buy next session open, sell its close; cash overnight; no shorts' AS rules
FROM falls GROUP BY portfolio""",
    ),
    "daily_csv": query(SAVED, f'SELECT portfolio AS "Portfolio", {DAILY_COLUMNS} FROM both_daily'),
    "trades_csv": query(
        SAVED,
        " UNION ALL ".join(
            f"""SELECT '{portfolio}' AS "Portfolio", d AS "Date", t AS "Ticker", {r8("weight")}, entry AS "EntryDate",
    op AS "Open", cl AS "Close", status, {all_r8("gross", "net")} FROM {name}"""
            for name, portfolio in (("a", "model"), ("b", "equal_weight_eligible"))
        ),
    ),
    "cached_inputs": query(NATION_BARS, WIDE_ROWS),
    "saved_inputs_order": query(
        f"{NATION_BARS}, {SUPPLIERS}",
        """SELECT 'constituents' AS table_name, count(*) AS rows, true AS in_order FROM details
UNION ALL SELECT 'prices', (SELECT count(DISTINCT d) FROM nation_bars) * count(*), true FROM nation""",
    ),
    "date_formats": f"""
WITH days AS (SELECT CAST(l_shipdate AS DATE) AS d, make_date(year(d), month(d), least(day(d), 12)) AS e FROM lineitem),
texts AS (SELECT UNNEST([
    {{'column_name': 'named', 'text': CAST(day(d) AS VARCHAR) || strftime(d, ' %B %Y')}},
    {{'column_name': 'day_first', 'text': strftime(d, '%d/%m/%Y')}},
    {{'column_name': 'open', 'text': strftime(e, '%d/%m/%Y')}}], recursive := true) FROM days),
read AS (SELECT column_name, text, UNNEST([{", ".join(f"{{'format': '{spark}', 'day': try_strptime(text, '{duck}')}}" for spark, duck in DATE_FORMATS.items())}], recursive := true) FROM texts)
SELECT column_name, "format", count(*) AS rows, count("day") AS fits, count(*) = count("day") AS fits_all FROM read GROUP BY column_name, "format"
""",
    "inferred_dates": query(BARS, f"SELECT {KEYS}, {QUOTES} FROM bars"),
    "wide_csv_roundtrip": query(
        NATION_BARS,
        WIDE_ROWS,
    ),
    "constituents_roundtrip": query(
        SUPPLIERS,
        """SELECT lower(t) AS "Ticker", s_name AS "Security", n_name AS "GICS Sector",
    CAST(NULL AS VARCHAR) AS "GICS Sub-Industry" FROM details""",
    ),
    "sorted_export": query(
        f"{CLEAN}, {SPLITS}",
        "SELECT count(*) AS rows, true AS in_order, min(d) AS first_date, max(d) AS last_date FROM splits",
    ),
    "predictions_csv": query(
        EVALUATED,
        f"""SELECT d AS "Date", t AS "Ticker", {r8("prediction", "CASE WHEN month(d) <> 5 THEN p END")} FROM entered""",
    ),
    "training_inputs": query(
        f"{CLEAN}, {SPLITS}",
        f"SELECT {all_r8('mom_5d', 'vol_20d', 'range_pct', 'target')} FROM splits WHERE split = 'train' AND target IS NOT NULL",
    ),
}
