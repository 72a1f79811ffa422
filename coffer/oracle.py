"""DuckDB SQL for the ledger queries, written apart from them."""

from __future__ import annotations

from types import SimpleNamespace

from .functions import predicates

REF = "DATE '2001-09-01'"
#: What the SQL knows of each cadence: name, months, days, cycle, grace, second miss, tolerance, interval tolerance, median from and to, pair from and to, least charges.
_FIELDS = ("name", "months", "days", "cycle", "grace", "second_miss", "tolerance", "interval_tolerance", "median", "pair", "least")
CADENCES = [
    SimpleNamespace(**dict(zip(_FIELDS, row)))
    for row in (
        ("monthly", 1, 0, 30, 5, True, 3, 7, (25, 36), (24, 38), 3),
        ("annual", 12, 0, 365, 21, False, 14, 30, (330, 395), (330, 395), 2),
        ("quarterly", 3, 0, 91, 10, False, 7, 10, (80, 100), (75, 105), 3),
        ("semiannual", 6, 0, 182, 10, False, 7, 14, (165, 200), (165, 200), 2),
        ("biweekly", 0, 14, 14, 3, True, 2, 3, (12, 17), (12, 17), 4),
        ("weekly", 0, 7, 7, 2, True, 1, 2, (5, 9), (5, 9), 4),
    )
]

T = """t AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(-(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))) AS DECIMAL(18,4)) AS amount,
  o_custkey AS account, s_name AS merchant_raw, lower(s_name) AS merchant, p_type AS category, p_name AS memo
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
C = "c AS (SELECT o_orderkey AS id, o_custkey AS account, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,4)) AS amount FROM orders)"
P = "p AS (SELECT event_id AS id, ts, user_id AS account, json_extract_string(props, '$.k') AS merchant, -CAST(value AS DECIMAL(18,2)) AS amount FROM events WHERE event_type = 'purchase')"

_CADENCE = "CASE " + " ".join(f"WHEN median_gap BETWEEN {c.median[0]} AND {c.median[1]} AND n >= {c.least} THEN '{c.name}'" for c in CADENCES) + " ELSE 'unknown' END"


def _advance(date: str, n: str) -> str:
    return "CASE cadence " + " ".join(f"WHEN '{c.name}' THEN CAST({date} + ({n}) * INTERVAL {f'{c.months} MONTH' if c.months else f'{c.days} DAY'} AS DATE)" for c in CADENCES) + " END"


def _value(field: str) -> str:
    return "CASE cadence " + " ".join(f"WHEN '{c.name}' THEN {getattr(c, field)}" for c in CADENCES) + " END"


S = f"""{C},
g AS (SELECT *, date - lag(date) OVER (PARTITION BY account ORDER BY date, id) AS gap FROM c),
k AS (SELECT account, count(*) AS n, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps, min(date) AS first_date, max(date) AS last_date FROM g GROUP BY account),
l AS (SELECT account, amount AS price FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY date DESC, id DESC) AS r FROM c) WHERE r = 1),
m AS (SELECT k.*, price, c_name AS name, c_mktsegment AS category, CAST(gaps[len(gaps) // 2 + 1] AS INTEGER) AS median_gap
  FROM k JOIN l USING (account) JOIN customer ON c_custkey = account),
n AS (SELECT *, {_CADENCE} AS cadence FROM m),
s AS (SELECT *, {_advance('last_date', '1')} AS next_date FROM n)"""
MONTHLY = "CASE cadence WHEN 'weekly' THEN CAST(price AS DOUBLE) * 52 / 12 WHEN 'biweekly' THEN CAST(price AS DOUBLE) * 26 / 12 WHEN 'quarterly' THEN CAST(price AS DOUBLE) / 3 WHEN 'semiannual' THEN CAST(price AS DOUBLE) / 6 WHEN 'annual' THEN CAST(price AS DOUBLE) / 12 ELSE CAST(price AS DOUBLE) END"
MISSING = f"""{T}, {S}, w AS (SELECT account, cadence, cycle, {_advance('last_date', 'cycle')} AS expected, {_advance('last_date', 'cycle + 1')} AS closes
  FROM s, (SELECT unnest([1, 2]) AS cycle) WHERE cadence <> 'unknown'),
v AS (SELECT account, cycle, expected, closes, CAST(expected + {_value('grace')} AS DATE) AS opens FROM w),
miss AS (SELECT account, cycle, expected FROM v WHERE opens < {REF} AND EXISTS (SELECT 1 FROM t WHERE t.account = v.account AND t.date <= {REF} AND t.date BETWEEN opens AND closes))"""
STATE = f"""{MISSING}, f AS (SELECT account, bool_or(cycle = 1) AS a, bool_or(cycle = 2) AS b FROM miss GROUP BY account),
j AS (SELECT s.*, coalesce(a, false) AS a, coalesce(b, false) AS b, {_value('grace')} AS grace, {_value('second_miss')} AS tolerant, {_advance('last_date', '2')} AS following FROM s LEFT JOIN f USING (account)),
state AS (SELECT *, CASE WHEN cadence = 'unknown' THEN 'needsReview' WHEN next_date + grace >= {REF} THEN 'active' WHEN a AND (NOT tolerant OR b) THEN 'former'
  WHEN a AND following + grace >= {REF} THEN 'active' ELSE 'needsReview' END AS state FROM j),
st AS (SELECT *, CASE WHEN state = 'active' AND next_date + grace >= {REF} THEN next_date WHEN state = 'active' THEN following END AS renews FROM state)"""
OVERLAP = f"o AS (SELECT lower(coalesce(category, 'uncategorized')) AS category, count(*) AS n, round(sum({MONTHLY}), 2) AS exposure FROM s WHERE cadence <> 'unknown' GROUP BY 1 HAVING count(*) > 1 AND lower(coalesce(category, 'uncategorized')) <> 'uncategorized')"
RISE = """r AS (SELECT account, sum(amount) AS total, count(*) AS n FROM c GROUP BY account HAVING count(*) > 1),
la AS (SELECT account, amount AS latest FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY date DESC, id DESC) AS i FROM c) WHERE i = 1),
ri AS (SELECT account, latest, CAST(total - latest AS DOUBLE) / (n - 1) AS rest FROM r JOIN la USING (account)),
rise AS (SELECT account, latest, round(rest, 6) AS mean_before, round((CAST(latest AS DOUBLE) - rest) / rest, 6) AS rise FROM ri)"""


def _any(text: str, terms: list[str], tokens: bool) -> str:
    quoted = [t.replace("'", "''") for t in terms]
    parts = [f"contains({text}, '{t}')" for t in quoted if not (tokens and t.isalnum())]
    single = [t for t in quoted if tokens and t.isalnum()]
    if single:
        parts.append(f"list_has_any(string_split_regex({text}, '[^\\p{{L}}\\p{{N}}]+'), [{', '.join(repr(t) for t in single)}])")
    return "(" + " OR ".join(parts) + ")"


_X = "lower(concat_ws(' ', memo, category, merchant_raw, merchant))"
_SHAPE = "lower(coalesce(memo, ''))"
for _pattern in (r"\b[a-f0-9]{8,}\b", r"\d+", r"\b(invoice|inv|ref|reference|order|txn|transaction|id|no)\b", r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b", r"[^\p{L}]+"):
    _SHAPE = f"regexp_replace({_SHAPE}, '{_pattern}', ' ', 'g')"

SQL: dict[str, str] = {
    "agg_monthly_spend": f"WITH {T} SELECT CAST(date_trunc('month', date) AS DATE) AS period, CAST(sum(abs(amount)) AS DECIMAL(28,4)) AS spent FROM t WHERE amount < 0 GROUP BY 1",
    "agg_yearly_spend": f"WITH {T} SELECT CAST(date_trunc('year', date) AS DATE) AS period, CAST(sum(abs(amount)) AS DECIMAL(28,4)) AS spent FROM t WHERE amount < 0 GROUP BY 1",
    "agg_category_spend": f"WITH {T} SELECT category, CAST(sum(abs(amount)) AS DECIMAL(28,4)) AS spent, count(*) AS n FROM t WHERE amount < 0 GROUP BY 1",
    "agg_run_rate": f"WITH {S} SELECT count(*) AS n, round(sum({MONTHLY}), 2) AS monthly, round(sum({MONTHLY}) * 12, 2) AS yearly FROM s WHERE cadence <> 'unknown'",
    "agg_overlap_groups": f"WITH {S}, {OVERLAP} SELECT category, n, exposure FROM o",
    "agg_mode_kind": f"WITH {T}, a AS (SELECT account, category, count(*) AS n FROM t GROUP BY ALL) SELECT account, category, n FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY n DESC, category DESC) AS r FROM a) WHERE r = 1",
    "agg_upper_median_interval": f"WITH {S} SELECT account, n, median_gap FROM s",
    "agg_top_quartile": f"WITH {C}, a AS (SELECT account, list_sort(list(amount)) AS a FROM c GROUP BY account) SELECT account, a[least(len(a) - 1, len(a) * 3 // 4) + 1] AS threshold FROM a",
    "agg_price_increase": f"WITH {C}, {RISE} SELECT * FROM rise WHERE rise >= 0.05",
    "agg_first_last_change": f"""WITH {C}, a AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY date, id) AS i, row_number() OVER (PARTITION BY account ORDER BY date DESC, id DESC) AS j FROM c),
b AS (SELECT x.account, x.amount AS first, y.amount AS last FROM a x JOIN a y ON x.account = y.account AND x.i = 1 AND y.j = 1)
SELECT account, first, last, round(CAST(last - first AS DOUBLE) / CAST(first AS DOUBLE), 6) AS change FROM b WHERE first <> 0 AND abs(round(CAST(last - first AS DOUBLE) / CAST(first AS DOUBLE), 6)) >= 0.03""",
    "agg_tenure": f"WITH {S} SELECT account, first_date, last_date, date_diff('month', first_date, last_date) - CASE WHEN day(last_date) < day(first_date) THEN 1 ELSE 0 END AS months FROM s",
    "agg_memo_diversity": f"WITH {T} SELECT merchant, count(DISTINCT trim({_SHAPE})) AS shapes, count(*) AS n, round(count(DISTINCT trim({_SHAPE})) / count(*), 6) AS diversity FROM t GROUP BY merchant",
    "agg_sorted_distinct_sample": f"WITH {T} SELECT account, array_to_string(list_sort(list(DISTINCT category))[1:3], ',') AS sample FROM t GROUP BY account",
    "win_intervals": f"WITH {S} SELECT id, account, CAST(gap AS INTEGER) AS gap FROM g",
    "win_price_step": f"WITH {C}, b AS (SELECT id, account, amount, lag(amount) OVER (PARTITION BY account ORDER BY date, id) AS p FROM c) SELECT id, account, CASE WHEN p IS NOT NULL AND greatest(abs(amount), abs(p)) > 0 THEN round(CAST(abs(amount - p) AS DOUBLE) / CAST(greatest(abs(amount), abs(p)) AS DOUBLE), 6) END AS step FROM b",
    "win_ordinal": f"WITH {C}, b AS (SELECT *, account || '|' || strftime(date, '%Y %m 01') AS fingerprint FROM c) SELECT id, fingerprint, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY date, id) - 1 AS INTEGER) AS ordinal FROM b",
    "win_mom_change": f"WITH {T}, a AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period, CAST(sum(abs(amount)) AS DECIMAL(28,4)) AS spent FROM t WHERE amount < 0 GROUP BY 1), b AS (SELECT *, lag(spent) OVER (ORDER BY period) AS before FROM a) SELECT period, spent, before, round(CAST(spent - before AS DOUBLE) / CAST(before AS DOUBLE), 6) AS change FROM b",
    "jn_fuzzy_interval": f"WITH {P}, q AS (SELECT id, account, CAST(ts AS DATE) AS date, CAST(floor(amount / 10) AS INTEGER) AS amount, merchant[1:1] AS m FROM p) SELECT a.id AS left_id, b.id AS right_id, CAST(abs(a.date - b.date) AS INTEGER) AS days, 1.0::DOUBLE AS similarity FROM q a JOIN q b ON a.account = b.account AND a.amount = b.amount AND a.m = b.m AND abs(a.date - b.date) <= 2 AND a.id < b.id",
    "jn_last_writer_dedupe": f"WITH {P} SELECT account, id, amount FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, id DESC) AS r FROM p) WHERE r = 1",
    "jn_fingerprint_upsert": f"WITH {P}, a AS (SELECT id, amount, merchant FROM p WHERE id % 3 <> 0), b AS (SELECT id, CAST(CASE WHEN id % 4 = 0 THEN amount + 1 ELSE amount END AS DECIMAL(18,2)) AS amount, merchant FROM p WHERE id % 2 = 0) SELECT coalesce(b.id, a.id) AS id, coalesce(b.amount, a.amount) AS amount, coalesce(b.merchant, a.merchant) AS merchant, CASE WHEN b.id IS NULL THEN 'kept' WHEN a.id IS NULL THEN 'inserted' WHEN a.amount = b.amount THEN 'unchanged' ELSE 'updated' END AS outcome FROM a FULL JOIN b ON a.id = b.id",
    "jn_lookup_default": f"WITH {P} SELECT coalesce(c_mktsegment, 'Uncategorized') AS segment, count(*) AS n, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM p LEFT JOIN customer ON c_custkey = account AND c_custkey % 2 = 0 GROUP BY 1",
    "jn_semi_coverage": f"WITH {C}, {P} SELECT id, account FROM c WHERE account IN (SELECT account FROM p)",
    "set_except_unclaimed": f"WITH {S} SELECT id, account, date FROM c WHERE account NOT IN (SELECT account FROM s WHERE cadence <> 'unknown')",
    "set_union_opportunities": f"WITH {S}, {OVERLAP}, {RISE} SELECT 0 AS priority, category AS key FROM o UNION ALL SELECT 1, CAST(account AS VARCHAR) FROM rise WHERE rise >= 0.05",
    "fn_normalize_merchant": r"""WITH a AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(upper('POS ' || p_brand || '*' || p_name || '/INTL 4411'), '[*#/]+', ' ', 'g'), '\b\d{2,}\b', ' ', 'g'), '\b[A-Z]*\d[A-Z0-9\-]{2,}\b', ' ', 'g') AS x FROM part),
b AS (SELECT p_partkey, [w FOR w IN string_split_regex(x, '[^\p{L}\p{N}]+') IF w <> '' AND w <> 'POS'][1:4] AS w FROM a)
SELECT p_partkey, array_to_string([CASE WHEN v = 'INTL' THEN 'International' ELSE v[1:1] || lower(v[2:]) END FOR v IN w], ' ') AS merchant FROM b""",
    "fn_parse_amount": "SELECT event_id, CASE event_id % 4 WHEN 1 THEN CAST(-CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,4)) WHEN 3 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,4)) END AS amount FROM events",
    "fn_parse_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders",
    "fn_monthly_normalize": f"WITH {S} SELECT account, cadence, round({MONTHLY}, 4) AS monthly FROM s",
    "fn_calendar_advance": f"WITH {C} SELECT id, CAST(date + INTERVAL 1 MONTH AS DATE) AS monthly_1, CAST(date + INTERVAL 6 MONTH AS DATE) AS quarterly_2, CAST(date + INTERVAL 12 MONTH AS DATE) AS annual_1, CAST(date + INTERVAL 42 DAY AS DATE) AS biweekly_3 FROM c",
    "fn_month_end_clamp": f"WITH {C} SELECT id, date = last_day(date) AS at_end, last_day(date) AS day_31, least(last_day(date), CAST(date_trunc('month', date) + INTERVAL 29 DAY AS DATE)) AS day_30 FROM c",
    "pred_text_signals": f"WITH {T} SELECT {_any(_X, predicates.MOVEMENT, False)} AS movement, {_any(_X, predicates.MOVEMENT, False)} OR {_any(_X, predicates.BILLS, True)} AS bill, {_any(_X, predicates.NOISE, True)} AS noise, {_any(_X, predicates.EXPLICIT, True)} AS keyword, {_any('lower(category)', predicates.EXCLUDED, False)} AS excluded, count(*) AS n FROM t GROUP BY ALL",
    "rec_cadence": f"WITH {S} SELECT account, n, median_gap, cadence, next_date FROM s",
    "jn_range_missing_cycles": f"WITH {MISSING} SELECT * FROM miss",
    "lc_status": f"WITH {STATE} SELECT account, cadence, state, renews FROM st",
    "top_renewals": f"WITH {STATE} SELECT account, name, renews FROM st WHERE renews >= {REF} AND renews < {REF} + 90 ORDER BY renews, name LIMIT 12",
    "qry_calendar_month": f"WITH {STATE} SELECT renews, count(*) AS n, CAST(sum(price) AS DECIMAL(28,4)) AS due FROM st WHERE date_trunc('month', renews) = DATE '2001-10-01' GROUP BY renews",
    "occ_status": f"""WITH {S}, e AS (SELECT account, cycle, price, {_advance('first_date', 'cycle')} AS expected, {_value('tolerance')} AS tol FROM s, (SELECT unnest([1, 2, 3]) AS cycle) WHERE cadence <> 'unknown'),
x AS (SELECT e.*, c.id, c.amount, row_number() OVER (PARTITION BY e.account, e.cycle ORDER BY c.date, c.id) AS r FROM e LEFT JOIN c ON c.account = e.account AND c.date BETWEEN expected - tol AND expected + tol)
SELECT account, cycle, expected, id, CASE WHEN id IS NOT NULL THEN CASE WHEN abs(CAST(amount - price AS DOUBLE) / CAST(price AS DOUBLE)) > 0.12 THEN 'priceChanged' ELSE 'matched' END WHEN expected + tol < {REF} THEN 'missed' ELSE 'pending' END AS status FROM x WHERE r = 1""",
    "page_ledger": f"WITH {C} SELECT id, account, date, amount FROM c ORDER BY date DESC, id DESC LIMIT 100",
    "search_ledger": f"WITH {T} SELECT memo, count(*) AS n FROM t WHERE contains(lower(merchant_raw), 'ring') OR contains(lower(category), 'ring') OR contains(lower(memo), 'ring') GROUP BY memo",
    "src_ofx": """SELECT CAST(o_orderdate AS DATE) AS date, CAST(-CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS amount, 'bill ' || o_orderkey AS merchant_raw, CAST(o_custkey AS VARCHAR) AS account,
  'bill ' || o_orderkey AS memo, 'USD' AS currency, CAST(o_orderkey AS VARCHAR) AS external_id FROM orders""",
    "src_json": f"WITH {P} SELECT CAST(ts AS DATE) AS date, CAST(amount AS DECIMAL(18,4)) AS amount, coalesce(nullif(trim(merchant), ''), 'Unknown merchant') AS merchant_raw, CAST(account AS VARCHAR) AS account, CAST(id AS VARCHAR) AS external_id FROM p",
    "src_decode": """SELECT p_partkey,
        CASE p_partkey % 8 WHEN 1 THEN 'windows-1252' WHEN 2 THEN 'macOSRoman' WHEN 3 THEN 'windows-1252' WHEN 4 THEN 'UTF-16' WHEN 5 THEN 'UTF-16' WHEN 6 THEN 'UTF-16BE' ELSE 'UTF-8' END AS encoding,
        p_partkey % 8 = 3 AS garbled,
        CASE WHEN p_partkey % 8 = 7 THEN p_name ELSE 'date,note' || chr(10) || '2025-01-02,' || p_name || ' ' ||
            CASE p_partkey % 8 WHEN 2 THEN 'è' WHEN 3 THEN 'Ã(' ELSE 'é€' END || chr(10) END AS text FROM part""",
    "src_csv": """SELECT CAST(o_orderdate AS DATE) AS date, CAST(-CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS amount, 'Customer; "' || o_custkey || '"' AS merchant_raw, 'bill ' || o_orderkey AS memo FROM orders""",
    "src_xlsx": """SELECT CAST(o_orderdate AS DATE) AS date, CAST(-CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS amount, 'Customer ' || o_custkey AS merchant_raw,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'bill <' || o_orderkey || '>' END AS memo FROM orders""",
}
