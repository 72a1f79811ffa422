"""DuckDB SQL for the detection queries, written apart from them; word lists are the fixed values of ``predicates``."""

from __future__ import annotations

from .functions import predicates as p
from .oracle import CADENCES, _any

REF = "DATE '1998-08-01'"


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


#: Fixed values, by kind: affinity, score of a single charge, threshold of confirmation.
AFF = {"subscriptionService": 0.95, "mediaStreaming": 0.95, "softwareOrSaaS": 0.88, "utilityOrBiller": 0.6, "membershipRetailer": 0.35, "marketplace": 0.12, "groceryRetailer": 0.08, "restaurant": 0.05, "medicalOrWellnessProvider": 0.1, "transportOrTravel": 0.15, "generalRetail": 0.12, "unknown": 0.4}
SVC = "('subscriptionService', 'softwareOrSaaS', 'mediaStreaming')"
NON = "('utilityOrBiller', 'marketplace', 'groceryRetailer', 'restaurant', 'medicalOrWellnessProvider', 'transportOrTravel', 'generalRetail')"
_KINDS = "['subscriptionService', 'membershipRetailer', 'marketplace', 'groceryRetailer', 'restaurant', 'medicalOrWellnessProvider', 'transportOrTravel', 'utilityOrBiller', 'generalRetail', 'softwareOrSaaS', 'mediaStreaming', 'unknown']"
_MEMOS = "['monthly subscription plan', 'transfer to savings', 'electric utility bill', 'refund of a charge', 'visit with the doctor', 'premium membership renewal', 'order 12 shipped', 'icloud storage', 'annual plan', 'thank you']"
_CATEGORIES = "['software', 'groceries', 'streaming', 'travel', '', 'restaurants']"
LEDGER = f"""o AS (SELECT o_orderkey AS id, o_custkey AS cluster, CAST(o_orderdate AS DATE) AS d, o_totalprice AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i,
  CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE) AS f FROM orders),
led AS (SELECT id, cluster, CASE WHEN cluster % 2 = 0 THEN CAST(f + CAST(i * ([30, 7, 14, 91, 182, 365])[(cluster // 2) % 6 + 1] AS INTEGER) AS DATE) ELSE d END AS date,
  CAST(-(CASE WHEN cluster % 3 = 0 THEN 100 + cluster % 50 ELSE t END) AS DECIMAL(18,4)) AS amount,
  ({_MEMOS})[CASE WHEN cluster % 3 < 2 THEN cluster % 10 ELSE id % 10 END + 1] AS memo, ({_CATEGORIES})[CASE WHEN cluster % 3 < 2 THEN (cluster // 10) % 6 ELSE (id // 4) % 6 END + 1] AS category,
  'MERCHANT ' || cluster AS merchant_raw, 'Merchant ' || cluster AS merchant, ({_KINDS})[CASE WHEN cluster % 12 = id % 12 THEN 11 ELSE (cluster // 3) % 12 END + 1] AS kind,
  CAST((cluster * 7 % 10) AS DOUBLE) / 10 AS affinity, CAST(cluster % 10 AS DOUBLE) / 10 + 0.05 AS confidence FROM o)"""
_ALL = "lower(concat_ws(' ', memo, category, merchant_raw, merchant))"
_PLAIN = "lower(concat_ws(' ', memo, merchant_raw, merchant))"
_VISIT = "lower(concat_ws(' ', memo, category, merchant_raw))"
_MOVED = "lower(concat_ws(' ', category, memo, merchant_raw, merchant))"


def _quoted(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_DESCRIPTOR = "CASE " + " ".join(f"WHEN contains({_ALL}, '{k}') THEN '{v}'" for k, v in p.DESCRIPTORS.items()) + " END"
FLAGS = f"""{LEDGER},
fa AS (SELECT *, {_any("lower(memo)", p.REFUND, False)} AS refund, {_any(_MOVED, p.MOVEMENT, False)} AS movement, {_any(_MOVED, p.MOVEMENT, False)} OR {_any(_MOVED, p.BILLS, True)} AS bill,
  {_any(_ALL, p.NOISE, True)} AS noise, {_any(_PLAIN, p.STRONG, True)} AS strong, {_any(_ALL, p.EXPLICIT, True)} AS keyword, {_any(_VISIT, p.APPOINTMENT, True)} AS appointment,
  {_any(_VISIT, p.ORDERS, True)} AS "order", {_any("lower(category)", p.EXCLUDED, False)} AS excluded, {_DESCRIPTOR} AS descriptor,
  {_any(_ALL, ["membership", "monthly", "subscription", "plan", "enrolled", "autopay"], False)} AS planned, {_any(_PLAIN, p.SERVICE, True)} AS service FROM led),
fl AS (SELECT *, NOT noise AND NOT bill AND (lower(trim(category)) IN {_quoted(p.SERVICE_CATEGORIES)} OR service OR kind IN {SVC} OR (kind = 'membershipRetailer' AND strong)) AS known FROM fa)"""

_VARIANT = "lower(memo)"
for _pattern in (r"\d+", r"inv[a-z\-]*", r"ref[a-z\-]*", r"conf[a-z\-]*", r"order[a-z\-]*", r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)\b", r"[a-f0-9\-]{8,}"):
    _VARIANT = f"regexp_replace({_VARIANT}, '{_pattern}', '', 'g')"
_VARIANT = rf"nullif(trim(regexp_replace({_VARIANT}, '[\s\-_*#]+', ' ', 'g')), '')"
_MEDIAN = "CASE " + " ".join(f"WHEN median_gap BETWEEN {c.median[0]} AND {c.median[1]} AND n >= {c.least} THEN '{c.name}'" for c in CADENCES) + " END"
_PAIR = "CASE " + " ".join(f"WHEN median_gap BETWEEN {c.pair[0]} AND {c.pair[1]} THEN '{c.name}'" for c in CADENCES) + " END"
_LEAST = "CASE cadence " + " ".join(f"WHEN '{c.name}' THEN {c.least}" for c in CADENCES) + " END"
_TRIED = ", ".join(f"('{c}', {k}, {n.cycle}, {n.interval_tolerance})" for k, c in enumerate(["weekly", "biweekly", "monthly", "quarterly", "semiannual", "annual"]) for n in CADENCES if n.name == c)
SNAPSHOT = f"""{FLAGS},
st AS (SELECT *, CAST(abs(amount) AS DOUBLE) AS price, lag(CAST(abs(amount) AS DOUBLE)) OVER w AS before, date - lag(date) OVER w AS gap, greatest(affinity, {_case("kind", AFF)}) AS aff, {_VARIANT} AS variant
  FROM fl WINDOW w AS (PARTITION BY cluster ORDER BY date, id)),
ag AS (SELECT cluster, count(*) AS n, count_if(refund) AS n_refund, count_if(movement) AS n_movement, count_if(bill) AS n_bill, count_if(noise) AS n_noise, count_if(keyword) AS n_keyword,
  count_if(appointment) AS n_appointment, count_if("order") AS n_order, count_if(excluded) AS n_excluded, count_if(known) AS n_known, bool_or(keyword) AS explicit, bool_or(strong) AS wording, bool_or(planned) AS planned,
  count(descriptor) AS n_descriptor, round(avg(aff), 9) AS affinity, round(avg(confidence), 9) AS classification, count(DISTINCT variant) AS n_variants, avg(price) AS mean_price, min(price) AS min_price, max(price) AS max_price,
  list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps, list_sort(list(abs(price - before) / greatest(price, before)) FILTER (WHERE before IS NOT NULL)) AS steps FROM st GROUP BY cluster HAVING count(*) >= 2 AND count_if(refund) < count(*)),
ki AS (SELECT cluster, kind FROM (SELECT cluster, kind, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, kind DESC) AS r FROM led GROUP BY cluster, kind) WHERE r = 1),
sa AS (SELECT ag.*, kind, gaps[len(gaps) // 2 + 1] AS median_gap, round(steps[len(steps) // 2 + 1], 9) AS variation, CAST(n_descriptor AS DOUBLE) / n AS descriptor, least(1.0, CAST(greatest(n_keyword, n_descriptor) AS DOUBLE) / n) AS keyword,
  CAST(n_variants AS DOUBLE) / n AS diversity, kind IN {NON} AS nonsub FROM ag JOIN ki USING (cluster)),
sb AS (SELECT *, greatest(0.0, 1 - least(variation / 0.6, 1.0)) AS stability, (n_excluded = 0 AND (affinity >= 0.85 OR (keyword >= 0.7 AND affinity >= 0.65)))
  OR (n_movement + n_bill + n_noise + n_order = 0 AND min_price >= 2.99 AND max_price - min_price <= greatest(0.01, 0.01 * max_price)) AS strongsig FROM sa),
cd(cadence, rank, cycle, tol) AS (VALUES {_TRIED}),
gp AS (SELECT cluster, unnest(gaps) AS gap FROM sb),
gq AS (SELECT cluster, cadence, rank, gap, CAST(cycle AS DOUBLE) AS cycle, CAST(tol AS DOUBLE) AS tol, least(3.0, greatest(1.0, round(gap / CAST(cycle AS DOUBLE)))) AS k FROM gp, cd),
gr AS (SELECT cluster, cadence, rank, bool_and(abs(gap - k * cycle) <= tol * k) AS fits, bool_or(abs(gap - cycle) <= tol) AS direct, avg(greatest(0.0, 1 - abs(gap - k * cycle) / k / tol - 0.1 * (k - 1))) AS fit,
  greatest(0.0, 1 - avg(abs(gap - cycle)) / any_value(tol)) AS plain FROM gq GROUP BY ALL),
gc AS (SELECT *, round(CASE WHEN fits AND direct THEN fit ELSE plain END, 9) AS consistency FROM gr),
sc AS (SELECT *, coalesce({_MEDIAN}, CASE WHEN n = 2 AND strongsig THEN {_PAIR} END) AS c1 FROM sb),
sd AS (SELECT cluster, arg_min(cadence, rank) AS c2 FROM (SELECT gc.*, n FROM gc JOIN sc USING (cluster) WHERE c1 IS NULL AND strongsig AND n >= 3) WHERE fits AND direct AND consistency >= 0.65 AND n >= {_LEAST} GROUP BY cluster),
se AS (SELECT sc.*, coalesce(c1, c2) AS cadence FROM sc LEFT JOIN sd USING (cluster)),
sf AS (SELECT se.*, gc.consistency FROM se JOIN gc ON gc.cluster = se.cluster AND gc.cadence = se.cadence),
sn AS (SELECT *, round(least(1.0, CASE WHEN nonsub THEN CASE WHEN keyword >= 0.5 THEN 0.18 ELSE 0.35 END ELSE least(0.35, 0.35 * n_excluded / n) * CASE WHEN keyword >= 0.5 THEN 0.5 ELSE 1 END END
  + CASE WHEN diversity > 0.65 THEN least(0.15, diversity * greatest(0.1, 1 - descriptor) * 0.2) ELSE 0 END + CASE WHEN variation > 0.3 THEN least(0.15, variation * 0.2) ELSE 0 END
  + CASE WHEN planned THEN 0 ELSE least(0.2, 0.25 * n_appointment / n) END + CASE WHEN n_descriptor > 0 THEN 0 ELSE least(0.2, 0.25 * n_order / n) END
  + CASE WHEN wording THEN least(0.12, 0.16 * n_movement / n) ELSE least(0.45, 0.5 * n_movement / n) END), 9) AS penalty FROM sf)"""
_R = ", ".join(f"round({x}, 6) AS {x}" for x in ("consistency", "variation", "stability", "keyword", "affinity", "classification", "diversity", "descriptor", "penalty", "mean_price", "min_price", "max_price"))
_REJECT = """((n_movement >= greatest(1, n - 1) AND NOT wording) OR (n_bill >= greatest(1, n - 1) AND NOT explicit) OR (n_noise >= greatest(1, n - 1) AND NOT explicit) OR (nonsub AND keyword = 0)
  OR (n_excluded >= greatest(2, n - 1) AND keyword = 0) OR (diversity > 0.8 AND descriptor < 0.2 AND keyword < 0.5 AND affinity < 0.6) OR (variation > 0.65 AND keyword = 0 AND affinity < 0.6))"""
_BASE = """round(greatest(0.0, least(0.99, CASE WHEN cadence IN ('annual', 'semiannual')
  THEN consistency * 0.22 + stability * 0.16 + keyword * 0.18 + affinity * 0.20 + greatest(0.0, 1 - penalty) * 0.12 + classification * 0.12
  ELSE consistency * 0.32 + stability * 0.18 + keyword * 0.14 + affinity * 0.14 + greatest(0.0, 1 - penalty) * 0.12 + classification * 0.10 END)), 9)"""


def _decisions(boost: str, fallback: bool) -> str:
    threshold = 0.42 if fallback else 0.48
    doubtful = "TRUE" if fallback else "(classification < 0.76 OR (stability < 0.5 AND NOT variable) OR score < 0.72)"
    return f"""{SNAPSHOT},
ea AS (SELECT *, {_REJECT} AS rejected, greatest(0.0, 1 - penalty) AS low, consistency >= 0.78 AS sc_, affinity >= 0.78 OR keyword >= 0.45 AS sm_, classification >= 0.72 AS sx_,
  variation <= 0.45 AND consistency >= 0.72 AND affinity >= 0.82 AND kind = 'softwareOrSaaS' AS variable, {_LEAST} AS least_n, {_BASE} AS base FROM sn),
eb AS (SELECT *, CASE WHEN rejected THEN 0.0 ELSE least(0.99, base + {boost}) END AS score, n = 2 AND cadence IN ('annual', 'semiannual') AND sc_ AND sm_ AND sx_ AND low >= 0.72 AS sparse_auto,
  n = 2 AND cadence = 'monthly' AND consistency >= 0.25 AND sm_ AND (sx_ OR (explicit AND keyword >= 0.5)) AND stability >= 0.85 AND low >= 0.82 AND keyword >= 0.35 AND kind IN {SVC} AS pair_auto,
  n_known >= greatest(1, n - 1) AND n_bill = 0 AND n_noise = 0 AND n_movement = 0 AND sm_ AND classification >= 0.55 AND low >= 0.52 AND stability >= 0.65 AS known_auto,
  (nonsub AND keyword < 0.35 AND descriptor < 0.3) OR (n_movement = n AND NOT wording) OR (n_bill >= greatest(1, n - 1) AND NOT explicit) OR (n_noise >= greatest(1, n - 1) AND NOT explicit) AS negative FROM ea),
ec AS (SELECT *, NOT negative AND ((sparse_auto AND score >= 0.72) OR (pair_auto AND score >= 0.62) OR (known_auto AND score >= 0.62)
  OR (n >= least_n AND sc_ AND sm_ AND low >= 0.7 AND (stability >= 0.45 OR variable) AND score >= 0.68 AND (sx_ OR variable))) AS auto_confirm FROM eb),
ed AS (SELECT *, NOT auto_confirm AND score >= {threshold} AND n_movement < n AND (n_bill < n OR explicit) AND (n_noise < n OR explicit) AND penalty < 0.6 AND sc_ AND sm_ AND {doubtful} AS surface,
  CASE WHEN {"FALSE" if fallback else "TRUE"} AND ((pair_auto AND score >= 0.62) OR (known_auto AND score >= 0.62) OR auto_confirm
    OR (consistency >= 0.8 AND (stability >= 0.7 OR variable) AND affinity >= 0.88 AND classification >= 0.82 AND penalty < 0.25 AND kind IN {SVC})
    OR (score >= CASE WHEN kind IN {SVC} THEN 0.72 WHEN kind = 'membershipRetailer' THEN 0.76 WHEN kind = 'utilityOrBiller' THEN 0.90 WHEN kind = 'unknown' THEN 0.82 ELSE 0.86 END
      AND classification >= CASE WHEN kind = 'unknown' THEN 0.45 ELSE 0.35 END)) AND (n >= least_n OR sparse_auto OR pair_auto OR known_auto) THEN 'active' ELSE 'needsReview' END AS status FROM ec),
ee AS (SELECT *, CASE WHEN rejected OR NOT (score >= 0.38 OR surface) THEN 'suppressed' WHEN status = 'active' THEN 'detected' ELSE 'needsReview' END AS disposition,
  rejected OR greatest(consistency, keyword, affinity) >= 0.7 AS recurring,
  CASE WHEN rejected THEN CASE WHEN nonsub AND keyword = 0 THEN 'non-subscription merchant' WHEN n_movement >= greatest(1, n - 1) AND NOT wording THEN 'bank movement' WHEN n_bill >= greatest(1, n - 1) AND NOT explicit THEN 'bill or purchase stream'
    WHEN n_noise >= greatest(1, n - 1) AND NOT explicit THEN 'repeated commerce' WHEN n_excluded >= greatest(2, n - 1) AND keyword = 0 THEN 'excluded categories' ELSE 'too noisy' END
  WHEN nonsub AND keyword = 0 THEN 'recurring, unlikely kind' WHEN classification < 0.65 THEN 'uncertain classification' WHEN diversity > 0.65 AND descriptor < 0.3 THEN 'details vary' WHEN penalty > 0.25 THEN 'conflicting signals'
  ELSE 'stable timing' END AS reason FROM ed)"""


_SAID = "CASE " + " ".join(
    f"WHEN {_any(_ALL, words, False)} THEN '{c}'"
    for c, words in (
        ("annual", ["annual", "yearly", "per year", "12 month", "12-month"]), ("quarterly", ["quarterly", "quarter", "qtr"]), ("semiannual", ["semiannual", "semi-annual", "biannual", "6 month", "6-month"]),
        ("biweekly", ["biweekly", "bi-weekly", "every two weeks", "every 2 weeks", "fortnightly"]), ("weekly", ["weekly", "per week"]),
        ("monthly", ["monthly", "trial", "renew", "renewal", "subscription", "membership", "plan", "premium", "plus", "pro"]),
    )
)
_SINGLE_KIND = "CASE WHEN kind IN " + SVC + " THEN 1.0 WHEN kind = 'membershipRetailer' THEN 0.75 WHEN kind = 'utilityOrBiller' AND keyword THEN 0.55 WHEN kind = 'unknown' THEN 0.45 ELSE 0.08 END"

SQL = {
    "prd_flags": f'WITH {FLAGS} SELECT memo, category, refund, movement, bill, noise, strong, keyword, appointment, "order", excluded, known, descriptor, count(*) AS n FROM fl GROUP BY ALL',
    "prd_group_gate": f"WITH {FLAGS} SELECT cluster FROM fl GROUP BY cluster HAVING NOT bool_and(bill OR kind IN {NON}) OR bool_or(keyword)",
    "scr_snapshot": f"WITH {SNAPSHOT} SELECT cluster, n, kind, cadence, explicit, wording, n_movement, n_bill, n_noise, n_excluded, n_known, n_appointment, n_order, {_R} FROM sn",
    "scr_base_score": f"WITH {SNAPSHOT} SELECT cluster, round({_BASE}, 6) AS base, {_REJECT} AS rejected FROM sn",
    "scr_decision": f"WITH {_decisions('CASE WHEN cluster % 11 = 0 THEN 0.30 ELSE 0 END', False)} SELECT cluster, round(score, 6) AS score, sparse_auto, pair_auto, known_auto, variable, negative, auto_confirm, surface, status, disposition, recurring, reason FROM ee",
    "scr_decision_fallback": f"WITH {_decisions('0.0', True)} SELECT cluster, round(score, 6) AS score, surface, disposition FROM ee",
    "scr_single_charge": f"""WITH {FLAGS}, sg AS (SELECT id AS cluster, *, greatest(affinity, {_case("kind", AFF)}) AS aff FROM (SELECT * EXCLUDE (cluster) FROM fl)),
sh AS (SELECT *, coalesce({_SAID} END, CASE WHEN kind IN {SVC} OR kind IN ('membershipRetailer', 'unknown') OR (kind = 'utilityOrBiller' AND keyword) THEN 'monthly' END, 'unknown') AS cadence,
  greatest(0.0, least(0.99, aff * 0.42 + confidence * 0.20 + CAST(keyword AS INT) * 0.18 + CAST(descriptor IS NOT NULL AS INT) * 0.10 + {_SINGLE_KIND} * 0.10)) AS score FROM sg
  WHERE amount < 0 AND NOT refund AND date >= {REF} - 75 AND (kind NOT IN {NON} OR keyword OR descriptor IS NOT NULL) AND (NOT excluded OR keyword OR descriptor IS NOT NULL) AND (NOT movement OR strong)
  AND (NOT bill OR keyword) AND (NOT noise OR keyword) AND (NOT "order" OR keyword OR descriptor IS NOT NULL)
  AND ((aff >= 0.92 AND confidence >= 0.84) OR (keyword AND aff >= 0.72) OR (descriptor IS NOT NULL AND aff >= 0.78)))
SELECT cluster, cadence, round(score, 6) AS score, CASE WHEN cadence = 'unknown' OR score < 0.62 THEN 'suppressed' ELSE 'needsReview' END AS disposition FROM sh""",
}
