"""The catalogue's queries as plain SQL over the star-schema tables, for checking against another engine."""

from __future__ import annotations

from ledgerline.functions.text import KEEP_LOWER, KEEP_UPPER, LEADING_DATE, PASSES, PREFIXES, TRAILERS
from ledgerline.plans import adapter
from ledgerline.rules import Ordered
from ledgerline.schemas import COST_FLOWS, OUTGO


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def first_match(rules: Ordered, text: str) -> str:
    """CASE over lower-cased text."""
    arms = " ".join(f"WHEN {' OR '.join(f'contains({text}, {_q(p.lower())})' for p in ps)} THEN {_q(label)}" for label, ps in rules.entries if ps)
    return f"CASE {arms} END"


def _strip_prefixes(text: str) -> str:
    for _ in range(PASSES):
        text = f"trim(regexp_replace(regexp_replace({text}, {_q(PREFIXES)}, ''), {_q(LEADING_DATE)}, ''))"
    return text


def _strip_trailers(text: str) -> str:
    for t in TRAILERS:
        text = f"trim(regexp_replace({text}, {_q(t)}, ''), ' -,')"
    return text


def _list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


R = adapter.rules()
_PREFIX = "[" + ", ".join(_q(p) for p in adapter.PREFIXES) + "]"
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"

OBS = f"""obs AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'simplefin' ELSE 'drop' END AS source, 'ACT-' || (o_custkey % 7) AS native_account, l_orderkey || '-' || l_linenumber AS external_id, l_orderkey,
    CAST(l_shipdate AS DATE) AS posted_on, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS transacted_on, l_linestatus = 'O' AS pending,
    CASE WHEN l_orderkey % 67 <> 0 THEN CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * {_CENTS} END AS amount_cents, CASE WHEN l_orderkey % 67 = 0 THEN 'not an amount: ''?''' END AS reject_reason,
    CASE WHEN l_orderkey % 53 = 0 THEN 'Direct Payee' WHEN l_orderkey % 59 = 0 THEN '' END AS payee, CASE WHEN l_orderkey % 61 = 0 THEN 'transfer' WHEN l_orderkey % 71 = 0 THEN '' END AS flow_hint, {_PREFIX}[1 + l_linenumber % {len(adapter.PREFIXES)}] || upper(p_name) || ' #' || l_suppkey AS description, l_shipdate AS observed_at,
    sha256(l_partkey || '|' || l_suppkey || '|' || {_CENTS} || '|' || CAST(round(l_quantity * 100) AS BIGINT) || '|' || CAST(round(l_discount * 100) AS BIGINT) || '|' || CAST(round(l_tax * 100) AS BIGINT) || '|' || l_returnflag || '|' || l_linestatus) AS uid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
COLLAPSED = f"""{OBS}, dedup AS (
  SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY source, native_account, external_id, posted_on, transacted_on, amount_cents, description, pending ORDER BY observed_at, uid) = 1),
latest AS (
  SELECT *, min(observed_at) OVER g AS first_seen_at, max(observed_at) OVER g AS last_seen_at, count(*) OVER g AS revisions, coalesce(min(amount_cents) OVER g < max(amount_cents) OVER g, false) AS amount_changed
  FROM dedup WINDOW g AS (PARTITION BY source, native_account, external_id)
  QUALIFY row_number() OVER (PARTITION BY source, native_account, external_id ORDER BY observed_at DESC, uid DESC) = 1),
keyed AS (SELECT *, substr(sha256(source || chr(31) || native_account || chr(31) || external_id), 1, 24) AS txn_key FROM latest)"""
NAMED = f"""n0 AS (SELECT *, trim(regexp_replace(regexp_replace({_strip_prefixes("trim(regexp_replace(description, '\\s+', ' ', 'g'))")}, '[*_|]+', ' ', 'g'), '\\s+', ' ', 'g'), ' -,') AS x0 FROM keyed),
n1 AS (SELECT *, coalesce(nullif({_strip_trailers('x0')}, ''), x0) AS x1 FROM n0),
n2 AS (SELECT *, coalesce(nullif({_strip_trailers('x1')}, ''), x1) AS x2 FROM n1),
n3 AS (SELECT *, coalesce(nullif({_strip_trailers('x2')}, ''), x2) AS x3 FROM n2),
n4 AS (SELECT *, lower(trim(regexp_replace(description, '\\s+', ' ', 'g'))) AS low, string_split(trim(x3, ' -,'), ' ') AS words FROM n3),
named AS (SELECT *, coalesce({first_match(R.merchants, 'low')}, array_to_string(list_transform(words, lambda w, i: CASE WHEN lower(w) IN {_list(KEEP_UPPER)} THEN upper(w) WHEN lower(w) IN {_list(KEEP_LOWER)} AND i > 1 THEN lower(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ')) AS auto_name FROM n4)"""
FEED = f"""{COLLAPSED}, {NAMED},
edits AS (SELECT *, l_orderkey % 101 = 0 AS deleted, l_orderkey % 101 <> 0 AND l_orderkey % 37 = 0 AS has_category, CASE WHEN l_orderkey % 2 = 0 THEN 'services' END AS new_category, l_orderkey % 101 <> 0 AND l_orderkey % 37 <> 0 AND l_orderkey % 41 = 0 AS has_merchant,
  CASE WHEN l_orderkey % 101 <> 0 AND l_orderkey % 37 <> 0 AND l_orderkey % 41 <> 0 AND l_orderkey % 43 = 0 AND l_orderkey % 2 = 0 THEN 'fee' END AS manual_flow FROM named),
f0 AS (SELECT *, CASE WHEN has_merchant THEN 'Corner Shop' ELSE coalesce(nullif(payee, ''), auto_name) END AS merchant, native_account = 'ACT-6' AS unmapped, CASE native_account WHEN 'ACT-0' THEN 'checking' WHEN 'ACT-1' THEN 'savings' WHEN 'ACT-6' THEN 'other' ELSE 'credit' END AS kind, coalesce(transacted_on, posted_on) AS dated_on FROM edits),
f1 AS (SELECT *, nullif(trim(regexp_replace(regexp_replace(lower(merchant), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')), '') AS merchant_key,
  coalesce(manual_flow, {first_match(R.flows, 'low')}, nullif(flow_hint, ''), CASE WHEN amount_cents IS NULL THEN 'unknown' WHEN amount_cents < 0 THEN '{OUTGO}' WHEN kind = 'credit' THEN 'refund' WHEN kind IN ('checking', 'savings') THEN 'income' ELSE 'unknown' END) AS flow,
  CASE WHEN has_category THEN new_category ELSE {first_match(R.categories, 'lower(merchant)')} END AS category FROM f0),
f2 AS (SELECT *, flow IN {_list(COST_FLOWS)} AND NOT deleted AND amount_cents IS NOT NULL AS counts FROM f1),
feed AS (SELECT *, CASE WHEN unmapped THEN 'unmapped:' || native_account ELSE 'account-' || substr(native_account, 5) END AS account_key, CASE WHEN counts THEN -amount_cents ELSE 0 END AS net_cost_cents, CASE WHEN amount_cents IS NOT NULL THEN greatest(-amount_cents, 0) END AS outflow_cents, CASE WHEN amount_cents IS NOT NULL THEN greatest(amount_cents, 0) END AS inflow_cents,
  CASE WHEN deleted THEN 'ignored' WHEN amount_cents IS NULL OR unmapped OR dated_on IS NULL THEN 'needs_review' WHEN pending THEN 'pending' ELSE 'ok' END AS status,
  CASE WHEN deleted THEN 'deleted' WHEN amount_cents IS NULL THEN 'amount unparseable: ' || coalesce(reject_reason, 'unknown') WHEN unmapped THEN native_account || ' is not named in accounts.toml' WHEN dated_on IS NULL THEN 'no date' END AS review_reason FROM f2),
costs AS (SELECT *, txn_key AS id, dated_on AS date, strftime(dated_on, '%Y-%m') AS month FROM feed WHERE counts)"""
AS_OF = f"DATE '{adapter.AS_OF}'"
MONTHS = f"months AS (SELECT DISTINCT month FROM costs WHERE month < strftime({AS_OF}, '%Y-%m') ORDER BY month DESC LIMIT 4)"
_MONEY = lambda c: f"(({c}) // 100) || '.' || lpad((({c}) % 100)::VARCHAR, 2, '0')"
RECEIPTS = f"""items AS (SELECT l_orderkey, p_name, CAST(l_quantity AS BIGINT)::VARCHAR AS qty, {_CENTS} AS cents, {_MONEY(_CENTS)} AS total FROM lineitem JOIN part ON l_partkey = p_partkey),
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_name, qty, total) AS n FROM items),
kept AS (SELECT l_orderkey AS receipt_id, n, p_name AS description, qty, cents AS total_cents FROM numbered WHERE l_orderkey % 13 <> 0 AND l_orderkey % 29 <> 0 AND NOT (n = 1 AND l_orderkey % 31 <> 0 AND l_orderkey % 43 = 0)),
sums AS (SELECT receipt_id, sum(total_cents)::BIGINT AS item_cents FROM kept GROUP BY 1),
rc0 AS (SELECT o_orderkey AS receipt_id, o_orderkey % 13 <> 0 AS tried, o_orderkey % 29 = 0 AS failed, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 29 <> 0 THEN (SELECT min(p_name) FROM items WHERE l_orderkey = o_orderkey) END AS merchant,
  CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 29 <> 0 THEN CAST(o_orderdate AS DATE) END AS purchased_on, o_orderkey % 31 = 0 AS has_category,
  CASE WHEN o_orderkey % 47 = 0 AND o_orderkey % 31 <> 0 AND o_orderkey % 43 <> 0 THEN 1235 WHEN o_orderkey % 13 <> 0 AND o_orderkey % 29 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS total_cents, (o_orderkey % 47 = 0) AS edited FROM orders),
rc AS (SELECT rc0.*, item_cents, CASE WHEN NOT has_category THEN coalesce({first_match(R.categories, 'lower(merchant)')}, CASE WHEN tried AND NOT failed THEN 'services' END) END AS category,
  nullif(trim(regexp_replace(regexp_replace(lower(merchant), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')), '') AS merchant_key FROM rc0 LEFT JOIN sums USING (receipt_id)),
receipt_txn AS (SELECT receipt_id, merchant, merchant_key, purchased_on, total_cents, category,
  CASE WHEN merchant IS NULL AND total_cents IS NULL AND purchased_on IS NULL THEN CASE WHEN NOT tried THEN 'pending' ELSE 'failed' END
       WHEN merchant IS NULL OR total_cents IS NULL OR purchased_on IS NULL THEN 'needs_review' WHEN abs(item_cents - total_cents) > 2 THEN 'needs_review' ELSE 'ok' END AS status FROM rc)"""
POLLS = """polls AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS uid, 'source-' || (user_id % 5) AS source, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'partial' ELSE 'ok' END AS outcome, ts AS started_at,
  CASE WHEN user_id % 5 <> 4 OR day(ts) % 7 < 3 THEN CAST(ts AS DATE) END AS window_from, CASE WHEN user_id % 5 <> 4 OR day(ts) % 7 < 3 THEN CAST(ts AS DATE) + 1 END AS window_to, event_type AS note, event_id % 97 = 0 AS broken FROM events)"""
ACCOUNTS = f"""acc_obs AS (SELECT lpad(c_custkey::VARCHAR, 12, '0') AS uid, CASE WHEN c_custkey % 2 = 0 THEN 'simplefin' ELSE 'drop' END AS source, 'ACT-' || (c_custkey % 7) AS native_id, c_mktsegment AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS balance_cents, TIMESTAMP '2001-01-01' + to_seconds(c_custkey * 60) AS observed_at FROM customer),
acc_new AS (SELECT * FROM acc_obs QUALIFY row_number() OVER (PARTITION BY source, native_id ORDER BY observed_at DESC, uid DESC) = 1),
acc AS (SELECT native_id, CASE WHEN native_id = 'ACT-6' THEN 'unmapped:ACT-6' ELSE 'account-' || substr(native_id, 5) END AS account, CASE WHEN native_id = 'ACT-6' THEN arg_min(name, source) ELSE 'Account ' || substr(native_id, 5) END AS name, CASE native_id WHEN 'ACT-0' THEN 'checking' WHEN 'ACT-1' THEN 'savings' WHEN 'ACT-6' THEN 'other' ELSE 'credit' END AS kind,
  CASE WHEN native_id = 'ACT-6' THEN 'Bank' WHEN native_id < 'ACT-3' THEN 'First Bank' ELSE 'Second Bank' END AS institution, arg_max(balance_cents, observed_at) AS balance_cents, max(observed_at) AS last_seen_at, native_id = 'ACT-6' AS unmapped FROM acc_new GROUP BY native_id)"""
