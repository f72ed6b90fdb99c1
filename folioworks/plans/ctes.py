"""The archive's tables as DuckDB CTEs, for the oracles; each needs those before it."""

DOCS = """docs AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_depicted,
  CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_range_start,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS source_archive,
  CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS is_key_evidence, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS is_trashed,
  CASE WHEN u.n >= 2 AND o_orderpriority = '1-URGENT' THEN o_custkey END AS group_id,
  CASE WHEN u.n >= 2 AND o_orderpriority = '1-URGENT' THEN rn END AS page_number, o_custkey AS custkey
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority = '1-URGENT' ORDER BY o_orderkey) AS rn FROM orders) o
  LEFT JOIN (SELECT o_custkey AS ck, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u ON u.ck = o.o_custkey)"""
GROUPS = """grps AS (SELECT group_id AS id, 'Group #' || group_id AS title, min(date_depicted) AS date_depicted, CAST(NULL AS VARCHAR) AS date_range_start,
  arg_min(source_archive, page_number) AS source_archive, CASE WHEN group_id % 23 = 0 THEN 1 ELSE 0 END AS is_trashed
  FROM docs WHERE group_id IS NOT NULL GROUP BY group_id)"""
ENTITIES = """ents AS (SELECT s_suppkey + 1000000 AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'person' ELSE 'institution' END AS type, lower(s_name) AS normalized_name FROM supplier
  UNION ALL SELECT c_custkey + 2000000, c_name, 'person', lower(c_name) FROM customer
  UNION ALL SELECT p_partkey + 3000000, p_name, 'object', lower(p_name) FROM part
  UNION ALL SELECT CAST(n_nationkey + 4000000 AS BIGINT), n_name, 'place', lower(n_name) FROM nation)"""
DOC_ENTS = """dents AS (SELECT DISTINCT l_orderkey AS document_id, l_suppkey + 1000000 AS entity_id, 'seller' AS role FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, l_partkey + 3000000, 'lot' FROM lineitem
  UNION ALL SELECT o_orderkey, o_custkey + 2000000, 'buyer' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT o_orderkey, CAST(c_nationkey + 4000000 AS BIGINT), 'origin' FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
GROUP_ENTS = "gents AS (SELECT id AS group_id, id + 2000000 AS entity_id, 'owner' AS role FROM grps)"
TXNS = """txns AS (SELECT l_orderkey AS document_id, CASE WHEN l_returnflag <> 'N' THEN s_name END AS seller, c_name AS buyer,
  CASE WHEN NOT (l_linestatus = 'O' AND l_quantity < 5) THEN strftime(l_shipdate, '%Y-%m-%d') END AS date, l_extendedprice AS price, 'USD' AS currency,
  CASE WHEN l_returnflag = 'R' THEN n_name END AS auction_house, CAST(l_linenumber AS VARCHAR) AS lot_number, l_suppkey AS suppkey
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""
TAGS = "dtags AS (SELECT DISTINCT l_orderkey AS document_id, p_type AS tag FROM lineitem JOIN part ON p_partkey = l_partkey)"
PAGES = "files AS (SELECT page_id, url, sha256(html) AS sha256, CASE WHEN page_id % 9 = 0 THEN 'failed' WHEN page_id % 3 = 0 THEN 'ingested' END AS known FROM pages)"
AUDIT = """audit AS (SELECT event_id, CAST(ts AS VARCHAR) AS ts, CAST(day(ts) AS BIGINT) AS run_id, user_id AS entity_id, event_type AS action,
  CASE event_type WHEN 'error' THEN 'err' WHEN 'signup' THEN 'requeued' ELSE 'ok' END AS status, value, props FROM events)"""
DESCRIBED = """ddocs AS (SELECT *, CASE WHEN id % 13 <> 0 THEN title END AS own_title, 'scan_' || id || '.jpg' AS filename,
  CASE id % 6 WHEN 0 THEN 'Letter' WHEN 1 THEN 'Invoice' WHEN 3 THEN '' WHEN 4 THEN 'photo' WHEN 5 THEN 'Poster' END AS medium,
  CASE id % 6 WHEN 0 THEN 'letter' WHEN 1 THEN 'transaction record' WHEN 4 THEN 'artifact photograph' ELSE 'other' END AS medium_category FROM docs)"""
GROUP_TXNS = "gtxns AS (SELECT docs.group_id, txns.* EXCLUDE (document_id) FROM txns JOIN docs ON docs.id = document_id WHERE docs.group_id IS NOT NULL AND docs.page_number = 1)"
#: Live records: standalone documents and groups.
LIVE = "live AS (SELECT * FROM docs WHERE is_trashed = 0 AND group_id IS NULL), lgrps AS (SELECT * FROM grps WHERE is_trashed = 0)"


def sql(*parts: str) -> str:
    """WITH the given tables, the last part; it can begin with a comma and more tables."""
    return f"WITH {', '.join(parts[:-1])} {parts[-1]}" if len(parts) > 1 else parts[0]


SCORE = "(CASE WHEN trim(seller) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(buyer) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(date) <> '' THEN 1 ELSE 0 END + CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN trim(auction_house) <> '' THEN 1 ELSE 0 END)"
LABEL = """coalesce(nullif(concat_ws(' · ', nullif(auction_house, ''), CASE WHEN seller IS NOT NULL AND buyer IS NOT NULL THEN seller || ' → ' || buyer WHEN seller IS NOT NULL THEN 'Sold by ' || seller WHEN buyer IS NOT NULL THEN 'Acquired by ' || buyer END,
  CASE WHEN price <> 0 THEN currency || ' ' || format('{:,.0f}', price) END), ''), 'Transaction')"""
