"""DuckDB twins of the registered catalogue queries."""

_NORM = r"upper(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def norm(x: str) -> str:
    return _NORM.format(x)


_VERSIONS = "('V0','V1','V2','V3','V4','FINAL','PROLOGUE','ALPHA','BETA','DEMO','CHAPTER','UPDATE','EPISODE','VERSION')"
_CUSTOMERS = "cu AS (SELECT c_custkey AS catalog_id, c_name AS title, c_mktsegment AS creator, c_acctbal AS rating FROM customer)"
_ORDERS = "o AS (SELECT o_custkey AS catalog_id, o_orderkey AS thread_id, o_orderstatus || ',' || o_orderpriority AS tags, epoch(o_orderdate)::BIGINT AS stamp FROM orders)"
_LISTING = """l AS (SELECT event_id AS thread_id, event_id // 20 AS page_no, event_id % 20 AS pos, CASE WHEN event_type = 'error' THEN 'README' ELSE event_type END AS category,
epoch(date_trunc('second', ts))::BIGINT AS last_thread_comment, event_id % 7 <> 0 AS changed FROM events)"""
_HALVES = """e AS (SELECT user_id, ts, event_id, CASE WHEN ts >= '2024-01-16' AND event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type,
CASE WHEN ts < '2024-01-16' OR event_id % 5 > 0 THEN value END AS value, ts >= '2024-01-16' AS new FROM events)"""
_UNESCAPE = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_LAYOUTS = """rows_(engine, item, kind, conflict) AS (VALUES
('Brand#1', 'data\\main.pak', 'file', false), ('Brand#1', 'lib\\core', 'folder', false), ('Brand#1', 'bin\\run.exe', 'folder', false), ('Brand#1', 'bin\\run.exe\\extra', 'file', true),
('Brand#1', 'data', 'folder', false), ('Brand#1', 'lib', 'folder', false), ('Brand#1', 'bin', 'folder', false),
('Brand#2', 'assets\\img\\a.png', 'file', false), ('Brand#2', 'assets\\img', 'folder', false), ('Brand#2', 'readme.txt', 'file', false), ('Brand#2', 'assets', 'folder', false),
('Brand#3', 'x\\y\\z\\w.bin', 'file', false), ('Brand#3', 'tools', 'folder', false), ('Brand#3', 'x', 'folder', false), ('Brand#3', 'x\\y', 'folder', false), ('Brand#3', 'x\\y\\z', 'folder', false))""".replace("\\\\", "\\")

_ITEMS = f"""o AS (SELECT *, o_orderkey // 20 AS page_no, row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) - 1 AS pos, o_orderkey % 10 <> 0 AS good,
CASE WHEN o_orderkey % 3 = 0 THEN (['VN', 'Unity', 'Completed', 'README'])[o_orderkey % 4 + 1] ELSE '' END AS label FROM orders),
items AS (SELECT page_no::INTEGER AS page_no, pos::INTEGER AS pos, good, CASE WHEN label IN ('VN', 'README') THEN label ELSE '' END AS category, CASE WHEN label = 'Unity' THEN label ELSE '' END AS engine,
CASE WHEN label = 'Completed' THEN label ELSE '' END AS status, 'Order & Co ' || o_orderkey || ' ' AS title, 'v' || o_custkey AS version, o_orderpriority AS creator, '/base/threads/order.' || o_orderkey || '/' AS site_url,
epoch(date_trunc('second', o_orderdate))::BIGINT AS stamp, o_custkey AS replies, CASE WHEN o_orderkey >= 1000 THEN o_orderkey // 1000 * 1000 ELSE o_orderkey END AS views, (o_orderkey % 5)::DOUBLE + 0.5 AS rating,
o_orderkey AS thread_id, 'ORDERCO' || o_orderkey AS short_name, 'ORDERCO' || o_orderkey || '_' || upper(o_orderpriority) AS id_name FROM o)"""

_TWO = """k AS (SELECT c_custkey::BIGINT AS k, c_name AS name, c_nationkey::BIGINT AS nation, c_custkey % 5 AS kind FROM customer), s AS (SELECT max(k) AS top FROM k)"""
_LINES = """u AS (SELECT user_id AS c, epoch(date_trunc('second', max(ts) FILTER (event_id % 4 > 0)))::BIGINT AS l, count(*) AS n FROM events GROUP BY user_id),
lines AS (SELECT l, 'catalog:{"catalog_id":' || c || ',"last_record_update":' || l || ',"n":' || n || '}' AS line FROM u WHERE l > 0 UNION ALL SELECT NULL, 'header:{"min_ver":"0.0.0"}')"""


def _sums(where: str) -> str:
    """The checksum of some lines."""
    parts = " || ':' || ".join(f"sum(('0x' || substr(md5(line), {8 * i + 1}, 8))::BIGINT)" for i in range(4))
    return f"(SELECT md5(count(*) || ':' || {parts}) FROM lines WHERE {where})"


ORACLE_SQL = {
    "title_parse": f"""
WITH t AS (SELECT p_partkey, string_split(p_name || (['', ' [' || p_brand || ']', ' [v' || p_size || '] [' || p_brand || ']', ' [Final]'])[p_partkey % 4 + 1], '[') AS s FROM part),
v AS (SELECT p_partkey, s[1] AS title, len(s) AS n, trim(replace(s[2], ']', '')) AS b, trim(replace(s[3], ']', '')) AS c, {norm("s[2]")} IN {_VERSIONS} AS is_version FROM t),
r AS (SELECT p_partkey, title, CASE WHEN n = 3 OR (n = 2 AND is_version) THEN b END AS version, CASE WHEN n = 3 THEN c WHEN n = 2 AND NOT is_version THEN b END AS creator FROM v)
SELECT *, {norm("title")} AS short_name, {norm("title")} || '_' || upper(coalesce(creator, '')) AS id_name, {norm("title")} || '_' || upper(replace(coalesce(creator, ''), ' ', '')) AS feed_id_name FROM r""",
    "compact_counts": """
WITH w AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS w, o_totalprice FROM orders),
s AS (SELECT *, ([w::VARCHAR, (w // 1000)::VARCHAR || ',' || lpad((w % 1000)::VARCHAR, 3, '0'), w::VARCHAR || 'K', substr(w::VARCHAR, 1, 1) || '.' || substr(w::VARCHAR, 2, 2) || 'm', 'none'])[o_orderkey % 5 + 1] AS shape FROM w)
SELECT o_orderkey, shape, CASE o_orderkey % 5 WHEN 0 THEN w WHEN 1 THEN w WHEN 2 THEN w * 1000 WHEN 3 THEN round(replace(shape, 'm', '')::DECIMAL(18, 4) * 1000000)::BIGINT END AS n, o_totalprice AS rating FROM s""",
    "epoch_parse": """
SELECT o_orderkey, ([strftime(o_orderdate, '%Y-%-m-%-d'), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), strftime(o_orderdate, '%Y-%m-%d '), strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')])[o_orderkey % 5 + 1] AS shape,
CASE o_orderkey % 5 WHEN 0 THEN epoch(date_trunc('day', o_orderdate)) WHEN 1 THEN epoch(date_trunc('second', o_orderdate)) WHEN 4 THEN epoch(date_trunc('second', o_orderdate)) ELSE 0 END::BIGINT AS epoch FROM orders""",
    "url_scalars": r"""
SELECT page_id, regexp_replace(regexp_extract(url, '[^.]*$'), '[^\p{L}\p{N}]+', '', 'g') AS thread_id, replace(replace(url, '/en/', '/preview/'), 'preview', 'attachments') AS media,
replace(url, '/', '') AS shown, regexp_replace(replace(url, '/', ': '), '[^\p{L}\p{N}_]\s', '', 'g') AS app, coalesce(try_cast(regexp_extract(url, '([0-9]+)', 1) AS INTEGER), 0) AS pages,
starts_with(url, 'https')::INTEGER AS secure, len(string_split(url, '/'))::INTEGER AS parts FROM pages""",
    "browse_page": f"WITH {_CUSTOMERS}, {_ORDERS} SELECT title, creator, catalog_id, thread_id, tags, stamp FROM cu JOIN o USING (catalog_id) ORDER BY title, thread_id LIMIT 25 OFFSET 50",
    "browse_ranks": f"WITH {_CUSTOMERS}, {_ORDERS} SELECT title, thread_id, row_number() OVER (ORDER BY title, thread_id) - 1 AS rank FROM cu JOIN o USING (catalog_id)",
    "page_total": "SELECT count(*) AS rows, ceil(count(*) / 25)::BIGINT AS pages, 2::BIGINT AS page FROM orders",
    "catalog_stats": f"WITH {_ORDERS} SELECT count(tags) AS titles, max(stamp) AS last_update FROM o",
    "lookup_nested": f"""WITH {_CUSTOMERS}, {_ORDERS} SELECT cu.catalog_id, title, count(thread_id) AS n, coalesce(string_agg(thread_id::VARCHAR, ',' ORDER BY thread_id), '') AS thread_ids
FROM cu LEFT JOIN o USING (catalog_id) WHERE creator = 'BUILDING' GROUP BY 1, 2""",
    "lookup_first": f"WITH {_CUSTOMERS}, {_ORDERS} SELECT cu.catalog_id, title, count(thread_id) AS n FROM cu LEFT JOIN o USING (catalog_id) WHERE cu.catalog_id = (SELECT min(catalog_id) FROM cu WHERE creator = 'MACHINERY') GROUP BY 1, 2",
    "lookup_all": f"WITH {_CUSTOMERS}, {_ORDERS} SELECT thread_id, title, split_part(tags, ',', 1) AS tag_1, split_part(tags, ',', 2) AS tag_2 FROM cu JOIN o USING (catalog_id) WHERE creator = 'BUILDING'",
    "detail_unpivot": f"""WITH {_CUSTOMERS}, c AS (SELECT * FROM cu WHERE catalog_id = 7)
SELECT 'catalog_id' AS field, catalog_id::VARCHAR AS value FROM c UNION ALL SELECT 'title', replace(title, '''', '') FROM c UNION ALL SELECT 'creator', creator FROM c
UNION ALL SELECT 'rating', CASE WHEN rating = 0 THEN '' ELSE rating::VARCHAR END FROM c""",
    "response_json": f"""WITH {_CUSTOMERS}, {_ORDERS}, g AS (SELECT string_agg('{{"catalog_id":' || catalog_id || ',"title":"' || title || '","creator":"' || creator || '"}}', ',') AS g FROM cu WHERE title = 'Customer#000000007')
SELECT '{{"games":[' || coalesce(g, '') || '],"status":"' || CASE WHEN g IS NULL THEN 'not found' ELSE 'ok' END || '","titles":' || (SELECT count(tags) FROM o) || ',"last_update":' || (SELECT max(stamp) FROM o) || '}}' AS body FROM g""",
    "upsert_merge": f"WITH {_HALVES} SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type IS NOT NULL) AS event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value FROM e GROUP BY user_id",
    "upsert_replace": f"WITH {_HALVES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e) SELECT user_id, event_type, value FROM r WHERE k = 1",
    "resolve_ids": "SELECT s_suppkey, 'NATION' || s_nationkey AS id_name, CASE WHEN n_nationkey IS NULL THEN 0 ELSE n_nationkey + 1 END::BIGINT AS catalog_id FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3",
    "assign_ids": f"""WITH n AS (SELECT DISTINCT {norm("c_name")} AS id_name FROM customer WHERE c_nationkey >= 10 EXCEPT SELECT {norm("c_name")} FROM customer WHERE c_nationkey < 10)
SELECT id_name, (SELECT coalesce(max(c_custkey), 0) FROM customer WHERE c_nationkey < 10) + row_number() OVER (ORDER BY id_name) AS catalog_id FROM n""",
    "unique_listing": f"WITH {_ORDERS} SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY stamp DESC, thread_id DESC) = 1 AND catalog_id > 0 AS kept FROM o",
    "maker_lookup": "SELECT s_suppkey, (s_nationkey + 5)::VARCHAR AS maker_id, coalesce(n_name, (s_nationkey + 5)::VARCHAR) AS creator FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey + 5",
    "changed_rows": f"WITH {_LISTING} SELECT * EXCLUDE changed FROM l WHERE changed",
    "prefix_until_stale": f"""WITH {_LISTING}, p AS (SELECT *, sum(CASE WHEN changed THEN 0 ELSE 1 END) OVER (PARTITION BY page_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM l WHERE category <> 'README')
SELECT * EXCLUDE (changed, k) FROM p WHERE k = 0""",
    "exclude_label": f"WITH {_LISTING} SELECT * EXCLUDE changed FROM l WHERE category <> 'README'",
    "details_join": "SELECT o_orderkey AS thread_id, '/c/' || o_custkey AS site_url, c_name AS overview FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0",
    "feed_explode": f"""WITH e AS (SELECT *, event_type || ' no. ' || (props->>'$.k') AS title FROM events)
SELECT user_id AS source_id, count(*) OVER (PARTITION BY user_id)::INTEGER AS total, event_id AS thread_id, title, {norm("title")} || '_BLUEFOX' AS id_name, user_id AS views,
'/attachments/' || event_id AS banner_url, '/threads/' || event_id AS site_url, 'a/attachments,b' AS screens FROM e""",
    "product_explode": """SELECT s_suppkey, 'RJ' || lpad(s_suppkey::VARCHAR, 6, '0') AS product_id, s_nationkey::VARCHAR AS maker_id, '/d' AS site_url, s_name AS title, 'x.jpg' AS banner_url, 'N/A' AS version,
'RPG' AS work_type, '2024-01-05' AS register_date FROM supplier WHERE s_suppkey % 10 <> 0""",
    "app_explode": "SELECT p_partkey::VARCHAR AS app_id, p_name || p_type AS name, p_brand AS developer, 2::BIGINT AS n_screens FROM part",
    "delta_export": """WITH u AS (SELECT user_id AS catalog_id, epoch(date_trunc('second', max(ts) FILTER (event_id % 4 > 0)))::BIGINT AS last_record_update, count(*) AS n FROM events GROUP BY user_id)
SELECT * FROM u WHERE last_record_update > 1706500000""",
    "snapshot_diff": """
WITH a AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS e, (count(*) FILTER (event_type = 'purchase'))::VARCHAR AS b FROM events WHERE ts < '2024-01-05' GROUP BY 1),
c AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS e, (count(*) FILTER (event_type = 'purchase'))::VARCHAR AS b FROM events WHERE ts < '2024-01-16' AND user_id >= 3 GROUP BY 1)
SELECT c.k AS catalog_id, 'added' AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM c ANTI JOIN a ON a.k = c.k
UNION ALL SELECT a.k, 'removed', NULL, NULL, NULL FROM a ANTI JOIN c ON a.k = c.k
UNION ALL SELECT a.k, 'changed', 'event_type', a.e, c.e FROM a JOIN c ON a.k = c.k WHERE a.e IS DISTINCT FROM c.e
UNION ALL SELECT a.k, 'changed', 'n_bought', a.b, c.b FROM a JOIN c ON a.k = c.k WHERE a.b IS DISTINCT FROM c.b""",
    "list_packages": """WITH d AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS date, md5(count(*)::VARCHAR) AS md5 FROM events GROUP BY 1)
SELECT date, 'daily' AS name, md5, '{"date":' || date || ',"name":"daily","md5":"' || md5 || '"}' AS body FROM d ORDER BY date DESC""",
    "union_sources": """WITH u AS (SELECT 'forum' AS source, c_name AS title, c_mktsegment AS genre, NULL::INTEGER AS maker, c_custkey AS thread_id FROM customer UNION ALL SELECT 'store', s_name, NULL, s_nationkey, s_suppkey FROM supplier)
SELECT source, title, genre, maker, 1700000000::BIGINT AS last_record_update, count(*) OVER (PARTITION BY source) AS n, max(thread_id) OVER (PARTITION BY source) AS top FROM u""",
    "page_links": f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
SELECT page_id, pos, {_UNESCAPE.format("href")} AS href, {_UNESCAPE.format("t")} AS text FROM (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS t FROM l)""",
    "page_labels": f"""SELECT page_id, {_UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS title, len(regexp_extract_all(html, '<b>'))::BIGINT AS n_bold,
array_to_string(list_filter(list_transform(regexp_extract_all(html, '<a href="([^"]*)">', 1), lambda h: replace(h, '/the', '/attachments/the')), lambda h: contains(h, 'attachments')), ',') AS attachments FROM pages""",
    "contract_violations": """
SELECT 'lineitem' AS "table", 'unique' AS rule, 'l_orderkey,l_linenumber' AS "column", l_orderkey || '|' || l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'lineitem', 'reference', 'l_orderkey', l_orderkey::VARCHAR, count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey
UNION ALL SELECT 'orders', 'unique', 'o_custkey', o_custkey::VARCHAR, count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'orders', 'reference', 'o_custkey', o_custkey::VARCHAR, count(*) FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey GROUP BY o_custkey
UNION ALL SELECT 'orders', 'max_bytes', 'o_orderpriority', strlen(o_orderpriority)::VARCHAR, count(*) FROM orders WHERE strlen(o_orderpriority) > 8 GROUP BY strlen(o_orderpriority)""",
    "frontier": """
SELECT 'page' AS kind, p::VARCHAR AS key, '/latest/' || CASE WHEN p > 1 THEN 'page-' || p ELSE '' END || '?order=post_date&direction=desc' AS url FROM (SELECT unnest(range(1, (count(*) + 19) // 20 + 1)) AS p FROM orders)
UNION ALL SELECT 'product', 'RJ' || lpad(p::VARCHAR, 6, '0'), '/info?id=RJ' || lpad(p::VARCHAR, 6, '0') FROM (SELECT unnest(range(0, max(p_partkey) + 1)) AS p FROM part)
UNION ALL SELECT 'maker', s || ':' || h, '/m/' || s || '/by-letter/' || h FROM (SELECT DISTINCT c_mktsegment AS s FROM customer),
(SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZあいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん', '')) AS h) WHERE h <> ''""",
    "layout_plan": f"WITH {_LAYOUTS} SELECT 'g' || p_partkey AS folder, 'g' || p_partkey || '\\' || item AS path, kind, conflict FROM part JOIN rows_ ON engine = p_brand",
    "asset_plan": """
WITH a AS (SELECT p_partkey::VARCHAR AS app_id, '/games/' || p_brand || '/' || p_name || p_type || '/' || p_partkey AS folder, p_name FROM part)
SELECT app_id, '/s' || i || '/' || p_name AS url, folder || '/previews/' || i || '.jpg' AS path FROM a, (VALUES (0), (1)) t(i)
UNION ALL SELECT app_id, 'https://img.example/' || app_id || '/' || r, folder || '/' || l FROM a, (VALUES ('header.jpg', 'banner.jpg'), ('library_600x900.jpg', 'cover.jpg'), ('library_hero.jpg', 'banner_w.jpg'), ('logo.png', 'logo.jpg')) t(r, l)""",
    "nested_drop": """
SELECT event_id, 'first' AS "outer", event_type AS "inner", value FROM events WHERE event_type <> 'click'
UNION ALL SELECT event_id, 'first', 'k', (props->>'$.k')::DOUBLE FROM events UNION ALL SELECT event_id, 'second', 'z', 2.0 FROM events""",
    "listing_items": f"""WITH {_ITEMS}
SELECT page_no, pos, category, engine, status, title, version, creator, site_url, stamp AS thread_publish_date, stamp AS last_thread_comment, replies, views, rating, thread_id, short_name, id_name FROM items WHERE good""",
    "listing_rejects": f"WITH {_ITEMS} SELECT page_no, pos FROM items WHERE NOT good",
    "detail_fields": """
SELECT '/threads/c.' || c_custkey || '/' AS site_url, g AS has_post,
CASE WHEN g THEN CASE WHEN c_custkey % 5 = 0 THEN 'Second ' || c_custkey ELSE 'Tale of ' || c_name || '.' END END AS overview, CASE WHEN g THEN c_mktsegment || ',n' || c_nationkey END AS tags,
CASE WHEN g THEN '/attachments/' || c_custkey END AS screens, CASE WHEN g THEN '1' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') END AS likes, CASE WHEN g THEN '/' || c_custkey || '.jpg' END AS banner_url,
CASE WHEN g THEN epoch(make_date(2023, 1, (c_custkey % 28 + 1)::INTEGER))::BIGINT END AS release_date, CASE WHEN g THEN 'No' END AS censored, CASE WHEN g THEN 'Win' END AS os, CASE WHEN g THEN c_mktsegment END AS language,
CASE WHEN g THEN '' END AS translations, CASE WHEN g THEN '' END AS length, CASE WHEN g THEN '' END AS voice, CASE WHEN g THEN 'v' || c_custkey END AS vndb
FROM (SELECT *, c_custkey % 7 <> 0 AS g FROM customer)""",
    "page_fields": "SELECT '/threads/c.' || c_custkey || '/' AS url, CASE WHEN c_custkey % 7 <> 0 THEN 'Win' END AS os, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS language FROM customer",
    "maker_pages": "SELECT 'RG' || s_suppkey AS maker_id, s_name AS name, '/u/' || s_suppkey AS url, '/i/' || s_suppkey || '.jpg' AS img FROM supplier WHERE s_suppkey % 6 <> 0",
    "crawl_read": "SELECT page_id::INTEGER AS page_no, url, 200 AS status, len(html)::BIGINT AS n_chars FROM pages WHERE page_id % 2 = 0 AND page_id % 5 <> 0",
    "package_rows": """WITH u AS (SELECT user_id AS catalog_id, epoch(date_trunc('second', max(ts) FILTER (event_id % 4 > 0)))::BIGINT AS last_record_update, count(*) AS n FROM events GROUP BY user_id)
SELECT *, 'base,daily' AS packages, '0.0.0' AS min_ver, 2 AS n_checksums FROM u WHERE last_record_update > 1706500000""",
    "backup_rows": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderstatus, o_custkey, '20240105' AS day FROM orders",
    "response_numbers": """
SELECT n_nationkey AS asked, '{"games":[{"catalog_id":' || n_nationkey || ',"rating":' || (['"' || n_name || '"', n_nationkey || '.5', n_nationkey::VARCHAR])[n_nationkey - 3] || '}],"status":"ok","titles":'
|| (SELECT count(*) FROM nation) || ',"last_update":' || (SELECT max(n_regionkey) FROM nation) || '}' AS body FROM nation WHERE n_nationkey BETWEEN 4 AND 6""",
    "feed_merge": f"""WITH g AS (SELECT event_type || ' no. ' || (props->>'$.k') AS title, event_id, user_id FROM events),
m AS (SELECT {norm("title")} || '_BLUEFOX' AS id_name, arg_max(title, event_id) AS title, max(event_id) AS thread_id, arg_max(user_id, event_id) AS views FROM g GROUP BY 1)
SELECT row_number() OVER (ORDER BY id_name) AS catalog_id, id_name, title, 'v1' AS version, 'Blue Fox' AS creator, thread_id, views, '/threads/' || thread_id AS site_url, 1700000000::BIGINT AS last_record_update FROM m""",
    "crawl_merge": f"""WITH {_ITEMS}
SELECT row_number() OVER (ORDER BY id_name) AS catalog_id, id_name, title, CASE WHEN thread_id % 2 = 0 THEN 'by clerk ' || replies END AS overview, CASE WHEN thread_id % 2 = 0 THEN 'Win' END AS os, thread_id, views, stamp AS last_thread_comment
FROM items WHERE good AND category <> 'README'""",
    "stream_ingest": """SELECT event_id % 500 AS thread_id, max(epoch(date_trunc('second', ts)))::BIGINT AS last_thread_comment, arg_max(event_type, (date_trunc('second', ts), event_id)) AS title FROM events GROUP BY 1""",
    "stream_writers": "SELECT event_id % 500 AS thread_id, max(epoch(date_trunc('second', ts)))::BIGINT AS last_thread_comment, 't' || max(epoch(date_trunc('second', ts)))::BIGINT AS title FROM events GROUP BY 1",
    "two_key_merge": f"""WITH {_TWO}
SELECT CASE kind WHEN 0 THEN k + 10000000 ELSE k END AS thread_id, CASE WHEN kind = 3 THEN k + 5000000 WHEN kind = 2 AND k = top THEN k + 1000001 ELSE k + 1000000 END AS catalog_id,
CASE kind WHEN 1 THEN 'new ' || name ELSE name END AS banner_url, CASE WHEN kind IN (0, 1, 3) OR kind = 2 AND k = top THEN k ELSE nation END AS views FROM k, s
UNION ALL SELECT CASE WHEN k % 10 = 4 THEN k + 40000000 ELSE k + 20000000 END, k + 20000000, CASE WHEN k % 10 = 4 THEN 'again' END, k FROM k WHERE kind = 4
UNION ALL SELECT k + 30000000, k + 1000000, NULL, -k FROM k WHERE k % 10 = 3""",
    "two_key_rejects": f"""WITH {_TWO} SELECT k AS thread_id, k + 1000001 AS catalog_id, k AS views, 'keys of two rows' AS reason FROM k, s WHERE kind = 2 AND k < top
UNION ALL SELECT k + 50000000, 0, k, 'no key' FROM k WHERE k % 50 = 0""",
    "assign_ids_durable": f"""WITH n AS (SELECT DISTINCT {norm("c_name")} || 'B' AS id_name FROM customer)
SELECT id_name, (SELECT coalesce(max(c_custkey), 0) FROM customer) + row_number() OVER (ORDER BY id_name) AS catalog_id FROM n""",
    "manifest_sums": f"""WITH {_LINES} SELECT 100::BIGINT AS date, 'base' AS name, {_sums("l > 0 OR l IS NULL")} AS md5, 2 AS version UNION ALL SELECT 200, 'daily', {_sums("l > 1706500000 OR l IS NULL")}, 2""",
    "feed_rejects": """WITH e AS (SELECT event_id, event_id % 6 AS kind FROM events)
SELECT event_id, NULL AS reason, 0 AS pos, event_id AS thread_id, NULL::BIGINT AS views FROM e WHERE kind IN (0, 4)
UNION ALL SELECT event_id, CASE kind WHEN 1 THEN 'broken' WHEN 2 THEN 'no list' WHEN 3 THEN 'no thread' WHEN 4 THEN 'unread fields' ELSE 'no body' END, CASE WHEN kind = 3 THEN 0 END, NULL, NULL FROM e WHERE kind IN (1, 2, 3, 4, 5)""",
    "browse_deep": f"""WITH {_CUSTOMERS}, {_ORDERS}, r AS (SELECT title, creator, catalog_id, thread_id, tags, stamp, row_number() OVER (ORDER BY title, thread_id) - 1 AS rank, count(*) OVER () AS n FROM cu JOIN o USING (catalog_id))
SELECT * EXCLUDE n FROM r WHERE rank >= n // 50 * 25 AND rank < n // 50 * 25 + 25 ORDER BY rank""",
    "browse_after": f"""WITH {_CUSTOMERS}, {_ORDERS}, r AS (SELECT title, creator, catalog_id, thread_id, tags, stamp, row_number() OVER (ORDER BY title, thread_id) - 1 AS rank FROM cu JOIN o USING (catalog_id))
SELECT * FROM r WHERE rank BETWEEN 50 AND 74 ORDER BY rank""",
}
#: The same results by another way.
ORACLE_SQL |= {"stored_upsert": ORACLE_SQL["upsert_merge"], "stored_changes": ORACLE_SQL["changed_rows"], "snapshot_ranges": ORACLE_SQL["snapshot_diff"], "delta_ranges": ORACLE_SQL["delta_export"]}
