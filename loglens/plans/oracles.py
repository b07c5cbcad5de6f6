"""DuckDB twins of the registered queries (the correctness oracle).

Each statement restates the *expected result* over the driver's tables: the same
stand-in views as plain SQL, then the report. Parsers are checked against the
rows they should give back, never by re-implementing the tokeniser in SQL.
Sums are cast to BIGINT (DuckDB widens them); rounding uses explicit formulas
(numpy-style ``round_even(x*10^d, 0)/10^d``; half-up ``floor(x*100+0.5)/100``).
"""
from __future__ import annotations

# Fixed values, stated here again so that a wrong one in the library shows: the four
# detector patterns in order, the two address patterns, the seed registry.
DETECTORS = [
    ("keyword", r"drop|delete|truncate|update|insert|select|declare|union|create|concat", "sqli"),
    ("meta", r"((\%3D)|(=))[^\n]*((\%27)|(\')|(\-\-)|(\%3B)|(;))|\w*((\%27)|(\'))((\%6F)|o|(\%4F))((\%72)|r|(\%52))", "sqli"),
    ("exec", r"exec(\s|\+)+(s|x)p\w+", "sqli"),
    ("xss", r"((\%3C)|<)((\%2F)|\/)*[a-z0-9\%]+((\%3E)|>)|((\%3C)|<)((\%69)|i|(\%49))((\%6D)|m|(\%4D))((\%67)|g|(\%47))[^\n]+((\%3E)|>)", "xss"),
]
IP_PREFIX_PATTERN = r"^\b(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
STRICT_IP_PATTERN = r"^([1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}$"
SEED_COLLECTIONS = [(1, "incident", "Example incident"), (2, "empty", "No sources")]
SEED_DATASOURCES = [(1, 1, "bc", "bluecoat", ""), (2, 1, "sq", "squid", ""), (3, 1, "www", "apache", ""),
                    (4, 1, "iis", "iis", ""), (5, 1, "iiss", "iis-short", "")]

# Parameters of the queries under test.
REPORT_IP_PROXY, REPORT_IP_WEB = "203.0.113.3", "198.51.0.7"
SEARCH_WORD, SEARCH_WORD_WEB = "purchase", "/en/1"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


PROXY = """proxy_data AS (
SELECT event_id AS id,
  concat('10.', CAST(user_id % 3 AS VARCHAR), '.', CAST(CAST(floor(user_id / 250) AS BIGINT) AS VARCHAR), '.', CAST(user_id % 250 AS VARCHAR)) AS clientip,
  CASE WHEN event_id % 97 = 0 THEN concat('rare', CAST(event_id AS VARCHAR), '.example.net')
       WHEN event_type = 'error' THEN concat('203.0.113.', CAST(user_id % 7 AS VARCHAR))
       ELSE concat(event_type, '.example.com') END AS destip,
  CAST(CASE WHEN user_id % 5 = 0
       THEN 1704067200 + 1000 * row_number() OVER (PARTITION BY user_id, event_type, event_id % 97 = 0 ORDER BY event_id)
       ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS BIGINT) AS time,
  CAST(floor(value * 100) AS BIGINT) AS bytesIn,
  CAST(CASE WHEN user_id % 2 = 0 THEN event_id % 5000 ELSE 0 END AS BIGINT) AS bytesOut,
  CAST(CASE WHEN user_id % 2 = 0 THEN abs(CAST(floor(value * 100) AS BIGINT) - event_id % 5000)
       ELSE CAST(floor(value * 100) AS BIGINT) END AS BIGINT) AS bytesDiff,
  CASE WHEN user_id % 2 = 1 THEN ''
       WHEN CAST(floor(value * 100) AS BIGINT) > event_id % 5000 THEN 'in'
       WHEN CAST(floor(value * 100) AS BIGINT) < event_id % 5000 THEN 'out'
       ELSE 'unknown' END AS direction,
  CAST(CASE WHEN event_type IN ('view', 'error') THEN 1 ELSE 0 END AS INTEGER) AS contentType,
  concat('/', event_type, '/', CAST(event_id % 40 AS VARCHAR)) AS page,
  CAST(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS datasource_id
FROM events)"""

WEB = """web_data AS (
SELECT e.event_id AS id,
  concat('198.51.', CAST(CAST(floor(e.user_id / 250) AS BIGINT) AS VARCHAR), '.', CAST(e.user_id % 250 AS VARCHAR)) AS clientip,
  CAST(floor(epoch(e.ts)) AS BIGINT) AS time,
  CAST(e.event_id % 700 AS BIGINT) AS bytesIn,
  CAST(floor(e.value * 100) AS BIGINT) AS bytesOut,
  regexp_extract(p.url, '^[a-z]+://[^/]+([^?#]*)', 1) AS page,
  CASE e.event_id % 50
    WHEN 0 THEN 'id=1'' or ''1''=''1'
    WHEN 1 THEN 'q=<script>x'
    WHEN 2 THEN 'cmd=exec xp_cmdshell'
    WHEN 3 THEN 'id=1 union select a'
    ELSE regexp_extract(p.url, '[?]([^#]*)', 1) END AS query,
  CAST(3 + e.user_id % 3 AS INTEGER) AS datasource_id
FROM events e
CROSS JOIN (SELECT count(*) AS n FROM pages) c
JOIN pages p ON e.event_id % c.n = p.page_id)"""

REGISTRY = (f"collections_t AS (SELECT * FROM (VALUES {_values(SEED_COLLECTIONS)}) t(id, name, description)),\n"
            f"datasources_t AS (SELECT * FROM (VALUES {_values(SEED_DATASOURCES)}) t(id, collection_id, name, type, description))")

HOST_NAMES = """host_names AS (
SELECT concat('198.51.', CAST(CAST(floor(c_custkey / 250) AS BIGINT) AS VARCHAR), '.', CAST(c_custkey % 250 AS VARCHAR)) AS address,
       concat(lower(replace(c_name, '#', '-')), '.example.org') AS name FROM customer)"""

GEO = f"""geo_blocks AS (
SELECT CAST({(198 << 24) + (51 << 16)} + (c_custkey - 1) * 64 AS BIGINT) AS start_ip,
       CAST({(198 << 24) + (51 << 16)} + (c_custkey - 1) * 64 + 16 + (c_custkey % 4) * 16 - 1 AS BIGINT) AS end_ip,
       CAST((c_acctbal % 180) - 90 AS DOUBLE) AS latitude, CAST((c_custkey % 360) - 180 AS DOUBLE) AS longitude,
       n_name AS country, r_name AS region, c_mktsegment AS city
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT CAST({203 << 24} + CAST(r_regionkey AS BIGINT) * {16 << 16} AS BIGINT),
       CAST({203 << 24} + CAST(r_regionkey AS BIGINT) * {16 << 16} + {(16 << 16) - 1} AS BIGINT),
       CAST(r_regionkey * 10 AS DOUBLE), CAST(r_regionkey * -10 AS DOUBLE), r_name, r_name, 'any' FROM region)"""

NESTED = f"""nested_blocks AS (SELECT * FROM geo_blocks
UNION ALL SELECT CAST({(198 << 24) + (51 << 16)} + n_nationkey * 1500 AS BIGINT), CAST({(198 << 24) + (51 << 16)} + n_nationkey * 1500 + 2047 AS BIGINT),
  CAST(n_nationkey AS DOUBLE), CAST(-n_nationkey AS DOUBLE), n_name, 'nation', NULL FROM nation
UNION ALL SELECT CAST({(198 << 24) + (51 << 16)} + r_regionkey * 32768 AS BIGINT), CAST({(198 << 24) + (51 << 16)} + r_regionkey * 32768 + 32767 AS BIGINT),
  CAST(r_regionkey AS DOUBLE), CAST(-r_regionkey AS DOUBLE), r_name, 'half', NULL FROM region
UNION ALL SELECT CAST({198 << 24} AS BIGINT), CAST({(199 << 24) - 1} AS BIGINT),
  CAST(r_regionkey AS DOUBLE), CAST(-r_regionkey AS DOUBLE), r_name, 'whole', NULL FROM region)"""

IPNUM = ("CASE WHEN regexp_matches(trim({a}), '" + STRICT_IP_PATTERN + "') THEN "
         "CAST(split_part(trim({a}), '.', 1) AS BIGINT) * 16777216 + CAST(split_part(trim({a}), '.', 2) AS BIGINT) * 65536 "
         "+ CAST(split_part(trim({a}), '.', 3) AS BIGINT) * 256 + CAST(split_part(trim({a}), '.', 4) AS BIGINT) END")

XSS = "xss AS (" + "\nUNION ALL\n".join(
    f"SELECT clientip, query, '{kind}' AS xsstype, '{name}' AS detector, datasource_id FROM web_data "
    f"WHERE query <> '' AND regexp_matches(query, {_q('(?i)' + pattern)})"
    for name, pattern, kind in DETECTORS) + ")"

PAIR_RAW = """gaps AS (
SELECT datasource_id, clientip, destip, contentType, bytesDiff,
       time - lag(time) OVER (PARTITION BY datasource_id, clientip, destip ORDER BY time, id) AS gap
FROM proxy_data),
pairs AS (
SELECT datasource_id, clientip, destip, count(*) AS n, CAST(sum(contentType) AS BIGINT) AS content_sum,
       CAST(sum(bytesDiff) AS BIGINT) AS bytes_sum, avg(gap) AS m, stddev_pop(gap) AS sd
FROM gaps GROUP BY datasource_id, clientip, destip)"""

BEACON = PAIR_RAW + f""",
dest_counts AS (SELECT datasource_id, destip, count(*) AS dest_count FROM proxy_data GROUP BY datasource_id, destip),
rounded AS (
SELECT pairs.*, dest_counts.dest_count, d.type, round_even(m * 100, 0) / 100 AS mean, round_even(sd * 1000, 0) / 1000 AS stdDev
FROM pairs JOIN dest_counts USING (datasource_id, destip) JOIN datasources_t d ON d.id = pairs.datasource_id),
scored AS (
SELECT *, (CASE WHEN dest_count >= 5 THEN 0 ELSE 1 END
  + CASE WHEN content_sum / n * 100 > 50 THEN 1 ELSE 0 END
  + CASE WHEN bytes_sum / n * 100 > (CASE WHEN type = 'bluecoat' THEN 500 ELSE 5000 END) THEN 1 ELSE 0 END
  + CASE WHEN mean > 900 THEN 1 ELSE 0 END
  + CASE WHEN stdDev < 0.5 THEN 2 WHEN stdDev < 1 THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(destip, '{IP_PREFIX_PATTERN}') THEN 2 ELSE 0 END
  + CASE WHEN n <= 3 THEN -3 ELSE 0 END) AS raw
FROM rounded WHERE mean > 0),
beacons AS (
SELECT clientip, destip, mean, stdDev, n AS count, greatest(raw, 0) AS beaconScore, raw AS raw_score, datasource_id FROM scored)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _top(source: str, key: str, measure: str, k: int, alias: str, where: str = "") -> str:
    return (f"SELECT datasource_id, {key}, {alias} FROM (SELECT datasource_id, {key}, CAST({measure} AS BIGINT) AS {alias}, "
            f"row_number() OVER (PARTITION BY datasource_id ORDER BY {measure} DESC, {key}) AS rn "
            f"FROM {source} {where} GROUP BY datasource_id, {key}) WHERE rn <= {k}")


def _labelled(label: str, source: str, key: str, measure: str, k: int) -> str:
    return (f"SELECT '{label}' AS report, datasource_id, {key} AS item, value FROM ("
            + _top(source, key, measure, k, "value") + ")")


PROXY_COLS = "datasource_id, clientip, destip, time, bytesIn, bytesOut, bytesDiff, direction, contentType, page"
WEB_COLS = "datasource_id, clientip, time, bytesIn, bytesOut, page, query"

IIS_Q = "CASE WHEN query = '' THEN '-' ELSE replace(query, ' ', '+') END"
ODD_QUOTES = f"(length({IIS_Q}) - length(replace({IIS_Q}, '''', ''))) % 2 = 1"
APACHE_EXPECTED = ("SELECT datasource_id, clientip, time, CAST(0 AS BIGINT) AS bytesIn, greatest(bytesOut, 0) AS bytesOut, "
                   "page, query FROM web_data WHERE id % 23 <> 0")
IIS_EXPECTED = (f"SELECT datasource_id, clientip, time, greatest(bytesIn, 0) AS bytesIn, greatest(bytesOut, 0) AS bytesOut, "
                f"page, replace({IIS_Q}, '''', '') AS query FROM web_data WHERE id % 23 <> 0 AND NOT ({ODD_QUOTES})")
IIS_SHORT_EXPECTED = (f"SELECT datasource_id, clientip, time, CAST(0 AS BIGINT) AS bytesIn, CAST(0 AS BIGINT) AS bytesOut, "
                      f"page, replace({IIS_Q}, '''', '') AS query FROM web_data WHERE id % 23 <> 0 AND NOT ({ODD_QUOTES})")


def _share(part: str, total: str) -> str:
    return (f"CASE WHEN coalesce({part}, 0) = 0 THEN 0.0 ELSE coalesce(floor(CAST({part} AS DOUBLE) / "
            f"CAST(nullif({total}, 0) AS DOUBLE) * 100 * 100 + 0.5) / 100, 0.0) END")


def _hour(col: str, n: int = 13) -> str:
    fmt = "%Y-%m-%d %H" if n == 13 else "%Y-%m-%d %H:%M"
    return f"strftime(make_timestamp(CAST({col} AS BIGINT) * 1000000), '{fmt}')"


def _ip_hourly(source: str, cond: str) -> str:
    return (f"SELECT datasource_id, hour, bytes_in, bytes_out, bytes_total FROM (SELECT datasource_id, {_hour('time')} AS hour, "
            f"CAST(sum(bytesIn) AS BIGINT) AS bytes_in, CAST(sum(bytesOut) AS BIGINT) AS bytes_out, "
            f"CAST(sum(bytesOut) + sum(bytesIn) AS BIGINT) AS bytes_total, "
            f"row_number() OVER (PARTITION BY datasource_id ORDER BY {_hour('time')}) AS rn "
            f"FROM {source} WHERE {cond} GROUP BY datasource_id, {_hour('time')}) WHERE rn <= 25")


def _weeks() -> str:
    return """last_t AS (SELECT datasource_id, max(time) AS last_time FROM web_data GROUP BY datasource_id),
weeks AS (SELECT w.datasource_id, l.last_time, w.time, w.page,
  CASE WHEN w.time < l.last_time AND w.time > l.last_time - 604800 THEN 'current'
       WHEN w.time < l.last_time - 604800 AND w.time > l.last_time - 1209600 THEN 'previous' END AS week
  FROM web_data w JOIN last_t l USING (datasource_id))"""


def _page_search(source: str, cond: str, count_col: str) -> str:
    return (f"SELECT datasource_id, clientip, count({count_col}) AS pageCount, {_hour('min(time)', 16)} AS first_seen, "
            f"{_hour('max(time)', 16)} AS last_seen, CAST(sum(bytesIn + bytesOut) AS BIGINT) AS bytes "
            f"FROM {source} WHERE {cond} GROUP BY datasource_id, clientip")


def _map_feed(source: str, key: str, k: int) -> str:
    private = (f"{key} <> '0.0.0.0' AND NOT starts_with({key}, '192.168.1.') AND NOT starts_with({key}, '10.') "
               f"AND NOT starts_with({key}, '172.16.')")
    top = _top(source, key, f"sum(bytesIn + bytesOut)", k, "totalBytes", f"WHERE {private}")
    return (f"SELECT t.datasource_id, t.{key} AS address, t.totalBytes, g.latitude, g.longitude, g.country, g.region, g.city "
            f"FROM ({top}) t JOIN geo_blocks g ON {IPNUM.replace('{a}', 't.' + key)} BETWEEN g.start_ip AND g.end_ip")


def oracle_sql() -> dict[str, str]:
    P, W = _with(PROXY), _with(WEB)
    PR = _with(PROXY, REGISTRY)
    out: dict[str, str] = {}
    proxy_all = f"SELECT {PROXY_COLS} FROM proxy_data"
    out["s1_text_scan_proxy"] = P + proxy_all
    out["s4_parse_squid"] = P + ("SELECT datasource_id, clientip, destip, time, greatest(bytesIn, 0) AS bytesIn, "
                                 "CAST(0 AS BIGINT) AS bytesOut, abs(bytesIn) AS bytesDiff, '' AS direction, contentType, page FROM proxy_data")
    out["s5_parse_bluecoat_a"] = P + ("SELECT datasource_id, clientip, destip, time, greatest(bytesIn, 0) AS bytesIn, "
                                      "greatest(bytesOut, 0) AS bytesOut, abs(bytesIn - bytesOut) AS bytesDiff, "
                                      "CASE WHEN bytesIn > bytesOut THEN 'in' WHEN bytesIn < bytesOut THEN 'out' ELSE 'unknown' END AS direction, "
                                      "contentType, page FROM proxy_data")
    out["s6_parse_bluecoat_b"] = P + ("SELECT datasource_id, clientip, destip, time, greatest(bytesIn, 0) AS bytesIn, "
                                      "CAST(0 AS BIGINT) AS bytesOut, CAST(0 AS BIGINT) AS bytesDiff, '' AS direction, "
                                      "contentType, page FROM proxy_data")
    out["s7_parse_apache"] = W + APACHE_EXPECTED
    out["s8_parse_iis"] = W + IIS_EXPECTED
    out["s9_parse_iis_short"] = W + IIS_SHORT_EXPECTED
    out["s10_dispatch_web"] = W + (f"SELECT * FROM ({APACHE_EXPECTED}) WHERE datasource_id = 3 UNION ALL "
                                   f"SELECT * FROM ({IIS_EXPECTED}) WHERE datasource_id = 4 UNION ALL "
                                   f"SELECT * FROM ({IIS_SHORT_EXPECTED}) WHERE datasource_id = 5")
    out["s11_reject_counts"] = _with(PROXY, WEB) + (
        f"SELECT kind, datasource_id, reason, count(*) AS lines FROM (SELECT 'web' AS kind, datasource_id, CASE "
        f"WHEN id % 31 = 1 THEN 'unbalanced_quote' WHEN id % 31 = 2 THEN 'not_digit_first' "
        f"WHEN id % 31 = 3 AND datasource_id = 3 THEN 'unbalanced_quote' WHEN id % 31 = 3 THEN 'unparsed' "
        f"WHEN datasource_id IN (4, 5) AND {ODD_QUOTES} THEN 'unbalanced_quote' "
        f"WHEN id % 23 = 0 THEN 'status_404' END AS reason FROM web_data UNION ALL "
        f"SELECT 'proxy', datasource_id, CASE id % 31 WHEN 1 THEN 'unbalanced_quote' WHEN 2 THEN 'not_digit_first' "
        f"WHEN 3 THEN 'unparsed' END FROM proxy_data) WHERE reason IS NOT NULL GROUP BY kind, datasource_id, reason")
    attack = "list_value('id=1', 'id=1''--', 'id=1''or''1''=''1', 'q=''<script>x', 'id=1'';drop')[event_id % 5 + 1]"
    out["s11_reject_indicators"] = (
        f"WITH lines AS (SELECT concat('2023-11-14 22:13:20 192.0.2.1 GET /p v=1 ', {attack}, ' 80 198.51.0.', CAST(event_id % 200 AS VARCHAR), ' UA - 200 0 0') AS line FROM events), "
        "marked AS (SELECT line, (length(line) - length(replace(line, '''', ''))) % 2 = 1 AS odd FROM lines) "
        + " UNION ALL ".join(f"SELECT CAST(5 AS INTEGER) AS datasource_id, 'unbalanced_quote' AS reason, '{kind}' AS xsstype, '{name}' AS detector, count(*) AS lines "
                             f"FROM marked WHERE odd AND regexp_matches(line, {_q('(?i)' + pattern)}) HAVING count(*) > 0" for name, pattern, kind in DETECTORS)
        + " UNION ALL SELECT CAST(5 AS INTEGER), 'stored', '', '', count(*) FROM marked WHERE NOT odd")
    # texts 5000000000, 20 digits, -7, junk, 12d, 0, 4294967296, 2^63 - 1, 1.5: integer or not, and its value
    numbers = ("nums(i, ok, v) AS (VALUES (0, true, CAST(5000000000 AS HUGEINT)), (1, true, 9223372036854775807), (2, true, -7), (3, false, 0), (4, false, 0), "
               "(5, true, 0), (6, true, 4294967296), (7, true, 9223372036854775807), (8, false, 0))")
    # lines that begin with 1700000000123, 1700000000, 1700000000d, 1700000000.9, -5.5, inf, 1e3, +12., 20 digits
    times = "times(i, t) AS (VALUES (0, 1700000000123), (1, 1700000000), (3, 1700000000), (6, 1000))"
    out["s4_numbers_proxy"] = _with(numbers, times) + (
        "SELECT datasource_id, time, bytesIn, bytesOut, bytesDiff, direction, count(*) AS lines FROM ("
        "SELECT CAST(2 AS INTEGER) AS datasource_id, CAST(t.t AS BIGINT) AS time, CAST(greatest(n.v, 0) AS BIGINT) AS bytesIn, CAST(0 AS BIGINT) AS bytesOut, "
        "CAST(abs(n.v) AS BIGINT) AS bytesDiff, '' AS direction FROM events e JOIN nums n ON n.i = e.event_id % 9 AND n.ok "
        "JOIN times t ON t.i = (e.event_id // 9) % 9 UNION ALL "
        "SELECT CAST(1 AS INTEGER), CAST(1700000000 AS BIGINT), CAST(greatest(n.v, 0) AS BIGINT), CAST(greatest(m.v, 0) AS BIGINT), "
        "CAST(least(abs(n.v - m.v), 9223372036854775807) AS BIGINT), CASE WHEN n.v > m.v THEN 'in' WHEN n.v < m.v THEN 'out' ELSE 'unknown' END "
        "FROM events e JOIN nums n ON n.i = e.event_id % 9 AND n.ok JOIN nums m ON m.i = (e.event_id // 9) % 9 AND m.ok) "
        "GROUP BY datasource_id, time, bytesIn, bytesOut, bytesDiff, direction")
    out["s7_numbers_web"] = _with(numbers) + (
        "SELECT CAST(3 AS INTEGER) AS datasource_id, CAST(1700000000 AS BIGINT) AS time, CAST(0 AS BIGINT) AS bytesIn, "
        "CAST(greatest(n.v, 0) AS BIGINT) AS bytesOut, count(*) AS lines FROM events e JOIN nums n ON n.i = e.event_id % 9 GROUP BY greatest(n.v, 0)")
    out["s12_partition_scan"] = P + f"SELECT id, {PROXY_COLS} FROM proxy_data WHERE datasource_id = 2"
    out["k1_create_tables"] = _with(PROXY, WEB) + (
        "SELECT 'proxy_data' AS table_name, count(*) AS rows FROM proxy_data UNION ALL "
        "SELECT 'web_data', count(*) FROM web_data UNION ALL SELECT 'beacon_data', CAST(0 AS BIGINT) "
        "UNION ALL SELECT 'xss_data', CAST(0 AS BIGINT)")
    out["k2_append_proxy"] = P + f"SELECT id, {PROXY_COLS} FROM proxy_data"
    out["k3_append_web"] = W + f"SELECT id, {WEB_COLS} FROM web_data"
    out["k4_replace_beacons"] = _with(PROXY, REGISTRY, BEACON) + "SELECT * FROM beacons"
    out["k5_replace_indicators"] = _with(WEB, XSS) + "SELECT * FROM xss"
    out["k6_registry_add"] = _with(
        PROXY, WEB, REGISTRY,
        "coll AS (SELECT * FROM collections_t UNION ALL SELECT 3, 'later', 'Added later')",
        "ds AS (SELECT * FROM datasources_t UNION ALL SELECT 6, 3, 'sq2', 'squid', '')",
        "cnt AS (SELECT datasource_id, count(*) AS rows FROM (SELECT datasource_id FROM proxy_data UNION ALL "
        "SELECT datasource_id FROM web_data) GROUP BY datasource_id)") + (
        "SELECT ds.id AS datasource_id, ds.name AS datasource_name, ds.type, c.name AS collection_name, "
        "ds.collection_id, coalesce(cnt.rows, 0) AS rows FROM ds JOIN coll c ON c.id = ds.collection_id "
        "LEFT JOIN cnt ON cnt.datasource_id = ds.id")
    out["k6_registry_store"] = _with(
        PROXY, WEB, REGISTRY,
        "coll AS (SELECT * FROM collections_t UNION ALL SELECT 3, 'later', 'Added later' UNION ALL SELECT 4, 'more', '')",
        "ds AS (SELECT * FROM datasources_t UNION ALL SELECT 6, 3, 'sq2', 'squid', '' UNION ALL SELECT 7, 4, 'ap2', 'apache', '')",
        "cnt AS (SELECT datasource_id, count(*) AS rows FROM (SELECT datasource_id FROM proxy_data UNION ALL "
        "SELECT datasource_id FROM web_data) GROUP BY datasource_id)") + (
        "SELECT ds.id AS datasource_id, ds.name AS datasource_name, ds.type, c.name AS collection_name, "
        "ds.collection_id, coalesce(cnt.rows, 0) AS rows FROM ds JOIN coll c ON c.id = ds.collection_id "
        "LEFT JOIN cnt ON cnt.datasource_id = ds.id")
    out["k7_names_csv"] = _with(WEB, HOST_NAMES) + (
        "SELECT w.clientip AS key, coalesce(n.name, 'unresolvable') AS name FROM (SELECT DISTINCT clientip FROM web_data) w "
        "LEFT JOIN host_names n ON n.address = w.clientip")
    out["k8_beacon_projection"] = P + ("SELECT id, clientip, destip, time, bytesDiff, contentType, datasource_id "
                                       "FROM proxy_data WHERE datasource_id = 1")
    out["f4_ip_literal_dests"] = P + (
        f"SELECT datasource_id, destip, coalesce(regexp_matches(destip, '{IP_PREFIX_PATTERN}'), false) AS ip_prefix, "
        f"coalesce(regexp_matches(trim(destip), '{STRICT_IP_PATTERN}'), false) AS ip_strict "
        f"FROM (SELECT DISTINCT datasource_id, destip FROM proxy_data)")
    out["f7_public_addresses"] = _with(PROXY, WEB) + (
        "SELECT DISTINCT datasource_id, address FROM (SELECT datasource_id, destip AS address FROM proxy_data "
        "UNION ALL SELECT datasource_id, clientip FROM web_data) WHERE address <> '0.0.0.0' "
        "AND NOT starts_with(address, '192.168.1.') AND NOT starts_with(address, '10.') AND NOT starts_with(address, '172.16.')")
    out["f22_kilobytes_top_clients"] = W + (
        "SELECT datasource_id, clientip, floor(totalBytes / 1024 * 100 + 0.5) / 100 AS kB FROM ("
        + _top("web_data", "clientip", "sum(bytesOut) + sum(bytesIn)", 20, "totalBytes") + ")")
    out["j2_collections_nested"] = _with(
        PROXY, WEB, REGISTRY,
        "cnt AS (SELECT datasource_id, count(*) AS rows FROM (SELECT datasource_id FROM proxy_data UNION ALL "
        "SELECT datasource_id FROM web_data) GROUP BY datasource_id)") + (
        "SELECT c.id AS collection_id, c.name AS collection_name, count(d.id) AS sources, "
        "coalesce(string_agg(d.name, ',' ORDER BY d.id), '') AS source_names, CAST(coalesce(sum(cnt.rows), 0) AS BIGINT) AS rows "
        "FROM collections_t c LEFT JOIN datasources_t d ON d.collection_id = c.id LEFT JOIN cnt ON cnt.datasource_id = d.id "
        "GROUP BY c.id, c.name")
    out["j7_destination_counts"] = P + "SELECT datasource_id, destip, count(*) AS dest_count FROM proxy_data GROUP BY datasource_id, destip"
    out["j9_geo_locate"] = _with(PROXY, WEB, GEO) + (
        "SELECT a.address, g.latitude, g.longitude, g.country, g.region, g.city FROM (SELECT DISTINCT address FROM "
        "(SELECT clientip AS address FROM web_data UNION ALL SELECT destip FROM proxy_data)) a "
        f"JOIN geo_blocks g ON {IPNUM.replace('{a}', 'a.address')} BETWEEN g.start_ip AND g.end_ip")
    out["j9_nested_blocks"] = _with(PROXY, WEB, GEO, NESTED) + (
        "SELECT a.address, g.latitude, g.longitude, g.country, g.region, g.city FROM (SELECT DISTINCT address FROM "
        "(SELECT clientip AS address FROM web_data UNION ALL SELECT destip FROM proxy_data)) a "
        f"JOIN nested_blocks g ON {IPNUM.replace('{a}', 'a.address')} BETWEEN g.start_ip AND g.end_ip "
        "QUALIFY row_number() OVER (PARTITION BY a.address ORDER BY g.end_ip - g.start_ip, g.start_ip, g.latitude, g.longitude, g.country, g.region, g.city) = 1")
    gate = lambda t: f"WHERE datasource_id IN (SELECT id FROM datasources_t WHERE type = '{t}')"
    out["a1_bluecoat_detail"] = PR + (
        "SELECT datasource_id, clientip, destip, CAST(sum(bytesIn) AS BIGINT) AS bytesIn, CAST(sum(bytesOut) AS BIGINT) AS bytesOut, "
        "CAST(sum(bytesIn) + sum(bytesOut) AS BIGINT) AS byteTotal, count(id) AS count, "
        "CASE WHEN sum(bytesIn) > sum(bytesOut) THEN 'in' WHEN sum(bytesOut) > sum(bytesIn) THEN 'out' ELSE '==' END AS direction "
        f"FROM proxy_data {gate('bluecoat')} GROUP BY datasource_id, clientip, destip")
    out["a2_bluecoat_summary"] = PR + (
        "SELECT datasource_id, clientip, CAST(sum(bytesIn) AS BIGINT) AS bytesIn, CAST(sum(bytesOut) AS BIGINT) AS bytesOut, "
        "CAST(sum(bytesIn) + sum(bytesOut) AS BIGINT) AS byteTotal, count(DISTINCT destip) AS hosts "
        f"FROM proxy_data {gate('bluecoat')} GROUP BY datasource_id, clientip")
    out["a3_squid_detail"] = PR + (
        "SELECT datasource_id, clientip, destip, CAST(sum(bytesIn) AS BIGINT) AS bytes, min(direction) AS direction, "
        f"count(id) AS count FROM proxy_data {gate('squid')} GROUP BY datasource_id, clientip, destip")
    out["a4_squid_summary"] = PR + (
        "SELECT datasource_id, clientip, CAST(sum(bytesIn) AS BIGINT) AS bytes, count(DISTINCT destip) AS hosts "
        f"FROM proxy_data {gate('squid')} GROUP BY datasource_id, clientip")
    out["a5_pair_statistics"] = _with(PROXY, PAIR_RAW) + (
        "SELECT datasource_id, clientip, destip, n, content_sum, bytes_sum, round_even(m * 100, 0) / 100 AS mean, "
        "round_even(sd * 1000, 0) / 1000 AS stdDev FROM pairs")
    beacons = _with(PROXY, REGISTRY, BEACON)
    out["k8_beacon_index"] = out["a7_beacon_scores"] = out["a7_scores_any_case"] = out["a7_scores_after_imports"] = beacons + "SELECT * FROM beacons"
    out["a8_a10_traffic_summary"] = W + " UNION ALL ".join([
        _labelled("clients_by_bytes_out", "web_data", "clientip", "sum(bytesOut)", 20),
        _labelled("clients_by_pages", "web_data", "clientip", "count(page)", 20),
        _labelled("pages_by_bytes_out", "web_data", "page", "sum(bytesOut)", 20)])
    out["a11_top_clients_total"] = W + _top("web_data", "clientip", "sum(bytesOut) + sum(bytesIn)", 20, "totalBytes")
    out["a12_top_clients_pages"] = W + _top("web_data", "clientip", "count(page)", 40, "totalPages")
    out["a12_top_pages_of_client"] = W + _top("web_data", "page", "count(page)", 40, "totalPages",
                                              f"WHERE clientip = '{REPORT_IP_WEB}'")
    out["a13_top_pages_total"] = W + _top("web_data", "page", "sum(bytesOut) + sum(bytesIn)", 20, "totalBytes")
    typed = "(SELECT p.*, d.type FROM proxy_data p JOIN datasources_t d ON d.id = p.datasource_id WHERE d.type IN ('bluecoat', 'squid'))"
    m_in = "sum(CASE WHEN type = 'bluecoat' THEN bytesIn ELSE bytesOut END)"
    m_out = "sum(CASE WHEN type = 'bluecoat' THEN bytesOut ELSE bytesIn END)"
    m_tot = "sum(CASE WHEN type = 'bluecoat' THEN bytesIn + bytesOut ELSE bytesIn END)"
    out["a14_top_clients_bytes_in"] = PR + _top(typed, "clientip", m_in, 50, "totalBytes")
    out["a15_top_clients_bytes_out"] = PR + _top(typed, "clientip", m_out, 50, "totalBytes")
    out["a16_top_clients_bytes_total"] = PR + _top(typed, "clientip", m_tot, 50, "totalBytes")
    out["a17_top_clients_hosts"] = PR + _top(typed, "clientip", "count(DISTINCT destip)", 40, "hostCount")
    out["a18_web_byte_leaders"] = W + " UNION ALL ".join([
        _labelled("pages_by_bytes_in", "web_data", "page", "sum(bytesIn)", 20),
        _labelled("pages_by_bytes_out", "web_data", "page", "sum(bytesOut)", 20),
        _labelled("clients_by_bytes_out", "web_data", "clientip", "sum(bytesOut)", 20),
        _labelled("clients_by_bytes_in", "web_data", "clientip", "sum(bytesIn)", 20)])
    listing = ("SELECT datasource_id, clientip, destip, count, mean, stdDev, beaconScore, "
               "CASE WHEN beaconScore >= 6 THEN 'High' WHEN beaconScore >= 3 THEN 'Medium' ELSE 'Low' END AS probability "
               "FROM beacons ")
    out["a19_beacon_listing"] = beacons + listing + "WHERE beaconScore >= 3"
    out["a19_beacon_listing_all_labels"] = beacons + listing + "WHERE beaconScore >= 2"
    out["a19_listing_after_import"] = beacons + listing + "WHERE beaconScore >= 3"
    out["a19_beacon_listing_for_ip"] = beacons + listing + f"WHERE clientip = '{REPORT_IP_PROXY}' OR destip = '{REPORT_IP_PROXY}'"
    out["a20_ip_hourly_proxy"] = P + _ip_hourly("proxy_data", f"clientip = '{REPORT_IP_PROXY}' OR destip = '{REPORT_IP_PROXY}'")
    out["a20_ip_hourly_web"] = W + _ip_hourly("web_data", f"clientip = '{REPORT_IP_WEB}'")
    out["a21_ip_top_destinations"] = P + _top("proxy_data", "destip", "sum(bytesOut) + sum(bytesIn)", 25, "totalBytes",
                                              f"WHERE clientip = '{REPORT_IP_PROXY}' OR destip = '{REPORT_IP_PROXY}'")
    out["a21_ip_top_pages"] = W + _top("web_data", "page", "sum(bytesOut) + sum(bytesIn)", 25, "totalBytes",
                                       f"WHERE clientip = '{REPORT_IP_WEB}'")
    out["a22_indicator_listing"] = _with(WEB, XSS) + "SELECT datasource_id, clientip, query, xsstype FROM xss"
    out["a22_indicators_of_client"] = _with(WEB, XSS) + (
        f"SELECT datasource_id, clientip, query, xsstype FROM xss WHERE datasource_id = 4 AND clientip = '{REPORT_IP_WEB}'")
    out["a23_page_search_proxy"] = P + _page_search(
        "proxy_data", f"contains(lower(page), '{SEARCH_WORD.lower()}') OR contains(lower(destip), '{SEARCH_WORD.lower()}')", "time")
    out["a23_page_search_web"] = W + _page_search("web_data", f"contains(lower(page), '{SEARCH_WORD_WEB.lower()}')", "page")
    for kind in ("proxy", "web"):
        out[f"a23_indexed_search_{kind}"] = out[f"a23_page_search_{kind}"]
    web_base = ("wb AS (SELECT datasource_id, count(page) AS total_hits, count(DISTINCT page) AS total_pages, "
                "CAST(sum(bytesIn + bytesOut) AS BIGINT) AS total_bytes FROM web_data GROUP BY datasource_id), "
                "xb AS (SELECT datasource_id, count(query) AS total_xss FROM xss GROUP BY datasource_id), "
                "web_base AS (SELECT wb.*, coalesce(xb.total_xss, 0) AS total_xss FROM wb LEFT JOIN xb USING (datasource_id))")
    out["a24_web_baseline"] = _with(WEB, XSS, web_base) + "SELECT * FROM web_base"
    proxy_base = ("pb AS (SELECT datasource_id, count(DISTINCT destip) AS total_dests, CAST(sum(bytesIn + bytesOut) AS BIGINT) AS total_bytes "
                  "FROM proxy_data GROUP BY datasource_id), "
                  "bb AS (SELECT datasource_id, CAST(sum(beaconScore) AS BIGINT) AS total_beacon FROM beacons GROUP BY datasource_id), "
                  "proxy_base AS (SELECT pb.*, bb.total_beacon FROM pb LEFT JOIN bb USING (datasource_id))")
    out["a25_proxy_baseline"] = _with(PROXY, REGISTRY, BEACON, proxy_base) + "SELECT * FROM proxy_base"
    out["a26_web_suspicion"] = _with(WEB, XSS, web_base + ", " + (
        "pc AS (SELECT datasource_id, clientip, count(page) AS hits, count(DISTINCT page) AS pages, "
        "sum(bytesIn + bytesOut) AS bytes FROM web_data GROUP BY datasource_id, clientip), "
        "xc AS (SELECT datasource_id, clientip, count(query) AS xss FROM xss GROUP BY datasource_id, clientip), "
        "s AS (SELECT pc.datasource_id, pc.clientip, "
        f"{_share('pc.hits', 'b.total_hits')} AS hitsScore, {_share('pc.pages', 'b.total_pages')} AS pageScore, "
        f"{_share('pc.bytes', 'b.total_bytes')} AS bytesScore, {_share('coalesce(xc.xss, 0)', 'b.total_xss')} AS xssScore "
        "FROM pc LEFT JOIN xc USING (datasource_id, clientip) JOIN web_base b ON b.datasource_id = pc.datasource_id)")) + (
        "SELECT *, floor((hitsScore + pageScore + bytesScore + xssScore) * 100 + 0.5) / 100 AS suspicionScore FROM s")
    out["a27_proxy_suspicion"] = _with(PROXY, REGISTRY, BEACON, proxy_base + ", " + (
        "pc AS (SELECT datasource_id, clientip, count(DISTINCT destip) AS dests, sum(bytesIn + bytesOut) AS bytes "
        "FROM proxy_data GROUP BY datasource_id, clientip), "
        "bc AS (SELECT datasource_id, clientip, sum(beaconScore) AS beacon FROM beacons GROUP BY datasource_id, clientip), "
        "s AS (SELECT pc.datasource_id, pc.clientip, "
        f"{_share('pc.dests', 'b.total_dests')} AS ipScore, {_share('pc.bytes', 'b.total_bytes')} AS bytesScore, "
        f"{_share('bc.beacon', 'b.total_beacon')} AS beaconScore "
        "FROM pc LEFT JOIN bc USING (datasource_id, clientip) JOIN proxy_base b ON b.datasource_id = pc.datasource_id)")) + (
        "SELECT *, floor((ipScore + bytesScore + beaconScore) * 100 + 0.5) / 100 AS suspicionScore FROM s")
    out["a28_map_feed_proxy"] = _with(PROXY, GEO) + _map_feed("proxy_data", "destip", 100)
    out["a28_map_feed_web"] = _with(WEB, GEO) + _map_feed("web_data", "clientip", 500)
    dest_names = ("dest_names AS (SELECT DISTINCT concat('203.', CAST(length(event_type) % 5 * 16 + 1 AS VARCHAR), '.0.9') AS address, "
                  "concat(event_type, '.example.com') AS name FROM events)")
    private = ("destip <> '0.0.0.0' AND NOT starts_with(destip, '192.168.1.') AND NOT starts_with(destip, '10.') AND NOT starts_with(destip, '172.16.')")
    top = _top("proxy_data", "destip", "sum(bytesIn + bytesOut)", 100, "totalBytes", f"WHERE {private}")
    out["a28_map_feed_names"] = _with(PROXY, GEO, dest_names) + (
        "SELECT t.datasource_id, t.destip AS address, t.totalBytes, g.latitude, g.longitude, g.country, g.region, g.city FROM ("
        f"SELECT x.*, CASE WHEN regexp_matches(trim(x.destip), '{STRICT_IP_PATTERN}') THEN x.destip ELSE n.address END AS lookup "
        f"FROM ({top}) x LEFT JOIN dest_names n ON n.name = x.destip) t JOIN geo_blocks g ON {IPNUM.replace('{a}', 't.lookup')} BETWEEN g.start_ip AND g.end_ip")
    out["a28_map_one_address"] = _with(PROXY, GEO) + (
        "SELECT a.address, g.latitude, g.longitude, g.country, g.region, g.city FROM "
        f"(SELECT DISTINCT destip AS address FROM proxy_data WHERE destip = '{REPORT_IP_PROXY}') a "
        f"JOIN geo_blocks g ON {IPNUM.replace('{a}', 'a.address')} BETWEEN g.start_ip AND g.end_ip")
    out["a29_latest_time"] = W + "SELECT datasource_id, max(time) AS last_time FROM web_data GROUP BY datasource_id"
    weeks = _with(WEB, _weeks())
    out["p1_week_totals"] = weeks + (
        "SELECT datasource_id, last_time, count(*) FILTER (WHERE week = 'current') AS current_total, "
        "count(*) FILTER (WHERE week = 'previous') AS previous_total FROM (SELECT DISTINCT datasource_id, last_time, week, time, page "
        "FROM weeks WHERE week IS NOT NULL) GROUP BY datasource_id, last_time")
    cur = "SELECT datasource_id, page FROM weeks WHERE week = 'current'"
    prev = "SELECT datasource_id, page FROM weeks WHERE week = 'previous'"
    out["p2_new_pages"] = weeks + f"{cur} EXCEPT {prev}"
    out["p3_gone_pages"] = weeks + f"{prev} EXCEPT {cur}"
    out["p2_p3_page_changes"] = weeks + (f"SELECT datasource_id, page, 'new' AS change FROM ({cur} EXCEPT {prev}) UNION ALL "
                                         f"SELECT datasource_id, page, 'gone' AS change FROM ({prev} EXCEPT {cur})")
    for twin, name in (("a29_latest_from_footers", "a29_latest_time"), ("p1_week_totals_by_day", "p1_week_totals"),
                       ("p2_p3_page_changes_by_day", "p2_p3_page_changes")):
        out[twin] = out[name]
    out["p4_indicator_rows"] = _with(WEB, XSS) + "SELECT * FROM xss"
    out["r1_document_indicators"] = "SELECT count(*) AS texts, " + ", ".join(
        f"count(*) FILTER (WHERE regexp_matches(text, {_q('(?i)' + pattern)})) AS {name}_hits"
        for name, pattern, _ in DETECTORS) + " FROM documents"
    out["r1_page_indicators"] = "SELECT count(*) AS texts, " + ", ".join(
        f"count(*) FILTER (WHERE regexp_matches(html, {_q('(?i)' + pattern)})) AS {name}_hits"
        for name, pattern, _ in DETECTORS) + " FROM pages"
    # Texts without apostrophes or backslashes (true for the driver's documents): shell
    # quoting then reduces to balanced double quotes, and a token is a maximal run of
    # non-blank characters and "..." sections.
    even = """(length(line) - length(replace(line, '"', ''))) % 2 = 0"""
    out["s3_tokenize_documents"] = (
        "WITH doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) "
        f"SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {even}) AS valid_lines, "
        f"CAST(coalesce(sum(CASE WHEN {even} THEN len(regexp_extract_all(line, '(?:[^ \t\r\n\"]+|\"[^\"]*\")+')) "
        "ELSE 0 END), 0) AS BIGINT) AS tokens FROM doc_lines GROUP BY doc_id")
    out["u1_url_parts"] = (
        "SELECT page_id, CASE WHEN host = '' THEN NULL ELSE host END AS host, regexp_replace(path, ';[^/]*$', '') AS path, query FROM ("
        "SELECT page_id, lower(split_part(split_part(regexp_extract(url, '^[^?#]*'), '://', 2), '/', 1)) AS host0, "
        "split_part(lower(split_part(split_part(regexp_extract(url, '^[^?#]*'), '://', 2), '/', 1)), ':', 1) AS host, "
        "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages)")
    out["t2_hourly_requests"] = P + (f"SELECT datasource_id, {_hour('time')} AS hour, count(*) AS requests, "
                                     f"CAST(sum(bytesIn) AS BIGINT) AS bytesIn FROM proxy_data GROUP BY datasource_id, {_hour('time')}")
    out["q1_catalog_sql"] = out["q1_free_sql"] = _with(
        PROXY, WEB, REGISTRY, BEACON, XSS, HOST_NAMES,
        "listed AS (SELECT DISTINCT x.clientip, c.name AS label FROM xss x JOIN datasources_t d ON d.id = x.datasource_id "
        "JOIN collections_t c ON c.id = d.collection_id WHERE x.clientip IN (SELECT clientip FROM web_data WHERE bytesOut > 100))",
        "called AS (SELECT DISTINCT b.clientip, 'beacons' AS label FROM beacons b WHERE b.beaconScore >= 6 AND EXISTS "
        "(SELECT 1 FROM proxy_data p WHERE p.clientip = b.clientip AND p.datasource_id = b.datasource_id AND p.direction = 'in'))") + (
        "SELECT w.clientip AS key, coalesce(n.name, 'unresolvable') AS name FROM "
        "(SELECT * FROM listed UNION ALL SELECT * FROM called) w LEFT JOIN host_names n ON n.address = w.clientip")
    return out
