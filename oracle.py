"""DuckDB SQL for every query, written from the definitions over the given tables."""

BASE = 1_704_067_200_000
DAY = f"ts_ms >= {BASE} AND ts_ms < {BASE + 86_400_000}"

MAPPED = f"""
mapped AS (
  SELECT event_id AS n, user_id AS u, CAST(props->>'$.k' AS INT) AS k,
         {BASE} + (epoch_us(ts)//1000 - {BASE})//30 AS ts_ms
  FROM events
),
flat AS (
  SELECT n, (ts_ms - {BASE})//300000 AS batch_id,
    'evt-' || n AS event_id,
    ts_ms,
    {BASE} + ((ts_ms - {BASE})//300000 + 1)*300000 AS received_ms,
    CAST(5201 + k % 3 AS BIGINT) AS config_id,
    'hedge-' || (1 + u % 3) AS policy_id,
    '198.51.100.' || (u % 16) AS client_ip,
    CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'depot.' ELSE 'till.' END || 'garden.test' AS hostname,
    CASE n % 9 WHEN 0 THEN '/members/login' WHEN 1 THEN '/greenhouse/admin/keys' WHEN 2 THEN '/old-login.html'
      WHEN 3 THEN '/seeds' WHEN 4 THEN '/seeds/tomato' WHEN 5 THEN '/tools/rake'
      WHEN 6 THEN '/basket' WHEN 7 THEN '/pictures/rose.webp' ELSE '/opening-hours' END AS path,
    CASE n % 4 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'GET' WHEN 2 THEN 'PATCH' ELSE 'POST' END AS method,
    CAST(CASE WHEN (n + u) % 5 = 0 THEN 429 WHEN n % 4 = 0 THEN 204 ELSE 302 END AS INT) AS status_code,
    CASE WHEN n % 13 = 0 THEN '' ELSE 'trowel/2.4' END AS user_agent,
    CAST(700 + k AS VARCHAR) AS rule_id,
    CASE k % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS rule_severity,
    CASE (n + k) % 7 WHEN 0 THEN 'INJECTION' WHEN 1 THEN 'XSS' WHEN 2 THEN 'PROTOCOL_VIOLATION'
      WHEN 3 THEN 'DATA_LEAKAGE' WHEN 4 THEN 'BOT' WHEN 5 THEN 'DOS' ELSE 'RATE_LIMIT' END AS rule_category,
    CASE (n + u) % 3 WHEN 0 THEN 'DENY' WHEN 1 THEN 'ALERT' ELSE 'MONITOR' END AS action,
    CASE WHEN n % 11 = 0 THEN '' ELSE
      CASE u % 7 WHEN 0 THEN 'NO' WHEN 1 THEN 'PT' WHEN 2 THEN 'KE' WHEN 3 THEN 'PE'
        WHEN 4 THEN 'JP' WHEN 5 THEN 'FI' ELSE 'NZ' END END AS geo_country,
    CASE WHEN n % 11 = 0 THEN '' ELSE 'town-' || (u % 37) END AS geo_city,
    CAST(CASE WHEN n % 17 = 0 THEN 0 ELSE 40 + (n * 7) % 3001 END AS BIGINT) AS request_size,
    CAST(CASE WHEN n % 19 = 0 THEN 0 ELSE 900 + (n * 11) % 20011 END AS BIGINT) AS response_size,
    k
  FROM mapped
)"""

PRIOR = """
prior AS (
  SELECT e.n, count(h.n) AS prior_count
  FROM flat e LEFT JOIN flat h
    ON h.client_ip = e.client_ip AND h.batch_id < e.batch_id
   AND h.ts_ms >= e.ts_ms - 600000 AND h.ts_ms < e.ts_ms
  GROUP BY e.n
)"""

ATTACK_TYPE = """CASE rule_category WHEN 'INJECTION' THEN 'SQL/Command Injection'
      WHEN 'XSS' THEN 'Cross-Site Scripting' WHEN 'PROTOCOL_VIOLATION' THEN 'Protocol Anomaly'
      WHEN 'DATA_LEAKAGE' THEN 'Data Exfiltration' WHEN 'BOT' THEN 'Bot Activity'
      WHEN 'DOS' THEN 'Denial of Service' WHEN 'RATE_LIMIT' THEN 'Rate Limiting' END"""

BASE_SCORE = """(CASE rule_severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 ELSE 10 END
      + CASE action WHEN 'DENY' THEN 20 WHEN 'ALERT' THEN 10 ELSE 0 END
      + CASE WHEN path LIKE '%/admin%' OR path LIKE '%/login%' THEN 15 ELSE 0 END)"""


def _score(repeat: str) -> str:
    return f"CAST(least({BASE_SCORE} + CASE WHEN {repeat} THEN 15 ELSE 0 END, 100) AS INT)"


ENRICHED = f"""
enriched AS (
  SELECT flat.*, prior_count, prior_count > 5 AS repeat_offender,
    {ATTACK_TYPE} AS attack_type, {_score('prior_count > 5')} AS threat_score
  FROM flat JOIN prior USING (n)
)"""

FLAT = f"WITH {MAPPED}"
STORED = f"WITH {MAPPED}, {PRIOR}, {ENRICHED}"

FLAT_COLUMNS = """event_id, ts_ms AS "timestamp", config_id, policy_id, client_ip, hostname, path, method,
    status_code, user_agent, rule_id, rule_category AS rule_name,
    'matched a pattern of ' || rule_category AS rule_message, rule_severity, rule_category, action,
    geo_country, geo_city, request_size, response_size"""

AVG = "floor(avg(threat_score)*10 + 0.5)/10.0 AS avg_threat_score"

# Events 7, 14, ... travel alone, the others in arrays of neighbours.
REQUESTED = """
requested AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY n) - 1 AS INT) AS idx
  FROM (SELECT *, CASE WHEN n % 7 = 0 THEN 'one-' || n ELSE 'many-' || (n//20) END AS request_id FROM flat)
)"""

FAULTS = """
faults AS (
  SELECT n, CASE WHEN batch_id % 4 = 0 THEN n % 97 END AS fault FROM flat
),
expected(fault, field, message) AS (VALUES
  (0, 'statusCode', 'must be less than or equal to 599'),
  (1, 'configId', 'must be greater than or equal to 0'),
  (2, 'clientIp', 'must not be blank'),
  (3, 'rule.category', 'must be one of INJECTION, XSS, PROTOCOL_VIOLATION, DATA_LEAKAGE, BOT, DOS, RATE_LIMIT'),
  (4, 'rule', 'must not be null'),
  (5, 'eventId', 'must not be blank'),
  (6, 'path', 'must not be blank'),
  (7, 'method', 'must not be blank'),
  (8, 'rule.id', 'must not be blank'),
  (9, 'timestamp', 'must not be null'),
  (10, 'configId', 'must not be null'),
  (11, 'statusCode', 'must not be null'),
  (12, 'action', 'must not be null'),
  (13, 'rule.severity', 'must not be null'),
  (14, 'statusCode', 'must be greater than or equal to 100'),
  (15, 'requestSize', 'must be greater than or equal to 0'),
  (16, 'rule.severity', 'must be one of CRITICAL, HIGH, MEDIUM, LOW'),
  (17, 'action', 'must be one of DENY, ALERT, MONITOR'),
  (18, 'responseSize', 'must be greater than or equal to 0'),
  (19, 'rule.category', 'must not be null')
),
errors AS (SELECT n, field, message FROM faults JOIN expected USING (fault)),
odd AS (
  SELECT CASE n % 97 WHEN 50 THEN 'none-' ELSE 'torn-' END || n AS request_id,
    CASE n % 97 WHEN 50 THEN 'events' ELSE 'body' END AS field,
    CASE n % 97 WHEN 50 THEN 'must not be empty' ELSE 'must be an event or an array of events' END AS message,
    CASE n % 97 WHEN 50 THEN CAST(0 AS BIGINT) END AS events
  FROM flat WHERE n % 97 IN (50, 51)
)"""

FAULTY = f"WITH {MAPPED}, {REQUESTED}, {FAULTS}"

LAST_TENANT = f"""WITH {MAPPED},
late AS (
  SELECT e.n, count(h.n) AS prior_count
  FROM flat e LEFT JOIN flat h
    ON h.client_ip = e.client_ip AND h.config_id <> 5203
   AND h.ts_ms >= e.ts_ms - 600000 AND h.ts_ms < e.ts_ms
  WHERE e.config_id = 5203
  GROUP BY e.n
)"""

SAMPLE_COLUMNS = """event_id, ts_ms AS "timestamp", config_id, client_ip, path,
    CAST(to_json({'severity': rule_severity, 'category': rule_category}) AS VARCHAR) AS rule,
    action, attack_type, threat_score, received_ms AS received_at"""


def _iso(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


NEWEST = "ORDER BY ts_ms DESC, event_id"


def _series(low: int, high: int, step: int, condition: str = "true") -> str:
    return f"""{FLAT},
    grid AS (SELECT unnest(range({low // step * step}, {high}, {step})) AS bucket),
    counted AS (
      SELECT ts_ms // {step} * {step} AS bucket, count(*) AS c FROM flat
      WHERE ts_ms >= {low} AND ts_ms < {high} AND {condition} GROUP BY 1
    )
    SELECT CAST(bucket AS BIGINT) AS bucket_from, CAST(least(bucket + {step}, {high}) AS BIGINT) AS bucket_to,
      CAST(coalesce(c, 0) AS BIGINT) AS count
    FROM grid LEFT JOIN counted USING (bucket)"""


DEFINED = """
definitions AS (
  SELECT n, CASE WHEN k % 4 <> 0 THEN config_id END AS config_id,
    CASE WHEN k % 10 = 9 THEN 'UNKNOWN' ELSE rule_category END AS category,
    CAST(k % 7 AS INT) AS threshold, CAST(CASE WHEN k = 5 THEN 2000000000 ELSE n % 61 END AS INT) AS window_minutes
  FROM flat
),
rules AS (
  SELECT 'rule-' || row_number() OVER (ORDER BY n) AS id, config_id, category, threshold, window_minutes
  FROM definitions WHERE category <> 'UNKNOWN' AND threshold >= 1 AND window_minutes >= 1
)"""

NOON = BASE + 43_200_000


def _evaluated(having: str) -> str:
    return f"""
    SELECT r.id AS rule_id, r.config_id, r.category, r.threshold, r.window_minutes,
      CAST(count(e.n) AS BIGINT) AS actual_count,
      {NOON} - CAST(r.window_minutes AS BIGINT) * 60000 AS window_from, CAST({NOON} AS BIGINT) AS window_to
    FROM rules r LEFT JOIN flat e
      ON e.rule_category = r.category AND (r.config_id IS NULL OR r.config_id = e.config_id)
     AND e.ts_ms >= {NOON} - CAST(r.window_minutes AS BIGINT) * 60000 AND e.ts_ms < {NOON}
    GROUP BY r.id, r.config_id, r.category, r.threshold, r.window_minutes {having}"""


METRICS = """
  SELECT batch_id, count(*) AS events, CAST(sum(CAST(repeat_offender AS INT)) AS BIGINT) AS repeat_offenders,
    CAST(sum(threat_score) AS BIGINT) AS score_sum, max(threat_score) AS score_max
  FROM enriched GROUP BY batch_id"""

ORACLE = {
    "ingest_parse": f"WITH {MAPPED}, {REQUESTED} SELECT request_id, idx, {FLAT_COLUMNS} FROM requested",
    "request_verdicts": f"""{FAULTY}
        SELECT request_id, count(DISTINCT r.n) AS events, count(e.n) AS errors, count(e.n) = 0 AS accepted
        FROM requested r LEFT JOIN errors e USING (n) GROUP BY request_id
        UNION ALL SELECT request_id, events, CAST(1 AS BIGINT), false FROM odd""",
    "validation_errors": f"""{FAULTY}
        SELECT request_id, '[' || idx || '].' || field AS field, message FROM requested JOIN errors USING (n)
        UNION ALL SELECT request_id, field, message FROM odd""",
    "accept_requests": f"""{FAULTY}
        SELECT request_id, idx, {FLAT_COLUMNS} FROM requested
        WHERE request_id NOT IN (SELECT request_id FROM requested JOIN errors USING (n))""",
    "quarantine_requests": f"""{FAULTY}
        SELECT request_id, idx, event_id FROM requested WHERE n NOT IN (SELECT n FROM errors)""",
    "validate_events": f"""{FAULTY}
        SELECT batch_id, n AS source_id, field, message FROM flat JOIN errors USING (n)""",
    "accept_batches": f"""{FAULTY}
        SELECT batch_id, n AS source_id FROM flat WHERE batch_id NOT IN (
          SELECT batch_id FROM flat JOIN errors USING (n)
          UNION ALL SELECT batch_id FROM flat GROUP BY batch_id HAVING count(*) > 10000)""",
    "accept_quarantine": f"""{FAULTY}
        SELECT batch_id, n AS source_id FROM flat WHERE n NOT IN (SELECT n FROM errors)""",
    "batch_limits": f"""{FLAT}
        SELECT batch_id, count(*) AS events, count(*) <= 40 AS within_limit FROM flat GROUP BY batch_id""",
    "flatten_event": f"{FLAT} SELECT {FLAT_COLUMNS}, batch_id, received_ms AS received_at FROM flat",
    "attack_type": f"{FLAT} SELECT event_id, rule_category, {ATTACK_TYPE} AS attack_type FROM flat",
    "threat_score": f"""{FLAT}
        SELECT event_id, path LIKE '%/admin%' OR path LIKE '%/login%' AS sensitive,
          {_score('false')} AS score, {_score('true')} AS repeat_score FROM flat""",
    "repeat_offender_history": f"""{STORED}
        SELECT event_id, client_ip, batch_id, prior_count, repeat_offender FROM enriched""",
    "repeat_offender_disordered": f"""{FLAT},
        sent AS (SELECT n, event_id, client_ip, ts_ms,
          (config_id - 5201)*24 + (ts_ms - {BASE})//3600000 AS batch_id FROM flat)
        SELECT e.event_id, e.batch_id, count(h.n) AS prior_count
        FROM sent e LEFT JOIN sent h ON h.client_ip = e.client_ip AND h.batch_id < e.batch_id
          AND h.ts_ms >= e.ts_ms - 600000 AND h.ts_ms < e.ts_ms
        GROUP BY e.event_id, e.batch_id""",
    "repeat_offender_batch": f"""{LAST_TENANT}
        SELECT event_id, prior_count, prior_count > 5 AS repeat_offender FROM flat JOIN late USING (n)""",
    "repeat_offender_scattered": f"""{FLAT},
        late AS (SELECT *, config_id = 5202 AND (ts_ms - {BASE})//3600000 IN (2, 11, 20) AS chosen FROM flat)
        SELECT e.event_id, count(h.n) AS prior_count
        FROM late e LEFT JOIN late h ON h.client_ip = e.client_ip AND NOT h.chosen
          AND h.ts_ms >= e.ts_ms - 600000 AND h.ts_ms < e.ts_ms
        WHERE e.chosen GROUP BY e.event_id""",
    "packed_events": f"""{STORED}
        SELECT event_id, ts_ms AS "timestamp", received_ms AS received_at, attack_type, threat_score FROM enriched""",
    "live_buckets": f"""{FLAT}
        SELECT ts_ms // 300000 * 300000 AS bucket_from, count(*) AS count FROM flat GROUP BY 1""",
    "alerts_live": f"{FLAT}, {DEFINED} {_evaluated('HAVING count(e.n) > r.threshold')}",
    "rules_appended": f"""{FLAT}, {DEFINED}
        SELECT 'rule-' || row_number() OVER (ORDER BY n % 2, n) AS id, config_id, category, threshold, window_minutes
        FROM definitions WHERE category <> 'UNKNOWN' AND threshold >= 1 AND window_minutes >= 1""",
    "history_by_ip": f"""{FLAT}, batch AS (SELECT * FROM flat WHERE batch_id = 144)
        SELECT client_ip, ts_ms FROM flat
        WHERE batch_id < 144 AND client_ip IN (SELECT client_ip FROM batch)
          AND ts_ms >= (SELECT min(ts_ms) - 600000 FROM batch) AND ts_ms < (SELECT max(ts_ms) FROM batch)""",
    "enrich": f"""{STORED}
        SELECT {FLAT_COLUMNS}, received_ms AS received_at, attack_type, threat_score, batch_id FROM enriched""",
    "enrich_batch": f"""{LAST_TENANT}
        SELECT event_id, CAST({BASE + 90_000_000} AS BIGINT) AS received_at, {ATTACK_TYPE} AS attack_type,
          {_score('prior_count > 5')} AS threat_score FROM flat JOIN late USING (n)""",
    "ingest_metrics": f"{STORED} {METRICS}",
    "ingest_metric_totals": f"""{STORED}, metrics AS ({METRICS})
        SELECT CAST(sum(events) AS BIGINT) AS events_total,
          CAST(sum(repeat_offenders) AS BIGINT) AS repeat_offenders_total, count(*) AS batch_count,
          CAST(sum(events) AS BIGINT) AS batch_size_sum, max(events) AS batch_size_max,
          CAST(sum(events) AS BIGINT) AS score_count, CAST(sum(score_sum) AS BIGINT) AS score_sum,
          max(score_max) AS score_max FROM metrics""",
    "summary_total": f"{FLAT} SELECT count(*) AS total_events FROM flat WHERE {DAY}",
    "summary_total_config": f"{FLAT} SELECT count(*) AS total_events FROM flat WHERE {DAY} AND config_id = 5201",
    "summary_by_category": f"""{STORED}
        SELECT rule_category, count(*) AS count, {AVG} FROM enriched WHERE {DAY} GROUP BY rule_category""",
    "summary_by_category_config": f"""{STORED}
        SELECT rule_category, count(*) AS count, {AVG} FROM enriched
        WHERE ts_ms >= {BASE + 21_600_000} AND ts_ms < {BASE + 64_800_000} AND config_id = 5202
        GROUP BY rule_category""",
    "summary_by_action": f"{FLAT} SELECT action, count(*) AS count FROM flat WHERE {DAY} GROUP BY action",
    "top_attackers": f"""{STORED}
        SELECT client_ip, count(*) AS count, {AVG} FROM enriched WHERE {DAY}
        GROUP BY client_ip ORDER BY count DESC, client_ip LIMIT 10""",
    "top_paths": f"""{FLAT}
        SELECT path, count(*) AS count FROM flat WHERE {DAY} GROUP BY path ORDER BY count DESC, path LIMIT 5""",
    "summary_document": f"""{STORED}, chosen AS (SELECT * FROM enriched WHERE {DAY} AND config_id = 5201)
        SELECT 'total' AS section, 'all' AS "key", count(*) AS count, CAST(NULL AS DOUBLE) AS avg_threat_score FROM chosen
        UNION ALL SELECT 'category', rule_category, count(*), {AVG} FROM chosen GROUP BY rule_category
        UNION ALL SELECT 'action', action, count(*), NULL FROM chosen GROUP BY action
        UNION ALL SELECT * FROM (SELECT 'attacker', client_ip, count(*) AS c, {AVG} FROM chosen
          GROUP BY client_ip ORDER BY c DESC, client_ip LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'path', path, count(*) AS c, NULL FROM chosen
          GROUP BY path ORDER BY c DESC, path LIMIT 5)""",
    "summary_json": f"""{STORED}, chosen AS (SELECT * FROM enriched WHERE {DAY} AND config_id = 5201),
        categories AS (SELECT rule_category AS k, {{'count': count(*), 'avgThreatScore': {AVG.split(" AS ")[0]}}} AS v
          FROM chosen GROUP BY rule_category),
        actions AS (SELECT action AS k, count(*) AS v FROM chosen GROUP BY action),
        attackers AS (SELECT client_ip, count(*) AS c, {AVG} FROM chosen GROUP BY client_ip
          ORDER BY c DESC, client_ip LIMIT 5),
        paths AS (SELECT path, count(*) AS c FROM chosen GROUP BY path ORDER BY c DESC, path LIMIT 5)
        SELECT CAST(to_json({{'configId': 5201,
          'timeRange': {{'from': {_iso(str(BASE))}, 'to': {_iso(str(BASE + 86_400_000))}}},
          'totalEvents': (SELECT count(*) FROM chosen),
          'byCategory': (SELECT map(list(k ORDER BY k), list(v ORDER BY k)) FROM categories),
          'byAction': (SELECT map(list(k ORDER BY k), list(v ORDER BY k)) FROM actions),
          'topAttackers': (SELECT list({{'clientIp': client_ip, 'count': c, 'avgThreatScore': avg_threat_score}}
            ORDER BY c DESC, client_ip) FROM attackers),
          'topTargetedPaths': (SELECT list({{'path': path, 'count': c}} ORDER BY c DESC, path) FROM paths)
        }}) AS VARCHAR) AS "value" """,
    "timeseries_json": f"""WITH buckets AS ({_series(BASE, BASE + 86_400_000, 3_600_000, "config_id = 5203")})
        SELECT CAST(to_json({{'configId': 5203, 'interval': '1h', 'from': {_iso('bucket_from')},
          'to': {_iso('bucket_to')}, 'count': count}}) AS VARCHAR) AS "value" FROM buckets""",
    "samples_json": f"""{STORED}, bots AS (SELECT * FROM enriched WHERE rule_category = 'BOT'),
        chosen AS (SELECT * FROM bots {NEWEST} LIMIT 30 OFFSET 4)
        SELECT CAST(to_json({{'total': (SELECT count(*) FROM bots), 'limit': 30, 'offset': 4,
          'items': (SELECT list({{'eventId': event_id, 'timestamp': {_iso('ts_ms')}, 'configId': config_id,
            'clientIp': client_ip, 'path': path, 'rule': {{'severity': rule_severity, 'category': rule_category}},
            'action': action, 'attackType': attack_type, 'threatScore': threat_score,
            'receivedAt': {_iso('received_ms')}}} {NEWEST}) FROM chosen)
        }}) AS VARCHAR) AS "value" """,
    "alerts_json": f"""{FLAT}, {DEFINED}, found AS ({_evaluated("HAVING count(e.n) > r.threshold")})
        SELECT CAST(to_json({{'evaluatedAt': {_iso(str(NOON))}, 'ruleId': rule_id, 'configId': config_id,
          'category': category, 'threshold': threshold, 'windowMinutes': window_minutes, 'actualCount': actual_count,
          'windowFrom': {_iso('window_from')}, 'windowTo': {_iso('window_to')}}}) AS VARCHAR) AS "value"
        FROM found WHERE config_id IS NOT NULL""",
    "count_by_category": f"""{FLAT}
        SELECT count(*) AS count FROM flat WHERE rule_category = 'INJECTION' AND config_id = 5201
          AND ts_ms >= {NOON - 3_600_000} AND ts_ms < {NOON}""",
    "timeseries_1m": _series(BASE, BASE + 86_400_000, 60_000),
    "timeseries_5m": _series(BASE + 36_090_000, BASE + 37_020_000, 300_000),
    "timeseries_1h": _series(BASE, BASE + 86_400_000, 3_600_000),
    "timeseries_1m_config": _series(BASE - 1_800_000, BASE + 88_200_000, 60_000, "config_id = 5203"),
    "samples_page": f"{STORED} SELECT {SAMPLE_COLUMNS} FROM enriched {NEWEST} LIMIT 20",
    "samples_filtered": f"""{STORED}
        SELECT {SAMPLE_COLUMNS} FROM enriched
        WHERE config_id = 5202 AND rule_category = 'XSS' AND action = 'ALERT'
          AND ts_ms >= {BASE + 10_800_000} AND ts_ms < {BASE + 75_600_000} {NEWEST} LIMIT 100 OFFSET 7""",
    "samples_page_past_end": f"""{STORED}
        SELECT {SAMPLE_COLUMNS} FROM enriched WHERE rule_category = 'BOT' {NEWEST} LIMIT 20 OFFSET 10000000""",
    "samples_deep_page": f"{STORED} SELECT {SAMPLE_COLUMNS} FROM enriched {NEWEST} LIMIT 50 OFFSET 7777",
    "samples_total": f"{FLAT} SELECT count(*) AS total FROM flat WHERE rule_category = 'BOT'",
    "samples_nested": f"""{STORED}
        SELECT {FLAT_COLUMNS}, attack_type, threat_score, received_ms AS received_at
        FROM enriched WHERE action = 'DENY' {NEWEST} LIMIT 100""",
    "rules_define": f"{FLAT}, {DEFINED} SELECT * FROM rules",
    "rule_errors": f"""{FLAT}, {DEFINED}
        SELECT n AS seq, 'category' AS field,
          'must be one of INJECTION, XSS, PROTOCOL_VIOLATION, DATA_LEAKAGE, BOT, DOS, RATE_LIMIT' AS message
        FROM definitions WHERE category = 'UNKNOWN'
        UNION ALL SELECT n, 'threshold', 'must be greater than or equal to 1' FROM definitions WHERE threshold < 1
        UNION ALL SELECT n, 'windowMinutes', 'must be greater than or equal to 1' FROM definitions
        WHERE window_minutes < 1""",
    "alerts_firing": f"""{FLAT}, rules AS (
          SELECT 'rule-1' AS id, CAST(5201 AS BIGINT) AS config_id, 'INJECTION' AS category,
            CAST(5 AS INT) AS threshold, CAST(60 AS INT) AS window_minutes
          UNION ALL SELECT 'rule-2', NULL, 'BOT', 100000, 60
          UNION ALL SELECT 'rule-3', NULL, 'DOS', 3, 30)
        {_evaluated("HAVING count(e.n) > r.threshold")}""",
    "alerts_evaluated": f"{FLAT}, {DEFINED} {_evaluated('')}",
    "attack_waves": f"""{FLAT},
        framed AS (SELECT client_ip, path, ts_ms, count(*) OVER (PARTITION BY client_ip, path ORDER BY ts_ms
          RANGE BETWEEN 180000 PRECEDING AND CURRENT ROW) AS c FROM flat)
        SELECT client_ip, path, count(*) AS events, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
          max(c) AS peak, max(ts_ms) - min(ts_ms) AS span_ms
        FROM framed GROUP BY client_ip, path HAVING max(c) >= 3""",
    "reconcile": f"""{FLAT}, chosen AS (SELECT * FROM flat WHERE {DAY} AND config_id = 5201),
        checks AS (
          SELECT 'by_category' AS "check", count(rule_category) AS lhs, count(*) AS rhs FROM chosen
          UNION ALL SELECT 'by_action', count(action), count(*) FROM chosen
          UNION ALL SELECT 'buckets', count(ts_ms), count(*) FROM chosen
          UNION ALL SELECT 'samples_' || rule_category, count(*), count(*) FROM chosen GROUP BY rule_category)
        SELECT "check", lhs, rhs, lhs = rhs AS ok FROM checks""",
}
