"""Schemas and the fixed values of the event model."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. Results depend on these being exactly as stated.
# ---------------------------------------------------------------------------
SEVERITY_SCORE = {"CRITICAL": 40, "HIGH": 30, "MEDIUM": 20, "LOW": 10}
ACTION_SCORE = {"DENY": 20, "ALERT": 10, "MONITOR": 0}
ATTACK_TYPE = {
    "INJECTION": "SQL/Command Injection",
    "XSS": "Cross-Site Scripting",
    "PROTOCOL_VIOLATION": "Protocol Anomaly",
    "DATA_LEAKAGE": "Data Exfiltration",
    "BOT": "Bot Activity",
    "DOS": "Denial of Service",
    "RATE_LIMIT": "Rate Limiting",
}
SENSITIVE_PATHS = ["/admin", "/login"]
SENSITIVE_PATH_SCORE = 15
REPEAT_OFFENDER_SCORE = 15
MAX_SCORE = 100
REPEAT_OFFENDER_WINDOW_MS = 10 * 60 * 1000
REPEAT_OFFENDER_THRESHOLD = 5
MAX_BATCH_SIZE = 10_000
SUMMARY_TOP = 10
SAMPLES_DEFAULT_LIMIT = 20
SAMPLES_MAX_LIMIT = 100
INTERVAL_SECONDS = {"1m": 60, "5m": 300, "1h": 3600}
ATTACK_WAVE_MS = 3 * 60 * 1000
# ---------------------------------------------------------------------------

SEVERITIES = list(SEVERITY_SCORE)
ACTIONS = list(ACTION_SCORE)
CATEGORIES = list(ATTACK_TYPE)

GEO = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()),
])

RULE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
])


def _event(size: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("eventId", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("configId", T.LongType()),
        T.StructField("policyId", T.StringType()),
        T.StructField("clientIp", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("statusCode", T.IntegerType()),
        T.StructField("userAgent", T.StringType()),
        T.StructField("rule", RULE),
        T.StructField("action", T.StringType()),
        T.StructField("geoLocation", GEO),
        T.StructField("requestSize", size),
        T.StructField("responseSize", size),
    ])


# A raw event.
EVENT = _event(T.LongType())

# The same as read from JSON: the optional sizes stay text, so that a value of
# the wrong type can be told apart from an absent one.
EVENT_JSON = _event(T.StringType())

# The stored fact table.
EVENT_TABLE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("config_id", T.LongType()),
    T.StructField("policy_id", T.StringType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("rule_message", T.StringType()),
    T.StructField("rule_severity", T.StringType()),
    T.StructField("rule_category", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("geo_country", T.StringType()),
    T.StructField("geo_city", T.StringType()),
    T.StructField("request_size", T.LongType()),
    T.StructField("response_size", T.LongType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("threat_score", T.IntegerType()),
])

ALERT_RULE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("config_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("threshold", T.IntegerType()),
    T.StructField("window_minutes", T.IntegerType()),
])

INGEST_METRICS = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("events", T.LongType()),
    T.StructField("repeat_offenders", T.LongType()),
    T.StructField("score_sum", T.LongType()),
    T.StructField("score_max", T.IntegerType()),
])
