"""Validation of raw events, of requests that hold many, and of batches of rows.

The constraints are SQL text over an event called ``{e}``, so that the same
ones serve rows with one event each and arrays inside a request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.text import HAS_INK
from palisade.operators.sizes import broadcast_if_small

NOT_NULL = "must not be null"
NOT_BLANK = "must not be blank"
NOT_EMPTY = "must not be empty"
AT_LEAST = "must be greater than or equal to {}"
AT_MOST = "must be less than or equal to {}"

_ERRORS = "array<struct<field:string,message:string>>"
_NONE = f"cast(array() as {_ERRORS})"


def _blank(field: str) -> tuple[str, str, str]:
    pattern = HAS_INK.replace("\\", "\\\\")
    return field, NOT_BLANK, f"not coalesce({{e}}.{field} rlike '{pattern}', false)"


def _null(field: str) -> tuple[str, str, str]:
    return field, NOT_NULL, f"{{e}}.{field} is null"


def _member(field: str, allowed: list[str]) -> list[tuple[str, str, str]]:
    names = ", ".join(f"'{name}'" for name in allowed)
    return [
        _null(field),
        (field, f"must be one of {', '.join(allowed)}", f"{{e}}.{field} not in ({names})"),
    ]


def _size(field: str) -> list[tuple[str, str, str]]:
    number = f"try_cast({{e}}.{field} as bigint)"
    return [
        (field, "must be a whole number", f"{{e}}.{field} is not null and {number} is null"),
        (field, AT_LEAST.format(0), f"{number} < 0"),
    ]


_OF_RULE = [
    _blank("rule.id"),
    *_member("rule.severity", schema.SEVERITIES),
    *_member("rule.category", schema.CATEGORIES),
]

# Field, message, and the SQL condition under which it is reported.
CONSTRAINTS = [
    *[_blank(field) for field in ("eventId", "clientIp", "path", "method")],
    *[_null(field) for field in ("timestamp", "configId", "statusCode", "rule")],
    ("configId", AT_LEAST.format(0), "{e}.configId < 0"),
    ("statusCode", AT_LEAST.format(100), "{e}.statusCode < 100"),
    ("statusCode", AT_MOST.format(599), "{e}.statusCode > 599"),
    *_size("requestSize"),
    *_size("responseSize"),
    *_member("action", schema.ACTIONS),
    *[(field, text, f"{{e}}.rule is not null and {broken}") for field, text, broken in _OF_RULE],
]


def _report(problems: list[tuple[str, str, str]]) -> str:
    entries = ", ".join(
        f"case when {broken} then named_struct('field', '{field}', 'message', '{text}') end"
        for field, text, broken in problems
    )
    return f"cast(array_compact(array({entries})) as {_ERRORS})"


def _valid(event: str) -> str:
    return " and ".join(
        f"not coalesce({broken.format(e=event)}, false)" for _, _, broken in CONSTRAINTS
    )


def _violations(event: str) -> str:
    named = [(field, text, broken.format(e=event)) for field, text, broken in CONSTRAINTS]
    return f"case when {_valid(event)} then {_NONE} else {_report(named)} end"


def valid(event: str = "event") -> Column:
    """True when the event in the named column breaks no constraint."""
    return F.expr(_valid(event))


def violations(event: str = "event") -> Column:
    """All broken constraints of one event, as an array of ``(field, message)``.

    The list is put together for bad events only.
    """
    return F.expr(_violations(event))


def judge_requests(
    requests: DataFrame, events: str = "events", max_batch_size: int = schema.MAX_BATCH_SIZE
) -> DataFrame:
    """Add ``errors`` to parsed requests, one request per row.

    An empty array means the request is accepted. All events of a request sit
    in its own row, so whole-request rejection needs no shuffle.
    """
    of_request = _report([
        ("body", "must be an event or an array of events", f"{events} is null"),
        ("events", NOT_EMPTY, f"size({events}) = 0"),
        ("events", f"batch must not exceed {max_batch_size} events", f"size({events}) > {max_batch_size}"),
    ])
    of_events = f"""flatten(transform({events}, (e, i) -> transform(
        {_violations('e')},
        v -> named_struct('field', concat('[', i, '].', v.field), 'message', v.message)
    )))"""
    sound = f"size({events}) between 1 and {max_batch_size} and forall({events}, e -> {_valid('e')})"
    return requests.withColumn("errors", F.expr(
        f"case when {sound} then {_NONE} "
        f"else concat({of_request}, coalesce(cast({of_events} as {_ERRORS}), {_NONE})) end"
    ))


def accepted_events(judged: DataFrame, events: str = "events", mode: str = "reject_batch") -> DataFrame:
    """One row per accepted event: its request's columns, ``idx`` and ``event``.

    ``reject_batch`` drops a request with any error; ``quarantine`` drops only
    the events at fault, and requests that are empty or too large.
    """
    others = [c for c in judged.columns if c not in (events, "errors")]
    if mode == "reject_batch":
        kept = judged.where(F.size("errors") == 0)
        return kept.select(*others, F.posexplode(events).alias("idx", "event"))
    if mode != "quarantine":
        raise ValueError("mode must be reject_batch or quarantine")
    of_request = F.exists("errors", lambda e: e["field"].isin("body", "events"))
    kept = judged.where(~of_request).select(*others, F.posexplode(events).alias("idx", "event"))
    return kept.where(valid())


def request_errors(judged: DataFrame, events: str = "events") -> DataFrame:
    """One row per error: the request's columns, ``field`` and ``message``."""
    others = [c for c in judged.columns if c not in (events, "errors")]
    return judged.select(*others, F.explode("errors").alias("error")).select(
        *others, "error.field", "error.message"
    )


def batch_sizes(rows: DataFrame, batch_id: str = "batch_id", max_batch_size: int = schema.MAX_BATCH_SIZE) -> DataFrame:
    """Rows per batch, and whether the batch keeps the limit."""
    return rows.groupBy(batch_id).agg(F.count(F.lit(1)).alias("events")).withColumn(
        "within_limit", F.col("events") <= max_batch_size
    )


def accept_rows(
    rows: DataFrame,
    mode: str = "reject_batch",
    batch_id: str = "batch_id",
    max_batch_size: int = schema.MAX_BATCH_SIZE,
) -> DataFrame:
    """The accepted rows of already exploded events, with ``event`` and a batch id.

    ``reject_batch`` drops every row of a batch that has a bad row or is too
    large. Batches are summed up before the shuffle, and the rows themselves
    move only when the list of refused batches is too large to broadcast.
    """
    sound = valid()
    if mode == "quarantine":
        return rows.where(sound)
    if mode != "reject_batch":
        raise ValueError("mode must be reject_batch or quarantine")
    refused = (
        rows.groupBy(batch_id)
        .agg(F.min(sound).alias("sound"), F.count(F.lit(1)).alias("events"))
        .where(~F.col("sound") | (F.col("events") > max_batch_size))
        .select(batch_id)
    )
    return rows.join(broadcast_if_small(refused), batch_id, "left_anti")
