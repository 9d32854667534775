"""Attack type and threat score of an event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import schema


def _lookup(column: Column, values: dict, otherwise: Column | None = None) -> Column:
    case = None
    for key, value in values.items():
        case = (F if case is None else case).when(column == key, F.lit(value))
    return case if otherwise is None else case.otherwise(otherwise)


def attack_type(category: Column) -> Column:
    return _lookup(category, schema.ATTACK_TYPE)


def sensitive_path(path: Column) -> Column:
    """True when the path contains a sensitive part, case as written; a null path does not."""
    hits = [path.contains(part) for part in schema.SENSITIVE_PATHS]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def threat_score(severity: Column, action: Column, path: Column, repeat_offender: Column) -> Column:
    """Integer score of 0 to 100."""
    total = (
        _lookup(severity, schema.SEVERITY_SCORE)
        + _lookup(action, schema.ACTION_SCORE)
        + F.when(sensitive_path(path), schema.SENSITIVE_PATH_SCORE).otherwise(0)
        + F.when(repeat_offender, schema.REPEAT_OFFENDER_SCORE).otherwise(0)
    )
    return F.least(total, F.lit(schema.MAX_SCORE)).cast("int")


def one_decimal(value: Column) -> Column:
    """Round half up to one decimal."""
    return F.floor(value * 10 + 0.5) / F.lit(10.0)
