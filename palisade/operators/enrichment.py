"""Enrichment: attack type, threat score and receive time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.instants import to_millis_precision
from palisade.functions.scoring import attack_type, threat_score


def enrich(flagged: DataFrame, received_at: Column, keep: list[str] = ()) -> DataFrame:
    """Flat events with a ``repeat_offender`` flag to rows of the event table.

    ``received_at`` is one value per batch. ``keep`` names further columns to
    carry along.
    """
    return flagged.withColumns({
        "received_at": to_millis_precision(received_at),
        "attack_type": attack_type(F.col("rule_category")),
        "threat_score": threat_score(
            F.col("rule_severity"), F.col("action"), F.col("path"), F.col("repeat_offender")
        ),
    }).select(*schema.EVENT_TABLE.fieldNames(), *keep)
