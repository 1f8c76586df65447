"""File events to actions: a move is two events with one cookie; the first half alone is a deletion after 60 seconds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT_S = 60
OUT = "kind string, location string, previous string, ts timestamp"


def pair_moves(events: DataFrame) -> DataFrame:
    """The batch form. events: ts, kind, location, cookie."""
    a = events.filter("kind = 'MOVED_FROM'").select(F.col("cookie"), F.col("location").alias("previous"), F.col("ts").alias("ts_from"))
    b = events.filter("kind = 'MOVED_TO'").select(F.col("cookie"), "location", "ts")
    j = a.join(b, "cookie", "full")
    in_time = F.col("ts") <= F.col("ts_from") + F.expr(f"INTERVAL {TIMEOUT_S} SECONDS")
    kind = F.when(F.col("location").isNull(), "DELETED").when(F.col("previous").isNull(), "CREATED").when(in_time, "MOVED").otherwise("CREATED")
    moved = j.select(kind.alias("kind"), F.coalesce("location", "previous").alias("location"), F.when(kind == "MOVED", F.col("previous")).alias("previous"), F.coalesce("ts", "ts_from").alias("ts"))
    late = j.filter(~in_time).select(F.lit("DELETED").alias("kind"), F.col("previous").alias("location"), F.lit(None).cast("string").alias("previous"), F.col("ts_from").alias("ts"))
    rest = events.filter("kind NOT IN ('MOVED_FROM', 'MOVED_TO')").select("kind", "location", F.lit(None).cast("string").alias("previous"), "ts")
    return moved.unionByName(late).unionByName(rest)


def pair_moves_stream(events: DataFrame) -> DataFrame:
    """The streaming form, with a processing-time timeout. Only halves of moves with a cookie go through the state; all
    other events pass by, halves without a cookie as what they are alone. A second first half of a cookie ends the one
    before it as a deletion."""

    def step(key, batches, state):
        held = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([("DELETED", held[0], None, held[1])], columns=["kind", "location", "previous", "ts"])
            return
        for pdf in batches:
            for r in pdf.sort_values("ts", kind="stable").itertuples():
                if r.kind == "MOVED_FROM":
                    if held:
                        out.append(("DELETED", held[0], None, held[1]))
                    held = (r.location, r.ts)
                elif held:
                    out.append(("MOVED", r.location, held[0], r.ts))
                    held = None
                else:
                    out.append(("CREATED", r.location, None, r.ts))
        if held:
            state.update(held)
            state.setTimeoutDuration(TIMEOUT_S * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["kind", "location", "previous", "ts"])

    half = F.col("kind").isin("MOVED_FROM", "MOVED_TO") & F.col("cookie").isNotNull()
    moves = events.filter(half).groupBy("cookie").applyInPandasWithState(step, OUT, "location string, ts timestamp", "append", "ProcessingTimeTimeout")
    alone = F.when(F.col("kind") == "MOVED_FROM", "DELETED").when(F.col("kind") == "MOVED_TO", "CREATED").otherwise(F.col("kind"))
    rest = events.filter(~half).select(alone.alias("kind"), "location", F.lit(None).cast("string").alias("previous"), "ts")
    return moves.unionByName(rest)
