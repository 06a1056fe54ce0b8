"""Streaming calibration: sliding windows of scores with state, and event-time counts."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.equations import stress_index

OUTPUT = "kind string, n_seen long, window_size long, quantile double, level double"
STATE = "scores string, n_seen long, level double"


def window_quantile(scores: list[float], alpha: float) -> float:
    """The interpolated quantile at ceil((n + 1)(1 - alpha)) / n; without scores infinite."""
    n = len(scores)
    if not n:
        return math.inf
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
    ordered, at = sorted(scores), (n - 1) * level
    low = math.floor(at)
    return ordered[low] + (at - low) * (ordered[min(low + 1, n - 1)] - ordered[low])


def sliding_calibration(
    stream: DataFrame, kind: str = "kind", score: str = "score", order: str = "seq", size: int = 200, alpha: float = 0.1, rate: float = 0.0
) -> DataFrame:
    """The quantile of the last ``size`` scores of each kind, after every batch.

    With a ``rate`` the miscoverage level adapts: it falls after a score above
    the quantile and rises after others. Rows of a batch go by ``order``; state
    is bounded by the window, and so is what a task holds of a batch: each part of
    it passes on only its last rows of each kind and their number. Only with a
    rate, where every score counts, is a kind's batch sorted whole.
    """
    number = "_n_scores"

    def last_rows(rows: pd.DataFrame) -> pd.DataFrame:
        """The last rows of each kind, the last of which has the number of all."""
        rows = rows.sort_values(order, kind="stable")
        kinds = rows.groupby(kind, dropna=False)
        rows[number] = kinds[number].transform("sum").where(kinds.cumcount(ascending=False) == 0, 0)
        return rows.groupby(kind, dropna=False).tail(size)

    def trimmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, without, limit = None, None, 0
        for pdf in batches:
            scored = pdf[score].notna()
            pdf = pdf.assign(**{number: scored.astype("int64")})
            # A kind without any score has a row of state too.
            without = pd.concat([without, pdf[~scored]]).drop_duplicates(kind)
            kept = pd.concat([kept, pdf[scored]])
            if len(kept) > limit:  # twice what stayed, so that many kinds are not sorted again for each batch
                kept = last_rows(kept)
                limit = 2 * len(kept)
        if kept is not None:
            yield last_rows(kept)
            yield without

    def last_of(batches: Iterable[pd.DataFrame]) -> tuple[list[float], int]:
        """The scores of the last rows, and how many there were."""
        kept, n = None, 0
        for pdf in batches:
            pdf = pdf[[order, score, number]].dropna(subset=[score])
            n += int(pdf[number].sum())
            kept = (pdf if kept is None else pd.concat([kept, pdf])).sort_values(order, kind="stable").tail(size)
        return ([] if kept is None else kept[score].astype(float).tolist()), n

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen, level = ([], 0, alpha) if not state.exists else (json.loads(state.get[0]), state.get[1], state.get[2])
        if not rate:
            more, n = last_of(batches)
            held, seen = [*held, *more][-size:], seen + n
        else:
            rows = pd.concat(list(batches)).sort_values(order, kind="stable")
            for value in rows[score].dropna():
                missed = float(value > window_quantile(held, level)) if held else 0.0
                level = min(0.5, max(0.001, level + rate * (alpha - missed)))
                held = [*held[-(size - 1) :], float(value)] if size > 1 else [float(value)]
                seen += 1
        state.update((json.dumps(held), seen, level))
        yield pd.DataFrame(
            {"kind": [key[0]], "n_seen": [seen], "window_size": [len(held)], "quantile": [window_quantile(held, level)], "level": [level]}
        )

    if not rate:
        rows = stream.select(kind, order, score)
        schema = StructType([*rows.schema.fields, StructField(number, LongType())])
        stream = rows.mapInPandas(trimmed, schema)
    return stream.groupBy(F.col(kind).alias("kind")).applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def event_counts(stream: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means by event-time window; later rows than the watermark allows are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value")
    ).select(F.col("w.start").alias("window_start"), key, "n", "mean_value")


def running_loads(stream: DataFrame, capacities: DataFrame) -> DataFrame:
    """Loads ``(edge_id, load)`` added up over batches, with their stress; a stream-static join."""
    return stream.join(capacities, "edge_id").groupBy("edge_id", "capacity").agg(F.sum("load").alias("load")).select(
        "edge_id", "load", stress_index(F.col("load"), F.col("capacity")).alias("stress")
    )


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)
