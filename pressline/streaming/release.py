"""The ingest with its stop rule as a Structured Streaming query.

Responses arrive in any order. Per publisher, the state holds what came for each date of the run and releases
dates in order: a date goes to the table once it and all earlier dates have a successful response, so nothing
behind a failed or missing date is ever written, and a retry that succeeds releases what waited for it.
A date that is answered again after its release is released again as a whole (the newest listings of all its
responses), so any order and batching of the files ends in the table of the batch job.

The state of a publisher holds at most the run's dates times the page size of listings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressline import constants as C
from pressline.operators.profile import date_sequence
from pressline.streaming.ingest import LANDING_SCHEMA, ingest_batch

RELEASED = "query_date string, source_id string, status string, listings string"
HELD = "held string"


def newest(listings: list[dict], limit: int | None) -> list[dict]:
    """The ``limit`` newest of one cell, by the batch job's order: time (none last), then url."""
    listings.sort(key=lambda x: (x.get("url") is not None, x.get("url") or ""))
    listings.sort(key=lambda x: x.get("_time") or "", reverse=True)
    return listings if limit is None else listings[:limit]


def release_in_order(dates: Sequence[str], limit: int | None):
    """State function: (publisher, rows, state) -> responses to write now."""
    order = list(dates)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        before = next((i for i, d in enumerate(order) if d not in held), len(order))
        touched = set()
        for frame in frames:
            for day, listings in zip(frame["query_date"], frame["listings"], strict=True):
                if day in order:
                    held[day] = held.get(day, []) + (json.loads(listings) if listings else [])
                    touched.add(day)
        for day in touched:
            held[day] = newest(held[day], limit)
        after = next((i for i, d in enumerate(order) if d not in held), len(order))
        state.update((json.dumps(held),))
        out = [d for i, d in enumerate(order[:after]) if i >= before or d in touched]
        if out:
            yield pd.DataFrame({"query_date": out, "source_id": key[0], "status": "ok", "listings": [json.dumps(held[d]) for d in out]})

    return run


def released(responses: DataFrame, dates: Sequence[str], sources: Sequence[str] | None, limit: int | None) -> DataFrame:
    """Streaming: the responses of dates that are free to be written."""
    ok = responses.where(F.col("status") == "ok")
    if sources is not None:
        ok = ok.where(F.col("source_id").isin(list(sources)))
    with_time = F.transform("articles", lambda a: a.withField("_time", F.date_format(F.to_timestamp(a["publishedAt"]), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    rows = ok.select("source_id", "query_date", F.to_json(with_time).alias("listings"))
    return rows.groupBy("source_id").applyInPandasWithState(release_in_order(dates, limit), RELEASED, HELD, "update", GroupStateTimeout.NoTimeout)


def start_release_stream(spark: SparkSession, landing_dir: str, table_path: str, checkpoint_location: str,
                         sources: Sequence[str] | None = tuple(C.CORE_SOURCES), first: str = C.FIRST_QUERY_DATE, last: str = C.LAST_QUERY_DATE,
                         limit: int | None = C.LISTING_PAGE_SIZE, preserve_status: bool = False, files_per_batch: int | None = None,
                         multi_line: bool = True, available_now: bool = True) -> StreamingQuery:
    dates = spark.range(1).select(date_sequence(first, last).alias("d")).first().d        # the run's dates
    reader = spark.readStream.schema(LANDING_SCHEMA).option("multiLine", multi_line)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    articles = LANDING_SCHEMA["articles"].dataType.simpleString()

    def write(free: DataFrame, _batch: int) -> None:
        ingest_batch(free.select("query_date", "source_id", "status", F.from_json("listings", articles).alias("articles")), table_path, limit, preserve_status)

    writer = (released(reader.json(landing_dir), dates, sources, limit).writeStream.outputMode("update").foreachBatch(write)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
