"""Daily refresh: newly landed bulletins are parsed, scored and put in place of the older predictions.

A zone's newest bulletin is state: documents that landed before it, or with it under a smaller name, change nothing, whichever
batch brings them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from roadpulse.plans import scoring
from roadpulse.session import cut_lineage, ship_package
from roadpulse.sources import bulletins, predictions

DOCUMENT = "weather_index int, json string, landed_at timestamp, file_name string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestDocument(StatefulProcessor):
    """Lets a zone's document through if it is newer than all before; the state is when the newest landed and its name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "landed_at timestamp, file_name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.newest.get() if self.newest.exists() else None
        seen = None if seen is None else (pd.Timestamp(seen[0]), seen[1])
        best = None
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                arrived = (pd.Timestamp(row.landed_at), row.file_name)
                if seen is None or arrived > seen:
                    seen, best = arrived, row
        if best is not None:
            self.newest.update((seen[0].to_pydatetime(), seen[1]))
            yield pd.DataFrame([best], columns=["weather_index", "json", "landed_at", "file_name"])

    def close(self) -> None:
        pass


def newest(documents: DataFrame) -> DataFrame:
    """The stream's documents, less those that are not newer than one of the same zone seen before. A document whose name
    gives no zone is left out."""
    known = documents.where(F.col("weather_index").isNotNull()).select(*[field.split()[0] for field in DOCUMENT.split(", ")])
    return known.groupBy("weather_index").transformWithStateInPandas(NewestDocument(), DOCUMENT, "Update", "None")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of bulletin documents, one per file named after its zone."""
    raw = spark.readStream.schema("value string").text(folder, wholetext=True)
    return raw.select(
        bulletins.zone_of_file(),
        F.col("value").alias("json"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_name").alias("file_name"),
    )


def refresh_batch(
    stations: DataFrame, models: dict[str, DataFrame], today: str, out: str, seed: int = 101, missing: str = "raise",
    rejects: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Scores the zones of one micro-batch, of which each has one document. Each station-day it predicts replaces itself on
    disk, so a batch that runs twice leaves the same table. Documents that give no forecasts change nothing and go to `rejects`,
    with the reason, in a folder of their batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # Read once: forecasts and horizon both come from the parsed documents.
        judged = cut_lineage(bulletins.judged(batch))
        if rejects is not None:
            broken = judged.where(F.col("reason").isNotNull())
            if not broken.isEmpty():
                broken.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        parsed = cut_lineage(bulletins.parse_bulletins(judged.where(F.col("reason").isNull())))
        if parsed.isEmpty():
            return
        rows = scoring.score(
            stations, bulletins.forecasts(parsed), bulletins.horizon(parsed, today), models, today, seed=seed, missing=missing
        )
        predictions.write_prediction_table(rows, out)

    return run


def start(
    spark: SparkSession, folder: str, stations: DataFrame, models: dict[str, DataFrame], today: str, out: str, checkpoint: str,
    missing: str = "raise", rejects: str | None = None,
) -> StreamingQuery:
    """Takes in what has landed since the last run and stops. The state lives in the checkpoint, so a restart goes on from it."""
    spark.conf.set(_PROVIDER, _ROCKS)  # keyed state with values of its own needs this store
    ship_package(spark)
    return (
        newest(landed(spark, folder))
        .writeStream.outputMode("update")
        .foreachBatch(refresh_batch(stations, models, today, out, missing=missing, rejects=rejects))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
