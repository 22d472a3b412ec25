"""An extension: decks dropped into a folder are decoded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.deck import Deck


def watch(spark: SparkSession, folder: str, kinds: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Write the records of each kind in new deck files to ``out/<kind>/batch=<number>``. A file is one row, so its lines stay in order.

    A batch that is tried again replaces what it wrote before. Its lines are kept while its kinds are decoded.
    """

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.select(F.col("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))
        deck = Deck(lines)
        deck.data.persist()
        for kind in kinds:
            deck[kind].write.mode("overwrite").parquet(f"{out}/{kind}/batch={number}")
        deck.data.unpersist()

    files = spark.readStream.format("text").option("wholetext", True).load(folder).withColumn("file", F.col("_metadata.file_path"))
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
