"""Books that arrive while the engine runs, as a stream of files. An extension: the batch sources do the same for a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """project_id (the file), line_pos, text: the lines of new text files."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return raw.select(F.input_file_name().alias("project_id"), F.posexplode(F.split("value", "\n", -1)).alias("line_pos", "text"))


def word_counts(lines: DataFrame) -> DataFrame:
    """project_id, word, n: running counts, complete or updated with every batch."""
    return lines.select("project_id", F.explode(X.tokens("text")).alias("t")).groupBy("project_id", F.lower("t").alias("word")).count().withColumnRenamed("count", "n")


def ingest(lines: DataFrame, out: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Runs a batch plan on each batch of new lines and writes its rows. A batch that is done again after a failure overwrites its own."""

    def put(batch: DataFrame, number: int) -> None:
        (plan(batch) if plan else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
