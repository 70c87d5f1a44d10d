"""S7 source side: server-sent event logs stored as text files.

One file holds one response.  ``wholetext`` keeps a file in one row, and
``posexplode`` of its lines gives exact line numbers, so line order never
depends on how Spark splits or schedules the read.  The result feeds
``operators.responses.event_line_source`` (batch) or the streaming
assembly (with ``stream=True``, a file stream that picks up new files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_event_files(spark: SparkSession, path: str, stream: bool = False, glob: str | None = None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """``response, line_no, line`` for every line of every event file under
    ``path`` (``response`` is the file's URI)."""
    r = (spark.readStream if stream else spark.read).format("text").option("wholetext", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.load(path)
    return df.select(F.col("_metadata.file_path").alias("response"),
                     F.posexplode(F.split(F.col("value"), r"\r\n|\n|\r")).alias("line_no", "line")) \
        .select("response", F.col("line_no").cast("bigint").alias("line_no"), "line")
