"""How many rows Python gets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of an Arrow batch of documents. A batch lies in the executor's buffers, in the socket and in Python at once, and what is made of it is
#: as large again; documents have some kB, so Spark's own number of 10,000 makes this some hundred MB for each task.
BATCH_ROWS = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, of whose session the number of rows of an Arrow batch is lowered to BATCH_ROWS; a lower one stays. Results don't depend on it."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_SETTING)) <= BATCH_ROWS:
        conf.set(_SETTING, BATCH_ROWS)
    return docs
