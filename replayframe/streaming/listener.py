"""Progress of a stream while it runs, one row for each batch that ends."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, batch long, rows long, rows_per_second double, seconds double, ended string"


class BatchProgress(StreamingQueryListener):
    """Keeps what each batch of each query reports; ``counts`` has it as a table at any time.

    ``spark.streams.addListener(progress)`` before the query starts.  With
    ``path`` each report is also appended to a file of JSON lines on the driver.
    """

    def __init__(self, path: str | None = None):
        self.path, self.rows, self.lock = path, [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (p.name, str(p.runId), p.batchId, p.numInputRows, float(p.processedRowsPerSecond), p.batchDuration / 1000, p.timestamp)
        with self.lock:
            self.rows.append(row)
            if self.path:
                with open(self.path, "a") as file:
                    file.write(json.dumps(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], row, strict=True))) + "\n")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def counts(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.rows), SCHEMA)
