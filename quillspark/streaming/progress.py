"""Progress of batch phases and of streams as rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "phase string, place int, n_rows long, n_null_keys long"


def run_phases(source: DataFrame, phases: Iterable[tuple[str, Callable[[DataFrame], DataFrame]]], key: str) -> tuple[DataFrame, DataFrame]:
    """(result, progress): the phases run as one plan, with the rows that leave each, and those whose ``key`` is null.

    Counts are taken by the tasks that compute the rows, so no phase is run again to be counted; a task that is run again
    counts once. The result is written to the checkpoint folder, which is what runs the plan.
    """
    df, seen = source, []
    for name, phase in phases:
        df = phase(df)
        seen.append((name, Observation()))
        df = df.observe(seen[-1][1], F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col(key).isNull(), 1)).alias("n_null_keys"))
    result = df.checkpoint()
    rows = [(name, k, o.get["n_rows"], o.get["n_null_keys"]) for k, (name, o) in enumerate(seen)]
    return result, source.sparkSession.createDataFrame(rows, PROGRESS)


class BatchProgress(StreamingQueryListener):
    """Collects one row for each micro-batch of the streams of a session: (query, batch, n_input, n_output).

    Rows are small and one for each batch; ``table`` gives them as a data frame, and ``clear`` forgets them.
    """

    def __init__(self):
        self.rows: list[tuple] = []
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event):  # noqa: N802
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.rows.append((str(p.id), int(p.batchId), int(p.numInputRows), int(p.sink.numOutputRows)))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.ended[str(event.id)] = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, batch long, n_input long, n_output long")

    def clear(self) -> None:
        self.rows.clear()
