"""Classification of evidence as it arrives, and snapshots that only redo what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import classify
from ..operators.config import Config
from ..operators.fleet import reusable


def classify_stream(routes: DataFrame, config: Config, shapes: dict[str, str], path: str, checkpoint: str) -> StreamingQuery:
    """A stateless stream: routes are classified as they come and appended to `path`; restarts resume at the checkpoint."""
    rows = classify(routes, config, shapes)
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def resume(earlier: DataFrame, targets: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results that hold, targets to redo) of an interrupted or repeated run."""
    held = reusable(earlier, targets)
    return results.join(held.select("target"), "target", "left_semi"), targets.join(held.select("target"), "target", "left_anti")
