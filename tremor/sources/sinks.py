"""Table sinks with provenance sidecars."""

from __future__ import annotations

import json
import platform
from datetime import datetime, timezone

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_frame(df: DataFrame, root: str, name: str, note: str = "") -> None:
    """Parquet table plus a sidecar with time, versions, rows, columns and note."""
    path = f"{root}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).count()
    sidecar = {
        "name": name,
        "written_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "python": platform.python_version(),
        "spark": pyspark.__version__,
        "rows": rows,
        "columns": df.columns,
        "note": note,
    }
    text = df.sparkSession.createDataFrame([(json.dumps(sidecar),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{root}/{name}.provenance.json")


def artifact_status(spark: SparkSession, root: str) -> DataFrame:
    """One row per saved table, read from the sidecars."""
    schema = "name string, written_utc string, python string, spark string, rows long, columns array<string>, note string"
    return (
        spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").json(root)
        .select("name", "written_utc", "rows", F.size("columns").alias("n_columns"), "note")
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Headed CSV of a result table."""
    df.write.mode("overwrite").csv(path, header=True)


def markdown_rows(df: DataFrame) -> DataFrame:
    """One markdown line per row of a result table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
