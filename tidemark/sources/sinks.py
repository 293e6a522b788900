"""Writers: JSON, the comparison CSV, and the deletion audit log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.sources.landed import MONTH_FOLDER

COMPARISON_COLUMNS = [
    "repository", "tag", "status", "severity", "mirror_status", "mirror_enabled", "filter", "source_digest",
    "target_digest", "message",
]


def write_json(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One JSON object per line. Long lists stay rows instead of arrays inside one object, so any volume can be written."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_metric_documents(documents: DataFrame, folder: str, mode: str = "append") -> None:
    """Nested metric records, a JSON document a line, in a folder per month. Months are dealt so that each makes few files."""
    lines = documents.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"), F.col("month").alias(MONTH_FOLDER))
    lines.repartition(MONTH_FOLDER).write.mode(mode).partitionBy(MONTH_FOLDER).text(folder)


def write_comparison_csv(rows: DataFrame, path: str, quote_all: bool = True) -> None:
    """Comparison rows as CSV with header; quotes inside a field are doubled."""
    writer = rows.select(*COMPARISON_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("quoteAll", quote_all).option("emptyValue", "").option("nullValue", "").csv(path)


def write_audit(ledger: DataFrame, path: str) -> None:
    """Ledger rows (ts, host, os, rule, size, path) as audit text lines."""
    line = tx.audit_text("ts", "host", "os", "rule", "size", "path")
    ledger.select(line.alias("value")).write.mode("overwrite").text(path)


def drop_written(df: DataFrame, path: str) -> int:
    """Rows of ``df`` not found in what was written at ``path``; only at 0 may the raw input go."""
    back = df.sparkSession.read.schema(df.schema).json(path)
    return df.exceptAll(back.select(*df.columns)).count()


def table_sizes(spark, folders: dict[str, str]) -> DataFrame:
    """Bytes per table and share of the whole, largest first, from file metadata only."""
    parts = []
    for name, folder in folders.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        parts.append(files.select(F.lit(name).alias("table_name"), F.col("length").alias("bytes")))
    frame = parts[0]
    for more in parts[1:]:
        frame = frame.unionByName(more)
    sizes = frame.groupBy("table_name").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return sizes.withColumn("pretty", tx.human_bytes("bytes")).orderBy(F.desc("bytes"), "table_name")
