"""Readers for landed API pages, metric files, rule tables, listings and tagged log lines."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed_values as fv
from tidemark import schemas
from tidemark.functions import text as tx
from tidemark.operators.common import dedup_first
from tidemark.session import use_checkpoint_dir

METRIC_PREFIX = "metric_"
MONTHLY_PREFIX = "monthly_"
YEARLY_PREFIX = "yearly_"
MONTH_FOLDER = "stored_month"


def scan_inventory(spark: SparkSession, roots: Sequence[str], recursive: bool = False) -> DataFrame:
    """Files below the roots with size and time, without reading their content.

    Spark's listing passes over names that start with ``.`` or ``_``; ``list_tree`` does not. For large estates read an
    inventory table.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = reader.load(list(roots)).select("path", "length", "modificationTime")
    plain = F.regexp_replace("path", r"\Afile:/*", "/")
    return files.select(
        plain.alias("path"),
        tx.basename(plain).alias("filename"),
        F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("mtime"),
    )


LISTING = "path string, filename string, size long, mtime timestamp_ntz, is_dir boolean, message string"
LISTED_AT_ONCE = 10_000


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of the directories given, a bounded number of rows at a time.

    What can't be read is a row with the error's ``message`` and nothing but path and name.
    """
    columns = ["path", "filename", "size", "mtime", "is_dir", "message"]

    def failed(path: str, error: OSError) -> tuple:
        return path, os.path.basename(path), None, pd.NaT, None, error.strerror or type(error).__name__

    def listed(directory: str) -> Iterator[tuple]:
        try:
            entries = os.scandir(directory)
        except OSError as error:
            yield failed(directory, error)
            return
        with entries:
            while True:
                try:
                    entry = next(entries, None)
                except OSError as error:
                    yield failed(directory, error)
                    return
                if entry is None:
                    return
                try:
                    held, folder = entry.stat(follow_symlinks=False), entry.is_dir(follow_symlinks=False)
                except OSError as error:
                    yield failed(entry.path, error)
                    continue
                yield entry.path, entry.name, held.st_size, pd.Timestamp(held.st_mtime_ns // 1000, unit="us"), folder, None

    for batch in batches:
        rows = itertools.chain.from_iterable(listed(d) for d in batch["path"])
        while chunk := list(itertools.islice(rows, LISTED_AT_ONCE)):
            yield pd.DataFrame(chunk, columns=columns).astype({"size": "Int64", "is_dir": "boolean"})


def list_tree(spark: SparkSession, roots: Sequence[str], recursive: bool = False) -> DataFrame:
    """Files and directories below the roots, hidden ones included, of a file system mounted on every executor.

    One pass per depth; the directories of a depth are spread over the tasks. Links are not followed.
    """
    use_checkpoint_dir(spark)
    level, found = spark.createDataFrame([(r,) for r in roots], "path string"), None
    while True:
        entries = level.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_entries, LISTING).checkpoint()
        found = entries if found is None else found.unionByName(entries)
        level = entries.where("is_dir").select("path")
        if not recursive or level.isEmpty():
            return found


def read_metrics(spark: SparkSession, folder: str, month: str | None = None, prefix: str = METRIC_PREFIX) -> DataFrame:
    """Per-job metric files of one month (or all), told apart by file name so that other files are never opened.

    A file that is no valid record fails the job: left out, it would be lost when raw files are dropped.
    """
    pattern = f"{prefix}{month or '[0-9][0-9][0-9][0-9][0-9][0-9]'}_*.json"
    records = (
        spark.read.schema(schemas.SAVINGS_METRIC)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", pattern)
        .json(folder)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )
    return records.where(tx.metric_file_month("source_file", prefix).isNotNull())


def list_metric_documents(spark: SparkSession, folder: str, period: str) -> DataFrame:
    """``path, length, modified`` of the files of metric documents of a month (``YYYYMM``) or a year (``YYYY``), unopened."""
    files = spark.read.format("binaryFile").load(folder)
    held = files.where(F.col(MONTH_FOLDER).cast("string").startswith(period))
    return held.select("path", "length", F.col("modificationTime").alias("modified"))


def read_metric_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The records of files of metric documents, each with the ``path`` of its file. What is no record fails the job."""
    held = spark.read.schema(schemas.SAVINGS_METRIC).option("mode", "FAILFAST").json(list(paths))
    return held.withColumn("path", F.col("_metadata.file_path"))


def read_metric_documents(spark: SparkSession, folder: str, period: str) -> DataFrame:
    """The records of a month or a year that ``write_metric_documents`` wrote; other months' files are not opened."""
    schema = T.StructType([*schemas.SAVINGS_METRIC, T.StructField(MONTH_FOLDER, T.StringType())])
    held = spark.read.schema(schema).option("mode", "FAILFAST").json(folder)
    return held.where(F.col(MONTH_FOLDER).startswith(period)).drop(MONTH_FOLDER)


def read_consolidated(spark: SparkSession, folder: str, period: str) -> DataFrame:
    """Executions held in the consolidated files of a month (``YYYYMM``) or a year (``YYYY``)."""
    prefix = MONTHLY_PREFIX if len(period) == 6 else YEARLY_PREFIX
    held = (
        spark.read.schema(schemas.CONSOLIDATED)
        .option("multiLine", True)
        .option("pathGlobFilter", f"{prefix}{period}.json")
        .json(folder)
    )
    return held.select(F.coalesce("month", "year").alias("period"), F.inline("executions"))


def repositories_from_pages(pages: DataFrame) -> DataFrame:
    """Repositories listed in the good pages, the first mention of each in arrival order."""
    listed = pages.where(F.coalesce("status", F.lit(0)) == 200).select(
        "side", F.col("namespace").alias("page_namespace"), "page_index", F.posexplode("json.repositories").alias("pos", "r")
    )
    raw = F.coalesce("r.name", "r.repository", F.lit(""))
    namespace = F.coalesce("r.namespace", "page_namespace", F.lit(""))
    rows = listed.select(
        "side",
        "page_index",
        "pos",
        tx.repo_full_name(namespace, raw).alias("repository"),
        namespace.alias("namespace"),
        tx.repo_short_name(raw).alias("name"),
        F.coalesce("r.state", F.lit("")).alias("state"),
        F.coalesce("r.is_public", F.lit(False)).alias("is_public"),
        F.coalesce("r.description", F.lit("")).alias("description"),
        F.coalesce("r.last_modified", F.lit("")).alias("last_modified"),
        F.coalesce("r.kind", "r.repo_kind", F.lit("")).alias("kind"),
    ).where(F.length("repository") > 1)
    rest = [c for c in rows.columns if c not in ("side", "repository", "page_index", "pos")]
    return dedup_first(rows, ["repository", "side"], ["page_index", "pos", *rest]).drop("page_index", "pos")


def tags_from_pages(pages: DataFrame, side: str) -> DataFrame:
    """Tags listed in the good pages of one side, the first mention of each (repository, tag) in arrival order."""
    listed = pages.where(F.coalesce("status", F.lit(0)) == 200).select(
        "repository", "namespace", F.col("name").alias("repo_name"), "page_index", F.posexplode("json.tags").alias("pos", "t")
    )
    rows = listed.select(
        F.lit(side).alias("side"),
        "repository",
        "namespace",
        "repo_name",
        F.coalesce("t.name", F.lit("")).alias("tag"),
        tx.digest_of("t.manifest_digest", "t.digest", "t.image_id").alias("manifest_digest"),
        F.coalesce("t.last_modified", F.lit("")).alias("last_modified"),
        F.coalesce("t.start_ts", F.lit("")).alias("start_ts"),
        F.coalesce("t.end_ts", F.lit("")).alias("end_ts"),
        "page_index",
        "pos",
    ).where(F.col("tag") != "")
    order = ["page_index", "pos", "manifest_digest", "last_modified", "start_ts", "end_ts"]
    return dedup_first(rows, ["tag", "repository"], order).drop("page_index", "pos")


def tag_errors_from_pages(pages: DataFrame, side: str) -> DataFrame:
    """Pages that could not be fetched, with the best message known."""
    status = F.coalesce("status", F.lit(0).cast("bigint"))
    message = F.coalesce("json.detail", "json.error_message", "msg", F.lit(fv.TAG_ERROR_MESSAGES[side]))
    return pages.where(status != 200).select(
        F.lit(side).alias("side"), "repository", status.alias("http_status"), message.alias("message")
    )


def mirror_configs_from_responses(responses: DataFrame) -> DataFrame:
    """One row per answer; answers other than 200 stay, marked as not found."""
    status = F.coalesce("status", F.lit(0).cast("bigint"))
    empty = F.lit("")
    return responses.select(
        F.concat("namespace", F.lit("/"), "name").alias("repository"),
        "namespace",
        "name",
        status.alias("http_status"),
        (status == 200).alias("mirror_found"),
        F.coalesce("json.is_enabled", F.lit(False)).alias("is_enabled"),
        F.coalesce("json.mirror_type", empty).alias("mirror_type"),
        F.coalesce("json.external_reference", empty).alias("external_reference"),
        F.coalesce("json.external_registry_username", empty).alias("external_registry_username"),
        F.col("json.sync_interval").alias("sync_interval"),
        F.coalesce("json.sync_start_date", empty).alias("sync_start_date"),
        F.coalesce("json.sync_expiration_date", empty).alias("sync_expiration_date"),
        F.coalesce("json.sync_status", F.lit("CONFIG_ERROR")).alias("sync_status"),
        F.col("json.sync_retries_remaining").alias("sync_retries_remaining"),
        F.coalesce("json.robot_username", empty).alias("robot_username"),
        F.col("json.root_rule.rule_kind").alias("rule_kind"),
        F.col("json.root_rule.rule_value").alias("rule_value"),
        F.col("json.skopeo_timeout_interval").alias("skopeo_timeout_interval"),
        F.coalesce("json.architecture_filter", F.array().cast("array<string>")).alias("architecture_filter"),
        F.coalesce("json.detail", "json.error_message", empty).alias("api_error"),
    )


def parse_tagged_lines(lines: DataFrame, value: str = "value", prefix: str = "DPM_") -> DataFrame:
    """Fields of ``<prefix>KEY=text`` lines; disk lines also give their measures, in bytes.

    Six parts are filesystem, mount, then size, used and free in KiB; five parts are a drive with bytes.
    """
    line = F.col(value)
    start = len(prefix) + 1
    key = F.substring_index(F.substring(line, start, 2**30), "=", 1)
    rows = lines.where(line.startswith(prefix) & F.contains(line, F.lit("="))).withColumn("key", key)
    rows = rows.withColumn("text", line.substr(F.length("key") + start + 1, F.length(line)))
    rows = rows.where(F.col("key") != "").withColumn(
        "_parts", F.when(F.col("key") == "DISK", F.split("text", r"\|")).otherwise(F.array().cast("array<string>"))
    )
    # One shape for both: filesystem, mount, unit, size, used, free, percent.
    parts = F.col("_parts")
    unix = F.concat(F.slice(parts, 1, 2), F.array(F.lit("1024")), F.slice(parts, 3, 4))
    drive = F.concat(F.slice(parts, 1, 1), F.slice(parts, 1, 1), F.array(F.lit("1")), F.slice(parts, 2, 4))
    shaped = F.when(F.size(parts) >= 6, unix).when(F.size(parts) == 5, drive)
    rows = rows.withColumn("_parts", shaped)
    rows = rows.withColumn("_numbers", F.transform(F.slice("_parts", 3, 5), lambda x: tx.safe_int(x)))

    def number(i: int) -> Column:
        return F.get("_numbers", F.lit(i))

    return rows.withColumns(
        {
            "number": F.when(F.rlike("text", F.lit(r"\A[0-9]+\z")), tx.whole_number(F.col("text"))),
            "filesystem": F.get("_parts", F.lit(0)),
            "mount": F.get("_parts", F.lit(1)),
            "size_bytes": number(1) * number(0),
            "used_bytes": number(2) * number(0),
            "free_bytes": number(3) * number(0),
            "used_pct": number(4),
        }
    ).drop("_parts", "_numbers")


def disk_row_windows(size: Column | str, free: Column | str) -> list[Column]:
    """Used bytes and whole percent of a drive (half to even)."""
    used = tx.col(size) - tx.col(free)
    return [used.alias("used_bytes"), F.bround(used * 100.0 / tx.col(size), 0).cast("bigint").alias("used_pct")]


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return parse_audit(spark.read.text(path))


def parse_audit(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fields of deletion audit lines; any other line is passed over."""
    shape = r"\A(.+?) \| host=(.*?) \| sistema=(.*?) \| regra=(.*?) \| bytes=([0-9]+) \| arquivo=(.*)\z"
    names = ["ts", "host", "os", "rule", "bytes", "path"]
    hits = lines.where(F.rlike(value, F.lit(shape)))
    picked = [F.regexp_extract(value, shape, i + 1).alias(n) for i, n in enumerate(names)]
    return hits.select(*picked).withColumn("bytes", tx.safe_int("bytes"))


def load_rules(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rule files, or folders of them, in load order: paths as given, files of a folder by name.

    A later file replaces all rules of the same (application, os).
    """
    parts = [
        spark.read.schema(schemas.PURGE_RULE).json(path).withColumn(
            "file_order", F.struct(F.lit(i).alias("given"), F.col("_metadata.file_path").alias("file"))
        )
        for i, path in enumerate(paths)
    ]
    return later_wins(reduce(DataFrame.unionByName, parts))


def later_wins(rules: DataFrame) -> DataFrame:
    """The rules of the last file (``file_order``) of every application and system."""
    last = rules.groupBy("application", "os").agg(F.max("file_order").alias("_last"))
    same = [rules[c].eqNullSafe(last[c]) for c in ("application", "os")]
    kept = rules.join(last, [*same, rules["file_order"] == last["_last"]], "left_semi")
    return kept.drop("file_order")


def filter_listing(lines: DataFrame, excluded: Sequence[str], value: str = "value") -> DataFrame:
    """Lines that contain none of the configured texts."""
    kept = lines
    for text in excluded:
        if text:
            kept = kept.where(~F.contains(F.col(value), F.lit(text)))
    return kept
