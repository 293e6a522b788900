"""Savings of retention runs: job records, monthly and annual roll-ups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text as tx
from tidemark.operators.common import keep_or_fail, total
from tidemark.operators.runs import rule_savings
from tidemark.session import use_checkpoint_dir
from tidemark.sources import landed

TOTALS = ["total_deleted_files", "total_deleted_bytes", "total_failed_files"]


def savings_metric(rows: DataFrame) -> DataFrame:
    """One record per (job, month) from rule rows (job_id, month, host, rule, counters, and status where known)."""
    failed_rule = F.col("status") == "failed" if "status" in rows.columns else F.lit(False)
    sums = rows.groupBy("job_id", "month").agg(
        total("deleted_files").alias("total_deleted_files"),
        total("deleted_bytes").alias("total_deleted_bytes"),
        total("failed_files").alias("total_failed_files"),
        F.count_if(failed_rule).alias("total_failed_rules"),
    )
    partial = (F.col("total_failed_files") > 0) | (F.col("total_failed_rules") > 0)
    return sums.withColumns(
        {"schema_version": F.lit(1), "status": F.when(partial, "partial").otherwise("success")}
    )


def metric_hosts(rows: DataFrame) -> DataFrame:
    """The hosts part of the job records, as rows: counters of hosts where anything was deleted."""
    names = ["matched_files", "matched_bytes", "deleted_files", "deleted_bytes", "failed_files"]
    sums = rows.groupBy("job_id", "month", "host").agg(*[total(c).alias(c) for c in names])
    return sums.where((F.col("deleted_files") > 0) | (F.col("deleted_bytes") > 0))


def metric_rules(rows: DataFrame) -> DataFrame:
    """The rules part of the job records, as rows."""
    keep = ["job_id", "month", "host", "rule", "deleted_files", "deleted_bytes", "failed_files"]
    return rule_savings(rows).select(*keep)


#: Hosts and rules that one nested record may hold; a job with more stays rows.
MOST_MEMBERS = 100_000


def metric_documents(
    jobs: DataFrame, reports: DataFrame, rows: DataFrame, source: str = "retention", most: int = MOST_MEMBERS
) -> tuple[DataFrame, DataFrame]:
    """The whole record of each job, its hosts and rules nested, and the jobs that are too large for that.

    ``jobs`` has a row per job (job_id, month, and what the record tells of the job), ``reports`` a row per job and host (os, envs,
    applications), ``rows`` the rule rows. Hosts are summed from rule rows, totals too; hosts and rules without anything
    deleted are left out. Members are counted before any is collected: a job with more than ``most`` comes in the second
    result (job_id, members) and is written from ``metric_hosts`` and ``metric_rules``.
    """
    known = reports.select("job_id", "host", "os", "envs", F.col("applications").alias("groups"))
    counted = ["matched_files", "matched_bytes", "deleted_files", "deleted_bytes", "failed_files"]
    saved = (F.col("deleted_files") > 0) | (F.col("deleted_bytes") > 0)
    hosts = rows.groupBy("job_id", "host").agg(*[total(c).alias(c) for c in counted]).where(saved)
    hosts = hosts.join(known, ["job_id", "host"], "left")
    text = lambda c, other="": F.coalesce(F.col(c), F.lit(other))
    none = F.array().cast("array<string>")
    host = F.struct(
        text("host").alias("host"), text("os", "unknown").alias("os"), F.coalesce("envs", none).alias("envs"),
        F.coalesce("groups", none).alias("groups"), *counted,
    )
    rules = rule_savings(rows).join(known.select("job_id", "host", "os"), ["job_id", "host"], "left")
    zero = F.lit(0).cast("bigint")
    rule = F.struct(
        text("host").alias("host"), text("os", "unknown").alias("os"), text("rule").alias("rule"),
        text("description").alias("description"), text("application").alias("group"), text("environment").alias("environment"),
        text("source", "application").alias("source"),
        *[F.coalesce(F.col(c).cast("bigint"), zero).alias(c) for c in ("deleted_files", "deleted_bytes", "failed_files")],
    )
    hosts, rules = hosts.select("job_id", host.alias("h")), rules.select("job_id", rule.alias("r"))
    sizes = hosts.select("job_id").unionAll(rules.select("job_id")).groupBy("job_id").agg(F.count("*").alias("members"))
    large = sizes.where(F.col("members") > most)

    def nested(members: DataFrame, column: str, name: str) -> DataFrame:
        small = members.join(large, "job_id", "left_anti")
        return small.groupBy("job_id").agg(F.sort_array(F.collect_list(column)).alias(name))

    sums = savings_metric(rows.select("*", F.lit("").alias("_month")).drop("month").withColumnRenamed("_month", "month"))
    found = jobs.join(large, "job_id", "left_anti").join(sums.drop("month"), "job_id", "left")
    found = found.join(nested(hosts, "h", "hosts"), "job_id", "left").join(nested(rules, "r", "rules"), "job_id", "left")
    totals = ["total_deleted_files", "total_deleted_bytes", "total_failed_files", "total_failed_rules"]
    told = ["job_template", "workflow_job_id", "generated_at", "month", "timezone", "mode", "reason"]
    values = {
        "schema_version": F.lit(1).cast("bigint"), "source": F.lit(source), "job_id": F.col("job_id"),
        **{c: text(c) if c in jobs.columns else F.lit("") for c in told},
        "status": text("status", "success"),
        **{c: F.coalesce(c, none) if c in jobs.columns else none for c in ("envs", "groups")},
        **{c: F.coalesce(c, zero) for c in totals},
        **{c: F.coalesce(F.col(c), F.array().cast(schemas.SAVINGS_METRIC[c].dataType)) for c in ("hosts", "rules")},
    }
    return found.select(*[values[c].alias(c) for c in schemas.SAVINGS_METRIC.names]), large


def publishable(records: DataFrame, applied: bool, enabled: bool = True, only_when_deleted: bool = True) -> DataFrame:
    """Records worth keeping: of an enabled, applied run, with bytes saved unless told otherwise."""
    if not (enabled and applied):
        return records.limit(0)
    return records.where(F.coalesce("total_deleted_bytes", F.lit(0)) > 0) if only_when_deleted else records


def rejected_period(records: DataFrame, period: str) -> DataFrame:
    """Records of another month (``YYYYMM``) or year (``YYYY``) than asked for."""
    return records.where(~_in_period(period))


def assert_period(records: DataFrame, period: str) -> DataFrame:
    return keep_or_fail(records, _in_period(period), F.concat(F.lit(f"not in {period}: "), F.coalesce("month", F.lit(""))))


def _in_period(period: str) -> Column:
    month = F.coalesce("month", F.lit(""))
    return month == period if len(period) == 6 else F.rlike(month, F.lit(rf"\A{period}[0-9]{{2}}\z"))


def period_totals(records: DataFrame) -> DataFrame:
    return records.agg(*[total(c).alias(c) for c in TOTALS], F.count("*").alias("execution_count"))


def month_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("month").agg(*[total(c).alias(c) for c in TOTALS], F.count("*").alias("execution_count"))


def calendar(spark: SparkSession, year: str) -> DataFrame:
    """The twelve month keys of a year."""
    months = F.explode(F.sequence(F.lit(1), F.lit(12)))
    return spark.range(1).select(months.alias("m")).select(
        F.concat(F.lit(year), F.lpad(F.col("m").cast("string"), 2, "0")).alias("month")
    )


def monthly_summary(records: DataFrame, year: str) -> DataFrame:
    """Twelve rows: executions, files and bytes per month, zeros where nothing ran."""
    sums = month_totals(records.where(F.substring("month", 1, 4) == year))
    joined = calendar(records.sparkSession, year).join(sums, "month", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "month",
        tx.month_label("month").alias("label"),
        F.coalesce("execution_count", zero).alias("executions"),
        F.coalesce("total_deleted_files", zero).alias("files"),
        F.coalesce("total_deleted_bytes", zero).alias("bytes"),
    ).withColumn("saved", tx.human_bytes("bytes"))


def distinct_members(rows: DataFrame, kinds: dict[str, Column | str]) -> DataFrame:
    """Distinct values of several kinds (hosts, environments, groups, months) as (kind, member) rows.

    A kind is a text column or an array of texts.
    """
    types = dict(rows.select(*[tx.col(c).alias(k) for k, c in kinds.items()]).dtypes)

    def pairs(kind: str, value: Column | str) -> Column:
        def pair(member: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), member.alias("member"))

        many = types[kind].startswith("array")
        return F.transform(tx.col(value), lambda m: pair(m)) if many else F.array(pair(tx.col(value)))

    found = rows.select(F.inline(F.concat(*[pairs(kind, value) for kind, value in kinds.items()])))
    return found.where(F.coalesce("member", F.lit("")) != "").distinct()


def member_counts(rows: DataFrame, kinds: dict[str, Column | str]) -> DataFrame:
    return distinct_members(rows, kinds).groupBy("kind").agg(F.count("*").alias("n"))


def missing_months(consolidated: DataFrame, year: str) -> DataFrame:
    """Months of the year that have no consolidated record."""
    held = consolidated.where(F.coalesce("month", F.lit("")) != "").select("month").distinct()
    return calendar(consolidated.sparkSession, year).join(held, "month", "left_anti")


def annual_records(consolidated: DataFrame, raw: DataFrame, year: str, fallback: bool = True) -> DataFrame:
    """Executions of a year: the consolidated months', and raw ones for months without a consolidated record."""
    held = assert_period(consolidated, year).withColumn("origin", F.lit("consolidated"))
    if not fallback:
        return held
    gaps = missing_months(consolidated, year)
    filled = raw.join(F.broadcast(gaps), "month", "left_semi").withColumn("origin", F.lit("raw"))
    return held.unionByName(filled, allowMissingColumns=True)


def months_without_any_data(consolidated: DataFrame, raw: DataFrame, year: str) -> DataFrame:
    return missing_months(consolidated, year).join(raw.select("month").distinct(), "month", "left_anti")


def duplicate_jobs(records: DataFrame) -> DataFrame:
    counted = records.groupBy("job_id", "month").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > 1)


def consolidate_month(raw: DataFrame, month: str) -> tuple[DataFrame, DataFrame]:
    """Head record and executions of a month. The executions stay rows; a month may hold any number of them.

    ``raw`` holds that month's records; one of another month fails the job instead of being lost.
    """
    executions = assert_period(raw, month)
    head = period_totals(executions).withColumns(
        {
            "schema_version": F.lit(1),
            "period_type": F.lit("month"),
            "month": F.lit(month),
            "month_label": tx.month_label(F.lit(month)),
        }
    )
    return head.where(F.col("execution_count") > 0), executions


def consolidate_year(consolidated: DataFrame, raw: DataFrame, year: str) -> tuple[DataFrame, DataFrame]:
    """Head record and executions of a year. ``missing_months`` lists months without a consolidated record.

    The head is put together from at most twelve month totals per side, so each side is read once.
    """
    held = month_totals(assert_period(consolidated, year))
    spare = month_totals(raw.where(F.substring("month", 1, 4) == year))
    names = [*TOTALS, "execution_count"]
    months = calendar(raw.sparkSession, year)
    months = months.join(held.select("month", F.struct(*names).alias("_held")), "month", "left")
    months = months.join(spare.select("month", F.struct(*names).alias("_spare")), "month", "left")
    chosen = months.withColumn("_used", F.coalesce("_held", "_spare"))

    def listed(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("month")))), ",")

    head = chosen.agg(
        *[total(F.col(f"_used.{c}")).alias(c) for c in names],
        listed(F.col("_held").isNull()).alias("missing_months"),
        listed(F.col("_used").isNull()).alias("months_without_any_data"),
    ).withColumns({"schema_version": F.lit(1), "period_type": F.lit("year"), "year": F.lit(year)})
    return head.where(F.col("execution_count") > 0), annual_records(consolidated, raw, year)


def store_month(raw: DataFrame, month: str, folder: str) -> bool:
    """Write a month's executions once, as a partition of ``folder``; true when the raw records may be dropped.

    A month already there is reused. The raw records may go only after what was written reads back whole.
    """
    spark = raw.sparkSession
    held = stored_months(spark, folder, raw)
    if held is not None and held.where(F.col("month") == month).limit(1).count():
        return False
    _, executions = consolidate_month(raw, month)
    files = raw.select("source_file").distinct().count() if "source_file" in raw.columns else None
    writer = executions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month")
    writer.parquet(folder)
    back = stored_months(spark, folder, raw).where(F.col("month") == month)
    whole = _fingerprint(executions) == _fingerprint(back.select(*executions.columns))
    return whole and (files is None or back.select("source_file").distinct().count() == files)


def stored_months(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame | None:
    return _stored(spark, folder, like.schema)


def _stored(spark: SparkSession, folder: str, schema) -> DataFrame | None:
    """The table at ``folder``; none where nothing has been written yet."""
    try:
        spark.read.format("binaryFile").load(folder)  # lists the folder only
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return spark.read.schema(schema).parquet(folder)


MANIFEST = "path string, length long, modified timestamp, year string"


def consume_year(spark: SparkSession, documents: str, store: str, year: str) -> tuple[DataFrame, DataFrame]:
    """Head of a year from its stored executions and the files not consumed yet, and the files read by this run.

    ``documents`` holds metric documents by month (``write_metric_documents``). A manifest beside the executions names each
    file consumed by path, length and time. An anti join with it finds new and changed files, and only these are opened:
    their executions are appended first, then their manifest rows, so that a run that breaks off leaves executions that
    nothing refers to. An execution counts if the latest manifest row of its file is its own. A year without new files is
    answered from the store.
    """
    listing = landed.list_metric_documents(spark, documents, year)
    manifest = _stored(spark, f"{store}/manifest", MANIFEST)
    identity = ["path", "length", "modified"]
    fresh = listing if manifest is None else listing.join(manifest.select(*identity), identity, "left_anti")
    use_checkpoint_dir(spark)
    fresh = fresh.withColumn("year", F.lit(year)).checkpoint()
    paths = [r["path"] for r in fresh.select("path").toLocalIterator()]  # a subset of what Spark's own listing holds
    if paths:
        records = assert_period(landed.read_metric_files(spark, paths), year)
        marked = records.join(fresh, "path")
        marked.write.mode("append").partitionBy("year").parquet(f"{store}/executions")
        fresh.write.mode("append").partitionBy("year").parquet(f"{store}/manifest")
    manifest = _stored(spark, f"{store}/manifest", MANIFEST)
    if manifest is None:
        return _year_head(spark.createDataFrame([], _EXECUTION), year), fresh
    latest = manifest.where(F.col("year") == year).groupBy("path").agg(F.max(F.struct("modified", "length")).alias("m"))
    latest = latest.select("path", "m.modified", "m.length")
    held = spark.read.parquet(f"{store}/executions").where(F.col("year") == year).join(latest, identity, "left_semi")
    return _year_head(held, year), fresh


_EXECUTION = "month string, " + ", ".join(f"{c} long" for c in TOTALS)


def _year_head(executions: DataFrame, year: str) -> DataFrame:
    months = month_totals(executions)
    head = months.agg(
        *[total(c).alias(c) for c in (*TOTALS, "execution_count")],
        F.array_join(F.sort_array(F.collect_list("month")), ",").alias("months"),  # twelve at most
    )
    return head.withColumns({"schema_version": F.lit(1), "period_type": F.lit("year"), "year": F.lit(year)})


def _fingerprint(df: DataFrame) -> tuple:
    digest = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return tuple(df.agg(F.count("*"), F.sum(digest)).first())
