"""Queries over savings records derived from the line items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text as tx
from tidemark.operators import savings as sv
from tidemark.plans.registry import Inputs, plain, query
from tidemark.session import use_checkpoint_dir
from tidemark.sources import landed
from tidemark.sources.sinks import write_metric_documents

YEAR = "1998"

_MONTH = "lpad(CAST(year(l_shipdate) AS VARCHAR(20)), 4, '0') || lpad(CAST(month(l_shipdate) AS VARCHAR(20)), 2, '0')"
METRIC_ROWS = f"""SELECT 'job-' || CAST(l_orderkey % 500 AS VARCHAR(20)) AS job_id, {_MONTH} AS month,
       'host-' || CAST(l_suppkey AS VARCHAR(20)) AS host, 'rule-' || CAST(l_linenumber AS VARCHAR(20)) AS rule,
       CAST(l_quantity AS BIGINT) AS matched_files,
       CASE WHEN l_returnflag='R' THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS deleted_files,
       CAST(round(l_extendedprice*100) AS BIGINT)*1000 AS matched_bytes,
       CASE WHEN l_returnflag='R' THEN CAST(0 AS BIGINT) ELSE CAST(round(l_extendedprice*100) AS BIGINT)*1000 END AS deleted_bytes,
       CASE WHEN l_linestatus='F' AND l_returnflag='R' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS failed_files,
       CASE WHEN l_linestatus='F' AND l_returnflag='R' AND l_partkey % 2 = 0 THEN 'failed' ELSE 'ok' END AS status,
       'env' || CAST(l_suppkey % 6 AS VARCHAR(20)) AS env_name, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'app' || CAST(l_suppkey % 9 AS VARCHAR(20)) END AS app
FROM {{lineitem}}"""

RECORDS = plain(
    f"""WITH rows AS ({METRIC_ROWS}), records AS (SELECT job_id, month, CAST(sum(deleted_files) AS BIGINT) AS total_deleted_files, CAST(sum(deleted_bytes) AS BIGINT) AS total_deleted_bytes,
  CAST(sum(failed_files) AS BIGINT) AS total_failed_files, count(*) FILTER (WHERE status = 'failed') AS total_failed_rules FROM rows GROUP BY job_id, month),
held AS (SELECT * FROM records WHERE month LIKE '{YEAR}%' AND right(month, 2) NOT IN ('03', '07')),
raw AS (SELECT * FROM records WHERE right(month, 2) <> '07')
"""
)


def rows(t: Inputs) -> DataFrame:
    return t.sql(METRIC_ROWS)


def records(t: Inputs) -> DataFrame:
    return sv.savings_metric(rows(t))


def held(t: Inputs) -> DataFrame:
    """Months with a consolidated record: all of the year but two."""
    return records(t).where(F.col("month").startswith(YEAR) & ~F.right("month", F.lit(2)).isin("03", "07"))


def raw(t: Inputs) -> DataFrame:
    """Raw records, of which one month is lost."""
    return records(t).where(F.right("month", F.lit(2)) != "07")


@query(
    "savings_metric",
    RECORDS
    + """SELECT job_id, month, total_deleted_files, total_deleted_bytes, total_failed_files, total_failed_rules, CAST(1 AS INTEGER) AS schema_version,
  CASE WHEN total_failed_files > 0 OR total_failed_rules > 0 THEN 'partial' ELSE 'success' END AS status FROM records""",
)
def savings_metric(t: Inputs) -> DataFrame:
    return records(t)


@query(
    "savings_metric_hosts",
    RECORDS
    + """SELECT job_id, month, host, CAST(sum(matched_files) AS BIGINT) AS matched_files, CAST(sum(matched_bytes) AS BIGINT) AS matched_bytes, CAST(sum(deleted_files) AS BIGINT) AS deleted_files,
  CAST(sum(deleted_bytes) AS BIGINT) AS deleted_bytes, CAST(sum(failed_files) AS BIGINT) AS failed_files FROM rows GROUP BY job_id, month, host HAVING sum(deleted_files) > 0 OR sum(deleted_bytes) > 0""",
)
def savings_metric_hosts(t: Inputs) -> DataFrame:
    return sv.metric_hosts(rows(t))


@query(
    "savings_metric_rules",
    RECORDS + "SELECT job_id, month, host, rule, deleted_files, deleted_bytes, failed_files FROM rows WHERE deleted_files > 0 OR deleted_bytes > 0",
)
def savings_metric_rules(t: Inputs) -> DataFrame:
    return sv.metric_rules(rows(t))


def job_rows(t: Inputs) -> DataFrame:
    """Rule rows of jobs that run within one month, with what a record tells of a rule."""
    return rows(t).select(
        F.concat_ws("-", "job_id", "month").alias("job_id"), "month", "host", "rule", "status",
        "matched_files", "matched_bytes", "deleted_files", "deleted_bytes", "failed_files",
        F.concat(F.lit("about "), "rule").alias("description"), F.col("app").alias("application"),
        F.col("env_name").alias("environment"), F.when(F.col("app") == "", "global").alias("source"),
    )


def documents(t: Inputs, months: str = "%") -> DataFrame:
    own = job_rows(t).where(F.col("month").like(months))
    jobs = own.groupBy("job_id").agg(
        F.min("month").alias("month"), F.sort_array(F.collect_set("environment")).alias("envs"),  # six at most
        F.sort_array(F.collect_set(F.nullif("application", F.lit("")))).alias("groups"),  # eight at most
    )
    told = {"job_template": "Purge", "workflow_job_id": "w1", "generated_at": "01/01/1999 00:00:00", "timezone": "UTC", "mode": "apply", "reason": "space"}
    reports = own.groupBy("job_id", "host").agg(
        F.lit("linux").alias("os"), F.sort_array(F.collect_set("environment")).alias("envs"), F.sort_array(F.collect_set("application")).alias("applications")
    )
    return sv.metric_documents(jobs.withColumns({c: F.lit(v) for c, v in told.items()}), reports, own)[0]


_JOB = f"{YEAR}0%"
_ROWS_OF_JOBS = f"own AS (SELECT job_id || '-' || month AS job, * FROM rows WHERE month LIKE '{_JOB}')"


@query(
    "savings_metric_record",
    RECORDS
    + f""", {_ROWS_OF_JOBS},
hosts AS (SELECT job, host, any_value(env_name) AS env, any_value(app) AS app, sum(matched_files) AS mf, sum(matched_bytes) AS mb, sum(deleted_files) AS df, sum(deleted_bytes) AS db, sum(failed_files) AS ff
  FROM own GROUP BY job, host HAVING sum(deleted_files) > 0 OR sum(deleted_bytes) > 0),
h AS (SELECT job, string_agg(concat_ws('|', host, 'linux', env, app, mf, mb, df, db, ff), ';' ORDER BY host) AS hosts FROM hosts GROUP BY job),
r AS (SELECT job, string_agg(concat_ws('|', host, 'linux', rule, 'about ' || rule, app, env_name, CASE WHEN app = '' THEN 'global' ELSE 'application' END, deleted_files, deleted_bytes, failed_files), ';'
  ORDER BY host, rule, app, env_name, deleted_files, deleted_bytes, failed_files) AS rules FROM own WHERE deleted_files > 0 OR deleted_bytes > 0 GROUP BY job),
t AS (SELECT job, month, CAST(sum(deleted_files) AS BIGINT) AS total_deleted_files, CAST(sum(deleted_bytes) AS BIGINT) AS total_deleted_bytes, CAST(sum(failed_files) AS BIGINT) AS total_failed_files,
  count(*) FILTER (WHERE status = 'failed') AS total_failed_rules, string_agg(DISTINCT env_name, ',' ORDER BY env_name) AS envs,
  coalesce(string_agg(DISTINCT app, ',' ORDER BY app) FILTER (app <> ''), '') AS groups FROM own GROUP BY job, month)
SELECT 1::BIGINT AS schema_version, 'retention' AS source, t.job AS job_id, 'Purge' AS job_template, 'w1' AS workflow_job_id, '01/01/1999 00:00:00' AS generated_at, t.month, 'UTC' AS timezone, 'apply' AS mode,
  CASE WHEN total_failed_files > 0 OR total_failed_rules > 0 THEN 'partial' ELSE 'success' END AS status, 'space' AS reason, envs, groups, total_deleted_files, total_deleted_bytes, total_failed_files, total_failed_rules,
  coalesce(hosts, '') AS hosts, coalesce(rules, '') AS rules
FROM t LEFT JOIN h ON h.job = t.job LEFT JOIN r ON r.job = t.job""",
)
def savings_metric_record(t: Inputs) -> DataFrame:
    """Records of nine months, written as nested documents and read back."""
    folder = f"{use_checkpoint_dir(t.spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    write_metric_documents(documents(t, _JOB), folder)
    found = landed.read_metric_documents(t.spark, folder, YEAR)
    flat = lambda name: F.array_join(
        F.transform(name, lambda m: F.concat_ws("|", *[
            F.array_join(m[f.name], ",") if f.dataType.typeName() == "array" else m[f.name].cast("string")
            for f in found.schema[name].dataType.elementType
        ])), ";",
    )
    lists = {"envs": F.array_join("envs", ","), "groups": F.array_join("groups", ",")}
    return found.withColumns({"hosts": flat("hosts"), "rules": flat("rules"), **lists})


@query(
    "savings_year_store",
    RECORDS
    + f""", {_ROWS_OF_JOBS.replace("WHERE", "WHERE month <> '" + YEAR + "05' AND")},
t AS (SELECT job, month, sum(deleted_files) AS df, sum(deleted_bytes) AS db, sum(failed_files) AS ff FROM own GROUP BY job, month),
runs AS (SELECT 1 AS run, '{YEAR}04' AS upto, '{YEAR}01,{YEAR}02,{YEAR}03,{YEAR}04' AS months_read UNION ALL
  SELECT 2, '{YEAR}09', '{YEAR}06,{YEAR}07,{YEAR}08,{YEAR}09' UNION ALL SELECT 3, '{YEAR}09', '')
SELECT run, months_read, string_agg(DISTINCT month, ',' ORDER BY month) AS months, CAST(sum(df) AS BIGINT) AS total_deleted_files, CAST(sum(db) AS BIGINT) AS total_deleted_bytes,
  CAST(sum(ff) AS BIGINT) AS total_failed_files, count(*) AS execution_count FROM runs JOIN t ON month <= upto GROUP BY run, months_read""",
)
def savings_year_store(t: Inputs) -> DataFrame:
    """A year consumed in three runs: four months, four more (one month never arrives), and nothing new."""
    base = f"{use_checkpoint_dir(t.spark).rstrip('/')}/year-{uuid.uuid4().hex}"
    all, heads = documents(t, _JOB).checkpoint(), None
    for run, months in enumerate(("0[1-4]", "0[6-9]", None), 1):
        if months:
            write_metric_documents(all.where(F.rlike("month", F.lit(f"{YEAR}{months}"))), f"{base}/raw")
        head, files = sv.consume_year(t.spark, f"{base}/raw", f"{base}/store", YEAR)
        read = files.select(F.regexp_extract("path", f"{landed.MONTH_FOLDER}=([0-9]+)", 1).alias("m")).distinct()
        read = read.agg(F.array_join(F.sort_array(F.collect_list("m")), ",")).scalar()  # twelve at most
        line = head.select(F.lit(run).alias("run"), read.alias("months_read"), "months", *sv.TOTALS, "execution_count").checkpoint()
        heads = line if heads is None else heads.unionByName(line)
    return heads


@query("publishable", RECORDS + "SELECT job_id, month FROM records WHERE total_deleted_bytes > 0")
def publishable(t: Inputs) -> DataFrame:
    return sv.publishable(records(t), applied=True).select("job_id", "month")


@query("rejected_period", RECORDS + f"SELECT month, count(*) AS n FROM records WHERE month NOT LIKE '{YEAR}%' GROUP BY month")
def rejected_period(t: Inputs) -> DataFrame:
    return sv.rejected_period(records(t), YEAR).groupBy("month").agg(F.count("*").alias("n"))


_SUMS = """CAST(coalesce(sum(total_deleted_files), 0) AS BIGINT) AS total_deleted_files, CAST(coalesce(sum(total_deleted_bytes), 0) AS BIGINT) AS total_deleted_bytes,
  CAST(coalesce(sum(total_failed_files), 0) AS BIGINT) AS total_failed_files, count(*) AS execution_count"""


@query("period_totals", RECORDS + f"SELECT {_SUMS} FROM records")
def period_totals(t: Inputs) -> DataFrame:
    return sv.period_totals(records(t))


@query("month_totals", RECORDS + f"SELECT month, {_SUMS} FROM records GROUP BY month")
def month_totals(t: Inputs) -> DataFrame:
    return sv.month_totals(records(t))


_MONTHS = f"(SELECT '{YEAR}' || lpad(CAST(i AS VARCHAR), 2, '0') AS month FROM generate_series(1, 12) g(i))"
_HUMAN = """CASE WHEN b >= 1099511627776 THEN format('{:.2f}', b / 1099511627776.0) || ' TB' WHEN b >= 1073741824 THEN format('{:.2f}', b / 1073741824.0) || ' GB'
  WHEN b >= 1048576 THEN format('{:.2f}', b / 1048576.0) || ' MB' WHEN b >= 1024 THEN format('{:.2f}', b / 1024.0) || ' KB' ELSE b || ' B' END"""


@query(
    "monthly_summary",
    RECORDS
    + f"""SELECT month, right(month, 2) || '/' || left(month, 4) AS label, executions, files, b AS bytes, {_HUMAN} AS saved FROM (
  SELECT m.month, count(h.month) AS executions, CAST(coalesce(sum(total_deleted_files), 0) AS BIGINT) AS files, CAST(coalesce(sum(total_deleted_bytes), 0) AS BIGINT) AS b
  FROM {_MONTHS} m LEFT JOIN held h ON h.month = m.month GROUP BY m.month)""",
)
def monthly_summary(t: Inputs) -> DataFrame:
    return sv.monthly_summary(held(t), YEAR)


_MEMBERS = """SELECT DISTINCT 'host' AS kind, host AS member FROM rows UNION SELECT 'env', env_name FROM rows
UNION SELECT 'group', app FROM rows WHERE app <> '' UNION SELECT 'month', month FROM rows"""


def _kinds() -> dict:
    return {"host": "host", "env": F.array("env_name"), "group": "app", "month": "month"}


@query("distinct_members", RECORDS + _MEMBERS)
def distinct_members(t: Inputs) -> DataFrame:
    return sv.distinct_members(rows(t), _kinds())


@query("member_counts", RECORDS + f"SELECT kind, count(*) AS n FROM ({_MEMBERS}) GROUP BY kind")
def member_counts(t: Inputs) -> DataFrame:
    return sv.member_counts(rows(t), _kinds())


@query("missing_months", RECORDS + f"SELECT month FROM {_MONTHS} WHERE month NOT IN (SELECT month FROM held)")
def missing_months(t: Inputs) -> DataFrame:
    return sv.missing_months(held(t), YEAR)


@query(
    "annual_records",
    RECORDS
    + f"""SELECT job_id, month, total_deleted_bytes, 'consolidated' AS origin FROM held
UNION ALL SELECT job_id, month, total_deleted_bytes, 'raw' FROM raw WHERE month LIKE '{YEAR}%' AND month NOT IN (SELECT month FROM held)""",
)
def annual_records(t: Inputs) -> DataFrame:
    return sv.annual_records(held(t), raw(t), YEAR).select("job_id", "month", "total_deleted_bytes", "origin")


@query(
    "consolidate_month",
    RECORDS
    + f"SELECT {_SUMS}, CAST(1 AS INTEGER) AS schema_version, 'month' AS period_type, '{YEAR}03' AS month, '03/{YEAR}' AS month_label FROM records WHERE month = '{YEAR}03'",
)
def consolidate_month(t: Inputs) -> DataFrame:
    return sv.consolidate_month(records(t).where(F.col("month") == YEAR + "03"), YEAR + "03")[0]


@query(
    "consolidate_year",
    RECORDS
    + f"""SELECT {_SUMS}, CAST(1 AS INTEGER) AS schema_version, 'year' AS period_type, '{YEAR}' AS year, '{YEAR}03,{YEAR}07' AS missing_months, '{YEAR}07' AS months_without_any_data
FROM (SELECT * FROM held UNION ALL SELECT * FROM raw WHERE month = '{YEAR}03')""",
)
def consolidate_year(t: Inputs) -> DataFrame:
    return sv.consolidate_year(held(t), raw(t), YEAR)[0]


@query("duplicate_jobs", RECORDS + "SELECT job_id, month, count(*) AS n FROM rows GROUP BY job_id, month HAVING count(*) > 1")
def duplicate_jobs(t: Inputs) -> DataFrame:
    return sv.duplicate_jobs(rows(t))


@query("encoded_records", RECORDS + "SELECT job_id, month, total_deleted_bytes FROM records")
def encoded_records(t: Inputs) -> DataFrame:
    """Records written as base64 of JSON, as they arrive from a file share, and read back."""
    packed = records(t).select(tx.encode_record(F.struct("job_id", "month", "total_deleted_bytes")).alias("content"))
    return packed.select(tx.decode_record("content", schemas.SAVINGS_METRIC).alias("r")).select(
        "r.job_id", "r.month", "r.total_deleted_bytes"
    )


# ---- scalar functions --------------------------------------------------------------------------------------------


@query(
    "human_bytes",
    f"""SELECT l_orderkey, l_linenumber, b AS bytes, {_HUMAN} AS text, round_even(b / 1048576.0, 2) AS mib
FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice*100) AS BIGINT) * (CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 10 ELSE 2000000 END) AS b FROM lineitem)""",
)
def human_bytes(t: Inputs) -> DataFrame:
    size = "CAST(round(l_extendedprice*100) AS BIGINT) * (CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 10 ELSE 2000000 END)"
    sized = t.table("lineitem").selectExpr("l_orderkey", "l_linenumber", f"{size} AS bytes")
    return sized.withColumns({"text": tx.human_bytes("bytes"), "mib": tx.mib("bytes")})


@query(
    "duration_hms",
    """SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), greatest(2, length(CAST(s // 3600 AS VARCHAR)))::INT, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration
FROM (SELECT event_id, event_id * 97 AS s FROM events)""",
)
def duration_hms(t: Inputs) -> DataFrame:
    return t.table("events").select("event_id", tx.hms(F.col("event_id") * 97).alias("duration"))


_LOCAL = "ts - INTERVAL 3 HOUR"


@query(
    "local_month",
    f"""SELECT event_id, strftime({_LOCAL}, '%d/%m/%Y %H:%M:%S') || ' America/Sao_Paulo' AS local, strftime({_LOCAL}, '%Y%m') AS month,
  strftime({_LOCAL} - INTERVAL 1 MONTH, '%Y%m') AS previous, CASE WHEN event_id % 5 = 0 THEN '202312' ELSE strftime({_LOCAL}, '%Y%m') END AS asked,
  strftime({_LOCAL}, '%m/%Y') AS label, strftime({_LOCAL} - INTERVAL 1 YEAR, '%Y') AS last_year FROM events""",
)
def local_month(t: Inputs) -> DataFrame:
    local = tx.local_time("ts", "America/Sao_Paulo")
    return t.table("events").select(
        "event_id",
        tx.local_ts("ts", "America/Sao_Paulo").alias("local"),
        tx.resolve_month(local).alias("month"),
        tx.resolve_month(local, mode="previous").alias("previous"),
        tx.resolve_month(local, F.when(F.col("event_id") % 5 == 0, F.lit(" 202312")).otherwise("")).alias("asked"),
        tx.month_label(tx.resolve_month(local)).alias("label"),
        tx.resolve_year(local, mode="previous").alias("last_year"),
    )


LISTS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' Prd ,hml,, PRD ,' || event_type WHEN 1 THEN event_type || ',A b,ab, ' || upper(event_type) WHEN 2 THEN ' , ' ELSE event_type END AS text,
       CASE event_id % 8 WHEN 0 THEN 'SIM' WHEN 1 THEN 's' WHEN 2 THEN 'Yes' WHEN 3 THEN 'no' WHEN 4 THEN '1' WHEN 5 THEN 'TRUE' WHEN 6 THEN '' END AS word,
       CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR(20)) WHEN 1 THEN '12.9' WHEN 2 THEN 'x1' WHEN 3 THEN ' 7 ' WHEN 4 THEN '-3.5' END AS number FROM {events}"""
_CLEAN = """list_filter(list_transform(string_split(regexp_replace(text, '\\s+', '', 'g'), ','), lambda x: lower(x)), lambda x: x <> '')"""


@query(
    "normalize_list",
    plain(
        f"SELECT event_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS items "
        f"FROM (SELECT event_id, {_CLEAN} AS l FROM ({LISTS}))"
    ),
)
def normalize_list(t: Inputs) -> DataFrame:
    return t.sql(LISTS).select("event_id", F.array_join(tx.normalize_list("text"), "|").alias("items"))


@query("yes_no", plain(f"SELECT event_id, coalesce(lower(word) IN ('sim', 's', 'yes', 'true', '1'), FALSE) AS yes FROM ({LISTS})"))
def yes_no(t: Inputs) -> DataFrame:
    return t.sql(LISTS).select("event_id", tx.yes_no("word").alias("yes"))


@query("safe_int", plain(f"SELECT event_id, coalesce(CAST(trunc(TRY_CAST(number AS DOUBLE)) AS BIGINT), 0) AS value FROM ({LISTS})"))
def safe_int(t: Inputs) -> DataFrame:
    return t.sql(LISTS).select("event_id", tx.safe_int("number").alias("value"))


FILTERS = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || ', ' || p_type || ',,x*' WHEN 1 THEN '' END AS rule_text,
       CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'tag_glob_csv' END AS kind FROM {part}"""


@query(
    "filter_patterns",
    plain(
        f"""SELECT p_partkey, coalesce(rule_text, '*') AS role, CASE WHEN kind = 'other' OR coalesce(rule_text, '') = '' THEN '*' ELSE p_brand || ',' || p_type || ',x*' END AS script
FROM ({FILTERS}) JOIN part USING (p_partkey)"""
    ),
)
def filter_patterns(t: Inputs) -> DataFrame:
    filters = t.sql(FILTERS).withColumn("items", F.lit(None).cast("array<string>"))
    return filters.select(
        "p_partkey",
        tx.filter_text(tx.filter_patterns("items", text="rule_text")).alias("role"),
        tx.filter_text(tx.filter_patterns("items", "kind", "script", "rule_text")).alias("script"),
    )


PATHS = """SELECT page_id, url, 'metric_' || lpad(CAST(page_id % 12 + 202401 AS VARCHAR(20)), 6, '0') || '_job' || CAST(page_id AS VARCHAR(20)) ||
       CASE WHEN page_id % 4 = 0 THEN '.txt' ELSE '.json' END AS file FROM {pages}"""


@query(
    "names_and_urls",
    plain(
        f"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS safe, regexp_extract(url, '[^/]*$') AS base,
  regexp_replace(url, '/[^/]*$', '') AS parent, CASE WHEN page_id % 4 <> 0 THEN substr(file, 8, 6) END AS month, regexp_full_match(url, '[A-Za-z0-9_.-]+') AS identifier FROM ({PATHS})"""
    ),
)
def names_and_urls(t: Inputs) -> DataFrame:
    return t.sql(PATHS).select(
        "page_id",
        tx.url_host("url").alias("host"),
        tx.safe_name("url").alias("safe"),
        tx.basename("url").alias("base"),
        tx.dirname("url").alias("parent"),
        tx.metric_file_month("file").alias("month"),
        tx.is_identifier("url").alias("identifier"),
    )
