"""Run results: rule status, totals, host reports, disk measures, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import text as tx
from tidemark.operators.common import first_rows, total

COUNTERS = [
    "matched_files", "deleted_files", "failed_files", "matched_bytes", "deleted_bytes", "removed_empty_dirs",
    "failed_empty_dirs",
]


def _shell_state(engine: str = "engine") -> tuple[Column, Column, Column, Column, Column]:
    fatal = F.size("fatal_errors") > 0
    all_blocked = (F.size("allowed") == 0) & (F.size("blocked") > 0)
    operations = (F.col("failed_files") > 0) | (F.col("failed_empty_dirs") > 0) | (F.coalesce("errors", F.lit(0)) > 0)
    nothing = (
        F.col("apply") & (F.col("matched_files") > 0) & (F.col("deleted_files") == 0) & (F.col("failed_files") == 0)
    )
    some_blocked = F.size("blocked") > 0
    return fatal, all_blocked, operations, nothing, some_blocked


def rule_status(rows: DataFrame) -> DataFrame:
    """Adds ``status`` and ``status_detail``.

    Needs fatal_errors, allowed, blocked (arrays), path_errors and errors (counts), apply, os, engine and the counters.
    The modules engine looks at failed counters and blocked paths only.
    """
    fatal, all_blocked, operations, nothing, some_blocked = _shell_state()
    modules = F.col("engine") == "modules"
    linux = F.coalesce("os", F.lit("linux")) == "linux"
    path_errors = linux & ~modules & (F.coalesce("path_errors", F.lit(0)) > 0)
    counted = (F.col("failed_files") > 0) | (F.col("failed_empty_dirs") > 0)
    failed = F.when(modules, counted).otherwise(operations)
    idle = ~modules & nothing
    failed_text = F.when(linux, fv.DETAIL_FAILED["linux"]).otherwise(fv.DETAIL_FAILED["windows"])
    status = (
        F.when(fatal | all_blocked, "blocked")
        .when(path_errors | failed, "failed")
        .when(idle | some_blocked, "warning")
        .otherwise("ok")
    )
    detail = (
        F.when(fatal, F.array_join("fatal_errors", " "))
        .when(all_blocked, fv.DETAIL_ALL_BLOCKED)
        .when(path_errors, fv.DETAIL_PATH_ERROR)
        .when(failed, failed_text)
        .when(idle, fv.DETAIL_NOTHING_DELETED)
        .when(some_blocked, fv.DETAIL_SOME_BLOCKED)
        .otherwise("ok")
    )
    return rows.withColumns({"status": status, "status_detail": detail})


def rule_rows(rules: DataFrame, counters: DataFrame, apply: bool) -> DataFrame:
    """One report row per planned rule, with zero counters where nothing matched."""
    zero = F.lit(0).cast("bigint")
    joined = rules.join(counters, ["host", "rule_id"], "left")
    have = set(counters.columns)
    joined = joined.withColumns({c: F.coalesce(c, zero) if c in have else zero for c in COUNTERS})
    extra = {c: F.lit(0) for c in ("path_errors", "errors") if c not in joined.columns}
    return rule_status(joined.withColumns({**extra, "apply": F.lit(apply)}))


def run_totals(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Totals over all rule rows of a run, in one pass, and the number of host reports."""
    count = lambda name: F.count_if(F.trim("status") == name)
    size = lambda name: total(F.greatest(F.size(name), F.lit(0)).cast("bigint"))
    totals = rows.agg(
        F.count("*").alias("total_rules"),
        *[total(c).alias(f"total_{c}") for c in COUNTERS],
        size("blocked").alias("total_blocked_paths"),
        size("missing").alias("total_missing_paths"),
        count("failed").alias("total_failed_rules"),
        count("warning").alias("total_warning_rules"),
        count("blocked").alias("total_blocked_rules"),
    )
    return totals.withColumn("total_hosts", hosts.agg(F.count_distinct("host")).scalar())


def host_totals(rows: DataFrame) -> DataFrame:
    """Counters per host, for hosts where anything was deleted."""
    names = ["matched_files", "matched_bytes", "deleted_files", "deleted_bytes", "failed_files"]
    sums = rows.groupBy("host").agg(*[total(c).alias(c) for c in names])
    return sums.where((F.col("deleted_files") > 0) | (F.col("deleted_bytes") > 0))


def rule_savings(rows: DataFrame) -> DataFrame:
    return rows.where((F.coalesce("deleted_files", F.lit(0)) > 0) | (F.coalesce("deleted_bytes", F.lit(0)) > 0))


def host_savings(rows: DataFrame, apply: bool) -> DataFrame:
    """Bytes shown as saved: deleted ones after a run that applied, matched ones after a check."""
    counted = "deleted_bytes" if apply else "matched_bytes"
    sums = rows.groupBy("host").agg(total(counted).alias("saved_bytes"))
    return sums.withColumn("saved", tx.human_bytes("saved_bytes"))


def audit_entries(rows: DataFrame) -> DataFrame:
    """Deleted files plus distinct missing-path lines, per host."""
    deleted = rows.groupBy("host").agg(total("deleted_files").alias("deleted_files"))
    lines = rows.select("host", "rule", F.explode("missing").alias("m")).where(F.trim("m.path") != "")
    text = tx.missing_path_text("rule", F.trim("m.reason"), F.trim("m.path"))
    missing = lines.select("host", text.alias("line")).distinct().groupBy("host").agg(F.count("*").alias("missing_paths"))
    joined = deleted.join(missing, "host", "left")
    joined = joined.withColumn("missing_paths", F.coalesce("missing_paths", F.lit(0).cast("bigint")))
    return joined.withColumn("audit_entries", F.col("deleted_files") + F.col("missing_paths"))


def interrupted_hosts(states: DataFrame) -> DataFrame:
    """Hosts that began, did not finish, and have no recorded failure."""
    no = F.lit(False)
    return states.where(
        F.coalesce("started", no) & ~F.coalesce("completed", no) & ~F.coalesce("failure_recorded", no)
    )


def complete_reports(states: DataFrame, rows: DataFrame) -> DataFrame:
    """Rule rows plus one failed row for every interrupted host."""
    zero = F.lit(0).cast("bigint")
    lost = interrupted_hosts(states).select(
        "host",
        F.lit(fv.RULE_INTERRUPTED).alias("rule"),
        F.lit("failed").alias("status"),
        F.lit(fv.RULE_INTERRUPTED_DETAIL).alias("status_detail"),
        *[zero.alias(c) for c in COUNTERS],
    )
    return rows.select(*lost.columns).unionByName(lost)


def failed_host_rows(failures: DataFrame) -> DataFrame:
    """Rows of hosts whose run broke off: columns host, category, task, details (texts, all of them whole)."""
    head = F.array(F.concat(F.lit("Categoria: "), "category"), F.concat(F.lit("Task: "), F.trim("task")))
    return failures.select(
        "host",
        F.lit(fv.RULE_FAILED).alias("rule"),
        F.lit(fv.RULE_FAILED_DESCRIPTION).alias("description"),
        F.lit("failed").alias("status"),
        F.col("category").alias("status_detail"),
        F.concat(head, "details").alias("fatal_errors"),
        *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS],
    )


def shown_failures(
    rows: DataFrame, details: int = fv.FAILURE_DETAILS_SHOWN, length: int = fv.FAILURE_DETAIL_LENGTH
) -> DataFrame:
    """Failed rows as a report shows them: category, task and the first details, each up to a length."""
    head, rest = F.slice("fatal_errors", 1, 2), F.slice("fatal_errors", 3, details)
    return rows.withColumn("fatal_errors", F.concat(head, F.transform(rest, lambda d: F.substring(d, 1, length))))


def host_reports(states: DataFrame, rows: DataFrame) -> DataFrame:
    """One report head per planned host; hosts without rows have an empty report."""
    counted = rows.groupBy("host").agg(F.count("*").alias("rows"))
    joined = states.select("host").distinct().join(counted, "host", "left")
    return joined.withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))


def runtime_failed_hosts(states: DataFrame) -> DataFrame:
    no = F.lit(False)
    broken = F.coalesce("failure_recorded", no) | (F.coalesce("started", no) & ~F.coalesce("completed", no))
    return states.where(broken).select("host").distinct()


def max_disk_pct(disks: DataFrame, apply: bool) -> DataFrame:
    """Highest percent in use; a host counts with its measures after the run where it has any and the run applied."""
    pct = F.coalesce("used_pct", F.lit(0)).cast("bigint")
    after = F.col("phase") == "after"
    per_host = disks.groupBy("host").agg(
        F.max(F.when(~after, pct)).alias("_before"), F.max(F.when(after, pct)).alias("_after")
    )
    worst = F.when(F.lit(apply) & F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_before"))
    return per_host.agg(F.greatest(F.coalesce(F.max(worst), F.lit(0)), F.lit(0)).cast("bigint").alias("max_disk_used_pct"))


def disk_delta(before: DataFrame, after: DataFrame, warn: int = 75, crit: int = 90) -> DataFrame:
    """Mount by mount: percent in use and free bytes before and after."""
    later = after.select(
        "host", "mount", F.col("used_pct").alias("used_pct_after"), F.col("free_bytes").alias("free_bytes_after")
    )
    joined = before.join(later, ["host", "mount"], "left")
    return joined.select(
        "host",
        "mount",
        "used_pct",
        "used_pct_after",
        tx.disk_band("used_pct", warn, crit).alias("band_before"),
        F.when(F.col("used_pct_after").isNotNull(), tx.disk_band("used_pct_after", warn, crit)).alias("band_after"),
        "free_bytes",
        "free_bytes_after",
        (F.col("free_bytes_after") - F.col("free_bytes")).alias("freed_bytes"),
    )


def mounts_for_rules(rules: DataFrame, disks: DataFrame) -> DataFrame:
    """One disk row per host and mount that a path of an enabled rule lies on.

    On Linux the longest mount above the path counts, on Windows the drive letter.
    """
    paths = rules.where(F.coalesce("enabled", F.lit(True))).select("host", F.explode("paths").alias("path"))
    paths = paths.select("host", F.trim("path").alias("path")).where(F.col("path") != "").distinct()
    drive = F.upper(F.regexp_extract("path", r"\A([A-Za-z]:)", 1))
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(depth + 1, F.lit(1))),
        lambda i: F.call_function("substring_index", F.col("path"), F.lit("/"), i),
    )
    above = F.transform(above, lambda d: F.when(d == "", F.lit("/")).otherwise(d))
    candidates = F.when(drive != "", F.array(drive)).otherwise(above)
    steps = paths.select("host", "path", F.explode(F.array_distinct(candidates)).alias("mount"))
    hits = steps.join(disks, ["host", "mount"])
    nearest = first_rows(hits, ["host", "path"], [F.length("mount").desc(), "mount"])
    rest = [c for c in disks.columns if c not in ("host", "mount")]
    return first_rows(nearest.drop("path"), ["host", "mount"], rest or ["mount"])


def report_level(
    totals: DataFrame,
    max_disk: DataFrame,
    runtime_failures: DataFrame,
    unknown_hosts: DataFrame,
    without_rules: DataFrame,
    warn_pct: int = 75,
    crit_pct: int = 90,
) -> DataFrame:
    """Verdict of a retention run: crit, issue, warn or ok."""
    rows = totals.withColumns(
        {
            "max_disk_used_pct": max_disk.select("max_disk_used_pct").scalar(),
            "runtime_failures": runtime_failures.agg(F.count("*")).scalar(),
            "unknown_hosts": unknown_hosts.agg(F.count("*")).scalar(),
            "hosts_without_rules": without_rules.agg(F.count("*")).scalar(),
        }
    )
    issues = [
        "runtime_failures", "unknown_hosts", "total_failed_files", "total_failed_empty_dirs", "total_failed_rules",
        "total_blocked_paths", "total_blocked_rules",
    ]
    issue = F.greatest(*[F.col(c) for c in issues]) > 0
    disk = F.col("max_disk_used_pct")
    level = (
        F.when(disk >= crit_pct, "crit")
        .when(issue, "issue")
        .when((disk >= warn_pct) | (F.col("hosts_without_rules") > 0) | (F.col("total_warning_rules") > 0), "warn")
        .otherwise("ok")
    )
    return rows.withColumn("level", level)


def attachment_plan(
    files: DataFrame, limit_bytes: int, compress: bool = True, archive_bytes: Column | None = None
) -> DataFrame:
    """How audit files go out: none, individual, compressed (archive fits), or share only."""
    sums = files.agg(F.count("*").alias("files"), total("size").alias("total_bytes"))
    over = F.col("total_bytes") > limit_bytes
    packed = F.lit("compress") if archive_bytes is None else F.when(archive_bytes <= limit_bytes, "compressed").otherwise("cifs_only")
    action = (
        F.when(F.col("files") == 0, "none")
        .when(~over, "individual")
        .when(F.lit(compress), packed)
        .otherwise("cifs_only")
    )
    return sums.withColumns({"action": action, "total_mib": tx.mib("total_bytes")})
