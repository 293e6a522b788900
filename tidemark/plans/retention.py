"""Queries over retention rules, file inventories and run results."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import text as tx
from tidemark.operators import common, runs
from tidemark.operators import retention as rt
from tidemark.plans import flows
from tidemark.plans.registry import Inputs, plain, query
from tidemark.session import use_checkpoint_dir
from tidemark.sources import landed, sinks

AS_OF = datetime(2024, 1, 31)
_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

# ---- file inventory and its rules --------------------------------------------------------------------------------

FILES = """SELECT 'host-' || CAST(user_id % 8 AS VARCHAR(20)) AS host,
       '/data/' || event_type || '/u' || CAST(user_id % 50 AS VARCHAR(20)) || '/' ||
       (CASE WHEN event_id % 10 = 0 THEN 'keep-' ELSE 'f' END) || CAST(event_id AS VARCHAR(20)) ||
       (CASE event_id % 4 WHEN 0 THEN '.log' WHEN 1 THEN '.LOG' WHEN 2 THEN '.tmp' ELSE '.csv' END) AS path,
       CAST(round(value*100) AS BIGINT) AS size, ts AS mtime
FROM {events}"""
FAILED_DELETES = f"SELECT host, path FROM ({FILES.replace('AS mtime', 'AS mtime, event_id')}) f WHERE event_id % 17 = 0"

# name | engine | paths | patterns | excludes | hosts | age | recursive | delete_empty_dirs | enabled
FILE_RULES = [
    ("error-logs", "shell", "/data/error/", "*.log", "keep-*", "", "15", True, True, True),
    ("view-tmp", "shell", "/data/view/u1", "*.tmp", "", "", "5", False, False, True),
    ("csv", "modules", "/data", "*.csv", "", "host-1;HOST-2", "10", True, False, True),
    ("overlap", "shell", "/data/error;/data/error/u3", "*.log;*.csv", "", "", "20", True, True, True),
    ("click-upper", "modules", "/data/click/u5/", "*.LOG", "*-1*", "", "3", False, False, True),
    ("purchase-all", "shell", "/data/purchase", "*", "", "", "2", True, True, True),
    ("part-blocked", "shell", "/data/signup/u7;/etc", "f*", "", "", "25", False, False, True),
    ("forbidden", "shell", "/var", "*", "", "", "5", True, False, True),
    ("short", "shell", "/x", "*", "", "", "5", True, False, True),
    ("outside", "shell", "/other/logs", "*", "", "", "5", True, False, True),
    ("no-age", "shell", "/data/view", "*", "", "", "0", True, False, True),
    ("no-paths", "shell", "", "*", "", "", "5", True, False, True),
    ("odd-engine", "x", "/data/view", "*", "", "", "5", True, False, True),
    ("disabled", "shell", "/data", "*", "", "", "1", True, True, False),
]


def _values(rows: list[tuple]) -> str:
    def cell(v: object) -> str:
        return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def file_rules(t: Inputs, own: list[tuple] | None = None) -> DataFrame:
    """The Linux rules, or the Windows rules given."""
    names = "name, engine, paths, patterns, exclude_patterns, hosts, age_days, recursive, delete_empty_dirs, enabled, position"
    rows = [(*row, i + 1) for i, row in enumerate(own or FILE_RULES)]
    rules = t.spark.sql(f"SELECT * FROM VALUES {_values(rows)} AS r({names})".replace("{bs}", "\\\\"))
    prefixes = ["D:\\Data", "\\\\srv\\share"] if own else ["/data"]

    def listed(name: str):
        return F.split(name, ";")

    return rules.withColumns(
        {c: listed(c) for c in ("paths", "patterns", "exclude_patterns", "hosts")}
        | {
            "exclude_hosts": F.lit(None).cast("array<string>"),
            "allowed_prefixes": F.array(*[F.lit(p) for p in prefixes]),
            "position": F.col("position").cast("bigint"),
            "scope": F.lit("global"),
            "application": F.lit("_global"),
            "environment": F.lit(None).cast("string"),
            "os": F.lit("windows" if own else "linux"),
        }
    )


def files(t: Inputs) -> DataFrame:
    return t.sql(FILES)


HOSTS_BY_KIND = "SELECT DISTINCT 'host-' || CAST(user_id % 8 AS VARCHAR(20)) AS host, event_type AS application FROM {events}"


WINDOWS_FILES = """SELECT 'host-' || CAST(user_id % 8 AS VARCHAR(20)) AS host,
       (CASE event_id % 4 WHEN 0 THEN 'D:{bs}Data{bs}' || event_type || '{bs}' WHEN 1 THEN '{bs}{bs}srv{bs}Share{bs}Logs{bs}' || event_type || '{bs}'
        WHEN 2 THEN '{bs}{bs}SRV{bs}share{bs}logs{bs}' || event_type || '/sub/' ELSE 'd:/DATA/' || event_type || '/' END) ||
       (CASE WHEN event_id % 10 = 0 THEN 'Keep-' ELSE 'f' END) || CAST(event_id AS VARCHAR(20)) ||
       (CASE event_id % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.LOG' ELSE '.tmp' END) AS path,
       CAST(round(value*100) AS BIGINT) AS size, ts AS mtime FROM {events}"""
WINDOWS_RULES = [
    ("drive", "shell", "D:{bs}data{bs}Error{bs}", "*.log", "keep-*", "", "10", True, False, True),
    ("share", "shell", "{bs}{bs}Srv{bs}SHARE{bs}Logs", "*.tmp", "", "", "5", True, False, True),
    ("share-flat", "modules", "{bs}{bs}srv{bs}share{bs}logs{bs}click", "*.LOG", "", "", "3", False, False, True),
]


def windows_files(t: Inputs) -> DataFrame:
    return t.sql(WINDOWS_FILES.replace("{bs}", "{{bs}}").replace("{{bs}}", "\\\\"))


def _windows_sql(name: str, order: int, age: int, where: str) -> str:
    return (
        f"SELECT host, '{name}' AS rule_id, CAST({order} AS BIGINT) AS plan_order, path, size, mtime FROM f "
        f"WHERE mtime <= {_AS_OF} - INTERVAL {age} DAY AND {where}"
    )


def file_plan(t: Inputs, own: list[tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """Guarded rules per host, and the rows of rules with an unknown engine."""
    known, unknown = rt.split_engines(resolved_plan(t, own))
    return rt.guard_paths(rt.rule_errors(rt.normalize_rules(known))), unknown


def resolved_plan(t: Inputs, own: list[tuple] | None = None) -> DataFrame:
    prefixes = F.lit(None).cast("map<string,array<string>>").alias("allowed_prefixes")
    matrix = t.sql(HOSTS_BY_KIND).select(
        F.lit("prd").alias("environment"),
        "application",
        F.array("host").alias("members"),
        prefixes,
        F.lit(None).cast("map<string,string>").alias("merge"),
    )
    applications = t.table("events").select(F.col("event_type").alias("application")).distinct().select("application", prefixes)
    plan = rt.resolve_plan(matrix, rt.enabled_rules(file_rules(t, own)), applications, global_rules=True)
    return plan.withColumn("rule_id", F.col("name"))


class Run:
    """An apply run over the inventory, with what the queries below look at."""

    def __init__(self, t: Inputs):
        self.files = files(t)
        self.plan, self.unknown = file_plan(t)
        self.matches = rt.match_files(self.files, self.plan, AS_OF)
        self.survivors, self.ledger = rt.apply_retention(
            self.files, self.matches, t.sql(FAILED_DELETES), mode="apply", confirmed=True
        )


_ORDER = {row[0]: (0 if row[1] == "modules" else 1 << 40) + i + 1 for i, row in enumerate(FILE_RULES)}


def _rule_sql(name: str, age: int, where: str) -> str:
    return (
        f"SELECT host, '{name}' AS rule_id, CAST({_ORDER[name]} AS BIGINT) AS plan_order, path, size, mtime FROM f "
        f"WHERE mtime <= {_AS_OF} - INTERVAL {age} DAY AND {where}"
    )


MATCHES = plain(
    f"WITH raw AS ({FILES}), f AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/[^/]*$', '') AS dir FROM raw), m AS ("
    + " UNION ALL ".join(
        [
            _rule_sql("error-logs", 15, "starts_with(path, '/data/error/') AND base ILIKE '%.log' AND NOT base ILIKE 'keep-%'"),
            _rule_sql("view-tmp", 5, "dir = '/data/view/u1' AND base ILIKE '%.tmp'"),
            _rule_sql("csv", 10, "host IN ('host-1', 'host-2') AND base LIKE '%.csv'"),
            _rule_sql("overlap", 20, "starts_with(path, '/data/error/') AND (base ILIKE '%.log' OR base ILIKE '%.csv')"),
            _rule_sql("click-upper", 3, "dir = '/data/click/u5' AND base LIKE '%.LOG' AND base NOT LIKE '%-1%'"),
            _rule_sql("purchase-all", 2, "starts_with(path, '/data/purchase/')"),
            _rule_sql("part-blocked", 25, "dir = '/data/signup/u7' AND base LIKE 'f%'"),
        ]
    )
    + f"""), failing AS ({FAILED_DELETES}),
ledger AS (SELECT d.host, rule_id, plan_order, d.path, size, mtime, x.path IS NULL AS deleted FROM
  (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY plan_order) AS rn FROM m) d
  LEFT JOIN failing x ON x.host = d.host AND x.path = d.path WHERE rn = 1),
survivors AS (SELECT host, path, size, mtime, dir FROM f WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.deleted AND l.host = f.host AND l.path = f.path)),
counted AS (SELECT host, rule_id, count(*) AS matched_files, count(*) FILTER (WHERE deleted) AS deleted_files, count(*) FILTER (WHERE NOT deleted) AS failed_files,
  CAST(sum(size) AS BIGINT) AS matched_bytes, CAST(coalesce(sum(size) FILTER (WHERE deleted), 0) AS BIGINT) AS deleted_bytes FROM ledger GROUP BY host, rule_id)
"""
)


@query("match_files", MATCHES + "SELECT host, rule_id, plan_order, path, size, mtime FROM m")
def match_files(t: Inputs) -> DataFrame:
    return rt.match_files(files(t), file_plan(t)[0], AS_OF)


@query(
    "match_files_windows",
    "WITH f AS (SELECT *, lower(replace(path, chr(92), '/')) AS key FROM ("
    + plain(WINDOWS_FILES).replace("{bs}", "\\")
    + ")) "
    + " UNION ALL ".join(
        [
            _windows_sql("drive", (1 << 40) + 1, 10, "starts_with(key, 'd:/data/error/') AND key LIKE '%.log' AND key NOT LIKE '%/keep-%'"),
            _windows_sql("share", (1 << 40) + 2, 5, "starts_with(key, '//srv/share/logs/') AND key LIKE '%.tmp'"),
            _windows_sql("share-flat", 3, 3, "regexp_full_match(key, '//srv/share/logs/click/[^/]*') AND path LIKE '%.LOG'"),
        ]
    ),
)
def match_files_windows(t: Inputs) -> DataFrame:
    return rt.match_files(windows_files(t), file_plan(t, WINDOWS_RULES)[0], AS_OF)


@query(
    "expired_files",
    plain(f"SELECT host, path FROM ({FILES}) WHERE mtime <= {_AS_OF} - INTERVAL 15 DAY AND size > 0"),
)
def expired_files(t: Inputs) -> DataFrame:
    return files(t).where(rt.expired("mtime", F.lit(15), AS_OF) & (F.col("size") > 0)).select("host", "path")


@query("retention_ledger", MATCHES + "SELECT host, rule_id, path, size, deleted FROM ledger")
def retention_ledger(t: Inputs) -> DataFrame:
    return Run(t).ledger.select("host", "rule_id", "path", "size", "deleted")


@query("retention_check_mode", MATCHES + "SELECT rule_id, count(*) AS matched, CAST(sum(size) AS BIGINT) AS bytes FROM m GROUP BY rule_id")
def retention_check_mode(t: Inputs) -> DataFrame:
    run = Run(t)
    _, ledger = rt.apply_retention(run.files, run.matches, mode="check")
    return ledger.groupBy("rule_id").agg(F.count("*").alias("matched"), common.total("size").alias("bytes"))


@query("retention_survivors", MATCHES + "SELECT host, path, size, mtime FROM survivors")
def retention_survivors(t: Inputs) -> DataFrame:
    return Run(t).survivors


@query("rule_counters", MATCHES + "SELECT * FROM counted")
def rule_counters(t: Inputs) -> DataFrame:
    return rt.rule_counters(Run(t).ledger)


@query(
    "rule_samples",
    MATCHES
    + """SELECT host, rule_id, path, greatest(n - 5, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY host, rule_id ORDER BY path) AS rn,
       count(*) OVER (PARTITION BY host, rule_id) AS n FROM m) WHERE rn <= 5""",
)
def rule_samples(t: Inputs) -> DataFrame:
    return rt.rule_samples(Run(t).matches, 5)


@query(
    "empty_dirs",
    MATCHES
    + """SELECT host, CASE WHEN starts_with(dir, '/data/error/') THEN 'error-logs' ELSE 'purchase-all' END AS rule_id, dir AS path
FROM (SELECT DISTINCT host, dir FROM f) d WHERE (starts_with(dir, '/data/error/') OR starts_with(dir, '/data/purchase/'))
AND NOT EXISTS (SELECT 1 FROM survivors s WHERE s.host = d.host AND s.dir = d.dir)""",
)
def empty_dirs(t: Inputs) -> DataFrame:
    run = Run(t)
    return rt.empty_dirs(rt.directory_counts(run.files, run.ledger.where("deleted")), run.plan, AS_OF)


_ROW_STATUS = f"""CASE rule_id WHEN 'forbidden' THEN 'blocked' WHEN 'short' THEN 'blocked' WHEN 'outside' THEN 'blocked' WHEN 'no-age' THEN 'blocked'
     WHEN 'no-paths' THEN 'blocked' ELSE CASE WHEN coalesce(failed_files, 0) > 0 THEN 'failed'
     WHEN rule_id NOT IN ('csv', 'click-upper') AND matched_files > 0 AND deleted_files = 0 AND failed_files = 0 THEN 'warning'
     WHEN rule_id = 'part-blocked' THEN 'warning' ELSE 'ok' END END"""
_ROW_DETAIL = f"""CASE rule_id WHEN 'forbidden' THEN '{fv.DETAIL_ALL_BLOCKED}' WHEN 'short' THEN '{fv.DETAIL_ALL_BLOCKED}' WHEN 'outside' THEN '{fv.DETAIL_ALL_BLOCKED}'
     WHEN 'no-age' THEN '{fv.RULE_BAD_AGE}' WHEN 'no-paths' THEN '{fv.RULE_NO_PATHS}'
     ELSE CASE WHEN coalesce(failed_files, 0) > 0 THEN '{fv.DETAIL_FAILED["linux"]}' WHEN rule_id = 'part-blocked' THEN '{fv.DETAIL_SOME_BLOCKED}' ELSE 'ok' END END"""
_RULE_NAMES = ", ".join(f"('{r[0]}')" for r in FILE_RULES if r[0] not in ("odd-engine", "disabled"))


@query(
    "rule_rows",
    MATCHES
    + f"""SELECT host, rule_id, {_ROW_STATUS} AS status, {_ROW_DETAIL} AS status_detail, coalesce(matched_files, 0) AS matched_files,
       coalesce(deleted_files, 0) AS deleted_files, coalesce(failed_files, 0) AS failed_files, coalesce(deleted_bytes, 0) AS deleted_bytes
FROM (SELECT DISTINCT host FROM f) h CROSS JOIN (VALUES {_RULE_NAMES}) r(rule_id) LEFT JOIN counted USING (host, rule_id)
WHERE rule_id <> 'csv' OR host IN ('host-1', 'host-2')
UNION ALL SELECT DISTINCT host, 'odd-engine', 'blocked', '{fv.UNKNOWN_ENGINE_DETAIL}', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM f""",
)
def rule_rows(t: Inputs) -> DataFrame:
    run = Run(t)
    rows = runs.rule_rows(run.plan, rt.rule_counters(run.ledger), apply=True)
    shown = ["host", "rule_id", "status", "status_detail", "matched_files", "deleted_files", "failed_files", "deleted_bytes"]
    zeros = {c: F.lit(0).cast("bigint") for c in shown[4:]}
    return rows.select(*shown).unionByName(run.unknown.withColumns(zeros).select(*shown))


# ---- path guard over many rules ----------------------------------------------------------------------------------

# "#" stands for the Windows separator.
GUARD_RULES = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'windows' ELSE 'linux' END AS os,
       CASE WHEN p_size % 2 = 0 THEN 'modules' ELSE 'shell' END AS engine,
       translate(CASE WHEN p_partkey % 3 = 0 THEN
         (CASE p_partkey % 4 WHEN 0 THEN 'C:#Windows#;' WHEN 1 THEN 'C:#;' WHEN 2 THEN 'c:#data;' ELSE 'D:#x;' END) || 'C:#DATA#' || p_brand || '#;E:#logs#' || p_type
       ELSE
         (CASE p_partkey % 7 WHEN 0 THEN '/var/;' WHEN 1 THEN '/x;' WHEN 2 THEN '//;' WHEN 3 THEN '/data;' WHEN 4 THEN ' ;' ELSE '/database/y;' END)
         || '/data/' || p_brand || '//; /srv/' || p_type || ' ;/data/' || p_brand || '/' END, '#', chr(92)) AS paths,
       translate(CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN 'c:#Data#' ELSE '/data/;/srv/ECONOMY' END, '#', chr(92)) AS prefixes,
       CASE p_partkey % 13 WHEN 0 THEN '0' WHEN 1 THEN '7.5' WHEN 2 THEN NULL ELSE CAST(p_size AS VARCHAR(20)) END AS age_days,
       CASE p_partkey % 17 WHEN 0 THEN '' ELSE '*.log;*.txt' END AS patterns
FROM {part}"""


def guard_rules(t: Inputs) -> DataFrame:
    rules = t.sql(GUARD_RULES)
    none = F.lit(None).cast("array<string>")
    rules = rules.withColumns(
        {
            "paths": F.split("paths", ";"),
            "patterns": F.split("patterns", ";"),
            "allowed_prefixes": F.split("prefixes", ";"),
            "exclude_patterns": none,
            "recursive": F.lit(True),
            "delete_empty_dirs": F.lit(False),
        }
    )
    return rt.normalize_rules(rules)


def _guard_oracle(required: bool) -> str:
    needed = f"WHEN NOT has_prefixes THEN '{fv.PATH_PREFIX_REQUIRED}'" if required else ""
    linux = "('" + "', '".join(fv.FORBIDDEN_LINUX) + "')"
    windows_modules = "('c:\\', 'd:\\', 'e:\\', 'c:\\windows', 'c:\\program files', 'c:\\program files (x86)', 'c:\\users')"
    windows_shell = "('c:', 'd:', 'e:', 'c:\\windows', 'c:\\program files', 'c:\\program files (x86)', 'c:\\users')"
    return plain(
        f"""WITH g AS ({GUARD_RULES}),
p AS (SELECT p_partkey, os, engine, trim(prefixes) <> '' AS has_prefixes, u.i, trim(u.raw) AS raw FROM g, LATERAL (SELECT unnest(string_split(paths, ';')) AS raw, unnest(generate_series(1, len(string_split(paths, ';')))) AS i) u),
n AS (SELECT *, CASE WHEN os = 'linux' THEN CASE WHEN length(raw) > 1 THEN rtrim(raw, '/') ELSE raw END
        WHEN engine = 'modules' AND length(raw) > 3 THEN rtrim(raw, '\\/') ELSE raw END AS path,
      CASE WHEN os = 'linux' THEN CASE WHEN length(raw) > 1 THEN rtrim(raw, '/') ELSE raw END
        WHEN engine = 'modules' AND length(raw) <= 3 THEN lower(raw) ELSE lower(rtrim(raw, '\\/')) END AS cmp FROM p WHERE raw <> ''),
v AS (SELECT *, CASE WHEN path = '' THEN '{fv.PATH_EMPTY}'
   WHEN length(path) < CASE os WHEN 'linux' THEN 4 ELSE 6 END THEN '{fv.PATH_TOO_SHORT}'
   WHEN os = 'linux' AND cmp IN {linux} OR os = 'windows' AND engine = 'modules' AND cmp IN {windows_modules} OR os = 'windows' AND engine = 'shell' AND cmp IN {windows_shell} THEN '{fv.PATH_FORBIDDEN}'
   {needed}
   WHEN has_prefixes AND NOT (CASE WHEN os = 'linux' THEN cmp = '/data' OR starts_with(cmp, '/data/') OR cmp = '/srv/ECONOMY' OR starts_with(cmp, '/srv/ECONOMY/')
        ELSE cmp = 'c:\\data' OR starts_with(cmp, 'c:\\data\\') OR starts_with(cmp, 'c:\\data/') END) THEN '{fv.PATH_OUTSIDE}' END AS reason FROM n),
firsts AS (SELECT p_partkey, path, min(i) AS i FROM v WHERE reason IS NULL GROUP BY p_partkey, path)
SELECT g.p_partkey, coalesce((SELECT string_agg(path, '|' ORDER BY i) FROM firsts f WHERE f.p_partkey = g.p_partkey), '') AS allowed,
       coalesce((SELECT string_agg(path || '=' || reason, '|' ORDER BY i) FROM v WHERE v.p_partkey = g.p_partkey AND reason IS NOT NULL), '') AS blocked
FROM g"""
    )


def _guard_view(guarded: DataFrame) -> DataFrame:
    blocked = F.transform("blocked", lambda b: F.concat(b["path"], F.lit("="), b["reason"]))
    return guarded.select(
        "p_partkey", F.array_join("allowed", "|").alias("allowed"), F.array_join(blocked, "|").alias("blocked")
    )


@query("guard_paths", _guard_oracle(required=False))
def guard_paths(t: Inputs) -> DataFrame:
    return _guard_view(rt.guard_paths(guard_rules(t)))


@query("guard_paths_prefix_required", _guard_oracle(required=True))
def guard_paths_prefix_required(t: Inputs) -> DataFrame:
    return _guard_view(rt.guard_paths(guard_rules(t), required=True))


@query(
    "rule_errors",
    plain(
        f"""SELECT p_partkey, concat_ws(' ', CASE WHEN patterns = '' THEN '{fv.RULE_NO_PATTERNS}' END,
       CASE WHEN age_days IS NULL OR (engine = 'shell' AND NOT regexp_full_match(age_days, '[0-9]+')) OR trunc(CAST(age_days AS DOUBLE)) = 0 THEN '{fv.RULE_BAD_AGE}' END) AS errors FROM ({GUARD_RULES})"""
    ),
)
def rule_errors(t: Inputs) -> DataFrame:
    return rt.rule_errors(guard_rules(t)).select("p_partkey", F.array_join("fatal_errors", " ").alias("errors"))


@query(
    "trimmed_paths",
    plain(
        f"""SELECT p_partkey, trim(raw) AS path, CASE WHEN length(trim(raw)) > 1 THEN rtrim(trim(raw), '/') ELSE trim(raw) END AS linux,
  rtrim(trim(raw), '\\/') AS windows, CASE WHEN length(trim(raw)) > 3 THEN rtrim(trim(raw), '\\/') ELSE trim(raw) END AS windows_modules
FROM (SELECT p_partkey, unnest(string_split(paths, ';')) AS raw FROM ({GUARD_RULES}))"""
    ),
)
def trimmed_paths(t: Inputs) -> DataFrame:
    paths = t.sql(GUARD_RULES).select("p_partkey", F.explode(F.split("paths", ";")).alias("path"))
    return paths.select(
        "p_partkey",
        F.trim("path").alias("path"),
        tx.trim_path("path").alias("linux"),
        tx.trim_path("path", "windows").alias("windows"),
        tx.trim_path("path", "windows", "modules").alias("windows_modules"),
    )


ALLOWED_PATHS = """SELECT 'host-' || CAST(p_partkey % 40 AS VARCHAR(20)) AS host, 'rule-' || CAST(p_partkey AS VARCHAR(20)) AS rule,
       '/data/' || p_brand || '/' || p_type AS path FROM {part}"""
LISTING = """SELECT DISTINCT 'host-' || CAST(p_partkey % 40 AS VARCHAR(20)) AS host, '/data/' || p_brand || '/' || p_type AS path,
       CASE p_type WHEN 'SMALL' THEN FALSE WHEN 'LARGE' THEN NULL ELSE TRUE END AS is_dir,
       CASE WHEN p_type = 'LARGE' THEN 'stat: Permission denied' WHEN p_type = 'SMALL' AND p_brand = 'Brand#3' THEN 'I/O error' END AS message
FROM {part} WHERE p_type <> 'PROMO'"""


@query(
    "path_state",
    plain(
        f"""SELECT a.host, a.rule, a.path, CASE WHEN l.path IS NULL THEN 'missing' WHEN message LIKE '%Permission%' THEN 'error' WHEN is_dir THEN 'existing'
       WHEN message IS NOT NULL THEN 'error' ELSE 'missing' END AS state,
       CASE WHEN l.path IS NULL THEN '{fv.PATH_NOT_FOUND}' WHEN message LIKE '%Permission%' THEN '{fv.PATH_DENIED}' WHEN is_dir THEN NULL
       WHEN message IS NOT NULL THEN 'falha ao validar o path: ' || message ELSE '{fv.PATH_NOT_DIRECTORY}' END AS reason
FROM ({ALLOWED_PATHS}) a LEFT JOIN ({LISTING}) l ON a.host = l.host AND a.path = l.path"""
    ),
)
def path_state(t: Inputs) -> DataFrame:
    rules = t.sql(ALLOWED_PATHS).select("host", "rule", F.array("path").alias("allowed"))
    return rt.path_state(rules, t.sql(LISTING))


# ---- plan resolution ---------------------------------------------------------------------------------------------

MEMBERS = """SELECT r_name AS environment, n_name AS application, s_name AS member, s_suppkey, n_nationkey, r_regionkey
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
PLAN_RULES = """SELECT CASE p_type WHEN 'SMALL' THEN 'global' WHEN 'PROMO' THEN 'environment_overlay' ELSE 'application' END AS scope,
       CASE WHEN p_type = 'SMALL' THEN '_global' ELSE 'Nation_' || CAST(b % 25 AS VARCHAR(20)) END AS application,
       CASE WHEN p_type = 'PROMO' THEN r_name END AS environment,
       CASE WHEN p_type = 'LARGE' THEN 'windows' ELSE 'linux' END AS os, p_brand || '/' || p_type AS name, b AS position,
       CASE WHEN b % 2 = 0 THEN 'modules' END AS engine,
       CASE WHEN p_type = 'MEDIUM' THEN 'supplier#000000001, SUPPLIER#000000026,Supplier#000000051' WHEN p_type = 'SMALL' AND b % 3 = 0 THEN 'supplier#000000007' ELSE '' END AS hosts,
       CASE WHEN p_type = 'ECONOMY' THEN 'Supplier#000000002,supplier#000000027' ELSE '' END AS exclude_hosts,
       CASE WHEN p_type = 'SMALL' AND b % 2 = 0 THEN '/global' END AS prefix
FROM (SELECT DISTINCT p_brand, p_type, CAST(substr(p_brand, 7) AS BIGINT) AS b FROM {part}) p JOIN {region} ON r_regionkey = b % 4"""
APP_PREFIXES = "SELECT n_name AS application, CASE WHEN n_nationkey % 2 = 0 THEN '/srv/' || n_name END AS prefix FROM {nation}"
ASKED = """SELECT CASE WHEN s_suppkey % 10 = 5 THEN 'Outside-' || CAST(s_suppkey AS VARCHAR(20)) ELSE s_name END AS host FROM {supplier} WHERE s_suppkey % 5 = 0"""


def _map_of(key: str, value) -> Column:
    return F.when(value.isNotNull(), F.create_map(F.lit(key), value))


def plan_matrix(t: Inputs) -> DataFrame:
    rows = t.sql(MEMBERS)
    prefix = F.when(F.col("r_regionkey") == 1, F.array(F.concat(F.lit("/data/"), "environment")))
    return rows.select(
        "environment",
        "application",
        F.array("member").alias("members"),
        _map_of("linux", prefix).alias("allowed_prefixes"),
        _map_of("linux", F.when(F.col("n_nationkey") % 5 == 0, F.lit("replace"))).alias("merge"),
    )


def plan_rules_input(t: Inputs) -> DataFrame:
    rules = t.sql(PLAN_RULES)
    return rules.withColumns(
        {
            "hosts": F.split("hosts", ","),
            "exclude_hosts": F.split("exclude_hosts", ","),
            "allowed_prefixes": F.when(F.col("prefix").isNotNull(), F.array("prefix")),
        }
    ).drop("prefix")


def plan_applications(t: Inputs) -> DataFrame:
    rows = t.sql(APP_PREFIXES)
    return rows.select(
        "application", _map_of("linux", F.when(F.col("prefix").isNotNull(), F.array("prefix"))).alias("allowed_prefixes")
    )


PLAN = plain(
    f"""WITH m AS (SELECT *, lower(member) AS host, lower(application) AS app, lower(environment) AS env FROM ({MEMBERS})),
r AS (SELECT *, lower(application) AS app, lower(environment) AS env,
  list_filter(list_transform(string_split(hosts, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS inc,
  list_filter(list_transform(string_split(exclude_hosts, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS exc FROM ({PLAN_RULES})),
a AS (SELECT lower(application) AS app, prefix FROM ({APP_PREFIXES}))
"""
)
_APPLIES = "(len(inc) = 0 OR list_contains(inc, host)) AND NOT list_contains(exc, host)"
_BOTH = """CASE WHEN os = 'windows' THEN 'd:/x' ELSE coalesce(nullif(concat_ws('|', a.prefix, CASE WHEN r_regionkey = 1 THEN '/data/' || m.environment END), ''), '/default') END"""
_DEFAULTS = {"linux": ["/default"], "windows": ["d:/x"]}


@query(
    "plan_rules",
    PLAN
    + f"""SELECT host, r.app AS application, 'global' AS environment, os, 'global' AS source, name, coalesce(engine, 'shell') AS engine, coalesce(prefix, '/default') AS prefixes
FROM (SELECT DISTINCT host FROM m) h JOIN r ON r.scope = 'global' WHERE {_APPLIES}
UNION ALL SELECT host, m.app, m.env, os, 'application', name, coalesce(engine, 'shell'), {_BOTH}
FROM m JOIN r ON r.app = m.app AND r.scope = 'application' JOIN a ON a.app = m.app WHERE {_APPLIES} AND NOT (os = 'linux' AND n_nationkey % 5 = 0)
UNION ALL SELECT host, m.app, m.env, os, 'environment_overlay', name, coalesce(engine, 'shell'), {_BOTH}
FROM m JOIN r ON r.app = m.app AND r.scope = 'environment_overlay' AND r.env = m.env JOIN a ON a.app = m.app WHERE {_APPLIES}""",
)
def plan_rules(t: Inputs) -> DataFrame:
    plan = rt.resolve_plan(
        plan_matrix(t), plan_rules_input(t), plan_applications(t), global_rules=True, default_prefixes=_DEFAULTS
    )
    return _plan_view(plan)


def _plan_view(plan: DataFrame) -> DataFrame:
    shown = F.array_join("allowed_prefixes", "|").alias("prefixes")
    return plan.select("host", "application", "environment", "os", "source", "name", "engine", shown)


_SELECTED = "('nation_1', 'nation_2', 'nation_3')"


@query(
    "plan_rules_adhoc",
    PLAN
    + f""", h AS (SELECT DISTINCT lower(host) AS host FROM ({plain(ASKED)})), placed AS (SELECT m.* FROM m JOIN h ON m.host = h.host WHERE m.app IN {_SELECTED})
SELECT m.host, m.app AS application, m.env AS environment, os, 'application' AS source, name, coalesce(engine, 'shell') AS engine, {_BOTH} AS prefixes
FROM placed m JOIN r ON r.app = m.app AND r.scope = 'application' JOIN a ON a.app = m.app WHERE {_APPLIES} AND NOT (os = 'linux' AND n_nationkey % 5 = 0)
UNION ALL SELECT m.host, m.app, m.env, os, 'environment_overlay', name, coalesce(engine, 'shell'), {_BOTH}
FROM placed m JOIN r ON r.app = m.app AND r.scope = 'environment_overlay' AND r.env = m.env JOIN a ON a.app = m.app WHERE {_APPLIES}
UNION ALL SELECT h.host, r.app, 'adhoc', os, 'application_adhoc', name, coalesce(engine, 'shell'),
       CASE WHEN os = 'windows' THEN 'd:/x' ELSE coalesce(a.prefix, '/default') END
FROM h JOIN r ON r.scope = 'application' AND r.app IN {_SELECTED} JOIN a ON a.app = r.app WHERE h.host NOT IN (SELECT host FROM placed) AND {_APPLIES}""",
)
def plan_rules_adhoc(t: Inputs) -> DataFrame:
    plan = rt.resolve_plan(
        plan_matrix(t),
        plan_rules_input(t),
        plan_applications(t),
        asked=t.sql(ASKED),
        selected=["nation_1", "NATION_2", "nation_3"],
        allow_adhoc=True,
        default_prefixes=_DEFAULTS,
    )
    return _plan_view(plan)


@query(
    "plan_hosts_without_rules",
    PLAN + f"SELECT DISTINCT lower(host) AS host FROM ({plain(ASKED)}) WHERE lower(host) NOT IN (SELECT host FROM m)",
)
def plan_hosts_without_rules(t: Inputs) -> DataFrame:
    asked = t.sql(ASKED)
    members = rt.plan_memberships(plan_matrix(t), asked)
    plan = rt.resolve_plan(plan_matrix(t), plan_rules_input(t), plan_applications(t), asked=asked)
    return rt.hosts_without_rules(asked, members, plan)


@query(
    "unknown_names",
    plain(f"SELECT DISTINCT host FROM ({ASKED}) WHERE host NOT IN (SELECT s_name FROM supplier)"),
)
def unknown_names(t: Inputs) -> DataFrame:
    known = t.table("supplier").select(F.col("s_name").alias("host"))
    return rt.unknown_names(t.sql(ASKED), known, "host")


PROBES = "SELECT s_name AS host, CAST(s_suppkey % {m} AS INT) AS elapsed FROM {supplier} WHERE s_suppkey % {skip} <> 0"
SSH_PROBES = PROBES.replace("{m}", "5").replace("{skip}", "7")
WINRM_PROBES = PROBES.replace("{m}", "8").replace("{skip}", "2")


@query(
    "classify_hosts",
    plain(
        f"""SELECT s_name AS host, CASE WHEN w.elapsed < 3 THEN 'windows' WHEN s.elapsed < 3 THEN 'linux' ELSE 'unknown' END AS os
FROM supplier LEFT JOIN ({SSH_PROBES}) s ON s.host = s_name LEFT JOIN ({WINRM_PROBES}) w ON w.host = s_name"""
    ),
)
def classify_hosts(t: Inputs) -> DataFrame:
    targets = t.table("supplier").select(F.col("s_name").alias("host"))
    return rt.classify_hosts(targets, t.sql(SSH_PROBES), t.sql(WINRM_PROBES))


# ---- run results -------------------------------------------------------------------------------------------------

RULE_ROWS = """SELECT 'host-' || CAST(l_suppkey AS VARCHAR(20)) AS host, 'rule-' || CAST(l_linenumber AS VARCHAR(20)) AS rule,
       CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'failed' WHEN l_partkey % 10 = 0 THEN 'warning' WHEN l_partkey % 101 = 0 THEN 'blocked' ELSE 'ok' END AS status,
       CAST(l_quantity AS BIGINT) AS matched_files, CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS deleted_files,
       CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END AS failed_files,
       CAST(round(l_extendedprice*100) AS BIGINT) * 1000 AS matched_bytes,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(round(l_extendedprice*100) AS BIGINT) * 1000 END AS deleted_bytes,
       l_linenumber % 2 AS removed_empty_dirs, CASE WHEN l_partkey % 500 = 0 THEN 1 ELSE 0 END AS failed_empty_dirs,
       CASE WHEN l_partkey % 10 = 0 THEN l_linenumber % 3 ELSE 0 END AS n_blocked, CASE WHEN l_partkey % 15 = 0 THEN 2 ELSE 0 END AS n_missing
FROM {lineitem}"""
_ROWS = plain(f"WITH r AS ({RULE_ROWS}) ")


def run_rows(t: Inputs) -> DataFrame:
    rows = t.sql(RULE_ROWS)

    def reasons(count: str, folder: str, reason: str) -> Column:
        item = lambda i: F.struct(F.concat(F.lit(folder), i.cast("string")).alias("path"), F.lit(reason).alias("reason"))
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(1), F.col(count)), item)).otherwise(
            F.array().cast("array<struct<path:string,reason:string>>")
        )

    return rows.withColumns(
        {
            "blocked": reasons("n_blocked", "/etc/", fv.PATH_OUTSIDE),
            "missing": reasons("n_missing", "/gone/", fv.PATH_NOT_FOUND),
            **{c: F.col(c).cast("bigint") for c in runs.COUNTERS},
        }
    ).drop("n_blocked", "n_missing")


HOST_STATES = """SELECT 'host-' || CAST(s_suppkey AS VARCHAR(20)) AS host, s_suppkey % 9 <> 0 AS started, s_suppkey % 4 <> 0 AS completed,
       s_suppkey % 8 = 0 AS failure_recorded FROM {supplier}"""

_TOTALS = """count(*) AS total_rules, CAST(sum(matched_files) AS BIGINT) AS total_matched_files, CAST(sum(deleted_files) AS BIGINT) AS total_deleted_files,
  CAST(sum(failed_files) AS BIGINT) AS total_failed_files, CAST(sum(matched_bytes) AS BIGINT) AS total_matched_bytes, CAST(sum(deleted_bytes) AS BIGINT) AS total_deleted_bytes,
  CAST(sum(removed_empty_dirs) AS BIGINT) AS total_removed_empty_dirs, CAST(sum(failed_empty_dirs) AS BIGINT) AS total_failed_empty_dirs,
  CAST(sum(n_blocked) AS BIGINT) AS total_blocked_paths, CAST(sum(n_missing) AS BIGINT) AS total_missing_paths,
  count(*) FILTER (WHERE status = 'failed') AS total_failed_rules, count(*) FILTER (WHERE status = 'warning') AS total_warning_rules,
  count(*) FILTER (WHERE status = 'blocked') AS total_blocked_rules, (SELECT count(*) FROM supplier) AS total_hosts"""


@query("run_totals", _ROWS + f"SELECT {_TOTALS} FROM r")
def run_totals(t: Inputs) -> DataFrame:
    return runs.run_totals(run_rows(t), t.sql(HOST_STATES))


@query(
    "host_totals",
    _ROWS
    + """SELECT host, CAST(sum(matched_files) AS BIGINT) AS matched_files, CAST(sum(matched_bytes) AS BIGINT) AS matched_bytes, CAST(sum(deleted_files) AS BIGINT) AS deleted_files,
  CAST(sum(deleted_bytes) AS BIGINT) AS deleted_bytes, CAST(sum(failed_files) AS BIGINT) AS failed_files FROM r GROUP BY host HAVING sum(deleted_files) > 0 OR sum(deleted_bytes) > 0""",
)
def host_totals(t: Inputs) -> DataFrame:
    return runs.host_totals(run_rows(t))


@query(
    "rule_savings",
    _ROWS + "SELECT host, rule, CAST(deleted_files AS BIGINT) AS deleted_files, deleted_bytes FROM r WHERE deleted_files > 0 OR deleted_bytes > 0",
)
def rule_savings(t: Inputs) -> DataFrame:
    return runs.rule_savings(run_rows(t)).select("host", "rule", "deleted_files", "deleted_bytes")


_HUMAN = """CASE WHEN b >= 1099511627776 THEN format('{:.2f}', b / 1099511627776.0) || ' TB' WHEN b >= 1073741824 THEN format('{:.2f}', b / 1073741824.0) || ' GB'
  WHEN b >= 1048576 THEN format('{:.2f}', b / 1048576.0) || ' MB' WHEN b >= 1024 THEN format('{:.2f}', b / 1024.0) || ' KB' ELSE b || ' B' END"""


@query(
    "host_savings",
    _ROWS + f"SELECT host, b AS saved_bytes, {_HUMAN} AS saved FROM (SELECT host, CAST(sum(deleted_bytes) AS BIGINT) AS b FROM r GROUP BY host)",
)
def host_savings(t: Inputs) -> DataFrame:
    return runs.host_savings(run_rows(t), apply=True)


@query(
    "host_savings_check",
    _ROWS + f"SELECT host, b AS saved_bytes, {_HUMAN} AS saved FROM (SELECT host, CAST(sum(matched_bytes) AS BIGINT) AS b FROM r GROUP BY host)",
)
def host_savings_check(t: Inputs) -> DataFrame:
    return runs.host_savings(run_rows(t), apply=False)


@query(
    "audit_entries",
    _ROWS
    + """, d AS (SELECT host, CAST(sum(deleted_files) AS BIGINT) AS deleted_files FROM r GROUP BY host),
x AS (SELECT host, 2 * count(DISTINCT rule) AS missing_paths FROM r WHERE n_missing > 0 GROUP BY host)
SELECT host, deleted_files, coalesce(missing_paths, 0) AS missing_paths, deleted_files + coalesce(missing_paths, 0) AS audit_entries FROM d LEFT JOIN x USING (host)""",
)
def audit_entries(t: Inputs) -> DataFrame:
    return runs.audit_entries(run_rows(t))


_STATES = plain(f", s AS ({HOST_STATES}) ")


@query(
    "complete_reports",
    _ROWS
    + _STATES
    + f"""SELECT host, rule, status, '' AS status_detail, matched_files, deleted_bytes FROM r
UNION ALL SELECT host, '{fv.RULE_INTERRUPTED}', 'failed', '{fv.RULE_INTERRUPTED_DETAIL}', 0, 0 FROM s WHERE started AND NOT completed AND NOT failure_recorded""",
)
def complete_reports(t: Inputs) -> DataFrame:
    rows = run_rows(t).withColumn("status_detail", F.lit(""))
    done = runs.complete_reports(t.sql(HOST_STATES), rows)
    return done.select("host", "rule", "status", "status_detail", "matched_files", "deleted_bytes")


@query(
    "host_reports",
    _ROWS + _STATES + "SELECT s.host, count(r.host) AS rows FROM s LEFT JOIN r ON r.host = s.host AND r.status <> 'ok' GROUP BY s.host",
)
def host_reports(t: Inputs) -> DataFrame:
    return runs.host_reports(t.sql(HOST_STATES), run_rows(t).where("status <> 'ok'"))


@query(
    "runtime_failed_hosts",
    plain(f"SELECT host FROM ({HOST_STATES}) WHERE failure_recorded OR (started AND NOT completed)"),
)
def runtime_failed_hosts(t: Inputs) -> DataFrame:
    return runs.runtime_failed_hosts(t.sql(HOST_STATES))


_DISK = """SELECT 'host-' || CAST(CAST(floor(s_suppkey / 3) AS BIGINT) AS VARCHAR(20)) AS host, CASE s_suppkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '/data' ELSE '/data/Brand#1' END AS mount,
       CAST(round(abs(s_acctbal)*100) AS BIGINT) % {mod} AS used_pct, CAST(round(abs(s_acctbal)*100) AS BIGINT) * {free} AS free_bytes FROM {supplier} WHERE {kept}"""
DISK_BEFORE = _DISK.replace("{mod}", "100").replace("{free}", "1024").replace("{kept}", "s_suppkey % 10 <> 9")
DISK_AFTER = _DISK.replace("{mod}", "80").replace("{free}", "2048").replace("{kept}", "s_suppkey % 4 <> 3")


def disks(t: Inputs) -> DataFrame:
    before = t.sql(DISK_BEFORE).withColumn("phase", F.lit("before"))
    return before.unionByName(t.sql(DISK_AFTER).withColumn("phase", F.lit("after")))


_BAND = "CASE WHEN {c} >= 90 THEN 'crit' WHEN {c} >= 75 THEN 'warn' ELSE 'ok' END"


@query(
    "disk_delta",
    plain(
        f"""SELECT b.host, b.mount, b.used_pct, a.used_pct AS used_pct_after, {_BAND.replace("{c}", "b.used_pct")} AS band_before,
       CASE WHEN a.used_pct IS NOT NULL THEN {_BAND.replace("{c}", "a.used_pct")} END AS band_after, b.free_bytes, a.free_bytes AS free_bytes_after,
       a.free_bytes - b.free_bytes AS freed_bytes FROM ({DISK_BEFORE}) b LEFT JOIN ({DISK_AFTER}) a ON a.host = b.host AND a.mount = b.mount"""
    ),
)
def disk_delta(t: Inputs) -> DataFrame:
    return runs.disk_delta(t.sql(DISK_BEFORE), t.sql(DISK_AFTER))


MAX_DISK = plain(
    f"""WITH b AS (SELECT host, max(used_pct) AS pct FROM ({DISK_BEFORE}) GROUP BY host), a AS (SELECT host, max(used_pct) AS pct FROM ({DISK_AFTER}) GROUP BY host)
SELECT CAST(max(coalesce(a.pct, b.pct)) AS BIGINT) AS max_disk_used_pct FROM b FULL JOIN a ON a.host = b.host"""
)


@query("max_disk_pct", MAX_DISK)
def max_disk_pct(t: Inputs) -> DataFrame:
    return runs.max_disk_pct(disks(t), apply=True)


MOUNT_RULES = """SELECT 'host-' || CAST(p_partkey % 30 AS VARCHAR(20)) AS host, CASE WHEN p_partkey % 9 = 0 THEN 'c:/x/' || p_name ELSE '/data/' || p_brand || '/logs' END AS path,
       p_partkey % 6 <> 0 AS enabled FROM {part}"""
DRIVES = "SELECT 'host-' || CAST(s_suppkey AS VARCHAR(20)) AS host, 'C:' AS mount, CAST(55 AS BIGINT) AS used_pct, s_suppkey * 1000 AS free_bytes FROM {supplier}"


@query(
    "mounts_for_rules",
    plain(
        f"""WITH d AS ({DISK_BEFORE} UNION ALL {DRIVES}), p AS (SELECT DISTINCT host, path FROM ({MOUNT_RULES}) WHERE enabled),
h AS (SELECT p.host, p.path, d.mount, d.used_pct, d.free_bytes, row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(d.mount) DESC) AS rn
  FROM p JOIN d ON p.host = d.host AND (CASE WHEN p.path LIKE 'c:%' THEN d.mount = 'C:' ELSE d.mount = '/' OR p.path = d.mount OR starts_with(p.path, d.mount || '/') END))
SELECT DISTINCT host, mount, used_pct, free_bytes FROM h WHERE rn = 1"""
    ),
)
def mounts_for_rules(t: Inputs) -> DataFrame:
    rules = t.sql(MOUNT_RULES).withColumn("paths", F.array("path"))
    return runs.mounts_for_rules(rules, t.sql(DISK_BEFORE).unionByName(t.sql(DRIVES)))


@query(
    "report_level",
    _ROWS
    + _STATES
    + f"""SELECT CASE WHEN d.max_disk_used_pct >= 90 THEN 'crit'
  WHEN (SELECT count(*) FROM s WHERE failure_recorded OR (started AND NOT completed)) + x.total_failed_files + x.total_failed_empty_dirs + x.total_failed_rules + x.total_blocked_paths + x.total_blocked_rules > 0 THEN 'issue'
  WHEN d.max_disk_used_pct >= 75 OR x.total_warning_rules > 0 THEN 'warn' ELSE 'ok' END AS level, d.max_disk_used_pct, x.total_rules,
  (SELECT count(*) FROM s WHERE failure_recorded OR (started AND NOT completed)) AS runtime_failures
FROM (SELECT {_TOTALS} FROM r) x, ({MAX_DISK}) d""",
)
def report_level(t: Inputs) -> DataFrame:
    states = t.sql(HOST_STATES)
    none = states.limit(0)
    level = runs.report_level(
        runs.run_totals(run_rows(t), states), runs.max_disk_pct(disks(t), True), runs.runtime_failed_hosts(states), none, none
    )
    return level.select("level", "max_disk_used_pct", "total_rules", "runtime_failures")


# ---- log lines and artefacts -------------------------------------------------------------------------------------

TAGGED_LINES = """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'DPM_MATCHED=' || CAST(l_partkey AS VARCHAR(20))
       WHEN 2 THEN 'DPM_SAMPLE=/data/' || CAST(l_suppkey AS VARCHAR(20)) || '/a=b.log'
       WHEN 3 THEN 'DPM_ERROR=/data/x|falha ao remover arquivo'
       WHEN 4 THEN 'DPM_DISK=/dev/sda|/data|' || CAST(l_partkey AS VARCHAR(20)) || '|' || CAST(l_suppkey AS VARCHAR(20)) || '|7|42'
       WHEN 5 THEN 'DPM_DISK=C:|' || CAST(l_partkey AS VARCHAR(20)) || '|5|6|bad'
       ELSE 'unrelated text' END AS value FROM {lineitem}"""


@query(
    "parse_tagged_lines",
    plain(
        f"""WITH l AS (SELECT *, split_part(substr(value, 5), '=', 1) AS key, substr(value, position('=' IN value) + 1) AS text FROM ({TAGGED_LINES}) WHERE starts_with(value, 'DPM_')),
p AS (SELECT *, string_split(text, '|') AS x FROM l)
SELECT l_orderkey, l_linenumber, key, text, TRY_CAST(CASE WHEN regexp_full_match(text, '[0-9]+') THEN text END AS BIGINT) AS number,
  CASE WHEN key = 'DISK' THEN x[1] END AS filesystem, CASE WHEN key = 'DISK' THEN CASE WHEN len(x) = 6 THEN x[2] ELSE x[1] END END AS mount,
  CASE WHEN key = 'DISK' THEN CASE WHEN len(x) = 6 THEN CAST(x[3] AS BIGINT) * 1024 ELSE CAST(x[2] AS BIGINT) END END AS size_bytes,
  CASE WHEN key = 'DISK' THEN CASE WHEN len(x) = 6 THEN CAST(x[4] AS BIGINT) * 1024 ELSE CAST(x[3] AS BIGINT) END END AS used_bytes,
  CASE WHEN key = 'DISK' THEN CASE WHEN len(x) = 6 THEN CAST(x[5] AS BIGINT) * 1024 ELSE CAST(x[4] AS BIGINT) END END AS free_bytes,
  CASE WHEN key = 'DISK' THEN CASE WHEN len(x) = 6 THEN CAST(x[6] AS BIGINT) ELSE CAST(0 AS BIGINT) END END AS used_pct FROM p"""
    ),
)
def parse_tagged_lines(t: Inputs) -> DataFrame:
    return landed.parse_tagged_lines(t.sql(TAGGED_LINES)).drop("value")


@query(
    "audit_parse",
    plain(f"SELECT '31/01/2024 00:00:00 UTC' AS ts, host, 'linux' AS os, 'r | ' || right(path, 3) AS rule, size AS bytes, path FROM ({FILES})"),
)
def audit_parse(t: Inputs) -> DataFrame:
    lines = files(t).select(
        tx.audit_text(
            F.lit("31/01/2024 00:00:00 UTC"), "host", F.lit("linux"), F.concat(F.lit("r | "), F.right("path", F.lit(3))), "size", "path"
        ).alias("value")
    )
    return landed.parse_audit(lines)


@query(
    "audit_written",
    plain(f"SELECT '31/01/2024 00:00:00 UTC' AS ts, host, 'linux' AS os, 'expired' AS rule, size AS bytes, path FROM ({FILES}) WHERE mtime <= {_AS_OF} - INTERVAL 15 DAY"),
)
def audit_written(t: Inputs) -> DataFrame:
    """Expired files written as audit lines and read back from them."""
    gone = files(t).where(rt.expired("mtime", F.lit(15), AS_OF)).select(
        F.lit("31/01/2024 00:00:00 UTC").alias("ts"), "host", F.lit("linux").alias("os"), F.lit("expired").alias("rule"), "size", "path"
    )
    folder = f"{use_checkpoint_dir(t.spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    sinks.write_audit(gone, folder)
    return landed.parse_audit(t.spark.read.text(folder))


@query(
    "disk_rows_windows",
    """SELECT s_suppkey, CAST(round(abs(s_acctbal)*100) AS BIGINT) * 3 + 7 AS size, CAST(round(abs(s_acctbal)*100) AS BIGINT) AS free, CAST(round(abs(s_acctbal)*100) AS BIGINT) * 2 + 7 AS used_bytes,
  CAST(round_even((CAST(round(abs(s_acctbal)*100) AS BIGINT) * 2 + 7) * 100.0 / (CAST(round(abs(s_acctbal)*100) AS BIGINT) * 3 + 7), 0) AS BIGINT) AS used_pct FROM supplier""",
)
def disk_rows_windows(t: Inputs) -> DataFrame:
    cents = "CAST(round(abs(s_acctbal)*100) AS BIGINT)"
    drives = t.table("supplier").selectExpr("s_suppkey", f"{cents} * 3 + 7 AS size", f"{cents} AS free")
    return drives.select("s_suppkey", "size", "free", *landed.disk_row_windows("size", "free"))


ARTIFACTS = """SELECT '/out/' || CASE WHEN doc_id % 5 = 0 THEN 'sub/' ELSE '' END || 'job_' || CAST(doc_id % 40 AS VARCHAR(20)) || '_' || source || '.txt' AS path, doc_id,
       CASE WHEN doc_id % 6 = 0 THEN CAST(0 AS BIGINT) ELSE n_chars END AS size, doc_id % 7 <> 0 AS exists, doc_id % 11 = 0 AS is_dir FROM {documents}"""


@query("valid_artifacts", plain(f'SELECT doc_id, path, size FROM ({ARTIFACTS}) WHERE "exists" AND size > 0 AND NOT is_dir'))
def valid_artifacts(t: Inputs) -> DataFrame:
    return rt.valid_artifacts(t.sql(ARTIFACTS)).select("doc_id", "path", "size")


@query(
    "attachment_plan",
    plain(
        f"""SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes, CASE WHEN sum(size) > 209715 THEN 'compress' ELSE 'individual' END AS action,
       round_even(sum(size) / 1048576.0, 2) AS total_mib FROM ({ARTIFACTS}) WHERE "exists" AND size > 0 AND NOT is_dir"""
    ),
)
def attachment_plan(t: Inputs) -> DataFrame:
    return runs.attachment_plan(rt.valid_artifacts(t.sql(ARTIFACTS)), limit_bytes=int(0.2 * 1024 * 1024))


@query("job_artifacts", plain(f"SELECT doc_id, path FROM ({ARTIFACTS}) WHERE path LIKE '/out/%job\\_7%' ESCAPE '\\' AND path NOT LIKE '/out/sub/%'"))
def job_artifacts(t: Inputs) -> DataFrame:
    return rt.job_artifacts(t.sql(ARTIFACTS), "/out", "7").select("doc_id", "path")


@query(
    "pending_artifacts",
    plain(f"SELECT path FROM ({ARTIFACTS}) WHERE path NOT IN (SELECT path FROM ({ARTIFACTS}) WHERE doc_id % 3 <> 0)"),
)
def pending_artifacts(t: Inputs) -> DataFrame:
    artifacts = t.sql(ARTIFACTS)
    return rt.pending_artifacts(artifacts, artifacts.where("doc_id % 3 <> 0"), ["path"]).select("path")


@query("sorted_files", plain(f"SELECT DISTINCT path FROM ({ARTIFACTS})"))
def sorted_files(t: Inputs) -> DataFrame:
    return rt.sorted_files(t.sql(ARTIFACTS), "path")


# ---- the whole run -----------------------------------------------------------------------------------------------

_KNOWN_PATHS = ["/data/error", "/data/error/u3", "/data/view", "/data", "/data/click/u5", "/data/purchase", "/data/signup/u7"]


@query(
    "purge_run_totals",
    MATCHES
    + f""", hosts AS (SELECT DISTINCT host FROM f),
rules AS (SELECT host, rule_id, {_ROW_STATUS} AS status, coalesce(matched_files, 0) AS matched_files, coalesce(matched_bytes, 0) AS matched_bytes,
    coalesce(deleted_files, 0) AS deleted_files, coalesce(failed_files, 0) AS failed_files, coalesce(deleted_bytes, 0) AS deleted_bytes
  FROM hosts CROSS JOIN (VALUES {_RULE_NAMES}) r(rule_id) LEFT JOIN counted USING (host, rule_id)
  WHERE rule_id <> 'csv' OR host IN ('host-1', 'host-2')),
emptied AS (SELECT host, dir FROM (SELECT DISTINCT host, dir FROM f) d WHERE (starts_with(dir, '/data/error/') OR starts_with(dir, '/data/purchase/'))
  AND NOT EXISTS (SELECT 1 FROM survivors s WHERE s.host = d.host AND s.dir = d.dir))
SELECT (SELECT count(*) FROM rules) + 2 * (SELECT count(*) FROM hosts) AS total_rules,
  CAST((SELECT sum(matched_files) FROM rules) AS BIGINT) AS total_matched_files, CAST((SELECT sum(deleted_files) FROM rules) AS BIGINT) AS total_deleted_files,
  CAST((SELECT sum(failed_files) FROM rules) AS BIGINT) AS total_failed_files, CAST((SELECT sum(matched_bytes) FROM rules) AS BIGINT) AS total_matched_bytes,
  CAST((SELECT sum(deleted_bytes) FROM rules) AS BIGINT) AS total_deleted_bytes, (SELECT count(*) FROM emptied) AS total_removed_empty_dirs,
  CAST(0 AS BIGINT) AS total_failed_empty_dirs, 4 * (SELECT count(*) FROM hosts) AS total_blocked_paths, (SELECT count(*) FROM hosts) AS total_missing_paths,
  (SELECT count(*) FROM rules WHERE status = 'failed') + (SELECT count(*) FROM hosts) AS total_failed_rules,
  (SELECT count(*) FROM rules WHERE status = 'warning') AS total_warning_rules,
  (SELECT count(*) FROM rules WHERE status = 'blocked') + (SELECT count(*) FROM hosts) AS total_blocked_rules, (SELECT count(*) FROM hosts) AS total_hosts""",
)
def purge_run_totals(t: Inputs) -> DataFrame:
    """The job itself: a path that is not there, a rule of an unknown engine, emptied directories and runs that broke off."""
    inventory = files(t)
    hosts = inventory.select("host").distinct()
    there = hosts.select("host", F.explode(F.array(*[F.lit(p) for p in _KNOWN_PATHS])).alias("path"))
    listing = there.select("host", "path", F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("message"))
    yes, no = F.lit(True), F.lit(False)
    states = hosts.select("host", yes.alias("started"), no.alias("completed"), no.alias("failure_recorded"))
    done = flows.purge_job(
        inventory, resolved_plan(t), AS_OF, "apply", True, failures=t.sql(FAILED_DELETES), listing=listing, states=states
    )
    return done["totals"]
