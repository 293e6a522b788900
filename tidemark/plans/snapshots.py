"""Queries over two snapshots of a tag inventory, derived from the orders, customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import text as tx
from tidemark.operators import common
from tidemark.operators import reconcile as rc
from tidemark.plans.registry import Inputs, plain, query
from tidemark.sources import landed

# ---- inputs ------------------------------------------------------------------------------------------------------

_TAG = """SELECT 'ns/' || o_orderpriority AS repository,
       (CASE o_orderstatus WHEN 'O' THEN 'release-' WHEN 'F' THEN 'v' ELSE 'dev-' END) || CAST(o_orderkey AS VARCHAR(20)) AS tag,
       {digest} AS digest
FROM {orders} WHERE {kept}"""
_MD5 = "md5(CAST(CAST(round(o_totalprice*100) AS BIGINT) AS VARCHAR(20)))"
SOURCE_TAGS = _TAG.replace("{digest}", f"CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE {_MD5} END").replace(
    "{kept}", "o_orderkey % 19 <> 0"
)
TARGET_TAGS = _TAG.replace(
    "{digest}", f"CASE WHEN o_orderkey % 7 = 0 THEN md5('drift' || CAST(o_orderkey AS VARCHAR(20))) ELSE {_MD5} END"
).replace("{kept}", "o_orderkey % 11 <> 0")

CONFIGS = """SELECT repository,
       CASE WHEN repository = 'ns/1-URGENT' THEN 404 ELSE 200 END AS http_status,
       repository <> 'ns/1-URGENT' AS mirror_found,
       repository NOT IN ('ns/1-URGENT', 'ns/2-HIGH') AS is_enabled,
       CASE WHEN repository = 'ns/1-URGENT' THEN 'CONFIG_ERROR' WHEN repository = 'ns/5-LOW' THEN 'FAIL' ELSE 'SUCCESS' END AS sync_status,
       CASE WHEN repository = 'ns/1-URGENT' THEN 'no such mirror' ELSE '' END AS api_error,
       'tag_glob_csv' AS rule_kind,
       CASE repository WHEN 'ns/1-URGENT' THEN NULL WHEN 'ns/5-LOW' THEN '*-7*,dev-1' WHEN 'ns/3-MEDIUM' THEN 'release-1?,*5'
            ELSE 'release-*,v*' END AS filter_text
FROM (SELECT DISTINCT 'ns/' || o_orderpriority AS repository FROM {orders}
      UNION ALL SELECT 'ns/unused-' || r_name FROM {region}) r"""

TAG_ERRORS = """SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'source' ELSE 'target' END AS side, 'ns/' || n_name AS repository,
       CASE WHEN n_nationkey % 3 = 0 THEN 403 ELSE 404 END AS http_status, 'denied ' || n_name AS message FROM {nation}"""

# Tags that repeat: (orderkey, linenumber) is not unique.
REPEATED_TAGS = """SELECT 'ns/' || l_returnflag || l_linestatus AS repository,
       'v' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) AS tag,
       md5(CAST(CAST(round({price}*100) AS BIGINT) AS VARCHAR(20))) AS digest, l_partkey AS arrival
FROM {lineitem} WHERE {kept}"""
REPEATED_SOURCE = REPEATED_TAGS.replace("{price}", "l_extendedprice").replace("{kept}", "l_suppkey % 5 <> 0")
REPEATED_TARGET = REPEATED_TAGS.replace("{price}", "(CASE WHEN l_partkey % 2 = 0 THEN l_extendedprice ELSE l_quantity END)").replace(
    "{kept}", "l_suppkey % 7 <> 0"
)
REPEATED_CONFIGS = """SELECT DISTINCT 'ns/' || l_returnflag || l_linestatus AS repository, 200 AS http_status, TRUE AS mirror_found,
       l_returnflag <> 'A' AS is_enabled, 'SUCCESS' AS sync_status, '' AS api_error,
       CASE WHEN l_returnflag = 'N' THEN 'other' ELSE 'tag_glob_csv' END AS rule_kind,
       CASE WHEN l_returnflag = 'R' THEN 'v[0-4]*-[!12], v9*' ELSE 'v1*' END AS filter_text FROM {lineitem}"""


def source_tags(t: Inputs) -> DataFrame:
    return t.sql(SOURCE_TAGS)


def target_tags(t: Inputs) -> DataFrame:
    return t.sql(TARGET_TAGS)


def configs(t: Inputs) -> DataFrame:
    return t.sql(CONFIGS).withColumn("rule_value", F.split("filter_text", ","))


def compared(t: Inputs, target: str = TARGET_TAGS) -> rc.Comparison:
    return rc.Comparison(source_tags(t), t.sql(target), configs(t), t.sql(TAG_ERRORS))


def role_rows(t: Inputs) -> DataFrame:
    return compared(t).rows


# ---- oracle of the comparison ------------------------------------------------------------------------------------


def _sql_case(column: str, which: int) -> str:
    return "CASE " + column + " ".join(f" WHEN '{s}' THEN '{v[which]}'" for s, v in fv.TAG_STATUSES.items()) + " END"


_STATUS = """CASE WHEN s_tag IS NULL THEN 'EXTRA_TAG_ON_TARGET'
     WHEN NOT matched AND t_tag IS NOT NULL THEN 'OUT_OF_FILTER_PRESENT_ON_TARGET'
     WHEN NOT matched THEN 'SKIPPED_BY_FILTER'
     WHEN t_tag IS NULL THEN 'MISSING_TAG'
     WHEN source_digest = '' OR target_digest = '' THEN 'DIGEST_UNAVAILABLE'
     WHEN source_digest <> target_digest THEN 'DIGEST_MISMATCH' ELSE 'OK' END"""

ROLE_ROWS = plain(
    f"""WITH src AS ({SOURCE_TAGS}), tgt AS ({TARGET_TAGS}), cfg AS ({CONFIGS}), err AS ({TAG_ERRORS}),
pairs AS (SELECT coalesce(s.repository, t.repository) AS repository, coalesce(s.tag, t.tag) AS tag, s.tag AS s_tag, t.tag AS t_tag,
                 coalesce(s.digest, '') AS source_digest, coalesce(t.digest, '') AS target_digest
          FROM src s FULL JOIN tgt t ON s.repository = t.repository AND s.tag = t.tag),
judged AS (SELECT p.*, c.sync_status AS mirror_status, c.is_enabled AS mirror_enabled, coalesce(c.filter_text, '*') AS filter,
                  CASE p.repository WHEN 'ns/1-URGENT' THEN TRUE
                       WHEN 'ns/5-LOW' THEN contains(p.tag, '-7') OR p.tag = 'dev-1'
                       WHEN 'ns/3-MEDIUM' THEN p.tag = 'release-1?' OR p.tag LIKE '%5'
                       ELSE p.tag LIKE 'release-%' OR p.tag LIKE 'v%' END AS matched
           FROM pairs p JOIN cfg c ON p.repository = c.repository),
named AS (SELECT *, {_STATUS} AS status FROM judged),
notes AS (
  SELECT c.*, 'SOURCE_REPOSITORY_EMPTY_OR_INACCESSIBLE' AS status, 'warning' AS severity, '{fv.SOURCE_EMPTY_MESSAGE}' AS message
  FROM cfg c WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.repository = c.repository)
  UNION ALL SELECT c.*, 'MIRROR_CONFIG_ERROR', 'critical', '{fv.MIRROR_CONFIG_ERROR_MESSAGE}' || http_status || '. ' || api_error FROM cfg c WHERE NOT mirror_found
  UNION ALL SELECT c.*, 'MIRROR_DISABLED', 'critical', '{fv.MIRROR_DISABLED_MESSAGE}' FROM cfg c WHERE mirror_found AND NOT is_enabled),
rows AS (
  SELECT repository, tag, status, {_sql_case("status", 0)} AS severity, mirror_status, mirror_enabled, filter, source_digest, target_digest,
         {_sql_case("status", 1)} AS message FROM named
  UNION ALL SELECT repository, '', status, severity, sync_status, is_enabled, coalesce(filter_text, '*'), '', '', message FROM notes
  UNION ALL SELECT repository, '', 'TAG_COLLECTION_ERROR', 'critical', '', NULL, '', '', '', side || ' HTTP ' || http_status || ': ' || message FROM err)
"""
)

SCRIPT_ROWS = plain(
    f"""WITH src AS ({REPEATED_SOURCE}), cfg AS ({REPEATED_CONFIGS}),
tgt AS (SELECT repository, tag, digest FROM (SELECT *, row_number() OVER (PARTITION BY repository, tag ORDER BY arrival DESC, digest DESC) AS rn FROM ({REPEATED_TARGET})) WHERE rn = 1),
pairs AS (SELECT coalesce(s.repository, t.repository) AS repository, coalesce(s.tag, t.tag) AS tag, s.tag AS s_tag, t.tag AS t_tag,
                 coalesce(s.digest, '') AS source_digest, coalesce(t.digest, '') AS target_digest
          FROM src s FULL JOIN tgt t ON s.repository = t.repository AND s.tag = t.tag),
judged AS (SELECT p.*, c.sync_status AS mirror_status, c.is_enabled AS mirror_enabled,
                  CASE WHEN rule_kind = 'other' THEN '*' WHEN p.repository LIKE 'ns/R%' THEN 'v[0-4]*-[!12],v9*' ELSE 'v1*' END AS filter,
                  CASE WHEN rule_kind = 'other' THEN TRUE
                       WHEN p.repository LIKE 'ns/R%' THEN (substr(p.tag, 2, 1) BETWEEN '0' AND '4' AND substr(p.tag, -2, 1) = '-' AND substr(p.tag, -1) NOT IN ('1', '2')) OR p.tag LIKE 'v9%'
                       ELSE p.tag LIKE 'v1%' END AS matched
           FROM pairs p JOIN cfg c ON p.repository = c.repository),
named AS (SELECT *, {_STATUS} AS status FROM judged)
SELECT repository, tag, status, {_sql_case("status", 0)} AS severity, mirror_status, mirror_enabled, filter, source_digest, target_digest,
       {_sql_case("status", 1)} AS message FROM named"""
)
_CANDIDATES = "('MISSING_TAG', 'DIGEST_MISMATCH', 'DIGEST_UNAVAILABLE')"
_NOISE = "('SOURCE_REPOSITORY_EMPTY_OR_INACCESSIBLE', 'TAG_COLLECTION_ERROR')"
_COLUMNS = ", ".join(rc.ROW_COLUMNS)


@query("reconcile_rows", ROLE_ROWS + f"SELECT {_COLUMNS} FROM rows")
def reconcile_rows(t: Inputs) -> DataFrame:
    return role_rows(t)


@query("reconcile_rows_fnmatch", SCRIPT_ROWS)
def reconcile_rows_fnmatch(t: Inputs) -> DataFrame:
    filters = t.sql(REPEATED_CONFIGS).withColumns(
        {"rule_text": F.col("filter_text"), "rule_value": F.lit(None).cast("array<string>")}
    )
    return rc.reconcile(t.sql(REPEATED_SOURCE), t.sql(REPEATED_TARGET), filters, dialect="script")


@query("reconcile_status_counts", ROLE_ROWS + "SELECT status, count(*) AS n FROM rows GROUP BY status")
def reconcile_status_counts(t: Inputs) -> DataFrame:
    return rc.status_counts(role_rows(t))


@query("reconcile_severity_counts", ROLE_ROWS + "SELECT severity, count(*) AS n FROM rows GROUP BY severity")
def reconcile_severity_counts(t: Inputs) -> DataFrame:
    return rc.severity_counts(role_rows(t))


@query(
    "reconcile_summary",
    ROLE_ROWS
    + f"""SELECT (SELECT count(*) FROM cfg) AS repositories_evaluated, (SELECT count(*) FROM src) AS source_tags_evaluated,
       (SELECT count(*) FROM tgt) AS target_tags_evaluated, count(*) AS total_rows,
       count(DISTINCT repository) FILTER (WHERE status IN {_CANDIDATES}) AS candidate_repositories,
       count(*) FILTER (WHERE status IN {_CANDIDATES}) > 0 AS has_divergence FROM rows""",
)
def reconcile_summary(t: Inputs) -> DataFrame:
    return rc.enforce_policy(compared(t).summary(), fail_on_divergence=False)


@query(
    "enforced_policy",
    plain(
        f"""WITH src AS ({SOURCE_TAGS}) SELECT (SELECT count(DISTINCT repository) FROM src) AS repositories_evaluated, (SELECT count(*) FROM src WHERE digest <> '') AS source_tags_evaluated,
  (SELECT count(*) FROM src WHERE digest <> '') AS target_tags_evaluated, (SELECT count(*) FROM src WHERE digest <> '') AS total_rows, CAST(0 AS BIGINT) AS candidate_repositories, FALSE AS has_divergence"""
    ),
)
def enforced_policy(t: Inputs) -> DataFrame:
    """The summary of two equal sides with the policy on; a divergence would fail the job (a test shows it)."""
    same, every = equal_sides(t)
    return rc.enforce_policy(rc.Comparison(same, same, every).summary(), fail_on_divergence=True)


@query("sync_candidates", ROLE_ROWS + f"SELECT DISTINCT repository FROM rows WHERE status IN {_CANDIDATES}")
def sync_candidates(t: Inputs) -> DataFrame:
    return rc.sync_candidates(role_rows(t))


@query("visible_rows", ROLE_ROWS + f"SELECT {_COLUMNS} FROM rows WHERE status NOT IN {_NOISE}")
def visible_rows(t: Inputs) -> DataFrame:
    return rc.visible_rows(role_rows(t))


@query(
    "visible_counts",
    ROLE_ROWS
    + f"""SELECT 'visible' AS part, status, severity, count(*) AS n FROM rows WHERE status NOT IN {_NOISE} GROUP BY status, severity
UNION ALL SELECT 'hidden', NULL, NULL, count(*) FROM rows WHERE status IN {_NOISE}""",
)
def visible_counts(t: Inputs) -> DataFrame:
    return rc.visible_counts(role_rows(t))


@query("display_rows", ROLE_ROWS + f"SELECT {_COLUMNS} FROM rows WHERE status <> 'OK'")
def display_rows(t: Inputs) -> DataFrame:
    return rc.display_rows(role_rows(t))


@query(
    "display_rows_all_ok",
    plain(f"WITH src AS ({SOURCE_TAGS}) SELECT repository, tag, 'OK' AS status FROM src WHERE digest <> ''"),
)
def display_rows_all_ok(t: Inputs) -> DataFrame:
    """Both sides equal, so nothing but OK rows is left and all of them show."""
    same, every = equal_sides(t)
    return rc.display_rows(rc.reconcile(same, same, every)).select("repository", "tag", "status")


def equal_sides(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """Source tags with a digest, and configurations of their repositories that take every tag."""
    same = source_tags(t).where("digest <> ''")
    every = same.select("repository").distinct().selectExpr(
        "repository", "200 AS http_status", "true AS mirror_found", "true AS is_enabled", "'SUCCESS' AS sync_status",
        "'' AS api_error", "CAST(NULL AS ARRAY<STRING>) AS rule_value",
    )
    return same, every


_LABELS = "CASE status" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in fv.STATUS_LABELS.items()) + " ELSE status END"
_TEXTS = "CASE status" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in fv.STATUS_TEXTS.items()) + f" ELSE '{fv.STATUS_TEXT_DEFAULT}' END"


@query(
    "report_preview",
    ROLE_ROWS
    + f"""SELECT repository, tag, status, {_LABELS} AS label, {_TEXTS} AS explanation,
       (SELECT greatest(count(*) - 200, 0) FROM rows WHERE status <> 'OK') AS remaining
FROM rows WHERE status <> 'OK' ORDER BY repository, tag, status, message LIMIT 200""",
)
def report_preview(t: Inputs) -> DataFrame:
    shown = rc.report_preview(rc.display_rows(role_rows(t)), 200)
    return shown.select("repository", "tag", "status", "label", "explanation", "remaining")


@query(
    "reconcile_level",
    ROLE_ROWS
    + f"""SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning,
       CAST(0 AS BIGINT) AS troubles,
       CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'crit' WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'warn' ELSE 'ok' END AS level
FROM rows WHERE status NOT IN {_NOISE}""",
)
def reconcile_level(t: Inputs) -> DataFrame:
    return rc.report_level(role_rows(t))


# ---- landed pages ------------------------------------------------------------------------------------------------

REPOSITORY_MENTIONS = """SELECT 'source' AS side, 'team' || CAST(c_nationkey AS VARCHAR(20)) AS namespace,
       CAST(floor(c_custkey / 50) AS BIGINT) + again AS page_index, c_custkey % 50 + 100 * again AS pos,
       CASE WHEN c_custkey % 3 = 0 THEN 'org/' || c_name ELSE c_name END AS name,
       CASE WHEN c_custkey % 5 = again THEN 'NORMAL' ELSE 'MIRROR' END AS state, c_custkey % 2 = 0 AS is_public, c_mktsegment AS kind
FROM (SELECT *, 0 AS again FROM {customer} UNION ALL SELECT *, 1 FROM {customer} WHERE c_custkey % 4 = 0) m"""


def _pages(mentions: DataFrame, keys: list[str], fields: str, holder: str, bad_every: int) -> DataFrame:
    """Mentions as API pages; a page never holds more than its page size."""
    page = mentions.groupBy(*keys, "page_index").agg(
        F.array_sort(F.collect_list(F.expr(f"named_struct('pos', pos, {fields})"))).alias("items")
    )
    status = F.when(F.col("page_index") % bad_every == bad_every - 1, 500).otherwise(200).cast("bigint")
    return page.select(*keys, "page_index", status.alias("status"), F.struct(F.col("items").alias(holder)).alias("json"))


def repository_pages(t: Inputs) -> DataFrame:
    mentions = t.sql(REPOSITORY_MENTIONS)
    fields = """'namespace', CAST(namespace AS STRING), 'name', name, 'repository', CAST(NULL AS STRING), 'state', state, 'is_public', is_public,
        'description', CAST(NULL AS STRING), 'last_modified', CAST(NULL AS STRING), 'kind', kind, 'repo_kind', CAST(NULL AS STRING)"""
    return _pages(mentions, ["side"], fields, "repositories", 11).withColumn("namespace", F.lit(""))


REPOSITORIES = plain(
    f"""WITH m AS (SELECT *, CASE WHEN contains(name, '/') THEN name ELSE namespace || '/' || name END AS repository FROM ({REPOSITORY_MENTIONS})
           WHERE page_index % 11 <> 10),
repos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY page_index, pos) AS rn FROM m) WHERE rn = 1)
"""
)


@query(
    "repositories_from_pages",
    REPOSITORIES
    + """SELECT side, repository, namespace, string_split(name, '/')[-1] AS name, state, is_public, '' AS description, '' AS last_modified, kind FROM repos""",
)
def repositories_from_pages(t: Inputs) -> DataFrame:
    return landed.repositories_from_pages(repository_pages(t))


@query("mirrors_only", REPOSITORIES + "SELECT repository, state FROM repos WHERE state = 'MIRROR'")
def mirrors_only(t: Inputs) -> DataFrame:
    return rc.mirrors_only(landed.repositories_from_pages(repository_pages(t))).select("repository", "state")


TAG_MENTIONS = """SELECT 'ns/u' || CAST(user_id % 50 AS VARCHAR(20)) AS repository, CAST(floor(event_id / 1000) AS BIGINT) AS page_index,
       event_id % 1000 AS pos, CASE WHEN event_id % 97 = 0 THEN '' ELSE event_type || '-' || CAST(user_id % 20 AS VARCHAR(20)) END AS tag,
       CASE event_id % 3 WHEN 0 THEN md5(CAST(event_id AS VARCHAR(20))) END AS manifest_digest,
       CASE event_id % 4 WHEN 0 THEN 'd' || CAST(event_id AS VARCHAR(20)) END AS digest,
       CASE event_id % 5 WHEN 0 THEN 'i' || CAST(event_id AS VARCHAR(20)) END AS image_id
FROM {events}"""


def tag_pages(t: Inputs) -> DataFrame:
    fields = """'name', tag, 'manifest_digest', manifest_digest, 'digest', digest, 'image_id', image_id,
        'last_modified', CAST(NULL AS STRING), 'start_ts', CAST(NULL AS STRING), 'end_ts', CAST(NULL AS STRING)"""
    pages = _pages(t.sql(TAG_MENTIONS), ["repository"], fields, "tags", 5)
    return pages.select(
        "repository",
        F.substring_index("repository", "/", 1).alias("namespace"),
        tx.repo_short_name("repository").alias("name"),
        "page_index",
        "status",
        F.when(F.col("page_index") % 2 == 0, F.lit("gateway error")).alias("msg"),
        F.struct("json.tags", F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("error_message")).alias("json"),
    )


@query(
    "tags_from_pages",
    plain(
        f"""SELECT 'source' AS side, repository, 'ns' AS namespace, substr(repository, 4) AS repo_name, tag,
       coalesce(manifest_digest, digest, image_id, '') AS manifest_digest, '' AS last_modified, '' AS start_ts, '' AS end_ts
FROM (SELECT *, row_number() OVER (PARTITION BY repository, tag ORDER BY page_index, pos) AS rn FROM ({TAG_MENTIONS}) WHERE page_index % 5 <> 4 AND tag <> '')
WHERE rn = 1"""
    ),
)
def tags_from_pages(t: Inputs) -> DataFrame:
    return landed.tags_from_pages(tag_pages(t), "source")


@query(
    "tag_errors_from_pages",
    plain(
        f"""SELECT DISTINCT 'target' AS side, repository, CAST(500 AS BIGINT) AS http_status,
       CASE WHEN page_index % 2 = 0 THEN 'gateway error' ELSE '{fv.TAG_ERROR_MESSAGES["target"]}' END AS message, page_index
FROM ({TAG_MENTIONS}) WHERE page_index % 5 = 4"""
    ),
)
def tag_errors_from_pages(t: Inputs) -> DataFrame:
    pages = tag_pages(t)
    return (
        landed.tag_errors_from_pages(pages, "target")
        .join(pages.where("status <> 200").select("repository", "page_index", F.coalesce("msg", F.lit(fv.TAG_ERROR_MESSAGES["target"])).alias("message")), ["repository", "message"])
        .distinct()
    )


MIRROR_RESPONSES = """SELECT 'ns' AS namespace, c_name AS name,
       CAST(CASE WHEN c_custkey % 9 = 0 THEN 404 ELSE 200 END AS BIGINT) AS status, c_custkey % 3 <> 0 AS is_enabled,
       CASE WHEN c_custkey % 4 = 0 THEN 'FAIL' WHEN c_custkey % 9 = 0 THEN NULL ELSE 'SUCCESS' END AS sync_status,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE lower(c_mktsegment) || '-*' END AS pattern,
       CASE WHEN c_custkey % 9 = 0 THEN 'gone' END AS detail, c_custkey AS sync_interval FROM {customer}"""


def mirror_responses(t: Inputs) -> DataFrame:
    text = "CAST(NULL AS STRING)"
    body = f"""named_struct('is_enabled', is_enabled, 'mirror_type', {text}, 'external_reference', {text}, 'external_registry_username', {text},
        'sync_interval', sync_interval, 'sync_start_date', {text}, 'sync_expiration_date', {text}, 'sync_status', sync_status,
        'sync_retries_remaining', CAST(NULL AS BIGINT), 'robot_username', {text},
        'root_rule', named_struct('rule_kind', 'tag_glob_csv', 'rule_value', IF(pattern IS NULL, NULL, array(pattern, 'v*'))),
        'skopeo_timeout_interval', CAST(NULL AS BIGINT), 'architecture_filter', CAST(NULL AS ARRAY<STRING>), 'detail', detail, 'error_message', {text})"""
    return t.sql(MIRROR_RESPONSES).selectExpr("namespace", "name", "status", f"{body} AS json")


@query(
    "mirror_configs",
    plain(
        f"""SELECT namespace || '/' || name AS repository, status AS http_status, status = 200 AS mirror_found, is_enabled,
       coalesce(sync_status, 'CONFIG_ERROR') AS sync_status, sync_interval, coalesce(pattern || ',v*', '*') AS filter, coalesce(detail, '') AS api_error
FROM ({MIRROR_RESPONSES})"""
    ),
)
def mirror_configs(t: Inputs) -> DataFrame:
    rows = landed.mirror_configs_from_responses(mirror_responses(t))
    shown = tx.filter_text(tx.filter_patterns("rule_value"))
    return rows.select(
        "repository", "http_status", "mirror_found", "is_enabled", "sync_status", "sync_interval", shown.alias("filter"), "api_error"
    )


@query(
    "mirror_stats",
    plain(
        f"""SELECT count(*) AS total, count(*) FILTER (WHERE is_enabled) AS enabled, count(*) FILTER (WHERE NOT is_enabled) AS disabled,
       count(*) FILTER (WHERE sync_status = 'SUCCESS') AS last_success, count(DISTINCT coalesce(pattern || ', v*', '*')) AS distinct_filters
FROM ({MIRROR_RESPONSES})"""
    ),
)
def mirror_stats(t: Inputs) -> DataFrame:
    return rc.mirror_stats(landed.mirror_configs_from_responses(mirror_responses(t)))


@query(
    "mirror_filters",
    plain(f"SELECT coalesce(pattern || ', v*', '*') AS filter, count(*) AS repositories FROM ({MIRROR_RESPONSES}) GROUP BY 1"),
)
def mirror_filters(t: Inputs) -> DataFrame:
    return rc.mirror_filters(landed.mirror_configs_from_responses(mirror_responses(t)))


# ---- repositories ------------------------------------------------------------------------------------------------

SOURCE_REPOSITORIES = "SELECT 'ns/' || c_name AS repository, 'MIRROR' AS state, c_custkey FROM {customer}"
TARGET_REPOSITORIES = """SELECT 'ns/' || c_name AS repository, CASE WHEN c_custkey % 5 = 0 THEN 'NORMAL' ELSE 'MIRROR' END AS state
FROM {customer} WHERE c_custkey % 7 <> 0"""
EXCEPTIONS = [f"ns/Customer#{k:09d}" for k in (10, 20, 30)]
_IGNORED = "('" + "', '".join(EXCEPTIONS) + "')"
CLASSIFIED = plain(
    f"""WITH s AS ({SOURCE_REPOSITORIES}), t AS ({TARGET_REPOSITORIES}),
classified AS (SELECT s.repository, s.c_custkey, t.state AS target_state,
  CASE WHEN t.repository IS NULL THEN 'missing' WHEN t.state = 'MIRROR' THEN 'existing' WHEN s.repository IN {_IGNORED} THEN 'ignored' ELSE 'conflict' END AS classification
  FROM s LEFT JOIN t ON s.repository = t.repository)
"""
)


def classified(t: Inputs) -> DataFrame:
    return rc.classify_repositories(t.sql(SOURCE_REPOSITORIES), t.sql(TARGET_REPOSITORIES), EXCEPTIONS)


@query("classify_repositories", CLASSIFIED + "SELECT repository, target_state, classification FROM classified")
def classify_repositories(t: Inputs) -> DataFrame:
    return classified(t).select("repository", "target_state", "classification")


@query(
    "mirror_outcomes",
    CLASSIFIED
    + """SELECT repository, 'missing' AS situation, CASE WHEN c_custkey % 2 = 0 THEN 'created' WHEN c_custkey % 3 = 0 THEN 'still_missing' ELSE 'unchanged' END AS outcome
FROM classified WHERE classification = 'missing'
UNION ALL SELECT repository, 'conflict', 'check' FROM classified WHERE classification = 'conflict'
UNION ALL SELECT repository, 'ignored', 'exception' FROM classified WHERE classification = 'ignored'""",
)
def mirror_outcomes(t: Inputs) -> DataFrame:
    rows = classified(t)

    def kind(name: str) -> DataFrame:
        return rows.where(F.col("classification") == name)

    return rc.mirror_outcomes(
        kind("missing"),
        kind("missing").where("c_custkey % 2 = 0"),
        kind("missing").where("c_custkey % 3 = 0"),
        kind("conflict"),
        kind("ignored"),
    )


RESPONSES = """SELECT c_custkey, CAST(CASE c_custkey % 6 WHEN 0 THEN 201 WHEN 1 THEN 404 WHEN 2 THEN 400 WHEN 3 THEN 400 WHEN 4 THEN 200 ELSE 503 END AS BIGINT) AS status,
       CASE c_custkey % 6 WHEN 2 THEN 'Could not find robot with specified USERNAME ' || c_name WHEN 3 THEN 'bad request' END AS message FROM {customer}"""


@query(
    "response_outcome",
    plain(
        f"""SELECT c_custkey, status, message, CASE WHEN status = 201 THEN 'created' WHEN status = 200 THEN 'found'
       WHEN status = 404 OR (status = 400 AND lower(message) LIKE '%could not find robot with specified username%') THEN 'robot_missing'
       ELSE 'unexpected' END AS outcome FROM ({RESPONSES})"""
    ),
)
def response_outcome(t: Inputs) -> DataFrame:
    return rc.response_outcome(t.sql(RESPONSES))


@query(
    "inventory_summary",
    plain(
        f"""WITH s AS ({SOURCE_REPOSITORIES}), t AS ({TARGET_REPOSITORIES}), st AS ({SOURCE_TAGS}), tt AS ({TARGET_TAGS})
SELECT 'source' AS side, count(*) AS repositories_visible, count(*) FILTER (WHERE state = 'MIRROR') AS mirrors_found, (SELECT count(*) FROM st) AS tags FROM s
UNION ALL SELECT 'target', count(*), count(*) FILTER (WHERE state = 'MIRROR'), (SELECT count(*) FROM tt) FROM t"""
    ),
)
def inventory_summary(t: Inputs) -> DataFrame:
    return rc.inventory_summary(t.sql(SOURCE_REPOSITORIES), t.sql(TARGET_REPOSITORIES), source_tags(t), target_tags(t))


# ---- sync --------------------------------------------------------------------------------------------------------

_ROWS = """SELECT 'ns/' || CAST(o_custkey AS VARCHAR(20)) AS repository,
       CASE o_orderstatus WHEN 'O' THEN 'OK' WHEN 'F' THEN 'MISSING_TAG' ELSE 'DIGEST_MISMATCH' END AS status FROM {orders} WHERE {kept}"""
ROWS_BEFORE = _ROWS.replace("{kept}", "o_orderkey % 2 = 0")
ROWS_AFTER = _ROWS.replace("{kept}", "o_orderkey % 10 = 0")
CANDIDATES = "SELECT 'ns/' || CAST(c_custkey AS VARCHAR(20)) AS repository FROM {customer} WHERE c_custkey % 2 = 0"
CALLS = """SELECT 'ns/' || CAST(c_custkey AS VARCHAR(20)) AS repository, action, c_custkey + try_no AS arrival,
       CAST(CASE (c_custkey + try_no) % 5 WHEN 0 THEN 404 WHEN 1 THEN 204 WHEN 2 THEN 400 WHEN 3 THEN 503 ELSE 201 END AS BIGINT) AS status,
       CASE (c_custkey + try_no) % 5 WHEN 3 THEN 'unavailable' END AS detail
FROM (SELECT c_custkey, 'sync-cancel' AS action, 0 AS try_no FROM {customer} UNION ALL SELECT c_custkey, 'sync-now', 1 FROM {customer}
      UNION ALL SELECT c_custkey, 'sync-now', 2 FROM {customer}) a
WHERE c_custkey % 11 <> 0"""
WAITS = """SELECT 'ns/' || CAST(c_custkey AS VARCHAR(20)) AS repository, CAST(CASE WHEN c_custkey % 8 = 0 THEN 502 ELSE 200 END AS BIGINT) AS http_status,
       CASE c_custkey % 12 WHEN 2 THEN 'FAILED' WHEN 4 THEN 'SYNCING' WHEN 6 THEN 'NEVER_RUN' WHEN 8 THEN NULL ELSE 'SUCCESS' END AS sync_status FROM {customer}"""


def calls(t: Inputs) -> DataFrame:
    responses = t.sql(CALLS).withColumns({"error_message": F.lit(None).cast("string"), "msg": F.lit(None).cast("string")})
    return rc.sync_actions(responses)


_OK_CODE = """(action = 'sync-cancel' AND status IN (200, 201, 202, 204, 400, 404) OR action = 'sync-now' AND status IN (200, 201, 202, 204))"""


@query(
    "sync_actions",
    plain(
        f"""SELECT repository, action, status AS http_status, {_OK_CODE} AS ok, coalesce(detail, '') AS message, arrival,
       CASE WHEN NOT {_OK_CODE} THEN 'failed' WHEN status = 404 THEN 'no_active_sync' WHEN status = 400 THEN 'nothing_to_do' ELSE 'ok' END AS badge FROM ({CALLS})"""
    ),
)
def sync_actions(t: Inputs) -> DataFrame:
    return calls(t).withColumn("badge", rc.call_badge("http_status", "ok"))


@query("failed_actions", plain(f"SELECT count(*) AS failed_actions FROM ({CALLS}) WHERE NOT {_OK_CODE}"))
def failed_actions(t: Inputs) -> DataFrame:
    return rc.failed_actions(calls(t))


_WAIT = """CASE WHEN http_status <> 200 THEN 'http_error' WHEN coalesce(sync_status, 'UNKNOWN') IN ('FAIL', 'FAILED', 'ERROR') THEN 'failed'
     WHEN coalesce(sync_status, 'UNKNOWN') NOT IN ('SUCCESS', 'NEVER_RUN') THEN 'timeout' ELSE 'done' END"""


@query(
    "wait_summary",
    plain(
        f"""WITH w AS (SELECT {_WAIT} AS outcome FROM ({WAITS}))
SELECT count(*) FILTER (WHERE outcome = 'timeout') AS total_timeout, count(*) FILTER (WHERE outcome = 'failed') AS total_terminal_failed,
       count(*) FILTER (WHERE outcome = 'http_error') AS total_http_errors, count(*) FILTER (WHERE outcome <> 'done') > 0 AS has_partial_failure FROM w"""
    ),
)
def wait_summary(t: Inputs) -> DataFrame:
    return rc.wait_summary(t.sql(WAITS))


@query(
    "sync_progress",
    plain(
        f"""WITH w AS (SELECT repository, {_WAIT} AS outcome FROM ({WAITS})), calls AS ({CALLS}),
b AS (SELECT repository, count(*) AS n FROM ({ROWS_BEFORE}) WHERE status IN {_CANDIDATES} GROUP BY 1),
a AS (SELECT repository, count(*) AS n FROM ({ROWS_AFTER}) WHERE status IN {_CANDIDATES} GROUP BY 1),
now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY arrival DESC) AS rn FROM calls WHERE action = 'sync-now') WHERE rn = 1)
SELECT c.repository, coalesce(b.n, 0) AS bad_before, coalesce(a.n, 0) AS bad_after, x.status AS cancel_status,
       x.status IN (200, 201, 202, 204, 400, 404) AS cancel_ok, now.status AS now_status, now.status IN (200, 201, 202, 204) AS now_ok,
       CASE WHEN w.outcome <> 'done' THEN w.outcome WHEN coalesce(a.n, 0) = 0 THEN 'resolved' ELSE 'pending' END AS outcome
FROM ({CANDIDATES}) c LEFT JOIN b USING (repository) LEFT JOIN a USING (repository) LEFT JOIN w USING (repository)
LEFT JOIN (SELECT * FROM calls WHERE action = 'sync-cancel') x USING (repository) LEFT JOIN now USING (repository)"""
    ),
)
def sync_progress(t: Inputs) -> DataFrame:
    return rc.sync_progress(t.sql(CANDIDATES), calls(t), t.sql(WAITS), t.sql(ROWS_BEFORE), t.sql(ROWS_AFTER))


# After a sync half of the drifted digests are those of the source, and some missing tags have arrived.
SYNCED_TAGS = TARGET_TAGS.replace("o_orderkey % 7 = 0", "o_orderkey % 14 = 0").replace("o_orderkey % 11 <> 0", "o_orderkey % 33 <> 0")


def _both_rows(tail: str) -> str:
    """SQL over the rows before (``rows``) and after a sync (``synced``)."""
    after = ROLE_ROWS.replace(plain(TARGET_TAGS), plain(SYNCED_TAGS))
    return f"SELECT * FROM (WITH before AS ({ROLE_ROWS} SELECT * FROM rows), after AS ({after} SELECT * FROM rows) {tail})"


@query(
    "sync_transitions",
    _both_rows(
        """, b AS (SELECT repository, tag, CASE WHEN tag = '' THEN status ELSE '' END AS about, any_value(status) AS status FROM before GROUP BY ALL),
a AS (SELECT repository, tag, CASE WHEN tag = '' THEN status ELSE '' END AS about, any_value(status) AS status FROM after GROUP BY ALL)
SELECT coalesce(b.status, 'ABSENT') AS status_before, coalesce(a.status, 'ABSENT') AS status_after, count(*) AS n
FROM b FULL JOIN a ON a.repository = b.repository AND a.tag = b.tag AND a.about = b.about GROUP BY ALL"""
    ),
)
def sync_transitions(t: Inputs) -> DataFrame:
    return rc.sync_transitions(role_rows(t), compared(t, SYNCED_TAGS).rows)


@query(
    "sync_result",
    _both_rows(
        f""", c AS (SELECT DISTINCT repository FROM before WHERE status IN {_CANDIDATES}),
w AS (SELECT repository, {_WAIT} AS outcome FROM ({plain(WAITS)})), calls AS ({plain(CALLS)}),
left_over AS (SELECT repository, count(*) AS n FROM after WHERE status IN {_CANDIDATES} GROUP BY ALL),
p AS (SELECT c.repository, CASE WHEN bool_or(w.outcome <> 'done') THEN 'waiting' WHEN coalesce(any_value(l.n), 0) = 0 THEN 'resolved' ELSE 'pending' END AS outcome
  FROM c LEFT JOIN w ON w.repository = c.repository LEFT JOIN left_over l ON l.repository = c.repository GROUP BY c.repository)
SELECT 'sync' AS mode, (SELECT count(*) FROM p) AS candidates, (SELECT count(*) FROM p WHERE outcome = 'resolved') AS resolved_repositories,
  (SELECT count(*) FROM p WHERE outcome = 'pending') AS pending_repositories, (SELECT count(*) FROM calls) AS actions, (SELECT count(*) FROM calls WHERE NOT {_OK_CODE}) AS failed_actions,
  (SELECT count(*) FROM w WHERE outcome = 'timeout') AS total_timeout, (SELECT count(*) FROM w WHERE outcome = 'failed') AS total_terminal_failed,
  (SELECT count(*) FROM w WHERE outcome = 'http_error') AS total_http_errors, (SELECT count(*) FROM w WHERE outcome <> 'done') > 0 AS has_partial_failure,
  (SELECT count(*) FROM before) AS initial_total_rows, (SELECT count(*) FROM c) AS initial_candidate_repositories, (SELECT count(*) FROM c) > 0 AS initial_has_divergence,
  (SELECT count(*) FROM after) AS final_total_rows, (SELECT count(*) FROM left_over) AS final_candidate_repositories, (SELECT count(*) FROM left_over) > 0 AS final_has_divergence,
  (SELECT count(*) FROM calls) > 0 AS performed"""
    ),
)
def sync_result(t: Inputs) -> DataFrame:
    """A sync over the comparison's own candidates, from its calls and waits to the one row of its result."""
    before, after = compared(t), compared(t, SYNCED_TAGS)
    progress = rc.sync_progress(rc.sync_candidates(before.rows), calls(t), t.sql(WAITS), before.rows, after.rows)
    return rc.sync_result("sync", before.summary(), after.summary(), calls(t), t.sql(WAITS), progress)


# ---- de-duplication and listing ----------------------------------------------------------------------------------

_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_SQL = ", ".join(_LINE)
_LINE_DESC = ", ".join(f"{c} DESC" for c in _LINE)


@query(
    "dedup_first",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_SQL}) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_first(t: Inputs) -> DataFrame:
    kept = common.dedup_first(t.table("lineitem"), ["l_orderkey", "l_linenumber"], _LINE)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


@query(
    "dedup_last",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_DESC}) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_last(t: Inputs) -> DataFrame:
    kept = common.dedup_last(t.table("lineitem"), ["l_orderkey", "l_linenumber"], _LINE)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


@query(
    "tags_per_repository",
    plain(
        f"""WITH s AS ({SOURCE_TAGS}), r AS (SELECT repository, tag, row_number() OVER (PARTITION BY repository ORDER BY tag) AS rn FROM s)
SELECT repository, count(*) AS tag_count, string_agg(tag, '|' ORDER BY tag) FILTER (WHERE rn <= 10) AS sample_tags FROM r GROUP BY repository"""
    ),
)
def tags_per_repository(t: Inputs) -> DataFrame:
    return rc.tags_per_repository(source_tags(t)).withColumn("sample_tags", F.array_join("sample_tags", "|"))


PAGE_SIZES = """SELECT 'ns/u' || CAST(user_id AS VARCHAR(20)) AS repository, event_id % 7 AS page_index, CAST(200 AS BIGINT) AS status,
       count(*) AS tags_on_page, max(event_id) % 3 = 0 AS has_next FROM {events} GROUP BY user_id, event_id % 7"""


@query(
    "page_gaps",
    plain(
        f"""WITH p AS ({PAGE_SIZES}), l AS (SELECT repository, max(page_index) AS last_page FROM p GROUP BY repository)
SELECT * FROM (SELECT l.repository, last_page, tags_on_page, tags_on_page >= 9 AND last_page < 6 AS needs_next_page,
       (tags_on_page >= 9 OR has_next) AND last_page >= 6 AS incomplete
FROM l JOIN p ON p.repository = l.repository AND p.page_index = l.last_page) WHERE needs_next_page OR incomplete"""
    ),
)
def page_gaps(t: Inputs) -> DataFrame:
    return rc.page_gaps(t.sql(PAGE_SIZES), limit=9, max_pages=6)
