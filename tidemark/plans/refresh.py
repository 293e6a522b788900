"""Refresh queries: tables, hosts, checks, grants, statuses; and classification of failure texts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import text as tx
from tidemark.operators import common, failures, runs
from tidemark.operators import refresh as rf
from tidemark.operators import retention as rt
from tidemark.plans.registry import Inputs, plain, query
from tidemark.session import use_checkpoint_dir
from tidemark.sources import landed, sinks

# ---- tables ------------------------------------------------------------------------------------------------------

SOURCE = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer}"
TARGET = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'own ' || c_name ELSE c_name END AS c_name, c_nationkey, c_mktsegment FROM {customer} WHERE c_custkey % 2 = 0"


def _refreshed(t: Inputs) -> dict[str, DataFrame]:
    source = {"customer": t.sql(SOURCE), "settings": t.sql(SOURCE), "sessions": t.table("events"), "supplier": t.table("supplier")}
    target = {"settings": t.sql(TARGET)}
    return rf.refresh_tables(source, target, preserve=["settings"], truncate=["sessions"], env="HML", run_on=["hml", "dev"])


@query(
    "refresh_tables",
    plain(
        f"""SELECT 'settings' AS table_name, * FROM ({TARGET}) UNION ALL SELECT 'customer', * FROM ({SOURCE})
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, NULL FROM supplier"""
    ),
)
def refresh_tables(t: Inputs) -> DataFrame:
    """The rows of all four tables under the first one's column names; the emptied one has none."""
    fresh, names = _refreshed(t), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    text = F.lit(None).cast("string")
    rows = {
        "settings": fresh["settings"], "customer": fresh["customer"],
        "supplier": fresh["supplier"].select("s_suppkey", "s_name", "s_nationkey", text).toDF(*names),
        "sessions": fresh["sessions"].select("event_id", "event_type", F.col("user_id").cast("int"), text).toDF(*names),
    }
    parts = [frame.select(F.lit(name).alias("table_name"), *names) for name, frame in rows.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "truncate_tables",
    "SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'events', CAST(0 AS BIGINT) UNION ALL SELECT 'orders', count(*) FROM orders",
)
def truncate_tables(t: Inputs) -> DataFrame:
    tables = {n: t.table(n) for n in ("customer", "events", "orders")}
    done = rf.truncate_tables(tables, ["events"], "dev")
    counts = [frame.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, frame in done.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "run_checks",
    """SELECT 'sessions' AS "check", CAST(0 AS BIGINT) AS observed, CAST(0 AS BIGINT) AS expected, TRUE AS passed
UNION ALL SELECT 'own names kept', count(*), CAST(0 AS BIGINT), count(*) = 0 FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT 'customers', count(*), NULL, TRUE FROM customer
UNION ALL SELECT 'suppliers without a nation', count(*), CAST(0 AS BIGINT), count(*) = 0 FROM supplier WHERE s_nationkey IS NULL""",
)
def run_checks(t: Inputs) -> DataFrame:
    fresh = _refreshed(t)
    return rf.run_checks(
        [
            rf.Check("sessions", fresh["sessions"]),
            rf.Check("own names kept", fresh["settings"], F.col("c_name").startswith("own ")),
            rf.Check("customers", fresh["customer"], expected=None),
            rf.Check("suppliers without a nation", fresh["supplier"], F.col("s_nationkey").isNull()),
        ]
    )


@query(
    "run_listings",
    plain(
        f"""WITH own AS (SELECT c_custkey, c_name FROM ({TARGET}) WHERE c_name LIKE 'own %'), n AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY ALL)
SELECT 'own names' AS "check", row_number() OVER (ORDER BY c_custkey) AS rank, '{{{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}}}}' AS detail,
  greatest((SELECT count(*) FROM own) - 7, 0) AS more FROM (SELECT * FROM own ORDER BY c_custkey LIMIT 7)
UNION ALL SELECT 'suppliers by nation', row_number() OVER (ORDER BY suppliers DESC, s_nationkey), '{{{{"s_nationkey":' || s_nationkey || ',"suppliers":' || suppliers || '}}}}',
  greatest((SELECT count(*) FROM n) - 5, 0) FROM (SELECT * FROM n ORDER BY suppliers DESC, s_nationkey LIMIT 5)
UNION ALL SELECT 'newest customers', row_number() OVER (ORDER BY c_custkey DESC), '{{{{"c_custkey":' || c_custkey || '}}}}', greatest((SELECT count(*) FROM customer) - 3, 0)
  FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 3)""".replace("{{", "{").replace("}}", "}")
    ),
)
def run_listings(t: Inputs) -> DataFrame:
    fresh = _refreshed(t)
    own = fresh["settings"].where(F.col("c_name").startswith("own ")).select("c_custkey", "c_name")
    nations = fresh["supplier"].groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return rf.run_listings(
        [
            rf.Listing("own names", own, ["c_custkey"], 7),
            rf.Listing("suppliers by nation", nations, [F.desc("suppliers"), "s_nationkey"], 5),
            rf.Listing("newest customers", fresh["customer"].select("c_custkey"), [F.desc("c_custkey")], 3),
            rf.Listing("sessions", fresh["sessions"].select("event_id"), ["event_id"], 3),
        ]
    )


@query(
    "publish_journal",
    """SELECT * FROM (VALUES (0, 'a', 'publish'), (1, 'b', 'publish'), (2, '', 'finished')) v(step, name, action), (SELECT count(*) AS customers FROM customer) c,
(SELECT count(*) AS suppliers FROM supplier) s""",
)
def publish_journal(t: Inputs) -> DataFrame:
    """Two tables staged and published, with the journal of the run and the rows found under the live names."""
    mark, spark = uuid.uuid4().hex[:8], t.spark
    names = {f"refresh_{mark}_a": t.table("customer"), f"refresh_{mark}_b": t.table("supplier")}
    rf.stage(names)
    run = rf.publish(spark, list(names), journal=f"refresh_{mark}_journal")
    counts = [spark.table(name).agg(F.count("*")).scalar() for name in names]
    use_checkpoint_dir(spark)
    steps = spark.table(f"refresh_{mark}_journal").where(F.col("run") == run)
    short = F.regexp_extract("name", "_([ab])$", 1).alias("name")
    found = steps.select("step", short, "action", counts[0].alias("customers"), counts[1].alias("suppliers")).checkpoint()
    for name in [*names, f"refresh_{mark}_journal"]:
        spark.sql(f"DROP TABLE {name}")
    return found


@query("last_audit_rows", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 5")
def last_audit_rows(t: Inputs) -> DataFrame:
    return common.last_n(t.table("events").where("event_type = 'error'").select("event_id", "user_id", "event_type"), "event_id")


@query(
    "namespace_preview",
    "SELECT n_name, greatest((SELECT count(DISTINCT n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey) - 5, 0) AS remaining FROM (SELECT DISTINCT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey ORDER BY n_name LIMIT 5)",
)
def namespace_preview(t: Inputs) -> DataFrame:
    used = t.table("nation").join(t.table("supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    return common.preview(used.select("n_name").distinct(), ["n_name"], 5)


_PROPERTIES = """SELECT s_name AS name, 'owner' || CAST(s_nationkey AS VARCHAR(20)) AS owner, 'UTF8' AS encoding, 'c' AS provider,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'pt_BR' END AS collate, CASE WHEN s_suppkey % {m} = 0 THEN 'C' ELSE 'pt_BR' END AS ctype, 'main' AS tablespace,
       CAST(s_suppkey % {n} AS VARCHAR(20)) AS conn_limit FROM {supplier} WHERE s_suppkey % 13 <> {n}"""
FIRST_PROPERTIES = _PROPERTIES.replace("{m}", "6").replace("{n}", "9")
SECOND_PROPERTIES = _PROPERTIES.replace("{m}", "7").replace("{n}", "10")
PROPERTIES = ["owner", "encoding", "provider", "collate", "ctype", "tablespace", "conn_limit"]


@query(
    "property_parity",
    plain(
        f"""SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_first' WHEN a.name IS NULL THEN 'only_second' WHEN a.ctype <> b.ctype THEN 'different' ELSE 'equal' END AS state,
  concat_ws('|', CASE WHEN a.owner IS DISTINCT FROM b.owner THEN 'owner' END, CASE WHEN a.encoding IS DISTINCT FROM b.encoding THEN 'encoding' END, CASE WHEN a.provider IS DISTINCT FROM b.provider THEN 'provider' END,
  CASE WHEN a.collate IS DISTINCT FROM b.collate THEN 'collate' END, CASE WHEN a.ctype IS DISTINCT FROM b.ctype THEN 'ctype' END, CASE WHEN a.tablespace IS DISTINCT FROM b.tablespace THEN 'tablespace' END) AS differing
FROM ({FIRST_PROPERTIES}) a FULL JOIN ({SECOND_PROPERTIES}) b ON a.name = b.name"""
    ),
)
def property_parity(t: Inputs) -> DataFrame:
    return rf.property_parity(t.sql(FIRST_PROPERTIES), t.sql(SECOND_PROPERTIES), PROPERTIES, ignore=["conn_limit"])


OBJECTS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'schema' WHEN 1 THEN 'table' WHEN 2 THEN 'sequence' WHEN 3 THEN 'function' WHEN 4 THEN 'default' ELSE 'database' END AS kind,
       CASE WHEN p_partkey % 6 = 4 AND p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN 'pg_catalog' WHEN p_partkey % 15 = 0 THEN 'pg_toast_1' WHEN p_partkey % 7 = 0 THEN p_brand ELSE lower(p_type) END AS schema,
       'obj_' || CAST(p_partkey AS VARCHAR(20)) AS name, CASE WHEN p_partkey % 4 = 1 THEN 'integer, text' END AS arguments,
       CASE p_partkey % 5 WHEN 0 THEN 'r' WHEN 1 THEN 'S' WHEN 2 THEN 'f' WHEN 3 THEN 'T' ELSE 'n' END AS object_type, p_type, p_brand FROM {part}"""


def objects(t: Inputs) -> DataFrame:
    acl = F.expr(
        """array(named_struct('grantee', CAST('' AS STRING), 'privilege', 'SELECT', 'grantable', false),
                 named_struct('grantee', concat('role_', lower(p_type)), 'privilege', 'UPDATE', 'grantable', p_partkey % 2 = 0),
                 named_struct('grantee', p_brand, 'privilege', 'USAGE', 'grantable', true))"""
    )
    return t.sql(OBJECTS).withColumn("acl", acl)


_QSCHEMA = """CASE WHEN schema LIKE 'Brand%' THEN '"' || schema || '"' ELSE schema END"""


@query(
    "grant_statements",
    plain(
        f"""WITH o AS (SELECT * FROM ({OBJECTS}) WHERE kind = 'default' OR NOT (coalesce(schema, '') IN ('pg_catalog', 'information_schema') OR coalesce(schema, '') LIKE 'pg\\_toast%' ESCAPE '\\')),
a AS (SELECT o.*, 'SELECT' AS privilege, 'PUBLIC' AS who, '' AS opt FROM o
  UNION ALL SELECT o.*, 'UPDATE', 'role_' || lower(p_type), CASE WHEN p_partkey % 2 = 0 AND kind <> 'database' THEN ' WITH GRANT OPTION' ELSE '' END FROM o
  UNION ALL SELECT o.*, 'USAGE', '"' || p_brand || '"', CASE WHEN kind <> 'database' THEN ' WITH GRANT OPTION' ELSE '' END FROM o)
SELECT kind, schema, name, privilege, CASE WHEN kind = 'default' THEN 'ALTER DEFAULT PRIVILEGES FOR ROLE ' || name || CASE WHEN schema IS NOT NULL THEN ' IN SCHEMA ' || {_QSCHEMA} ELSE '' END || ' ' ELSE '' END
  || 'GRANT ' || privilege || ' ON ' || CASE kind WHEN 'database' THEN 'DATABASE "lab"' WHEN 'schema' THEN 'SCHEMA ' || {_QSCHEMA} WHEN 'table' THEN 'TABLE ' || {_QSCHEMA} || '.' || name
     WHEN 'sequence' THEN 'SEQUENCE ' || {_QSCHEMA} || '.' || name WHEN 'function' THEN 'FUNCTION ' || {_QSCHEMA} || '.' || name || '(' || coalesce(arguments, '') || ')'
     ELSE CASE object_type WHEN 'r' THEN 'TABLES' WHEN 'S' THEN 'SEQUENCES' WHEN 'f' THEN 'FUNCTIONS' WHEN 'T' THEN 'TYPES' ELSE 'SCHEMAS' END END
  || ' TO ' || who || opt || ';' AS statement FROM a"""
    ),
)
def grant_statements(t: Inputs) -> DataFrame:
    return rf.grant_statements(objects(t), database="lab")


# Privileges as captured, and as found: of each role's some are lacking, some new, and some changed their option.
_HELD = """SELECT CASE p_partkey % 4 WHEN 0 THEN 'schema' WHEN 1 THEN 'table' WHEN 2 THEN 'sequence' ELSE 'database' END AS kind, p_brand AS schema, 'obj_' || CAST(p_partkey AS VARCHAR(20)) AS name,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS grantee, 'SELECT' AS privilege, {option} AS grantable FROM {part} WHERE {kept}"""
WANTED_GRANTS = _HELD.replace("{option}", "p_partkey % 2 = 0").replace("{kept}", "p_partkey % 5 <> 0")
PRESENT_GRANTS = _HELD.replace("{option}", "p_partkey % 6 < 2").replace("{kept}", "p_partkey % 7 <> 0")


def held_objects(t: Inputs, text: str) -> DataFrame:
    acl = F.array(F.struct("grantee", "privilege", "grantable"))
    none = F.lit(None).cast("string")
    return t.sql(text).select("kind", "schema", "name", none.alias("arguments"), none.alias("object_type"), acl.alias("acl"))


@query(
    "grant_difference",
    plain(
        f"""WITH w AS ({WANTED_GRANTS}), h AS ({PRESENT_GRANTS}),
d AS (SELECT coalesce(w.kind, h.kind) AS kind, coalesce(w.schema, h.schema) AS schema, coalesce(w.name, h.name) AS name, coalesce(w.grantee, h.grantee) AS grantee, 'SELECT' AS privilege,
  w.grantable AND w.kind <> 'database' AS wo, h.grantable AND h.kind <> 'database' AS ho FROM w FULL JOIN h ON w.name = h.name),
a AS (SELECT *, CASE WHEN wo IS NULL THEN 'revoke' WHEN ho IS NULL OR (wo AND NOT ho) THEN 'grant' WHEN ho AND NOT wo THEN 'revoke_option' END AS action,
  CASE kind WHEN 'database' THEN 'DATABASE "lab"' WHEN 'schema' THEN 'SCHEMA "' || schema || '"' ELSE upper(kind) || ' "' || schema || '".' || name END AS what,
  CASE WHEN grantee = '' THEN 'PUBLIC' ELSE '"' || grantee || '"' END AS who FROM d)
SELECT kind, schema, name, grantee, privilege, action, CASE action WHEN 'grant' THEN 2 ELSE 1 END::INTEGER AS step,
  CASE action WHEN 'grant' THEN 'GRANT SELECT ON ' || what || ' TO ' || who || CASE WHEN wo THEN ' WITH GRANT OPTION' ELSE '' END
    WHEN 'revoke' THEN 'REVOKE SELECT ON ' || what || ' FROM ' || who ELSE 'REVOKE GRANT OPTION FOR SELECT ON ' || what || ' FROM ' || who END || ';' AS statement
FROM a WHERE action IS NOT NULL"""
    ),
)
def grant_difference(t: Inputs) -> DataFrame:
    return rf.grant_difference(held_objects(t, WANTED_GRANTS), held_objects(t, PRESENT_GRANTS), database="lab")


NAMED = """SELECT CASE WHEN p_size % 12 = 0 THEN NULL WHEN p_size % 12 = 1 THEN 99 ELSE p_size % 25 END AS schema_id, CASE p_partkey % 5 WHEN 0 THEN 'schema' WHEN 1 THEN 'table' WHEN 2 THEN 'sequence' WHEN 3 THEN 'function' ELSE 'default' END AS kind,
       'obj_' || CAST(p_partkey AS VARCHAR(20)) AS name, lower(p_type) AS owner, p_partkey % 2 = 0 AS listed FROM {part}"""
_OWNED = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{p}' AS privilege, {who} AS everyone"
    for who, held in (("FALSE", fv.OWNER_PRIVILEGES), ("TRUE", fv.PUBLIC_PRIVILEGES))
    for kind, privileges in held.items()
    for p in privileges
)


@query(
    "catalog_objects",
    plain(
        f"""WITH o AS (SELECT x.*, n_name AS schema FROM ({NAMED}) x LEFT JOIN nation ON n_nationkey = x.schema_id WHERE n_name IS NOT NULL OR kind = 'default')
SELECT kind, schema, name, CASE WHEN d.everyone THEN '' ELSE owner END AS grantee, d.privilege FROM o JOIN ({_OWNED}) d USING (kind) WHERE NOT listed
UNION ALL SELECT kind, schema, name, 'reader', 'SELECT' FROM o WHERE listed"""
    ),
)
def catalog_objects(t: Inputs) -> DataFrame:
    schemas = t.table("nation").select(F.col("n_nationkey").alias("schema_id"), F.col("n_name").alias("name"))
    acl = F.when(F.col("listed"), F.expr("array(named_struct('grantee', 'reader', 'privilege', 'SELECT', 'grantable', false))"))
    named = rf.catalog_objects(t.sql(NAMED).withColumn("acl", acl), schemas)
    return rf.with_default_acl(named).select("kind", "schema", "name", F.inline("acl")).drop("grantable")


ROLES = """SELECT CASE WHEN c_custkey % 9 = 0 THEN 'pg_role' ELSE 'user_' END || CAST(c_custkey AS VARCHAR(20)) AS role,
       CASE c_custkey % 4 WHEN 0 THEN 'CONNECT' WHEN 1 THEN 'CONNECT,TEMP' WHEN 2 THEN 'OTHER' ELSE '' END AS held FROM {customer}"""


@query(
    "database_privileges",
    plain(
        f"""SELECT role AS name, p AS privilege, 'GRANT ' || p || ' ON DATABASE "lab" TO ' || role || ';' AS statement
FROM (SELECT role, unnest(string_split(held, ',')) AS p FROM ({ROLES}) WHERE role NOT LIKE 'pg\\_%' ESCAPE '\\') WHERE p IN ('CONNECT', 'CREATE', 'TEMP')"""
    ),
)
def database_privileges(t: Inputs) -> DataFrame:
    roles = t.sql(ROLES).withColumn("privileges", F.split("held", ","))
    return rf.grant_statements(rf.database_privileges(roles), database="lab").select("name", "privilege", "statement")


EXCLUDED = ["small ", "USER MAPPING", "widget"]


@query(
    "filter_listing",
    "SELECT p_partkey, p_name || ' ' || p_type AS value FROM part WHERE NOT contains(p_name, 'small ') AND NOT contains(p_name, 'widget')",
)
def filter_listing(t: Inputs) -> DataFrame:
    lines = t.table("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("value"))
    return landed.filter_listing(lines, EXCLUDED)


RULE_FILES = """SELECT 'app' || CAST(p_size % 20 AS VARCHAR(20)) AS application, CASE WHEN p_size % 2 = 0 THEN 'linux' ELSE 'windows' END AS os, p_type AS name,
       p_partkey % 3 AS file_order, p_partkey AS position, p_brand AS description FROM {part}"""


@query(
    "later_rules_win",
    plain(
        f"""SELECT application, os, name, description, position FROM (SELECT *, max(file_order) OVER (PARTITION BY application, os) AS latest FROM ({RULE_FILES})) WHERE file_order = latest"""
    ),
)
def later_rules_win(t: Inputs) -> DataFrame:
    return landed.later_wins(t.sql(RULE_FILES)).select("application", "os", "name", "description", "position")


@query("table_sizes")
def table_sizes(t: Inputs) -> DataFrame:
    return sinks.table_sizes(t.spark, t.files)


# ---- plan --------------------------------------------------------------------------------------------------------

DEFAULTS = "SELECT 'setting_' || CAST(p_partkey AS VARCHAR(20)) AS key, p_brand AS value FROM {part} WHERE p_partkey % 3 <> 0"
OVERRIDES = "SELECT 'setting_' || CAST(p_partkey AS VARCHAR(20)) AS key, p_type AS value FROM {part} WHERE p_partkey % 4 = 0"


@query("overlay", plain(f"SELECT coalesce(o.key, d.key) AS key, coalesce(o.value, d.value) AS value FROM ({DEFAULTS}) d FULL JOIN ({OVERRIDES}) o ON o.key = d.key"))
def overlay(t: Inputs) -> DataFrame:
    return rf.overlay(t.sql(DEFAULTS), t.sql(OVERRIDES))


SELECTIONS = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',' || 'x' ELSE '' END AS asked, CASE WHEN event_id % 2 = 0 THEN 'dflt' ELSE ' ' END AS defaults, 'a,b' AS known FROM {events}"""


@query(
    "effective_selection",
    plain(f"SELECT event_id, CASE WHEN asked <> '' THEN asked WHEN trim(defaults) <> '' THEN defaults ELSE known END AS chosen FROM ({SELECTIONS})"),
)
def effective_selection(t: Inputs) -> DataFrame:
    lists = [tx.normalize_list(c) for c in ("asked", "defaults", "known")]
    return t.sql(SELECTIONS).select("event_id", F.array_join(rt.effective_selection(*lists), ",").alias("chosen"))


HOSTS = """SELECT CASE WHEN s_suppkey % 5 = 0 THEN ' PRD' WHEN s_suppkey % 5 = 1 THEN 'hml' ELSE 'Dev' END AS env, s_name, s_suppkey, '10.0.0.' || CAST(s_suppkey AS VARCHAR(20)) AS address,
       s_suppkey % 3 AS shape, CASE WHEN s_suppkey % 7 = 0 THEN FALSE WHEN s_suppkey % 7 = 1 THEN TRUE END AS enabled FROM {supplier}"""
FLAT_HOSTS = plain(
    f"""WITH c AS (SELECT *, lower(trim(env)) AS e FROM ({HOSTS})),
h AS (SELECT e AS env, e || '-core-01' AS name, address AS ansible_host, TRUE AS enabled, '5432' AS port FROM c WHERE shape = 0
  UNION ALL SELECT e, s_name, coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN address END, s_name), TRUE, '5432' FROM c WHERE shape = 1
  UNION ALL SELECT e, CASE WHEN s_suppkey % 4 = 0 THEN address ELSE s_name END, CASE WHEN s_suppkey % 4 = 1 THEN s_name ELSE address END, coalesce(enabled, TRUE), CASE WHEN s_suppkey % 2 = 0 THEN '5433' ELSE '5432' END FROM c WHERE shape = 2)
"""
)


def hosts(t: Inputs) -> DataFrame:
    fields = """array(named_struct('name', IF(s_suppkey % 4 = 0, NULL, s_name), 'ansible_host', IF(s_suppkey % 4 = 1, NULL, address), 'enabled', enabled, 'source', CAST(NULL AS BOOLEAN),
        'database_name', CAST(NULL AS STRING), 'port', IF(s_suppkey % 2 = 0, '5433', NULL)))"""
    configured = t.sql(HOSTS).selectExpr(
        "env",
        "IF(shape = 0, address, NULL) AS host_text",
        "IF(shape = 1, map(s_name, IF(s_suppkey % 4 <> 0, address, NULL)), NULL) AS host_map",
        f"IF(shape = 2, {fields}, NULL) AS host_list",
    )
    return rf.flatten_hosts(configured, "core")


@query("flatten_hosts", FLAT_HOSTS + "SELECT env, name, ansible_host, enabled, port, 'core' AS database_name FROM h")
def flatten_hosts(t: Inputs) -> DataFrame:
    return hosts(t).select("env", "name", "ansible_host", "enabled", "port", "database_name")


@query("select_hosts", FLAT_HOSTS + "SELECT env, name, ansible_host, 'target' AS role FROM h WHERE enabled AND env IN ('hml', 'dev')")
def select_hosts(t: Inputs) -> DataFrame:
    return rf.select_hosts(hosts(t), "target", ["HML", "dev"]).select("env", "name", "ansible_host", "role")


@query(
    "select_source_host",
    FLAT_HOSTS + "SELECT env, name, ansible_host, 'source' AS role FROM h WHERE enabled AND env = 'prd' AND (lower(name) IN ('10.0.0.20', 'supplier#000000010') OR lower(ansible_host) IN ('10.0.0.20', 'supplier#000000010'))",
)
def select_source_host(t: Inputs) -> DataFrame:
    wanted = ["10.0.0.20", "SUPPLIER#000000010"]
    return rf.select_hosts(hosts(t), "source", ["prd"], wanted).select("env", "name", "ansible_host", "role")


@query(
    "validate_plan",
    FLAT_HOSTS
    + """, n AS (SELECT count(*) FILTER (WHERE env = 'prd') AS sources, count(*) FILTER (WHERE env IN ('hml', 'dev')) AS targets FROM h WHERE enabled)
SELECT 'exactly one source is needed' AS violation, * FROM n WHERE sources <> 1 UNION ALL SELECT 'unknown restore mode', * FROM n WHERE targets > 0""",
)
def validate_plan(t: Inputs) -> DataFrame:
    chosen = rf.select_hosts(hosts(t), "source", ["prd"]).unionByName(rf.select_hosts(hosts(t), "target", ["hml", "dev"]))
    mode = F.when(F.col("env") == "hml", "promote").otherwise("replace")
    return rf.validate_plan(chosen.withColumn("restore_mode", mode), "sync")


# ---- results -----------------------------------------------------------------------------------------------------

RESULTS = """SELECT 'host-' || CAST(o_custkey AS VARCHAR(20)) AS host, o_orderkey, 'db' || CAST(o_custkey % 20 AS VARCHAR(20)) AS database, lower(o_orderpriority) AS env,
       CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS code, o_orderkey % 3 = 0 AS strict, 'dump_' || CAST(o_orderkey % 1000 AS VARCHAR(20)) AS name, o_orderdate AS finished_at,
       CASE WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'target' END AS role, o_orderkey % 4000 AS duration_seconds FROM {orders}"""
STATUS = plain(
    f"""WITH r AS (SELECT *, CASE WHEN code = 0 THEN 'SUCESSO' WHEN strict THEN 'FALHA' ELSE 'SUCESSO COM AVISO' END AS status FROM ({RESULTS})) """
)


def results(t: Inputs) -> DataFrame:
    meaning = tx.error_or_warning("code", "strict")
    return t.sql(RESULTS).withColumn("status", tx.run_status(meaning == "failure", meaning == "warning"))


@query("run_status", STATUS + "SELECT o_orderkey, status FROM r")
def run_status(t: Inputs) -> DataFrame:
    return results(t).select("o_orderkey", "status")


@query(
    "overall_status",
    STATUS + "SELECT count(*) AS hosts, CASE WHEN count(*) FILTER (WHERE status = 'FALHA') > 0 THEN 'FALHA' WHEN count(*) FILTER (WHERE status = 'SUCESSO COM AVISO') > 0 THEN 'SUCESSO COM AVISO' ELSE 'SUCESSO' END AS overall_status FROM r",
)
def overall_status(t: Inputs) -> DataFrame:
    return rf.overall_status(results(t))


@query(
    "report_rows",
    STATUS
    + """SELECT 'host-' || c_custkey AS host, coalesce(n, 0) AS n, coalesce(status, 'NÃO EXECUTADO') AS status FROM customer
LEFT JOIN (SELECT host, status, count(*) AS n FROM r GROUP BY host, status) x ON x.host = 'host-' || c_custkey""",
)
def report_rows(t: Inputs) -> DataFrame:
    planned = t.table("customer").select(F.concat(F.lit("host-"), F.col("c_custkey").cast("string")).alias("host"))
    per_host = results(t).groupBy("host", "status").agg(F.count("*").alias("n"), F.max("duration_seconds").alias("duration_seconds"))
    rows = rf.report_rows(planned, per_host)
    return rows.select("host", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "status")


@query("env_gate", STATUS + "SELECT o_orderkey, env FROM r WHERE env IN ('1-urgent', '5-low')")
def env_gate(t: Inputs) -> DataFrame:
    return rf.gated(results(t), ["1-URGENT", "5-low"]).select("o_orderkey", "env")


@query("report_hosts", STATUS + "SELECT DISTINCT host FROM r")
def report_hosts(t: Inputs) -> DataFrame:
    rows = results(t)
    return rf.report_hosts(rows.where("role = 'source'"), rows.where("role = 'target'"))


@query(
    "cleanup_gate",
    STATUS
    + """SELECT count(*) FILTER (WHERE status <> 'SUCESSO') AS not_succeeded, count(DISTINCT name) FILTER (WHERE role = 'target') AS dumps,
  count(*) FILTER (WHERE status <> 'SUCESSO') = 0 AND count(DISTINCT name) FILTER (WHERE role = 'target') = 1 AS may_clean FROM r""",
)
def cleanup_gate(t: Inputs) -> DataFrame:
    return rf.cleanup_gate(results(t).withColumn("dump", F.col("name")))


@query(
    "latest_snapshot",
    STATUS
    + "SELECT database, env, name, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY database, env ORDER BY finished_at DESC, name DESC) AS rn FROM r) WHERE rn = 1",
)
def latest_snapshot(t: Inputs) -> DataFrame:
    return rf.latest_snapshot(results(t))


@query(
    "refresh_ready",
    STATUS + "SELECT o_orderkey, host FROM r WHERE role = 'target' AND NOT EXISTS (SELECT 1 FROM r s WHERE s.role = 'source' AND s.code = 0 AND s.status <> 'SUCESSO')",
)
def refresh_ready(t: Inputs) -> DataFrame:
    rows = results(t)
    return rf.refresh_ready(rows.where("role = 'source' AND code = 0"), rows.where("role = 'target'")).select("o_orderkey", "host")


@query(
    "refresh_absent_source",
    STATUS
    + """, done AS (SELECT * FROM r WHERE role = 'source' AND code = 0 AND o_orderkey % 50 <> 7),
planned AS (SELECT DISTINCT host FROM r WHERE role = 'source' AND code = 0)
SELECT (SELECT count(*) FROM planned WHERE host NOT IN (SELECT host FROM done)) AS absent,
  (SELECT count(*) FROM r WHERE role = 'target' AND NOT EXISTS (SELECT 1 FROM planned WHERE host NOT IN (SELECT host FROM done))
   AND NOT EXISTS (SELECT 1 FROM done WHERE status <> 'SUCESSO') AND EXISTS (SELECT 1 FROM planned)) AS started""",
)
def refresh_absent_source(t: Inputs) -> DataFrame:
    """Targets that start when some planned sources have no result at all."""
    rows = results(t)
    sources = rows.where("role = 'source' AND code = 0")
    done, planned = sources.where("o_orderkey % 50 <> 7"), sources.select("host").distinct()
    started = rf.refresh_ready(done, rows.where("role = 'target'"), planned)
    absent = planned.join(done.select("host").distinct(), "host", "left_anti")
    return absent.agg(F.count("*").alias("absent")).withColumn("started", started.agg(F.count("*")).scalar())


@query("refresh_blocked", STATUS + "SELECT o_orderkey FROM r WHERE role = 'target' AND NOT EXISTS (SELECT 1 FROM r s WHERE s.role = 'source' AND s.status <> 'SUCESSO')")
def refresh_blocked(t: Inputs) -> DataFrame:
    rows = results(t)
    return rf.refresh_ready(rows.where("role = 'source'"), rows.where("role = 'target'")).select("o_orderkey")


# ---- failures ----------------------------------------------------------------------------------------------------

# One or two texts per category, and some that fit none.
MESSAGES = {
    "host": ["Permission denied", "read timed out", "No route to host", "failed to transfer file", "'x' is undefined", "odd"],
    "run": [
        "dict object has no attribute", "Expecting value: line 1", "métrica mensal", "NT_STATUS_LOGON", "set_stats", "errno 13", "operation timeout",
        "could not resolve", "Path proibido", "Aplicação zz inexistente", "Ambiente inexistente", "empty host list", "purge_matrix", "Relatório consolidado", "odd",
    ],
    "registry": [
        "sync_wait_timeout", "sync_terminal_failure", "sync_http_error", "next_page acima do limite", "status=429", "expired_token", "insufficient_scope", "status=404",
        "namespace is required", "Nenhum repository mirror", "connection refused", "TIMED OUT", "x509", "cifs", "sync-now", "assertion", "SYNCING", "odd",
    ],
}
TASKS = "CASE WHEN doc_id % 2 = 0 THEN 'Sync | Aguardar repositories retornarem para SUCCESS' ELSE 'other' END"


def _texts(ruleset: str) -> str:
    """Whole documents, each followed by one of the messages."""
    quoted = [m.replace("'", "''") for m in MESSAGES[ruleset]]
    pick = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(quoted))
    return f"SELECT doc_id, text || ' ' || CASE doc_id % {len(quoted)} {pick} END AS text, {TASKS} AS task FROM {{documents}}"


def _category(ruleset: str) -> str:
    def quoted(token: str) -> str:
        return "'" + token.replace("'", "''") + "'"

    cases = []
    for i, (name, alternatives) in enumerate(failures.RULESETS[ruleset]):
        hit = " OR ".join("(" + " AND ".join(f"contains(l, {quoted(x)})" for x in every) + ")" for every in alternatives)
        if ruleset == "registry" and i == 0:
            hit += f" OR (contains(lower(task), '{fv.REGISTRY_WAIT_TASK[0]}') AND contains(l, '{fv.REGISTRY_WAIT_TASK[1]}'))"
        cases.append(f"WHEN {hit} THEN '{name}'")
    return "CASE " + " ".join(cases) + f" ELSE '{fv.UNCLASSIFIED}' END"


def _classified(ruleset: str) -> str:
    return plain(f"WITH c AS (SELECT doc_id, {_category(ruleset)} AS category FROM (SELECT *, lower(text) AS l FROM ({_texts(ruleset)}))) ")


@query("classify_failure_host", _classified("host") + "SELECT doc_id, category FROM c")
def classify_failure_host(t: Inputs) -> DataFrame:
    return failures.classify_failure(t.sql(_texts("host")), "host").select("doc_id", "category")


@query("classify_failure_run", _classified("run") + "SELECT doc_id, category FROM c")
def classify_failure_run(t: Inputs) -> DataFrame:
    return failures.classify_failure(t.sql(_texts("run")), "run").select("doc_id", "category")


@query("classify_failure_registry", _classified("registry") + "SELECT doc_id, category FROM c")
def classify_failure_registry(t: Inputs) -> DataFrame:
    return failures.classify_failure(t.sql(_texts("registry")), "registry", task="task").select("doc_id", "category")


GUIDANCE = [("Timeout", "wait and try again"), ("Permissão insuficiente", "ask for access")]


@query(
    "with_guidance",
    _classified("run")
    + f"""SELECT doc_id, category, CASE category WHEN 'Timeout' THEN 'wait and try again' WHEN 'Permissão insuficiente' THEN 'ask for access' ELSE '{failures.DEFAULT_ADVICE}' END AS guidance,
  CASE WHEN category IN ('Timeout', 'Falha de conectividade', 'Falha no CIFS/anexos', '{fv.UNCLASSIFIED}') THEN 'warn' ELSE 'crit' END AS badge FROM c""",
)
def with_guidance(t: Inputs) -> DataFrame:
    found = failures.classify_failure(t.sql(_texts("run")), "run").select("doc_id", "category")
    return failures.with_guidance(found, GUIDANCE)


TASK_RESULTS = """SELECT event_id, 'host-' || CAST(user_id AS VARCHAR(20)) AS host, event_type, event_id % 5 AS shape FROM {events}"""


def task_results(t: Inputs) -> DataFrame:
    text = "CAST(NULL AS STRING)"

    def item(name: str, failed: str, unreachable: str, msg: str, stderr: str) -> str:
        return (
            f"named_struct('item', {name}, 'failed', {failed}, 'unreachable', {unreachable}, 'msg', {msg}, 'stderr', {stderr}, "
            f"'stdout', {text}, 'exception', {text})"
        )

    yes, no = "true", "CAST(NULL AS BOOLEAN)"
    results_of = f"""CASE shape WHEN 0 THEN array({item("event_type", yes, no, "concat(' m ', host)", text)}, {item("'fine'", no, no, "'skip'", text)}, {item(text, no, yes, text, "'err'")})
        WHEN 1 THEN array({item("'a'", yes, no, text, text)}) WHEN 2 THEN array({item("'a'", no, no, text, text)}) END"""
    raw = f"""named_struct('results', {results_of}, 'msg', IF(shape = 3, concat('main ', event_type), NULL), 'stderr', {text}, 'stdout', IF(shape = 2, ' out ', NULL), 'exception', {text})"""
    return t.sql(TASK_RESULTS).selectExpr("event_id", "host", f"{raw} AS raw")


@query(
    "failure_details",
    plain(
        f"""WITH e AS ({TASK_RESULTS})
SELECT event_id, host, 0 AS position, CASE shape WHEN 0 THEN event_type || ': m ' || host WHEN 1 THEN 'a: Erro não detalhado' WHEN 2 THEN 'out' WHEN 3 THEN 'main ' || event_type ELSE 'Erro técnico não mapeado' END AS detail FROM e
UNION ALL SELECT event_id, host, 1, 'item não identificado: err' FROM e WHERE shape = 0"""
    ),
)
def failure_details(t: Inputs) -> DataFrame:
    return failures.failure_details(task_results(t))


@query(
    "failed_host_rows",
    plain(
        f"""WITH e AS ({TASK_RESULTS}), d AS (SELECT host, event_id, CASE WHEN shape % 2 = 0 THEN 'ssh: connection lost' ELSE 'no words' END AS text FROM e)
SELECT host, '{fv.RULE_FAILED}' AS rule, 'failed' AS status, CASE WHEN text LIKE 'ssh%' THEN 'Falha de conectividade' ELSE '{fv.UNCLASSIFIED}' END AS status_detail,
  'Categoria: ' || CASE WHEN text LIKE 'ssh%' THEN 'Falha de conectividade' ELSE '{fv.UNCLASSIFIED}' END || '|Task: copy|' || text || repeat('|' || repeat(text, 120), 14) AS errors FROM d"""
    ),
)
def failed_host_rows(t: Inputs) -> DataFrame:
    text = F.when(F.col("shape") % 2 == 0, "ssh: connection lost").otherwise("no words")
    broken = failures.classify_failure(t.sql(TASK_RESULTS).withColumn("text", text), "host")
    details = F.concat(F.array("text"), F.array_repeat(F.repeat("text", F.lit(120)), 14))  # many, and long
    rows = runs.failed_host_rows(broken.select("host", "category", F.lit(" copy ").alias("task"), details.alias("details")))
    return rows.select("host", "rule", "status", "status_detail", F.array_join("fatal_errors", "|").alias("errors"))
