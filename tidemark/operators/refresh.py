"""Refreshing one environment from another: plan, preserved and emptied tables, staging, checks, status."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import text as tx
from tidemark.operators.common import preview, unique_or_fail
from tidemark.session import prepare


# ---- plan --------------------------------------------------------------------------------------------------------


def overlay(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Settings (key, value) of one database over the defaults."""
    left = defaults.select("key", F.col("value").alias("_default"))
    right = overrides.select("key", F.col("value").alias("_own"))
    return left.join(right, "key", "full_outer").select("key", F.coalesce("_own", "_default").alias("value"))


def env_gate(env: str, run_on: Sequence[str] = (), protected: Sequence[str] = ()) -> bool:
    """Whether a step runs in an environment; a protected environment stops the job before anything is written."""
    name = env.lower()
    if name in [p.lower() for p in protected]:
        raise PermissionError(f"environment {env} is protected")
    return not run_on or name in [r.lower() for r in run_on]


def gated(df: DataFrame, run_on: Sequence[str] = (), column: str = "env") -> DataFrame:
    return df.where(F.lower(column).isin([r.lower() for r in run_on])) if run_on else df


def flatten_hosts(df: DataFrame, database: str, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Hosts configured as one text, as a map (name to address) or as a list of entries, as one table.

    Columns: env, host_text, host_map, host_list (array of name, ansible_host, enabled, source, database_name, port).
    """
    env = F.trim(F.lower("env"))
    fields = {"enabled": "boolean", "source": "boolean", "database_name": "string", "port": "string"}
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in fields.items()]
    single = df.where(F.col("host_text").isNotNull()).select(
        env.alias("env"), F.concat(env, F.lit(f"-{database}-01")).alias("name"), F.col("host_text").alias("ansible_host"), *blank
    )
    named = df.select(env.alias("env"), F.explode("host_map").alias("name", "ansible_host")).select(
        "env", "name", F.coalesce("ansible_host", "name").alias("ansible_host"), *blank
    )
    listed = df.select(env.alias("env"), F.inline("host_list")).select(
        "env",
        F.coalesce("name", "ansible_host").alias("name"),
        F.coalesce("ansible_host", "name").alias("ansible_host"),
        *fields,
    )
    hosts = single.unionByName(named).unionByName(listed)
    values = {"database_name": database, "port": "5432", **(defaults or {})}
    hosts = hosts.withColumns({"enabled": F.coalesce("enabled", F.lit(True))})
    for name, value in values.items():
        hosts = hosts.withColumn(name, F.coalesce(name, F.lit(value)) if name in fields else F.lit(value))
    return hosts


def select_hosts(hosts: DataFrame, role: str, envs: Sequence[str], wanted: Sequence[str] = ()) -> DataFrame:
    """Candidate hosts of a role: enabled, in the environments, and named by the filter (name or address) if any."""
    env = F.lower("env")
    chosen = hosts.where(F.coalesce("enabled", F.lit(True)) & env.isin([e.lower() for e in envs]))
    if role == "source":
        chosen = chosen.where(F.coalesce("source", env.isin([e.lower() for e in envs])))
    if wanted:
        names = [w.lower() for w in wanted]
        chosen = chosen.where(F.lower("name").isin(names) | F.lower("ansible_host").isin(names))
    return chosen.withColumn("role", F.lit(role))


def validate_plan(plan: DataFrame, action: str, confirmed: bool = False) -> DataFrame:
    """What is wrong with the selected hosts (columns role, restore_mode), one row per violation."""
    counts = plan.agg(
        F.count_if(F.col("role") == "source").alias("sources"),
        F.count_if(F.col("role") == "target").alias("targets"),
        F.count_if((F.col("role") == "target") & ~F.col("restore_mode").isin("promote", "drop_in_place")).alias("bad_modes"),
    )
    needs_source, needs_target = F.lit(action in ("backup", "sync")), F.lit(action in ("restore", "sync"))
    found = F.array_compact(
        F.array(
            F.when(needs_source & (F.col("sources") != 1), "exactly one source is needed"),
            F.when(needs_target & (F.col("targets") == 0), "at least one target is needed"),
            F.when(
                F.lit(action == "restore" and not confirmed) & (F.col("targets") > 1), "several targets need a confirmation"
            ),
            F.when(needs_target & (F.col("bad_modes") > 0), "unknown restore mode"),
        )
    )
    return counts.select(F.explode(found).alias("violation"), "sources", "targets")


def refresh_ready(results: DataFrame, targets: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Targets that may start: all of them when every planned source (``host``) succeeded, else none.

    A planned source without a result has not run. Without a plan the results name the sources; none at all block too.
    """
    status = F.coalesce("status", F.lit(fv.NOT_RUN))
    sources = _with_absent(results, planned)
    ready = sources.agg((F.count("*") > 0) & (F.count_if(status != fv.SUCCEEDED) == 0)).scalar()
    return targets.where(ready)


def _with_absent(results: DataFrame, planned: DataFrame | None) -> DataFrame:
    """Results plus a row without status for every planned host that has none."""
    if planned is None:
        return results
    absent = planned.select("host").distinct().join(results.select("host").distinct(), "host", "left_anti")
    return results.unionByName(absent, allowMissingColumns=True)


def latest_snapshot(dumps: DataFrame) -> DataFrame:
    """Newest dump per database and environment; the name decides between equal times."""
    order = F.struct("finished_at", "name")
    return dumps.groupBy("database", "env").agg(
        F.max_by("name", order).alias("name"), F.max("finished_at").alias("finished_at")
    )


# ---- tables ------------------------------------------------------------------------------------------------------


def refresh_tables(
    source: Mapping[str, DataFrame],
    target: Mapping[str, DataFrame],
    preserve: Sequence[str] = (),
    truncate: Sequence[str] = (),
    env: str = "",
    run_on: Sequence[str] = (),
    truncate_on: Sequence[str] = (),
    protected: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """New content of every table: the target's own rows where preserved, nothing where emptied, else the source's."""
    keep = set(preserve) if env_gate(env, run_on, protected) else set()
    clear = set(truncate) if env_gate(env, truncate_on, protected) else set()
    unknown = keep - set(target)
    if unknown:
        raise ValueError(f"preserved tables missing on the target: {sorted(unknown)}")
    names = list(source) + [n for n in keep if n not in source]
    fresh = {}
    for name in names:
        frame = target[name] if name in keep else source[name]
        fresh[name] = frame.limit(0) if name in clear and name not in keep else frame
    return fresh


def truncate_tables(tables: Mapping[str, DataFrame], names: Sequence[str], env: str, run_on: Sequence[str] = ()) -> dict:
    empty = set(names) if env_gate(env, run_on) else set()
    return {name: frame.limit(0) if name in empty else frame for name, frame in tables.items()}


def stage(frames: Mapping[str, DataFrame], suffix: str = "_restoring") -> list[str]:
    """Write every table beside the live one."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").saveAsTable(name + suffix)
    return [name + suffix for name in frames]


JOURNAL = "run string, step int, name string, action string"


def publish(spark: SparkSession, names: Sequence[str], suffix: str = "_restoring", old: str = "_old", journal: str | None = None) -> str:
    """Put staged tables in place of the live ones and keep those under another name; all of them, or none.

    Where a step fails, the steps before it are taken back in reverse order and the failure is raised again. With a
    ``journal`` table every step is written down before it is made, so that ``take_back`` can undo a run whose driver was
    lost. Returns the run's name in the journal.
    """
    run, steps = uuid.uuid4().hex, []

    def step(name: str, action: str) -> None:
        if journal is not None:
            line = spark.createDataFrame([(run, len(steps), name, action)], JOURNAL)
            line.write.mode("append").saveAsTable(journal)
        steps.append((name, action))
        if action != "finished":
            first, second = _renamed(name, action, suffix, old)
            spark.sql(f"ALTER TABLE {first} RENAME TO {second}")

    try:
        for name in names:
            if not spark.catalog.tableExists(name + suffix):
                raise ValueError(f"nothing is staged for {name}")
        for name in names:
            if spark.catalog.tableExists(name):
                spark.sql(f"DROP TABLE IF EXISTS {name}{old}")
                step(name, "keep")
            step(name, "publish")
    except Exception:
        _undo(spark, steps, suffix, old)
        if journal is not None:
            step("", "finished")
        raise
    step("", "finished")
    return run


def _renamed(name: str, action: str, suffix: str, old: str) -> tuple[str, str]:
    return (name, name + old) if action == "keep" else (name + suffix, name)


def _undo(spark: SparkSession, steps: Sequence[tuple[str, str]], suffix: str, old: str) -> None:
    """Take renames back, the last first. A step that was never made is told by its names and left out."""
    for name, action in reversed(steps):
        if action != "finished":
            first, second = _renamed(name, action, suffix, old)
            if spark.catalog.tableExists(second) and not spark.catalog.tableExists(first):
                spark.sql(f"ALTER TABLE {second} RENAME TO {first}")


def take_back(spark: SparkSession, journal: str, suffix: str = "_restoring", old: str = "_old") -> list[str]:
    """Undo the runs of a journal that never finished; the names of these runs."""
    steps = spark.table(journal)
    open_runs = steps.groupBy("run").agg(F.bool_or(F.col("action") == "finished").alias("done")).where("not done")
    taken = []
    for row in open_runs.select("run").collect():  # a run that lost its driver; few at any time
        held = steps.where(F.col("run") == row["run"]).orderBy("step").collect()  # two steps a table
        _undo(spark, [(r["name"], r["action"]) for r in held], suffix, old)
        spark.createDataFrame([(row["run"], len(held), "", "finished")], JOURNAL).write.mode("append").saveAsTable(journal)
        taken.append(row["run"])
    return taken


def refresh_views(spark: SparkSession, views: Mapping[str, str], only: Sequence[str] | None = None) -> list[str]:
    """Rebuild derived tables from their registered queries: all, or a listed set."""
    unknown = set(only or ()) - set(views)
    if unknown:
        raise ValueError(f"unknown derived tables: {sorted(unknown)}")
    done = [name for name in views if only is None or name in only]
    for name in done:
        spark.sql(views[name]).write.mode("overwrite").saveAsTable(name)
    return done


def stage_views(spark: SparkSession, views: Mapping[str, str], tables: Sequence[str], suffix: str = "_restoring") -> list[str]:
    """Derived tables from their queries, beside the live ones; the queries see the staged form of ``tables``.

    They run in a session of their own, so temporary views of the caller's session stay as they are (and are not seen).
    """
    own = prepare(spark.newSession())
    own.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    for name in tables:
        own.table(name + suffix).createOrReplaceTempView(name)
    for name, query in views.items():
        own.sql(query).write.mode("overwrite").saveAsTable(name + suffix)
        own.table(name + suffix).createOrReplaceTempView(name)  # later views may build on it
    return [name + suffix for name in views]


def analyze(spark: SparkSession, tables: Sequence[str], columns: bool = True) -> None:
    for name in tables:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if columns else ""))
        now = spark.sql("SELECT CAST(unix_seconds(current_timestamp()) AS STRING)").first()[0]
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{ANALYZED}' = '{now}')")


#: Table property that holds when statistics were collected last, in seconds since 1970.
ANALYZED = "statistics.collected"


def statistics_age(spark: SparkSession, tables: Sequence[str], as_of: datetime | None = None) -> DataFrame:
    """``table_name, collected, age_seconds`` of each table, oldest first; null where statistics were never collected."""
    parts = []
    for name in tables:
        held = spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == ANALYZED)
        parts.append(held.agg(F.lit(name).alias("table_name"), F.max("value").cast("bigint").alias("_at")))
    now = F.unix_seconds(F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp"))
    rows = reduce(DataFrame.unionByName, parts)
    aged = rows.select("table_name", F.timestamp_seconds("_at").alias("collected"), (now - F.col("_at")).alias("age_seconds"))
    return aged.orderBy(F.col("age_seconds").desc_nulls_first(), "table_name")


@dataclass(frozen=True)
class Check:
    """A count that must equal ``expected`` (null: reported only)."""

    name: str
    frame: DataFrame
    condition: Column | None = None
    expected: int | None = 0


def run_checks(checks: Sequence[Check]) -> DataFrame:
    """One row per check: observed, expected, passed."""
    parts = []
    for check in checks:
        rows = check.frame if check.condition is None else check.frame.where(check.condition)
        expected = F.lit(check.expected).cast("bigint")
        parts.append(
            rows.agg(F.lit(check.name).alias("check"), F.count("*").alias("observed")).withColumns(
                {"expected": expected, "passed": F.when(expected.isNull(), F.lit(True)).otherwise(F.col("observed") == expected)}
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@dataclass(frozen=True)
class Listing:
    """Rows to look at: the first ``limit`` of ``frame`` in ``order``, which must decide every tie."""

    name: str
    frame: DataFrame
    order: Sequence[Column | str]
    limit: int = 20


def run_listings(listings: Sequence[Listing]) -> DataFrame:
    """``check, rank, detail``: the rows of every listing in order, each as JSON, and how many more there are (``more``)."""
    parts = []
    for listing in listings:
        rows = preview(listing.frame, listing.order, listing.limit)
        detail = F.to_json(F.struct(*listing.frame.columns), {"ignoreNullFields": "false"}).alias("detail")
        rank = F.row_number().over(Window.orderBy(*listing.order))  # of ``limit`` rows
        parts.append(rows.select(F.lit(listing.name).alias("check"), rank.cast("bigint").alias("rank"), detail, F.col("remaining").alias("more")))
    return reduce(DataFrame.unionByName, parts)


def with_run_status(outcome: DataFrame) -> DataFrame:
    """Check rows with ``run_status``: failed where any check is."""
    broken = outcome.agg(F.coalesce(F.bool_or(~F.col("passed")), F.lit(False))).scalar()
    return outcome.withColumn("run_status", F.when(broken, fv.FAILED).otherwise(fv.SUCCEEDED))


def property_parity(first: DataFrame, second: DataFrame, properties: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Named objects whose properties differ between two sides; null equals null, and some may differ on purpose."""
    compared = [p for p in properties if p not in ignore]

    def side(df: DataFrame, name: str) -> DataFrame:
        return unique_or_fail(df.select("name", F.struct(*compared).alias(name)), ["name"])

    joined = side(first, "_a").join(side(second, "_b"), "name", "full_outer")
    differing = F.array_compact(
        F.array(*[F.when(~F.col(f"_a.{p}").eqNullSafe(F.col(f"_b.{p}")), F.lit(p)) for p in compared])
    )
    state = (
        F.when(F.col("_b").isNull(), "only_first")
        .when(F.col("_a").isNull(), "only_second")
        .when(F.size(differing) > 0, "different")
        .otherwise("equal")
    )
    return joined.select("name", state.alias("state"), F.array_join(differing, "|").alias("differing"))


def quote_name(name: Column | str) -> Column:
    """Identifier in quotes unless it is a plain lower-case name."""
    value = tx.col(name)
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(value, F.lit(r"\A[a-z_][a-z0-9_$]*\z")), value).otherwise(quoted)


def catalog_objects(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """Objects with the name of their schema. Default privileges may belong to no schema; other objects need one."""
    names = schemas.select("schema_id", F.col("name").alias("schema"))
    joined = objects.join(names, "schema_id", "left")
    return joined.where(F.col("schema").isNotNull() | (F.col("kind") == "default")).drop("schema_id")


def with_default_acl(objects: DataFrame) -> DataFrame:
    """Objects without a privilege list get the list their owner has by default (columns kind, owner, acl)."""

    def granted(grantee: Column, privileges: Sequence[str]) -> list[Column]:
        return [F.struct(grantee.alias("grantee"), F.lit(p).alias("privilege"), F.lit(False).alias("grantable")) for p in privileges]

    chain = F.when(F.col("acl").isNotNull(), F.col("acl"))
    for kind, privileges in fv.OWNER_PRIVILEGES.items():
        everyone = granted(F.lit(""), fv.PUBLIC_PRIVILEGES.get(kind, []))
        chain = chain.when(F.col("kind") == kind, F.array(*everyone, *granted(F.col("owner"), privileges)))
    return objects.withColumn("acl", chain)


GRANTED = ["kind", "schema", "name", "arguments", "object_type"]


def _granted(objects: DataFrame) -> DataFrame:
    """One row per privilege of the objects that may be granted on; an empty grantee means PUBLIC."""
    schema = F.coalesce("schema", F.lit(""))
    visible = ~schema.isin(fv.SYSTEM_SCHEMAS) & ~schema.startswith("pg_toast")
    return objects.where(visible | (F.col("kind") == "default")).select(*GRANTED, F.inline("acl"))


def _statement(database: str, revoke: Column | bool = False, option: Column | None = None) -> Column:
    """The statement of a row of ``_granted``; ``option`` tells whether it is about the grant option."""
    revoke = F.lit(revoke) if isinstance(revoke, bool) else revoke
    who = F.when(F.coalesce("grantee", F.lit("")).isin("", "PUBLIC"), "PUBLIC").otherwise(quote_name("grantee"))
    option = F.coalesce("grantable", F.lit(False)) if option is None else option
    with_option = F.when(option & ~revoke & (F.col("kind") != "database"), " WITH GRANT OPTION").otherwise("")
    qualified = F.concat(quote_name("schema"), F.lit("."), quote_name("name"))
    words = F.create_map(*[F.lit(x) for pair in fv.DEFAULT_ACL_WORDS.items() for x in pair])
    what = (
        F.when(F.col("kind") == "database", F.lit(f'DATABASE "{database}"'))
        .when(F.col("kind") == "schema", F.concat(F.lit("SCHEMA "), quote_name("schema")))
        .when(F.col("kind") == "table", F.concat(F.lit("TABLE "), qualified))
        .when(F.col("kind") == "sequence", F.concat(F.lit("SEQUENCE "), qualified))
        .when(
            F.col("kind") == "function",
            F.concat(F.lit("FUNCTION "), qualified, F.lit("("), F.coalesce("arguments", F.lit("")), F.lit(")")),
        )
        .when(F.col("kind") == "default", F.coalesce(F.try_element_at(words, F.col("object_type")), F.lit("TABLES")))
    )
    default_head = F.concat(
        F.lit("ALTER DEFAULT PRIVILEGES FOR ROLE "),
        quote_name("name"),
        F.when(F.col("schema").isNotNull(), F.concat(F.lit(" IN SCHEMA "), quote_name("schema"))).otherwise(""),
        F.lit(" "),
    )
    head = F.when(F.col("kind") == "default", default_head).otherwise("")
    verb = F.when(~revoke, "GRANT ").when(option, "REVOKE GRANT OPTION FOR ").otherwise("REVOKE ")
    to = F.when(revoke, " FROM ").otherwise(" TO ")
    return F.concat(head, verb, F.col("privilege"), F.lit(" ON "), what, to, who, with_option, F.lit(";"))


def grant_statements(objects: DataFrame, database: str = "database") -> DataFrame:
    """Grant statements of objects: kind, schema, name, arguments, object_type, acl (grantee, privilege, grantable).

    Kinds: database, schema, table, sequence, function, default. An empty grantee means PUBLIC.
    """
    return _granted(objects).select("kind", "schema", "name", "privilege", _statement(database).alias("statement"))


def grant_difference(captured: DataFrame, present: DataFrame, database: str = "database") -> DataFrame:
    """The least statements that turn the privileges of ``present`` into the captured ones (objects as in ``grant_statements``).

    Both sides are added up per object, grantee and privilege in one pass: what only one side holds is granted or revoked, and
    where the grant option differs it alone is. ``action`` is grant, revoke or revoke_option; revokes come first in ``step``.
    A database's privileges have no option.
    """
    who = F.when(F.coalesce("grantee", F.lit("")) == "PUBLIC", "").otherwise(F.coalesce("grantee", F.lit("")))
    option = F.coalesce("grantable", F.lit(False)) & (F.col("kind") != "database")

    def side(objects: DataFrame, name: str) -> DataFrame:
        return _granted(objects).select(*GRANTED, who.alias("grantee"), "privilege", option.alias(name))

    both = side(captured, "_wanted").unionByName(side(present, "_held"), allowMissingColumns=True)
    keyed = both.groupBy(*GRANTED, "grantee", "privilege").agg(F.max("_wanted").alias("_wanted"), F.max("_held").alias("_held"))
    action = (
        F.when(F.col("_wanted").isNull(), "revoke")
        .when(F.col("_held").isNull() | (F.col("_wanted") & ~F.col("_held")), "grant")
        .when(~F.col("_wanted") & F.col("_held"), "revoke_option")
    )
    changed = keyed.withColumn("action", action).where("action is not null").withColumn("grantable", F.coalesce("_wanted", F.lit(False)))
    revoke = F.col("action") != "grant"
    about_option = F.when(revoke, F.col("action") == "revoke_option").otherwise(F.col("grantable"))
    statement = _statement(database, revoke, about_option).alias("statement")
    step = F.when(revoke, 1).otherwise(2).alias("step")
    return changed.select("kind", "schema", "name", "grantee", "privilege", "action", step, statement)


def database_privileges(roles: DataFrame, held: str = "privileges") -> DataFrame:
    """Roles with the database privileges they hold, as objects for ``grant_statements``; system roles left out."""
    wanted = F.filter(F.array(*[F.lit(p) for p in fv.DATABASE_PRIVILEGES]), lambda p: F.array_contains(F.col(held), p))
    acl = F.transform(
        wanted, lambda p: F.struct(F.col("role").alias("grantee"), p.alias("privilege"), F.lit(False).alias("grantable"))
    )
    text = F.lit(None).cast("string")
    return roles.where(~F.col("role").startswith("pg_")).select(
        F.lit("database").alias("kind"),
        text.alias("schema"),
        F.col("role").alias("name"),
        text.alias("arguments"),
        text.alias("object_type"),
        acl.alias("acl"),
    )


# ---- results -----------------------------------------------------------------------------------------------------


def overall_status(results: DataFrame, controller_failed: bool = False, cleanup_warning: bool = False) -> DataFrame:
    """FALHA if any host failed, else SUCESSO COM AVISO if any warned, else SUCESSO."""
    failed = F.coalesce(F.bool_or(F.col("status") == fv.FAILED), F.lit(False)) | F.lit(controller_failed)
    warned = F.coalesce(F.bool_or(F.col("status") == fv.WARNED), F.lit(False)) | F.lit(cleanup_warning)
    return results.agg(F.count("*").alias("hosts"), tx.run_status(failed, warned).alias("overall_status"))


def report_rows(hosts: DataFrame, results: DataFrame) -> DataFrame:
    """One row per host of the plan; hosts without a result have not run."""
    joined = hosts.select("host").distinct().join(results, "host", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("status", F.lit(fv.NOT_RUN)),
            "duration": tx.hms(F.coalesce("duration_seconds", F.lit(0).cast("bigint"))),
        }
    )


def report_hosts(sources: DataFrame, targets: DataFrame) -> DataFrame:
    return sources.select("host").union(targets.select("host")).distinct()


def cleanup_gate(results: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """A shared dump may go when every host succeeded and the targets used exactly one dump.

    ``planned`` names the hosts that must have a result; one without has not succeeded.
    """
    results = _with_absent(results, planned)
    status = F.coalesce("status", F.lit(fv.NOT_RUN))
    used = F.when(F.col("role") == "target", F.nullif(F.col("dump"), F.lit("")))
    gate = results.agg(F.count_if(status != fv.SUCCEEDED).alias("not_succeeded"), F.count_distinct(used).alias("dumps"))
    return gate.withColumn("may_clean", (F.col("not_succeeded") == 0) & (F.col("dumps") == 1))
