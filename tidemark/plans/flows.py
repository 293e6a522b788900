"""The jobs a user runs, from landed data to results, built from the operators.

Results that several later steps need are cut off from their lineage with a reliable checkpoint in the shared folder,
so they are computed once and survive the loss of executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import masking, runs
from tidemark.operators import reconcile as rc
from tidemark.operators import refresh as rf
from tidemark.operators import retention as rt
from tidemark.operators import savings as sv
from tidemark.session import use_checkpoint_dir
from tidemark.sources import landed


def reconcile_job(
    repository_pages: DataFrame,
    mirror_responses: DataFrame,
    source_pages: DataFrame,
    target_pages: DataFrame,
    exceptions: Sequence[str] = (),
    fail_on_divergence: bool = False,
) -> dict[str, DataFrame]:
    """Compare two registries from their landed pages."""
    use_checkpoint_dir(repository_pages.sparkSession)
    repositories = landed.repositories_from_pages(repository_pages).checkpoint()
    source = repositories.where("side = 'source'")
    target = repositories.where("side = 'target'")
    configs = landed.mirror_configs_from_responses(mirror_responses).join(
        rc.mirrors_only(target).select("repository"), "repository", "left_semi"
    )
    tags = {
        side: landed.tags_from_pages(pages, side).withColumnRenamed("manifest_digest", "digest")
        for side, pages in (("source", source_pages), ("target", target_pages))
    }
    errors = landed.tag_errors_from_pages(source_pages, "source").unionByName(
        landed.tag_errors_from_pages(target_pages, "target")
    )
    compared = rc.Comparison(tags["source"], tags["target"], configs, errors)
    rows = compared.rows.checkpoint()
    summary = compared.summary(rows=rows)
    return {
        "rows": rows,
        "summary": rc.enforce_policy(summary, fail_on_divergence),
        "status_counts": rc.status_counts(rows),
        "candidates": rc.sync_candidates(rows),
        "repositories": rc.classify_repositories(source, target.select("repository", "state"), exceptions),
        "configs": configs,
        "visible": rc.visible_rows(rows),
        "level": rc.report_level(rows),
    }


def sync_job(
    before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], responses: DataFrame, waits: DataFrame, mode: str = "sync"
) -> dict[str, DataFrame]:
    """What a sync run did, from the comparison before it, the answers of its calls and waits, and the comparison after it.

    ``before`` and ``after`` are results of ``reconcile_job``; ``responses`` and ``waits`` have an ``arrival`` column.
    """
    use_checkpoint_dir(responses.sparkSession)
    actions = rc.sync_actions(responses).checkpoint()
    progress = rc.sync_progress(before["candidates"], actions, waits, before["rows"], after["rows"]).checkpoint()
    return {
        "actions": actions,
        "progress": progress,
        "transitions": rc.sync_transitions(before["rows"], after["rows"]),
        "result": rc.sync_result(mode, before["summary"], after["summary"], actions, waits, progress),
    }


def purge_job(
    files: DataFrame,
    plan: DataFrame,
    as_of: datetime,
    mode: str = "check",
    confirmed: bool = False,
    failures: DataFrame | None = None,
    samples: int = 50,
    listing: DataFrame | None = None,
    dirs: DataFrame | None = None,
    states: DataFrame | None = None,
    job: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Run a resolved plan (host, rule_id, ...) over a file inventory.

    ``listing`` (host, path, is_dir, message) tells which planned paths exist; ``dirs`` (host, path) holds directories that
    are there besides those above a file, empty ones among them; ``states`` (host, started, completed, failure_recorded)
    adds a failed row for every host whose run broke off. ``job`` (job_id, month, and what else a record tells) adds the
    job's nested ``metric`` records as worth keeping: none, or one.
    """
    use_checkpoint_dir(files.sparkSession)
    apply = mode == "apply" and confirmed
    known, unknown = rt.split_engines(rt.enabled_rules(plan))
    guarded = rt.guard_paths(rt.rule_errors(rt.normalize_rules(known))).checkpoint()
    found = rt.match_files(files, guarded, as_of).checkpoint()
    survivors, ledger = rt.apply_retention(files, found, failures, mode, confirmed)
    counts = rt.directory_counts(files, ledger.where("deleted").select("host", "path"), dirs)
    empty = rt.empty_dirs(counts, guarded, as_of).checkpoint()

    keys = ["host", "rule_id"]
    counters = rt.rule_counters(ledger, apply)
    if apply:
        removed = empty.groupBy(*keys).agg(F.count("*").alias("removed_empty_dirs"))
        counters = counters.join(removed, keys, "full_outer")
    held = guarded.drop("missing", "path_errors")
    none = F.array().cast("array<struct<path: string, reason: string>>")
    if listing is None:
        held = held.withColumns({"missing": none, "path_errors": F.lit(0).cast("bigint")})
    else:
        seen = rt.path_state(guarded, listing, keys)
        missing = F.when(F.col("state") == "missing", F.struct("path", "reason"))
        per_rule = seen.groupBy(*keys).agg(
            F.sort_array(F.collect_list(missing)).alias("missing"), F.count_if(F.col("state") == "error").alias("path_errors")
        )
        held = held.join(per_rule, keys, "left").withColumn("missing", F.coalesce("missing", none))
    rows = runs.rule_rows(held, counters, apply)
    refused = rt.guard_paths(rt.rule_errors(rt.normalize_rules(unknown))).drop("missing", "path_errors")
    refused = runs.rule_rows(refused.withColumns({"missing": none, "path_errors": F.lit(0).cast("bigint")}), counters.limit(0), apply)
    refused = refused.withColumns({"status": F.lit("blocked"), "status_detail": F.lit(fv.UNKNOWN_ENGINE_DETAIL)})
    rows = rows.unionByName(refused).withColumn("rule", F.col("rule_id")).checkpoint()
    if states is not None:
        lost = runs.complete_reports(states, rows.limit(0))
        rows = rows.unionByName(lost, allowMissingColumns=True)
    done = {}
    if job is not None:
        own = rows.withColumn("job_id", F.lit(job["job_id"]))
        reports = own.groupBy("job_id", "host").agg(
            F.min("os").alias("os"), F.sort_array(F.collect_set("environment")).alias("envs"),
            F.sort_array(F.collect_set("application")).alias("applications"),
        )
        records, large = sv.metric_documents(files.sparkSession.createDataFrame([dict(job)]), reports, own)
        done = {"metric": sv.publishable(records, apply), "metric_too_large": large}
    return {
        **done,
        "survivors": survivors,
        "ledger": ledger,
        "rows": rows,
        "unsupported": unknown,
        "samples": rt.rule_samples(found, samples, materialized=True),
        "totals": runs.run_totals(rows, plan.select("host")),
        "host_savings": runs.host_savings(rows, apply),
        "empty_dirs": empty,
    }


def savings_month_job(spark: SparkSession, raw_folder: str, store: str, month: str) -> tuple[DataFrame, bool]:
    """Consolidate a month from its raw metric files; tells whether the raw files may be dropped."""
    raw = landed.read_metrics(spark, raw_folder, month)
    droppable = sv.store_month(raw, month, store)
    held = sv.stored_months(spark, store, raw)
    return sv.consolidate_month(held.where(F.col("month") == month), month)[0], droppable


def savings_year_job(spark: SparkSession, documents: str, store: str, year: str) -> DataFrame:
    """Head of a year from its stored executions, after the files of ``documents`` not consumed yet have been added to them."""
    return sv.consume_year(spark, documents, store, year)[0]


def refresh_job(
    spark: SparkSession,
    source: Mapping[str, DataFrame],
    target: Mapping[str, DataFrame],
    results: DataFrame,
    env: str,
    preserve: Sequence[str] = (),
    truncate: Sequence[str] = (),
    protected: Sequence[str] = (),
    masks: Mapping[str, tuple[Sequence[str], Sequence[Mapping]]] | None = None,
    views: Mapping[str, str] | None = None,
    checks: Sequence[rf.Check] = (),
    seed: str | None = None,
    planned: DataFrame | None = None,
    journal: str | None = None,
    captured: DataFrame | None = None,
    present: DataFrame | None = None,
) -> DataFrame | None:
    """Load, keep, empty, mask, derive views and collect statistics beside the live tables, publish, then check.

    ``masks`` holds, per table, its key columns and the rows of its masking spec; masking needs a ``seed``, or its order
    could be told from the keys alone. Nothing starts unless every source finished: those in ``planned`` (host), each with a
    row in ``results``. Tables are published all or none, with their steps in the ``journal`` table if one is named. Returns the
    checks' outcome, each row with the run's ``run_status``; with the privileges ``captured`` before and those ``present`` now
    also the statements that bring the former back.
    """
    if rf.refresh_ready(results, spark.range(1), planned).isEmpty():
        raise RuntimeError("the sources did not all finish")
    if masks and not seed:
        raise ValueError("masking needs a seed")
    fresh = rf.refresh_tables(source, target, preserve, truncate, env, protected=protected)
    for name, (keys, spec) in (masks or {}).items():
        fresh[name] = masking.mask_by_spec(fresh[name], keys, spec, seed)
    staged = rf.stage(fresh)
    staged += rf.stage_views(spark, views or {}, list(fresh))
    rf.analyze(spark, staged)
    rf.publish(spark, [*fresh, *(views or {})], journal=journal)
    outcome = rf.with_run_status(rf.run_checks(checks)) if checks else None
    if captured is None or present is None:
        return outcome
    return outcome, rf.grant_difference(captured, present)
