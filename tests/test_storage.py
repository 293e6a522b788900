"""Readers, writers and tables on disk."""

import json
from datetime import timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import refresh as rf
from tidemark.operators import savings as sv
from tidemark.plans import flows
from tidemark import schemas
from tidemark.sources import landed, sinks
from tidemark.sources.sinks import write_metric_documents


@pytest.fixture()
def metrics(tmp_path):
    def put(month, job, size, name=None):
        record = {"schema_version": 1, "job_id": job, "month": month, "total_deleted_files": 2, "total_deleted_bytes": size, "total_failed_files": 0, "hosts": [{"host": "h1"}], "envs": ["prd"]}
        (tmp_path / (name or f"metric_{month}_{job}.json")).write_text(json.dumps(record, indent=2))

    put("202401", "j1", 100)
    put("202401", "j2", 50)
    put("202402", "j3", 7)
    put("202401", "j4", 999, "metric_2024_j4.json")
    put("202401", "j5", 999, "other.json")
    return tmp_path


def test_metrics_are_chosen_by_file_name(spark, metrics):
    month = landed.read_metrics(spark, str(metrics), "202401")
    assert sorted(r["job_id"] for r in month.collect()) == ["j1", "j2"]
    assert landed.read_metrics(spark, str(metrics)).count() == 3
    assert sv.member_counts(month, {"host": F.col("hosts.host"), "env": "envs", "month": "month"}).where("kind = 'host'").first()["n"] == 1


def test_month_is_stored_once_and_read_back(spark, metrics, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store") / "months")
    head, droppable = flows.savings_month_job(spark, str(metrics), store, "202401")
    assert droppable and head.first()["total_deleted_bytes"] == 150 and head.first()["execution_count"] == 2
    head, droppable = flows.savings_month_job(spark, str(metrics), store, "202402")
    assert droppable and head.first()["total_deleted_bytes"] == 7
    # A stored month is reused, also when the raw files have changed.
    head, droppable = flows.savings_month_job(spark, str(metrics), store, "202401")
    assert not droppable and head.first()["total_deleted_bytes"] == 150


def test_consolidated_files(spark, tmp_path):
    record = {"period_type": "month", "month": "202401", "executions": [{"job_id": "a", "month": "202401", "total_deleted_bytes": 5}, {"job_id": "b", "month": "202401"}]}
    (tmp_path / "monthly_202401.json").write_text(json.dumps(record))
    held = landed.read_consolidated(spark, str(tmp_path), "202401")
    assert sorted(r["job_id"] for r in held.collect()) == ["a", "b"]
    assert sv.period_totals(held).first()["total_deleted_bytes"] == 5
    assert sv.missing_months(held, "2024").count() == 11
    with pytest.raises(Exception, match="not in 202402"):
        sv.assert_period(held, "202402").collect()


def test_year_falls_back_to_raw_months(spark):
    columns = "job_id string, month string, total_deleted_files long, total_deleted_bytes long, total_failed_files long"
    held = spark.createDataFrame([("a", "202401", 1, 10, 0), ("b", "202402", 1, 10, 0)], columns)
    raw = spark.createDataFrame([("a", "202401", 9, 99, 0), ("c", "202403", 2, 20, 1), ("d", "202301", 9, 99, 9)], columns)
    head, executions = sv.consolidate_year(held, raw, "2024")
    row = head.first()
    assert (row["total_deleted_bytes"], row["execution_count"], row["total_failed_files"]) == (40, 3, 1)
    assert row["missing_months"].startswith("202403,") and row["months_without_any_data"].startswith("202404,")
    assert sorted(r["job_id"] for r in executions.collect()) == ["a", "b", "c"]
    assert len(sv.monthly_summary(executions, "2024").collect()) == 12
    assert sv.publishable(raw, applied=False).count() == 0


def test_comparison_csv_quotes_everything(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r", 't"1', "OK", "ok", "SUCCESS", True, "a,b", "", "", "m")],
        "repository string, tag string, status string, severity string, mirror_status string, mirror_enabled boolean, filter string, source_digest string, target_digest string, message string",
    )
    sinks.write_comparison_csv(rows, str(tmp_path / "q"))
    text = "".join(p.read_text() for p in (tmp_path / "q").glob("*.csv"))
    assert '"r","t""1","OK"' in text and '"a,b","",""' in text and text.startswith('"repository"') or "repository" in text.splitlines()[0]
    sinks.write_comparison_csv(rows, str(tmp_path / "m"), quote_all=False)
    plain = "".join(p.read_text() for p in (tmp_path / "m").glob("*.csv"))
    assert 'r,"t""1",OK' in plain


def test_audit_log_round_trip(spark, tmp_path):
    ledger = spark.createDataFrame([("t1", "h", "linux", "rule | x", 5, "/a | b")], "ts string, host string, os string, rule string, size long, path string")
    sinks.write_audit(ledger, str(tmp_path / "a"))
    row = landed.read_audit(spark, str(tmp_path / "a")).first()
    assert tuple(row) == ("t1", "h", "linux", "rule | x", 5, "/a | b")


def test_json_is_read_back_whole(spark, tmp_path):
    rows = spark.range(10).withColumn("month", F.lit("202401"))
    sinks.write_json(rows, str(tmp_path / "j"))
    assert sinks.drop_written(rows, str(tmp_path / "j")) == 0
    assert sinks.drop_written(rows.withColumn("month", F.lit("x")), str(tmp_path / "j")) == 10


def test_inventory_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_text("12345")
    (tmp_path / "sub" / "b.log").write_text("1")
    flat = landed.scan_inventory(spark, [str(tmp_path)])
    assert [(r["filename"], r["size"], r["path"]) for r in flat.collect()] == [("a.log", 5, str(tmp_path / "a.log"))]
    assert landed.scan_inventory(spark, [str(tmp_path)], recursive=True).count() == 2


def test_tree_listing_includes_hidden_names(spark, tmp_path):
    (tmp_path / "sub" / ".deep").mkdir(parents=True)
    (tmp_path / ".keep").write_text("1")
    (tmp_path / "_x.log").write_text("22")
    (tmp_path / "sub" / ".deep" / "y").write_text("333")
    (tmp_path / "link").symlink_to(tmp_path / "sub")
    flat = {r["filename"]: (r["size"], r["is_dir"]) for r in landed.list_tree(spark, [str(tmp_path)]).collect()}
    assert flat[".keep"] == (1, False) and flat["_x.log"] == (2, False) and flat["sub"][1] and not flat["link"][1]
    deep = landed.list_tree(spark, [str(tmp_path), str(tmp_path / "none")], recursive=True)
    lost = deep.where("message IS NOT NULL").collect()
    assert [(r["path"], r["is_dir"]) for r in lost] == [(str(tmp_path / "none"), None)] and "No such" in lost[0]["message"]
    assert {r["path"] for r in deep.where("NOT is_dir AND filename <> 'link'").collect()} == {
        str(tmp_path / ".keep"), str(tmp_path / "_x.log"), str(tmp_path / "sub" / ".deep" / "y"),
    }
    written = deep.where("filename = 'y'").first()["mtime"]
    assert abs(written.replace(tzinfo=timezone.utc).timestamp() - (tmp_path / "sub" / ".deep" / "y").stat().st_mtime) < 1


def test_rule_files_override_in_order(spark, tmp_path):
    for name, age in (("a.json", "1"), ("b.json", "2")):
        (tmp_path / name).write_text(json.dumps({"application": "x", "os": "linux", "name": "r", "age_days": age, "position": 1}))
    rules = landed.load_rules(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert [r["age_days"] for r in rules.collect()] == ["2"]
    for folder, names in (("one", ["r", "s"]), ("two", ["t"])):
        (tmp_path / folder).mkdir()
        lines = [json.dumps({"application": "x", "os": "linux", "name": n, "age_days": "1", "position": 1}) for n in names]
        (tmp_path / folder / "rules.json").write_text("\n".join(lines))
    folders = [str(tmp_path / "one"), str(tmp_path / "two")]
    assert [r["name"] for r in landed.load_rules(spark, folders).collect()] == ["t"]  # the whole list is replaced
    assert sorted(r["name"] for r in landed.load_rules(spark, folders[::-1]).collect()) == ["r", "s"]


def test_foreign_and_damaged_records_stop_the_month(spark, tmp_path):
    def put(folder, name, record):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(record)

    good = json.dumps({"job_id": "1", "month": "202401", "total_deleted_files": 1, "total_deleted_bytes": 10, "total_failed_files": 0})
    for folder, other in (("foreign", good.replace("202401", "202312")), ("cut", good[:30])):
        put(folder, "metric_202401_1.json", good)
        put(folder, "metric_202401_2.json", other)
        with pytest.raises(Exception):  # noqa: B017
            flows.savings_month_job(spark, str(tmp_path / folder), str(tmp_path / f"store-{folder}"), "202401")
        assert not (tmp_path / f"store-{folder}" / "month=202401").exists()
    raw = spark.createDataFrame([("1", "202401"), ("2", "202312"), ("3", None)], "job_id string, month string")
    assert sorted(r["job_id"] for r in sv.rejected_period(raw, "202401").collect()) == ["2", "3"]


def test_refresh_from_load_to_checks(spark):
    settings = spark.createDataFrame([("environment_name", "lab")], "config_key string, config_value string")
    source = {
        "rf_settings": settings.withColumn("config_value", F.lit("prd")),
        "rf_sessions": spark.range(5),
        "rf_people": spark.range(30).select("id", F.concat(F.lit("n"), "id").alias("full_name")),
    }
    good = spark.createDataFrame([("s", "SUCESSO")], "host string, status string")
    masks = {"rf_people": (["id"], [{"column": "full_name", "method": "template", "args": {"prefix": "CLIENTE_"}}])}
    views = {"rf_view": "SELECT count(*) AS n FROM rf_people WHERE full_name LIKE 'CLIENTE%'"}
    for _ in range(2):
        rf_done = flows.refresh_job(
            spark, source, {"rf_settings": settings}, good, "lab", preserve=["rf_settings"], truncate=["rf_sessions"], masks=masks, views=views, seed="s"
        )
        assert rf_done is None
    assert spark.table("rf_settings").first()["config_value"] == "lab"
    assert spark.table("rf_sessions").count() == 0 and spark.table("rf_view").first()["n"] == 30
    assert spark.catalog.tableExists("rf_people_old")
    checks = [rf.Check("sessions", spark.table("rf_sessions")), rf.Check("people", spark.table("rf_people"), expected=30), rf.Check("bad", spark.table("rf_people"))]
    assert {r["check"]: r["passed"] for r in rf.run_checks(checks).collect()} == {"sessions": True, "people": True, "bad": False}
    stats = spark.sql("DESCRIBE EXTENDED rf_people").where("col_name = 'Statistics'").first()
    assert "30 rows" in stats["data_type"]
    bad = spark.createDataFrame([("s", "FALHA")], "host string, status string")
    with pytest.raises(RuntimeError, match="sources"):
        flows.refresh_job(spark, source, {}, bad, "lab")
    absent = spark.createDataFrame([("s",), ("t",)], "host string")
    with pytest.raises(RuntimeError, match="sources"):
        flows.refresh_job(spark, source, {}, good, "lab", planned=absent)
    with pytest.raises(RuntimeError, match="sources"):
        flows.refresh_job(spark, source, {}, good.limit(0), "lab")
    with pytest.raises(ValueError, match="seed"):
        flows.refresh_job(spark, source, {}, good, "lab", masks=masks)
    assert {r["run_status"] for r in rf.with_run_status(rf.run_checks(checks)).collect()} == {"FALHA"}
    assert {r["run_status"] for r in rf.with_run_status(rf.run_checks(checks[:2])).collect()} == {"SUCESSO"}
    with pytest.raises(PermissionError):
        flows.refresh_job(spark, source, {}, good, "PRD", protected=["prd"])
    for name in ("rf_settings", "rf_sessions", "rf_people"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}_old")
    spark.sql("DROP TABLE IF EXISTS rf_view")
    spark.sql("DROP TABLE IF EXISTS rf_view_old")


def test_plan_validation(spark):
    def found(roles, action, confirmed=False):
        frame = spark.createDataFrame([(r, "promote") for r in roles] or [("none", "promote")], "role string, restore_mode string")
        return [r["violation"] for r in rf.validate_plan(frame, action, confirmed).collect()]

    assert found(["source", "target"], "sync") == []
    assert found([], "sync") == ["exactly one source is needed", "at least one target is needed"]
    assert found(["target", "target"], "restore") == ["several targets need a confirmation"]
    assert found(["target", "target"], "restore", True) == []


def test_overall_status_and_cleanup(spark):
    def frame(*rows):
        return spark.createDataFrame(rows, "role string, status string, dump string")

    def status(*rows, **kw):
        return rf.overall_status(frame(*rows), **kw).first()["overall_status"]

    ok, warn, bad = ("target", "SUCESSO", "d"), ("target", "SUCESSO COM AVISO", "d"), ("source", "FALHA", "")
    assert status(ok) == "SUCESSO" and status(ok, warn) == "SUCESSO COM AVISO" and status(ok, warn, bad) == "FALHA"
    assert status(ok, cleanup_warning=True) == "SUCESSO COM AVISO" and status(ok, controller_failed=True) == "FALHA"
    assert rf.cleanup_gate(frame(ok, ("source", "SUCESSO", "other"))).first()["may_clean"]
    assert not rf.cleanup_gate(frame(ok, ("target", "SUCESSO", "e"))).first()["may_clean"]
    assert not rf.cleanup_gate(frame(ok, warn)).first()["may_clean"]


def metric_rows(spark, jobs, deleted=3):
    rows = [(j, f"h{k}", f"r{k}", deleted, 10 * deleted, deleted, 10 * deleted, 0, "ok", None, "app", "prd", None) for j in jobs for k in range(2)]
    return spark.createDataFrame(
        rows, "job_id string, host string, rule string, matched_files long, matched_bytes long, deleted_files long, deleted_bytes long,"
        "failed_files long, status string, description string, application string, environment string, source string",
    )


def metric_docs(spark, jobs, month, deleted=3, **more):
    frame = spark.createDataFrame([(j, month) for j in jobs], "job_id string, month string")
    reports = spark.createDataFrame([(j, "h0", "linux", ["prd"], ["app"]) for j in jobs], "job_id string, host string, os string, envs array<string>, applications array<string>")
    return sv.metric_documents(frame, reports, metric_rows(spark, jobs, deleted), **more)


def test_jobs_with_too_many_members_stay_rows(spark):
    docs, large = metric_docs(spark, ["a", "b"], "202401", most=4)
    assert docs.count() == 2 and large.count() == 0 and docs.schema.names == schemas.SAVINGS_METRIC.names
    one = docs.orderBy("job_id").first()
    assert (one["total_deleted_files"], len(one["hosts"]), one["hosts"][1]["os"], one["rules"][0]["source"]) == (6, 2, "unknown", "application")
    docs, large = metric_docs(spark, ["a"], "202401", most=3)
    assert docs.count() == 0 and large.first()["members"] == 4
    empty, _ = metric_docs(spark, ["c"], "202401", deleted=0)
    assert (empty.first()["hosts"], empty.first()["rules"], empty.first()["status"]) == ([], [], "success")


def test_a_year_reads_new_and_changed_files_only(spark, tmp_path):
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    write_metric_documents(metric_docs(spark, ["a", "b"], "202401")[0], raw)
    write_metric_documents(metric_docs(spark, ["z"], "202301")[0], raw)
    head, files = sv.consume_year(spark, raw, store, "2024")
    assert (head.first()["execution_count"], head.first()["total_deleted_files"], files.count()) == (2, 12, 1)
    write_metric_documents(metric_docs(spark, ["c"], "202402")[0], raw)
    head, files = sv.consume_year(spark, raw, store, "2024")
    assert (head.first()["execution_count"], head.first()["months"], files.count()) == (3, "202401,202402", 1)
    changed = next((tmp_path / "raw" / "stored_month=202402").glob("part-*"))
    lines = metric_docs(spark, ["c", "d"], "202402", deleted=5)[0].select(F.to_json(F.struct("*"))).collect()
    changed.write_text("".join(r[0] + "\n" for r in lines))
    for side in changed.parent.glob(".*.crc"):
        side.unlink()
    head, files = sv.consume_year(spark, raw, store, "2024")
    assert (head.first()["execution_count"], head.first()["total_deleted_files"], files.count()) == (4, 32, 1)
    assert sv.consume_year(spark, raw, store, "2024")[1].count() == 0
    assert sv.consume_year(spark, raw, str(tmp_path / "other"), "2025")[0].first()["execution_count"] == 0


def test_executions_of_a_run_that_broke_off_do_not_count(spark, tmp_path):
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    write_metric_documents(metric_docs(spark, ["a"], "202401")[0], raw)
    sv.consume_year(spark, raw, store, "2024")
    lost = spark.read.parquet(f"{store}/executions").withColumn("path", F.lit("file:/elsewhere"))
    lost.write.mode("append").partitionBy("year").parquet(f"{store}/executions")
    assert sv.consume_year(spark, raw, store, "2024")[0].first()["execution_count"] == 1


def test_documents_of_another_year_or_broken_ones_fail(spark, tmp_path):
    raw = tmp_path / "raw"
    write_metric_documents(metric_docs(spark, ["a"], "202401")[0].withColumn("month", F.lit("202401")), str(raw))
    (raw / "stored_month=202402").mkdir()
    (raw / "stored_month=202402" / "part-x.txt").write_text("{no record")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        sv.consume_year(spark, str(raw), str(tmp_path / "store"), "2024")


@pytest.fixture()
def live(spark):
    """Two live tables, a staged form of both, and a third staged table of a new name."""
    names = ["pub_one", "pub_two", "pub_three"]
    for k, name in enumerate(names[:2]):
        spark.range(k + 1).write.mode("overwrite").saveAsTable(name)
    for name in names:
        spark.range(10).write.mode("overwrite").saveAsTable(name + "_restoring")
    yield names
    for name in names:
        for table in (name, name + "_restoring", name + "_old"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql("DROP TABLE IF EXISTS pub_journal")


def rows_of(spark, names):
    return {n: spark.table(n).count() if spark.catalog.tableExists(n) else None for n in names}


def failing_at(spark, monkeypatch, k):
    """Renames fail from the ``k``-th on, until ``monkeypatch`` is undone."""
    real, seen = type(spark).sql, []

    def sql(self, text, *args, **kwargs):
        if "RENAME" in text:
            seen.append(text)
            if len(seen) == k:
                raise RuntimeError("lost")
        return real(self, text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", sql)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_a_failed_rename_leaves_every_live_name_as_it_was(spark, live, monkeypatch, k):
    failing_at(spark, monkeypatch, k)
    with pytest.raises(RuntimeError, match="lost"):
        rf.publish(spark, live, journal="pub_journal")
    monkeypatch.undo()
    assert rows_of(spark, live) == {"pub_one": 1, "pub_two": 2, "pub_three": None}
    assert rows_of(spark, [n + "_restoring" for n in live]) == {n + "_restoring": 10 for n in live}
    assert rf.take_back(spark, "pub_journal") == []
    rf.publish(spark, live, journal="pub_journal")
    assert rows_of(spark, live) == dict.fromkeys(live, 10) and rows_of(spark, ["pub_two_old"]) == {"pub_two_old": 2}


def test_a_run_that_lost_its_driver_is_taken_back(spark, live, monkeypatch):
    failing_at(spark, monkeypatch, 4)
    monkeypatch.setattr(rf, "_undo", lambda *args: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        rf.publish(spark, live, journal="pub_journal")
    monkeypatch.undo()
    assert rows_of(spark, live)["pub_one"] == 10
    assert len(rf.take_back(spark, "pub_journal")) == 1
    assert rows_of(spark, live) == {"pub_one": 1, "pub_two": 2, "pub_three": None}


def test_nothing_is_renamed_where_a_staged_table_is_missing(spark, live):
    spark.sql("DROP TABLE pub_three_restoring")
    with pytest.raises(ValueError, match="nothing is staged"):
        rf.publish(spark, live)
    assert rows_of(spark, live) == {"pub_one": 1, "pub_two": 2, "pub_three": None}


def test_age_of_statistics(spark, live):
    rf.analyze(spark, ["pub_one"])
    rows = {r["table_name"]: r["age_seconds"] for r in rf.statistics_age(spark, ["pub_one", "pub_two"]).collect()}
    assert list(rows) == ["pub_two", "pub_one"] and rows["pub_two"] is None and 0 <= rows["pub_one"] < 600


def test_views_of_the_caller_survive_staging(spark, live):
    spark.range(3).createOrReplaceTempView("pub_one")
    try:
        assert rf.stage_views(spark, {"pub_two": "SELECT id + 1 AS id FROM pub_one"}, ["pub_one"]) == ["pub_two_restoring"]
        assert spark.table("pub_one").count() == 3 and spark.table("pub_two_restoring").count() == 10
    finally:
        spark.catalog.dropTempView("pub_one")
