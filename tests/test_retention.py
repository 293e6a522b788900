"""Retention rules over small trees."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import retention as rt
from tidemark.operators import runs
from tidemark.plans import flows

AS_OF = datetime(2024, 6, 30)
RULE = """host string, rule_id string, position long, os string, engine string, paths array<string>, patterns array<string>, exclude_patterns array<string>,
    allowed_prefixes array<string>, age_days string, recursive boolean, delete_empty_dirs boolean, enabled boolean"""


def rule(name, paths, patterns, age="30", recursive=False, excludes=(), engine="shell", os="linux", prefixes=("/opt/lab",), empty=False, position=1, host="h", enabled=True):
    return (host, name, position, os, engine, list(paths), list(patterns), list(excludes), list(prefixes), age, recursive, empty, enabled)


def files(spark, *entries):
    return spark.createDataFrame([("h", p, s, AS_OF - timedelta(days=d)) for p, s, d in entries], "host string, path string, size long, mtime timestamp").withColumn(
        "mtime", F.col("mtime").cast("timestamp_ntz")
    )


def plan(spark, *rules):
    return spark.createDataFrame(list(rules), RULE)


def guarded(spark, *rules):
    return rt.guard_paths(rt.rule_errors(rt.normalize_rules(plan(spark, *rules))))


def matched(spark, tree, *rules):
    return {(r["rule_id"], r["path"]) for r in rt.match_files(tree, guarded(spark, *rules), AS_OF).collect()}


def test_rules_of_the_lab(spark):
    tree = files(
        spark,
        ("/opt/lab/a/logs/old.log", 10, 40),
        ("/opt/lab/a/logs/OLD.TXT", 10, 40),
        ("/opt/lab/a/logs/keep-1.log", 10, 40),
        ("/opt/lab/a/logs/new.log", 10, 5),
        ("/opt/lab/a/logs/sub/deep.log", 10, 40),
        ("/opt/lab/a/tmp/x.tmp", 7, 40),
        ("/opt/lab/a/tmp/X.TMP", 7, 40),
        ("/opt/lab/b/logs/2024/01/r.log", 3, 31),
        ("/opt/lab/b/logs/2024/02/r.log", 3, 2),
        ("/opt/lab/b/exports/e.csv", 5, 30),
        ("/tmp/lab-blocked/x.log", 5, 90),
    )
    rules = [
        rule("logs", ["/opt/lab/a/logs"], ["*.log", "*.txt"], excludes=["keep-*"], position=1),
        rule("tmp", ["/opt/lab/a/tmp"], ["*.tmp"], engine="modules", position=2),
        rule("recursive", ["/opt/lab/b/logs"], ["*.log", "*.txt"], recursive=True, empty=True, excludes=["keep-*"], position=3),
        rule("exports", ["/opt/lab/b/exports"], ["*.csv", "*.zip"], engine="modules", position=4),
        rule("missing", ["/opt/lab/none"], ["*.log"], position=5),
        rule("blocked", ["/tmp/lab-blocked"], ["*.log"], position=6),
    ]
    assert matched(spark, tree, *rules) == {
        ("logs", "/opt/lab/a/logs/old.log"),
        ("logs", "/opt/lab/a/logs/OLD.TXT"),
        ("tmp", "/opt/lab/a/tmp/x.tmp"),
        ("recursive", "/opt/lab/b/logs/2024/01/r.log"),
        ("exports", "/opt/lab/b/exports/e.csv"),
    }
    done = flows.purge_job(tree, plan(spark, *rules), AS_OF, mode="apply", confirmed=True)
    assert {r["rule_id"]: r["status"] for r in done["rows"].collect()} == {
        "logs": "ok", "tmp": "ok", "recursive": "ok", "exports": "ok", "missing": "ok", "blocked": "blocked",
    }
    assert done["survivors"].count() == 6 and done["ledger"].count() == 5
    assert [r["path"] for r in done["empty_dirs"].collect()] == ["/opt/lab/b/logs/2024/01"]
    totals = done["totals"].first()
    assert (totals["total_deleted_files"], totals["total_deleted_bytes"], totals["total_blocked_rules"]) == (5, 35, 1)
    check = flows.purge_job(tree, plan(spark, *rules), AS_OF)
    assert check["survivors"].count() == 11 and check["totals"].first()["total_deleted_files"] == 0
    assert check["totals"].first()["total_matched_files"] == 5


def test_apply_needs_a_confirmation(spark):
    tree = files(spark, ("/opt/lab/a/x", 1, 99))
    found = rt.match_files(tree, guarded(spark, rule("r", ["/opt/lab/a"], ["*"])), AS_OF)
    kept, ledger = rt.apply_retention(tree, found, mode="apply", confirmed=False)
    assert kept.count() == 1 and not ledger.first()["deleted"]


def test_a_file_goes_to_the_first_rule_and_counts_once_per_rule(spark):
    tree = files(spark, ("/opt/lab/a/b/x.log", 1, 99), ("/opt/lab/a/y.log", 1, 99))
    rules = [
        rule("shell", ["/opt/lab/a", "/opt/lab/a/b"], ["*.log", "x*"], recursive=True, position=1),
        rule("modules", ["/opt/lab/a/b"], ["*.log"], engine="modules", position=2),
    ]
    found = rt.match_files(tree, guarded(spark, *rules), AS_OF)
    assert found.count() == 3
    kept, ledger = rt.apply_retention(tree, found, mode="apply", confirmed=True)
    assert kept.count() == 0
    assert {r["path"]: r["rule_id"] for r in ledger.collect()} == {"/opt/lab/a/b/x.log": "modules", "/opt/lab/a/y.log": "shell"}


def test_survivors_and_ledger_make_up_the_input(spark):
    tree = files(spark, *[(f"/opt/lab/a/f{i}.{'log' if i % 2 else 'csv'}", i, i % 60) for i in range(300)])
    failing = tree.where("path LIKE '%7.log'").select("host", "path")
    found = rt.match_files(tree, guarded(spark, rule("r", ["/opt/lab/a"], ["*.log"])), AS_OF)
    kept, ledger = rt.apply_retention(tree, found, failing, mode="apply", confirmed=True)
    gone = ledger.where("deleted")
    assert kept.count() + gone.count() == 300
    assert kept.select("path").union(gone.select("path")).distinct().count() == 300
    counters = rt.rule_counters(ledger).first()
    assert counters["failed_files"] == ledger.where("NOT deleted").count() > 0
    rows = runs.rule_rows(guarded(spark, rule("r", ["/opt/lab/a"], ["*.log"])), rt.rule_counters(ledger), apply=True)
    assert rows.first()["status"] == "failed"


def test_windows_paths(spark):
    tree = files(spark, ("C:\\Lab\\Logs\\A.LOG", 1, 99), ("c:\\lab\\logs\\sub\\b.log", 1, 99), ("D:\\x\\c.log", 1, 99))
    windows = dict(os="windows", prefixes=["c:\\LAB\\"])
    flat = rule("flat", ["C:\\lab\\logs\\"], ["*.log"], **windows)
    deep = rule("deep", ["c:\\LAB\\logs"], ["*.log"], recursive=True, position=2, **windows)
    assert matched(spark, tree, flat, deep) == {
        ("flat", "C:\\Lab\\Logs\\A.LOG"), ("deep", "C:\\Lab\\Logs\\A.LOG"), ("deep", "c:\\lab\\logs\\sub\\b.log"),
    }
    case = rule("modules", ["C:\\lab\\logs"], ["*.log"], engine="modules", recursive=True, **windows)
    assert matched(spark, tree, case) == {("modules", "c:\\lab\\logs\\sub\\b.log")}


def reasons(spark, **changes):
    got = guarded(spark, rule("r", ["/opt/lab/x/", "/opt/lab/x", "/etc", "/x", "//", "/opt/labor", "/opt/lab"], ["*"], **changes)).first()
    return got["allowed"], [(b["path"], b["reason"]) for b in got["blocked"]]


def test_path_guard(spark):
    allowed, blocked = reasons(spark)
    assert allowed == ["/opt/lab/x", "/opt/lab"]
    assert blocked == [("/etc", fv.PATH_FORBIDDEN), ("/x", fv.PATH_TOO_SHORT), ("", fv.PATH_EMPTY), ("/opt/labor", fv.PATH_OUTSIDE)]
    allowed, _ = reasons(spark, prefixes=[])
    assert allowed == ["/opt/lab/x", "/opt/labor", "/opt/lab"]
    required = rt.guard_paths(rt.normalize_rules(plan(spark, rule("r", ["/opt/lab"], ["*"], prefixes=[]))), required=True).first()
    assert required["blocked"][0]["reason"] == fv.PATH_PREFIX_REQUIRED
    off = rt.guard_paths(rt.normalize_rules(plan(spark, rule("r", ["/srv/x"], ["*"]))), enforce=False).first()
    assert off["allowed"] == ["/srv/x"]


@pytest.mark.parametrize(
    ("engine", "path", "allowed"), [("modules", "C:\\", []), ("shell", "C:\\Users\\", []), ("shell", "C:\\Data\\x\\", ["C:\\Data\\x\\"]), ("modules", "C:\\Data\\x\\", ["C:\\Data\\x"])]
)
def test_windows_guard(spark, engine, path, allowed):
    assert guarded(spark, rule("r", [path], ["*"], engine=engine, os="windows", prefixes=[])).first()["allowed"] == allowed


def test_rule_errors_and_engines(spark):
    bad = rt.rule_errors(rt.normalize_rules(plan(spark, rule("r", [" "], [" "], age="-1")))).first()
    assert bad["fatal_errors"] == [fv.RULE_NO_PATHS, fv.RULE_NO_PATTERNS, fv.RULE_BAD_AGE]
    known, unknown = rt.split_engines(rt.enabled_rules(plan(spark, rule("a", ["/x"], ["*"]), rule("b", ["/x"], ["*"], engine="x"), rule("c", ["/x"], ["*"], enabled=False))))
    assert [r["rule_id"] for r in known.collect()] == ["a"]
    assert [(r["rule_id"], r["status"]) for r in unknown.collect()] == [("b", "blocked")]


def test_rule_status_by_engine(spark):
    def status(engine, os="linux", **kw):
        values = dict(matched_files=0, deleted_files=0, failed_files=0, failed_empty_dirs=0, errors=0, path_errors=0, n_blocked=0, n_allowed=1) | kw
        row = spark.range(1).select(
            F.lit(engine).alias("engine"), F.lit(os).alias("os"), F.lit(True).alias("apply"), F.array().cast("array<string>").alias("fatal_errors"),
            F.array_repeat(F.lit("/a"), values.pop("n_allowed")).alias("allowed"), F.array_repeat(F.lit("/b"), values.pop("n_blocked")).alias("blocked"),
            *[F.lit(v).alias(k) for k, v in values.items()],
        )
        return tuple(runs.rule_status(row).select("status", "status_detail").first())

    assert status("shell") == ("ok", "ok")
    assert status("shell", matched_files=3) == ("warning", fv.DETAIL_NOTHING_DELETED)
    assert status("modules", matched_files=3) == ("ok", "ok")
    assert status("shell", errors=1) == ("failed", fv.DETAIL_FAILED["linux"])
    assert status("shell", os="windows", errors=1) == ("failed", fv.DETAIL_FAILED["windows"])
    assert status("modules", errors=1) == ("ok", "ok")
    assert status("shell", path_errors=1) == ("failed", fv.DETAIL_PATH_ERROR)
    assert status("shell", n_blocked=1) == ("warning", fv.DETAIL_SOME_BLOCKED)
    assert status("shell", n_blocked=1, n_allowed=0) == ("blocked", fv.DETAIL_ALL_BLOCKED)


def test_samples(spark):
    tree = files(spark, *[(f"/opt/lab/a/f{i:03d}", 1, 99) for i in range(60)])
    found = rt.match_files(tree, guarded(spark, rule("r", ["/opt/lab/a"], ["*"])), AS_OF)
    shown = rt.rule_samples(found, 50).collect()
    assert len(shown) == 50 and {r["more"] for r in shown} == {10}
    assert min(r["path"] for r in shown) == "/opt/lab/a/f000"


def test_plan_of_the_lab_matrix(spark):
    maps = "map<string,array<string>>"
    matrix = spark.createDataFrame(
        [("hml", "lab_linux", ["10.0.0.35"], None, None), ("prd", "lab_linux", [" 10.0.0.1", "10.0.0.2"], {"linux": ["/data"]}, None), ("prd", "Harbour", ["WIN-1"], None, {"windows": "replace"})],
        f"environment string, application string, members array<string>, allowed_prefixes {maps}, merge map<string,string>",
    )
    apps = spark.createDataFrame([("lab_linux", {"linux": ["/opt/lab"]}), ("harbour", None)], f"application string, allowed_prefixes {maps}")
    rules = spark.createDataFrame(
        [
            ("application", "lab_linux", None, "linux", "all", None, None, None, None, 1),
            ("application", "lab_linux", None, "linux", "one", None, ["10.0.0.1"], None, ["/ignored"], 2),
            ("application", "lab_linux", None, "linux", "not-one", "modules", None, ["10.0.0.1"], None, 3),
            ("application", "harbour", None, "windows", "replaced", None, None, None, None, 1),
            ("environment_overlay", "harbour", "PRD", "windows", "overlay", None, None, None, None, 1),
            ("environment_overlay", "lab_linux", "dr", "linux", "other-env", None, None, None, None, 1),
            ("global", "_global", None, "linux", "tmp", None, None, None, ["/tmp"], 1),
        ],
        "scope string, application string, environment string, os string, name string, engine string, hosts array<string>, exclude_hosts array<string>, allowed_prefixes array<string>, position long",
    )
    got = rt.resolve_plan(matrix, rules, apps, envs=["prd"], global_rules=True)
    rows = {(r["host"], r["name"]): (r["source"], r["engine"], tuple(r["allowed_prefixes"])) for r in got.collect()}
    assert rows == {
        ("10.0.0.1", "all"): ("application", "shell", ("/opt/lab", "/data")),
        ("10.0.0.2", "all"): ("application", "shell", ("/opt/lab", "/data")),
        ("10.0.0.1", "one"): ("application", "shell", ("/opt/lab", "/data")),
        ("10.0.0.2", "not-one"): ("application", "modules", ("/opt/lab", "/data")),
        ("win-1", "overlay"): ("environment_overlay", "shell", ()),
        **{(h, "tmp"): ("global", "shell", ("/tmp",)) for h in ("10.0.0.1", "10.0.0.2", "win-1")},
    }


def test_attachment_plans(spark):
    sized = spark.createDataFrame([(100,), (200,)], "size long")
    def action(frame, **kw):
        return runs.attachment_plan(frame, **kw).first()["action"]

    assert action(sized.limit(0), limit_bytes=10) == "none"
    assert action(sized, limit_bytes=300) == "individual"
    assert action(sized, limit_bytes=299) == "compress"
    assert action(sized, limit_bytes=299, compress=False) == "cifs_only"
    assert action(sized, limit_bytes=299, archive_bytes=F.lit(120)) == "compressed"
    assert action(sized, limit_bytes=299, archive_bytes=F.lit(999)) == "cifs_only"


def test_totals_hold_every_rule_of_the_run(spark):
    tree = files(spark, ("/opt/lab/a/x/old.log", 3, 99))
    rules = [
        rule("gone", ["/opt/lab/a", "/opt/lab/none"], ["*.log"], recursive=True, empty=True, position=1),
        rule("odd", ["/opt/lab/a"], ["*"], engine="robot", position=2),
    ]
    planned = plan(spark, *rules)
    host = planned.first()["host"]
    listing = spark.createDataFrame([(host, "/opt/lab/a", True, None)], "host string, path string, is_dir boolean, message string")
    dirs = spark.createDataFrame([(host, "/opt/lab/a/bare")], "host string, path string")
    broken = "host string, started boolean, completed boolean, failure_recorded boolean"
    states = spark.createDataFrame([(host, True, True, False), ("lost", True, False, False)], broken)
    done = flows.purge_job(tree, planned, AS_OF, "apply", True, listing=listing, dirs=dirs, states=states)
    totals = done["totals"].first()
    assert (totals["total_rules"], totals["total_blocked_rules"], totals["total_failed_rules"]) == (3, 1, 1)
    assert (totals["total_missing_paths"], totals["total_removed_empty_dirs"], totals["total_deleted_bytes"]) == (1, 2, 3)
    assert sorted(r["path"] for r in done["empty_dirs"].collect()) == ["/opt/lab/a/bare", "/opt/lab/a/x"]


def test_share_paths_match_whatever_their_case_and_separators(spark):
    tree = files(spark, ("\\\\SRV\\Share\\logs\\a.LOG", 1, 99), ("\\\\srv\\share/logs/sub\\b.log", 1, 99), ("\\\\srv\\other\\c.log", 1, 99))
    guarded_ = rt.guard_paths(rt.rule_errors(rt.normalize_rules(plan(spark, rule("r", ["\\\\srv\\share\\logs\\"], ["*.log"], recursive=True)).withColumns(
        {"os": F.lit("windows"), "allowed_prefixes": F.array(F.lit("\\\\srv\\share"))}
    ))))
    assert guarded_.first()["fatal_errors"] == [] and len(guarded_.first()["allowed"]) == 1
    assert {r["path"][-5:].lower() for r in rt.match_files(tree, guarded_, AS_OF).collect()} == {"a.log", "b.log"} or {
        r["path"][-5:].lower() for r in rt.match_files(tree, guarded_, AS_OF).collect()
    } == {"a.log", "\\b.log"}


def test_all_details_of_a_failure_are_kept(spark):
    details = [f"{i} " + "x" * 3000 for i in range(25)]
    rows = runs.failed_host_rows(spark.createDataFrame([("h", "c", "t", details)], "host string, category string, task string, details array<string>"))
    assert rows.first()["fatal_errors"][2:] == details
    shown = runs.shown_failures(rows).first()["fatal_errors"]
    assert len(shown) == 12 and max(map(len, shown)) == 1500


def test_ages_by_engine(spark):
    errors = {}
    for engine, age in (("modules", "7.5"), ("shell", "7.5"), ("modules", "0.9"), ("modules", "x")):
        got = rt.rule_errors(rt.normalize_rules(plan(spark, rule("r", ["/opt/lab/a"], ["*"], engine=engine, age=age)))).first()
        errors[engine, age] = len(got["fatal_errors"])
    assert errors == {("modules", "7.5"): 0, ("shell", "7.5"): 1, ("modules", "0.9"): 1, ("modules", "x"): 1}


def test_survivors_with_a_filter_of_few_bits(spark):
    files = spark.range(5000).selectExpr("concat('h', id % 7) AS host", "concat('/d/', id) AS path", "id AS size")
    files = files.unionByName(spark.createDataFrame([(None, "/d/1", 1), ("h1", None, 2)], "host string, path string, size long"))
    gone = files.where("size % 3 = 0").select("host", "path")
    want = sorted((r["host"] or "", r["path"] or "") for r in files.where("size % 3 <> 0 OR host IS NULL").collect())
    for bits in (1 << 15, 1 << 20):
        kept = rt.survivors_of(files, gone, bits)
        assert sorted((r["host"] or "", r["path"] or "") for r in kept.collect()) == want and kept.columns == files.columns
    assert rt.survivors_of(files, gone.limit(0)).count() == files.count()


def test_directories_become_empty_from_the_bottom(spark):
    paths = ["/a/b/c/1", "/a/b/c/2", "/a/b/d/3", "/a/e/4", "C:\\X\\Y\\5", "C:\\X\\6"]
    files = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    gone = files.where(F.col("path").isin("/a/b/c/1", "/a/b/c/2", "/a/b/d/3", "C:\\X\\Y\\5"))
    dirs = spark.createDataFrame([("h", "/a/f/g"), ("h", "/a/e")], "host string, path string")
    left = {r["path"]: r["left"] for r in rt.directory_counts(files, gone, dirs).collect()}
    assert left == {"/a": 1, "/a/b": 0, "/a/b/c": 0, "/a/b/d": 0, "/a/e": 1, "/a/f": 0, "/a/f/g": 0, "c:": 1, "c:/x": 1, "c:/x/y": 0}
