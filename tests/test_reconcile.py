"""Registry scenarios with known outcomes."""

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import reconcile as rc
from tidemark.plans import flows

# One organisation: repository, filter, tags.
ORGANISATION = [
    ("app-all", ["*"], ["latest", "1.0", "1.1", "2.0"]),
    ("app-more", ["*"], ["latest", "a", "b", "c"]),
    ("app-release", ["release-*"], ["release-1", "release-2", "release-3", "dev-1", "dev-2"]),
    ("app-v", ["v*"], ["v1", "v2", "v3", "test", "tmp"]),
    ("app-stable", ["stable-*"], ["stable-1", "stable-2", "edge", "nightly"]),
    ("app-last", ["*"], ["x", "y", "z", "w"]),
]


def configs(spark, rows):
    return spark.createDataFrame(
        [(f"org/{n}", 200, True, True, "SUCCESS", "", f) for n, f, _ in rows],
        "repository string, http_status long, mirror_found boolean, is_enabled boolean, sync_status string, api_error string, rule_value array<string>",
    )


def tags(spark, rows, digest=lambda n, t: f"sha-{n}-{t}"):
    return spark.createDataFrame(
        [(f"org/{n}", t, digest(n, t)) for n, _, names in rows for t in names], "repository string, tag string, digest string"
    )


def counts(rows):
    return {r["status"]: r["n"] for r in rc.status_counts(rows).collect()}


def mirrored(spark):
    """What a mirror holds: the tags its filter lets through."""
    import fnmatch

    return tags(spark, [(n, f, [t for t in names if any(fnmatch.fnmatchcase(t, p) for p in f)]) for n, f, names in ORGANISATION])


def test_fully_mirrored(spark):
    got = counts(rc.reconcile(tags(spark, ORGANISATION), mirrored(spark), configs(spark, ORGANISATION)))
    assert got == {"OK": 20, "SKIPPED_BY_FILTER": 6}


def test_rebuilt_source_shows_as_digest_drift(spark):
    rebuilt = tags(spark, ORGANISATION, lambda n, t: f"new-{n}-{t}")
    rows = rc.reconcile(rebuilt, mirrored(spark), configs(spark, ORGANISATION))
    assert counts(rows) == {"DIGEST_MISMATCH": 20, "SKIPPED_BY_FILTER": 6}
    assert rc.sync_candidates(rows).count() == 6
    assert rc.report_level(rows).first()["level"] == "crit"


def test_new_source_tags_show_as_missing(spark):
    new = [(n, f, [*names, f[0].replace("*", "new")]) for n, f, names in ORGANISATION]
    got = counts(rc.reconcile(tags(spark, new), mirrored(spark), configs(spark, ORGANISATION)))
    assert got == {"OK": 20, "SKIPPED_BY_FILTER": 6, "MISSING_TAG": 6}


def test_config_rows_come_besides_tag_rows(spark):
    broken = spark.createDataFrame(
        [("org/gone", 404, False, False, None, "no mirror", None), ("org/off", 200, True, False, "FAIL", "", ["v*"]), ("org/none", 200, True, True, "SUCCESS", "", [])],
        configs(spark, ORGANISATION).schema,
    )
    source = spark.createDataFrame([("org/gone", "a", "d"), ("org/off", "v1", ""), ("org/other", "x", "d")], "repository string, tag string, digest string")
    target = spark.createDataFrame([("org/off", "v1", "d"), ("org/none", "t", "d")], "repository string, tag string, digest string")
    errors = spark.createDataFrame([("source", "org/err", 403, "denied")], "side string, repository string, http_status long, message string")
    rows = rc.reconcile(source, target, broken, errors)
    got = {(r["repository"], r["tag"], r["status"]) for r in rows.collect()}
    assert got == {
        ("org/gone", "", "MIRROR_CONFIG_ERROR"),
        ("org/gone", "a", "MISSING_TAG"),
        ("org/off", "", "MIRROR_DISABLED"),
        ("org/off", "v1", "DIGEST_UNAVAILABLE"),
        ("org/none", "", "SOURCE_REPOSITORY_EMPTY_OR_INACCESSIBLE"),
        ("org/none", "t", "EXTRA_TAG_ON_TARGET"),
        ("org/err", "", "TAG_COLLECTION_ERROR"),
    }
    messages = {r["status"]: r["message"] for r in rows.collect()}
    assert messages["TAG_COLLECTION_ERROR"] == "source HTTP 403: denied"
    assert messages["MIRROR_CONFIG_ERROR"].endswith("HTTP 404. no mirror")


def test_dialects_differ_where_they_should(spark):
    cfg = spark.createDataFrame(
        [("r", 200, True, True, "SUCCESS", "", "tag_glob_csv", "a*b, c"), ("e", 200, True, True, "SUCCESS", "", "tag_glob_csv", None)],
        "repository string, http_status long, mirror_found boolean, is_enabled boolean, sync_status string, api_error string, rule_kind string, rule_text string",
    ).withColumn("rule_value", F.when(F.col("repository") == "e", F.array().cast("array<string>")))
    source = spark.createDataFrame([("r", "axb", "1"), ("r", "c", "1"), ("r", "a*b, c", "1"), ("e", "t", "1")], "repository string, tag string, digest string")
    target = source.limit(0)
    role = {(r["repository"], r["tag"]): r["status"] for r in rc.reconcile(source, target, cfg).collect()}
    script = {(r["repository"], r["tag"]): r["status"] for r in rc.reconcile(source, target, cfg, dialect="script").collect()}
    assert role == {("r", "axb"): "SKIPPED_BY_FILTER", ("r", "c"): "SKIPPED_BY_FILTER", ("r", "a*b, c"): "MISSING_TAG", ("e", "t"): "SKIPPED_BY_FILTER"}
    assert script == {("r", "axb"): "MISSING_TAG", ("r", "c"): "MISSING_TAG", ("r", "a*b, c"): "SKIPPED_BY_FILTER", ("e", "t"): "MISSING_TAG"}


def test_script_stops_at_an_empty_source_repository(spark):
    target = spark.createDataFrame([("org/app-all", "t", "d")], "repository string, tag string, digest string")
    cfg = configs(spark, ORGANISATION[:1])
    assert counts(rc.reconcile(target.limit(0), target, cfg, dialect="script")) == {"SOURCE_REPOSITORY_EMPTY_OR_INACCESSIBLE": 1}
    assert counts(rc.reconcile(target.limit(0), target, cfg)) == {"SOURCE_REPOSITORY_EMPTY_OR_INACCESSIBLE": 1, "EXTRA_TAG_ON_TARGET": 1}


def test_one_hot_repository_is_counted_whole(spark):
    hot = spark.range(60_000).select(F.lit("org/hot").alias("repository"), F.concat(F.lit("v"), "id").alias("tag"), F.lit("d").alias("digest"))
    cold = spark.range(60_000).select(
        F.concat(F.lit("org/"), (F.col("id") % 1000).cast("string")).alias("repository"), F.concat(F.lit("v"), "id").alias("tag"), F.lit("d").alias("digest")
    )
    both = hot.unionByName(cold)
    cfg = both.select("repository").distinct().selectExpr(
        "repository", "200 AS http_status", "true AS mirror_found", "true AS is_enabled", "'SUCCESS' AS sync_status", "'' AS api_error", "array('v*') AS rule_value"
    )
    assert counts(rc.reconcile(both, both.where("tag <> 'v7'"), cfg)) == {"OK": 119_998, "MISSING_TAG": 2}


def test_repository_classification(spark):
    source = spark.createDataFrame([(f"lab/{n}", "MIRROR") for n in ["baseline", "conflict-normal", "a", "b", "c", "d", "e"]], "repository string, state string")
    target = spark.createDataFrame([("lab/baseline", "MIRROR"), ("lab/conflict-normal", "NORMAL")], "repository string, state string")
    rows = rc.classify_repositories(source, target)
    got = {r["classification"]: r["n"] for r in rows.groupBy("classification").agg(F.count("*").alias("n")).collect()}
    assert got == {"missing": 5, "existing": 1, "conflict": 1}
    ignored = rc.classify_repositories(source, target, ["lab/conflict-normal"])
    assert ignored.where("classification = 'ignored'").count() == 1
    missing = rows.where("classification = 'missing'")
    outcomes = rc.mirror_outcomes(missing, missing, missing.limit(0), rows.where("classification = 'conflict'"), rows.limit(0))
    got = {(r["situation"], r["outcome"]): r["n"] for r in outcomes.groupBy("situation", "outcome").agg(F.count("*").alias("n")).collect()}
    assert got == {("missing", "created"): 5, ("conflict", "check"): 1}


def test_policy(spark):
    good = spark.createDataFrame([(False,)], "has_divergence boolean")
    bad = spark.createDataFrame([(True,)], "has_divergence boolean")
    assert rc.enforce_policy(good, True).count() == 1
    assert rc.enforce_policy(bad, False).count() == 1
    with pytest.raises(Exception, match="divergence"):
        rc.enforce_policy(bad, True).collect()


def test_report_level_counts_troubles(spark):
    rows = rc.reconcile(tags(spark, ORGANISATION), mirrored(spark), configs(spark, ORGANISATION))
    waits = spark.createDataFrame([("a", 200, "SUCCESS"), ("b", 200, "SYNCING")], "repository string, http_status long, sync_status string")
    assert rc.report_level(rows).first()["level"] == "ok"
    assert rc.report_level(rows, waits=waits).first()["level"] == "crit"


def test_pages_to_results(spark):
    def page(side, names, state):
        repos = [("lab", n, None, state(n), True, None, None, None, None) for n in names]
        return (side, "lab", 1, 200, (repos, None))

    repositories = spark.createDataFrame(
        [page("source", ["a", "b"], lambda n: "NORMAL"), page("target", ["a", "b"], lambda n: "MIRROR" if n == "a" else "NORMAL"), ("target", "lab", 2, 500, None)],
        schemas.REPOSITORY_PAGE,
    )
    response = {"is_enabled": True, "sync_status": "SUCCESS", "root_rule": ("tag_glob_csv", ["v*"])}
    body = tuple(response.get(f.name) for f in schemas.MIRROR_RESPONSE["json"].dataType)
    responses = spark.createDataFrame([("lab", "a", 200, body)], schemas.MIRROR_RESPONSE)

    def tag_page(tags, status=200, page=1):
        rows = [(t, d, None, None, None, None, None) for t, d in tags]
        return ("lab/a", "lab", "a", page, status, None, (rows, None, None))

    source = spark.createDataFrame([tag_page([("v1", "d1"), ("v2", "d2"), ("x", "d3")]), tag_page([("v1", "other")], page=2)], schemas.TAG_PAGE)
    target = spark.createDataFrame([tag_page([("v1", "d1")]), tag_page([], 502, 2)], schemas.TAG_PAGE)
    done = flows.reconcile_job(repositories, responses, source, target)
    assert {r["status"]: r["n"] for r in done["status_counts"].collect()} == {"OK": 1, "MISSING_TAG": 1, "SKIPPED_BY_FILTER": 1, "TAG_COLLECTION_ERROR": 1}
    assert [r["repository"] for r in done["candidates"].collect()] == ["lab/a"]
    assert done["summary"].first()["has_divergence"]
    assert {r["repository"]: r["classification"] for r in done["repositories"].collect()} == {"lab/a": "existing", "lab/b": "conflict"}
    assert done["visible"].where("status = 'TAG_COLLECTION_ERROR'").count() == 0
