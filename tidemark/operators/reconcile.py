"""Comparison of two inventory snapshots, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import globs
from tidemark.functions import text as tx
from tidemark.operators.common import first_rows, preview, total
from tidemark.session import use_checkpoint_dir

ROW_COLUMNS = [
    "repository", "tag", "status", "severity", "mirror_status", "mirror_enabled", "filter", "source_digest",
    "target_digest", "message",
]


def _patterns(configs: DataFrame, dialect: str) -> Column:
    kind = "rule_kind" if "rule_kind" in configs.columns else None
    text = "rule_text" if "rule_text" in configs.columns else None
    return tx.filter_patterns("rule_value", kind, dialect, text)


def _prepared(configs: DataFrame, dialect: str) -> DataFrame:
    """Config columns a comparison needs, with the filter compiled to one expression per repository."""
    missing = F.lit("CONFIG_ERROR") if dialect == "role" else F.lit("")
    rules = configs.withColumn("_patterns", _patterns(configs, dialect))
    return rules.select(
        "repository",
        F.coalesce("mirror_found", F.lit(False)).alias("mirror_found"),
        F.coalesce("is_enabled", F.lit(False)).alias("mirror_enabled"),
        F.coalesce("sync_status", F.when(F.col("mirror_found"), F.lit("")).otherwise(missing)).alias("mirror_status"),
        F.coalesce("http_status", F.lit(0)).alias("http_status"),
        F.coalesce("api_error", F.lit("")).alias("api_error"),
        tx.filter_text("_patterns").alias("filter"),
        globs.globs_regex(F.col("_patterns"), "simple" if dialect == "role" else "fnmatch").alias("_regex"),
    )


def tag_status(in_source: Column, in_target: Column, in_filter: Column, source: Column, target: Column) -> Column:
    return (
        F.when(~in_source, "EXTRA_TAG_ON_TARGET")
        .when(~in_filter & in_target, "OUT_OF_FILTER_PRESENT_ON_TARGET")
        .when(~in_filter, "SKIPPED_BY_FILTER")
        .when(~in_target, "MISSING_TAG")
        .when((source == "") | (target == ""), "DIGEST_UNAVAILABLE")
        .when(source != target, "DIGEST_MISMATCH")
        .otherwise("OK")
    )


def _by_status(status: Column, which: int) -> Column:
    pairs = [x for name, values in fv.TAG_STATUSES.items() for x in (F.lit(name), F.lit(values[which]))]
    return F.element_at(F.create_map(*pairs), status)


def _pairs(source: DataFrame, target: DataFrame, dialect: str) -> DataFrame:
    """Every (repository, tag) with its digests and the number of records on either side, checkpointed.

    Both sides are read once, as one table with a side to each row, and added up before they are shuffled. In the script
    dialect a source record may repeat: its digests stay rows of their own, and ``n_source`` says how often each occurs;
    of target records the last one counts. Records without repository or tag are counted only.
    """
    # The tag comes first: sorts then decide most comparisons on their first bytes.
    keys = ["tag", "repository"]
    arrival = F.col("arrival") if "arrival" in target.columns else F.lit(0)
    last = F.struct(arrival.alias("arrival"), F.coalesce("digest", F.lit("")).alias("digest"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    src = source.select(*keys, F.coalesce("digest", F.lit("")).alias("own"), one.alias("s"), zero.alias("t"))
    tgt = target.select(*keys, F.lit(None).cast("string").alias("own"), zero.alias("s"), one.alias("t"), last.alias("last"))
    both = src.unionByName(tgt, allowMissingColumns=True)
    sums = [F.sum("s").alias("n_source"), F.sum("t").alias("n_target")]
    if dialect == "role":
        pairs = both.groupBy(*keys).agg(F.max("own").alias("source_digest"), F.max("last").alias("last"), *sums)
    else:
        # a key's rows: one per digest of the source, and one of the target, whose record all others get
        split = both.groupBy(*keys, "own").agg(F.max("last").alias("own_last"), *sums)
        of_key = Window.partitionBy(*keys)
        split = split.withColumns({"last": F.max("own_last").over(of_key), "held": F.sum("n_source").over(of_key)})
        pairs = split.select(
            *keys, F.col("own").alias("source_digest"), "last", "n_source",
            F.when(F.col("n_target") > 0, F.col("n_target")).otherwise(zero).alias("n_target"), "held",
        )
    pairs = pairs.withColumns(
        {
            "target_digest": F.coalesce("last.digest", F.lit("")), "in_target": F.col("last").isNotNull(),
            "in_source": F.col("n_source") > 0, "source_digest": F.coalesce("source_digest", F.lit("")),
        }
    ).drop("last")
    use_checkpoint_dir(source.sparkSession)
    return pairs.checkpoint()


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, in two steps so that no long list is made."""
    step = 4096
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / step))))
    left = F.least(F.lit(step).cast("bigint"), F.col(times) - F.col("_block") * step)
    return rows.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("bigint"), left))).drop("_block", "_turn")


class Comparison:
    """Two snapshots compared: the ``rows`` of the comparison, and its ``summary``, from one pass over both sides.

    ``source`` and ``target`` hold (repository, tag, digest), one row per tag in the role dialect. The script dialect
    accepts repeated tags: every source record makes a row, and where ``target`` has an ``arrival`` column its last record
    wins. ``configs`` has one row per repository. What the sides hold per tag is checkpointed, rows and counts come from there.
    """

    def __init__(
        self, source: DataFrame, target: DataFrame, configs: DataFrame, errors: DataFrame | None = None, dialect: str = "role"
    ):
        self.configs = configs
        self.pairs = _pairs(source, target, dialect)
        self.rows = self._rows(_prepared(configs, dialect), errors, dialect)

    def _rows(self, cfg: DataFrame, errors: DataFrame | None, dialect: str) -> DataFrame:
        pairs = self.pairs.dropna(subset=["tag", "repository"])
        held = self.pairs.where("in_source").select("repository").distinct()
        if dialect == "script":
            # tags of the target alone show for repositories that the source lists, once each
            extras = pairs.where("held = 0").join(held, "repository", "left_semi")
            pairs = _repeated(pairs.where("in_source"), "n_source").unionByName(extras)
        rows = pairs.join(cfg, "repository")
        rows = rows.withColumn("in_filter", F.coalesce(F.rlike("tag", F.col("_regex")), F.lit(False)))
        seen = [F.col(c) for c in ("in_source", "in_target", "in_filter", "source_digest", "target_digest")]
        rows = rows.withColumn("status", tag_status(*seen))
        rows = rows.withColumns({"severity": _by_status(F.col("status"), 0), "message": _by_status(F.col("status"), 1)})
        result = rows.select(*ROW_COLUMNS).unionByName(_config_notes(cfg, held, dialect))
        return result if errors is None or dialect == "script" else result.unionByName(_error_rows(errors))

    def summary(self, statuses: Sequence[str] = fv.CANDIDATE_STATUSES, rows: DataFrame | None = None) -> DataFrame:
        """One row of counts; the candidate repositories themselves are ``sync_candidates``. ``rows`` may be a checkpointed
        copy of the rows."""
        candidate = F.when(F.col("status").isin(list(statuses)), F.col("repository"))
        totals = (self.rows if rows is None else rows).agg(
            F.count("*").alias("total_rows"), F.count_distinct(candidate).alias("candidate_repositories")
        )
        return totals.select(
            self.configs.agg(F.count("*")).scalar().alias("repositories_evaluated"),
            self.pairs.agg(total("n_source")).scalar().alias("source_tags_evaluated"),
            self.pairs.agg(total("n_target")).scalar().alias("target_tags_evaluated"),
            "total_rows",
            "candidate_repositories",
            (F.col("candidate_repositories") > 0).alias("has_divergence"),
        )


def reconcile(
    source: DataFrame, target: DataFrame, configs: DataFrame, errors: DataFrame | None = None, dialect: str = "role"
) -> DataFrame:
    """Classify every tag of the configured repositories: the rows of a ``Comparison``."""
    return Comparison(source, target, configs, errors, dialect).rows


def _config_notes(cfg: DataFrame, listed: DataFrame, dialect: str) -> DataFrame:
    """Rows about repositories as a whole: no source tags, no configuration, or a mirror switched off."""
    listed = listed.withColumn("_listed", F.lit(True))

    def note(condition: Column, status: str, severity: str, message: Column) -> Column:
        parts = F.struct(F.lit(status).alias("status"), F.lit(severity).alias("severity"), message.alias("message"))
        return F.when(condition, parts)

    notes = [
        note(F.col("_listed").isNull(), "SOURCE_REPOSITORY_EMPTY_OR_INACCESSIBLE", "warning", F.lit(fv.SOURCE_EMPTY_MESSAGE))
    ]
    if dialect == "role":
        unknown = F.concat(
            F.lit(fv.MIRROR_CONFIG_ERROR_MESSAGE), F.col("http_status").cast("string"), F.lit(". "), F.col("api_error")
        )
        off = F.col("mirror_found") & ~F.col("mirror_enabled")
        notes.append(note(~F.col("mirror_found"), "MIRROR_CONFIG_ERROR", "critical", unknown))
        notes.append(note(off, "MIRROR_DISABLED", "critical", F.lit(fv.MIRROR_DISABLED_MESSAGE)))
    found = cfg.join(listed, "repository", "left").select("*", F.inline(F.array_compact(F.array(*notes))))
    blank = {c: F.lit("") for c in ("tag", "source_digest", "target_digest")}
    return found.withColumns(blank).select(*ROW_COLUMNS)


def _error_rows(errors: DataFrame) -> DataFrame:
    message = F.concat("side", F.lit(" HTTP "), F.col("http_status").cast("string"), F.lit(": "), "message")
    blank = {c: F.lit("") for c in ("tag", "mirror_status", "filter", "source_digest", "target_digest")}
    fixed = {"status": F.lit("TAG_COLLECTION_ERROR"), "severity": F.lit("critical")}
    rows = errors.withColumns({"message": message, "mirror_enabled": F.lit(None).cast("boolean"), **blank, **fixed})
    return rows.select(*ROW_COLUMNS)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def severity_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count("*").alias("n"))


def sync_candidates(rows: DataFrame, statuses: Sequence[str] = fv.CANDIDATE_STATUSES) -> DataFrame:
    return rows.where(F.col("status").isin(list(statuses))).select("repository").distinct()


def visible_rows(rows: DataFrame, hidden: Sequence[str] = fv.NOISE_STATUSES, on: bool = True) -> DataFrame:
    return rows.where(~F.coalesce("status", F.lit("")).isin(list(hidden))) if on else rows


def visible_counts(rows: DataFrame, hidden: Sequence[str] = fv.NOISE_STATUSES, on: bool = True) -> DataFrame:
    """Counts by status and severity over the visible rows, and how many rows are hidden, in one pass."""
    hide = F.coalesce("status", F.lit("")).isin(list(hidden)) & F.lit(on)
    marked = rows.select(
        F.when(hide, F.lit("hidden")).otherwise(F.lit("visible")).alias("part"),
        F.when(~hide, F.coalesce("status", F.lit("UNKNOWN"))).alias("status"),
        F.when(~hide, F.coalesce("severity", F.lit("info"))).alias("severity"),
    )
    return marked.groupBy("part", "status", "severity").agg(F.count("*").alias("n"))


def display_rows(rows: DataFrame, show_ok: bool = False) -> DataFrame:
    """Rows other than OK; all rows where there are no others."""
    if show_ok:
        return rows
    other = F.col("status") != "OK"
    return rows.where(other | (rows.agg(F.count_if(other)).scalar() == 0))


def report_preview(rows: DataFrame, limit: int = 200) -> DataFrame:
    labelled = rows.withColumns({"label": tx.status_label("status"), "explanation": tx.status_text("status")})
    return preview(labelled, ["repository", "tag", "status", "message"], limit)


def report_level(
    rows: DataFrame,
    waits: DataFrame | None = None,
    actions: DataFrame | None = None,
    missing_mirrors: DataFrame | None = None,
    conflicts: DataFrame | None = None,
    hidden: Sequence[str] = fv.NOISE_STATUSES,
) -> DataFrame:
    """Verdict of a run: crit, warn or ok, with the counts it rests on."""
    seen = visible_rows(rows, hidden)
    counts = seen.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
    )
    zero = F.lit(0).cast("bigint")
    troubles = zero
    if waits is not None:
        troubles = troubles + wait_outcomes(waits).agg(F.count_if(F.col("outcome") != "done")).scalar()
    if actions is not None:
        troubles = troubles + actions.agg(F.count_if(~F.col("ok"))).scalar()
    for extra in (missing_mirrors, conflicts):
        if extra is not None:
            troubles = troubles + extra.agg(F.count("*")).scalar()
    counts = counts.withColumn("troubles", troubles)
    level = F.when((F.col("critical") > 0) | (F.col("troubles") > 0), "crit").when(F.col("warning") > 0, "warn")
    return counts.withColumn("level", level.otherwise("ok"))


def enforce_policy(summary: DataFrame, fail_on_divergence: bool) -> DataFrame:
    """Fail the job when the summary shows a divergence and the policy is on."""
    if not fail_on_divergence:
        return summary
    stop = F.raise_error(F.lit("divergence between source and target"))
    return summary.where(F.when(~F.col("has_divergence"), F.lit(True)).otherwise(stop))


def mirrors_only(repositories: DataFrame) -> DataFrame:
    return repositories.where(F.col("state") == "MIRROR")


def classify_repositories(source: DataFrame, target: DataFrame, exceptions: Sequence[str] = ()) -> DataFrame:
    """Every source repository as missing, existing, ignored or conflict on the target (both sides unique by name)."""
    state = target.select("repository", F.coalesce("state", F.lit("")).alias("target_state"))
    found = F.col("target_state").isNotNull()
    kind = (
        F.when(~found, "missing")
        .when(F.col("target_state") == "MIRROR", "existing")
        .when(F.col("repository").isin(list(exceptions)), "ignored")
        .otherwise("conflict")
    )
    return source.join(state, "repository", "left").withColumn("classification", kind)


def mirror_outcomes(
    initial: DataFrame, created: DataFrame, remaining: DataFrame, conflicts: DataFrame, ignored: DataFrame
) -> DataFrame:
    """What became of every repository without a mirror, with conflicts and known exceptions."""
    flags = initial.select("repository").join(
        created.select("repository", F.lit(True).alias("_created")).distinct(), "repository", "left"
    )
    flags = flags.join(remaining.select("repository", F.lit(True).alias("_remaining")).distinct(), "repository", "left")
    outcome = F.when(F.col("_created"), "created").when(F.col("_remaining"), "still_missing").otherwise("unchanged")
    rows = flags.select("repository", F.lit("missing").alias("situation"), outcome.alias("outcome"))
    for frame, situation, name in ((conflicts, "conflict", "check"), (ignored, "ignored", "exception")):
        rows = rows.unionByName(
            frame.select("repository", F.lit(situation).alias("situation"), F.lit(name).alias("outcome"))
        )
    return rows


def mirror_stats(configs: DataFrame) -> DataFrame:
    """Counts over the mirror configurations; the filters themselves are ``mirror_filters``."""
    shown = F.array_join(F.coalesce("rule_value", F.array(F.lit("*"))), ", ")
    return configs.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("is_enabled", F.lit(False))).alias("enabled"),
        F.count_if(~F.coalesce("is_enabled", F.lit(False))).alias("disabled"),
        F.count_if(F.coalesce("sync_status", F.lit("")) == "SUCCESS").alias("last_success"),
        F.count_distinct(shown).alias("distinct_filters"),
    )


def mirror_filters(configs: DataFrame) -> DataFrame:
    shown = F.array_join(F.coalesce("rule_value", F.array(F.lit("*"))), ", ")
    return configs.groupBy(shown.alias("filter")).agg(F.count("*").alias("repositories"))


def sync_actions(responses: DataFrame) -> DataFrame:
    """Answers of the cancel and start calls as action rows; ``arrival`` tells repeated calls apart."""
    status = F.coalesce("status", F.lit(0).cast("bigint"))
    ok = F.lit(False)
    for action, codes in fv.ACTION_OK_CODES.items():
        ok = ok | ((F.col("action") == action) & status.isin(codes))
    return responses.select(
        F.coalesce("repository", F.lit("N/A")).alias("repository"),
        "action",
        status.alias("http_status"),
        ok.alias("ok"),
        F.coalesce("detail", "error_message", "msg", F.lit("")).alias("message"),
        "arrival",
    )


def failed_actions(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count_if(~F.col("ok")).alias("failed_actions"))


def wait_outcomes(waits: DataFrame) -> DataFrame:
    state = F.coalesce("sync_status", F.lit("UNKNOWN"))
    outcome = (
        F.when(F.coalesce("http_status", F.lit(0)) != 200, "http_error")
        .when(state.isin(fv.WAIT_FAILED), "failed")
        .when(~state.isin(fv.WAIT_DONE), "timeout")
        .otherwise("done")
    )
    return waits.withColumns({"sync_status": state, "outcome": outcome})


def wait_summary(waits: DataFrame) -> DataFrame:
    counts = wait_outcomes(waits).agg(
        F.count_if(F.col("outcome") == "timeout").alias("total_timeout"),
        F.count_if(F.col("outcome") == "failed").alias("total_terminal_failed"),
        F.count_if(F.col("outcome") == "http_error").alias("total_http_errors"),
    )
    some = F.col("total_timeout") + F.col("total_terminal_failed") + F.col("total_http_errors") > 0
    return counts.withColumn("has_partial_failure", some)


def sync_progress(
    candidates: DataFrame,
    actions: DataFrame,
    waits: DataFrame,
    before: DataFrame,
    after: DataFrame,
    statuses: Sequence[str] = fv.CANDIDATE_STATUSES,
) -> DataFrame:
    """Per candidate: bad rows before, what the calls answered, how the wait ended, bad rows after, and the outcome.

    ``actions`` and ``waits`` need an ``arrival`` column; the last one per repository counts.
    """

    def bad(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(F.col("status").isin(list(statuses))).groupBy("repository").agg(F.count("*").alias(name))

    def last(value: str, action: str) -> Column:
        return F.max_by(value, F.when(F.col("action") == action, F.col("arrival")))

    calls = actions.groupBy("repository").agg(
        last("http_status", "sync-cancel").alias("cancel_status"),
        last("ok", "sync-cancel").alias("cancel_ok"),
        last("http_status", "sync-now").alias("now_status"),
        last("ok", "sync-now").alias("now_ok"),
    )
    ended = wait_outcomes(waits).groupBy("repository").agg(
        *[F.bool_or(F.col("outcome") == kind).alias(f"wait_{kind}") for kind in ("http_error", "failed", "timeout")]
    )
    rows = candidates.select("repository").distinct()
    for frame in (bad(before, "bad_before"), bad(after, "bad_after"), calls, ended):
        rows = rows.join(frame, "repository", "left")
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumns(
        {"bad_before": F.coalesce("bad_before", zero), "bad_after": F.coalesce("bad_after", zero)}
    )
    outcome = (
        F.when(F.col("wait_http_error"), "http_error")
        .when(F.col("wait_failed"), "failed")
        .when(F.col("wait_timeout"), "timeout")
        .when(F.col("bad_after") == 0, "resolved")
        .otherwise("pending")
    )
    return rows.withColumn("outcome", outcome).drop("wait_http_error", "wait_failed", "wait_timeout")


def _worst(rows: DataFrame, side: str) -> DataFrame:
    """``rows`` with a key per tag, or per note of a repository, and the status with its rank on one ``side``."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).when(F.col("severity") == "ok", 0).otherwise(1)
    about = F.when(F.col("tag") == "", F.col("status")).otherwise("")
    return rows.select("repository", "tag", about.alias("about"), F.struct(rank.alias("rank"), "status").alias(side))


def sync_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many tags went from which status to which: ``status_before, status_after, n``, absent ones as ABSENT.

    Both results are added up per (repository, tag) in one pass; of a tag's repeated rows the worst counts. Notes about a
    repository are matched by their status.
    """
    both = _worst(before, "b").unionByName(_worst(after, "a"), allowMissingColumns=True)
    keyed = both.groupBy("repository", "tag", "about").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    names = [F.coalesce(f"{side}.status", F.lit("ABSENT")).alias(name) for side, name in (("b", "status_before"), ("a", "status_after"))]
    return keyed.groupBy(*names).agg(F.count("*").alias("n"))


def sync_result(mode: str, before: DataFrame, after: DataFrame, actions: DataFrame, waits: DataFrame, progress: DataFrame) -> DataFrame:
    """One row on a whole run: candidates, calls, waits, and what the comparison showed before and after.

    ``before`` and ``after`` are comparison summaries, ``progress`` is ``sync_progress``.
    """
    one = lambda frame, prefix: frame.select(*[F.col(c).alias(f"{prefix}_{c}") for c in (
        "total_rows", "candidate_repositories", "has_divergence")])
    outcomes = progress.agg(
        F.count("*").alias("candidates"),
        *[F.count_if(F.col("outcome") == name).alias(f"{name}_repositories") for name in ("resolved", "pending")],
    )
    parts = [outcomes, actions.agg(F.count("*").alias("actions")), failed_actions(actions), wait_summary(waits), one(before, "initial"), one(after, "final")]
    row = before.sparkSession.range(1).select(F.lit(mode).alias("mode"))
    for part in parts:  # aggregates of one row each
        row = row.withColumns({c: part.select(c).scalar() for c in part.columns})
    return row.withColumn("performed", F.col("actions") > 0)


def call_badge(status: Column | str, ok: Column | str) -> Column:
    """How a cancel or start call is shown."""
    code = tx.col(status)
    return (
        F.when(code.isNull(), "not_run")
        .when(~tx.col(ok), "failed")
        .when(code == 404, "no_active_sync")
        .when(code == 400, "nothing_to_do")
        .otherwise("ok")
    )


def response_outcome(responses: DataFrame) -> DataFrame:
    """Answers of the create and robot calls: created, found, robot missing, or unexpected."""
    code = F.coalesce("status", F.lit(0).cast("bigint"))
    text = F.lower(F.coalesce("message", F.lit("")))
    missing = (code == 404) | ((code == 400) & F.contains(text, F.lit(fv.ROBOT_NOT_FOUND_TEXT)))
    outcome = F.when(code == 201, "created").when(code == 200, "found").when(missing, "robot_missing")
    return responses.withColumn("outcome", outcome.otherwise("unexpected"))


def inventory_summary(source: DataFrame, target: DataFrame, source_tags: DataFrame, target_tags: DataFrame) -> DataFrame:
    """Repositories visible, mirrors found and tags, per side; every side is counted before the sides meet."""

    def side(name: str, repositories: DataFrame, tags: DataFrame) -> DataFrame:
        return repositories.agg(
            F.lit(name).alias("side"),
            F.count("*").alias("repositories_visible"),
            F.count_if(F.col("state") == "MIRROR").alias("mirrors_found"),
        ).withColumn("tags", tags.agg(F.count("*")).scalar())

    return side("source", source, source_tags).unionByName(side("target", target, target_tags))


def tags_per_repository(tags: DataFrame, order: Sequence[str] = ("tag",), n: int = 10) -> DataFrame:
    """Tag count per repository and the first ``n`` names."""
    counts = tags.groupBy("repository").agg(F.count("*").alias("tag_count"))
    heads = first_rows(tags.select("repository", "tag", *[c for c in order if c != "tag"]), ["repository"], order, n)
    ranked = F.array_sort(F.collect_list(F.struct(*order, F.col("tag").alias("_tag"))))
    heads = heads.groupBy("repository").agg(F.transform(ranked, lambda s: s["_tag"]).alias("sample_tags"))
    return counts.join(heads, "repository")


def page_gaps(pages: DataFrame, limit: int = 100, max_pages: int = 10) -> DataFrame:
    """Repositories whose listing may not be whole.

    ``pages`` has (repository, page_index, status, tags_on_page, has_next). A last page that is full asks for another
    one; a last page that still names a next page after the page limit means the listing was cut.
    """
    last = pages.groupBy("repository").agg(
        F.max("page_index").alias("last_page"),
        F.max_by(F.struct("status", "tags_on_page", "has_next"), "page_index").alias("p"),
    )
    full = (F.col("p.status") == 200) & (F.col("p.tags_on_page") >= limit)
    rows = last.select(
        "repository",
        "last_page",
        F.col("p.tags_on_page").alias("tags_on_page"),
        (full & (F.col("last_page") < max_pages)).alias("needs_next_page"),
        ((full | F.col("p.has_next")) & (F.col("last_page") >= max_pages)).alias("incomplete"),
    )
    return rows.where(F.col("needs_next_page") | F.col("incomplete"))
