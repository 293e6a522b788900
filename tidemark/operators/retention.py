"""Retention: which rules hold on which host, which files they reach, and what a run leaves behind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import globs
from tidemark.functions import text as tx
from tidemark.operators.common import first_rows, total
from tidemark.session import use_checkpoint_dir

EMPTY = "array<string>"


# ---- rules -------------------------------------------------------------------------------------------------------


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.coalesce("enabled", F.lit(True)))


def split_engines(rules: DataFrame, default: str = "shell") -> tuple[DataFrame, DataFrame]:
    """Rules that can run, and report rows for those that name an unknown engine."""
    named = rules.withColumn("engine", F.coalesce("engine", F.lit(default)))
    known = F.col("engine").isin("modules", "shell")
    unknown = named.where(~known).withColumns(
        {"status": F.lit("blocked"), "status_detail": F.lit(fv.UNKNOWN_ENGINE_DETAIL)}
    )
    return named.where(known), unknown


def normalize_rules(rules: DataFrame) -> DataFrame:
    """Clean path and pattern lists, with ``*`` where a rule names no pattern at all."""
    none, every = F.array().cast(EMPTY), F.array(F.lit("*"))

    def clean(name: str, default: Column) -> Column:
        return F.filter(F.transform(F.coalesce(name, default), lambda x: F.trim(x)), lambda x: x != "")

    return rules.withColumns(
        {
            "paths": clean("paths", none),
            "patterns": clean("patterns", every),
            "exclude_patterns": clean("exclude_patterns", none),
            "allowed_prefixes": clean("allowed_prefixes", none),
            "recursive": F.coalesce("recursive", F.lit(False)),
            "delete_empty_dirs": F.coalesce("delete_empty_dirs", F.lit(False)),
        }
    )


def rule_errors(rules: DataFrame) -> DataFrame:
    """Adds ``fatal_errors``: what keeps a (normalized) rule from running.

    The shell engine takes digits only as an age, the modules engine the whole part of any number.
    """
    age = F.col("age_days").cast("string")
    readable = (F.col("engine") == "modules") | F.rlike(age, F.lit(r"\A[0-9]+\z"))
    valid_age = F.coalesce(readable & (tx.safe_int(age) > 0), F.lit(False))
    found = F.array(
        F.when(F.size("paths") == 0, fv.RULE_NO_PATHS),
        F.when(F.size("patterns") == 0, fv.RULE_NO_PATTERNS),
        F.when(~valid_age, fv.RULE_BAD_AGE),
    )
    return rules.withColumn("fatal_errors", F.array_compact(found))


def _forbidden(paths: Sequence[str], engine: str) -> list[str]:
    """Windows paths as the guard compares them."""
    bare = [p if engine == "modules" and len(p) <= 3 else p.rstrip("\\/") for p in paths]
    return [p.lower() for p in bare]


def guard_paths(
    rules: DataFrame,
    min_length: Mapping[str, int] = fv.MIN_PATH_LENGTH,
    forbidden_linux: Sequence[str] = fv.FORBIDDEN_LINUX,
    forbidden_windows: Sequence[str] = fv.FORBIDDEN_WINDOWS,
    enforce: bool = True,
    required: bool = False,
) -> DataFrame:
    """Adds ``allowed`` paths and ``blocked`` (path, reason) to normalized rules; a projection, nothing is shuffled.

    Linux compares paths as written, Windows in lower case with either separator. Trailing separators go, but the
    modules engine keeps those of ``C:\\``, and the Windows shell engine reports paths as they were given.
    """
    linux = F.coalesce("os", F.lit("linux")) != "windows"
    modules = F.col("engine") == "modules"

    def bare(path: Column) -> Column:
        long = F.when(linux, F.length(path) > 1).otherwise(~modules | (F.length(path) > 3))
        separators = F.when(linux, F.lit("/")).otherwise(F.lit("/\\"))
        return F.when(long, F.rtrim(path, separators)).otherwise(path)

    def verdict(path: Column) -> Column:
        trimmed = F.trim(path)
        stored = F.when(linux | modules, bare(trimmed)).otherwise(trimmed)
        return F.struct(stored.alias("path"), _compared(bare(trimmed), linux).alias("compared"))

    def texts(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(EMPTY)

    barred = (
        F.when(linux, texts(forbidden_linux))
        .when(modules, texts(_forbidden(forbidden_windows, "modules")))
        .otherwise(texts(_forbidden(forbidden_windows, "shell")))
    )
    prepared = rules.withColumns(
        {
            "_paths": F.transform("paths", verdict),
            "_prefixes": F.filter(
                F.transform("allowed_prefixes", lambda p: _compared(bare(F.trim(p)), linux)), lambda p: p != ""
            ),
            "_barred": barred,
            "_shortest": F.when(linux, min_length["linux"]).otherwise(min_length["windows"]),
        }
    )

    def inside(path: Column) -> Column:
        def below(prefix: Column) -> Column:
            other = ~linux & F.startswith(path, F.concat(prefix, F.lit("\\")))
            return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/"))) | other

        return F.exists("_prefixes", below)

    def judged(p: Column) -> Column:
        stored, compared = p["path"], p["compared"]
        reason = (
            F.when(stored == "", fv.PATH_EMPTY)
            .when(F.length(stored) < F.col("_shortest"), fv.PATH_TOO_SHORT)
            .when(F.array_contains(F.col("_barred"), compared), fv.PATH_FORBIDDEN)
        )
        if enforce:
            none = F.size("allowed_prefixes") == 0
            if required:
                reason = reason.when(none, fv.PATH_PREFIX_REQUIRED)
            reason = reason.when(~none & ~inside(compared), fv.PATH_OUTSIDE)
        return F.struct(stored.alias("path"), reason.alias("reason"))

    judged_rules = prepared.withColumn("_verdicts", F.transform("_paths", judged))
    passed = F.filter("_verdicts", lambda v: v["reason"].isNull())
    found = {
        "allowed": F.array_distinct(F.transform(passed, lambda v: v["path"])),
        "blocked": F.filter("_verdicts", lambda v: v["reason"].isNotNull()),
    }
    return judged_rules.withColumns(found).drop("_paths", "_prefixes", "_barred", "_shortest", "_verdicts")


def _compared(path: Column, linux: Column) -> Column:
    return F.when(linux, path).otherwise(F.lower(path))


def path_state(rules: DataFrame, listing: DataFrame, keys: Sequence[str] = ("host", "rule")) -> DataFrame:
    """State of every allowed path: existing, missing or error, with the reason.

    ``listing`` has one row per (host, path): is_dir and message (text of a failed look-up, or null).
    """
    paths = rules.select(*keys, F.explode("allowed").alias("path"))
    seen = listing.select("host", "path", "is_dir", F.coalesce("message", F.lit("")).alias("message"), F.lit(True).alias("_seen"))
    lowered, denied = F.lower("message"), F.lit(False)
    for words in fv.DENIED_WORDS:
        denied = denied | F.contains(lowered, F.lit(words))
    state = (
        F.when(F.col("_seen").isNull(), "missing")
        .when(denied, "error")
        .when(F.col("is_dir"), "existing")
        .when(F.col("message") != "", "error")
        .when(F.col("is_dir").isNull(), "missing")
        .otherwise("missing")
    )
    reason = (
        F.when(F.col("_seen").isNull() | ((F.col("state") == "missing") & F.col("is_dir").isNull()), fv.PATH_NOT_FOUND)
        .when(F.col("state") == "missing", fv.PATH_NOT_DIRECTORY)
        .when(denied, fv.PATH_DENIED)
        .when(F.col("state") == "error", F.concat(F.lit("falha ao validar o path: "), F.col("message")))
    )
    joined = paths.join(seen, ["host", "path"], "left").withColumn("state", state).withColumn("reason", reason)
    return joined.select(*keys, "path", "state", "reason")


# ---- plan --------------------------------------------------------------------------------------------------------


def plan_memberships(
    matrix: DataFrame, asked: DataFrame | None = None, envs: Sequence[str] = (), applications: Sequence[str] = ()
) -> DataFrame:
    """One row per (host, environment, application) of the selection; only the hosts asked for, where any were."""
    rows = matrix.withColumns({"environment": F.lower("environment"), "application": F.lower("application")})
    if envs:
        rows = rows.where(F.col("environment").isin([e.lower() for e in envs]))
    if applications:
        rows = rows.where(F.col("application").isin([a.lower() for a in applications]))
    members = rows.withColumn("host", F.explode(tx.normalize_array("members", lower=True))).drop("members")
    return members if asked is None else members.join(asked.select(F.lower("host").alias("host")).distinct(), "host", "left_semi")


def _applies(rule_hosts: str, excluded: str) -> Column:
    include = tx.normalize_array(F.coalesce(rule_hosts, F.array().cast(EMPTY)), lower=True)
    exclude = tx.normalize_array(F.coalesce(excluded, F.array().cast(EMPTY)), lower=True)
    listed = (F.size(include) == 0) | F.array_contains(include, F.col("host"))
    return listed & ~F.array_contains(exclude, F.col("host"))


def resolve_plan(
    matrix: DataFrame,
    rules: DataFrame,
    applications: DataFrame,
    asked: DataFrame | None = None,
    envs: Sequence[str] = (),
    selected: Sequence[str] = (),
    global_rules: bool = False,
    allow_adhoc: bool = False,
    default_engine: str = "shell",
    default_prefixes: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Rules of every host.

    ``matrix``        environment, application, members, allowed_prefixes (map by os), merge (map by os)
    ``applications``  application, allowed_prefixes (map by os)
    ``rules``         scope (global, application, environment_overlay), application, environment, os, position and
                      the rule's own fields; global rules carry the application ``_global``
    """
    defaults = {"linux": [], "windows": [], **(default_prefixes or {})}
    prefix_map = "map<string,array<string>>"
    members = plan_memberships(matrix, asked, envs, selected)
    app_prefixes = applications.select(
        F.lower("application").alias("application"), F.col("allowed_prefixes").alias("_app_prefixes")
    )
    placed = members.join(app_prefixes, "application", "left").select(
        "host",
        "environment",
        "application",
        F.lit("matrix").alias("_via"),
        F.col("allowed_prefixes").cast(prefix_map).alias("_env_prefixes"),
        F.col("_app_prefixes").cast(prefix_map).alias("_app_prefixes"),
        F.col("merge").alias("_merge"),
    )
    hosts = members.select("host").distinct() if asked is None else asked.select(F.lower("host").alias("host")).distinct()

    def placed_as(frame: DataFrame, environment: str, application: Column, via: str, prefixes: Column) -> DataFrame:
        return frame.select(
            "host",
            F.lit(environment).alias("environment"),
            application.alias("application"),
            F.lit(via).alias("_via"),
            F.lit(None).cast(prefix_map).alias("_env_prefixes"),
            prefixes.cast(prefix_map).alias("_app_prefixes"),
            F.lit(None).cast("map<string,string>").alias("_merge"),
        )

    if global_rules:
        placed = placed.unionByName(placed_as(hosts, "global", F.lit("_global"), "global", F.lit(None)))
    if allow_adhoc and asked is not None:
        outside = hosts.join(members.select("host").distinct(), "host", "left_anti")
        chosen = [a.lower() for a in selected]
        if not chosen:
            raise ValueError("hosts outside the matrix need a selection of applications")
        spread = outside.withColumn("application", F.explode(F.array(*[F.lit(a) for a in chosen])))
        spread = spread.join(app_prefixes, "application", "left")
        placed = placed.unionByName(placed_as(spread, "adhoc", F.col("application"), "adhoc", F.col("_app_prefixes")))

    own = rules.withColumns(
        {
            "application": F.lower("application"),
            "_rule_env": F.lower("environment"),
            "_rule_prefixes": F.col("allowed_prefixes"),
        }
    ).drop("environment", "allowed_prefixes")
    # scope and environment are part of the key, so a member never meets the overlay rules of other environments
    asked_for = {"global": ["global"], "matrix": ["application", "environment_overlay"], "adhoc": ["application"]}
    scopes = F.create_map(*[x for via, names in asked_for.items() for x in (F.lit(via), F.array(*[F.lit(n) for n in names]))])
    placed = placed.withColumn("scope", F.explode(scopes[F.col("_via")]))
    overlay = F.col("scope") == "environment_overlay"
    placed = placed.withColumn("_env_key", F.when(overlay, F.col("environment")).otherwise(""))
    own = own.withColumn("_env_key", F.when(overlay, F.col("_rule_env")).otherwise(""))
    pairs = placed.join(own, ["application", "scope", "_env_key"]).drop("_env_key")
    via, scope = F.col("_via"), F.col("scope")
    replaced = F.coalesce(F.try_element_at("_merge", F.col("os")), F.lit("merge")) == "replace"
    source = (
        F.when((via == "global") & (scope == "global"), "global")
        .when((via == "matrix") & (scope == "application") & ~replaced, "application")
        .when(
            (via == "matrix") & (scope == "environment_overlay") & (F.col("_rule_env") == F.col("environment")),
            "environment_overlay",
        )
        .when((via == "adhoc") & (scope == "application"), "application_adhoc")
    )
    default = F.when(F.col("os") == "windows", F.array(*[F.lit(p) for p in defaults["windows"]]).cast(EMPTY)).otherwise(
        F.array(*[F.lit(p) for p in defaults["linux"]]).cast(EMPTY)
    )
    none = F.array().cast(EMPTY)
    app = F.try_element_at("_app_prefixes", F.col("os"))
    env = F.try_element_at("_env_prefixes", F.col("os"))
    both = F.concat(F.coalesce(app, none), F.coalesce(env, none))
    allowed = (
        F.when(via == "global", F.coalesce("_rule_prefixes", default))
        .when(via == "adhoc", F.coalesce(app, default))
        .when(F.size(both) > 0, both)
        .otherwise(default)
    )
    plan = pairs.withColumn("source", source).where(F.col("source").isNotNull() & _applies("hosts", "exclude_hosts"))
    plan = plan.withColumns({"allowed_prefixes": allowed, "engine": F.coalesce("engine", F.lit(default_engine))})
    hidden = ["_via", "_env_prefixes", "_app_prefixes", "_merge", "_rule_env", "_rule_prefixes", "hosts", "exclude_hosts"]
    return plan.drop(*hidden, "scope")


def hosts_without_rules(hosts: DataFrame, members: DataFrame, plan: DataFrame) -> DataFrame:
    """Hosts that belong to no application and have no rule."""
    known = members.select("host").distinct().union(plan.select("host").distinct()).distinct()
    return hosts.select(F.lower("host").alias("host")).distinct().join(known, "host", "left_anti")


def unknown_names(asked: DataFrame, known: DataFrame, name: str) -> DataFrame:
    return asked.select(name).distinct().join(known.select(name).distinct(), name, "left_anti")


def effective_selection(asked: Column | str, defaults: Column | str, known: Column | str) -> Column:
    """The values asked for, else the configured defaults, else all known ones."""
    return (
        F.when(F.size(tx.col(asked)) > 0, tx.col(asked))
        .when(F.size(tx.col(defaults)) > 0, tx.col(defaults))
        .otherwise(tx.col(known))
    )


def classify_hosts(targets: DataFrame, ssh: DataFrame, winrm: DataFrame, timeout: int = 3) -> DataFrame:
    """Operating system by which port answered in time; Windows wins where both did."""

    def answered(probe: DataFrame, name: str) -> DataFrame:
        return probe.groupBy("host").agg(F.bool_or(F.col("elapsed") < timeout).alias(name))

    rows = targets.select("host").distinct().join(answered(ssh, "_ssh"), "host", "left").join(answered(winrm, "_win"), "host", "left")
    return rows.select("host", F.when(F.col("_win"), "windows").when(F.col("_ssh"), "linux").otherwise("unknown").alias("os"))


# ---- files -------------------------------------------------------------------------------------------------------


def expired(mtime: Column | str, age_days: Column | str, as_of: datetime) -> Column:
    return tx.col(mtime) <= _cutoff(tx.col(age_days), as_of)


def _cutoff(age_days: Column, as_of: datetime) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(age_days)


def execution_order(engine: Column | str, position: Column | str) -> Column:
    """Modules rules run before shell rules, each in plan order."""
    return F.when(tx.col(engine) == "modules", F.lit(0)).otherwise(F.lit(1)) * F.lit(1 << 40) + tx.col(position)


def _is_windows(path: Column) -> Column:
    """A path with a drive, or of a network share."""
    return (F.substring(path, 2, 1) == ":") | F.startswith(path, F.lit("\\\\")) | F.startswith(path, F.lit("//"))


def _path_key(path: Column) -> Column:
    """Path with ``/`` separators; a Windows path in lower case, a share with its two leading separators."""
    return F.when(_is_windows(path), F.lower(F.translate(path, "\\", "/"))).otherwise(path)


def _file_name(path: Column) -> Column:
    plain = F.when(_is_windows(path), F.translate(path, "\\", "/")).otherwise(path)
    return F.substring_index(plain, "/", -1)


def _separators(key: Column) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit("/"), F.lit("")))


def _ancestors(key: Column) -> Column:
    """Directories above a path, nearest last."""
    depth = _separators(key)
    above = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.call_function("substring_index", key, F.lit("/"), i))
    return F.filter(above, lambda d: (d != "") & (depth > 0))


def _rule_regexes() -> tuple[Column, Column]:
    """Tests of a rule's patterns and exclusions. Only the modules engine minds case, and it excludes by simple globs."""
    modules, windows = F.col("engine") == "modules", F.coalesce("os", F.lit("linux")) == "windows"
    negation = modules | ~windows
    include = globs.wildcards_regex(F.col("patterns"), negation, ~modules)
    exclude = F.when(modules, globs.globs_regex(F.col("exclude_patterns"), "simple_name")).otherwise(
        globs.wildcards_regex(F.col("exclude_patterns"), negation, F.lit(True))
    )
    return include, exclude


def rule_roots(rules: DataFrame, as_of: datetime) -> DataFrame:
    """One row per root a rule may walk, with its compiled tests.

    A root below another root of the same recursive rule is left out, so a file meets a rule at most once.
    """
    roots = F.transform("allowed", lambda p: F.regexp_replace(_path_key(p), r"/+\z", ""))
    nested = lambda root: F.exists("_roots", lambda other: F.startswith(root, F.concat(other, F.lit("/"))))
    walked = F.when(F.col("recursive"), F.filter("_roots", lambda r: ~nested(r))).otherwise(F.col("_roots"))
    include, exclude = _rule_regexes()
    prepared = rules.where(F.size("fatal_errors") == 0).withColumn("_roots", F.array_distinct(roots))
    return prepared.select(
        "host",
        "rule_id",
        execution_order("engine", "position").alias("plan_order"),
        "recursive",
        "delete_empty_dirs",
        _cutoff(tx.safe_int("age_days").cast("int"), as_of).alias("_cutoff"),
        include.alias("_include"),
        exclude.alias("_exclude"),
        F.explode(walked).alias("_dir"),
    )


def match_files(files: DataFrame, rules: DataFrame, as_of: datetime) -> DataFrame:
    """Files every rule would delete: below its roots, old enough, named by a pattern and by no exclusion.

    ``rules`` is a guarded plan (host, rule_id, position, allowed, fatal_errors, ...). A file appears once per rule.
    The directories above a file meet the roots in an equi-join; no file is compared with every rule. One small job
    over the roots comes first: it finds how many there are, at which depths, and the newest cutoff.
    """
    roots = _Roots(rule_roots(rules, as_of))
    path = F.col("path")
    aged = files.where(F.col("mtime") <= F.lit(roots.newest).cast("timestamp_ntz"))
    aged = aged.select("host", "path", "size", "mtime", _path_key(path).alias("_key"), _file_name(path).alias("_name"))
    old_enough = (F.col("mtime") <= F.col("_cutoff")) & (F.col("recursive") | F.col("_parent"))
    named = F.rlike("_name", F.col("_include")) & ~F.rlike("_name", F.col("_exclude"))
    return roots.above(aged).where(old_enough & named).select("host", "rule_id", "plan_order", "path", "size", "mtime")


ROOTS_BROADCAST = 64 << 20


class _Roots:
    """Rule roots with their bytes, their depths and the newest cutoff, from one aggregation."""

    def __init__(self, frame: DataFrame):
        self.frame = frame
        depth = _separators(F.col("_dir")) + 1
        texts = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in ("host", "rule_id", "_include", "_exclude", "_dir")), F.lit(64))
        size = F.coalesce(F.sum(texts), F.lit(0))
        self.bytes, self.newest, depths = frame.agg(size, F.max("_cutoff"), F.collect_set(depth)).first()
        self.depths = sorted(depths)

    def above(self, rows: DataFrame) -> DataFrame:
        """Rows (with ``_key``) joined to the roots above them; roots of few bytes are broadcast, so that no row is shuffled."""
        key = F.col("_key")
        dirs = F.array(*[F.substring_index(key, "/", d) for d in self.depths]).cast("array<string>")
        steps = rows.withColumn("_dir", F.explode(dirs)).where(F.col("_dir") != key)
        steps = steps.withColumn("_parent", _separators(key) == _separators(F.col("_dir")) + 1).drop("_key")
        roots = F.broadcast(self.frame) if self.bytes <= ROOTS_BROADCAST else self.frame
        return steps.join(roots, ["host", "_dir"])


def deletions(matches: DataFrame) -> DataFrame:
    """What an apply run deletes: every file once, by the first rule in execution order."""
    return first_rows(matches, ["host", "path"], ["plan_order", "rule_id"])


def apply_retention(
    files: DataFrame, matches: DataFrame, failures: DataFrame | None = None, mode: str = "check", confirmed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Survivors and ledger of a run. Only ``mode="apply"`` with a confirmation removes anything.

    The ledger of an apply run is checkpointed. In check mode it lists a file for every rule that would take it, with ``deleted`` false.
    """
    if mode != "apply" or not confirmed:
        return files, matches.withColumn("deleted", F.lit(False))
    ledger = deletions(matches)
    if failures is None:
        ledger = ledger.withColumn("deleted", F.lit(True))
    else:
        failed = failures.select("host", "path", F.lit(True).alias("_failed")).distinct()
        ledger = ledger.join(failed, ["host", "path"], "left").withColumn("deleted", F.col("_failed").isNull())
        ledger = ledger.drop("_failed")
    use_checkpoint_dir(files.sparkSession)
    ledger = ledger.checkpoint()  # read for the survivors twice
    return survivors_of(files, ledger.where("deleted").select("host", "path")), ledger


#: Bits of the filter of deleted files, 16 MB whatever the input. With as many deleted files as a quarter of that, about
#: one in five files that stay is shuffled in vain; more deleted files make the filter useless, never wrong.
DELETED_BITS = 1 << 27


def deleted_bits(gone: DataFrame, bits: int = DELETED_BITS) -> DataFrame:
    """A bitmap of the hashed (host, path) of ``gone``: at most ``bits / 32768`` rows of 4 KB."""
    at = gone.select(_bit_of("host", "path", bits=bits).alias("_at"))
    return at.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits")
    )


def _bit_of(*keys: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1


def _marked(files: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """``files`` with ``_hit``, whether a file's bit is set. The bitmap is of fixed size, so it is broadcast."""
    at = files.withColumn("_at", _bit_of("host", "path", bits=bits)).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    place = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return at.join(F.broadcast(marks), "_bucket", "left").withColumn("_hit", hit).drop("_at", "_bucket", "_bits")


def survivors_of(files: DataFrame, gone: DataFrame, bits: int = DELETED_BITS) -> DataFrame:
    """``files`` without those in ``gone`` (host, path).

    A bitmap of the deleted files tells which files may be among them: only these are shuffled for the exact anti join, all
    others stay where they are read.
    """
    marked = _marked(files, deleted_bits(gone, bits), bits)
    clear = marked.where("not _hit").drop("_hit")
    return clear.unionByName(marked.where("_hit").drop("_hit").join(gone, ["host", "path"], "left_anti"))


def rule_counters(ledger: DataFrame, applied: bool = True) -> DataFrame:
    """Matched, deleted and failed files and bytes per host and rule."""
    gone = F.col("deleted")
    return ledger.groupBy("host", "rule_id").agg(
        F.count("*").alias("matched_files"),
        F.count_if(gone).alias("deleted_files"),
        F.count_if(~gone & F.lit(applied)).alias("failed_files"),
        total("size").alias("matched_bytes"),
        total(F.when(gone, F.col("size"))).alias("deleted_bytes"),
    )


def rule_samples(matches: DataFrame, n: int = 50, materialized: bool = False) -> DataFrame:
    """First ``n`` paths per rule and how many more there are.

    Counts are added up and paths cut to ``n`` before either is shuffled. The two need the matches twice, so these are
    checkpointed first unless the caller says that they have been.
    """
    keys = ["host", "rule_id"]
    matches = matches.select(*keys, "path")
    if not materialized:
        use_checkpoint_dir(matches.sparkSession)
        matches = matches.checkpoint()
    heads = first_rows(matches, keys, ["path"], n)
    counts = matches.groupBy(*keys).agg(F.count("*").alias("matched_files"))
    more = F.greatest(F.col("matched_files") - n, F.lit(0).cast("bigint"))
    return heads.join(counts, keys).select(*keys, "path", more.alias("more"))


def directory_counts(files: DataFrame, gone: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """``host, path, left``: files that stay anywhere below each directory, once ``gone`` (host, path) are deleted.

    Files are read once: they and the deleted ones are counted per parent, the latter against the former, and only distinct
    parents are rolled up to the directories above them. A path must be listed once per host. ``dirs`` adds directories
    without files.
    """
    one = lambda rows, n: rows.select("host", tx.dirname(_path_key(F.col("path"))).alias("path"), F.lit(n).alias("n"))
    counted = one(files, 1).unionByName(one(gone, -1))
    if dirs is not None:
        counted = counted.unionByName(dirs.select("host", _path_key(F.col("path")).alias("path"), F.lit(0).alias("n")))
    parents = counted.groupBy("host", "path").agg(F.sum("n").alias("n"))
    above = parents.select("host", F.explode(F.array_append(_ancestors(F.col("path")), F.col("path"))).alias("path"), "n")
    return above.where(F.col("path") != "/").groupBy("host", "path").agg(F.sum("n").alias("left"))


def empty_dirs(counts: DataFrame, rules: DataFrame, as_of: datetime) -> DataFrame:
    """Directories a run leaves empty, strictly below the roots of recursive rules that remove such directories.

    ``counts`` are ``directory_counts``; a directory whose children become empty is empty too.
    """
    roots = _Roots(rule_roots(rules.where(F.col("recursive") & F.col("delete_empty_dirs")), as_of))
    empty = counts.where(F.col("left") == 0).select("host", "path")
    held = roots.above(empty.withColumn("_key", F.col("path")))
    return first_rows(held, ["host", "path"], ["plan_order", "rule_id"]).select("host", "rule_id", "path")


def job_artifacts(files: DataFrame, root: str, job_id: str) -> DataFrame:
    """Entries directly below ``root`` whose name carries the job."""
    name = tx.basename("path")
    return files.where((tx.dirname("path") == root) & F.contains(name, F.lit(f"job_{job_id}")))


def valid_artifacts(files: DataFrame) -> DataFrame:
    alive = F.coalesce("exists", F.lit(False)) & (F.coalesce("size", F.lit(0)) > 0) & ~F.coalesce("is_dir", F.lit(False))
    return files.where(alive)


def pending_artifacts(expected: DataFrame, collected: DataFrame, keys: Sequence[str] = ("host", "path")) -> DataFrame:
    return expected.join(collected.select(*keys).distinct(), list(keys), "left_anti")


def sorted_files(files: DataFrame, name: str = "source_file") -> DataFrame:
    return files.select(name).distinct().orderBy(name)
