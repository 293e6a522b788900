"""Scalar functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import fixed_values as fv

KIB, MIB, GIB, TIB = 1 << 10, 1 << 20, 1 << 30, 1 << 40
SEPARATORS = r"[\\/]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_array(items: Column | str, lower: bool = False) -> Column:
    """Trim every item, drop the empty ones and keep the first of equal ones."""
    clean = F.transform(col(items), lambda x: F.lower(F.trim(x)) if lower else F.trim(x))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def normalize_list(text: Column | str, lower: bool = True) -> Column:
    """Comma-separated text to a clean array; blanks anywhere in the text are ignored."""
    return normalize_array(F.split(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", ""), ","), lower)


def yes_no(text: Column | str) -> Column:
    return F.lower(F.coalesce(col(text).cast("string"), F.lit(""))).isin(fv.YES_WORDS)


def safe_int(text: Column | str) -> Column:
    """Whole part of a number given as text; anything unreadable is 0. A number beyond 64 bits fails the job.

    The shape is tested first: a failed cast costs an exception per row. Digits are never read through a double.
    """
    value = F.trim(col(text).cast("string"))
    whole = F.regexp_extract(value, r"\A([+-]?[0-9]*)", 1)
    return (
        F.when(F.rlike(value, F.lit(r"\A[+-]?[0-9]{1,18}\z")), value.cast("bigint"))
        .when(F.rlike(value, F.lit(r"\A[+-]?[0-9]+([.][0-9]*)?\z")), whole_number(whole))
        .when(
            F.rlike(value, F.lit(r"\A[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z")),
            F.coalesce(value.try_cast("decimal(38,9)").try_cast("bigint"), value.try_cast("double").try_cast("bigint"), _too_large(value)),
        )
        .otherwise(F.lit(0).cast("bigint"))
    )


def whole_number(digits: Column) -> Column:
    """Digits of any number as a 64-bit integer; the job fails where they don't fit."""
    return F.coalesce(digits.try_cast("decimal(38,0)").try_cast("bigint"), _too_large(digits))


def _too_large(value: Column) -> Column:
    return F.when(value.isNotNull(), F.raise_error(F.concat(F.lit("number beyond 64 bits: "), value)).cast("bigint"))


def human_bytes(size: Column | str) -> Column:
    """Byte count with the largest fitting unit (base 1024) and two decimals.

    Whole-number arithmetic, half to even: exact where a double-based format would depend on the engine.
    """
    value = F.coalesce(col(size).cast("bigint"), F.lit(0).cast("bigint"))
    unit = F.when(value >= TIB, TIB).when(value >= GIB, GIB).when(value >= MIB, MIB).otherwise(KIB)
    name = F.when(value >= TIB, " TB").when(value >= GIB, " GB").when(value >= MIB, " MB").otherwise(" KB")
    rest = value % unit * 100
    cents, left = F.floor(rest / unit), rest % unit
    up = (left * 2 > unit) | ((left * 2 == unit) & (cents % 2 == 1))
    hundredths = F.floor((value - value % unit) / unit) * 100 + cents + up.cast("bigint")
    whole = F.floor(hundredths / 100).cast("string")
    text = F.concat(whole, F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), name)
    return F.when(value < KIB, F.concat(value.cast("string"), F.lit(" B"))).otherwise(text)


def mib(size: Column | str) -> Column:
    return F.bround(col(size) / F.lit(float(MIB)), 2)


def hms(seconds: Column | str) -> Column:
    """Seconds as HH:MM:SS; the hours may need more than two digits."""
    value = col(seconds).cast("bigint")

    def two(part: Column) -> Column:
        return F.when(part < 10, F.concat(F.lit("0"), part.cast("string"))).otherwise(part.cast("string"))

    hours = ((value - value % 3600) / 3600).cast("bigint")
    minutes = ((value % 3600 - value % 60) / 60).cast("bigint")
    return F.concat_ws(":", two(hours), two(minutes), two(value % 60))


def local_time(instant: Column | str, zone: str) -> Column:
    """UTC instant as a wall-clock timestamp of ``zone``, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(instant).cast("timestamp_ntz"))


def local_ts(instant: Column | str, zone: str) -> Column:
    return F.concat(F.date_format(local_time(instant, zone), "dd/MM/yyyy HH:mm:ss"), F.lit(f" {zone}"))


def resolve_month(now: Column | str, explicit: Column | str | None = None, mode: str = "current") -> Column:
    """Month key of a report: the one asked for, else the previous or the current month of ``now``."""
    shifted = F.add_months(col(now).cast("date"), -1 if mode == "previous" else 0)
    default = F.date_format(shifted, "yyyyMM")
    asked = F.lit(None) if explicit is None else F.nullif(F.trim(col(explicit)), F.lit(""))
    return F.coalesce(asked, default)


def resolve_year(now: Column | str, explicit: Column | str | None = None, mode: str = "current") -> Column:
    default = (F.year(col(now)) - (1 if mode == "previous" else 0)).cast("string")
    asked = F.lit(None) if explicit is None else F.nullif(F.trim(col(explicit)), F.lit(""))
    return F.coalesce(asked, F.lpad(default, 4, "0"))


def month_label(month: Column | str) -> Column:
    return F.concat(F.substring(col(month), 5, 2), F.lit("/"), F.substring(col(month), 1, 4))


def check_pattern(value: Column | str, regex: str) -> Column:
    return F.coalesce(F.rlike(col(value), F.lit(regex)), F.lit(False))


def is_identifier(value: Column | str) -> Column:
    return check_pattern(value, r"\A[A-Za-z0-9_.-]+\z")


def is_month_key(value: Column | str) -> Column:
    return check_pattern(value, r"\A[0-9]{6}\z")


def repo_short_name(raw: Column | str) -> Column:
    return F.substring_index(col(raw), "/", -1)


def repo_full_name(namespace: Column | str, raw: Column | str) -> Column:
    return F.when(F.contains(col(raw), F.lit("/")), col(raw)).otherwise(
        F.concat(col(namespace), F.lit("/"), col(raw))
    )


def digest_of(manifest: Column | str, digest: Column | str, image_id: Column | str, skip_empty: bool = False) -> Column:
    """First digest known for a tag; ``skip_empty`` also passes over empty texts."""
    names = [col(manifest), col(digest), col(image_id)]
    if skip_empty:
        names = [F.nullif(n, F.lit("")) for n in names]
    return F.coalesce(*names, F.lit(""))


def filter_patterns(
    value: Column | str, kind: Column | str | None = None, dialect: str = "role", text: Column | str | None = None
) -> Column:
    """Patterns of a mirror filter.

    ``value`` is the pattern array, ``text`` the same filter where it was stored as plain text. The role dialect takes
    such a text as one pattern and lets an empty array match nothing; the script dialect splits the text at commas,
    and falls back to ``*`` for an empty list or for another kind of rule.
    """
    items, every = col(value), F.array(F.lit("*"))
    plain = F.lit(None).cast("string") if text is None else col(text)
    if dialect == "role":
        return F.coalesce(items, F.when(plain.isNotNull(), F.array(plain)), every)
    split = F.filter(F.transform(F.split(plain, ","), lambda x: F.trim(x)), lambda x: x != "")
    known = F.coalesce(items, split, F.array().cast("array<string>"))
    if kind is not None:
        known = F.when(F.coalesce(col(kind), F.lit("")) == "tag_glob_csv", known).otherwise(every)
    return F.when(F.size(known) > 0, known).otherwise(every)


def filter_text(patterns: Column | str) -> Column:
    return F.array_join(col(patterns), ",")


def trim_path(path: Column | str, os: str = "linux", engine: str = "shell") -> Column:
    """Path without trailing separators; a root such as ``/`` or (modules engine) ``C:\\`` keeps its own."""
    value = F.trim(col(path))
    if os == "linux":
        return F.when(F.length(value) > 1, F.regexp_replace(value, r"/+\z", "")).otherwise(value)
    bare = F.regexp_replace(value, SEPARATORS + r"+\z", "")
    return bare if engine == "shell" else F.when(F.length(value) > 3, bare).otherwise(value)


def basename(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^\\/]*)\z", 1)


def dirname(path: Column | str) -> Column:
    """Directory of a path; a file directly below the root has the root as directory."""
    parent = F.regexp_replace(col(path), r"[\\/][^\\/]*\z", "")
    return F.when(parent == "", F.lit("/")).otherwise(parent)


def safe_name(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[^A-Za-z0-9_.-]", "_")


def metric_file_month(name: Column | str, prefix: str = "metric_") -> Column:
    """Month key in a metric file name ``<prefix>YYYYMM_<job>.json``; null for any other name."""
    return F.nullif(F.regexp_extract(col(name), rf"\A\Q{prefix}\E([0-9]{{6}})_\S+\.json\z", 1), F.lit(""))


def url_host(url: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(url), r"\A[a-z]+://", ""), r"/.*\z", "")


def trim_url(url: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(url)), r"/+\z", "")


def decode_record(encoded: Column | str, schema: StructType) -> Column:
    """Record held as base64 of JSON text; null where the text is no such record."""
    return F.from_json(F.decode(F.unbase64(col(encoded)), "UTF-8"), schema)


def encode_record(record: Column | str) -> Column:
    return F.base64(F.encode(F.to_json(col(record)), "UTF-8"))


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def status_label(status: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_lookup(fv.STATUS_LABELS), col(status)), col(status))


def status_text(status: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_lookup(fv.STATUS_TEXTS), col(status)), F.lit(fv.STATUS_TEXT_DEFAULT))


def disk_band(used_pct: Column | str, warn: int = 75, crit: int = 90) -> Column:
    value = F.coalesce(col(used_pct), F.lit(0))
    return F.when(value >= crit, "crit").when(value >= warn, "warn").otherwise("ok")


def percent_digits(text: Column | str) -> Column:
    """Whole number in a text such as ``87%``."""
    return safe_int(F.regexp_replace(F.coalesce(col(text), F.lit("0")), r"[^0-9]", ""))


def audit_text(
    instant: Column | str, host: Column | str, os: Column | str, rule: Column | str, size: Column | str, path: Column | str
) -> Column:
    return F.concat_ws(
        " | ",
        col(instant),
        F.concat(F.lit("host="), col(host)),
        F.concat(F.lit("sistema="), col(os)),
        F.concat(F.lit("regra="), col(rule)),
        F.concat(F.lit("bytes="), col(size).cast("string")),
        F.concat(F.lit("arquivo="), col(path)),
    )


def missing_path_text(rule: Column | str, reason: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit("regra="), col(rule), F.lit(" | motivo="), col(reason), F.lit(" | path="), col(path))


def run_status(failed: Column | str, warned: Column | str) -> Column:
    no = F.lit(False)
    return (
        F.when(F.coalesce(col(failed), no), fv.FAILED)
        .when(F.coalesce(col(warned), no), fv.WARNED)
        .otherwise(fv.SUCCEEDED)
    )


def error_or_warning(code: Column | str, fail_on_error: Column | str | bool) -> Column:
    """What a step's return code means: nothing, a failure, or only a warning where the setting says so."""
    strict = F.lit(fail_on_error) if isinstance(fail_on_error, bool) else col(fail_on_error)
    return F.when(F.coalesce(col(code), F.lit(0)) == 0, "ok").when(strict, "failure").otherwise("warning")
