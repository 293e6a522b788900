"""Masking queries over the customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import masking as mk
from tidemark.plans.registry import Inputs, plain, query

SEED = "s"

PEOPLE = """SELECT c_custkey, lower(c_mktsegment) || ' ' || substr(md5(c_name), 1, 5) || ' ' || CAST(c_nationkey AS VARCHAR(20)) AS name,
       'u_' || CAST(c_custkey AS VARCHAR(20)) || 'ai@' || lower(c_mktsegment) || '.example' AS email,
       CAST(13*c_custkey+1234567 AS VARCHAR(20)) AS phone, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 98765 + c_custkey * 31 END AS document,
       c_mktsegment AS segment, c_nationkey FROM {customer}"""

# Rows with their rank in the drawn order, as the oracle sees them.
_RANKED = """WITH p AS ({people}), o AS (SELECT *, row_number() OVER (ORDER BY md5('s|' || {key}), {key}) - 1 AS rank FROM p) """


def _ranked(people: str, key: str) -> str:
    return plain(_RANKED.replace("{people}", people).replace("{key}", key))


def _draw(purpose: str, key: str, low: int, high: int) -> str:
    """The number drawn for a row, in the oracle's words."""
    return f"({low} + CAST('0x' || substr(md5('s|{purpose}|' || o.{key}), 1, 7) AS BIGINT) % {high - low + 1})"


def _at(value: str, distance: str) -> str:
    """A value ``distance`` ranks away (negative: before)."""
    return f"(SELECT {value} FROM o n WHERE n.rank = o.rank + ({distance}))"


def _word(column: str, i: int, mark: str = " ") -> str:
    return f"split_part(n.{column}, '{mark}', {i})"


def _name(column: str, key: str, lead: int, second: int, words=((1, 2), (3, 1), (1, 3))) -> str:
    (a1, b1), (a2, b2), (a3, b3) = words
    draw = lambda label: _draw(f"{column}.{label}", key, 1, 6)
    parts = [
        f"coalesce({_at(_word(column, a1), str(lead))}, {_at(_word(column, b1), '-' + draw('1'))})",
        f"coalesce({_at(_word(column, a2), str(second))}, {_at(_word(column, b2), '-3')})",
        f"coalesce({_at(_word(column, a3), draw('2'))}, {_at(_word(column, b3), '-' + draw('3'))})",
    ]
    return "upper(" + " || ' ' || ".join(parts) + ")"


def people(t: Inputs) -> DataFrame:
    return t.sql(PEOPLE)


_PEOPLE = _ranked(PEOPLE, "c_custkey")


@query("scramble_name", _PEOPLE + f"SELECT c_custkey, segment, {_name('name', 'c_custkey', 1, 1)} AS name FROM o")
def scramble_name(t: Inputs) -> DataFrame:
    return mk.scramble(people(t), ["c_custkey"], {"name": mk.name_words()}, SEED).select("c_custkey", "segment", "name")


@query(
    "scramble_name_far",
    _ranked("SELECT p_partkey, p_name, p_brand FROM part", "p_partkey")
    + f"SELECT p_partkey, p_brand, {_name('p_name', 'p_partkey', 3, 2)} AS p_name FROM o",
)
def scramble_name_far(t: Inputs) -> DataFrame:
    parts = t.table("part").select("p_partkey", "p_name", "p_brand")
    return mk.scramble(parts, ["p_partkey"], {"p_name": mk.name_words(lead=3, second_lead=2)}, SEED)


_ADDRESS = ((1, 2), (3, 2), (2, 3))


@query(
    "scramble_address",
    _PEOPLE + f"SELECT c_custkey, {_name('name', 'c_custkey', 1, 1, _ADDRESS)} AS name FROM o",
)
def scramble_address(t: Inputs) -> DataFrame:
    method = mk.name_words(words=_ADDRESS)
    return mk.scramble(people(t), ["c_custkey"], {"name": method}, SEED).select("c_custkey", "name")


def _mail(lead: str, other: str, domain: str, back: str) -> str:
    local = f"coalesce({_at(_word('email', 1, '@'), lead)}, {_at(_word('email', 1, '@'), other)})"
    return f"lower({local} || '@' || coalesce({_at(_word('email', 2, '@'), domain)}, {_at(_word('email', 2, '@'), back)}))"


_E = {n: _draw(f"email.{n}", "c_custkey", *r) for n, r in {"1": (1, 6), "2": (1, 4), "3": (1, 6)}.items()}
_E2 = {n: _draw(f"email.{n}", "c_custkey", *r) for n, r in {"1": (1, 6), "2": (2, 7), "3": (2, 7)}.items()}


@query("scramble_email", _PEOPLE + f"SELECT c_custkey, {_mail('1', '-' + _E['1'], _E['2'], '-' + _E['3'])} AS email FROM o")
def scramble_email(t: Inputs) -> DataFrame:
    return mk.scramble(people(t), ["c_custkey"], {"email": mk.email_parts()}, SEED).select("c_custkey", "email")


@query(
    "scramble_email_letters",
    _PEOPLE
    + f"SELECT c_custkey, replace(replace(replace(replace({_mail('-1', _E2['1'], _E2['2'], '-' + _E2['3'])}, '_', '.'), 'a', 'e'), 'u', 'o'), 'i', 'a') AS email FROM o",
)
def scramble_email_letters(t: Inputs) -> DataFrame:
    method = mk.email_parts(substitute=True)
    return mk.scramble(people(t), ["c_custkey"], {"email": method}, SEED).select("c_custkey", "email")


def _number(column: str, old: str, before: str, after: str) -> str:
    value = f"coalesce({_at('n.' + column, '-' + _draw(column + '.1', 'c_custkey', 2, 7))}, {_at('n.' + column, _draw(column + '.2', 'c_custkey', 1, 6))})"
    return f"translate(CAST({value} AS VARCHAR), '{old}', '{before}' || {_draw(column + '.3', 'c_custkey', 1, 9)} || '{after}')"


@query(
    "scramble_digits",
    _PEOPLE
    + f"""SELECT c_custkey, {_number('phone', '1234567', '941', '423')} AS phone, CAST(nullif(trim({_number('document', '12345', '94', '74')}), '') AS BIGINT) AS document FROM o""",
)
def scramble_digits(t: Inputs) -> DataFrame:
    methods = {"phone": mk.digits("1234567", "941", "423"), "document": mk.digits(as_number=True)}
    done = mk.scramble(people(t), ["c_custkey"], methods, SEED)
    return done.select("c_custkey", "phone", F.col("document").cast("bigint").alias("document"))


@query(
    "swap_value",
    _PEOPLE
    + f"SELECT c_custkey, coalesce({_at('n.segment', '-' + _draw('segment.1', 'c_custkey', 1, 6))}, {_at('n.segment', _draw('segment.2', 'c_custkey', 1, 6))}) AS segment FROM o",
)
def swap_value(t: Inputs) -> DataFrame:
    return mk.scramble(people(t), ["c_custkey"], {"segment": mk.swapped()}, SEED).select("c_custkey", "segment")


SPEC = [
    {"column": "name", "method": "name", "args": {"lead": 3, "second_lead": 2}},
    {"column": "email", "method": "template", "args": {"prefix": "masked_", "suffix": "@example.invalid"}},
    {"column": "phone", "method": "multiple", "args": {"factor": 1000}},
    {"column": "segment", "method": "constant", "args": {"value": "***MASKED***"}},
]


@query(
    "mask_by_spec",
    _PEOPLE
    + f"""SELECT c_custkey, {_name('name', 'c_custkey', 3, 2)} AS name, 'masked_' || c_custkey || '@example.invalid' AS email, c_custkey * 1000 AS phone,
  '***MASKED***' AS segment, c_nationkey FROM o""",
)
def mask_by_spec(t: Inputs) -> DataFrame:
    return mk.mask_by_spec(people(t), ["c_custkey"], SPEC, SEED).drop("document")


@query(
    "mask_template",
    plain(f"SELECT c_custkey, 'CLIENTE_MASCARADO_' || c_custkey AS name, 'masked_' || c_custkey || '@example.invalid' AS email, c_custkey * 100 AS phone FROM ({PEOPLE})"),
)
def mask_template(t: Inputs) -> DataFrame:
    templates = {
        "name": mk.template("c_custkey", "CLIENTE_MASCARADO_"),
        "email": mk.template("c_custkey", "masked_", "@example.invalid"),
        "phone": F.col("c_custkey") * 100,
    }
    return mk.mask_template(people(t), templates).select("c_custkey", "name", "email", "phone")


@query("mask_constant", plain(f"SELECT c_custkey, '***MASKED***' AS phone, email FROM ({PEOPLE})"))
def mask_constant(t: Inputs) -> DataFrame:
    return mk.mask_constant(people(t), "phone", "***MASKED***").select("c_custkey", "phone", "email")


UPDATES = "SELECT c_custkey, 'new ' || c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment || '!' END AS segment FROM {customer} WHERE c_custkey % 3 = 0"


@query(
    "apply_updates",
    plain(
        f"""SELECT p.c_custkey, CASE WHEN u.c_custkey IS NULL THEN p.name ELSE u.name END AS name, CASE WHEN u.c_custkey IS NULL THEN p.segment ELSE u.segment END AS segment, p.phone
FROM ({PEOPLE}) p LEFT JOIN ({UPDATES}) u ON u.c_custkey = p.c_custkey"""
    ),
)
def apply_updates(t: Inputs) -> DataFrame:
    base = people(t).select("c_custkey", "name", "segment", "phone")
    return mk.apply_updates(base, t.sql(UPDATES), ["c_custkey"])


SETTINGS = "SELECT CASE r_regionkey WHEN 2 THEN 'environment_name' ELSE 'other_' || r_name END AS config_key, lower(r_name) AS config_value FROM {region}"


@query(
    "masking_audit",
    plain(
        f"""SELECT (SELECT config_value FROM ({SETTINGS}) WHERE config_key = 'environment_name') AS observed_environment,
  (SELECT count(*) FROM events WHERE event_type = 'signup') AS observed_runtime_sessions, count(*) AS rows_masked FROM customer"""
    ),
)
def masking_audit(t: Inputs) -> DataFrame:
    return mk.masking_audit(people(t), t.table("events").where("event_type = 'signup'"), t.sql(SETTINGS))
