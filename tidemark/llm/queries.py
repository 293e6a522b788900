"""The registered queries of this subpackage, each over its whole tables, and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat_format, embedding_dedup, importance_resampling, license_scan, mixing, ngram_join, packing, prefix_trie,
    quality_classifier, quality_rules, suffix_dedup, url_filter, warc,
)
from tidemark.llm.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query(
    "op8_warc_revisits",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    h AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM h)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
    FROM g
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.read_headers(spark, archives)


@query("op6_quality_classifier")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_classifier.with_scores(docs, quality_classifier.fit(docs, table(spark, folder, "labels")))


@query("op10_ngram_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, folder, "documents"), width=4, percent=85)


@query(
    "op5_chat_formatting",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    signed AS (SELECT *, regexp_matches(role || ' ' || text, '<s>|</s>|<<SYS>>|<</SYS>>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]') AS bare,
               regexp_matches(role || ' ' || text, '(<|\[)\\/?(SYS>>|s>|INST\]|ROLE\]|TEXT\])') AS broken FROM turns),
    levels AS (SELECT conv_id, bool_or(bare) AS bare, bool_or(broken) AS broken FROM signed GROUP BY conv_id),
    sized AS (
        SELECT t.conv_id, t.turn, t.role, t.text,
               CASE t.role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(t.role) END + length(t.text)
               + CASE WHEN bare AND NOT broken
                      THEN len(regexp_extract_all(CASE WHEN t.role IN ('system', 'user', 'assistant') THEN t.text ELSE t.role || ' ' || t.text END,
                                                  '(<<|<|\[)/?(SYS>>|s>|INST\]|ROLE\]|TEXT\])'))
                      WHEN bare
                      THEN len(regexp_extract_all(CASE WHEN t.role IN ('system', 'user', 'assistant') THEN t.text ELSE t.role || ' ' || t.text END, '[<\[\\]'))
                      ELSE 0 END AS size
        FROM turns t JOIN levels l ON t.conv_id IS NOT DISTINCT FROM l.conv_id)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(size)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose turns say what the template's marks say."""
    conflict = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(conflict)
    return chat_format.digest(chat_format.format_conversations(rows))


TARGETS = mixing.Targets(
    weights={"domain": {"web": 5, "code": 2, "books": 3}, "lang": {"en": 6, "fr": 2}, "source": {"src0": 2}}, percent=100, epochs=4
)


def _shares(level: str, parents: str, nodes: str, weight: str) -> str:
    """SQL for one level of the tree: budgets of ``nodes`` (parents, name, cap, given)."""
    return f"""
    {level}_w AS (SELECT *, {weight} AS w FROM {nodes}),
    {level}_o AS (
        SELECT *, coalesce(sum(cap) OVER p, 0)::HUGEINT AS before, (sum(w) OVER q)::HUGEINT AS from_here FROM {level}_w
        WINDOW p AS (PARTITION BY {parents} ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               q AS (PARTITION BY {parents} ORDER BY cap / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    {level}_f AS (SELECT *, cap::HUGEINT * from_here <= w::HUGEINT * (given - before) AS filled FROM {level}_o),
    {level}_r AS (
        SELECT *, given - coalesce(sum(CASE WHEN filled THEN cap END) OVER (PARTITION BY {parents}), 0)::HUGEINT AS rest,
               (sum(CASE WHEN NOT filled THEN w END) OVER (PARTITION BY {parents}))::HUGEINT AS opened FROM {level}_f),
    {level}_p AS (SELECT *, CASE WHEN NOT filled THEN (w * rest) // opened END AS part FROM {level}_r),
    {level} AS (
        SELECT *, CASE WHEN filled THEN cap ELSE part + CASE
            WHEN row_number() OVER (PARTITION BY {parents}, filled ORDER BY name)
                 <= rest - coalesce(sum(part) OVER (PARTITION BY {parents}), 0) THEN 1 ELSE 0 END END AS budget FROM {level}_p)"""


@query(
    "op3_mixing",
    f"""
    WITH numbered AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT) % 3 AS number,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
    measured AS (
        SELECT doc_id, CASE number WHEN 1 THEN 'code' WHEN 2 THEN 'books' ELSE 'web' END AS domain, lang, source, n_tokens
        FROM numbered),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, 4 * sum(n_tokens)::BIGINT AS cap
               FROM measured GROUP BY ALL),
    d0 AS (SELECT 0 AS root, domain AS name, sum(cap)::BIGINT AS cap, (SELECT sum(supply) FROM leaves)::BIGINT AS given
           FROM leaves GROUP BY domain),
    {_shares("d1", "root", "d0", "CASE name WHEN 'web' THEN 5 WHEN 'code' THEN 2 WHEN 'books' THEN 3 ELSE 1 END").strip()},
    l0 AS (SELECT domain, lang AS name, sum(leaves.cap)::BIGINT AS cap, any_value(budget) AS given
           FROM leaves JOIN d1 ON domain = d1.name GROUP BY domain, lang),
    {_shares("l1", "domain", "l0", "CASE name WHEN 'en' THEN 6 WHEN 'fr' THEN 2 ELSE 1 END").strip()},
    s0 AS (SELECT leaves.domain, lang, source AS name, leaves.supply, leaves.cap, budget AS given
           FROM leaves JOIN l1 ON leaves.domain = l1.domain AND lang = l1.name),
    {_shares("s1", "domain, lang", "s0", "CASE name WHEN 'src0' THEN 2 ELSE 1 END").strip()},
    plan AS (SELECT domain, lang, name AS source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole,
                    CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS part FROM s1),
    ordered AS (
        SELECT measured.*, whole, part, md5('1|' || whole || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
        FROM measured JOIN plan USING (domain, lang, source)),
    running AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM ordered)
    SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN upto <= part THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM running
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.choose(table(spark, folder, "documents"), TARGETS)


@query(
    "op7_url_filter",
    r"""
    WITH sites AS (
        SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919) % 525600) AS fetched,
               regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
               list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
        FROM pages),
    keyed AS (
        SELECT page_id, url, fetched,
               CASE WHEN host <> '' THEN list_concat(
                   list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
                   list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[:i], '/'))) END AS patterns
        FROM sites),
    patterns AS (SELECT DISTINCT unnest(patterns) AS pattern FROM keyed),
    drawn AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS a, ('0x' || substr(md5(pattern), 7, 6))::BIGINT AS b
              FROM patterns),
    listed AS (SELECT pattern, CASE WHEN a % 5 = 0 THEN 'allow' ELSE 'block' END AS verdict,
                      TIMESTAMP '2023-11-01' + to_days((b % 300)::INTEGER) AS first, a, b FROM drawn WHERE a % 3 = 0),
    valid AS (
        SELECT pattern, verdict, first AS since, CASE WHEN b % 4 <> 0 THEN first + to_days((10 + a % 90)::INTEGER) END AS until FROM listed
        UNION ALL
        SELECT pattern, verdict, first + to_days((130 + a % 70)::INTEGER), NULL FROM listed WHERE b % 4 <> 0 AND b % 3 = 0),
    asked AS (SELECT page_id, url, fetched, unnest(patterns) AS pattern FROM keyed),
    met AS (
        SELECT page_id, url, fetched, a.pattern, verdict, since,
               row_number() OVER (PARTITION BY page_id, url, fetched
                                  ORDER BY length(a.pattern) DESC, verdict = 'allow' DESC, a.pattern DESC, since DESC) AS place
        FROM asked a JOIN valid v ON a.pattern = v.pattern AND fetched >= since AND (until IS NULL OR fetched < until))
    SELECT s.page_id, s.url, s.fetched, coalesce(verdict = 'block', false) AS blocked, pattern AS entry, since
    FROM (SELECT DISTINCT page_id, url, fetched FROM sites) s
    LEFT JOIN met m ON s.page_id IS NOT DISTINCT FROM m.page_id AND s.url IS NOT DISTINCT FROM m.url AND s.fetched = m.fetched AND place = 1
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Captures are the pages at times drawn from their ids; the list is drawn from the patterns that occur in them."""
    captures = table(spark, folder, "pages").select(
        "page_id", "url", F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, CAST((page_id * 7919) % 525600 AS INT))").alias("fetched")
    )
    patterns = captures.select(F.explode(url_filter.patterns_of("url")).alias("pattern")).distinct()
    drawn = patterns.selectExpr(
        "pattern", "CAST(conv(substr(md5(pattern), 1, 6), 16, 10) AS BIGINT) AS a", "CAST(conv(substr(md5(pattern), 7, 6), 16, 10) AS BIGINT) AS b"
    ).where("a % 3 = 0")
    first = "TIMESTAMP_NTZ '2023-11-01' + make_dt_interval(CAST(b % 300 AS INT))"
    changes = drawn.selectExpr(
        "pattern", "CASE WHEN a % 5 = 0 THEN 'allow' ELSE 'block' END AS verdict",
        f"""explode(filter(array(
            named_struct('change', 'add', 'at', {first}),
            IF(b % 4 <> 0, named_struct('change', 'remove', 'at', {first} + make_dt_interval(CAST(10 + a % 90 AS INT))), NULL),
            IF(b % 4 <> 0 AND b % 3 = 0, named_struct('change', 'add', 'at', {first} + make_dt_interval(CAST(130 + a % 70 AS INT))), NULL)
        ), x -> x IS NOT NULL)) AS c""",
    ).select("pattern", "verdict", "c.change", "c.at")
    return url_filter.judge(captures, changes)


@query("op1_license_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, folder, "documents")))


@query("op9_embedding_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, folder, "embeddings"))


@query("op11_importance_resampling")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.drop("n_words")


@query("op12_suffix_dedup")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, folder, "documents"))


@query(
    "op13_prefix_trie",
    """
    WITH bits AS (
        SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
        FROM range(256) r(i)),
    ordered AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS rank
        FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS digits
            FROM ordered GROUP BY conv_id),
    convs AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base,
               xor(list_reduce(digits, lambda c, d: xor(c // 256, t[xor(c % 256, d) + 1]), 4294967295::BIGINT), 4294967295) % 6 AS h
        FROM ids, bits),
    rebuilt AS (
        SELECT c.conv_id, 0 AS side, rank, role, text FROM convs c JOIN ordered o ON o.conv_id = c.base AND rank <= h
        UNION ALL SELECT c.conv_id, 1, rank, role, text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND rank > h),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY side, rank) AS depth FROM rebuilt),
    paths AS (
        SELECT conv_id, depth, length(text) AS chars, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (
            PARTITION BY conv_id ORDER BY depth)) AS key FROM placed
        UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    linked AS (SELECT *, lag(key) OVER c AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM paths
               WINDOW c AS (PARTITION BY conv_id ORDER BY depth)),
    nodes AS (
        SELECT depth, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
        FROM linked GROUP BY depth, key),
    children AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
    full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, key)),
    sums AS (
        SELECT p.depth, p.key, sum((u.n_convs - 1) * u.chars) AS saved_tokens, count(*) FILTER (u.n_children = 0) AS n_leaves
        FROM full_nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY ALL)
    SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
           s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM full_nodes n JOIN sums s USING (depth, key) LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.key = n.parent
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, folder, "conversations"))
