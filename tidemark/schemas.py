"""Fixed schemas of the landed records. Missing JSON keys arrive as null."""

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


REPOSITORY = _struct(
    namespace=_S, name=_S, repository=_S, state=_S, is_public=_B, description=_S, last_modified=_S, kind=_S, repo_kind=_S
)
REPOSITORY_PAGE = _struct(
    side=_S, namespace=_S, page_index=_L, status=_L, json=_struct(repositories=T.ArrayType(REPOSITORY), next_page=_S)
)

TAG = _struct(name=_S, manifest_digest=_S, digest=_S, image_id=_S, last_modified=_S, start_ts=_S, end_ts=_S)
TAG_PAGE = _struct(
    repository=_S,
    namespace=_S,
    name=_S,
    page_index=_L,
    status=_L,
    msg=_S,
    json=_struct(tags=T.ArrayType(TAG), detail=_S, error_message=_S),
)

ROOT_RULE = _struct(rule_kind=_S, rule_value=T.ArrayType(_S))
MIRROR_RESPONSE = _struct(
    namespace=_S,
    name=_S,
    status=_L,
    json=_struct(
        is_enabled=_B,
        mirror_type=_S,
        external_reference=_S,
        external_registry_username=_S,
        sync_interval=_L,
        sync_start_date=_S,
        sync_expiration_date=_S,
        sync_status=_S,
        sync_retries_remaining=_L,
        robot_username=_S,
        root_rule=ROOT_RULE,
        skopeo_timeout_interval=_L,
        architecture_filter=T.ArrayType(_S),
        detail=_S,
        error_message=_S,
    ),
)

REASON = _struct(path=_S, reason=_S)

PURGE_RULE = _struct(
    application=_S,
    environment=_S,
    os=_S,
    name=_S,
    description=_S,
    hosts=T.ArrayType(_S),
    exclude_hosts=T.ArrayType(_S),
    paths=T.ArrayType(_S),
    patterns=T.ArrayType(_S),
    exclude_patterns=T.ArrayType(_S),
    allowed_prefixes=T.ArrayType(_S),
    age_days=_S,
    recursive=_B,
    delete_empty_dirs=_B,
    enabled=_B,
    engine=_S,
    position=_L,
)

METRIC_HOST = _struct(
    host=_S,
    os=_S,
    envs=T.ArrayType(_S),
    groups=T.ArrayType(_S),
    matched_files=_L,
    matched_bytes=_L,
    deleted_files=_L,
    deleted_bytes=_L,
    failed_files=_L,
)
METRIC_RULE = _struct(
    host=_S,
    os=_S,
    rule=_S,
    description=_S,
    group=_S,
    environment=_S,
    source=_S,
    deleted_files=_L,
    deleted_bytes=_L,
    failed_files=_L,
)
SAVINGS_METRIC = _struct(
    schema_version=_L,
    source=_S,
    job_id=_S,
    job_template=_S,
    workflow_job_id=_S,
    generated_at=_S,
    month=_S,
    timezone=_S,
    mode=_S,
    status=_S,
    reason=_S,
    envs=T.ArrayType(_S),
    groups=T.ArrayType(_S),
    total_deleted_files=_L,
    total_deleted_bytes=_L,
    total_failed_files=_L,
    total_failed_rules=_L,
    hosts=T.ArrayType(METRIC_HOST),
    rules=T.ArrayType(METRIC_RULE),
)
PERIOD_TOTALS = _struct(total_deleted_files=_L, total_deleted_bytes=_L, total_failed_files=_L, execution_count=_L)
CONSOLIDATED = _struct(
    schema_version=_L,
    period_type=_S,
    month=_S,
    year=_S,
    generated_at=_S,
    timezone=_S,
    source_files=T.ArrayType(_S),
    totals=PERIOD_TOTALS,
    executions=T.ArrayType(SAVINGS_METRIC),
)
