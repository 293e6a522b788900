"""Texts, codes and limits that results must carry exactly."""

# --- Fixed values: comparison statuses -> (severity, message) ---
TAG_STATUSES = {
    "OUT_OF_FILTER_PRESENT_ON_TARGET": ("info", "Tag não casa com filtro do mirror, mas existe no DR."),
    "SKIPPED_BY_FILTER": ("info", "Tag não casa com filtro do mirror; ausência no DR é esperada."),
    "MISSING_TAG": ("critical", "Tag deveria estar no DR, mas não foi encontrada."),
    "DIGEST_UNAVAILABLE": ("warning", "Tag existe nos dois lados, mas não foi possível comparar digest."),
    "DIGEST_MISMATCH": ("critical", "Tag existe nos dois lados, mas aponta para digest diferente."),
    "OK": ("ok", "Tag sincronizada com digest igual."),
    "EXTRA_TAG_ON_TARGET": ("warning", "Tag existe no DR, mas não foi encontrada no PRD."),
}
MIRROR_CONFIG_ERROR_MESSAGE = "Falha ao consultar configuração de mirror no DR. HTTP "
MIRROR_DISABLED_MESSAGE = "Repository mirror está desabilitado no DR."
SOURCE_EMPTY_MESSAGE = "Nenhuma tag foi retornada no PRD para este repository."
TAG_ERROR_MESSAGES = {"source": "Falha ao coletar tags no PRD", "target": "Falha ao coletar tags no DR"}

CANDIDATE_STATUSES = ["MISSING_TAG", "DIGEST_MISMATCH", "DIGEST_UNAVAILABLE"]
NOISE_STATUSES = ["SOURCE_REPOSITORY_EMPTY_OR_INACCESSIBLE", "TAG_COLLECTION_ERROR"]

# --- Fixed values: status labels and explanations shown in reports ---
STATUS_LABELS = {
    "OK": "Sincronizado",
    "SKIPPED_BY_FILTER": "Ignorado pelo filtro",
    "OUT_OF_FILTER_PRESENT_ON_TARGET": "Fora do filtro no DR",
    "MISSING_TAG": "Tag ausente no DR",
    "DIGEST_MISMATCH": "Diferença de digest",
    "DIGEST_UNAVAILABLE": "Digest indisponível",
    "EXTRA_TAG_ON_TARGET": "Tag extra no DR",
    "MIRROR_DISABLED": "Mirror desabilitado",
    "MIRROR_CONFIG_ERROR": "Erro na configuração do mirror",
    "TAG_COLLECTION_ERROR": "Erro ao coletar tags",
    "SOURCE_REPOSITORY_EMPTY_OR_INACCESSIBLE": "Origem vazia ou inacessível",
}
STATUS_TEXTS = {
    "OK": "Tag sincronizada com digest igual.",
    "SKIPPED_BY_FILTER": "Tag fora do filtro configurado no mirror; ausência no DR é esperada.",
    "OUT_OF_FILTER_PRESENT_ON_TARGET": "Tag não deveria sincronizar pelo filtro, mas existe no DR.",
    "MISSING_TAG": "Tag existe no PRD, deveria sincronizar, mas não foi encontrada no DR.",
    "DIGEST_MISMATCH": "Tag existe nos dois lados, mas aponta para digest diferente.",
    "DIGEST_UNAVAILABLE": "Tag existe nos dois lados, mas não foi possível comparar digest.",
    "EXTRA_TAG_ON_TARGET": "Tag existe no DR, mas não foi encontrada no PRD.",
    "MIRROR_DISABLED": "Repository mirror está desabilitado no DR.",
    "MIRROR_CONFIG_ERROR": "Não foi possível consultar a configuração de mirror do repository.",
    "TAG_COLLECTION_ERROR": "Falha ao coletar tags no PRD ou DR.",
    "SOURCE_REPOSITORY_EMPTY_OR_INACCESSIBLE": "Nenhuma tag foi retornada no PRD para este repository.",
}
STATUS_TEXT_DEFAULT = "Verificar detalhes na tabela de comparação."

# --- Fixed values: HTTP codes and states of the sync calls ---
ACTION_OK_CODES = {"sync-cancel": [200, 201, 202, 204, 400, 404], "sync-now": [200, 201, 202, 204]}
WAIT_DONE = ["SUCCESS", "NEVER_RUN"]
WAIT_FAILED = ["FAIL", "FAILED", "ERROR"]
ROBOT_NOT_FOUND_TEXT = "could not find robot with specified username"

# --- Fixed values: words read as "yes" ---
YES_WORDS = ["sim", "s", "yes", "true", "1"]

# --- Fixed values: path guard limits and reasons ---
MIN_PATH_LENGTH = {"linux": 4, "windows": 6}
FORBIDDEN_LINUX = [
    "/", "/bin", "/boot", "/dev", "/etc", "/home", "/lib", "/lib64", "/opt", "/proc", "/root", "/run", "/sbin", "/sys",
    "/usr", "/var",
]
FORBIDDEN_WINDOWS = [
    "C:\\", "D:\\", "E:\\", "C:\\Windows", "C:\\Program Files", "C:\\Program Files (x86)", "C:\\Users",
]
PATH_EMPTY = "Path vazio."
PATH_TOO_SHORT = "Path menor que o tamanho mínimo permitido."
PATH_FORBIDDEN = "Path proibido por forbidden_paths."
PATH_PREFIX_REQUIRED = "allowed_prefixes obrigatório, mas não definido para a aplicação/regra."
PATH_OUTSIDE = "Path fora dos allowed_prefixes permitidos."
PATH_NOT_FOUND = "path não encontrado"
PATH_NOT_DIRECTORY = "path não é diretório"
PATH_DENIED = "acesso negado durante a validação"
DENIED_WORDS = ["permission denied", "operation not permitted", "access denied", "acesso negado"]

# --- Fixed values: rule errors and rule status details ---
RULE_NO_PATHS = "Regra sem paths definidos."
RULE_NO_PATTERNS = "Regra sem patterns definidos."
RULE_BAD_AGE = "age_days precisa ser maior que zero."
UNKNOWN_ENGINE_DETAIL = "Engine não suportada. Use engine=modules ou engine=shell."
DETAIL_ALL_BLOCKED = "todos os paths da regra foram bloqueados por segurança"
DETAIL_PATH_ERROR = "falha ao validar um ou mais paths"
DETAIL_FAILED = {
    "linux": "uma ou mais operações shell falharam",
    "windows": "uma ou mais operações PowerShell falharam",
}
DETAIL_NOTHING_DELETED = (
    "candidatos encontrados em modo apply, mas nenhum arquivo foi removido; "
    "validar se a task de delete foi executada"
)
DETAIL_SOME_BLOCKED = "um ou mais paths foram bloqueados por segurança"
RULE_INTERRUPTED = "Execução interrompida"
RULE_INTERRUPTED_DETAIL = "Host inacessível ou execução interrompida"

RULE_FAILED = "Falha inesperada na execução"
RULE_FAILED_DESCRIPTION = "A execução do host foi interrompida por uma falha técnica não tratada pela regra."
FAILURE_DETAILS_SHOWN, FAILURE_DETAIL_LENGTH = 10, 1500

# --- Fixed values: run statuses ---
FAILED, WARNED, SUCCEEDED, NOT_RUN = "FALHA", "SUCESSO COM AVISO", "SUCESSO", "NÃO EXECUTADO"

# --- Fixed values: failure categories, in order of precedence; each alternative is a list of texts that must all occur ---
UNCLASSIFIED = "Erro não classificado automaticamente"
HOST_FAILURES = [
    ("Permissão insuficiente", [["permission denied"], ["access is denied"], ["acesso negado"], ["unauthorized"]]),
    ("Timeout", [["timed out"], ["timeout"]]),
    (
        "Falha de conectividade",
        [["unreachable"], ["connection"], ["winrm"], ["ssh"], ["no route to host"], ["could not resolve"]],
    ),
    ("Falha na transferência de arquivo", [["failed to transfer file"], ["fetch"], ["filetransfer"]]),
    ("Falha de template ou variável", [["undefined variable"], ["is undefined"], ["template"], ["jinja"]]),
]
RUN_FAILURES = [
    (
        "Falha de template/Jinja ou variável indefinida",
        [
            ["unexpected templating"], ["template"], ["jinja"], ["undefined variable"], ["is undefined"],
            ["has no attribute"], ["dict object"],
        ],
    ),
    (
        "Falha ao processar JSON/métrica",
        [
            ["from_json"], ["to_nice_json"], ["json object must be str"], ["expecting value"],
            ["no json object could be decoded"],
        ],
    ),
    ("Falha na métrica mensal de economia", [["savings_metric"], ["métrica mensal"], ["metric"]]),
    (
        "Falha no CIFS/anexos",
        [
            ["smbclient"], ["cifs"], ["nt_status"], ["failed to connect"], ["tree connect failed"], ["mount error"],
            ["não foi possível publicar"],
        ],
    ),
    ("Falha ao publicar artefatos para e-mail", [["send_mail"], ["set_stats"], ["mail_attachments"]]),
    (
        "Permissão insuficiente",
        [
            ["permission denied"], ["access is denied"], ["acesso negado"], ["unauthorized"], ["forbidden"],
            ["errno 13"],
        ],
    ),
    ("Timeout", [["timed out"], ["timeout"], ["operation timeout"], ["read timed out"]]),
    (
        "Falha de conectividade",
        [
            ["unreachable"], ["connection"], ["no route to host"], ["name or service not known"],
            ["could not resolve"], ["winrm"], ["ssh"],
        ],
    ),
    (
        "Path bloqueado por segurança",
        [["path proibido"], ["allowed_prefix"], ["fora dos allowed_prefixes"], ["forbidden_paths"]],
    ),
    (
        "Grupo de expurgo inexistente",
        [["aplicação/perfil de expurgo inexistente"], ["aplicação", "inexistente"], ["grupo", "inexistente"]],
    ),
    ("Ambiente inexistente na matriz", [["ambiente inexistente"], ["environment", "not found"]]),
    ("Nenhum host resolvido", [["nenhum host"], ["no hosts"], ["empty host list"]]),
    (
        "Arquivo de matriz/configuração não encontrado",
        [["matriz não encontrado"], ["arquivo de matriz"], ["purge_matrix"], ["purge_matrix_file"]],
    ),
    ("Falha ao montar relatório", [["report_success"], ["report_failure"], ["relatório consolidado"]]),
]
REGISTRY_FAILURES = [
    ("Timeout aguardando conclusão do mirror/sync", [["sync_wait_timeout"]]),
    ("Mirror/sync finalizou com falha no registry", [["sync_terminal_failure"]]),
    ("Falha HTTP ao consultar status do mirror/sync", [["sync_http_error"]]),
    (
        "Limite de paginação de repositories atingido",
        [["repository_max_pages"], ["listagem pode estar incompleta"], ["next_page", "limite"]],
    ),
    (
        "Limite de requisições da API do registry",
        [['"status": 429'], ["'status': 429"], ["status=429"], ["too many requests"], ["rate limit"]],
    ),
    (
        "Token inválido ou expirado",
        [
            ['"status": 401'], ["'status': 401"], ["status=401"], ["invalid_token"], ["expired_token"],
            ["session required"],
        ],
    ),
    (
        "Permissão insuficiente no registry",
        [
            ['"status": 403'], ["'status': 403"], ["status=403"], ["insufficient_scope"], ["forbidden"],
            ["unauthorized"],
        ],
    ),
    (
        "Recurso não encontrado no registry",
        [['"status": 404'], ["'status': 404"], ["status=404"], ["not found"]],
    ),
    (
        "Namespace ausente ou inválido na consulta",
        [["namespace, starred or public"], ["namespace", "required"]],
    ),
    (
        "Nenhum repository mirror encontrado",
        [["nenhum repositório mirror"], ["nenhum repository mirror"], ["nenhum repository com state mirror"]],
    ),
    (
        "Falha de conectividade com o registry",
        [
            ["connection refused"], ["no route to host"], ["name or service not known"],
            ["temporary failure in name resolution"],
        ],
    ),
    ("Timeout de conexão com o registry", [["timed out"], ["timeout"]]),
    ("Falha de certificado/TLS", [["certificate"], ["tls"], ["ssl"], ["x509"]]),
    ("Falha no upload CIFS de anexos", [["smbclient"], ["cifs"], ["failed to connect", "share"]]),
    ("Falha em operação de mirror/sync", [["sync-now"], ["sync-cancel"], ["/mirror"]]),
    ("Variável obrigatória ausente ou inválida", [["variáveis obrigatórias"], ["assertion"], ["mandatory"]]),
]
# The registry's first category also holds when the task and the text together say so.
REGISTRY_WAIT_TASK = ("aguardar repositories retornarem para success", "syncing")
WARN_CATEGORIES = ["Timeout", "Falha de conectividade", "Falha no CIFS/anexos", UNCLASSIFIED]
FAILURE_DETAIL_DEFAULTS = {"item": "Erro não detalhado", "main": "Erro técnico não mapeado"}
ITEM_LABEL_DEFAULT = "item não identificado"

# --- Fixed values: system schemas never shown in grants; default-privilege object words ---
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
DEFAULT_ACL_WORDS = {"r": "TABLES", "S": "SEQUENCES", "f": "FUNCTIONS", "T": "TYPES", "n": "SCHEMAS"}
DATABASE_PRIVILEGES = ["CONNECT", "CREATE", "TEMP"]

# --- Fixed values: privileges an owner (and PUBLIC) has where an object carries no list of its own ---
OWNER_PRIVILEGES = {
    "schema": ["USAGE", "CREATE"],
    "table": ["INSERT", "SELECT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER"],
    "sequence": ["SELECT", "UPDATE", "USAGE"],
    "function": ["EXECUTE"],
}
PUBLIC_PRIVILEGES = {"function": ["EXECUTE"]}
