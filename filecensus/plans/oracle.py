"""ANSI SQL counterparts of the registered queries, for checking results on one machine."""

from __future__ import annotations

from filecensus.operators import permissions as P
from filecensus.operators import rules as R
from filecensus.plans import demo

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN_RULE = ("quoted_token", r"token\s*=\s*\"[0-9a-f]{40}\"")


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    def cell(v):
        return str(v) if isinstance(v, (int, float)) else q(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def rx(pattern: str) -> str:
    """RE2 text of a rule: the Unicode classes are written out."""
    pattern = pattern.replace(r"[^@\s]", rf"[^@{SPACE}]")
    pattern = pattern.replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]")
    return q(pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", r"\p{Nd}"))


def hits(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {q(w)}) AS INTEGER)" for w in words) + ")"


def isin(column: str, words) -> str:
    return f"{column} IN ({', '.join(q(w) for w in words)})"


def size_text(size: str) -> str:
    whens = [f"WHEN {size} < 1024 THEN CAST({size} AS VARCHAR) || ' B'"]
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        scaled = f"({size} / {float(1024**power)!r})"
        whens.append(f"WHEN {scaled} < 1024 THEN format('{{:.1f}} {unit}', {scaled})")
    return f"CASE {' '.join(whens)} ELSE format('{{:.1f}} PB', {size} / {float(1024**5)!r}) END"


EXT = r"lower(regexp_extract({0}, '(?s)^\.*[^.].*?(\.[^.]*)\z', 1))"
STEM = r"substr(lower({0}), 1, length({0}) - length(regexp_extract({0}, '(?s)^\.*[^.].*?(\.[^.]*)\z', 1)))"
CHECKPOINT = rf"(?i)^((?:[^/]+/)*?(?:{R.CHECKPOINT_WORDS})[-_](?:{R.CHECKPOINT_ENDINGS}))/"
SKIPPED = r"(^|/)(" + "|".join(n.replace(".", r"\.") for n in R.SKIPPED_FOLDERS) + r")/"

_EXT_ROWS = [
    (
        ext,
        "|".join(cats) if cats else None,
        int(ext in R.AMBIGUOUS),
        "medium" if ext in R.MEDIUM_CONFIDENCE else "high",
        *R.RISKS.get(ext, (None, None)),
    )
    for ext, cats in sorted(R.Rules().extensions.items())
] + [(e, None, 1, "medium", *R.RISKS.get(e, (None, None))) for e in R.AMBIGUOUS]


def ext_table(rows=_EXT_ROWS) -> str:
    return f"ext_rules(re, rcats, ramb, rconf, rlevel, rreason) AS (VALUES {values(rows)})"


_DOC_PATHS = f"""
catalog(slot, kind, name, lead) AS (VALUES {values([(i, *e) for i, e in enumerate(demo.CATALOG)])}),
doc_paths AS (
  SELECT d.doc_id AS file_id, d.source AS machine, c.lead, d.text,
         '{demo.SCAN_PATH}/' || CASE c.kind
           WHEN 'hidden' THEN d.lang || '/.cache/' || d.doc_id
           WHEN 'skipped' THEN d.lang || '/node_modules/' || d.doc_id
           WHEN 'hub' THEN 'hub/' || (d.doc_id // 1000)
           WHEN 'run' THEN 'experiments/run-' || (d.doc_id // 1000) || '/part/' || d.doc_id
           WHEN 'top' THEN d.lang
           ELSE d.lang || '/' || d.doc_id END
         || '/' || CASE WHEN c.kind = 'top' THEN d.doc_id || '-' || c.name ELSE c.name END AS path
  FROM documents d JOIN catalog c ON d.doc_id % {len(demo.CATALOG)} = c.slot)"""


def _attributes(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, substr(sha256(md5(machine) || ':' || machine), 1, 16) AS machine_id,
         '{demo.SCAN_PATH}' AS scan_path,
         strlen(head) * CASE WHEN filename = 'pytorch_model.bin' THEN 1048576 ELSE 1 END AS size_bytes,
         CAST({demo.BASE_TIME} + file_id * 61 AS DOUBLE) + (file_id % 4) * CAST(0.25 AS DOUBLE) AS modified_timestamp,
         {demo.MODES}[file_id % {len(demo.MODES)} + 1] AS mode,
         'user' || (file_id % 5) AS owner, 'ml' AS "group",
         substr(path, {len(demo.SCAN_PATH) + 2}) AS rel
  FROM (SELECT *, regexp_extract(path, '[^/]+$') AS filename FROM {source}))"""


def _rule_case(sibling: str = "sibling") -> str:
    ext, stem, name = "ext", "stem", "filename"
    agent = (
        f"({isin(stem, R.AGENT_STEMS)} OR {isin(name, R.AGENT_EXACT_NAMES)}) AND "
        f"(NOT {isin(stem, R.AGENT_STEMS_NEEDING_EXTENSION)} OR {isin(ext, R.AGENT_EXTENSIONS)})"
    )
    agent_text = f"regexp_matches({name}, {rx(R.AGENT_NAME)}) AND {hits('lower(head)', R.AGENT_KEYWORDS)} >= 2"
    skill_text = f"regexp_matches({name}, {rx(R.SKILL_NAME)}) AND {hits('lower(head)', R.SKILL_KEYWORDS)} >= 2"
    yaml = "ext IN ('.yaml', '.yml')"
    magic = "(starts_with(head, 'GGUF') OR starts_with(head, 'ggml') OR starts_with(head, 'PK'))"
    words = " OR ".join(f"contains(lower(head), {q(w)})" for w in R.VECTOR_DB_WORDS)
    return f"""CASE
    WHEN {name} = 'SKILL.md' THEN 'skill_name'
    WHEN {agent} THEN CASE WHEN ext IN ('.md', '.txt') THEN 'agent_document_name' ELSE 'agent_config_name' END
    WHEN regexp_matches({name}, {rx(R.ENV_NAME)}) OR regexp_matches({name}, {rx(R.SECRET_NAME)}) THEN 'secret_name'
    WHEN rcats IS NOT NULL AND ramb = 0 THEN 'extension'
    WHEN ramb = 1 AND (({yaml}) OR ext = '.json') AND {agent_text} THEN 'agent_config'
    WHEN ramb = 1 AND (({yaml}) OR ext = '.json') AND {skill_text} THEN 'skill_config'
    WHEN ramb = 1 AND {yaml} AND {hits('lower(head)', R.AI_KEYWORDS)} >= 2 THEN 'ai_yaml'
    WHEN ramb = 1 AND ext = '.bin' AND ({magic} OR (size_bytes > {R.LARGE_BINARY_BYTES} AND {sibling})) THEN 'binary_model'
    WHEN ramb = 1 AND ext IN ('.db', '.sqlite', '.sqlite3') AND starts_with(head, 'SQLite format 3')
      THEN CASE WHEN {words} THEN 'vector_database' ELSE 'database' END
    WHEN COALESCE(ramb, 0) = 0 AND ext = '.txt' AND {agent_text} THEN 'agent_text'
  END"""


_CATEGORY_CASE = "CASE rule WHEN 'extension' THEN rcats " + " ".join(
    f"WHEN {q(rule)} THEN {q('|'.join(cats))}"
    for rule, cats in {
        "skill_name": ["skill", "document"],
        "agent_document_name": ["agent", "document"],
        "agent_config_name": ["agent", "config"],
        "secret_name": ["secret"],
        "agent_text": ["agent", "document"],
        "agent_config": ["agent", "config"],
        "skill_config": ["skill", "config"],
        "ai_yaml": ["config"],
        "binary_model": ["model"],
        "vector_database": ["vector"],
        "database": ["data"],
    }.items()
) + " END"
_NAMES = "('skill_name', 'agent_document_name', 'agent_config_name', 'secret_name')"


def overlaps(categories: str, names: list[str]) -> str:
    return f"regexp_matches({categories}, '(^|\\|)({'|'.join(names)})(\\||$)')"


def _classified(source: str, name: str, secrets=R.SECRET_CONTENT) -> str:
    """CTEs that classify ``source`` as ``name`` (rows no rule matches keep a NULL rule)."""
    found = " OR ".join(f"regexp_matches(head, {rx(p)})" for _, p in secrets)
    others = "(mode & 1) <> 0"
    finding = f"""CASE
      WHEN (mode & 2) <> 0 THEN 'world_writable'
      WHEN (mode & 4) <> 0 AND {overlaps('categories', ['secret'])} THEN 'world_readable_secret'
      WHEN (mode & 4) <> 0 AND {overlaps('categories', P.CONFIDENTIAL)} THEN 'world_readable_agent'
      WHEN (mode & 16) <> 0 AND {overlaps('categories', P.SENSITIVE)} THEN 'group_writable'
      WHEN {others} AND NOT {overlaps('categories', ['source'])} AND {overlaps('categories', P.SENSITIVE)} THEN 'too_open'
    END"""
    reasons = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in P.REASONS.items())
    return f"""
{name}_0 AS (SELECT *, {EXT.format('filename')} AS ext, {STEM.format('filename')} AS stem,
    regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM {source}),
{name}_dirs AS (SELECT machine_id, parent FROM {name}_0
  WHERE {isin('filename', R.MODEL_FOLDER_FILES)} GROUP BY ALL),
{name}_1 AS (SELECT s.*, r.*, d.parent IS NOT NULL AS sibling FROM {name}_0 s
  LEFT JOIN ext_rules r ON s.ext = r.re
  LEFT JOIN {name}_dirs d ON s.machine_id = d.machine_id AND s.parent = d.parent),
{name}_2 AS (SELECT *, {_rule_case()} AS rule FROM {name}_1),
{name}_3 AS (SELECT *, {_CATEGORY_CASE} AS categories,
    CASE WHEN rule IN {_NAMES} THEN 'filename' WHEN rule = 'extension' THEN 'extension' WHEN rule IS NOT NULL THEN 'heuristic' END AS detection_method,
    CASE WHEN rule IN {_NAMES} THEN 'high' WHEN rule = 'extension' THEN rconf WHEN rule IS NOT NULL THEN 'medium' END AS confidence,
    CASE WHEN rule = 'secret_name' THEN 'danger' WHEN rule = 'binary_model' THEN 'warning'
         WHEN rule = 'extension' AND rlevel IS NOT NULL THEN rlevel WHEN rule IS NOT NULL THEN 'none' END AS level0,
    CASE WHEN rule = 'secret_name' THEN {q(R.SECRET_FILE_REASON)} WHEN rule = 'binary_model' THEN {q(R.BINARY_REASON)}
         WHEN rule = 'extension' THEN rreason END AS reason0,
    CASE WHEN rule = 'secret_name' AND ext = '' THEN filename ELSE NULLIF(ext, '') END AS extension
  FROM {name}_2),
{name}_4 AS (SELECT *, (rule IS NOT NULL AND level0 <> 'danger'
    AND NOT {overlaps('categories', R.NOT_SCANNED_FOR_SECRETS)} AND ({found})) AS embedded,
    {finding} AS finding,
    split_part(categories, '|', 1) AS category FROM {name}_3),
{name} AS (SELECT *, CASE WHEN embedded THEN 'danger' ELSE level0 END AS risk_level,
    CASE WHEN embedded THEN {q(R.EMBEDDED_SECRET_REASON)} ELSE reason0 END AS risk_reason,
    CASE WHEN starts_with(finding, 'world_readable') THEN 'world_readable' ELSE finding END AS permission_alert,
    CASE finding {reasons} END AS permission_alert_reason
  FROM {name}_4)"""


def _perm_string() -> str:
    parts = ["'-'"]
    for shift in (6, 3, 0):
        for bit, letter in ((4, "r"), (2, "w"), (1, "x")):
            parts.append(f"CASE WHEN (mode & {bit << shift}) <> 0 THEN '{letter}' ELSE '-' END")
    return " || ".join(parts)


PERMISSIONS = _perm_string()

LISTING = (
    _DOC_PATHS
    + ", doc_files AS (SELECT file_id, machine, path, lead || text AS head FROM doc_paths),"
    + _attributes("doc_files", "listing_0")
    + f", listing AS (SELECT *, NULLIF(regexp_extract(rel, {rx(CHECKPOINT)}, 1), '') AS checkpoint FROM listing_0)"
)


def reached(entry: str, hidden: bool = False, depth: int | None = None) -> str:
    test = f"NOT regexp_matches({entry}, {q(SKIPPED)})"
    if not hidden:
        test += f" AND NOT regexp_matches({entry}, '(^|/)\\.')"
    if depth is not None:
        test += f" AND length({entry}) - length(replace({entry}, '/', '')) <= {depth}"
    return test


def inventory(hidden: bool = False, depth: int | None = None, rules: str | None = None) -> str:
    """WITH clause up to ``inv``: classified files and checkpoint folders."""
    return (
        f"WITH {rules or ext_table()}, {LISTING},"
        + f" walked AS (SELECT * FROM listing WHERE {reached('COALESCE(checkpoint, rel)', hidden, depth)}),"
        + _classified("listing", "all_files")
        + f""",
files AS (SELECT * FROM all_files WHERE checkpoint IS NULL AND {reached('rel', hidden, depth)}),
folders AS (SELECT machine_id, scan_path, checkpoint, SUM(size_bytes) AS size_bytes, COUNT(*) AS n_files
  FROM walked WHERE checkpoint IS NOT NULL GROUP BY ALL),
inv AS (
  SELECT machine_id, scan_path, path, filename, CAST(0 AS BIGINT) AS is_dir, size_bytes, extension, categories,
         category, rule, detection_method, confidence, risk_level, risk_reason FROM files WHERE rule IS NOT NULL
  UNION ALL
  SELECT machine_id, scan_path, scan_path || '/' || checkpoint, regexp_extract(checkpoint, '[^/]+$'), 1, size_bytes, NULL,
         'checkpoint', 'checkpoint', 'checkpoint_folder', 'pattern', 'high', 'none', NULL FROM folders)
"""
    )


# Files of three scans per machine.
SCANS = (
    f"WITH {ext_table()}, {_DOC_PATHS},"
    + f"""
lab AS (SELECT doc_id, MAX(toxic) AS toxic, MAX(CASE WHEN quality = 0 THEN 1 END) AS low FROM labels GROUP BY doc_id),
state AS (SELECT p.*, COALESCE(l.toxic, 0) = 1 AS is_toxic, COALESCE(l.low, 0) = 1 AS is_low
  FROM doc_paths p LEFT JOIN lab l ON p.file_id = l.doc_id),
scan_0 AS (
  SELECT file_id, machine, path, 0 AS scan_no, lead || text AS head FROM state
  UNION ALL
  SELECT file_id, machine, path, n, lead || text || CASE WHEN is_low THEN {q(demo.EDIT_MARK)} ELSE '' END
  FROM state, (VALUES (1), (2)) AS t(n) WHERE NOT is_toxic
  UNION ALL
  SELECT page_id, 'src' || (page_id % 20), '{demo.SCAN_PATH}/web/' || page_id || '/index.html', 2, html FROM pages),"""
    + _attributes("scan_0", "scan_1")
    + ","
    + _classified("scan_1", "scan_3")
    + f""",
sf AS (SELECT *, sha256(head) AS hash, {PERMISSIONS} AS permissions, machine_id || '-' || scan_no AS report_id,
    TIMESTAMP '{demo.FIRST_SCAN}' + scan_no * INTERVAL 14 HOUR AS received_at
  FROM scan_3 WHERE rule IS NOT NULL AND {reached('rel')} AND NOT regexp_matches(rel, {rx(CHECKPOINT)})),
rep AS (SELECT report_id, machine_id, machine, scan_path, scan_no, received_at, COUNT(*) AS total_files,
    CAST(SUM(size_bytes) AS BIGINT) AS total_size, 'node-' || machine AS hostname,
    strftime(received_at, '%Y-%m-%dT%H:%M:%S') AS scan_time
  FROM sf GROUP BY ALL),
seq AS (SELECT *, LAG(report_id) OVER (PARTITION BY machine_id, scan_path ORDER BY received_at, report_id) AS previous_report_id,
    LAG(scan_time) OVER (PARTITION BY machine_id, scan_path ORDER BY received_at, report_id) AS previous_time FROM rep),
cur AS (SELECT s.report_id AS pair, f.* FROM seq s JOIN sf f ON s.report_id = f.report_id WHERE s.previous_report_id IS NOT NULL),
prev AS (SELECT s.report_id AS pair, f.* FROM seq s JOIN sf f ON s.previous_report_id = f.report_id),
chg AS (SELECT COALESCE(c.pair, p.pair) AS report_id, COALESCE(c.path, p.path) AS path,
    CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' ELSE 'modified' END AS action,
    COALESCE(c.filename, p.filename) AS filename, CASE WHEN c.path IS NULL THEN p.size_bytes ELSE c.size_bytes END AS size_bytes,
    COALESCE(c.categories, p.categories) AS categories,
    CASE WHEN c.path IS NOT NULL AND p.path IS NOT NULL THEN p.size_bytes END AS previous_size,
    CASE WHEN c.path IS NOT NULL AND p.path IS NOT NULL THEN p.hash END AS previous_hash,
    CASE WHEN c.path IS NOT NULL AND p.path IS NOT NULL THEN c.hash END AS current_hash
  FROM cur c FULL OUTER JOIN prev p ON c.pair = p.pair AND c.path = p.path
  WHERE c.path IS NULL OR p.path IS NULL OR c.hash <> p.hash),
chg_n AS (SELECT report_id, SUM(CASE WHEN action = 'added' THEN 1 ELSE 0 END) AS new,
    SUM(CASE WHEN action = 'modified' THEN 1 ELSE 0 END) AS changed,
    SUM(CASE WHEN action = 'deleted' THEN 1 ELSE 0 END) AS deleted FROM chg GROUP BY report_id),
kinds AS (SELECT report_id, path, permissions, unnest(list_filter([
      CASE WHEN {overlaps('categories', ['secret'])} THEN 'secrets_found' END,
      CASE WHEN risk_level = 'danger' AND contains(lower(risk_reason), 'deserialization') THEN 'deserialization_risk' END,
      CASE WHEN permission_alert IS NOT NULL THEN 'permissions' END,
      CASE WHEN starts_with(risk_reason, 'Possible embedded') THEN 'embedded_secrets' END], lambda k: k IS NOT NULL)) AS alert_type
  FROM sf),
alert_n AS (SELECT report_id, alert_type, COUNT(*) AS n_files FROM kinds GROUP BY ALL),
alr AS (SELECT a.report_id, r.machine_id, r.hostname, strftime(r.received_at, '%Y-%m-%d %H:%M:%S') AS created_at, a.alert_type,
    CASE WHEN a.alert_type IN ('secrets_found', 'embedded_secrets') THEN 'critical' ELSE 'warning' END AS severity,
    a.n_files || CASE a.alert_type
      WHEN 'secrets_found' THEN ' secret/credential file(s) found on '
      WHEN 'deserialization_risk' THEN ' file(s) with deserialization risk on '
      WHEN 'permissions' THEN ' file(s) with overly permissive access on '
      ELSE ' file(s) with embedded secrets on ' END || r.hostname AS message,
    a.n_files, CAST(0 AS BIGINT) AS acknowledged
  FROM alert_n a JOIN rep r ON a.report_id = r.report_id),
lat AS (SELECT * FROM rep QUALIFY ROW_NUMBER() OVER (PARTITION BY machine_id ORDER BY received_at DESC, report_id DESC) = 1),
rep_cat AS (SELECT report_id, category, COUNT(*) AS n_files, SUM(size_bytes) AS total_size
  FROM (SELECT report_id, size_bytes, unnest(string_split(categories, '|')) AS category FROM sf) GROUP BY ALL)
"""
)
