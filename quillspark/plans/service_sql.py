"""DuckDB SQL of the service queries, with their tables written out."""

from __future__ import annotations

from quillspark.corpus import corpus_cte
from quillspark.plans.oracle import BASE, CORR, DATED, FILES, FULL, GRADE, RESULTS, LOG, SCORES, any_of, find, lit, on_corpus

DATE_FIND = [(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", 0), (r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", 0), (r"\b\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\b", 1), (r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b", 1)]
MONEY_FIND = [(r"\$\d+(?:\.\d{2})?", 0), (r"USD\s*\d+(?:\.\d{2})?", 0), (r"€\d+(?:\.\d{2})?", 0), (r"£\d+(?:\.\d{2})?", 0), (r"\d+\.\d{2}\s*(?:USD|EUR|GBP|CAD|AUD)", 0)]

SHORT = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
MONTH_NO = "CASE lower(word) " + " ".join(f"WHEN '{m}' THEN {i} WHEN '{m[:3]}' THEN {i}" for i, m in enumerate("january february march april may june july august september october november december".split(), 1)) + " WHEN 'sept' THEN 9 END"


def extractor() -> str:
    forms = [r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", rf"\b{SHORT}\w*\s+\d{{1,2}},?\s+\d{{4}}\b", rf"\b\d{{1,2}}\s+{SHORT}\w*\s+\d{{4}}\b"]
    hits = " UNION ALL ".join(f"SELECT doc_id, {k} AS form, unnest(regexp_extract_all(t, {lit(p)}, 0, 'i')) AS raw, generate_subscripts(regexp_extract_all(t, {lit(p)}, 0, 'i'), 1) AS place FROM b" for k, p in enumerate(forms))
    amounts = r"list_filter(list_transform(flatten([regexp_extract_all(t, '\$[\d,]+\.?\d*', 0, 'i'), regexp_extract_all(t, '[\d,]+\.\d{2}\s*(?:USD|dollars?)', 0, 'i'), regexp_extract_all(t, 'amount[:\s]+\$?[\d,]+\.?\d*', 0, 'i')]), lambda a: TRY_CAST(regexp_replace(a, '[^0-9.]', '', 'g') AS DOUBLE)), lambda v: v IS NOT NULL)"
    fy = [rf"nullif(regexp_extract(t, '{p}', 1, 'i'), '')" for p in (r"fy[\s-]?(\d{2,4})", r"fiscal\s+year\s+(\d{2,4})", r"(\d{4})[\s-]?(?:\d{2,4})\s+fiscal")]
    words = ", ".join(f"CASE WHEN contains(lower(t), '{w}') THEN '{w}' END" for w in ("fiscal year", "fy", "budget year", "financial year", "tax year"))
    return rf"""{corpus_cte()}{BASE}, h AS ({hits}),
 p AS (SELECT *, TRY_CAST(regexp_extract(raw, '^(\d+)', 1) AS INT) AS a, TRY_CAST(regexp_extract(raw, '^\d+[-/](\d+)', 1) AS INT) AS m, TRY_CAST(regexp_extract(raw, '(\d+)$', 1) AS INT) AS y, len(regexp_extract(raw, '(\d+)$', 1)) AS w, regexp_extract(raw, '([A-Za-z]\w*)', 1) AS word,
   TRY_CAST(CASE WHEN regexp_matches(raw, '^\d') THEN regexp_extract(raw, '^(\d{{1,2}})\s', 1) ELSE regexp_extract(raw, '\s(\d{{1,2}}),?\s+\d{{4}}$', 1) END AS INT) AS nd FROM h),
 q AS (SELECT doc_id, form, place, CASE form WHEN 0 THEN CASE WHEN w = 4 THEN y WHEN w = 2 AND y <= 75 THEN 2000 + y WHEN w = 2 THEN 1900 + y END WHEN 1 THEN a ELSE y END AS yy,
   CASE form WHEN 0 THEN CASE WHEN a <= 12 THEN a ELSE m END WHEN 1 THEN CASE WHEN m <= 12 THEN m ELSE y END ELSE {MONTH_NO} END AS mm,
   CASE form WHEN 0 THEN CASE WHEN a <= 12 THEN m ELSE a END WHEN 1 THEN CASE WHEN m <= 12 THEN y ELSE m END ELSE nd END AS dd FROM p),
 d AS (SELECT doc_id, TRY_CAST(lpad(CAST(yy AS VARCHAR), 4, '0') || '-' || lpad(CAST(mm AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') AS DATE) AS dt, form * 1000000 + place AS o FROM q),
 f AS (SELECT doc_id, dt, min(o) AS o FROM d WHERE dt IS NOT NULL GROUP BY ALL),
 g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM f),
 l AS (SELECT doc_id, string_agg(CAST(dt AS VARCHAR), ',' ORDER BY o) AS dates, array_to_string(list_sort(list_distinct(list(year(dt)))), ',') AS detected_years FROM g WHERE r <= 10 GROUP BY doc_id)
 SELECT b.doc_id, coalesce(dates, '') AS dates, coalesce(detected_years, '') AS detected_years,
   array_to_string(list_transform(list_slice(list_reverse_sort({amounts}), 1, 5), lambda v: CAST(trunc(v * 100) AS BIGINT)), '|') AS top_amounts_cents,
   regexp_matches(t, '(?m)^[A-Z][A-Z\s]+$') AS has_headers, regexp_matches(t, '(?m)^\s*\d+\.') AS has_numbered_items, regexp_matches(t, '(?m)^\s*[•\-*]') AS has_bullet_points,
   coalesce({", ".join(fy)}) AS fiscal_year_pattern, array_to_string(list_transform(regexp_extract_all(t, 'q[1-4]\s+\d{{4}}', 0, 'i'), lambda q: upper(q)), ',') AS quarters, concat_ws(',', {words}) AS fiscal_keywords
 FROM b LEFT JOIN l ON b.doc_id = l.doc_id"""


def few(patterns, n: int) -> str:
    return find("t", patterns, "i").replace("1, 10)", f"1, {n})")


def few_joined(patterns, n: int) -> str:
    return few(patterns, n).replace("'|')", "', ')")


MESSAGES = ("[Errno 13] Permission denied: x", "The file is being used by another process", "OneDrive sync pending", "Connection reset", "Unsupported image", "No module named fitz", "Invalid config value", "No documents given", "Clustering gave up", "Cannot create folder", "HTTP 503 Service Unavailable", "rate limit reached", "something else")
SAID = "WITH m AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 17 <> 0 THEN [" + ", ".join(lit(m) for m in MESSAGES) + f"][o_orderkey % {len(MESSAGES)} + 1] END AS message, o_orderkey % 9 + 1 AS attempt FROM orders)"
CLASSES = (
    ("recoverable_permission", 2.0, True, "permission denied|errno 13"),
    ("file_locked", 1.5, True, "file is being used|errno 32|temporarily locked|file locked"),
    ("sync_conflict", 3.0, True, "onedrive|dropbox|sync|cloud|conflicted copy"),
    ("network_issue", 5.0, True, "network|timeout|connection|unreachable"),
    ("unsupported_format", 0.0, False, "unsupported|invalid format|corrupted|not a valid"),
    ("organization_ml_unavailable", 0.0, False, "spacy|sentence|transformers|sklearn|nltk|model|no module named"),
    ("organization_config_error", 1.0, True, "configuration|invalid config|missing config|preferences"),
    ("organization_insufficient_data", 0.0, False, "no documents|empty content|insufficient data|no valid documents"),
    ("organization_classifier_error", 2.0, True, "classification|categorization|clustering|similarity"),
    ("organization_folder_error", 1.0, True, "mkdir|folder|directory|makedirs|cannot create"),
)
RETRY = r"connection|network|timeout|unreachable|dns|socket|ssl|certificate|rate limit|rate_limit|too many requests|429|quota|throttle|500|502|503|504|server error|internal error|service unavailable|bad gateway|temporarily unavailable|try again|service busy|model loading|warming up"


def error_case(message: str, which: int, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce({message}, '')), '{c[3]}') THEN {lit(c[0]) if which == 0 else c[which]}" for c in CLASSES) + f" ELSE {default} END"


ATTEMPTS = "att AS (SELECT DISTINCT ON (content_id) * FROM extracted_content)"
LAYERS = """lay AS (SELECT 'setting_' || c_custkey || CASE WHEN c_custkey % 11 = 0 THEN '_api_key' ELSE '' END AS name, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS cli,
 CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'Yes' END AS env, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS file, CASE WHEN c_custkey % 7 <> 0 THEN 'off' END AS dflt FROM customer),
 r AS (SELECT name, coalesce(nullif(cli, ''), nullif(env, ''), nullif(file, ''), nullif(dflt, '')) AS value, CASE WHEN nullif(cli, '') IS NOT NULL THEN 'cli' WHEN nullif(env, '') IS NOT NULL THEN 'env' WHEN nullif(file, '') IS NOT NULL THEN 'file' WHEN nullif(dflt, '') IS NOT NULL THEN 'default' ELSE 'none' END AS origin FROM lay)"""
K = "p_partkey"
PLANNED = f"""{RESULTS}, best AS (SELECT id, max(struct_pack(confidence, category)) AS r FROM res WHERE category IS NOT NULL AND id IS NOT NULL GROUP BY id), mv AS (SELECT id, r.category AS category, r.confidence AS confidence FROM best),
 pl AS (SELECT 'create_dir' AS type, '' AS source, 'organized/' || category AS target, category, 1.0::DOUBLE AS confidence FROM (SELECT DISTINCT category FROM mv) WHERE category NOT IN (SELECT subject FROM subject_areas)
 UNION ALL SELECT 'move', id, 'organized/' || category || '/' || regexp_extract(id, '[^/]*$', 0), category, confidence FROM mv)"""
CHECKED = f"""{PLANNED}, {FILES}, there AS (SELECT DISTINCT file_path AS source FROM fil WHERE file_size > 0 AND modification_date IS NOT NULL),
 chk AS (SELECT CASE WHEN category = 'other' THEN 'shred' ELSE type END AS type, pl.source, target, there.source IS NOT NULL AS here FROM pl LEFT JOIN there ON pl.source = there.source),
 op AS (SELECT type, source, target, CASE WHEN type NOT IN ('move', 'copy', 'create_dir') THEN 'Invalid operation type: ' || type WHEN type = 'create_dir' AND target = '' THEN 'Target path required for directory creation' WHEN type <> 'create_dir' AND NOT here THEN 'Source path does not exist' WHEN target = '' THEN 'Target path cannot be empty' END AS error FROM chk)"""
FOLDERS = f"""{FILES}, fo AS (SELECT DISTINCT name FROM (SELECT unnest(string_split(file_path, '/')) AS name FROM fil UNION ALL SELECT unnest(categories_created) FROM organization_sessions) WHERE name NOT LIKE '%.%' OR name IN (SELECT unnest(categories_created) FROM organization_sessions)),
 fn AS (SELECT name FROM fo WHERE name IS NOT NULL AND name <> '' AND NOT starts_with(name, '.')),
 fc AS (SELECT count(*) AS folders, count(*) FILTER (regexp_matches(name, '^(19|20)\\d{{2}}$')) AS year_like, count(*) FILTER (regexp_matches(lower(name), 'financial|legal|personal|business|medical|tax|bills|receipts|contracts|statements|documents')) AS category_like,
  count(*) FILTER (regexp_matches(lower(name), 'financial|legal|personal|business|medical|bills|receipts|contracts|statements')) AS sure, count(*) FILTER (regexp_matches(lower(name), '\\d{{4}}[-_]\\d{{1,2}}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec')) AS months,
  count(*) FILTER (regexp_matches(lower(name), 'fy.*july|july.*fy')) AS f1, count(*) FILTER (regexp_matches(lower(name), 'fy.*april|april.*fy')) AS f2, count(*) FILTER (regexp_matches(lower(name), 'fy.*sep|sep.*fy')) AS f3 FROM fn),
 pat AS (SELECT folders, year_like, category_like, CASE WHEN year_like > category_like THEN 'time_first' ELSE 'category_first' END AS structure_type, CASE WHEN months > 0 THEN 'month' ELSE 'year' END AS time_granularity, CASE WHEN f1 > 0 THEN 'fy_july' WHEN f2 > 0 THEN 'fy_april' WHEN f3 > 0 THEN 'fy_september' ELSE 'calendar' END AS fiscal_year_type,
  CASE WHEN folders > 0 THEN round(least(1.0::DOUBLE, (CASE WHEN year_like > category_like THEN year_like ELSE sure END)::DOUBLE / folders), 6) ELSE 0.0 END AS confidence, CASE WHEN year_like > category_like THEN 0 ELSE folders - year_like END AS categories FROM fc),
 pat2 AS (SELECT *, folders > 0 AND confidence >= 0.3 AND categories <= 20 AS reasonable FROM pat)"""
GAPS = ", gp AS (SELECT category, date_diff('day', dt, lead(dt) OVER (PARTITION BY category ORDER BY dt))::DOUBLE AS gap FROM n), gs AS (SELECT category, avg(gap) AS m, stddev_pop(gap) AS sd FROM gp GROUP BY category HAVING count(gap) > 0)"


def errors(*cases: tuple[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {m if '||' in m else lit(m)} END" for c, m in cases) + ")"


def oracle_sql() -> dict[str, str]:
    ok = r"coalesce(regexp_matches(text, '\S'), false)"
    key = r"regexp_extract(t, '(sk-[A-Za-z0-9_-]+|AIza[A-Za-z0-9_-]+|token|[a-z]{8,})', 1)"
    said = "replace(replace(error_message, 'time limit', 'timeout'), 'file is locked', 'file locked')"
    ranked = f"{corpus_cte()}{BASE}{SCORES}, u AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS i, '{c}' AS category, {c} AS score FROM sc" for i, c in enumerate(("contracts", "invoices", "reports", "correspondence", "financial", "legal"))) + "), v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS place FROM u WHERE score > 0)"
    top = "greatest(contracts, invoices, reports, correspondence, financial, legal)"
    typed = r"CASE WHEN template <> 7 THEN regexp_replace('R&D <' || file_name, '[<>:\"|?*\\/]', '_', 'g') END"
    return {
        "T46_T47_T48_T49_L03_L04_W06_X07_extractor": extractor(),
        "T45_L02_entity_groups": on_corpus(f"doc_id, {few(DATE_FIND, 5)} AS dates, {few(MONEY_FIND, 5)} AS money, '' AS organizations, '' AS persons, '' AS locations"),
        "T50_short_summary": on_corpus(f"doc_id, concat_ws(' ', coalesce(file_name, ''), nullif(left(t, 500), ''), CASE WHEN {few(DATE_FIND, 3)} <> '' THEN 'dates: ' || {few_joined(DATE_FIND, 3)} END, CASE WHEN {few(MONEY_FIND, 3)} <> '' THEN 'money: ' || {few_joined(MONEY_FIND, 3)} END) AS summary"),
        "T29_plain_name": f"WITH {FILES}, s AS (SELECT file_id, file_name, regexp_replace(strip_accents(regexp_replace(file_name, 'e', 'é')), '[^a-zA-Z0-9_]', '', 'g') AS s FROM fil) SELECT file_id, CASE WHEN file_name IS NULL OR NOT regexp_matches(file_name, '\\S') THEN 'empty_file_0' WHEN s = '' THEN 'invalid_name_0' ELSE left(s, 160) END AS name FROM s",
        "T31_typed_name": on_corpus(f"doc_id, CASE WHEN {typed} IS NULL THEN 'unnamed_file' WHEN len({typed}) > 255 THEN left({typed}, 255 - len(regexp_extract({typed}, '[^.](\\.[^.]*)$', 1))) || regexp_extract({typed}, '[^.](\\.[^.]*)$', 1) ELSE {typed} END AS name"),
        "T38_provider_filter": on_corpus("doc_id, md5(CASE WHEN contains(lower(t), 'ignore previous') OR contains(lower(t), 'forget all') OR contains(lower(t), 'system:') OR contains(lower(t), 'assistant:') THEN '[Content contains potentially unsafe patterns - using safe fallback]' ELSE t END) AS digest"),
        "T39_T40_keys": f"{corpus_cte()}{BASE}, k AS (SELECT doc_id, {key} AS k FROM b) SELECT doc_id, CASE WHEN starts_with(k, 'sk-ant-') THEN 'claude' WHEN starts_with(k, 'sk-proj-') OR starts_with(k, 'sk-') AND len(k) > 20 THEN 'openai' WHEN starts_with(k, 'AIza') THEN 'gemini' WHEN regexp_matches(k, '^[A-Za-z0-9]{{32}}$') THEN 'deepseek' ELSE 'unknown' END AS family, CASE WHEN len(k) < 10 THEN 'too short' WHEN len(k) > 512 THEN 'too long' WHEN regexp_matches(k, '^(test|fake|dummy|placeholder)|^(sk-)?1{{10,}}|^(sk-)?0{{10,}}|^(password|secret|key|token)', 'i') THEN 'placeholder' ELSE 'ok' END AS verdict, CASE WHEN len(k) >= 14 THEN left(k, 10) || repeat('*', len(k) - 14) || right(k, 4) ELSE left(k, 6) || repeat('*', greatest(len(k) - 6, 0)) END AS shown FROM k",
        "T51_model_names": f"WITH n AS (SELECT p_partkey, CASE WHEN {K} % 4 = 0 THEN 'big-model' WHEN {K} % 4 = 1 THEN 'model' WHEN {K} % 4 = 2 THEN 'known-name' ELSE 'other-model:tag' END || CASE WHEN {K} % 5 = 0 THEN '-latest' WHEN {K} % 5 = 1 THEN '-' || p_size || 'b' WHEN {K} % 5 = 2 THEN '-instruct' ELSE '' END AS n FROM part), s AS (SELECT p_partkey, CASE WHEN n = 'known-name' THEN 'served/known' WHEN contains(n, '-') AND (regexp_matches(regexp_extract(n, '-([^-]*)$', 1), '^\\d') OR regexp_extract(n, '-([^-]*)$', 1) = 'latest') THEN regexp_replace(n, '-([^-]*)$', ':\\1') ELSE n END AS served FROM n) SELECT p_partkey, served, regexp_replace(served, '^([^:]*):', '\\1-') AS internal FROM s",
        "T52_error_classes": f"{SAID} SELECT doc_id, {error_case('message', 0, lit('permanent_error'))} AS error_type, {error_case('message', 1, '0.0')} AS wait_seconds, {error_case('message', 2, 'False')} AS retry FROM m",
        "T53_retries": f"{SAID} SELECT doc_id, regexp_matches(lower(coalesce(message, '')), '{RETRY}') AS retry, least(1.0::DOUBLE * pow(2.0, attempt - 1), 50.0) AS delay FROM m",
        "T09_profiled_files": f"WITH {ATTEMPTS}, {FILES}, x AS (SELECT file_id, max(text) AS content FROM att WHERE regexp_matches(text, '\\S') GROUP BY 1), b AS (SELECT file_id AS doc_id, file_name, file_size, coalesce(content, '') AS content, coalesce(content, '') AS t FROM fil LEFT JOIN x USING (file_id)), f AS (SELECT {FULL} FROM b) SELECT * EXCLUDE (doc_id), doc_id AS file_id FROM f",
        "S05_S06_S07_chosen_reader": f"WITH {ATTEMPTS}, a AS (SELECT file_id, content_id, extraction_method, list_position(['failed', 'poor', 'fair', 'good', 'excellent'], coalesce(quality, 'failed')) AS g, CASE extraction_method WHEN 'pymupdf' THEN 0 WHEN 'pypdf' THEN 1 WHEN 'ocr' THEN 2 ELSE 3 END AS o, coalesce(len(trim(text)), 0) AS chars FROM att WHERE file_id IS NOT NULL), c AS (SELECT * FROM a WHERE g > 1), f AS (SELECT file_id, bool_or(o < 2 AND chars < 100) AND bool_or(o = 2) AS wait FROM c GROUP BY 1), k AS (SELECT c.*, o = 2 OR g >= 4 AND NOT wait AS now FROM c JOIN f USING (file_id)) SELECT file_id, content_id, extraction_method FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY NOT now, CASE WHEN now THEN o ELSE -g END, content_id) AS r FROM k) WHERE r = 1",
        "S01_S02_discovered": "SELECT CASE n_nationkey % 5 WHEN 1 THEN n_nationkey || '.MD' ELSE n_nationkey || '.gif' END AS name, strlen(repeat(n_name || ' is one of many nations. ', n_nationkey)) AS length FROM nation WHERE n_nationkey % 5 IN (1, 2)",
        "S01_S03_S04_extracted": f"WITH n AS (SELECT n_nationkey AS k, repeat(n_name || ' is one of many nations. ', n_nationkey) AS t FROM nation WHERE n_nationkey % 5 < 3 AND n_nationkey > 0) SELECT k || CASE k % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' ELSE '.gif' END AS name, CASE k % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'gif' END AS file_type, CASE WHEN k % 5 = 2 THEN '' ELSE t END AS text, CASE WHEN k % 5 = 2 THEN 'failed' ELSE 'text_file' END AS extraction_method, CASE WHEN k % 5 = 2 THEN 'failed' ELSE {GRADE} END AS quality FROM n",
        "S21_S22_moved": "SELECT CAST(n_nationkey % 7 AS VARCHAR) AS name, count(*) AS copies, sum(n_nationkey)::BIGINT AS contents FROM nation GROUP BY 1",
        "S08_base64": "SELECT doc_id, to_base64(encode(text)) AS image_data FROM documents",
        "S26_old_files": f"WITH {FILES} SELECT file_path AS path FROM fil WHERE file_name LIKE '%.txt' AND modification_date < TIMESTAMP '2020-01-01' - INTERVAL 365 DAY",
        "S16_S19_settings": f"WITH {LAYERS} SELECT *, CASE WHEN value IS NULL THEN true ELSE lower(trim(value)) IN ('true', '1', 'yes', 'on') END AS flag FROM r",
        "S17_export_lines": f"WITH {LAYERS} SELECT name, 'export QUILL_' || upper(name) || '=''' || value || '''' AS line FROM r WHERE value IS NOT NULL",
        "S18_without_secrets": f"WITH {LAYERS} SELECT name, CASE WHEN NOT contains(upper(name), 'API_KEY') THEN value END AS value FROM r",
        "S13_history_tables": "SELECT * FROM (VALUES ('organization_history', 0, 'session_id', 'string'), ('organization_history', 1, 'session_time', 'timestamp'), ('organization_history', 2, 'documents_processed', 'bigint'), ('organization_history', 3, 'success_rate', 'double'), ('organization_history', 4, 'structure_type', 'string'), ('organization_history', 5, 'quality_score', 'double'), ('organization_history', 6, 'metadata', 'string'), ('category_history', 0, 'session_id', 'string'), ('category_history', 1, 'category', 'string'), ('category_history', 2, 'document_count', 'bigint'), ('category_history', 3, 'average_confidence', 'double'), ('user_corrections', 0, 'file_name', 'string'), ('user_corrections', 1, 'from_category', 'string'), ('user_corrections', 2, 'to_category', 'string'), ('user_corrections', 3, 'session_id', 'string'), ('user_corrections', 4, 'correction_time', 'timestamp')) v(\"table\", position, \"column\", type)",
        "S12_appended_sessions": "SELECT DISTINCT ON (session_id) session_id, documents_processed, structure_type FROM organization_sessions WHERE documents_processed IS NOT NULL",
        "S11_state": f"WITH {CORR}, b AS (SELECT 'category_strengthening' AS pattern_type, to_category AS category FROM cor UNION ALL SELECT 'category_weakening', from_category FROM cor) SELECT pattern_type, category, count(*) AS n FROM b WHERE category IS NOT NULL GROUP BY ALL",
        "S15_kept_progress": "SELECT DISTINCT file_name FROM user_corrections WHERE file_name IN (SELECT file_name FROM document_metadata WHERE file_name IS NOT NULL)",
        "S14_G22_learned_patterns": f"WITH {CORR}, b AS (SELECT 'category_strengthening' AS pattern_type, to_category AS category FROM cor UNION ALL SELECT 'category_weakening', from_category FROM cor) SELECT pattern_type, category, count(*) AS n FROM b WHERE category IS NOT NULL GROUP BY ALL",
        "G22_pattern_success": f"WITH {RESULTS}, {CORR} SELECT 'successful' AS outcome, 'high_confidence_rules' AS pattern_type, least(count(*), 100) AS n FROM res WHERE confidence >= 0.8 UNION ALL SELECT 'failed', 'category_weakening', count(DISTINCT from_category) FROM cor UNION ALL SELECT 'failed', 'failed_classifications', count(*) FROM res WHERE category IS NULL",
        "S20_P09_tally": f"WITH {CHECKED} SELECT count(*) AS total_operations, count(*) FILTER (error IS NULL) AS successful_operations, count(error) AS failed_operations, count(*) FILTER (error IS NULL AND type = 'create_dir') AS created_directories, count(*) FILTER (error IS NULL AND type = 'move') AS moved_files, round(100.0::DOUBLE * count(*) FILTER (error IS NULL) / count(*), 6) AS success_rate FROM op",
        "P09_operation_errors": f"WITH {CHECKED} SELECT * FROM op WHERE error IS NOT NULL",
        "S28_log_lines": on_corpus(f"md5('[2024-05-06 07:08:09] ' || {LOG}) AS digest", tail="b WHERE content IS NOT NULL"),
        "S27_G30_call_report": "WITH s AS (SELECT c_custkey % 3 AS k, c_custkey % 4 AS n FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 4 > 0) SELECT sum(n)::BIGINT AS total, count(*) AS files, coalesce(sum(n) FILTER (k = 0), 0)::BIGINT AS direct, coalesce(sum(n) FILTER (k = 1), 0)::BIGINT AS module, 'HIGH' AS severity FROM s",
        "G27_retry_statistics": f"WITH {ATTEMPTS}, a AS (SELECT file_id, content_id, {ok} AS ok, CASE WHEN error_message IS NOT NULL THEN {error_case(said, 2, 'False')} END AS again FROM att), f AS (SELECT file_id, count(*) AS n, count(*) FILTER (ok) AS good, arg_min(ok, content_id)::INT AS first, count(*) FILTER (again) AS rec, count(*) FILTER (NOT again) AS per FROM a GROUP BY 1) SELECT sum(n)::BIGINT AS total_attempts, sum(good - first)::BIGINT AS successful_retries, sum(n - 1 - (good - first))::BIGINT AS failed_retries, count(*) FILTER (rec > 0) AS files_with_recoverable_issues, sum(per)::BIGINT AS permanent_errors, sum(rec)::BIGINT AS recoverable_errors, count(*) AS files, count(*) FILTER (good > 0) AS succeeded, round(100.0::DOUBLE * count(*) FILTER (good > 0) / count(*), 6) AS success_rate FROM f",
        "G28_operation_statistics": f"WITH {ATTEMPTS} SELECT coalesce(file_type, 'none') AS operation, count(*) AS total, count(*) FILTER (NOT {ok}) AS failed, round(100.0::DOUBLE * count(*) FILTER ({ok}) / count(*), 6) AS success_rate FROM att GROUP BY 1",
        "G29_availability": f"WITH {ATTEMPTS}, s AS (SELECT coalesce(extraction_method, 'none') AS s, bool_or(coalesce(quality, '') = 'excellent') AS up FROM att GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (up) AS available, round(count(*) FILTER (up)::DOUBLE / count(*), 6) AS availability_rate FROM s",
        "C03_classify": f"{corpus_cte()}, b AS (SELECT doc_id, content, file_name, coalesce(file_name, '') || ' ' || coalesce(content, '') AS t FROM corpus){SCORES} SELECT doc_id, CASE WHEN {top} < 0.3 THEN 'other' " + " ".join(f"WHEN {c} = {top} THEN '{c}'" for c in ("contracts", "invoices", "reports", "correspondence", "financial", "legal")) + " END AS category FROM sc",
        "C12_disambiguated": f"WITH {RESULTS}, {FILES}, {CORR}, base AS (SELECT file_id AS doc_id, max(struct_pack(confidence, category)) AS r FROM res GROUP BY 1), nm AS (SELECT file_name, min(file_id) AS doc_id FROM fil GROUP BY 1), fx AS (SELECT doc_id, max(to_category) AS c FROM cor JOIN nm USING (file_name) WHERE to_category IS NOT NULL GROUP BY 1) SELECT doc_id, coalesce(c, r.category) AS category, CASE WHEN c IS NOT NULL THEN 1.0 ELSE r.confidence END AS confidence, c IS NOT NULL AS refined FROM base LEFT JOIN fx USING (doc_id)",
        "L08_L11_ranked_categories": f"{ranked} SELECT doc_id, place, category, round(score, 9) AS score FROM v WHERE place <= 3",
        "L11_alternatives": f"{ranked} SELECT doc_id, place, category, round(score, 9) AS score FROM v WHERE place BETWEEN 2 AND 3",
        "J12_rule_table": f"{ranked} SELECT doc_id, category, round(score, 9) AS score FROM v",
        "J07_zipped": f"WITH {FILES}, z AS (SELECT file_id, list_zip(dates_found, numbers_found, true) AS z FROM fil WHERE dates_found IS NOT NULL AND numbers_found IS NOT NULL), u AS (SELECT file_id, unnest(z) AS p, generate_subscripts(z, 1) AS position FROM z) SELECT file_id, position, p[1] AS \"left\", p[2] AS \"right\" FROM u",
        "J08_with_counterpart": f"WITH {FILES} SELECT file_id, file_name FROM fil WHERE file_name IN (SELECT file_name FROM user_corrections WHERE file_name IS NOT NULL)",
        "J09_in_range": f"WITH {FILES} SELECT file_id, file_size, CASE WHEN file_size <= 2000 THEN 'tiny' WHEN file_size BETWEEN 2001 AND 20000 THEN 'small' WHEN file_size BETWEEN 20001 AND 200000 THEN 'medium' WHEN file_size >= 250000 THEN 'large' END AS tier FROM fil",
        "J13_lookup": f"WITH {RESULTS} SELECT result_id, CASE method WHEN 'rule_based' THEN 1 WHEN 'ml_enhanced' THEN 2 ELSE 0 END AS step FROM res",
        "P04_preference_errors": f"SELECT p_partkey, {errors((f'{K} % 13 / 10.0 NOT BETWEEN 0 AND 1', 'ML threshold must be between 0.0 and 1.0'), (f'{K} % 4 <> 0 AND ({K} % 70 < 1 OR {K} % 70 > 50)', 'Max categories must be integer between 1 and 50'), (f'round(1.2 - {K} % 15 / 10.0, 6) NOT BETWEEN 0 AND 1', 'Quality threshold must be between 0.0 and 1.0'), (f'{K} % 3 = 1', 'Structure type must be one of: time_first, category_first, flat_time, flat_category'))} AS errors FROM part",
        "P05_configuration_errors": f"SELECT p_partkey, {errors((f'{K} % 6 = 0', 'Input directory is required'), (f'{K} % 6 <> 0 AND {K} % 4 = 0', chr(39) + 'Input directory does not exist: ' + chr(39) + ' || p_name'), (f'{K} % 5 = 0', 'Output directory is required'), (f'{K} % 7 = 0', 'Provider is required'), (f'{K} % 7 <> 0 AND {K} % 3 = 0', 'Key required for openai'), (f'{K} % 5 NOT IN (1, 2, 3)', 'Level must be 1, 2, or 3'), (f'{K} % 8 = 0', 'Language cannot be empty'))} AS errors FROM part",
        "P06_argument_conflicts": f"SELECT p_partkey, {errors((f'{K} % 6 = 0', 'organize and no-organize'), (f'{K} % 5 < 2 AND {K} % 7 < 2', 'quiet and verbose'), (f'{K} % 5 < 2 AND {K} % 4 <> 0 AND {K} % 2 = 0', 'quiet without key'), (f'{K} % 18 = 0', 'enable and disable'), (f'{K} % 10 < 5 AND {K} % 4 <> 2', 'dependency needs name and path'))} AS errors FROM part",
        "P08_nearest_level": f"WITH l AS (SELECT p_partkey, unnest([1, 2, 3]) AS level FROM part), a AS (SELECT * FROM l WHERE level = 1 AND {K} % 2 = 0 OR level = 2 AND {K} % 3 = 0 OR level = 3 AND {K} % 7 <> 0), m AS (SELECT p_partkey, arg_min(level, abs({K} % 5 - level) * 10 + level) AS level FROM a GROUP BY 1) SELECT p_partkey, coalesce(level, 1) AS level FROM part LEFT JOIN m USING (p_partkey)",
        "K01_G26_X11_P03_folder_pattern": f"WITH {FOLDERS} SELECT * FROM pat2",
        "K02_chosen_structure": f"WITH {FOLDERS}, {RESULTS}, s AS (SELECT CASE WHEN avg((confidence >= 0.8)::INT) >= 0.6 THEN 'category_first' ELSE 'time_first' END AS st, CASE WHEN count(*) > 50 THEN 'month' ELSE 'year' END AS gr, count(DISTINCT category) AS wanted, count(DISTINCT category) FILTER (category NOT IN (SELECT name FROM fo WHERE name IS NOT NULL)) AS lacking FROM res) SELECT CASE WHEN reasonable THEN 'extend' ELSE 'new' END AS decision, CASE WHEN reasonable THEN structure_type ELSE st END AS structure_type, CASE WHEN reasonable THEN time_granularity ELSE gr END AS time_granularity, CASE WHEN reasonable THEN fiscal_year_type ELSE 'calendar' END AS fiscal_year_type, CASE WHEN reasonable THEN categories + lacking ELSE wanted END AS categories, CASE WHEN reasonable THEN lacking ELSE 0 END AS new_categories FROM pat2, s",
        "K04_K05_operations": f"WITH {PLANNED} SELECT * FROM pl",
        "K08_by_kind": f"WITH {FILES} SELECT file_id, CASE WHEN regexp_matches(lower(file_name), '[^/.]\\.(pdf|doc|docx|txt)$') THEN 'documents' WHEN regexp_matches(lower(file_name), '[^/.]\\.(png|jpg|jpeg|gif|bmp)$') THEN 'images' ELSE 'other' END AS kind FROM fil",
        "G16_temporal_confidence": f"WITH {RESULTS}, {FILES}, d AS (SELECT CAST(modification_date AS DATE) AS dt, confidence AS q FROM fil JOIN res USING (file_id)), t AS (SELECT count(*) AS n, count(dt) AS k, avg(coalesce(q, 0.5)) FILTER (dt IS NOT NULL) AS q FROM d), m AS (SELECT stddev_pop(c) / avg(c) AS cv FROM (SELECT month(dt), count(*)::DOUBLE AS c FROM d WHERE dt IS NOT NULL GROUP BY 1)) SELECT round(k::DOUBLE / n, 6) AS date_coverage, round(q, 6) AS average_date_quality, round(least(1.0::DOUBLE, cv * 0.5), 6) AS pattern_strength, round(k::DOUBLE / n * 0.4::DOUBLE + q * 0.3::DOUBLE + least(1.0::DOUBLE, cv * 0.5) * 0.3::DOUBLE, 6) AS overall_confidence FROM t, m",
        "G14_fiscal_hints": rf"{corpus_cte()}{BASE}, h AS (SELECT count(*) AS h FROM b WHERE regexp_matches(t, 'fy[\s-]?\d{{2,4}}|fiscal\s+year\s+\d{{2,4}}|\d{{4}}[\s-]?\d{{2,4}}\s+fiscal', 'i')), n AS (SELECT CAST(modified AS DATE) AS dt FROM b WHERE modified IS NOT NULL), m AS (SELECT count(*) FILTER (month(dt) IN (3, 4))::DOUBLE AS financial, (count(*) FILTER (month(dt) = 9) * 1.5)::DOUBLE AS academic, count(*) FILTER (month(dt) IN (9, 10))::DOUBLE AS federal, count(*)::DOUBLE / 12 AS calendar, count(DISTINCT month(dt)) AS months, count(*) AS dates FROM n) SELECT round(financial, 6) AS financial, round(academic, 6) AS academic, round(federal, 6) AS federal, round(calendar, 6) AS calendar, CASE greatest(financial, academic, federal, calendar) WHEN financial THEN 'financial' WHEN academic THEN 'academic' WHEN federal THEN 'federal' ELSE 'calendar' END AS fiscal_type, round(CASE WHEN h > 0 THEN h::DOUBLE / (h + dates) ELSE 0.0 END * 0.7::DOUBLE + least(1.0::DOUBLE, months / 12.0::DOUBLE * 2) * 0.3::DOUBLE, 6) AS confidence FROM m, h",
        "X09_advice": f"{DATED}{GAPS}, sp AS (SELECT (max(dt) - min(dt)) / 365.25 AS y FROM n), cq AS (SELECT category, quarter(dt) AS q, count(*)::DOUBLE AS c FROM n GROUP BY ALL), se AS (SELECT category, count(*) >= 2 AND stddev_pop(c) / avg(c) > 0.6 AS strong FROM cq GROUP BY 1 HAVING sum(c) >= 3), s AS (SELECT count(*) AS seasons, count(*) FILTER (strong) AS strong, min(category) FILTER (strong) AS one FROM se), w AS (SELECT count(*) AS rhythms, count(*) FILTER (sd < m * 0.3 AND m > 0 AND 1 - sd / m > 0.7) AS regular FROM gs), a AS (SELECT 'span' AS source, CASE WHEN y > 5 THEN 'Long time span detected - consider year-based primary organization' WHEN y < 1 THEN 'Recent documents - consider month/quarter organization' END AS advice FROM sp UNION ALL SELECT 'seasons', CASE WHEN seasons > 2 THEN 'Strong seasonal patterns - organize by business quarters within years' END FROM s UNION ALL SELECT 'categories', CASE WHEN strong >= 2 THEN 'Multiple categories show strong seasonal patterns - consider quarterly organization' WHEN strong = 1 THEN one || ' shows seasonal pattern - organize by business quarters' END FROM s UNION ALL SELECT 'workflows', CASE WHEN rhythms > 3 THEN 'Multiple workflow patterns detected - consider category-first organization' END FROM w UNION ALL SELECT 'regular', CASE WHEN regular > 1 THEN 'Multiple regular workflows detected - organize by workflow pattern' END FROM w) SELECT * FROM a WHERE advice IS NOT NULL",
        "M06_cluster_categories": f"{corpus_cte()}{BASE}, c AS (SELECT doc_id % 50 AS cluster, bool_or({any_of('x', ['invoice|bill|payment', chr(92) + '$'])}) AS i, bool_or(regexp_matches(x, 'contract|agreement|terms')) AS k, bool_or(regexp_matches(x, 'report|analysis|summary')) AS r, bool_or(regexp_matches(x, 'email|letter|correspondence')) AS e FROM (SELECT doc_id, lower(concat_ws(' ', file_name, content)) AS x FROM b) GROUP BY 1) SELECT cluster, CASE WHEN i THEN 'invoices' WHEN k THEN 'contracts' WHEN r THEN 'reports' WHEN e THEN 'correspondence' ELSE 'other' END AS category, CASE WHEN i OR k OR r OR e THEN 0.6 ELSE 0.4 END AS confidence FROM c",
    }
