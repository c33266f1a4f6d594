"""DuckDB SQL of the document queries, written on its own from the rules, not from the Spark plans."""

from __future__ import annotations

from quillspark.corpus import corpus_cte
from quillspark.operators import classify, profile, security

WORDS = r"list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')"
BASE = ", b AS (SELECT *, coalesce(content, '') AS t FROM corpus)"


def lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def matches(text: str, pattern: str, options: str = "i") -> str:
    return f"regexp_matches({text}, {lit(pattern)}, '{options}')"


def any_of(text: str, patterns, options: str = "i") -> str:
    return "(" + " OR ".join(matches(text, p, options) for p in patterns) + ")"


def find(text: str, patterns, options: str) -> str:
    lists = ", ".join(f"regexp_extract_all({text}, {lit(p)}, {g}, '{options}')" for p, g in patterns)
    return f"array_to_string(list_slice(list_sort(list_distinct(flatten([{lists}]))), 1, 10), '|')"


def on_corpus(select: str, more: str = "", tail: str = "") -> str:
    return f"{corpus_cte()}{BASE}{more} SELECT {select} FROM {tail or 'b'}"


EXT = r"lower(regexp_extract(file_name, '[^/.](\.[^./]+)$', 1))"
MIME = "CASE " + EXT + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in profile.MIME_TYPES.items()) + " END"
LINES = r"list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
HEADERS = f"coalesce(list_bool_or(list_transform(range(1, len({LINES})), lambda i: len(({LINES})[i]) < 50 AND len(({LINES})[i + 1]) > len(({LINES})[i]))), false)"
MARKS = "len(regexp_replace({0}, '[^.!?]', '', 'g'))"
READABILITY = f"CASE WHEN content IS NULL OR content = '' THEN NULL WHEN {MARKS.format('content')} = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 100 - (len({WORDS})::DOUBLE / {MARKS.format('content')}) * 1.5 - coalesce(list_sum(list_transform({WORDS}, lambda w: len(w)))::DOUBLE / nullif(len({WORDS}), 0), 0.0) * 5)) END"


def language() -> str:
    counts = {k: " + ".join(f"contains(lower(content), {lit(w)})::INT" for w in v.split()) for k, v in profile.LANGUAGE_MARKERS.items()}
    top = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN content IS NULL OR len(trim(content)) < 50 THEN NULL WHEN {top} < 3 THEN 'unknown' " + " ".join(f"WHEN {c} = {top} THEN '{k}'" for k, c in counts.items()) + " END"


DATES = [p for p, _ in profile.DATE_PATTERNS]
HAS_DATES, HAS_MONEY = any_of("t", DATES), any_of("t", profile.CURRENCY_FLAGS)
HAS_PAID = any_of("t", [p for p, _ in profile.CURRENCY_PATTERNS])
HAS_NUMBERS = r"regexp_matches(t, '\d+')"
COUNTS = rf"len(t) AS content_length, len({WORDS}) AS word_count, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS line_count, len(list_filter(string_split(t, chr(10) || chr(10)), lambda x: regexp_matches(x, '\S'))) AS paragraph_count"
FOUND = f"{find('t', profile.DATE_PATTERNS, 'i')} AS dates_found, {find('t', profile.NUMBER_PATTERNS, 'c')} AS numbers_found, {find('t', profile.CURRENCY_PATTERNS, 'i')} AS currency_found, CASE WHEN content IS NULL THEN 'failed' END AS error_quality"
FULL = f"doc_id, file_name, file_size, {EXT} AS file_extension, {MIME} AS mime_type, {COUNTS}, {HEADERS} AS has_headers, {HAS_DATES} AS has_dates, {HAS_MONEY} AS has_currency, {HAS_NUMBERS} AS has_numbers, round({READABILITY}, 6) AS readability_score, {language()} AS language, {FOUND}"


def document_type() -> str:
    def says(kind: str) -> str:
        w, listed = profile.NAME_WORDS[kind]
        return "(CASE WHEN " + " OR ".join(f"contains(lower(file_name), {lit(x)})" for x in listed.split()) + f" THEN {w} ELSE 0.0 END)::DOUBLE"

    def plus(flag: str, w: float) -> str:
        return f"(CASE WHEN {flag} THEN {w} ELSE 0.0 END)::DOUBLE"

    scores = {
        "financial": plus("has_currency", 0.4) + " + " + plus("has_numbers", 0.2) + " + " + says("financial"),
        "legal": says("legal") + " + " + plus("word_count > 500", 0.2) + " + " + plus("has_dates", 0.2),
        "personal": says("personal") + " + " + plus("file_size < 1048576", 0.2),
        "technical": says("technical") + " + " + plus("word_count > 1000", 0.2) + " + " + plus("has_headers", 0.2),
    }
    cols = ", ".join(f"round({s}, 6) AS s_{k}" for k, s in scores.items())
    top = "greatest(s_financial, s_legal, s_personal, s_technical)"
    return f"{corpus_cte()}{BASE}, p AS (SELECT {FULL} FROM b), q AS (SELECT doc_id, {cols} FROM p) SELECT doc_id, CASE WHEN {top} < 0.5 THEN 'unknown' " + " ".join(f"WHEN s_{k} = {top} THEN '{k}'" for k in scores) + f" END AS primary_type, {top} AS confidence FROM q"


NON_TEXT = r"len(regexp_replace(t, '[\p{L}\p{N} \n\t.,!?]', '', 'g'))"
POOR = f"((len(t) - len(replace(t, '�', ''))) > len(t) * 0.01)::INT + ((len(t) - len(replace(t, chr(10), ''))) > len(t) * 0.1)::INT + (len({WORDS}) < len(t) * 0.1)::INT + ({NON_TEXT} > len(t) * 0.1)::INT"
SIZED = f"len(t) BETWEEN 50 AND 50000 AND len(list_filter({WORDS}, lambda w: len(w) >= 3)) > 10"
GRADE = f"CASE WHEN len(trim(t)) < 10 OR len({WORDS}) < 20 THEN 'failed' WHEN {POOR} >= 2 THEN 'poor' WHEN {POOR} = 1 THEN 'fair' WHEN contains(t, '.') AND {SIZED} THEN 'excellent' WHEN {SIZED} THEN 'good' ELSE 'fair' END"
ALPHA = rf"len(list_filter({WORDS}, lambda w: regexp_matches(w, '^[\p{{L}}]{{3,}}$')))"
IMAGE = f"CASE WHEN len(trim(t)) < 5 THEN 'failed' WHEN len({LINES}) < 2 THEN 'poor' WHEN {ALPHA} < 5 THEN 'poor' WHEN {ALPHA} < 15 THEN 'fair' ELSE 'good' END"
DIRECT = f"CASE WHEN len(trim(t)) < 10 THEN 'failed' WHEN len({WORDS}) >= 50 AND {MARKS.format('t')} >= 3 AND len(t) >= 200 THEN 'excellent' WHEN len({WORDS}) >= 20 AND {MARKS.format('t')} >= 1 AND len(t) >= 100 THEN 'good' WHEN len({WORDS}) >= 10 AND len(t) >= 50 THEN 'fair' ELSE 'poor' END"
UP = "CASE WHEN len(trim(t)) < 10 THEN 'failed' ELSE CASE text_grade WHEN 'failed' THEN 'poor' WHEN 'poor' THEN 'fair' WHEN 'fair' THEN 'good' ELSE 'excellent' END END"
STRUCTURED = r"array_to_string(list_filter(list_transform(list_transform(string_split(t, chr(10) || chr(10)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')), lambda p: CASE WHEN p = '' OR regexp_matches(p, '[.!?:]$') THEN p ELSE p || '.' END), lambda p: p <> ''), chr(10) || chr(10))"
SENTENCES = r"list_filter(list_transform(string_split_regex(t, '[.!?]+\s+'), lambda s: trim(s)), lambda s: len(s) > 10)"
SCORE = "CASE WHEN len(s) BETWEEN 30 AND 200 THEN 1.0 WHEN len(s) > 200 AND len(s) <= 400 THEN 0.7 ELSE 0.0 END::DOUBLE + (" + " + ".join(f"contains(lower(s), '{w}')::INT" for w in "date amount total invoice contract agreement summary conclusion purpose objective".split()) + r") * 0.5::DOUBLE + CASE WHEN regexp_matches(s, '\d') THEN 0.3 ELSE 0.0 END::DOUBLE + CASE WHEN regexp_matches(s, '^\p{Lu}') AND s <> upper(s) THEN 0.2 ELSE 0.0 END::DOUBLE"
SCORED = f", x AS (SELECT doc_id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) - 1 AS pos FROM b), y AS (SELECT doc_id, pos, s, round({SCORE}, 6) AS score FROM x)"
SUMMARY = f"""{corpus_cte()}{BASE}{SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM y JOIN (SELECT doc_id FROM b WHERE len(t) > 2000) USING (doc_id)),
 f AS (SELECT doc_id, list(struct_pack(s := s) ORDER BY r) AS l FROM o GROUP BY doc_id),
 z AS (SELECT doc_id, list_reduce(list_prepend(struct_pack(used := 0::BIGINT, kept := ''), list_transform(l, lambda e: struct_pack(used := len(e.s)::BIGINT, kept := e.s))), lambda a, e: CASE WHEN a.used < 1800 AND a.used + e.used <= 2000 THEN struct_pack(used := a.used + e.used, kept := CASE WHEN a.kept = '' THEN e.kept ELSE a.kept || ' ' || e.kept END) ELSE a END).kept AS summary FROM f)
 SELECT b.doc_id, len({SENTENCES}) AS n_sentences, CASE WHEN len(t) > 2000 THEN coalesce(z.summary, '') ELSE t END AS summary FROM b LEFT JOIN z ON b.doc_id = z.doc_id"""

RESERVED = "(" + ", ".join(lit(x) for x in security.RESERVED) + ")"


def chosen_name() -> str:
    steps = [r"regexp_replace(trim(file_name), '^[''\"`]+|[''\"`]+$', '', 'g') AS s", "regexp_replace(regexp_replace(regexp_replace(s, '[^A-Za-z0-9_-]', '_', 'g'), '_{2,}', '_', 'g'), '^_+|_+$', '', 'g') AS s", "CASE WHEN len(s) < 10 THEN 'document_' || s ELSE s END AS s"]
    cut = "regexp_extract(left(s, 160), '^(.{10,}[_-])', 1)"
    steps.append(f"CASE WHEN len(s) > 160 THEN regexp_replace(CASE WHEN {cut} <> '' THEN {cut} ELSE left(s, 160) END, '[_-]+$', '') ELSE s END AS s")
    sql, at = f"{corpus_cte()}, s0 AS (SELECT doc_id, file_name, {steps[0]} FROM corpus)", 0
    for step in steps[1:]:
        sql += f", s{at + 1} AS (SELECT doc_id, file_name, {step} FROM s{at})"
        at += 1
    s = "s"
    for w in security.FORBIDDEN_WORDS:
        s = f"CASE WHEN contains(low, '{w}') THEN replace(low, '{w}', 'content') ELSE {s} END"
    return f"{sql}, e AS (SELECT *, lower(s) AS low FROM s{at}) SELECT doc_id, CASE WHEN file_name IS NULL OR file_name = '' THEN 'unnamed_document' WHEN ({s}) = '' THEN 'document' ELSE {s} END AS name FROM e"


def chain(text: str, steps, options: str) -> str:
    for p, r in steps:
        text = f"regexp_replace({text}, {lit(p)}, {lit(r)}, '{options}')"
    return text


LOG = chain("content", [(p, r.replace("$1", r"\1")) for p, r in security.LOG_SECRETS], "g")
DANGERS = rf"regexp_replace(regexp_replace(regexp_replace({chain('t', [(p, '[REMOVED]') for p in security.DANGEROUS], 'gis')}, '\r\n|\r', chr(10), 'g'), '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"
INDICATORS = {
    "javascript": "len(regexp_extract_all(t, '/JS\\b')) + len(regexp_extract_all(t, '/JavaScript\\b'))",
    **{k: rf"len(regexp_extract_all(t, '{p}\b'))" for k, p in {"open_action": "/OpenAction", "additional_actions": "/AA", "embedded_files": "/EmbeddedFile", "xfa_forms": "/XFA", "uri_references": "/URI", "submit_form": "/SubmitForm", "launch_action": "/Launch"}.items()},
}


def threats() -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in INDICATORS.items())
    high = "(javascript > 0)::INT + 2 * (launch_action > 0)::INT + (embedded_files > 0)::INT"
    medium = " + ".join(f"({k} > 0)::INT" for k in ("open_action", "additional_actions", "uri_references", "submit_form", "xfa_forms"))
    level = f"CASE WHEN unread THEN 'low' WHEN {high} >= 2 THEN 'high' WHEN {high} >= 1 OR {medium} >= 3 THEN 'medium' WHEN {medium} >= 1 THEN 'low' ELSE 'safe' END"
    said = {"javascript": "JavaScript code", "launch_action": "Launch actions", "embedded_files": "Embedded files", "open_action": "Auto-open actions", "uri_references": "External URI references", "submit_form": "Form submissions"}
    parts = ", ".join(f"CASE WHEN {k} > 0 THEN '{v} (' || {k} || ' instances)' END" for k, v in said.items())
    summary = f"CASE WHEN threat_level = 'safe' THEN 'PDF appears safe - no suspicious indicators detected' WHEN NOT unread AND concat_ws(', ', {parts}) <> '' THEN 'Potential threats detected: ' || concat_ws(', ', {parts}) ELSE 'PDF has ' || threat_level || ' risk indicators' END"
    return f"{corpus_cte()}{BASE}, n AS (SELECT doc_id, content IS NULL AS unread, {cols} FROM b), l AS (SELECT *, {level} AS threat_level FROM n) SELECT * EXCLUDE (unread), {summary} AS summary FROM l"


def category_score(category: str) -> str:
    sets = classify.RULES[category]
    total = "0.0::DOUBLE"
    for w, patterns in sets:
        total += " + (" + " + ".join(matches("t", p) + "::INT" for p in patterns) + f")::DOUBLE / {len(patterns)}::DOUBLE * {w}::DOUBLE"
    return f"({total}) / {len(sets)}::DOUBLE"


SCORES = ", sc AS (SELECT doc_id, content, t, file_name, " + ", ".join(f"{category_score(c)} AS {c}" for c in classify.RULES) + " FROM b)"
TOP = "greatest(" + ", ".join(classify.RULES) + ")"
CLASSIFIED = SCORES + f", k AS (SELECT doc_id, content, t, file_name, CASE WHEN {TOP} = 0 THEN 'other' " + " ".join(f"WHEN {c} = {TOP} THEN '{c}'" for c in classify.RULES) + f" END AS category, {TOP} AS confidence, greatest(0, " + " + ".join(f"({c} > 0)::INT" for c in classify.RULES) + " - 1) AS alternatives FROM sc)"
LEVEL = "CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.2 THEN 'low' ELSE 'very_low' END"
BROAD = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in words.split()) + f" THEN '{name}'" for name, words in classify.BROAD) + " ELSE 'miscellaneous_documents' END"
REFINED = f", g AS (SELECT count(*) FILTER (confidence < 0.7) >= 10 AS go FROM k), u AS (SELECT k.*, CASE WHEN confidence >= 0.7 OR NOT go THEN 'certain' WHEN len(t) < 50 THEN 'insufficient' WHEN confidence < 0.3 THEN 'new_pattern' WHEN alternatives > 2 THEN 'ambiguous' ELSE 'quality' END AS uncertainty FROM k, g)"
GENERIC = " OR ".join(f"contains(fn, '{w}')" for w in classify.GENERIC_NAMES)
BARE = "replace(fn, '.pdf', '')"
FACTORS = f""", v AS (SELECT *, lower(coalesce(file_name, '')) AS fn, len({WORDS}) AS nw FROM k), fa AS (SELECT doc_id, confidence,
 CASE WHEN confidence BETWEEN 0.4 AND 0.7 THEN (0.7::DOUBLE - confidence) / 0.3::DOUBLE ELSE 0.0 END AS mixed_signals,
 (CASE WHEN len(t) + len(fn) < 50 THEN 0.8 WHEN len(t) + len(fn) < 100 OR nw < 10 THEN 0.5 WHEN nw < 20 THEN 0.3 ELSE 0.0 END)::DOUBLE AS sparse_content,
 (CASE WHEN fn = '' THEN 0.8 WHEN {GENERIC} THEN 0.6 WHEN regexp_matches({BARE}, '^[0-9\\-_.]+$') THEN 0.4 WHEN len({BARE}) < 5 THEN 0.3 ELSE 0.0 END)::DOUBLE AS ambiguous_filename,
 CASE WHEN content IS NULL THEN 0.8::DOUBLE ELSE least(1.0::DOUBLE, (CASE WHEN {HAS_DATES} OR {HAS_PAID} THEN 0.0 ELSE 0.3 END)::DOUBLE + (CASE WHEN {HAS_DATES} THEN 0.0 ELSE 0.2 END)::DOUBLE + (CASE WHEN regexp_matches(lower(t), 'invoice|payment|bill|\\$') AND NOT regexp_matches(t, '\\$[\\d,]+\\.?\\d*') THEN 0.3 ELSE 0.0 END)::DOUBLE + (CASE WHEN nw < 20 THEN 0.2 ELSE 0.0 END)::DOUBLE) END AS missing_metadata FROM v),
 un AS (SELECT *, least(1.0::DOUBLE, 1.0::DOUBLE - confidence + mixed_signals * 0.3::DOUBLE + sparse_content * 0.2::DOUBLE + ambiguous_filename * 0.15::DOUBLE + missing_metadata * 0.1::DOUBLE) AS uncertainty_score, confidence >= 0.7 AS certain FROM fa)"""

RESULTS = "res AS (SELECT DISTINCT ON (result_id) * FROM classification_results)"
FILES = "fil AS (SELECT DISTINCT ON (file_id) * FROM document_metadata)"
DATED = f"WITH {RESULTS}, {FILES}, d AS (SELECT lower(trim(category)) AS category, CAST(modification_date AS DATE) AS dt FROM res JOIN fil USING (file_id)), n AS (SELECT * FROM d WHERE dt IS NOT NULL)"
SESS = "ses AS (SELECT DISTINCT ON (session_id) * FROM organization_sessions)"
CORR = "cor AS (SELECT DISTINCT ON (correction_id) * FROM user_corrections)"
DIST = ", ds AS (SELECT 'year' AS grain, year(dt) AS period, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'month', month(dt), count(*) FROM n GROUP BY ALL UNION ALL SELECT 'quarter', quarter(dt), count(*) FROM n GROUP BY ALL)"
QUARTERS = ", cq AS (SELECT category, quarter(dt) AS q, count(*) AS c FROM n GROUP BY ALL)"
SEASON = "CASE peak WHEN 1 THEN 'year_end_reporting' WHEN 2 THEN 'mid_year_activity' WHEN 3 THEN 'summer_activity' ELSE 'year_end_closure' END"


def gap_stats(keys: str) -> str:
    part, group = (f"PARTITION BY {keys} ", keys) if keys else ("", "1")
    name = keys or "1 AS one"
    return f", gp AS (SELECT {name}, date_diff('day', dt, lead(dt) OVER ({part}ORDER BY dt))::DOUBLE AS gap FROM n), gs AS (SELECT {keys + ',' if keys else ''} count(*) AS dates, count(gap) AS k, avg(gap) AS m, stddev_pop(gap) AS sd, count(DISTINCT gap) AS di FROM gp GROUP BY {keys if keys else 'one'})"


def oracle_sql() -> dict[str, str]:
    ent = f"doc_id, {find('t', profile.DATE_PATTERNS, 'i')} AS dates_found, {find('t', profile.NUMBER_PATTERNS, 'c')} AS numbers_found, {find('t', profile.CURRENCY_PATTERNS, 'i')} AS currency_found"
    printable = r"regexp_replace(left(t, 4096), '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', '', 'g')"
    inj, scr = any_of("left(t, 4096)", security.INJECTION), any_of("left(t, 8192)", security.SCRIPTS, "is")
    p = r"replace(file_name, '\', '/')"
    return {
        "T01_file_metadata": on_corpus(f"doc_id, file_name, file_size, CAST(modified AS DATE) AS modified, {EXT} AS file_extension, {MIME} AS mime_type"),
        "T02_content_counts": on_corpus(rf"doc_id, len(t) AS content_length, len({WORDS}) AS word_count, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS line_count, len(list_filter(string_split(t, chr(10) || chr(10)), lambda x: regexp_matches(x, '\S'))) AS paragraph_count"),
        "T03_T04_structure_flags": on_corpus(f"doc_id, {HEADERS} AS has_headers, {HAS_NUMBERS} AS has_numbers, {HAS_DATES} AS has_dates, {HAS_MONEY} AS has_currency"),
        "T05_L01_U03_entities": on_corpus(ent),
        "T06_readability": on_corpus(f"doc_id, round({READABILITY}, 6) AS readability_score"),
        "T07_L09_language_guess": on_corpus(f"doc_id, {language()} AS language"),
        "T08_comprehensive": on_corpus(FULL),
        "T10_document_type": document_type(),
        "T11_document_summary": f"{corpus_cte()}{BASE}, p AS (SELECT {FULL} FROM b) SELECT doc_id, file_name, round(content_length / 1024, 6) AS size_kb, word_count, coalesce(language, 'unknown') AS language, has_dates OR has_currency OR has_numbers AS has_important_data FROM p",
        "T12_T13_T14_T24_T25_grades": f"{corpus_cte()}{BASE}, g AS (SELECT doc_id, t, {GRADE} AS text_grade, {IMAGE} AS image_grade, {DIRECT} AS direct_grade FROM b) SELECT doc_id, text_grade, CASE text_grade WHEN 'excellent' THEN 'good' WHEN 'good' THEN 'fair' ELSE text_grade END AS recognised_grade, image_grade, {UP} AS promoted_grade, direct_grade FROM g",
        "T15_best_attempt": "SELECT file_id, content_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY coalesce(list_position(['failed', 'poor', 'fair', 'good', 'excellent'], quality), 0) DESC, content_id) AS r FROM (SELECT DISTINCT ON (content_id) * FROM extracted_content)) WHERE r = 1",
        "T16_normalise_unicode": "SELECT doc_id, md5(replace(replace(replace(replace(nfc_normalize(coalesce(text, '')), '–', '-'), '—', '-'), '…', '...'), chr(8203), '')) AS digest FROM documents",
        "T18_structured": on_corpus(f"doc_id, {STRUCTURED} AS structured"),
        "T19_T20_L05_sentence_scores": f"{corpus_cte()}{BASE}{SCORED} SELECT doc_id, pos, score FROM y",
        "T21_T22_W08_summary": SUMMARY,
        "T26_model_wrapper": on_corpus(f"doc_id, CASE WHEN replace({EXT}, '.', '') <> '' THEN '[' || upper(replace({EXT}, '.', '')) || ' DOCUMENT]' || chr(10) ELSE '' END || t || chr(10) || '[Extracted via: text_file]' AS wrapped"),
        "T28_chosen_name": chosen_name(),
        "T30_safe_name": rf"{corpus_cte()}, e AS (SELECT doc_id, file_name, regexp_replace(file_name, '[<>:\"|?*\\/]', '_', 'g') AS s FROM corpus), f AS (SELECT doc_id, file_name, CASE WHEN upper(regexp_replace(s, '([^/.])\.[^./]*$', '\1')) IN {RESERVED} THEN 'file_' || s ELSE s END AS s FROM e) SELECT doc_id, CASE WHEN file_name IS NULL OR file_name = '' THEN 'unnamed_file' WHEN trim(s) = '' THEN 'sanitized_file' WHEN len(s) > 255 THEN left(s, 255 - len(regexp_extract(s, '[^.](\.[^.]*)$', 1))) || regexp_extract(s, '[^.](\.[^.]*)$', 1) ELSE s END AS name FROM f",
        "T32_U06_checked_name": rf"{corpus_cte()}, e AS (SELECT doc_id, regexp_replace(left(file_name, 160), '[^a-zA-Z0-9._\-\s]', '', 'g') AS s FROM corpus) SELECT doc_id, CASE WHEN upper(s) IN ('.', '..') OR upper(s) IN {RESERVED} OR regexp_replace(s, '^[. ]+|[. ]+$', '', 'g') = '' THEN NULL ELSE regexp_replace(s, '^[. ]+|[. ]+$', '', 'g') END AS name FROM e",
        "T33_model_input": on_corpus(rf"doc_id, CASE WHEN {inj} THEN 'refused' ELSE 'ok' END AS status, md5(CASE WHEN {inj} THEN '-' ELSE trim(regexp_replace({printable}, '\s+', ' ', 'g')) END) AS digest"),
        "T34_script_check": on_corpus(f"doc_id, CASE WHEN {scr} THEN 'warned' ELSE 'ok' END AS status, md5(CASE WHEN {scr} THEN coalesce(content, '-') ELSE left(t, 8192) END) AS digest"),
        "T35_without_dangers": on_corpus(f"doc_id, {DANGERS} AS content"),
        "T36_S25_clean_log": on_corpus(f"doc_id, {LOG} AS line"),
        "S25_log_statistics": on_corpus(f"count(content) AS lines, count(*) FILTER (content <> {LOG}) AS changed"),
        "T43_broad_category": on_corpus(f"doc_id, {BROAD} AS category"),
        "T54_path_verdict": on_corpus(f"doc_id, CASE WHEN file_name IS NULL OR file_name = '' THEN 'empty' WHEN {any_of(p, security.SUSPICIOUS_PATHS)} THEN 'suspicious' WHEN {any_of(p, security.SYSTEM_PATHS)} THEN 'system' ELSE 'ok' END AS verdict"),
        "T56_S10_threats": threats(),
        "C01_C02_rule_scores": f"{corpus_cte()}{BASE}{SCORES} SELECT doc_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in classify.RULES) + " FROM sc",
        "C04_C06_C07_classified": f"{corpus_cte()}{BASE}{CLASSIFIED} SELECT doc_id, category, round(confidence, 9) AS confidence, {LEVEL} AS confidence_level, CASE WHEN confidence >= 0.7 THEN 'rule_based' ELSE 'ml_enhanced' END AS method FROM k",
        "C08_C09_C10_C11_refined": f"{corpus_cte()}{BASE}{CLASSIFIED}{REFINED} SELECT doc_id, CASE WHEN uncertainty = 'new_pattern' THEN {BROAD} ELSE category END AS category, round(CASE uncertainty WHEN 'new_pattern' THEN 0.4::DOUBLE WHEN 'quality' THEN least(0.6::DOUBLE, confidence + 0.1::DOUBLE) ELSE confidence END, 9) AS confidence, CASE WHEN uncertainty = 'new_pattern' THEN category END AS alternative, uncertainty FROM u",
        "C14_C15_C16_uncertainty": f"{corpus_cte()}{BASE}{CLASSIFIED}{FACTORS} SELECT doc_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["confidence", *classify.FACTOR_WEIGHTS, "uncertainty_score"]) + ", certain FROM un",
        "G18_uncertainty_summary": f"{corpus_cte()}{BASE}{CLASSIFIED}{FACTORS} " + " UNION ALL ".join(f"SELECT '{k}' AS factor, round(avg({k}), 6) AS avg_score, round(max({k}), 6) AS max_score, count(*) FILTER ({k} > 0.1) AS documents_affected FROM un WHERE NOT certain" for k in classify.FACTOR_WEIGHTS),
        "G19_threshold_sweep": f"{corpus_cte()}{BASE}{CLASSIFIED} SELECT threshold::DOUBLE AS threshold, count(*) FILTER (confidence >= threshold) AS certain, count(*) FILTER (confidence < threshold) AS uncertain FROM k, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(threshold) GROUP BY threshold",
        "G03_G04_quality": f"WITH {RESULTS}, c AS (SELECT coalesce(category, 'none') AS category, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS hi, count(*) FILTER (method = 'fallback') AS fb FROM res GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total_documents, sum(hi)::BIGINT AS high_confidence, sum(fb)::BIGINT AS fallback_documents, count(*) AS total_categories, count(*) FILTER (n < 2) AS one FROM c), u AS (SELECT *, CASE WHEN total_documents <= 10 THEN 0 ELSE one END AS small_categories FROM t), w AS (SELECT *, 100.0::DOUBLE * high_confidence / total_documents AS qs, greatest(0.0::DOUBLE, 100 - small_categories::DOUBLE / total_categories * 100) AS bs, CASE WHEN total_documents <= 5 THEN 40 WHEN total_documents <= 10 THEN 50 WHEN total_documents <= 20 THEN 55 ELSE 60 END AS th FROM u), x AS (SELECT *, (qs + bs) / 2 AS os FROM w) SELECT total_documents, high_confidence, fallback_documents, total_categories, small_categories, round(qs, 6) AS quality_score, round(bs, 6) AS balance_score, round(os, 6) AS overall_score, th AS threshold_used, os >= th AS valid, coalesce(nullif(concat_ws(',', CASE WHEN os < 60 THEN 'below_threshold' END, CASE WHEN fallback_documents > 0 THEN 'review_fallback' END, CASE WHEN one > total_categories * 0.3 THEN 'merge_small' END, CASE WHEN total_categories > 20 THEN 'too_many_categories' END), ''), 'good') AS advice FROM x",
        "G02_G05_G07_methods": f"WITH {RESULTS} SELECT method, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium FROM res GROUP BY method",
        "G01_processing_summary": "WITH a AS (SELECT DISTINCT ON (content_id) * FROM extracted_content), g AS (SELECT *, (coalesce(quality, 'failed') <> 'failed')::INT AS ok FROM a) SELECT 'quality' AS \"by\", coalesce(quality, 'none') AS \"value\", count(*) AS n, round(avg(ok), 6) AS success_share FROM g GROUP BY 2 UNION ALL SELECT 'method', coalesce(extraction_method, 'none'), count(*), round(avg(ok), 6) FROM g GROUP BY 2 UNION ALL SELECT 'kind', coalesce(file_type, 'none'), count(*), round(avg(ok), 6) FROM g GROUP BY 2 UNION ALL SELECT 'total', '', count(*), round(avg(ok), 6) FROM g",
        "G09_X01_distribution": f"{DATED}{DIST} SELECT * FROM ds",
        "G10_L07_X05_peaks": f"{DATED}{DIST} SELECT grain, period, CASE WHEN grain = 'month' THEN ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][period] ELSE 'Q' || period END AS name, n FROM (SELECT *, row_number() OVER (PARTITION BY grain ORDER BY n DESC, period) AS r FROM ds WHERE grain <> 'year') WHERE r = 1",
        "G11_X06_seasonal": f"{DATED}{QUARTERS}, cs AS (SELECT category, sum(c) AS total, count(*) AS qs, stddev_pop(c) / avg(c) AS cv, arg_min(q, -c * 10 + q) AS peak FROM cq GROUP BY category) SELECT category, qs >= 2 AND cv > 0.5 AS pattern_detected, CASE WHEN qs >= 2 THEN round(cv, 6) END AS pattern_strength, CASE WHEN qs >= 2 AND cv > 0.5 THEN 'Q' || peak END AS peak_quarter, CASE WHEN qs >= 2 AND cv > 0.5 THEN {SEASON} END AS seasonal_type FROM cs WHERE total >= 3",
        "G12_overall_season": f"{DATED}, cq AS (SELECT quarter(dt) AS q, count(*) AS c FROM n GROUP BY 1) SELECT 'Q' || arg_min(q, -c * 10 + q) AS peak_quarter, round(max(c) / sum(c) * 100, 6) AS peak_percentage, CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, stddev_pop(c) / avg(c)), 6) END AS seasonal_strength FROM cq",
        "G13_G14_fiscal_inference": f"{DATED}, m AS (SELECT count(*) FILTER (month(dt) IN (3, 4))::DOUBLE AS financial, (count(*) FILTER (month(dt) = 9) * 1.5)::DOUBLE AS academic, count(*) FILTER (month(dt) IN (9, 10))::DOUBLE AS federal, count(*)::DOUBLE / 12 AS calendar, count(DISTINCT month(dt)) AS months FROM n) SELECT round(financial, 6) AS financial, round(academic, 6) AS academic, round(federal, 6) AS federal, round(calendar, 6) AS calendar, CASE WHEN months = 0 THEN 'calendar' WHEN financial >= greatest(academic, federal, calendar) THEN 'financial' WHEN academic >= greatest(federal, calendar) THEN 'academic' WHEN federal >= calendar THEN 'federal' ELSE 'calendar' END AS fiscal_type, round(least(1.0::DOUBLE, months / 12.0::DOUBLE * 2) * 0.3::DOUBLE, 6) AS confidence FROM m",
        "G15_X02_X03_fiscal_structure": f"{DATED}, f AS (SELECT CASE WHEN month(dt) >= 4 THEN year(dt) ELSE year(dt) - 1 END AS fiscal_year, 'FQ' || CAST(floor(((month(dt) + 8) % 12) / 3) + 1 AS INT) AS fiscal_quarter, count(*) AS n FROM n GROUP BY ALL), w AS (SELECT count(*) AS y, avg(s) AS m FROM (SELECT fiscal_year, sum(n) AS s FROM f GROUP BY 1)) SELECT f.*, CASE WHEN y > 3 AND m > 20 THEN 'fiscal_year_quarter' WHEN y > 1 THEN 'fiscal_year_only' ELSE 'fiscal_quarter_only' END AS structure_type FROM f, w",
        "G17_W03_cycles": f"{DATED}, c AS (SELECT category, month(dt) AS m, count(*) AS k FROM n WHERE category IN ('finance', 'law', 'sport', 'money & tax') GROUP BY ALL), s AS (SELECT *, m - lag(m) OVER (PARTITION BY category ORDER BY m) AS step, row_number() OVER (PARTITION BY category ORDER BY k DESC, m) AS r FROM c) SELECT category, CASE WHEN count(DISTINCT step) = 1 THEN 'every_' || min(step) || '_months' ELSE 'variable_cycle' END AS cycle_type, string_agg(CAST(m AS VARCHAR), ',' ORDER BY r) FILTER (r <= 2) AS peak_months FROM s GROUP BY category HAVING sum(k) > 2 AND count(*) >= 3 AND count(DISTINCT step) <= 2",
        "W01_density": f"{DATED}{gap_stats('')} SELECT CASE WHEN sd < m * 0.3 THEN 'regular' WHEN di < k * 0.5 THEN 'periodic' ELSE 'irregular' END AS pattern_type, round(m, 6) AS average_gap_days, round(sd, 4) AS gap_variability FROM gs WHERE k > 0",
        "W02_workflows": f"{DATED}{gap_stats('category')} SELECT category, CASE WHEN NOT sd < m * 0.3 THEN 'irregular' WHEN m BETWEEN 25 AND 35 THEN 'monthly' WHEN m BETWEEN 85 AND 95 THEN 'quarterly' WHEN m BETWEEN 350 AND 380 THEN 'yearly' ELSE 'regular_custom' END AS workflow_type, round(m, 6) AS average_interval_days, CASE WHEN m > 0 THEN round(1 - sd / m, 4) ELSE 0.0 END AS interval_consistency, dates AS document_frequency FROM gs WHERE k > 0",
        "X04_X08_span": f"{DATED}, s AS (SELECT min(dt) AS earliest, max(dt) AS latest, count(*) AS n, date_diff('day', min(dt), max(dt)) AS span_days FROM n) SELECT earliest, latest, n, span_days, round(span_days / 365.25::DOUBLE, 6) AS span_years, CASE WHEN span_days / 365.25 > 3 AND n > 50 THEN 'year-quarter' WHEN span_days / 365.25 > 5 AND n > 100 THEN 'year-month' WHEN span_days / 365.25 < 2 AND n > 20 THEN 'quarter-month' ELSE 'year' END AS time_granularity FROM s",
        "G20_recent_average": f"WITH {SESS} SELECT round(coalesce(avg(quality_score), 0.5), 6) AS recent_quality, count(*) AS sessions FROM ses WHERE session_time >= (SELECT max(session_time) FROM ses) - INTERVAL 30 DAY",
        "G21_W04_learning_metrics": f"WITH {SESS}, r AS (SELECT *, row_number() OVER (ORDER BY session_time DESC NULLS LAST, session_id) AS i FROM ses) SELECT count(*) AS total_sessions, round(coalesce(avg(quality_score), 0.0), 6) AS average_quality_score, round(coalesce(avg(quality_score) FILTER (i <= 10) - avg(quality_score) FILTER (i BETWEEN 11 AND 30), 0.0), 6) AS improvement_trend, (SELECT count(DISTINCT correction_id) FROM user_corrections) AS user_corrections FROM r",
        "G23_successful_patterns": f"WITH {RESULTS} SELECT method, category, count(DISTINCT file_id) AS files, round(max(confidence), 6) AS best FROM res WHERE confidence >= 0.8 GROUP BY method, category",
        "L06_top_patterns": f"WITH {RESULTS}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY confidence DESC, classified_at DESC NULLS LAST, result_id) AS position FROM res WHERE confidence IS NOT NULL) SELECT method, result_id, file_id, confidence, position FROM r WHERE position <= 100",
        "L10_paged_sessions": f"WITH {SESS} SELECT session_id, session_time, quality_score FROM ses ORDER BY session_time DESC NULLS LAST, session_id LIMIT 10 OFFSET 5",
        "S12_J11_session_categories": f"WITH {SESS} SELECT DISTINCT session_id, unnest(categories_created) AS category FROM ses",
        "S14_correction_flow": f"WITH {CORR} SELECT coalesce(from_category, 'none') AS from_category, coalesce(to_category, 'none') AS to_category, count(*) AS n FROM cor GROUP BY ALL",
        "T44_correction_keywords": rf"WITH {CORR} SELECT correction_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(file_name), '[a-z]{{3,}}'))), ',') AS keywords, regexp_matches(lower(file_name), '\d') AS has_digit, regexp_matches(lower(file_name), '\d{{4}}[-_]\d{{2}}') AS has_date FROM cor",
        "P07_reorganise": f"WITH {SESS}, o AS (SELECT avg(quality_score) AS a FROM ses), p AS (SELECT structure_type, count(*) AS n, avg(quality_score) AS m FROM ses GROUP BY 1) SELECT structure_type, n, round((m - a) / a, 6) AS gain, coalesce((m - a) / a >= 0.15, false) AS recommended FROM p, o",
        "J01_matched_paths": f"WITH {RESULTS}, {FILES}, k AS (SELECT file_path AS key, 0 AS rank, file_id FROM fil UNION ALL SELECT file_name, 1, file_id FROM fil UNION ALL SELECT properties['original_path'], 2, file_id FROM fil UNION ALL SELECT CAST(file_id AS VARCHAR), 3, file_id FROM fil), f AS (SELECT key, file_id, row_number() OVER (PARTITION BY key ORDER BY rank, file_id) AS r FROM k WHERE key IS NOT NULL) SELECT result_id, id, f.file_id AS matched_file_id FROM res LEFT JOIN f ON id = key AND r = 1",
        "J02_T09_with_default": f"WITH {FILES}, s AS (SELECT file_id, max(len(text)) AS n FROM extracted_content GROUP BY 1) SELECT fil.file_id, coalesce(n, 0) AS text_length FROM fil LEFT JOIN s USING (file_id)",
        "J03_J04_overridden": f"WITH {RESULTS}, b AS (SELECT file_id, max(category) AS c FROM res GROUP BY 1), w AS (SELECT file_id, upper(max(category)) AS c FROM res WHERE confidence >= 0.8 GROUP BY 1) SELECT b.file_id, coalesce(w.c, b.c) AS category FROM b LEFT JOIN w USING (file_id)",
        "J05_S15_unprocessed": f"WITH {FILES} SELECT file_id FROM fil WHERE file_id NOT IN (SELECT file_id FROM extracted_content WHERE regexp_matches(text, '\\S') AND file_id IS NOT NULL)",
        "J06_U01_new_categories": f"WITH {RESULTS} SELECT DISTINCT lower(trim(category)) AS category FROM res WHERE category IS NOT NULL EXCEPT SELECT subject FROM subject_areas",
        "W05_collisions": rf"WITH {FILES}, m AS (SELECT file_id, 'by_type/' || replace(coalesce(file_extension, 'none'), '.', '') AS folder, file_name AS name FROM fil), r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY file_id) - 1 AS k FROM m), tk AS (SELECT folder, regexp_extract(name, '^(.+?)_([1-9]\d{{0,8}})(\.[^.]*)?$', 1) || regexp_extract(name, '^(.+?)_([1-9]\d{{0,8}})(\.[^.]*)?$', 3) AS name, list(DISTINCT CAST(regexp_extract(name, '^(.+?)_([1-9]\d{{0,8}})(\.[^.]*)?$', 2) AS BIGINT)) AS taken FROM m WHERE regexp_matches(name, '^(.+?)_([1-9]\d{{0,8}})(\.[^.]*)?$') GROUP BY ALL), z AS (SELECT r.*, coalesce(taken, []) AS taken FROM r LEFT JOIN tk USING (folder, name)) SELECT file_id, folder || '/' || regexp_extract(name, '^(.+?)(\.[^.]*)?$', 1) || CASE WHEN k > 0 THEN '_' || (list_filter(range(1, k + len(taken) + 1), lambda x: NOT list_contains(taken, x)))[k] ELSE '' END || regexp_extract(name, '^(.+?)(\.[^.]*)?$', 2) AS target FROM z",
        "W07_last_write": "SELECT content_id, ingested_at, quality FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY ingested_at DESC NULLS LAST, quality DESC NULLS LAST) AS r FROM extracted_content) WHERE r = 1",
        "K07_G08_preview": f"WITH {RESULTS}, d AS (SELECT DISTINCT category, file_id FROM res WHERE category IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY file_id) AS i FROM d) SELECT category, count(*) AS n, string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id) FILTER (i <= 3) AS examples FROM r GROUP BY category",
        "K03_G24_structure": f"WITH {RESULTS}, s AS (SELECT count(*) AS n, coalesce(avg((confidence >= 0.8)::INT), 0.0) AS a FROM res) SELECT n, round(a, 6) AS strong_share, CASE WHEN a >= 0.6 THEN 'category_first' ELSE 'time_first' END AS structure_type, CASE WHEN n > 50 THEN 'month' ELSE 'year' END AS granularity FROM s",
        "T55_K06_folder_checks": rf"{corpus_cte()} SELECT DISTINCT file_name AS name, concat_ws(',', CASE WHEN file_name IS NULL OR trim(file_name) = '' THEN 'empty' END, CASE WHEN len(file_name) > 255 THEN 'too_long' END, CASE WHEN regexp_matches(file_name, '[<>:\"|?*]') THEN 'illegal_character' END, CASE WHEN upper(file_name) IN {RESERVED} THEN 'reserved' END) AS errors FROM corpus",
        "S23_S24_folder_statistics": f"WITH {FILES} SELECT coalesce(file_extension, '') AS extension, count(DISTINCT file_id) AS files, coalesce(sum(file_size), 0)::BIGINT AS bytes, count(DISTINCT regexp_extract(file_path, '^(.*)/[^/]*$', 1)) AS folders, max(len(file_path) - len(replace(file_path, '/', ''))) AS depth FROM fil GROUP BY 1",
        "G25_U05_distinct_categories": f"WITH {RESULTS} SELECT DISTINCT lower(trim(category)) AS category FROM res WHERE category IS NOT NULL",
        "P01_file_validity": f"WITH {FILES} SELECT file_id, coalesce(file_size > 0 AND file_size <= 52428800 AND lower(file_extension) IN ('.pdf', '.txt', '.md', '.png', '.jpg', '.jpeg', '.tiff', '.bmp', '.gif'), false) AS valid FROM fil",
        "P02_scanned": f"WITH {FILES} SELECT file_id, coalesce(content_length, 0) < coalesce(paragraph_count, 1) * 100 AS scanned FROM fil",
        "X10_time_fallback": f"WITH {FILES} SELECT file_id, 'documents_' || coalesce(CAST(year(modification_date) AS VARCHAR), 'undated') AS category, 0.9::DOUBLE AS confidence FROM fil",
        "M07_reference_categories": f"WITH {RESULTS} SELECT category, count(DISTINCT file_id) AS files FROM res WHERE confidence >= 0.7 AND category IS NOT NULL GROUP BY 1",
        "U02_U04_merged_categories": "SELECT category FROM classification_results WHERE category IS NOT NULL UNION SELECT to_category FROM user_corrections WHERE to_category IS NOT NULL UNION SELECT subject FROM subject_areas",
        "G06_method_share": f"WITH {RESULTS} SELECT count(*) FILTER (method = 'ml_enhanced') AS enhanced, round(avg((method = 'ml_enhanced')::INT), 6) AS rate FROM res",
        "T37_clean_settings": f"{corpus_cte()} SELECT doc_id, '[REDACTED]' AS key, CAST(template AS VARCHAR) AS home FROM corpus",
        "T42_token_allowance": on_corpus("doc_id, CAST(greatest(ceil(ceil(len(t) / 2.7::DOUBLE) * 1.3::DOUBLE), 20) AS BIGINT) AS tokens"),
        "S09_placeholder": on_corpus("doc_id, 'Document: ' || file_name || ', Size: ' || len(t) || ' bytes' AS text"),
        "C13_fallback": on_corpus("doc_id, CASE WHEN content IS NULL THEN 'uncategorized' END AS category, CASE WHEN content IS NULL THEN 0.1::DOUBLE END AS confidence"),
        "G31_centroids": "SELECT label, i - 1 AS i, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i",
        "M04_M05_J10_nearest_reference": "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL), s AS (SELECT e.vec_id, c.label, round(sum(v * m) / sqrt(sum(v * v) * sum(m * m)), 9) AS s FROM e JOIN c USING (i) GROUP BY e.vec_id, c.label), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s) SELECT vec_id, label AS nearest, round(s, 6) AS similarity, CASE WHEN s > 0.3 THEN round(greatest(0.4, least(0.9, s)), 6) ELSE 0.4 END AS confidence FROM r WHERE k = 1",
    }
