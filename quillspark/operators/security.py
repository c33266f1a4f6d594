"""Checks and sanitising of names, paths, content, logs and settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names reserved by an operating system.
RESERVED = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]
# Words that a generated name must not hold.
FORBIDDEN_WORDS = ["script", "command", "exec", "run", "javascript", "python"]
MAX_NAME, MIN_NAME = 160, 10
# Phrases of injection attempts, of embedded scripts, of dangerous content and of dangerous paths.
INJECTION = (
    r"ignore\s+(?:previous|all|above)\s+instructions?",
    r"forget\s+(?:previous|all|above)\s+instructions?",
    r"new\s+instructions?",
    r"system\s*:\s*",
    r"assistant\s*:\s*",
    r"user\s*:\s*",
    r"execute\s+(?:command|code|script)",
    r"run\s+(?:command|code|script)",
    r"eval\s*\(",
    r"exec\s*\(",
    r"subprocess\.",
    r"os\.system",
    r"print\s+(?:api|key|token|secret)",
    r"output\s+(?:api|key|token|secret)",
    r"reveal\s+(?:api|key|token|secret)",
    r"show\s+(?:api|key|token|secret)",
    r"```\s*(?:python|bash|sh|cmd)",
    r"<script[^>]*>",
    r"javascript:",
    r"you\s+are\s+(?:now|a)\s+(?:hacker|admin|root)",
    r"act\s+as\s+(?:if\s+you\s+are\s+)?(?:a|an|)\s*(?:hacker|admin|root|administrator)",
    r"pretend\s+(?:to\s+be|you\s+are)",
    r"act\s+like\s+(?:a|an)\s+(?:hacker|admin|root)",
)
NOT_PRINTABLE = r"[\p{C}\p{Z}&&[^ \n\t]]"
SCRIPTS = (r"<script[^>]*>.*?</script>", "javascript:", "vbscript:", "data:text/html", r"eval\s*\(", r"exec\s*\(")
DANGEROUS = (r"<script.*?>.*?</script>", "javascript:", "data:.*base64,", r"on\w+\s*=", r"expression\s*\(", r"@import\s+", r"\\x[0-9a-fA-F]{2}", "%[0-9a-fA-F]{2}")
SUSPICIOUS_PATHS = (r"\.\.[\\/]", "%2e%2e", "%252e%252e", "%00")
SYSTEM_PATHS = ("^/etc/", "^/proc/", "^/sys/", "^/dev/", "^/root/", "^/usr/bin/", "^/usr/sbin/")
# Secrets in log lines in the order in which they are replaced.
LOG_SECRETS = (
    (r"sk-proj-([A-Za-z0-9_-]{3})[A-Za-z0-9_-]{12,}", "sk-proj-$1***"),
    (r"sk-([A-Za-z0-9_-]{3})[A-Za-z0-9_-]{37,}", "sk-$1***"),
    (r"sk-ant-[A-Za-z0-9_-]{15,}", "sk-ant-***"),
    (r"AIza[A-Za-z0-9_-]{30,}", "AIza***"),
    (r"sk-proj-test[A-Za-z0-9_-]+", "sk-proj-test***"),
    (r"sk-ant-test[A-Za-z0-9_-]+", "sk-ant-***"),
)
SECRET_KEYS = ("API_KEY", "SECRET", "TOKEN", "PASSWORD", "PRIVATE_KEY", "AUTH")
# Keywords of documents that act on their own.
INDICATORS = {
    "javascript": "/(?:JS|JavaScript)",
    "open_action": "/OpenAction",
    "additional_actions": "/AA",
    "embedded_files": "/EmbeddedFile",
    "xfa_forms": "/XFA",
    "uri_references": "/URI",
    "submit_form": "/SubmitForm",
    "launch_action": "/Launch",
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once a row however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chosen_name(name: Column) -> Column:
    """A generated name within its limits: allowed characters, 10 to 160 long, cut at a word end, no forbidden words.

    The steps are bound by once(): written into each other they grow to hundreds of copies of the first step, which no
    longer compile.
    """

    def shortened(s: Column) -> Column:
        cut = F.regexp_extract(F.substring(s, 1, MAX_NAME), rf"^(.{{{MIN_NAME},}}[_-])", 1)
        whole = once(cut, lambda c: F.when(c != "", c).otherwise(F.substring(s, 1, MAX_NAME)))
        return F.when(F.length(s) > MAX_NAME, F.regexp_replace(whole, "[_-]+$", "")).otherwise(s)

    def allowed(s: Column) -> Column:
        def words(low: Column) -> Column:
            out = s
            for w in FORBIDDEN_WORDS:  # each word replaces in the lower-cased name as it was before
                out = F.when(F.contains(low, F.lit(w)), F.replace(low, F.lit(w), F.lit("content"))).otherwise(out)
            return out

        return once(F.lower(s), words)

    s = F.regexp_replace(F.trim(name), "^['\"`]+|['\"`]+$", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_-]", "_"), "_{2,}", "_"), "^_+|_+$", "")
    s = once(s, lambda x: F.when(F.length(x) < MIN_NAME, F.concat(F.lit("document_"), x)).otherwise(x))
    s = once(once(once(s, shortened), allowed), lambda x: F.when(x == "", "document").otherwise(x))
    return F.when(name.isNull() | (name == ""), "unnamed_document").otherwise(s)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")


def safe_name(name: Column) -> Column:
    """A name usable on every platform: marks replaced, controls dropped, reserved names prefixed, at most 255 long."""
    s = F.regexp_replace(F.regexp_replace(name, r'[<>:"|?*\\/]', "_"), "[\\x00-\\x1f\\x7f-\\x9f]", "")
    s = F.when(F.upper(stem(s)).isin(*RESERVED), F.concat(F.lit("file_"), s)).otherwise(s)
    ext = F.regexp_extract(s, r"[^.](\.[^.]*)$", 1)
    s = F.when(F.length(s) > 255, F.concat(s.substr(F.lit(1), 255 - F.length(ext)), ext)).otherwise(s)
    return F.when(name.isNull() | (name == ""), "unnamed_file").when(F.trim(s) == "", "sanitized_file").otherwise(s)


def checked_name(name: Column) -> Column:
    """A name with unsafe characters removed, or null where it is empty, reserved or nothing is left."""
    s = F.regexp_replace(F.substring(name, 1, MAX_NAME), r"[^a-zA-Z0-9._\-\s]", "")
    reserved = F.upper(s).isin(".", "..", *RESERVED)
    s = F.regexp_replace(s, "^[. ]+|[. ]+$", "")
    return F.when(reserved | (s == ""), None).otherwise(s)


def any_of(patterns) -> str:
    return "|".join(patterns)


def model_input(text: Column) -> Column:
    """(status, text): content cut to 4096, refused where it tries to give instructions, else printable and on one line."""
    cut = F.substring(F.coalesce(text, F.lit("")), 1, 4096)
    bad = cut.rlike("(?iu)" + any_of(INJECTION))
    return F.struct(F.when(bad, "refused").otherwise("ok").alias("status"), F.when(~bad, F.trim(F.regexp_replace(F.regexp_replace(cut, NOT_PRINTABLE, ""), r"\s+", " "))).alias("text"))


def script_check(text: Column) -> Column:
    """(status, text): content cut to 8192; where it holds scripts it goes on whole, with a warning."""
    cut = F.substring(F.coalesce(text, F.lit("")), 1, 8192)
    bad = cut.rlike("(?isu)" + any_of(SCRIPTS))
    return F.struct(F.when(bad, "warned").otherwise("ok").alias("status"), F.when(bad, text).otherwise(cut).alias("text"))


def without_dangers(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for p in DANGEROUS:
        out = F.regexp_replace(out, "(?isu)" + p, "[REMOVED]")
    out = F.regexp_replace(F.regexp_replace(out, "\r\n|\r", "\n"), r"\n\s*\n\s*\n", "\n\n")
    return F.regexp_replace(out, "[ \t]+", " ")


def clean_log(line: Column) -> Column:
    for p, r in LOG_SECRETS:
        line = F.regexp_replace(line, p, r)
    return line


def clean_settings(settings: Column) -> Column:
    """A map of settings with the values of secret keys redacted."""
    return F.transform_values(settings, lambda k, v: F.when(F.upper(k).rlike("|".join(SECRET_KEYS)), "[REDACTED]").otherwise(v))


def path_verdict(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(p.rlike("(?i)" + any_of(SUSPICIOUS_PATHS)), "suspicious")
        .when(p.rlike("(?i)" + any_of(SYSTEM_PATHS)), "system")
        .otherwise("ok")
    )


def indicators(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {k: F.regexp_count(t, F.lit(p + r"\b")).cast("bigint") for k, p in INDICATORS.items()}


def threat_level(n: dict[str, Column]) -> Column:
    high = (n["javascript"] > 0).cast("int") + (n["launch_action"] > 0).cast("int") * 2 + (n["embedded_files"] > 0).cast("int")
    medium = sum(((n[k] > 0).cast("int") for k in ("open_action", "additional_actions", "uri_references", "submit_form", "xfa_forms")), F.lit(0))
    return F.when(high >= 2, "high").when((high >= 1) | (medium >= 3), "medium").when(medium >= 1, "low").otherwise("safe")


# How the summary names each indicator, in order.
THREAT_NAMES = (
    ("javascript", "JavaScript code"),
    ("launch_action", "Launch actions"),
    ("embedded_files", "Embedded files"),
    ("open_action", "Auto-open actions"),
    ("uri_references", "External URI references"),
    ("submit_form", "Form submissions"),
)


def threat_summary(n: dict[str, Column], level: Column) -> Column:
    named = F.array_compact(F.array(*[F.when(n[k] > 0, F.concat(F.lit(name + " ("), n[k].cast("string"), F.lit(" instances)"))) for k, name in THREAT_NAMES]))
    some = F.concat(F.lit("Potential threats detected: "), F.array_join(named, ", "))
    return F.when(level == "safe", "PDF appears safe - no suspicious indicators detected").when(F.size(named) > 0, some).otherwise(F.concat(F.lit("PDF has "), level, F.lit(" risk indicators")))


def threats(df: DataFrame) -> DataFrame:
    """Counts of the indicators, threat level and summary. Content that cannot be read (null) has level 'low', not 'safe'."""
    n = indicators(F.col("content"))
    counted = df.select("doc_id", *[c.alias(k) for k, c in n.items()], F.col("content").isNull().alias("unread"))
    n = {k: F.col(k) for k in n}
    level = F.when(F.col("unread"), "low").otherwise(threat_level(n))
    return counted.select("doc_id", *n, level.alias("threat_level"), F.when(F.col("unread"), "PDF has low risk indicators").otherwise(threat_summary(n, level)).alias("summary"))
