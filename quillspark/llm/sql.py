"""DuckDB counterparts of the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

from quillspark.llm.textkind import COMMON_WORDS

# Every pair that shares a shingle is counted; the whole sets decide. No prefix, signature or tree is used here.
P4 = r"""
WITH t AS (SELECT file_id, max(lower(text)) AS t FROM extracted_content WHERE regexp_matches(text, '\S') GROUP BY 1),
w AS (SELECT file_id, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w FROM t),
n AS (SELECT DISTINCT file_id, regexp_replace(regexp_replace(lower(file_name), '\.[^.]*$', ''), '[^\p{L}\p{N}]', '', 'g') AS s
      FROM document_metadata WHERE file_id NOT IN (SELECT file_id FROM t)),
g AS (SELECT DISTINCT 't' AS kind, file_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w
      UNION ALL
      SELECT DISTINCT 'n', file_id, unnest(list_transform(range(1, len(s) - 1), lambda i: s[i:i + 2])) FROM n),
c AS (SELECT kind, file_id, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT a.kind, a.file_id AS a, b.file_id AS b, count(*) AS i FROM g a JOIN g b ON a.kind = b.kind AND a.g = b.g AND a.file_id < b.file_id GROUP BY ALL)
SELECT p.a AS file_id_a, p.b AS file_id_b FROM p JOIN c x ON x.file_id = p.a AND x.kind = p.kind JOIN c y ON y.file_id = p.b AND y.kind = p.kind
WHERE i * 5 >= (x.n + y.n - i) * 3
"""

# The statistics of a text from the text itself; the kinds of text are not expressible here.
P1_STATS = r"""
WITH t AS (SELECT DISTINCT file_id, text, regexp_extract_all(text, '\S+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM extracted_content WHERE regexp_matches(text, '\S'))
SELECT DISTINCT file_id, len(w) AS words, len(l) AS lines, len(regexp_replace(text, '[^.!?]', '', 'g')) AS marks,
 round(list_sum(list_transform(w, lambda x: len(x))) / len(w), 6) AS mean_word_length,
 round(len(regexp_replace(text, '[^{}<>^~\\=*&%§]', '', 'g')) / len(text), 6) AS symbol_ratio,
 round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?]\s*$'))) / len(l), 6) AS ended_line_share,
 round(len(list_filter(w, lambda x: list_contains(COMMON, lower(x)))) / len(w), 6) AS common_word_share
FROM t
""".replace("COMMON", "[" + ", ".join(f"'{w}'" for w in sorted(COMMON_WORDS)) + "]")


# Links a file, 0 for those alone: from all pairs, without classes.
P4_LINKS = f"""
WITH found AS ({P4}), every AS (
 SELECT DISTINCT file_id FROM (SELECT file_id, max(lower(text)) AS t FROM extracted_content WHERE regexp_matches(text, '\\S') GROUP BY 1) WHERE len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) >= 3
 UNION SELECT DISTINCT file_id FROM document_metadata WHERE file_id NOT IN (SELECT file_id FROM extracted_content WHERE regexp_matches(text, '\\S'))
   AND len(regexp_replace(regexp_replace(lower(file_name), '\\.[^.]*$', ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3),
l AS (SELECT file_id_a AS file_id FROM found UNION ALL SELECT file_id_b FROM found)
SELECT file_id, count(l.file_id) AS links FROM every LEFT JOIN l USING (file_id) GROUP BY file_id
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4, "p4_links": P4_LINKS, "p1_stats": P1_STATS}
