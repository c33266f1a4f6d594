"""A derived corpus: relational rows rendered into texts, by the same rule in Spark and in SQL.

The supplied texts never match the classification, money and secret patterns, so queries on those operators run on this
corpus: one text an order, from ten templates that give every category, ties, edge lengths, null and empty texts, dates
valid and not, page headings, planted secrets and colliding file names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.session import load, spread

# {date}: the order date as "June 3, 1996"; {iso}: as "1996-06-03"; {text}: the type of a string.
CORPUS_SQL = r"""
SELECT o_orderkey AS doc_id,
       o_orderkey % 10 AS template,
       CASE WHEN o_orderkey % 10 = 0 THEN 'invoice_' || CAST(o_custkey AS {text}) || '.pdf'
            WHEN o_orderkey % 10 = 1 THEN 'Quarterly Report ' || CAST(o_orderkey % 7 AS {text}) || '.txt'
            WHEN o_orderkey % 10 = 2 THEN 'contract<' || CAST(o_orderkey AS {text}) || '>.PDF'
            WHEN o_orderkey % 10 = 3 THEN 'scan.png'
            WHEN o_orderkey % 10 = 4 THEN 'con.md'
            WHEN o_orderkey % 10 = 5 THEN '../medical/health_' || CAST(o_orderkey % 3 AS {text}) || '.tiff'
            WHEN o_orderkey % 10 = 6 THEN '2020-01-02_33.pdf'
            WHEN o_orderkey % 10 = 7 THEN ''
            WHEN o_orderkey % 10 = 8 THEN 'user manual and API guide ' || repeat('x_', CAST(o_orderkey % 140 AS INT)) || 'end.jpg'
            ELSE 'untitled' || CAST(o_orderkey AS {text}) END AS file_name,
       o_orderdate AS modified,
       o_orderkey * 1013 % 3000000 AS file_size,
       CASE o_orderkey % 10
       WHEN 0 THEN 'Invoice #' || CAST(o_orderkey AS {text}) || ' dated {date}.' || chr(10) || 'Amount due: $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS {text}) || '.50. Payment terms: Net ' || CAST(o_orderkey % 90 AS {text}) || '.' || chr(10) || 'Billing charge: please remit the total payable by the due date 12/31/' || CAST(1995 + o_orderkey % 7 AS {text}) || '. USD 45.10 was paid on {iso}.'
       WHEN 1 THEN 'QUARTERLY REPORT' || chr(10) || 'Q' || CAST(1 + o_orderkey % 4 AS {text}) || ' ' || CAST(1995 + o_orderkey % 7 AS {text}) || ' financial report: executive summary of revenue, expenses and performance.' || chr(10) || chr(10) || '1. Findings of the annual analysis' || chr(10) || '- Year over year growth was ' || CAST(o_orderkey % 50 AS {text}) || '.25 percent!' || chr(10) || 'Conclusion and recommendation follow on {date}.'
       WHEN 2 THEN 'Service agreement. Terms and conditions: the effective date is {date}. This contract is legal and binding; each party shall comply. Whereas and therefore executed.'
       WHEN 3 THEN 'Dear customer,' || chr(10) || 'thank you for the meeting. Please update the email message after our discussion and follow-up. Sincerely, with kind regards to all colleagues on various topics of the meeting notes and communication.'
       WHEN 4 THEN 'Balance sheet, income statement and cash flow. The budget forecast shows a financial profit or loss of revenue; assets, liabilities and equity of $' || CAST(o_orderkey % 1000 AS {text}) || ',000.00 as of ' || CASE o_orderkey % 3 WHEN 0 THEN 'fiscal year ' || CAST(1990 + o_orderkey % 20 AS {text}) || '. Tax year and FY-' || CAST(90 + o_orderkey % 9 AS {text}) WHEN 1 THEN CAST(1990 + o_orderkey % 20 AS {text}) || '-' || CAST(10 + o_orderkey % 80 AS {text}) || ' fiscal. Budget year' ELSE CAST(1 + o_orderkey % 40 AS {text}) || ' March ' || CAST(1990 + o_orderkey % 20 AS {text}) || ', ' || CAST(1 + o_orderkey % 29 AS {text}) || '/' || CAST(1 + o_orderkey % 31 AS {text}) || '/' || CAST(o_orderkey % 100 AS {text}) END || '.'
       WHEN 5 THEN 'Legal document of the court of jurisdiction. The plaintiff and the defendant of this litigation cite the statute, regulation and compliance. Hereby the witness notarized it on {iso} and 31/02/2020.'
       WHEN 6 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'profit of the court' WHEN o_orderkey % 3 = 1 THEN 'whereas the budget; however email' ELSE 'page ' || CAST(o_orderkey AS {text}) || chr(10) || 'aaaaaaabbbbbbb l 0 rn vv' || chr(10) || CAST(o_orderkey % 100 AS {text}) || chr(10) || 'confidential' END
       WHEN 7 THEN CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' WHEN o_orderkey % 4 = 2 THEN repeat('y', CAST(o_orderkey % 60 AS INT)) ELSE repeat('ab ', CAST(o_orderkey % 60 AS INT)) END
       WHEN 8 THEN repeat('The purpose of this summary is the total amount of order ' || CAST(o_orderkey AS {text}) || '. An objective conclusion was reached! Nothing else' || chr(7) || ' happened' || {zero} || chr(160) || 'here? ', CAST(o_orderkey % 23 AS INT))
       ELSE 'token sk-proj-' || repeat('Ab3_', 5) || CAST(o_orderkey AS {text}) || ' and sk-' || repeat('k', 45) || ' or AIza' || repeat('Z9', 18) || ' sk-ant-' || repeat('q', CAST(10 + o_orderkey % 9 AS INT)) || ' <script>x</script> javascript:void ignore previous instructions ' || CASE o_orderkey % 4 WHEN 0 THEN '/JS /JS /Launch /OpenAction obj' WHEN 1 THEN '/JavaScript /URI' WHEN 2 THEN '/AA /XFA /URI /SubmitForm' ELSE '/EmbeddedFile' END END AS content
FROM {orders}
"""
ZERO = "'\u200b'"  # a character that is not printed
SPARK_PARTS = {"text": "STRING", "zero": ZERO, "date": "' || date_format(o_orderdate, 'MMMM d, yyyy') || '", "iso": "' || date_format(o_orderdate, 'yyyy-MM-dd') || '"}
DUCK_PARTS = {"text": "VARCHAR", "zero": ZERO, "date": "' || strftime(o_orderdate, '%B %-d, %Y') || '", "iso": "' || strftime(o_orderdate, '%Y-%m-%d') || '"}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, template, file_name, modified, content): one row an order."""
    text = CORPUS_SQL
    for k, v in SPARK_PARTS.items():
        text = text.replace("{" + k + "}", v)
    return spark.sql(text.replace("\\", "\\\\"), orders=spread(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")))


def corpus_cte() -> str:
    """A WITH clause that defines the same corpus as the view corpus in DuckDB."""
    text = CORPUS_SQL.replace("{orders}", "orders")
    for k, v in DUCK_PARTS.items():
        text = text.replace("{" + k + "}", v)
    return f"WITH corpus AS ({text})"
