"""Problem 1: per-document text quality statistics.

Method: documents are split into chunks, each chunk gets an associative partial summary whose boundary state (a bounded
part of the unfinished first and last line, with counters of the rest) corrects the cut, summaries merge through a tree of
fan-in 16, and ratios and rule outcomes are derived from the merged counters. A document of one chunk is a tree of one leaf.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkind as K

CHUNK_CHARS = 1 << 18  # texts up to this length are one chunk
FAN_IN = 16  # summaries merged by one node of the tree
LEVELS = 3  # of inner nodes below the root: 16^4 chunks, more than the longest string has

STATS_SCHEMA = (
    "file_id bigint, kind string, words bigint, word_chars bigint, marks bigint, chars bigint, lines bigint, common bigint, plain bigint, symbols bigint, ended_lines bigint, sentence_ends bigint, "
    "mean_word_length double, symbol_ratio double, ended_line_share double, common_word_share double, readability double"
)


def _stats_row(c: list[int]) -> tuple:
    words, lines = c[0] or None, c[4] or None
    ratios = (c[1] / words if words else None, c[8] / c[3] if c[3] > 0 else None, c[16] / lines if lines else None, c[5] / words if words else None)
    return (K.kind(c), c[0], c[1], c[2], c[3], c[4], c[5], c[6], c[8], c[16], c[10], *ratios, K.readability(c))


def _frame(ids, rows) -> pd.DataFrame:
    names = [x.split()[0] for x in STATS_SCHEMA.split(", ")]
    return pd.DataFrame([(i, *r) for i, r in zip(ids, rows)], columns=names)


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield _frame(b.file_id, (_stats_row(K.Summary.of(t).close()) for t in b.text))


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"copy": b.copy_id, "file_id": b.file_id, "chunk": b.chunk, "state": [pickle.dumps(K.Summary.of(t).state()) for t in b.text]})


def _merge(part: pd.DataFrame) -> K.Summary:
    out = None
    for blob in part.sort_values("chunk").state:
        s = K.Summary.from_state(pickle.loads(blob))
        out = s if out is None else out.merge(s)
    return out


def _node(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"copy": [part["copy"].iloc[0]], "file_id": [part.file_id.iloc[0]], "chunk": [part.chunk.min() // FAN_IN], "state": [pickle.dumps(_merge(part).state())]})


def _root(part: pd.DataFrame) -> pd.DataFrame:
    return _frame([part.file_id.iloc[0]], [_stats_row(_merge(part).close())])


def text_stats(texts: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Statistics of each row's text as a whole: counts, readability score and the kind of text.

    texts: (file_id bigint, text string); further columns are ignored. One row a text with at least one word. Null and
    empty texts and texts of white space give no row; repeated rows give repeated rows. Texts longer than chunk_chars are
    cut into chunks that are spread over the cluster and merged through a tree of fan-in 16; the result does not depend
    on the place of the cuts, and no state grows with the length of a line or a word.
    """
    texts = texts.select("file_id", "text").filter(F.col("text").isNotNull() & F.col("file_id").isNotNull())
    short = texts.filter(F.length("text") <= chunk_chars).mapInPandas(_leaves, STATS_SCHEMA)
    chunk = "copy_id bigint, file_id bigint, chunk bigint, state binary"
    cut = (
        texts.filter(F.length("text") > chunk_chars)
        .withColumn("copy_id", F.xxhash64("text"))
        .select(
            "copy_id",
            "file_id",
            F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk_chars).cast("int")), lambda i: F.substring("text", i * chunk_chars + 1, F.lit(chunk_chars)))).alias("chunk", "text"),
        )
        .distinct()
        .repartition(F.col("file_id"), F.col("chunk"))
        .mapInPandas(_partial, chunk.replace("copy_id", "copy"))
    )
    for _ in range(LEVELS):
        cut = cut.groupBy("copy", "file_id", F.floor(F.col("chunk") / FAN_IN).alias("node")).applyInPandas(_node, chunk.replace("copy_id", "copy"))
    long = cut.groupBy("copy", "file_id").applyInPandas(_root, STATS_SCHEMA)
    return short.unionByName(long).filter("words > 0")


def quality_findings(texts: DataFrame, metadata: DataFrame) -> DataFrame:
    """(file_id, kind): texts that are lists, tables or junk, and recorded counts or scores that are wrong.

    A file without metadata gives only its text kind. A recorded word_count is wrong if null or different, a recorded
    readability_score if null, not a number or more than 0.5 off. Distinct rows; empty inputs give an empty result.
    """
    stats = text_stats(texts).select("file_id", "kind", "words", "readability").distinct()
    recorded = metadata.select("file_id", "word_count", "readability_score", F.lit(True).alias("known"))
    both = stats.join(recorded, "file_id", "left")
    score = F.col("readability_score")
    wrong_count = F.col("known") & (F.col("word_count").isNull() | (F.col("word_count") != F.col("words")))
    wrong_score = F.col("known") & (score.isNull() | F.isnan(score) | (F.abs(score - F.col("readability")) > 0.5))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("kind").isin("list", "table", "junk"), F.col("kind")),
            F.when(wrong_count, F.lit("word_count")),
            F.when(wrong_score, F.lit("readability")),
        )
    )
    return both.select("file_id", F.explode(kinds).alias("kind")).distinct()
