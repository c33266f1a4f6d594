"""Problem 9: mixing sources to target weights.

Method: Sainte-Laguë apportionment. The mix is cut into equal-token blocks that go to the sources by highest quotients,
each source's blocks go to its groups of shards and from there to the shards the same way, and every shard fills its
quota in a seeded order. Shards have a fixed size, so there are more of them in a larger corpus and none grows.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.tokenizer import token_counts
from quillspark.session import materialise

BLOCKS = 1 << 14  # equal-token blocks of the whole mix, and at least BLOCKS_A_SHARD for every shard
BLOCKS_A_SHARD = 16
SHARD_TOKENS = 2_000_000  # aimed at; the number of shards follows the corpus
MAX_GROUPS = 4096  # groups of shards: at most MAX_GROUPS rows a source reach the driver, the shards of a group one task
SEED = 20_240_117


def sainte_lague(weights: dict, seats: int, limits: dict | None = None) -> dict:
    """Seats for each key by highest quotients weight / (2 n + 1); a key stops at its limit. Ties go to the smaller key.

    The fair integer part is given out first, so that only the last seats need the heap.
    """
    total = sum(w for w in weights.values() if w > 0)
    out = dict.fromkeys(weights, 0)
    if total <= 0 or seats <= 0:
        return out
    cap = {k: (seats if limits is None else max(0, limits.get(k, 0))) for k in weights}
    # a key holds at least floor(share - 1) seats under highest quotients with odd divisors when none is limited
    for k, w in weights.items():
        if w > 0 and limits is None:
            out[k] = max(0, int(seats * w / total) - len(weights))
    heap = [(-w / (2 * out[k] + 1), k) for k, w in weights.items() if w > 0 and out[k] < cap[k]]
    heapq.heapify(heap)
    left = seats - sum(out.values())
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        out[k] += 1
        left -= 1
        if out[k] < cap[k]:
            heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), k))
    return out


def spread_quota(held: dict, quota: float, block: float, repeats: int) -> dict:
    """Tokens for each key: whole blocks by Sainte-Laguë on what the keys hold, none above repeats times that.

    What the limits or the rounding to blocks leave over goes to the keys that still have room, in proportion to it.
    """
    seats = sainte_lague(held, int(quota / block), {k: int(n * repeats / block) for k, n in held.items()})
    out = {k: min(seats[k] * block, float(n * repeats)) for k, n in held.items()}
    left = quota - sum(out.values())
    room = sum(n * repeats - out[k] for k, n in held.items())
    if left > 0 and room > 0:
        part = min(1.0, left / room)
        out = {k: out[k] + part * (n * repeats - out[k]) for k, n in held.items()}
    return out


def source_name(column: str = "source"):
    """The source however it is spelled: lower case without outer white space."""
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = BLOCKS, seed: int = SEED, shard_tokens: int = SHARD_TOKENS, max_groups: int = MAX_GROUPS) -> tuple[DataFrame, DataFrame]:
    """(chosen documents, report of shares).

    docs: (doc_id, text, source); targets: (source, target_share, max_repeats), a small table of which only its sources
    count; further columns are ignored. Chosen: (doc_id, source, n_tokens, copies) with 1 <= copies <= max_repeats. Report:
    (source, target_share, max_repeats, available_tokens, mixed_tokens, actual_share, highest_repeat).

    total_tokens defaults to the largest mix in which no source with tokens falls short of its share. A source without
    tokens cannot contribute: it is reported with share 0 and the others keep their proportions. Documents of null or
    unknown source and documents without tokens are not mixed. Repeated rows of a doc_id count once. Empty tables give an
    empty mix; a null share counts as 0, null max_repeats as 1.
    """
    spark = docs.sparkSession
    named = docs.select("doc_id", "text", source_name().alias("source")).filter("source is not null and doc_id is not null")
    wanted = [
        r for r in targets.select(source_name().alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats")).filter("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats")).orderBy("source").collect()
    ]  # one row a source
    names = [r.source for r in wanted]
    share, repeats = {r.source: float(r.share) for r in wanted}, {r.source: int(r.repeats) for r in wanted}
    counted = token_counts(named.filter(F.col("source").isin(names)), ["doc_id", "source"]).filter("n_tokens > 0")
    counted = materialise(counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")), "mix-counts")

    corpus = counted.agg(F.sum("n_tokens")).collect()[0][0] or 0
    shards = max(1, -(-corpus // shard_tokens))
    wide = max(1, -(-shards // max_groups))  # shards a group
    groups = -(-shards // wide)
    sharded = counted.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards))).withColumn("group", F.floor(F.col("shard") / wide))
    in_shards = sharded.groupBy("source", "group", "shard").agg(F.sum("n_tokens").alias("n"))
    held: dict[str, dict[int, int]] = {s: {} for s in names}
    for r in in_shards.groupBy("source", "group").agg(F.sum("n").alias("n")).collect():
        held[r.source][r.group] = r.n
    available = {s: sum(held[s].values()) for s in names}
    live = [s for s in names if available[s] > 0 and share[s] > 0 and repeats[s] > 0]
    scale = sum(share[s] for s in live)
    if total_tokens is None:
        total_tokens = int(min((available[s] * repeats[s] * scale / share[s] for s in live), default=0))
    block = max(1.0, total_tokens / max(blocks, BLOCKS_A_SHARD * groups))
    quota = sainte_lague({s: share[s] for s in live}, int(total_tokens / block), {s: int(available[s] * repeats[s] / block) for s in live})
    rows = [(s, g, q) for s in live for g, q in spread_quota(held[s], quota[s] * block, block, repeats[s]).items()]
    given = spark.createDataFrame(rows, "source string, group bigint, quota double")
    capped = spark.createDataFrame([(s, repeats[s]) for s in live], "source string, repeats bigint")

    def divide(part: pd.DataFrame) -> pd.DataFrame:
        """The quota of a group of shards over its shards, the same way; a group holds at most as many shards as wide."""
        mine, most = dict(zip(part.shard.tolist(), part.n.tolist())), int(part.repeats.iloc[0])
        fine = max(1.0, float(part.quota.iloc[0]) / (BLOCKS_A_SHARD * len(mine)))
        out = []
        for k, q in spread_quota(mine, float(part.quota.iloc[0]), fine, most).items():
            whole = min(int(q // mine[k]), most)
            out.append((part.source.iloc[0], k, whole, q - whole * mine[k] if whole < most else 0.0))
        return pd.DataFrame(out, columns=["source", "shard", "whole", "rest"])

    quotas = in_shards.join(given, ["source", "group"]).join(capped, "source").groupBy("source", "group").applyInPandas(divide, "source string, shard bigint, whole int, rest double")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    placed = sharded.withColumn("before", F.sum("n_tokens").over(order) - F.col("n_tokens")).join(quotas, ["source", "shard"])
    # a block ends inside a document: that document is taken if more than half of it lies before the end
    extra = (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int")
    chosen = placed.select("doc_id", "source", "n_tokens", (F.col("whole") + extra).cast("bigint").alias("copies")).filter("copies > 0")
    totals = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("highest_repeat"))
    base = spark.createDataFrame([(s, share[s], repeats[s], available[s]) for s in names], "source string, target_share double, max_repeats bigint, available_tokens bigint")
    both = base.join(totals, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0))).withColumn("highest_repeat", F.coalesce("highest_repeat", F.lit(0)))
    everything = F.sum("mixed_tokens").over(Window.partitionBy())  # over one row a source
    report = both.withColumn("actual_share", F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(F.lit(0.0)))
    return chosen, report.select("source", "target_share", "max_repeats", "available_tokens", "mixed_tokens", "actual_share", "highest_repeat")
