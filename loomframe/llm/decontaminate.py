"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask keeps some of a few consecutive tokens and ignores the others, so a seed survives
substitutions at ignored places; whatever substitutions LEAST_SHARE allows, a seed of one
of the masks survives them. Seeds of benchmark items and of documents are hashed
and joined; each hit names a diagonal (place in the document minus place in the item), along
which tokens are compared. An item is found in a document if a window of WINDOW tokens of
the item (all of it, if shorter) has LEAST_SHARE of its tokens in place; an item of under
LEAST_TOKENS tokens must have all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import cut, small, table

#: Kept places of each mask, the first and last among them. For a window of 9 to 16 tokens with any quarter of them substituted, a mask fits at some place: a test goes through all.
MASKS = ("11101", "100111")
WINDOW, LEAST_SHARE = 16, 0.75
#: Tokens of an item from which substitutions are tolerated; a shorter one is found where all its tokens stand.
LEAST_TOKENS = 9
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def seeds(rows: DataFrame, key: str, text: str, masks: dict[int, tuple[str, int, int]]) -> DataFrame:
    """key, place and seed (hash of mask and kept tokens) of every place of every mask.

    masks has by number what a mask keeps, and the least and most tokens of texts that it is laid on; texts shorter than a mask have none of it.
    """
    hashed = rows.select(F.col(key).alias("key"), F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("h"))

    def one(number: int, mask: str, least: int, most: int) -> Column:
        kept = [k for k, c in enumerate(mask) if c == "1"]
        return F.when(F.size("h").between(max(least, len(mask)), most), F.transform(F.sequence(F.lit(0), F.size("h") - len(mask)), lambda i: F.struct(i.alias("place"), F.xxhash64(F.lit(number), *[F.get("h", i + k) for k in kept]).alias("seed")))).otherwise(F.array())

    return hashed.select("key", F.explode(F.concat(*[one(k, *m) for k, m in masks.items()])).alias("at")).select("key", "at.seed", "at.place")


#: No text has more tokens.
ANY = 2**31 - 1


def masks_of(items: DataFrame) -> tuple[dict, dict]:
    """Masks for items and for documents: MASKS for items of LEAST_TOKENS tokens, and for each length of shorter ones a mask that keeps all."""
    sizes = items.select(F.size(tokens(F.col("text"))).alias("n")).where(F.col("n").between(1, LEAST_TOKENS - 1)).distinct().collect()  # a few numbers below LEAST_TOKENS
    own = {k: (m, LEAST_TOKENS, ANY) for k, m in enumerate(MASKS)} | {100 + r.n: ("1" * r.n, r.n, r.n) for r in sizes}
    return own, {k: (m, 1, ANY) for k, (m, _, _) in own.items()}


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item (tokens of the item), n_window, n_matched (the best window) and share of every item found in a document.

    docs has doc_id and text, benchmark item_id and text; the whole of both is searched. Null and empty texts are found nowhere
    and hold nothing. Items of under LEAST_TOKENS tokens are found where all their tokens stand in a row; of the others, every match is found. Rows with a null id are left out. Rows that share an id count as
    one with the best match of any.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    items = benchmark.select("item_id", "text").where("item_id is not null")
    for_items, for_docs = masks_of(items)
    known = cut(seeds(items, "item_id", "text", for_items).select(F.col("key").alias("item_id"), "seed", F.col("place").alias("item_place")).distinct())
    hits = seeds(docs, "doc_id", "text", for_docs).join(small(known), "seed").select(F.col("key").alias("doc_id"), "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    hits = cut(hits)
    held = docs.join(small(hits), "doc_id").select("doc_id", "item_id", "diagonal", tokens(F.col("text")).alias("own"))
    size = F.size("want")
    same = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.when((k + F.col("diagonal") >= 0) & (F.get("want", k) == F.get("own", F.greatest(k + F.col("diagonal"), F.lit(0)))), 1).otherwise(0))
    wide = F.least(F.lit(WINDOW), size)
    pairs = held.join(items.select("item_id", tokens(F.col("text")).alias("want")), "item_id").select("doc_id", "item_id", size.alias("n_item"), wide.alias("n_window"), same.alias("same"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n_item") - F.col("n_window") + 1), lambda k: F.aggregate(F.slice("same", k, F.col("n_window")), F.lit(0), lambda s, x: s + x)))
    scored = pairs.select("doc_id", "item_id", "n_item", "n_window", best.alias("n_matched")).withColumn("share", F.col("n_matched") / F.col("n_window")).where(F.col("share") >= F.when(F.col("n_item") < LEAST_TOKENS, 1.0).otherwise(LEAST_SHARE))
    top = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "n_matched", "n_item", "n_window")).alias("x"))
    return top.select("doc_id", "item_id", "x.n_item", "x.n_window", "x.n_matched", "x.share")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: drops every document in which an item is found."""
    found = find(docs, benchmark).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs["doc_id"] == F.col("__found"), "left_anti")
