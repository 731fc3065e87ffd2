"""Line dedup: explode normalised lines, hash, count distinct documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.plans.durable import broadcast_if_small, discard, materialize

from .common import ascii_lower

#: What is stripped at both ends of a line: space and 0x09 to 0x0D.
BLANK = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(BLANK))


def _hash(key: Column) -> Column:
    """128 bits: two 64-bit hashes of the key under different seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, kept, n_lines, n_dropped)``: ``docs`` without its repeated lines.

    A line's key is the line stripped of ASCII blanks with A-Z folded.  Keys of at least ``min_chars`` code points that
    at least ``min_docs`` distinct documents hold lose all lines except in the holder with the largest ``doc_id``.

    Null or empty text is one empty line.  Rows repeating a ``doc_id`` count once and are each judged; a row with a
    null ``doc_id`` counts for no key and keeps its lines.  Extra columns are ignored, an empty table gives no rows.

    Keys are compared by 128 bits of hash.  Only hashes and positions move for the counting, pre-aggregated per task;
    lines of a key that very many documents hold are spread by AQE or meet a broadcast of the repeated keys.  Texts move
    once, to their dropped positions.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("lines")
    )
    keys = F.transform("lines", lambda x, i: F.struct(i.alias("pos"), _key(x).alias("key")))
    long_keys = F.transform(F.filter(keys, lambda k: F.char_length(k.key) >= min_chars), lambda k: F.struct(k.pos.alias("pos"), _hash(k.key).alias("h")))
    held = rows.where("doc_id is not null").select("doc_id", "t", F.explode(long_keys).alias("k")).select("doc_id", "t", "k.pos", "k.h.h1", "k.h.h2")
    held = materialize(held, "lines")
    common = held.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    common = materialize(common.select("h1", "h2", "last"), "common")
    drops = held.join(broadcast_if_small(common, 300_000), ["h1", "h2"]).where("doc_id < last").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("drops"))
    drops = materialize(drops, "drops")
    discard(held)
    discard(common)
    left = F.transform(F.array_except(F.expr("sequence(0, size(lines) - 1)"), "drops"), lambda i: F.get("lines", i))
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(left)
    return (
        rows.join(drops, ["doc_id", "t"], "left")
        .select("doc_id", F.size("lines").alias("n_lines"), kept.alias("kept"))
        .select(
            "doc_id",
            F.array_join("kept", "\n").alias("kept"),
            F.col("n_lines").cast("long"),
            (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        )
    )
