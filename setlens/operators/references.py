"""References to records that do not exist.

Keys of both sides become integers (a dictionary of dense positions inside ranges of at most 32,768 codes).
Per range of codes and month there is one compressed bitmap of referenced keys, one of the keys whose validity through
whole months begins and one of those for which it is over. One pass over the months of a range carries the bitmap of
valid keys on (OR the beginning ones, AND-NOT the ended ones), so a key costs two bits however long it is valid and
however far apart the months lie. Referenced AND-NOT valid leaves the few (key, month) bits that need a look at exact
times. Surviving bits are decoded through the dictionary and joined back to the references, and an anti join on the
validity intervals decides.

Defined cases: a null key refers to nothing; a parent row without ``valid_from`` is never valid; a reference without a
time has no valid target and comes out with a null month; repeated references come out once; empty tables give no
rows; further columns of the inputs are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from setlens.shared import cut

BITS = 32_768  # bits of one bitmap, as bitmap_construct_agg makes them
KEYS_PER_CHUNK = 16_384  # keys aimed at per chunk; a fuller one goes on in a second bitmap
SPARSE = 1_024  # up to so many set bits are kept as a list of positions
BEGIN, END = "<", ">"  # of validity, beside the names of referring tables


def _pack(raw: bytes) -> bytes:
    bits = np.frombuffer(raw, np.uint8)
    on = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    return b"S" + on.astype("<u2").tobytes() if len(on) <= SPARSE else b"Z" + zlib.compress(raw, 1)


def _unpack(packed: bytes | None) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    if packed is None:
        return bits
    if packed[:1] == b"S":
        bits[np.frombuffer(packed, "<u2", offset=1)] = True
        return bits
    return np.unpackbits(np.frombuffer(zlib.decompress(packed[1:]), np.uint8), bitorder="little").astype(bool)


@F.pandas_udf(T.BinaryType())
def pack_bitmap(raw: pd.Series) -> pd.Series:
    return raw.map(_pack)


def surviving(pdf: pd.DataFrame) -> pd.DataFrame:
    """(chunk, src_table, m, pos) of the referenced keys of one range that are not valid through the whole month.

    pdf: chunk, m, what ("begin", "end" or the referring table), bits; a month's own begins and ends come first.
    """
    valid, out = np.zeros(BITS, bool), []
    for _, month in pdf.groupby("m", sort=True):
        for what, bits in zip(month["what"], month["bits"]):
            if what == END:
                valid &= ~_unpack(bits)
        for what, bits in zip(month["what"], month["bits"]):
            if what == BEGIN:
                valid |= _unpack(bits)
        for what, bits in zip(month["what"], month["bits"]):
            if what not in (BEGIN, END):
                pos = np.flatnonzero(_unpack(bits) & ~valid)
                out.append(pd.DataFrame({"src_table": what, "m": month["m"].iloc[0], "pos": pos}))
    if not out:
        return pd.DataFrame({"chunk": [], "src_table": [], "m": [], "pos": []})
    return pd.concat(out, ignore_index=True).assign(chunk=pdf["chunk"].iloc[0])[["chunk", "src_table", "m", "pos"]]


def month_index(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t) - 1


def _dictionary(keys: DataFrame) -> DataFrame:
    """(kind, key, chunk, pos): dense positions in hash chunks; the order in a chunk is that of the keys."""
    keys = cut(keys)
    chunks = max(1, -(-keys.count() // KEYS_PER_CHUNK))
    hashed = keys.withColumn("h", F.pmod(F.xxhash64("kind", "key"), F.lit(chunks)))
    rank = F.row_number().over(Window.partitionBy("h").orderBy("kind", "key")) - 1
    coded = hashed.withColumn("rank", rank)
    return cut(
        coded.select(
            "kind",
            "key",
            (F.col("h") * 64 + F.floor(F.col("rank") / BITS)).alias("chunk"),
            (F.col("rank") % BITS).alias("pos"),
        )
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose target is not valid at their time.

    refs: src_table, kind, record_key, ref_key, ref_time. parents: kind, key, valid_from, valid_to (excluded, null = open).
    Returns (src_table, ref_month, record_key, ref_key), each once.
    """
    refs = refs.where(F.col("ref_key").isNotNull()).select(
        "src_table", "kind", "record_key", F.col("ref_key").alias("key"), "ref_time", month_index(F.col("ref_time")).alias("m")
    )
    parents = parents.where(F.col("key").isNotNull() & F.col("valid_from").isNotNull())
    parents = parents.select("kind", "key", "valid_from", "valid_to").distinct()
    timed = refs.where(F.col("m").isNotNull())
    present = cut(timed.groupBy("src_table", "kind", "key", "m").agg(F.lit(1).alias("one")).drop("one"))
    low, high = present.agg(F.min("m"), F.max("m")).first()
    codes = _dictionary(present.select("kind", "key").union(parents.select("kind", "key")).distinct())

    begin = month_index(F.col("valid_from"))
    whole = F.date_trunc("month", F.col("valid_from")).cast("timestamp_ntz") == F.col("valid_from")
    first = F.greatest(F.when(whole, begin).otherwise(begin + 1), F.lit(low or 0))
    last = F.least(F.coalesce(month_index(F.col("valid_to")) - 1, F.lit(high or 0)), F.lit(high or 0))
    spans = parents.select("kind", "key", first.alias("first"), last.alias("last")).where("first <= last").distinct()
    # spans of a key that touch become one, so that each bit begins and ends once in between
    earlier = Window.partitionBy("kind", "key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("new", F.coalesce((F.col("first") > F.max("last").over(earlier) + 1).cast("int"), F.lit(1)))
    upto = Window.partitionBy("kind", "key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    merged = starts.withColumn("island", F.sum("new").over(upto)).groupBy("kind", "key", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    events = merged.select("kind", "key", F.lit(BEGIN).alias("what"), F.col("first").alias("m")).unionByName(
        merged.where(F.col("last") < F.lit(high or 0)).select("kind", "key", F.lit(END).alias("what"), (F.col("last") + 1).alias("m"))
    )
    bits = (
        present.withColumnRenamed("src_table", "what").unionByName(events).join(codes, ["kind", "key"])
        .groupBy("chunk", "what", "m").agg(F.bitmap_construct_agg(F.col("pos").cast("bigint")).alias("bits"))
        .select("chunk", "m", "what", pack_bitmap("bits").alias("bits"))
    )
    open_keys = (
        bits.groupBy("chunk").applyInPandas(surviving, "chunk bigint, src_table string, m int, pos bigint")
        .join(codes, ["chunk", "pos"]).select("src_table", "kind", "key", "m")
    )
    p = parents.select(F.col("kind").alias("p_kind"), F.col("key").alias("p_key"), "valid_from", "valid_to")
    valid_then = (
        (F.col("p_kind") == F.col("kind"))
        & (F.col("p_key") == F.col("key"))
        & (F.col("valid_from") <= F.col("ref_time"))
        & (F.col("valid_to").isNull() | (F.col("ref_time") < F.col("valid_to")))
    )
    orphans = timed.join(open_keys, ["src_table", "kind", "key", "m"]).join(p, valid_then, "left_anti")
    untimed = refs.where(F.col("m").isNull())
    return (
        orphans.unionByName(untimed)
        .select(
            "src_table", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "record_key", F.col("key").alias("ref_key")
        )
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of orphan references and of missing keys per table and month."""
    per_key = orphans.groupBy("src_table", "ref_month", "ref_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("src_table", "ref_month").agg(
        F.sum("n").alias("orphan_refs"), F.count(F.lit(1)).alias("missing_keys")
    )
