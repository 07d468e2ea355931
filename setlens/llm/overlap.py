"""Same or nearly the same records across splits.

Records with the same word set form one class; only one representative per class goes on. Minwise hashes over the words
are banded into buckets, and only representatives of the evaluation side meet those of the training side there. Before
anything is shuffled further, a pair must pass an exact bound: each bit set in one 128-bit word signature and not in the
other is a word the sets do not share. What is left is verified by exact Jaccard similarity on the words.

With 40 bands of 6 rows, a pair of similarity 0.8 misses all bands with a probability of 0.0005 %, one of 0.85 with
0.000001 %. A bucket that holds a large share of all classes is divided over several tasks. Where no pair of a bucket
can be told apart by the bound, its classes are similar to each other and all these pairs belong to the result.

Defined cases: a record whose text is null or has no words has no word set and is in no pair; names of splits compare
without letter case and outer white space, unknown and null splits list nothing; an id listed on both sides is paired
with itself; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setlens.shared import cut

BANDS, ROWS = 40, 6
SEED = 20_240_501
SEEN = 64  # one class of so many is looked at for full buckets
FULL = 1 / 256  # of the classes in one bucket make it full
LEAST = 64  # classes seen in it at least
SALTS = 32  # tasks over which a full bucket is divided


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def word_set(text: Column) -> Column:
    """Sorted distinct runs of letters and digits after NFKC and lower-casing; null if there is none."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(nfkc(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))
    return F.when(F.size(words) > 0, words)


def band_hashes(bands: int, rows: int):
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(words: pd.Series) -> pd.Series:
        lengths = words.map(len).to_numpy()
        flat = np.concatenate(words.to_numpy()).astype(np.int64).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out = np.zeros((len(words), bands), np.uint64)
        with np.errstate(over="ignore"):
            for band in range(bands):
                h = np.full(len(words), band + 1, np.uint64)
                for k in range(band * rows, band * rows + rows):
                    low = np.minimum.reduceat((flat ^ b[k]) * a[k], starts)
                    h = (h ^ low) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out[:, band] = h
        return pd.Series(list(out.view(np.int64)))

    return hashes


def _signature(hashed: Column, half: int) -> Column:
    """Half of a 128-bit signature: each word sets one bit of one half, by seven bits of its hash."""
    mine = F.filter(hashed, lambda x: F.shiftrightunsigned(x, 6) % 2 == half)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)).cast("int"))
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(bit(x)))


def _full_buckets(classes: DataFrame) -> list[int]:
    """Buckets that hold more than a share of FULL of all classes, seen in one class of SEEN; FULL bounds their number."""
    seen = classes.where(F.pmod(F.xxhash64("c"), F.lit(SEEN)) == 0)
    n = seen.count()
    counts = seen.select(F.explode("bands").alias("h")).groupBy("h").count()
    return [r["h"] for r in counts.where(F.col("count") > max(LEAST, n * FULL)).collect()]


def _spread(banded: DataFrame, full: list[int], divide: bool) -> DataFrame:
    """Rows of full buckets divided over SALTS tasks on one side and repeated in each of them on the other."""
    if not full:
        return banded.withColumn("salt", F.lit(0))
    number = F.pmod(F.xxhash64("left_c"), F.lit(SALTS)).cast("int") if divide else F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    hot = banded.where(F.col("h").isin(full)).withColumn("salt", number)
    return banded.where(~F.col("h").isin(full)).withColumn("salt", F.lit(0)).unionByName(hot)


def similar_across(
    records: DataFrame, left: Column, right: Column, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (left_rep, right_rep, jaccard), and the members (id, rep, is_left, is_right).

    records: id, words, is_left, is_right; ids distinct, words as word_set makes them.
    """
    records = records.where(F.col("words").isNotNull())
    members = cut(records.select("id", "words", left.alias("is_left"), right.alias("is_right")))
    classes = members.groupBy("words").agg(
        F.min("id").alias("rep"), F.max("is_left").alias("any_left"), F.max("is_right").alias("any_right")
    )
    hashed = classes.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    classes = cut(
        hashed.select(
            F.monotonically_increasing_id().alias("c"), "rep", "any_left", "any_right", "words",
            F.size("words").alias("n"),
            *[_signature(F.col("hashed"), k).alias(f"sig{k}") for k in (0, 1)],
            band_hashes(bands, rows)("hashed").alias("bands"),
        )
    )
    # the hash of a band holds its number, so a row of a bucket needs no more than the numbers of its class
    banded = classes.select("any_left", "any_right", "c", "n", "sig0", "sig1", F.explode("bands").alias("h"))

    def side(name: str) -> DataFrame:
        return banded.where(f"any_{name}").select("h", *[F.col(c).alias(f"{name}_{c}") for c in ("c", "n", "sig0", "sig1")])

    def unshared(x: str, y: str) -> Column:
        return sum(F.bit_count(F.col(f"{x}_sig{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}_sig{k}")))) for k in (0, 1))

    # |A & B| <= |A| - unshared(A, B), and the same from B; similar means (1 + s) |A & B| >= s (|A| + |B|)
    most = F.least(F.col("left_n") - unshared("left", "right"), F.col("right_n") - unshared("right", "left"))
    possible = (1 + similarity) * most >= similarity * (F.col("left_n") + F.col("right_n")) - 1e-9
    full = _full_buckets(classes)
    near = (
        _spread(side("left"), full, True).join(_spread(side("right"), full, False), ["h", "salt"])
        .where((F.col("left_c") != F.col("right_c")) & possible)
        .select("left_c", "right_c").distinct()
    )
    shared = F.size(F.array_intersect("left_words", "right_words"))
    of = lambda name: classes.select(*[F.col(c).alias(f"{name}_{c}") for c in ("c", "rep", "words")])
    verified = (
        near.join(of("left"), "left_c").join(of("right"), "right_c")
        .withColumn("jaccard", shared / (F.size("left_words") + F.size("right_words") - shared))
        .where(F.col("jaccard") >= similarity)
        .select("left_rep", "right_rep", "jaccard")
    )
    same = classes.where("any_left AND any_right").select(
        F.col("rep").alias("left_rep"), F.col("rep").alias("right_rep"), F.lit(1.0).alias("jaccard")
    )
    membership = members.join(classes.select("rep", "words"), "words").select("id", "rep", "is_left", "is_right")
    return verified.unionByName(same), membership
