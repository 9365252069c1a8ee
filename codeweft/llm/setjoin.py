"""All similar pairs between set-valued records, by multi-index binary sketches.

Equal sets are collapsed first. Every distinct set gets a code of one-bit minhashes; two sets agree in a bit with
probability (1 + J) / 2, J their Jaccard similarity. Sets meet where a code segment, a fixed choice of bits, is equal.
The number of segments follows from the wanted recall at the least J that the threshold allows, and the length of a
segment from the number of sets, so that chance meetings per set and segment stay constant. Meetings outside a Hamming
radius, set by the same recall, are dropped; the rest is verified on the original sets. Similarity is the number of
shared values divided by the size of the larger set.

The result is pairs of representatives, one for each distinct set, and a membership of records; pairs of records are
made from both where they are wanted. All joins are merge joins by hint: how many rows a sketch gives is hidden from
the planner, and none of the tables has a bound that would allow to send it to every executor. Hot keys are left to
the splitting of skewed partitions at run time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut

BITS = 1024
FILTER_BITS = 128
#: Of segments and of the filter, each, at the least similarity: less than one link of a million is lost.
RECALL = 0.999999
_SEED = 20240607


def least_jaccard(threshold: float) -> float:
    """The least Jaccard similarity of two sets whose overlap is threshold of the larger one: both of that size."""
    return threshold / (2 - threshold)


def radius(bits: int, jaccard: float, recall: float) -> int:
    """The least Hamming radius that holds a pair of this similarity with the wanted probability."""
    p, q, total, term = (1 - jaccard) / 2, (1 + jaccard) / 2, 0.0, ((1 + jaccard) / 2) ** bits
    for r in range(bits + 1):
        total += term
        if total >= recall:
            return r
        term *= (bits - r) / (r + 1) * p / q
    return bits


def expected_recall(width: int, count: int, jaccard: float) -> float:
    """Share of pairs of this similarity that agree in at least one segment, over the distribution of their distance."""
    p, q, total, weight = (1 - jaccard) / 2, (1 + jaccard) / 2, 0.0, ((1 + jaccard) / 2) ** BITS
    for d in range(BITS + 1):
        total += weight * (1 - (1 - ((BITS - d) / BITS) ** width) ** count)
        weight *= (BITS - d) / (d + 1) * p / q
    return total


def plan_segments(n_sets: int, jaccard: float, recall: float) -> tuple[int, int]:
    """Bits of a segment and number of segments."""
    width = max(8, min(40, round(math.log2(max(2, n_sets)) - 3.5)))
    count = 8
    while expected_recall(width, count, jaccard) < recall:
        count += max(1, count // 16)
    return width, count


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def codes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One-bit minhashes of non-empty sets of 64-bit values, as array [sets, BITS] of 0 and 1."""
    seeds = np.random.default_rng(_SEED).integers(1, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(offsets) - 1
    out = np.empty((n, BITS), dtype=np.uint8)
    for a in range(0, n, 400):
        b = min(n, a + 400)
        part = values[offsets[a] : offsets[b]]
        hashed = _mixed((part[:, None] ^ (seeds >> np.uint64(7))) * seeds)
        least = np.minimum.reduceat(hashed, offsets[a:b] - offsets[a], axis=0)
        out[a:b] = (_mixed(least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(37)) & np.uint64(1)
    return out


def segment_keys(bits: np.ndarray, width: int, count: int) -> np.ndarray:
    """Join keys [sets, count]: segment number and segment value in one 64-bit number."""
    rng = np.random.default_rng(_SEED + 1)
    powers = np.uint64(1) << np.arange(width, dtype=np.uint64)
    out = np.empty((len(bits), count), dtype=np.uint64)
    for s in range(count):
        chosen = rng.choice(BITS, width, replace=False)
        out[:, s] = (bits[:, chosen].astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64) | np.uint64(s << width)
    return out


def _sketcher(width: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                col = b.column("hashes")
                values = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                offsets = np.concatenate([[0], np.cumsum(np.diff(col.offsets.to_numpy()))])
                bits = codes(values, offsets)
                words = np.packbits(bits[:, :FILTER_BITS], axis=1).view(np.int64)
                ids = b.column("set_id").to_numpy()
                keys = segment_keys(bits, width, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.reshape(-1).view(np.int64)),
                        pa.array(np.repeat(ids, count)),
                        pa.array(np.repeat(words[:, 0], count)),
                        pa.array(np.repeat(words[:, 1], count)),
                    ],
                    names=["key", "set_id", "c0", "c1"],
                )

    return run


def similar_sets(sets: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """(set_a, set_b, n_shared, similarity) of the pairs of different sets at or above threshold, set_a < set_b.

    sets: (set_id long, items array<string>), items distinct and not null, one row for each distinct set.
    """
    # a set shares threshold of the larger one with another set only if it has threshold / (1 - threshold) values
    fewest = math.ceil(round(threshold / (1 - threshold), 9)) if threshold < 1 else 1 << 30
    sets = sets.filter(F.size("items") >= fewest)
    n = sets.count()
    jaccard = least_jaccard(threshold)
    width, count = plan_segments(n, jaccard, recall)
    hashed = sets.select("set_id", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    rows = hashed.mapInArrow(_sketcher(width, count), "key long, set_id long, c0 long, c1 long")
    within = radius(FILTER_BITS, jaccard, recall)
    a, b = rows.alias("a"), rows.alias("b")
    distance = F.bit_count(F.col("a.c0").bitwiseXOR(F.col("b.c0"))) + F.bit_count(F.col("a.c1").bitwiseXOR(F.col("b.c1")))
    near = (
        a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.set_id") < F.col("b.set_id")) & (distance <= within))
        .select(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b"))
        .distinct()
    )
    # first by 64-bit hashes of the values, which can only count too many shared ones; what remains by the values
    likely = _verified(near, hashed.withColumnRenamed("hashes", "values"), threshold)
    return _verified(likely.select("set_a", "set_b"), sets.withColumnRenamed("items", "values"), threshold)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    for t in "ab":
        pairs = pairs.join(sets.select(F.col("set_id").alias(f"set_{t}"), F.col("values").alias(f"values_{t}")).hint("merge"), f"set_{t}")
    shared = F.size(F.array_intersect("values_a", "values_b"))
    larger = F.greatest(F.size("values_a"), F.size("values_b"))
    return pairs.select("set_a", "set_b", shared.alias("n_shared"), (shared / larger).alias("similarity")).filter(F.col("similarity") >= threshold)


def _set_of(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))


class SimilarRecords(NamedTuple):
    """pairs: (set_a, set_b, similarity) of different sets, each set standing for its copies, set_a < set_b. members: (id,
    set_id, grp, own), one row for each record with values. Records of one set are similar to each other too."""

    pairs: DataFrame
    members: DataFrame


def similar_classes(
    records: DataFrame, record_id: str, values: str, group: str, threshold: float, own: Column | None = None
) -> SimilarRecords:
    """Pairs of representatives and the membership of records whose sets are similar.

    record_id: unique but for repeated rows, which count once. values: array<string> with nulls and repeats, which are
    ignored; records without values take no part. group, own: kept with the members, for what is made from the result.
    An empty table gives empty tables; other columns are ignored.
    """
    flag = own if own is not None else F.lit(True)
    sets = _set_of(F.col(values))
    base = records.select(F.col(record_id).alias("id"), F.col(group).alias("grp"), sets.alias("items"), flag.alias("own"))
    base = base.filter(F.size("items") > 0).withColumn("set_id", F.xxhash64("items"))
    rows = cut(base.groupBy("id").agg(F.min(F.struct("set_id", "grp", "own", "items")).alias("m")).select("id", "m.*"))
    distinct_sets = cut(rows.groupBy("set_id").agg(F.min("items").alias("items")))
    pairs = cut(similar_sets(distinct_sets, threshold).select("set_a", "set_b", "similarity"))
    return SimilarRecords(pairs, rows.select("id", "set_id", "grp", "own"))


def record_pairs(found: SimilarRecords) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of similar records of different groups (null-safe), one of them own.

    Copies of one group are never paired with each other on the way.
    """
    members = found.members
    # copies: one row for each (set, group), so that members of one group don't meet
    groups = members.groupBy("set_id", "grp").agg(F.max("own").alias("any_own"))
    side = lambda t: groups.select(F.col("set_id").alias(f"set_{t}"), F.col("grp").alias(f"grp_{t}"), F.col("any_own").alias(f"any_{t}")).hint("merge")
    same = side("a").join(side("b"), F.col("set_a") == F.col("set_b")).filter(
        F.coalesce(F.col("grp_a"), F.lit("")) < F.coalesce(F.col("grp_b"), F.lit(""))
    ).withColumn("similarity", F.lit(1.0))
    other = found.pairs.join(side("a"), "set_a").join(side("b"), "set_b").filter(~F.col("grp_a").eqNullSafe(F.col("grp_b")))
    met = same.unionByName(other.select(*same.columns)).filter("any_a or any_b").drop("any_a", "any_b")
    for t in "ab":
        m = members.select(F.col("set_id").alias("_s"), F.col("grp").alias("_g"), F.col("id").alias(f"id_{t}"), F.col("own").alias(f"own_{t}")).hint("merge")
        met = met.join(m, (F.col(f"set_{t}") == F.col("_s")) & F.col(f"grp_{t}").eqNullSafe(F.col("_g"))).drop("_s", "_g")
    return met.filter("own_a or own_b").select(
        F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity"
    )


def record_links(found: SimilarRecords) -> DataFrame:
    """(id, set_id, n_links long): one row for each record with values, the set that stands for it, and the number of its
    pairs in record_pairs, counted from sums over sets and groups without making a pair of copies."""
    own = lambda c: F.sum(F.when(F.col("own"), c).otherwise(0))
    groups = found.members.groupBy("set_id", "grp").agg(F.count(F.lit(1)).alias("n"), own(F.lit(1)).alias("n_own"))
    sets = groups.groupBy("set_id").agg(F.sum("n").alias("n"), F.sum("n_own").alias("n_own"))
    ways = found.pairs.select("set_a", "set_b").unionByName(found.pairs.select(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b")))
    ways = ways.unionByName(sets.select(F.col("set_id").alias("set_a"), F.col("set_id").alias("set_b")))
    there = sets.select(F.col("set_id").alias("set_b"), "n", "n_own").hint("merge")
    whole = ways.join(there, "set_b").groupBy("set_a").agg(F.sum("n").alias("all_n"), F.sum("n_own").alias("all_own"))
    # records of the own group among the similar ones are no partners
    there = groups.select(F.col("set_id").alias("set_b"), F.col("grp").alias("_g"), "n", "n_own").hint("merge")
    mine = groups.select(F.col("set_id").alias("set_a"), "grp").join(ways.hint("merge"), "set_a")
    mine = mine.join(there, (mine.set_b == there.set_b) & mine.grp.eqNullSafe(there._g)).groupBy("set_a", "grp").agg(F.sum("n").alias("grp_n"), F.sum("n_own").alias("grp_own"))
    mine = mine.join(whole.hint("merge"), "set_a").select(F.col("set_a").alias("_s"), F.col("grp").alias("_g"), (F.col("all_n") - F.col("grp_n")).alias("n"), (F.col("all_own") - F.col("grp_own")).alias("n_own"))
    out = found.members.join(mine.hint("merge"), (F.col("set_id") == F.col("_s")) & F.col("grp").eqNullSafe(F.col("_g")))
    return out.select("id", "set_id", F.when(F.col("own"), F.col("n")).otherwise(F.col("n_own")).alias("n_links"))


def similar_records(
    records: DataFrame, record_id: str, values: str, group: str, threshold: float, own: Column | None = None
) -> DataFrame:
    """record_pairs of similar_classes: (id_a, id_b, similarity) of all pairs of records, copies included."""
    return record_pairs(similar_classes(records, record_id, values, group, threshold, own))
