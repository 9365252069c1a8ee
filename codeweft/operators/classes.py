"""Classes: inheritance folding, exact clusters, and similarity of method sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.functions import sql
from codeweft.operators.ranking import global_rank
from codeweft.session import cut


def fold_inheritance(df: DataFrame, class_id: str, name: str, bases: str, class_hash: str, order: str) -> DataFrame:
    """df with parent_hash and folded_hash.

    A base counts if a class of that name exists anywhere; of several the last in order gives its hash, as it was
    before any folding. Classes without a known base keep their hash; others get the digest of their own hash and the
    sorted hashes of their parents. parent_hash is the single parent's hash, or the digest of several. Null or empty
    bases are none; class_id must be unique.
    """
    known = df.filter(F.col(class_hash).isNotNull()).groupBy(F.col(name).alias("_base")).agg(F.max(F.struct(F.col(order), F.col(class_hash).alias("h"))).getField("h").alias("_parent"))
    wanted = df.select(F.col(class_id).alias("_id"), F.explode(bases).alias("_base"))
    parents = wanted.join(known, "_base").groupBy("_id").agg(F.sort_array(F.collect_list("_parent")).alias("_parents"))
    out = df.drop("parent_hash", "folded_hash").join(parents, F.col(class_id) == F.col("_id"), "left")
    several = F.sha2(F.to_json("_parents"), 256)
    return out.withColumns(
        {
            "parent_hash": F.when(F.size("_parents") == 1, F.get("_parents", F.lit(0))).when(F.size("_parents") > 1, several),
            "folded_hash": F.when(F.size("_parents") > 0, sql.folded_hash(F.col(class_hash), F.col("_parents"))).otherwise(F.col(class_hash)),
        }
    ).drop("_id", "_parents")


def similar_classes(df: DataFrame, index: str, key: list[str], hashes: str, class_hash: str, threshold: float, most_rows: int = 2_000) -> DataFrame:
    """(index_a, index_b, n_shared, similarity) of class pairs, index_a < index_b, of different class hash at or above threshold.

    Similarity is the number of different shared method hashes divided by the larger number of methods, repeats counted.
    Of classes with the same key (file and name, say) only the first is paired with others, and with its next namesake.
    A threshold of 1 or more gives nothing, as exact clusters answer it. For a threshold above 0 classes meet at the
    rarest of their hashes, as many as must contain a shared one, so that hashes held by very many classes aren't
    joined. At 0 or below every pair is an answer; then the table must not exceed most_rows rows.
    """
    empty = df.sparkSession.createDataFrame([], "index_a long, index_b long, n_shared int, similarity double")
    if threshold >= 1:
        return empty
    rows = df.select(
        F.col(index).cast("long").alias("i"), F.col(class_hash).alias("ch"), F.struct(*key).alias("key"), F.size(F.coalesce(hashes, F.array())).alias("n"),
        F.array_distinct(F.filter(F.coalesce(F.col(hashes), F.array()), lambda x: x.isNotNull())).alias("hs"),
    ).filter("n > 0")
    rows = cut(rows)
    whole = F.struct("i", "ch", "n", "hs")
    first = rows.groupBy("key").agg(F.min(whole).alias("a"))
    later = rows.join(first.select("key", F.col("a.i").alias("_first")).hint("merge"), "key").filter(F.col("i") > F.col("_first"))
    next_one = first.join(later.groupBy("key").agg(F.min(whole).alias("b")).hint("merge"), "key").select("a", "b")
    # equal classes are one on the way: they are no pair, and meet the others together
    head = cut(first.select("a.*").groupBy("ch", "n", "hs").agg(F.min("i").alias("i")))

    def scored(pairs: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect("a.hs", "b.hs"))
        larger = F.greatest("a.n", "b.n")
        out = pairs.filter(~F.col("a.ch").eqNullSafe(F.col("b.ch"))).withColumn("s", shared).withColumn("sim", F.col("s") / larger)
        return out.filter(F.col("sim") >= threshold).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.col("s").alias("n_shared"), F.col("sim").alias("similarity"))

    if threshold <= 0:
        if head.count() > most_rows:
            raise ValueError(f"a threshold of {threshold} asks for all pairs of more than {most_rows} classes")
        x = head.select(F.struct("*").alias("a"))
        pairs = scored(x.join(F.broadcast(head.select(F.struct("*").alias("b"))), F.col("a.i") < F.col("b.i")))
    else:
        pairs = scored(_meetings(head, threshold))
    known = head.select(F.col("i").alias("_rep"), F.struct("ch", "n", "hs").alias("_same")).hint("merge")
    members = first.select(F.col("a.i").alias("_i"), F.struct("a.ch", "a.n", "a.hs").alias("_own")).join(known, F.col("_own").eqNullSafe(F.col("_same"))).select("_rep", "_i")
    for side in ("i", "j"):
        pairs = pairs.join(members.withColumnRenamed("_rep", side).withColumnRenamed("_i", f"_{side}").hint("merge"), side)
    expanded = pairs.select(F.col("_i").alias("i"), F.col("_j").alias("j"), "n_shared", "similarity")
    return expanded.unionByName(scored(next_one)).select(F.least("i", "j").alias("index_a"), F.greatest("i", "j").alias("index_b"), "n_shared", "similarity")


def _meetings(head: DataFrame, threshold: float) -> DataFrame:
    """(a, b): different classes that share one of their rarest hashes, of as many as must hold a shared one."""
    hashed = head.select("i", "n", F.explode("hs").alias("h"))
    frequency = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    ranked = hashed.join(frequency.hint("merge"), "h").withColumns(
        {"r": F.row_number().over(W.partitionBy("i").orderBy("f", "h")), "d": F.count(F.lit(1)).over(W.partitionBy("i"))}
    )
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)))
    prefix = ranked.filter(F.col("r") <= F.col("d") - needed + 1).select("i", "h", "n")
    p, q = prefix.alias("p"), prefix.alias("q")
    fits = F.least("p.n", "q.n") >= F.greatest("p.n", "q.n") * F.lit(threshold) - F.lit(1e-9)
    met = p.join(q.hint("merge"), (F.col("p.h") == F.col("q.h")) & (F.col("p.i") < F.col("q.i")) & fits).select(F.col("p.i").alias("i"), F.col("q.i").alias("j")).distinct()
    full = head.select("i", F.struct("*").alias("a")).hint("merge")
    other = head.select(F.col("i").alias("j"), F.struct("*").alias("b")).hint("merge")
    return met.join(full, "i").join(other, "j").select("a", "b")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Similar pairs with their position from 0: the most similar first, then by index."""
    return global_rank(pairs, [F.col("similarity").desc(), F.col("index_a"), F.col("index_b")])


def pair_details(pairs: DataFrame, df: DataFrame, index: str, methods: str) -> DataFrame:
    """pairs with shared, only_in_a and only_in_b: method names by hash, of methods with one hash the last."""
    m = df.select(F.col(index).cast("long").alias("i"), F.coalesce(F.col(methods), F.array()).alias("m"))
    name_of = lambda side: F.map_from_entries(
        F.transform(F.array_distinct(F.transform(side, lambda x: x["hash"])), lambda h: F.struct(h.alias("k"), F.element_at(F.filter(side, lambda x: x["hash"].eqNullSafe(h)), -1)["name"].alias("v")))
    )
    a = m.select(F.col("i").alias("index_a"), F.filter("m", lambda x: x["hash"].isNotNull()).alias("ma"))
    b = m.select(F.col("i").alias("index_b"), F.filter("m", lambda x: x["hash"].isNotNull()).alias("mb"))
    both = pairs.join(a, "index_a").join(b, "index_b")
    ha, hb = (F.array_distinct(F.transform(c, lambda x: x["hash"])) for c in ("ma", "mb"))
    names = lambda hs, side: F.sort_array(F.transform(hs, lambda h: F.element_at(name_of(F.col(side)), h)))
    return both.withColumns(
        {"shared": names(F.array_intersect(ha, hb), "ma"), "only_in_a": names(F.array_except(ha, hb), "ma"), "only_in_b": names(F.array_except(hb, ha), "mb")}
    ).drop("ma", "mb")
