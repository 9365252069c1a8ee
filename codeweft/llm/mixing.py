"""Mixing sources to target shares, by whole texts and their tokens.

Tokens are summed per source; from the target shares, the sizes and the caps on repeats follows the largest total that
can be reached, or a chosen total, and with it a repetition rate for each source. Every text is then taken floor(rate)
times and once more with probability rate - floor(rate), drawn from a hash of its id and a seed, so that a rerun gives
the same rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import tokens
from codeweft.session import cut


class SourcePlan(NamedTuple):
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    rate: float


def plan_rates(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: float | None = None) -> list[SourcePlan]:
    """Repetition rates for (source, target share, max repeats).

    total: tokens wanted; by default as many as there are in all named sources. A source that can't reach its part,
    even repeated to its cap, gives all it may, and what it lacks is shared out among the others in proportion to their
    target shares, again and again until nobody else falls short. Sources with no tokens or no share have rate 0.
    """
    live = {s: (share, cap) for s, share, cap in targets if share and share > 0}
    room = {s: max(0, cap or 0) * sizes.get(s, 0) for s, (_, cap) in live.items()}
    wanted = float(sum(sizes.get(s, 0) for s in live)) if total is None else float(total)
    given: dict[str, float] = {}
    open_sources = set(live)
    while open_sources:
        rest = wanted - sum(given.values())
        weight = math.fsum(live[s][0] for s in open_sources)
        short = {s for s in open_sources if room[s] <= rest * live[s][0] / weight}
        if not short or rest <= 0:
            given |= {s: max(0.0, rest) * live[s][0] / weight for s in open_sources}
            break
        given |= {s: float(room[s]) for s in short}
        open_sources -= short
    out = []
    for s, share, cap in targets:
        n = sizes.get(s, 0)
        rate = min(float(max(0, cap or 0)), given.get(s, 0.0) / n) if n else 0.0
        out.append(SourcePlan(s, share or 0.0, cap or 0, n, rate))
    return out


def mix(docs: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(chosen rows, report).

    chosen: (doc_id, source, n_tokens, repeats int) of the texts taken at least once, repeats at most the cap. report:
    (source, target_share, source_tokens, rate, mixed_tokens, actual_share) for each target. Texts of null or unnamed
    sources, null and empty texts are left out; each row of docs is a text of its own. targets is small by nature: one
    row for each source, (source, target_share, max_repeats); its rows alone come to the driver. Empty tables give an
    empty choice and zeros.
    """
    named = docs.join(F.broadcast(targets.select(F.col("source").alias(source)).distinct()), source, "left_semi")
    counted = tokens.count_tokens(
        named.filter(F.length(text) > 0).select(F.struct(F.col(doc_id).alias("id"), F.col(source).alias("source")).alias("k"), text), "k", text
    )
    sized = cut(counted.select(F.col("k.id").alias("id"), F.col("k.source").alias("source"), "n_tokens"))
    sizes = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}  # one row for each target
    plan = plan_rates([(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").collect()], sizes, total)
    spark = docs.sparkSession
    rates = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, source_tokens long, rate double")
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    extra = (draw < F.col("rate") - F.floor("rate")).cast("int")
    repeats = F.least(F.col("max_repeats"), F.floor("rate").cast("int") + extra)
    chosen = sized.join(F.broadcast(rates.select("source", "rate", "max_repeats")), "source").withColumn("repeats", repeats).filter("repeats > 0")
    chosen = chosen.select(F.col("id").alias(doc_id), F.col("source"), "n_tokens", "repeats")
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"))
    report = rates.join(reached, "source", "left").na.fill(0, ["mixed_tokens"])
    whole = reached.agg(F.sum("mixed_tokens").alias("whole"))
    report = report.join(F.broadcast(whole)).select(
        "source",
        "target_share",
        "source_tokens",
        "rate",
        "mixed_tokens",
        F.coalesce(F.col("mixed_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
    )
    return chosen, report


def copies(chosen: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, source, n_tokens, copy_no int from 0): every text taken, once for each of its repeats."""
    return chosen.select(doc_id, "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy_no"))


def emit(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, source, copy_no, text): the mix itself. doc_id must be unique in docs and chosen; copies are made behind
    the join, so that a text crosses the network once."""
    rows = chosen.select(doc_id, "source", "repeats").join(docs.select(doc_id, text), doc_id)
    return rows.select(doc_id, "source", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy_no"), text)
