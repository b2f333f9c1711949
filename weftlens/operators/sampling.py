"""Samples and assignments. Random order is a hash of id and seed: the same rows on every run and every cluster.

The n first of a group by hash are a top-n: every partition keeps its own first n of each group before the shuffle, so that
a hot group is never sorted whole in one task, and a sample is exactly as large as asked for, or as the group is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlens.operators.dedup import keep_first
from weftlens.operators.ordered import numbered, top_n


def hash_order(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def _first_by_hash(df: DataFrame, groups: Sequence[str], id_col: str, most: int, seed: int) -> DataFrame:
    """``sample_rank`` 1 to ``most`` by hash within groups, null groups among them."""
    keyed = df.withColumn("sample_hash", F.shiftrightunsigned(hash_order(id_col, seed), 11))
    order = [F.col("sample_hash"), F.col(id_col)]
    return top_n(keyed if groups else keyed.orderBy(*order).limit(most), groups, order, most, "sample_rank").drop("sample_hash")


def stratified_sample(df: DataFrame, groups: Sequence[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each group."""
    return _first_by_hash(df, groups, id_col, n, seed).drop("sample_rank")


def global_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of all, or all if there are fewer."""
    return _first_by_hash(df, [], id_col, n, seed).drop("sample_rank")


def quota_sample(df: DataFrame, group: str, id_col: str, quotas: Mapping[str, int], seed: int = 42) -> DataFrame:
    """A number of rows per group; groups without a quota take no part."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(group)]
    wanted = df.filter(F.col(group).isin(list(quotas))).withColumn("sample_quota", quota)
    return _first_by_hash(wanted, [group], id_col, max(quotas.values(), default=0), seed).filter("sample_rank <= sample_quota").drop("sample_rank", "sample_quota")


def orientation_sampling(df: DataFrame, orientation: str, verdict: str, text: str, id_col: str, target: int = 500) -> DataFrame:
    """Regressive rows: first-tier only, longest first, at most ``target``. Progressive rows: first-tier, topped up by the
    longest of the second tier to ``target``; more than enough first-tier rows are cut to the longest."""
    tier = F.when(F.col(verdict) == "TIER1", 1).when(F.col(verdict) == "TIER2", 2)
    rows = df.withColumn("os_tier", tier).filter("os_tier is not null").filter((F.lower(orientation) == "progressive") | (F.col("os_tier") == 1))
    rank = F.row_number().over(Window.partitionBy(F.lower(orientation)).orderBy("os_tier", F.length(text).desc(), id_col))
    return rows.withColumn("sample_rank", rank).filter(F.col("sample_rank") <= target).drop("os_tier")


def assign_round_robin(df: DataFrame, strata: Sequence[str], id_col: str, coders: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows shuffled within a stratum and dealt to the coders in turn; strata may be of any size."""
    dealt = numbered(df.withColumn("rr_order", hash_order(id_col, seed)), strata, ["rr_order", id_col], "rr_n")
    turn = ((F.col("rr_n") - 1) % len(coders) + 1).cast("int")
    return dealt.withColumn("coder", F.element_at(F.array(*map(F.lit, coders)), turn)).drop("rr_order", "rr_n")


def overlap_design(pool: DataFrame, id_col: str, coders: Sequence[str], shared: int = 5, ring: Sequence[int] = (3, 2, 3, 2, 3, 2), seed: int = 42) -> DataFrame:
    """An overlap set of fixed size: ``shared`` items go to every coder, and neighbours in the ring of coders share 3, 2, 3, 2, 3, 2 items.

    ``id_col, coder, group_id``; a pool too small gives a smaller design.
    """
    spark = pool.sparkSession
    slots = [(i + 1, "all", c) for i in range(shared) for c in coders]
    at = shared
    for k, size in enumerate(ring):
        pair = (coders[k % len(coders)], coders[(k + 1) % len(coders)])
        slots += [(at + i + 1, f"pair_{k + 1}", c) for i in range(size) for c in pair]
        at += size
    design = spark.createDataFrame(slots, "sample_rank int, group_id string, coder string")
    picked = _first_by_hash(pool.select(id_col), [], id_col, at, seed)
    return picked.join(F.broadcast(design), "sample_rank").select(id_col, "coder", "group_id")


def select_diverse(df: DataFrame, theme: str, score: str, id_col: str, cap: int, target: int) -> DataFrame:
    """By score with at most ``cap`` per theme, then filled up by score to ``target``.

    Rows within their cap come from a top-n per theme. Where they are fewer than ``target``, the rest is among the
    ``2 * target`` best rows of all, so that no theme is ever ranked whole.
    """
    order = [F.col(score).desc_nulls_last(), F.col(id_col)]
    within = top_n(df, [theme], order, cap, "sd_rank").drop("sd_rank").withColumn("sd_first", F.lit(1))
    best = df.orderBy(*order).limit(2 * target).withColumn("sd_first", F.lit(0))
    rows = keep_first(within.unionByName(best), [id_col], [F.desc("sd_first")])
    return rows.orderBy(F.desc("sd_first"), *order).limit(target).drop("sd_first")
