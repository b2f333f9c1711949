"""Mixing sources to target weights (problem 8).

Capped water-filling: the total is shared out by target weight; a source that would need more repetitions than it may
have is held at its maximum and what it can't give is shared among the others by weight, until no source is over its
maximum. A source's amount over its size is its number of epochs: the whole part repeats every document, the rest takes
a seeded part of the documents, in order of a hash of document and seed. That order is cut by two histograms of the hash
(4096 cells of a source, then 4096 cells of the one the cut falls in), so that nothing larger than one cell of a cell is
ever put in order, and the part is met to within one document.

The shares come as near to their targets as the maximums allow where the total is the largest that every source can bear
(``exact_total``, the default); a larger total, such as all there is (``whole_total``), makes small sources fall behind.

Defined cases: documents without a token, without a source or of a source without a target are not part of the mix; a
source without documents takes nothing and its share goes to the others by weight; with no source left the mix is empty;
a null or negative target counts as 0, a null ``max_repeats`` as 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CELLS = 12  # bits


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    size: int
    most: int
    amount: float

    @property
    def epochs(self) -> float:
        return self.amount / self.size if self.size else 0.0


def _kept(targets: Sequence[tuple[str, float | None, int | None]]) -> dict[str, tuple[float, int]]:
    return {s: (max(0.0, w or 0.0), max(0, 1 if m is None else m)) for s, w, m in targets if s is not None}


def water_fill(sizes: Mapping[str, int], targets: Sequence[tuple[str, float | None, int | None]], total: float | None = None) -> list[Share]:
    """The amount of each source. Without a ``total`` it is ``exact_total``, so that every source meets its target."""
    kept = _kept(targets)
    free = {s for s, (w, m) in kept.items() if w > 0 and m > 0 and sizes.get(s, 0) > 0}
    amounts = dict.fromkeys(kept, 0.0)
    left = exact_total(sizes, targets) if total is None else float(total)
    while free and left > 0:
        weight = sum(kept[s][0] for s in free)
        over = {s for s in free if left * kept[s][0] / weight > kept[s][1] * sizes[s] * (1 + 1e-12)}
        if not over:
            for s in free:
                amounts[s] = left * kept[s][0] / weight
            break
        for s in over:
            amounts[s] = float(kept[s][1] * sizes[s])
            left -= amounts[s]
        free -= over
    return [Share(s, w, int(sizes.get(s, 0)), m, amounts[s]) for s, (w, m) in sorted(kept.items())]


def exact_total(sizes: Mapping[str, int], targets: Sequence[tuple[str, float | None, int | None]]) -> float:
    """The largest total at which every source that has documents, and may be used, still reaches its share exactly."""
    present = {s: wm for s, wm in _kept(targets).items() if wm[0] > 0 and wm[1] > 0 and sizes.get(s, 0) > 0}
    weight = sum(w for w, _ in present.values())
    return min((m * sizes[s] * weight / w for s, (w, m) in present.items()), default=0.0)


def whole_total(sizes: Mapping[str, int], targets: Sequence[tuple[str, float | None, int | None]]) -> float:
    """As many tokens as the sources of the targets hold: small ones are used up to their maximum, and the rest shares their excess."""
    return float(sum(sizes.get(s, 0) for s, (w, m) in _kept(targets).items() if w > 0 and m > 0))


def _order(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, F.lit(seed))


def _cell(order: Column, level: int) -> Column:
    return F.shiftrightunsigned(order, 64 - _CELLS * level).bitwiseAND((1 << _CELLS) - 1).cast("int")


def _cut(cells: list[tuple[str, int, int]], needs: Mapping[str, float]) -> dict[str, tuple[int, float]]:
    """Per source the cell its cut falls in, and what is still needed from that cell."""
    found = {}
    for source, need in needs.items():
        cut, left = 1 << _CELLS, 0.0
        for _, cell, tokens in sorted(c for c in cells if c[0] == source):
            if tokens > need:
                cut, left = cell, need
                break
            need -= tokens
        found[source] = (cut, left)
    return found


def _case(source: Column, values: Mapping[str, float], default: float) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])[source], F.lit(default))


def mix_documents(tokens: DataFrame, shares: Sequence[Share], seed: int = 8) -> DataFrame:
    """``doc_id, source, tokens, repeats`` of every document in the mix.

    ``tokens`` has ``doc_id, source, tokens``; it is read three times, so pass a table that is written down. What comes
    to the driver are histograms: at most 4096 cells per source of the (small) list of targets.
    """
    whole = {s.source: int(s.epochs + 1e-12) for s in shares}
    part = {s.source: max(0.0, s.amount - whole[s.source] * s.size) for s in shares if s.amount > 0}
    rows = tokens.filter(F.col("tokens") > 0).filter(F.col("source").isin([s.source for s in shares if s.amount > 0]))
    rows = rows.withColumn("mix_order", _order(F.col("doc_id"), seed))
    rows = rows.withColumns({"mix_cell": _cell(F.col("mix_order"), 1), "mix_inner": _cell(F.col("mix_order"), 2)})

    def histogram(df: DataFrame, cell: str) -> list[tuple[str, int, int]]:
        return [tuple(r) for r in df.groupBy("source", cell).agg(F.sum("tokens")).collect()]

    first = _cut(histogram(rows, "mix_cell"), part)
    edge = F.col("mix_cell") == _case(F.col("source"), {s: c for s, (c, _) in first.items()}, -1)
    second = _cut(histogram(rows.filter(edge), "mix_inner"), {s: need for s, (_, need) in first.items()})
    inner = _case(F.col("source"), {s: c for s, (c, _) in second.items()}, -1)
    need = _case(F.col("source"), {s: float(n) for s, (_, n) in second.items()}, 0.0)
    below = (F.col("mix_cell") < _case(F.col("source"), {s: c for s, (c, _) in first.items()}, -1)) | (edge & (F.col("mix_inner") < inner))
    at_cut = edge & (F.col("mix_inner") == inner)
    # the documents of one cell of a cell, in order, up to what is needed
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("mix_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.filter(at_cut).withColumn("mix_upto", upto).withColumn("extra", (F.col("mix_upto") - F.col("tokens") / 2 <= need).cast("int")).drop("mix_upto")
    clear = rows.filter(~at_cut).withColumn("extra", below.cast("int"))
    times = _case(F.col("source"), whole, 0).cast("int") + F.col("extra")
    return clear.unionByName(last).select("doc_id", "source", "tokens", times.alias("repeats")).filter("repeats > 0")


def mix_report(mix: DataFrame, shares: Sequence[Share]) -> DataFrame:
    """Per source of the targets: target, reachable and actual share, size, epochs and the most uses of one document."""
    spark = mix.sparkSession
    total = sum(s.amount for s in shares) or 1.0
    plan = spark.createDataFrame(
        [(s.source, float(s.target), s.amount / total, s.size, s.most, s.epochs) for s in shares],
        "source string, target_share double, reachable_share double, source_tokens long, max_repeats int, epochs double",
    )
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_uses"), F.count("*").alias("docs"))
    everything = used.agg(F.sum("mixed_tokens").alias("all_tokens"))
    return (
        plan.join(F.broadcast(used), "source", "left")  # one row per target
        .crossJoin(F.broadcast(everything))  # one row
        .select(
            "source", "target_share", "reachable_share", F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            "source_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), "epochs", "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
    )
