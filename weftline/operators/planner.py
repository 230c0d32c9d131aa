"""Chains of replacements: for each host, the turns go round its slots, and each takes the best candidate that the host has not used.

What a turn takes depends on the turns before, so a host is one fold over its turns; hosts are folded side by side. The fold needs no
more than the first ``turns`` + 1 candidates of a slot, since no more can be taken or in place: the cut is exact, and it bounds what a host
holds by its slots and turns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT = 0.8  # fixed value: the share of turns that a chain must have
LEAST_SLOTS = 2


def _fold(order: list, ranked: dict, start: dict, turns: int) -> list[tuple]:
    """(turn, slot, removed, added, refused) of the turns that found a candidate."""
    used, held, out = set(), dict(start), []
    for t in range(turns):
        slot = order[t % len(order)]
        refused = 0
        for candidate in ranked.get(slot, ()):
            if candidate in used or candidate == held[slot]:
                refused += 1
                continue
            out.append((t + 1, slot, held[slot], candidate, refused))
            used.add(candidate)
            held[slot] = candidate
            break
    return out


def planned_chains(slots: DataFrame, candidates: DataFrame, turns: int, kept: float = KEPT, by: Sequence[str] = ("oid", "slot")) -> DataFrame:
    """(oid, turn, slot, removed, added, refused) of the chains that have at least so much of their turns.

    slots: (oid, slot, ord, occupant), of which an object has at least two and few. candidates: (oid, slot, rank, candidate), best first by
    rank, then candidate. removed and added: what leaves the slot and what comes; refused: better ones that the host has used already. A turn
    without a candidate is left out; it still is the slot's turn. by: what candidates have instead of oid and slot, where slots share them by
    a column of their own; each list is then ranked and cut once, not once a slot.
    """
    best = Window.partitionBy(*by).orderBy("rank", "candidate")
    few = candidates.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= turns + 1)
    ranked = few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "candidate"))).alias("list")).withColumn("list", F.col("list.candidate"))
    whole = slots.join(ranked, list(by), "left").select("oid", F.struct("ord", "slot", "occupant", "list").alias("s"))
    hosts = whole.groupBy("oid").agg(F.array_sort(F.collect_list("s")).alias("slots")).filter(F.size("slots") >= LEAST_SLOTS)
    kinds, slot, held = dict(slots.dtypes), dict(slots.dtypes)["slot"], dict(candidates.dtypes)["candidate"]
    schema = f"oid {kinds['oid']}, turn int, slot {slot}, removed {held}, added {held}, refused int"

    def read(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            rows = []
            for oid, own in zip(pdf["oid"], pdf["slots"], strict=True):
                ranked = {s["slot"]: () if s["list"] is None else list(s["list"]) for s in own}
                chain = _fold([s["slot"] for s in own], ranked, {s["slot"]: s["occupant"] for s in own}, turns)
                rows += [(oid, *turn) for turn in chain if len(chain) >= turns * kept]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return hosts.mapInPandas(read, schema)
