from __future__ import annotations

import random

from weftline.operators.planner import planned_chains


def plain(slots, candidates, turns, kept):
    """The loop over turns, with all candidates at hand."""
    out = []
    for oid in {s[0] for s in slots}:
        own = sorted(((o, s, x) for i, s, o, x in slots if i == oid))
        if len(own) < 2:
            continue
        held, used, chain = {s: x for _, s, x in own}, set(), []
        for t in range(turns):
            slot = own[t % len(own)][1]
            refused = 0
            for _, c in sorted((r, c) for i, s, r, c in candidates if (i, s) == (oid, slot)):
                if c in used or c == held[slot]:
                    refused += 1
                    continue
                chain.append((oid, t + 1, slot, held[slot], c, refused))
                used.add(c)
                held[slot] = c
                break
        out += chain if len(chain) >= turns * kept else []
    return sorted(out)


def test_chains_against_the_plain_loop(spark):
    rng = random.Random(2)
    slots = [(oid, s, 10 - s, rng.randrange(30)) for oid in range(40) for s in range(rng.randrange(1, 5))]
    candidates = [(oid, s, rng.randrange(5), c) for oid, s, *_ in slots for c in rng.sample(range(30), rng.randrange(0, 12))]
    a = spark.createDataFrame(slots, "oid long, slot long, ord long, occupant long")
    b = spark.createDataFrame(candidates, "oid long, slot long, rank long, candidate long")
    for turns, kept in ((6, 0.8), (9, 0.5), (3, 0.0)):
        want = plain(slots, candidates, turns, kept)
        assert sorted(map(tuple, planned_chains(a, b, turns, kept).collect())) == want and want
    assert planned_chains(a.limit(0), b, 5).count() == 0


def test_candidates_that_slots_share_by_kind(spark):
    slots = [(o, s, s, 100 + s, "ab"[s % 2]) for o in range(5) for s in range(1, 4 + o % 2)]
    lists = [("a", k % 3, 200 + k) for k in range(9)] + [("b", k, 104 - k) for k in range(8)]
    shared = spark.createDataFrame(slots, "oid long, slot long, ord long, occupant long, kind string")
    kinds = spark.createDataFrame(lists, "kind string, rank int, candidate long")
    each = shared.join(kinds, "kind").select("oid", "slot", "rank", "candidate")
    got = planned_chains(shared, kinds, 6, by=("kind",)).collect()
    assert got and sorted(got) == sorted(planned_chains(shared.drop("kind"), each, 6).collect())
