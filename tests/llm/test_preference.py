from __future__ import annotations

from weftline.llm.preference import END, START, neighbours

TURNS = "conv_id long, turn long, role string, text string"


def show(role, text):
    return f"{START}{role or 'user'}\n{text or ''}{END}"


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn if turn is not None else -1, role, text))
    out = {}
    for pair in {c // 2 for c in convs}:
        order = lambda x: (x[0], x[1] or "", x[2] or "")
        c, r = (sorted(convs.get(pair * 2 + k, []), key=order) for k in (0, 1))
        n = 0
        while n < min(len(c), len(r)) and c[n][1:] == r[n][1:]:
            n += 1

        def done(turns):
            text, mask = "", []
            for _, role, said in turns:
                if role == "assistant":
                    start = len(text) + len(f"{START}{role}\n")
                    mask.append(f"{start}:{len(text) + len(show(role, said))}")
                text += show(role, said)
            return text, ",".join(mask)

        out[pair] = (n, done(c[:n])[0], *done(c[n:]), *done(r[n:]))
    return out


def test_against_brute_force(spark):
    shared = [("system", "Be brief"), ("user", "Why?"), ("assistant", "é🙂")]
    rows = [(10, i, *t) for i, t in enumerate([*shared, ("user", "More"), ("assistant", "A")])]
    rows += [(11, i, *t) for i, t in enumerate([*shared, ("user", "More"), ("assistant", "B"), ("assistant", "C")])]
    rows += [(20, 0, "user", "x"), (21, 0, "user", "x"), (30, 0, "user", "alone"), (33, 5, None, None), (32, 4, None, "")]
    rows += [(40, 0, "user", "same"), (40, 0, "user", "same"), (41, 0, "user", "same"), (None, 0, "user", "lost"), (50, 0, "assistant", "z" * 100000), (51, None, "user", "q"), (51, 1, "assistant", "")]
    found = {r.pair_id: r for r in neighbours(spark.createDataFrame(rows, TURNS)).collect()}
    want = brute(rows)
    assert found.keys() == want.keys()
    for pair, r in found.items():
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) == want[pair], pair
    assert found[5].n_prompt_turns == 4 and found[10].chosen == found[10].rejected == "" and not found[15].paired and found[16].n_prompt_turns == 0


def test_masks_cut_out_what_assistants_say(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no")]
    (r,) = neighbours(spark.createDataFrame(rows, TURNS)).collect()
    start, end = map(int, r.chosen_mask.split(":"))
    assert r.chosen[start:end] == "yes" + END


def test_no_rows_and_extra_columns(spark):
    assert neighbours(spark.createDataFrame([], TURNS)).count() == 0
    extra = spark.createDataFrame([(0, 0, "user", "a", "x", 1, 2)], TURNS + ", pair_id string, side int, n int")
    assert neighbours(extra).count() == 1


def test_native_plan(spark):
    plan = neighbours(spark.createDataFrame([(0, 0, "user", "a")], TURNS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pairs_of_large_ids(spark):
    """Beyond 2^53, where doubles skip numbers."""
    rows = [((1 << 54) + k, turn, role, f"{k} {turn}") for k in range(12) for turn, role in ((0, "user"), (1, "assistant"))]
    found = {r.pair_id: r for r in neighbours(spark.createDataFrame(rows, TURNS)).collect()}
    want = brute(rows)
    assert found.keys() == want.keys() == {(1 << 53) + k for k in range(6)}
    for pair, r in found.items():
        assert (r.chosen_id, r.rejected_id) == (2 * pair, 2 * pair + 1)
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) == want[pair]
