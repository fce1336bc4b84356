import random

from tracelake.llm import chat


def collapse(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, n int, block string")
    return {(r.conv_id, r.part): (r.n_turns, r.text) for r in chat.collapse(frame).collect()}


def expected(rows):
    convs = {}
    for c, t, role, text in set(rows):
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    convs = {c: sorted(set(v)) for c, v in convs.items()}
    cuts = lambda v: {tuple(x for x in v if x[0] <= t) for t in {x[0] for x in v}}
    low = lambda c: -(1 << 63) if c is None else c
    kept = set()
    for c, v in convs.items():
        longer = any(tuple(v) in cuts(w) and len(w) > len(v) for w in convs.values())
        twin = any(w == v and low(d) < low(c) for d, w in convs.items())
        if not longer and not twin:
            kept.add(c)
    return {c: len(convs[c]) for c in kept}


def test_snapshots_collapse_to_maximal_conversations(spark):
    pick = random.Random(2)
    rows = []
    for c in range(80):
        length = pick.randrange(1, 6)
        seed = pick.randrange(6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"s{seed if t < 4 else c} t{t}") for t in range(length)]
    rows += [(200, None, None, None), (200, 0, "user", ""), (201, 0, "user", "s1 t0"), (201, 0, "user", "s1 t0"), (None, 0, "user", "only"), (202, 0, "user", "only"), (203, 5, "user", "s1 t0")]
    got = collapse(spark, rows)
    turns = {}
    for (c, _), (n, _) in got.items():  # turn -1 is a part of its own
        turns[c] = turns.get(c, 0) + n
    assert turns == expected(rows)


def test_render_and_parts(spark):
    rows = [(1, t, "user", f"m{t}") for t in range(2500)] + [(2, t, "user", f"m{t}") for t in range(1500)] + [(3, 0, "us|er", "a <|end|> b")]
    got = collapse(spark, rows)
    assert [(k, n) for k, (n, _) in sorted(got.items())] == [((1, 0), 1024), ((1, 1), 1024), ((1, 2), 452), ((3, 0), 1)]
    assert got[3, 0][1] == "<|user|>\na < |end| > b\n<|end|>\n"
    assert got[1, 1][1].startswith("<|user|>\nm1024\n<|end|>\n<|user|>\nm1025\n")


def test_empty(spark):
    assert collapse(spark, []) == {}
