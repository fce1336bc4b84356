import hashlib
import itertools
import random
import re
import zlib

from tracelake.llm import conversation_repair as repair

WHITE = " \t\n\x0b\x0c\r"
SHAPE = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) by trying every edit of every row and every run of up to two inserts in every gap."""
    runs = ["", "u", "a", "ua", "au"]
    seen, faults, best = set(), [], None
    for role, text in rows:
        said = text.rstrip(WHITE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    moves = [["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for f in faults]
    for edits in itertools.product(*moves):
        for gaps in itertools.product(runs, repeat=len(rows) + 1):
            cost, audit, initials, lines = 0, "", "", []
            for k, gap in enumerate(gaps):
                for g in gap:
                    cost, audit, initials = cost + 2, audit + "I", initials + g
                    lines.append({"u": "user:", "a": "assistant:"}[g])
                if k == len(rows):
                    break
                (role, text), e = rows[k], edits[k]
                audit += e if e in "DK" else "R"
                if e == "D":
                    cost += 3
                    continue
                cost += (0 if e == "K" else 2) + (faults[k] == "truncated")
                role = role if e == "K" else {"u": "user", "a": "assistant"}[e]
                initials += role[:1] or "?"
                lines.append(f"{role}:{text}")
            if SHAPE.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return (*best, faults)


def damage(table):
    out = []
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    cost, audit, lines, faults = cheapest([(r[2], r[3]) for r in rows])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    firsts = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


FORM = "conv_id long, turn long, role string, text string, audit string, cost string"


def test_random_conversations_equal_brute_force(spark):
    pick = random.Random(3)
    table = []
    for conv in [*range(150), None]:
        for _ in range(pick.randrange(1, 5)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = pick.choice(["Hi.", "Hi there", "", " \n", "So? ", "é!\x0b", "no ", None, "Hi."])
            table.append((conv, pick.choice([None, 0, 1, 2, 3, 9]), role, text, "x", "y"))
    frame = spark.createDataFrame(table, FORM)
    got = {r.conv_id: tuple(r)[1:] for r in repair.damage_and_repair(frame).collect()}
    hurt = damage([t[:4] for t in table])
    want = {c: expected([r for r in hurt if r[0] == c]) for c in {t[0] for t in table}}
    assert got == want and len(got) == 151


def test_segments_join_like_one_path(spark, monkeypatch):
    pick = random.Random(8)
    rows = [(pick.choice("uast"), pick.choice(["none"] * 4 + ["blank", "truncated"])) for _ in range(61)]
    whole = repair.solve(rows, repair.ACCEPTING)[0]
    for size in (1, 2, 7, 30):
        cuts = [rows[k : k + size] for k in range(0, len(rows), size)]
        parts = [{(p, q): v[:2] for q in range(repair.STATES) for p, v in repair.solve(cut, (q,)).items()} for cut in cuts]
        cost, audit, states = repair.join_segments(parts)
        assert (cost, audit) == whole[:2]
        said = [x for cut, p, q in zip(cuts, states, states[1:]) for x in repair.solve(cut, (q,))[p][2]]
        assert "".join(said) == "".join(whole[2])
    monkeypatch.setattr(repair, "SEGMENT", 3)
    table = [(7, k, pick.choice(["user", "assistant", "system"]), pick.choice(["A.", f"b{k}", f"c{k}."])) for k in range(40)]
    short = repair.repair(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).first()
    monkeypatch.setattr(repair, "SEGMENT", 512)
    assert short == repair.repair(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).first()


def test_long_and_empty(spark):
    long = [(1, k, "user" if k % 2 == 0 else "assistant", f"word {k} " * 50 + ".") for k in range(2500)] + [(1, 2500, "user", "x" * 300000 + ".")]
    row = repair.repair(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).first()
    assert row.cost == 2 and row.audit == "K" * 2501 + "I" and row.illegal == 0
    text = "\n".join(f"{r}:{t}" for _, _, r, t in long) + "\nassistant:"
    assert row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert repair.damage_and_repair(spark.createDataFrame([], FORM)).count() == 0
