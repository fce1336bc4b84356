import random
import re

import pytest

from tracelake.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def expected(texts, items, length):
    out = []
    for i, text in texts:
        own, hit, found = words(text), set(), set()
        for item, said in items:
            w = words(said)
            n = min(length, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[s : s + n]:
                        hit.update(range(at, at + n))
                        found.add(str(item))
        out.append((i, len(own), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def result(docs, items, length):
    rows = decontaminate.report(docs, items, length).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in rows], key=str)


@pytest.mark.parametrize("length", [10, 3])
def test_report_equals_brute_force(spark, make_docs, length):
    pick = random.Random(3)
    vocab = ["the", "of", "in", "É", "é", "x1"] + [f"w{i}" for i in range(25)]
    text = lambda n: [pick.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(pick.choice([1, 4, 9, 10, 14, 30])))) for k in range(12)] + [(2, "other text of a repeated id here"), (40, None), (41, " ... "), (42, "zz")]
    docs = []
    for i in range(60):
        own = text(pick.randrange(40))
        for _ in range(pick.randrange(3)):
            said = words(pick.choice(items)[1])
            a = pick.randrange(len(said) + 1)
            own += said[a : a + 12] + text(2)
        docs.append((i, ", ".join(own).title() if i % 3 else " ".join(own)))
    docs += [(100, None), (101, ""), (102, "ZZ top zz"), (3, docs[3][1]), (None, "zz"), (103, "a " * 30000 + "zz")]
    bench = spark.createDataFrame([(k, t, 1, "y") for k, t in items], "item_id long, text string, doc_id int, words string")
    assert result(make_docs(docs), bench, length) == expected(docs, items, length)
    clean = sorted((r.doc_id for r in decontaminate.remove_contaminated(make_docs(docs), bench, length).collect()), key=str)
    assert clean == sorted((r[0] for r in expected(docs, items, length) if not r[5]), key=str)


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert result(make_docs([(1, "a b")]), bench, 10) == [(1, 2, 0, 0, "", False)]
    assert result(make_docs([]), spark.createDataFrame([(1, "a b")], "item_id long, text string"), 10) == []


def test_proximity(make_docs):
    docs = make_docs({1: "alpha x beta y y y y alpha", 2: "beta alpha", 3: "alpha " + "z " * 50 + "beta", 4: None})
    got = sorted((r.doc_id, r["first"], r["last"]) for r in decontaminate.proximity_matches(docs, ["alpha", "beta"], 4).collect())
    assert got == [(1, 0, 2), (2, 0, 1)]
