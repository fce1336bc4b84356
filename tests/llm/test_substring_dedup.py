import random
import re

import pytest

from tracelake.llm import substring_dedup
from tracelake.llm.substring_dedup import Dedup


def expected(docs, window):
    """{doc: (n_words, n_removed, kept)} by a dictionary of all windows in order of place."""
    seen, out = {}, {}
    for i in sorted(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[i] or "")
        gone = set()
        for s in range(len(words) - window + 1):
            g = tuple(words[s : s + window])
            if g in seen:
                gone.update(range(s, s + window))
            else:
                seen[g] = (i, s)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def texts(seed=1):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abAé") for _ in range(pick.randrange(1, 4)))
    passages = [[word() for _ in range(pick.randrange(15, 70))] for _ in range(8)]
    docs = {}
    for i in range(150):
        parts = []
        for _ in range(pick.randrange(1, 5)):
            p = pick.choice(passages)
            a = pick.randrange(len(p))
            parts += pick.choice([[word() for _ in range(pick.randrange(40))], p, p[a:], p[:a], p[3:] + p[3:]])
        docs[i] = pick.choice([" ", "\n", " \t "]).join(parts)
    docs[200], docs[201], docs[202] = None, "", " ".join(["x"] * 5000)
    docs[203] = docs[202] + " tail"
    return docs


@pytest.mark.parametrize("how", [Dedup(), Dedup(20, 12), Dedup(7), Dedup(1), Dedup(2)])
def test_equals_brute_force(make_docs, how):
    docs = texts()
    rows = list(docs.items())
    random.Random(2).shuffle(rows)
    found = substring_dedup.deduplicate(make_docs(rows).repartition(7), ["doc_id", "score", "twin"], how).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found}
    assert got == expected(docs, how.window) and len(found) == len(docs)
    assert {(r.score, r.twin) for r in found} == {(1.5, "x")}


def test_repeated_rows_null_ids_and_shared_ids(make_docs):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, long), (1, long), (None, long), (None, "a " + long), (5, long + " z"), (5, "q")]
    found = substring_dedup.deduplicate(make_docs(rows), ["doc_id", "n_removed"]).collect()
    assert sorted(r.n_removed for r in found if r.doc_id == 1) == [0, 0]
    assert sorted(r.n_removed for r in found if r.doc_id is None) == [30, 30]
    assert sorted((r.n_words, r.n_removed, r.kept) for r in found if r.doc_id == 5) == [(1, 0, "q"), (31, 30, "z")]


def test_large_group_of_copies(make_docs):
    long = " ".join(f"w{k % 97}x{k % 31}" for k in range(400))
    found = substring_dedup.deduplicate(make_docs({i: f"own{i} {long}" for i in range(600)}).repartition(9), ["doc_id"]).collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: 0 if i == 0 else 400 for i in range(600)}


def test_empty_table(make_docs):
    assert substring_dedup.deduplicate(make_docs([]), ["doc_id"]).count() == 0
