import random
from dataclasses import replace

import pytest

from tracelake.llm import jaccard_join
from tracelake.llm.jaccard_join import Join


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def expected(texts):
    """Groups by comparing every two sets."""
    sets = {i: shingles(t) for i, t in texts.items()}
    low = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in sets}


def corpus(seed):
    """Exact and near copies at all distances, shared passages, short texts."""
    pick = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [pick.choice(vocab) for _ in range(n)]
    passage, bases, texts = text(40), [text(120) for _ in range(3)], {}
    for i in range(90):
        kind = i % 6
        if kind == 0:
            words = text(pick.randrange(1, 150)) + passage
        elif kind in (1, 2, 3):
            words = list(bases[kind - 1])
            for _ in range(pick.randrange(8)):
                words[pick.randrange(len(words))] = pick.choice(vocab)
        elif kind == 4:
            words = text(pick.randrange(8))
        else:
            words = list(bases[0]) if i % 4 else text(60)
        texts[i + 5] = "  ".join(words).upper() if i % 7 == 0 else " ".join(words)
    return texts


@pytest.mark.parametrize("how", [Join(filter_bits=12, hot_from=4), replace(Join(filter_bits=12), stars=3)])
def test_groups_equal_all_pairs(make_docs, how):
    texts = corpus(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(make_docs(texts), how).collect()}
    assert got == expected(texts)


def test_nulls_empty_texts_and_repeated_rows(make_docs):
    long = " ".join(f"word{i}" for i in range(30000))
    texts = [(4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (7, None), (8, ""), (9, " \n"), (None, "a b c d e f"), (11, "x y"), (12, "X  y"), (13, long), (14, long + " end")]
    docs = make_docs(texts)
    how = Join(filter_bits=12)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.groups(docs, how).collect()), key=str)
    assert got == sorted([(4, 2, 2), (2, 2, 2), (2, 2, 2), (7, 0, 7), (8, 0, 8), (9, 0, 9), (None, 2, 2), (11, 1, 11), (12, 1, 11), (13, 29996, 13), (14, 29997, 13)], key=str)
    kept = [r.doc_id for r in jaccard_join.first_of_each_group(docs, how).collect()]
    both = [(1, "one text of this id alone"), (1, "quite another text under that id"), (1, None), (1, None)]
    assert sorted(str(r.text) for r in jaccard_join.first_of_each_group(make_docs(both), how).collect()) == sorted(str(t) for t in {t for _, t in both})
    assert sorted(kept, key=str) == sorted([2, 7, 8, 9, None, 11, 13], key=str)
    assert jaccard_join.groups(make_docs([]), how).count() == 0


def test_prefix_is_long_enough():
    for n in range(1, 300):
        need = -(-80 * n // 100)
        assert jaccard_join.prefix_size(n, 80) == n - need + 1


def truncations(seed):
    """Chains of texts cut shorter and shorter: a cut one lacks nothing of the longer one; some rows twice."""
    pick = random.Random(seed)
    texts, free = [], iter(pick.sample(range(1000), 1000))
    for k in range(12):
        words = [f"t{k}x{i}" for i in range(204)]
        sizes = [204, 169, 139] + [pick.randrange(60, 204) for _ in range(k % 3)]
        ids = sorted(next(free) for _ in sizes) if k % 2 else [next(free) for _ in sizes]
        texts += [(i, " ".join(words[:n])) for i, n in zip(ids, sizes)]
    return texts + texts[::5]


@pytest.mark.parametrize("seed", [1, 2])
def test_shorter_copies_are_linked_beside_their_centre(make_docs, seed):
    texts = truncations(seed)
    how = Join(filter_bits=12, hot_from=4)
    got = jaccard_join.groups(make_docs(texts), how).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected(dict(texts))
    kept = sorted(r.doc_id for r in jaccard_join.first_of_each_group(make_docs(texts), how).collect())
    assert kept == sorted({low for _, low in expected(dict(texts)).values()})


def test_large_group_of_near_copies_opens_few_pairs(make_docs, monkeypatch):
    """512 near copies of one text, in chains: whatever is compared set by set stays linear in the group."""
    pick = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(512):
        words = list(base)
        for k in pick.sample(range(120), pick.randrange(1, 3)):
            words[k] = f"x{i}y{k}"
        texts[i] = " ".join(words[: pick.randrange(112, 121)])
    texts |= {1000 + i: " ".join(f"{pick.randrange(400)}" for _ in range(60)) for i in range(300)}
    seen = []
    real = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, sets: seen.append(pairs.count()) or real(pairs, sets))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(make_docs(texts), Join(filter_bits=12, hot_from=4)).collect()}
    assert got == expected(texts)
    assert sum(seen) < 12 * len(texts)


def test_near_copies_without_a_middle_meet_few_blocks(make_docs, monkeypatch):
    """600 copies with three or four words of their own: many are linked to each other and few to any one, so the blocks of
    different groups would meet in squares before what links them is known."""
    pick = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(600):
        words = list(base)
        for k in pick.sample(range(150), pick.choice((2, 3, 3, 4))):
            words[k] = f"x{i}y{k}"
        texts[i] = " ".join(words)
    met = []
    real = jaccard_join.stored

    def counted(df, label):
        out = real(df, label)
        if label == "block-pairs":
            met.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(make_docs(texts), Join(filter_bits=12, hot_from=4)).collect()}
    assert got == expected(texts)
    assert sum(met) < 10 * len(texts)


def joined(edges):
    """The smallest node each is connected with, one edge after another."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_components_go_on_from_known_ones(spark):
    pick = random.Random(3)
    some = [(pick.randrange(400), pick.randrange(400)) for _ in range(330)]
    edges = [(a, b) for a, b in some if a != b] + [(500 + i, 501 + i) for i in range(60)] + [(700, 600 + i) for i in range(200)] + [(-5, 700)]
    make = lambda e: spark.createDataFrame(e, "src long, dst long")
    rows = lambda df: {r.node: r.component for r in df.collect()}
    known = jaccard_join.stored(jaccard_join.common.components(make(edges[::2])), "known")
    assert rows(known) == joined(edges[::2])
    assert rows(jaccard_join.common.components(make(edges[1::2]), known)) == joined(edges)
    assert jaccard_join.common.components(make([*edges[:20:2], (9, 9)]), known) is known
    assert rows(jaccard_join.common.components(make([]))) == {}


def test_links_of_a_large_group_are_walked_once(make_docs, monkeypatch):
    """What the rounds that look for components write stays below the number of texts, however often groups are merged."""
    pick = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(600):
        words = list(base)
        for k in pick.sample(range(150), pick.choice((2, 3, 3, 4))):
            words[k] = f"x{i}y{k}"
        texts[i] = " ".join(words)
    walked = []
    real = jaccard_join.common.stored

    def counted(df, label):
        out = real(df, label)
        walked.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join.common, "stored", counted)
    assert len(jaccard_join.groups(make_docs(texts), Join(filter_bits=12, hot_from=4)).collect()) == len(texts)
    assert sum(walked) < 6 * len(texts)
