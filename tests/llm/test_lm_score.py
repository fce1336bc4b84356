import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import lm_score
from tracelake.llm.lm_score import Neural

SMALL = Neural(classes=24, width=6, noise=12, batch=256)


def tokens(text):
    return (text or "").encode().lower().split() + [None]


@pytest.mark.parametrize("how", [SMALL, replace(SMALL, head=24)])
def test_counts_equal_brute_force(make_docs, how):
    pick = random.Random(3)
    texts = [(i, " ".join(pick.choice(["The", "of", "x", f"w{pick.randrange(60)}"]) for _ in range(pick.randrange(30)))) for i in range(60)]
    texts += [(70, None), (71, ""), (72, "never seen é\u00a0x"), (5, texts[5][1]), (5, texts[5][1]), (None, "of of"), (73, "the of " * 40000)]
    seen = Counter(t for i, text in texts if i is not None and i % 5 for t in tokens(text))
    total, distinct = sum(seen.values()), len(seen)
    got = lm_score.judge(make_docs(texts), F.col("doc_id") % 5 != 0, how).collect()
    rows = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    for i, text in texts:
        own, r = tokens(text), rows[i]
        base = sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(seen[t] > 0 for t in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_class_probabilities_sum_to_one():
    p = lm_score.fresh(SMALL)
    n = SMALL.classes
    for one, two in ((0, 1), (n - 1, n - 1), (n - 2, 3)):
        logs = lm_score.log10_classes(p, np.full(n - 1, one), np.full(n - 1, two), np.arange(n - 1), n)
        assert (10**logs).sum() == pytest.approx(1, abs=1e-5)


def test_the_model_uses_the_context(make_docs):
    pick = random.Random(4)
    follow = {w: [f"a{(k * 3 + d) % 12}" for d in range(2)] for k, w in enumerate(f"a{i}" for i in range(12))}
    texts = []
    for i in range(200):
        words = ["a0"]
        for _ in range(60):
            words.append(pick.choice(follow[words[-1]]))
        texts.append((i, " ".join(words)))
    got = lm_score.judge(make_docs(texts), F.col("doc_id") % 5 != 0, replace(SMALL, batch=64)).where("doc_id % 5 = 0").collect()
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_nothing_to_learn_from(make_docs):
    got = lm_score.judge(make_docs([(1, "a b"), (2, None)]), F.lit(False), SMALL).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0), (1, 0, 0)}
    assert lm_score.judge(make_docs([]), F.lit(True), SMALL).count() == 0


def _walks(words, docs, pick):
    """Texts in which each word is followed by one of two."""
    follow = {w: [words[(k * 3 + d) % len(words)] for d in range(2)] for k, w in enumerate(words)}
    texts = []
    for i in range(docs):
        said = [words[0]]
        for _ in range(60):
            said.append(pick.choice(follow[said[-1]]))
        texts.append((i, " ".join(said)))
    return texts


def test_words_without_a_class_are_told_apart(make_docs):
    texts = _walks([f"a{i}" for i in range(60)], 400, random.Random(7))
    how = replace(SMALL, classes=8, width=12, noise=24, batch=64)
    got = lm_score.judge(make_docs(texts), F.col("doc_id") % 5 != 0, how).where("doc_id % 5 = 0").collect()
    assert sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_all_words_of_a_vocabulary_share_one_probability(make_docs, head):
    pick = random.Random(8)
    texts = [(i, " ".join(f"w{int(1500 * pick.random() ** 3)}" for _ in range(40))) for i in range(150)]
    docs, how = make_docs(texts), replace(SMALL, classes=8, head=head)
    counted = lm_score.stored(lm_score.counts(docs), "counts")
    vocab = lm_score.vocabulary(counted, how)
    rows = counted.collect()
    keys, n = np.array([r.token for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows])
    classed = np.isin(keys, vocab.classed)
    assert len(vocab.mass) < len(keys) and vocab.tail_mass == pytest.approx((n[~classed] + 0.5).sum() + 0.5)
    p = lm_score.train(docs, vocab, how)
    classes, cells = lm_score.classes_of(keys, vocab, 8), lm_score.cells_of(keys, vocab)
    context = 8 + cells[classes == 6][0]
    logs = lm_score.log10_classes(p, np.full(len(keys), context), np.full(len(keys), 7), classes, 8, cells)
    inside = np.where((classes == 6) & (cells >= len(vocab.mass) // 2), np.log10(n + 0.5) - np.log10(vocab.mass[cells]), 0.0)
    # what is missing is held by words never seen
    assert 0.9 < (10 ** (logs + inside)).sum() < 1 + 1e-4
