import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracelake.llm import token_alignment as align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


def spelled(models):
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    one = {i: bytes(char[c] for c in t) for t, i in models[0].get_vocab().items()}
    two = {i: bytes([int(p[3:5], 16)]) if models[1].is_byte(i) else p.replace("▁", " ").encode() for i in range(32000) for p in [models[1].id_to_piece(i)]}
    return one, two


def expected(texts, models):
    """Each text token by token; pairs by comparing all tokens of a group."""
    of_a, of_b = spelled(models)
    rows, held = [], Counter()
    for t in texts:
        a, b = (models[0].encode(" " + t, add_special_tokens=False).ids, models[1].encode(t)) if t else ([], [])
        if not t or b"".join(of_a[i] for i in a) != (" " + t).encode() or b"".join(of_b[i] for i in b) != (" " + t).encode():
            a, b = [], []
        groups, i, j, x, y = [], 0, 0, 0, 0
        one, two = [], []
        while i < len(a) or j < len(b):
            if x <= y:
                one.append(a[i])
                x += len(of_a[a[i]])
                i += 1
            else:
                two.append(b[j])
                y += len(of_b[b[j]])
                j += 1
            if x == y:
                groups.append((one, two))
                one, two = [], []
        links = [(p, q) for one, two in groups for p in one for q in two]
        held.update(set(links))
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((len(a), len(b), len(groups), links, text))
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    return [(n_a, n_b, n_g, len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(t.encode()).hexdigest() if t else "") for n_a, n_b, n_g, links, t in rows], [r[4] for r in rows]


def texts():
    pick = random.Random(6)
    signs = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "中文", "😀", "\x00", "aaaa", "----", "<|endoftext|>", "<s>", "<0x41>", "ﬁ", "'s", "1234", "▁", "Überraschung ", "​"]
    said = ["".join(pick.choice(signs) for _ in range(pick.randrange(30))) for _ in range(300)]
    words = ["hello", "tokenization", "straße", "deduplication", "naïve", "12,345.67"]
    said += [" ".join(pick.choice(words) for _ in range(pick.randrange(60))) for _ in range(100)]
    return said + ["", None, " ", "   ", "a" * 3000, "ab-" * 900, "▁", "hello world", "hello world"]


@pytest.mark.parametrize("block", [1 << 21, 700])
def test_equals_brute_force(make_docs, models, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    if block == 700:
        monkeypatch.setattr(align, "LINKS", 50)
        monkeypatch.setattr(align, "LANE", 5)
    said = texts()
    want, groups = expected([t or "" for t in said], models)
    found = align.linked(make_docs(list(enumerate(said))), A, B, ["doc_id", "twin"]).collect()
    got = {r.doc_id: tuple(r)[2:] for r in found}
    assert [got[i] for i in range(len(said))] == want
    assert found[0].twin == "x" and any(w[0] == 0 for w, t in zip(want, said) if t)
    whole = align.groups(make_docs(list(enumerate(said))), A, B, ["doc_id"]).collect()
    assert [g for _, g in sorted((r.doc_id, r.groups) for r in whole)] == groups


def test_gallop_finds_lower_bounds():
    pick = np.random.default_rng(2)
    for size in (1, 5, 64, 1000):
        into = np.unique(pick.integers(0, 5000, size * 3))
        driving = np.sort(pick.choice(into, size)) - pick.integers(0, 2, size)
        driving = np.sort(driving)
        assert (align.gallop(driving, into, np.zeros(size, np.int64)) == np.searchsorted(into, driving)).all()


def test_null_ids_repeated_rows_clashing_names_and_empty(make_docs, models):
    rows = [(None, "some words"), (1, "some words"), (1, "some words"), (1, "other")]
    found = align.linked(make_docs(rows).withColumnRenamed("twin", "n_links"), A, B, ["doc_id", "n_links"])
    want, _ = expected([t for _, t in rows], models)
    assert found.columns == ["doc_id", *align.RESULTS]
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(want)
    assert align.linked(make_docs([]), A, B, ["doc_id"]).count() == 0
