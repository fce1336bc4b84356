import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tracelake.llm import sentencepiece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    signs = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "中", "😀", "\x00", "aaaa", "----", "<s>", "ﬁ", "'s", "1"]
    pick = random.Random(4)
    texts = ["".join(pick.choice(signs) for _ in range(pick.randrange(30))) for _ in range(1500)]
    return texts + ["", "a" * 3000, " " * 3000, "ab" * 900, "=" * 399, "the " * 1500, "-=" * 300 + "x" * 700]


def test_ids_equal_the_library(library):
    texts = odd_texts()
    ids, starts = sentencepiece_bpe.encode(texts, sentencepiece_bpe.pieces(PATH))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == library.encode(texts)


def test_decode_equals_the_library_for_any_ids(library):
    pick = random.Random(5)
    some = [0, 1, 2, 3 + 0xE4, 3 + 0xB8, 3 + 0xAD, 259, 300, 29871]
    rows = [[pick.choice([*some, pick.randrange(32000)]) for _ in range(pick.randrange(8))] for _ in range(2000)]
    starts = np.append(0, np.cumsum([len(r) for r in rows]))
    flat = np.array([x for r in rows for x in r], np.int32)
    assert sentencepiece_bpe.decode(flat, starts, sentencepiece_bpe.pieces(PATH)) == [library.decode(r) for r in rows]


def test_ids_outside_the_vocabulary_are_refused():
    with pytest.raises(ValueError):
        sentencepiece_bpe.decode(np.array([40000]), np.array([0, 1]), sentencepiece_bpe.pieces(PATH))


def test_frame(make_docs, library):
    texts = [(1, "Hello there"), (2, None), (3, ""), (1, "Hello there"), (None, "x y " * 30000)]
    got = sentencepiece_bpe.round_trip(make_docs(texts), PATH, ["doc_id", "score", "twin"]).collect()
    for (i, t), row in zip(texts, got):
        assert (row.doc_id, row.ids, row.decoded, row.twin) == (i, library.encode(t or ""), t or "", "x")
    assert sentencepiece_bpe.round_trip(make_docs([]), PATH, ["doc_id"]).count() == 0
