import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.llm import quality
from tracelake.llm.quality import Training

SMALL = Training(bits=12, shards=2)


def texts():
    pick = random.Random(1)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(5))
    good = [(i, " ".join(word() for _ in range(40)) + ".") for i in range(0, 300, 2)]
    bad = [(i, " ".join(word().upper() + "!!" for _ in range(40))) for i in range(1, 300, 2)]
    return good + bad


def test_held_out_accuracy(spark, make_docs):
    docs = make_docs(texts())
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels, F.col("doc_id") < 200, ["doc_id"], SMALL).where("doc_id >= 200").collect()
    assert len(got) == 100 and sum(r.predicted == 1 - r.doc_id % 2 for r in got) >= 97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_odd_rows(spark, make_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "a b"), (4, "long " * 50000)]
    got = quality.judge(make_docs(rows), labels, None, ["doc_id", "twin", "n_chars"], SMALL).collect()
    assert len(got) == 6 and got[0].score == got[1].score == got[4].score and got[2].score == got[3].score
    none = quality.judge(make_docs(rows), labels.where("false"), None, ["doc_id"], SMALL).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.judge(make_docs([]), labels, None, ["doc_id"], SMALL).count() == 0


def test_long_shards_and_batches_are_hashed_in_blocks(spark, monkeypatch):
    """N-grams take many times the memory of their text: those of a shard are never held all at once."""
    texts = [" ".join(f"w{i % 97}x{k % 31}" for k in range(2000)) for i in range(200)]
    seen, real = [], quality.features
    monkeypatch.setattr(quality, "features", lambda data, offsets, bits: seen.append(len(data)) or real(data, offsets, bits))
    labels = np.arange(len(texts)) % 2.0
    blocks = quality.fit_shard(pa.array(texts).cast(pa.binary()), labels, quality.Training(epochs=1))
    assert sum(seen) == sum(map(len, texts)) > 2 * quality.BLOCK and max(seen) <= quality.BLOCK
    monkeypatch.setattr(quality, "BLOCK", 1 << 30)
    assert np.array_equal(blocks, quality.fit_shard(pa.array(texts).cast(pa.binary()), labels, quality.Training(epochs=1)))
