import random

import corpus_pipeline
from tracelake.llm import pii

from .test_decontaminate import words
from .test_jaccard_join import expected as groups_of


def tables(spark, folder):
    pick = random.Random(9)
    vocab = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: [pick.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(25))) for k in range(4)]
    docs, labels = [], []
    for i in range(240):
        if i % 4 == 3:
            said = " ".join(w.upper() + "!!" for w in text(60))
        else:
            said = " ".join(text(60))
        if i % 20 == 4:
            said = docs[i - 4][1]
        elif i % 20 == 8:
            said = docs[i - 8][1] + " tail"
        elif i % 20 == 12:
            said += " " + items[i % 4][1]
        elif i % 20 == 16:
            said += " mail a@b.co or c at d dot com"
        docs.append((i, said, "en", "s", len(said)))
        labels.append((i, 0 if i % 4 == 3 else 1, 0))
    docs.append((900, None, "en", "s", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}, items


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    texts, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "tokens" or docs.columns == columns
    good = {i for i in texts if i % 4 != 3 or i == 900}
    assert len(good ^ set(kept["quality"])) <= 3
    first = groups_of({i: texts[i] for i in kept["quality"]})
    assert set(kept["near_duplicates"]) == {i for i, (_, low) in first.items() if i == low}
    grams = {tuple(w[a : a + 10]) for _, t in items for w in [words(t)] for a in range(len(w) - 9)}
    dirty = {i for i in kept["near_duplicates"] for w in [words(texts[i])] if any(tuple(w[a : a + 10]) in grams for a in range(len(w) - 9))}
    assert dirty and set(kept["decontamination"]) == set(kept["near_duplicates"]) - dirty
    for i, row in kept["personal_data"].items():
        spans = [s for part in pii.find(texts[i] or "") for s in part]
        assert row.text == (None if texts[i] is None else pii.redacted(texts[i], spans)) and row.n_chars == len(row.text or "")
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in kept["tokens"].values())
    assert set(kept["tokens"]) == set(kept["decontamination"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(kept["tokens"])


def test_odd_tables(spark, tmp_path):
    """Clashing names, repeated ids and rows, null ids, a very long text, empty tables."""
    folder = str(tmp_path)
    tables(spark, folder)
    form = "doc_id long, text string, score double, predicted string, ids string, decoded string, spans string, n_tokens string, round_trip string, node string, __first string"
    said = [" ".join(f"plain{i}word{k}" for k in range(60)) for i in range(4)]
    rows = [(1, said[0]), (1, said[0]), (1, said[1]), (None, said[2]), (None, said[2]), (7, said[3] + " mail a@b.co"), (8, "long " * 70000), (9, None), (10, "")]
    rows = [(i, t, 0.5, "p", "i", "d", "s", "n", "r", "o", "f") for i, t in rows]
    for given in (rows, []):
        docs = spark.createDataFrame(given, form)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, stage(spark, docs, folder)
            docs.write.parquet(f"{folder}/{name}-{len(given)}")
            docs = spark.read.parquet(f"{folder}/{name}-{len(given)}")
            if name != "tokens":
                assert docs.columns == before
            if name == "near_duplicates" and given:
                kept = docs.collect()
                assert {(r.score, r.predicted, r.ids, r["__first"]) for r in kept} <= {(0.5, "p", "i", "f")}
                texts = sorted((str(r.doc_id), r.text or "") for r in kept if r.doc_id in (1, None))
                assert all(texts.count(x) == 1 for x in texts if x[0] == "1")
        assert len(set(docs.columns)) == len(docs.columns) and {"ids", "n_tokens", "round_trip"} <= set(docs.columns)
        assert all(r.round_trip and r.n_tokens == len(r.ids) and r.spans == "s" for r in docs.collect())
