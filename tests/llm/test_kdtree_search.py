import numpy as np
import pytest

from tracelake.llm import kdtree_search
from tracelake.llm.kdtree_search import Search, Tree


def brute(vectors, asked, k):
    out = set()
    for q in asked:
        scores = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("how", [Search(k=5, shard_rows=40, block_rows=7, leaf=4), Search(k=5)])
def test_top_k_equals_brute_force_with_ties(spark, how):
    seed = np.random.default_rng(1)
    vectors = {int(i): seed.normal(0, 0.3, 6).round(2).tolist() for i in range(150)}
    vectors |= {i: vectors[3] for i in range(150, 190)} | {i: [1.0, 2.0] for i in range(190, 193)}
    rows = [(i, v, 1) for i, v in vectors.items()] + [(3, vectors[3], 1)]
    rows += [(500, None, 1), (501, [], 1), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (520, [float("nan")] * 6, 1), (540, [float("inf")] * 6, 1), (None, vectors[3], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    clean = kdtree_search.clean(frame, "vec_id", "embedding", 64.0)
    got = kdtree_search.top_k(clean, clean.where("id % 10 = 0"), how).collect()
    whole = {i: np.floor(64 * np.array(v)) for i, v in vectors.items()}
    assert {(r.query_id, r["rank"], r.id, int(r.score)) for r in got} == brute(whole, [i for i in whole if i % 10 == 0], 5)
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})


def test_fewer_candidates_and_empty_tables(spark):
    frame = spark.createDataFrame([(20, [1.0]), (21, [2.0]), (22, [-1.0])], "id long, x array<double>").selectExpr("id", "size(x) as dim", "x")
    got = [(r.query_id, r["rank"], r.id, r.score) for r in kdtree_search.top_k(frame, frame.where("id = 20"), Search(k=5)).orderBy("rank").collect()]
    assert got == [(20, 1, 21, 2.0), (20, 2, 22, -1.0)]
    assert kdtree_search.top_k(frame.where("false"), frame.where("false")).count() == 0


def test_a_tree_visits_few_leaves_where_boxes_are_tight():
    seed = np.random.default_rng(2)
    points = np.floor(seed.uniform(-64, 64, (5000, 2)))
    tree = Tree(np.arange(5000), points, 16)
    (score, names), = tree.search(np.array([-1]), np.array([[3.0, 5.0]]), 10, np.array([-np.inf]))
    want = sorted((-(points @ [3.0, 5.0])[i], i) for i in range(5000))[:10]
    assert [(-s, n) for s, n in zip(score, names)] == want
