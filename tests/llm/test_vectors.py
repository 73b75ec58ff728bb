import numpy as np
import pytest

from auditloom.llm import flat_graph, vptree
from auditloom.llm.vectors import clean

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, id long, v array<float>, tau double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2, None, 0.0) for i, v in rows], SCHEMA)


def clusters(n, dim=24, centres=30, spread=0.35, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return (c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dim))).astype(np.float32)


ODD = [(9000, None), (9001, []), (9002, [1.0, None] * 12), (9003, [float("nan")] * 24), (9004, [float("inf")] * 24), (9005, [1.0, 2.0]), (None, [1.0] * 24), (9006, [0.0] * 24)]


def test_clean(spark):
    x = clusters(6)
    got = clean(frame(spark, [*enumerate(x), (0, x[1]), *ODD])).collect()
    assert sorted(r.id for r in got) == [*range(6), 9006]


def exact_neighbours(x, k):
    d = np.sqrt(((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return [[(int(j), d[i, j]) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]] for i in range(len(x))]


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (vptree.FACTOR, 0.9)])
def test_neighbours_recall_over_several_shards(spark, factor, least):
    x = clusters(1500)
    got = {r.vec_id: r for r in vptree.neighbours(frame(spark, list(enumerate(x))), k=10, factor=factor, shard=200).collect()}
    want = exact_neighbours(x, 10)
    hits = sum(len({j for j, _ in w} & set(got[i].neighbours)) for i, w in enumerate(want))
    assert len(got) == len(x) and hits >= least * 10 * len(x)
    if factor == 1:
        assert all(np.allclose([d for _, d in w], got[i].distances, atol=1e-6) for i, w in enumerate(want))


def test_neighbours_of_odd_rows_and_ties(spark):
    x = clusters(5)
    rows = [*enumerate(x), (5, x[0]), (6, x[0]), (6, x[0]), *ODD]
    got = {r.vec_id: r for r in vptree.neighbours(frame(spark, rows), k=3).collect()}
    assert sorted(got) == [*range(7), 9006]
    assert got[0].neighbours[:2] == [5, 6] and got[0].distances[:2] == [0.0, 0.0] and got[5].neighbours[:2] == [0, 6]
    assert vptree.neighbours(frame(spark, [])).count() == 0
    one = vptree.neighbours(frame(spark, [(1, x[0])])).collect()
    assert len(one) == 1 and one[0].neighbours == []


def test_ties_go_by_id_in_large_groups_of_copies_and_among_equal_distances(spark):
    rng = np.random.default_rng(4)
    x = clusters(700)
    x[rng.permutation(700)[:150]] = np.repeat(x[:3], 50, 0)  # three groups of copies
    grid = np.zeros((500, 24), np.float32)
    grid[:, :3] = 40 + rng.permutation(np.stack(np.meshgrid(*[range(8)] * 3), -1).reshape(-1, 3))[:500]  # unlike vectors at equal distances
    x = np.concatenate([x, grid])
    want = exact_neighbours(x, 10)
    for shard, full in ((5000, None), (250, None), (250, 60)):
        got = {r.vec_id: r for r in vptree.neighbours(frame(spark, list(enumerate(x))), k=10, factor=1.0, shard=shard, full=full).collect()}
        assert len(got) == len(x)
        assert all(got[i].neighbours == [j for j, _ in w] and np.allclose(got[i].distances, [d for _, d in w], atol=1e-9) for i, w in enumerate(want))


def test_only_queries_are_answered_but_all_vectors_are_searched(spark):
    x = clusters(900)
    x[7], x[40] = x[20], x[20]  # copies of a query, one of them a query too
    want = exact_neighbours(x, 10)
    got = {r.vec_id: r for r in vptree.neighbours(frame(spark, list(enumerate(x))), k=10, factor=1.0, shard=200, asked=lambda i: i % 20 == 0).collect()}
    assert sorted(got) == list(range(0, 900, 20))
    assert all(r.neighbours == [j for j, _ in want[i]] for i, r in got.items()) and got[20].neighbours[:2] == [7, 40]


def test_six_hundred_equal_vectors(spark):
    x = np.ones((600, 24), np.float32)
    got = {r.vec_id: r.neighbours for r in vptree.neighbours(frame(spark, list(enumerate(x))), k=3, factor=1.0).collect()}
    assert all(got[i] == [j for j in range(4) if j != i][:3] for i in range(600))


def exact_classes(rows, cosine=0.95):
    """{id: (class, links)} by comparing all vectors that can be compared."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == len(rows[0][1]) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.asarray(v, np.float32).astype(np.float64)
    ids = sorted(good)
    u = np.array([good[i] / np.sqrt((good[i] ** 2).sum()) for i in ids])
    near = u @ u.T >= cosine - 1e-9
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(ids)).min(1))
        if (new == label).all():
            break
        label = new
    return {i: (i, 0) for i, _ in rows if i is not None} | {i: (ids[label[k]], int(near[k].sum())) for k, i in enumerate(ids)}


def got_classes(df, **kw):
    rows = flat_graph.near_duplicates(df, **kw).collect()
    assert len(rows) == len({r.vec_id for r in rows})
    return {r.vec_id: (r.class_id, r.n_links) for r in rows}


def agree(got, want, least):
    links, all_links = sum(min(got[i][1], want[i][1]) for i in want), sum(n for _, n in want.values())
    assert set(got) == set(want) and all(got[i][1] <= want[i][1] for i in want)
    assert links >= least * all_links and sum(got[i][0] == want[i][0] for i in want) >= least * len(want)


@pytest.mark.parametrize("full", [10**6, 120])
def test_near_duplicates_against_all_pairs(spark, full, monkeypatch):
    monkeypatch.setattr(flat_graph, "BLOCK", 50)
    x = clusters(1200, spread=0.2)
    rows = list(enumerate(x))
    want = exact_classes(rows)
    assert sum(n for _, n in want.values()) > 2000
    agree(got_classes(frame(spark, rows), shard=300, full=full), want, 0.95)


def test_a_hot_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "BLOCK", 40)
    rng = np.random.default_rng(8)
    hot = rng.standard_normal(24) + 0.02 * rng.standard_normal((300, 24))
    x = np.concatenate([hot, clusters(600, spread=0.5), np.repeat(hot[:1], 5, 0)]).astype(np.float32)
    rows = list(enumerate(x))
    want = exact_classes(rows)
    assert want[0] == (0, 304)
    agree(got_classes(frame(spark, rows), shard=60, full=100), want, 0.98)


def test_near_duplicates_in_many_shards_are_found_across_them(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    x = unit(rng.standard_normal((2000, 64)))
    off = rng.standard_normal((2000, 64))
    off = unit(off - (off * x).sum(1)[:, None] * x)
    x = np.concatenate([x, 0.955 * x + (1 - 0.955**2) ** 0.5 * off]).astype(np.float32)
    rows = list(enumerate(x))
    want = exact_classes(rows)
    assert sum(n for _, n in want.values()) == 4000
    agree(got_classes(frame(spark, rows), shard=32), want, 0.97)


def test_near_duplicates_of_odd_rows_and_equal_vectors(spark):
    x = clusters(40, centres=40)
    rows = [*enumerate(x), (100, x[0]), (101, x[0]), (101, x[0]), *ODD]
    assert got_classes(frame(spark, rows)) == exact_classes(rows)
    assert flat_graph.near_duplicates(frame(spark, [])).count() == 0
    assert got_classes(frame(spark, [(1, x[0])])) == {1: (1, 0)}


def test_robust_pruning_keeps_what_no_kept_one_covers():
    x = clusters(60, dim=4)
    d = ((x[:1] - x[1:]) ** 2).sum(1)
    order = np.argsort(d)
    kept = flat_graph.prune(x, np.array([0]), (order + 1)[None], d[order][None], 10)[0]
    want: list[int] = []
    for j in order + 1:
        if len(want) < 10 and all(1.2**2 * ((x[k] - x[j]) ** 2).sum() > d[j - 1] for k in want):
            want.append(int(j))
    assert [int(k) for k in kept if k >= 0] == want


def test_a_search_that_misses_is_widened_until_the_audit_passes():
    x = clusters(500, dim=16)
    x /= np.sqrt((x * x).sum(1))[:, None]
    ring = np.stack([(np.arange(500) + 1) % 500, (np.arange(500) - 1) % 500], 1)  # a graph that knows nothing of distances
    a, b, recall, beam = flat_graph.found_pairs(x, ring, 0.9, beam=4)
    assert recall >= flat_graph.RECALL and beam > 4
