import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import assignment as A
from gridloom.operators import clustering as C
from gridloom.operators import encoder as EN
from gridloom.operators import losses as L
from gridloom.operators import matrix as M
from gridloom.operators import packing as PK
from gridloom.operators.neighbours import knn_vectors, nearest_rows, pairwise_squared
from gridloom.operators.sampling import sample_per_group, split_tiles
from tests.conftest import rows


def test_knn_vectors_with_duplicates_and_small_blocks(spark):
    rng = np.random.default_rng(0)
    v = np.vstack([rng.normal(size=(60, 6)), np.tile(rng.normal(size=(1, 6)), (15, 1))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, embedding array<double>")
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    for args in ({}, {"block_rows": 7, "n_pivots": 4}):
        got = {}
        for r in knn_vectors(df, 5, **args).collect():
            got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
        for i in range(len(v)):
            want = [int(j) for j in np.lexsort((np.arange(len(v)), d[i]))[:5]]
            assert [x for _, x in sorted(got[i])] == want


def test_nearest_rows_are_those_of_exact_differences():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    many = np.concatenate([base, base, base + 1e-9, base + 1e5])[rng.permutation(160)]
    for a, b in ((many[:50], many), (many * 1e-30, many * 1e-30), (base, base[:3]), (base[:1] * 0, base * 0)):
        d2 = pairwise_squared(a, b)
        order = np.argsort(d2, axis=1, kind="stable")[:, :6]
        at, to, near = nearest_rows(a, b, 6)
        assert np.array_equal(to.reshape(order.shape), order) and np.array_equal(at, np.repeat(np.arange(len(a)), order.shape[1]))
        assert np.array_equal(near, np.take_along_axis(d2, order, axis=1).ravel())


def test_knn_vectors_sends_a_query_once_to_neighbouring_groups(spark, monkeypatch):
    from gridloom.operators import neighbours as NB

    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    written, cut = [], NB.cut_lineage
    monkeypatch.setattr(NB, "cut_lineage", lambda x: written.append(cut(x)) or written[-1])
    want = np.argsort(pairwise_squared(v, v), axis=1, kind="stable")[:, :5]
    for block_rows, most in ((16384, 600), (150, 600 * 12)):
        got = {(r["src"], r["rank"]): r["dst"] for r in knn_vectors(df, 5, n_pivots=24, block_rows=block_rows).collect()}
        assert got == {(i, j + 1): want[i, j] for i in range(600) for j in range(5)}
        assert written[-1].count() <= most


def test_jaccard_edges_search_for_neighbours_once(spark):
    pairs = [(a, (a + d) % 9) for a in range(9) for d in (0, 1, 2)]
    found = spark.createDataFrame(pairs, "src long, dst long").mapInArrow(lambda batches: batches, "src long, dst long")
    scored = C.jaccard_edges(found)
    assert "MapInArrow" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["src"], r["dst"]) for r in scored.collect()} == set(pairs)


def test_louvain_finds_planted_groups(spark):
    rng = np.random.default_rng(1)
    edges = []
    for g in range(4):
        for i in range(12):
            for j in range(i):
                if rng.random() < 0.7:
                    edges.append((g * 12 + i, g * 12 + j, 1.0))
        edges.append((g * 12, ((g + 1) % 4) * 12, 1.0))
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = C.louvain(df)
    labels = {r["id"]: r["community"] for r in found.collect()}
    assert len(labels) == 48
    for g in range(4):
        assert len({labels[g * 12 + i] for i in range(12)}) == 1
    assert len(set(labels.values())) == 4
    assert C.modularity(df, found) > 0.6


def test_louvain_goes_on_until_no_vertex_gains(spark):
    rng = np.random.default_rng(4)
    n = 1500
    edges = [(i, i + 1, float(w)) for i, w in enumerate(rng.integers(1, 4, n - 1))]
    graph = spark.createDataFrame(edges, "src long, dst long, weight double")
    both = C.cut_lineage(C._undirected(graph))
    two_m = 2 * sum(w for *_, w in edges)
    at = {r["id"]: r["c"] for r in C._local_moves(both, two_m, 1.0, 1000, 0).collect()}
    around, total = {i: {} for i in range(n)}, {}
    strength = dict.fromkeys(range(n), 0.0)
    for a, b, w in edges:
        for u, v in ((a, b), (b, a)):
            around[u][at[v]] = around[u].get(at[v], 0) + w
            strength[u] += w
    for i, c in at.items():
        total[c] = total.get(c, 0) + strength[i]
    for i, c in at.items():
        k = strength[i]
        stay = around[i].get(c, 0) - k * (total[c] - k) / two_m
        assert all(into - k * total[d] / two_m <= stay + 1e-9 for d, into in around[i].items() if d != c)


def test_louvain_fails_at_its_limits(spark):
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "src long, dst long, weight double")
    with pytest.raises(RuntimeError):
        C.louvain(graph, max_rounds=1)
    with pytest.raises(RuntimeError):
        C.louvain(graph, max_levels=1)
    singles = graph.selectExpr("src AS id").union(graph.selectExpr("dst")).distinct().selectExpr("id", "id AS community")
    assert C._vertex_modularity(C._undirected(graph), 1.0) == pytest.approx(C.modularity(graph, singles))


def test_louvain_settles_in_few_rounds_and_in_many_blocks(spark, monkeypatch):
    # Four rounds are too few where vertices move against their neighbours as they were.
    n = 300
    edges = [(i, (i + step) % n, 1.0) for i in range(n) for step in (1, 2, 5, 9, 14)]
    graph = spark.createDataFrame(edges, "src long, dst long, weight double")
    both = C.cut_lineage(C._undirected(graph))
    one = C._local_moves(both, 2.0 * len(edges), 1.0, 4, 0).collect()
    assert len(one) == n and len({r["c"] for r in one}) < n / 4
    # Dealt to many blocks it settles too, and no worse by much.
    monkeypatch.setattr(C, "BLOCK_LINKS", 700)
    many = C._local_moves(both, 2.0 * len(edges), 1.0, 100, 0)
    reached = [C.modularity(graph, spark.createDataFrame([(r["id"], r["c"]) for r in x], "id long, community long")) for x in (one, many.collect())]
    assert reached[1] > reached[0] - 0.1


def test_louvain_level_of_one_block_takes_one_round_of_moves(spark, monkeypatch):
    # The second round finds that no vertex gains.
    n = 400
    edges = [(i, (i + step) % n, 1.0 + (i * step) % 3) for i in range(n) for step in (1, 3, 7, 16)]
    both = C.cut_lineage(C._undirected(spark.createDataFrame(edges, "src long, dst long, weight double")))
    two_m = both.agg(F.sum("w")).first()[0]
    assert len({r["c"] for r in C._local_moves(both, two_m, 1.0, 2, 0).collect()}) < n / 2
    # Of many blocks too: no vertex gains, and where all that could gain fit a block they are moved there.
    monkeypatch.setattr(C, "BLOCK_LINKS", 1500)
    at = {r["id"]: r["c"] for r in C._local_moves(both, two_m, 1.0, 30, 0).collect()}
    strength, total, around = {}, {}, {}
    for r in both.collect():
        strength[r["u"]] = strength.get(r["u"], 0) + r["w"]
        around.setdefault(r["u"], {}).setdefault(at[r["v"]], 0)
        around[r["u"]][at[r["v"]]] += r["w"]
    for i, c in at.items():
        total[c] = total.get(c, 0) + strength[i]
    for i, c in at.items():
        stay = around[i].get(c, 0) - strength[i] * (total[c] - strength[i]) / two_m
        assert all(into - strength[i] * total[d] / two_m <= stay + 1e-9 for d, into in around[i].items() if d != c)


def test_louvain_block_settles_whatever_the_batches():
    rng = np.random.default_rng(8)
    u, v = rng.integers(0, 60, (2, 400))
    pairs = sorted({(int(a), int(b)) for a, b in zip(u, v) if a != b} | {(int(b), int(a)) for a, b in zip(u, v) if a != b})
    a, b = (np.array(x) for x in zip(*pairs))
    k = np.bincount(a, minlength=60).astype(float)

    def settled(blocks, size):
        order = np.lexsort((a, blocks[a]))
        src, dst = a[order], b[order]
        inner = blocks[src] == blocks[dst]
        rows = pa.table(
            {"block": blocks[src], "id": src, "now": src, "k": k[src], "v": np.where(inner, dst, src), "c": dst, "into": np.ones(len(src)), "tot": k[dst]}
        )
        return {i: g for out in C._settle(1 / len(a))(iter(rows.to_batches(size))) for i, g in zip(*(out[c].to_pylist() for c in ("id", "goal")))}

    one = settled(np.zeros(60, int), 10_000)
    assert one == settled(np.zeros(60, int), 7) and len(set(one.values())) < 30
    two = settled(np.arange(60) % 2, 10_000)
    assert two == settled(np.arange(60) % 2, 7) and set(two) == set(one)


def test_relabel_boundary_size(spark):
    df = spark.createDataFrame([(i, "a") for i in range(5)] + [(9, "b"), (10, "b"), (11, "c")], "id long, community string")
    got = dict(rows(C.relabel_by_size(df, 2)))
    assert got[0] == 0 and got[9] == -1 and got[11] == -1
    assert dict(rows(C.relabel_by_size(df, -1)))[11] == 2


def numpy_yen(v, bins=256):
    counts, edges = np.histogram(v, bins)
    p = counts / counts.sum()
    p1, a, b = np.cumsum(p), np.cumsum(p**2), np.cumsum(p[::-1] ** 2)[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        crit = np.log(((a[:-1] * b[1:]) ** -1) * (p1[:-1] * (1 - p1[:-1])) ** 2)
    return ((edges[:-1] + edges[1:]) / 2)[:-1][np.nanargmax(crit)]


def test_thresholds(spark):
    rng = np.random.default_rng(2)
    bimodal = np.concatenate([rng.normal(0.2, 0.05, 400), rng.normal(0.8, 0.05, 300)])
    data = [(0, i, float(v)) for i, v in enumerate(bimodal)]
    data += [(1, 1000 + i, 0.4) for i in range(5)] + [(2, 2000, 0.1), (2, 2001, 0.9)]
    df = spark.createDataFrame(data, "gene_encoding long, row_index long, similarity double")
    yen = dict(rows(A.yen_thresholds(df)))
    assert yen[0] == pytest.approx(numpy_yen(bimodal), abs=0.01)
    assert yen[1] == 0.4
    li = {r["gene_encoding"]: (r["li"], r["converged"]) for r in A.li_thresholds(df).collect()}
    assert 0.3 < li[0][0] < 0.7 and li[0][1]
    assert li[1] == (0.4, True)
    for r in A.gene_thresholds(df).collect():
        values = df.where(F.col("gene_encoding") == r["gene_encoding"]).agg(F.min("similarity"), F.max("similarity")).first()
        assert values[0] - 1e-9 <= r["similarity_threshold"] <= values[1] + 1e-9


def test_unconverged_iteration_is_backfilled(spark):
    v = np.sort(np.random.default_rng(3).random(500)) ** 3
    many = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "gene_encoding long, row_index long, similarity double")
    assert [r["converged"] for r in A.li_thresholds(many, max_iter=1).collect()] == [False]
    df = spark.createDataFrame([(0, 1.0, True), (1, 3.0, True), (2, None, False)], "g int, similarity_threshold double, converged boolean")
    assert rows(A.backfill_thresholds(df)) == [(0, 1.0, True), (1, 3.0, True), (2, 2.0, False)]


def plain_li(values, max_iter=250):
    v = np.asarray(values, float)
    if len(set(v)) == 1:
        return v[0], True
    x = v - v.min()
    tol = np.diff(np.unique(x)).min() / 2
    t, step = x.mean(), 1
    while True:
        low, high = x[x <= t], x[x > t]
        b, f = low.mean(), high.mean() if len(high) else 0.0
        step += 1
        if b == 0 or f == 0:
            return t + v.min(), True
        after = (b - f) / (np.log(b) - np.log(f))
        t, moved = after, abs(after - t)
        if moved <= tol or step > max_iter:
            return t + v.min(), step <= max_iter


@pytest.mark.parametrize("block_rows", [3, 64, 4096])
def test_li_reads_only_the_blocks_it_passes(spark, block_rows):
    rng = np.random.default_rng(8)
    sets = {
        0: rng.random(700), 1: np.round(rng.normal(size=900), 2), 2: rng.random(400) ** 6, 3: np.array([0.25] * 9), 4: np.array([-1.0, 3.0]),
        5: np.concatenate([rng.normal(0, 1, 300), rng.normal(50, 1, 5)]), 6: np.array([0.0, 0.0, 1e-9, 1.0]),
    }
    data = [(f"g{g}", float(x)) for g, v in sets.items() for x in v] + [("g0", None), (None, 0.5), (None, 0.75)]
    df = spark.createDataFrame(data, "gene string, similarity double").repartition(5)
    got = {r["gene"]: (r["li"], r["converged"]) for r in A.li_thresholds(df, gene="gene", block_rows=block_rows).collect()}
    assert len(got) == len(sets)
    for g, v in sets.items():
        want, converged = plain_li(v)
        assert got[f"g{g}"] == (pytest.approx(want, abs=1e-9), converged)


def test_assignment_ties_and_missing(spark):
    scored = spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (2, 7, 0.1)], "src long, dst long, similarity double")
    assert rows(A.best_per_source(scored)) == [(1, 4, 0.5), (2, 7, 0.1)]
    nodes = spark.createDataFrame([(1, 0, True), (2, 0, True), (3, 1, True), (4, 1, False)], "row_index long, gene_encoding int, is_core boolean")
    got = rows(A.predict(nodes, scored, 0.3), "row_index", "cell_encoding", "similarity")
    assert got == [(1, 4, 0.5), (2, -1, 0.1), (3, -1, 0.0)]
    cells = spark.createDataFrame([("x", 4), ("y", 7)], "cell_id string, cell_encoding int")
    out = A.assign(A.predict(nodes, scored), cells)
    found = {r["row_index"]: r["assigned_cell_id"] for r in out.collect()}
    assert found == {1: "x", 2: "y", 3: None}
    assert out.where("row_index = 3").first()["similarity_threshold"] is None


def test_count_thresholds_are_inclusive(spark):
    data = [("c9", "g", 9), ("c10", "g", 10), ("c11", "h", 11)]
    counts = spark.createDataFrame(data, "cell_id string, feature_name string, n long")
    assert rows(M.cell_totals(counts, 10), "cell_id", "filtered") == [("c10", True), ("c11", True), ("c9", False)]
    assert rows(M.keep_genes(counts, 11), "feature_name") == [("g",), ("g",), ("h",)]
    assert rows(M.keep_genes(counts, 12), "feature_name") == [("g",), ("g",)]


def test_reference_gene_checks(spark):
    counts = spark.createDataFrame([("c", "g1", 5), ("c", "g2", 5)], "cell_id string, feature_name string, n long")
    ref = spark.createDataFrame([("r", "g1", 200.0)], "cell_id string, feature_name string, n double")
    with pytest.raises(ValueError, match="g2"):
        M.check_reference_genes(counts, ref, "error")
    assert rows(M.check_reference_genes(counts, ref, "remove"), "feature_name") == [("g1",)]
    with pytest.raises(NotImplementedError):
        M.check_reference_genes(counts, ref, "fill")
    with pytest.raises(ValueError, match="below"):
        M.check_reference_genes(counts, ref.withColumn("n", F.lit(3.0)), "remove")
    with pytest.raises(ValueError, match="raw counts"):
        M.check_reference_genes(counts, ref.withColumn("n", F.lit(3.5)), "remove")


def test_join_exactly_one(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    ok = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(M.join_exactly_one(left, ok, "k")) == [(1, "a"), (2, "b")]
    for bad in (ok.limit(1), ok.unionAll(ok)):
        with pytest.raises(Exception, match="exactly one"):
            M.join_exactly_one(left, bad, "k").collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_packing_invariants(sizes):
    for bins in (PK.best_fit_decreasing(sizes, 100), PK.harmonic_k(sizes, 100), PK.first_fit(sizes, 100, seed=0), PK.first_fit(sizes, 100, n_buckets=None)):
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    # First-fit in one order never opens a bin while an earlier one has room.
    bins = PK.first_fit(sizes, 100, n_buckets=None)
    assert len(bins) <= 1 + 2 * sum(sizes) / 100


def test_packing_rejects_and_skips():
    for pack in (PK.best_fit_decreasing, PK.harmonic_k, PK.first_fit):
        for bad in ([0, 5], [5, 11]):
            with pytest.raises(ValueError):
                pack(bad, 10)
        assert [i for b in pack([0, 5, 11, 10], 10, skip_too_big=True) for i in b].count(1) == 1
    assert PK.best_fit_decreasing([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    assert PK.harmonic_k([6, 6, 4, 4, 1], 10, k=6) == [[0], [1], [2, 3], [4]]


def test_pack_tiles_groups(spark):
    weights = spark.createDataFrame([(i, i % 7 + 1) for i in range(40)], "tile_id long, weight long")
    packed = PK.pack_tiles(weights, 20.0, group_size=15)
    assert packed.count() == 40
    assert packed.groupBy("batch_id").agg(F.sum("weight").alias("s")).where("s > 20").count() == 0
    a = rows(PK.pack_tiles(weights, 20.0, "first_fit", epoch=0))
    assert a == rows(PK.pack_tiles(weights, 20.0, "first_fit", epoch=0))
    assert a != rows(PK.pack_tiles(weights, 20.0, "first_fit", epoch=1))
    with pytest.raises(ValueError):
        PK.pack_tiles(weights, 20.0, "next_fit")


def test_sampling_is_stable(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a, b = sample_per_group(df, "g", "id", 50), sample_per_group(df.repartition(7), "g", "id", 50)
    assert rows(a) == rows(b) and a.count() == 150
    share = split_tiles(spark.range(4000).withColumnRenamed("id", "tile_id")).where("is_train").count() / 4000
    assert 0.72 < share < 0.78


def test_scheduled_weights():
    assert L.scheduled_weights([1, 1, 0], [1, 1, 0.5], 0, 20) == pytest.approx([0.5, 0.5, 0.0], abs=1e-6)
    assert L.scheduled_weights([1, 1, 0], [1, 1, 0.5], 19, 20) == pytest.approx([0.4, 0.4, 0.2], abs=1e-6)
    assert L.scheduled_weights([1, 1, 0], [1, 1, 0.5], 0, 1) == pytest.approx([0.5, 0.5, 0.0], abs=1e-6)
    assert L.combined_loss([1, 1, 1], [1, 1, 0], [1, 1, 0.5], 3, 20) == pytest.approx(1.0, abs=1e-6)


def test_losses_without_anchors_or_cells(spark):
    empty = spark.createDataFrame([], "id long, label int, embedding array<double>")
    triplets = spark.createDataFrame([], "id long, label int, positive long, positive_label int, negative long, negative_label int")
    sim = spark.createDataFrame([], "a int, b int, sim double")
    assert L.triplet_loss(triplets, empty).first()[0] == 0.0
    assert L.metric_loss(triplets, empty, sim).first()[0] == 0.0
    edges = spark.createDataFrame([(0, 0)], "src long, dst long")
    assert L.segmentation_loss(edges, empty, empty, 1).first()[0] == 0.0
    with pytest.raises(ValueError):
        L.segmentation_loss(edges, empty, empty, 3, "hinge")


def test_vectors_do_not_ride_on_pairs(spark, monkeypatch):
    from gridloom.operators import vector_pairs as VP

    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=(20, 4))
    as_df = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    pairs = [(int(i), int(j)) for i, j in zip(rng.integers(0, 32, 900), rng.integers(0, 22, 900))]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    known = [(i, j) for i, j in pairs if i < 30 and j < 20]
    args = (edges, as_df(a), as_df(b))
    losses = [[L.segmentation_loss(*args, 20, kind).first()[0] for kind in ("triplet", "bce")]]
    # Many blocks, cut cells; and the joins by id.
    monkeypatch.setattr(VP, "BLOCK", 9)
    monkeypatch.setattr(VP, "PAIRS", 40)
    scored = A.score_edges(*args)
    assert "FlatMapCoGroups" in scored._jdf.queryExecution().toString()
    got = sorted((r["src"], r["dst"], r["similarity"]) for r in scored.collect())
    cosines = [(i, j, a[i] @ b[j] / np.linalg.norm(a[i]) / np.linalg.norm(b[j])) for i, j in known]
    assert [x[:2] for x in got] == sorted(known) and np.allclose([x[2] for x in got], [x[2] for x in sorted(cosines)])
    losses.append([L.segmentation_loss(*args, 20, kind).first()[0] for kind in ("triplet", "bce")])
    monkeypatch.setattr(A, "blocks_pay", lambda *_: False)
    monkeypatch.setattr(L, "blocks_pay", lambda *_: False)
    losses.append([L.segmentation_loss(*args, 20, kind).first()[0] for kind in ("triplet", "bce")])
    assert np.allclose(losses[0], losses[2]) and np.allclose(losses[1], losses[2])
    assert np.allclose([r["similarity"] for r in A.score_edges(*args).sort("src", "dst").collect()], [x[2] for x in got])


def test_segmentation_losses_match_numpy(spark):
    rng = np.random.default_rng(5)
    a, c = rng.normal(size=(20, 4)), rng.normal(size=(5, 4))
    edges = spark.createDataFrame([(i, i % 5) for i in range(20)], "src long, dst long")
    as_df = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, embedding array<double>")
    neg = {r["src"]: r["neg"] for r in L.shifted_negatives(edges, 5).collect()}
    assert all(neg[i] != i % 5 for i in range(20))
    p, n = c[[i % 5 for i in range(20)]], c[[neg[i] for i in range(20)]]
    want = np.maximum(np.linalg.norm(a - p, axis=1) - np.linalg.norm(a - n, axis=1) + 0.4, 0).mean()
    assert L.segmentation_loss(edges, as_df(a), as_df(c), 5).first()[0] == pytest.approx(want)
    pos, dif = (a * p).sum(1), (a * n).sum(1)
    want = np.concatenate([np.log1p(np.exp(-pos)), np.log1p(np.exp(dif))]).mean()
    assert L.segmentation_loss(edges, as_df(a), as_df(c), 5, "bce").first()[0] == pytest.approx(want)


def test_triplet_sampler_frequencies(spark):
    labelled = spark.createDataFrame([(i, i % 3, [float(i)]) for i in range(3000)], "id long, label int, embedding array<double>")
    sim = spark.createDataFrame([(a, b, 1.0 if a == b else 0.5 if (a + b) == 1 else -1.0) for a in range(3) for b in range(3)], "a int, b int, sim double")
    drawn = L.sample_triplets(labelled, sim, seed=3)
    assert drawn.count() == 3000
    share = drawn.where("label = 0 AND positive_label = 0").count() / 1000
    assert abs(share - 1 / 1.5) < 0.05
    assert drawn.where("label = 0 AND negative_label <> 2").count() == 0


def gelu(x):
    return np.vectorize(lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2))))(x)


def test_encoder_matches_numpy(spark):
    rng = np.random.default_rng(6)
    n, b = 7, 3
    xy, cxy = rng.random((n, 2)) * 10, rng.random((b, 2)) * 10
    genes, feats = rng.integers(0, 4, n), rng.normal(size=(b, 5))
    tt = [(i, j) for i in range(n) for j in range(n) if (i * 3 + j) % 4 == 0]
    tb = [(i, i % 2) for i in range(n)]
    w = EN.initial_weights(4, 5, in_channels=4, hidden_channels=3, out_channels=4, n_mid_layers=1, n_heads=2, frequency_size=8)

    def positions(p):
        s = (p - p.min(0)) / (np.ptp(p, axis=0) + 1e-8)
        f = np.exp(-np.log(10000.0) * np.arange(4) / 4)
        parts = []
        for k in range(2):
            c = np.concatenate([np.cos(s[:, k : k + 1] * f), np.sin(s[:, k : k + 1] * f)], axis=1)
            h = c @ w.position[0][0] + w.position[0][1]
            h = h / (1 + np.exp(-h))
            parts.append(h @ w.position[1][0] + w.position[1][1])
        return np.concatenate(parts, axis=1)

    def gat(src, dst, edges, p):
        left, right = src @ p["left"] + p["left_bias"], dst @ p["right"] + p["right_bias"]
        ch = left.shape[1] // 2
        out = np.tile(p["bias"], (len(dst), 1))
        for d in range(len(dst)):
            inc = [s for s, e in edges if e == d]
            if not inc:
                continue
            for h in range(2):
                cut = slice(h * ch, (h + 1) * ch)
                z = left[inc][:, cut] + right[d, cut]
                score = np.where(z >= 0, z, 0.2 * z) @ p["attention"][h]
                a = np.exp(score - score.max())
                out[d, cut] += (a / a.sum()) @ left[inc][:, cut]
        return out

    ht = gelu(np.concatenate([w.gene[genes], positions(xy)], axis=1))
    hb = gelu(np.concatenate([feats @ w.cell[0] + w.cell[1], positions(cxy)], axis=1))
    for layer in w.layers:
        ht, hb = gelu(gat(ht, ht, tt, layer["tx-tx"])), gelu(gat(ht, hb, tb, layer["tx-belongs-bd"]))
    ht, hb = ht @ w.last["tx"][0] + w.last["tx"][1], hb @ w.last["bd"][0] + w.last["bd"][1]
    ht, hb = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (ht, hb))

    tx = spark.createDataFrame([(0, i, *map(float, xy[i]), int(genes[i])) for i in range(n)], "tile_id long, id long, x double, y double, gene_encoding int")
    bd = spark.createDataFrame([(0, i, *map(float, cxy[i]), feats[i].tolist()) for i in range(b)], "tile_id long, id long, x double, y double, features array<double>")
    edges = spark.createDataFrame([(0, "tx-tx", i, j) for i, j in tt] + [(0, "tx-belongs-bd", i, j) for i, j in tb], "tile_id long, edge_type string, src long, dst long")
    out = EN.encode(tx, bd, edges, w)
    for name, want in (("tx", ht), ("bd", hb)):
        got = np.array([r["embedding"] for r in out[name].orderBy("id").collect()])
        assert np.abs(got - want).max() < 1e-5


@pytest.mark.parametrize("block", [3, 512])
def test_blocked_products_are_the_gram_matrix(spark, block):
    from gridloom.operators.matrix import gene_products

    rng = np.random.default_rng(6)
    x = np.where(rng.random((70, 11)) < 0.3, rng.integers(-2, 3, (70, 11)), np.nan)
    names = [f"g{j}" for j in range(10)] + ["Ünique"]
    data = [(f"c{i}", names[j], float(x[i, j])) for i in range(70) for j in range(11) if not np.isnan(x[i, j])]
    norm = spark.createDataFrame([*data, ("c0", None, 1.0)], "cell_id string, feature_name string, norm double").repartition(4)
    got = {(r["gene_a"], r["gene_b"]): r["sxy"] for r in gene_products(norm, block=block).collect()}
    want = {}
    for a in range(11):
        for b in range(11):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            if names[a] <= names[b] and both.any():
                want[names[a], names[b]] = float((x[both, a] * x[both, b]).sum())
    assert got == want
    assert gene_products(norm.limit(0)).count() == 0
