import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import Graph, Shared
from graphloom.operators import coloring, contract, degree, moves, partition
from graphloom.plans import held, queries, shared, small
from graphloom.plans.louvain import Louvain
from graphloom.sources import binary, generate, tables

KARATE = (
    "1-0 2-0 2-1 3-0 3-1 3-2 4-0 5-0 6-0 6-4 6-5 7-0 7-1 7-2 7-3 8-0 8-2 9-2 10-0 10-4 10-5 11-0 12-0 12-3 13-0 13-1 13-2 13-3 16-5 16-6 17-0 17-1 19-0 19-1 21-0 21-1 25-23 25-24 "
    "27-2 27-23 27-24 28-2 29-23 29-26 30-1 30-8 31-0 31-24 31-25 31-28 32-2 32-8 32-14 32-15 32-18 32-20 32-22 32-23 32-29 32-30 32-31 33-8 33-9 33-13 33-14 33-15 33-18 33-19 33-20 "
    "33-22 33-23 33-26 33-27 33-28 33-29 33-30 33-31 33-32"
)


def made(spark, ties, n=None):
    rows = [(a, b) for a, b in ties]
    vertices = spark.range(n).select(F.col("id").alias("v")) if n else None
    return Graph.from_edges(spark.createDataFrame(rows, "src bigint, dst bigint"), vertices, weight=None, symmetric=False)


def labels(result):
    return [r["community"] for r in result.communities.orderBy("v").collect()]


TRIANGLES = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]


@pytest.mark.parametrize(("batches", "q", "phases", "loops", "want"), [(8, 0.357143, 2, 4, [0, 0, 0, 1, 1, 1]), (2, 0.173469, 3, 5, [0, 1, 0, 2, 2, 2]), (1, -0.010204, 2, 3, None)])
def test_two_triangles(spark, batches, q, phases, loops, want):
    r = Louvain(batches=batches).fit(made(spark, TRIANGLES))
    p = r.phases.collect()
    assert (round(r.q_final, 6), len(p), sum(x["loops"] for x in p)) == (q, phases, loops)
    assert want is None or labels(r) == want


def test_supersteps_equal_the_small_path(spark):
    g = made(spark, TRIANGLES)
    a, b = Louvain(batches=2).fit(g), Louvain(batches=2, small_arcs=0).fit(g)
    assert labels(a) == labels(b) and a.history.collect() == b.history.collect() and a.phases.collect() == b.phases.collect()
    assert sorted(a.hierarchy.collect()) == sorted(b.hierarchy.collect())


def test_karate(spark):
    ties = [tuple(map(int, x.split("-"))) for x in KARATE.split()]
    g = made(spark, ties)
    assert g.num_edges() == 156 and g.max_degree() == 17
    r = Louvain(batches=8).fit(g)
    assert " ".join(map(str, labels(r))) == "1 1 1 1 0 0 0 1 2 1 0 1 1 1 2 2 0 1 2 1 2 1 2 2 2 2 2 2 2 2 2 2 2 2" and round(r.q_final, 6) == 0.402038
    assert round(Louvain(batches=2, tie="lane").fit(g).q_final, 6) == 0.227646
    alone = Louvain(batches=1).fit(g)
    assert labels(alone) == list(range(34)) and not alone.history.first()["accepted"]


def test_small_shapes(spark):
    assert labels(Louvain(batches=8).fit(made(spark, [(0, 1), (1, 2), (2, 3)]))) == [0, 0, 1, 1]
    isolated = Louvain(batches=8).fit(made(spark, [(0, 1), (0, 2), (1, 2)], 5))
    assert labels(isolated) == [0, 0, 0, 1, 2] and isolated.q_final == 0
    one = Louvain(batches=2).fit(made(spark, [(0, 1)]))
    assert labels(one) == [0, 1] and one.q_final == -0.5
    assert labels(Louvain(batches=8).fit(made(spark, [(0, 1)]))) == [0, 0]
    for limit in (0, 100):
        empty = Louvain(small_arcs=limit).fit(made(spark, [], 3))
        assert labels(empty) == [0, 1, 2] and empty.q_final is None


def test_planted_blocks_and_lanes(spark):
    r = Louvain(batches=8).fit(Graph(*generate.planted_partition(spark)))
    assert labels(r) == [i // 20 for i in range(120)]
    assert round(Louvain(batches=2, tie="lane").fit(Graph(*generate.ring_of_cliques(spark))).q_final, 6) == 0.357438


def test_history_rises_within_phases(spark):
    h = Louvain(batches=2).fit(Graph(*tables.nation_trade(spark, "/root/testdata/sf0.01"))).history.orderBy("phase", "loop").collect()
    for a, b in zip(h, h[1:]):
        assert a["phase"] != b["phase"] or not b["accepted"] or b["q"] >= a["q"] or not a["accepted"]


def test_bounds(spark):
    g = made(spark, TRIANGLES)
    offsets = g.csr_offsets()
    assert partition.edge_balanced(offsets, 6, 14, 2) == [0, 4, 6] and partition.edge_balanced(offsets, 6, 14, 8) == [0, 1, 2, 3, 4, 5, 6, 6, 6]
    assert partition.two_way(g.vertices).agg(F.sum("c")).first()[0] == 3
    assert small.cuts(np.array([2, 2, 3, 3, 2, 2]), 8) == [0, 1, 2, 3, 4, 5, 6, 6, 6] and small.cuts(np.array([1, 1]), 2) == [0, 2, 2]
    for devices, by in ((1, "edge"), (2, "edge"), (2, "vertex")):
        assert partition.batches(offsets, 6, 14, 2, devices, by) == small.windows(np.array([2, 2, 3, 3, 2, 2]), 2, devices, by)


def test_contraction_keeps_masses(spark):
    g = Graph(*generate.ring_of_cliques(spark))
    state = g.weighted_degrees().select("v", "k", (F.col("v") % 7).alias("c"))
    names = contract.relabel(state)
    coarse = Graph(names.select(F.col("id").alias("v")), contract.contract(g.edges, state, names))
    assert coarse.total_mass() == g.total_mass()
    assert moves.modularity(coarse.edges, moves.singletons(coarse.weighted_degrees())).first()["q"] == moves.modularity(g.edges, state).first()["q"]


def test_wide_masses_use_decimals(spark):
    w = 4_000_000_000
    rows = [(a, b, w) for a, b in TRIANGLES] + [(b, a, w) for a, b in TRIANGLES]
    g = Graph.from_edges(spark.createDataFrame(rows, "src bigint, dst bigint, w bigint"))
    m2 = degree.total_mass(g.edges).first()["m2"]
    got = moves.moves(g.edges, moves.singletons(g.weighted_degrees()), m2, F.lit(True)).collect()
    plain = made(spark, TRIANGLES)
    want = moves.moves(plain.edges, moves.singletons(plain.weighted_degrees()), 14, F.lit(True)).collect()
    assert sorted(got) == sorted(want)


def test_coloring_is_proper_and_a_permutation(spark):
    g = made(spark, TRIANGLES, 8)
    c = coloring.coloring(g.vertices, g.edges)
    color = {r["v"]: r["color"] for r in c.collect()}
    assert all(color[a] != color[b] for a, b in TRIANGLES) and color[6] == color[7] == 0
    assert sorted(r["position"] for r in coloring.positions(c).collect()) == list(range(8))
    colored = Louvain(batches=8, coloring=True).fit(g)
    assert colored.communities.count() == 8


def test_validation(spark):
    bad = Graph(spark.range(2).select(F.col("id").alias("v")), spark.createDataFrame([(0, 1, 1), (5, 0, -1), (None, 0, 1)], schema.EDGES))
    with pytest.raises(ValueError, match="asymmetric arc"):
        bad.validate()
    made(spark, TRIANGLES).validate()
    with pytest.raises(ValueError):
        schema.check_columns(bad.vertices, schema.EDGES)


def test_formats(spark, tmp_path):
    g = made(spark, TRIANGLES, 8)
    edges = sorted(tuple(r) for r in g.edges.collect())
    g.write_binary(f"{tmp_path}/g.bin")
    again = Graph.read_binary(spark, f"{tmp_path}/g.bin", whole=True)
    assert sorted(tuple(r) for r in again.edges.collect()) == edges and again.num_vertices() == 8
    with pytest.raises(FileNotFoundError):
        Graph.read_binary(spark, f"{tmp_path}/none.bin")
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n3 3 2\n2 1\n3 3\n")
    mtx = Graph.read_mtx(spark, f"{tmp_path}/a.mtx")
    assert sorted(tuple(r) for r in mtx.edges.collect()) == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)] and mtx.num_vertices() == 3
    csr = Graph.from_csr(spark, [0, 1, 3, 3], [1, 0, 2], [5, 5, 7])
    assert sorted(tuple(r) for r in csr.edges.collect()) == [(0, 1, 5), (1, 0, 5), (1, 2, 7)] and csr.num_vertices() == 3


def test_binary_blocks_cut_hubs_and_slices_start_above_zero(spark, tmp_path):
    hub = made(spark, [(0, i) for i in range(1, 40)] + [(45, 46)], 50)
    want = sorted(tuple(r) for r in hub.edges.collect())
    hub.write_binary(f"{tmp_path}/h.bin")
    for block in (7, 1000):
        vertices, edges = binary.read(spark, f"{tmp_path}/h.bin", block)
        assert sorted((r["src"], r["dst"], int(r["w"])) for r in edges.collect()) == want and vertices.count() == 50
    records = np.array([(1, 2.0), (0, 3.0)], binary.RECORD)
    (tmp_path / "s.bin").write_bytes(np.array([2, 2, 100, 101, 102], "<i8").tobytes() + records.tobytes())
    assert sorted(tuple(r) for r in binary.read(spark, f"{tmp_path}/s.bin")[1].collect()) == [(0, 1, 2.0), (1, 0, 3.0)]
    made(spark, [], 0).write_binary(f"{tmp_path}/e.bin")
    assert binary.read(spark, f"{tmp_path}/e.bin")[1].count() == 0


def test_assignment_from_outside(spark):
    g = made(spark, TRIANGLES)
    given = spark.createDataFrame([(v, v // 3 * 3) for v in range(6)], "v bigint, c bigint")
    for limit in (0, 100):
        r = Louvain(batches=1, small_arcs=limit).fit(g, init=given)
        assert labels(r) == [0, 0, 0, 1, 1, 1] and r.timings.count() == r.phases.count() and r.seconds > 0
    assert Louvain(batches=8, phase_tol=0.9).fit(g).phases.count() == 1
    assert coloring.color_count(spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "v bigint, color bigint")).first()[:] == (2, 2)


def test_random_graphs(spark):
    g = Graph.random_ba(spark, 300, 3, seed=5)
    assert g.num_edges() == 2 * 3 * 297 and g.validate() and sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, Graph.random_ba(spark, 300, 3, seed=5).edges.collect()))
    assert g.max_degree() > 20
    w = {(r["src"], r["dst"]): r["w"] for r in g.dedupe().randomize_weights(2).edges.collect()}
    assert all(0 < x < 1 and w[b, a] == x for (a, b), x in w.items())


def alike(spark, **options):
    """Results of a phase inside one task, of blocks of arcs and of supersteps, on a graph of whole weights with loops, hubs and isolated vertices."""
    r = np.random.default_rng(11)
    a, b = r.integers(0, 60, 300), r.integers(0, 60, 300) ** 2 // 60
    pairs = {(int(min(x, y)), int(max(x, y))): int(w) for x, y, w in zip(a, b, r.integers(1, 9, 300))}
    rows = [(x, y, w) for (x, y), w in pairs.items()] + [(y, x, w) for (x, y), w in pairs.items() if x != y]
    g = Graph(spark.range(64).select(F.col("id").alias("v")), spark.createDataFrame(rows, schema.EDGES))
    sides = [Louvain(**limit, **options).fit(g) for limit in ({}, {"small_arcs": 1}, {"small_arcs": 1, "held_vertices": 0})]
    return [[sorted(map(tuple, x.collect())) for x in (f.communities, f.hierarchy, f.history, f.phases)] for f in sides]


def test_blocks_of_arcs_move_together_on_devices(spark):
    small, blocks, steps = alike(spark, batches=4, devices=2)
    assert small == blocks == steps


def test_blocks_of_arcs_break_ties_by_lanes(spark):
    small, blocks, steps = alike(spark, batches=8, tie="lane")
    assert small == blocks == steps


def test_blocks_of_arcs_of_real_weights_and_given_communities(spark):
    g = Graph.random_ba(spark, 200, 3, seed=2).dedupe().randomize_weights(4)
    init = g.vertices.select("v", (F.col("v") % 9).alias("c"))
    small, blocks = (Louvain(batches=8, small_arcs=limit).fit(g, init=init) for limit in (10**6, 1))
    assert sorted(small.hierarchy.collect()) == sorted(blocks.hierarchy.collect()) and abs(small.q_final - blocks.q_final) < 1e-12
    empty = Graph(g.vertices, g.edges.limit(0))
    assert Louvain(small_arcs=-1).fit(empty).communities.count() == 200


def test_tasks_share_a_phase_of_many_arcs(spark, monkeypatch):
    items = [(i % 90, (i * i + i // 7) % 40) for i in range(900)] + [(5, None), (None, 3)]
    arcs = tables._shared(spark.createDataFrame(items, "g long, m long"), "g", "m").cache()
    n = {x: sum(y == x for y in items) for x in items}
    want = {}
    for (g, a), x in n.items():
        for (h, b), y in n.items():
            if g == h and g is not None and None not in (a, b) and a != b:
                want[a, b] = want.get((a, b), 0) + x * y
    assert sorted(tuple(r) for r in arcs.collect()) == sorted((*k, w) for k, w in want.items())
    ran = []
    monkeypatch.setattr(held, "phase", lambda *a, f=held.phase, **k: ran.append(1) or f(*a, **k))
    for real in (False, True):
        g = Graph(spark.range(40).select(F.col("id").alias("v")), arcs.withColumn("w", F.col("w").cast("double")) if real else arcs)
        one = Louvain(batches=4).fit(g)
        assert not ran
        with monkeypatch.context() as m:
            m.setattr(held, "TASK", 1)
            several = Louvain(batches=4).fit(g)
        assert bool(ran) != real
        ran.clear()
        for x, y in ((one.hierarchy, several.hierarchy), (one.history, several.history)):
            assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))


def test_ties_by_blocks_are_those_of_a_join(spark):
    r = np.random.default_rng(5)
    rows = sorted({(int(g), int(m)) for g, m in zip(r.integers(-4, 30, 900), r.integers(0, 70, 900) * 10**12)})
    seen = spark.createDataFrame(rows, "group long, member long")
    want = sorted(tables._shared(seen, "group", "member").collect())
    for block in (30, 1000):
        blocks = tables._shared_blocks(seen, 70, block)
        assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, want))
    assert "Join" not in blocks._jdf.queryExecution().toString()  # no pair is shuffled
    assert tables._shared_blocks(seen.limit(0), 0).count() == 0


def test_phases_of_users_shuffle_no_pairs(spark):
    vertices, edges = tables.user_hour(spark, "/root/testdata/sf0.001")
    assert "Join" not in edges._jdf.queryExecution().toString()
    one, blocks = (Louvain(batches=8, small_arcs=limit).fit(Graph(vertices, edges)).phases for limit in (4_000_000, 1))
    assert sorted(one.collect()) == sorted(blocks.collect())


def test_iterations_over_blocks_start_no_jobs(spark):
    g, sc = made(spark, [(a, b) for a in range(40) for b in range(a) if (a * 7 + b * 3) % 5 < 2]), spark.sparkContext
    jobs = []
    for loops in (1, 9):
        sc.setJobGroup(f"loops {loops}", "")
        history = Louvain(batches=8, tie="lane", small_arcs=1, tol=-1, max_iter=loops, max_phases=1).fit(g).history
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"loops {loops}")))
        assert history.count() == loops
    sc._jsc.clearJobGroup()
    assert jobs[1] <= jobs[0] + 2


def test_ties_and_moves_are_those_of_plain_sums():
    r = np.random.default_rng(3)
    n = 50
    for arcs, top in ((2000, 9), (90, 9), (90, 1 << 60), (90, None)):  # counted, sorted with their weights, ordered; real
        row, t = r.integers(0, n, arcs), r.integers(0, n, arcs)
        w = r.random(arcs) if top is None else r.integers(0, top, arcs) // 100 if top > 9 else r.integers(0, top, arcs)
        want = {}
        for x, y, z in zip(row.tolist(), t.tolist(), w.tolist()):
            want[x, y] = want.get((x, y), 0) + z
        got = [x.tolist() for x in small.ties(row, t, w, n, n)]
        assert list(zip(*got[:2])) == sorted(want) and np.allclose(got[2], [want[x] for x in sorted(want)], rtol=1e-12)
        assert top is None or got[2] == [want[x] for x in sorted(want)]
    lanes = [i % 2 * 4 + i // 2 % 2 * 2 + i // 4 for i in range(8)]
    for tie in ("min", "lane"):
        c, k = r.integers(0, 12, n), r.integers(1, 4, n)
        a, m2 = small.sizes(c, k, n), int(k.sum())
        row, com, e = small.ties(r.integers(0, n, 300), c[r.integers(0, n, 300)], np.ones(300, np.int64), n, n)
        to = dict(zip(*(x.tolist() for x in small.choose(row, com, e, k, a, c, m2, tie))))
        for v in range(n):
            near = [(int(y), int(z)) for x, y, z in zip(row, com, e) if x == v]
            score = {y: m2 * z - int(k[v]) * int(a[y] - (k[v] if y == c[v] else 0)) for y, z in near}
            stay = score.get(int(c[v]), -int(k[v]) * int(a[c[v]] - k[v]))
            order = {y: (lanes[i % 8], i) if tie == "lane" else y for i, (y, _) in enumerate(near)}
            best = min((y for y in score if y != c[v]), key=lambda y: (-score[y], order[y]), default=None)
            assert to.get(v) == (best if best is not None and score[best] > stay else None)


def test_blocks_have_like_numbers_of_arcs_in_narrow_types():
    assert [held.narrow(0, x, False) for x in (255, 256, 65_536, 1 << 32)] == ["<u1", "<u2", "<u4", "<i8"] and held.narrow(-1, 1, False) == "<i8" and held.narrow(0, 1, True) == "<f8"
    count = np.full(9000, 9000)
    windows = small.windows(count, 8, 1, "edge")
    at, parts = held.homes(count, windows, 6)
    arcs = np.bincount(at, count)
    assert parts % 6 == 0 and len(arcs) == 8 * parts and arcs.max() <= held.BLOCK + 9000 and arcs.max() < 1.1 * arcs.min()
    assert all(set(at[lo:hi] // parts) == {b} for b, ranges in enumerate(windows) for lo, hi in ranges)


def grouped(n, groups, size, top, seed=9):
    """Counts of members by group, once a pair, and the arcs that they make."""
    r = np.random.default_rng(seed)
    pairs = np.unique(np.stack([r.integers(0, groups, size), r.integers(0, n - 2, size) ** 2 // (n - 2)]), axis=1)
    table = np.zeros((n, groups), np.int64)
    table[pairs[1], pairs[0]] = r.integers(1, top, pairs.shape[1])
    arcs = table @ table.T
    np.fill_diagonal(arcs, 0)
    return pairs, table[pairs[1], pairs[0]], table, arcs


def test_ties_by_groups_need_no_arcs(spark):
    def refused():
        raise AssertionError("arcs were made")

    for top, options in ((2, {"batches": 8}), (4, {"batches": 3, "devices": 2, "partition_by": "vertex"}), (200_000, {"batches": 2, "max_iter": 1, "max_phases": 1})):
        pairs, count, _, arcs = grouped(70, 12, 200, top)
        ties = spark.createDataFrame([(int(g) - 5, int(m), int(c)) for g, m, c in zip(*pairs, count)], "group long, member long, n long")
        src, dst = np.nonzero(arcs)
        edges = spark.createDataFrame([tuple(map(int, x)) for x in zip(src, dst, arcs[src, dst])], schema.EDGES)
        vertices = spark.range(70).select(F.col("id").alias("v"))
        want, got = Louvain(**options, small_arcs=0 if top > 9 else 10**6).fit(Graph(vertices, edges)), Louvain(**options).fit(Shared(vertices, ties, refused))
        one, other = ([sorted(map(tuple, x.collect())) for x in (f.communities, f.hierarchy, f.history, f.phases)] for f in (want, got))
        assert one == other and one[2]
    assert sorted(Louvain(batches=2, tie="lane").fit(Shared(vertices, ties, lambda: edges)).communities.collect()) == sorted(Louvain(batches=2, tie="lane").fit(Graph(vertices, edges)).communities.collect())
    alone = spark.createDataFrame([(g, g, 1) for g in range(4)], "group long, member long, n long")
    none = Louvain().fit(Shared(vertices.limit(4), alone, refused))
    assert none.q_final is None and none.phases.collect()[0][:] == (0, 1, None, 4, 0, 4)
    assert Louvain().fit(Shared(vertices.limit(4), alone.limit(0), lambda: edges.limit(0))).communities.count() == 4


def test_phases_of_users_make_no_arcs(spark, monkeypatch):
    want = Louvain(batches=8).fit(Graph(*tables.user_hour(spark, "/root/testdata/sf0.001"))).phases.collect()
    for name in ("_shared", "_shared_blocks"):
        monkeypatch.setattr(tables, name, None)
    assert queries.QUERIES["louvain_phases"](spark, "/root/testdata/sf0.001").collect() == want


@pytest.mark.parametrize("dense", [0, 10**9])  # products of tables; sums of pairs
@pytest.mark.parametrize("top", [2, 9, 9000])
def test_moves_by_groups_are_those_of_arcs(monkeypatch, dense, top):
    monkeypatch.setattr(shared, "DENSE", 0 if dense else 10**9)
    monkeypatch.setattr(shared, "TABLE", 200)
    monkeypatch.setattr(shared, "CELLS", 300)
    monkeypatch.setattr(shared, "PAIRS", 100)
    n, groups = 90, 14
    pairs, count, table, arcs = grouped(n, groups, 300, top)
    counts = shared.Counts(pairs[0], pairs[1], count, n)
    loops = np.arange(n) % 3 == 0
    for tasks in (1, 3):
        assert (sum(shared.degrees(counts, loops, r, tasks) for r in range(tasks)) == (arcs > 0).sum(axis=1) + loops).all()
    assert (counts.squares == (table * table).sum(axis=1)).all() and (counts.most == (table @ table.sum(axis=0))).all()
    k, r = arcs.sum(axis=1) + loops * 7, np.random.default_rng(1)
    m2, moved = int(k.sum()), 0
    for communities in (1, 2, 5, 30, n):
        c = np.arange(n) if communities == n else r.integers(0, communities, n) * 3 % n
        a, (labels, label) = small.sizes(c, k, n), small.numbered(c, n)
        order = np.argsort(label, kind="stable")
        for movers in (np.arange(n), np.arange(20, 50), np.arange(0)):
            cut = [0, len(labels) // 3, len(labels)]
            found = [x for lo, hi in zip(cut, cut[1:]) for x in shared.near(counts, movers, order, label, lo, hi, k, a[labels], m2)]
            v, to, e = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            order_of = np.lexsort((to, v))
            got = small.choose(v[order_of], labels[to[order_of]], e[order_of], k, a, c, m2, "min")
            src, dst = np.nonzero(arcs[movers])
            row, t, e = small.ties(movers[src], label[dst], arcs[movers][src, dst], n, len(labels))
            want = small.choose(row, labels[t], e, k, a, c, m2, "min")
            assert [x.tolist() for x in got] == [x.tolist() for x in want]
            moved += len(want[0])
    assert moved > 100


def test_scores_wider_than_64_bits():
    r = np.random.default_rng(8)
    n = 40
    c, k = r.integers(0, 9, n), r.integers(1, 50, n)
    row, com, e = small.ties(r.integers(0, n, 200), c[r.integers(0, n, 200)], r.integers(1, 5, 200), n, n)
    for tie in ("min", "lane"):
        want, got = (small.choose(row, com, e << by, k << by, small.sizes(c, k << by, n), c, int(k.sum()) << by, tie) for by in (0, 36))
        assert len(want[0]) and [x.tolist() for x in got] == [x.tolist() for x in want]
