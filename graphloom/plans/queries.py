"""The registered graph queries, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graph as graphs
from ..graph import Graph, Shared
from ..lineage import cut, shared_folder
from ..operators import coloring, contract, degree, moves, partition
from ..sources import generate, tables, text
from . import oracle
from .louvain import Louvain
from .oracle import NATION, PART, PLANTED, RING, SUPP, USER, query

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _nation(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(*tables.nation_trade(spark, sf_dir))


def _part(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(*tables.part_co_order(spark, sf_dir))


def _supp(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(*tables.supp_co_order(spark, sf_dir))


def _kept(g: Graph) -> Graph:
    """The graph with its arcs written once, for queries that read them more than once."""
    return Graph(g.vertices, cut(g.edges))


def _mod5(g: Graph) -> DataFrame:
    """A fixed state of five communities."""
    return cut(g.weighted_degrees().select("v", "k", (F.col("v") % 5).alias("c")))


def _m2(g: Graph) -> int:
    return degree.total_mass(g.edges).first()["m2"]


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Graphs from tables and rules


@register(query(NATION, "SELECT src, dst, w FROM g"))
def nation_trade(spark, sf_dir):
    return _nation(spark, sf_dir).edges


@register(query(PART, "SELECT src, dst, w FROM g"))
def part_co_order(spark, sf_dir):
    return _part(spark, sf_dir).edges


@register(query(SUPP, "SELECT src, dst, w FROM g"))
def supp_co_order(spark, sf_dir):
    return _supp(spark, sf_dir).edges


@register(query(USER, "SELECT src, dst, w FROM g"))
def user_hour(spark, sf_dir):
    return Graph(*tables.user_hour(spark, sf_dir)).edges


@register(query(RING, "SELECT src, dst, w FROM g"))
def ring_of_cliques(spark, sf_dir):
    return generate.ring_of_cliques(spark)[1]


@register(query(PLANTED, "SELECT src, dst, w FROM g"))
def planted_partition(spark, sf_dir):
    return generate.planted_partition(spark)[1]


@register()
def random_ba(spark, sf_dir):
    return generate.random_ba(spark, 2000, 4)[1]


@register()
def random_weights(spark, sf_dir):
    return _supp(spark, sf_dir).randomize_weights().edges


# Degrees


@register(query(PART, "SELECT v, degree FROM deg"))
def degrees(spark, sf_dir):
    return _part(spark, sf_dir).degrees()


@register(query(PART, "SELECT v, k FROM deg"))
def weighted_degrees(spark, sf_dir):
    return _part(spark, sf_dir).weighted_degrees()


@register(query(PART, "SELECT v, max_w FROM deg"))
def max_incident_weights(spark, sf_dir):
    return _part(spark, sf_dir).max_incident_weights()


@register(query(PART, "SELECT max(degree) AS max_degree FROM deg"))
def max_degree(spark, sf_dir):
    g = _part(spark, sf_dir)
    return degree.max_degree(g.vertices, g.edges)


@register(query(PART, "SELECT m2, m2 / 2.0::DOUBLE AS mass FROM mm"))
def total_mass(spark, sf_dir):
    return degree.total_mass(_part(spark, sf_dir).edges)


@register(
    query(
        PART,
        """SELECT n AS n_vertices, s AS n_arcs, mx AS max_degree, md AS median_degree, q::DOUBLE / n::DOUBLE AS mean_sq_degree,
  (n * q - s * s)::DOUBLE / (n * n)::DOUBLE AS variance, sqrt((n * q - s * s)::DOUBLE / (n * n)::DOUBLE) AS stddev
FROM (SELECT count(*)::BIGINT AS n, sum(degree)::BIGINT AS s, max(degree) AS mx, quantile_cont(degree::DOUBLE, 0.5) AS md, sum(degree * degree)::BIGINT AS q FROM deg)""",
    )
)
def graph_stats(spark, sf_dir):
    return _part(spark, sf_dir).stats()


@register(query(NATION, "SELECT dst, w FROM g WHERE src = 7"))
def neighbors(spark, sf_dir):
    return _nation(spark, sf_dir).neighbors(7)


# Shape


@register(query(SUPP, "SELECT src, dst, w FROM g"))
def symmetrize(spark, sf_dir):
    return graphs.symmetrize(_supp(spark, sf_dir).edges.where("src <= dst"))


@register("SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def dedupe_parallel_edges(spark, sf_dir):
    return Graph(spark.range(25).select(F.col("id").alias("v")), tables.trade_pairs(spark, sf_dir)).dedupe().edges


@register(query(NATION, "SELECT src, dst, CASE WHEN src = dst THEN 0 ELSE w END AS w FROM g"))
def self_loop_mask(spark, sf_dir):
    return graphs.mask_loops(_nation(spark, sf_dir).edges)


@register(query(PART, "SELECT v, (sum(degree) OVER (ORDER BY v) - degree)::BIGINT AS \"begin\", (sum(degree) OVER (ORDER BY v))::BIGINT AS \"end\" FROM deg"))
def csr_offsets(spark, sf_dir):
    return _part(spark, sf_dir).csr_offsets()


def _bounds_sql(parts: int) -> str:
    chain, names = oracle.cut_chain("g", "vv", parts, "z")
    edges = ["0", *[f"(SELECT cutoff FROM {b})" for b in names], "(SELECT nv FROM zn)"]
    rows = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return query(PART, f"SELECT * FROM (VALUES {rows}) AS t(b, v_lo, v_hi)", ",\n" + chain)


@register(_bounds_sql(8))
def edge_balanced_batches(spark, sf_dir):
    g = _part(spark, sf_dir)
    offsets = cut(g.csr_offsets())
    row = offsets.agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("arcs")).first()
    return partition.table(spark, partition.edge_balanced(offsets, row["n"], row["arcs"] or 0, 8))


@register("SELECT i::INT AS b, i * (n // 8) AS v_lo, CASE WHEN i = 7 THEN n ELSE (i + 1) * (n // 8) END AS v_hi FROM range(8) t(i), (SELECT count(*) AS n FROM part)")
def vertex_balanced_batches(spark, sf_dir):
    return partition.table(spark, partition.vertex_balanced(_part(spark, sf_dir).num_vertices(), 8))


# Communities


@register(query(PART, "SELECT v, k, v AS c FROM deg"))
def singleton_partition(spark, sf_dir):
    return moves.singletons(_part(spark, sf_dir).weighted_degrees())


@register(query(PART, "SELECT v, (v * 7919 + 13) % 2 AS c FROM vv"))
def two_way_partition(spark, sf_dir):
    return partition.two_way(_part(spark, sf_dir).vertices)


@register(query(PART, "SELECT c, sum(k)::BIGINT AS a FROM p5 GROUP BY c"))
def community_weights(spark, sf_dir):
    return moves.community_weights(_mod5(_part(spark, sf_dir)))


@register(query(PART, "SELECT src, c, CASE WHEN src = dst THEN 0 ELSE w END AS w FROM g JOIN p5 ON v = dst"))
def gather_neighbour_communities(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    return moves.gather(g.edges, _mod5(g))


@register(query(PART, "SELECT src, c, sum(CASE WHEN src = dst THEN 0 ELSE w END)::BIGINT AS e FROM g JOIN p5 ON v = dst GROUP BY ALL"))
def neighbour_community_sums(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    return moves.neighbour_sums(g.edges, _mod5(g))


@register(query(PART, "SELECT src, count(DISTINCT c) AS n FROM g JOIN p5 ON v = dst GROUP BY ALL"))
def distinct_neighbour_communities(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    return moves.distinct_communities(g.edges, _mod5(g))


_STEP = "," + oracle.superstep("p5", "z", "true")


@register(query(PART, "SELECT v, c, s::BIGINT AS s FROM zs", _STEP))
def move_scores(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    return moves.move_scores(g.edges, _mod5(g), _m2(g)).select("v", "c", F.col("s").cast("bigint").alias("s"))


@register(query(PART, "SELECT v, c AS best_c, s::BIGINT AS best_s FROM zt WHERE place = 1", _STEP))
def best_moves(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    return moves.best_moves(moves.move_scores(g.edges, _mod5(g), _m2(g))).where("best_c IS NOT NULL").select("v", "best_c", F.col("best_s").cast("bigint").alias("best_s"))


@register(query(NATION, "SELECT v, c AS best_c FROM zt WHERE place = 1", "," + oracle.superstep("p0", "z", "true", tie="lane")))
def best_moves_lane(spark, sf_dir):
    g = _kept(_nation(spark, sf_dir))
    return moves.best_moves(moves.move_scores(g.edges, moves.singletons(g.weighted_degrees()), _m2(g)), tie="lane").where("best_c IS NOT NULL").select("v", "best_c")


@register(query(PART, "SELECT v, c AS c_new FROM zm", _STEP))
def superstep_moves(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    return moves.moves(g.edges, _mod5(g), _m2(g), F.lit(True))


@register(query(PART, "SELECT c, sum(d)::BIGINT AS delta FROM (SELECT p.c, -p.k AS d FROM zm m JOIN p5 p USING (v) UNION ALL SELECT m.c, p.k FROM zm m JOIN p5 p USING (v)) GROUP BY c", _STEP))
def community_weight_delta(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    state = _mod5(g)
    return moves.weight_deltas(state, moves.moves(g.edges, state, _m2(g), F.lit(True)))


@register(query(PART, "SELECT v, k, c FROM z", _STEP))
def apply_moves(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    return moves.superstep(g.edges, _mod5(g), _m2(g), F.lit(True))


@register(query(PART, f"SELECT {oracle.modularity('p0')} AS q"))
def modularity_singleton(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    return moves.modularity(g.edges, moves.singletons(g.weighted_degrees()))


@register(query(PART, f"SELECT {oracle.modularity('p5')} AS q"))
def modularity_given_partition(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    return moves.modularity(g.edges, _mod5(g))


@register(query(PART, f"SELECT {oracle.modularity('p5')} AS q_before, {oracle.modularity('z')} AS q_after", _STEP))
def modularity_delta(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    state = _mod5(g)
    after = moves.modularity(g.edges, cut(moves.superstep(g.edges, state, _m2(g), F.lit(True))))
    both = moves.modularity(g.edges, state).select(F.col("q").alias("q_before"), F.lit(None).cast("double").alias("q_after")).unionByName(after.select(F.lit(None).cast("double").alias("q_before"), F.col("q").alias("q_after")))
    return both.agg(F.max("q_before").alias("q_before"), F.max("q_after").alias("q_after"))


# Iterations


def _iterations(spark: SparkSession, g: Graph, batches: int, times: int) -> DataFrame:
    edges, state = cut(g.edges), cut(moves.singletons(g.weighted_degrees()))
    offsets = cut(degree.csr_offsets(g.vertices, edges))
    row = offsets.agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("arcs")).first()
    m2 = degree.total_mass(edges).first()["m2"]
    bounds = partition.edge_balanced(offsets, row["n"], row["arcs"], batches)
    for _ in range(times):
        for lo, hi in zip(bounds, bounds[1:]):
            if lo < hi:
                state = cut(moves.superstep(edges, state, m2, F.col("v").between(lo, hi - 1)))
    return state


def _iterations_sql(base: str, batches: int, times: int) -> str:
    chain, names = oracle.cut_chain("g", "vv", batches, "y")
    steps, now = [], "p0"
    for i in range(times):
        steps.append(oracle.iteration(now, f"i{i}", oracle.ranges([f"(SELECT cutoff FROM {b})" for b in names], "0", "(SELECT nv FROM yn)")))
        now = f"i{i}"
    return query(base, f"SELECT v, k, c FROM {now}", ",\n" + chain + "," + ",".join(steps))


@register(_iterations_sql(NATION, 2, 1))
def one_iteration(spark, sf_dir):
    return _iterations(spark, _nation(spark, sf_dir), 2, 1)


@register(_iterations_sql(NATION, 2, 2))
def two_iterations(spark, sf_dir):
    return _iterations(spark, _nation(spark, sf_dir), 2, 2)


# Contraction


@register(query(PART, "SELECT c, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT DISTINCT v // 3 * 3 AS c FROM vv)"))
def relabel_dense(spark, sf_dir):
    return contract.relabel(_part(spark, sf_dir).vertices.select((F.floor(F.col("v") / 3) * 3).alias("c")))


@register(query(PART, "SELECT x.c AS src, y.c AS dst, sum(w)::BIGINT AS w FROM g JOIN p5 x ON x.v = src JOIN p5 y ON y.v = dst GROUP BY ALL"))
def contract_graph(spark, sf_dir):
    g = _kept(_part(spark, sf_dir))
    state = _mod5(g)
    return contract.contract(g.edges, state, contract.relabel(state))


@register(query(PART, "SELECT v, v % 5 % 2 AS community FROM vv"))
def compose_levels(spark, sf_dir):
    state = _mod5(_part(spark, sf_dir))
    first = contract.compose(state.select("v", F.col("v").alias("community")), state, contract.relabel(state))
    upper = spark.range(5).select(F.col("id").alias("v"), F.lit(0).cast("bigint").alias("k"), (F.col("id") % 2).alias("c"))
    return contract.compose(first, upper, contract.relabel(upper))


@register(query(PART, f"SELECT {oracle.modularity('p5')} AS q"))
def coarse_modularity(spark, sf_dir):
    """Singletons of the contracted graph have the modularity of the communities before."""
    g = _kept(_part(spark, sf_dir))
    state = _mod5(g)
    names = cut(contract.relabel(state))
    coarse = Graph(names.select(F.col("id").alias("v")), cut(contract.contract(g.edges, state, names)))
    return moves.modularity(coarse.edges, moves.singletons(coarse.weighted_degrees()))


# Whole runs


def _louvain_sql(kind: str, **options) -> str:
    ctes, last, history, phases = oracle.louvain(NATION, options.pop("batches", 2), 5, options.pop("loops", 4), **options)
    hierarchy = "\nUNION ALL ".join(f"SELECT {f}::INT AS level, v, community FROM h_{f + 1} WHERE levels = {f + 1}" for f in range(5))
    return f"{ctes}\n" + {"communities": f"SELECT v, community FROM {last}", "history": history, "hierarchy": hierarchy, "phases": phases}[kind]


@register(_louvain_sql("communities"))
def louvain_communities(spark, sf_dir):
    return Louvain(batches=2).fit(_nation(spark, sf_dir)).communities


@register(_louvain_sql("history"))
def louvain_history(spark, sf_dir):
    return Louvain(batches=2).fit(_nation(spark, sf_dir)).history


@register(_louvain_sql("communities"))
def louvain_supersteps(spark, sf_dir):
    """The same run by DataFrame supersteps in every phase."""
    return Louvain(batches=2, small_arcs=0).fit(_nation(spark, sf_dir)).communities


@register(_louvain_sql("hierarchy"))
def louvain_nation_hierarchy(spark, sf_dir):
    return Louvain(batches=2).fit(_nation(spark, sf_dir)).hierarchy


@register(_louvain_sql("phases"))
def louvain_nation_phases(spark, sf_dir):
    return Louvain(batches=2).fit(_nation(spark, sf_dir)).phases


@register(_louvain_sql("communities", tie="lane"))
def louvain_nation_lanes(spark, sf_dir):
    return Louvain(batches=2, tie="lane").fit(_nation(spark, sf_dir)).communities


@register(_louvain_sql("communities", devices=2))
def louvain_nation_devices(spark, sf_dir):
    return Louvain(batches=2, devices=2).fit(_nation(spark, sf_dir)).communities


@register(_louvain_sql("communities", init="v % 5"))
def louvain_from_partition(spark, sf_dir):
    g = _nation(spark, sf_dir)
    return Louvain(batches=2).fit(g, init=g.vertices.select("v", (F.col("v") % 5).alias("c"))).communities


@register()
def louvain_timings(spark, sf_dir):
    return Louvain(batches=2).fit(_nation(spark, sf_dir)).timings


@register()
def louvain_hierarchy(spark, sf_dir):
    return Louvain(batches=8).fit(_part(spark, sf_dir)).hierarchy


@register()
def louvain_phases(spark, sf_dir):
    return Louvain(batches=8).fit(Shared(*tables.users_by_hour(spark, sf_dir), lambda: tables.user_hour(spark, sf_dir)[1])).phases


@register()
def louvain_lane_ties(spark, sf_dir):
    return Louvain(batches=8, tie="lane").fit(_supp(spark, sf_dir)).communities


@register()
def louvain_devices(spark, sf_dir):
    return Louvain(batches=4, devices=2).fit(_supp(spark, sf_dir)).communities


@register()
def louvain_colored(spark, sf_dir):
    return Louvain(batches=2, coloring=True).fit(_ring(spark)).communities


# Coloring


def _ring(spark: SparkSession) -> Graph:
    return Graph(*generate.ring_of_cliques(spark))


@register()
def color_vertices(spark, sf_dir):
    g = Graph(*generate.planted_partition(spark))
    return coloring.coloring(g.vertices, g.edges)


@register("SELECT 0::BIGINT AS conflicts")
def coloring_conflicts(spark, sf_dir):
    g = _ring(spark)
    c = cut(coloring.coloring(g.vertices, g.edges))
    near = g.edges.where("src <> dst").join(c.select(F.col("v").alias("src"), F.col("color").alias("a")), "src").join(c.select(F.col("v").alias("dst"), F.col("color").alias("b")), "dst")
    return near.agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))


@register(query(PART, "SELECT (src * 7919 + 13) % n AS src, (dst * 7919 + 13) % n AS dst, w FROM g, (SELECT count(*) AS n FROM vv)"))
def reorder_graph(spark, sf_dir):
    """7919 is prime and divides no number of vertices here, so the positions are a permutation."""
    g = _part(spark, sf_dir)
    return g.reorder(g.vertices.select("v", ((F.col("v") * 7919 + 13) % g.num_vertices()).alias("position"))).edges


@register()
def color_count(spark, sf_dir):
    g = Graph(*generate.planted_partition(spark))
    return coloring.color_count(coloring.coloring(g.vertices, g.edges))


@register("SELECT count(*) AS n, sum(range)::BIGINT AS total FROM range(40)")
def reorder_by_color(spark, sf_dir):
    """Positions are a permutation."""
    return _ring(spark).coloring().agg(F.countDistinct("position").alias("n"), F.sum("position").alias("total"))


# Formats


@register(query(SUPP, "SELECT src, dst, w FROM g"))
def binary_roundtrip(spark, sf_dir):
    path = _scratch(spark, "graph").removeprefix("file://") + ".bin"
    _supp(spark, sf_dir).write_binary(path)
    return Graph.read_binary(spark, path, whole=True).edges


@register(query(SUPP, "SELECT src, dst, w FROM g"))
def edge_tsv_roundtrip(spark, sf_dir):
    path = _scratch(spark, "tsv")
    _supp(spark, sf_dir).write_tsv(path)
    return Graph.read_tsv(spark, path).edges.withColumn("w", F.col("w").cast("bigint"))


@register(query(NATION, "SELECT src, dst, w FROM g"))
def mtx_roundtrip(spark, sf_dir):
    path = _scratch(spark, "mtx")
    g = _nation(spark, sf_dir)
    text.write_mtx(g.vertices, g.edges, path)
    return Graph.read_mtx(spark, path).edges.withColumn("w", F.col("w").cast("bigint"))


@register(query(PART, "SELECT v, v % 5 AS community FROM vv"))
def communities_roundtrip(spark, sf_dir):
    path = _scratch(spark, "communities")
    text.write_communities(_part(spark, sf_dir).vertices.select("v", (F.col("v") % 5).alias("community")), path)
    return text.read_communities(spark, path)


@register("SELECT * FROM (VALUES ('null vertex', 0::BIGINT), ('null end', 0), ('bad weight', 0), ('unknown vertex', 0), ('asymmetric arc', 0)) AS t(problem, n)")
def validate(spark, sf_dir):
    from .. import schema

    g = _nation(spark, sf_dir)
    return schema.problems(g.vertices, g.edges)


@register(
    query(
        NATION,
        """SELECT * FROM (VALUES ('null vertex', 0::BIGINT), ('null end', 0), ('bad weight', (SELECT count(*) FROM g WHERE src % 3 = 0)), ('unknown vertex', (SELECT count(*) FROM g WHERE src % 4 = 0) + (SELECT count(*) FROM g WHERE dst % 4 = 0)),
  ('asymmetric arc', (SELECT count(*) FROM g WHERE src % 3 = 0 AND w <> 0 AND NOT (src = dst) AND dst % 3 <> 0) * 2)) AS t(problem, n)""",
    )
)
def validate_broken(spark, sf_dir):
    """Arcs from every third vertex lose their weight's sign, and every fourth vertex is missing."""
    from .. import schema

    g = _nation(spark, sf_dir)
    edges = g.edges.withColumn("w", F.when(F.col("src") % 3 == 0, -F.col("w") - 1).otherwise(F.col("w")))
    return schema.problems(g.vertices.where("v % 4 <> 0"), edges)
