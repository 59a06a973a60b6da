"""DuckDB SQL of the registered graph queries, over whole-number graphs."""

from __future__ import annotations

NATION = """
pairs AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
g AS MATERIALIZED (SELECT src, dst, sum(w)::BIGINT AS w FROM (SELECT src, dst, w FROM pairs UNION ALL SELECT dst, src, w FROM pairs) GROUP BY ALL),
vv AS MATERIALIZED (SELECT n_nationkey::BIGINT AS v FROM nation)"""


def _shared(group: str, member: str, rows: str, vertices: str) -> str:
    return f"""
cnt AS (SELECT {group} AS h, {member} AS u, count(*) AS n FROM {rows} GROUP BY ALL),
g AS MATERIALIZED (SELECT x.u AS src, y.u AS dst, sum(x.n * y.n)::BIGINT AS w FROM cnt x JOIN cnt y ON x.h = y.h AND x.u <> y.u GROUP BY ALL),
vv AS MATERIALIZED ({vertices})"""


PART = _shared("l_orderkey", "l_partkey", "lineitem", "SELECT p_partkey::BIGINT AS v FROM part")
SUPP = _shared("l_orderkey", "l_suppkey", "lineitem", "SELECT s_suppkey::BIGINT AS v FROM supplier")
USER = _shared("hour", "user_id", "(SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events)", "SELECT DISTINCT user_id AS v FROM events")
RING = """
half AS (SELECT q * 5 + i AS src, q * 5 + j AS dst FROM range(8) a(q), range(5) b(i), range(5) c(j) WHERE i < j UNION ALL SELECT q * 5, (q + 1) % 8 * 5 + 1 FROM range(8) a(q)),
g AS MATERIALIZED (SELECT src, dst, 1::BIGINT AS w FROM half UNION ALL SELECT dst, src, 1 FROM half),
vv AS MATERIALIZED (SELECT range AS v FROM range(40))"""
PLANTED = """
half AS (SELECT i AS src, j AS dst FROM range(120) a(i), range(120) b(j) WHERE j < i AND (i * 7919 + j * 104729) % 1000 < CASE WHEN i // 20 = j // 20 THEN 600 ELSE 30 END),
g AS MATERIALIZED (SELECT src, dst, 1::BIGINT AS w FROM half UNION ALL SELECT dst, src, 1 FROM half),
vv AS MATERIALIZED (SELECT range AS v FROM range(120))"""

MASS = """,
deg AS MATERIALIZED (SELECT v, coalesce(d, 0)::BIGINT AS degree, coalesce(k, 0)::BIGINT AS k, greatest(coalesce(mx, 0), 0)::BIGINT AS max_w
  FROM vv LEFT JOIN (SELECT src, count(*) AS d, sum(w) AS k, max(w) AS mx FROM g GROUP BY src) ON v = src),
mm AS MATERIALIZED (SELECT sum(k)::BIGINT AS m2 FROM deg),
p0 AS MATERIALIZED (SELECT v, k, v AS c FROM deg),
p5 AS MATERIALIZED (SELECT v, k, v % 5 AS c FROM deg)"""


def query(base: str, body: str, extra: str = "") -> str:
    return f"WITH {base}{MASS}{extra}\n{body}"


def cut_chain(g: str, v: str, parts: int, tag: str) -> tuple[str, list[str]]:
    """CTEs of the greedy edge-balanced bounds, one row each (cutoff, base), and the names of the inner bounds."""
    ctes = [
        f"{tag}o AS MATERIALIZED (SELECT v, sum(n) OVER (ORDER BY v)::BIGINT AS e FROM (SELECT v, count(src) AS n FROM {v} LEFT JOIN {g} ON src = v GROUP BY v))",
        f"{tag}n AS MATERIALIZED (SELECT count(*)::BIGINT AS nv, (SELECT count(*) FROM {g})::BIGINT AS ne FROM {v})",
    ]
    before, names = "(SELECT 0::BIGINT AS cutoff, 0::BIGINT AS base)", []
    for i in range(1, parts):
        name = f"{tag}b{i}"
        ctes.append(
            f"{name} AS MATERIALIZED (SELECT CASE WHEN o.v IS NULL THEN nv ELSE o.v + 1 END AS cutoff, coalesce(o.e, ne) AS base FROM {tag}n, {before} x "
            f"LEFT JOIN {tag}o o ON o.v = (SELECT min(y.v) FROM {tag}o y, {tag}n z, {before} b WHERE y.v >= b.cutoff AND y.e - b.base > z.ne // {parts}))"
        )
        before = name
        names.append(name)
    return ",\n".join(ctes), names


def superstep(p: str, out: str, where: str, g: str = "g", mass: str = "mm", tie: str = "min") -> str:
    """CTEs from state p (v, k, c) to state out; where: SQL of the condition on the movers x.v."""
    second = "c" if tie == "min" else "(r % 8 % 2 * 4 + r % 8 // 2 % 2 * 2 + r % 8 // 4), r"
    return f"""
{out}a AS MATERIALIZED (SELECT c, sum(k)::BIGINT AS a FROM {p} GROUP BY c),
{out}x AS MATERIALIZED (SELECT x.v, x.k, x.c, y.a FROM {p} x JOIN {out}a y USING (c) WHERE {where}),
{out}n AS MATERIALIZED (SELECT x.v, x.k, x.c AS own, p.c, sum(CASE WHEN src = dst THEN 0 ELSE w END)::BIGINT AS e FROM {g} JOIN {out}x x ON x.v = src JOIN {p} p ON p.v = dst GROUP BY ALL),
{out}s AS MATERIALIZED (SELECT n.v, n.c, n.own, m2 * e - n.k * (a - CASE WHEN n.c = own THEN n.k ELSE 0 END) AS s, row_number() OVER (PARTITION BY n.v ORDER BY n.c) - 1 AS r FROM {out}n n JOIN {out}a y ON y.c = n.c, {mass}),
{out}t AS MATERIALIZED (SELECT v, c, s, row_number() OVER (PARTITION BY v ORDER BY s DESC, {second}) AS place FROM {out}s WHERE c <> own),
{out}m AS MATERIALIZED (SELECT t.v, t.c FROM {out}t t JOIN {out}x x ON x.v = t.v LEFT JOIN {out}s o ON o.v = t.v AND o.c = o.own WHERE place = 1 AND t.s > coalesce(o.s, -x.k * (x.a - x.k))),
{out} AS MATERIALIZED (SELECT p.v, p.k, coalesce(m.c, p.c) AS c FROM {p} p LEFT JOIN {out}m m ON m.v = p.v)"""


def modularity(p: str, g: str = "g") -> str:
    """Scalar SQL."""
    return (
        f"(SELECT CASE WHEN m2 = 0 THEN NULL ELSE (m2 * s_in - s_sq)::DOUBLE / (m2 * m2)::DOUBLE END FROM "
        f"(SELECT coalesce(sum(k), 0)::BIGINT AS m2 FROM {p}), "
        f"(SELECT coalesce(sum(w), 0)::BIGINT AS s_in FROM {g} JOIN {p} x ON x.v = src JOIN {p} y ON y.v = dst WHERE x.c = y.c), "
        f"(SELECT coalesce(sum(a * a), 0)::BIGINT AS s_sq FROM (SELECT sum(k)::BIGINT AS a FROM {p} GROUP BY c)))"
    )


def iteration(p: str, out: str, batches: list[str], g: str = "g", mass: str = "mm", tie: str = "min") -> str:
    """CTEs of all batches, from state p to state out; batches: SQL of the condition on each one's movers x.v."""
    ctes, now = [], p
    for i, where in enumerate(batches):
        name = out if i == len(batches) - 1 else f"{out}_{i}"
        ctes.append(superstep(now, name, where, g, mass, tie))
        now = name
    return ",".join(ctes)


def ranges(bounds: list[str], lo: str, hi: str) -> list[str]:
    """Conditions of the ranges between bounds, from lo to hi, all of them SQL of one value."""
    edges = [lo, *bounds, hi]
    return [f"(x.v >= {a} AND x.v < {b})" for a, b in zip(edges, edges[1:])]


def batched(g: str, v: str, parts: int, devices: int, tag: str) -> tuple[str, list[str]]:
    """CTEs of the bounds and the condition of each batch: the same range of every device's vertices."""
    outer, names = cut_chain(g, v, devices, f"{tag}")
    marks = ["0", *[f"(SELECT cutoff FROM {b})" for b in names], f"(SELECT nv FROM {tag}n)"]
    ctes, each = [outer], []
    for d, (lo, hi) in enumerate(zip(marks, marks[1:])):
        t = f"{tag}d{d}"
        ctes.append(f"{t}v AS MATERIALIZED (SELECT v - {lo} AS v FROM {v} WHERE v >= {lo} AND v < {hi})")
        ctes.append(f"{t}g AS MATERIALIZED (SELECT src - {lo} AS src FROM {g} WHERE src >= {lo} AND src < {hi})")
        chain, inner = cut_chain(f"{t}g", f"{t}v", parts, t)
        ctes.append(chain)
        each.append(ranges([f"({lo} + (SELECT cutoff FROM {b}))" for b in inner], lo, hi))
    return ",\n".join(ctes), [" OR ".join(x) for x in zip(*each)]


def louvain(base: str, batches: int, phases: int, loops: int, tol: float = 1e-6, tie: str = "min", devices: int = 1, init: str = "v") -> tuple[str, str, str, str]:
    """(CTEs, name of the last composition, SQL of the history, SQL of the phases) of at most ``phases`` phases of ``loops`` iterations.

    init: SQL of the first phase's communities.  Control rows carry on unchanged once an end is reached; SQL has no loop over aggregates, so the
    bounds must be no less than what the data needs.
    """
    ctes = [base + MASS, "h_0 AS (SELECT v, v AS community, 0 AS levels FROM vv)", "live_0 AS (SELECT true AS live)"]
    g, verts, history, told = "g", "vv", [], []
    for f in range(phases):
        t = f"f{f}"
        own = init if f == 0 else "v"
        ctes.append(f"{t}k AS MATERIALIZED (SELECT v, coalesce(sum(w), 0)::BIGINT AS k FROM {verts} LEFT JOIN {g} ON src = v GROUP BY v)")
        ctes.append(f"{t}mm AS MATERIALIZED (SELECT sum(k)::BIGINT AS m2 FROM {t}k)")
        chain, where = batched(g, verts, batches, devices, t)
        ctes += [chain, f"{t}p0 AS MATERIALIZED (SELECT v, k, {own} AS c FROM {t}k)"]
        ctes.append(f"{t}c0 AS MATERIALIZED (SELECT {modularity(f'{t}p0', g)} AS q, 1e300 AS gain, live AS running, NULL::DOUBLE AS seen, 0 AS ran FROM live_{f})")
        for i in range(1, loops + 1):
            ctes.append(iteration(f"{t}p{i - 1}", f"{t}r{i}", where, g, f"{t}mm", tie))
            ctes.append(f"{t}q{i} AS MATERIALIZED (SELECT {modularity(f'{t}r{i}', g)} AS q)")
            ctes.append(
                f"{t}c{i} AS MATERIALIZED (SELECT CASE WHEN c.running AND c.gain > {tol} AND n.q >= c.q THEN n.q ELSE c.q END AS q, "
                f"CASE WHEN c.running AND c.gain > {tol} THEN n.q - c.q ELSE c.gain END AS gain, c.running AND c.gain > {tol} AS running, n.q AS seen, "
                f"ran + (c.running AND c.gain > {tol})::INT AS ran FROM {t}c{i - 1} c, {t}q{i} n)"
            )
            ctes.append(f"{t}p{i} AS MATERIALIZED (SELECT x.v, x.k, CASE WHEN running AND gain >= 0 THEN y.c ELSE x.c END AS c FROM {t}p{i - 1} x JOIN {t}r{i} y USING (v), {t}c{i})")
            history.append(f"SELECT {f}::INT AS phase, {i}::INT AS loop, seen AS q, gain AS dq, gain >= 0 AS accepted, nv AS n_vertices, ne AS n_arcs FROM {t}c{i}, {t}n WHERE running")
        end = f"{t}p{loops}"
        keep = "live" if f == 0 and init != "v" else f"live AND z.q - a.q > {tol}"
        ctes.append(f"{t}w AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT DISTINCT c FROM {end}))")
        ctes.append(f"{t}up AS MATERIALIZED (SELECT {keep} AS up FROM live_{f}, {t}c{loops} z, {t}c0 a)")
        ctes.append(f"{t}to AS MATERIALIZED (SELECT v, id FROM {end} JOIN {t}w USING (c))")
        ctes.append(f"h_{f + 1} AS MATERIALIZED (SELECT h.v, CASE WHEN up THEN id ELSE community END AS community, levels + up::INT AS levels FROM h_{f} h LEFT JOIN {t}to n ON n.v = h.community, {t}up)")
        ctes.append(f"live_{f + 1} AS MATERIALIZED (SELECT up AND (SELECT count(*) FROM {t}w) NOT IN (1, nv) AS live FROM {t}up, {t}n)")
        ctes.append(f"{t}g AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, sum(w)::BIGINT AS w FROM {g} JOIN {t}to a ON a.v = src JOIN {t}to b ON b.v = dst GROUP BY ALL)")
        ctes.append(f"{t}v AS MATERIALIZED (SELECT id AS v FROM {t}w)")
        told.append(f"SELECT {f}::INT AS phase, ran::INT AS loops, q, nv AS n_vertices, ne AS n_arcs, (SELECT count(*) FROM {t}w) AS n_communities FROM {t}c{loops}, {t}n, live_{f} WHERE live")
        g, verts = f"{t}g", f"{t}v"
    return "WITH " + ",\n".join(ctes), f"h_{phases}", "\nUNION ALL ".join(history), "\nUNION ALL ".join(told)
