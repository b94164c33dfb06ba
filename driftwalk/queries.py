"""One query per operator, each with the SQL that gives the same rows.

QUERIES: name -> function of (spark, sf_dir). SQL: name -> text over the
tables of sf_dir. Both are filled by the functions below, group by group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwalk.config import WalkConfig
from driftwalk.functions.pairing import decode_step, encode_step, pair, pair_triplet, unpair, unpair_triplet
from driftwalk.functions.rng import hashed_draw, portable_draw_sql
from driftwalk.operators import chains, embeddings, graph, lookup, metrics, ordered, suffixes, triangles, updates, walks
from driftwalk.plans import strategy
from driftwalk.plans.materialise import folder, stored, stored_edges
from driftwalk.sources import graph_files, rmat, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LENGTH = 6
DEEP = WalkConfig(length=LENGTH)
BASE_BEFORE = "2001-01-01"

# ---------------------------------------------------------------- SQL pieces

PAIRS = """l AS (SELECT o_custkey * 3 c, l_partkey * 3 + 1 p, l_suppkey * 3 + 2 s, o_orderdate dt, l_returnflag rf FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
pr AS (SELECT c a, p b, dt, rf FROM l UNION ALL SELECT p, s, dt, rf FROM l UNION ALL SELECT c, s, dt, rf FROM l)"""


def _mirror(name: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT DISTINCT src, dst FROM (SELECT a src, b dst FROM pr WHERE {where} UNION ALL SELECT b, a FROM pr WHERE {where}) WHERE src <> dst)"


ALL = f"{PAIRS}, {_mirror('e')}"
BASE = f"{PAIRS}, {_mirror('e', "dt < TIMESTAMP '2001-01-01'")}"
BIPARTITE = """e AS (SELECT DISTINCT src, dst FROM (SELECT o_custkey * 2 src, l_partkey * 2 + 1 dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT l_partkey * 2 + 1, o_custkey * 2 FROM orders JOIN lineitem ON o_orderkey = l_orderkey))"""


def _month(name: str, month: int, returned: bool = False) -> str:
    return _mirror(name, f"dt >= TIMESTAMP '2001-{month:02d}-01' AND dt < TIMESTAMP '2001-{month + 1:02d}-01'" + " AND rf = 'R'" * returned)


def _adj(edges: str = "e", name: str = "adj") -> str:
    return f"{name} AS (SELECT src u, dst v, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 idx, count(*) OVER (PARTITION BY src) deg FROM {edges})"


def _starts(edges: str = "e", reps: int = 1) -> str:
    return f"n AS (SELECT max(greatest(src, dst)) + 1 n FROM {edges}), st AS (SELECT (r.range * n + v.range)::BIGINT walk_id, v.range vertex FROM n, range({reps}) r, (SELECT unnest(range(n)) AS range FROM n) v)"


def _walk(name: str, starts: str, adj: str, length: int = LENGTH, seed: int = 42, batch: int = 0) -> str:
    """Paths as rows (walk_id, pos, vertex); starts(walk_id, p0, vertex)."""
    draw = portable_draw_sql("x.walk_id", "x.pos + 1", str(seed), str(batch))
    return f"""{name}p AS (SELECT walk_id, p0::BIGINT pos, vertex FROM {starts}
UNION ALL SELECT x.walk_id, x.pos + 1, a.v FROM {name}p x JOIN {adj} a ON a.u = x.vertex AND a.idx = {draw} % a.deg WHERE x.pos < {length - 1}),
{name} AS (SELECT walk_id, pos, vertex, coalesce(lead(vertex) OVER (PARTITION BY walk_id ORDER BY pos), vertex) "next", {batch} batch FROM {name}p)"""


def _w0(edges: str = "e") -> str:
    return f"{_adj(edges)}, {_starts(edges)}, s0 AS (SELECT walk_id, 0 p0, vertex FROM st), {_walk('w', 's0', 'adj')}"


STEP_OUT = 'walk_id, pos::INTEGER pos, vertex, "next", batch::INTEGER batch'


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _edges(spark, sf):
    return tables.tripartite_edges(spark, sf)


def _base(spark, sf):
    return tables.tripartite_edges(spark, sf, BASE_BEFORE)


# ---------------------------------------------------------------- graph

query("edges_symmetric", f"WITH {ALL} SELECT src, dst FROM e")(_edges)
query("edge_dedup_no_selfloop", "WITH r AS (SELECT user_id src, lead(user_id) OVER (ORDER BY ts, event_id) dst FROM events) SELECT DISTINCT src, dst FROM r WHERE src <> dst")(
    lambda s, d: graph.clean_batch(tables.table(s, d, "events").selectExpr("user_id AS src", "lead(user_id) OVER (ORDER BY ts, event_id) AS dst"))
)
query("adjacency_index", f"WITH {ALL}, {_adj()} SELECT u, idx, v, deg FROM adj")(lambda s, d: graph.adjacency(_edges(s, d)))
query("vertex_count_maxid", f"WITH {ALL} SELECT max(greatest(src, dst)) + 1 n FROM e")(lambda s, d: graph.vertex_count(_edges(s, d)))
query("edge_count", f"WITH {ALL} SELECT count(*) m FROM e")(lambda s, d: graph.edge_count(_edges(s, d)))
query("degree", f"WITH {ALL} SELECT src vertex, count(*) degree FROM e GROUP BY 1")(lambda s, d: graph.degrees(_edges(s, d)))
query("degree_histogram", f"WITH {ALL}, g AS (SELECT count(*) degree FROM e GROUP BY src) SELECT degree, count(*) vertices FROM g GROUP BY 1")(lambda s, d: graph.degree_histogram(_edges(s, d)))
query("isolated_vertices", f"WITH {ALL}, {_starts()} SELECT vertex FROM st WHERE vertex NOT IN (SELECT src FROM e)")(lambda s, d: walks.id_domain(_edges(s, d)).select("vertex").join(_edges(s, d).select(F.col("src").alias("vertex")), "vertex", "left_anti"))


@query("has_edge", f"WITH {ALL} SELECT o_custkey * 3 src, (o_orderkey % 100) * 3 + 2 dst, EXISTS (SELECT 1 FROM e WHERE e.src = o_custkey * 3 AND e.dst = (o_orderkey % 100) * 3 + 2) has_edge FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)")
def _has_edge(spark, sf):
    asked = tables.table(spark, sf, "orders").select((F.col("o_custkey") * 3).alias("src"), ((F.col("o_orderkey") % 100) * 3 + 2).alias("dst"))
    return graph.has_edge(asked, _edges(spark, sf))


@query("k_hop_frontier", f"WITH {ALL}, h0 AS (SELECT 0::BIGINT vertex), h1 AS (SELECT DISTINCT dst vertex FROM e WHERE src IN (SELECT vertex FROM h0)), h2 AS (SELECT DISTINCT dst vertex FROM e WHERE src IN (SELECT vertex FROM h1)), h3 AS (SELECT DISTINCT dst vertex FROM e WHERE src IN (SELECT vertex FROM h2)), u AS (SELECT vertex, 0 hop FROM h0 UNION ALL SELECT vertex, 1 FROM h1 UNION ALL SELECT vertex, 2 FROM h2 UNION ALL SELECT vertex, 3 FROM h3) SELECT vertex, min(hop)::INTEGER hop FROM u GROUP BY 1")
def _k_hop(spark, sf):
    return graph.k_hop(stored_edges(_edges(spark, sf), "hop-edges"), spark.range(1).select(F.col("id").alias("vertex")), 3)


@query("edge_map_sparse", f"WITH {ALL} SELECT DISTINCT dst vertex FROM e WHERE src < 30 AND dst % 3 = 2")
def _edge_map(spark, sf):
    return graph.edge_map(spark.range(30).select(F.col("id").alias("vertex")), _edges(spark, sf), F.col("dst") % 3 == 2)


query("vertex_map_subset", f"WITH {ALL}, g AS (SELECT src vertex, count(*) degree FROM e GROUP BY 1) SELECT vertex FROM g WHERE degree > 100")(lambda s, d: graph.vertex_subset(graph.degrees(_edges(s, d)), F.col("degree") > 100))
query("edge_union", f"WITH {PAIRS}, {_mirror('a0', "dt < TIMESTAMP '2001-01-01'")}, {_month('b0', 1)} SELECT src, dst FROM a0 UNION SELECT src, dst FROM b0")(lambda s, d: graph.edge_union(_base(s, d), tables.month_batch(s, d, 1)))
query("edge_difference", f"WITH {PAIRS}, {_mirror('a0', "dt < TIMESTAMP '2001-01-01'")}, {_month('b0', 1, True)} SELECT src, dst FROM a0 EXCEPT SELECT src, dst FROM b0")(lambda s, d: graph.edge_difference(_base(s, d), tables.month_batch(s, d, 1, True)))
query("batch_runs_by_source", f"WITH {PAIRS}, {_month('b0', 2)} SELECT src, count(*) run_length, min(dst) first_dst, max(dst) last_dst FROM b0 GROUP BY 1")(lambda s, d: graph.batch_runs(tables.month_batch(s, d, 2)))
query("neighbor_intersection_count", f"WITH {ALL} SELECT q.src, q.dst, count(y.src) common FROM e q LEFT JOIN e x ON x.src = q.src LEFT JOIN e y ON y.src = q.dst AND y.dst = x.dst GROUP BY 1, 2")(lambda s, d: triangles.edge_triangles(stored_edges(_edges(s, d), "intersection-edges")))
query("triangle_count", f"WITH {BASE} SELECT count(*) // 6 triangles FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = y.dst AND z.dst = x.src")(lambda s, d: graph.triangle_count(_base(s, d)))
query("spmv", f"WITH {ALL} SELECT src vertex, sum(dst % 7 + 1)::BIGINT \"value\" FROM e GROUP BY 1")(lambda s, d: graph.spmv(_edges(s, d), walks.id_domain(_edges(s, d)).select("vertex", (F.col("vertex") % 7 + 1).alias("value"))))
query("connected_components", f"WITH RECURSIVE {ALL}, r(vertex, component) USING KEY (vertex) AS (SELECT DISTINCT src, src FROM e UNION (SELECT e.dst, min(r.component) FROM r JOIN e ON e.src = r.vertex JOIN recurring.r k ON k.vertex = e.dst WHERE r.component < k.component GROUP BY 1)) SELECT vertex, component FROM r")(
    lambda s, d: graph.components(e := stored_edges(_edges(s, d), "component-edges"), e.select(F.col("src").alias("vertex")))
)


@query("rmat_edges")
def _rmat(spark, sf):
    return rmat.rmat_edges(spark, 20_000, 5_000, seed=3, directed=False)


def _rmat_sql(edges: int, vertices: int, seed: int) -> str:
    bits = rmat.log2_up(vertices) - 1
    draws = [f"{portable_draw_sql(f'i * 64 + {b}', str(b + 1), str(seed))} % 1000" for b in range(bits)]
    src = " + ".join(f"CASE WHEN r{b} >= 700 THEN {1 << b} ELSE 0 END" for b in range(bits))
    dst = " + ".join(f"CASE WHEN (r{b} >= 500 AND r{b} < 700) OR r{b} >= 800 THEN {1 << b} ELSE 0 END" for b in range(bits))
    return f"WITH r AS (SELECT {', '.join(f'{x} r{b}' for b, x in enumerate(draws))} FROM (SELECT range i FROM range({edges}))), o AS (SELECT ({src})::BIGINT src, ({dst})::BIGINT dst FROM r) SELECT DISTINCT src, dst FROM (SELECT src, dst FROM o UNION ALL SELECT dst, src FROM o) WHERE src <> dst"


SQL["rmat_edges"] = _rmat_sql(20_000, 5_000, 3)

# ---------------------------------------------------------------- pairing

PAIRED = "CASE WHEN {y} >= {x} THEN {y} * ({y} + 1) + {x} ELSE {x} * {x} + {y} END"


@query("szudzik_pair", f"SELECT o_orderkey, {PAIRED.format(x='o_orderkey', y='o_custkey')} z FROM orders")
def _pair(spark, sf):
    return tables.table(spark, sf, "orders").select("o_orderkey", pair("o_orderkey", "o_custkey").alias("z"))


@query("szudzik_unpair", "SELECT z, CASE WHEN z - s * s < s THEN s ELSE z - s * s - s END x, CASE WHEN z - s * s < s THEN z - s * s ELSE s END y FROM (SELECT o_orderkey, o_orderkey z, floor(sqrt(o_orderkey))::BIGINT s FROM orders)")
def _unpair(spark, sf):
    x, y = unpair("z")
    return tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("z")).select("z", x.alias("x"), y.alias("y"))


@query("szudzik_triplet", f"SELECT a, b, c, {PAIRED.format(x='ab', y='c')} t, TRUE same FROM (SELECT l_orderkey a, l_linenumber::BIGINT b, l_suppkey c, {PAIRED.format(x='l_orderkey', y='l_linenumber::BIGINT')} ab FROM lineitem)")
def _triplet(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"), F.col("l_suppkey").alias("c"))
    x, y, z = unpair_triplet("t")
    return rows.withColumn("t", pair_triplet("a", "b", "c")).select("a", "b", "c", "t", ((x == F.col("a")) & (y == F.col("b")) & (z == F.col("c"))).alias("same"))


# ---------------------------------------------------------------- walks

@query("deepwalk_steps", f"WITH RECURSIVE {BIPARTITE}, {_w0()} SELECT {STEP_OUT} FROM w")
def deepwalk_steps(spark, sf):
    return walks.generate(tables.bipartite_edges(spark, sf), DEEP)


@query("deepwalk_broadcast", SQL["deepwalk_steps"])
def _broadcast(spark, sf):
    return strategy.generate_auto(tables.bipartite_edges(spark, sf), DEEP)


@query("deepwalk_multi_rep", f"WITH RECURSIVE {ALL}, {_adj()}, {_starts(reps=3)}, s0 AS (SELECT walk_id, 0 p0, vertex FROM st), {_walk('w', 's0', 'adj', 5, 7)} SELECT {STEP_OUT} FROM w")
def _multi_rep(spark, sf):
    return walks.generate(_edges(spark, sf), WalkConfig(walks_per_vertex=3, length=5, seed=7))


@query("deepwalk_segmented", f"WITH RECURSIVE {ALL}, {_adj()}, {_starts()}, s0 AS (SELECT walk_id, 0 p0, vertex FROM st), {_walk('w', 's0', 'adj', 8)} SELECT {STEP_OUT} FROM w")
def _segmented(spark, sf):
    return walks.generate(_edges(spark, sf), WalkConfig(length=8, segment_hops=3))


def _parity_sql() -> str:
    from driftwalk.functions.rng import ParityStream

    rows = []
    for rep in range(2):
        stream = ParityStream(rep)
        rows += [f"({rep}, {k}, {stream.draw()}::UBIGINT)" for k in range(LENGTH)]
    return f"""WITH RECURSIVE {ALL}, {_adj()}, {_starts(reps=2)}, dr(rep, k, d) AS (VALUES {', '.join(rows)}),
wp AS (SELECT walk_id, walk_id // (SELECT n FROM n) rep, 0::BIGINT pos, vertex FROM st
UNION ALL SELECT x.walk_id, x.rep, x.pos + 1, a.v FROM wp x JOIN dr ON dr.rep = x.rep AND dr.k = x.pos JOIN adj a ON a.u = x.vertex AND a.idx = (dr.d % a.deg::UBIGINT)::BIGINT WHERE x.pos < {LENGTH - 1})
SELECT walk_id, pos::INTEGER pos, vertex, coalesce(lead(vertex) OVER (PARTITION BY walk_id ORDER BY pos), vertex) "next", 0 batch FROM wp"""


@query("deepwalk_parity_rng", _parity_sql())
def _parity(spark, sf):
    return walks.generate_parity(_edges(spark, sf), WalkConfig(walks_per_vertex=2, length=LENGTH))


@query("isolated_vertex_walks", f"WITH RECURSIVE {ALL}, {_w0()} SELECT {STEP_OUT} FROM w WHERE vertex NOT IN (SELECT src FROM e)")
def _isolated(spark, sf):
    edges = _edges(spark, sf)
    return walks.generate(edges, DEEP).join(edges.select(F.col("src").alias("vertex")), "vertex", "left_anti").select(*walks.STEP_COLUMNS)


def _live0(spark, sf):
    return walks.generate(_base(spark, sf), DEEP)


query("walk_paths_text", f"WITH RECURSIVE {BASE}, {_w0()} SELECT walk_id, string_agg(vertex::VARCHAR, '>' ORDER BY pos) path_text FROM w GROUP BY 1")(lambda s, d: lookup.walk_paths(_live0(s, d)).select("walk_id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path_text")))
query("walk_string", f"WITH RECURSIVE {BASE}, {_w0()} SELECT walk_id, string_agg(vertex::VARCHAR, ' ' ORDER BY pos) || ' ' walk FROM w GROUP BY 1")(lambda s, d: lookup.walk_strings(_live0(s, d)))
query("find_next", f"WITH RECURSIVE {BASE}, {_w0()} SELECT walk_id, pos::INTEGER pos, vertex, \"next\" FROM w")(lambda s, d: lookup.find_next(x := stored(_live0(s, d), "steps"), x.select("walk_id", "pos", "vertex")))


@query("find_next_in_range", f"WITH RECURSIVE {BASE}, {_w0()} SELECT walk_id, pos::INTEGER pos, vertex, \"next\" FROM w")
def _in_range(spark, sf):
    coded = stored(lookup.coded_steps(_live0(spark, sf), LENGTH), "coded-steps")
    return lookup.find_next_in_range(coded, lookup.next_ranges(coded), coded.select("walk_id", "pos", "vertex"), LENGTH)


@query("step_encoding", f"WITH RECURSIVE {BASE}, {_w0()} SELECT walk_id, pos::INTEGER pos, \"next\", {PAIRED.format(x=f'(walk_id * {LENGTH} + pos)', y='"next"')} code, TRUE same FROM w")
def _encoding(spark, sf):
    w, p, x = decode_step("code", LENGTH)
    rows = _live0(spark, sf).select("walk_id", "pos", "next", encode_step("walk_id", "pos", "next", LENGTH).alias("code"))
    return rows.withColumn("same", (w == F.col("walk_id")) & (p == F.col("pos")) & (x == F.col("next")))


query("vertex_at_walk", f"WITH RECURSIVE {BASE}, {_w0()} SELECT walk_id, vertex FROM w WHERE pos = 4")(lambda s, d: lookup.vertex_at(_live0(s, d), 4))
query("vnext_min_max", f"WITH RECURSIVE {BASE}, {_w0()} SELECT vertex, min(\"next\") next_min, max(\"next\") next_max FROM w GROUP BY 1")(lambda s, d: lookup.next_ranges(_live0(s, d)))
query("visit_counts", f"WITH RECURSIVE {BASE}, {_w0()} SELECT vertex, count(*) visits FROM w GROUP BY 1")(lambda s, d: lookup.visit_counts(_live0(s, d)))
query("cooccurrence_pairs", f"WITH RECURSIVE {BASE}, {_w0()} SELECT x.vertex a, y.vertex b, count(*) n FROM w x JOIN w y ON x.walk_id = y.walk_id AND y.pos > x.pos AND y.pos <= x.pos + 2 GROUP BY 1, 2")(lambda s, d: lookup.cooccurrences(_live0(s, d), 2))
query("corpus_rows", f"WITH RECURSIVE {BASE}, {_w0()} SELECT 'edges' part, count(*) n FROM e UNION ALL SELECT 'steps', count(*) FROM w UNION ALL SELECT 'vertices', count(DISTINCT vertex) FROM w UNION ALL SELECT 'walks', count(DISTINCT walk_id) FROM w")(lambda s, d: metrics.corpus_rows(_base(s, d), _live0(s, d)))

# ---------------------------------------------------------------- batches

INSERTED = f"{_month('b1', 1)}, e1 AS (SELECT src, dst FROM e UNION SELECT src, dst FROM b1)"
DELETED = f"{_month('b1', 1, True)}, e1 AS (SELECT src, dst FROM e EXCEPT SELECT src, dst FROM b1)"


def _mav(number: int, live: str, batch: str, edges: str, name: str) -> str:
    return f"""{name}0 AS (SELECT walk_id, min(pos) p, arg_min(vertex, pos) vertex FROM {live} WHERE vertex IN (SELECT src FROM {batch}) GROUP BY 1),
{name} AS (SELECT {number} batch, m.walk_id, CASE WHEN m.vertex IN (SELECT src FROM {edges}) THEN p ELSE 0 END p_min, CASE WHEN m.vertex IN (SELECT src FROM {edges}) THEN m.vertex ELSE st.vertex END vertex, m.vertex NOT IN (SELECT src FROM {edges}) reset FROM {name}0 m JOIN st ON st.walk_id = m.walk_id)"""


def _updated(number: int, live: str, batch: str, edges: str, n: str, out: str) -> str:
    """mav n, adjacency, suffix and the live steps `out` after a batch."""
    return f"""{_mav(number, live, batch, edges, n)}, {_adj(edges, f'adj{number}')}, {n}s AS (SELECT walk_id, p_min p0, vertex FROM {n}), {_walk(f'{n}w', f'{n}s', f'adj{number}', batch=number)},
{out} AS (SELECT o.walk_id, o.pos, o.vertex, o."next", o.batch FROM {live} o LEFT JOIN {n} ON {n}.walk_id = o.walk_id WHERE {n}.p_min IS NULL OR o.pos < {n}.p_min UNION ALL SELECT * FROM {n}w)"""


INSERT_SQL = f"WITH RECURSIVE {BASE}, {_w0()}, {INSERTED}, {_updated(1, 'w', 'b1', 'e1', 'm', 'live')}"
DELETE_SQL = f"WITH RECURSIVE {BASE}, {_w0()}, {DELETED}, {_updated(1, 'w', 'b1', 'e1', 'm', 'live')}"
MAV_OUT = "batch::INTEGER batch, walk_id, p_min::INTEGER p_min, vertex, reset"


def _corpus(spark, sf, config: WalkConfig = DEEP):
    return updates.new_corpus(_base(spark, sf), config)


query("insert_batch_edges", f"WITH {PAIRS}, {_mirror('e', "dt < TIMESTAMP '2001-01-01'")}, {INSERTED} SELECT src, dst FROM e1")(lambda s, d: _corpus(s, d).apply(tables.month_batch(s, d, 1), update_walks=False)[0].edges)
query("insert_batch_mav", f"{INSERT_SQL} SELECT {MAV_OUT} FROM m")(lambda s, d: _corpus(s, d).apply(tables.month_batch(s, d, 1))[1])
query("insert_batch_live", f"{INSERT_SQL} SELECT {STEP_OUT} FROM live")(lambda s, d: _corpus(s, d).apply(tables.month_batch(s, d, 1))[0].live)
query("delete_batch_edges", f"WITH {PAIRS}, {_mirror('e', "dt < TIMESTAMP '2001-01-01'")}, {DELETED} SELECT src, dst FROM e1")(lambda s, d: _corpus(s, d).apply(tables.month_batch(s, d, 1, True), delete=True, update_walks=False)[0].edges)
query("delete_batch_mav_reset", f"{DELETE_SQL} SELECT {MAV_OUT} FROM m")(lambda s, d: _corpus(s, d).apply(tables.month_batch(s, d, 1, True), delete=True)[1])
query("delete_batch_live", f"{DELETE_SQL} SELECT {STEP_OUT} FROM live")(lambda s, d: _corpus(s, d).apply(tables.month_batch(s, d, 1, True), delete=True)[0].live)
LAZY = WalkConfig(length=LENGTH, merge_frequency=1000)
query("stale_triplets", f"{INSERT_SQL} SELECT {STEP_OUT.replace('walk_id', 'w.walk_id').replace('batch::INTEGER batch', 'w.batch::INTEGER batch').replace('vertex,', 'w.vertex,')} FROM w JOIN m ON m.walk_id = w.walk_id WHERE w.pos >= m.p_min")(lambda s, d: updates.stale_steps((c := _corpus(s, d, LAZY).apply(tables.month_batch(s, d, 1))[0]).steps, c.mav))
query("merge_compaction", f"{INSERT_SQL} SELECT {STEP_OUT} FROM live")(lambda s, d: updates.compact((c := _corpus(s, d, LAZY).apply(tables.month_batch(s, d, 1))[0]).steps, c.mav, 1)[0])
query("merge_partial", f"{INSERT_SQL}, x AS (SELECT w.* FROM w LEFT JOIN m ON m.walk_id = w.walk_id WHERE m.p_min IS NULL OR w.pos < m.p_min OR w.vertex NOT IN (SELECT src FROM b1) UNION ALL SELECT * FROM mw) SELECT {STEP_OUT} FROM x")(lambda s, d: updates.compact_vertices((c := _corpus(s, d, LAZY).apply(b := stored(tables.month_batch(s, d, 1), "batch"))[0]).steps, c.mav, b.select(F.col("src").alias("vertex")), 1))
query("merge_last_ranges", f"{INSERT_SQL} SELECT vertex, min(\"next\") next_min, max(\"next\") next_max FROM live GROUP BY 1")(lambda s, d: updates.compact_with_ranges((c := _corpus(s, d, LAZY).apply(tables.month_batch(s, d, 1))[0]).steps, c.mav, 1)[1])
query("merge_by_position", f"{INSERT_SQL} SELECT {STEP_OUT} FROM live")(lambda s, d: updates.compact_by_position((c := _corpus(s, d, LAZY).apply(tables.month_batch(s, d, 1))[0]).steps, c.mav, LENGTH, 1))
TWO_SQL = f"{INSERT_SQL}, {_month('b2', 2, True)}, e2 AS (SELECT src, dst FROM e1 EXCEPT SELECT src, dst FROM b2), {_updated(2, 'live', 'b2', 'e2', 'mm', 'live2')}"


def _two(spark, sf):
    return _corpus(spark, sf, LAZY).apply(tables.month_batch(spark, sf, 1))[0].apply(tables.month_batch(spark, sf, 2, True), delete=True)[0]


query("two_batches_live", f"{TWO_SQL} SELECT {STEP_OUT} FROM live2")(lambda s, d: _two(s, d).live)
query("as_of_batch", f"{INSERT_SQL} SELECT {STEP_OUT} FROM live")(lambda s, d: updates.as_of((c := _two(s, d)).steps, c.mav, 1))
query("affected_fraction", f"{INSERT_SQL} SELECT 1 batch, (SELECT count(*) FROM m) affected, (SELECT count(*) FROM st) walks, (SELECT count(*) FROM m) * 1000 // (SELECT count(*) FROM st) per_mille")(lambda s, d: updates.affected_fraction((c := _corpus(s, d)).apply(tables.month_batch(s, d, 1))[1], c.starts))

# ---------------------------------------------------------------- second order

N2V = WalkConfig(length=4, model="node2vec", p=0.5, q=2.0)


def _n2v_sql(config: WalkConfig) -> str:
    back, near, far = walks.integer_weights(config.p, config.q)
    start = portable_draw_sql("st.walk_id", "0", str(config.seed + walks.START))
    parts = [f"WITH {ALL}, {_adj()}, {_starts()}, w0 AS (SELECT st.walk_id, st.vertex cur, a.v prev FROM st LEFT JOIN adj a ON a.u = st.vertex AND a.idx = {start} % a.deg)"]
    for hop in range(1, config.length):
        weight = lambda c: f"CASE WHEN {c} = x.prev THEN {back} WHEN EXISTS (SELECT 1 FROM e WHERE e.src = x.prev AND e.dst = {c}) THEN {near} ELSE {far} END"
        if config.sampler == "exact":
            target = portable_draw_sql("walk_id", str(hop), str(config.seed + walks.CHOOSE))
            parts.append(f"c{hop} AS (SELECT x.walk_id, x.cur, x.prev, a.v, {weight('a.v')} wt FROM w{hop - 1} x JOIN adj a ON a.u = x.cur), r{hop} AS (SELECT *, sum(wt) OVER (PARTITION BY walk_id ORDER BY v ROWS UNBOUNDED PRECEDING) upto, sum(wt) OVER (PARTITION BY walk_id) total FROM c{hop}), t{hop} AS (SELECT walk_id, v FROM r{hop} WHERE upto > {target} % total AND upto - wt <= {target} % total)")
        else:
            one, two = (portable_draw_sql("x.walk_id", str(hop), str(config.seed + walks.PROPOSE + k)) for k in (0, 7))
            accept = portable_draw_sql("walk_id", str(hop), str(config.seed + walks.ACCEPT))
            parts.append(f"c{hop} AS (SELECT x.walk_id, a.v o, {weight('a.v')} ow, b.v k, {weight('b.v')} kw FROM w{hop - 1} x JOIN adj a ON a.u = x.cur AND a.idx = {one} % a.deg JOIN adj b ON b.u = x.cur AND b.idx = {two} % b.deg), t{hop} AS (SELECT walk_id, CASE WHEN kw > ow OR {accept} * ow <= kw::BIGINT * 2147483647 THEN k ELSE o END v FROM c{hop})")
        parts.append(f"w{hop} AS (SELECT x.walk_id, coalesce(t.v, x.cur) cur, CASE WHEN t.v IS NULL THEN x.prev ELSE x.cur END prev, t.v IS NOT NULL moved FROM w{hop - 1} x LEFT JOIN t{hop} t ON t.walk_id = x.walk_id)")
    union = " UNION ALL ".join(f"SELECT walk_id, {h} pos, cur vertex FROM w{h}" + (" WHERE moved" if h else "") for h in range(config.length))
    return ", ".join(parts) + f", u AS ({union}) SELECT walk_id, pos::INTEGER pos, vertex, coalesce(lead(vertex) OVER (PARTITION BY walk_id ORDER BY pos), vertex) \"next\", 0 batch FROM u"


N2V_MH = WalkConfig(length=4, model="node2vec", p=0.5, q=2.0, sampler="mh")
query("node2vec_steps", _n2v_sql(N2V))(lambda s, d: walks.generate(_edges(s, d), N2V))
query("mh_accept", _n2v_sql(N2V_MH))(lambda s, d: walks.generate(_edges(s, d), N2V_MH))


@query("node2vec_weights", f"WITH {ALL}, c AS (SELECT x.dst cur, x.src prev, count(*) n, count(z.src) near FROM e x JOIN e y ON y.src = x.dst LEFT JOIN e z ON z.src = x.src AND z.dst = y.dst GROUP BY 1, 2) SELECT cur, prev, 1 back, near, n - 1 - near far, (4 + 2 * near + (n - 1 - near))::BIGINT total FROM c")
def _weights(spark, sf):
    """Of each second-order state: candidates of each kind, and their weights' sum.

    Of cur's neighbors one is prev, `common` are prev's neighbors too, the rest lead onward.
    """
    found = triangles.edge_triangles(stored_edges(_edges(spark, sf), "weight-edges"), with_degree=True)
    back, near, far = walks.integer_weights(N2V.p, N2V.q)
    onward = F.col("degree") - 1 - F.col("common")
    return found.select(F.col("dst").alias("cur"), F.col("src").alias("prev"), F.lit(1).alias("back"), F.col("common").alias("near"), onward.alias("far"), (F.lit(back).cast("long") + near * F.col("common") + far * onward).alias("total"))


TRIALS = 8


@query("mh_weight_init", f"WITH {ALL}, {_adj()}, q AS (SELECT src prev, dst cur FROM e), t AS (SELECT range k FROM range({TRIALS})), c AS (SELECT q.prev, q.cur, k, a.v, CASE WHEN a.v = q.prev THEN 4 WHEN EXISTS (SELECT 1 FROM e z WHERE z.src = q.prev AND z.dst = a.v) THEN 2 ELSE 1 END wt FROM q, t, adj a WHERE a.u = q.cur AND a.idx = {portable_draw_sql('q.prev * 1000003 + q.cur', 'k')} % a.deg) SELECT prev, cur, arg_max(v, wt * 100 - k) \"last\" FROM c GROUP BY 1, 2")
def _weight_init(spark, sf):
    edges = stored_edges(_edges(spark, sf), "chain-edges")
    return chains.chain_starts(edges, walks.integer_weights(N2V.p, N2V.q), TRIALS)


@query("previously_sampled_vertex", f"WITH RECURSIVE {BASE}, {_w0()}, q AS (SELECT src prev, dst cur FROM e), t AS (SELECT range k FROM range({TRIALS})), c AS (SELECT q.prev, q.cur, k, a.v, CASE WHEN a.v = q.prev THEN 4 WHEN z.src IS NOT NULL THEN 2 ELSE 1 END wt FROM q, t JOIN adj a ON a.u = q.cur AND a.idx = {portable_draw_sql('q.prev * 1000003 + q.cur', 'k')} % a.deg LEFT JOIN e z ON z.src = q.prev AND z.dst = a.v), sm AS (SELECT prev, cur, arg_max(v, wt * 100 - k) \"last\" FROM c GROUP BY 1, 2) SELECT walk_id, pos::INTEGER pos, w.vertex prev, w.\"next\" cur, \"last\" FROM w LEFT JOIN sm ON sm.prev = w.vertex AND sm.cur = w.\"next\"")
def _previously(spark, sf):
    """Walkers meet the samplers of their states: what each chain has last drawn; null where the walk has ended."""
    table = walks.WalkGraph(_base(spark, sf))
    steps = stored(walks.generate(None, DEEP, graph=table).select("walk_id", "pos", F.col("vertex").alias("prev"), F.col("next").alias("cur")), "sampler-steps", packed=True)
    # A step to the vertex itself ends a walk; the others are states, and only theirs are asked for.
    asked = stored(steps.where("prev <> cur").select("prev", "cur").distinct(), "sampler-states", packed=True)
    return walks.previously_sampled(steps, chains.chain_starts(table.edges, walks.integer_weights(N2V.p, N2V.q), TRIALS, asked))


# ---------------------------------------------------------------- ordered maps and sequences

ORDERS = "o AS (SELECT o_orderkey idx, o_custkey \"value\" FROM orders)"


def _seq(spark, sf):
    return tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("value"))


def _map(spark, sf, name: str, key: str, value: str):
    return tables.table(spark, sf, name).select(F.col(key).cast("long").alias("key"), F.col(value).cast("long").alias("value"))


query("prefix_scan", f"WITH {ORDERS} SELECT idx, \"value\", coalesce(sum(\"value\") OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT \"prefix\" FROM o")(lambda s, d: ordered.prefix_sums(_seq(s, d), block=1000))
query("collect_reduce", "SELECT l_suppkey \"key\", max(l_orderkey) \"value\" FROM lineitem GROUP BY 1")(lambda s, d: ordered.collect_reduce(_map(s, d, "lineitem", "l_suppkey", "l_orderkey"), F.max("value")))
query("histogram", "SELECT l_partkey % 16 bucket, count(*) n FROM lineitem GROUP BY 1")(lambda s, d: ordered.histogram(tables.table(s, d, "lineitem"), F.col("l_partkey") % 16))
query("reduce_monoids", "SELECT sum(o_custkey)::BIGINT total, min(o_custkey) low, max(o_custkey) high, bit_xor(o_custkey) mixed, count(*) n FROM orders")(lambda s, d: tables.table(s, d, "orders").agg(F.sum("o_custkey").alias("total"), F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"), F.bit_xor("o_custkey").alias("mixed"), F.count("*").alias("n")))
query("rank_select", "WITH k AS (SELECT DISTINCT l_partkey \"key\" FROM lineitem) SELECT \"key\", row_number() OVER (ORDER BY \"key\") - 1 \"rank\" FROM k")(lambda s, d: ordered.ranks(tables.table(s, d, "lineitem").select(F.col("l_partkey").alias("key"))))
query("successor_predecessor", "SELECT (SELECT min(o_custkey) FROM orders WHERE o_custkey > 70) next_key, (SELECT max(o_custkey) FROM orders WHERE o_custkey < 70) previous_key, (SELECT max(o_custkey) FROM orders WHERE o_custkey <= 70) previous_or_eq")(
    lambda s, d: ordered.successor(k := tables.table(s, d, "orders").select(F.col("o_custkey").alias("key")), 70).select(F.col("key").alias("next_key")).join(F.broadcast(ordered.predecessor(k, 70).select(F.col("key").alias("previous_key")))).join(F.broadcast(ordered.predecessor(k, 70, True).select(F.col("key").alias("previous_or_eq"))))
)
query("key_range", "SELECT o_orderkey \"key\", o_custkey \"value\" FROM orders WHERE o_orderkey BETWEEN 100 AND 900")(lambda s, d: ordered.key_range(_map(s, d, "orders", "o_orderkey", "o_custkey"), 100, 900))
query("aug_range_sum", "SELECT sum(o_custkey)::BIGINT total FROM orders WHERE o_orderkey BETWEEN 100 AND 900")(lambda s, d: ordered.range_aggregate(_map(s, d, "orders", "o_orderkey", "o_custkey"), 100, 900, F.sum("value").alias("total")))
query("aug_select", "WITH r AS (SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey) run FROM orders) SELECT min(o_orderkey) \"key\" FROM r WHERE run > 50000")(lambda s, d: ordered.augmented_select(_map(s, d, "orders", "o_orderkey", "o_custkey"), 50000))
query("kth_smallest", "SELECT o_custkey \"value\" FROM orders ORDER BY o_custkey LIMIT 1 OFFSET 321")(lambda s, d: ordered.kth_smallest(tables.table(s, d, "orders").select(F.col("o_custkey").alias("value")), 321))
query("range_min", f"WITH {ORDERS}, q AS (SELECT range q, range * 10 low, range * 10 + 500 high FROM range(50)) SELECT q, low, high, min(\"value\") \"minimum\" FROM q JOIN o ON idx BETWEEN low AND high GROUP BY 1, 2, 3")(lambda s, d: ordered.range_minimum(_seq(s, d), s.range(50).select(F.col("id").alias("q"), (F.col("id") * 10).alias("low"), (F.col("id") * 10 + 500).alias("high")), block=64))
query("sort_dedup", "WITH k AS (SELECT DISTINCT o_custkey \"value\" FROM orders) SELECT row_number() OVER (ORDER BY \"value\") - 1 idx, \"value\" FROM k")(lambda s, d: ordered.sort_dedup(_seq(s, d)))
query("map_union", "SELECT coalesce(c.c_custkey, s.s_suppkey) \"key\", CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_nationkey ELSE c.c_nationkey END::BIGINT \"value\" FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey")(lambda s, d: ordered.map_union(_map(s, d, "customer", "c_custkey", "c_nationkey"), _map(s, d, "supplier", "s_suppkey", "s_nationkey")))
query("map_intersect", "SELECT c_custkey \"key\", (c_nationkey + s_nationkey)::BIGINT \"value\" FROM customer JOIN supplier ON c_custkey = s_suppkey")(lambda s, d: ordered.map_intersect(_map(s, d, "customer", "c_custkey", "c_nationkey"), _map(s, d, "supplier", "s_suppkey", "s_nationkey"), F.col("left") + F.col("right")))
query("map_difference", "SELECT c_custkey \"key\", c_nationkey::BIGINT \"value\" FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")(lambda s, d: ordered.map_difference(_map(s, d, "customer", "c_custkey", "c_nationkey"), _map(s, d, "supplier", "s_suppkey", "s_nationkey")))
query("multi_insert_combine", "WITH b AS (SELECT o_custkey k, sum(o_orderkey)::BIGINT v FROM orders GROUP BY 1) SELECT coalesce(k, c_custkey) \"key\", coalesce(v, c_nationkey)::BIGINT \"value\" FROM customer FULL JOIN b ON k = c_custkey")(lambda s, d: ordered.multi_insert(_map(s, d, "customer", "c_custkey", "c_nationkey"), _map(s, d, "orders", "o_custkey", "o_orderkey"), F.sum("value")))
query("pack_index", f"WITH {ORDERS} SELECT row_number() OVER (ORDER BY idx) - 1 slot, idx FROM o WHERE \"value\" % 3 = 0")(lambda s, d: ordered.pack_index(_seq(s, d).select("idx", (F.col("value") % 3 == 0).alias("flag"))))
query("quantified", f"WITH {ORDERS} SELECT bool_and(\"value\" > 5) all_of, bool_or(\"value\" > 5) any_of, NOT bool_or(\"value\" > 5) none_of, count_if(\"value\" > 5)::BIGINT \"count_if\", min(idx) FILTER (\"value\" > 5) first_index FROM o")(lambda s, d: ordered.quantified(_seq(s, d), F.col("value") > 5))
query("is_sorted", f"WITH {ORDERS}, b AS (SELECT min(y.idx) brk FROM o x JOIN o y ON y.idx = x.idx + 1 WHERE y.\"value\" < x.\"value\") SELECT brk IS NULL sorted, coalesce(brk, (SELECT count(*) FROM o)) sorted_until FROM b")(lambda s, d: ordered.is_sorted(_seq(s, d)))
query("unique_runs", f"WITH {ORDERS}, x AS (SELECT idx, \"value\" % 4 \"value\" FROM o), r AS (SELECT *, lag(\"value\") OVER (ORDER BY idx) p FROM x) SELECT idx, \"value\" FROM r WHERE p IS DISTINCT FROM \"value\"")(lambda s, d: ordered.unique_runs(_seq(s, d).select("idx", (F.col("value") % 4).alias("value"))))
query("split_two", f"WITH {ORDERS} SELECT idx, \"value\", 1 part FROM o WHERE \"value\" % 2 = 1 UNION ALL SELECT idx, \"value\", 0 FROM o WHERE \"value\" % 2 = 0")(lambda s, d: (x := ordered.split_two(_seq(s, d), F.col("value") % 2 == 1))[1].withColumn("part", F.lit(1)).unionByName(x[0].withColumn("part", F.lit(0))))
query("rotate_reverse_append", f"WITH {ORDERS}, k AS (SELECT count(*) n FROM o) SELECT n - 1 - (idx + n - 7) % n idx, \"value\" FROM o, k UNION ALL SELECT idx + n, \"value\" FROM o, k")(lambda s, d: ordered.append(ordered.reverse(ordered.rotate(x := _seq(s, d), 7, n := x.count()), n), x, n))
query("tokenize_word_counts", "WITH w AS (SELECT unnest(string_split_regex(text, '[\\s\\x00]+')) word FROM documents) SELECT word, count(*) n FROM w WHERE word <> '' GROUP BY 1")(lambda s, d: graph_files.word_counts(tables.table(s, d, "documents"), "text"))
query("top_k", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25")(lambda s, d: tables.table(s, d, "orders").select("o_orderkey", "o_custkey").orderBy(F.desc("o_custkey"), "o_orderkey").limit(25))
query("random_shuffle", f"WITH {ORDERS} SELECT row_number() OVER (ORDER BY {portable_draw_sql('idx', '0', '5')}, idx) - 1 idx, \"value\" FROM o")(lambda s, d: ordered.shuffled(_seq(s, d), 5))

query("reverse_scan", f"WITH {ORDERS} SELECT idx, \"value\", coalesce(sum(\"value\") OVER (ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT \"prefix\" FROM o")(lambda s, d: ordered.prefix_sums(_seq(s, d), block=1000, backward=True))
query("sort_values", f"WITH {ORDERS} SELECT row_number() OVER (ORDER BY \"value\", idx) - 1 idx, \"value\" FROM o")(lambda s, d: ordered.sort_values(_seq(s, d)))
query("merge_sorted", f"WITH u AS (SELECT o_custkey \"value\", 0 side FROM orders UNION ALL SELECT c_nationkey::BIGINT, 1 FROM customer) SELECT row_number() OVER (ORDER BY \"value\", side) - 1 idx, \"value\" FROM u")(
    lambda s, d: ordered.merge_sorted(stored(ordered.sort_values(_seq(s, d)), "sorted"), stored(ordered.sort_values(tables.table(s, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").cast("long").alias("value"))), "sorted"))
)
query("split_three", f"WITH {ORDERS} SELECT idx, \"value\", (\"value\" % 3)::INTEGER part FROM o")(lambda s, d: reduce(DataFrame.unionByName, (x.withColumn("part", F.lit(k)) for k, x in enumerate(ordered.split_three(_seq(s, d), F.col("value") % 3)))))
query("map_filter", f"WITH {ORDERS} SELECT idx, \"value\" * 2 \"value\" FROM o WHERE \"value\" % 5 = 0")(lambda s, d: ordered.map_filter(_seq(s, d), F.when(F.col("value") % 5 == 0, F.col("value") * 2)))
query("search_sequence", f"WITH {ORDERS}, x AS (SELECT idx, \"value\" % 3 v FROM o) SELECT min(a.idx) first_index, max(a.idx) last_index FROM x a JOIN x b ON b.idx = a.idx + 1 JOIN x c ON c.idx = a.idx + 2 WHERE a.v = 1 AND b.v = 2 AND c.v = 1")(lambda s, d: ordered.search(_seq(s, d).select("idx", (F.col("value") % 3).alias("value")), [1, 2, 1]))
query("adjacent_find", f"WITH {ORDERS} SELECT min(a.idx) first_index FROM o a JOIN o b ON b.idx = a.idx + 1 WHERE a.\"value\" % 50 = b.\"value\" % 50")(lambda s, d: ordered.adjacent_find(_seq(s, d).select("idx", (F.col("value") % 50).alias("value"))))
query("compare_sequences", f"WITH {ORDERS}, k AS (SELECT min(idx) m FROM o WHERE idx >= 700 AND \"value\" % 7 <> \"value\" % 8) SELECT m mismatch, m IS NULL equal, coalesce((SELECT \"value\" % 7 < \"value\" % 8 FROM o WHERE idx = m), FALSE) less FROM k")(lambda s, d: ordered.compare(x := _seq(s, d).select("idx", (F.col("value") % 7).alias("value")), _seq(s, d).select("idx", F.when(F.col("idx") < 700, F.col("value") % 7).otherwise(F.col("value") % 8).alias("value"))))
query("is_partitioned", f"WITH {ORDERS} SELECT 'by index' \"name\", coalesce(max(idx) FILTER (idx < 900) < min(idx) FILTER (idx >= 900), TRUE) partitioned FROM o UNION ALL SELECT 'by value', coalesce(max(idx) FILTER (\"value\" > 9) < min(idx) FILTER (\"value\" <= 9), TRUE) FROM o")(lambda s, d: ordered.is_partitioned(_seq(s, d), F.col("idx") < 900).select(F.lit("by index").alias("name"), "partitioned").unionByName(ordered.is_partitioned(_seq(s, d), F.col("value") > 9).select(F.lit("by value").alias("name"), "partitioned")))
query("extreme_positions", f"WITH {ORDERS} SELECT arg_min(idx, \"value\" * 1000000 + idx) min_index, min(\"value\") min_value, arg_max(idx, \"value\" * 1000000 - idx) max_index, max(\"value\") max_value FROM o")(lambda s, d: ordered.extreme_positions(_seq(s, d)))
query("augmented_filter", "SELECT o_orderkey \"key\", o_custkey \"value\" FROM orders WHERE o_custkey > 20")(lambda s, d: ordered.augmented_filter(_map(s, d, "orders", "o_orderkey", "o_custkey"), 20))
query("approximate_kth")(lambda s, d: ordered.approximate_kth(tables.table(s, d, "orders").select(F.col("o_custkey").alias("value")), 321))
query("suffix_array", "WITH x AS (SELECT p_partkey id, i pos, substr(p_name, i + 1) s FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) i FROM part)), r AS (SELECT id, pos, s, row_number() OVER w - 1 \"rank\", lag(s) OVER w p FROM x WINDOW w AS (PARTITION BY id ORDER BY s)) SELECT id, \"rank\", pos, coalesce(list_max(list_filter(range(0, least(length(s), length(p)) + 1), lambda l: left(s, l) = left(p, l))), 0) lcp FROM r")(lambda s, d: suffixes.suffix_array(tables.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))))
query("count_neighbors", f"WITH {ALL} SELECT src vertex, count_if(dst % 3 = 1)::BIGINT n FROM e GROUP BY 1")(lambda s, d: graph.count_neighbors(_edges(s, d), F.col("dst") % 3 == 1))
query("check_edges", f"WITH {PAIRS} SELECT 'missing end' \"check\", count(*) FILTER (a IS NULL OR b IS NULL) violations FROM pr UNION ALL SELECT 'negative id', count(*) FILTER (least(a, b) < 0) FROM pr UNION ALL SELECT 'self-loop', count(*) FILTER (a = b) FROM pr UNION ALL SELECT 'repeated edge', count(*) FROM (SELECT 1 FROM pr GROUP BY a, b HAVING count(*) > 1) UNION ALL SELECT 'missing mirror', count(*) FROM pr WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.a = pr.b AND q.b = pr.a)")(lambda s, d: graph.check_edges(stored(tables.tripartite_pairs(s, d).select(F.col("a").alias("src"), F.col("b").alias("dst")), "checked-edges")))

# ---------------------------------------------------------------- files, streams, learning


@query("adjacency_text_roundtrip", f"WITH {ALL} SELECT src, dst FROM e")
def _text_roundtrip(spark, sf):
    edges, at = stored_edges(_edges(spark, sf), "text-edges"), folder(spark, "adjacency")
    graph_files.write_adjacency_text(edges, edges.agg(F.max("src")).first()[0] + 1, at)
    return graph_files.load_graph(spark, at, "adjacency_text")


@query("byte_graph_roundtrip", f"WITH {ALL} SELECT src, dst FROM e")
def _bytes_roundtrip(spark, sf):
    at = folder(spark, "byte-graph")
    graph_files.write_byte_files(stored_edges(_edges(spark, sf), "byte-edges"), at)
    return graph_files.load_graph(spark, at, "bytes")


LATER = "dt >= TIMESTAMP '2001-01-01'"
#: Order lines of January 2001 are inserted with the rest of the year; what was returned in February is deleted in the second batch.
query("streaming_foreach_batch", f"WITH {PAIRS}, {_mirror('e', "dt < TIMESTAMP '2001-01-01'")}, {_mirror('b1', LATER)} SELECT src, dst FROM e UNION SELECT src, dst FROM b1")(lambda s, d: _streamed(s, d, [(LATER, "insert")]).edges)
query("streaming_mixed_batches", f"WITH {PAIRS}, {_mirror('e', "dt < TIMESTAMP '2001-01-01'")}, {_month('b1', 1)}, {_month('b2', 2)}, {_month('b3', 1, True)} (SELECT src, dst FROM e UNION SELECT src, dst FROM b1 UNION SELECT src, dst FROM b2) EXCEPT SELECT src, dst FROM b3")(lambda s, d: _streamed(s, d, [_MONTH(1), ("rf = 'R' AND " + _MONTH(1)[0], "delete"), _MONTH(2)], 2).edges)
query("streamed_corpus_check", "SELECT * FROM (VALUES ('gap in a walk', 0::BIGINT), ('next is not the next vertex', 0), ('repeated position', 0), ('step without an edge', 0), ('walk doesn''t begin at its start', 0), ('walk ends at a vertex with edges', 0)) t(\"check\", violations)")(lambda s, d: updates.check_corpus(_streamed(s, d, [_MONTH(1), ("rf = 'R' AND " + _MONTH(2)[0], "delete")], 2)))


def _MONTH(month: int) -> tuple[str, str]:
    return f"dt >= TIMESTAMP '2001-{month:02d}-01' AND dt < TIMESTAMP '2001-{month + 1:02d}-01'", "insert"


def _streamed(spark, sf, parts, files: int = 1):
    """A stream of `files` edge files through foreachBatch into a stored corpus; the corpus after the last.

    parts: (condition on dt and rf, op). With two files the first part comes first, all others in the second file.
    """
    from driftwalk.streaming.runner import CorpusStore, run_stream

    at, config = folder(spark, "stream"), WalkConfig(length=3)
    store = CorpusStore(spark, f"{at}/store", config)
    store.write(updates.new_corpus(_base(spark, sf), config), 0)
    pairs = tables.tripartite_pairs(spark, sf).withColumnsRenamed({"at": "dt", "flag": "rf"})
    for k in range(files):
        mine = [p for i, p in enumerate(parts) if min(i, files - 1) == k]
        rows = [tables.mirrored(pairs.where(where)).withColumn("op", F.lit(op)) for where, op in mine]
        reduce(DataFrame.unionByName, rows).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema("src long, dst long, op string").parquet(f"{at}/in")
    run_stream(stream, store, f"{at}/checkpoint").awaitTermination()
    return store.read(store.last())


query("event_window_sliding", "WITH r AS (SELECT ts, user_id src, user_id * 7 % 10 dst FROM events), x AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR window_start, src, dst FROM r, range(4) t(k)) SELECT window_start, src, dst, count(*) n FROM x GROUP BY 1, 2, 3")(lambda s, d: _windows(s, d, lambda e, f: f.windowed_edges(e, "1 day", "1 hour", "6 hours")))
query("event_sessions", "WITH r AS (SELECT ts, user_id src, user_id * 7 % 10 dst FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END new FROM r WINDOW w AS (PARTITION BY src, dst ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY src, dst ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT min(ts) session_start, max(ts) + INTERVAL 2 HOUR session_end, src, dst, count(*) n FROM i GROUP BY src, dst, k")(lambda s, d: _windows(s, d, lambda e, f: f.session_edges(e, "2 hours", "1 hour")))


def _windows(spark, sf, how):
    from driftwalk.streaming import runner

    return how(tables.table(spark, sf, "events").selectExpr("ts", "user_id AS src", "user_id * 7 % 10 AS dst"), runner)


@query("event_window_edges", "WITH r AS (SELECT ts, user_id src, user_id * 7 % 10 dst FROM events) SELECT time_bucket(INTERVAL 1 DAY, ts) window_start, src, dst, count(*) n FROM r GROUP BY 1, 2, 3")
def _windowed(spark, sf):
    from driftwalk.streaming.runner import windowed_edges

    return windowed_edges(tables.table(spark, sf, "events").selectExpr("ts", "user_id AS src", "user_id * 7 % 10 AS dst"), "1 day", "1 hour")


@query("word2vec_embeddings")
def _vectors(spark, sf):
    paths = lookup.walk_paths(walks.generate(_edges(spark, sf), WalkConfig(length=8))).where("size(path) > 1")
    return embeddings.word2vec(paths, dim=8)


@query("vertex_classification")
def _classified(spark, sf):
    paths = lookup.walk_paths(walks.generate(_edges(spark, sf), WalkConfig(length=8))).where("size(path) > 1")
    vectors = embeddings.word2vec(paths, dim=8)
    return embeddings.accuracy(embeddings.classify(vectors, vectors.select("vertex", (F.col("vertex") % 3).alias("label"))))


@query("xxhash_walk_draws")
def _hashed(spark, sf):
    return walks.id_domain(_edges(spark, sf)).select("vertex", hashed_draw("vertex", 1, 42).alias("draw"))


@query("corpus_size_bytes")
def _bytes(spark, sf):
    """Of each part of a corpus after a batch, as a store keeps it."""
    from driftwalk.streaming.runner import CorpusStore

    at = folder(spark, "size")
    CorpusStore(spark, at, DEEP).write(_corpus(spark, sf).apply(tables.month_batch(spark, sf, 1))[0], 1)
    return metrics.stored_bytes(spark, at)
