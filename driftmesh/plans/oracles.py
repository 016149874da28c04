"""DuckDB SQL with the rows of the named queries."""

from __future__ import annotations

_HOUR = "date_diff('hour', TIMESTAMP '2024-01-01', ts)"
_E = f"""e AS (
  SELECT (dense_rank() OVER (ORDER BY user_id) - 1)::BIGINT AS trajectory_idx, user_id AS trajectory_id,
         (row_number() OVER (PARTITION BY user_id ORDER BY {_HOUR}, event_id) - 1)::BIGINT AS seq,
         floor(value)::BIGINT AS x, (props::JSON->>'k')::BIGINT AS y, {_HOUR}::BIGINT AS t, event_id AS ord
  FROM events)"""
_ORDERS = """e AS (
  SELECT (dense_rank() OVER (ORDER BY o_custkey) - 1)::BIGINT AS trajectory_idx,
         (row_number() OVER (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1995-01-01', o_orderdate::DATE), o_orderkey) - 1)::BIGINT AS seq,
         floor(o_totalprice / 1000)::BIGINT AS x, substr(o_orderpriority, 1, 1)::BIGINT AS y,
         date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS t
  FROM orders)"""


def _corner(column: str, bits: int, add: int = 0) -> str:
    side = 1 << bits
    return f"(floor(({column} + {add}) / {side}.0) * {side})::BIGINT"


def _rolled(x: int, y: int, t: int, shifted: bool = False) -> str:
    add = [(1 << (b - 1)) if shifted and b >= 2 else 0 for b in (x, y, t)]
    parts = ", ".join(f"{_corner(c, b, a)} AS {c}" for c, b, a in zip("xyt", (x, y, t), add, strict=True))
    return f"SELECT trajectory_idx, seq, {parts} FROM e"


def _visits(x: int, y: int, t: int) -> str:
    return f"""{_E}, c AS ({_rolled(x, y, t)}), dict AS (
  SELECT (row_number() OVER (ORDER BY x, y, t) - 1)::BIGINT AS item_id, x, y, t FROM (SELECT DISTINCT x, y, t FROM c)
), n AS (
  SELECT DISTINCT c.trajectory_idx, dict.item_id FROM c JOIN dict ON c.x = dict.x AND c.y = dict.y AND c.t = dict.t
)"""


_C = f"{_E}, c AS ({_rolled(5, 5, 5)})"
_N = _visits(5, 5, 5)


def _itemsets(least: str) -> str:
    """CTEs from n to s: items as a list, n_items, support, of up to four items."""
    made = [f"k AS (SELECT {least} AS least FROM n)", "f1 AS (SELECT item_id AS i1, count(*)::BIGINT AS support FROM n GROUP BY 1 HAVING count(*) >= (SELECT least FROM k))"]
    made.append("p AS (SELECT n.trajectory_idx, n.item_id FROM n JOIN f1 ON n.item_id = f1.i1)")
    made.append("b1 AS (SELECT trajectory_idx, item_id AS i1 FROM p)")
    for size in (2, 3, 4):
        held = ", ".join(f"b.i{i}" for i in range(1, size))
        keys = ", ".join(f"i{i}" for i in range(1, size + 1))
        same = " AND ".join(f"b.i{i} = f{size}.i{i}" for i in range(1, size + 1))
        made.append(f"c{size} AS (SELECT b.trajectory_idx, {held}, p.item_id AS i{size} FROM b{size - 1} b JOIN p ON b.trajectory_idx = p.trajectory_idx AND p.item_id > b.i{size - 1})")
        made.append(f"f{size} AS (SELECT {keys}, count(*)::BIGINT AS support FROM c{size} GROUP BY ALL HAVING count(*) >= (SELECT least FROM k))")
        made.append(f"b{size} AS (SELECT b.* FROM c{size} b JOIN f{size} ON {same})")
    rows = [f"SELECT [{', '.join(f'i{i}' for i in range(1, size + 1))}] AS items, {size}::BIGINT AS n_items, support FROM f{size}" for size in (1, 2, 3, 4)]
    made.append(f"s AS (SELECT (row_number() OVER (ORDER BY n_items, items) - 1)::BIGINT AS itemset_id, * FROM ({' UNION ALL '.join(rows)}))")
    return ", ".join(made)


_S = f"{_N}, {_itemsets('greatest(4, ceil(count(DISTINCT trajectory_idx) / 10.0))::BIGINT')}"
_FINER = f"{_visits(2, 2, 2)}, {_itemsets('any_value(2::BIGINT)')}"
_FINE = f"{_visits(2, 3, 2)}, {_itemsets('any_value(2::BIGINT)')}"
_B = f"""n AS (
  SELECT DISTINCT l_orderkey AS trajectory_idx, unnest([n_nationkey::BIGINT, n_regionkey::BIGINT + 100]) AS item_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), {_itemsets('ceil(count(DISTINCT trajectory_idx) / 10.0)::BIGINT')}"""


def _cliques(length: int, sets: str = _S) -> str:
    return f"""{sets}, w AS (SELECT itemset_id, n_items, unnest(items) AS item_id FROM s WHERE n_items >= {length}), cl AS (
  SELECT w.itemset_id, n.trajectory_idx FROM w JOIN n ON w.item_id = n.item_id
  GROUP BY w.itemset_id, w.n_items, n.trajectory_idx HAVING count(*) = w.n_items
)"""


def _weights(length: int, sets: str = _S) -> str:
    return f"""{_cliques(length, sets)}, sz AS (SELECT trajectory_idx, count(*) AS n FROM n GROUP BY 1), al AS (
  SELECT a.itemset_id, a.trajectory_idx AS t1, b.trajectory_idx AS t2, (2 * s.n_items)::DOUBLE / (z1.n + z2.n)::DOUBLE AS w
  FROM cl a JOIN cl b ON a.itemset_id = b.itemset_id JOIN s ON s.itemset_id = a.itemset_id
  JOIN sz z1 ON z1.trajectory_idx = a.trajectory_idx JOIN sz z2 ON z2.trajectory_idx = b.trajectory_idx
)"""


def _closed(ctes: str) -> str:
    """The CTEs with s as the closed itemsets only."""
    closed = "s AS (SELECT * FROM every a WHERE NOT EXISTS (SELECT 1 FROM every b WHERE b.n_items = a.n_items + 1 AND b.support = a.support AND list_has_all(b.items, a.items)))"
    return ctes.replace(", s AS (", ", every AS (", 1).replace(", w AS (", f", {closed}, w AS (", 1)


def _components(edges: str, nodes: str) -> str:
    """CTEs ed, no, rc and comp (node, component)."""
    return f"""ed AS ({edges}), no AS ({nodes}), rc(node, label) AS (
  SELECT node, node FROM no UNION SELECT ed.dst, rc.label FROM rc JOIN ed ON ed.src = rc.node
), comp AS (SELECT node, min(label) AS component FROM rc GROUP BY node)"""


def _overlap(above: float, weights: str) -> str:
    edges = f"SELECT DISTINCT t1 AS src, t2 AS dst FROM al WHERE w > {above} AND t1 <> t2"
    return f"{weights}, {_components(edges, 'SELECT DISTINCT src AS node FROM ed')}"


_SHARED = "SELECT DISTINCT a.trajectory_idx AS src, b.trajectory_idx AS dst FROM cl a JOIN cl b ON a.itemset_id = b.itemset_id"
_MEMBERS = "SELECT DISTINCT trajectory_idx AS node FROM cl"
_CC3 = f"{_cliques(3)}, {_components(_SHARED, _MEMBERS)}"
_CC = f"{_cliques(2, _FINE)}, {_components(_SHARED, _MEMBERS)}"
_LIST = "cq AS (SELECT itemset_id, any_value(n_items)::DOUBLE AS len, list(trajectory_idx ORDER BY trajectory_idx) AS m FROM cl JOIN s USING (itemset_id) GROUP BY itemset_id)"


def _linked(edges: str, weights: str, thresholds: list[float]) -> str:
    """Groups merged step by step over the whole list, the pair of most weight first, for each threshold; the union keeps the first's id."""
    parts = []
    for k, threshold in enumerate(thresholds):
        parts.append(f"""z{k}(step, gs, ids) AS (
  SELECT 0, list(m ORDER BY itemset_id), list(itemset_id ORDER BY itemset_id) FROM cq
  UNION ALL
  (WITH cur AS (SELECT * FROM z{k}), mem AS (SELECT i, gs[i] AS g, unnest(gs[i]) AS a FROM (SELECT gs, unnest(range(1, len(gs) + 1)) AS i FROM cur)),
   tot AS (SELECT x.i, y.i AS j, x.a, any_value(len(x.g)) AS nx, any_value(len(y.g)) AS ny, sum(edge.w) AS s
           FROM mem x JOIN edge ON edge.t1 = x.a JOIN mem y ON y.a = edge.t2 AND y.i <> x.i GROUP BY x.i, y.i, x.a),
   fit AS (SELECT i, j, sum(s) AS part FROM tot WHERE s / ny >= {threshold} GROUP BY i, j HAVING count(*) = any_value(nx)),
   best AS (SELECT p.i, p.j, round(p.part + q.part, 9) AS strength FROM fit p JOIN fit q ON p.i = q.j AND p.j = q.i WHERE p.i < p.j AND p.part + q.part > 0 ORDER BY strength DESC, p.i, p.j LIMIT 1)
   SELECT step + 1, list_concat([gs[k] for k in range(1, len(gs) + 1) if k <> i AND k <> j], [list_sort(list_distinct(list_concat(gs[i], gs[j])))]),
          list_concat([ids[k] for k in range(1, len(gs) + 1) if k <> i AND k <> j], [ids[i]]) FROM cur, best))""")
    last = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, gs, ids FROM (SELECT gs, ids FROM z{k} ORDER BY step DESC LIMIT 1)" for k, t in enumerate(thresholds))
    rows = f"SELECT threshold, ids[i] AS group_id, unnest(gs[i]) AS trajectory_idx FROM (SELECT threshold, gs, ids, unnest(range(1, len(gs) + 1)) AS i FROM ({last}))"
    return f"WITH RECURSIVE {weights}, {_LIST}, edge AS ({edges}), {', '.join(parts)} {rows}"


def _attached(name: str, threshold: float, by_id: bool = False) -> str:
    """CTE ``name`` (step, gs, ...) of groups merged while each shares enough with the other.

    A group is (n, m, slot, id): its name, members, where its value stands, and the itemset it grew from. A pair's
    strength is that of the step it was made in.
    """
    value = "vals[{g}.slot]" if by_id else "vals[{k}]"
    pair = lambda g, k, h, l: f"({value.format(g=g, k=k)} + {value.format(g=h, k=l)}) / 2"  # noqa: E731, E741
    shared = lambda g, h: f"len(list_intersect({g}.m, {h}.m))::DOUBLE"
    near = lambda g, h: f"{shared(g, h)} / len({g}.m) >= {threshold} AND {shared(g, h)} / len({h}.m) >= {threshold}"
    return f"""{name}0 AS (
  SELECT list(struct_pack(n := k, m := m, slot := k, id := itemset_id) ORDER BY k) AS gs, list(len ORDER BY k) AS vals FROM (SELECT row_number() OVER (ORDER BY itemset_id) AS k, m, len, itemset_id FROM cq)
), {name}(step, gs, vals, pairs) AS (
  SELECT 0, gs, vals, (SELECT coalesce(list(struct_pack(a := i, b := j, s := {pair('gs[i]', 'i', 'gs[j]', 'j')})), []) FROM (SELECT gs, vals, i, unnest(range(i + 1, len(gs) + 1)) AS j FROM (SELECT gs, vals, unnest(range(1, len(gs) + 1)) AS i FROM {name}0)) WHERE {near('gs[i]', 'gs[j]')})
  FROM {name}0
  UNION ALL
  (WITH cur AS (SELECT * FROM {name}), best AS (SELECT p.a, p.b, p.s FROM (SELECT unnest(pairs) AS p FROM cur) WHERE p.s > 0 ORDER BY p.s DESC, p.a, p.b LIMIT 1),
   joined AS (SELECT step, vals, a, b, s, [p for p in pairs if p.a <> a AND p.b <> b AND p.a <> b AND p.b <> a] AS old, [g for g in gs if g.n <> a AND g.n <> b] AS rest,
                     [g for g in gs if g.n = a][1] AS ga, [g for g in gs if g.n = b][1] AS gb, [g.n for g in gs][len(gs)] + 1 AS name FROM cur, best),
   made AS (SELECT *, struct_pack(n := name, m := list_sort(list_distinct(list_concat(ga.m, gb.m))), slot := ga.slot, id := ga.id) AS g FROM joined),
   new AS (SELECT list(struct_pack(a := h.n, b := name, s := {pair('h', 'k', 'g', 'len(rest) + 1')})) AS fresh FROM (SELECT made.*, rest[k] AS h, k FROM made, (SELECT unnest(range(1, len(rest) + 1)) AS k FROM made)) WHERE {near('h', 'g')})
   SELECT step + 1, list_concat(rest, [g]), [CASE WHEN k = ga.slot THEN s ELSE vals[k] END for k in range(1, len(vals) + 1)], list_concat(old, coalesce(fresh, [])) FROM made, new))"""


def _attachment(thresholds: list[float], by_id: bool = False) -> str:
    ctes = ", ".join(_attached(f"z{k}", t, by_id) for k, t in enumerate(thresholds))
    last = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, gs FROM (SELECT gs FROM z{k} ORDER BY step DESC LIMIT 1)" for k, t in enumerate(thresholds))
    rows = f"SELECT threshold, gs[i].id AS group_id, unnest(gs[i].m) AS trajectory_idx FROM (SELECT threshold, gs, unnest(range(1, len(gs) + 1)) AS i FROM ({last}))"
    return f"WITH RECURSIVE {_cliques(2, _FINE)}, {_LIST}, {ctes} {rows}"


def _directed(above: float, attach: float) -> str:
    """Attachment groups and overlap edges, merged along edges from earlier groups to later ones."""
    return f"""WITH RECURSIVE {_weights(2, _FINE)}, {_LIST}, {_attached('z', attach)}, held AS (
  SELECT gs[i].m AS m FROM (SELECT gs, unnest(range(1, len(gs) + 1)) AS i FROM (SELECT gs FROM z ORDER BY step DESC LIMIT 1))
), edge AS (
  SELECT t1, t2 FROM al WHERE w > {above} AND t1 <> t2
  UNION SELECT a, b FROM (SELECT m, unnest(m) AS a FROM held), LATERAL (SELECT unnest(m) AS b) WHERE a < b
), y(step, gs, ids) AS (
  SELECT 0, list([node] ORDER BY node), list(node ORDER BY node) FROM ({_MEMBERS})
  UNION ALL
  (WITH cur AS (SELECT * FROM y), mem AS (SELECT i, unnest(gs[i]) AS a FROM (SELECT gs, unnest(range(1, len(gs) + 1)) AS i FROM cur)),
   best AS (SELECT x.i, w.i AS j FROM mem x JOIN edge ON edge.t1 = x.a JOIN mem w ON w.a = edge.t2 AND w.i > x.i ORDER BY x.i, x.a, w.i LIMIT 1)
   SELECT step + 1, list_concat([gs[k] for k in range(1, len(gs) + 1) if k <> i AND k <> j], [list_sort(list_concat(gs[i], gs[j]))]),
          list_concat([ids[k] for k in range(1, len(gs) + 1) if k <> i AND k <> j], [ids[i]]) FROM cur, best)
), done AS (SELECT gs, ids FROM y ORDER BY step DESC LIMIT 1)
SELECT ids[i] AS group_id, unnest(gs[i]) AS trajectory_idx FROM (SELECT gs, ids, unnest(range(1, len(gs) + 1)) AS i FROM done) WHERE len(gs[i]) > 1"""


def _gaps(source: str) -> str:
    line = "({p} + trunc(i * (({c} - {p})::DOUBLE / gap::DOUBLE))::BIGINT)"
    on = lambda c: f"CASE WHEN i >= coalesce(gap, 1) - 1 THEN {c} ELSE {line.format(p='p' + c, c=c)} END"
    return f"""{source}, g AS (
  SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(t) OVER o AS pt, t - lag(t) OVER o AS gap
  FROM e WINDOW o AS (PARTITION BY trajectory_idx ORDER BY t, seq)
), u AS (SELECT g.*, unnest(range(0, greatest(coalesce(gap, 1), 1))) AS i FROM g), fi AS (
  SELECT trajectory_idx, seq AS oseq, {on('x')} AS x, {on('y')} AS y, CASE WHEN i >= coalesce(gap, 1) - 1 THEN t ELSE pt + i + 1 END AS t FROM u
), path AS (
  SELECT trajectory_idx, (row_number() OVER (PARTITION BY trajectory_idx ORDER BY t, oseq) - 1)::BIGINT AS seq, x::BIGINT AS x, y::BIGINT AS y, t::BIGINT AS t FROM fi
)"""


_TICKS = f"""{_E}, r AS (
  SELECT t, (row_number() OVER (ORDER BY t) - 1)::BIGINT AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM e)
), sl AS (
  SELECT unnest(range(greatest(0, ceil((rank - 47) / 36.0))::BIGINT, least(floor(rank / 36.0), ceil(n / 36.0) - 1)::BIGINT + 1)) AS slice_id, t FROM r
)"""


def _pixel(column: str, top: int, bottom: int, pixels: int) -> str:
    cut = f"trunc(({column} - {top})::DOUBLE / ({bottom - top}::DOUBLE / {pixels}))"
    return f"(sign({cut}) * floor(abs({cut}) / 4) * 4)::BIGINT"


_VIEW = f"{_E}, v AS (SELECT *, px >= 0 AND px < 400 AND py >= 0 AND py < 300 AS in_view FROM (SELECT e.*, {_pixel('x', 0, 150, 400)} AS px, {_pixel('y', 10, 90, 300)} AS py FROM e))"
_LISTS = """SELECT (a.i * 4 + b.i * 2 + c.i)::BIGINT AS set_id, a.v AS space, b.v AS time, c.v AS support
FROM (VALUES (0, '3'), (1, '5'), (2, '9')) a(i, v), (VALUES (0, '2'), (1, '10')) b(i, v), (VALUES (0, '4'), (1, '15')) c(i, v)"""
_BITS = ", ".join(f"length(bin(max({c})))::BIGINT * (max({c}) > 0)::BIGINT AS l{c}" for c in "xyt")
_BOUNDS = ", ".join(f"{f}({c}) AS {f}_{c}" for c in "xyt" for f in ("min", "max"))
_ROW = "trajectory_idx, seq, x, y, t"
_JOIN = "array_to_string(items, ',')"
_MORTON = " + ".join(f"((x >> {b}) & 1) * {1 << (2 * b)} + ((y >> {b}) & 1) * {1 << (2 * b + 1)}" for b in range(10))

_TOP = "SELECT component AS group_id, count(*) AS n_members FROM comp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT"

_STAR = """SELECT cl.trajectory_idx AS src, c.hub AS dst FROM cl JOIN (SELECT itemset_id, min(trajectory_idx) AS hub FROM cl GROUP BY 1) c USING (itemset_id)
  UNION SELECT c.hub, cl.trajectory_idx FROM cl JOIN (SELECT itemset_id, min(trajectory_idx) AS hub FROM cl GROUP BY 1) c USING (itemset_id)"""
_TENTH = "greatest(4, ceil(count(DISTINCT trajectory_idx) / 10.0))::BIGINT"


def _counted(columns: str, level: tuple[int, int, int], least: str, length: int, counts: str, of: str = "comp") -> str:
    """One row: ``columns``, and ``counts`` over the components of the cliques at a level, or ``of`` what is made of them."""
    return f"""SELECT {columns}, c.* FROM (WITH RECURSIVE {_cliques(length, f"{_visits(*level)}, {_itemsets(least)}")}, {_components(_STAR, _MEMBERS)} SELECT {counts} FROM {of}) c"""


_SIZES = "(SELECT component, count(*) AS m FROM comp GROUP BY component)"
_GROUPS = "count(DISTINCT component)::BIGINT AS n_groups"

_DRAWN = f"""WITH RECURSIVE {_CC}, pt AS (
  SELECT trajectory_idx, seq, floor(x * (300.0::DOUBLE / 1024))::BIGINT AS ux, floor(300.0::DOUBLE - y * (300.0::DOUBLE / 1024))::BIGINT AS uy FROM e
), ln AS (
  SELECT *, coalesce(lag(ux) OVER o, ux) AS ax, coalesce(lag(uy) OVER o, uy) AS ay FROM pt WINDOW o AS (PARTITION BY trajectory_idx ORDER BY seq)
), sp AS (
  SELECT *, greatest(abs(ux - ax), abs(uy - ay)) AS n, unnest(range(0, greatest(abs(ux - ax), abs(uy - ay)) + 1)) AS k FROM ln
), st AS (
  SELECT DISTINCT trajectory_idx, (ax + floor((2 * k * (ux - ax) + n) / (2.0::DOUBLE * greatest(n, 1))))::BIGINT AS px, (ay + floor((2 * k * (uy - ay) + n) / (2.0::DOUBLE * greatest(n, 1))))::BIGINT AS py FROM sp
), res AS (
  SELECT DISTINCT 0::BIGINT AS set_id, trajectory_idx % 5 AS group_id, trajectory_idx FROM e
  UNION ALL SELECT 1, component, node FROM comp
  UNION ALL SELECT 2, (dense_rank() OVER (ORDER BY itemset_id) - 1)::BIGINT, trajectory_idx FROM cl
), rk AS (
  SELECT set_id, group_id, n, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, group_id) AS rank FROM (SELECT set_id, group_id, count(*) AS n FROM res GROUP BY ALL)
), ly AS (
  SELECT res.*, rank, CASE WHEN n = 1 THEN -2 ELSE (rank - 1) % 16 END::BIGINT AS colour FROM res JOIN rk USING (set_id, group_id) WHERE rank <= 15
)"""
_TILE = "((px // 30) || ',' || (py // 30)) AS tile"

ORACLES: dict[str, str] = {
    "top_group_tiles": f"""{_DRAWN} SELECT set_id, rank::BIGINT AS rank, group_id, {_TILE}, colour, count(DISTINCT (px, py)) AS n_pixels
FROM ly JOIN st USING (trajectory_idx) GROUP BY ALL""",
    "top_overlay_tiles": f"""{_DRAWN}, im AS (
  SELECT set_id, px, py, arg_max(colour, rank) AS colour FROM ly JOIN st USING (trajectory_idx) GROUP BY 1, 2, 3 UNION ALL SELECT DISTINCT -1, px, py, -1 FROM st
) SELECT set_id, {_TILE}, colour, count(*) AS n_pixels FROM im GROUP BY ALL""",
    "fine_levels": " UNION ALL ".join(
        _counted(f"{n}::BIGINT AS n", (3 - n, 3 - n, 2), "any_value(2::BIGINT)", 2, "count(*) AS n_groups, sum(m)::BIGINT AS n_members, max(m) AS largest", _SIZES) for n in range(3)
    ),
    "largest_fine_groups": f"WITH RECURSIVE {_overlap(0.02, _weights(2, _FINER))} {_TOP} 15",
    "all_levels": " UNION ALL ".join(_counted(f"{n}::BIGINT AS n", (3 - n, 3 - n, 5), _TENTH, 1, f"{_GROUPS}, count(*)::BIGINT AS n_members") for n in range(3)),
    "swept_groups": " UNION ALL ".join(
        _counted(f"{k}::BIGINT AS set_id, 'completed' AS status", (space, space, time), _TENTH, 1, _GROUPS) for k, (space, time) in enumerate(((4, 4), (4, 5), (5, 4), (5, 5)))
    ),
    "sweep_resumed": " UNION ALL ".join(
        _counted(f"{k}::BIGINT AS set_id, {k // 2}::BIGINT AS batch, 'completed' AS status", (2, 3, lt), f"any_value({support}::BIGINT)", 2, _GROUPS)
        for k, (lt, support) in enumerate(((3, 2), (3, 3), (5, 2), (5, 3)))
    ),
    "stage_metrics": f"""WITH {_cliques(3)} SELECT 0::BIGINT AS line, 'enumerated' AS stage, count(*) AS rows FROM n
UNION ALL SELECT 1, 'itemsets', count(*) FROM s UNION ALL SELECT 2, 'cliques', count(*) FROM cl""",
    "flagship": f"WITH RECURSIVE {_overlap(0.06, _closed(_weights(3)))} {_TOP} 5",
    "load_samples": f"WITH {_E} SELECT trajectory_idx, trajectory_id, seq, x, y, t FROM e",
    "dataset_stats": f"WITH {_E} SELECT {_BOUNDS}, count(*) AS n_samples, count(DISTINCT trajectory_idx) AS n_trajectories FROM e",
    "grid_extent": f"WITH {_E} SELECT greatest(max(x) - min(x), max(y) - min(y)) AS grid_size, max(t) - min(t) AS max_t FROM e",
    "path_length_stats": f"WITH {_E} SELECT min(n) AS min_length, max(n) AS max_length, avg(n) AS avg_length FROM (SELECT count(*) AS n FROM e GROUP BY trajectory_idx)",
    "trajectory_bbox": f"WITH {_E} SELECT trajectory_idx, {_BOUNDS} FROM e GROUP BY trajectory_idx",
    "box_filter": f"WITH {_E} SELECT {_ROW} FROM e WHERE x >= 2 AND x < 200 AND y >= 10 AND y < 90",
    "box_filter_reset": f"""WITH {_E}, m AS (SELECT *, max(CASE WHEN NOT (x >= 0 AND x < 200 AND y >= 0 AND y < 99) THEN ord END) OVER (PARTITION BY trajectory_idx) AS gone FROM e)
SELECT {_ROW} FROM m WHERE gone IS NULL OR ord > gone""",
    "normalize_origin": f"WITH {_E} SELECT trajectory_idx, seq, x - min(x) OVER () AS x, y - min(y) OVER () AS y, t - min(t) OVER () AS t FROM e",
    "interpolate_gaps": f"WITH {_gaps(_E)} SELECT * FROM path",
    "interpolate_orders": f"WITH {_gaps(_ORDERS)} SELECT * FROM path",
    "pad_paths": f"""WITH {_gaps(_E)}, sp AS (SELECT min(t) AS lo, max(t) - min(t) + 1 AS ticks FROM e), q AS (
  SELECT *, row_number() OVER o AS rn, count(*) OVER (PARTITION BY trajectory_idx) AS cnt, first_value(t) OVER o AS ft FROM path WINDOW o AS (PARTITION BY trajectory_idx ORDER BY t, seq)
), z AS (
  SELECT trajectory_idx, seq AS oseq, x, y, unnest(list_concat(list_concat(CASE WHEN rn = 1 THEN range(lo, t) ELSE [] END, [t]),
         CASE WHEN rn = cnt AND ticks - cnt - (ft - lo) > 0 THEN range(t + 1, t + 1 + ticks - cnt - (ft - lo)) ELSE [] END)) AS t FROM q, sp
) SELECT trajectory_idx, (row_number() OVER (PARTITION BY trajectory_idx ORDER BY t, oseq) - 1)::BIGINT AS seq, x, y, t::BIGINT AS t FROM z""",
    "compress_path": f"""WITH {_E}, c AS ({_rolled(7, 6, 5)}), m AS (
  SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(t) OVER o AS pt FROM c WINDOW o AS (PARTITION BY trajectory_idx ORDER BY t, seq)
) SELECT {_ROW} FROM m WHERE px IS NULL OR px <> x OR py <> y OR pt <> t""",
    "singular_paths": f"WITH {_E}, c AS ({_rolled(9, 7, 5)}) SELECT trajectory_idx, count(DISTINCT (x, y)) = 1 AS singular FROM c GROUP BY trajectory_idx",
    "verify_path": f"WITH {_E}, m AS (SELECT *, t - lag(t) OVER (PARTITION BY trajectory_idx ORDER BY t, seq) AS step FROM e) SELECT trajectory_idx, seq, t, step FROM m WHERE step <> 1",
    "heading_distance": f"""WITH {_E}, m AS (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM e WINDOW o AS (PARTITION BY trajectory_idx ORDER BY t, seq)),
f AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS far FROM m WHERE nx IS NOT NULL)
SELECT trajectory_idx, seq, round(far, 6) AS distance, round(CASE WHEN far = 0 THEN 0.0 WHEN ny < y THEN 3.141592654 * 2 - acos((nx - x) / far) ELSE acos((nx - x) / far) END, 6) AS heading FROM f""",
    "levels": f"WITH {_E} SELECT {_BITS} FROM e",
    "rollup": f"WITH {_C} SELECT {_ROW}, 5::BIGINT AS lx, 5::BIGINT AS ly, 5::BIGINT AS lt FROM c",
    "rollup_shift": f"WITH {_E} {_rolled(5, 5, 5, True)}",
    "cell_centres": f"WITH {_C} SELECT trajectory_idx, seq, x + 17 AS x, y + 18 AS y, t + 16 AS t FROM c",
    "unique_cells": f"WITH {_N} SELECT item_id, x, y, t FROM dict",
    "enumerate": f"WITH {_N} SELECT trajectory_idx, item_id FROM n",
    "morton_codes": f"WITH {_E} SELECT trajectory_idx, seq, ({_MORTON})::BIGINT AS code FROM e",
    "timeslice": f"WITH {_TICKS} SELECT slice_id, {_ROW} FROM e JOIN sl USING (t)",
    "timeslice_counts": f"""WITH {_TICKS}, h AS (SELECT slice_id, trajectory_idx, count(*) AS n FROM e JOIN sl USING (t) GROUP BY 1, 2)
SELECT a.slice_id, b.trajectory_idx, coalesce(h.n, 0)::BIGINT AS n_samples FROM (SELECT DISTINCT slice_id FROM sl) a CROSS JOIN (SELECT DISTINCT trajectory_idx FROM e) b
LEFT JOIN h ON h.slice_id = a.slice_id AND h.trajectory_idx = b.trajectory_idx""",
    "item_support": f"WITH {_N} SELECT item_id, count(*) AS support FROM n GROUP BY 1 HAVING count(*) >= 5",
    "frequent_itemsets": f"WITH {_S} SELECT itemset_id, {_JOIN} AS items, n_items, support FROM s",
    "itemset_histogram": f"WITH {_S} SELECT n_items, count(*) AS n_itemsets FROM s GROUP BY 1",
    "closed_itemsets": f"WITH {_B} SELECT {_JOIN} AS items, support FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.n_items = a.n_items + 1 AND b.support = a.support AND list_has_all(b.items, a.items))",
    "maximal_itemsets": f"WITH {_B} SELECT {_JOIN} AS items, support FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.n_items = a.n_items + 1 AND list_has_all(b.items, a.items))",
    "match_cliques": f"WITH {_cliques(1)} SELECT itemset_id, trajectory_idx FROM cl",
    "match_min_length": f"WITH {_cliques(3)} SELECT itemset_id, trajectory_idx FROM cl",
    "comembership_bool": f"WITH {_cliques(3)} SELECT DISTINCT a.trajectory_idx AS t1, b.trajectory_idx AS t2 FROM cl a JOIN cl b ON a.itemset_id = b.itemset_id",
    "weight_last": f"WITH {_weights(2)} SELECT t1, t2, round(arg_max(w, itemset_id), 9) AS w FROM al GROUP BY 1, 2",
    "weight_max": f"WITH {_weights(2)} SELECT t1, t2, round(max(w), 9) AS w FROM al GROUP BY 1, 2 HAVING max(w) > 0.045",
    "group_overlap": f"""WITH {_cliques(3)}, z AS (SELECT itemset_id, count(*) AS n FROM cl GROUP BY 1), sh AS (
  SELECT a.itemset_id AS g1, b.itemset_id AS g2, count(*) AS n_shared FROM cl a JOIN cl b ON a.trajectory_idx = b.trajectory_idx AND a.itemset_id < b.itemset_id GROUP BY 1, 2
) SELECT g1, g2, n_shared, (z1.n + z2.n - n_shared)::BIGINT AS n_union FROM sh JOIN z z1 ON z1.itemset_id = g1 JOIN z z2 ON z2.itemset_id = g2""",
    "group_cc": f"WITH RECURSIVE {_CC} SELECT component AS group_id, node AS trajectory_idx FROM comp",
    "group_overlap_components": f"WITH RECURSIVE {_overlap(0.03, _weights(2, _FINE))} SELECT component AS group_id, node AS trajectory_idx FROM comp",
    "topk_groups": f"WITH RECURSIVE {_CC} {_TOP} 5",
    "group_both_symmetric": f"""WITH RECURSIVE {_weights(2, _FINE)}, {_LIST}, {_attached('z', 0.5)}, held AS (
  SELECT gs[i].m AS m FROM (SELECT gs, unnest(range(1, len(gs) + 1)) AS i FROM (SELECT gs FROM z ORDER BY step DESC LIMIT 1))
), {_components("SELECT t1 AS src, t2 AS dst FROM al WHERE w > 0.03 AND t1 <> t2 UNION SELECT a, b FROM (SELECT m, unnest(m) AS a FROM held), LATERAL (SELECT unnest(m) AS b) WHERE a <> b", "SELECT DISTINCT src AS node FROM ed")}
SELECT component AS group_id, node AS trajectory_idx FROM comp""",
    "group_both": _directed(0.03, 0.5),
    "group_nc": _linked("SELECT DISTINCT a.trajectory_idx AS t1, b.trajectory_idx AS t2, 1.0::DOUBLE AS w FROM cl a JOIN cl b ON a.itemset_id = b.itemset_id", _cliques(2, _FINE), [0.3, 0.8]),
    "group_wc": _linked("SELECT t1, t2, arg_max(w, itemset_id) AS w FROM al GROUP BY 1, 2", _weights(2, _FINE), [0.01, 0.025]),
    "group_attachment": _attachment([0.3, 0.5]),
    "group_attachment_by_id": _attachment([0.2, 0.4], by_id=True),
    "group_per_clique": f"WITH {_cliques(2, _FINE)} SELECT (dense_rank() OVER (ORDER BY itemset_id) - 1)::BIGINT AS group_id, trajectory_idx FROM cl",
    "merged_members": f"""WITH {_cliques(2, _FINE)}, pr AS (SELECT DISTINCT a.itemset_id AS g1, b.itemset_id AS g2 FROM cl a JOIN cl b ON a.trajectory_idx = b.trajectory_idx AND a.itemset_id < b.itemset_id), u AS (
  SELECT DISTINCT g1, g2, trajectory_idx FROM pr JOIN cl ON cl.itemset_id IN (g1, g2)
) SELECT g1, g2, string_agg(trajectory_idx::VARCHAR, ',' ORDER BY trajectory_idx) AS members FROM u GROUP BY 1, 2""",
    "weight_mean": f"WITH {_weights(2, _FINE)} SELECT t1, t2, round(avg(w), 9) AS w FROM al GROUP BY 1, 2",
    "edge_matrix": f"WITH {_weights(2, _FINE)} SELECT t1, {', '.join(f'round(max(w) FILTER (t2 = {k}), 9) AS w{k}' for k in range(4))} FROM al GROUP BY 1",
    "supplied_groups": f"WITH {_E} SELECT DISTINCT trajectory_idx % 5 AS group_id, trajectory_idx FROM e",
    "viewport_points": f"WITH {_VIEW} SELECT trajectory_idx, seq, px, py, in_view FROM v",
    "viewport_polylines": f"""WITH {_VIEW}, g AS (SELECT DISTINCT trajectory_idx % 5 AS group_id, trajectory_idx FROM e), h AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY trajectory_idx) AS place, count(*) OVER (PARTITION BY group_id) AS n FROM g
), p AS (
  SELECT h.group_id, v.trajectory_idx, v.seq, v.px, v.py, v.in_view, lag(px) OVER o AS lx, lag(py) OVER o AS ly, coalesce(lag(in_view) OVER o, false) AS was
  FROM v JOIN h ON v.trajectory_idx = h.trajectory_idx WHERE h.place <= 4 AND h.n <> 1 AND (23 >> h.group_id::INT) & 1 = 1 AND v.seq >= 1
  WINDOW o AS (PARTITION BY h.group_id, v.trajectory_idx ORDER BY v.seq)
), q AS (SELECT *, sum((in_view AND NOT was)::INT) OVER (PARTITION BY group_id, trajectory_idx ORDER BY seq) AS segment FROM p), m AS (
  SELECT group_id, trajectory_idx, segment, seq, 0 AS a, lx AS px, ly AS py FROM q WHERE in_view AND NOT was AND lx IS NOT NULL
  UNION ALL SELECT group_id, trajectory_idx, segment, seq, 1, px, py FROM q WHERE in_view AND (lx IS NULL OR px <> lx OR py <> ly)
  UNION ALL SELECT group_id, trajectory_idx, segment, seq, 2, px, py FROM q WHERE NOT in_view AND was
) SELECT group_id, trajectory_idx, segment::BIGINT AS segment, (row_number() OVER (PARTITION BY group_id, trajectory_idx, segment ORDER BY seq, a) - 1)::BIGINT AS ord, px, py FROM m""",
    "canvas_points": f"WITH {_E} SELECT trajectory_idx, seq, x * (640.0::DOUBLE / 1024) AS cx, 480.0::DOUBLE - y * (480.0::DOUBLE / 1024) AS cy FROM e",
    "sweep_params": _LISTS,
    "sweep_batches": f"SELECT *, set_id // 5 AS batch FROM ({_LISTS})",
    "sweep_feasible": f"WITH {_E}, b AS (SELECT {_BITS} FROM e), p AS ({_LISTS}) SELECT p.*, lx - space::BIGINT AS shift_xy, lt - time::BIGINT AS shift_t FROM p, b WHERE space::BIGINT <= lx AND time::BIGINT <= lt",
    "sweep_pending": f"SELECT * FROM ({_LISTS}) WHERE set_id % 3 <> 0",
    "stage_stats": f"""WITH RECURSIVE {_CC3} SELECT 0::BIGINT AS line, 'trajectories' AS label, count(DISTINCT trajectory_idx) AS value FROM n
UNION ALL SELECT 1, 'unique_items', count(DISTINCT item_id) FROM n UNION ALL SELECT 2, 'itemsets', count(*) FROM s
UNION ALL SELECT 3, 'cliques', count(DISTINCT itemset_id) FROM cl UNION ALL SELECT 4, 'groups', count(DISTINCT component) FROM comp""",
    "dat_roundtrip": f"WITH {_E} SELECT trajectory_idx, trajectory_id, seq, x, y, t FROM e",
    "unq_text": f"WITH {_N} SELECT item_id AS line, '(' || x || ', ' || y || ', ' || t || ')' AS text FROM dict",
    "emp_text": f"WITH {_N} SELECT trajectory_idx AS line, string_agg(item_id::VARCHAR, ' ' ORDER BY item_id) AS text FROM n GROUP BY 1",
    "fi_text": f"WITH {_S} SELECT itemset_id AS line, array_to_string(items, ' ') || ' (' || support || ')' AS text FROM s",
    "cl_text": f"WITH {_cliques(3)} SELECT itemset_id AS line, itemset_id || ': ' || string_agg(trajectory_idx::VARCHAR, ' ' ORDER BY trajectory_idx) AS text FROM cl GROUP BY 1",
    "dat_file": f"WITH {_E} SELECT trajectory_idx, trajectory_id, seq, x, y, t FROM e",
    "dat_file_header": f"WITH {_E} SELECT greatest(max(x) - min(x), max(y) - min(y)) AS grid_size, max(t) - min(t) AS max_t, count(DISTINCT trajectory_idx) AS n_trajectories FROM e",
    "dat_file_groups": f"WITH {_E} SELECT DISTINCT trajectory_idx % 5 AS group_id, trajectory_idx FROM e",
    "map_file": f"WITH {_C} SELECT {_ROW} FROM c",
    "map_file_header": f"WITH {_E} SELECT 5::BIGINT AS lx, 5::BIGINT AS ly, 5::BIGINT AS lt, count(DISTINCT trajectory_idx) AS n_trajectories FROM e",
    "unq_file": f"WITH {_N} SELECT item_id, x, y, t FROM dict",
    "emp_file": f"WITH {_N} SELECT trajectory_idx, item_id FROM n",
    "transaction_file": f"WITH {_N} SELECT trajectory_idx AS line, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM n GROUP BY 1",
    "fi_file": f"WITH {_S} SELECT itemset_id, {_JOIN} AS items, n_items, support FROM s WHERE n_items >= 2",
    "cl_file": f"WITH {_cliques(3)} SELECT itemset_id, trajectory_idx FROM cl",
    "grp_file": f"WITH RECURSIVE {_CC} SELECT (dense_rank() OVER (ORDER BY component) - 1)::BIGINT AS group_id, node AS trajectory_idx FROM comp",
    "csv_file": f"WITH {_E} SELECT trajectory_idx, trajectory_id, seq, x, y, t FROM e",
    "sweep_list_file": "SELECT l AS line, (row_number() OVER (PARTITION BY l ORDER BY o) - 1)::BIGINT AS pos, v AS value FROM (VALUES (0::BIGINT, 1, '3'), (0, 2, '5'), (0, 3, '9'), (1, 1, '2'), (1, 2, '10'), (2, 1, '4'), (2, 2, '15')) x(l, o, v)",
    "print_dataset": f"WITH {_E} SELECT trajectory_idx AS line, lpad(any_value(trajectory_id)::VARCHAR, greatest(5, length(any_value(trajectory_id)::VARCHAR))::INTEGER, ' ') || ': ' || string_agg('(' || x || ', ' || y || ', ' || t || ')', ' ' ORDER BY seq) AS text FROM e GROUP BY 1",
    "print_itemsets": f"WITH {_S} SELECT itemset_id AS line, itemset_id || ': {{' || array_to_string(items, ' ') || '}} x ' || support AS text FROM s WHERE n_items >= 3",
    "print_groups": f"WITH RECURSIVE {_CC} SELECT component AS line, component || ' (' || count(*) || '): ' || string_agg(node::VARCHAR, ' ' ORDER BY node) AS text FROM comp GROUP BY 1",
    "print_edges": f"WITH {_weights(2, _FINE)}, x AS (SELECT t1, t2, max(w) AS w FROM al GROUP BY 1, 2) SELECT t1 AS line, string_agg(t2 || ':' || printf('%.6f', w), ' ' ORDER BY t2) AS text FROM x GROUP BY 1",
    "rotated_points": f"WITH {_E} SELECT trajectory_idx, seq, (trunc((x - 100)::DOUBLE * cos(0.75) - (y - 50)::DOUBLE * sin(0.75)) + 100)::BIGINT AS rx, (trunc((x - 100)::DOUBLE * sin(0.75) + (y - 50)::DOUBLE * cos(0.75)) + 50)::BIGINT AS ry FROM e",
    "scaled_points": f"WITH {_E} SELECT trajectory_idx, seq, round(x * 1024.0::DOUBLE / 600, 6) AS sx FROM e",
    "log2_values": f"WITH {_E} SELECT trajectory_idx, seq, length(bin(x))::BIGINT - 1 AS bits FROM e WHERE x > 0",
    "path_without_time": f"""WITH {_E}, c AS ({_rolled(2, 3, 2)}), m AS (
  SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py FROM c WINDOW o AS (PARTITION BY trajectory_idx ORDER BY t, seq)
) SELECT {_ROW} FROM m WHERE px IS NULL OR px <> x OR py <> y""",
    "support_order": f"WITH {_N}, u AS (SELECT item_id, count(*) AS support FROM n GROUP BY 1) SELECT (row_number() OVER (ORDER BY support, item_id) - 1)::BIGINT AS rank, item_id, support FROM u",
    "group_colours": f"WITH RECURSIVE {_CC} SELECT component AS group_id, CASE WHEN count(*) <> 1 THEN component % 4 END AS colour FROM comp GROUP BY 1",
    "filled_templates": "SELECT k AS line, 'run ' || k || ' of b on ' || (k + 7) || ', 100%%2 %9' AS text FROM (SELECT unnest(range(3)) AS k)",
    "parsed_levels": "SELECT * FROM (VALUES (5::BIGINT, 5::BIGINT, 3::BIGINT), (0, 1, 12)) x(x, y, t)",
    "generator_config": "SELECT 'spiral' AS movement, 3::BIGINT AS n_groups, 10::BIGINT AS group_size, 80::BIGINT AS steps, 10::BIGINT AS n_singletons",
    "grp_text": f"WITH RECURSIVE {_CC} SELECT component AS line, string_agg(node::VARCHAR, ' ' ORDER BY node) AS text FROM comp GROUP BY 1",
}
