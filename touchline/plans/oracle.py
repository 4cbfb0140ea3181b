"""The registered queries in SQL: a chain of named relations, and a select over them for each query."""

from __future__ import annotations

import re

from ..sources.fixtures import BALL, DENSE, DETECTION, FRAME_PIXEL, UNNAMED

TRACK = "match_id, frame_num, object, track_id"
H = (0.21888134936997805, 0.04464027520045604, -70.27963326316959, -0.005306128172663865, -0.06765313420146424, 70.60466799750851, -5.9823044554659536e-05, 0.00431056087175743, 1.0)
POLYGON = ((110, 1035), (265, 275), (910, 260), (1640, 915))


def _num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _inside(x: str, y: str) -> str:
    edges = zip(POLYGON, (*POLYGON[1:], POLYGON[0]), strict=True)
    return " AND ".join(f"({bx - ax}e0 * (trunc({y}) - {ay}e0) - ({by - ay}e0) * (trunc({x}) - {ax}e0) >= 0)" for (ax, ay), (bx, by) in edges)


def _project(row: int, x: str, y: str) -> str:
    s = lambda v: f"CAST(CAST({v} AS REAL) AS DOUBLE)"
    a, b, c = (_num(v) for v in H[3 * row : 3 * row + 3])
    w = f"({_num(H[6])} * {s(x)} + {_num(H[7])} * {s(y)} + {_num(H[8])})"
    return f"CAST(CAST(({a} * {s(x)} + {b} * {s(y)} + {c}) / {w} AS REAL) AS DOUBLE)"


def _solved(ids: str, source: list[tuple[str, str]], target: list[tuple[str, str]]) -> str:
    """ids, h: the map of four points to four points, step by step over columns: the unit square to either, one back, one on."""
    single = lambda v: f"CAST(CAST({v} AS REAL) AS DOUBLE)"
    points = ", ".join(f"{single(v)} AS {m}{c}{k}" for m, four in (("s", source), ("t", target)) for k, xy in enumerate(four) for c, v in zip("xy", xy, strict=True))
    sides = ", ".join(f"{m}{c}0 - {m}{c}1 + {m}{c}2 - {m}{c}3 AS {m}s{c}, {m}{c}1 - {m}{c}2 AS {m}a{c}, {m}{c}3 - {m}{c}2 AS {m}b{c}" for m in "st" for c in "xy")
    slopes = ", ".join(f"({m}sx * {m}by - {m}bx * {m}sy) / {m}det AS {m}6, ({m}ax * {m}sy - {m}sx * {m}ay) / {m}det AS {m}7, 1e0 AS {m}8" for m in "st")
    rows = ", ".join(f"{m}{c}1 - {m}{c}0 + {m}6 * {m}{c}1 AS {m}{3 * r}, {m}{c}3 - {m}{c}0 + {m}7 * {m}{c}3 AS {m}{3 * r + 1}, {m}{c}0 AS {m}{3 * r + 2}" for m in "st" for r, c in enumerate("xy"))
    minors = ((4, 5, 7, 8), (2, 1, 8, 7), (1, 2, 4, 5), (5, 3, 8, 6), (0, 2, 6, 8), (2, 0, 5, 3), (3, 4, 6, 7), (1, 0, 7, 6), (0, 1, 3, 4))
    back = ", ".join(f"s{i} * s{m} - s{j} * s{k} AS k{n}" for n, (i, j, k, m) in enumerate(minors))
    cells = ", ".join(f"t{3 * r} * k{c} + t{3 * r + 1} * k{3 + c} + t{3 * r + 2} * k{6 + c} AS p{3 * r + c}" for r in range(3) for c in range(3))
    out = f"SELECT *, {points} FROM ({ids})"
    for step in (sides, "sax * sby - sbx * say AS sdet, tax * tby - tbx * tay AS tdet", slopes, rows, back, cells):
        out = f"SELECT *, {step} FROM ({out})"
    return f"SELECT match_id, calibration_id, [{', '.join(f'p{k} / p8' for k in range(9))}] AS h FROM ({out})"


def _d(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


#: Draws of the ten starts of 2-means: the number of the start, and the fractions at which its two centres lie.
DRAWS = ", ".join(f"({k}, {_num((k + 0.5) / 10)}, {_num((k + 1) * 0.6180339887498949 % 1)})" for k in range(10))


def _means(name: str, points: str, *keys: str) -> dict[str, str]:
    """2-means of each group of points: counted colours, starts drawn by squared distance and by extremes, all the
    centres that the rounds pass through (name_walk, until nothing new comes), and the best that stay."""
    key = ", ".join(keys)
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys)
    of = lambda x: ", ".join(f"{x}.{k}" for k in keys)
    centre = ", ".join(f"c{k}_{c}" for k in (0, 1) for c in "bgr")
    near = [" + ".join(f"(p.{c} - w.c{k}_{c}) * (p.{c} - w.c{k}_{c})" for c in "bgr") for k in (0, 1)]
    far = " + ".join(f"(c.{c} - f.{c}) * (c.{c} - f.{c})" for c in "bgr")
    side = f"(({near[0]}) <= ({near[1]}))"
    mean = lambda k, c: f"coalesce(round(sum(p.n * p.{c}) FILTER ({'' if k == 0 else 'NOT '}{side}) / sum(p.n) FILTER ({'' if k == 0 else 'NOT '}{side}), 9), w.c{k}_{c})"
    means = ", ".join(f"{mean(k, c)} AS {'{}'}c{k}_{c}" for k in (0, 1) for c in "bgr")
    extremes = []
    for i, order in enumerate(("b + g + r", "b", "g", "r")):
        first = ", ".join(f"arg_{f}({c}, ({order}, b, g, r)) AS c{k}_{c}" for k, f in ((0, "min"), (1, "max")) for c in "bgr")
        extremes.append(f"SELECT {key}, {10 + i} AS s, {first} FROM {name}_c GROUP BY {key}")
    darker = "(c0_b + c0_g + c0_r, c0_b, c0_g, c0_r) <= (c1_b + c1_g + c1_r, c1_b, c1_g, c1_r)"
    ordered = ", ".join(f"CASE WHEN {darker} THEN c{k}_{c} ELSE c{1 - k}_{c} END AS c{k}_{c}" for k in (0, 1) for c in "bgr")
    return {
        f"{name}_c": f"SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY b, g, r) AS cum, sum(n) OVER (PARTITION BY {key}) AS total FROM "
        f"(SELECT {key}, CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g, CAST(r AS DOUBLE) AS r, CAST(count(*) AS DOUBLE) AS n FROM {points} GROUP BY ALL)",
        f"{name}_1": f"SELECT {key}, s, v, " + ", ".join(f"arg_min({c}, (b, g, r)) AS {c}" for c in "bgr") + f" FROM {name}_c, (VALUES {DRAWS}) d(s, u, v) WHERE cum > u * total GROUP BY {key}, s, v",
        f"{name}_2": f"SELECT {of('f')}, s, v, f.b AS fb, f.g AS fg, f.r AS fr, c.b, c.g, c.r, sum(c.n * ({far})) OVER (PARTITION BY {of('f')}, s ORDER BY c.b, c.g, c.r) AS cum, "
        f"sum(c.n * ({far})) OVER (PARTITION BY {of('f')}, s) AS total FROM {name}_1 f JOIN {name}_c c ON {on('f', 'c')}",
        f"{name}_starts": f"SELECT {key}, s, fb AS c0_b, fg AS c0_g, fr AS c0_r, " + ", ".join(f"coalesce(arg_min({c}, (b, g, r)) FILTER (cum > v * total), f{c}) AS c1_{c}" for c in "bgr")
        + f" FROM {name}_2 GROUP BY {key}, s, fb, fg, fr UNION ALL " + " UNION ALL ".join(extremes),
        f"{name}_walk": f"SELECT {key}, s, {centre} FROM {name}_starts UNION SELECT {of('w')}, w.s, {means.format(*[''] * 6)} FROM {name}_walk w JOIN {name}_c p ON {on('w', 'p')} GROUP BY {of('w')}, w.s, "
        + ", ".join(f"w.{c}" for c in centre.split(", ")),
        f"{name}_next": f"SELECT {of('w')}, w.s, " + ", ".join(f"w.{c}" for c in centre.split(", ")) + f", {means.format(*['n'] * 6)}, round(sum(p.n * least({near[0]}, {near[1]})), 6) AS cost "
        f"FROM {name}_walk w JOIN {name}_c p ON {on('w', 'p')} GROUP BY {of('w')}, w.s, " + ", ".join(f"w.{c}" for c in centre.split(", ")),
        name: f"SELECT {key}, " + ", ".join(f"arg_min({c}, (cost, s)) AS {c}" for c in centre.split(", ")) + f" FROM (SELECT {key}, s, cost, {ordered} FROM {name}_next WHERE "
        + " AND ".join(f"{c} = n{c}" for c in centre.split(", ")) + f") GROUP BY {key}",
    }


def _colours(prefix: str, top: str, *keys: str) -> dict[str, str]:
    """Jersey colours of crops: prefix + means, extent, corner, votes, colours over the pixels of their upper halves."""
    p, key = prefix, ", ".join(keys)
    return {
        **_means(f"{p}means", top, *keys),
        f"{p}extent": f"SELECT {key}, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM {top} GROUP BY {key}",
        f"{p}corner": " UNION ALL ".join(f"SELECT {key}, {x} AS x, {y} AS y FROM {p}extent" for x in ("lx", "hx") for y in ("ly", "hy")),
        f"{p}votes": f"SELECT {key}, CASE WHEN sum({_nearer()}) >= 3 THEN 0 ELSE 1 END AS player_cluster FROM {p}corner JOIN {top} USING ({key}, x, y) JOIN {p}means USING ({key}) GROUP BY {key}",
        f"{p}colours": f"SELECT {key}, " + ", ".join(f"CASE WHEN player_cluster = 0 THEN c0_{c} ELSE c1_{c} END AS {c}" for c in "bgr") + f" FROM {p}means JOIN {p}votes USING ({key})",
    }


def _teams(prefix: str, seen: str) -> dict[str, str]:
    """Teams of players by the colours in ``seen``: prefix + seen_0, teams, first_colours, by_colour."""
    p = prefix
    return {
        f"{p}seen_0": f"SELECT * FROM {seen} WHERE frame_num = 0",
        **_means(f"{p}team_means", f"{p}seen_0", "match_id"),
        f"{p}teams": f"SELECT match_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY b, g, r) AS INT) AS team, b, g, r FROM (SELECT match_id, c0_b AS b, c0_g AS g, c0_r AS r FROM {p}team_means UNION ALL SELECT match_id, c1_b, c1_g, c1_r FROM {p}team_means)",
        f"{p}first_colours": f"SELECT match_id, track_id, arg_min(b, frame_num) AS b, arg_min(g, frame_num) AS g, arg_min(r, frame_num) AS r FROM {seen} GROUP BY match_id, track_id",
        f"{p}by_colour": f"SELECT f.match_id, f.track_id, CAST({_nearer('f.', 'a.', 'z.')} + 1 AS INT) AS team FROM {p}first_colours f JOIN {p}teams a ON f.match_id = a.match_id AND a.team = 1 JOIN {p}teams z ON f.match_id = z.match_id AND z.team = 2",
    }


def _nearer(point: str = "", first: str = "c0_", second: str = "c1_") -> str:
    near = [" + ".join(f"({point}{c} - {p}{c}) * ({point}{c} - {p}{c})" for c in "bgr") for p in (first, second)]
    return f"CASE WHEN {near[0]} <= {near[1]} THEN 0 ELSE 1 END"


def _links(table: str, also: str = "true") -> str:
    """Detections of a table and those of the frame before that they continue: each other's best overlap."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, object, frame_num, det_index ORDER BY iou DESC, p_index) AS a, row_number() OVER (PARTITION BY match_id, object, frame_num, p_index ORDER BY iou DESC, det_index) AS b FROM (
        SELECT n.match_id, n.object, n.frame_num, n.det_index, p.det_index AS p_index, w * h / ((n.x2 - n.x1) * (n.y2 - n.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - w * h) AS iou
        FROM {table} n JOIN {table} p ON n.match_id = p.match_id AND n.object = p.object AND n.frame_num = p.frame_num + 1 AND {also},
        LATERAL (SELECT greatest(least(n.x2, p.x2) - greatest(n.x1, p.x1), 0e0) AS w, greatest(least(n.y2, p.y2) - greatest(n.y1, p.y1), 0e0) AS h)) WHERE iou >= 0.3e0) WHERE a = 1 AND b = 1"""


_GIVEN = "CASE WHEN track_id IS NOT NULL THEN {'f': frame_num, 't': track_id} END"
RELATIONS: dict[str, str] = {
    "ord": "SELECT CAST(floor(o_orderkey/750) AS BIGINT) AS match_id, o_orderkey % 750 AS frame_num, * FROM orders",
    "frames": "SELECT match_id, frame_num FROM ord",
    "li": "SELECT CAST(floor(l_orderkey/750) AS BIGINT) AS match_id, l_orderkey % 750 AS frame_num, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS BIGINT) AS det_index, * FROM lineitem",
    "detections": f"SELECT {DETECTION} FROM li UNION ALL SELECT {BALL.format(index=100, confidence='0.5e0', a=53, b=31)} FROM ord WHERE o_orderstatus <> 'P' "
    f"UNION ALL SELECT {BALL.format(index=101, confidence='0.3e0', a=59, b=41)} FROM ord WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'",
    "dense": f"SELECT {DENSE} FROM li",
    "features": """SELECT match_id, frame_num, det_index AS feature_id, CAST((l_partkey*7) % 1920 AS DOUBLE) AS old_x, CAST((l_suppkey*11) % 1080 AS DOUBLE) AS old_y,
        CAST((l_partkey*7) % 1920 AS DOUBLE) + (l_quantity-25)*0.5e0 AS new_x, CAST((l_suppkey*11) % 1080 AS DOUBLE) + (l_linenumber-4)*1.5e0 AS new_y FROM li""",
    "sure": "SELECT * FROM detections WHERE confidence > 0.1e0",
    "objects": """SELECT * REPLACE (CASE WHEN class_name = 'ball' THEN 1 ELSE track_id END AS track_id),
        CASE class_name WHEN 'player' THEN 'players' WHEN 'goalkeeper' THEN 'players' WHEN 'referee' THEN 'referees' ELSE 'balls' END AS object FROM sure""",
    "tracks": f"""SELECT {TRACK}, max(det_index) AS det_index, min(det_index) AS first_index,
        arg_max(x1, det_index) AS x1, arg_max(y1, det_index) AS y1, arg_max(x2, det_index) AS x2, arg_max(y2, det_index) AS y2 FROM objects GROUP BY {TRACK}""",
    "positioned": "SELECT *, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS pos_x, CAST(trunc(y2) AS BIGINT) AS pos_y FROM tracks",
    "masked": "SELECT * FROM features WHERE (old_x >= 0 AND old_x < 20) OR (old_x >= 900 AND old_x < 1050)",
    "moves": f"SELECT *, new_x - old_x AS dx, new_y - old_y AS dy, {_d('new_x', 'new_y', 'old_x', 'old_y')} AS d FROM features",
    "dominant": """SELECT match_id, frame_num, arg_max(dx, (d, -feature_id)) AS dx, arg_max(dy, (d, -feature_id)) AS dy, max(d) AS d
        FROM moves SEMI JOIN masked USING (match_id, frame_num, feature_id) WHERE frame_num > 0 AND d > 0 GROUP BY match_id, frame_num""",
    "camera": """SELECT f.match_id, f.frame_num, CASE WHEN d > 5 THEN dx ELSE 0e0 END AS dx, CASE WHEN d > 5 THEN dy ELSE 0e0 END AS dy
        FROM frames f LEFT JOIN dominant m ON f.match_id = m.match_id AND f.frame_num = m.frame_num""",
    "adjusted": "SELECT t.*, pos_x - dx AS adj_x, pos_y - dy AS adj_y FROM positioned t JOIN camera c ON t.match_id = c.match_id AND t.frame_num = c.frame_num",
    "projected": f"SELECT *, {_project(0, 'adj_x', 'adj_y')} AS u, {_project(1, 'adj_x', 'adj_y')} AS v, {_inside('adj_x', 'adj_y')} AS inside FROM adjusted",
    "world": "SELECT * EXCLUDE (u, v, inside), CASE WHEN inside THEN u END AS world_x, CASE WHEN inside THEN v END AS world_y FROM projected",
    "calibrations": _solved(
        "SELECT DISTINCT match_id, match_id AS calibration_id, CAST(match_id % 25 AS DOUBLE) AS s FROM frames",
        [(f"{x}e0 + s", f"{y}e0") for x, y in POLYGON],
        [("0e0", "0e0"), ("0e0", "23.32e0"), ("68e0", "23.32e0"), ("68e0", "0e0")],
    ),
    "calibrated": """SELECT *, CAST(CAST((h[1] * x + h[2] * y + h[3]) / w AS REAL) AS DOUBLE) AS u, CAST(CAST((h[4] * x + h[5] * y + h[6]) / w AS REAL) AS DOUBLE) AS v FROM (
        SELECT *, h[7] * x + h[8] * y + h[9] AS w FROM (SELECT *, CAST(CAST(adj_x AS REAL) AS DOUBLE) AS x, CAST(CAST(adj_y AS REAL) AS DOUBLE) AS y FROM adjusted JOIN calibrations USING (match_id)))""",
    "world_by_match": f"SELECT * EXCLUDE (u, v, h, w, x, y), CASE WHEN {_inside('trunc(adj_x) - match_id % 25', 'adj_y')} THEN u END AS world_x, CASE WHEN {_inside('trunc(adj_x) - match_id % 25', 'adj_y')} THEN v END AS world_y FROM calibrated",
    "counts": "SELECT match_id, max(frame_num) + 1 AS n_frames FROM frames GROUP BY match_id",
    "spots": "SELECT * FROM world WHERE object <> 'balls' AND world_x IS NOT NULL",
    "windows": f"""SELECT s.match_id, s.object, s.track_id, s.start, s.last, {_d('s.world_x', 's.world_y', 'e.world_x', 'e.world_y')} AS metres,
        {_d('s.world_x', 's.world_y', 'e.world_x', 'e.world_y')} / ((s.last - s.start) / 25e0) * 3.6e0 AS speed_kmh
        FROM (SELECT *, frame_num AS start, least(frame_num + 5, n_frames - 1) AS last FROM spots JOIN counts USING (match_id) WHERE frame_num % 5 = 0) s
        JOIN spots e ON s.match_id = e.match_id AND s.object = e.object AND s.track_id = e.track_id AND s.last = e.frame_num WHERE s.last > s.start""",
    "cumulative": "SELECT *, sum(metres) OVER (PARTITION BY match_id, object, track_id ORDER BY start) AS distance_m FROM windows",
    "sped": """SELECT t.*, CASE WHEN t.frame_num < w.last THEN w.speed_kmh END AS speed_kmh, CASE WHEN t.frame_num < w.last THEN w.distance_m END AS distance_m
        FROM world t LEFT JOIN cumulative w ON t.match_id = w.match_id AND t.object = w.object AND t.track_id = w.track_id AND w.start = floor(t.frame_num / 5) * 5""",
    "balls": "SELECT * FROM tracks WHERE object = 'balls'",
    "near": """SELECT f.match_id, f.frame_num,
        last_value(CASE WHEN x1 IS NOT NULL THEN {'f': f.frame_num, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} END IGNORE NULLS) OVER (PARTITION BY f.match_id ORDER BY f.frame_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
        first_value(CASE WHEN x1 IS NOT NULL THEN {'f': f.frame_num, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} END IGNORE NULLS) OVER (PARTITION BY f.match_id ORDER BY f.frame_num ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
        FROM frames f LEFT JOIN balls b ON f.match_id = b.match_id AND f.frame_num = b.frame_num""",
    "filled": "SELECT match_id, frame_num, 'balls' AS object, CAST(1 AS BIGINT) AS track_id, "
    + ", ".join(f"coalesce(p.{c} + (n.{c} - p.{c}) * ((frame_num - p.f) / nullif(n.f - p.f, 0)), p.{c}, n.{c}) AS {c}" for c in ("x1", "y1", "x2", "y2"))
    + " FROM near",
    "ball": "SELECT match_id, frame_num, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS bx, CAST(trunc((y1 + y2) / 2) AS BIGINT) AS bp FROM filled WHERE x1 IS NOT NULL",
    "distances": f"""SELECT t.match_id, t.frame_num, track_id, first_index, least({_d('x1', 'y2', 'bx', 'bp')}, {_d('x2', 'y2', 'bx', 'bp')}) AS d
        FROM tracks t JOIN ball b ON t.match_id = b.match_id AND t.frame_num = b.frame_num WHERE object = 'players'""",
    "holders": "SELECT match_id, frame_num, arg_min(track_id, (d, first_index)) AS player_id, min(d) AS d FROM distances WHERE d < 70 GROUP BY match_id, frame_num",
    "assigned": "SELECT f.match_id, f.frame_num, player_id FROM frames f LEFT JOIN holders h ON f.match_id = h.match_id AND f.frame_num = h.frame_num",
    "player_team": "SELECT DISTINCT match_id, track_id, CAST(track_id % 2 + 1 AS INT) AS team FROM tracks WHERE object = 'players'",
    "carried": """SELECT a.match_id, a.frame_num, a.player_id, last_value(t.team IGNORE NULLS) OVER (PARTITION BY a.match_id ORDER BY a.frame_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS team
        FROM assigned a LEFT JOIN player_team t ON a.match_id = t.match_id AND a.player_id = t.track_id""",
    "shares": """SELECT match_id, frame_num, player_id, team, n1 / nullif(n1 + n2, 0) AS share_1, n2 / nullif(n1 + n2, 0) AS share_2 FROM (
        SELECT *, count(*) FILTER (team = 1) OVER w AS n1, count(*) FILTER (team = 2) OVER w AS n2 FROM carried WINDOW w AS (PARTITION BY match_id ORDER BY frame_num))""",
    "flagged": """SELECT t.*, coalesce(t.object = 'players' AND a.player_id = t.track_id, false) AS has_ball
        FROM sped t LEFT JOIN assigned a ON t.match_id = a.match_id AND t.frame_num = a.frame_num""",
    "pixels": "SELECT label + 10 * CAST(floor(i/40) AS BIGINT) AS crop_id, i % 5 AS x, CAST(floor(i % 40 / 5) AS BIGINT) AS y, b, g, r FROM (SELECT CAST(label AS BIGINT) AS label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS i, "
    + ", ".join(f"CAST(floor((CAST(embedding[{k}] AS DOUBLE)+1e0)*127.5e0) AS BIGINT) AS {c}" for k, c in enumerate("bgr", 1))
    + " FROM embeddings)",
    "crops": "SELECT DISTINCT crop_id, CAST(floor(crop_id/10) AS BIGINT) AS match_id, CAST(floor(crop_id % 10 / 5) AS BIGINT) AS frame_num, crop_id % 5 + 1 AS track_id FROM pixels",
    "images": "SELECT crop_id, x + crop_id % 7 AS x, y + crop_id % 3 AS y, b, g, r FROM pixels",
    "boxes": "SELECT crop_id, greatest(trunc(crop_id % 7 - 1.5e0), 0) AS x1, greatest(trunc(crop_id % 3 - 0.5e0), 0) AS y1, trunc(crop_id % 7 + 4.75e0) AS x2, trunc(crop_id % 3 + 6.25e0) AS y2 FROM crops",
    "cut": "SELECT crop_id, CAST(x - x1 AS BIGINT) AS x, CAST(y - y1 AS BIGINT) AS y, b, g, r FROM images JOIN boxes USING (crop_id) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2",
    "cut_top": "SELECT p.* FROM cut p JOIN (SELECT crop_id, floor((max(y) + 1) / 2) AS half FROM cut GROUP BY crop_id) h USING (crop_id) WHERE y < half",
    "top": "SELECT p.* FROM pixels p JOIN (SELECT crop_id, floor((max(y) + 1) / 2) AS half FROM pixels GROUP BY crop_id) h USING (crop_id) WHERE y < half",
    **_colours("", "top", "crop_id"),
    "seen": "SELECT * FROM colours JOIN crops USING (crop_id)",
    **_teams("", "seen"),
    "frame_pixels": f"SELECT match_id, frame_num, x, y, b, g, r FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_num, x, y ORDER BY b, g, r) AS nth FROM (SELECT {FRAME_PIXEL} FROM li, range(12) t(k))) WHERE nth = 1",
    "first_boxes": "SELECT match_id, track_id, min(frame_num) AS frame_num, " + ", ".join(f"greatest(trunc(arg_min({c}, frame_num)), 0) AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM tracks WHERE object = 'players' GROUP BY match_id, track_id",
    "heights": "SELECT match_id, frame_num, max(y) + 1 AS height FROM frame_pixels GROUP BY match_id, frame_num",
    "frame_top": """SELECT p.match_id, p.frame_num, track_id, CAST(x - x1 AS BIGINT) AS x, CAST(y - y1 AS BIGINT) AS y, b, g, r FROM frame_pixels p JOIN first_boxes q ON p.match_id = q.match_id AND p.frame_num = q.frame_num
        JOIN heights h ON p.match_id = h.match_id AND p.frame_num = h.frame_num WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y1 + floor((least(y2, height) - y1) / 2)""",
    **_colours("f_", "frame_top", "match_id", "frame_num", "track_id"),
    **_teams("f_", "f_colours"),
    "f_player_team": "SELECT match_id, track_id, CASE WHEN match_id = 0 AND track_id = 3 THEN 1 ELSE team END AS team FROM f_by_colour",
    "f_colour": "SELECT p.match_id, p.track_id, p.team, [t.b, t.g, t.r] AS team_color FROM f_player_team p LEFT JOIN f_teams t ON p.match_id = t.match_id AND p.team = t.team",
    "corners": """SELECT match_id, frame_num, old_x AS x, old_y AS y, l_extendedprice AS quality FROM features JOIN li USING (match_id, frame_num) WHERE feature_id = det_index
        AND (old_x >= 0 AND old_x < 20 OR old_x >= 900 AND old_x < 1050)""",
    "good_corners": """SELECT match_id, frame_num, row_number() OVER (PARTITION BY match_id, frame_num ORDER BY quality DESC, x, y) AS k, {'o': -quality, 'x': x, 'y': y} AS p
        FROM (SELECT *, max(quality) OVER (PARTITION BY match_id, frame_num) AS best FROM corners) WHERE quality >= 0.3e0 * best""",
    "choosing": """SELECT match_id, frame_num, k, [p] AS taken FROM good_corners WHERE k = 1
        UNION ALL SELECT c.match_id, c.frame_num, c.k, CASE WHEN len(taken) < 100 AND len(list_filter(taken, lambda q: (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) < 9)) = 0 THEN list_append(taken, p) ELSE taken END
        FROM choosing s JOIN good_corners c ON s.match_id = c.match_id AND s.frame_num = c.frame_num AND c.k = s.k + 1""",
    "links": _links("dense"),
    "unnamed": f"SELECT *, CASE class_name WHEN 'player' THEN 'players' ELSE 'referees' END AS object FROM (SELECT {UNNAMED} FROM li)",
    "own_links": _links("unnamed", "coalesce(n.track_id = p.track_id, true)"),
    "own_chain": """SELECT match_id, object, frame_num, det_index, track_id, frame_num AS hf, det_index AS hi FROM unnamed d ANTI JOIN own_links l USING (match_id, object, frame_num, det_index)
        UNION ALL SELECT d.match_id, d.object, d.frame_num, d.det_index, d.track_id, hf, hi FROM own_chain c JOIN own_links l ON l.match_id = c.match_id AND l.object = c.object AND l.frame_num = c.frame_num + 1 AND l.p_index = c.det_index
        JOIN unnamed d ON d.match_id = l.match_id AND d.frame_num = l.frame_num AND d.det_index = l.det_index""",
    "nearest_ids": f"""SELECT *, last_value({_GIVEN} IGNORE NULLS) OVER (chained ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value({_GIVEN} IGNORE NULLS) OVER (chained ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
        FROM own_chain WINDOW chained AS (PARTITION BY match_id, object, hf, hi ORDER BY frame_num)""",
    "claims": "SELECT *, abs(frame_num - source.f) AS away FROM (SELECT *, coalesce(before, after) AS source FROM nearest_ids)",
    "granted": """SELECT c.*, CASE WHEN track_id IS NOT NULL THEN track_id WHEN NOT EXISTS (SELECT 1 FROM claims o WHERE o.match_id = c.match_id AND o.object = c.object AND o.frame_num = c.frame_num
        AND (o.track_id = c.source.t OR o.track_id IS NULL AND o.source.t = c.source.t AND (o.away, o.det_index) < (c.away, c.det_index))) THEN c.source.t END AS found FROM claims c""",
    "numbers": """SELECT match_id, object, hf, hi, row_number() OVER (PARTITION BY match_id ORDER BY object, hf, hi) + (SELECT max(track_id) FROM unnamed u WHERE u.match_id = g.match_id) AS own
        FROM (SELECT DISTINCT match_id, object, hf, hi FROM granted WHERE found IS NULL) g""",
    "renamed": "SELECT u.* REPLACE (coalesce(found, own) AS track_id) FROM unnamed u JOIN granted USING (match_id, object, frame_num, det_index) LEFT JOIN numbers USING (match_id, object, hf, hi)",
}
#: The chain from positions to speeds once more, over positions by each match's calibration.
_CHAIN = ("world", "spots", "windows", "cumulative", "sped", "flagged")
RELATIONS |= {f"{n}_by_match": re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"\1_by_match", RELATIONS[n]) for n in _CHAIN[1:]}
RELATIONS |= {
    "analyzed": """SELECT f.*, p.team, p.team_color FROM flagged_by_match f LEFT JOIN f_colour p ON f.object = 'players' AND f.match_id = p.match_id AND f.track_id = p.track_id WHERE f.object <> 'balls'
        UNION ALL BY NAME SELECT *, false AS has_ball FROM filled""",
    "f_carried": RELATIONS["carried"].replace("player_team", "f_player_team"),
    "f_shares": RELATIONS["shares"].replace("FROM carried", "FROM f_carried"),
    "painted": """SELECT f.*, p.team_color FROM flagged f LEFT JOIN f_colour p ON f.object = 'players' AND f.match_id = p.match_id AND f.track_id = p.track_id""",
}


def sql(select: str) -> str:
    """The select with the relations that it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\w+", text)) & RELATIONS.keys():
            if name not in needed:
                needed.add(name)
                visit(RELATIONS[name])

    visit(select)
    kept = lambda n: "MATERIALIZED " if "means" in n and not n.endswith("_walk") else ""
    parts = [f"{n} AS {kept(n)}({RELATIONS[n]})" for n in RELATIONS if n in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _two_digits(x: str) -> str:
    """As the other engine writes a number: its shortest decimal form, rounded half up."""
    return f"CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 15)), 2) AS DECIMAL(20, 2)) AS VARCHAR)"


_colour = "[0e0, 0e0, 255e0]", "[0e0, 255e0, 255e0]", "[0e0, 255e0, 0e0]"
OWN_COLOUR = f"CASE object WHEN 'players' THEN coalesce(list_transform(team_color, lambda c: round(c, 6)), {_colour[0]}) WHEN 'referees' THEN {_colour[1]} ELSE {_colour[2]} END"
SHAPES = f"""
    SELECT match_id, frame_num, 1 AS z, 'ellipse' AS shape, track_id, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS x, CAST(trunc(y2) AS BIGINT) AS y, NULL AS text, {OWN_COLOUR} AS color FROM analyzed WHERE object IN ('players', 'referees')
    UNION ALL SELECT match_id, frame_num, 2, 'badge', track_id, CAST(trunc((x1 + x2) / 2) AS BIGINT) - 8 - CASE WHEN track_id > 99 THEN 10 ELSE 0 END, CAST(trunc(y2) AS BIGINT) + 20, CAST(track_id AS VARCHAR), {OWN_COLOUR} FROM analyzed WHERE object = 'players'
    UNION ALL SELECT match_id, frame_num, 3, 'triangle', track_id, CAST(trunc((x1 + x2) / 2) AS BIGINT), CAST(trunc(y1) AS BIGINT), NULL, {_colour[1]} FROM analyzed WHERE object = 'players' AND has_ball
    UNION ALL SELECT match_id, frame_num, 3, 'triangle', track_id, CAST(trunc((x1 + x2) / 2) AS BIGINT), CAST(trunc(y1) AS BIGINT), NULL, {_colour[2]} FROM analyzed WHERE object = 'balls' AND x1 IS NOT NULL
    UNION ALL SELECT match_id, frame_num, 4, 'possession', NULL, 1400, 850 + 50 * k, 'Team ' || k || ' Ball Control: ' || {_two_digits("CASE k WHEN 1 THEN share_1 ELSE share_2 END * 100")} || '%', NULL FROM f_shares, (VALUES (1), (2)) v(k) WHERE share_1 IS NOT NULL
    UNION ALL SELECT match_id, frame_num, 5, 'camera', NULL, 10, 30, 'Camera Movement: (' || {_two_digits("dx")} || ', ' || {_two_digits("dy")} || ')', NULL FROM camera
    UNION ALL SELECT match_id, frame_num, 6, 'speed', track_id, CAST(trunc((x1 + x2) / 2) AS BIGINT), CAST(trunc(y2) AS BIGINT) + dy, CASE dy WHEN 40 THEN {_two_digits("speed_kmh")} || ' km/h' ELSE {_two_digits("distance_m")} || ' m' END, NULL FROM analyzed, (VALUES (40), (60)) v(dy) WHERE object = 'players' AND speed_kmh IS NOT NULL AND distance_m IS NOT NULL
"""
SHAPE_ROWS = f"SELECT match_id, frame_num, CAST(z AS BIGINT) AS z, shape, track_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, text, color FROM ({SHAPES})"

_track = "match_id, frame_num, object, track_id, det_index, first_index, x1, y1, x2, y2"
_kinds = "match_id, object, track_id"

SELECTS: dict[str, str] = {
    "s1_s2_tracks_saved": f"SELECT {_track} FROM tracks",
    "s3_s4_camera_saved": "SELECT match_id, frame_num, dx, dy FROM camera",
    "s5_frame_spine": "SELECT match_id, frame_num FROM frames",
    "s6_image_pixels": "SELECT crop_id, x, y, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r FROM (SELECT crop_id, unnest(generate_series(0, max(x))) AS x FROM pixels GROUP BY crop_id) "
    "JOIN (SELECT crop_id, unnest(generate_series(0, max(y))) AS y FROM pixels GROUP BY crop_id) USING (crop_id) LEFT JOIN pixels USING (crop_id, x, y)",
    "s7_score_detections": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 4) AS energy FROM embeddings",
    "p1_box_centre": f"SELECT {TRACK}, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS cx, CAST(trunc((y1 + y2) / 2) AS BIGINT) AS cy FROM tracks",
    "p2_box_foot": f"SELECT {TRACK}, pos_x AS fx, pos_y AS fy FROM positioned",
    "p3_box_width": f"SELECT {TRACK}, x2 - x1 AS width FROM tracks",
    "p4_distance": "SELECT match_id, frame_num, feature_id, round(d, 6) AS d FROM moves",
    "p5_delta": "SELECT match_id, frame_num, feature_id, dx, dy FROM moves",
    "p6_positions": f"SELECT {TRACK}, pos_x, pos_y FROM positioned",
    "p7_adjusted_positions": f"SELECT {TRACK}, adj_x, adj_y FROM adjusted",
    "p8_project": f"SELECT {TRACK}, {r6('u', 'v')} FROM projected",
    "p9_calibrations": "SELECT calibration_id, list_transform(list_zip(h, [1e3, 1e3, 1e0, 1e3, 1e3, 1e0, 1e6, 1e6, 1e0]), lambda v: round(v[1] * v[2], 3)) AS h FROM calibrations",
    "p9_world_by_calibration": f"SELECT {TRACK}, {r6('world_x', 'world_y')} FROM world_by_match",
    "p10_world_by_match": f"SELECT {TRACK}, {r6('world_x', 'world_y')} FROM world_by_match",
    "f3_inside_calibration": f"SELECT {TRACK} FROM adjusted WHERE {_inside('trunc(adj_x) - match_id % 25', 'adj_y')}",
    "f10_frame_crops": "SELECT match_id, frame_num, track_id, x, y, b, g, r FROM frame_top",
    "a9_colours_from_frames": f"SELECT match_id, frame_num, track_id, {r6('b', 'g', 'r')} FROM f_colours",
    "c6_teams_from_frames": "SELECT match_id, track_id, team, list_transform(team_color, lambda c: round(c, 6)) AS team_color FROM f_colour",
    "p10_world_positions": f"SELECT {TRACK}, {r6('world_x', 'world_y')} FROM world",
    "p11_kmh": f"SELECT {_kinds}, start, round(speed_kmh, 6) AS speed_kmh FROM windows",
    "p12_relabel": "SELECT match_id, frame_num, det_index, CASE class_name WHEN 'goalkeeper' THEN 'player' ELSE class_name END AS class_name FROM detections",
    "p13_class_names": "SELECT match_id, frame_num, det_index, CAST(CASE class_name WHEN 'ball' THEN 0 WHEN 'goalkeeper' THEN 1 WHEN 'player' THEN 2 ELSE 3 END AS BIGINT) AS class_id, class_name FROM detections",
    "f1_confident": "SELECT match_id, frame_num, det_index, confidence FROM sure",
    "f2_objects": "SELECT match_id, frame_num, det_index, object, track_id FROM objects",
    "f3_inside_pitch": f"SELECT {TRACK} FROM projected WHERE inside",
    "f4_feature_mask": "SELECT match_id, frame_num, feature_id FROM masked",
    "f5_movement_threshold": "SELECT match_id, frame_num, CASE WHEN d > 5 THEN dx ELSE 0e0 END AS dx, CASE WHEN d > 5 THEN dy ELSE 0e0 END AS dy FROM dominant",
    "f6_ball_radius": "SELECT match_id, frame_num, track_id, round(d, 6) AS d FROM distances WHERE d < 70",
    "f7_no_speed_objects": f"SELECT {TRACK} FROM tracks WHERE object <> 'balls'",
    "f8_labelled_rows": f"SELECT {TRACK} FROM sped WHERE object = 'players' AND speed_kmh IS NOT NULL AND distance_m IS NOT NULL",
    "f9_valid_windows": f"SELECT {_kinds}, start, last FROM windows",
    "f10_crop_top_half": "SELECT crop_id, x, y, b, g, r FROM top",
    "f10_box_crop": "SELECT crop_id, x, y, b, g, r FROM cut_top",
    "j1_tracks_camera": f"SELECT t.match_id, t.frame_num, object, track_id, dx, dy FROM tracks t JOIN camera c ON t.match_id = c.match_id AND t.frame_num = c.frame_num",
    "j2_frames_movement": "SELECT f.match_id, f.frame_num, coalesce(dx, 0e0) AS dx, coalesce(dy, 0e0) AS dy FROM frames f LEFT JOIN dominant m ON f.match_id = m.match_id AND f.frame_num = m.frame_num",
    "j3_window_ends": f"SELECT {_kinds}, start, last, round(metres, 6) AS metres FROM windows",
    "j4_windows_onto_frames": f"SELECT {TRACK}, {r6('speed_kmh', 'distance_m')} FROM sped",
    "j5_players_ball": "SELECT match_id, frame_num, track_id, round(d, 6) AS d FROM distances",
    "j6_player_team": "SELECT t.match_id, t.frame_num, t.object, t.track_id, p.team FROM tracks t LEFT JOIN player_team p ON t.object = 'players' AND t.match_id = p.match_id AND t.track_id = p.track_id",
    "j7_team_colour": "SELECT c.match_id, c.track_id, c.team, [round(t.b, 6), round(t.g, 6), round(t.r, 6)] AS team_color FROM by_colour c LEFT JOIN teams t ON c.match_id = t.match_id AND c.team = t.team",
    "j8_overrides": "SELECT match_id, track_id, CASE WHEN match_id = 0 AND track_id = 3 THEN 1 ELSE team END AS team FROM player_team",
    "j9_has_ball": f"SELECT {TRACK}, has_ball FROM flagged",
    "j10_link": """, chain AS (SELECT match_id, frame_num, det_index, frame_num AS hf, det_index AS hi FROM dense d WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.match_id = d.match_id AND l.frame_num = d.frame_num AND l.det_index = d.det_index)
        UNION ALL SELECT l.match_id, l.frame_num, l.det_index, hf, hi FROM chain c JOIN links l ON l.match_id = c.match_id AND l.frame_num = c.frame_num + 1 AND l.p_index = c.det_index)
        SELECT match_id, frame_num, det_index, CAST(dense_rank() OVER (PARTITION BY match_id ORDER BY hf, hi) AS BIGINT) AS track_id FROM chain""",
    "a1_dominant_movement": "SELECT match_id, frame_num, dx, dy, round(d, 6) AS d FROM dominant",
    "a2_nearest_player": "SELECT match_id, frame_num, player_id, round(d, 6) AS d FROM holders",
    "a3_corner_reach": "SELECT match_id, frame_num, track_id, first_index, round(d, 6) AS d FROM distances",
    "a4_keep_last": f"SELECT {_track} FROM tracks",
    "a5_total_distance": f"SELECT {_kinds}, round(sum(metres), 6) AS total_m, count(*) AS n_windows FROM windows GROUP BY {_kinds}",
    "a6_match_share": "SELECT match_id, frames_1, frames_2, frames_1 / nullif(frames_1 + frames_2, 0) AS share_1, frames_2 / nullif(frames_1 + frames_2, 0) AS share_2 FROM (SELECT match_id, count(*) FILTER (team = 1) AS frames_1, count(*) FILTER (team = 2) AS frames_2 FROM carried GROUP BY match_id)",
    "a7_corner_vote": "SELECT crop_id, CAST(player_cluster AS INT) AS player_cluster FROM votes",
    "a8_crop_two_means": "SELECT crop_id, " + r6(*(f"c{k}_{c}" for k in (0, 1) for c in "bgr")) + " FROM means",
    "a9_jersey_colours": f"SELECT crop_id, {r6('b', 'g', 'r')} FROM colours",
    "a10_team_colours": f"SELECT match_id, team, {r6('b', 'g', 'r')} FROM teams",
    "a11_predicted_team": "SELECT match_id, track_id, team FROM by_colour",
    "a12_frame_counts": "SELECT match_id, n_frames FROM counts",
    "w1_interpolate_ball": f"SELECT match_id, frame_num, {r6('x1', 'y1', 'x2', 'y2')} FROM filled",
    "w2_cumulative_distance": f"SELECT {_kinds}, start, round(distance_m, 6) AS distance_m FROM cumulative",
    "w3_carry_possession": "SELECT match_id, frame_num, player_id, team FROM carried",
    "w4_running_share": f"SELECT match_id, frame_num, {r6('share_1', 'share_2')} FROM shares",
    "w5_first_seen_colour": f"SELECT match_id, track_id, {r6('b', 'g', 'r')} FROM first_colours",
    "w6_frame_windows": "SELECT match_id, frame_num, CAST(floor(frame_num / 5) * 5 AS BIGINT) AS start, least(floor(frame_num / 5) * 5 + 5, n_frames - 1)::BIGINT AS last FROM frames JOIN counts USING (match_id)",
    "w7_detection_ordinal": "SELECT match_id, frame_num, CAST(row_number() OVER (PARTITION BY match_id, frame_num ORDER BY class_name, x1, y1, x2, y2, confidence, track_id NULLS FIRST) - 1 AS BIGINT) AS det_index, class_name, x1, y1 FROM detections",
    "t1_last_ball": "SELECT match_id, frame_num, det_index, x1, y1, x2, y2 FROM balls",
    "t3_drawing_order": SHAPE_ROWS,
    "t2_select_corners": "SELECT match_id, frame_num, p.x AS x, p.y AS y, -p.o AS quality FROM (SELECT match_id, frame_num, unnest(taken) AS p FROM (SELECT match_id, frame_num, arg_max(taken, k) AS taken FROM choosing GROUP BY match_id, frame_num))",
    "u1_objects_together": f"SELECT object, count(*) AS n, count(DISTINCT (match_id, track_id)) AS n_tracks FROM tracks GROUP BY object",
    "u2_replace_balls": f"SELECT {TRACK}, {r6('x1', 'y1', 'x2', 'y2')}, det_index FROM tracks WHERE object <> 'balls' UNION ALL SELECT {TRACK}, {r6('x1', 'y1', 'x2', 'y2')}, NULL FROM filled",
    "u3_shapes_together": SHAPE_ROWS,
    "o1_possession_captions": "SELECT match_id, frame_num, CAST(k AS INT) AS team, CAST(1400 AS BIGINT) AS x, CAST(850 + 50 * k AS BIGINT) AS y, round(CASE k WHEN 1 THEN share_1 ELSE share_2 END * 100, 6) AS value, 'Team ' || k || ' Ball Control: ' || " + _two_digits("CASE k WHEN 1 THEN share_1 ELSE share_2 END * 100") + " || '%' AS text FROM shares, (VALUES (1), (2)) v(k) WHERE share_1 IS NOT NULL",
    "o2_speed_labels": "SELECT match_id, frame_num, track_id, kind, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS x, CAST(trunc(y2) AS BIGINT) + dy AS y, round(CASE kind WHEN 'speed' THEN speed_kmh ELSE distance_m END, 6) AS value, " + _two_digits("CASE kind WHEN 'speed' THEN speed_kmh ELSE distance_m END") + " || CASE kind WHEN 'speed' THEN ' km/h' ELSE ' m' END AS text FROM sped, (VALUES ('speed', 40), ('distance', 60)) v(kind, dy) WHERE object = 'players' AND speed_kmh IS NOT NULL",
    "o3_camera_captions": "SELECT match_id, frame_num, CAST(10 AS BIGINT) AS x, CAST(30 AS BIGINT) AS y, dx, dy, 'Camera Movement: (' || " + _two_digits("dx") + " || ', ' || " + _two_digits("dy") + " || ')' AS text FROM camera",
    "o4_ellipses": f"SELECT {TRACK}, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS cx, CAST(trunc(y2) AS BIGINT) AS cy, CAST(trunc(x2 - x1) AS BIGINT) AS axis_x, CAST(trunc((x2 - x1) * 0.35e0) AS BIGINT) AS axis_y, CAST(-45 AS BIGINT) AS start_angle, CAST(225 AS BIGINT) AS end_angle, {OWN_COLOUR} AS color FROM painted WHERE object <> 'balls'",
    "o5_badges": f"SELECT match_id, frame_num, track_id, cx - 20 AS \"left\", cy + 5 AS top, cx + 20 AS \"right\", cy + 25 AS bottom, cx - 8 - CASE WHEN track_id > 99 THEN 10 ELSE 0 END AS text_x, cy + 20 AS text_y, CAST(track_id AS VARCHAR) AS text, {OWN_COLOUR} AS color FROM (SELECT *, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS cx, CAST(trunc(y2) AS BIGINT) AS cy FROM painted) WHERE object = 'players'",
    "o6_triangles": f"SELECT match_id, frame_num, object, track_id, cx AS tip_x, cy AS tip_y, cx - 10 AS left_x, cx + 10 AS right_x, cy - 20 AS top_y, CASE object WHEN 'balls' THEN {_colour[2]} ELSE {_colour[1]} END AS color FROM (SELECT match_id, frame_num, object, track_id, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS cx, CAST(trunc(y1) AS BIGINT) AS cy FROM flagged WHERE object = 'balls' OR has_ball)",
    "o7_colours": f"SELECT {TRACK}, {OWN_COLOUR} AS color FROM painted",
    "c1_build_tracks": f"SELECT {_track} FROM tracks",
    "c1_tracks_without_ids": f"""SELECT {TRACK}, max(det_index) AS det_index, min(det_index) AS first_index,
        arg_max(x1, det_index) AS x1, arg_max(y1, det_index) AS y1, arg_max(x2, det_index) AS x2, arg_max(y2, det_index) AS y2 FROM renamed GROUP BY {TRACK}""",
    "c2_camera_motion": "SELECT match_id, frame_num, dx, dy FROM camera",
    "c3_to_pitch": f"SELECT {TRACK}, pos_x, pos_y, adj_x, adj_y, {r6('world_x', 'world_y')} FROM world",
    "c4_interpolate_ball": f"SELECT {TRACK}, {r6('x1', 'y1', 'x2', 'y2')} FROM tracks WHERE object <> 'balls' UNION ALL SELECT {TRACK}, {r6('x1', 'y1', 'x2', 'y2')} FROM filled",
    "c5_speed_distance": f"SELECT {TRACK}, {r6('speed_kmh', 'distance_m')} FROM sped",
    "c6_assign_teams": "SELECT c.match_id, c.track_id, CASE WHEN c.match_id = 0 AND c.track_id = 3 THEN 1 ELSE c.team END AS team FROM by_colour c",
    "c7_possession": f"SELECT match_id, frame_num, player_id, team, {r6('share_1', 'share_2')} FROM shares",
    "c8_overlays": SHAPE_ROWS,
    "c9_analyze_matches": f"SELECT {TRACK}, {r6('x1', 'y1', 'x2', 'y2', 'world_x', 'world_y', 'speed_kmh', 'distance_m')}, has_ball, team FROM analyzed",
}

STREAMS = {
    "x1_stream_speed": f"SELECT {_kinds}, start, {r6('metres', 'speed_kmh')} FROM windows",
    "x2_stream_distance": f"SELECT {_kinds}, round(sum(metres), 6) AS total_m FROM windows GROUP BY {_kinds}",
    "x3_stream_possession": f"SELECT match_id, frame_num, team, {r6('share_1', 'share_2')} FROM shares",
    "x4_stream_first_team": "SELECT match_id, track_id, CAST(arg_min(first_index, frame_num) % 2 + 1 AS INT) AS team, min(frame_num) AS frame_num FROM tracks WHERE object = 'players' GROUP BY match_id, track_id",
}


def _with_chain(select: str) -> str:
    """A select that begins with a recursive relation of its own."""
    whole = sql("SELECT * FROM links, dense")
    return whole[: whole.rindex(" SELECT * FROM links, dense")] + select


ORACLE_SQL = {n: _with_chain(s) if s.startswith(", chain") else sql(s) for n, s in (SELECTS | STREAMS).items()}
