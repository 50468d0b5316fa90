"""DuckDB twins of the queries, in long form: a row per frame, dimension or pair, joins and windows instead of arrays."""

from __future__ import annotations

import math
import re

from .operators.similarity import checkerboard

EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1e6 AS t, CAST(value AS DOUBLE) AS value,
  event_type, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k,
  [CAST(value AS DOUBLE)] || [CASE WHEN event_type = x THEN 1.0::DOUBLE ELSE 0 END for x in ['click', 'error', 'purchase', 'signup', 'view']] || [coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)] AS vec FROM events),
sz AS (SELECT track_id, count(*) AS n FROM ev GROUP BY track_id),
fr AS (SELECT track_id, i, unnest(range(7)) AS d, unnest(vec) AS v FROM ev)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def reflect(k: str, n: str) -> str:
    r = f"((({k}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"(CASE WHEN {r} < {n} THEN {r} ELSE 2 * {n} - 1 - {r} END)"


def med(name: str, source: str, size: int, keys: str = "track_id, d") -> str:
    """name(keys, i, v): running upper median over reflected places."""
    low, high = -(size // 2), size - size // 2 - 1
    on = " AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"{name} AS (SELECT {ks}, a.i, list_sort(list(b.v))[{size // 2} + 1] AS v FROM {source} a JOIN sz ON sz.track_id = a.track_id CROSS JOIN range({low}, {high + 1}) o(o) JOIN {source} b ON {on} AND b.i = {reflect('a.i + o.o', 'sz.n')} GROUP BY {ks}, a.i)"


def gauss(name: str, source: str, sigma: float, keys: str = "track_id, d", n: str = "sz") -> str:
    radius = int(4 * sigma + 0.5)
    on = " AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    whole = f"(SELECT sum(exp(-0.5 * (q / {sigma}) ** 2)) FROM range({-radius}, {radius + 1}) z(q))"
    return f"{name} AS (SELECT {ks}, a.i, sum(b.v * exp(-0.5 * (o.o / {sigma}) ** 2)) / {whole} AS v FROM {source} a JOIN {n} s ON s.track_id = a.track_id CROSS JOIN range({-radius}, {radius + 1}) o(o) JOIN {source} b ON {on} AND b.i = {reflect('a.i + o.o', 's.n')} GROUP BY {ks}, a.i)"


def matrix(source: str) -> str:
    return f"SELECT track_id, CAST(i AS BIGINT) AS i, CAST(d AS BIGINT) AS d, round(v, 6) AS v FROM {source}"


def line(source: str) -> str:
    return f"SELECT track_id, CAST(i AS BIGINT) AS i, round(CAST(v AS DOUBLE), 6) AS v FROM {source}"


MM = "mm AS (SELECT track_id, i, d, s / max(s) OVER (PARTITION BY track_id, d) AS v FROM (SELECT track_id, i, d, v + (0.001 - min(v) OVER (PARTITION BY track_id)) AS s FROM fr))"
INF = "inf AS (SELECT track_id, i, d, CASE WHEN m = 0 THEN v ELSE v / m END AS v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY track_id, i) AS m FROM fr))"
L2 = "l2 AS (SELECT track_id, i, d, CASE WHEN m = 0 THEN 1e-10 ELSE v / m END AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY track_id, i)) AS m FROM fr))"


def successive(source: str) -> list[str]:
    return [
        f"sd AS (SELECT a.track_id, a.i, sqrt(sum((a.v - b.v) ** 2)) AS v FROM {source} a JOIN {source} b ON a.track_id = b.track_id AND a.d = b.d AND b.i = a.i + 1 GROUP BY a.track_id, a.i)",
        "s0 AS (SELECT e.track_id, e.i, coalesce(sd.v, 0) AS v FROM ev e LEFT JOIN sd USING (track_id, i))",
        "nc AS (SELECT track_id, i, v / nullif(max(v) OVER (PARTITION BY track_id), 0) AS v FROM (SELECT track_id, i, v + abs(min(v) OVER (PARTITION BY track_id)) AS v FROM s0))",
    ]


def threshold(curve: str, size: int, share: float, base: str | None = None) -> list[str]:
    return [med("md", curve, size, "track_id"), f"av AS (SELECT track_id, avg(v) AS m FROM {base or curve} GROUP BY track_id)", f"th AS (SELECT track_id, i, v + m * {share} AS v FROM md JOIN av USING (track_id))"]


def peak(curve: str) -> str:
    return f"pk AS (SELECT track_id, i FROM (SELECT c.track_id, c.i, c.v, th.v AS t, lag(c.v) OVER w AS b, lead(c.v) OVER w AS a FROM {curve} c JOIN th USING (track_id, i) WINDOW w AS (PARTITION BY c.track_id ORDER BY c.i)) WHERE b < v AND v > a AND v > t)"


ENDS = "bd AS (SELECT track_id, CAST(i AS BIGINT) AS frame FROM pk UNION SELECT track_id, 0 FROM sz UNION SELECT track_id, CAST(n - 1 AS BIGINT) FROM sz)"
BOUNDS = "SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS BIGINT) AS k, frame FROM bd"
PLAIN = [EV, INF, *successive("inf"), *threshold("nc", 8, 0.05), peak("nc"), ENDS]


def pairs_(source: str, value: str, name: str = "pr", where: str = "") -> str:
    return f"{name} AS (SELECT a.track_id, a.i, b.i AS j, {value} AS v FROM {source} a JOIN {source} b ON a.track_id = b.track_id AND a.d = b.d {where} GROUP BY a.track_id, a.i, b.i)"


UPPER = "SELECT track_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 6) AS v FROM {} WHERE i < j"


def standardised(source: str) -> str:
    return f"st AS (SELECT track_id, i, d, CASE WHEN s > 0 THEN v / s ELSE 0 END AS v FROM (SELECT *, stddev_samp(v) OVER (PARTITION BY track_id, d) AS s FROM {source}))"


SEUCLID = ["ds AS (SELECT a.track_id, a.i, b.i AS j, sqrt(sum((a.v - b.v) ** 2)) AS v FROM st a JOIN st b ON a.track_id = b.track_id AND a.d = b.d GROUP BY a.track_id, a.i, b.i)", "sm AS (SELECT track_id, i, j, CASE WHEN m > 0 THEN 1 - v / m ELSE 1 END AS v FROM (SELECT *, max(v) OVER (PARTITION BY track_id) AS m FROM ds))"]


def knn(source: str, k: str, width: int, mutual: bool, n: str = "sz") -> list[str]:
    out = [
        pairs_(source, "sqrt(sum((a.v - b.v) ** 2))", "kd", f"AND abs(a.i - b.i) >= {width}"),
        f"kn AS MATERIALIZED (SELECT track_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY track_id, i ORDER BY v, j) AS r FROM kd) JOIN {n} USING (track_id) WHERE r <= {k})",
    ]
    out.append("rc AS (SELECT a.track_id, a.i, a.j FROM kn a JOIN kn b ON a.track_id = b.track_id AND a.i = b.j AND a.j = b.i)" if mutual else "rc AS (SELECT * FROM kn)")
    return out


K = "floor(0.1 * n)"
LINKS = "SELECT track_id, CAST(i AS BIGINT) AS i, CAST({} AS BIGINT) AS j, 1.0::DOUBLE AS v FROM {}"
KERNEL = checkerboard(16)
KERNEL_SQL = "ck AS (SELECT r, c, exp(-0.5 * ((r - 7.5) / 5.0) ** 2) * exp(-0.5 * ((c - 7.5) / 5.0) ** 2) * CASE WHEN (r < 8) <> (c < 8) THEN -1 ELSE 1 END AS g FROM range(16) x(r), range(16) y(c))"
NOVELTY = [
    KERNEL_SQL,
    "cv AS (SELECT e.track_id, e.i, coalesce(sum(s.v * g), 0) AS v FROM ev e JOIN sz USING (track_id) LEFT JOIN ck ON e.i >= 8 AND e.i <= n - 8 LEFT JOIN sm s ON s.track_id = e.track_id AND s.i = e.i - 8 + r AND s.j = e.i - 8 + c GROUP BY e.track_id, e.i)",
    "cn AS (SELECT track_id, i, CASE WHEN m = 0 THEN 0 ELSE v / m END AS v FROM (SELECT track_id, i, v, max(v) OVER (PARTITION BY track_id) AS m FROM (SELECT track_id, i, v + min(v) OVER (PARTITION BY track_id) AS v FROM cv)))",
]
PATH = [
    "ps AS (SELECT a.track_id, a.i, sum((a.v - b.v) ** 2) AS v FROM mm a JOIN mm b ON a.track_id = b.track_id AND a.d = b.d AND b.i = a.i + 1 GROUP BY a.track_id, a.i)",
    "pa AS (SELECT track_id, i, exp(-v / m) AS v FROM (SELECT *, median(v) OVER (PARTITION BY track_id) AS m FROM ps))",
]
DEGREES = [
    "dg AS (SELECT e.track_id, e.i, coalesce(a.v, 0) + coalesce(b.v, 0) AS p, (SELECT count(*) FROM rc WHERE rc.track_id = e.track_id AND rc.i = e.i)::DOUBLE AS r FROM ev e LEFT JOIN pa a ON a.track_id = e.track_id AND a.i = e.i - 1 LEFT JOIN pa b ON b.track_id = e.track_id AND b.i = e.i)",
]
DAY = "dy AS (SELECT track_id, i, n, t, floor(t / 86400) AS day, floor(t / 86400) <> lag(floor(t / 86400)) OVER (PARTITION BY track_id ORDER BY i) AS new FROM ev JOIN sz USING (track_id))"
DAYS = [DAY, "dc AS (SELECT track_id, i FROM dy WHERE new)", "db AS (SELECT track_id, CAST(i AS BIGINT) AS frame FROM dc UNION SELECT track_id, 0 FROM sz UNION SELECT track_id, CAST(n - 1 AS BIGINT) FROM sz)"]
REF = [
    *DAYS,
    "rs AS (SELECT track_id, seg, s, e, CAST(floor(ev.t / 86400) % 3 AS BIGINT) AS label FROM (SELECT track_id, row_number() OVER w - 1 AS seg, frame AS s, lead(frame) OVER w AS e FROM db WINDOW w AS (PARTITION BY track_id ORDER BY frame)) q JOIN ev USING (track_id) WHERE e IS NOT NULL AND ev.i = s)",
]
EST = [
    "es AS (SELECT track_id, seg, s, e, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS BIGINT) AS label FROM (SELECT track_id, row_number() OVER w - 1 AS seg, frame AS s, lead(frame) OVER w AS e FROM bd WINDOW w AS (PARTITION BY track_id ORDER BY frame)) q JOIN ev USING (track_id) WHERE e IS NOT NULL AND ev.i = s)",
]
SIDES = [*PLAIN, *REF, *EST]


def hits(window: float, trim: bool) -> list[str]:
    def cut(name, source):
        w = "WINDOW w AS (PARTITION BY track_id ORDER BY frame)"
        own = f"SELECT track_id, frame::DOUBLE AS x, row_number() OVER w AS k, count(*) OVER (PARTITION BY track_id) AS n FROM {source} {w}"
        return f"{name} AS (SELECT track_id, list(x ORDER BY x) FILTER (ok) AS x FROM (SELECT *, {'k > 1 AND k < n' if trim else 'true'} AS ok FROM ({own})) GROUP BY track_id)"

    return [
        cut("hr", "db"),
        cut("he", "bd"),
        "hb AS (SELECT track_id, coalesce(hr.x, []) AS r, coalesce(he.x, []) AS e FROM hr JOIN he USING (track_id))",
        # two pointers over sorted points
        f"tp AS (SELECT track_id, r, e, 1 AS a, 1 AS b, 0 AS m FROM hb UNION ALL SELECT track_id, r, e, a + CASE WHEN abs(r[a] - e[b]) <= {window} OR r[a] < e[b] THEN 1 ELSE 0 END, b + CASE WHEN abs(r[a] - e[b]) <= {window} OR r[a] >= e[b] THEN 1 ELSE 0 END, m + CASE WHEN abs(r[a] - e[b]) <= {window} THEN 1 ELSE 0 END FROM tp WHERE a <= len(r) AND b <= len(e))",
        "hm AS (SELECT track_id, CASE WHEN len(r) = 0 OR len(e) = 0 THEN 0 ELSE m / len(e) END AS p, CASE WHEN len(r) = 0 OR len(e) = 0 THEN 0 ELSE m / len(r) END AS q FROM (SELECT track_id, any_value(r) AS r, any_value(e) AS e, max(m)::DOUBLE AS m FROM tp GROUP BY track_id))",
        "hf AS (SELECT track_id, p, q, CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END AS f, CASE WHEN p + q = 0 THEN 0 ELSE (1 + 0.58 ** 2) * p * q / (0.58 ** 2 * p + q) END AS w FROM hm)",
    ]


def hit_sql(window: float, trim: bool, name: str) -> str:
    return with_(*SIDES, *hits(window, trim)) + f"SELECT track_id, round(p, 6) AS {name}P, round(q, 6) AS {name}R, round(f, 6) AS {name}F FROM hf"


LABELS = [
    # samples every tenth of a frame, times 10 as integers
    "sx AS (SELECT track_id, unnest(range(0, (n - 1) * 10)) AS x FROM sz)",
    "sy AS (SELECT sx.track_id, x, r.label AS r, e.label AS e FROM sx JOIN rs r ON r.track_id = sx.track_id AND x >= r.s * 10 AND x < r.e * 10 JOIN es e ON e.track_id = sx.track_id AND x >= e.s * 10 AND x < e.e * 10)",
    "cb AS (SELECT track_id, r, e, count(*)::DOUBLE AS n FROM sy GROUP BY track_id, r, e)",
    "ce AS (SELECT track_id, sum(n * (n - 1) / 2) AS two, sum(-n / t * log2(n / t)) AS h, count(*) AS k FROM (SELECT track_id, e, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY track_id) AS t FROM cb GROUP BY track_id, e) GROUP BY track_id)",
    "cr AS (SELECT track_id, sum(n * (n - 1) / 2) AS two, sum(-n / t * log2(n / t)) AS h, count(*) AS k FROM (SELECT track_id, r, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY track_id) AS t FROM cb GROUP BY track_id, r) GROUP BY track_id)",
    "cc AS (SELECT track_id, sum(n * (n - 1) / 2) AS two, sum(-n / t * log2(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY track_id) AS t FROM cb) GROUP BY track_id)",
    "ls AS (SELECT track_id, cc.two / nullif(ce.two, 0) AS p, cc.two / nullif(cr.two, 0) AS q, CASE WHEN ce.k <= 1 THEN 1 ELSE 1 - (cc.h - cr.h) / log2(ce.k) END AS so, CASE WHEN cr.k <= 1 THEN 1 ELSE 1 - (cc.h - ce.h) / log2(cr.k) END AS su FROM cc JOIN ce USING (track_id) JOIN cr USING (track_id))",
    "lf AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END AS pf, CASE WHEN so <= 0 AND su <= 0 THEN 0 ELSE 2 * so * su / (so + su) END AS sf FROM ls)",
]


def deviation(trim: bool, a: str, b: str) -> str:
    cut = lambda s: f"(SELECT track_id, frame FROM (SELECT track_id, frame, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS k, count(*) OVER (PARTITION BY track_id) AS n FROM {s}) WHERE {'k > 1 AND k < n' if trim else 'true'})"
    return f"(SELECT track_id, median(g) AS v FROM (SELECT x.track_id, x.frame, min(abs(x.frame - y.frame))::DOUBLE AS g FROM {cut(a)} x JOIN {cut(b)} y ON x.track_id = y.track_id GROUP BY x.track_id, x.frame) GROUP BY track_id)"


def gain(a: str, b: str) -> list[str]:
    """Entropy of the errors of b's points against a's."""
    n = f"{a}{b}"
    return [
        f"{n}p AS (SELECT track_id, frame AS x, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY track_id) AS c, frame - lag(frame) OVER w AS before, lead(frame) OVER w - frame AS after FROM {a} WINDOW w AS (PARTITION BY track_id ORDER BY frame))",
        f"{n}e AS (SELECT track_id, t, err / CASE WHEN k = c - 1 THEN before WHEN k > 0 AND err < 0 THEN before ELSE after END AS e FROM (SELECT q.track_id, q.frame AS t, p.*, (q.frame - p.x)::DOUBLE AS err, row_number() OVER (PARTITION BY q.track_id, q.frame ORDER BY abs(q.frame - p.x), p.k) AS r FROM {b} q JOIN {n}p p ON p.track_id = q.track_id) WHERE r = 1)",
        f"{n}w AS (SELECT track_id, -((((0.5 - e) % 1) + 1) % 1 - 0.5) AS e FROM {n}e)",
        f"{n}c AS (SELECT track_id, CASE WHEN h = l THEN 125 ELSE least(floor((e - l) / (h - l) * 251), 250) END AS cell FROM (SELECT *, min(e) OVER (PARTITION BY track_id) AS l, max(e) OVER (PARTITION BY track_id) AS h FROM {n}w))",
        f"{n}h AS (SELECT track_id, sum(-p * log2(p)) AS h FROM (SELECT track_id, count(*) / sum(count(*)) OVER (PARTITION BY track_id) AS p FROM {n}c GROUP BY track_id, cell) GROUP BY track_id)",
    ]


RUNS = "lr AS (SELECT 'embeddings' AS track_id, row_number() OVER (ORDER BY min(vec_id)) - 1 AS seg, min(p)::DOUBLE AS start, max(p)::DOUBLE + 1 AS \"end\", label::BIGINT AS label FROM (SELECT *, p - row_number() OVER (PARTITION BY label ORDER BY p) AS g FROM (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings)) GROUP BY label, g)"
CENTRES = "ct AS (SELECT label, list(m ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, k) GROUP BY label)"
DIST = "list_sum([({a}[z] - {b}[z]) * ({a}[z] - {b}[z]) for z in range(1, len({a}) + 1)])"


def delay() -> str:
    return with_(EV) + "SELECT track_id, CAST(i AS BIGINT) AS i, CAST(d AS BIGINT) AS d, round(v, 6) AS v FROM (SELECT a.track_id, a.i, b.d + 7 * (b.i - a.i) AS d, b.v FROM (SELECT track_id, i, n FROM ev JOIN sz USING (track_id) WHERE i < n - 3) a JOIN fr b ON b.track_id = a.track_id AND (b.i - a.i IN (0, 1) OR b.i - a.i = 2 AND b.d < 3))"


def sf_sql() -> str:
    """Embedding of 3, mutual neighbours, lag matrix, both smoothings, novelty and peaks."""
    parts = [
        EV,
        INF,
        "tk AS (SELECT track_id, n FROM sz WHERE n > 20)",
        "en AS (SELECT track_id, n - 3 AS n, n AS whole FROM tk)",
        "em AS (SELECT a.track_id, a.i, b.d + 7 * (b.i - a.i) AS d, b.v FROM (SELECT DISTINCT track_id, i, whole FROM inf JOIN en USING (track_id) WHERE i < whole - 3) a JOIN inf b ON b.track_id = a.track_id AND b.i - a.i BETWEEN 0 AND 2)",
        *knn("em", "floor(0.1 * whole)", 1, True, "en"),
        # row lag, column time
        "lg AS (SELECT e.track_id, l.x AS d, t.x AS i, CASE WHEN rc.i IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM en e, unnest(range(e.n)) l(x), unnest(range(e.n)) t(x) LEFT JOIN rc ON rc.track_id = e.track_id AND rc.i = (l.x + t.x) % e.n AND rc.j = t.x)",
        gauss("g1", "lg", 3.5, "track_id, d", "en"),
        "g1t AS (SELECT track_id, i AS d, d AS i, v FROM g1)",
        gauss("g2", "g1t", 0.5, "track_id, d", "en"),
        "sq AS (SELECT a.track_id, a.d AS i, sqrt(sum((a.v - b.v) ** 2)) AS v FROM g2 a JOIN g2 b ON a.track_id = b.track_id AND a.i = b.i AND b.d = a.d + 1 GROUP BY a.track_id, a.d)",
        "s0 AS (SELECT e.track_id, t.x AS i, coalesce(sq.v, 0) AS v FROM en e, unnest(range(e.n)) t(x) LEFT JOIN sq ON sq.track_id = e.track_id AND sq.i = t.x)",
        "nc AS (SELECT track_id, i, CASE WHEN m = 0 THEN 0 ELSE v / m END AS v FROM (SELECT *, max(v) OVER (PARTITION BY track_id) AS m FROM (SELECT track_id, i, v + abs(min(v) OVER (PARTITION BY track_id)) AS v FROM s0)))",
        med("md", "nc", 8, "track_id").replace("JOIN sz ON sz.track_id", "JOIN en sz ON sz.track_id"),
        "av AS (SELECT track_id, avg(v) AS m FROM nc GROUP BY track_id)",
        "th AS (SELECT track_id, i, v + m * 0.05 AS v FROM md JOIN av USING (track_id))",
        peak("nc"),
        "bd AS (SELECT track_id, CAST(i + 2 AS BIGINT) AS frame FROM pk UNION SELECT track_id, 0 FROM sz UNION SELECT track_id, CAST(n - 1 AS BIGINT) FROM sz)",
    ]
    return with_(*parts) + BOUNDS


COSINE = pairs_("l2", "sum(a.v * b.v)", "sm")
CBM = [
    EV,
    L2,
    COSINE,
    "sg AS (SELECT track_id, e.x AS fin, p.x AS p FROM sz, unnest(range(1, n)) e(x), unnest(range(1, least(32, e.x) + 1)) p(x))",
    "sb AS (SELECT g.track_id, fin, p, coalesce(sum(sm.v), 0) / (p * p) AS v FROM sg g LEFT JOIN sm ON sm.track_id = g.track_id AND sm.i >= fin - p AND sm.i < fin AND sm.j >= fin - p AND sm.j < fin AND sm.i <> sm.j AND abs(sm.i - sm.j) <= 7 GROUP BY g.track_id, fin, p)",
]


def cbm_sql() -> str:
    pen = "CASE WHEN p = 8 THEN 0 WHEN p % 4 = 0 THEN 0.25 WHEN p % 2 = 0 THEN 0.5 ELSE 1 END"
    return (
        with_(
            *CBM,
            "e8 AS (SELECT track_id, greatest(coalesce(max(v) FILTER (p = 8), 0), 0) AS top FROM sb GROUP BY track_id)",
            f"co AS (SELECT track_id, fin, list(v * p - {pen} * top ORDER BY p) AS c FROM sb JOIN e8 USING (track_id) GROUP BY track_id, fin)",
            # best[k + 1] is the best total that ends at frame k, frm[k + 1] its last segment's start
            "dp AS (SELECT track_id, n, 1 AS f, [0.0::DOUBLE] AS best, [0::BIGINT] AS frm FROM sz UNION ALL SELECT track_id, n, f + 1, best || [list_max(w)], frm || [f - list_max([q for q in range(1, len(w) + 1) if w[q] = list_max(w)])] FROM (SELECT dp.*, [best[f - q + 1] + c[q] for q in range(1, len(c) + 1)] AS w FROM dp JOIN co ON co.track_id = dp.track_id AND co.fin = dp.f WHERE dp.f < dp.n))",
            "ba AS (SELECT track_id, frm, CAST(n - 1 AS BIGINT) AS frame FROM dp WHERE f = n UNION ALL SELECT track_id, frm, frm[frame + 1] FROM ba WHERE frame > 0)",
            "bd AS (SELECT DISTINCT track_id, frame FROM ba)",
        )
        + BOUNDS
    )


def sweep() -> str:
    out = []
    for size in (4, 8):
        for share in (0.0, 0.1):
            out.append("SELECT * FROM (" + with_(EV, INF, *successive("inf"), *threshold("nc", size, share), peak("nc"), ENDS, *DAYS, *hits(3.0, False)) + f"SELECT CAST({size} AS BIGINT) AS size, CAST({share} AS DOUBLE) AS share, round(avg(f), 6) AS f FROM hf)")
    return " UNION ALL ".join(out)


TWINS = {
    "frames_from_events": with_(EV) + "SELECT track_id, CAST(i AS BIGINT) AS i, round(t, 6) AS t, round(value, 6) AS value, array_to_string([CASE WHEN event_type = x THEN '1' ELSE '0' END for x in ['click', 'error', 'purchase', 'signup', 'view']], '') AS types, k FROM ev",
    "frames_from_embeddings": "SELECT 'embeddings' AS track_id, CAST(i AS BIGINT) AS i, unnest(range(len(embedding)))::BIGINT AS d, round(unnest(embedding)::DOUBLE, 6) AS v FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings)",
    "norm_inf": with_(EV, INF) + matrix("inf"),
    "norm_l2": with_(EV, L2) + matrix("l2"),
    "norm_p1": with_(EV, "p1 AS (SELECT track_id, i, d, CASE WHEN m = 0 THEN v ELSE v / m END AS v FROM (SELECT *, sum(abs(v)) OVER (PARTITION BY track_id, i) AS m FROM fr))") + matrix("p1"),
    "norm_minmax": with_(EV, MM) + matrix("mm"),
    "norm_log": with_(EV, MM.replace("0.001", "0.1")) + "SELECT track_id, CAST(i AS BIGINT) AS i, CAST(d AS BIGINT) AS d, round(80 * log10(v), 6) AS v FROM mm",
    "log1p": with_(EV) + "SELECT track_id, CAST(i AS BIGINT) AS i, CAST(d AS BIGINT) AS d, round(ln(1 + v), 6) AS v FROM fr",
    "whiten_cols": with_(EV, "wh AS (SELECT track_id, i, d, CASE WHEN s = 0 THEN v ELSE v / s END AS v FROM (SELECT *, stddev_pop(v) OVER (PARTITION BY track_id, d) AS s FROM fr))") + matrix("wh"),
    "beat_sync_mean": with_(EV, *DAYS, "bg AS (SELECT track_id, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY i) AS g FROM dy)") + "SELECT track_id, CAST(g AS BIGINT) AS i, CAST(d AS BIGINT) AS d, round(avg(v), 6) AS v FROM fr JOIN bg USING (track_id, i) GROUP BY track_id, g, d",
    "delay_embedding": delay(),
    "stack_memory": with_(EV) + "SELECT track_id, CAST(i AS BIGINT) AS i, CAST(d AS BIGINT) AS d, round(v, 6) AS v FROM (SELECT track_id, i, d, v FROM fr UNION ALL SELECT track_id, i, d + 7, coalesce(lag(v) OVER (PARTITION BY track_id, d ORDER BY i), 0) FROM fr)",
    "median_filter": with_(EV, med("md", "fr", 12)) + matrix("md"),
    "gaussian_smooth": with_(EV, gauss("gs", "fr", 2.0)) + matrix("gs"),
    "novelty_successive": with_(EV, INF, *successive("inf")) + line("nc"),
    "adaptive_threshold": with_(EV, INF, *successive("inf"), *threshold("nc", 8, 0.05)) + line("th"),
    "peak_pick": with_(*PLAIN) + "SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY i) - 1 AS BIGINT) AS i, i::DOUBLE AS v FROM pk",
    "change_points": with_(EV, *DAYS) + "SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY i) - 1 AS BIGINT) AS i, i::DOUBLE AS v FROM dc",
    "ssm_seuclidean": with_(EV, standardised("fr"), *SEUCLID) + UPPER.format("sm"),
    "ssm_cosine": with_(EV, L2, COSINE) + UPPER.format("sm"),
    "ssm_covariance": with_(EV, "c0 AS (SELECT track_id, i, d, v - avg(v) OVER (PARTITION BY track_id, d) AS v FROM fr)", L2.replace("FROM fr", "FROM c0"), COSINE) + UPPER.format("sm"),
    "ssm_rbf": with_(EV, L2, pairs_("l2", "sqrt(sum((a.v - b.v) ** 2))", "ds"), "gm AS (SELECT track_id, 1 / (2 * stddev_pop(v)) AS g FROM ds WHERE i <> j GROUP BY track_id)", "sm AS (SELECT track_id, i, j, exp(-g * v * v) AS v FROM ds JOIN gm USING (track_id))") + UPPER.format("sm"),
    "recurrence_knn": with_(EV, *knn("fr", K, 3, False)) + LINKS.format("j", "rc"),
    "recurrence_mutual": with_(EV, *knn("fr", K, 1, True)) + LINKS.format("j", "rc"),
    "lag_matrix": with_(EV, *knn("fr", K, 1, True), "lm AS (SELECT track_id, (i - j + n) % n AS i, j FROM rc JOIN sz USING (track_id))") + LINKS.format("j", "lm"),
    "path_similarity": with_(EV, MM, *PATH) + line("pa"),
    "graph_degree": with_(EV, MM, *knn("mm", K, 1, True), *PATH, *DEGREES) + "SELECT track_id, CAST(i AS BIGINT) AS i, r AS v FROM dg",
    "balanced_affinity": with_(EV, MM, *knn("mm", K, 1, True), *PATH, *DEGREES) + "SELECT track_id, round(mu, 6) AS mu, round(mu * r + (1 - mu) * p, 6) AS total FROM (SELECT track_id, sum(p * (p + r)) / sum((p + r) ** 2) AS mu, sum(r) AS r, sum(p) AS p FROM dg GROUP BY track_id)",
    "checkerboard_novelty": with_(EV, MM, standardised("mm"), *SEUCLID, *NOVELTY) + line("cn"),
    "foote_boundaries": with_(EV, MM, med("md0", "mm", 4), standardised("md0"), *SEUCLID, *NOVELTY, gauss("gn", "cn", 4.0, "track_id"), *threshold("gn", 8, 0.05, "cn"), peak("gn"), ENDS) + BOUNDS,
    "sf_boundaries": sf_sql(),
    "cbm_segment_scores": with_(*CBM) + "SELECT track_id, CAST(fin AS BIGINT) AS \"end\", CAST(p AS BIGINT) AS n, round(v, 6) AS v FROM sb WHERE p <= 16",
    "cbm_penalty": "SELECT n, CASE WHEN n = 8 THEN 0.0 WHEN n % 4 = 0 THEN 0.25 WHEN n % 2 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS modulo8, CASE WHEN n % 4 = 0 THEN 0.0 WHEN n % 2 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS modulo4, CASE WHEN n = 8 THEN 0.0 WHEN n = 4 THEN 0.25 WHEN n % 2 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS modulo8modulo4, round(sqrt(abs(n - 8)), 6) AS target_deviation_8_alpha_half, abs(n - 8)::DOUBLE AS target_deviation_8_alpha_one, ((n - 8) * (n - 8))::DOUBLE AS target_deviation_8_alpha_two FROM range(1, 65) x(n)",
    "cbm_boundaries": cbm_sql(),
    "ground_truth_bounds": with_(EV, "nn AS (SELECT DISTINCT track_id, floor(t / 86400) * 86400 + 43200 AS t FROM ev)", "bd AS (SELECT q.track_id, coalesce((SELECT min(i) FROM ev WHERE ev.track_id = q.track_id AND ev.t >= q.t), (SELECT n - 1 FROM sz WHERE sz.track_id = q.track_id))::BIGINT AS frame FROM nn q UNION SELECT track_id, 0 FROM sz UNION SELECT track_id, CAST(n - 1 AS BIGINT) FROM sz)") + BOUNDS,
    "times_to_intervals": with_(RUNS) + "SELECT track_id, CAST(seg AS BIGINT) AS seg, start, \"end\" FROM lr",
    "intervals_to_times": with_(RUNS) + "SELECT track_id, start AS t FROM lr UNION ALL SELECT track_id, max(\"end\") FROM lr GROUP BY track_id",
    "drop_empty_segments": with_(RUNS) + "SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start) - 1 AS BIGINT) AS seg, start, \"end\", label FROM lr WHERE seg % 7 <> 3",
    "edge_silence": with_(RUNS, "al AS (SELECT track_id, start + 0.5 AS start, \"end\" + 0.5 AS \"end\", label FROM lr UNION ALL SELECT track_id, 0, 0.5, max(label) + 1 FROM lr GROUP BY track_id UNION ALL SELECT track_id, max(\"end\") + 0.5, 1e6, max(label) + 1 FROM lr GROUP BY track_id)") + "SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start) - 1 AS BIGINT) AS seg, start::DOUBLE AS start, \"end\"::DOUBLE AS \"end\", label FROM al",
    "align_times_asof": with_(EV, "nn AS (SELECT DISTINCT track_id, floor(t / 86400) * 86400 + 43200 AS t FROM ev)") + "SELECT q.track_id, round(q.t, 6) AS t, CAST(coalesce(e.i, n - 1) AS BIGINT) AS frame FROM nn q ASOF LEFT JOIN ev e ON q.track_id = e.track_id AND q.t <= e.t JOIN sz ON sz.track_id = q.track_id",
    "synchronize_labels": with_(*PLAIN, *DAYS, "ol AS (SELECT track_id, (row_number() OVER w - 1) % 5 AS label, frame AS s, lead(frame) OVER w AS e FROM db WINDOW w AS (PARTITION BY track_id ORDER BY frame))", "nb AS (SELECT track_id, row_number() OVER w - 1 AS k, frame AS s, lead(frame) OVER w AS e FROM bd WINDOW w AS (PARTITION BY track_id ORDER BY frame))", "fl AS (SELECT ev.track_id, ev.i, coalesce(ol.label, 0) AS label FROM ev LEFT JOIN ol ON ol.track_id = ev.track_id AND ev.i >= ol.s AND ev.i < ol.e)") + "SELECT nb.track_id, CAST(k AS BIGINT) AS i, round(median(label), 6) AS v FROM nb JOIN fl ON fl.track_id = nb.track_id AND fl.i >= nb.s AND fl.i < nb.e GROUP BY nb.track_id, k",
    "segment_mode": with_(*SIDES, "ct AS (SELECT es.track_id, seg, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS label, count(*) AS n FROM es JOIN ev ON ev.track_id = es.track_id AND ev.i >= s AND ev.i < e GROUP BY ALL)") + "SELECT track_id, CAST(seg AS BIGINT) AS seg, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY track_id, seg ORDER BY n DESC, label) AS r FROM ct) WHERE r = 1",
    "relabel_overlap_matrix": with_(*SIDES) + "SELECT es.track_id, es.label AS est_label, rs.label AS ref_label, round(sum(least(es.e, rs.e) - greatest(es.s, rs.s))::DOUBLE, 6) AS overlap FROM es JOIN rs ON es.track_id = rs.track_id AND es.s < rs.e AND rs.s < es.e GROUP BY ALL",
    "hit_rate_3s": hit_sql(3.0, False, "HitRate_3"),
    "hit_rate_half": hit_sql(0.5, False, "HitRate_0_5"),
    "hit_rate_trimmed": hit_sql(3.0, True, "HitRate_t3"),
    "hit_rate_weighted": with_(*SIDES, *hits(3.0, False)) + "SELECT track_id, round(w, 6) AS HitRate_w3F FROM hf",
    "median_deviation": with_(*SIDES) + f"SELECT track_id, round(a.v, 6) AS DevR2E, round(b.v, 6) AS DevE2R, round(c.v, 6) AS DevtR2E, round(d.v, 6) AS DevtE2R FROM (SELECT track_id FROM es INTERSECT SELECT track_id FROM rs) LEFT JOIN {deviation(False, 'db', 'bd')} a USING (track_id) LEFT JOIN {deviation(False, 'bd', 'db')} b USING (track_id) LEFT JOIN {deviation(True, 'db', 'bd')} c USING (track_id) LEFT JOIN {deviation(True, 'bd', 'db')} d USING (track_id)",
    "information_gain": with_(*SIDES, *gain("db", "bd"), *gain("bd", "db")) + f"SELECT a.track_id, round(({math.log2(251)!r} - greatest(a.h, b.h)) / {math.log2(251)!r}, 6) AS D FROM dbbdh a JOIN bddbh b USING (track_id)",
    "pairwise_scores": with_(*SIDES, *LABELS) + "SELECT track_id, round(p, 6) AS PWP, round(q, 6) AS PWR, round(pf, 6) AS PWF FROM lf",
    "nce_scores": with_(*SIDES, *LABELS) + "SELECT track_id, round(so, 6) AS So, round(su, 6) AS Su, round(sf, 6) AS Sf FROM lf",
    "results_mean": with_(*SIDES, *hits(3.0, False), *LABELS) + 'SELECT round(avg(hf.p), 6) AS "HitRate_3P", round(avg(hf.q), 6) AS "HitRate_3R", round(avg(f), 6) AS "HitRate_3F", round(avg(pf), 6) AS "PWF", round(avg(sf), 6) AS "Sf" FROM hf JOIN lf USING (track_id)',
    "results_cube": with_(*SIDES, *hits(3.0, False)) + "SELECT ds_name, kind, count(*) AS n, round(avg(f), 6) AS f FROM (SELECT 'd' || (CAST(track_id AS BIGINT) % 3) AS ds_name, CASE WHEN n - 1 >= 70 THEN 'long' ELSE 'short' END AS kind, f FROM hf JOIN sz USING (track_id)) GROUP BY CUBE (ds_name, kind)",
    "param_sweep": sweep(),
    "factor_distances": "WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), q AS (SELECT vec_id, unnest(v) AS x, unnest(w) AS y FROM p) SELECT vec_id, round(sqrt(sum((x - y) ** 2)), 6) AS l2, round(sum(abs(x - y)), 6) AS l1, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine, round(1 - abs(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))), 6) AS abs_cosine, round(sum(greatest(abs(x), 1e-12) * ln(greatest(abs(x), 1e-12) / greatest(abs(y), 1e-12)) - greatest(abs(x), 1e-12) + greatest(abs(y), 1e-12)), 6) AS kl FROM q GROUP BY vec_id",
    "vq_assign": with_(CENTRES) + f"SELECT vec_id, CAST(label AS BIGINT) AS centre, round(dist, 6) AS dist FROM (SELECT vec_id, ct.label, sqrt({DIST.format(a='e.v', b='ct.c')}) AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY {DIST.format(a='e.v', b='ct.c')}, ct.label) AS r FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e, ct) WHERE r = 1",
    "norm_sampling_probabilities": "WITH s AS (SELECT vec_id, list_sum([x * x for x in embedding::DOUBLE[]]) AS s FROM embeddings) SELECT vec_id, round(s / sum(s) OVER (), 6) AS p FROM s",
    "cmeans_membership": with_(CENTRES) + f"SELECT vec_id, CAST(label AS BIGINT) AS label, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS membership FROM (SELECT vec_id, ct.label, greatest(sqrt({DIST.format(a='e.v', b='ct.c')}), 1e-12) ** (-2 / 0.75) AS w FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e, ct)",
    "session_segments": "SELECT user_id, round(epoch_us(min(ts)) / 1e6, 6) AS start, count(*) AS n, round(sum(value), 6) AS value FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 43200000000, true) AS gap FROM events)) GROUP BY user_id, s",
    "resample_mean": with_(EV, "sp AS (SELECT track_id, t AS s, lead(t) OVER (PARTITION BY track_id ORDER BY i) AS e, value AS v FROM ev)", "cu AS (SELECT *, unnest(range(CAST(floor(s / 86400) AS BIGINT), CAST(floor(e / 86400) AS BIGINT) + 1)) AS day FROM sp WHERE e IS NOT NULL)") + "SELECT track_id, day, round(sum(w * v) / sum(w), 6) AS v FROM (SELECT *, least(e, (day + 1) * 86400) - greatest(s, day * 86400) AS w FROM cu) WHERE w > 0 GROUP BY track_id, day",
    "time_lag_median": with_(EV, L2, COSINE, "lm AS (SELECT sm.track_id, (i - j + n) % n AS lag, j AS t, n, v FROM sm JOIN sz USING (track_id))", "lf AS (SELECT a.track_id, a.lag, a.t, any_value(a.n) AS n, list_sort(list(b.v))[3] AS v FROM lm a CROSS JOIN range(-2, 3) o(o) JOIN lm b ON b.track_id = a.track_id AND b.lag = a.lag AND b.t = (a.t + o.o + a.n) % a.n GROUP BY a.track_id, a.lag, a.t)", "tm AS (SELECT track_id, (lag + t) % n AS i, t AS j, v FROM lf)") + UPPER.format("tm"),
    "normalised_laplacian": with_(EV, MM, *knn("mm", K, 1, True), *PATH, *DEGREES, "mu AS (SELECT track_id, sum(p * (p + r)) / sum((p + r) ** 2) AS mu FROM dg GROUP BY track_id)", "ae AS (SELECT track_id, i, j, sum(v) AS v FROM (SELECT rc.track_id, i, j, mu AS v FROM rc JOIN mu USING (track_id) UNION ALL SELECT pa.track_id, i, i + 1, (1 - mu) * v FROM pa JOIN mu USING (track_id) UNION ALL SELECT pa.track_id, i + 1, i, (1 - mu) * v FROM pa JOIN mu USING (track_id)) GROUP BY track_id, i, j)", "ad AS (SELECT track_id, i, sum(v) AS d FROM ae GROUP BY track_id, i)", "la AS (SELECT track_id, i, i AS j, 1.0::DOUBLE AS v FROM ad WHERE d > 0 UNION ALL SELECT ae.track_id, ae.i, ae.j, -ae.v / sqrt(x.d * y.d) FROM ae JOIN ad x ON x.track_id = ae.track_id AND x.i = ae.i JOIN ad y ON y.track_id = ae.track_id AND y.i = ae.j)") + "SELECT track_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 6) AS v FROM la WHERE round(v, 6) <> 0",
    "ordinal_chroma": with_(EV, "oc AS (SELECT track_id, i, d, 80 * log10(s / max(s) OVER (PARTITION BY track_id, i)) AS v FROM (SELECT track_id, i, d, v + (min(v) OVER (PARTITION BY track_id) + 0.1) AS s FROM fr))") + matrix("oc"),
    "value_decibel": with_(EV, "dv AS (SELECT track_id, i, 20 * (log10(greatest(abs(value), 1e-5)) - log10(greatest(abs(max(value) OVER (PARTITION BY track_id)), 1e-5))) AS v FROM ev)", "dw AS (SELECT track_id, i, greatest(v, max(v) OVER (PARTITION BY track_id) - 30) AS v FROM dv)") + line("dw"),
    "element_functions": "SELECT event_id, round(sign(v) * greatest(abs(v) - 10, 0) + 0.0, 6) AS soft, round(greatest(v, 0) + 0.0, 6) AS positive, round(greatest(-v, 0) + 0.0, 6) AS negative, round(sqrt(v * v + 9), 6) AS magnitude FROM (SELECT event_id, value - 50 AS v FROM events)",
    "find_estimation": with_(*SIDES) + "SELECT track_id, 0::BIGINT AS ann, 2::BIGINT AS matches, count(*) AS n_segments FROM es GROUP BY track_id",
    "estimation_upsert": "WITH o AS (SELECT c_custkey, c_mktsegment AS boundaries_id, CASE WHEN c_nationkey % 2 = 0 THEN 'fmc2d' END AS labels_id, 0::BIGINT AS version FROM customer), n AS (SELECT c_custkey, c_mktsegment AS boundaries_id, CASE WHEN c_nationkey % 4 = 0 THEN 'fmc2d' END AS labels_id, 1::BIGINT AS version FROM customer WHERE c_nationkey % 3 = 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.c_custkey = o.c_custkey AND n.boundaries_id = o.boundaries_id AND n.labels_id IS NOT DISTINCT FROM o.labels_id)",
    "mirex_lines": with_(*SIDES) + "SELECT track_id, string_agg(printf('%.3f', s::DOUBLE) || chr(9) || printf('%.3f', e::DOUBLE) || chr(9) || chr(CAST(label + 65 AS INT)), chr(10) ORDER BY s) AS text FROM es GROUP BY track_id",
    "first_seen_labels": with_(EV, *REF) + "SELECT track_id, CAST(seg AS BIGINT) AS seg, CAST(dense_rank() OVER (PARTITION BY track_id ORDER BY f) - 1 AS BIGINT) AS label FROM (SELECT track_id, seg, min(seg) OVER (PARTITION BY track_id, label) AS f FROM rs)",
}

# greedy matching as a recursion: the next pair is the best whose labels are both free
TWINS["relabel_hierarchy"] = (
    with_(
        *SIDES,
        "om AS (SELECT es.track_id, es.label AS e, rs.label AS r, sum(least(es.e, rs.e) - greatest(es.s, rs.s))::DOUBLE AS o FROM es JOIN rs ON es.track_id = rs.track_id AND es.s < rs.e AND rs.s < es.e GROUP BY ALL)",
        "pl AS (SELECT track_id, list({'e': e, 'r': r} ORDER BY o DESC, e DESC, r DESC) AS p FROM om GROUP BY track_id)",
        "gr AS (SELECT track_id, p, 1 AS k, []::STRUCT(e BIGINT, r BIGINT)[] AS m FROM pl UNION ALL SELECT track_id, p, k + 1, CASE WHEN len(list_filter(m, lambda q: q.e = p[k].e OR q.r = p[k].r)) > 0 THEN m ELSE m || [{'e': p[k].e, 'r': p[k].r}] END FROM gr WHERE k <= len(p))",
        "gm AS (SELECT track_id, unnest(m) AS q FROM gr WHERE k > len(p))",
        "hit AS (SELECT track_id, q.e AS est_label, q.r AS new_label FROM gm)",
        "lft AS (SELECT track_id, label, row_number() OVER (PARTITION BY track_id ORDER BY label) AS k FROM (SELECT track_id, label FROM es EXCEPT SELECT track_id, est_label FROM hit))",
        "uns AS (SELECT track_id, label, row_number() OVER (PARTITION BY track_id ORDER BY label) AS k FROM (SELECT track_id, label FROM es EXCEPT SELECT track_id, label FROM rs))",
    )
    + "SELECT track_id, est_label, new_label FROM hit UNION ALL SELECT l.track_id, l.label, u.label FROM lft l JOIN uns u USING (track_id, k)"
)

for _name in ("foote", "sf", "cbm"):
    TWINS[f"{_name}_boundaries_relational"] = TWINS[f"{_name}_boundaries"]

#: Segments between boundaries, at a frame a second.
SEGMENTS = "SELECT track_id, 0::INTEGER AS level, CAST(row_number() OVER w - 1 AS INTEGER) AS seg, CAST(frame AS INTEGER) AS start_idx, CAST(\"next\" AS INTEGER) AS end_idx, frame::DOUBLE AS start, \"next\"::DOUBLE AS \"end\", (-1)::INTEGER AS label FROM (SELECT track_id, frame, lead(frame) OVER (PARTITION BY track_id ORDER BY frame) AS \"next\" FROM bd) WHERE \"next\" IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY frame)"
for _name, _from in (("segment_foote", "foote_boundaries"), ("segment_sf", "sf_boundaries"), ("segment_cbm_cosine", "cbm_boundaries")):
    TWINS[_name] = TWINS[_from].replace(BOUNDS, SEGMENTS)


def all_metrics() -> str:
    """Every metric by its own CTEs, under names of their own."""
    parts = [*SIDES, *LABELS, *gain("db", "bd"), *gain("bd", "db")]
    columns = []
    for k, (window, trim, name, weighted) in enumerate(((3.0, False, "HitRate_3", "HitRate_w3F"), (3.0, True, "HitRate_t3", "HitRate_wt3F"), (0.5, False, "HitRate_0_5", "HitRate_w0_5F"), (0.5, True, "HitRate_t0_5", "HitRate_wt0_5F"))):
        for part in hits(window, trim):
            for cte in ("hr", "he", "hb", "tp", "hm", "hf"):
                part = re.sub(rf"\b{cte}\b", f"{cte}{k}", part)
            parts.append(part)
        columns += [f'round(hf{k}.p, 6) AS "{name}P"', f'round(hf{k}.q, 6) AS "{name}R"', f'round(hf{k}.f, 6) AS "{name}F"', f'round(hf{k}.w, 6) AS "{weighted}"']
    deviations = [("DevR2E", False, "db", "bd"), ("DevE2R", False, "bd", "db"), ("DevtR2E", True, "db", "bd"), ("DevtE2R", True, "bd", "db")]
    joins = "".join(f" LEFT JOIN {deviation(t, a, b)} d{k} ON d{k}.track_id = lf.track_id" for k, (_, t, a, b) in enumerate(deviations))
    columns += [f'round(d{k}.v, 6) AS "{name}"' for k, (name, *_) in enumerate(deviations)]
    bits = repr(math.log2(251))
    columns.append(f'round(({bits} - greatest(ga.h, gb.h)) / {bits}, 6) AS "D"')
    columns += ['round(lf.p, 6) AS "PWP"', 'round(lf.q, 6) AS "PWR"', 'round(lf.pf, 6) AS "PWF"', 'round(lf.so, 6) AS "So"', 'round(lf.su, 6) AS "Su"', 'round(lf.sf, 6) AS "Sf"']
    found = " ".join(f"LEFT JOIN hf{k} ON hf{k}.track_id = lf.track_id" for k in range(4))
    return with_(*parts) + f"SELECT lf.track_id, split_part(lf.track_id, '_', 1) AS ds_name, {', '.join(columns)} FROM lf {found} LEFT JOIN dbbdh ga ON ga.track_id = lf.track_id LEFT JOIN bddbh gb ON gb.track_id = lf.track_id{joins}"


TWINS["evaluate_sides"] = all_metrics()
