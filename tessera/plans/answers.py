"""SQL for queries that other modules register without."""

from __future__ import annotations

from .catalogue import _PTS, _QUERIES, _SQL, RGB, Q


def _answer(name: str, sql: str) -> None:
    assert name in _QUERIES and name not in _SQL
    _SQL[name] = sql


def _fold(c: str, m: str) -> str:
    """A place mirrored into 0 .. m, the edge pixel repeated."""
    return f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > {m} THEN 2 * {m} + 1 - ({c}) ELSE {c} END"


_round = lambda k: f", d{k + 1} AS (SELECT y, x, v + 0.25::DOUBLE * ({' + '.join(f'coalesce(({n} - v) * exp(-power({n} - v, 2) / 900), 0)' for n in ('l', 'r', 'u', 'd'))}) AS v FROM (SELECT y, x, v, lag(v) OVER a AS l, lead(v) OVER a AS r, lag(v) OVER b AS u, lead(v) OVER b AS d FROM d{k} WINDOW a AS (PARTITION BY y ORDER BY x), b AS (PARTITION BY x ORDER BY y)))"
_answer("diffuse", Q + ", d0 AS (SELECT y, x, v::DOUBLE AS v FROM q)" + "".join(_round(k) for k in range(3)) + " SELECT y, x, round(v, 4) AS v FROM d3")

_AROUND = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"
_answer(
    "local_brighten",
    Q + f""", iv AS (SELECT y, x, 1 - (v - min(v) OVER ())::DOUBLE / (max(v) OVER () - min(v) OVER ()) AS v FROM q),
    lo AS (SELECT a.y, a.x, min(b.v) AS v FROM iv a JOIN iv b ON {_AROUND} GROUP BY 1, 2), hz AS (SELECT a.y, a.x, 0.8::DOUBLE * max(b.v) AS h FROM lo a JOIN lo b ON {_AROUND} GROUP BY 1, 2)
    SELECT y, x, round(1 - greatest(0, least(1, (v - h) / greatest(1 - h, 0.1))), 6) AS v FROM iv JOIN hz USING (y, x)""",
)
_answer(
    "non_local_means",
    Q + f""", bx AS (SELECT max(y) AS my, max(x) AS mx FROM q), s5 AS (SELECT i.i AS sy, j.j AS sx FROM range(-2, 3) i(i), range(-2, 3) j(j)), s3 AS (SELECT i.i AS ey, j.j AS ex FROM range(-1, 2) i(i), range(-1, 2) j(j)),
    pl AS (SELECT q.y, q.x, sy, sx, {_fold('q.y + ey', 'my')} AS ay, {_fold('q.x + ex', 'mx')} AS ax, {_fold('q.y + ey + sy', 'my')} AS cy, {_fold('q.x + ex + sx', 'mx')} AS cx, ey = 0 AND ex = 0 AS mid FROM q, bx, s5, s3),
    pt AS (SELECT pl.y, pl.x, sy, sx, exp(-avg(power(a.v - c.v, 2)) / 1600) AS w, max(CASE WHEN mid THEN c.v END) AS o FROM pl JOIN q a ON a.y = ay AND a.x = ax JOIN q c ON c.y = cy AND c.x = cx GROUP BY 1, 2, 3, 4)
    SELECT y, x, round(sum(w * o) / sum(w), 6) AS v FROM pt GROUP BY 1, 2""",
)
_DISK3 = "b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3 AND power(a.y - b.y, 2) + power(a.x - b.x, 2) <= 9"
_answer(
    "preprocess",
    RGB + f""", gy AS (SELECT y, x, 0.2989 * r + 0.5870 * g + 0.1140 * b AS v FROM c), ds AS (SELECT y, x, (v - least(0.0, min(v) OVER ())) / (greatest(1.0, max(v) OVER ()) - least(0.0, min(v) OVER ())) AS v FROM gy),
    sh AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM ds GROUP BY 1, 2), bx AS (SELECT max(y) AS my, max(x) AS mx FROM sh),
    i AS (SELECT CAST(u.i AS BIGINT) AS y, CAST(t.i AS BIGINT) AS x, 1 - sh.v AS v FROM bx, range(-3, (SELECT my + 4 FROM bx)) u(i), range(-3, (SELECT mx + 4 FROM bx)) t(i) JOIN sh ON sh.y = greatest(0, least(my, u.i)) AND sh.x = greatest(0, least(mx, t.i))),
    p1 AS (SELECT a.y, a.x, min(b.v) AS v FROM i a JOIN i b ON {_DISK3} GROUP BY 1, 2), p2 AS (SELECT a.y, a.x, max(b.v) AS v FROM p1 a JOIN p1 b ON {_DISK3} GROUP BY 1, 2)
    SELECT y, x, round(1 - (i.v - p2.v), 6) AS v FROM i JOIN p2 USING (y, x), bx WHERE y BETWEEN 0 AND my AND x BETWEEN 0 AND mx""",
)
_answer(
    "register_candidates",
    Q + """, h AS (SELECT max(y) + 1 AS h FROM q), k AS (SELECT CAST(unnest([-3, -2, -1]) AS INTEGER) AS shift),
    mv AS (SELECT shift, (y + 2 + shift + 2 * h) % h AS y, x, v AS w FROM q, h, k), f AS (SELECT shift, avg(power(v - w, 2)) AS mse, corr(v, w) AS r FROM q JOIN mv USING (y, x) GROUP BY 1)
    SELECT shift, round(mse, 4) AS mse, round(r, 4) AS r, CAST(row_number() OVER (ORDER BY mse, shift) AS INTEGER) AS rank FROM f""",
)
_answer(
    "polynomial_fit",
    _PTS + """, m AS (SELECT count(*)::DOUBLE AS n, sum(px) AS s1, sum(px ** 2) AS s2, sum(px ** 3) AS s3, sum(px ** 4) AS s4, sum(py) AS t0, sum(px * py) AS t1, sum(px ** 2 * py) AS t2, sum(py * py) AS yy FROM p),
    d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM m),
    c AS (SELECT *, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det AS c0, (n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det AS c1,
    (n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM d)
    SELECT round(c0, 4) AS c0, round(c1, 5) AS c1, round(1 - ((yy - c0 * t0 - c1 * t1 - c2 * t2) / (n - 3)) / ((yy - t0 * t0 / n) / (n - 1)), 6) AS adj_r2 FROM c""",
)
