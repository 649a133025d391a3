"""Least squares as SQL: the cross products are swept column by column in a recursive step, errors come from the rows again.

`least_squares` gives one row per group and numeric term: g, term, coef, v (its variance), bread (its diagonal element of the inverse),
ssr, tss, n, rank. Columns that depend on those before them are passed over, so terms which are identified don't change.
"""

#: A pivot below this share of its column's sum of squares belongs to a column that depends on earlier ones.
DEPENDENT = 1e-9


def least_squares(src: str, y: str, x: list[str], categories: tuple[str, ...] = (), by: str = "'all'", cov: str = "nonrobust", order: str = "0",
                  cluster: str = "0", lags: int = 3, intercept: bool = True) -> str:
    numeric = (["const"] if intercept else []) + x
    needed = " AND ".join(f"{c} IS NOT NULL" for c in [y, *x, *categories])
    columns = [f"SELECT i, g, {j} AS j, CAST({'1' if c == 'const' else c} AS DOUBLE) AS v FROM ls_rows" for j, c in enumerate(numeric)]
    levels = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST(l AS VARCHAR) AS l FROM (SELECT DISTINCT {c} AS l FROM ls_rows) d WHERE l > (SELECT min({c}) FROM ls_rows)" for c in categories)
    dummies = f"SELECT c, l, {len(numeric)} - 1 + row_number() OVER (ORDER BY c, l) AS j FROM ({levels}) v" if categories else "SELECT 'none' AS c, '' AS l, 0 AS j WHERE FALSE"
    columns += [f"SELECT i, g, j, CAST(1 AS DOUBLE) FROM ls_rows JOIN ls_dummies ON ls_dummies.c = '{c}' AND ls_dummies.l = CAST({c} AS VARCHAR)" for c in categories]
    names = " ".join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(numeric))
    variance = {
        "nonrobust": "SELECT b.g, b.i AS t, b.v * s.v / (n.n - n.rank) AS v FROM ls_end b JOIN ls_end s ON s.g = b.g AND s.i = -1 AND s.j = -1 JOIN ls_size n ON n.g = b.g WHERE b.i = b.j AND b.i >= 0",
        "HC3": """SELECT w.g, w.t, sum(pow(w.s * w.e / (1 - h.h), 2)) AS v FROM ls_score w JOIN (
  SELECT a.i, sum(a.v * b.v * f.v) AS h FROM ls_long a JOIN ls_long b ON a.i = b.i JOIN ls_end f ON f.g = a.g AND f.i = a.j AND f.j = b.j WHERE a.j >= 0 AND b.j >= 0 GROUP BY 1) h ON h.i = w.i GROUP BY 1, 2""",
        "HAC": "SELECT g, t, sum(u * u) + 2 * (" + " + ".join(f"{1 - k / (lags + 1)} * sum(u * u{k})" for k in range(1, lags + 1)) + ") AS v FROM (SELECT w.g, w.t, w.s * w.e AS u, "
               + ", ".join(f"lag(w.s * w.e, {k}) OVER (PARTITION BY w.g, w.t ORDER BY r.o) AS u{k}" for k in range(1, lags + 1)) + " FROM ls_score w JOIN ls_rows r ON r.i = w.i) q GROUP BY 1, 2",
        "cluster": """SELECT c.g, c.t, sum(c.u * c.u) * count(*) / (count(*) - 1) * (max(n.n) - 1) / (max(n.n) - max(n.width)) AS v FROM (
  SELECT w.g, w.t, r.k, sum(w.s * w.e) AS u FROM ls_score w JOIN ls_rows r ON r.i = w.i GROUP BY 1, 2, 3) c JOIN ls_size n ON n.g = c.g GROUP BY 1, 2""",
    }[cov]
    return f"""WITH RECURSIVE ls_rows AS MATERIALIZED (SELECT row_number() OVER () AS i, {by} AS g, {order} AS o, {cluster} AS k, * FROM ({src}) given WHERE {needed}),
ls_dummies AS MATERIALIZED ({dummies}),
ls_long AS MATERIALIZED ({' UNION ALL '.join(columns)} UNION ALL SELECT i, g, -1, CAST({y} AS DOUBLE) FROM ls_rows),
ls_start AS MATERIALIZED (SELECT c.g, a.j AS i, b.j AS j, coalesce(p.v, 0) AS v FROM (SELECT DISTINCT g FROM ls_rows) c CROSS JOIN (SELECT DISTINCT j FROM ls_long) a CROSS JOIN (SELECT DISTINCT j FROM ls_long) b
  LEFT JOIN (SELECT l.g, l.j AS i, r.j AS j, sum(l.v * r.v) AS v FROM ls_long l JOIN ls_long r ON l.i = r.i GROUP BY 1, 2, 3) p ON p.g = c.g AND p.i = a.j AND p.j = b.j),
ls_sweep(k, g, i, j, v) AS (SELECT CAST(0 AS BIGINT), g, i, j, v FROM ls_start UNION ALL
  SELECT a.k + 1, a.g, a.i, a.j, CASE WHEN p.v <= {DEPENDENT} * d.v THEN CASE WHEN a.i = a.k OR a.j = a.k THEN 0 ELSE a.v END WHEN a.i = a.k AND a.j = a.k THEN 1 / p.v
    WHEN a.i = a.k THEN a.v / p.v WHEN a.j = a.k THEN -a.v / p.v ELSE a.v - c.v * r.v / p.v END
  FROM ls_sweep a JOIN ls_sweep p ON p.g = a.g AND p.i = a.k AND p.j = a.k JOIN ls_sweep r ON r.g = a.g AND r.i = a.k AND r.j = a.j JOIN ls_sweep c ON c.g = a.g AND c.i = a.i AND c.j = a.k
  JOIN ls_start d ON d.g = a.g AND d.i = a.k AND d.j = a.k),
ls_end AS MATERIALIZED (SELECT g, i, j, v FROM ls_sweep WHERE k = (SELECT max(j) + 1 FROM ls_long)),
ls_size AS MATERIALIZED (SELECT r.g, r.n, r.tss, f.rank, f.width FROM (SELECT g, count(*) AS n, sum(pow({y}, 2)) - pow(sum({y}), 2) / count(*) AS tss FROM ls_rows GROUP BY 1) r
  JOIN (SELECT g, count(*) FILTER (WHERE v > 0) AS rank, count(*) AS width FROM ls_end WHERE i = j AND i >= 0 GROUP BY 1) f ON f.g = r.g),
ls_error AS MATERIALIZED (SELECT x.i, max(r.{y}) - sum(x.v * f.v) AS e FROM ls_long x JOIN ls_end f ON f.g = x.g AND f.i = x.j AND f.j = -1 JOIN ls_rows r ON r.i = x.i WHERE x.j >= 0 GROUP BY 1),
ls_score AS MATERIALIZED (SELECT w.*, e.e FROM (SELECT x.i, x.g, f.i AS t, sum(f.v * x.v) AS s FROM ls_long x JOIN ls_end f ON f.g = x.g AND f.j = x.j
  WHERE f.i BETWEEN 0 AND {len(numeric) - 1} AND x.j >= 0 GROUP BY 1, 2, 3) w JOIN ls_error e ON e.i = w.i)
SELECT b.g, CASE b.i {names} END AS term, b.v AS coef, q.v, d.v AS bread, s.v AS ssr, n.tss, n.n, n.rank FROM ls_end b JOIN ls_end d ON d.g = b.g AND d.i = b.i AND d.j = b.i
JOIN ls_end s ON s.g = b.g AND s.i = -1 AND s.j = -1 JOIN ls_size n ON n.g = b.g JOIN ({variance}) q ON q.g = b.g AND q.t = b.i WHERE b.j = -1 AND b.i BETWEEN 0 AND {len(numeric) - 1}"""


def table(fitted: str, terms: list[str] | None = None) -> str:
    """The columns of a coefficient table without p-values."""
    chosen = f" WHERE term IN ({', '.join(repr(t) for t in terms)})" if terms else ""
    return f"SELECT g, term, coef, sqrt(v) AS se, coef / sqrt(v) AS stat, n, 1 - ssr / tss AS r2, CAST(n - rank AS DOUBLE) AS df FROM ({fitted}) f{chosen}"


def coefficient(fitted: str, term: str) -> str:
    return f"(SELECT coef FROM ({fitted}) f WHERE term = '{term}')"
