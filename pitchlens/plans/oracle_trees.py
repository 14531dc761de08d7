"""SQL twin of the extra-trees forest: the same trees, grown level by level by DuckDB, and their predictions."""

from __future__ import annotations

from .trees import PRIME


def draw_sql(seed: int, salt: int, tree: str, node: str, feature: str) -> str:
    h = f"{(seed * 7919 + salt + 1) % PRIME}::BIGINT"
    for v in (tree, f"({node} % {PRIME})", feature):
        h = f"(({h} * 48271 + {v}) % {PRIME})"
    q = f"(({h} * {h} + 1013904223) % {PRIME})"
    return f"(({q} * {q} + 12345) % {PRIME})"


def forest_ctes(n_trees: int, max_depth: int, max_features: int, seed: int = 42) -> str:
    """CTEs from ``tr(row, label, x)`` (training) and ``te(row, x)`` (other rows) to ``pred(row, label)``.

    x is a list of doubles, label a small integer; rows of both tables have different numbers.
    """
    parts = [f"""pts AS MATERIALIZED (SELECT row, label, x FROM tr UNION ALL SELECT row, CAST(NULL AS INTEGER), x FROM te),
at0 AS MATERIALIZED (SELECT CAST(unnest(range({n_trees})) AS BIGINT) AS tree, row, CAST(1 AS BIGINT) AS node FROM pts)"""]
    for k in range(max_depth):
        parts.append(f"""open{k} AS MATERIALIZED (
  SELECT tree, node FROM at{k} JOIN tr USING (row) GROUP BY tree, node HAVING count(DISTINCT label) > 1),
range{k} AS (
  SELECT tree, node, f, min(v) AS lo, max(v) AS hi FROM (
    SELECT tree, node, unnest(range(len(x))) AS f, unnest(x) AS v FROM at{k} JOIN tr USING (row) JOIN open{k} USING (tree, node))
  GROUP BY tree, node, f HAVING min(v) < max(v)),
cand{k} AS MATERIALIZED (
  SELECT tree, node, f, CASE WHEN t >= hi THEN lo ELSE t END AS t FROM (
    SELECT tree, node, f, lo, hi, lo + {draw_sql(seed, 1, 'tree', 'node', 'f')} / CAST({PRIME} AS DOUBLE) * (hi - lo) AS t,
           row_number() OVER (PARTITION BY tree, node ORDER BY {draw_sql(seed, 0, 'tree', 'node', 'f')}, f) AS place
    FROM range{k}) WHERE place <= {max_features}),
best{k} AS MATERIALIZED (
  SELECT tree, node, f, t FROM (
    SELECT tree, node, f, t, row_number() OVER (PARTITION BY tree, node ORDER BY
             CAST(sum(l * l) AS DOUBLE) / sum(l) + CAST(sum((n - l) * (n - l)) AS DOUBLE) / sum(n - l) DESC, f) AS place
    FROM (SELECT tree, node, f, t, label, count(*) FILTER (WHERE x[f + 1] <= t) AS l, count(*) AS n
          FROM cand{k} JOIN at{k} USING (tree, node) JOIN tr USING (row) GROUP BY tree, node, f, t, label)
    GROUP BY tree, node, f, t) WHERE place = 1),
stay{k} AS MATERIALIZED (SELECT a.* FROM at{k} a ANTI JOIN best{k} b USING (tree, node)),
at{k + 1} AS MATERIALIZED (
  SELECT a.tree, a.row, 2 * a.node + CAST(p.x[b.f + 1] > b.t AS BIGINT) AS node FROM at{k} a JOIN best{k} b USING (tree, node) JOIN pts p USING (row))""")
    ends = " UNION ALL ".join([*(f"SELECT * FROM stay{k}" for k in range(max_depth)), f"SELECT * FROM at{max_depth}"])
    parts.append(f"""forest_ends AS MATERIALIZED ({ends}),
forest_leaf AS MATERIALIZED (
  SELECT tree, node, label, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY tree, node) AS share
  FROM forest_ends JOIN tr USING (row) GROUP BY tree, node, label),
votes AS (SELECT e.row, l.label, round(sum(l.share), 9) AS v FROM forest_ends e JOIN te USING (row) JOIN forest_leaf l USING (tree, node) GROUP BY e.row, l.label),
pred AS (SELECT row, label FROM (SELECT row, label, row_number() OVER (PARTITION BY row ORDER BY v DESC, label) AS k FROM votes) WHERE k = 1)""")
    return ",\n".join(parts)


def boost_ctes(rounds: int, max_depth: int, learning_rate: float, reg_lambda: float, min_child_weight: float) -> str:
    """CTEs from ``tr(row, y, x)`` and ``te(row, x)`` to ``pred(row, score)``: logistic boosting with second-order gains over all values.

    Gains are compared to 7 digits, ties go to the first feature and value.
    """
    parts = ["""pts AS MATERIALIZED (SELECT row, CAST(y AS DOUBLE) AS y, x FROM tr UNION ALL SELECT row, CAST(NULL AS DOUBLE), x FROM te),
m0 AS MATERIALIZED (SELECT row, CAST(0.0 AS DOUBLE) AS m FROM pts)"""]
    lam = f"CAST({reg_lambda} AS DOUBLE)"
    for r in range(rounds):
        parts.append(f"""gh{r} AS MATERIALIZED (
  SELECT row, x, 1 / (1 + exp(-m)) - y AS g, greatest(1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))), 1e-16) AS h FROM m{r} JOIN pts USING (row) WHERE y IS NOT NULL),
n{r}_0 AS MATERIALIZED (SELECT row, CAST(1 AS BIGINT) AS node FROM pts)""")
        for d in range(max_depth):
            n = f"n{r}_{d}"
            parts.append(f"""c{r}_{d} AS (
  SELECT node, f, v, sum(g) AS g, sum(h) AS h FROM (
    SELECT node, g, h, unnest(range(len(x))) AS f, unnest(x) AS v FROM {n} JOIN gh{r} USING (row)) GROUP BY node, f, v),
s{r}_{d} AS (
  SELECT node, f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER a AS gt, sum(h) OVER a AS ht,
         row_number() OVER (PARTITION BY node, f ORDER BY v DESC) AS back
  FROM c{r}_{d} WINDOW w AS (PARTITION BY node, f ORDER BY v), a AS (PARTITION BY node, f)),
b{r}_{d} AS MATERIALIZED (
  SELECT node, f, v FROM (
    SELECT node, f, v, won, row_number() OVER (PARTITION BY node ORDER BY round(won, 7) DESC, f, v) AS k FROM (
      SELECT node, f, v, gl * gl / (hl + {lam}) + (gt - gl) * (gt - gl) / (ht - hl + {lam}) - gt * gt / (ht + {lam}) AS won
      FROM s{r}_{d} WHERE back > 1 AND hl >= {min_child_weight} AND ht - hl >= {min_child_weight}))
  WHERE k = 1 AND won > 1e-10),
n{r}_{d + 1} AS MATERIALIZED (
  SELECT n.row, CASE WHEN b.node IS NULL THEN n.node ELSE 2 * n.node + CAST(p.x[b.f + 1] > b.v AS BIGINT) END AS node
  FROM {n} n JOIN pts p USING (row) LEFT JOIN b{r}_{d} b ON b.node = n.node)""")
        parts.append(f"""v{r} AS MATERIALIZED (
  SELECT node, -CAST({learning_rate} AS DOUBLE) * sum(g) / (sum(h) + {lam}) AS value FROM n{r}_{max_depth} JOIN gh{r} USING (row) GROUP BY node),
m{r + 1} AS MATERIALIZED (SELECT m.row, m.m + v.value AS m FROM m{r} m JOIN n{r}_{max_depth} n USING (row) JOIN v{r} v USING (node))""")
    parts.append(f"pred AS (SELECT m.row, m.m AS score FROM m{rounds} m JOIN te USING (row))")
    return ",\n".join(parts)
