"""The unsupervised fit in SQL: two masked views of each row, told apart in its batch."""

from __future__ import annotations

from labelspring.checks.elastic_sql import ENCODED
from labelspring.checks.oracle import IDENTITY, LAB, WIDTH, descent, digest, rank, wide
from labelspring.functions.keyed import DRAW_DIGITS, DRAWS, draw_below

BATCH, SCALE, RATE, MAX_NORM, DROPOUT = 32, 20, 0.2, 1.0, 0.1
LABELLED_VEC = """vec AS (SELECT row_id, "LABEL", emb FROM encoded JOIN lab USING (row_id))"""


def masked(epoch: int, view: int) -> str:
    """The vector ``emb`` of a row with the entries that the view drops."""
    block = f"row_id || '/' || CAST((i - 1) // {DRAWS} AS VARCHAR)"
    draw = (
        f"substr({digest(block, f'dropout-{epoch}-{view}')}, "
        f"1 + {DRAW_DIGITS} * ((i - 1) % {DRAWS}), {DRAW_DIGITS})"
    )
    return f"""list_transform(emb, lambda x, i: CASE WHEN {draw} < '{draw_below(DROPOUT)}'
    THEN CAST(0 AS DOUBLE) ELSE x / CAST({1 - DROPOUT} AS DOUBLE) END)"""


def unsupervised(epochs: int) -> str:
    """Tables ``m{e}``, the matrix after epoch ``e``, and ``turn{e}``, its loss and gradient norm."""
    parts = [
        f"""{ENCODED},
batched AS (SELECT row_id, emb, {rank(digest("row_id", "batch"))} // {BATCH} AS batch_id FROM encoded),
m0 AS ({IDENTITY})"""
    ]
    for e in range(1, epochs + 1):
        parts.append(f"""views{e} AS MATERIALIZED (
  SELECT row_id, batch_id, 'a' AS side, {masked(e, 0)} AS v FROM batched
  UNION ALL SELECT row_id, batch_id, 'b', {masked(e, 1)} FROM batched),
sides{e} AS MATERIALIZED (
  SELECT row_id, batch_id, side, v, n,
         CASE WHEN n > 0 THEN list_transform(u, lambda x: x / n) ELSE u END AS u
  FROM (SELECT *, sqrt(list_dot_product(u, u)) AS n FROM (
    SELECT *, list_transform(w, lambda r: list_dot_product(r, v)) AS u FROM views{e}, m{e - 1}))),
close{e} AS MATERIALIZED (
  SELECT i, j, s, ua, ub, sum(exp(s)) OVER (PARTITION BY i) AS mass
  FROM (SELECT a.row_id AS i, b.row_id AS j, {SCALE} * list_dot_product(a.u, b.u) AS s,
               a.u AS ua, b.u AS ub
        FROM sides{e} a JOIN sides{e} b ON a.batch_id = b.batch_id
        WHERE a.side = 'a' AND b.side = 'b')),
shares{e} AS (
  SELECT i, j, ua, ub, {SCALE} * (exp(s) / mass - CASE WHEN i = j THEN 1 ELSE 0 END) AS k FROM close{e}),
drawn{e} AS (
  SELECT 'a' AS side, i AS row_id, k, unnest(range(1, {WIDTH + 1})) AS d, unnest(ub) AS x FROM shares{e}
  UNION ALL
  SELECT 'b', j, k, unnest(range(1, {WIDTH + 1})), unnest(ua) FROM shares{e}),
turned{e} AS (
  SELECT side, row_id, list(g ORDER BY d) AS g
  FROM (SELECT side, row_id, d, sum(k * x) AS g FROM drawn{e} GROUP BY side, row_id, d)
  GROUP BY side, row_id),
slopes{e} AS MATERIALIZED (
  SELECT v, list_transform(range(1, {WIDTH + 1}), lambda d: (g[d] - c * u[d]) / n) AS f
  FROM (SELECT *, list_dot_product(g, u) AS c FROM turned{e} JOIN sides{e} USING (side, row_id))
  WHERE n > 0),
lines{e} AS (SELECT v, unnest(range({WIDTH})) AS i, unnest(f) AS f FROM slopes{e}),
products{e} AS (SELECT i, f, unnest(range({WIDTH})) AS j, unnest(v) AS x FROM lines{e}),
slope{e} AS MATERIALIZED (
  SELECT i, j, sum(f * x) / (SELECT count(*) FROM batched) AS g FROM products{e} GROUP BY i, j),
turn{e} AS (
  SELECT {e} AS epoch, (SELECT avg(ln(mass) - s) FROM close{e} WHERE i = j) AS loss,
         sqrt(sum(g * g)) AS size FROM slope{e}),
m{e} AS MATERIALIZED (
  SELECT list(r ORDER BY i) AS w FROM (
    SELECT i, list(w[i + 1][j + 1] - {RATE} * least(1, {MAX_NORM} / size) * g ORDER BY j) AS r
    FROM slope{e}, m{e - 1}, turn{e} GROUP BY i))""")
    return ",\n".join(parts)


def _log(stage: str, table: str, epochs: int, n: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{stage}' AS stage, CAST({e} AS INTEGER) AS epoch, round(loss, 6) AS loss,
  round(size, 6) AS grad_norm, (SELECT count(*) FROM {n}) AS n FROM {table}{e}"""
        for e in range(1, epochs + 1)
    )


SIMCSE_ORACLE: dict[str, str] = {
    "simcse_fit": f"""WITH {unsupervised(1)},
last AS (
  SELECT row_id, list_transform(w, lambda r: list_dot_product(r, emb)) AS u FROM encoded, m1),
moved AS (SELECT row_id, u, sqrt(list_dot_product(u, u)) AS n FROM last)
SELECT row_id, {wide("CASE WHEN n > 0 THEN u[{i}] / n ELSE 0 END", 6)} FROM moved""",
    "epoch_loss": f"""WITH {LAB}, {unsupervised(2)},
{descent(rows=LABELLED_VEC, start="SELECT w FROM m2")}
{_log("simcse", "turn", 2, "batched")} UNION ALL {_log("pairs", "step", 3, "pairs")}""",
}
