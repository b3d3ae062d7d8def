"""The elastic net in SQL, by coordinate descent, and the loops that rest on it.

The elastic net has one answer, so another engine that gets there in another way
checks the scaler, the fit, the scores, and the folds and rounds around them.
"""

from __future__ import annotations

from labelspring.checks.oracle import (
    DIMS,
    DOCS,
    HELD_OUT,
    LAB,
    SLOTS,
    UNL,
    WIDTH,
    folded,
    label_cut,
    split_rounds,
)

ALPHA, L1_RATIO = 0.01, 0.5
SWEEPS = 120
#: Scores are compared to so many decimals; Spark's solver leaves about 1e-5.
SCORE_DIGITS = 2
#: Of the solver on sums.
SOLVED_DIGITS = 6

#: Vectors as the encoder stores them, and at unit length as the plans store them.
ENCODED = f"""{DOCS}, {SLOTS}, encoded AS (
  SELECT row_id, [{", ".join(f"CAST(CAST(emb_{j} AS FLOAT) AS DOUBLE)" for j in DIMS)}] AS emb
  FROM bags),
unit AS (
  SELECT row_id, list_transform(emb, lambda v: CAST(CAST(v / n AS FLOAT) AS DOUBLE)) AS emb
  FROM (SELECT *, sqrt(list_dot_product(emb, emb)) AS n FROM encoded))"""


def elastic(name: str, train: str, rows: str) -> str:
    """Tables that end in ``name(g, row_id, score)``.

    ``train(g, row_id, y, emb)`` holds the fits, one for each ``g``, and
    ``rows(g, row_id, emb)`` what each scores. A step of the recursion updates one
    coefficient of every fit.
    """
    l1, l2 = ALPHA * L1_RATIO, ALPHA * (1 - L1_RATIO)
    slope = "(c[j] - list_dot_product(gram[j], w) + gram[j][j] * w[j])"
    update = f"sign({slope}) * greatest(abs({slope}) - {l1}, 0) / (gram[j][j] + {l2})"
    return f"""{name}_cells AS MATERIALIZED (
  SELECT g, row_id, y, unnest(emb) AS x, unnest(range(1, {WIDTH + 1})) AS j FROM {train}),
{name}_dims AS MATERIALIZED (
  SELECT g, j, avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS std,
         avg(y) AS level FROM {name}_cells GROUP BY g, j),
{name}_scaled AS MATERIALIZED (
  SELECT g, row_id, any_value(y - level) AS y, list((x - mean) / std ORDER BY j) AS z
  FROM {name}_cells JOIN {name}_dims USING (g, j) GROUP BY g, row_id),
{name}_parts AS (
  SELECT g, row_id, y, z, unnest(z) AS zj, unnest(range(1, {WIDTH + 1})) AS j FROM {name}_scaled),
{name}_products AS (
  SELECT g, j, avg(zj * y) AS c, k, avg(zj * zk) AS p
  FROM (SELECT g, j, y, zj, unnest(z) AS zk, unnest(range(1, {WIDTH + 1})) AS k FROM {name}_parts)
  GROUP BY g, j, k),
{name}_gram AS MATERIALIZED (
  SELECT g, list(line ORDER BY j) AS gram, list(c ORDER BY j) AS c
  FROM (SELECT g, j, any_value(c) AS c, list(p ORDER BY k) AS line FROM {name}_products GROUP BY g, j)
  GROUP BY g),
{name}_steps(g, step, w) AS (
  SELECT g, 0, list_transform(c, lambda v: CAST(0 AS DOUBLE)) FROM {name}_gram
  UNION ALL
  SELECT g, step + 1, w[:j - 1] || [{update}] || w[j + 1:]
  FROM (SELECT s.g, step, w, gram, c, step % {WIDTH} + 1 AS j
        FROM {name}_steps s JOIN {name}_gram m ON s.g = m.g WHERE step < {SWEEPS * WIDTH})),
{name}_fit AS MATERIALIZED (
  SELECT s.g, w, means, stds, level FROM {name}_steps s JOIN (
    SELECT g, list(mean ORDER BY j) AS means, list(std ORDER BY j) AS stds, max(level) AS level
    FROM {name}_dims GROUP BY g) d ON s.g = d.g
  WHERE step = {SWEEPS * WIDTH}),
{name} AS MATERIALIZED (
  SELECT r.g, row_id, least(greatest(level + list_sum(list_transform(range(1, {WIDTH + 1}),
    lambda j: w[j] * (emb[j] - means[j]) / stds[j])), 0), 1) AS score
  FROM {rows} r JOIN {name}_fit f ON r.g = f.g)"""


LABELLED = """labelled AS (SELECT 0 AS g, row_id, "LABEL" AS y, emb FROM lab JOIN unit USING (row_id)),
open_rows AS (SELECT 0 AS g, row_id, emb FROM unl JOIN unit USING (row_id))"""
BASE = f"WITH RECURSIVE {LAB}, {UNL}, {ENCODED}, {LABELLED}"


def self_trained(rounds: int, threshold: float) -> str:
    """Fits ``fit0`` to ``fit{rounds}`` of self-training; ``train{r}`` is what round r is fitted on."""
    parts = ["train0 AS (SELECT g, row_id, y, emb, 0 AS pseudo FROM labelled)"]
    for r in range(rounds + 1):
        parts.append(elastic(f"fit{r}", f"train{r}", "open_rows"))
        cut = f"CAST({threshold} AS DOUBLE)"
        parts.append(f"""train{r + 1} AS MATERIALIZED (
  SELECT g, row_id, y, emb, 0 AS pseudo FROM labelled
  UNION ALL
  SELECT g, -1 - row_id, CAST(score >= {cut} AS INTEGER), emb, 1
  FROM fit{r} JOIN open_rows USING (g, row_id)
  WHERE score >= {cut} OR score <= CAST(1 AS DOUBLE) - {cut})""")
    return ",\n".join(parts)


def _round_counts(rounds: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT CAST({r} AS INTEGER) AS round, count(*) AS total_train,
  count(*) FILTER (pseudo = 0) AS labeled, count(*) FILTER (pseudo = 1) AS pseudo,
  count(*) FILTER (pseudo = 1 AND y = 1) AS pos, count(*) FILTER (pseudo = 1 AND y = 0) AS neg
FROM train{r}"""
        for r in range(rounds + 1)
    )


def _round_changes(rounds: int) -> str:
    """Pseudo-labels of each round against those of the round before; ``train0`` has none."""

    def pseudo(r: int) -> str:
        return f"(SELECT -1 - row_id AS row_id, y FROM train{r} WHERE pseudo = 1)"

    return " UNION ALL ".join(
        f"""SELECT CAST({r} AS INTEGER) AS round, row_id,
  CASE WHEN b.y IS NULL THEN 'entered' WHEN a.y IS NULL THEN 'left' ELSE 'flipped' END AS change,
  CAST(b.y AS INTEGER) AS label_before, CAST(a.y AS INTEGER) AS label_after
FROM {pseudo(r)} b FULL JOIN {pseudo(r + 1)} a USING (row_id) WHERE b.y IS DISTINCT FROM a.y"""
        for r in range(rounds)
    )


#: All folds are fitted at once: row i is in the training set of each fold but its own.
FOLDS = f"""{folded("lab", "LABEL")},
fold_train AS (
  SELECT f AS g, row_id, "LABEL" AS y, emb
  FROM folded JOIN unit USING (row_id), (SELECT unnest(range(5)) AS f) WHERE fold <> f),
fold_held AS (SELECT fold AS g, row_id, emb FROM folded JOIN unit USING (row_id))"""

SPLITS = f"""{split_rounds("lab")},
splits AS (SELECT *, {HELD_OUT} AS held_out FROM ranked),
split_train AS (
  SELECT round AS g, row_id, "LABEL" AS y, emb
  FROM splits JOIN unit USING (row_id) WHERE NOT held_out),
split_held AS (SELECT round AS g, row_id, emb FROM splits JOIN unit USING (row_id) WHERE held_out)"""


def _rounded(value: str, digits: int = SOLVED_DIGITS) -> str:
    return f"round({value}, {digits}) AS score"


def fold_rounds(rounds: int, threshold: float, name: str = "") -> str:
    """Self-training in each fold: fits ``{name}fit0`` and on, each on ``{name}train{r}``."""
    parts = [f"{name}train0 AS (SELECT g, row_id, y, emb, 0 AS pseudo FROM fold_train)"]
    cut = f"CAST({threshold} AS DOUBLE)"
    for r in range(rounds):
        parts.append(elastic(f"{name}fit{r}", f"{name}train{r}", "every"))
        parts.append(f"""{name}train{r + 1} AS MATERIALIZED (
  SELECT g, row_id, y, emb, 0 AS pseudo FROM fold_train
  UNION ALL
  SELECT g, -1 - row_id, CAST(score >= {cut} AS INTEGER), emb, 1
  FROM {name}fit{r} JOIN every USING (g, row_id)
  WHERE score >= {cut} OR score <= CAST(1 AS DOUBLE) - {cut})""")
    return ",\n".join(parts)


EVERY = "every AS (SELECT f AS g, row_id, emb FROM open_rows, (SELECT unnest(range(5)) AS f))"


def _fold_counts(rounds: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT CAST(g AS INTEGER) AS fold, CAST({r} AS INTEGER) AS round, count(*) AS total_train,
  count(*) FILTER (pseudo = 0) AS labeled, count(*) FILTER (pseudo = 1) AS pseudo,
  count(*) FILTER (pseudo = 1 AND y = 1) AS pos, count(*) FILTER (pseudo = 1 AND y = 0) AS neg
FROM train{r} GROUP BY g"""
        for r in range(rounds + 1)
    )


def _swept(threshold: float, cut: float, name: str) -> str:
    """Metrics of one variant's out-of-fold scores."""
    hit, tag = f"score >= CAST({cut} AS DOUBLE)", f"CAST({threshold} AS DOUBLE) AS threshold"
    return f"""SELECT {tag}, CAST({cut} AS DOUBLE) AS cut,
  round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(mse, 6) AS mse
FROM (SELECT CAST(count(*) AS DOUBLE) AS n,
  CAST(count(*) FILTER ({hit} AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER ({hit} AND y = 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (NOT {hit} AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT {hit} AND y = 0) AS DOUBLE) AS tn,
  avg((score - y) * (score - y)) AS mse
  FROM {name} JOIN (SELECT row_id, "LABEL" AS y FROM lab) USING (row_id))"""


ELASTIC_ORACLE: dict[str, str] = {
    "elastic_scores": f"""WITH RECURSIVE {LAB}, {UNL}, {ENCODED},
labelled AS (SELECT 0 AS g, row_id, "LABEL" AS y, emb FROM lab JOIN encoded USING (row_id)),
open_rows AS (SELECT 0 AS g, row_id, emb FROM unl JOIN encoded USING (row_id)),
{elastic("fit", "labelled", "open_rows")}
SELECT row_id, {_rounded("score", SCORE_DIGITS)} FROM fit""",
    "elastic_self_training": f"""{BASE}, {self_trained(2, 0.9)}
{_round_counts(2)}""",
    "round_changes": f"""{BASE}, {self_trained(2, 0.85)}
{_round_changes(2)}""",
    "elastic_fit_predict": f"""{BASE}, {self_trained(1, 0.9)}
SELECT row_id, {_rounded("score")}, {label_cut(0.5)} AS "LABEL" FROM fit1""",
    "run_job": f"""{BASE}, {self_trained(1, 0.85)}
SELECT row_id, {label_cut(0.5)} AS "LABEL" FROM fit1""",
    "elastic_cv": f"""{BASE}, {FOLDS}, {elastic("fit", "fold_train", "fold_held")}
SELECT CAST(g AS INTEGER) AS fold, row_id, "LABEL" AS y, {_rounded("score")}
FROM fit JOIN lab USING (row_id)""",
    "elastic_cv_ensemble": f"""{BASE}, {FOLDS},
{EVERY},
{elastic("fit", "fold_train", "every")},
means AS (SELECT row_id, avg(score) AS score FROM fit GROUP BY row_id)
SELECT row_id, {_rounded("score")}, {label_cut(0.5)} AS "LABEL" FROM means""",
    "elastic_cv_rounds": f"""{BASE}, {FOLDS}, {EVERY}, {fold_rounds(2, 0.9)}
{_fold_counts(2)}""",
    "elastic_sweep": f"""{BASE}, {FOLDS}, {EVERY}, {fold_rounds(1, 0.8, "a")}, {fold_rounds(1, 0.9, "b")},
{elastic("low", "atrain1", "fold_held")}, {elastic("high", "btrain1", "fold_held")}
{_swept(0.8, 0.5, "low")} UNION ALL {_swept(0.9, 0.5, "high")} UNION ALL {_swept(0.9, 0.6, "high")}""",
    "elastic_splits": f"""{BASE}, {SPLITS}, {elastic("fit", "split_train", "split_held")}
SELECT CAST(g AS INTEGER) AS fold, row_id, lab."LABEL" AS y, {_rounded("score")}, {label_cut(0.5)} AS "LABEL"
FROM fit JOIN lab USING (row_id)""",
}
