"""The same queries as plain SQL, for comparison with another engine.

Queries that fit a model have no SQL counterpart and are absent here.
"""

from __future__ import annotations

from labelspring.functions.columns import MISSING_TEXTS

WIDTH = 64

# Metrics of few rows are short decimals, which a coarser rounding would often meet
# exactly half way; there the order of a sum would decide.
DIGITS = 10
LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIMS = range(WIDTH)


def digest(key: str, tag: str | None = None) -> str:
    tail = f" || ':{tag}'" if tag else ""
    return f"md5('42:' || CAST({key} AS VARCHAR){tail})"


def h(key: str, tag: str) -> str:
    return f"CAST(('0x' || substr({digest(key, tag)}, 1, 8)) AS BIGINT)"


def wide_h(key: str, tag: str) -> str:
    """60 bits of the digest, by which positions in a pool are drawn."""
    return f"CAST(('0x' || substr({digest(key, tag)}, 1, 15)) AS BIGINT)"


def rank(order: str, by: str = "", key: str = "row_id") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(row_number() OVER ({part}ORDER BY {order}, {key}) - 1)"


NAN_LIST = ", ".join(f"'{t}'" for t in MISSING_TEXTS)


def as_string(text: str) -> str:
    return f"CASE WHEN {text} IS NULL OR {text} IN ({NAN_LIST}) THEN 'nan' ELSE {text} END"


DOCS = "docs AS (SELECT doc_id AS row_id, text AS \"TEXT\" FROM documents)"
LAB = """lab AS (
  SELECT d.doc_id AS row_id, d.text AS "TEXT", CAST(l.quality AS INTEGER) AS "LABEL"
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
UNL = """unl AS (
  SELECT d.doc_id AS row_id, d.text AS "TEXT", CAST(-1 AS INTEGER) AS "LABEL"
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"""
VEC = """vec AS (
  SELECT vec_id AS row_id, CAST(label >= 5 AS INTEGER) AS "LABEL",
         CAST(embedding AS DOUBLE[]) AS emb
  FROM embeddings)"""
SCO = f"""sco AS (
  SELECT d.doc_id AS row_id, ({h("d.doc_id", "score")} % 201) / CAST(200 AS DOUBLE) AS score,
         CAST(l.quality AS INTEGER) AS y
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
JUDGED = "judged AS (SELECT * FROM sco WHERE y IS NOT NULL)"
OPEN = "open_rows AS (SELECT row_id, score FROM sco WHERE y IS NULL)"

THR = "CAST(0.85 AS DOUBLE)"
PSEUDO = f"""pseudo AS (
  SELECT row_id, score,
         CAST(CASE WHEN score >= {THR} THEN 1 ELSE 0 END AS INTEGER) AS "LABEL"
  FROM open_rows
  WHERE score >= {THR} OR score <= CAST(1 AS DOUBLE) - {THR})"""
RANKED_PSEUDO = """ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY "LABEL"
    ORDER BY CASE WHEN "LABEL" = 1 THEN -score ELSE score END, row_id) AS place
  FROM pseudo)"""


def label_cut(cut: float) -> str:
    return f"CAST(CASE WHEN score >= CAST({cut} AS DOUBLE) THEN 1 ELSE 0 END AS INTEGER)"


def folded(table: str, label: str, k: int = 5) -> str:
    """Rows of a table with their fold."""
    numbered = f"""(SELECT *, row_number() OVER (
        ORDER BY "{label}", {digest("row_id")}, row_id) - 1 AS overall FROM {table})"""
    return f"folded AS (SELECT *, CAST(overall % {k} AS INTEGER) AS fold FROM {numbered})"


def pool(table: str) -> str:
    return f"""pool AS (
  SELECT row_id, "LABEL", {rank(digest("row_id", "pool"), '"LABEL"')} AS idx,
         count(*) OVER (PARTITION BY "LABEL") AS m
  FROM {table} WHERE "LABEL" IN (0, 1)),
sizes AS (SELECT DISTINCT "LABEL", m FROM pool)"""


def same(start: int, stop: int) -> str:
    return f"""
  SELECT d.p AS pair_id, a.row_id AS a, b.row_id AS b, CAST(1 AS DOUBLE) AS label
  FROM (
    SELECT p, cls, a_idx,
           CASE WHEN m > 1 THEN (a_idx + 1 + {wide_h("p", "b")} % greatest(m - 1, 1)) % m
                ELSE a_idx END AS b_idx
    FROM (SELECT i.p, s."LABEL" AS cls, s.m, {wide_h("i.p", "a")} % s.m AS a_idx
          FROM (SELECT unnest(range({start}, {stop})) AS p) i
          JOIN sizes s ON s."LABEL" = {h("i.p", "cls")} % 2)) d
  JOIN pool a ON a."LABEL" = d.cls AND a.idx = d.a_idx
  JOIN pool b ON b."LABEL" = d.cls AND b.idx = d.b_idx"""


def cross(start: int, stop: int) -> str:
    return f"""
  SELECT d.p AS pair_id, a.row_id AS a, b.row_id AS b, CAST(0 AS DOUBLE) AS label
  FROM (SELECT p, {wide_h("p", "pos")} % (SELECT m FROM sizes WHERE "LABEL" = 1) AS a_idx,
               {wide_h("p", "neg")} % (SELECT m FROM sizes WHERE "LABEL" = 0) AS b_idx
        FROM (SELECT unnest(range({start}, {stop})) AS p)) d
  JOIN pool a ON a."LABEL" = 1 AND a.idx = d.a_idx
  JOIN pool b ON b."LABEL" = 0 AND b.idx = d.b_idx"""


def pairs(table: str, n: int = 3000) -> str:
    return f"{pool(table)}, pairs AS ({same(0, n // 2)} UNION ALL {cross(n // 2, n)})"


PAIR_COSINE = f"""{VEC}, {pairs("vec")}, cosines AS (
  SELECT p.pair_id, p.a, p.b, p.label,
         list_dot_product(x.emb, y.emb)
           / (sqrt(list_dot_product(x.emb, x.emb)) * sqrt(list_dot_product(y.emb, y.emb)))
           AS cosine
  FROM pairs p JOIN vec x ON x.row_id = p.a JOIN vec y ON y.row_id = p.b)"""

SLOT_SHARE = "sum(CASE WHEN slot = {j} THEN c ELSE 0 END) / max(n) AS emb_{j}"
SLOTS = f"""tokens AS (
  SELECT row_id, unnest(regexp_split_to_array(lower({as_string('"TEXT"')}), '\\s+')) AS t
  FROM docs),
slots AS (
  SELECT row_id, {h("t", "token")} % {WIDTH} AS slot, CAST(count(*) AS DOUBLE) AS c
  FROM tokens GROUP BY 1, 2),
lengths AS (SELECT row_id, sqrt(sum(c * c)) AS n FROM slots GROUP BY 1),
bags AS (
  SELECT s.row_id, {", ".join(SLOT_SHARE.replace("{j}", str(j)) for j in DIMS)}
  FROM slots s JOIN lengths l ON s.row_id = l.row_id GROUP BY s.row_id)"""

RATIO = "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END"


def metrics(table: str, by: str = "", cut: float = 0.5, digits: int = DIGITS) -> str:
    """All metrics of a table with ``y`` and ``score``, one row for each ``by``."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    same_group = f"r.{by} = t.{by}" if by else "TRUE"
    pred = f"(score >= CAST({cut} AS DOUBLE))"

    def rounded(value: str, name: str) -> str:
        return f"round({value}, {digits}) AS {name}"

    return f"""grouped AS (
  SELECT {lead}score, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS cnt
  FROM {table} GROUP BY {lead}score),
running AS (
  SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS tp,
         sum(cnt) OVER ({part}ORDER BY score DESC) AS n FROM grouped),
ranking AS (
  SELECT {lead}sum((cnt - pos) * (tp - pos / 2)) / nullif(sum(pos) * sum(cnt - pos), 0) AS auc,
         sum(pos * tp / n) / sum(pos) AS pr_auc
  FROM running {group}),
cells AS (
  SELECT {lead}CAST(count(*) FILTER ({pred} AND y = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER ({pred} AND y = 0) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (NOT {pred} AND y = 1) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (NOT {pred} AND y = 0) AS DOUBLE) AS tn,
         avg((score - y) * (score - y)) AS mse
  FROM {table} {group}),
metrics AS (
  SELECT {"r." + by + ", " if by else ""}{rounded("r.auc", "auc")}, {rounded("r.pr_auc", "pr_auc")},
         {rounded("(tp + tn) / (tp + tn + fp + fn)", "accuracy")},
         {rounded(RATIO.format("tp", "(tp + fp)"), "precision")},
         {rounded(RATIO.format("tp", "(tp + fn)"), "recall")},
         {rounded(RATIO.format("2 * tp", "(2 * tp + fp + fn)"), "f1")},
         {rounded("mse", "mse")}
  FROM ranking r JOIN cells t ON {same_group})"""


def judged_metrics(columns: str, cut: float = 0.5) -> str:
    tables = f"{SCO}, {JUDGED}, {metrics('judged', cut=cut)}"
    return f"WITH {tables} SELECT {columns} FROM metrics"


FOLD_METRICS = f"{SCO}, {JUDGED}, {folded('judged', 'y')}, {metrics('folded', 'fold', digits=15)}"
METRIC_NAMES = ("auc", "pr_auc", "accuracy", "precision", "recall", "f1", "mse")
ROUNDED_METRICS = ", ".join(f"round({m}, {DIGITS}) AS {m}" for m in METRIC_NAMES)

AUGMENTED = f"""{SCO}, {JUDGED}, {OPEN}, {PSEUDO}, augmented AS (
  SELECT row_id, y AS "LABEL", CAST(0 AS INTEGER) AS is_pseudo FROM judged
  UNION ALL SELECT row_id, "LABEL", CAST(1 AS INTEGER) FROM pseudo)"""


def wide(value: str, digits: int | None = None, width: int = WIDTH) -> str:
    """One column for each dimension; ``{i}`` counts from 1."""
    cells = []
    for i in range(width):
        cell = value.replace("{i}", str(i + 1)).replace("{j}", str(i))
        cells.append(f"{cell if digits is None else f'round({cell}, {digits})'} AS emb_{i}")
    return ", ".join(cells)


def letter_count(letter: str) -> str:
    return f"""CAST(length("TEXT") - length(replace("TEXT", '{letter}', '')) AS DOUBLE)"""


_ENTRY = "CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE)"
_ROW = f"list_transform(range({WIDTH}), lambda j: {_ENTRY})"
IDENTITY = f"SELECT list_transform(range({WIDTH}), lambda i: {_ROW}) AS w"


def descent(
    epochs: int = 3,
    rate: float = 2.0,
    max_norm: float = 1.0,
    rows: str = VEC,
    start: str = IDENTITY,
) -> str:
    """Gradient descent on the pair loss, one group of tables for each epoch.

    ``rows`` defines the table ``vec`` and ``start`` selects the first matrix,
    ``w0``; ``w{e}`` holds the matrix after epoch ``e`` as one list of rows,
    ``step{e}`` the loss before that epoch and its gradient's norm.
    """
    parts = [
        f"""{rows}, {pairs("vec")},
w0 AS ({start}),
cells AS (
  SELECT row_id, unnest(range({WIDTH})) AS j, unnest(emb) AS x FROM vec)"""
    ]
    for e in range(1, epochs + 1):
        parts.append(f"""moved{e} AS MATERIALIZED (
  SELECT row_id, list_transform(w, lambda r: list_dot_product(r, emb)) AS u
  FROM vec, w{e - 1}),
unit{e} AS MATERIALIZED (
  SELECT row_id, n, list_transform(u, lambda x: x / n) AS u
  FROM (SELECT row_id, u, sqrt(list_dot_product(u, u)) AS n FROM moved{e})),
error{e} AS MATERIALIZED (
  SELECT p.a, p.b, a.u AS ua, b.u AS ub, a.n AS na, b.n AS nb,
         list_dot_product(a.u, b.u) AS c, list_dot_product(a.u, b.u) - p.label AS miss
  FROM pairs p JOIN unit{e} a ON a.row_id = p.a JOIN unit{e} b ON b.row_id = p.b),
pulls{e} AS (
  SELECT a AS row_id, unnest(range({WIDTH})) AS i, 2 * miss / na AS f, c,
         unnest(ub) AS other, unnest(ua) AS own FROM error{e}
  UNION ALL
  SELECT b, unnest(range({WIDTH})), 2 * miss / nb, c, unnest(ua), unnest(ub) FROM error{e}),
pulled{e} AS (
  SELECT row_id, i, sum(f * (other - c * own)) AS g FROM pulls{e} GROUP BY row_id, i),
grad{e} AS MATERIALIZED (
  SELECT i, j, sum(g * x) / (SELECT count(*) FROM pairs) AS g
  FROM pulled{e} JOIN cells USING (row_id) GROUP BY i, j),
step{e} AS (
  SELECT {e} AS epoch, (SELECT avg(miss * miss) FROM error{e}) AS loss, sqrt(sum(g * g)) AS size
  FROM grad{e}),
w{e} AS MATERIALIZED (
  SELECT list(r ORDER BY i) AS w FROM (
    SELECT i, list(w[i + 1][j + 1] - {rate} * least(1, {max_norm} / size) * g ORDER BY j) AS r
    FROM grad{e}, w{e - 1}, step{e} GROUP BY i))""")
    return ",\n".join(parts)


def step_descent(
    epochs: int = 3,
    size: int = 8,
    rate: float = 0.05,
    warmup: int = 100,
    max_norm: float = 1.0,
) -> str:
    """Descent with a step for each batch of pairs, as one recursion over the batches.

    ``state`` has a row for each step: the matrix ``w`` after it, the summed
    ``loss`` of its batch before it, and its gradient's norm ``size``.
    """
    orders = " UNION ALL ".join(
        f"""SELECT {e} AS epoch, p.label, x.emb AS va, y.emb AS vb,
       {rank(digest("pair_id", f"steps-{e}"), key="pair_id")} AS place
FROM pairs p JOIN vec x ON x.row_id = p.a JOIN vec y ON y.row_id = p.b"""
        for e in range(1, epochs + 1)
    )
    dims = f"range({WIDTH})"
    moved = "list_transform({v}, lambda x: list_transform(s.w, lambda r: list_dot_product(r, x)))"
    length = "list_transform({u}, lambda x: sqrt(list_dot_product(x, x)))"
    unit = "list_transform(range(n), lambda k: list_transform({u}[k + 1], lambda x: x / {l}[k + 1]))"
    pull = (
        "list_transform(range(n), lambda k: list_transform({dims}, lambda i: "
        "2 * (c[k + 1] - labels[k + 1]) "
        "* ({other}[k + 1][i + 1] - c[k + 1] * {own}[k + 1][i + 1]) / {l}[k + 1]))"
    )
    return f"""{VEC}, {pairs("vec")},
placed AS ({orders}),
batched AS MATERIALIZED (
  SELECT epoch, place // {size} AS batch, list(label ORDER BY place) AS labels,
         list(va ORDER BY place) AS va, list(vb ORDER BY place) AS vb, count(*) AS n
  FROM placed GROUP BY ALL),
counted AS (SELECT count(*) AS total FROM batched),
columns AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY epoch, batch) - 1 AS step,
         list_transform({dims}, lambda j: list_transform(list_concat(va, vb), lambda x: x[j + 1])) AS cols
  FROM batched),
scheduled AS MATERIALIZED (
  SELECT *, {rate} * CASE WHEN step < {warmup} THEN step / CAST({warmup} AS DOUBLE)
    ELSE (total - step) / CAST(greatest(1, total - {warmup}) AS DOUBLE) END AS rate
  FROM columns, counted),
state AS (
  WITH RECURSIVE state AS (
    SELECT CAST(-1 AS BIGINT) AS step, CAST(0 AS DOUBLE) AS loss, CAST(0 AS DOUBLE) AS size,
           list_transform({dims}, lambda i: list_transform({dims},
             lambda j: CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE))) AS w
    UNION ALL
    SELECT step, loss, size, list_transform({dims}, lambda i: list_transform({dims},
             lambda j: w[i + 1][j + 1] - rate * least(1, {max_norm} / size) * g[i + 1][j + 1])) AS w
    FROM (
      SELECT *, sqrt(list_sum(list_transform(g, lambda r: list_dot_product(r, r)))) AS size
      FROM (
        SELECT *, list_transform(pulls, lambda p: list_transform(cols,
                 lambda x: list_dot_product(p, x) / n)) AS g
        FROM (
          SELECT *, list_transform({dims}, lambda i: list_transform(list_concat(
                   {pull.format(dims=dims, other="ub", own="ua", l="la")},
                   {pull.format(dims=dims, other="ua", own="ub", l="lb")}), lambda x: x[i + 1])) AS pulls,
                 list_sum(list_transform(range(n),
                   lambda k: (c[k + 1] - labels[k + 1]) * (c[k + 1] - labels[k + 1]))) AS loss
          FROM (
            SELECT *, list_transform(range(n), lambda k: list_dot_product(ua[k + 1], ub[k + 1])) AS c
            FROM (
              SELECT * EXCLUDE (ua, ub), {unit.format(u="ua", l="la")} AS ua,
                     {unit.format(u="ub", l="lb")} AS ub
              FROM (
                SELECT *, {length.format(u="ua")} AS la, {length.format(u="ub")} AS lb
                FROM (
                  SELECT b.*, s.w, {moved.format(v="b.va")} AS ua, {moved.format(v="b.vb")} AS ub
                  FROM state s JOIN scheduled b ON b.step = s.step + 1)))))))
  ) SELECT * FROM state)"""


SPLIT_KEY = "CAST(round AS VARCHAR) || '/' || CAST(row_id AS VARCHAR)"
HELD_OUT = "(place < round(CAST(0.2 AS DOUBLE) * m))"


def split_rounds(table: str, rounds: int = 5) -> str:
    """Rows of a table, once for each round, ranked in their class."""
    return f"""repeated AS (
  SELECT CAST(r AS INTEGER) AS round, row_id, "LABEL"
  FROM {table}, (SELECT unnest(range({rounds})) AS r)),
ranked AS (
  SELECT *, {rank(digest(SPLIT_KEY, "split"), 'round, "LABEL"')} AS place,
         count(*) OVER (PARTITION BY round, "LABEL") AS m FROM repeated)"""


GAPPY = f"""gappy AS (
  SELECT row_id, CASE WHEN {h("row_id", "gap")} % 10 = 0 THEN NULL
                      WHEN {h("row_id", "gap")} % 10 = 1 THEN 'NA' ELSE "TEXT" END AS "TEXT"
  FROM docs)"""
MASK_DRAW = f"{h('''row_id || '/' || CAST(i - 1 AS VARCHAR)''', 'mask')} / CAST(4294967296 AS DOUBLE)"

LETTER_SHARES = f"""WITH {DOCS}, letters AS (
  SELECT row_id, [{", ".join(letter_count(c) for c in LETTERS)}] AS c FROM docs),
lengths AS (SELECT row_id, c, sqrt(list_dot_product(c, c)) AS n FROM letters)
SELECT row_id, {wide("CASE WHEN n > 0 THEN c[{i}] / n ELSE 0 END", 9, len(LETTERS))}
FROM lengths"""

ORACLE: dict[str, str] = {
    "read_labelled": f"""WITH {LAB}
SELECT row_id, {as_string('"TEXT"')} AS "TEXT", "LABEL" FROM lab""",
    "read_unlabelled": f"""WITH {UNL}
SELECT row_id, {as_string('"TEXT"')} AS "TEXT", "LABEL" FROM unl""",
    "class_balance": f"""WITH {LAB}
SELECT count(*) AS n_rows, count(*) FILTER ("LABEL" = 1) AS n_pos,
       count(*) FILTER ("LABEL" = 0) AS n_neg FROM lab""",
    "write_predictions": f"""WITH {SCO}, {OPEN}
SELECT row_id, {label_cut(0.5)} AS "LABEL" FROM open_rows""",
    "oof_table": f"""WITH {SCO}, {JUDGED}, {folded("judged", "y")}
SELECT fold, row_id, y, score FROM folded""",
    "feature_wide": f"""WITH {VEC} SELECT row_id, "LABEL", {wide("emb[{i}]")} FROM vec""",
    "text_as_string": f"""WITH {DOCS}, {GAPPY}
SELECT row_id, {as_string('"TEXT"')} AS "TEXT" FROM gappy""",
    "class_pools": """SELECT vec_id AS row_id, label AS "LABEL" FROM embeddings
WHERE label IN (0, 1)""",
    "sentinel_label": f"""WITH {UNL}
SELECT row_id, CAST(-1 AS INTEGER) AS "LABEL" FROM unl""",
    "clip_score": f"""WITH {SCO}
SELECT row_id, round(least(greatest(
    score * CAST(1.6 AS DOUBLE) - CAST(0.3 AS DOUBLE), 0), 1), 9) AS score FROM sco""",
    "label_by_cut": f"""WITH {SCO} SELECT row_id, {label_cut(0.5)} AS "LABEL" FROM sco""",
    "label_by_cut_060": f"""WITH {SCO} SELECT row_id, {label_cut(0.6)} AS "LABEL" FROM sco""",
    "fold_rows": f"""WITH {VEC}, {folded("vec", "LABEL")}
SELECT row_id, CASE WHEN fold = 2 THEN 'held_out' ELSE 'train' END AS part FROM folded""",
    "metric_report": f"""WITH {FOLD_METRICS}
SELECT fold, printf('%.4f', accuracy) AS accuracy, printf('%.4f', precision) AS precision,
       printf('%.4f', recall) AS recall, printf('%.4f', f1) AS f1 FROM metrics""",
    "labelled_view": f"""WITH {LAB} SELECT row_id, "TEXT", "LABEL" FROM lab""",
    "unlabelled_view": f"""WITH {UNL} SELECT row_id, "TEXT", "LABEL" FROM unl""",
    "pair_texts": f"""WITH {LAB}, {pairs("lab")}
SELECT p.pair_id, p.label, p.a, p.b, x."TEXT" AS "TEXT_a", y."TEXT" AS "TEXT_b"
FROM pairs p JOIN lab x ON x.row_id = p.a JOIN lab y ON y.row_id = p.b""",
    "pairs_same_class": f"""WITH {VEC}, {pool("vec")} {same(0, 3000)}""",
    "pairs_cross_class": f"""WITH {VEC}, {pool("vec")} {cross(0, 3000)}""",
    "pairs_shuffled": f"""WITH {VEC}, {pairs("vec")}
SELECT pair_id, a, b, label, {rank(digest("pair_id", "shuffle"), key="pair_id")} AS position
FROM pairs""",
    "simcse_pairs": f"""WITH {LAB}, {UNL}
SELECT row_id, "TEXT" AS anchor, "TEXT" AS positive FROM lab
UNION ALL SELECT row_id, "TEXT", "TEXT" FROM unl""",
    "class_index": f"""WITH {VEC}, {pool("vec")}
SELECT row_id, "LABEL", idx, m AS pool_size FROM pool""",
    "stratified_folds": f"""WITH {VEC}, {folded("vec", "LABEL")}
SELECT row_id, "LABEL", fold FROM folded""",
    "shuffle_splits": f"""WITH {VEC}, {split_rounds("vec")}
SELECT round, row_id, "LABEL", CAST({HELD_OUT} AS INTEGER) AS held_out FROM ranked""",
    "split_assignment": f"""WITH {LAB}, {split_rounds("lab")}
SELECT round AS fold, row_id, "LABEL" AS y FROM ranked WHERE {HELD_OUT}""",
    "cv_assignment": f"""WITH {LAB}, {folded("lab", "LABEL")}
SELECT fold, row_id, "LABEL" AS y FROM folded""",
    "mlm_mask": f"""WITH {DOCS},
split AS (SELECT row_id, string_split("TEXT", ' ') AS tk FROM docs),
drawn AS (
  SELECT row_id, tk,
         list_transform(tk, lambda x, i: {MASK_DRAW} < CAST(0.15 AS DOUBLE)) AS hit
  FROM split),
chosen AS (SELECT *, list_filter(range(len(tk)), lambda p: hit[p + 1]) AS places FROM drawn)
SELECT row_id,
       array_to_string(list_transform(tk, lambda x, i:
         CASE WHEN hit[i] THEN '<mask>' ELSE x END), ' ') AS masked_text,
       CAST(len(places) AS INTEGER) AS n_masked,
       coalesce(array_to_string(places, ','), '') AS positions,
       coalesce(array_to_string(list_transform(places, lambda p: tk[p + 1]), ' '), '') AS tokens
FROM chosen""",
    "batches": f"""WITH {DOCS}
SELECT row_id, CAST(floor({rank(digest("row_id", "batch"))} / 64) AS BIGINT) AS batch_id
FROM docs""",
    "hashed_encode": f"""WITH {DOCS}, {SLOTS}
SELECT row_id, {wide("emb_{j}", 9)} FROM bags""",
    "embed_join": f"""WITH {DOCS}, {VEC}
SELECT d.row_id, d."TEXT", {wide("v.emb[{i}]")}
FROM docs d JOIN vec v ON d.row_id = v.row_id""",
    "model_encode": LETTER_SHARES,
    "encode_once": LETTER_SHARES,
    "l2_normalise": f"""WITH {VEC}, stretched AS (
  SELECT row_id, list_transform(emb, lambda x: x * (row_id % 7 + 1)) AS e FROM vec),
lengths AS (SELECT row_id, e, sqrt(list_dot_product(e, e)) AS n FROM stretched)
SELECT row_id, {wide("e[{i}] / n", 6)} FROM lengths""",
    "pair_cosine": f"""WITH {PAIR_COSINE}
SELECT pair_id, a, b, label, round(cosine, 6) AS cosine FROM cosines""",
    "cosine_pair_loss": f"""WITH {PAIR_COSINE}
SELECT round(avg((cosine - label) * (cosine - label)), 6) AS loss, count(*) AS n_pairs
FROM cosines""",
    "in_batch_ranking_loss": f"""WITH {DOCS}, {SLOTS}, batched AS (
  SELECT row_id, [{", ".join(f"emb_{i}" for i in DIMS)}] AS v,
         floor({rank(digest("row_id", "batch"))} / 32) AS batch_id FROM bags),
closeness AS (
  SELECT a.row_id, a.row_id = b.row_id AS own, 20 * list_dot_product(a.v, b.v) AS s
  FROM batched a JOIN batched b ON a.batch_id = b.batch_id),
losses AS (
  SELECT row_id, ln(sum(exp(s))) - max(CASE WHEN own THEN s END) AS loss
  FROM closeness GROUP BY row_id)
SELECT round(avg(loss), 6) AS loss, count(*) AS n_rows FROM losses""",
    "scaler_stats": f"""WITH {VEC},
cells AS (SELECT unnest(range({WIDTH})) AS dim, unnest(emb) AS x FROM vec),
stats AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std FROM cells GROUP BY dim)
SELECT CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean,
       round(CASE WHEN std > 0 THEN std ELSE 1 END, 6) AS std FROM stats""",
    "scaled_features": f"""WITH {VEC}
SELECT row_id, "LABEL",
       {wide("(emb[{i}] - avg(emb[{i}]) OVER ()) / (stddev_pop(emb[{i}]) OVER ())", 6)}
FROM vec""",
    "projection_fit": f"""WITH {descent()},
last AS (
  SELECT row_id, list_transform(w, lambda r: list_dot_product(r, emb)) AS u FROM vec, w3),
lengths AS (SELECT row_id, u, sqrt(list_dot_product(u, u)) AS n FROM last)
SELECT row_id, {wide("u[{i}] / n", 6)} FROM lengths""",
    "projection_steps": f"""WITH {step_descent()},
last AS (
  SELECT row_id, list_transform(w, lambda r: list_dot_product(r, emb)) AS u
  FROM vec, (SELECT w FROM state ORDER BY step DESC LIMIT 1)),
lengths AS (SELECT row_id, u, sqrt(list_dot_product(u, u)) AS n FROM last)
SELECT row_id, {wide("u[{i}] / n", 6)} FROM lengths""",
    "step_epoch_loss": f"""WITH {step_descent()}
SELECT 'steps' AS stage, CAST(epoch AS INTEGER) AS epoch, round(sum(s.loss) / sum(n), 6) AS loss,
       round(avg(s.size), 6) AS grad_norm, CAST(sum(n) AS BIGINT) AS n
FROM state s JOIN scheduled b ON b.step = s.step GROUP BY epoch""",
    "pair_epoch_loss": f"""WITH {descent()},
steps AS (SELECT * FROM step1 UNION ALL SELECT * FROM step2 UNION ALL SELECT * FROM step3)
SELECT 'pairs' AS stage, CAST(epoch AS INTEGER) AS epoch, round(loss, 6) AS loss,
       round(size, 6) AS grad_norm, (SELECT count(*) FROM pairs) AS n FROM steps""",
    "pseudo_select": f"""WITH {SCO}, {OPEN}, {PSEUDO} SELECT row_id, score, "LABEL" FROM pseudo""",
    "pseudo_topk": f"""WITH {SCO}, {OPEN}, {PSEUDO}, {RANKED_PSEUDO}
SELECT row_id, score, "LABEL" FROM ranked WHERE place <= 20""",
    "pseudo_topk_round": f"""WITH {SCO}, {OPEN}, {PSEUDO}, {RANKED_PSEUDO},
caps AS (SELECT * FROM (VALUES (0, 10), (1, 20), (2, NULL)) AS t(round, cap))
SELECT row_id, score, "LABEL", CAST(round AS INTEGER) AS round
FROM ranked JOIN caps ON cap IS NULL OR place <= cap""",
    "augment": f"""WITH {AUGMENTED} SELECT row_id, "LABEL", is_pseudo FROM augmented""",
    "augment_empty": f"""WITH {AUGMENTED} SELECT row_id, "LABEL", is_pseudo FROM augmented""",
    "round_counts": f"""WITH {AUGMENTED}
SELECT count(*) AS total_train, count(*) FILTER (is_pseudo = 0) AS labeled,
       count(*) FILTER (is_pseudo = 1) AS pseudo,
       count(*) FILTER (is_pseudo = 1 AND "LABEL" = 1) AS pos,
       count(*) FILTER (is_pseudo = 1 AND "LABEL" = 0) AS neg FROM augmented""",
    "roc_auc": judged_metrics("auc"),
    "average_precision": judged_metrics("pr_auc"),
    "accuracy": judged_metrics("accuracy"),
    "precision_recall_f1": judged_metrics("precision, recall, f1"),
    "mse": judged_metrics("mse"),
    "confusion": f"""WITH {SCO}, {JUDGED}
SELECT CAST(k AS INTEGER) AS y,
       count(*) FILTER (j.y = k AND score < CAST(0.5 AS DOUBLE)) AS pred_0,
       count(*) FILTER (j.y = k AND score >= CAST(0.5 AS DOUBLE)) AS pred_1
FROM judged j, (SELECT unnest([0, 1]) AS k) GROUP BY k""",
    "metrics_log": f"""WITH {FOLD_METRICS}
SELECT run, fold, {ROUNDED_METRICS} FROM metrics, (VALUES ('first'), ('second')) AS t(run)""",
    "fold_metrics": f"WITH {FOLD_METRICS} SELECT fold, {ROUNDED_METRICS} FROM metrics",
    "fold_summary": f"WITH {FOLD_METRICS} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), {DIGITS}) AS mean, "
        f"round(stddev_pop({m}), {DIGITS}) AS std FROM metrics"
        for m in METRIC_NAMES
    ),
    "oof_metrics": judged_metrics(", ".join(METRIC_NAMES)),
    "metrics_at_cut": judged_metrics(", ".join(METRIC_NAMES), cut=0.6),
    "fold_ensemble": f"""WITH {UNL}, means AS (
  SELECT row_id, ({" + ".join(
      f"({h(f'''{f} || '/' || CAST(row_id AS VARCHAR)''', 'score')} % 201) / CAST(200 AS DOUBLE)"
      for f in range(5))}) / 5 AS score FROM unl)
SELECT row_id, round(score, 9) AS score, {label_cut(0.5)} AS "LABEL" FROM means""",
}
