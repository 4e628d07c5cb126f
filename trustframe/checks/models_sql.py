"""SQL of the closed-form learners: CTEs over ``train`` (keys, x, y[, w]) and ``test``
(keys, row_id, x, y)."""

from __future__ import annotations

from collections.abc import Sequence


def _k(keys: Sequence[str], alias: str = "") -> str:
    return ", ".join(f"{alias}{k}" for k in keys)


def centroid_cte(
    keys: Sequence[str], dims: Sequence[int], out: str = "cpred", train: str = "train", test: str = "test", w: str = "1"
) -> str:
    """``out`` (keys, row_id, y_true, y_pred); dims are 1-based."""
    on = f"USING ({_k(keys)})" if keys else "ON true"
    lead = _k(keys) + ", " if keys else ""
    tlead = _k(keys, "t.") + ", " if keys else ""
    return f"""{out}_c AS (SELECT {lead}y AS c, i, sum({w} * x[i]) / sum({w}) AS m FROM {train},
    (SELECT unnest({list(dims)}) AS i) GROUP BY ALL),
  {out}_d AS (SELECT {tlead}t.row_id, t.y AS y_true, c, sum((x[i] - m) ** 2) AS d FROM {test} t JOIN {out}_c {on} GROUP BY ALL),
  {out} AS (SELECT {lead}row_id, y_true, CAST(arg_min(c, d) AS INTEGER) AS y_pred FROM {out}_d GROUP BY ALL)"""


def gnb_cte(
    keys: Sequence[str], dims: Sequence[int], out: str = "gpred", train: str = "train", test: str = "test", w: str = "1"
) -> str:
    """``out`` (keys, row_id, y_true, y_pred) and ``out_s`` with normalised class support ``p``."""
    on = f"USING ({_k(keys)})" if keys else "ON true"
    lead = _k(keys) + ", " if keys else ""
    tlead = _k(keys, "t.") + ", " if keys else ""
    part = f"PARTITION BY {_k(keys)}" if keys else ""
    if w == "1":
        moments = f"""{out}_m AS (SELECT {lead}y AS c, i, CAST(count(*) AS DOUBLE) AS n, avg(x[i]) AS m, var_pop(x[i]) AS v FROM {train},
    (SELECT unnest({list(dims)}) AS i) GROUP BY ALL)"""
    else:
        non = f"USING ({lead}c, i)"
        moments = f"""{out}_l AS (SELECT {lead}y AS c, i, x[i] AS xi, {w} AS w FROM {train}, (SELECT unnest({list(dims)}) AS i)),
  {out}_a AS (SELECT {lead}c, i, sum(w) AS n, sum(w * xi) / sum(w) AS m FROM {out}_l GROUP BY ALL),
  {out}_m AS (SELECT {lead}c, i, n, m, sum(w * (xi - m) ** 2) / sum(w) AS v FROM {out}_l JOIN {out}_a {non} GROUP BY ALL)"""
    return f"""{moments},
  {out}_v AS (SELECT * REPLACE (greatest(v, CASE WHEN top > 0 THEN top * 1e-9 ELSE 1e-9 END) AS v) FROM
    (SELECT *, max(v) OVER ({part}) AS top FROM {out}_m)),
  {out}_j AS (SELECT {tlead}t.row_id, t.y AS y_true, c, ln(any_value(n)) + sum(-0.5 * ln(2 * pi() * v) - (x[i] - m) ** 2 / (2 * v)) AS s
    FROM {test} t JOIN {out}_v {on} GROUP BY ALL),
  {out}_s AS (SELECT *, e / sum(e) OVER (PARTITION BY {lead}row_id) AS p FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY {lead}row_id)) AS e FROM {out}_j)),
  {out} AS (SELECT {lead}row_id, y_true, CAST(arg_max(c, s) AS INTEGER) AS y_pred FROM {out}_j GROUP BY ALL)"""


def folds_cte(src: str, k: int, keys: Sequence[str] = (), out: str = "test", y: str = "y", seed: int = 1410) -> str:
    """``out`` = src plus fold."""
    lead = "".join(f"{x}, " for x in keys)
    return f"""{out} AS (SELECT *, CAST(ntile({k}) OVER (PARTITION BY {lead}{y} ORDER BY
    md5(concat_ws('|', {seed}, {lead}row_id)), row_id) - 1 AS INTEGER) AS fold FROM {src})"""


def train_cte(k: int, test: str = "test", out: str = "train") -> str:
    return f"""{out} AS (SELECT t.* REPLACE (CAST(f.f AS INTEGER) AS fold) FROM {test} t JOIN (SELECT unnest(range({k})) AS f) f ON t.fold <> f.f)"""


def f1_cte(keys: Sequence[str], pred: str, out: str = "f1") -> str:
    """``out`` (keys, f1): support-weighted F1."""
    lead = _k(keys) + ", " if keys else ""
    group = f"GROUP BY {_k(keys)}" if keys else ""
    return f"""{out}_c AS (SELECT {lead}c, CAST(count(*) FILTER (y_true = c AND y_pred = c) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (y_true = c) AS DOUBLE) AS sup, CAST(count(*) FILTER (y_pred = c) AS DOUBLE) AS pre FROM
    (SELECT *, unnest(CASE WHEN y_true = y_pred THEN [y_true] ELSE [y_true, y_pred] END) AS c FROM {pred}) GROUP BY ALL),
  {out} AS (SELECT {lead}sum(sup * 2 * tp / (sup + pre)) / sum(sup) AS f1 FROM {out}_c {group})"""


def tree_cte(depth: int, features, n_classes: int, out: str = "tpred") -> str:
    """Greedy Gini tree of the table ``train``, applied to ``test``: (row_id, y_true, y_pred)."""
    codes = range(n_classes)

    def quality(side: str) -> str:
        return f"({' + '.join(f'{side}{c} * {side}{c}' for c in codes)}) / ({' + '.join(f'{side}{c}' for c in codes)})"

    parts = ["at0 AS (SELECT row_id, x, y, 1 AS node, true AS fits FROM train UNION ALL SELECT row_id, x, y, 1, false FROM test)"]
    for level in range(depth):
        counts = ", ".join(f"CAST(count(*) FILTER (y = {c}) AS DOUBLE) AS c{c}" for c in codes)
        below = ", ".join(f"sum(c{c}) OVER (PARTITION BY node, f ORDER BY v) AS l{c}" for c in codes)
        whole = ", ".join(f"sum(c{c}) OVER (PARTITION BY node, f) AS t{c}" for c in codes)
        above = ", ".join(f"t{c} - l{c} AS r{c}" for c in codes)
        mixed = " + ".join(f"(t{c} > 0)::INT" for c in codes)
        parts += [
            f"cell{level} AS (SELECT node, f, x[f] AS v, {counts} FROM at{level}, (SELECT unnest({list(features)}) AS f) WHERE fits GROUP BY ALL)",
            f"sums{level} AS (SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS above, {below}, {whole} FROM cell{level})",
            f"side{level} AS (SELECT *, {above} FROM sums{level} WHERE above IS NOT NULL AND {mixed} > 1)",
            f"""cut{level} AS (SELECT node, f, CASE WHEN (v + above) / 2 < above THEN (v + above) / 2 ELSE v END AS t FROM side{level}
              QUALIFY row_number() OVER (PARTITION BY node ORDER BY {quality('l')} + {quality('r')} DESC, f, v) = 1)""",
            f"""at{level + 1} AS (SELECT row_id, x, y, CASE WHEN f IS NULL THEN node ELSE 2 * node + (x[f] > t)::INT END AS node, fits
              FROM at{level} LEFT JOIN cut{level} USING (node))""",
        ]
    parts += [
        f"""leaf AS (SELECT node, y AS y_pred FROM at{depth} WHERE fits GROUP BY node, y
          QUALIFY row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, y) = 1)""",
        f"{out} AS (SELECT row_id, y AS y_true, y_pred FROM at{depth} JOIN leaf USING (node) WHERE NOT fits)",
    ]
    return ",\n".join(parts)
