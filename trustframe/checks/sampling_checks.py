"""Samples, splits, folds, permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustframe.checks import query
from trustframe.checks.tables import (
    FEATURES, IMBALANCED, LINES, POINTS, VECTORS, hash_sql, imbalanced, lines, points, table, vectors, with_,
)
from trustframe.ensembles import subspaces as subs
from trustframe.ensembles.members import project
from trustframe.operators import permuting, sampling
from trustframe.operators.scoring import label_corr as corr_of
from trustframe.operators.transforming import label_encode


def md5_sql(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def ids(df):
    return df.select("row_id", "y")


@query(with_(LINES, select=f"""SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax, label FROM (SELECT *,
  row_number() OVER (PARTITION BY label ORDER BY {md5_sql('1410', 'row_id')}, row_id) AS rn FROM lines) WHERE rn <= 5000"""))
def capped_sample(spark, folder):
    return sampling.capped_sample(lines(spark, folder), limit=5000).select("row_id", *FEATURES, "label")


@query(with_(LINES, select="SELECT label, least(count(*), 5000) AS n FROM lines GROUP BY label"))
def analyzed_samples(spark, folder):
    return sampling.analyzed_samples(lines(spark, folder), limit=5000)


@query("""SELECT p_partkey AS row_id, p_brand AS label FROM part WHERE p_brand IN
  (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 80)""")
def rare_class_filter(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("label"))
    return sampling.rare_class_filter(parts, min_rows=80)


@query("""SELECT count(*) FILTER (n <= 80) AS filtered_classes FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)""")
def rare_class_count(spark, folder):
    return sampling.rare_class_count(table(spark, folder, "part").select(F.col("p_brand").alias("label")), min_rows=80)


@query(with_(VECTORS, select=f"""SELECT rep, row_id, y, rn <= greatest(1, round_even(0.7 * n, 0)) AS is_train FROM
  (SELECT r.rep, row_id, y, count(*) OVER (PARTITION BY r.rep, y) AS n, row_number() OVER (PARTITION BY r.rep, y
   ORDER BY {md5_sql('1410', 'r.rep', 'row_id')}, row_id) AS rn FROM vectors, (SELECT unnest(range(3)) AS rep) r)"""))
def stratified_split(spark, folder):
    copies = sampling.replicate(ids(vectors(spark, folder)), range(3))
    return sampling.stratified_split(copies, 0.7).select("rep", "row_id", "y", "is_train")


@query(with_(VECTORS, select=f"""SELECT row_id, y, CAST(ntile(5) OVER (PARTITION BY y ORDER BY {md5_sql('1410', 'row_id')},
  row_id) - 1 AS INTEGER) AS fold FROM vectors"""))
def stratified_kfold(spark, folder):
    return sampling.stratified_kfold(ids(vectors(spark, folder)), 5)


@query(with_(VECTORS, select=f"""SELECT row_id, y, CAST(ntile(7) OVER (ORDER BY {md5_sql('1410', 'row_id')}, row_id) - 1
  AS INTEGER) AS fold FROM vectors"""))
def kfold(spark, folder):
    return sampling.kfold(ids(vectors(spark, folder)), 7)


@query(with_(VECTORS, select=f"""SELECT r.rep, row_id, y, CAST(ntile(2) OVER (PARTITION BY r.rep, y ORDER BY
  {md5_sql('1410', 'r.rep', 'row_id')}, row_id) - 1 AS INTEGER) AS fold FROM vectors, (SELECT unnest(range(3)) AS rep) r"""))
def repeated_kfold(spark, folder):
    return sampling.repeated_kfold(ids(vectors(spark, folder)), 2, 3).select("rep", "row_id", "y", "fold")


BOOT = f"""ranked AS (SELECT row_id, y, row_number() OVER (ORDER BY {md5_sql('1410', 'row_id')}, row_id) AS rank,
    count(*) OVER () AS n FROM vectors),
  hits AS (SELECT member, rank, CAST(count(*) AS DOUBLE) AS w FROM (SELECT m.member,
      {hash_sql('1410', "'slot'", 'm.member', '0', 'rank')} % n + 1 AS rank
      FROM ranked, (SELECT unnest(range(3)) AS member) m) GROUP BY ALL),
  boot AS (SELECT CAST(member AS INTEGER) AS member, row_id, y, w FROM ranked JOIN hits USING (rank))"""


@query(with_(VECTORS, BOOT, select="SELECT * FROM boot"))
def bootstrap(spark, folder):
    return sampling.bootstrap(ids(vectors(spark, folder)), 3).select("member", "row_id", "y", "w")


STRAT_BOOT = f"""ranked AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {md5_sql('1410', 'row_id')}, row_id) AS rank,
    count(*) OVER (PARTITION BY y) AS n FROM vectors),
  hits AS (SELECT member, y, rank, CAST(count(*) AS DOUBLE) AS w FROM (SELECT m.member, y,
      {hash_sql('1410', "'slot'", 'm.member', 'y', 'rank')} % n + 1 AS rank
      FROM ranked, (SELECT unnest(range(10)) AS member) m) GROUP BY ALL),
  boot AS (SELECT CAST(member AS INTEGER) AS member, row_id, y, w FROM ranked JOIN hits USING (y, rank))"""


@query(with_(IMBALANCED, STRAT_BOOT, select="SELECT * FROM boot"))
def stratified_bootstrap(spark, folder):
    return sampling.stratified_bootstrap(ids(imbalanced(spark, folder)), 10).select("member", "row_id", "y", "w")


UNDER = f"""under AS (SELECT * EXCLUDE (rn, m) FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY
    {md5_sql('1410', "'under'", 'row_id')}, row_id) AS rn, (SELECT min(n) FROM (SELECT count(*) AS n FROM vectors GROUP BY y)) AS m
    FROM vectors) WHERE rn <= m)"""


@query(with_(IMBALANCED, UNDER, select="SELECT row_id, y FROM under"))
def undersample(spark, folder):
    return ids(sampling.undersample(imbalanced(spark, folder)))


OVER = f"""oranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {md5_sql('1410', "'over'", 'row_id')}, row_id) AS rank,
    count(*) OVER (PARTITION BY y) AS n, (SELECT max(n) FROM (SELECT count(*) AS n FROM vectors GROUP BY y)) - n AS deficit FROM vectors),
  oslots AS (SELECT y, rank, n, unnest(range(1, CAST(deficit // n + CASE WHEN rank <= deficit % n THEN 1 ELSE 0 END AS BIGINT) + 1))
    AS turn FROM oranked),
  ohits AS (SELECT y, {hash_sql('1410', "'slot'", 'y', 'rank', 'turn')} % n + 1 AS rank, count(*) AS hits FROM oslots GROUP BY ALL),
  over_ AS (SELECT row_id, x, y, CAST(1 + coalesce(hits, 0) AS DOUBLE) AS w FROM oranked LEFT JOIN ohits USING (y, rank))"""


@query(with_(IMBALANCED, OVER, select="SELECT row_id, y, w FROM over_"))
def oversample(spark, folder):
    return sampling.oversample(ids(imbalanced(spark, folder))).select("row_id", "y", "w")


PARTS = f"""k AS (SELECT CAST(greatest(2, round_even(max(n) / min(n), 0)) AS BIGINT) AS k FROM (SELECT count(*) AS n FROM vectors GROUP BY y)),
  blocks AS (SELECT *, row_number() OVER (ORDER BY {md5_sql('1410', "'split'", 'row_id')}, row_id) - 1 AS rn,
    count(*) OVER () AS n, k FROM vectors, k WHERE y = 0),
  parts AS (SELECT row_id, x, y, CAST(CASE WHEN rn < (n % k) * (n // k + 1) THEN rn // (n // k + 1)
      ELSE n % k + (rn - (n % k) * (n // k + 1)) // (n // k) END AS INTEGER) AS member FROM blocks
    UNION ALL SELECT row_id, x, y, CAST(unnest(range(k)) AS INTEGER) AS member FROM vectors, k WHERE y = 1)"""


@query(with_(IMBALANCED, PARTS, select="SELECT row_id, y, member FROM parts"))
def undersampled_folds(spark, folder):
    return sampling.undersampled_folds(ids(imbalanced(spark, folder))).select("row_id", "y", "member")


SPEC = permuting.spec_grid(2, [50, 10])


def bijection_sql(src: str, out: str, value: str, n: str, keys: str, walks: int = 9) -> str:
    """``out`` = src plus ``v``, the image of value in 0 ... n - 1 under the keyed permutation (``walks`` times through the network at most)."""
    mix = lambda x, r: f"(((({x} * 1103515245 + _k[{r}]) % 2147483647) * (({x} * 1103515245 + _k[{r}]) % 2147483647) + _k[{r}]) % 2147483629) >> 7"
    found = f"""SELECT *, {value} AS _v, CAST({n} AS BIGINT) AS _n, CAST(ceil(sqrt({n})) AS BIGINT) AS _a, CAST(ceil({n} / ceil(sqrt({n}))) AS BIGINT) AS _b, {keys} AS _k,
      CAST(0 AS BIGINT) AS _l, CAST(0 AS BIGINT) AS _r, false AS _in FROM {src}"""
    for _ in range(walks):
        found = f"SELECT * REPLACE (_v // _b AS _l, _v % _b AS _r) FROM ({found})"
        for r in range(1, 7):
            found = f"SELECT * REPLACE ((_l + ({mix('_r', r)})) % _a AS _l) FROM ({found})" if r % 2 else f"SELECT * REPLACE ((_r + ({mix('_l', r)})) % _b AS _r) FROM ({found})"
        found = f"SELECT * REPLACE (CASE WHEN _in THEN _v ELSE _l * _b + _r END AS _v, _in OR _l * _b + _r < _n AS _in) FROM ({found})"
    return f"{out} AS MATERIALIZED (SELECT * EXCLUDE (_v, _n, _a, _b, _k, _l, _r, _in), _v AS v FROM ({found}))"


def keys_sql(*parts: str) -> str:
    return "[" + ", ".join(f"{hash_sql(*parts, str(r))} % 2147483647" for r in range(6)) + "]"


def permuted_sql(redraw: bool = True, perms: int = 2, levels: str = "50, 10") -> str:
    sel = keys_sql("1410", "'select'", "perm", "perc", "y") if redraw else keys_sql("1410", "'select'", "y")
    return f"""sizes AS (SELECT y, count(*) AS n FROM vectors GROUP BY y),
  lev AS MATERIALIZED (SELECT *, coalesce(sum(target) OVER (PARTITION BY perm, perc ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first,
      (sum(target) OVER (PARTITION BY perm, perc))::BIGINT AS m, {sel} AS sk FROM (SELECT y, n, CAST(perm AS INTEGER) AS perm, perc, round_even(perc * n / 100.0, 0)::BIGINT AS target
      FROM sizes, (SELECT unnest(range({perms})) AS perm), (SELECT unnest([{levels}]) AS perc))),
  probe AS (SELECT perm, perc, m, y, t, first + unnest(range(least(target, 64))) AS s FROM lev, (SELECT unnest(range(5)) AS t)),
  {bijection_sql('probe', 'probed', 's', 'm', keys_sql('1410', "'shuffle'", 't', 'perm', 'perc'))},
  tried AS (SELECT p.perm, p.perc, least(4, coalesce(min(t) FILTER (p.y <> l.y), 4)) AS t FROM probed p JOIN lev l
      ON p.perm = l.perm AND p.perc = l.perc AND p.v >= l.first AND p.v < l.first + l.target GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {md5_sql('1410', "'rank'", 'row_id')}, row_id) - 1 AS rk FROM vectors),
  grid AS (SELECT r.row_id, r.x, r.y, rk, n, perm, perc, target, first, m, sk FROM ranked r JOIN lev ON r.y = lev.y),
  {bijection_sql('grid', 'placed', 'rk', 'n', 'sk')},
  spot AS (SELECT perm, perc, row_id, first + v AS s, m, {keys_sql('1410', "'shuffle'", 't', 'perm', 'perc')} AS fk FROM placed JOIN tried USING (perm, perc) WHERE v < target),
  {bijection_sql('spot', 'moved', 's', 'm', 'fk')},
  given AS (SELECT m.perm, m.perc, m.row_id, l.y AS y_new FROM moved m JOIN lev l ON m.perm = l.perm AND m.perc = l.perc AND m.v >= l.first AND m.v < l.first + l.target),
  permuted AS (SELECT g.perm, g.perc, g.row_id, g.x, g.y, coalesce(m.y_new, g.y) AS y_perm FROM grid g
      LEFT JOIN given m ON g.perm = m.perm AND g.perc = m.perc AND g.row_id = m.row_id)"""


@query(with_(VECTORS, permuted_sql(), select="SELECT perm, perc, row_id, y, y_perm FROM permuted"))
def permute_labels(spark, folder):
    return permuting.permute_labels(vectors(spark, folder), SPEC)


@query(with_(VECTORS, permuted_sql(False), select="SELECT perm, perc, row_id, y, y_perm FROM permuted"))
def permute_labels_fixed(spark, folder):
    """The same rows are chosen in every permutation."""
    return permuting.permute_labels(vectors(spark, folder), SPEC, redraw=False)


@query(with_(VECTORS, permuted_sql(), select="""SELECT perm, perc, round(corr(y, y_perm), 6) AS corr FROM permuted GROUP BY perm, perc"""))
def label_corr(spark, folder):
    found = corr_of(permuting.permute_labels(vectors(spark, folder), SPEC), ["perm", "perc"])
    return found.withColumn("corr", F.round("corr", 6))


RANDOM_SUBS = f"""subs AS (SELECT CAST(member AS INTEGER) AS member, list_transform(range(3), lambda s:
    {hash_sql('1410', "'sub'", 'member', 's')} % 64) AS features FROM (SELECT unnest(range(20)) AS member))"""


@query(with_(POINTS, RANDOM_SUBS, select="""SELECT member, features[1] AS f1, features[2] AS f2, features[3] AS f3, round(avg(x[features[1] + 1]), 6) AS m1,
  round(avg(x[features[3] + 1]), 6) AS m3 FROM vectors, subs GROUP BY ALL"""))
def random_subspaces(spark, folder):
    """Mean of the rows in each drawn subspace."""
    rows = points(spark, folder)
    drawn = subs.random_subspaces(spark, 64, 20, 3)
    seen = project(rows, drawn).join(drawn, "member")
    return seen.groupBy("member", *[F.get("features", F.lit(i)).cast("bigint").alias(f"f{i + 1}") for i in range(3)]).agg(
        F.round(F.avg(F.get("x", F.lit(0))), 6).alias("m1"), F.round(F.avg(F.get("x", F.lit(2))), 6).alias("m3")
    )


def _weighted_sql(worst: bool) -> str:
    last = "q" if worst else "p"
    worse = """,
  q0 AS (SELECT feature, 1 - p AS v FROM p),
  q AS (SELECT feature, (v - min(v) OVER ()) / sum(v - m) OVER () AS p FROM (SELECT *, min(v) OVER () AS m FROM q0))"""
    return with_(POINTS, """imp AS (SELECT i - 1 AS feature, var_pop(x[i]) AS v FROM vectors, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)""",
      """p AS (SELECT feature, (v - m) / sum(v - m) OVER () AS p FROM (SELECT *, min(v) OVER () AS m FROM imp))""" + (worse if worst else ""),
      f"""cum AS (SELECT feature, sum(p) OVER (ORDER BY feature) AS hi FROM {last})""",
      f"""draws AS (SELECT member, s AS slot, {hash_sql('1410', "'wsub'", 'member', 's')} / CAST(1152921504606846976 AS DOUBLE) AS u FROM
        (SELECT unnest(range(20)) AS member), (SELECT unnest(range(2)) AS s))""",
      select="""SELECT CAST(member AS INTEGER) AS member, CAST(slot AS INTEGER) AS slot,
        CAST(coalesce(min(feature) FILTER (u < hi), max(feature)) AS INTEGER) AS feature FROM draws, cum GROUP BY member, slot""")


def _drawn(spark, folder, worst):
    rows = points(spark, folder)
    spread = rows.agg(*[F.var_pop(F.get("x", F.lit(i))).alias(f"f{i}") for i in range(64)])
    long = spread.select(F.posexplode(F.array(*spread.columns)).alias("feature", "importance"))
    drawn = subs.weighted_subspaces(subs.subspace_shares(long, worst), 20, 2)
    return drawn.select("member", F.posexplode("features").alias("slot", "feature"))


@query(_weighted_sql(False))
def weighted_subspaces(spark, folder):
    return _drawn(spark, folder, False)


@query(_weighted_sql(True))
def weighted_subspaces_worst(spark, folder):
    return _drawn(spark, folder, True)


def by_language(spark, folder):
    docs = table(spark, folder, "documents")
    return label_encode(docs.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), "n_chars"))


@query(f"""SELECT row_id, y FROM (SELECT doc_id AS row_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS y,
  row_number() OVER (PARTITION BY lang ORDER BY {md5_sql('1410', "'under'", 'doc_id')}, doc_id) AS rn FROM documents)
  WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""")
def undersample_languages(spark, folder):
    """More than two classes."""
    return ids(sampling.undersample(by_language(spark, folder)))
