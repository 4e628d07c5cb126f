"""Profiling, cleaning, scaling and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trustframe.checks import query
from trustframe.checks.tables import (
    COMPLETE, FEATURES, LINES, MESSY, MESSY_COLUMNS, MESSY_FEATURES, UNIQUE, line_key, lines, messy, table, vectors, with_,
)
from trustframe.config import ReportConfig
from trustframe.functions.arrays import pack
from trustframe.operators import cleaning, profiling, transforming
from trustframe.operators.storage import settle, shared_dir
from trustframe.plans import report as reports
from trustframe.plans.similarity import similarity_mean
from trustframe.sources import features as sources
from trustframe.sources import sinks


@query(with_(LINES, select="SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax, label FROM lines"))
def load_features(spark, folder):
    return sources.load_features(spark, lines(spark, folder), "label", row_id="row_id")


@query(with_(LINES, select="""SELECT label, count(*) AS n, round(sum(l_extendedprice), 2) AS price,
  round(sum(l_tax), 2) AS tax FROM lines GROUP BY label"""))
def load_features_csv(spark, folder):
    """The lines written as a headed CSV with another delimiter and read back."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines(spark, folder).drop("row_id").write.option("header", True).option("sep", ";").csv(path)
    back = sources.load_features(spark, path, "label", delimiter=";")
    return back.groupBy("label").agg(
        F.count_distinct("row_id").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.sum("l_tax"), 2).alias("tax"),
    )


@query(with_(MESSY, select="""SELECT count(DISTINCT label) AS classes,
  CASE WHEN count(DISTINCT label) > 2 THEN true END AS multiclass FROM messy"""))
def class_count(spark, folder):
    return profiling.class_count(messy(spark, folder))


@query(with_(MESSY, select="SELECT label, count(*) AS n FROM messy WHERE label IS NOT NULL GROUP BY label"))
def class_distribution(spark, folder):
    return profiling.class_distribution(messy(spark, folder))


@query("""SELECT p_brand AS label, n, n / min(n) OVER () AS ratio,
  CAST(round_even(n / min(n) OVER (), 0) AS BIGINT) AS ratio_rounded,
  max(n) OVER () / min(n) OVER () AS majority_over_minority
  FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)""")
def imbalance_ratio(spark, folder):
    return profiling.imbalance_ratio(table(spark, folder, "part").select(F.col("p_brand").alias("label")))


@query(with_(LINES, select="""SELECT count(*) AS rows, CAST(4 AS BIGINT) AS features,
  ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'label'] AS feature_list FROM lines"""))
def feature_inventory(spark, folder):
    return profiling.feature_inventory(lines(spark, folder), "label")


@query(with_(MESSY, select="""SELECT count(*) AS rows, count(DISTINCT label) AS classes,
  count(*) FILTER (l_quantity IS NULL) AS missing_l_quantity, count(*) FILTER (l_discount IS NULL) AS missing_l_discount,
  count(*) FILTER (l_tax IS NULL) AS missing_l_tax, count(*) FILTER (label IS NULL) AS missing_label FROM messy"""))
def profile(spark, folder):
    return profiling.row_profile(cleaning.nan_to_null(messy(spark, folder), MESSY_FEATURES), MESSY_FEATURES)


@query(with_(MESSY, select="""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM
  (SELECT count(*) AS c FROM messy GROUP BY l_quantity, l_discount, l_tax, label)"""))
def duplicate_rows(spark, folder):
    return cleaning.duplicate_count(cleaning.nan_to_null(messy(spark, folder), MESSY_FEATURES), MESSY_COLUMNS)


@query(with_(MESSY, UNIQUE, COMPLETE, select="""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM
  (SELECT count(*) AS c FROM complete GROUP BY l_quantity, l_discount, l_tax)"""))
def duplicate_vectors(spark, folder):
    return cleaning.duplicate_count(_complete(spark, folder), MESSY_FEATURES)


def _unique(spark, folder):
    raw = cleaning.nan_to_null(messy(spark, folder), MESSY_FEATURES)
    return cleaning.normalize_missing(cleaning.dedupe(raw, MESSY_COLUMNS), MESSY_FEATURES)


def _complete(spark, folder):
    return cleaning.drop_missing(_unique(spark, folder), MESSY_COLUMNS)


@query(with_(MESSY, select="""SELECT row_id, l_quantity, l_discount, l_tax, label FROM (SELECT *, row_number() OVER
  (PARTITION BY l_quantity, l_discount, l_tax, label ORDER BY row_id) AS rn FROM messy) WHERE rn > 1"""))
def duplicate_listing(spark, folder):
    raw = cleaning.nan_to_null(messy(spark, folder), MESSY_FEATURES)
    return cleaning.duplicate_listing(raw, MESSY_COLUMNS)


@query(with_(MESSY, select="""SELECT row_id, l_quantity, l_discount, l_tax, label FROM (SELECT *, row_number() OVER
  (PARTITION BY l_quantity, l_discount, l_tax, label ORDER BY row_id) AS rn FROM messy) WHERE rn = 1"""))
def dedupe(spark, folder):
    return cleaning.dedupe(cleaning.nan_to_null(messy(spark, folder), MESSY_FEATURES), MESSY_COLUMNS)


@query("""SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents) WHERE rn > 1""")
def duplicate_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return cleaning.duplicate_listing(docs, ["text"], "doc_id")


@query(with_(MESSY, select="""SELECT row_id, l_quantity, CASE WHEN isfinite(l_discount) THEN l_discount END AS l_discount,
  l_tax, label FROM messy"""))
def normalize_missing(spark, folder):
    return cleaning.normalize_missing(messy(spark, folder), MESSY_FEATURES)


@query(with_(MESSY, UNIQUE, select="""SELECT count(*) FILTER (l_quantity IS NULL OR l_discount IS NULL OR l_tax IS NULL
  OR label IS NULL) AS missing_rows FROM normal"""))
def missing_rows(spark, folder):
    return cleaning.missing_rows(_unique(spark, folder), MESSY_COLUMNS)


@query(with_(MESSY, UNIQUE, select="""SELECT * FROM normal WHERE l_quantity IS NULL OR l_discount IS NULL
  OR l_tax IS NULL OR label IS NULL"""))
def missing_listing(spark, folder):
    return cleaning.missing_listing(_unique(spark, folder), MESSY_COLUMNS)


@query(with_(MESSY, UNIQUE, COMPLETE, select="SELECT * FROM complete"))
def drop_missing(spark, folder):
    return _complete(spark, folder)


CONFIG = ReportConfig(sampling_limit=700, min_sample_limit=10, metrics=())
CLEANED = """capped AS (SELECT row_id, l_quantity, l_discount, l_tax, label FROM (SELECT *, row_number() OVER
    (PARTITION BY label ORDER BY md5(concat_ws('|', 1410, row_id)), row_id) AS rn FROM complete) WHERE rn <= 700),
  sample AS (SELECT * FROM capped WHERE label IN (SELECT label FROM capped GROUP BY label HAVING count(*) > 10))"""


@query(with_(MESSY, UNIQUE, COMPLETE, CLEANED, select="SELECT * FROM sample"))
def cleaned_dataset(spark, folder):
    _, sample = reports.clean(messy(spark, folder), MESSY_FEATURES, CONFIG)
    return sample.select("row_id", *MESSY_COLUMNS)


REPORT_SQL = with_(MESSY, UNIQUE, COMPLETE, CLEANED,
  "a AS (SELECT label, count(*) AS n FROM messy WHERE label IS NOT NULL GROUP BY label)",
  "b AS (SELECT label, count(*) AS n FROM capped GROUP BY label)",
  select="""SELECT (SELECT count(*) FROM a) AS classes, CASE WHEN (SELECT count(*) FROM a) > 2 THEN true END AS multiclass,
  3 AS features, ['l_quantity', 'l_discount', 'l_tax', 'label'] AS feature_list,
  (SELECT string_agg(label || ':' || n, ',' ORDER BY label) FROM a) AS original_samples,
  (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM messy GROUP BY l_quantity, l_discount, l_tax, label))
    AS duplicated,
  (SELECT count(*) FROM normal WHERE l_quantity IS NULL OR l_discount IS NULL OR l_tax IS NULL OR label IS NULL) AS missing,
  700 AS sampling_limit, (SELECT string_agg(label || ':' || n, ',' ORDER BY label) FROM b) AS analyzed_samples,
  (SELECT count(*) FROM b WHERE n <= 10) AS filtered_classes""")


def _flat(name: str):
    pairs = F.array_sort(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return F.array_join(pairs, ",").alias(name)


@query(REPORT_SQL)
def report(spark, folder):
    row = reports.dataset_report(messy(spark, folder), MESSY_FEATURES, CONFIG)
    return row.drop("date").withColumns({c: _flat(c) for c in ("original_samples", "analyzed_samples")})


@query()
def catalogue_report(spark, folder):
    """The catalogue's sections with one plugged-in metric."""
    def similarity(sample, features, config):
        rows = sample.select("label", pack(features).alias("x"))
        return similarity_mean(rows, len(features))[1]

    config = ReportConfig(metrics=("similarity",))
    found = reports.dataset_report(lines(spark, folder), FEATURES, config, {"similarity": similarity})
    return reports.catalogue_report(found)


@query()
def report_json(spark, folder):
    return sinks.report_json(reports.dataset_report(messy(spark, folder), MESSY_FEATURES, CONFIG))


@query(with_(LINES, """long AS (UNPIVOT (SELECT label, l_quantity, l_extendedprice, l_discount, l_tax FROM lines)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v)""",
  """c AS (SELECT feature, label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM long GROUP BY ALL)""",
  """g AS (SELECT feature, sum(n * m) / sum(n) AS gm, sum(n) AS t, count(*) AS k, sum(n * s) AS w FROM c GROUP BY feature)""",
  select="""SELECT feature, round((sum(n * (m - gm) ** 2) / (any_value(k) - 1)) / (any_value(w) / (any_value(t) - any_value(k))), 6)
  AS score FROM c JOIN g USING (feature) GROUP BY feature ORDER BY score DESC LIMIT 10"""))
def feature_scores(spark, folder):
    found = profiling.feature_scores(lines(spark, folder), FEATURES)
    return found.select("feature", F.round("score", 6).alias("score"))


@query()
def pca_projection(spark, folder):
    return profiling.pca_projection(lines(spark, folder), FEATURES)


@query(with_(LINES, select="""SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax, label,
  CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y FROM lines"""))
def label_encode(spark, folder):
    return transforming.label_encode(lines(spark, folder))


@query("""SELECT vec_id AS row_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y FROM embeddings""")
def label_encode_numeric(spark, folder):
    df = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    return transforming.label_encode(df)


def _scale_sql(expr: str) -> str:
    cols = ", ".join(f"{expr.format(c=c)} AS {c}" for c in FEATURES)
    return with_(LINES, select=f"SELECT row_id, {cols}, CAST(0 AS DOUBLE) AS constant FROM lines")


@query(_scale_sql("round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6)"))
def minmax_scale(spark, folder):
    df = lines(spark, folder).withColumn("constant", F.lit(3.0))
    scaled = transforming.minmax_scale(df, [*FEATURES, "constant"])
    return scaled.select("row_id", *[F.round(c, 6).alias(c) for c in [*FEATURES, "constant"]])


@query(_scale_sql("round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6)"))
def standard_scale(spark, folder):
    df = lines(spark, folder).withColumn("constant", F.lit(3.0))
    scaled = transforming.standard_scale(df, [*FEATURES, "constant"])
    return scaled.select("row_id", *[F.round(c, 6).alias(c) for c in [*FEATURES, "constant"]])


@query("""SELECT doc_id AS row_id, toxic AS label, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY toxic)), 6) AS w
  FROM labels""")
def class_weights(spark, folder):
    df = table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"))
    return transforming.class_weights(df).withColumn("w", F.round("w", 6))


def collection_lines(spark, folder):
    """(dataset, features, y) of the lines with the parts of their row id, which take less room than the id."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    owners = orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name")
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *FEATURES]
    li = table(spark, folder, "lineitem").select(*parts, (F.col("l_linestatus") == "O").cast("int").alias("open"))
    joined = li.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    y = F.when((F.col("r_name") == "ASIA") & (F.col("l_quantity") < 6), 2).otherwise(F.col("open"))
    return joined.select(F.col("r_name").alias("dataset"), *parts, y.alias("y"))


def with_row_ids(lines):
    return lines.select("dataset", line_key().alias("row_id"), pack(FEATURES).alias("x"), "y")


def collection(spark, folder):
    """Lines as one dataset per event-like split: dataset = region of the customer."""
    return with_row_ids(collection_lines(spark, folder))


COLLECTION = """collection AS (SELECT r_name AS dataset, md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_id, [l_quantity, l_extendedprice, l_discount, l_tax] AS x,
    CASE WHEN r_name = 'ASIA' AND l_quantity < 6 THEN 2 ELSE CAST(l_linestatus = 'O' AS INTEGER) END AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
TAGS = """tags AS (SELECT dataset, list_filter([CASE WHEN count(*) = 2 THEN 'binary' ELSE 'multi-class' END,
    CASE WHEN max(d) >= 8 THEN 'multi-feature' END,
    CASE WHEN max(round_even(n / m, 0)) > 3 THEN 'imbalanced' ELSE 'balanced' END], lambda t: t IS NOT NULL) AS tags
  FROM (SELECT dataset, y, count(*) AS n, max(len(x)) AS d, min(count(*)) OVER (PARTITION BY dataset) AS m
        FROM collection GROUP BY dataset, y) GROUP BY dataset)"""


@query(with_(COLLECTION, TAGS, select="SELECT dataset, array_to_string(tags, ',') AS tags FROM tags"))
def dataset_tags(spark, folder):
    return sources.dataset_tags(collection(spark, folder)).withColumn("tags", F.array_join("tags", ","))


def _counted(df):
    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))


@query(with_(COLLECTION, TAGS, select="""SELECT dataset, count(*) AS rows FROM collection JOIN tags USING (dataset)
  WHERE list_has_all(tags, ['binary', 'balanced']) GROUP BY dataset"""))
def dataset_select_all(spark, folder):
    return _counted(sources.select_datasets(collection(spark, folder), ("all", ["binary", "balanced"])))


@query(with_(COLLECTION, TAGS, select="""SELECT dataset, count(*) AS rows FROM collection JOIN tags USING (dataset)
  WHERE list_has_any(tags, ['multi-class', 'imbalanced']) GROUP BY dataset"""))
def dataset_select_any(spark, folder):
    return _counted(sources.select_datasets(collection(spark, folder), ("any", ["multi-class", "imbalanced"])))


@query(with_(COLLECTION, select="""SELECT dataset, count(*) AS rows FROM collection
  WHERE dataset IN ('ASIA', 'EUROPE') GROUP BY dataset"""))
def dataset_select_names(spark, folder):
    return _counted(sources.select_datasets(collection(spark, folder), ["ASIA", "EUROPE"]))


@query(with_(COLLECTION, select="""SELECT dataset, count(*) AS rows, CAST(length(dataset) AS INTEGER) AS features, count(DISTINCT y) AS classes
  FROM collection GROUP BY dataset"""))
def dataset_catalogue(spark, folder):
    """Writes the collection as one CSV folder per dataset file name and loads it back."""
    root = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = settle(collection(spark, folder), "collection")
    for name in [r["dataset"] for r in rows.select("dataset").distinct().collect()]:  # a handful of regions
        # from region to region another width: the first features once more
        one = rows.where(F.col("dataset") == name).select(*[F.get("x", F.lit(i % 4)).alias(f"c{i}") for i in range(len(name))], "y")
        one.write.csv(f"{root}/{name.replace(' ', '_')}.csv")
    found = sources.dataset_catalogue(sources.load_collection(spark, root))
    return found.withColumn("dataset", F.translate("dataset", "_", " "))


@query()
def noise_dims(spark, folder):
    df = sources.noise_dims(vectors(spark, folder).withColumn("dataset", F.lit("lines")), 4)
    return df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("x")).alias("features"),
        F.round(F.avg(F.element_at("x", -1)), 1).alias("last_mean"),
    )


@query(with_(LINES, select="""SELECT label, count(*) AS n FROM lines GROUP BY label"""))
def evidence_roundtrip(spark, folder):
    root = f"{shared_dir(spark)}/evidence-{uuid.uuid4().hex}"
    sinks.save_evidence({"classes": profiling.class_distribution(lines(spark, folder))}, root)
    return sinks.load_evidence(spark, root, "classes")


@query(with_(COLLECTION, select="""SELECT DISTINCT dataset, f AS fold, m AS model FROM collection,
  (SELECT unnest(range(5)) AS f), (SELECT unnest(['centroid', 'gnb']) AS m) WHERE NOT (m = 'gnb' AND f < 2)"""))
def pending_work(spark, folder):
    """Work left when the store already holds two folds of one model."""
    prints = settle(sinks.data_fingerprint(collection(spark, folder), ["dataset"]), "prints")
    planned = sinks.planned_work(prints, {"centroid": "", "gnb": "floor=1e-9"}, 5, 1, 1410)
    done = planned.where((F.col("model") == "gnb") & (F.col("fold") < 2))
    return sinks.pending_work(planned, done).select("dataset", "fold", "model")
