"""Not-modified revisits of a web archive, resolved to the responses they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.functions.arrays import lower_bound

#: Headers that a 304 may not change in the stored response (connection-level ones and those that describe the body).
KEPT_HEADERS = [
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
]
URL = r"^(?i:https?)://([^/?]*)([^?]*)(?:\?(.*))?$"
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, the scheme's own default port, trailing slashes and tracking parameters go; host in lower case, parameters sorted.

    What is not an http(s) URL is only trimmed; null stays null.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host, port = F.lower(F.regexp_extract(bare, URL, 1)), F.when(bare.rlike("^(?i:https):"), ":443$").otherwise(":80$")
    host = F.regexp_replace(host, port, F.lit(""))
    path = F.regexp_replace(F.regexp_extract(bare, URL, 2), "/+$", "")
    pairs = F.filter(F.array_sort(F.split(F.regexp_extract(bare, URL, 3), "&")), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(bare.rlike(URL), F.concat(host, path, query)).otherwise(bare)


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the first counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.filter(entries, lambda e: e["key"] == n)[0]))


def resolve_revisits(records: DataFrame, bins: int = 256) -> DataFrame:
    """Resolves each revisit to the latest earlier full response for its canonical URL.

    ``records``: record_id, url, ts (a number), status, headers (map), digest. Status 304 marks a revisit, 200 a
    full response, others take no part. Result, per revisit: record_id, canonical_url, outcome, response_id,
    response_digest, headers. Outcomes: ``resolved``; ``no_response`` (nothing earlier; also for a null url or ts);
    ``mismatch`` (a validator differs: entity tags compare without W/, and where either lacks one the
    last-modified dates do); ``unverified`` (no validator on both sides). Only resolved rows have the last three. Equal times
    go by record_id; of repeated rows each is answered. Merged headers are the response's, overwritten by the
    revisit's except for ``KEPT_HEADERS``; null headers are empty.

    No URL lies in one task: time is cut at quantiles of all rows' times into ``bins``, so that one far-off time moves no
    cut and a URL has about 1/bins of all rows in a bin at most (rows of one URL and one time stay together); a window inside
    (URL, bin) finds the latest response there, and the last response of each earlier bin, at most ``bins`` rows for a URL,
    comes from a small second window.
    """
    headers = _lower_keys(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")))
    rows = records.where(F.col("status").isin(200, 304)).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("double").alias("at"),
        (F.col("status") == 304).alias("revisit"), headers.alias("headers"), "digest",
    )
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = rows.agg(F.array_distinct(F.percentile_approx("at", shares, 16 * bins)).alias("cuts")).first()["cuts"] or []
    rows = rows.withColumn("bin", lower_bound(F.lit(cuts).cast("array<double>"), F.col("at"), bins))
    known = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    full = F.when(known & ~F.col("revisit"), F.struct("at", "record_id", "headers", "digest"))
    rows = rows.withColumn("full", full)
    last = rows.where("full IS NOT NULL").groupBy("canonical_url", "bin").agg(F.max_by("full", F.struct("at", "record_id")).alias("seen"))
    steps = Window.partitionBy("canonical_url").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = rows.where(F.col("revisit") & known).select("canonical_url", "bin").distinct()
    carried = (
        wanted.withColumn("seen", F.lit(None).cast(last.schema["seen"].dataType)).unionByName(last)
        .groupBy("canonical_url", "bin").agg(F.first("seen", ignorenulls=True).alias("seen"))
        .withColumn("earlier", F.last("seen", ignorenulls=True).over(steps)).select("canonical_url", "bin", "earlier")
    )
    order = Window.partitionBy("canonical_url", "bin").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.where(known).withColumn("within", F.last("full", ignorenulls=True).over(order)).where("revisit")
    lost = rows.where(F.col("revisit") & ~known).withColumn("within", F.lit(None).cast(rows.schema["full"].dataType))
    found = near.unionByName(lost.select(near.columns)).join(carried, ["canonical_url", "bin"], "left")
    found = found.withColumn("hit", F.when(known, F.coalesce("within", "earlier")))
    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), "^W/", "")
    date = lambda h: F.trim(h["last-modified"])
    mine, theirs = F.col("headers"), F.col("hit.headers")
    same = F.when(tag(mine).isNotNull() & tag(theirs).isNotNull(), tag(mine) == tag(theirs)).otherwise(date(mine) == date(theirs))
    outcome = F.when(F.col("hit").isNull(), "no_response").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    news = F.map_filter(mine, lambda k, _: ~k.isin(KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(news, k)), news)
    ok = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "outcome", F.when(ok, F.col("hit.record_id")).alias("response_id"),
        F.when(ok, F.col("hit.digest")).alias("response_digest"), F.when(ok, merged).alias("headers"),
    )
