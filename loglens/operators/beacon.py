"""Beacon detection: request-interval statistics and score per (client, destination).

W1 + A5 + A6/J7 + A7 (+ K8 projection, A19 listing, F11, F13, F21).

For every (data source, client, destination) pair, the gaps between consecutive
request times give a mean and a population standard deviation. A hot pair may
hold a large share of all rows, so no pair is ever sorted in one task:

1. rows are added up by (pair, time slice, second) with partial aggregation (equal times
   only add zero gaps);
2. inside a slice, at most ``slice_seconds`` rows, the squared gaps are summed;
3. per pair, slices are ordered by their index and the gap across each slice
   boundary (``first(k+1) - last(k)``) is added; this step sees one row per
   non-empty slice, not one per request.

With ``n`` requests, ``S1 = last - first`` and ``S2`` the sum of squared gaps:
``mean = S1/(n-1)`` and ``var = (S2*(n-1) - S1^2)/(n-1)^2``, computed exactly in
integers before the final division. Rounding follows numpy's ``round``
(``rint(x*10^d)/10^d``), and thresholds see the rounded values (D11).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counts import byte_sum
from ..functions.ip import looks_like_ip
from ..plans.registry import with_type

DEFAULT_SLICE_SECONDS = 3600

# Score thresholds and weights.
STD_STRONG, STD_WEAK = 0.5, 1.0          # std < 0.5 -> +2, < 1 -> +1
MEAN_LONG = 900                          # mean > 900 s -> +1
FEW_REQUESTS = 3                         # count <= 3 -> -3
HTML_SHARE = 50                          # html share % > 50 -> +1
RARE_DEST = 5                            # destination seen < 5 times -> +1
BYTES_AVG_LIMIT = {"bluecoat": 500}      # bytes average x100 above: bluecoat 500, other 5000
BYTES_AVG_DEFAULT = 5000
HIGH, MEDIUM = 6, 3                      # labels: >= 6 High, >= 3 Medium, else Low

PAIR = ["datasource_id", "clientip", "destip"]


def numpy_round(col: Column, digits: int) -> Column:
    """numpy's round: scale, round half to even, scale back (same IEEE steps)."""
    scale = float(10 ** digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def beacon_projection(proxy: DataFrame, datasource_id: int | None = None) -> DataFrame:
    """K8: the columns beacon scoring reads, optionally for one data source (pruned scan)."""
    df = proxy if datasource_id is None else proxy.filter(F.col("datasource_id") == int(datasource_id))
    return df.select("id", *PAIR[1:], "time", "bytesDiff", "contentType", "datasource_id")


def slice_stats(proxy: DataFrame, slice_seconds: int = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """Step 1-2: one row per (pair, slice) with counts, sums and in-slice squared gaps.

    Rows of one second are added up first (a plain hash aggregate, partial before the
    shuffle); the gaps inside a slice are then ``lag`` over its at most ``slice_seconds`` rows."""
    rows = proxy.select(*PAIR, "time", "bytesDiff", "contentType").filter(F.col("time").isNotNull())
    rows = rows.withColumn("slice", F.floor(F.col("time") / F.lit(slice_seconds)))
    seconds = rows.groupBy(*PAIR, "slice", "time").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.col("contentType"), F.lit(0))).cast("bigint").alias("content_sum"),
        byte_sum(F.coalesce(F.col("bytesDiff"), F.lit(0))).alias("bytes_sum"))
    w = Window.partitionBy(*PAIR, "slice").orderBy("time")
    gap = F.col("time") - F.lag("time").over(w)
    return seconds.withColumn("gap", gap).groupBy(*PAIR, "slice").agg(
        F.sum("n").alias("n"), F.sum("content_sum").alias("content_sum"), byte_sum("bytes_sum").alias("bytes_sum"),
        F.min("time").alias("t_first"), F.max("time").alias("t_last"),
        F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).cast("bigint").alias("sq_inner"))


def pair_stats(proxy: DataFrame, slice_seconds: int = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """Step 3 + A5: per pair n, mean and population deviation of the gaps (unrounded)."""
    return stats_of_slices(slice_stats(proxy, slice_seconds))


def stats_of_slices(sl: DataFrame) -> DataFrame:
    """Step 3 over slices, however they were kept."""
    w = Window.partitionBy(*PAIR).orderBy("slice")
    # Gaps across slices can be long (a stray timestamp far from the rest): square
    # them as exact decimals. Sum of squares <= span^2, far inside 38 digits.
    boundary = (F.col("t_first") - F.lag("t_last").over(w)).cast("decimal(38,0)")
    sl = sl.withColumn("sq_cross", F.coalesce(boundary * boundary, F.lit(0).cast("decimal(38,0)")))
    p = sl.groupBy(*PAIR).agg(
        F.sum("n").alias("n"),
        F.sum("content_sum").alias("content_sum"),
        byte_sum("bytes_sum").alias("bytes_sum"),
        (F.max("t_last") - F.min("t_first")).alias("s1"),
        F.sum(F.col("sq_inner").cast("decimal(38,0)") + F.col("sq_cross")).cast("decimal(38,0)").alias("s2"),
    )
    gaps = (F.col("n") - 1)
    s1 = F.col("s1").cast("decimal(38,0)")
    # exact where 38 digits hold it; else the same in doubles
    exact = F.try_subtract(F.try_multiply(F.col("s2"), gaps.cast("decimal(38,0)")), F.try_multiply(s1, s1)).cast("double")
    num = F.coalesce(exact, F.col("s2").cast("double") * gaps - s1.cast("double") * s1.cast("double"))
    mean = F.when(gaps > 0, F.col("s1").cast("double") / gaps.cast("double"))
    var = F.when(gaps > 0, F.greatest(num, F.lit(0.0)) / (gaps.cast("double") * gaps.cast("double")))
    return p.select(*PAIR, "n", "content_sum", "bytes_sum", mean.alias("mean_raw"),
                    F.sqrt(var).alias("std_raw"))


def destination_counts(proxy: DataFrame) -> DataFrame:
    """Requests per destination and data source (reads one column; partial aggregation)."""
    return proxy.groupBy("datasource_id", "destip").agg(F.count(F.lit(1)).alias("dest_count"))


def score_columns(mean: Column, std: Column, n: Column, content_sum: Column, bytes_sum: Column,
                  dest: Column, dest_count: Column, log_type: Column) -> Column:
    """Raw score, range -3..8."""
    std_f = F.when(std < STD_STRONG, 2).when(std < STD_WEAK, 1).otherwise(0)
    mean_f = F.when(mean > MEAN_LONG, 1).otherwise(0)
    count_f = F.when(n <= FEW_REQUESTS, -3).otherwise(0)
    html_f = F.when(content_sum / n * 100 > HTML_SHARE, 1).otherwise(0)
    ip_f = F.when(looks_like_ip(dest), 2).otherwise(0)
    rare_f = F.when(F.coalesce(dest_count, F.lit(0)) >= RARE_DEST, 0).otherwise(1)
    limit = F.lit(BYTES_AVG_DEFAULT)
    for t, v in BYTES_AVG_LIMIT.items():
        limit = F.when(log_type == t, F.lit(v)).otherwise(limit)
    bytes_f = F.when(bytes_sum / n * 100 > limit, 1).otherwise(0)
    return (rare_f + html_f + bytes_f + mean_f + std_f + ip_f + count_f).cast("int")


def fold_destinations(proxy: DataFrame) -> DataFrame:
    """Rows whose destinations are one in any letter case, in lower case (D13). For a kept state, fold
    every import."""
    return proxy.withColumn("destip", F.lower("destip"))


def beacon_scores(proxy: DataFrame, datasources: DataFrame,
                  slice_seconds: int = DEFAULT_SLICE_SECONDS, fold_case: bool = False) -> DataFrame:
    """``beacon_data`` rows: pairs with a positive rounded mean gap (D10, F13), scored. Destinations
    are told apart by their bytes, or with ``fold_case`` whatever their letter case, both in pairs and
    in requests per destination."""
    return scores_of_pairs(pair_stats(fold_destinations(proxy) if fold_case else proxy, slice_seconds), datasources)


def scores_of_pairs(stats: DataFrame, datasources: DataFrame) -> DataFrame:
    """A7 over the statistics of all pairs."""
    # Requests per destination are sums over the pairs. Joined on (source, destination);
    # adaptive execution broadcasts the counts when they are small at run time and otherwise splits
    # a hot destination (skew join). Both sides plan the statistics: over rows that is a second scan,
    # over a kept state (``operators.beacon_state``) it reads only slices.
    dests = stats.groupBy("datasource_id", "destip").agg(F.sum("n").alias("dest_count"))
    scored = stats.join(dests, ["datasource_id", "destip"], "left")
    scored = with_type(scored, datasources)
    scored = scored.withColumn("mean", numpy_round(F.col("mean_raw"), 2)) \
                   .withColumn("stdDev", numpy_round(F.col("std_raw"), 3))
    scored = scored.filter(F.col("mean") > 0)
    raw = score_columns(F.col("mean"), F.col("stdDev"), F.col("n"), F.col("content_sum"), F.col("bytes_sum"),
                        F.col("destip"), F.col("dest_count"), F.col("type"))
    return scored.select("clientip", "destip", "mean", "stdDev", F.col("n").alias("count"),
                         F.greatest(raw, F.lit(0)).alias("beaconScore"), raw.alias("raw_score"),
                         F.col("datasource_id").cast("int").alias("datasource_id"))


def probability_label(score: Column) -> Column:
    """F21."""
    return F.when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").otherwise("Low")


def beacon_listing(beacons: DataFrame, min_score: int = 3, ip: str | None = None) -> DataFrame:
    """Threshold (or client-or-destination filter), score desc, deviation asc, label."""
    if ip is None:
        b = beacons.filter(F.col("beaconScore") >= min_score)
    else:
        b = beacons.filter((F.col("clientip") == ip) | (F.col("destip") == ip))
    return b.select("datasource_id", "clientip", "destip", "count", "mean", "stdDev", "beaconScore",
                    probability_label(F.col("beaconScore")).alias("probability")) \
            .orderBy(F.col("beaconScore").desc(), F.col("stdDev").asc(), "datasource_id", "clientip", "destip")
