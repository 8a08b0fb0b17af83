"""Joins, aggregations and group encoders."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators import counts as N
from clickloom.operators import encoder as E
from clickloom.operators import keys as K
from clickloom.operators import profile as P
from clickloom.operators.splits import kfold
from clickloom.operators.stage import GroupStatistic
from clickloom.operators.timefeat import from_supplement, time_table
from clickloom.operators.windows import last_next_union
from clickloom.registry.base import BUCKETED_BY, DETERMINE_IT, clicks, coded, contest, develop, query, r6, sql, stack
from clickloom.schema import COUNT_KEYS, DICTIONARY_KEYS, DISTINCT_PAIRS, LABEL, LABEL_COUNT_KEYS, MEAN_KEYS, PULSE_KEYS, feature_name
from clickloom.sources.scans import read_table
from clickloom.sources.store import scratch_path


def stacked(dfs, cols) -> DataFrame:
    return stack({name: df.select("row_id", *cols) for name, df in zip(("tr", "val"), dfs)})


CODES = ["ip_device_os", "ip_device_os_app", "ip_device_os_app_channel"]


@query("join_encode_keys", sql("""
SELECT t.row_id, t.ip, d.code AS ip_device_os FROM test t
LEFT JOIN (SELECT DISTINCT ip, device, os, dense_rank() OVER (ORDER BY ip, device, os) - 1 AS code FROM train) d USING (ip, device, os)"""))
def join_encode_keys(spark, sf):
    train, _, test = contest(spark, sf)
    keys = ["ip", "device", "os"]
    return K.encode_keys(test, K.key_dictionary([train], keys), keys).select("row_id", "ip", "ip_device_os")


@query("base_table", sql("SELECT row_id, dayofweek, hourofday, ip_device_os, ip_device_os_app, ip_device_os_app_channel FROM coded"))
def base_table(spark, sf):
    train, supp, _ = contest(spark, sf)
    log = train.unionByName(supp).drop("dayofweek", "hourofday")
    return K.base_table(log, [train, supp]).select("row_id", "dayofweek", "hourofday", *CODES)


@query("join_encode_keys_salted", sql("SELECT row_id, ip_device_os, ip_device_os_app, ip_device_os_app_channel FROM coded"))
def join_encode_keys_salted(spark, sf):
    log = clicks(spark, sf)
    return K.encode_all(log, [log], DICTIONARY_KEYS).select("row_id", *CODES)


COUNT_SQL = ", ".join(f"count(*) OVER (PARTITION BY {', '.join(k)}) AS {feature_name(k, 'cnt')}" for k in COUNT_KEYS)


@query("join_count_map", sql(f"SELECT row_id, {COUNT_SQL} FROM coded"))
def join_count_map(spark, sf):
    out = N.add_counts_in_place(coded(spark, sf), BUCKETED_BY, DETERMINE_IT)
    return out.select("row_id", *[feature_name(k, "cnt") for k in COUNT_KEYS])


@query("join_count_map_salted", sql("""
SELECT row_id, count(*) OVER (PARTITION BY ip) AS ip_cnt, count(*) OVER (PARTITION BY app) AS app_cnt,
       count(*) OVER (PARTITION BY ip, app) AS ip_app_cnt FROM clicks"""))
def join_count_map_salted(spark, sf):
    log = clicks(spark, sf)
    return N.add_count_maps(log, [log], [["ip"], ["app"], ["ip", "app"]]).select("row_id", "ip_cnt", "app_cnt", "ip_app_cnt")


@query("join_encoder_transform", sql("""
SELECT v.row_id, v.app, v.channel, round(m.y, 6) AS app_channel_mean FROM val v
LEFT JOIN (SELECT app, channel, avg(is_attributed) AS y FROM tr GROUP BY app, channel) m USING (app, channel)"""))
def join_encoder_transform(spark, sf):
    tr, val = develop(spark, sf)
    out = E.GroupEncoder(["app", "channel"], LABEL, "mean").fit(tr).transform(val)
    return out.select("row_id", "app", "channel", r6(F.col("app_channel_mean")).alias("app_channel_mean"))


SUPP_SQL = sql("""
SELECT t.row_id, t.ip, t.epoch_hour, s.app AS first_app, s.channel AS first_channel FROM test t
LEFT JOIN (SELECT ip, epoch_hour, arg_min(app, row_id) AS app, arg_min(channel, row_id) AS channel FROM supp GROUP BY ip, epoch_hour) s
USING (ip, epoch_hour)""")


@query("join_test_from_supp", SUPP_SQL)
def join_test_from_supp(spark, sf):
    _, supp, test = contest(spark, sf)
    supp = supp.withColumns({"first_app": F.col("app"), "first_channel": F.col("channel")})
    out = from_supplement(test, supp, ["ip", "epoch_hour"], ["first_app", "first_channel"])
    return out.select("row_id", "ip", "epoch_hour", "first_app", "first_channel")


@query("join_positional_columns", sql("SELECT row_id, app, hourofday, minutes FROM clicks"))
def join_positional_columns(spark, sf):
    log = clicks(spark, sf)
    return P.join_columns(log.select("row_id", "app"), log.select("row_id", "hourofday", "minutes"))


@query("join_dedup_merge", sql("""
SELECT t.row_id, s.dummy FROM test t
LEFT JOIN (SELECT DISTINCT ip, epoch_hour, 1 AS dummy FROM train) s ON t.ip = s.ip AND t.epoch_hour = s.epoch_hour + 480"""))
def join_dedup_merge(spark, sf):
    train, _, test = contest(spark, sf)
    later = train.withColumn("epoch_hour", F.col("epoch_hour") + 480)
    return P.merge_distinct(test, later, ["ip", "epoch_hour"]).select("row_id", "dummy")


@query("join_group_stats_back", sql("SELECT row_id, count(*) OVER (PARTITION BY ip, app) AS group_size FROM clicks"))
def join_group_stats_back(spark, sf):
    return N.group_size(clicks(spark, sf), ["ip", "app"]).select("row_id", "group_size")


COUNT_KEYS_SQL = "\nUNION ALL ".join(
    f"SELECT '{feature_name(k, 'cnt')}' AS part, concat_ws('|', {', '.join(k)}) AS key, count(*) AS n FROM coded GROUP BY {', '.join(k)}"
    for k in COUNT_KEYS
)


@query("agg_count_keys", sql(COUNT_KEYS_SQL))
def agg_count_keys(spark, sf):
    log = coded(spark, sf)
    names = [(feature_name(k, "cnt"), k) for k in COUNT_KEYS]
    maps = {name: m.select(F.concat_ws("|", *k).alias("key"), F.col(name).alias("n")) for (name, k), (_, m) in zip(names, N.count_maps([log]))}
    return stack(maps).select("part", "key", "n")


@query("agg_count_lineitem", """
SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS l_partkey_l_suppkey_l_returnflag_cnt FROM lineitem GROUP BY ALL""")
def agg_count_lineitem(spark, sf):
    return N.count_map([read_table(spark, sf, "lineitem")], ["l_partkey", "l_suppkey", "l_returnflag"])


CODED_PARTS = ["ctr AS (SELECT * FROM coded WHERE split = 'tr')", "cval AS (SELECT * FROM coded WHERE split = 'val')"]


def develop_coded(spark, sf):
    """(tr, val) with composite codes."""
    log = coded(spark, sf)
    return log.where(F.col("split") == "tr"), log.where(F.col("split") == "val")


NONNULL_KEYS = LABEL_COUNT_KEYS
NONNULL_SQL = sql(
    "SELECT 'tr' AS part, t.row_id, {c} FROM ctr t {j} UNION ALL SELECT 'val', t.row_id, {c} FROM cval t {j}".format(
        c=", ".join(f"c_{k}.n AS {k}_count" for k in NONNULL_KEYS),
        j=" ".join(f"LEFT JOIN c_{k} USING ({k})" for k in NONNULL_KEYS),
    ),
    *CODED_PARTS,
    *[
        f"c_{k} AS (SELECT {k}, count(y) AS n FROM (SELECT {k}, is_attributed AS y FROM ctr UNION ALL SELECT {k}, NULL FROM cval) GROUP BY {k})"
        for k in NONNULL_KEYS
    ],
)


@query("agg_count_nonnull", NONNULL_SQL)
def agg_count_nonnull(spark, sf):
    tr, val = develop_coded(spark, sf)
    val = val.withColumn(LABEL, F.lit(None).cast("int"))
    return stacked(E.count_features(tr, val, NONNULL_KEYS, LABEL), [f"{k}_count" for k in NONNULL_KEYS])


@query("agg_count_supplement", sql("""
SELECT 'tr' AS part, row_id, n AS ip_app_count FROM train JOIN c USING (ip, app)
UNION ALL SELECT 'val', row_id, n FROM test JOIN c USING (ip, app)""",
"c AS (SELECT ip, app, count(is_attributed) AS n FROM (SELECT * FROM train UNION ALL SELECT * FROM supp) GROUP BY ip, app)"))
def agg_count_supplement(spark, sf):
    train, supp, test = contest(spark, sf)
    return stacked(E.count_features(train, test, [["ip", "app"]], LABEL, supp), ["ip_app_count"])


@query("agg_target_mean", sql("""
SELECT 'tr' AS part, row_id, round(y, 6) AS os_mean FROM tr LEFT JOIN m USING (os)
UNION ALL SELECT 'val', row_id, round(y, 6) FROM val LEFT JOIN m USING (os)""",
"m AS (SELECT os, avg(is_attributed) AS y FROM tr GROUP BY os)"))
def agg_target_mean(spark, sf):
    out = stacked(E.mean_features(*develop(spark, sf), ["os"], LABEL), ["os_mean"])
    return out.withColumn("os_mean", r6(F.col("os_mean")))


@query("agg_target_mean_min_count", sql("""
SELECT v.row_id, round(m.y, 6) AS ip_app_mean FROM val v
LEFT JOIN (SELECT ip, app, avg(is_attributed) AS y FROM tr GROUP BY ip, app HAVING count(*) >= 3) m USING (ip, app)"""))
def agg_target_mean_min_count(spark, sf):
    tr, val = develop(spark, sf)
    _, out = E.mean_features(tr, val, [["ip", "app"]], LABEL, min_count=3)
    return out.select("row_id", r6(F.col("ip_app_mean")).alias("ip_app_mean"))


OOF_CTES = [
    *CODED_PARTS,
    "rows AS (SELECT *, row_id % 5 AS fold FROM ctr)",
    *[
        f"""t_{k} AS (SELECT {k}, count(*) AS n, sum(is_attributed) AS s FROM rows GROUP BY {k}),
f_{k} AS (SELECT {k}, fold, count(*) AS n, sum(is_attributed) AS s FROM rows GROUP BY {k}, fold)"""
        for k in MEAN_KEYS
    ],
]
OOF_SQL = sql(
    "SELECT 'tr' AS part, r.row_id, {a} FROM rows r {ja} UNION ALL SELECT 'val', v.row_id, {b} FROM cval v {jb}".format(
        a=", ".join(f"round((t_{k}.s - f_{k}.s) / nullif(t_{k}.n - f_{k}.n, 0), 6) AS {k}_mean" for k in MEAN_KEYS),
        ja=" ".join(f"JOIN t_{k} USING ({k}) JOIN f_{k} ON r.{k} = f_{k}.{k} AND r.fold = f_{k}.fold" for k in MEAN_KEYS),
        b=", ".join(f"round(t_{k}.s / t_{k}.n, 6)" for k in MEAN_KEYS),
        jb=" ".join(f"LEFT JOIN t_{k} USING ({k})" for k in MEAN_KEYS),
    ),
    *OOF_CTES,
)


@query("agg_target_mean_oof", OOF_SQL)
def agg_target_mean_oof(spark, sf):
    tr, val = develop_coded(spark, sf)
    made = E.out_of_fold_means(tr, val, MEAN_KEYS, LABEL, fold=kfold(5, seed=None))
    out = stacked(made, [f"{k}_mean" for k in MEAN_KEYS])
    return out.withColumns({f"{k}_mean": r6(F.col(f"{k}_mean")) for k in MEAN_KEYS})


UNQ_NAMES = [feature_name(k, "unq", t) for k, t in DISTINCT_PAIRS]
UNQ_SQL = sql(
    "SELECT b.split AS part, b.row_id, {c} FROM b {j}".format(
        c=", ".join(f"q{i}.n AS {name}" for i, name in enumerate(UNQ_NAMES)),
        j=" ".join(f"LEFT JOIN q{i} USING ({', '.join(k)})" for i, (k, _) in enumerate(DISTINCT_PAIRS)),
    ),
    "b AS (SELECT * FROM coded WHERE split IS NOT NULL)",
    *[
        f"q{i} AS (SELECT {', '.join(k)}, count(DISTINCT {t}) AS n FROM b GROUP BY {', '.join(k)})"
        for i, (k, t) in enumerate(DISTINCT_PAIRS)
    ],
)


@query("agg_nunique", UNQ_SQL)
def agg_nunique(spark, sf):
    log = coded(spark, sf)
    tr, val = log.where(F.col("split") == "tr"), log.where(F.col("split") == "val")
    return stacked(E.distinct_features(tr, val, DISTINCT_PAIRS), UNQ_NAMES)


@query("agg_std", sql("""
SELECT split AS part, row_id, round(stddev_samp(gap) OVER (PARTITION BY ip), 6) AS ip_std FROM (
  SELECT split, row_id, ip, epoch_time - lag(epoch_time) OVER (PARTITION BY ip, device, os ORDER BY epoch_time, row_id) AS gap FROM both_splits)"""))
def agg_std(spark, sf):
    gaps = last_next_union(*develop(spark, sf), ["ip", "device", "os"])
    parts = P.split_back(gaps, ["tr", "val"])
    out = stacked(E.std_features(parts["tr"], parts["val"], ["ip"], "ip_device_os_last_click"), ["ip_std"])
    return out.withColumn("ip_std", r6(F.col("ip_std")))


STATS = ["mean", "count", "sum", "min", "max", "nunique", "std", "var", "median"]
STAT_SQL = {"mean": "avg", "std": "stddev_samp", "var": "var_samp", "median": "median"}


@query("agg_named_dispatch", sql("\nUNION ALL ".join(
    "SELECT '{s}' AS part, os, CAST(round({f}, 6) AS DOUBLE) AS v FROM clicks GROUP BY os".format(
        s=s, f="count(DISTINCT channel)" if s == "nunique" else f"{STAT_SQL.get(s, s)}(channel)")
    for s in STATS)))
def agg_named_dispatch(spark, sf):
    log = clicks(spark, sf)
    made = {s: E.GroupEncoder("os", "channel", s, "v").fit(log).table for s in STATS}
    return stack({s: t.select("os", r6(F.col("v").cast("double")).alias("v")) for s, t in made.items()})


@query("agg_custom_callable", sql("""
SELECT row_id, CAST((max(channel) OVER w - min(channel) OVER w) * 2 AS INTEGER) AS ip_range FROM clicks WINDOW w AS (PARTITION BY ip)"""))
def agg_custom_callable(spark, sf):
    log = clicks(spark, sf)
    spread = lambda c, times: (F.max(c) - F.min(c)) * times
    model = E.GroupEncoder("ip", "channel", spread, "ip_range", func_kwargs={"times": 2}).fit(log)
    return model.transform(log, add_to_orig=False)


@query("udaf_custom_encoder", sql("""
SELECT ip, app, round(avg(CASE WHEN channel >= 50 THEN 1 ELSE 0 END), 6) AS share_above FROM clicks GROUP BY ip, app"""))
def udaf_custom_encoder(spark, sf):
    share = E.AdditiveAggregate(lambda s, cut: [(s >= cut).sum(), len(s)], lambda st: r6(st[0] / st[1]), 2)
    return E.GroupEncoder(["ip", "app"], "channel", share, "share_above", func_kwargs={"cut": 50}).fit(clicks(spark, sf)).table


@query("encoder_estimator", sql("""
SELECT t.row_id, m.n AS channel_cnt FROM test t LEFT JOIN (SELECT channel, count(is_attributed) AS n FROM train GROUP BY channel) m USING (channel)"""))
def encoder_estimator(spark, sf):
    train, _, test = contest(spark, sf)
    return E.GroupEncoder("channel", LABEL, "count", "channel_cnt").fit(train).transform(test, add_to_orig=False)


@query("encoder_ml_pipeline", sql("""
SELECT v.row_id, round(a.y, 6) AS app_mean, h.y AS ip_app_median FROM val v
LEFT JOIN (SELECT app, avg(is_attributed) AS y FROM tr GROUP BY app) a USING (app)
LEFT JOIN (SELECT ip, app, median(channel)::DOUBLE AS y FROM tr GROUP BY ip, app HAVING count(*) >= 2) h USING (ip, app)"""))
def encoder_ml_pipeline(spark, sf):
    tr, val = develop(spark, sf)
    stages = [GroupStatistic(keyCols=["app"], targetCol=LABEL), GroupStatistic(keyCols=["ip", "app"], targetCol="channel", statistic="median", minCount=2)]
    path = scratch_path(spark, "encoder-pipeline")
    Pipeline(stages=stages).fit(tr).write().save(path)
    return PipelineModel.load(path).transform(val).select("row_id", r6(F.col("app_mean")).alias("app_mean"), "ip_app_median")


@query("agg_time_pair_count", sql("SELECT ip, epoch_hour, count(*) AS ip_timecount FROM clicks GROUP BY ip, epoch_hour"))
def agg_time_pair_count(spark, sf):
    train, supp, _ = contest(spark, sf)
    return N.time_pair_counts([train, supp], "ip", "epoch_hour")


PULSE_SQL = ", ".join(f"count(*) OVER (PARTITION BY {', '.join(k)}) AS {name}" for name, k in PULSE_KEYS.items())


@query("agg_pulse_counts", sql(f"SELECT row_id, {PULSE_SQL} FROM coded"))
def agg_pulse_counts(spark, sf):
    log = coded(spark, sf)
    return N.add_named_counts(log, [log], PULSE_KEYS).select("row_id", *PULSE_KEYS)


@query("agg_stacked_count_mean", sql("""
SELECT split AS part, row_id, round(y, 6) AS app_count_mean FROM counted LEFT JOIN m USING (app_count)""",
"c AS (SELECT app, count(is_attributed) AS app_count FROM tr GROUP BY app)",
"counted AS (SELECT b.split, b.row_id, b.is_attributed, c.app_count FROM both_splits b LEFT JOIN c USING (app))",
"m AS (SELECT app_count, avg(is_attributed) AS y FROM counted WHERE split = 'tr' GROUP BY app_count)"))
def agg_stacked_count_mean(spark, sf):
    out = stacked(E.stacked_count_means(*develop(spark, sf), ["app"], LABEL), ["app_count_mean"])
    return out.withColumn("app_count_mean", r6(F.col("app_count_mean")))


@query("agg_distinct_keys", sql("SELECT DISTINCT ip, device, os, app, channel FROM clicks"))
def agg_distinct_keys(spark, sf):
    train, supp, _ = contest(spark, sf)
    return K.distinct_keys([train, supp], DICTIONARY_KEYS[2])


@query("encode_dense_ids", sql("""
SELECT DISTINCT ip, device, os, app, channel, dense_rank() OVER (ORDER BY ip, device, os, app, channel) - 1 AS ip_device_os_app_channel FROM clicks"""))
def encode_dense_ids(spark, sf):
    train, supp, _ = contest(spark, sf)
    return K.key_dictionary([train, supp], DICTIONARY_KEYS[2])


@query("encode_dense_ids_lineitem", """
SELECT DISTINCT l_partkey, l_suppkey, dense_rank() OVER (ORDER BY l_partkey, l_suppkey) - 1 AS l_partkey_l_suppkey FROM lineitem""")
def encode_dense_ids_lineitem(spark, sf):
    return K.key_dictionary([read_table(spark, sf, "lineitem")], ["l_partkey", "l_suppkey"])


@query("agg_value_counts", sql("SELECT app, count(*) AS n FROM clicks GROUP BY app"))
def agg_value_counts(spark, sf):
    return P.value_counts(clicks(spark, sf), "app")


@query("agg_describe", """
SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
  max(value) AS max FROM events""")
def agg_describe(spark, sf):
    out = P.describe(read_table(spark, sf, "events"), "value")
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "q25", "q50", "q75")})


@query("agg_duplicate_rows", sql("""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM clicks GROUP BY ip, epoch_hour)"""))
def agg_duplicate_rows(spark, sf):
    return P.duplicate_rows(clicks(spark, sf), ["ip", "epoch_hour"])


@query("agg_bincount", sql("""
SELECT i AS minute, count(c.row_id) AS n FROM range((SELECT max(epoch_minute) + 1 FROM clicks)) r(i)
LEFT JOIN clicks c ON c.epoch_minute = r.i GROUP BY i"""))
def agg_bincount(spark, sf):
    return P.bincount(clicks(spark, sf).withColumnRenamed("epoch_minute", "minute"), "minute")


@query("agg_unique_index", sql("""
SELECT row_id, ip, app, dense_rank() OVER (ORDER BY ip, app) - 1 AS code, count(*) OVER (PARTITION BY ip, app) AS n FROM clicks"""))
def agg_unique_index(spark, sf):
    return P.unique_inverse(clicks(spark, sf), ["ip", "app"])


@query("agg_class_histogram", sql("""
SELECT is_attributed, CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT is_attributed, CAST(epoch_time AS DOUBLE) AS x FROM clicks),
     (SELECT CAST(min(epoch_time) AS DOUBLE) AS lo, CAST(max(epoch_time) AS DOUBLE) AS hi FROM clicks) GROUP BY ALL"""))
def agg_class_histogram(spark, sf):
    return P.class_histogram(clicks(spark, sf), "epoch_time", 20)


@query("agg_row_count", "SELECT count(*) AS rows FROM events")
def agg_row_count(spark, sf):
    return P.row_count(read_table(spark, sf, "events"))


@query("ratio_features", sql("""
SELECT row_id, round(u / n, 6) AS user_click_ratio, round(a / n, 6) AS app_click_ratio FROM tr JOIN (
  SELECT ip, count(is_attributed) AS n, count(DISTINCT (device, os)) AS u, count(DISTINCT app) AS a FROM tr GROUP BY ip) USING (ip)"""))
def ratio_features(spark, sf):
    tr = coded(spark, sf).where(F.col("split") == "tr")
    made = ((LABEL, "count", "ip_count"), ("ip_device_os", "nunique", "users"), ("app", "nunique", "apps"))
    (tr,) = E.add_encodings([tr], [tr], [E.GroupEncoder("ip", *m) for m in made])
    out = N.click_ratios(tr, "ip_count", {"user_click_ratio": "users", "app_click_ratio": "apps"})
    return out.select("row_id", r6(F.col("user_click_ratio")).alias("user_click_ratio"), r6(F.col("app_click_ratio")).alias("app_click_ratio"))


@query("time_table_split", sql("""
SELECT ip, epoch_hour, n AS ip_timecount, coalesce(epoch_hour - lag(epoch_hour) OVER (PARTITION BY ip ORDER BY epoch_hour), 1000000) AS ip_timediff
FROM (SELECT ip, epoch_hour, count(*) AS n FROM clicks GROUP BY ip, epoch_hour)"""))
def time_table_split(spark, sf):
    return time_table([clicks(spark, sf)], "ip", "epoch_hour")
