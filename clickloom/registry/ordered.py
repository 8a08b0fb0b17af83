"""Windows, sequences and array functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from clickloom.functions import arrays as A
from clickloom.operators import timefeat as T
from clickloom.operators import windows as W
from clickloom.operators.eventlists import sequence_input, store_lists
from clickloom.operators.sequences import HISTORY_COLUMNS, histories, next_step_input
from clickloom.plans.grouped import Carried, apply_ordered
from clickloom.plans.ordered import LastN, ordered_features
from clickloom.registry.base import clicks, develop, query, r6, sql
from clickloom.registry.groups import stacked
from clickloom.schema import LABEL
from clickloom.sources import store
from clickloom.sources.scans import read_table
from clickloom.streaming.history import History, read_arriving

ORDER = "ORDER BY epoch_time, row_id"


def prior(agg: str, key: str) -> str:
    return f"{agg}(is_attributed) OVER (PARTITION BY {key} {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


EXP_KEYS = ["app", "channel", "ip"]
MEAN_SQL = sql(
    "SELECT 'tr' AS part, row_id, {a} FROM tr UNION ALL SELECT 'val', v.row_id, {b} FROM val v {j}".format(
        a=", ".join(f"round(coalesce({prior('avg', k)}, -1), 6) AS {k}_expmean" for k in EXP_KEYS),
        b=", ".join(f"round(coalesce(m_{k}.y, -1), 6)" for k in EXP_KEYS),
        j=" ".join(f"LEFT JOIN (SELECT {k}, avg(is_attributed) AS y FROM tr GROUP BY {k}) m_{k} USING ({k})" for k in EXP_KEYS),
    )
)


@query("win_expanding_mean", MEAN_SQL)
def win_expanding_mean(spark, sf):
    made = W.expanding(*develop(spark, sf), EXP_KEYS, stats=["mean"])
    return stacked(made, [r6(F.col(f"{k}_expmean")).alias(f"{k}_expmean") for k in EXP_KEYS])


COUNT_SQL = sql(
    "SELECT 'tr' AS part, row_id, {a} FROM tr UNION ALL SELECT 'val', v.row_id, {b} FROM val v {j}".format(
        a=", ".join(f"{prior('count', k)} AS {k}_expcount" for k in EXP_KEYS),
        b=", ".join(f"coalesce(m_{k}.y, 0)" for k in EXP_KEYS),
        j=" ".join(f"LEFT JOIN (SELECT {k}, count(is_attributed) AS y FROM tr GROUP BY {k}) m_{k} USING ({k})" for k in EXP_KEYS),
    )
)


@query("win_expanding_count", COUNT_SQL)
def win_expanding_count(spark, sf):
    made = W.expanding(*develop(spark, sf), EXP_KEYS, stats=["count"])
    return stacked(made, [f"{k}_expcount" for k in EXP_KEYS])


@query("win_expanding_split_keys", sql(f"""
SELECT row_id, round(coalesce({prior('avg', 'app')}, -1), 6) AS app_expmean, {prior('count', 'app')} AS app_expcount FROM clicks"""))
def win_expanding_split_keys(spark, sf):
    (out,) = W.expanding(clicks(spark, sf), None, ["app"])
    return out.select("row_id", r6(F.col("app_expmean")).alias("app_expmean"), "app_expcount")


GLOBAL_CTES = [
    """g AS (SELECT app, lag(s) OVER (ORDER BY app) AS ps, lag(n) OVER (ORDER BY app) AS pn
FROM (SELECT app, sum(is_attributed) AS s, count(is_attributed) AS n FROM tr GROUP BY app))""",
    f"""o AS (SELECT row_id, app, {prior('sum', 'app')} AS s, {prior('count', 'app')} AS n,
row_number() OVER (PARTITION BY app {ORDER}) AS rn FROM tr)""",
]


@query("win_expanding_mean_globalshift", sql("""
SELECT row_id, round(coalesce(CASE WHEN rn = 1 THEN ps / pn ELSE s / n END, -1), 6) AS app_expmean FROM o JOIN g USING (app)""", *GLOBAL_CTES))
def win_expanding_mean_globalshift(spark, sf):
    tr, _ = develop(spark, sf)
    (out,) = W.expanding(tr, None, ["app"], stats=["mean"], group_shift="global")
    return out.select("row_id", r6(F.col("app_expmean")).alias("app_expmean"))


@query("win_expanding_count_globalshift", sql("""
SELECT row_id, coalesce(CASE WHEN rn = 1 THEN pn ELSE n END, 0) AS app_expcount FROM o JOIN g USING (app)""", *GLOBAL_CTES))
def win_expanding_count_globalshift(spark, sf):
    tr, _ = develop(spark, sf)
    (out,) = W.expanding(tr, None, ["app"], stats=["count"], group_shift="global")
    return out.select("row_id", "app_expcount")


def gap_sql(kind: str, keys: dict[str, str], table: str = "both_splits", within: str = ", split") -> str:
    cols = []
    for name, key in keys.items():
        for n in (1, 2):
            w = f"OVER (PARTITION BY {key}{within} {ORDER})"
            diff = f"epoch_time - lag(epoch_time, {n}) {w}" if kind == "prev" else f"lead(epoch_time, {n}) {w} - epoch_time"
            cols.append(f"coalesce({diff}, -1) AS {name}_{kind}_click_{n}")
    return f"SELECT row_id, {', '.join(cols)} FROM {table}"


GAP_KEYS = {
    "ip": ["ip"],
    "ip_device_os": ["ip", "device", "os"],
    "ip_device_os_app": ["ip", "device", "os", "app"],
    "ip_device_os_app_channel": ["ip", "device", "os", "app", "channel"],
}
GAP_SQL_KEYS = {name: ", ".join(keys) for name, keys in GAP_KEYS.items()}


def both_splits(spark, sf):
    return clicks(spark, sf).where(F.col("split").isNotNull())


@query("win_prev_click", sql(gap_sql("prev", GAP_SQL_KEYS)))
def win_prev_click(spark, sf):
    out = W.click_gaps_all(both_splits(spark, sf), GAP_KEYS.values(), prev=(1, 2), within=["split"])
    return out.select("row_id", *[f"{n}_prev_click_{i}" for n in GAP_KEYS for i in (1, 2)])


@query("win_next_click", sql(gap_sql("next", GAP_SQL_KEYS)))
def win_next_click(spark, sf):
    out = W.click_gaps_all(both_splits(spark, sf), GAP_KEYS.values(), prev=(), nxt=(1, 2), within=["split"])
    return out.select("row_id", *[f"{n}_next_click_{i}" for n in GAP_KEYS for i in (1, 2)])


@query("win_gaps_split_keys", sql(f"""
SELECT row_id, epoch_time - lag(epoch_time, 2) OVER w AS app_prev_click_2, lead(epoch_time, 2) OVER w - epoch_time AS app_next_click_2
FROM clicks WINDOW w AS (PARTITION BY app {ORDER})"""))
def win_gaps_split_keys(spark, sf):
    out = W.click_gaps(clicks(spark, sf), "app", prev=(2,), nxt=(2,), fill=None)
    return out.select("row_id", "app_prev_click_2", "app_next_click_2")


@query("win_prev_shipdate", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS shipdate,
  coalesce(epoch(l_shipdate)::BIGINT - lag(epoch(l_shipdate)::BIGINT) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice), -1) AS l_suppkey_prev_click_1
FROM lineitem""")
def win_prev_shipdate(spark, sf):
    items = read_table(spark, sf, "lineitem").withColumn("t", F.datediff("l_shipdate", F.lit("1970-01-01")).cast("bigint") * 86400)
    order = ["t", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    out = W.click_gaps(items, "l_suppkey", time="t", order=order)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate"), "l_suppkey_prev_click_1")


TIMES_SQL = sql("""
SELECT c.row_id, c.ip, c.epoch_hour, t.ip_timecount, t.ip_timediff FROM clicks c JOIN (
  SELECT ip, epoch_hour, count(*) AS ip_timecount,
    coalesce(epoch_hour - lag(epoch_hour) OVER (PARTITION BY ip ORDER BY epoch_hour), 1000000) AS ip_timediff
  FROM clicks GROUP BY ip, epoch_hour) t USING (ip, epoch_hour)""")


@query("win_distinct_time_diff", TIMES_SQL)
def win_distinct_time_diff(spark, sf):
    log = clicks(spark, sf)
    return T.add_time_features(log, [log], ["ip"], "epoch_hour").select("row_id", "ip", "epoch_hour", "ip_timecount", "ip_timediff")


GROUP_DIFF_SQL = sql("""
SELECT row_id, CASE WHEN app = lag(app) OVER (ORDER BY row_id) THEN epoch_time - lag(epoch_time) OVER (ORDER BY row_id) ELSE 7200 END AS group_diff
FROM clicks""")


@query("win_group_diff_rows", GROUP_DIFF_SQL)
def win_group_diff_rows(spark, sf):
    return W.adjacent_diff(clicks(spark, sf), F.col("app"), F.col("epoch_time")).select("row_id", "group_diff")


@query("win_last_next_union", sql(f"""
SELECT row_id, split, epoch_time - lag(epoch_time) OVER w AS ip_device_os_last_click, lead(epoch_time) OVER w - epoch_time AS ip_device_os_next_click
FROM both_splits WINDOW w AS (PARTITION BY ip, device, os {ORDER})"""))
def win_last_next_union(spark, sf):
    out = W.last_next_union(*develop(spark, sf), ["ip", "device", "os"])
    return out.select("row_id", "split", "ip_device_os_last_click", "ip_device_os_next_click")


def history_sql(width: int, key: str = "ip") -> str:
    w = f"(PARTITION BY {key} {ORDER} ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"
    padded = ", ".join(
        f"array_to_string(list_concat(list_resize([]::INTEGER[], {width} - len(h_{v}), -1), h_{v}), ',') AS {v}_history" for v in HISTORY_COLUMNS
    )
    lists = ", ".join(f"coalesce(list({v}) OVER {w}, []) AS h_{v}" for v in HISTORY_COLUMNS)
    return f"SELECT row_id, {padded} FROM (SELECT row_id, {lists} FROM clicks)"


def joined(df, cols):
    return df.select("row_id", *[F.array_join(c, ",").alias(c) for c in cols])


HISTORIES = [f"{v}_history" for v in HISTORY_COLUMNS]


@query("win_history_last_n", sql(history_sql(20)))
def win_history_last_n(spark, sf):
    return joined(histories(clicks(spark, sf), deltas=False), HISTORIES)


@query("win_history_split_keys", sql(history_sql(20, "app")))
def win_history_split_keys(spark, sf):
    return joined(histories(clicks(spark, sf), key="app", deltas=False), HISTORIES)


DELTA_SQL = f"""SELECT row_id, [CAST(ts[i] - ts[i - 1] AS INTEGER) FOR i IN range(2, len(ts) + 1)] AS d FROM (
  SELECT row_id, coalesce(list(epoch_time) OVER (PARTITION BY ip {ORDER} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), []) AS ts FROM clicks)"""


@query("win_history_deltas", sql(f"""
SELECT row_id, array_to_string(list_concat(list_resize([]::INTEGER[], 20 - len(d), -1), d), ',') AS time_history FROM ({DELTA_SQL})"""))
def win_history_deltas(spark, sf):
    return joined(histories(clicks(spark, sf), values=[]), ["time_history"])


@query("win_history_length", sql(f"""
SELECT row_id, CAST(least(20, greatest(count(*) OVER (PARTITION BY ip {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0)) AS INTEGER) AS history_length
FROM clicks"""))
def win_history_length(spark, sf):
    return histories(clicks(spark, sf), values=[]).select("row_id", "history_length")


@query("win_cumulative_sum", sql("""
SELECT row_id, split, CAST(sum(is_attributed) OVER (PARTITION BY ip, device, os, app ORDER BY late, t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
  AS ip_device_os_app_cusum FROM (SELECT *, CASE WHEN split = 'val' THEN 1 ELSE 0 END AS late, CASE WHEN split = 'tr' THEN epoch_time ELSE 0 END AS t FROM both_splits)"""))
def win_cumulative_sum(spark, sf):
    out = W.cumulative_sum(*develop(spark, sf), ["ip", "device", "os", "app"])
    return out.select("row_id", "split", "ip_device_os_app_cusum")


@query("win_group_time_diff", sql(f"""
SELECT row_id, epoch_time - lag(epoch_time) OVER (PARTITION BY ip, device {ORDER}) AS click_diff FROM clicks"""))
def win_group_time_diff(spark, sf):
    return W.click_gaps(clicks(spark, sf), ["ip", "device"], fill=None, names=["click_diff"]).select("row_id", "click_diff")


def time_diff() -> Carried:
    """Seconds since the row before, as a function of a group: the state is the last time seen."""

    def step(last, part):
        diff = part["epoch_time"].diff().astype("Int64")
        if last is not None:
            diff.iloc[0] = part["epoch_time"].iloc[0] - last
        return pd.DataFrame({"row_id": part["row_id"], "click_diff": diff}), int(part["epoch_time"].iloc[-1])

    return Carried(lambda: None, step, lambda earlier, later: earlier if later is None else later)


@query("udf_grouped_apply", sql(f"""
SELECT row_id, epoch_time - lag(epoch_time) OVER (PARTITION BY ip, device, os {ORDER}) AS click_diff FROM clicks"""))
def udf_grouped_apply(spark, sf):
    log = clicks(spark, sf).select("row_id", "ip", "device", "os", "epoch_time")
    return apply_ordered(log, ["ip", "device", "os"], ["epoch_time", "row_id"], time_diff(), "row_id long, click_diff long")


def sequence_sql(width: int) -> str:
    earlier = f"(PARTITION BY ip {ORDER} ROWS BETWEEN {{n}} PRECEDING AND 1 PRECEDING)"
    pad = lambda v: f"md5(array_to_string(list_concat(list_resize([]::INTEGER[], {width} - len({v}), -1), {v}), ','))"
    return f"""SELECT row_id, ip AS ip_id, {pad('labels')} AS attributed_md5, {pad('gaps')} AS time_delta_md5,
  CAST(greatest(len(labels), 1) AS INTEGER) AS ip_history_length, is_attributed AS ip_next_download
FROM (SELECT *, [CAST(ts[i] - ts[i - 1] AS INTEGER) FOR i IN range(2, len(ts) + 1)] AS gaps FROM (
  SELECT row_id, ip, is_attributed, coalesce(list(is_attributed) OVER {earlier.format(n=width)}, []) AS labels,
    coalesce(list(epoch_time) OVER {earlier.format(n=width + 1)}, []) AS ts FROM clicks))"""


def sequences_of(spark, sf, width: int):
    lists = store_lists(clicks(spark, sf), store.scratch_path(spark, "event-lists"))
    digest = lambda c: F.md5(F.array_join(c, ","))
    return sequence_input(lists, width).select(
        "row_id", "ip_id", digest("ip_attributed_history").alias("attributed_md5"), digest("ip_time_delta_history").alias("time_delta_md5"),
        "ip_history_length", "ip_next_download")


@query("sequence_input_20", sql(sequence_sql(20)))
def sequence_input_20(spark, sf):
    return sequences_of(spark, sf, 20)


@query("sequence_input_1000", sql(sequence_sql(1000)))
def sequence_input_1000(spark, sf):
    return sequences_of(spark, sf, 1000)


@query("win_sortedness_check", """
SELECT 'ts' AS by, count(*) FILTER (x < p) AS out_of_order, count(*) FILTER (x < p) = 0 AS is_sorted
FROM (SELECT ts AS x, lag(ts) OVER (ORDER BY event_id) AS p FROM events)
UNION ALL SELECT 'value', count(*) FILTER (x < p), count(*) FILTER (x < p) = 0 FROM (SELECT value AS x, lag(value) OVER (ORDER BY event_id) AS p FROM events)""")
def win_sortedness_check(spark, sf):
    events = read_table(spark, sf, "events")
    checks = [W.sortedness(events, c, ["event_id"]).select(F.lit(c).alias("by"), "*") for c in ("ts", "value")]
    return checks[0].unionByName(checks[1])


PLATEAU_SQL = """
WITH m AS (SELECT event_type, event_id, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS a FROM events),
b AS (SELECT *, min(a) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM m),
s AS (SELECT *, max(CASE WHEN p IS NULL OR a < p THEN event_id END) OVER (PARTITION BY event_type ORDER BY event_id) AS best_step FROM b)
SELECT event_type, event_id, round(a, 9) AS avg_loss, round(least(a, p), 9) AS best_loss, best_step, event_id - best_step AS steps_since_best,
  event_id - best_step > 500 AS should_stop FROM s"""


@query("win_rolling_mean_best", PLATEAU_SQL)
def win_rolling_mean_best(spark, sf):
    out = W.plateau(read_table(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value", 100, 500)
    return out.select("event_type", "event_id", F.round("avg_loss", 9).alias("avg_loss"), F.round("best_loss", 9).alias("best_loss"),
                      "best_step", "steps_since_best", "should_stop")


@query("win_rolling_mean_split_keys", """
SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS avg_loss FROM events""")
def win_rolling_mean_split_keys(spark, sf):
    out = W.plateau(read_table(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value", 100)
    return out.select("event_type", "event_id", F.round("avg_loss", 9).alias("avg_loss"))


def recent_arrays(spark, sf):
    """The last 6 earlier channels of the ip, as arrays of 0 to 6 items."""
    made = ordered_features(clicks(spark, sf), ["ip"], ["epoch_time", "row_id"], [LastN("a", F.col("channel"), 6)])
    return made.select("row_id", "a")


ARRAYS = f"""arrays AS (SELECT row_id, coalesce(list(channel) OVER (PARTITION BY ip {ORDER} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS a FROM clicks)"""


@query("array_left_pad", sql("""
SELECT row_id, array_to_string(list_concat(list_resize([]::INTEGER[], greatest(3 - len(a), 0), -1), a[-3:]), ',') AS padded,
  CAST(least(len(a), 3) AS INTEGER) AS kept FROM arrays""", ARRAYS))
def array_left_pad(spark, sf):
    padded, kept = A.left_pad(F.col("a"), 3)
    return recent_arrays(spark, sf).select("row_id", F.array_join(padded, ",").alias("padded"), kept.alias("kept"))


@query("array_left_pad_sliceparity", sql("""
SELECT row_id, array_to_string(list_concat(list_resize([]::INTEGER[], 5 - keep, -1), CASE WHEN keep = 0 THEN [] ELSE a[-keep:] END), ',') AS padded,
  CAST(keep AS INTEGER) AS kept
FROM (SELECT *, CASE WHEN len(a) * 2 > 5 AND len(a) < 5 THEN 5 - len(a) ELSE least(len(a), 5) END AS keep FROM arrays)""", ARRAYS))
def array_left_pad_sliceparity(spark, sf):
    padded, kept = A.left_pad(F.col("a"), 5, mode="slice")
    return recent_arrays(spark, sf).select("row_id", F.array_join(padded, ",").alias("padded"), kept.alias("kept"))


@query("array_roll", sql("""
SELECT row_id, array_to_string(list_concat(a[2:], a[1:1]), ',') AS a, CAST(len(a) - 1 AS INTEGER) AS length, a[-1] - 1 AS label FROM arrays WHERE len(a) > 0""", ARRAYS))
def array_roll(spark, sf):
    df = recent_arrays(spark, sf).where(F.size("a") > 0).withColumns({"length": F.size("a"), "label": F.element_at("a", -1)})
    out = next_step_input(df, ["a"], "label", "length")
    return out.select("row_id", F.array_join("a", ",").alias("a"), "length", "label")


@query("array_one_hot", sql("""
SELECT row_id, array_to_string([CASE WHEN i = app THEN 1 ELSE 0 END FOR i IN range(5)], ',') AS app_hot,
  array_to_string([CASE WHEN i = is_attributed THEN 1 ELSE 0 END FOR i IN range(2)], ',') AS label_hot FROM clicks"""))
def array_one_hot(spark, sf):
    hot = {"app_hot": A.one_hot(F.col("app"), 5), "label_hot": A.one_hot(F.col(LABEL), 2)}
    return clicks(spark, sf).select("row_id", *[F.array_join(c, ",").alias(n) for n, c in hot.items()])


@query("string_series_to_array", sql("""
SELECT row_id, CASE WHEN len(a) > 1 THEN array_to_string(a[:-2], ',') ELSE '-1' END AS history, a[-1] AS label,
  array_to_string(a[:-2], ',') AS gaps FROM arrays WHERE len(a) > 0""", ARRAYS))
def string_series_to_array(spark, sf):
    series = recent_arrays(spark, sf).where(F.size("a") > 0).withColumn("s", F.array_join("a", "_"))
    history, label = A.split_series(F.col("s"))
    return series.select("row_id", F.array_join(history, ",").alias("history"), label.alias("label"),
                         F.array_join(A.drop_last(F.col("s")), ",").alias("gaps"))


@query("array_repeat_explode", sql("""
SELECT ip, epoch_hour, n, unnest(range(n)) * 0 AS zero FROM (SELECT ip, epoch_hour, count(*) AS n FROM clicks GROUP BY ip, epoch_hour)"""))
def array_repeat_explode(spark, sf):
    counted = clicks(spark, sf).groupBy("ip", "epoch_hour").agg(F.count(F.lit(1)).alias("n"))
    return A.repeat_rows(counted, "n", block=2).withColumn("zero", F.lit(0).cast("bigint"))


@query("array_last_valid", sql("""
SELECT row_id, CASE WHEN len(a) > 1 THEN a[len(a) - 1] END AS last_valid FROM arrays""", ARRAYS))
def array_last_valid(spark, sf):
    return recent_arrays(spark, sf).select("row_id", A.last_valid(F.col("a"), F.size("a") - 1).alias("last_valid"))


@query("sequence_model_input", sql("""
SELECT row_id, array_to_string(list_concat(list_resize([]::INTEGER[], 6 - len(h), -1), h), ',') AS ip_attributed_history
FROM (SELECT row_id, coalesce(list(is_attributed) OVER (PARTITION BY ip ORDER BY epoch_time, row_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS h FROM clicks)"""))
def sequence_model_input(spark, sf):
    out = histories(clicks(spark, sf), values=[LABEL], width=6, deltas=False).withColumnRenamed(f"{LABEL}_history", "ip_attributed_history")
    return joined(out, ["ip_attributed_history"])


STREAMED = History(("ip",))
#: The log arrives in two parts, cut here (seconds), and the stream is started anew for the second one.
ARRIVES = (15 * 86400,)


def streamed(spark, sf):
    """Features of all rows: those the watermark has passed, and those still waiting in state when the log ends."""
    log = clicks(spark, sf).select("row_id", "ip", "epoch_time", LABEL)
    folder, out, state = (store.scratch_path(spark, f"stream-{part}") for part in ("clicks", "features", "state"))
    for low, high in zip((None, *ARRIVES), (*ARRIVES, None)):
        part = log if low is None else log.where(F.col("epoch_time") >= low)
        (part if high is None else part.where(F.col("epoch_time") < high)).write.mode("append").parquet(folder)
        STREAMED.run(read_arriving(spark, folder, log.schema), out, state)
    return STREAMED.final(spark, out).unionByName(STREAMED.waiting(spark, state))


@query("stream_expanding", sql(f"""
SELECT row_id, ip, round(coalesce({prior('avg', 'ip')}, -1), 6) AS ip_expmean, {prior('count', 'ip')} AS ip_expcount FROM clicks"""))
def stream_expanding(spark, sf):
    return streamed(spark, sf).select("row_id", "ip", r6(F.col("ip_expmean")).alias("ip_expmean"), "ip_expcount")


@query("stream_gaps", sql(gap_sql("prev", {"ip": "ip"}, "clicks", "")))
def stream_gaps(spark, sf):
    return streamed(spark, sf).select("row_id", "ip_prev_click_1", "ip_prev_click_2")
