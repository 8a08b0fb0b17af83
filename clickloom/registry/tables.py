"""Scans, sinks, projections, splits and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions import columns as C
from clickloom.functions.calendar import epoch_between
from clickloom.operators import splits as S
from clickloom.operators.keys import key_dictionary
from clickloom.operators.sequences import histories
from clickloom.registry.base import clicks, contest, develop, query, r6, sql, stack
from clickloom.schema import CLICK_SCHEMA, LABEL, RAW_FIELDS, feature_name
from clickloom.sources import inspect, scans, sinks, store
from clickloom.sources.scans import EVENTS_ORIGIN, read_table
from clickloom.streaming.chunked import chunked_count_map, read_chunks

RAW = [f.name for f in RAW_FIELDS]


def second_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("click_time")


@query("scan_typed_csv", sql("""
SELECT ip, app, device, os, channel, strftime(click_time, '%Y-%m-%d %H:%M:%S') AS click_time, is_attributed FROM clicks"""))
def scan_typed_csv(spark, sf):
    path = store.scratch_path(spark, "clicks-csv")
    sinks.export_features(clicks(spark, sf), [*RAW, LABEL], path)
    read = scans.read_clicks_csv(spark, path, CLICK_SCHEMA)
    return read.select(*RAW[:-1], second_text("click_time"), LABEL)


@query("scan_pruned", sql("\nUNION ALL ".join(f"SELECT '{part}' AS part, row_id, ip FROM {part}" for part in ("train", "supp", "test"))))
def scan_pruned(spark, sf):
    paths = {part: store.scratch_path(spark, f"pruned-{part}") for part in ("train", "supp", "test")}
    for df, path in zip(contest(spark, sf), paths.values()):
        store.save_table(df, path)
    return stack(scans.read_pruned(spark, paths, ["row_id", "ip"])).select("part", "row_id", "ip")


@query("scan_chunked_partial_agg", "SELECT user_id, event_type, count(*) AS user_id_event_type_cnt FROM events GROUP BY ALL")
def scan_chunked_partial_agg(spark, sf):
    folder = store.scratch_path(spark, "event-chunks")
    events = read_table(spark, sf, "events").select("user_id", "event_type")
    events.repartition(4).write.parquet(folder)
    return chunked_count_map(read_chunks(spark, folder, events.schema), ["user_id", "event_type"])


@query("scan_skip_limit", sql("SELECT row_id, ip, app FROM clicks ORDER BY row_id LIMIT 4000 OFFSET 300"))
def scan_skip_limit(spark, sf):
    return scans.skip_limit(clicks(spark, sf), 300, 4000).select("row_id", "ip", "app")


@query("sink_csv_append", sql("SELECT ip, app, is_attributed, count(*) AS n FROM both_splits GROUP BY ALL"))
def sink_csv_append(spark, sf):
    path = store.scratch_path(spark, "append-csv")
    cols = ["ip", "app", LABEL]
    sinks.append_csv([df.select(*cols) for df in develop(spark, sf)], path)
    schema = T.StructType([f for f in CLICK_SCHEMA if f.name in cols])
    return scans.read_clicks_csv(spark, path, schema).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("dict_roundtrip", sql("""
SELECT DISTINCT ip, device, os, dense_rank() OVER (ORDER BY ip, device, os) - 1 AS ip_device_os FROM clicks"""))
def dict_roundtrip(spark, sf):
    return store.roundtrip(key_dictionary([clicks(spark, sf)], ["ip", "device", "os"]), "dictionary")


@query("feature_table_roundtrip", sql("SELECT row_id, epoch_time, minutes, split FROM both_splits"))
def feature_table_roundtrip(spark, sf):
    tr, val = develop(spark, sf)
    cols = ["row_id", "epoch_time", "minutes", "split"]
    return store.roundtrip(tr.unionByName(val).select(*cols), "features", partition_by="split")


@query("array_column_roundtrip", sql("""
SELECT row_id, array_to_string(h, ',') AS app_history FROM (
  SELECT row_id, list_concat(list_resize([]::INTEGER[], 5 - len(h), -1), h) AS h FROM (
    SELECT row_id, coalesce(list(app) OVER (PARTITION BY ip ORDER BY epoch_time, row_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS h
    FROM clicks))"""))
def array_column_roundtrip(spark, sf):
    made = histories(clicks(spark, sf), values=["app"], width=5, deltas=False).select("row_id", "app_history")
    return store.roundtrip(made, "arrays").select("row_id", F.array_join("app_history", ",").alias("app_history"))


@query("sink_feature_csv", sql("SELECT ip, hourofday, minutes FROM tr"))
def sink_feature_csv(spark, sf):
    path = store.scratch_path(spark, "feature-csv")
    tr, _ = develop(spark, sf)
    sinks.export_features(tr, ["ip", "hourofday", "minutes"], path)
    return scans.read_clicks_csv(spark, path, tr.select("ip", "hourofday", "minutes").schema)


@query("sink_submission", sql("""
SELECT t.row_id AS click_id, round(s.score, 6) AS is_attributed FROM test t
LEFT JOIN (SELECT app, avg(is_attributed) AS score FROM train GROUP BY app) s USING (app)"""))
def sink_submission(spark, sf):
    train, _, test = contest(spark, sf)
    rate = train.groupBy("app").agg(F.avg(LABEL).alias("score"))
    scores = test.join(rate, "app", "left").select(F.col("row_id").alias("click_id"), r6(F.col("score")).alias("score"))
    path = store.scratch_path(spark, "submission")
    sinks.write_submission(test.select(F.col("row_id").alias("click_id")), scores, path)
    return scans.read_clicks_csv(spark, path, T.StructType.fromDDL("click_id bigint, is_attributed double"))


@query("materialize_or_load", sql("""
SELECT 'tr' AS split, ip, count(*) AS n FROM tr GROUP BY ip UNION ALL SELECT 'val', ip, count(*) FROM val GROUP BY ip"""))
def materialize_or_load(spark, sf):
    def compute():
        tr, val = develop(spark, sf)
        return {"tr": tr.groupBy("ip").agg(F.count(F.lit(1)).alias("n")), "val": val.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))}

    paths = {s: store.cache_path(spark, "ip-counts", {"split": s}, [sf]) for s in ("tr", "val")}
    first = store.materialize(spark, compute, paths, rewrite=True)
    again = store.materialize(spark, compute, paths)
    return first["tr"].select(F.lit("tr").alias("split"), "*").unionByName(again["val"].select(F.lit("val").alias("split"), "*"))


@query("schema_introspection", """
SELECT 0 AS "position", 'vec_id' AS "column", 'bigint' AS "type", count(*) AS "rows", CAST(NULL AS INTEGER) AS width FROM embeddings
UNION ALL SELECT 1, 'embedding', 'array<float>', count(*), CAST(max(len(embedding)) AS INTEGER) FROM embeddings
UNION ALL SELECT 2, 'label', 'int', count(*), NULL FROM embeddings""")
def schema_introspection(spark, sf):
    return inspect.describe_schema(read_table(spark, sf, "embeddings"))


@query("project_base_features", sql("SELECT row_id, ip, app, device, os, channel, dayofweek, hourofday FROM clicks"))
def project_base_features(spark, sf):
    return C.project(clicks(spark, sf), ["row_id", "ip", "app", "device", "os", "channel", "dayofweek", "hourofday"])


@query("calendar_parts", sql("SELECT row_id, dayofweek, hourofday FROM clicks"))
def calendar_parts(spark, sf):
    return clicks(spark, sf).select("row_id", "dayofweek", "hourofday")


@query("epoch_offset", sql("SELECT row_id, epoch_time FROM clicks"))
def epoch_offset(spark, sf):
    return clicks(spark, sf).select("row_id", "epoch_time")


@query("minute_second_parts", sql("SELECT row_id, seconds, epoch_minute, minutes FROM clicks"))
def minute_second_parts(spark, sf):
    return clicks(spark, sf).select("row_id", "seconds", "epoch_minute", "minutes")


@query("drop_columns", "SELECT event_id, user_id, event_type, value FROM events")
def drop_columns(spark, sf):
    return C.drop(read_table(spark, sf, "events"), "ts", "props")


@query("constant_label", sql("""
SELECT row_id, is_attributed FROM train UNION ALL SELECT row_id, 0 FROM test
UNION ALL SELECT row_id, NULL FROM supp WHERE hourofday NOT IN (4, 9, 14)"""))
def constant_label(spark, sf):
    train, supp, test = contest(spark, sf)
    unseen = S.split_complement(supp, F.col("hourofday").isin(4, 9, 14))[1]
    parts = [train, C.constant_label(test, 0), C.constant_label(unseen, None)]
    return reduce(lambda a, b: a.unionByName(b), [p.select("row_id", LABEL) for p in parts])


@query("narrow_types", sql("""
SELECT row_id, CAST(hourofday AS SMALLINT) AS hour8, CAST(epoch_minute % 256 AS SMALLINT) AS minute8, CAST(channel AS INTEGER) AS channel16
FROM clicks"""))
def narrow_types(spark, sf):
    return clicks(spark, sf).select(
        "row_id",
        C.narrow(F.col("hourofday"), "uint8").alias("hour8"),
        C.narrow(F.col("epoch_minute"), "uint8", wrap=True).alias("minute8"),
        C.narrow(F.col("channel"), "uint16").alias("channel16"),
    )


@query("fill_missing", """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def fill_missing(spark, sf):
    docs, labels = read_table(spark, sf, "documents").select("doc_id"), read_table(spark, sf, "labels")
    return C.fill(docs.join(labels, "doc_id", "left"), {"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic")


@query("split_temporal_train", sql("SELECT row_id, ip, epoch_time FROM clicks WHERE (dayofweek = 3 AND hourofday < 4) OR dayofweek < 3"))
def split_temporal_train(spark, sf):
    return clicks(spark, sf).where(S.is_train_time()).select("row_id", "ip", "epoch_time")


@query("split_temporal_valid", sql("""
SELECT row_id, hourofday IN (4, 9, 14) AS short_list FROM clicks WHERE dayofweek = 3 AND hourofday IN (4, 5, 9, 10, 13, 14)"""))
def split_temporal_valid(spark, sf):
    return clicks(spark, sf).where(S.is_valid_time()).select("row_id", S.is_valid_time([4, 9, 14]).alias("short_list"))


@query("split_complement", sql("""
SELECT row_id, coalesce(split = 'tr', false) AS met FROM clicks"""))
def split_complement(spark, sf):
    met, rest = S.split_complement(clicks(spark, sf), F.col("split") == "tr")
    return met.select("row_id", F.lit(True).alias("met")).unionByName(rest.select("row_id", F.lit(False).alias("met")))


@query("filter_point_lookup", sql("SELECT row_id, app, epoch_time FROM clicks WHERE ip = 8"))
def filter_point_lookup(spark, sf):
    return clicks(spark, sf).where(F.col("ip") == 8).select("row_id", "app", "epoch_time")


@query("filter_time_range", sql("""
SELECT row_id, epoch_time, epoch_time <= 349200 AS early FROM clicks WHERE epoch_time BETWEEN 309600 AND 349200 OR epoch_time >= 2000000"""))
def filter_time_range(spark, sf):
    at, t = F.col("click_time"), F.col("epoch_time")
    wanted = epoch_between(at, 309600, 349200, EVENTS_ORIGIN) | epoch_between(at, 2000000, None, EVENTS_ORIGIN)
    return clicks(spark, sf).where(wanted).select("row_id", "epoch_time", (t <= 349200).alias("early"))


@query("missing_indicator", """
SELECT CAST(quality IS NULL AS INTEGER) AS is_missing, lang, count(*) AS n, count(quality) AS n_known
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def missing_indicator(spark, sf):
    docs, labels = read_table(spark, sf, "documents").select("doc_id", "lang"), read_table(spark, sf, "labels")
    both = docs.join(labels, "doc_id", "left").withColumn("is_missing", C.missing_indicator(F.col("quality")))
    return both.groupBy("is_missing", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_known"))


@query("rename_feature", sql("SELECT ip, app, count(*) AS ip_app_cnt, count(DISTINCT channel) AS ip_app_unq_channel FROM clicks GROUP BY ip, app"))
def rename_feature(spark, sf):
    keys = ["ip", "app"]
    return clicks(spark, sf).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(feature_name(keys, "cnt")), F.count_distinct("channel").alias(feature_name(keys, "unq", "channel"))
    )


@query("mask_rows", sql("SELECT row_id, app, os FROM clicks WHERE app = os"))
def mask_rows(spark, sf):
    return C.mask(clicks(spark, sf), F.col("app") == F.col("os")).select("row_id", "app", "os")


@query("add_or_replace_column", sql("SELECT row_id, app + 1 AS app, CAST(app * 10 + os AS INTEGER) AS app_os FROM clicks"))
def add_or_replace_column(spark, sf):
    df = C.set_column(clicks(spark, sf), "app_os", F.col("app") * 10 + F.col("os"))
    df = C.set_column(df, "app", F.col("app") + 1)
    return df.select("row_id", "app", "app_os")


# A multiplicative draw that SQL can repeat, in place of the default hash.
DRAW = "((row_id * 48271 + 11) % 2147483647)"


def draw(col="row_id"):
    return (F.col(col) * 48271 + 11) % 2147483647


@query("split_random_fraction", sql(f"""
SELECT row_id, CASE WHEN {DRAW} / 2147483647.0 < 0.8 THEN 'train' ELSE 'test' END AS part FROM clicks"""))
def split_random_fraction(spark, sf):
    first, rest = S.random_split(clicks(spark, sf), 0.8, draw=draw() / 2147483647)
    tagged = first.select("row_id", F.lit("train").alias("part")), rest.select("row_id", F.lit("test").alias("part"))
    return tagged[0].unionByName(tagged[1])


@query("split_random_fraction_hashed")
def split_random_fraction_hashed(spark, sf):
    first, rest = S.random_split(clicks(spark, sf), 0.9)
    tagged = first.select("row_id", F.lit("train").alias("part")), rest.select("row_id", F.lit("test").alias("part"))
    return tagged[0].unionByName(tagged[1])


@query("kfold_assign", sql("SELECT row_id, CAST(row_id % 5 AS INTEGER) AS fold FROM clicks"))
def kfold_assign(spark, sf):
    return clicks(spark, sf).select("row_id", S.kfold(5, seed=None).alias("fold"))


BATCH_SQL = """
SELECT row_id, batch_id FROM (SELECT row_id, (row_number() OVER (ORDER BY {order}) - 1) // 64 AS batch_id FROM clicks)
WHERE batch_id < (SELECT count(*) // 64 FROM clicks)"""


@query("shuffle_batches", sql(BATCH_SQL.format(order=f"{DRAW}, row_id")))
def shuffle_batches(spark, sf):
    return S.shuffled_batches(clicks(spark, sf), 64, draw=draw()).select("row_id", "batch_id")


@query("shuffle_batches_hashed")
def shuffle_batches_hashed(spark, sf):
    return S.shuffled_batches(clicks(spark, sf), 64, epoch=1).select("row_id", "batch_id")


@query("ordered_batches", sql(BATCH_SQL.format(order="row_id")))
def ordered_batches(spark, sf):
    return S.shuffled_batches(clicks(spark, sf), 64, shuffle=False).select("row_id", "batch_id")


@query("sample_one_entity", sql("""
SELECT row_id, ip, epoch_time FROM clicks WHERE ip = (SELECT arg_min(ip, (ip * 48271 + 11) % 2147483647) FROM clicks)"""))
def sample_one_entity(spark, sf):
    return S.sample_entity(clicks(spark, sf), "ip", draw=draw("ip")).select("row_id", "ip", "epoch_time")
