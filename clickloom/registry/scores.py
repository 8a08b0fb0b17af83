"""Sorting, set operations, scaling, metrics and model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import arrays as A
from clickloom.functions import numeric as X
from clickloom.operators import metrics as M
from clickloom.operators import model as L
from clickloom.operators import profile as P
from clickloom.operators.assembly import BASE_FEATURES, COUNT_FEATURES, TIME_FEATURES, staged_features
from clickloom.operators.counts import add_count_maps
from clickloom.operators.encoder import count_features, distinct_features
from clickloom.operators.keys import distinct_keys
from clickloom.operators.scaling import P_MIN, QuantileMap, normalize_splits, scale_l2
from clickloom.operators.sequences import histories
from clickloom.operators.windows import click_gaps, expanding
from clickloom.registry.base import BUCKETED_BY, DETERMINE_IT, clicks, coded, contest, develop, query, r6, sql
from clickloom.registry.groups import CODED_PARTS, develop_coded, stack
from clickloom.schema import COUNT_KEYS, LABEL, TIME_KEYS, feature_name
from clickloom.sources.scans import read_table
from clickloom.sources.store import release, roundtrip


@query("sort_by_time", sql("SELECT row_id, epoch_time, row_number() OVER (ORDER BY epoch_time, row_id) - 1 AS position FROM clicks"))
def sort_by_time(spark, sf):
    return P.number_rows(clicks(spark, sf).select("row_id", "epoch_time"), ["epoch_time", "row_id"])


@query("sort_key_time", sql("SELECT ip, device, os, epoch_time, row_id FROM clicks ORDER BY ip, device, os, epoch_time, row_id"))
def sort_key_time(spark, sf):
    order = ["ip", "device", "os", "epoch_time", "row_id"]
    return P.sort_rows(clicks(spark, sf).select(*order), *order)


@query("restore_row_order", sql("SELECT row_id, ip, row_number() OVER (ORDER BY row_id) - 1 AS position FROM clicks ORDER BY row_id"))
def restore_row_order(spark, sf):
    shuffled = clicks(spark, sf).select("row_id", "ip").repartition("ip")
    return P.number_rows(shuffled, ["row_id"]).orderBy("row_id")


@query("head_tail", sql("""
SELECT * FROM (SELECT 'head' AS part, row_id, ip, app FROM clicks ORDER BY row_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'tail', row_id, ip, app FROM clicks ORDER BY row_id DESC LIMIT 5)"""))
def head_tail(spark, sf):
    log = clicks(spark, sf).select("row_id", "ip", "app")
    return stack({"head": P.head(log, 5), "tail": P.tail(log, 5)})


@query("sort_lexicographic_unique", sql("""
SELECT ip, epoch_hour, min(row_id) AS first_row, count(*) AS n, row_number() OVER (ORDER BY ip, epoch_hour) - 1 AS code FROM clicks GROUP BY ip, epoch_hour"""))
def sort_lexicographic_unique(spark, sf):
    return P.unique_rows(clicks(spark, sf), ["ip", "epoch_hour"])


@query("union_all_splits", sql("""
SELECT 'train' AS split, row_id, ip, is_attributed FROM train UNION ALL SELECT 'test', row_id, ip, NULL FROM test"""))
def union_all_splits(spark, sf):
    train, _, test = contest(spark, sf)
    return P.union_splits({"train": train.select("row_id", "ip", LABEL), "test": test.select("row_id", "ip")})


@query("union_distinct_keys", sql("SELECT ip, app FROM train UNION SELECT ip, app FROM supp"))
def union_distinct_keys(spark, sf):
    train, supp, _ = contest(spark, sf)
    return distinct_keys([train, supp], ["ip", "app"])


@query("drop_duplicates", sql("SELECT DISTINCT ip, epoch_hour FROM clicks"))
def drop_duplicates(spark, sf):
    return clicks(spark, sf).select("ip", "epoch_hour").dropDuplicates()


@query("split_back", sql("SELECT row_id, app FROM val"))
def split_back(spark, sf):
    tr, val = develop(spark, sf)
    return P.split_back(P.union_splits({"tr": tr, "val": val}), ["tr", "val"])["val"].select("row_id", "app")


@query("math_log1p", sql(f"""
SELECT row_id, round(ln(1 + ln(1 + d)), 6) AS squashed FROM (
  SELECT row_id, epoch_time - lag(epoch_time) OVER (PARTITION BY ip ORDER BY epoch_time, row_id) AS d FROM clicks) WHERE d IS NOT NULL"""))
def math_log1p(spark, sf):
    gaps = click_gaps(clicks(spark, sf), "ip", fill=None, names=["d"]).dropna(subset=["d"])
    return gaps.select("row_id", r6(X.log1p_twice(F.col("d"))).alias("squashed"))


@query("math_clip", "SELECT event_id, least(greatest(value / 100, 0.05), 0.95) AS clipped FROM events")
def math_clip(spark, sf):
    return read_table(spark, sf, "events").select("event_id", X.clip_probability(F.col("value") / 100, 0.05).alias("clipped"))


# The 17 columns scaled to length one, and the 23 mapped to a normal distribution.
L2_COUNTS = ["app", "channel", "ip", "os", "ip_device_os_app_channel", "ip_device_os_app", "ip_device_os"]
L2_RUNNING = ["app", "channel", "ip"]
L2_GAPS = {"ip_device_os_app_channel": {"next": (1, 2), "prev": (1, 2)}, "ip_device_os_app": {"next": (1, 2), "prev": (1,)}}
L2_GAP_NAMES = [f"{k}_{kind}_click_{n}" for k, kinds in L2_GAPS.items() for kind, ns in kinds.items() for n in ns]
L2_COLUMNS = [f"{k}_count" for k in L2_COUNTS] + [f"{k}_expcount" for k in L2_RUNNING] + L2_GAP_NAMES
NORMAL_GAPS = {"ip": (1,), "ip_device_os": (1,), "ip_device_os_app": (1, 2)}
NORMAL_GAP_NAMES = [f"{k}_{kind}_click_{n}" for k, ns in NORMAL_GAPS.items() for kind in ("prev", "next") for n in ns]
WIDE_INPUT = list(dict.fromkeys(["row_id", "epoch_time", LABEL, "hourofday", *L2_RUNNING, *NORMAL_GAPS, *L2_COUNTS]))
NORMAL_COLUMNS = (
    ["hourofday", *[f"{k}_expmean" for k in L2_RUNNING], *NORMAL_GAP_NAMES, *[f"{k}_count" for k in L2_COUNTS]]
    + [f"{k}_expcount" for k in L2_RUNNING] + ["ip_unq_app"]
)


def gap_column(name: str) -> str:
    """SQL of a gap named `<key>_prev_click_<n>` or `<key>_next_click_<n>`."""
    key, kind, _, n = name.rsplit("_", 3)
    w = f"(PARTITION BY {key} ORDER BY epoch_time, row_id)"
    return f"coalesce({f'epoch_time - lag(epoch_time, {n}) OVER {w}' if kind == 'prev' else f'lead(epoch_time, {n}) OVER {w} - epoch_time'}, -1) AS {name}"


def earlier_labels(agg: str, key: str) -> str:
    return f"{agg}(is_attributed) OVER (PARTITION BY {key} ORDER BY epoch_time, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


L2_SQL = sql(
    "SELECT row_id, {c} FROM f, n".format(c=", ".join(f"round(f.{c} / n.{c}, 9) AS {c}_normalized" for c in L2_COLUMNS)),
    *CODED_PARTS,
    "f AS (SELECT row_id, {counts}, {running}, {gaps} FROM ctr)".format(
        counts=", ".join(f"count(is_attributed) OVER (PARTITION BY {k}) AS {k}_count" for k in L2_COUNTS),
        running=", ".join(f"{earlier_labels('count', k)} AS {k}_expcount" for k in L2_RUNNING),
        gaps=", ".join(gap_column(c) for c in L2_GAP_NAMES),
    ),
    "n AS (SELECT {c} FROM f)".format(c=", ".join(f"coalesce(nullif(sqrt(sum(CAST({c} AS DOUBLE) * {c})), 0), 1) AS {c}" for c in L2_COLUMNS)),
)


@query("scale_l2", L2_SQL)
def scale_l2_columns(spark, sf):
    tr, _ = develop_coded(spark, sf)
    tr, _ = count_features(tr, tr.where(F.lit(False)), L2_COUNTS, LABEL)
    (tr,) = expanding(tr, None, L2_RUNNING, stats=["count"])
    for key, kinds in L2_GAPS.items():
        tr = click_gaps(tr, key, prev=kinds["prev"], nxt=kinds["next"])
    # The norms need all rows before the first one can be scaled, so the features are written once.
    tr = roundtrip(tr.select("row_id", *L2_COLUMNS), "scaled-l2")
    return scale_l2(tr, L2_COLUMNS).select("row_id", *[F.round(f"{c}_normalized", 9).alias(f"{c}_normalized") for c in L2_COLUMNS])


PROBS = ", ".join(str(i / 100) for i in range(101))


def rank_sql(edge: str) -> str:
    """Rank of x among the 101 landmarks v, ties to the middle of their share."""
    return f"""CASE WHEN x - {edge} <= v[1] THEN 0.0 WHEN x + {edge} >= v[101] THEN 1.0 ELSE
  ((le - 1) / 100.0 + (x - v[le]) / (v[le + 1] - v[le]) / 100.0
   + lt / 100.0 - CASE WHEN v[lt + 1] = x THEN 0 ELSE (v[lt + 1] - x) / (v[lt + 1] - v[lt]) / 100.0 END) / 2 END"""


def polynomial_sql(coefficients, x: str) -> str:
    out = repr(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {float(c)!r})"
    return out


def ratio_sql(region, x: str) -> str:
    return f"{polynomial_sql(region[0], x)} / {polynomial_sql(region[1], x)}"


NORMAL_SQL = f"""CASE WHEN abs(q) <= 0.425 THEN q * {ratio_sql(X.CENTRAL, "c")}
  ELSE sign(q) * CASE WHEN r <= 5 THEN {ratio_sql(X.MIDDLE, "(r - 1.6)")} ELSE {ratio_sql(X.TAIL, "(r - 5)")} END END"""
PLACES = "len([t FOR t IN v IF t <= x]) AS le, len([t FOR t IN v IF t < x]) AS lt"
RANK_CTES = [
    f"q AS (SELECT quantile_cont(CAST(value AS DOUBLE), [{PROBS}]) AS v FROM events)",
    f"placed AS (SELECT event_id, value AS x, v, {PLACES} FROM events, q)",
    f"p AS (SELECT event_id, {rank_sql('0')} AS u FROM placed)",
]


@query("scale_quantile_uniform", "WITH " + ",\n".join(RANK_CTES) + " SELECT event_id, round(u, 6) AS value FROM p")
def scale_quantile_uniform(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "value")
    out = QuantileMap.fit(events, ["value"], 101).transform(events, "uniform")
    return out.select("event_id", r6(F.col("value")).alias("value"))


SCALED = ["ip", "channel", "epoch_time", "minutes"]
SCALED_VALUES = "unnest([" + ", ".join(f"{{'name': '{c}', 'x': CAST({c} AS DOUBLE)}}" for c in SCALED) + "], recursive := true)"
NORMAL_CTES = [
    "parts AS (" + " UNION ALL ".join(
        f"SELECT '{part}' AS part, '{fit}' AS fit, row_id, {SCALED_VALUES} FROM {part}"
        for part, fit in (("tr", "tr"), ("val", "tr"), ("train", "train"), ("test", "train"))
    ) + ")",
    f"marks AS (SELECT fit, name, quantile_cont(x, [{PROBS}]) AS v FROM parts WHERE part = fit GROUP BY fit, name)",
    f"placed AS (SELECT part, row_id, name, x, v, {PLACES} FROM parts JOIN marks USING (fit, name))",
    f"ranked AS (SELECT part, row_id, name, least(greatest({rank_sql('1e-7')}, {P_MIN!r}), {1 - P_MIN!r}) AS p FROM placed)",
    "n AS (SELECT part, row_id, name, p - 0.5 AS q, 0.180625 - (p - 0.5) * (p - 0.5) AS c, sqrt(-ln(least(p, 1 - p))) AS r FROM ranked)",
]


@query("scale_quantile_normal", sql(f"SELECT part, row_id, name, round({NORMAL_SQL}, 6) + 0.0 AS value FROM n", *NORMAL_CTES))
def scale_quantile_normal(spark, sf):
    train, _, test = contest(spark, sf)
    tables = [df.select("row_id", *SCALED) for df in (*develop(spark, sf), train, test)]
    done = stack(dict(zip(("tr", "val", "train", "test"), normalize_splits(*tables, SCALED, n_quantiles=101))))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), r6(F.col(c)).alias("value")) for c in SCALED]))
    return done.select("part", "row_id", pairs.alias("p")).select("part", "row_id", "p.name", "p.value")


def wide_step(part, name: str):
    """Written, so that the next step counts and samples a table and not all joins and windows before it."""
    release(part.sparkSession)
    done = roundtrip(part, name)
    release(part.sparkSession)
    return done


def wide_features(spark, sf):
    """(tr, val) with the 23 columns, written once: fitting a map and applying it both read them."""
    base = [part.select(*WIDE_INPUT) for part in develop_coded(spark, sf)]
    # A code tells the ip: with the ip beside it, windows and joins of the codes stay where those of the ip have put the rows.
    ordered = []
    for part, source in zip(expanding(*base, L2_RUNNING), base):
        for key, ns in NORMAL_GAPS.items():
            part = click_gaps(part, key, prev=ns, nxt=ns, within=[BUCKETED_BY] if key in DETERMINE_IT else [], source=source)
        ordered.append(wide_step(part, "wide-ordered"))
    made = distinct_features(*ordered, [(["ip"], "app")])
    made = count_features(*made, L2_COUNTS, LABEL, by=BUCKETED_BY, determines=DETERMINE_IT)
    return [wide_step(part.select("row_id", *NORMAL_COLUMNS), "scaled-wide") for part in made]


def wide_sql(part: str) -> str:
    """The 23 columns of `ctr` or `cval`; val gets statistics of all of tr where tr gets those of its earlier rows."""
    if part == "ctr":
        running = [f"coalesce({earlier_labels('avg', k)}, -1) AS {k}_expmean, {earlier_labels('count', k)} AS {k}_expcount" for k in L2_RUNNING]
        joins = []
    else:
        running = [f"coalesce(e_{k}.y, -1) AS {k}_expmean, coalesce(e_{k}.n, 0) AS {k}_expcount" for k in L2_RUNNING]
        joins = [f"LEFT JOIN e_{k} USING ({k})" for k in L2_RUNNING]
    counts = [f"c_{k}.n AS {k}_count" for k in L2_COUNTS]
    joins += [f"LEFT JOIN c_{k} USING ({k})" for k in L2_COUNTS] + ["LEFT JOIN u_ip USING (ip)"]
    cols = ", ".join(["hourofday", *running, *[gap_column(c) for c in NORMAL_GAP_NAMES], *counts, "u_ip.n AS ip_unq_app"])
    return f"SELECT '{part[1:]}' AS part, row_id, {cols} FROM {part} {' '.join(joins)}"


WIDE_VALUES = "unnest([" + ", ".join(f"{{'name': '{c}', 'x': CAST({c} AS DOUBLE)}}" for c in NORMAL_COLUMNS) + "], recursive := true)"
WIDE_CTES = [
    *CODED_PARTS,
    "cboth AS (SELECT * FROM ctr UNION ALL SELECT * FROM cval)",
    *[f"c_{k} AS (SELECT {k}, count(is_attributed) AS n FROM cboth GROUP BY {k})" for k in L2_COUNTS],
    *[f"e_{k} AS (SELECT {k}, avg(is_attributed) AS y, count(is_attributed) AS n FROM ctr GROUP BY {k})" for k in L2_RUNNING],
    "u_ip AS (SELECT ip, count(DISTINCT app) AS n FROM cboth GROUP BY ip)",
    f"wide AS ({wide_sql('ctr')} UNION ALL BY NAME {wide_sql('cval')})",
    f"melted AS (SELECT part, row_id, {WIDE_VALUES} FROM wide)",
    "steps AS (SELECT least(1000, count(*)) - 1 AS s FROM ctr)",
    "sorted AS (SELECT name, list_sort(list(x)) AS l FROM melted WHERE part = 'tr' GROUP BY name)",
    "places AS (SELECT name, l, s, i, (len(l) - 1) * i / s AS pos FROM sorted, steps, range(1000) r(i) WHERE i <= s)",
    "marks AS (SELECT name, i, s, l[CAST(floor(pos) AS BIGINT) + 1] + (l[CAST(ceil(pos) AS BIGINT) + 1] - l[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos)) AS t FROM places)",
    "g AS (SELECT name, t, min(s) AS s, min(i) AS i1, max(i) AS i2 FROM marks GROUP BY name, t)",
    "ends AS (SELECT name, min(t) AS t1, max(t) AS t2 FROM marks GROUP BY name)",
    "below AS (SELECT v.name, v.x, g.t AS b, g.i1, g.i2, g.s FROM (SELECT DISTINCT name, x FROM melted) v ASOF LEFT JOIN g ON v.name = g.name AND v.x >= g.t)",
    "around AS (SELECT below.*, g.t AS a FROM below ASOF LEFT JOIN g ON below.name = g.name AND below.x <= g.t)",
    """wide_ranks AS (SELECT name, x, CASE WHEN x - 1e-7 <= t1 THEN 0.0 WHEN x + 1e-7 >= t2 THEN 1.0
  WHEN b = x THEN (i1 + i2) / 2 / s ELSE (i2 + (x - b) / (a - b)) / s END AS u FROM around JOIN ends USING (name))""",
    f"clipped AS (SELECT name, x, least(greatest(u, {P_MIN!r}), {1 - P_MIN!r}) AS p FROM wide_ranks)",
    "n AS (SELECT name, x, p - 0.5 AS q, 0.180625 - (p - 0.5) * (p - 0.5) AS c, sqrt(-ln(least(p, 1 - p))) AS r FROM clipped)",
    f"mapped AS (SELECT name, x, round({NORMAL_SQL}, 6) + 0.0 AS value FROM n)",
]
WIDE_SQL = sql("SELECT part, row_id, name, value FROM melted JOIN mapped USING (name, x)", *WIDE_CTES)


def melted_normal(tr, val, landmarks: QuantileMap):
    done = stack({"tr": landmarks.transform(tr), "val": landmarks.transform(val)})
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), r6(F.col(c)).alias("value")) for c in NORMAL_COLUMNS]))
    return done.select("part", "row_id", pairs.alias("p")).select("part", "row_id", "p.name", "p.value")


@query("scale_quantile_normal_wide", WIDE_SQL)
def scale_quantile_normal_wide(spark, sf):
    tr, val = wide_features(spark, sf)
    return melted_normal(tr, val, QuantileMap.fit(tr, NORMAL_COLUMNS, 1000))


@query("scale_quantile_normal_sketch")
def scale_quantile_normal_sketch(spark, sf):
    """As `scale_quantile_normal_wide`, from sketches of one scan; ranks may be off by 0.0005, so it has no SQL."""
    tr, val = wide_features(spark, sf)
    return melted_normal(tr, val, QuantileMap.fit(tr, NORMAL_COLUMNS, 1000, rank_error=0.0005))


@query("embedding_dot", """
SELECT a.vec_id, round(list_sum([CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) FOR i IN range(1, len(a.embedding) + 1)]), 6) + 0.0 AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_dot(spark, sf):
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(after, "vec_id").select("vec_id", r6(A.dot(F.col("embedding"), F.col("other"))).alias("dot"))


SCORE = "CAST(app * 10 + os AS DOUBLE) / 100"
AUC_OF = """SELECT {by} round(sum(pos * (below + neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0), 9) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {by} score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY {by} score)) {group}"""


def scored_clicks(spark, sf):
    return clicks(spark, sf).withColumn("score", (F.col("app") * 10 + F.col("os")) / 100)


def with_auc(df):
    return df.withColumn("auc", F.round("auc", 9))


@query("metric_roc_auc", sql(AUC_OF.format(by="", part="", group=""), f"scored AS (SELECT is_attributed AS y, {SCORE} AS score FROM clicks)"))
def metric_roc_auc(spark, sf):
    return with_auc(M.roc_auc(scored_clicks(spark, sf)))


@query("metric_roc_auc_documents", "WITH scored AS (SELECT quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id)) "
       + AUC_OF.format(by="", part="", group=""))
def metric_roc_auc_documents(spark, sf):
    both = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return with_auc(M.roc_auc(both, "quality", "n_chars"))


@query("metric_auc_by_epoch", sql(AUC_OF.format(by="epoch,", part="PARTITION BY epoch", group="GROUP BY epoch"),
       f"scored AS (SELECT dayofweek AS epoch, is_attributed AS y, {SCORE} AS score FROM clicks WHERE dayofweek % 2 = 0)"))
def metric_auc_by_epoch(spark, sf):
    return with_auc(M.auc_by_epoch(scored_clicks(spark, sf).withColumnRenamed("dayofweek", "epoch"), interval=2))


LOSS = "y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))"


@query("metric_log_loss", sql(f"SELECT round(-avg({LOSS}), 6) AS log_loss FROM (SELECT is_attributed AS y, {SCORE} AS p FROM clicks)"))
def metric_log_loss(spark, sf):
    return M.log_loss(scored_clicks(spark, sf)).select(r6(F.col("log_loss")).alias("log_loss"))


STEPS_SQL = """steps AS (SELECT h.row_id, unnest(h.ys) AS y, unnest(h.ps) AS p FROM (
  SELECT row_id, list(is_attributed) OVER w AS ys, list((app + 0.5) / 10) OVER w AS ps FROM clicks
  WINDOW w AS (PARTITION BY ip ORDER BY epoch_time, row_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) h WHERE h.ys IS NOT NULL)"""


def step_arrays(spark, sf):
    """Labels and predictions of the last 8 clicks, valid steps first, then padding."""
    df = histories(clicks(spark, sf), values=[LABEL, "app"], width=8, deltas=False)
    length = F.size(F.filter(f"{LABEL}_history", lambda v: v >= 0))
    front = lambda c: F.concat(F.slice(c, 9 - F.col("n"), F.greatest(F.col("n"), F.lit(1))), F.array_repeat(F.lit(-1), 8 - F.col("n")))
    df = df.withColumn("n", length).withColumns({"ys": front(F.col(f"{LABEL}_history")), "ps": front(F.col("app_history"))})
    return df.withColumn("ps", F.transform("ps", lambda v: (v + 0.5) / 10))


@query("metric_seq_log_loss", sql(f"SELECT round(-sum({LOSS}) / count(*), 6) AS log_loss FROM steps", STEPS_SQL))
def metric_seq_log_loss(spark, sf):
    df = step_arrays(spark, sf).where(F.col("n") > 0)
    return M.sequence_log_loss(df, "ys", "ps", "n").select(r6(F.col("log_loss")).alias("log_loss"))


@query("metric_seq_rmse", sql("SELECT round(sqrt(sum((y - p) * (y - p)) / count(*)), 6) AS rmse FROM steps", STEPS_SQL))
def metric_seq_rmse(spark, sf):
    df = step_arrays(spark, sf).where(F.col("n") > 0)
    return M.sequence_rmse(df, "ys", "ps", "n").select(r6(F.col("rmse")).alias("rmse"))


def features_table(spark, sf):
    """Clicks with a few count and gap features, written once."""
    tr, val = develop(spark, sf)
    tr, val = count_features(tr, val, ["ip", "app", "channel"], LABEL)
    tr, val = (click_gaps(df, "ip", prev=(1,), nxt=(1,)) for df in (tr, val))
    return roundtrip(tr, "model-tr"), roundtrip(val, "model-val")


BASE = ["ip", "app", "device", "os", "channel", "hourofday"]
EXTRA = ["ip_count", "app_count", "ip_prev_click_1"]
SMALL = L.BoostParams(trees=12, depth=4, pos_weight=4.0, bins=32, patience=6)


@query("model_fit_score")
def model_fit_score(spark, sf):
    tr, val = features_table(spark, sf)
    return L.fit_score(tr, val, [*BASE, *EXTRA], SMALL).scores


@query("model_incremental_feature_eval")
def model_incremental_feature_eval(spark, sf):
    return L.incremental_eval(*features_table(spark, sf), BASE, EXTRA, SMALL)


@query("model_forward_selection")
def model_forward_selection(spark, sf):
    return L.forward_selection(*features_table(spark, sf), BASE, EXTRA, SMALL)


@query("model_param_sweep")
def model_param_sweep(spark, sf):
    sets = {
        "shallow": L.BoostParams(trees=16, depth=2, pos_weight=4.0, min_rows=10, patience=6),
        "middle": L.BoostParams(trees=12, depth=3, step=0.2, pos_weight=4.0, patience=6),
        "deep": L.BoostParams(trees=8, depth=4, pos_weight=2.0, row_share=0.8, feature_share="0.8", patience=6),
    }
    return L.param_sweep(*features_table(spark, sf), [*BASE, *EXTRA], sets)


@query("model_refit_full")
def model_refit_full(spark, sf):
    tr, val = features_table(spark, sf)
    developed = L.fit_score(tr, val, BASE, SMALL)
    train, _, test = contest(spark, sf)
    return L.refit_full(train, test, developed, tr.count(), train.count()).scores


STAGED_SQL = sql(
    "SELECT c.row_id, {base}, {counts}, {times} FROM coded c {joins}".format(
        base=", ".join(f"c.{b}" for b in BASE_FEATURES),
        counts=", ".join(f"count(*) OVER (PARTITION BY {', '.join('c.' + x for x in k)}) AS {feature_name(k, 'cnt')}" for k in COUNT_KEYS),
        times=", ".join(f"t_{k}.n AS {k}_timecount, t_{k}.d AS {k}_timediff" for k in TIME_KEYS),
        joins=" ".join(f"JOIN t_{k} ON c.{k} = t_{k}.{k} AND c.epoch_hour = t_{k}.epoch_hour" for k in TIME_KEYS),
    ),
    *[
        f"""t_{k} AS (SELECT {k}, epoch_hour, count(*) AS n,
coalesce(epoch_hour - lag(epoch_hour) OVER (PARTITION BY {k} ORDER BY epoch_hour), 1000000) AS d FROM coded GROUP BY {k}, epoch_hour)"""
        for k in TIME_KEYS
    ],
)


@query("model_feature_assembly", STAGED_SQL)
def model_feature_assembly(spark, sf):
    log = coded(spark, sf)
    return staged_features(log, [log], time="epoch_hour").select("row_id", *BASE_FEATURES, *COUNT_FEATURES, *TIME_FEATURES)


ENTRY_SQL = sql("""
SELECT row_id, ip, app, hourofday, count(*) OVER (PARTITION BY ip, app, hourofday) AS ip_app_hourofday_cnt FROM clicks""")


@query("flagship_click_counts", ENTRY_SQL)
def flagship_click_counts(spark, sf):
    log = clicks(spark, sf)
    keys = ["ip", "app", "hourofday"]
    return add_count_maps(log, [log], [keys]).select("row_id", *keys, "ip_app_hourofday_cnt")
