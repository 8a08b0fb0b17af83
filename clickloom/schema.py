"""Click schema, feature names and the key sets the feature jobs are run with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import types as T

ROW_ID = "row_id"
LABEL = "is_attributed"
TIME = "epoch_time"
SPLIT = "split"

# Rows are ordered by time, and by row id where times are equal.
TIME_ORDER = (TIME, ROW_ID)

# Fixed value: zero point of `epoch_time` for the contest log.
CONTEST_ORIGIN = dt.datetime(2017, 11, 6, 14, 0, 0)

RAW_FIELDS = [
    T.StructField("ip", T.LongType()),
    T.StructField("app", T.IntegerType()),
    T.StructField("device", T.IntegerType()),
    T.StructField("os", T.IntegerType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("click_time", T.TimestampNTZType()),
]
CLICK_SCHEMA = T.StructType([*RAW_FIELDS, T.StructField(LABEL, T.IntegerType())])
TEST_SCHEMA = T.StructType([T.StructField("click_id", T.LongType()), *RAW_FIELDS])

# The key sets of the feature jobs.
DICTIONARY_KEYS = [
    ["ip", "device", "os"],
    ["ip", "device", "os", "app"],
    ["ip", "device", "os", "app", "channel"],
]
COUNT_KEYS = [
    ["ip"],
    ["ip", "app"],
    ["app"],
    ["app", "channel"],
    ["device", "os"],
    ["ip", "app", "hourofday"],
    ["device", "os", "app"],
    ["device", "os", "channel"],
    ["ip_device_os"],
    ["ip_device_os", "hourofday"],
    ["ip_device_os_app"],
    ["ip_device_os_app_channel"],
]
LABEL_COUNT_KEYS = ["app", "channel", "ip", "os", "ip_device_os", "ip_device_os_app", "ip_device_os_app_channel"]
TIME_KEYS = ["ip", "ip_device_os", "ip_device_os_app", "ip_device_os_app_channel"]
DISTINCT_PAIRS = [
    (["ip"], "app"),
    (["ip"], "channel"),
    (["app"], "ip"),
    (["app"], "os"),
    (["ip"], "ip_device_os"),
    (["channel"], "app"),
    (["ip_device_os", "dayofweek"], "hourofday"),
    (["ip", "os"], "app"),
    (["ip_device_os"], "dayofweek"),
]
MEAN_KEYS = ["app", "channel", "os", "device", "ip", "ip_device_os", "ip_device_os_app", "ip_device_os_app_channel"]
PULSE_KEYS = {
    "ip_dayhourmin_count": ["ip", "dayofweek", "hourofday", "epoch_minute"],
    "ip_device_os_count": ["ip", "device", "os"],
    "ip_dayhour_count": ["ip", "dayofweek", "hourofday"],
    "device_os_count": ["device", "os"],
    "ip_app_channel_count": ["ip", "app", "channel"],
    "ip_device_os_dayhour_count": ["ip_device_os", "dayofweek", "hourofday"],
}
VALID_HOURS = [4, 5, 9, 10, 13, 14]
VALID_HOURS_SHORT = [4, 9, 14]


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def feature_name(cols: str | Sequence[str], kind: str, target: str | None = None) -> str:
    """`(['ip','app'], 'cnt')` -> `ip_app_cnt`; `('ip', 'unq', 'app')` -> `ip_unq_app`."""
    return "_".join([*as_list(cols), kind, *([target] if target else [])])
