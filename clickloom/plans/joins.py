"""Left joins of per-key tables onto the log, with hot keys salted.

Count maps and encoders are joined back to every row of the log. Spark broadcasts
the map when it is small; otherwise both sides are shuffled by key and a hot key
would send a large share of the log to one task. `KeySample` names the hot keys from
one sample of the log; `attach` spreads their rows over several salts and repeats the
single matching map row once per salt.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.plans.splits import MIN_CHUNK_ROWS, SAMPLES_PER_PIECE, is_null_key, piece_rows

_SALT, _PIECES = "__salt", "__pieces"


class KeySample:
    """A bounded sample of the key columns of a log, good for any key set made of them."""

    def __init__(self, df: DataFrame, cols: Sequence[str], chunk_rows: int | None = None):
        self.schema = df.schema
        self.spark = df.sparkSession
        narrow = df.select(*dict.fromkeys(cols))
        self.rows = narrow.count()
        self.size = piece_rows(self.spark, self.rows, MIN_CHUNK_ROWS, chunk_rows)
        self.fraction, self.found = 1.0, []
        if self.rows > self.size:
            self.fraction = min(1.0, SAMPLES_PER_PIECE * math.ceil(self.rows / self.size) / self.rows)
            self.found = narrow.sample(self.fraction, seed=17).collect()

    def hot(self, keys: Sequence[str]) -> list[tuple]:
        """`(*key, pieces)` for keys with more than one piece of rows; at most rows / size of them."""
        counts = Counter(tuple(r[k] for k in keys) for r in self.found)
        pieces = {key: round(n / self.fraction / self.size) for key, n in counts.items()}
        return [(*key, p) for key, p in pieces.items() if p >= 2]


def attach(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    sample: KeySample | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Left join `table` (one row per key) onto `df`; unseen and null keys get null."""
    keys = list(keys)
    sample = sample or KeySample(df, keys, chunk_rows)
    hot = sample.hot(keys)
    known = [h for h in hot if None not in h]
    null_pieces = sum(h[-1] for h in hot if None in h)
    if not hot:
        return df.join(table, keys, "left").select(*df.columns, *[c for c in table.columns if c not in keys])

    schema = T.StructType([sample.schema[k] for k in keys] + [T.StructField(_PIECES, T.IntegerType())])
    pieces = F.broadcast(sample.spark.createDataFrame(known, schema))
    row_hash = F.xxhash64(*df.columns)
    salt = F.when(F.col(_PIECES).isNotNull(), F.pmod(row_hash, F.col(_PIECES))).otherwise(0)
    if null_pieces:
        salt = F.when(is_null_key(keys), F.pmod(row_hash, F.lit(null_pieces))).otherwise(salt)
    left = df.join(pieces, keys, "left").withColumn(_SALT, salt.cast("int"))
    right = (
        table.join(pieces, keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_PIECES), F.lit(1)) - 1)))
        .drop(_PIECES)
    )
    out = left.join(right, [*keys, _SALT], "left")
    return out.select(*df.columns, *[c for c in table.columns if c not in keys])


def attach_all(
    df: DataFrame,
    tables: Sequence[tuple[Sequence[str], DataFrame]],
    chunk_rows: int | None = None,
) -> DataFrame:
    """Attach several tables using one sample of `df` for all their key sets.

    Key sets that extend one another are joined one after the other, shortest first, so
    that they can share one shuffle of the log (see `clickloom.session`).
    """
    made = [c for keys, table in tables for c in table.columns if c not in keys]
    used = {k for keys, _ in tables for k in keys}
    df = df.drop(*[c for c in made if c in df.columns and c not in used])  # a feature that is made again replaces the old one
    sample = KeySample(df, [k for keys, _ in tables for k in keys], chunk_rows)
    out = df
    for keys, table in sorted(tables, key=lambda t: list(t[0])):
        out = attach(out, table, keys, sample)
    return out.select(*df.columns, *made)
