"""Best-fit packing of token sequences by bin completion.

1. Each text becomes token ids plus an end id. Texts longer than a sequence are cut into full pieces and a rest.
2. Pieces are counted by length. Lengths are 1..capacity, so this table is bounded by the capacity, whatever
   the corpus holds; the driver plans on it.
3. The plan is a list of patterns (a filling of one sequence and how often it is used). Around the longest
   length left, a branch and bound enumerates undominated fillings, prunes by the waste of the incumbent, and
   starts from the best-fit filling.
4. Pieces get their rank among pieces of the same length (counts per length and salt give the offsets, so
   that one frequent length is ranked by many tasks) and take the place that the plan has for that rank.

Defined cases: null text is empty and gives the end id alone; repeated rows are packed as often as they stand;
an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import batches, partitions, read, small_batches, tidy, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Entries of a worker's word cache; it is emptied when full, so this bounds memory and changes no result.
CACHE_WORDS = 600_000
CLOSING = (b".", b",", b";", b":", b"!", b"?")
#: Branches tried per pattern before the incumbent is taken.
BRANCHES = 2000
#: Tasks that rank the pieces of one length, at least.
SALTS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_level() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_LEVEL = _byte_level()


def is_letters(word: bytes) -> bool:
    """Whether a word is letters alone that the vocabulary's normaliser leaves as they are (lower case, composed)."""
    if word.isalpha():
        return word.islower()
    text = word.decode()
    return text.isalpha() and text.lower() == text and is_normalized("NFC", text)


class WordIds(dict):
    """Ids (little-endian bytes) of white-space delimited words, filled on demand.

    The vocabulary drops white space before it merges, so a text's ids are those of its words, one after the
    other. A word with closing punctuation is split again where its letters alone make a pre-token. Letters that are
    normalised already go to the vocabulary's merges at once, which takes a third of the time; all other new words of
    several texts are encoded in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.encoder = Tokenizer.from_file(path)
        self.merges = self.encoder.model.tokenize

    def letters(self, word: bytes) -> bytes:
        """Ids of a word of lower-case letters only (a pre-token as it stands)."""
        ids = [t.id for t in self.merges(word.decode("latin-1").translate(BYTE_LEVEL))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, new: set[bytes]) -> None:
        """Put words that are not in the cache there."""
        split = {w: (w[:-1], w[-1:]) for w in new if w[-1:] in CLOSING and is_letters(w[:-1])}
        ask = []
        # `difference(self)` would walk through the whole cache, as it is not a plain dict.
        for word in (new - split.keys()).union(*split.values()):
            if word in self:
                continue
            if is_letters(word):
                self[word] = self.letters(word)
            else:
                ask.append(word)
        for word, found in zip(ask, self.encoder.encode_batch_fast([w.decode() for w in ask], add_special_tokens=False)):
            self[word] = struct.pack(f"<{len(found.ids)}I", *found.ids)
        for word, (letters, last) in split.items():
            self[word] = self[letters] + self[last]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        # A to Z may be lowered early, except where a special token could arise from it.
        words = [(raw if b"<|" in raw else raw.lower()).split() for raw in map(str.encode, texts)]
        found = [list(map(self.get, w)) for w in words]
        open_ = [i for i, ids in enumerate(found) if None in ids]
        new = {w for i in open_ for w, ids in zip(words[i], found[i]) if ids is None}
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
        if new:
            self.learn(new)
        for i in open_:
            ids, w = found[i], words[i]
            for k in [k for k, x in enumerate(ids) if x is None]:
                ids[k] = self[w[k]]
        return list(map(b"".join, found))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_CACHES: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (on request) ids (little-endian unsigned 32-bit)."""
    path = path or tokenizer_path()

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = word_ids(path), np.asarray([END_ID], "<u4").tobytes()
        for b in batches(frames, 256):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), cache.encode_all([text or "" for text in b.column(1).to_pylist()])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(cut), PIECES)
    return found if with_ids else found.drop("ids")


def complete(room: int, lengths: list[int], left: dict[int, int]) -> list[int]:
    """Lengths that fill `room` with least waste, longest first.

    `lengths` are the lengths with pieces left, ascending. The incumbent is best fit (the longest that fits,
    again and again). A branch is pruned when its room is no less than the best waste and no length fits, or
    when the longest length that still fits cannot beat the incumbent within the pieces allowed. A filling is
    dominated by a single length of the same sum, so single lengths come first and an exact one ends the search.
    """
    best: list[int] = []
    waste, rest, used = room, room, {}
    top = bisect_right(lengths, rest)
    while top:
        x = lengths[top - 1]
        if left[x] > used.get(x, 0):
            best.append(x)
            used[x] = used.get(x, 0) + 1
            rest -= x
            top = bisect_right(lengths, rest)
        else:
            top -= 1
    waste = rest
    if not waste:
        return best
    tried = 0
    used = {}

    def branch(rest: int, top: int, taken: list[int]) -> bool:
        nonlocal best, waste, tried
        if rest < waste:
            best, waste = list(taken), rest
            if not waste:
                return True
        exact = bisect_right(lengths, rest)
        for i in range(min(top, exact) - 1, -1, -1):
            x = lengths[i]
            tried += 1
            if tried > BRANCHES:
                return True
            if left[x] <= used.get(x, 0):
                continue
            # All that can follow is at most x long and there are finitely many pieces of it.
            if i == 0 and rest - x * (left[x] - used.get(x, 0)) >= waste:
                return False
            used[x] = used.get(x, 0) + 1
            taken.append(x)
            done = branch(rest - x, i + 1, taken)
            taken.pop()
            used[x] -= 1
            if done:
                return True
        return False

    branch(room, len(lengths), [])
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: pieces in the sequence})] that uses all pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError(f"lengths must be 1 to {capacity}")
    lengths, out = sorted(left), []
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        usable = lengths if left[longest] else lengths[:-1]
        filling = [longest, *complete(capacity - longest, usable, left)]
        left[longest] += 1
        pattern: dict[int, int] = {}
        for n in filling:
            pattern[n] = pattern.get(n, 0) + 1
        times = min(left[n] // m for n, m in pattern.items())
        out.append((times, pattern))
        for n, m in pattern.items():
            left[n] -= times * m
            if not left[n]:
                del lengths[bisect_right(lengths, n) - 1]
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset), sorted: where each rank of a length goes."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in patterns:
        offset = 0
        for n, m in pattern.items():
            rows.append((n, rank.get(n, 0), sequence, m, offset))
            rank[n] = rank.get(n, 0) + times * m
            offset += n * m
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (columns as of `pieces`; best a written table, as it is read twice)."""
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    salts = max(SALTS, partitions(spark))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(first, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("own") + F.col("first")).cast("long").alias("rank"))
    shared = spark.sparkContext.broadcast(table)
    names = list(cut.columns)
    at, of_length = len(names), names.index("length")

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t[:, 0] << 44 | t[:, 1] if len(t) else np.zeros(0, np.int64)
        for b in frames:
            n, rank = (b.column(i).to_numpy() for i in (of_length, at))
            row = t[np.searchsorted(key, n << 44 | rank, "right") - 1]
            turn = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(at)), pa.array(row[:, 2] + turn // row[:, 3]), pa.array(row[:, 4] + turn % row[:, 3] * n)],
                [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(tidy(place), schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(written(pieces(read(spark, sf_dir, "documents", "doc_id", "text"), with_ids=False), "pieces"))
