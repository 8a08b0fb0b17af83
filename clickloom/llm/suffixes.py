"""Byte-exact removal of strings of `WIDTH` bytes that also start in a document with a smaller id.

The unit is a window: a suffix cut after `WIDTH` bytes. Most equal windows are found without sorting them:

1. Every window names an anchor, the first `GRAM`-byte string in it with the least hash; windows in a row with one
   anchor are a stretch. Equal windows have equal anchors, as far from their starts. Stretches are exchanged as hashes
   (anchor, bytes) in packed parts, one entry per part for equal ones. Of equal stretches all but that of the least id
   go as a whole. A stretch's windows fall into bins by their distance to the anchor; those of a bin share most of
   their bytes, of which the entry has a short hash. What is left to sort are the bins whose anchor and shared bytes
   another document has too.
2. The suffixes of these are sorted in runs, equal ones merged, front-coded (the length of the prefix shared with
   the one before, then the rest) and exchanged by hash.
3. Loser trees merge the runs. Each entry keeps the length of the prefix that it shares with the last winner, so
   known prefixes are never compared again. Of equal suffixes all but those of the least id go.

A run or part sends one entry for equal windows, so a passage of very many documents costs as much as there are
runs. Equality of stretches is that of a 64-bit hash within a part and of 80 bits of two between parts; suffixes are
compared byte by byte.

Defined cases: null text is empty; texts shorter than `WIDTH` keep all bytes; rows that repeat an id are one
document with regard to each other (neither is smaller); null ids are never smaller and lose nothing; an
empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import by_bytes, mix, partitions, ragged, read, release, row_hashes, small_batches, span_hashes, tidy, utf8, written
from clickloom.llm.jaccard import thinned

WIDTH, GRAM = 50, 24
#: Bytes of text per part, suffixes per run, text bytes per exchange task aimed at.
PART_BYTES, RUN_SUFFIXES, TASK_BYTES = 1 << 22, 1 << 19, 1 << 23
#: Suffixes that begin with the same bytes of this number go to one task, so that neighbours share long prefixes.
HEAD = 8
#: Bytes of texts whose windows are worked out at once.
BLOCK_BYTES = 1 << 15
#: Bins of a stretch's windows: by the distance from a window's start to its anchor.
SPAN = WIDTH - GRAM + 1
BINS = [(SPAN * k // 3, SPAN * (k + 1) // 3) for k in range(3)]
#: Rows of a packed list of answers, so that no row of an exchange is large.
ANSWERS = 20_000


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each place on (n = 8, 16 or 24); places without n bytes are left out."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    h = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    out = h[: len(data) - n + 1].copy()
    for k in range(8, n, 8):
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += h[k : k + len(out)]
        out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


def window_anchors(data: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each window start, the least gram hash inside the window; h: `gram_hashes`."""
    span = SPAN
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    reach = 1
    while 2 * reach <= span:
        h = np.minimum(h[: len(h) - reach], h[reach:])
        reach *= 2
    return np.minimum(h[:n], h[span - reach : span - reach + n])


def first_least(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Place of the anchor (the first of the least) of the windows at `starts`; h: gram hashes."""
    out = np.empty(len(starts), np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(h, SPAN) if len(starts) else None
    for i in range(0, len(starts), 1 << 12):
        out[i : i + (1 << 12)] = grams[starts[i : i + (1 << 12)]].argmin(1)
    return starts + out


def stretches_at(data: np.ndarray, offsets: np.ndarray, bins: bool = False) -> tuple[np.ndarray, ...]:
    """Of all rows: row, first window, end (exclusive), anchor hash, hash of the bytes and place of the anchor of every
    stretch; with `bins`, also a column of one byte per bin: 0 without windows, else by the bytes that its windows share."""
    found: list[tuple[np.ndarray, ...]] = []
    i = 0
    while i < len(offsets) - 1:
        # Short texts are looked at together; only windows that lie within one text count.
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        a = offsets[i]
        block = data[a : offsets[j]]
        h = gram_hashes(block, GRAM)
        w = window_anchors(block, h)
        begin = offsets[i:j] - a
        stop = np.maximum(offsets[i + 1 : j + 1] - a - WIDTH + 1, begin)
        if (stop > begin).any():

            def runs(*cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Row, first window and end of the runs that begin at the cuts and at each row."""
                edge = np.zeros(len(block) + 1, bool)
                for at in (begin, *cuts):
                    edge[at] = True
                first = np.flatnonzero(edge)
                of = np.searchsorted(begin, first, "right") - 1
                end = np.minimum(np.append(first[1:], stop[-1]), stop[of])
                some = end > first
                return of[some], first[some], end[some]

            cuts = np.flatnonzero(w[1:] != w[:-1]) + 1
            of, first, end = runs(cuts)
            place = first_least(h, first)
            late = end > place + 1
            if late.any():  # the anchor comes again: windows behind its first place are stretches of their own
                more = ragged(first[late], (end - first)[late])
                spot = first_least(h, more)
                of, first, end = runs(cuts, more[1:][spot[1:] != spot[:-1]])
                place = first_least(h, first)
            spans = [(first, end + WIDTH - 1)]
            for low, high in BINS if bins else ():
                some = np.minimum(place - low, end - 1) >= np.maximum(place - high + 1, first)
                spans.append((np.where(some, place - low, 0), np.where(some, place - high + 1 + WIDTH, 0)))
            own, *short = span_hashes(block, *map(np.concatenate, zip(*spans))).reshape(len(spans), -1)
            short = [np.where(z > x, v % np.uint64(255) + np.uint64(1), 0).astype(np.uint8) for v, (x, z) in zip(short, spans[1:])]
            found.append((of + i, first + a, end + a, mix(w[first]), own, place + a, *short))
        i = j
    if not found:
        return *(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)), np.zeros(0, np.int64), *(np.zeros(0, np.uint8) for _ in BINS if bins)
    return tuple(map(np.concatenate, zip(*found)))


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: row, first window, end (exclusive), anchor hash and hash of the bytes of every stretch."""
    return stretches_at(data, offsets)[:5]


#: Of the hashes of an anchor and of its stretch, parts and answers have these bits.
UPPER, LOWER_48 = np.uint64(32), np.uint64((1 << 48) - 1)


def named(anchor: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What stands for a stretch in answers: 48 bits of the hash of its bytes, 16 of that of its anchor."""
    return own & LOWER_48 | anchor & ~LOWER_48


def bin_name(name: np.ndarray, k: int) -> np.ndarray:
    """What stands for a bin of a stretch in answers."""
    return name ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))


def pack_ids(ids: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes, least id, bytes of one): differences to the least id, as narrow as they go."""
    low = int(ids.min()) if len(ids) else 0
    far = int(ids.max()) - low if len(ids) else 0
    width = next((w for w in (1, 2, 4) if far < 1 << 8 * w), 8)
    return (ids.astype("<i8") if width == 8 else (ids - low).astype(f"<u{width}")).tobytes(), low, width


def unpack_ids(raw: bytes, low: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8") if width == 8 else np.frombuffer(raw, f"<u{width}").astype(np.int64) + low


def pack_rising(ids: np.ndarray) -> tuple[bytes, int, int]:
    """As `pack_ids`, of ids in ascending order: the first and the steps, or else all."""
    steps = np.diff(ids, prepend=ids[:1])
    far = int(ids[-1]) - int(ids[0])
    width = 8 if far >= 1 << 62 else next((w for w in (1, 2, 4) if int(steps.max()) < 1 << 8 * w), 8)
    return (ids.astype("<i8") if width == 8 else steps.astype(f"<u{width}")).tobytes(), int(ids[0]), width


def unpack_rising(raw: bytes, low: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8") if width == 8 else np.cumsum(np.frombuffer(raw, f"<u{width}"), dtype=np.int64) + low


#: Kinds of answers: a stretch that goes, a bin of a stretch whose suffixes must be sorted, a suffix that goes.
GONE, OPEN, SUFFIX = 0, 1, 2
ANSWER = "doc_id long, kind int, h long"


def answer(ids: np.ndarray, kind: int, h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(h.view(np.int64))], ["doc_id", "kind", "h"])


def _one(values: tuple, kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def settle_stretches(docs: DataFrame, tasks: int) -> DataFrame:
    """Answers GONE and OPEN for stretches and their bins; h is their name."""
    fields = "task int, final boolean, a binary, c binary, bins binary, ids binary, low long, width int"
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32())

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            a, c, ids, *bins = (np.concatenate(x) for x in zip(*held))
            held.clear()
            if not len(a):
                return
            order = np.argsort(c)
            new = np.concatenate([[True], c[order[1:]] != c[order[:-1]]])
            starts = np.flatnonzero(new)
            least = np.minimum.reduceat(ids[order], starts)
            gone = order[ids[order] > least[np.cumsum(new) - 1]]  # a smaller document of this part has the same stretch
            gone = gone[np.argsort(ids[gone])]
            for k in range(0, len(gone), ANSWERS):
                h = named(a[gone[k : k + ANSWERS]], c[gone[k : k + ANSWERS]])
                yield _one((int(mix(h[:1])[0] % np.uint64(tasks)), True, b"", h.tobytes(), b"", *pack_rising(ids[gone[k : k + ANSWERS]])), kinds, names)
            one = order[starts]  # equal bytes: the same anchor and bins
            a, c, ids, bins = a[one], c[one], least, [x[one] for x in bins]
            task = (a & np.uint64(0xFFFFFFFF)) % np.uint64(tasks)
            by = np.lexsort((ids, task))
            cuts = np.searchsorted(task[by], np.arange(tasks + 1, dtype=np.uint64))
            a, c, bins = (a >> UPPER).astype("<u4"), c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], np.stack(bins)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = by[cuts[k] : cuts[k + 1]]
                yield _one((k, False, a[at].tobytes(), c[at].tobytes(), bins[:, at].tobytes(), *pack_rising(ids[at])), kinds, names)

        for b in by_bytes(frames, 1):
            data, offsets = utf8(b.column(1))
            row, _, _, anchor, own, _, *bins = stretches_at(data, offsets, True)
            held.append((anchor, own, b.column(0).to_numpy()[row], *bins))
            size += len(data)
            if size >= PART_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def gather(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in frames:
            for _, final, a, c, bins, ids, low, width in zip(*(x.to_pylist() for x in b.columns)):
                ids = unpack_rising(ids, low, width)
                if final:
                    yield answer(ids, GONE, np.frombuffer(c, np.uint64))
                else:
                    held.append((np.frombuffer(a, "<u4"), np.frombuffer(c, np.uint8).reshape(-1, 6), ids, np.frombuffer(bins, np.uint8).reshape(len(BINS), -1)))
        if not held:
            return
        a, c, ids = (np.concatenate([h[i] for h in held]) for i in range(3))
        bins = np.concatenate([h[3] for h in held], 1)
        held.clear()
        wide = np.zeros((len(c), 8), np.uint8)
        wide[:, :6] = c
        a, c = a.astype(np.uint64) << UPPER, wide.view("<u8").ravel()
        key = a | c & np.uint64(0xFFFFFFFF)
        order = np.argsort(key)
        key, c = key[order], c[order]
        if ((key[1:] == key[:-1]) & (c[1:] != c[:-1])).any():
            order = np.lexsort((wide.view("<u8").ravel(), a))
            key, c = a[order], wide.view("<u8").ravel()[order]
        a, ids = a[order], ids[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])])
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(ids, starts)
        for kind, h, of in left_open(named(a, c), ids, np.cumsum(new) - 1, least, a[starts], bins[:, order[starts]], starts):
            for i in range(0, len(h), 100_000):
                yield answer(of[i : i + 100_000], kind, h[i : i + 100_000])

    packed = docs.mapInArrow(tidy(emit), fields)
    return packed.repartition(tasks, "task").mapInArrow(tidy(gather), ANSWER)


def left_open(names: np.ndarray, ids: np.ndarray, group: np.ndarray, least: np.ndarray, anchors: np.ndarray, bins: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, names, ids) of the answers on entries that are sorted by anchor; `group` numbers equal stretches, of which
    the least id, the anchor and the bins are given, and `starts` their first entries."""
    gone = np.flatnonzero(ids > least[group])
    yield GONE, names[gone], ids[gone]
    for k, code in enumerate(bins):
        some = np.flatnonzero(code)
        key = anchors[some] | code[some]
        order = np.argsort(key)
        some, key = some[order], key[order]
        if not len(some):
            continue
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        several = np.minimum.reduceat(least[some], at) != np.maximum.reduceat(least[some], at)
        some = some[several[np.cumsum(new) - 1]]
        yield OPEN, bin_name(names[starts[some]], k), least[some]


# --- sorted runs -----------------------------------------------------------------------------------------------


def front_code(sorted_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the prefix shared with the row before, all rests) of sorted rows of WIDTH bytes."""
    shared = np.zeros(len(sorted_rows), np.uint8)
    for i in range(1, len(sorted_rows), 1 << 16):
        z = min(i + (1 << 16), len(sorted_rows))
        same = sorted_rows[i:z] == sorted_rows[i - 1 : z - 1]
        shared[i:z] = np.where(same.all(1), WIDTH, same.argmin(1))
    rest = np.arange(WIDTH)[None] >= shared[:, None]
    return shared, sorted_rows[rest]


class LoserTree:
    """Merges front-coded runs. Every waiting entry knows the prefix length it shares with the last winner."""

    def __init__(self, runs: list[tuple[bytes, bytes]]):
        self.runs = runs
        self.size = 1
        while self.size < max(len(runs), 1):
            self.size *= 2
        self.at = [0] * self.size
        self.place = [0] * self.size
        self.now: list[bytes | None] = [None] * self.size
        self.shared = [0] * self.size
        for r in range(len(runs)):
            self._next(r)
        self.loser = [0] * self.size
        self.top = self._build(1)

    def _next(self, r: int) -> None:
        lengths, rests = self.runs[r]
        k = self.at[r]
        if k == len(lengths):
            self.now[r] = None
            return
        h, p = lengths[k], self.place[r]
        q = p + WIDTH - h
        self.now[r] = (self.now[r][:h] if h else b"") + rests[p:q]
        self.shared[r] = h  # with the entry before, which was the last winner
        self.place[r], self.at[r] = q, k + 1

    def _less(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        h, g = self.shared[a], self.shared[b]
        if h != g:  # the one closer to the last winner is smaller, and they part where the other left it
            return (a, b) if h > g else (b, a)
        while h + 8 <= WIDTH and x[h : h + 8] == y[h : h + 8]:
            h += 8
        while h < WIDTH and x[h] == y[h]:
            h += 1
        if h == WIDTH or x[h] < y[h]:
            self.shared[b] = h
            return a, b
        self.shared[a] = h
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.loser[node] = self._less(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def merge(self) -> Iterator[tuple[int, bytes, int]]:
        """(run, suffix, length of the prefix shared with the suffix before) in ascending order."""
        now, shared, loser, size, less = self.now, self.shared, self.loser, self.size, self._less
        while now[self.top] is not None:
            r = self.top
            yield r, now[r], shared[r]
            self._next(r)
            node = (r + size) // 2
            while node:
                other = loser[node]
                if now[r] is not None and now[other] is not None and shared[r] != shared[other]:
                    if shared[r] < shared[other]:
                        r, loser[node] = other, r
                else:
                    r, loser[node] = less(r, other)
                node //= 2
            self.top = r


def merge_runs(runs: list[tuple[bytes, bytes, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of WIDTH bytes, ids) of the suffixes that also occur with a smaller id in another run."""
    if len(runs) < 2:
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64)
    used, out, ids = [0] * len(runs), [], []
    group: list[int] = []
    before = b""

    def close() -> None:
        least = min(group)
        for i in group:
            if i > least:
                out.append(before)
                ids.append(i)

    lists = [x[2].tolist() for x in runs]
    for r, suffix, shared in LoserTree([x[:2] for x in runs]).merge():
        i = lists[r][used[r]]
        used[r] += 1
        if shared == WIDTH:
            group.append(i)
            continue
        if len(group) > 1:
            close()
        group, before = [i], suffix
    if len(group) > 1:
        close()
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, WIDTH), np.array(ids, np.int64)


def settle_suffixes(docs: DataFrame, tasks: int) -> DataFrame:
    """Answers SUFFIX for docs (doc_id, text, open: names of their open bins); h is the hash of a window."""
    fields = "task int, final boolean, shared binary, rests binary, ids binary, low long, width int"
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32())

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, ids = (np.concatenate([h[i] for h in held]) for i in range(2))
            text = np.ascontiguousarray(rows).view(f"S{WIDTH}").ravel()
            order = np.lexsort((ids, text))
            rows, ids, text = rows[order], ids[order], text[order]
            new = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
            least = ids[new][np.cumsum(new) - 1] if len(ids) else ids
            gone = np.flatnonzero(ids > least)
            for at in np.array_split(gone, max(1, len(gone) // ANSWERS)):
                if len(at):
                    h = row_hashes(rows[at])
                    yield _one((int(h[0] % np.uint64(tasks)), True, b"", h.tobytes(), *pack_ids(ids[at])), kinds, names)
            rows, ids = rows[new], ids[new]
            head = np.ascontiguousarray(rows[:, :HEAD]).view("<u8").ravel()
            task = (mix(head) >> np.uint64(20)) % np.uint64(tasks)
            by = np.argsort(task, kind="stable")  # stays sorted within a task
            for at in np.split(by, np.flatnonzero(np.diff(task[by])) + 1):
                if len(at):
                    shared, rests = front_code(rows[at])
                    yield _one((int(task[at[0]]), False, shared.tobytes(), rests.tobytes(), *pack_ids(ids[at])), kinds, names)

        for b in by_bytes(frames, 1, 1 << 20):
            data, offsets = utf8(b.column(1))
            row, first, end, anchor, own, place = stretches_at(data, offsets)
            name = named(anchor, own)
            for k, (low, high) in enumerate(BINS):
                wanted = open_of(b, row, bin_name(name, k), 2)
                begin = np.maximum(first, place - high + 1)[wanted]
                n = np.maximum(np.minimum(end, place - low + 1)[wanted] - begin, 0)
                at = ragged(begin, n)
                if len(at):
                    held.append((np.lib.stride_tricks.sliding_window_view(data, WIDTH)[at], np.repeat(b.column(0).to_numpy()[row[wanted]], n)))
                    size += len(at)
            if size >= RUN_SUFFIXES:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def gather(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for b in frames:
            for _, final, shared, rests, ids, low, width in zip(*(x.to_pylist() for x in b.columns)):
                ids = unpack_ids(ids, low, width)
                if final:
                    yield answer(ids, SUFFIX, np.frombuffer(rests, np.uint64))
                else:
                    runs.append((shared, rests, ids))
        rows, ids = merge_runs(runs)
        if len(ids):
            yield answer(ids, SUFFIX, row_hashes(rows))

    return docs.mapInArrow(tidy(emit), fields).repartition(tasks, "task").mapInArrow(tidy(gather), ANSWER)


def open_of(b: pa.RecordBatch, row: np.ndarray, h: np.ndarray, column: int) -> np.ndarray:
    """Which (row, h) are in the list column of their row."""
    lists = b.column(column)
    count = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    count = np.where(lists.is_valid().to_numpy(zero_copy_only=False), count, 0)
    values = lists.flatten().to_numpy().view(np.uint64) if len(lists) else np.zeros(0, np.uint64)
    out = np.zeros(len(row), bool)
    if not len(values):
        return out
    # Most are told apart by a few bits, and only the others are searched.
    spot = np.zeros(1 << 18, bool)
    spot[values & np.uint64(len(spot) - 1)] = True
    some = np.flatnonzero(spot[h & np.uint64(len(spot) - 1)])
    key = lambda r, v: mix(v + mix(r.astype(np.uint64) + np.uint64(77)))
    table = np.sort(key(np.repeat(np.arange(len(count)), count), values))
    mine = key(row[some], h[some])
    out[some] = table[np.minimum(np.searchsorted(table, mine), len(table) - 1)] == mine
    return out


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, gone, suffixes): per document, hashes of stretches and of single windows to remove."""
    spark = docs.sparkSession
    known = docs.where("doc_id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(partitions(spark), -(-size // TASK_BYTES))
    first = written(settle_stretches(known, tasks), "suffix-stretches")
    release(spark)
    wanted = first.where(F.col("kind") == OPEN).groupBy("doc_id").agg(F.collect_set("h").alias("open"))
    wanted = written(wanted, "suffix-open")
    with_open = thinned(known, wanted.select(F.col("doc_id").alias("id"))).join(wanted, "doc_id")
    second = written(settle_suffixes(with_open.select("doc_id", "text", "open"), tasks), "suffix-windows")
    release(spark)
    both = first.where(F.col("kind") == GONE).unionByName(second)
    pick = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("h")))
    return written(both.groupBy("doc_id").agg(pick(GONE).alias("gone"), pick(SUFFIX).alias("suffixes")), "suffix-removals")


def cover(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and the mask of removed bytes of rows (doc_id, text, gone, suffixes); rows without hashes lose none."""
    data, offsets = utf8(b.column(1))
    out = np.zeros(len(data), bool)
    some = np.flatnonzero(sum(np.diff(b.column(i).offsets.to_numpy()) for i in (2, 3))) if b.num_rows else np.zeros(0, np.int64)
    if len(some):
        _, parts, mask = _cover(b.select([0, 1, 2, 3]).take(pa.array(some)))
        for i, x, y in zip(some, parts[:-1], parts[1:]):
            out[offsets[i] : offsets[i + 1]] = mask[x:y]
    return data, offsets, out


def _cover(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8(b.column(1))
    row, first, end, anchor, own = stretches(data, offsets)
    mark = np.zeros(len(data) + 1, np.int64)
    gone = open_of(b, row, named(anchor, own), 2)
    np.add.at(mark, first[gone], 1)
    np.add.at(mark, end[gone] + WIDTH - 1, -1)
    # Single windows are looked up among the stretches that stay.
    n = (end - first)[~gone]
    at = ragged(first[~gone], n)
    some = np.diff(b.column(3).offsets.to_numpy()) > 0 if b.num_rows else np.zeros(0, bool)
    of = np.repeat(row[~gone], n)
    keep = some[of] if len(of) else np.zeros(0, bool)
    at, of = at[keep], of[keep]
    hit = at[open_of(b, of, span_hashes(data, at, at + WIDTH), 3)]
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + WIDTH, -1)
    return data, offsets, np.cumsum(mark[:-1]) > 0


def removed_masks(docs: DataFrame, run, schema: str) -> DataFrame:
    """run(batch, data, offsets, mask) for all documents; a batch has doc_id, text, two columns of hashes, then the others."""
    found = removals(docs.select("doc_id", "text"))
    empty = F.array().cast("array<bigint>")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    joined = docs.join(found, "doc_id", "left").select(
        "doc_id", "text", F.coalesce(found["gone"], empty).alias("gone"), F.coalesce(found["suffixes"], empty).alias("suffixes"), *[docs[c] for c in others])

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(frames, 1, 1 << 20):
            yield run(b, *cover(b))

    return joined.mapInArrow(tidy(each), schema)


def digest(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(b, data, offsets, mask):
        rows = []
        for i, (a, z) in enumerate(zip(offsets[:-1], offsets[1:])):
            m = mask[a:z]
            spans = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum())
            rows.append((z - a, int(m.sum()), spans, hashlib.sha256(data[a:z][~m].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [x.split()[0] for x in schema.split(", ")])

    return removed_masks(docs, run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the rest of every text; bytes of a cut character are dropped, so that the text stays valid."""
    names = ["doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    kinds = dict(docs.dtypes)

    def run(b, data, offsets, mask):
        texts = [data[a:z][~mask[a:z]].tobytes().decode(errors="ignore") for a, z in zip(offsets[:-1], offsets[1:])]
        texts = pa.array(texts, pa.string(), mask=b.column(1).is_null().to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([b.column(0), texts, *b.columns[4:]], names)

    out = removed_masks(docs, run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    return out.select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digest(read(spark, sf_dir, "documents", "doc_id", "text"))
