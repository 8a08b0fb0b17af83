"""Repair of conversation structure: the cheapest edits that make turns alternate, and of these the least audit.

Edits of a row: K(eep) 0, R(erole to user or assistant) 1, D(elete) 2, I(nsert an empty user or assistant turn,
anywhere) 5; a truncated row that is not deleted adds 5; blank and duplicate rows have to be deleted. The repaired
roles' initials are `(s?(ua)+)?`. The audit is the edits' initials in order.

1. A row becomes one byte: the class of its role's initial and its first fault. Rows of a conversation come
   sorted to one task, which keeps one byte per row and no text.
2. Cost DP, backwards: the least cost from each (row, state) node on, for all conversations of a batch at once.
3. Arcs that keep to the least cost, between nodes that the start reaches by such arcs, are ranked by prefix
   doubling: first by their letter, then by the pair of their rank and that of the arc 2^k letters on, so that after k
   rounds arcs are ordered by 2^k letters of audit. Each node's arc is the one of least rank (arcs of a node differ in
   their letter, so a node's next arc is known from the first round). The path is read off in doubling lengths
   through the same doubled pointers.
4. Texts are sorted once by conversation behind its audit, and edited as they stream by.

A conversation is a unit, as its audit and digest are one value; it is streamed, never gathered as texts.

Defined cases: null role or text is one space (so a blank text, or a role that is neither kept nor left out of
`illegal`); an empty role has no initial and cannot be kept; null turns sort first; rows of one turn are ordered
by role, the first 16 characters of the text, and its digest; a null conv_id is a conversation of its own; an empty
table gives no rows; extra columns are ignored. Numbers beyond a long are held at its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import read, written

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LETTERS = b"DIKR"  # ascending, so that the number of a letter is its rank
DELETE, INSERT, KEEP, REROLE = range(4)
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
CUT_OFF = 5  # what a truncated row adds unless it is deleted
#: States between rows, by the last initial that is out.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant turn (row), from each state (column); -1: not legal.
AFTER = {USER: np.array([USER, USER, -1, USER]), ASSISTANT: np.array([-1, -1, ASSISTANT, -1])}
#: A row's byte: class of the initial (other, s, u, a) + 4 * fault; 16 names a conversation without a row.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
NO_ROW = 16
#: Rows of ended conversations that are solved together.
ROWS = 1 << 15
FAR = 1 << 40


# --- rows as codes ----------------------------------------------------------------------------------------------


def rows_of(turns: DataFrame) -> DataFrame:
    """Turns with what orders them and their code, but for duplicates. Rows with present = false are codes of no row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), "present")
    body = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(NONE)
    return rows.select(
        "*", F.substring("text", 1, 16).alias("head"),
        F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest"),
        kind.alias("kind"), fault.alias("fault"),
    )


def in_order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("digest")]


def codes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, code) by conversation, in order: a partition holds whole conversations."""
    light = rows_of(turns).drop("text").repartition("conv_id")
    # The same role and text seen earlier; of rows of one turn the first stays.
    earlier = F.row_number().over(Window.partitionBy("conv_id", "present", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    light = light.withColumn("again", earlier)
    fault = F.when(F.col("again") & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    code = F.when(F.col("present"), F.col("kind") + 4 * fault).otherwise(NO_ROW)
    return light.sortWithinPartitions("conv_id", *in_order(), "again").select("conv_id", "turn", code.cast("byte").alias("code"))


# --- cost, ranks and path ---------------------------------------------------------------------------------------


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs of the four states, when turns may be inserted first."""
    cost[:, USER] = np.minimum(cost[:, USER], COST[INSERT] + cost[:, ASSISTANT])
    for state in (START, SYSTEM, ASSISTANT):
        cost[:, state] = np.minimum(cost[:, state], COST[INSERT] + cost[:, USER])
    return cost


def _moves(code: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(letter, state, cost, next state) of the edits of rows, by rows; a cost of FAR: not allowed."""
    kind, fault = code % 4, code // 4
    gone = (fault == BLANK) | (fault == DUPLICATE)
    extra = np.where(gone, FAR, np.where(fault == TRUNCATED, CUT_OFF, 0))
    for state in range(4):
        yield DELETE, state, np.full(len(code), COST[DELETE]), np.full(len(code), state)
        role = ASSISTANT if state == USER else USER
        yield REROLE, state, extra + COST[REROLE], np.full(len(code), role)
        kept = (kind == role) | ((kind == SYSTEM) & (state == START))
        yield KEEP, state, np.where(kept, extra + COST[KEEP], FAR), np.where(kind == SYSTEM, SYSTEM, role)


def least_costs(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least cost from every (place, state) on. Places are row numbers plus one end per conversation."""
    sizes = np.diff(offsets)
    first = offsets[:-1] + np.arange(len(sizes))  # place of a conversation's first row
    cost = np.full((len(code) + len(sizes), 4), FAR, np.int64)
    cost[first + sizes] = _with_inserts(np.tile(np.array([0, FAR, FAR, 0]), (len(sizes), 1)))
    order = np.argsort(-sizes, kind="stable")
    for back in range(1, int(sizes.max(initial=0)) + 1):
        now = order[: np.searchsorted(-sizes[order], -back, "right")]
        at = first[now] + sizes[now] - back
        ahead, here = cost[at + 1], np.full((len(now), 4), FAR, np.int64)
        for _, state, price, to in _moves(code[offsets[now] + sizes[now] - back]):
            here[:, state] = np.minimum(here[:, state], price + ahead[np.arange(len(now)), to])
        cost[at] = _with_inserts(here)
    return np.minimum(cost, FAR)


def optimal_arcs(code: np.ndarray, offsets: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, letter, next node) of the arcs on cheapest paths; node = 4 * place + state."""
    sizes = np.diff(offsets)
    conv = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) + conv
    found = []
    for letter, state, price, to in _moves(code):
        ok = np.flatnonzero((cost[place, state] < FAR) & (price + cost[place + 1, to] == cost[place, state]))
        found.append((4 * place[ok] + state, np.full(len(ok), letter), 4 * (place[ok] + 1) + to[ok]))
    everywhere = np.arange(len(cost))
    for state in range(4):
        to = ASSISTANT if state == USER else USER
        ok = np.flatnonzero((cost[:, state] < FAR) & (COST[INSERT] + cost[:, to] == cost[:, state]))
        found.append((4 * everywhere[ok] + state, np.full(len(ok), INSERT), 4 * everywhere[ok] + to))
    src, letter, dst = (np.concatenate(c) for c in zip(*found))
    return src, letter, dst


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples: equal tuples share one, from 0."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        step[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def least_paths(src: np.ndarray, letter: np.ndarray, dst: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the least path from each start node, one after the other, and the n + 1 offsets.

    Arcs of a node have different letters. A path ends at a node without arcs.
    """
    n = len(src)
    rank = np.append(1 + dense(letter), 0) if n else np.zeros(1, np.int64)  # the last entry stands for the end

    def pick(rank: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The arc of least rank that leaves each node; n when none does."""
        order = np.lexsort((rank[:n], src))
        at = np.searchsorted(src[order], nodes)
        there = at < n
        there[there] &= src[order][at[there]] == nodes[there]
        return np.where(there, order[np.minimum(at, max(n - 1, 0))] if n else 0, n)

    ahead = [np.append(pick(rank, dst), n)]  # arc after 2^k letters
    while (ahead[-1][:n] < n).any():
        rank = np.append(1 + dense(rank[:n], rank[ahead[-1][:n]]), 0)
        ahead.append(ahead[-1][ahead[-1]])
    path = pick(rank, starts)[:, None]
    for jump in ahead:
        if (jump[path[:, 0]] == n).all():
            break
        path = np.concatenate([path, jump[path]], axis=1)
    out = path < n
    return np.append(letter, 0)[path[out]], np.concatenate([[0], np.cumsum(out.sum(1))])


def audits(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Least cost and least audit of each conversation."""
    sizes = np.diff(offsets)
    starts = 4 * (offsets[:-1] + np.arange(len(sizes))) + START
    cost = least_costs(code, offsets)
    src, letter, dst = optimal_arcs(code, offsets, cost)
    # Only arcs that a start reaches: row by row, and twice at a place, as an insertion stays there.
    reached = np.zeros(4 * len(cost), bool)
    reached[starts] = True
    order = np.argsort(src, kind="stable")
    src, letter, dst = src[order], letter[order], dst[order]
    first = np.searchsorted(src, np.arange(4 * len(cost) + 1))
    front = starts
    while len(front):
        n = first[front + 1] - first[front]
        arcs = np.repeat(first[front], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        front = np.unique(dst[arcs])
        front = front[~reached[front]]
        reached[front] = True
    used = reached[src]
    at = 0
    # Conversations of like length share a table of paths.
    found = [""] * len(sizes)
    by_size = np.argsort(sizes, kind="stable")
    while at < len(sizes):
        end = at + 1
        while end < len(sizes) and sizes[by_size[end]] <= 2 * sizes[by_size[at]] + 8:
            end += 1
        group = by_size[at:end]
        mine = np.zeros(len(sizes), bool)
        mine[group] = True
        conv = np.repeat(np.arange(len(sizes)), sizes + 1)
        here = used & mine[conv[src // 4]]
        letters, cut = least_paths(src[here], letter[here], dst[here], starts[group])
        text = np.frombuffer(LETTERS, np.uint8)[letters].tobytes().decode()
        for i, g in enumerate(group):
            found[g] = text[cut[i] : cut[i + 1]]
        at = end
    return cost[starts // 4, START], found


# --- streams over sorted rows -----------------------------------------------------------------------------------


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = np.zeros((4, 4), bool)
LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


class Conversations:
    """Conversations that come piece by piece, one byte and one turn number per row."""

    def __init__(self):
        self.ids, self.codes, self.gaps, self.rows = [], [], [], 0
        self.open = False

    def add(self, conv: int | None, code: np.ndarray, turn: np.ndarray) -> None:
        """Rows of a conversation; `turn` without nulls, ascending."""
        if not (self.open and self.ids[-1] == conv):
            self.ids.append(conv)
            self.codes.append([])
            self.gaps.append([None, None, 0])
            self.open = True
        self.codes[-1].append(code[code < NO_ROW])
        self.rows += len(code)
        if len(turn):
            gap = self.gaps[-1]
            gap[2] += int((turn[1:] != turn[:-1]).sum()) + int(gap[1] is None or gap[1] != int(turn[0]))
            gap[0] = int(turn[0]) if gap[0] is None else gap[0]
            gap[1] = int(turn[-1])

    def solved(self) -> pa.RecordBatch:
        per = [np.concatenate(c) for c in self.codes]
        sizes = np.array([len(c) for c in per], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        code = np.concatenate(per).astype(np.int64)
        conv = np.repeat(np.arange(len(per)), sizes)
        cost, audit = audits(code, offsets)
        bad = ~LEGAL[code[:-1] % 4, code[1:] % 4] & (conv[1:] == conv[:-1])
        count = lambda mask, of: pa.array(np.bincount(of[mask], minlength=len(per)))
        gaps = [0 if g[0] is None else min(g[1] - g[0] + 1 - g[2], (1 << 63) - 1) for g in self.gaps]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids, pa.int64()), pa.array(gaps, pa.int64()), *(count(code // 4 == f, conv) for f in (BLANK, DUPLICATE, TRUNCATED)),
             count(bad, conv[1:]), pa.array(cost), pa.array(audit)],
            ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def pieces(ids: pa.Array) -> Iterator[tuple[int | None, int, int]]:
    """(id, start, end) of runs of equal ids; null is an id of its own."""
    if len(ids) == 0:
        return
    null, value = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
    cut = np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1
    for a, b in zip([0, *cut], [*cut, len(value)]):
        yield None if null[a] else int(value[a]), a, b


def audit(turns: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit.

    `turns` has conv_id, turn, role, text, and present: false where a row only names its conversation.
    """

    def run(frames):
        held = Conversations()
        for b in frames:
            code, turn = b.column(2).to_numpy(), b.column(1)
            known, value = np.asarray(turn.is_valid()), turn.fill_null(0).to_numpy()
            for conv, a, z in pieces(b.column(0)):
                if held.rows >= ROWS and not (held.open and held.ids[-1] == conv):
                    yield held.solved()
                    held = Conversations()
                there = known[a:z] & (code[a:z] < NO_ROW)
                held.add(conv, code[a:z], value[a:z][there])
        if held.ids:
            yield held.solved()

    return codes(turns).mapInArrow(run, AUDIT)


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired conversations, and a row with place -1 for each conversation.

    A task holds whole conversations, and their rows follow each other in order.
    """
    rows = rows_of(turns).where("present").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "head", "digest", "text")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("head"),
                         F.unhex(F.lit("")).alias("digest"), F.col("audit").alias("text"))
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *in_order()).select("conv_id", "kind", "role", "text")

    def run(frames):
        edits, at, place, system, names = "", 0, 0, 0, ("user", "assistant")
        for b in frames:
            out = [[] for _ in range(5)]

            def put(conv, letter, role, text):
                nonlocal place
                for o, v in zip(out, (conv, place, letter, role, text)):
                    o.append(v)
                place += 1

            def insert(conv):
                nonlocal at
                while at < len(edits) and edits[at] == "I":
                    put(conv, "I", names[(place - system) % 2], "")
                    at += 1

            ids, kinds, roles, texts = (b.column(i).to_pylist() for i in range(4))
            for conv, kind, role, text in zip(ids, kinds, roles, texts):
                if kind == 0:
                    # An odd number of turns begins with a system turn.
                    edits, at, place, system = text, 0, -1, (len(text) - text.count("D")) % 2
                    put(conv, None, None, None)
                    insert(conv)
                    continue
                letter = edits[at]
                at += 1
                if letter != "D":
                    put(conv, letter, role if letter == "K" else names[(place - system) % 2], text)
                insert(conv)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                                             ["conv_id", "place", "edit", "role", "text"])

    return both.mapInArrow(run, REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `repaired` rows, as they stream by: one running digest, no text is kept."""

    def run(frames):
        conv, digest = None, None
        for b in frames:
            ids, shas = [], []
            for c, place, role, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if place == -1:
                    if digest is not None:
                        ids.append(conv)
                        shas.append(digest.hexdigest())
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with damage by the hash of `conv_id:turn`; a row that is dropped stays with present = false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), way.alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("way") != 0).alias("present"), F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    found = written(audit(turns), "repair-audits")
    sums = digests(repaired(turns, found))
    return found.join(sums, found["conv_id"].eqNullSafe(sums["conv_id"])).drop(sums["conv_id"]).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
