"""Benchmark decontamination by latent semantic retrieval.

1. Documents become passages of `PASSAGE` words, one every `STEP` words, that cover the whole text. Document
   frequencies of all benchmark words are counted over all passages of the corpus.
2. The latent space is spanned by the singular vectors of the items' TF-IDF rows, weighted by the corpus. A block has
   no more items than the space may have dimensions, so all directions of its items are kept. What a text has besides
   is orthogonal to every item, so directions of the corpus would change no product; none are taken from it.
3. Every `STEP` words of the corpus are projected, and their inner products with the items add up over the words around
   a passage. An accepted stretch holds a known number of an item's words, and the product of a text with an item has
   no negative terms, so it reaches at least the sum over the item's lightest words of that number. Candidates are
   all passages and items whose product around the passage reaches this bound; they alone are checked, and nothing
   else can pass. Documents are compared as a whole first, by the same bound.
4. Candidates whose words are enough in number are checked by the longest common subsequence of the item's words and
   the words around the passage; an item counts as contained when the subsequence covers `EXACT` of it, or `PARAPHRASE`
   of it and the answer (the words of its last sentence) is there too. An item of fewer than `LEAST` words has to be
   there word for word.

The benchmark is the stated query set: it is collected in blocks of at most `ITEMS` items and no more than the rank.
Each block is searched against all rows.

Defined cases: null texts and items and those without words match nothing; repeated documents match alike; an empty
table gives no rows; columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import by_bytes, ragged, read, small_batches, tidy

PASSAGE, STEP, LEAST = 48, 16, 8
RANK = 256
ITEMS = RANK
#: Pieces of `STEP` words that are projected at once, and passages of a longer text that are looked at together.
PIECES, LONG = 2048, 8192
#: Candidates of one item among so many passages in a row are checked together before they are checked alone.
TOGETHER = 4
#: Share of the norms of a text and an item by which their product in single precision may be off.
SLACK = 1e-5
EXACT, PARAPHRASE, ANSWER = 0.8, 0.5, 0.6

_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts words."""
    return (text or "").lower().encode().translate(_KEEP).split()


@dataclass
class Items:
    """A block of items as word codes of its own vocabulary."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[bytes, int]


def block_of(rows: list) -> Items:
    vocabulary: dict[bytes, int] = {}
    out = Items([], [], [], vocabulary)
    for r in rows:
        found = tokens(r.text)
        if not found or r.item_id is None:
            continue
        codes = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int32)
        last = [s for s in (r.text or "").replace("\n", " ").split(". ") if tokens(s)][-1]
        out.ids.append(r.item_id)
        out.words.append(codes)
        out.answers.append(np.array([vocabulary[w] for w in tokens(last) if w in vocabulary] or codes, np.int32))
    return out


def codes_of(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as codes (-1 for words that no item has), and the n + 1 offsets of the texts into them."""
    found: list[bytes] = []
    ends = [0]
    for text in texts:
        found += tokens(text)
        ends.append(len(found))
    return np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found)), np.array(ends)


def passages(n: int) -> range:
    """Starts of the passages of a text of n words."""
    return range(0, max(n - PASSAGE, 0) + STEP, STEP) if n else range(0)


def frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Passages that hold each word of the vocabulary, and all passages, over the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    width = len(items.vocabulary)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(width, np.int64), 0
        for b in by_bytes(frames, 0):
            codes, offsets = codes_of(b.column(0).to_pylist(), shared.value)
            # Passages that do not overlap count words once each; the step only repeats them.
            n = -(-np.diff(offsets) // PASSAGE)
            first = np.cumsum(n) - n
            at = np.flatnonzero(codes >= 0)
            text = np.searchsorted(offsets, at, "right") - 1
            key = np.unique((first[text] + (at - offsets[text]) // PASSAGE) * width + codes[at])
            seen += np.bincount(key % width, minlength=width)
            total += int(n.sum())
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(seen[hit], total))], ["code", "n"])

    got = docs.select("text").mapInArrow(tidy(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(width, np.int64)
    total = 0
    for r in got:  # a row per word of the vocabulary at most
        if r.code < 0:
            total = r.n
        else:
            n[r.code] = r.n
    return n, total


def least(share: float, n: int) -> int:
    """The smallest number whose share of n reaches `share`."""
    return next(k for k in range(n + 1) if k / n >= share)


def needed(n: int) -> tuple[int, int]:
    """Words of an item of n words that an accepted stretch holds at least, repeated ones counted as often as held: with
    its answer, and whatever the answer."""
    return (n, n) if n < LEAST else (least(PARAPHRASE, n), least(EXACT, n))


@dataclass
class Space:
    """The latent space of a block: per word its weighted place (last: no word), per item its place, the product that
    the words around a passage reach if they hold the item, its words, how many of them an accepted stretch holds with
    the answer and without, how many words of the answer, which words these are, how often it has each word
    (last: no word) and whether it has it, item by item."""

    weight: np.ndarray
    words: np.ndarray
    items: np.ndarray
    bound: np.ndarray
    size: np.ndarray
    need: np.ndarray
    exact: np.ndarray
    reply: np.ndarray
    replies: np.ndarray
    times: np.ndarray
    own: np.ndarray


def space_of(items: Items, weight: np.ndarray) -> Space:
    """All right singular vectors of the items' TF-IDF rows: products with items are exact in their span."""
    times = np.zeros((len(items.words), len(weight) + 1), np.int32)
    for i, codes in enumerate(items.words):
        np.add.at(times[i], codes, 1)
    rows = times[:, :-1] * weight
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    basis = v[s > 1e-9 * s[0]].T
    words = np.concatenate([weight[:, None] * basis, np.zeros((1, basis.shape[1]))])
    size = np.array([len(codes) for codes in items.words])
    need, exact = np.array([needed(int(n)) for n in size]).T
    replies = np.zeros(times.shape, bool)
    bound, reply = np.zeros(len(size)), np.zeros(len(size), np.int64)
    for i, codes in enumerate(items.words):
        answer = np.unique(items.answers[i])
        replies[i, answer] = True
        reply[i] = least(ANSWER, len(answer)) if size[i] >= LEAST else 0
        # Every word held adds its own square weight, as often as the item has it. The least sum of `exact` places, or of
        # `need` places with `reply` words of the answer among them: the lightest of the answer, then of the rest.
        value = times[i] * np.append(weight, 0) ** 2
        lightest = answer[np.argsort(value[answer], kind="stable")[: reply[i]]]
        rest = times[i].copy()
        rest[lightest] -= 1
        rest = np.sort(np.repeat(value, rest))[: max(need[i] - reply[i], 0)]
        bound[i] = min(np.sort(value[codes])[: exact[i]].sum(), value[lightest].sum() + rest.sum())
    return Space(weight, words.astype(np.float32), (rows @ basis).astype(np.float32), bound, size, need, exact, reply, replies, times, times.ravel() > 0)


def project(codes: np.ndarray, piece: np.ndarray, n: int, words: np.ndarray) -> np.ndarray:
    """The latent sums of n pieces; `codes` are known words, `piece` (ascending) says where each belongs."""
    count = np.bincount(piece, minlength=n)
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    out = np.zeros((n, words.shape[1]), np.float32)
    for k in range(int(count.max(initial=0))):  # at most `STEP` words
        m = int((count > k).sum())
        out[:m] += words[codes[first[order[:m]] + k]]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return out[back]


def candidates(codes: np.ndarray, offsets: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of a passage, item) of all pairs whose product around the passage reaches the item's bound."""
    side = -(-space.size // STEP)  # pieces on both sides of a passage that may count
    beyond = int(side.max())
    units = []  # text, first passage, end, first piece, end
    for text, n in enumerate(np.diff(offsets).tolist()):
        many, pieces = len(passages(n)), -(-n // STEP)
        for a in range(0, many, LONG):
            z = min(a + LONG, many)
            units.append((text, a, z, max(a - beyond, 0), min(z - 1 + PASSAGE // STEP + beyond, pieces)))
    units = np.array(units, np.int64).reshape(-1, 5)
    pieces = np.cumsum(units[:, 4] - units[:, 3])
    bound = (1 - 1e-6) * space.bound
    known = np.flatnonzero(codes >= 0)
    # A last place adds to every product by how much it may be off.
    items = np.append(space.items, np.linalg.norm(space.items, axis=1)[:, None], axis=1).T
    out = [np.zeros((3, 0), np.int64)]
    i = 0
    while i < len(units):
        j = max(i + 1, int(np.searchsorted(pieces, (pieces[i - 1] if i else 0) + PIECES, "right")))
        text, first, end, low, high = units[i:j].T
        after = np.cumsum(high - low)
        start = after - (high - low)
        left, right = np.searchsorted(known, [offsets[text] + low * STEP, np.minimum(offsets[text] + high * STEP, offsets[text + 1])])
        at = known[ragged(left, right - left)]
        points = project(codes[at], (at - np.repeat(offsets[text] + (low - start) * STEP, right - left)) // STEP, int(after[-1]), space.words)
        points = np.append(points, SLACK * np.linalg.norm(points, axis=1)[:, None], axis=1)
        total = np.zeros((len(points) + 1, len(bound)))
        np.cumsum(points @ items, axis=0, dtype=np.float64, out=total[1:])
        unit, item = np.nonzero(total[after] - total[start] >= bound)  # the text as a whole
        many = (end - first)[unit]
        passage, unit, item = ragged(first[unit], many), np.repeat(unit, many), np.repeat(item, many)
        a = np.maximum(passage - side[item], low[unit]) + (start - low)[unit]
        z = np.minimum(passage + PASSAGE // STEP + side[item], high[unit]) + (start - low)[unit]
        some = np.flatnonzero(total[z, item] - total[a, item] >= bound[item])
        out.append(np.stack([text[unit[some]], passage[some], item[some]]))
        i = j
    return tuple(np.concatenate(out, 1))


def enough(codes: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, space: Space) -> np.ndarray:
    """Whether the words from low to high are as many of the item's, each counted as often as the item has it, as it
    needs: with enough words of the answer, or without."""
    width = space.times.shape[1]
    out = np.zeros(len(item), bool)
    for i in range(0, len(item), 2048):
        k, long = item[i : i + 2048], (high - low)[i : i + 2048]
        near = codes[ragged(low[i : i + 2048], long)]
        near += np.where(near < 0, width, 0).astype(np.int32)  # no word comes last
        at = np.flatnonzero(space.own[np.repeat(k * width, long) + near])
        pair = np.repeat(np.arange(len(k)), long)[at]
        some = (np.bincount(pair, minlength=len(k)) >= space.need[k])[pair]
        key, there = np.unique(pair[some] * width + near[at[some]], return_counts=True)
        of, word = key // width, key % width
        held = np.bincount(of, np.minimum(there, space.times[k[of], word]), len(k))
        reply = np.bincount(of, space.replies[k[of], word], len(k))
        out[i : i + 2048] = (held >= space.exact[k]) | (held >= space.need[k]) & (reply >= space.reply[k])
    return out


def cosine(codes: np.ndarray, k: int, space: Space, unknown: float) -> float:
    """Latent cosine of a passage and an item; words that no item has lengthen the passage."""
    some, tf = np.unique(codes, return_counts=True)
    weight = np.where(some < 0, unknown, space.weight[some])
    square = (tf**2 * weight**2)[some >= 0].sum() + (tf * weight**2)[some < 0].sum()
    product = (tf.astype(np.float32) @ space.words[some]) @ space.items[k]
    return float(product / np.sqrt(square) / np.linalg.norm(space.items[k])) if (some >= 0).any() else 0.0


def places_of(a: np.ndarray) -> dict[int, int]:
    """The places of every word of a, one bit each."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def lcs(a: np.ndarray, b: np.ndarray, masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, one bit row per word of b; `masks`: the places of a's words, if known."""
    masks = places_of(a) if masks is None else masks
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def contained(items: Items, k: int, near: np.ndarray, times: np.ndarray, masks: dict[int, int]) -> tuple[float, float]:
    """Shares of an item and of its answer that the words around a passage hold; an item below `LEAST` words is there
    whole, in one run, or not at all. `times`: how often the item has each word; `masks`: where."""
    item = items.words[k]
    size = len(item)
    if size < LEAST:
        there = len(near) >= size and (np.lib.stride_tricks.sliding_window_view(near, size) == item).all(1).any()
        return float(there), float(there)
    # Other words do not lengthen a subsequence.
    share = lcs(item, near[times[near] > 0], masks) / size
    if share < PARAPHRASE:
        return share, 0.0
    # The subsequence may not be scattered: it has to fit into a stretch twice as long as the item.
    share = max(lcs(item, near[j : j + 2 * size], masks) for j in range(0, max(len(near) - size, 1), max(size // 2, 1))) / size
    return share, float(np.isin(np.unique(items.answers[k]), near).mean())


def find(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): documents that contain an item."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double"
    if not items.ids:
        return spark.createDataFrame([], schema)
    n, total = frequencies(docs, items)
    weight = np.log((1 + total) / (1 + n)) + 0.1
    unknown = float(weight.mean())  # words that no item has weigh as much as an item's word on average
    shared = spark.sparkContext.broadcast((items, space_of(items, weight)))

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, space = shared.value
        masks = [places_of(x) for x in items.words]
        for b in by_bytes(frames, 1):
            codes, offsets = codes_of(b.column(1).to_pylist(), items.vocabulary)
            text, passage, item = candidates(codes, offsets, space)
            order = np.lexsort((passage, item, text))
            text, passage, item = text[order], passage[order], item[order]
            start = offsets[text] + passage * STEP
            low, high = np.maximum(start - space.size[item], offsets[text]), np.minimum(start + PASSAGE + space.size[item], offsets[text + 1])
            # Neighbours first as one: what a passage's surroundings hold, those of all of them hold.
            new = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(item, prepend=-1) | np.diff(passage // TOGETHER, prepend=-1))
            end = np.append(new[1:], len(item))[: len(new)]
            keep = enough(codes, low[new], high[end - 1], item[new], space)
            keep[keep] = [lcs(items.words[k], (near := codes[x:z])[space.times[k][near] > 0], masks[k]) >= need
                          for k, x, z, need in zip(*(v[keep].tolist() for v in (item[new], low[new], high[end - 1], space.need[item[new]])))]
            some = ragged(new[keep], (end - new)[keep])
            some = some[enough(codes, low[some], high[some], item[some], space)]
            best: dict[tuple[int, int], tuple] = {}
            for t, k, a, x, z in zip(*(v[some].tolist() for v in (text, item, start, low, high))):
                share, answer = contained(items, k, codes[x:z], space.times[k], masks[k])
                if share >= EXACT or share >= PARAPHRASE and answer >= ANSWER:
                    close = cosine(codes[a : min(a + PASSAGE, offsets[t + 1])], k, space, unknown)
                    best[t, k] = max(best.get((t, k), (0.0, 0.0, 0.0)), (share, answer, close))
            if best:
                ids = b.column(0).to_pylist()
                rows = [(ids[t], items.ids[k], c, s, a) for (t, k), (s, a, c) in sorted(best.items())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(tidy(search), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """All (doc_id, item_id) pairs over all blocks of the benchmark."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, out, held = benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator(), None, []
    for r in rows:
        held.append(r)
        if len(held) == min(ITEMS, rank):
            part = find(docs, block_of(held))
            out, held = part if out is None else out.unionByName(part), []
    if held or out is None:
        part = find(docs, block_of(held))
        out = part if out is None else out.unionByName(part)
    return out


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
