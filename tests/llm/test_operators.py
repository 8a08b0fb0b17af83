"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import itertools
import re
import time
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clickloom.llm import chat, decontaminate, jaccard, langid, packing, paragraphs, suffixes, toxicity, vectors, warc
from clickloom.llm.common import components, release, row_hashes, small_batches, span_hashes, tidy, written

WORDS = "alpha beta gamma delta river stone window garden yellow quiet seven letter market paper morning silver".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(j % 7) for j, i in enumerate(rng.integers(0, len(WORDS), n)))


def texts() -> list[tuple[int | None, str | None]]:
    base = [prose(s, n) for s, n in ((1, 120), (2, 60), (3, 300), (4, 30))]
    near = base[0].split()
    near[60] = "CHANGED"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[0]), (11, " ".join(near)), (12, base[0].upper()), (13, None), (14, ""), (15, " \n "), (16, "one two three"),
             (17, "ONE two  three"), (18, "one two three four"), (19, prose(9, 3000)), (20, prose(9, 3000) + " tail"), (21, "x" * 130), (22, "x" * 60),
             (23, "é" * 40 + base[1]), (2, base[2]), (None, base[0]), (None, None), (24, prose(30, 40) + "\n" + base[1] + "\n" + prose(31, 12))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    small_batches(spark)
    rows = [(i, t, "x", 5, "own") for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n long, component_id string").repartition(3)


def empty(df):
    return df.where(F.lit(False))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 1), (7, 8), (20, 20), (8, 30), (2, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = roots({x for e in edges for x in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- chat ------------------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", "a % < [INST] </s> %25"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, None, None, "[TURN:x]"),
            (2, 0, "too]l", "é😀"), (3, 0, "system", ""), (3, 1, "user", "q"), (3, 2, "assistant", "r"), (None, 0, "user", "u")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r.conv_id: r for r in chat.digest(turns).collect()}
    said = {k: [((r[2] or ""), (r[3] or "")) for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))] for k in got}
    for k, s in said.items():
        loss = "".join(t for r, t in s if r == "assistant")
        assert got[k].n_turns == len(s)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in s).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[k].valid for k in (1, 2, 3)] == [False, False, True]
    assert chat.digest(empty(turns)).count() == 0
    plan = chat.digest(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- packing ---------------------------------------------------------------------------------------------------


def test_packing(docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(packing.pieces(docs, capacity=256), capacity=256).collect()
    want = []
    for i, t in texts():
        ids = np.array(encoder.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, a, len(p := ids[a : a + 256]), zlib.crc32(p.tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    for _, g in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(packing.pieces(empty(docs))).count() == 0


def test_special_strings_and_case(spark):
    from tokenizers import Tokenizer

    encoder, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    for t in ("<|endoftext|> a", "<|ENDOFTEXT|>", "ΑΣ Σ.", "don't STOP, now!!", "x1y2 ²½", " a b", "é.", "İ İ", "ab,c d?", "😀😀 ok."):
        assert np.frombuffer(words.encode(t), "<u4").tolist() == encoder.encode(t, add_special_tokens=False).ids, t


def test_new_words_are_encoded_in_one_call(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    own = ["The river, the RIVER. a1b2 x,y ,, . ... don't I'M", "", " \n ", "<|endoftext|> A<|STARTOFTEXT|>b é. É! 漢字? ß: \u0130.", "stone; " * 40, "x" * 3000 + ".", "été straße, ﬁn? e\u0301t\u00e9; ꜩ ª. ǅ! ςσΣ. \u0301a ａｂ. 你好, ñandú!"]
    own += [t or "" for _, t in texts()]
    want = [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in own]
    for most in (600_000, 30):
        monkeypatch.setattr(packing, "CACHE_WORDS", most)
        cache, calls = packing.WordIds(packing.tokenizer_path()), []
        real = cache.encoder
        cache.encoder = SimpleNamespace(encode_batch_fast=lambda words, **k: calls.append(words) or real.encode_batch_fast(words, **k))
        assert cache.encode_all(own) == want and len(calls) == 1
        assert not any(packing.is_letters(w.encode()) for w in calls[0])
        assert cache.encode_all(own[:3]) == want[:3] and cache.encode_all([]) == []


def test_new_words_do_not_walk_through_the_cache():
    class Watched(packing.WordIds):
        def __iter__(self):
            raise AssertionError("walked through")

    words, plain = Watched(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    for text in ("some words, here", "here, words. Some 12 other wörds!"):
        ids = plain.encoder.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 101), 25, False), rng.integers(1, 40, 25))}
    plan = packing.plan(counts, 100)
    used: dict[int, int] = {}
    for times, pattern in plan:
        assert sum(n * m for n, m in pattern.items()) <= 100
        for n, m in pattern.items():
            used[n] = used.get(n, 0) + times * m
    assert used == counts
    assert sum(t for t, _ in plan) <= 1.05 * -(-sum(n * c for n, c in counts.items()) // 100) + 2 + sum(c for n, c in counts.items() if n > 50)


# --- near copies -----------------------------------------------------------------------------------------------


def shingle_sets():
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        yield i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def test_near_copies(docs):
    sets = list(shingle_sets())
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None], 2) if x and 100 * len(x & y) >= 85 * len(x | y)]
    comp = roots({i for i, _ in sets if i is not None}, edges)
    want = sorted(((i, len(s), comp.get(i)) for i, s in sets), key=str)
    assert sorted((tuple(r) for r in jaccard.near_copies(docs).collect()), key=str) == want
    assert jaccard.near_copies(empty(docs)).count() == 0


def test_near_copies_of_an_id_with_two_texts(spark):
    x, y, z = prose(1, 60), prose(2, 60), prose(3, 60)
    nearly = x + " end"
    rows = [(0, x), (1, x), (1, y), (2, z), (5, y), (5, nearly), (6, None), (6, z), (7, z), (7, z)]
    got = sorted(tuple(r) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
    assert got == sorted([(0, 0), (1, 0), (1, 1), (2, 2), (5, 1), (5, 0), (6, 6), (6, 2), (7, 2), (7, 2)])


@pytest.mark.parametrize("size", [3, 8, 20, 70, 300])
def test_signatures_meet(size):
    """Any two sets at the threshold share a signature that neither may leave out."""
    rng = np.random.default_rng(size)
    for _ in range(20):
        full = rng.integers(0, 1 << 62, size, dtype=np.uint64)
        drop = int(0.15 * size)
        a, b = np.unique(full), np.unique(full[drop:]) if drop else np.unique(full)
        s, of, spare = jaccard.signatures([a, b])
        common = set(s[of == 0].tolist()) & set(s[of == 1].tolist())
        upper = jaccard.bands()[0]
        k = max(np.searchsorted(upper, [len(a), len(b)]))
        left = spare[k - np.searchsorted(upper, len(a)), 0]
        assert len([x for x in common if x & 1 == k & 1]) > left


def test_blocks_agree_with_pairs(spark):
    rows = [(i, " ".join(prose(1, 80).split()[: 80 - i % 9])) for i in range(30)] + [(100 + i, prose(50 + i, 80)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    entries = df.select(F.lit(1).cast("long").alias("signature"), F.col("doc_id").alias("class"))
    found = jaccard.checked_blocks(df, entries, 4, 85).collect()
    low = dict((r.b, r.a) for r in found)
    assert set(low) == set(range(1, 30)) and set(low.values()) == {0}


def test_a_class_is_once_in_a_group_however_many_signatures_it_shares(spark, monkeypatch):
    """Rows of a group grow with its classes, not with its square; results are those of all pairs."""
    rng, rows = np.random.default_rng(4), []
    base = prose(7, 150).split()
    for i in range(300):
        w = list(base)
        for k in rng.choice(len(w), 6, False):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    met, plain = [], jaccard.checked_blocks
    monkeypatch.setattr(jaccard, "checked_blocks", lambda docs, entries, n, percent: met.append(entries) or plain(docs, entries, n, percent))
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(147)} for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == roots(set(sets), edges)
    assert 0 < met[0].count() <= 10 * len(rows)


def test_tiles_agree_with_pairs():
    rng = np.random.default_rng(1)
    full = [np.unique(rng.integers(0, 1 << 40, 60, dtype=np.uint64)) for _ in range(8)]
    sets = [np.unique(x[rng.random(len(x)) > 0.08]) for x in full for _ in range(90)]  # three tiles
    edges = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2)
             if 100 * (n := len(np.intersect1d(sets[a], sets[b], True))) >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    want = roots(set(range(len(sets))), edges)
    a, b = jaccard.meeting(sets, np.arange(len(sets)), 85)
    assert {int(y): int(x) for x, y in zip(a, b)} == {i: r for i, r in want.items() if i != r}


# --- suffixes --------------------------------------------------------------------------------------------------


def test_suffixes(docs):
    first: dict[bytes, int] = {}
    rows = sorted((r for r in texts() if r[0] is not None), key=lambda r: r[0])
    want = []
    for i, t in rows:
        for p in range(len(raw := (t or "").encode()) - 49):
            first.setdefault(raw[p : p + 50], i)
    for i, t in rows + [r for r in texts() if r[0] is None]:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if i is not None and first[raw[p : p + 50]] < i:
                mark[p : p + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(mark)))
        want.append((i, len(raw), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(raw, mark) if not m)).hexdigest()))
    assert sorted(map(tuple, suffixes.digest(docs.select("doc_id", "text")).collect()), key=str) == sorted(want, key=str)
    assert suffixes.digest(empty(docs).select("doc_id", "text")).count() == 0
    rest = suffixes.without_repeats(docs)
    assert rest.columns == docs.columns and rest.count() == docs.count()


def test_loser_tree():
    rng = np.random.default_rng(1)
    every, runs = [], []
    for r in range(5):
        rows = np.unique(rng.integers(97, 99, (40, suffixes.WIDTH)).astype(np.uint8) * (rng.random((40, 1)) < 0.7) + 97, axis=0).astype(np.uint8)
        rows = rows[np.argsort(np.ascontiguousarray(rows).view(f"S{suffixes.WIDTH}").ravel(), kind="stable")]
        shared, rests = suffixes.front_code(rows)
        runs.append((shared.tobytes(), rests.tobytes(), np.arange(len(rows)) + 100 * r))
        every += [x.tobytes() for x in rows]
    out = list(suffixes.LoserTree([x[:2] for x in runs]).merge())
    assert [x[1] for x in out] == sorted(every)
    for (_, a, _), (_, b, n) in itertools.pairwise(out):
        assert a[:n] == b[:n] and (n == suffixes.WIDTH or a[n] != b[n])


# --- paragraphs ------------------------------------------------------------------------------------------------


def test_stretches_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 49, 50, 51, 0, 3000, 7, 200, 40_000, 50, 120, 33_000, 0)]
    offsets = np.cumsum([0, *map(len, texts)])
    row, first, end, anchor, own = suffixes.stretches(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, text in enumerate(texts):
        _, *alone = suffixes.stretches(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        mine = row == i
        for x, y in zip((first - offsets[i], end - offsets[i], anchor, own), alone):
            assert (x[mine] == y).all()
        assert (end - first)[mine].sum() == max(len(text) - suffixes.WIDTH + 1, 0)


def test_suffixes_of_texts_whose_anchors_come_again(spark):
    rng = np.random.default_rng(11)
    some = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    a, b, c = some(70), some(24), some(40)
    texts = ["=" * 130, "x" + "=" * 90 + "y", some(30) + b * 4 + some(30), b * 3, some(9) + b * 2 + some(40), "ab" * 60, "b" + "ab" * 40 + some(20),
             some(60) + a + some(5), some(3) + a[:60] + some(50), a[9:], some(20) + c + some(20), some(30) + c + some(30), "ha! " * 30, some(10) + "ha! " * 14 + "!", "é" * 40, "xé" * 30 + "é" * 30]
    rows = [(i - 3, t) for i, t in enumerate(texts * 2)] + [(1 << 40, texts[2][5:] + texts[7][:90]), (5, texts[9] + texts[11])]
    first: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for p in range(len(raw := t.encode()) - 49):
            first.setdefault(raw[p : p + 50], i)
    want = []
    for i, t in rows:
        mark = bytearray(len(raw := t.encode()))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                mark[p : p + 50] = b"\1" * 50
        want.append((i, sum(mark), hashlib.sha256(bytes(x for x, m in zip(raw, mark) if not m)).hexdigest()))
    got = suffixes.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(want)


def test_only_windows_that_share_most_bytes_are_sorted(spark):
    rng = np.random.default_rng(12)
    some = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    phrase, passage = some(41), some(60)

    def left(texts):
        found = suffixes.settle_stretches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4)
        return found.where(found.kind == suffixes.OPEN).count()

    assert left([some(80) + phrase + some(80) for _ in range(12)]) < 12  # at least one for each of them before; equal short hashes leave a few
    assert left([some(80) + passage + some(80) for _ in range(2)]) > 0


def test_packed_ids():
    for ids in ([3], [-5, -5, 7], [0, 200, 70_000], [1, 1 << 33], [-(1 << 63), (1 << 63) - 1], [9, 9, 9]):
        ids = np.array(ids, np.int64)
        assert (suffixes.unpack_ids(*suffixes.pack_ids(ids)) == ids).all() and (suffixes.unpack_rising(*suffixes.pack_rising(ids)) == ids).all()
    assert len(suffixes.pack_rising(np.arange(10**6, 10**6 + 5000))[0]) == 5000


def test_release_lets_go_of_shuffle_files_of_the_last_query(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {str(f) for d in folders for f in Path(d).rglob("shuffle_*.data")}
    release(spark)
    time.sleep(2)
    before = files()
    written(spark.range(1000).repartition(5, "id"), "test-release")
    mine = files() - before
    assert mine
    release(spark)
    for _ in range(50):
        if not mine & files():
            break
        time.sleep(0.1)
    assert not mine & files()


def test_small_batches_bound_scans_too(spark):
    small_batches(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_tidy_hands_freed_memory_back():
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    kept = []

    def run(frames):
        yield from frames
        for _ in range(600):
            some = bytearray(b"x") * 100_000
            kept.append(some)
        del kept[:-1]  # the last one stands above what is free

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["a"])
    before = resident()
    assert list(run(iter([batch]))) == [batch]
    grown = resident() - before
    kept.clear()
    assert list(tidy(run)(iter([batch]))) == [batch]
    assert grown > 30_000_000 > resident() - before


def test_row_hashes_are_span_hashes():
    rows = np.random.default_rng(5).integers(0, 256, (40, suffixes.WIDTH), dtype=np.uint8)
    at = np.arange(len(rows)) * suffixes.WIDTH
    assert (row_hashes(rows) == span_hashes(rows.reshape(-1), at, at + suffixes.WIDTH)).all()


def test_paragraphs(docs):
    gone = {(r.doc_id, r.place): (r.kept_doc, r.kept_place) for r in paragraphs.repeats(docs).collect()}
    assert gone[(24, 1)] == (1, 0) and gone[(10, 0)] == (0, 0) and gone[(11, 0)] == (0, 0)
    assert (24, 0) not in gone and (24, 2) not in gone and (16, 0) not in gone and (3, 0) not in gone
    assert paragraphs.repeats(empty(docs)).count() == 0
    bands, rows = paragraphs.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= paragraphs.RECALL


def planted(seed: int, n: int = 30) -> tuple[list[tuple[int, str]], set[int]]:
    """Texts of words of their own, and the ids of those that hold 50 words of another text, broken into other lines."""
    rng = np.random.default_rng(seed)
    own = lambda k: [f"v{x}" for x in rng.integers(0, 1_000_000, k)]
    shared, rows = own(paragraphs.WINDOW + paragraphs.PASSAGE - 1), []
    for i in range(n):
        mine = own(rng.integers(20, 90)) + (shared if i % 3 == 1 else []) + own(rng.integers(20, 90))
        rows.append((i, "".join(w + str(rng.choice([" ", " ", " ", " ", "\n", "  "])) for w in mine)))
    return rows, {i for i in range(n) if i % 3 == 1} - {1}


def test_passages_within_lines(spark):
    rows, hold = planted(11)
    gone = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # Other documents may share a line of the passage that the first one breaks elsewhere.
    assert {r.doc_id for r in gone} == hold and {r.doc_id for r in gone if r.kept_doc == 1} == hold and {r.kept_doc for r in gone} <= hold | {1}
    texts = dict(rows)
    for r in gone:
        kept, words = texts[r.kept_doc].encode().split(), texts[r.doc_id].encode()[r.start : r.end].split()
        assert len(words) == paragraphs.PASSAGE or r.place is not None
        assert len(set(words) & set(kept)) >= len(words) - 2  # near copies may differ at their ends


def test_every_long_repeat_holds_a_common_passage():
    rng = np.random.default_rng(6)
    for _ in range(60):
        vocabulary = rng.choice([3, 50, 10_000])
        own = lambda k: [f"w{x}" for x in rng.integers(0, vocabulary, k)]  # noqa: B023, E731
        shared = own(paragraphs.WINDOW + paragraphs.PASSAGE - 1)
        made = [" ".join(own(rng.integers(0, 40)) + shared + own(rng.integers(0, 40))).encode() for _ in range(2)]
        data, offsets = np.frombuffer(b"".join(made), np.uint8), np.cumsum([0, *map(len, made)])
        row, begin, end = paragraphs.passages(data, offsets)
        found = [{data[a:z].tobytes() for a, z in zip(begin[row == i], end[row == i])} for i in (0, 1)]
        assert all(len(x.split()) == paragraphs.PASSAGE for f in found for x in f)
        assert vocabulary == 3 or found[0] & found[1]
        for i, text in enumerate(made):  # a text among others is cut as it is alone
            _, a, z = paragraphs.passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            assert (a == begin[row == i] - offsets[i]).all() and (z == end[row == i] - offsets[i]).all()


def test_units_against_all_pairs(spark, docs):
    """Components of the units equal those of all pairs of lines compared, and of equal passages."""
    rows, _ = planted(12)
    near = [(100 + i, " ".join(x if j != 30 * (i % 2) + 20 else "changed" for j, x in enumerate(t.split()))) for i, t in rows[:8]]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows + near, "doc_id long, text string"))
    made = [r for r in paragraphs.units(both.where("doc_id IS NOT NULL")).collect()]
    sets = {r.id: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for r in made if r.text for w in [r.text.lower().split()]}
    ids, root = sorted(sets), {r.id: r.id for r in made}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    first: dict[int, tuple] = {}
    for r in made:
        first[top(r.id)] = min(first.get(top(r.id), (1 << 62,)), (r.doc_id, r.start, r.end))
    expected = set()
    for r in made:
        keep = first[top(r.id)]
        if r.doc_id != keep[0] or r.start >= keep[2] or r.end <= keep[1]:
            expected.add((r.doc_id, r.start, r.end, keep[0], keep[1]))
    found = {(r.doc_id, r.start, r.end, r.kept_doc, r.kept_start) for r in paragraphs.repeats(both).collect()}
    assert found == expected and len(found) > 50


# --- decontamination -------------------------------------------------------------------------------------------


def test_decontamination(spark, docs):
    item = prose(77, 30)
    twisted = item.split()
    twisted[5], twisted[14] = "other", "words"
    more = [(100, prose(5, 200) + " " + item + " " + prose(6, 90)), (101, prose(8, 50) + " " + " ".join(twisted)), (102, item), (103, prose(8, 200)), (None, item)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "too short", 1), (10, prose(78, 25), 1), (None, item, 1)], "item_id long, text string, lcs int")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(both, bench).collect()}
    assert {(100, 7), (101, 7), (102, 7), (None, 7)} == found
    assert decontaminate.contaminated(empty(both), bench).count() == 0 and decontaminate.contaminated(both, empty(bench)).count() == 0


def test_decontamination_of_many_items(spark):
    """Every verbatim item is found, however many items there are for the basis."""
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(6000)])
    items = [" ".join(rng.choice(words, 30)) for _ in range(800)]
    rows = [(i, " ".join(rng.choice(words, 9)) + " " + t + " " + " ".join(rng.choice(words, 9))) for i, t in enumerate(items)]
    rows += [(5000 + i, " ".join(rng.choice(words, 60))) for i in range(100)]
    both = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = decontaminate.contaminated(both, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), rank=64)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(len(items))}


def accepted(text, item):
    """The rule alone: every passage with its surroundings against the item, nothing left out before the checks."""
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    words, own = decontaminate.tokens(text), decontaminate.tokens(item)
    last, n = set(decontaminate.tokens(item.split(". ")[-1])), len(own)
    for start in range(0, max(len(words) - 48, 0) + 16, 16):
        near = words[max(0, start - n) : start + 48 + n]
        if n < 8:
            share = float(any(near[j : j + n] == own for j in range(len(near))))
        else:
            share = length(own, near) / n
            if share >= 0.5:
                share = max(length(own, near[j : j + 2 * n]) for j in range(0, max(len(near) - n, 1), max(n // 2, 1))) / n
        if share >= 0.8 or share >= 0.5 and len(last & set(near)) >= 0.6 * len(last):
            return True
    return False


def test_decontamination_leaves_out_only_what_the_checks_refuse(spark):
    rng = np.random.default_rng(8)
    other = lambda n: [f"o{k}" for k in rng.integers(0, 3000, n)]
    long = [f"a{k}" for k in range(40)]
    short = [f"b{k}" for k in range(15)]
    same = [f"c{k}" for k in range(10)] + ["again"] * 20
    items = {1: " ".join(long[:20]) + ". " + " ".join(long[20:]), 2: " ".join(short[:6]) + ". " + " ".join(short[6:]), 3: " ".join(same[:10]) + ". " + " ".join(same[10:]),
             4: "short but whole item", 5: "one", 6: " ".join(f"a{k}" for k in range(0, 60, 3)), 7: " ... "}
    kept = [[*long[:3], *long[23:]], short[6:], same[10:26], ["Short", "but", "whole", "item"], ["short", "but", "item", "whole"], ["one"], short[:8], [*long[:2], *long[24:]]]
    rows = [(i, " ".join([*other(70), *k, *other(70)])) for i, k in enumerate(kept)] + [(20, "short but whole, item!"), (21, ""), (22, None)]
    for i in range(40):
        own = decontaminate.tokens(items[1 + i % 3])
        some = [x for x in own if rng.random() < 0.45 + 0.01 * i]
        rows.append((100 + i, " ".join([*other(rng.integers(0, 60)), *[x.decode() for x in some], *other(rng.integers(0, 60))])))
    both = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(both, bench).collect()}
    want = {(i, k) for i, t in rows for k, item in items.items() if decontaminate.tokens(item) and accepted(t or "", item)}
    assert {(0, 1), (1, 2), (2, 3), (3, 4), (5, 5), (20, 4)} <= want and (4, 4) not in want
    assert found == want


def test_latent_products_decide_which_pairs_are_checked(spark, monkeypatch):
    """All that the checks accept is a candidate; most of the rest is not; without candidates nothing is found."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(3000)])
    chance = 1 / np.arange(1, 3001)
    text = lambda n: " ".join(rng.choice(words, n, p=chance / chance.sum()))
    items = [text(n) for n in (9, 12, 20, 30, 45, 70, 3, 1)]
    texts = [text(n) for n in rng.integers(0, 260, 60)] + ["", None]
    for i in range(40):
        own = items[i % 6].split()
        texts.append(" ".join([text(rng.integers(1, 90)), *[w for w in own if rng.random() < 0.6 + 0.01 * i], text(rng.integers(1, 90))]))
    block = decontaminate.block_of([Row(item_id=i, text=t) for i, t in enumerate(items)])
    codes, offsets = decontaminate.codes_of(texts, block.vocabulary)
    space = decontaminate.space_of(block, np.array([0.1 + np.log1p(int(w[1:])) for w in block.vocabulary]))
    found = set(zip(*(x.tolist() for x in decontaminate.candidates(codes, offsets, space))))
    every = 0
    for t, n in enumerate(np.diff(offsets).tolist()):
        for p, start in enumerate(decontaminate.passages(n)):
            for k, size in enumerate(space.size.tolist()):
                near = codes[offsets[t] + max(0, start - size) : offsets[t] + min(n, start + 48 + size)]
                share, answer = decontaminate.contained(block, k, near, space.times[k], decontaminate.places_of(block.words[k]))
                every += 1
                assert share < 0.8 and not (share >= 0.5 and answer >= 0.6) or (t, p, k) in found
    assert 0 < len(found) < 0.5 * every
    monkeypatch.setattr(decontaminate, "LONG", 3)
    monkeypatch.setattr(decontaminate, "PIECES", 7)
    assert set(zip(*(x.tolist() for x in decontaminate.candidates(codes, offsets, space)))) >= {x for x in found if x[2] < 6 and accepted(texts[x[0]] or "", items[x[2]])}

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if accepted(t or "", item)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want and want
    none = np.zeros(0, np.int64)
    frames = [pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})]
    held = {}
    fake = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))),
                           select=lambda *a: SimpleNamespace(mapInArrow=lambda f, schema: held.update(f=f)))
    monkeypatch.setattr(decontaminate, "frequencies", lambda docs, items: (np.ones(len(items.vocabulary)), 9))
    decontaminate.find(fake, block)
    assert sum(b.num_rows for b in held["f"](iter(frames))) == len(want)
    monkeypatch.setattr(decontaminate, "candidates", lambda codes, offsets, space: (none, none, none))
    assert not list(held["f"](iter(frames)))


def test_lcs():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 15)
        t = np.zeros((13, 16), int)
        for i, j in itertools.product(range(12), range(15)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[12, 15]


# --- vectors ---------------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[100:200] = x[0] + rng.normal(size=(100, 16)) * 0.15
    x[200:230] = x[1]
    x[230:300] = x[2:72] + rng.normal(size=(70, 16)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] + [1.0] * 15), (1005, [1.0] * 3), (None, x[0].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    comp = roots(range(400), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    links = {i: int(near[i].sum()) - 1 for i in range(400)}
    assert sum(got[i].n_links for i in range(400)) >= 0.99 * sum(links.values()) and all(got[i].n_links <= links[i] for i in range(400))
    assert sum(got[i].component_id == comp[i] for i in range(400)) >= 396
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1006))
    assert vectors.near_vectors(empty(df)).count() == 0


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    wide, narrow = rng.normal(size=(40, 12)), rng.normal(size=(6, 5))
    narrow[3], narrow[4] = narrow[0], narrow[1] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(wide)] + [(100 + i, v.tolist()) for i, v in enumerate(narrow)] + [(200, [2.0]), (201, [5.0]), (202, [-1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    assert got[103] == (1, 100) and got[100] == (1, 100) and got[104] == (1, 101)
    assert got[200] == (1, 200) and got[201] == (1, 200) and got[202] == (0, 202)
    assert all(got[i] == (0, i) for i in (*range(40), 102, 105))


# --- WARC ------------------------------------------------------------------------------------------------------


def test_warc(spark):
    body = "<html>" + "é" * 80
    rows = [(5, "http://a", body), (3, "http://b\r\nX: y", body), (3, "again", body), (9, None, None), (10, "u", ""), (11, "u", "short"), (12, "u", "short"), (None, "n", body), (13, "u", "\r\n\r\nWARC/1.1\r\n" * 30)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder, index).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = 3 if h == body and i != 3 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first is None else "revisit", first))
    assert got == sorted(want, key=str)
    assert warc.fetch(spark, folder, index, [13, 9]) == {13: rows[-1][2].encode(), 9: b""}
    assert warc.write_archives(empty(pages), warc.archive_folder(spark)).count() == 0


# --- classifiers -----------------------------------------------------------------------------------------------


def test_toxicity(spark, sf, docs):
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(real, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len({i for i, _ in texts()}) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[13].score == got[14].score
    assert toxicity.score(empty(docs), model).count() == 0
    blank = toxicity.fit(real, labels.where("false"))
    assert {r.predicted for r in toxicity.score(docs, blank).collect()} == {0}
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_isotonic():
    x, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1])
    at, to = toxicity.fit_isotonic(x, y)
    assert at.tolist() == x.tolist() and to.tolist() == [0, 0.5, 0.5, 0.5, 0.5, 1]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op1(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)


def test_language(spark, docs):
    sf = "/root/testdata/sf0.01"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.op6(spark, sf).join(real.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "word")], "doc_id long, text string")
    net = langid.fit(real.limit(100))
    assert [r.lang_pred == "und" for r in langid.predict(odd, net).orderBy("doc_id").collect()] == [True, True, True, False]
    assert langid.predict(empty(odd), net).count() == 0 and langid.fit(real.where("false")) is None
