"""Operators 1, 4 and 7 against brute force on small corpora made to repeat."""

import hashlib
import random
import re
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quietfield.llm import kernels as k
from quietfield.llm import op1_suffix_dedup as op1
from quietfield.llm import op7_substring_dedup as op7
from quietfield.llm.op1_suffix_dedup import suffix_dedup
from quietfield.llm.op4_line_dedup import line_dedup, without_repeated_lines
from quietfield.llm.op7_substring_dedup import substring_dedup
from quietfield.llm.repeats import Limits, keyed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(40)] + ["é", "straße", "日本", "a"]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(5, 80))) for _ in range(8)]
    out = []
    for i in range(n):
        t = r.choice(base)
        kind = r.random()
        if kind < 0.3:
            w = t.split(" ")
            w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif kind < 0.5:
            t = t[r.randint(0, 30) :] + "\n" + r.choice(base)[: r.randint(0, 300)]
        elif kind < 0.55:
            t = "a" * r.randint(0, 400)
        elif kind < 0.6:
            t = "ab c " * r.randint(0, 90)
        out.append((i, t))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, base[0])]


def company(seed, n=80):
    """One phrase in many documents, each time between other words, sometimes between shared ones."""
    r = random.Random(seed)
    phrase = "this phrase of more than sixty bytes stands in a third of all of them, always"
    side = [" ".join("s%d" % r.randrange(99) for _ in range(9)) for _ in range(6)]
    fresh = lambda: " ".join("f%d" % r.randrange(10**6) for _ in range(12))
    pick = lambda: r.choice(side) if r.random() < 0.4 else fresh()
    return [(i, pick() + " " + phrase + " " + pick()) for i in range(n)]


def brute_bytes(rows, L):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - L + 1):
            w = b[p : p + L]
            if w in seen:
                gone[p : p + L] = b"\1" * L
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, L):
    first, out = {}, []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for n, (_, text) in enumerate(rows):
        w = WORD.findall(text or "")
        for p in range(len(w) - L + 1):
            first.setdefault(tuple(w[p : p + L]), n)
    for n, (key, text) in enumerate(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - L + 1):
            if first[tuple(w[p : p + L])] < n:
                gone[p : p + L] = [True] * L
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, n_bytes string, cover string").repartition(parts)


def key(r):
    return (r[0] is None, r[0] or 0)


def same_bytes(spark, rows, L, **how):
    got = suffix_dedup(frame(spark, rows), L, **how).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_bytes(rows, L), key=key)


def same_words(spark, rows, L, **how):
    got = substring_dedup(frame(spark, rows), L, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_words(rows, L), key=key)


@pytest.mark.parametrize(("seed", "L"), [(1, 100), (2, 40)])
def test_bytes_match_brute_force(spark, seed, L):
    same_bytes(spark, corpus(seed), L)


@pytest.mark.parametrize(("seed", "L"), [(3, 13), (4, 6)])
def test_words_match_brute_force(spark, seed, L):
    same_words(spark, corpus(seed), L)


def test_bytes_in_many_buckets(spark):
    """Buckets of a few suffixes: splitters fall into most anchors, so windows are compared across boundaries."""
    same_bytes(spark, corpus(5), 50, bucket_bytes=2000, limits=Limits(piece=64, block=16))
    same_bytes(spark, company(6), 100, bucket_bytes=1000)
    base = keyed(frame(spark, company(6)))
    found = op1.repeated_windows(base, 100, bucket_bytes=1000)
    assert found.count() > 0


def test_words_with_lengthened_seeds(spark):
    rows = company(7) + [(a + 100, b) for a, b in corpus(6) if a is not None]
    rows += [(a + 300, b + " / " + b) for a, b in company(7)[::5]]  # twice in one document
    few = Limits(sample_hot=2, piece=16, block=16)
    assert len(op7.common_seeds(keyed(frame(spark, rows)), 7, 5, few)) > 0
    same_words(spark, rows, 7, limits=few)
    same_words(spark, rows, 13, limits=Limits(hot=1))


def test_very_long_text(spark):
    """Two million characters in one document, longer than a piece and a block of records, with a copy of a part of it."""
    r = random.Random(11)
    long = " ".join("u%d" % r.randrange(10**9) for _ in range(200_000))
    part = long[1_500_000:1_501_000]
    rows = [(1, long), (2, "x " + part + " y"), (3, "ab " * 100_000)]
    got = {x.doc_id: x.n_removed for x in suffix_dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 1000, 3: 300_000 - 3}
    got = {x.doc_id: x.n_removed for x in substring_dedup(frame(spark, rows)).collect()}
    whole = len(part.split()) - (not part.startswith(" ") and long[1_499_999] != " ") - (not part.endswith(" ") and long[1_501_000] != " ")
    assert got == {1: 0, 2: whole, 3: 0}


def thue_morse(n, one, other):
    return [one if bin(i).count("1") % 2 else other for i in range(n)]


def test_alternating_sequences_are_told_apart(spark):
    """A polynomial modulo 2**64 takes these for equal, whatever its multiplier."""
    a, b = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    raw = np.frombuffer((a + b).encode(), np.uint8)
    assert len(set(k.word_hashes(raw, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2
    rows = [(1, a + "\nline two\nline three"), (2, b + "\nline two\nline three")]
    assert {x.n_removed for x in line_dedup(frame(spark, rows)).collect()} == {0}
    words = [(i, " ".join(thue_morse(1100, *pair))) for i, pair in ((1, ("a", "b")), (2, ("b", "a")))]
    for L in (13, 30):
        same_words(spark, words, L)
    same_bytes(spark, [(1, a), (2, b), (3, a[:300] + b)], 100)


def test_empty_and_repeated_rows(spark):
    assert suffix_dedup(frame(spark, [])).count() == 0
    assert substring_dedup(frame(spark, [])).count() == 0
    assert line_dedup(frame(spark, [])).count() == 0
    t = "abc def ghi " * 30
    got = suffix_dedup(frame(spark, [(1, t), (1, t), (2, t)])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed < r.n_bytes) for r in got) == [(1, 360, True), (1, 360, True), (2, 360, False)]


def test_rows_without_an_id_keep_their_own_marks(spark):
    r = random.Random(8)
    line = lambda: " ".join("u%d" % r.randrange(10**6) for _ in range(14))
    text = lambda n: "\n".join(line() for _ in range(n))
    a, b, c, shared = text(6), text(9), text(8), text(5)
    rows = [(1, a), (None, a), (None, b), (1, c), (None, shared + "\n" + text(4)), (None, text(3) + "\n" + shared)]
    for run, size in ((suffix_dedup, lambda t: len(t.encode())), (substring_dedup, lambda t: len(t.split())), (line_dedup, lambda t: t.count("\n") + 1)):
        got = {(x.doc_id, x.kept if isinstance(x.kept, str) else bytes(x.kept).decode()): x.n_removed for x in run(frame(spark, rows), with_text=True).collect()}
        kept = lambda t: " ".join(t.split()) if run is substring_dedup else t
        assert len(got) == len(rows)
        assert [got[k, kept(t)] for k, t in (rows[0], rows[2], rows[3])] == [0, 0, 0]  # repeats of nothing
        assert got[None, ""] == size(a)
        # of what the last two share one copy stays
        assert sum(kept(shared) in k for _, k in got) == 1 and sum(v > 0 for v in got.values()) == 2
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    got = {(x.doc_id, x.text) for x in without_repeated_lines(docs).collect()}
    assert len(got) == 5 and {rows[0], rows[2], rows[3]} <= got and (None, a) not in got


def shuffled(spark):
    """Shuffle files of the session: bytes by name."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
    files = [found.apply(i) for i in range(found.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_what_was_shuffled_for_a_table_goes_with_it(spark, monkeypatch):
    """Texts, anchors and suffixes that are shuffled for a table of op1 do not wait for the driver's garbage."""
    r = random.Random(12)
    fresh = lambda n: " ".join("v%d" % r.randrange(10**9) for _ in range(n))
    shared = [fresh(100) for _ in range(4)]
    rows = [(i, fresh(50) + " " + r.choice(shared)) for i in range(50)]
    left, write = {}, op1.table

    def watched(df, name, **how):
        before = shuffled(spark)
        out = write(df, name, **how)
        time.sleep(1)
        left[name] = sum(size for file, size in shuffled(spark).items() if file not in before)
        return out

    monkeypatch.setattr(op1, "table", watched)
    same_bytes(spark, rows, 100, bucket_bytes=20_000)
    assert left == {"anchors": 0, "sample": 0, "suffixes": 0}


def test_few_long_documents_are_sampled_for_buckets(spark, monkeypatch):
    r = random.Random(13)
    fresh = lambda n: " ".join("v%d" % r.randrange(10**9) for _ in range(n))
    shared = fresh(9_000)
    rows = [(1, fresh(9_000) + " " + shared), (2, shared + " " + fresh(9_000))]
    sizes, write = {}, op1.table

    def watched(df, name, **how):
        out = write(df, name, **how)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(op1, "table", watched)
    assert op1.repeated_windows(keyed(frame(spark, rows)), 100, bucket_bytes=100_000).count() > 0
    buckets = -(-sizes["anchors"] * 168 * 0.8 // 100_000)
    assert buckets > 4 and 0.5 < sizes["sample"] / (buckets * op1.SAMPLE) < 2


def test_a_bucket_keeps_one_copy_of_its_bytes():
    """Long suffixes, so that their bytes outweigh what is held for each row."""
    r, L, K, n = np.random.default_rng(14), 280, 32, 20_000
    width = L - K + 1
    size = width + L - 1
    raw = r.integers(97, 123, n * size).astype(np.uint8).reshape(n, size)
    raw[1::2, 200:400] = raw[::2, 200:400]  # pairs share the bytes about the anchor, and no window
    ends = np.arange(n + 1, dtype=np.int32) * size
    body = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw.ravel())])
    fixed = lambda x, kind: pa.array(np.full(n, x, kind))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), fixed(7, np.int64), fixed(0, np.int32), fixed(width * 256 + 248, np.int32), body], names=["doc", "sig", "pos", "meta", "body"])
    run = op1._bucket(L, K, SimpleNamespace(value=np.zeros(0, "S8")))
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 0 and most < 5.5 * raw.nbytes  # half of it for a slice of windows


def test_many_buckets_are_written_by_few_tasks(spark, monkeypatch):
    files, write = {}, op1.table

    def watched(df, name, **how):
        out = write(df, name, **how)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(op1, "table", watched)
    same_bytes(spark, company(6), 100, bucket_bytes=1000)
    assert files["suffixes"] <= 4 * spark.sparkContext.defaultParallelism
