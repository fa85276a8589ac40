"""Operator 10 against a search for every window in every document."""

import hashlib
import random
import re

from quietfield.llm.op10_decontamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, L):
    wins = {}
    for item, t in items:
        w = words(t)
        if t is None or not w:
            continue
        for p in range(len(w) - L + 1) if len(w) >= L else [0]:
            wins.setdefault(tuple(w[p : p + L]), set()).add(item)
    sizes = {len(x) for x in wins}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in wins:
                    hit[p : p + n] = [True] * n
                    found |= wins[x] - {None}
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def test_matches_every_window(spark):
    r = random.Random(4)
    vocab = ["a", "b", "é", "d9", "the"]
    for L in (13, 4):
        items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 12, 13, 14, 30])) if True) if i % 4 else "x%d y z " % i * 9) for i in range(2, 30)]
        items += [(40, None), (41, "..."), (None, "a b"), (3, "q q q q q")]
        items = [(i, t) for i, t in items if not (t and len(words(t)) < 3)] + [(50, "zz top")]
        docs = []
        for d in range(120):
            w = [r.choice([*vocab, "other", "zz", "top"]) for _ in range(r.randint(0, 60))]
            if r.random() < 0.5:
                s = words(r.choice(items)[1])
                c = r.randint(0, max(0, len(s) - 1))
                w += [x.upper() for x in s[c : c + r.randint(1, 20)]]
            docs.append((d, "-".join(w) + ".\n" + " ".join(w[::-1])))
        docs += [(200, None), (201, ""), (None, "zz top"), (7, "zz  Top!")]
        df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, n_words int").repartition(3)
        it = spark.createDataFrame(items, "item_id long, text string")
        for most in (500_000, 40):  # one automaton, and many with long items in pieces
            got = contamination(df, it, L, max_words=most).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(docs, items, L)))


def test_very_long_and_alternating(spark):
    r = random.Random(9)
    long = " ".join("w%d" % r.randrange(10**6) for _ in range(60_000))
    morse = lambda a, b: "".join((a, b)[bin(i).count("1") % 2] for i in range(1024))
    items = [(1, " ".join(long.split()[59_000:59_020])), (2, long + " end"), (3, morse("a", "b"))]
    docs = [(1, long), (2, "x " * 100_000 + " ".join(long.split()[100:140])), (3, morse("b", "a")), (4, morse("a", "b"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = contamination(df, spark.createDataFrame(items, "item_id long, text string"), max_words=20_000).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(docs, items, 13)))


def test_cut_text_and_empty(spark):
    it = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Say: one, Two three! and é go."), (2, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.cut_text for r in contamination(df, it, with_text=True).collect()}
    assert got == {1: "Say: ! and é go.", 2: None}
    assert contamination(df.limit(0), it).count() == 0
    assert [r.n_hit for r in contamination(df, it.limit(0)).collect()] == [0, 0]
