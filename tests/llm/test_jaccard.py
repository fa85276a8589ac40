"""Operator 2 against all pairs on small corpora of edited copies."""

import random
import re

import quietfield.llm.op2_ngram_jaccard as op2

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sets(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    low = list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(s[a] & s[b])
            if s[a] and s[b] and 100 * i >= 75 * (len(s[a]) + len(s[b]) - i):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return sorted((rows[a][0], len(s[a]), rows[root(a)][0]) for a in range(len(rows)))


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["v%d" % i for i in range(300)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 8, 20, 60, 150]))] for _ in range(n // 12)]
    hot = [r.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = w + hot
        if r.random() < 0.2:
            w = w[: r.randint(1, len(w))]
        rows.append((i, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows + [(n, None), (n + 1, " \n"), (n + 2, "one"), (n + 3, "ONE"), (n + 4, "two")]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n long").repartition(5)


def test_matches_all_pairs(spark):
    rows = corpus(1, 240)
    got = sorted(map(tuple, op2.jaccard_groups(frame(spark, rows)).collect()))
    assert got == brute(rows)


def test_square_tiles_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(op2, "TILE", 7)
    monkeypatch.setattr(op2, "FREQUENT", 2)
    monkeypatch.setattr(op2, "TOKEN_ROWS", 500)
    rows = corpus(2, 240)
    got = sorted(map(tuple, op2.jaccard_groups(frame(spark, rows)).collect()))
    assert got == brute(rows)


def test_large_groups_have_leaders(spark, monkeypatch):
    """One family of near copies in chains and another around one text; tiles of a few members."""
    monkeypatch.setattr(op2, "LEAD", 4)
    monkeypatch.setattr(op2, "TILE", 9)
    monkeypatch.setattr(op2, "FREQUENT", 10**6)
    r = random.Random(5)
    words = ["z%d" % i for i in range(120)]
    rows = []
    for i in range(150):  # a chain: each differs a little from the one before, so the ends do not link
        words[r.randrange(len(words))] = "c%d" % i
        rows.append((i, " ".join(words)))
    for i in range(150, 260):
        own = ["y%d" % j for j in range(90)]
        own[r.randrange(90)] = "d%d" % i
        rows.append((i, " ".join(own)))
    rows += [(i + 500, t) for i, t in rows[::40]]
    r.shuffle(rows)
    got = sorted(map(tuple, op2.jaccard_groups(frame(spark, rows)).collect()))
    assert got == sorted(brute(sorted(rows)))


def test_hot_keys_are_looked_up_whole(spark, monkeypatch):
    from quietfield.llm import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 2)
    monkeypatch.setattr(runtime, "HOT_KEYS", 50)
    rows = corpus(3, 200) + [(1000 + i, "the very same text in many rows of the table") for i in range(90)]
    got = sorted(map(tuple, op2.jaccard_groups(frame(spark, rows)).collect()))
    assert got == sorted(brute(sorted(rows)))


def test_very_long_and_alternating_texts(spark):
    one, two = "alpha ", "beta "
    morse = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = "".join((one, two)[m] for m in morse), "".join((two, one)[m] for m in morse)
    r = random.Random(6)
    long = " ".join("u%d" % r.randrange(10**9) for _ in range(150_000))
    rows = [(1, "ab" * 4000), (2, "ba" * 4000), (3, "".join("ab"[m] for m in morse)), (4, "".join("ba"[m] for m in morse)), (5, long), (6, long + " tail"), (7, a), (8, b)]
    got = sorted(map(tuple, op2.jaccard_groups(frame(spark, rows)).collect()))
    assert got == brute(rows)


def test_empty_and_repeated(spark):
    assert op2.jaccard_groups(frame(spark, [])).count() == 0
    got = op2.jaccard_groups(frame(spark, [(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "z")])).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, 1, 5), (5, 1, 5), (None, 1, 5), (7, 1, 7)]))


def test_rows_without_an_id_link_by_their_own_texts(spark):
    r = random.Random(7)
    text = lambda n: " ".join("u%d" % r.randrange(10**6) for _ in range(n))
    a, b, c, d = text(40), text(90), text(60), text(200)
    near = d + " more words"
    rows = [(1, a), (2, b), (3, c), (None, a), (None, b), (None, d), (8, near), (9, c), (9, text(30)), (10, None), (None, None), (None, text(50))]
    got = op2.jaccard_groups(frame(spark, rows)).collect()
    want = [(1, 36, 1), (2, 86, 2), (3, 56, 3), (None, 36, 1), (None, 86, 2), (None, 196, 8), (8, 198, 8), (9, 56, 3), (9, 26, 9), (10, 0, 10), (None, 0, None), (None, 46, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
