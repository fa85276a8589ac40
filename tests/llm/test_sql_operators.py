"""Operators against their SQL on the tables; 4, 8 and 9 on made ones too."""

import random

import duckdb
import pytest

from quietfield.llm import catalog
from quietfield.llm import op4_line_dedup as op4
from quietfield.llm import op8_source_mix as op8
from quietfield.llm import op9_url_filters as op9

DATA = "/root/testdata/sf0.001"


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con.sql(sql).fetchall()


def rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def test_lines(spark):
    r = random.Random(1)
    pool = ["l%d" % i for i in range(9)] + ["", " ", "é x", "\t"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(150)] + [(150, None), (151, "\n\n\n")]
    df = spark.createDataFrame([(a, b, 2) for a, b in docs], "doc_id long, text string, n_lines int").repartition(4)
    cols = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    assert rows(op4.line_dedup(df), cols) == sorted(oracle(op4.SQL, documents=df.select("doc_id", "text")), key=str)
    cut = op4.without_repeated_lines(df)
    assert cut.columns == df.columns
    assert op4.line_dedup(df.limit(0)).count() == 0
    kept = {x.doc_id: x.kept for x in op4.line_dedup(df, with_text=True).collect()}
    for x in cut.collect():
        assert (x.text or "") == kept[x.doc_id]


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), "s%d" % min(9, int(r.expovariate(0.4)))) for i in range(4500)]
    docs += [(5000, None, "s1"), (5001, "a b", None), (5002, "a", "empty"), (5003, "", "zero")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 900)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    got = op8.mix(df, labels)
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert rows(got, cols) == sorted(oracle(op8.SQL, documents=df.select("doc_id", "text", "source"), labels=labels), key=str)
    per = {}
    for x in got.collect():
        assert 0 <= x.taken <= 3 * x.size
        per.setdefault(x.source, [x.target, x.source_size, 0])[2] += x.taken
    assert all(abs(t - n) <= 1 for t, _, n in per.values())
    assert abs(sum(t for t, _, _ in per.values()) - sum(s for _, s, _ in per.values())) < 1e-6
    assert op8.mix(df.limit(0), labels).count() == 0


def brute_targets(sizes):
    total, names = sum(sizes.values()), sorted(sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, free, left = {}, set(names), total
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return goal | share
        for s in over:
            goal[s] = 3 * sizes[s]
            left -= goal[s]
        free -= over


def test_targets(spark):
    for seed in range(4):
        r = random.Random(seed)
        sizes = {"s%02d" % i: r.choice([0, 1, 10, 100, 10000]) + r.randint(0, 9) for i in range(r.randint(1, 12))}
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
        got = {x.source: x.target for x in op8.targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def test_urls(spark):
    urls = ["http://a.example.com/en/1?x=/", "https://WWW.Example.com/en/", "http://www.example.com/en", "ftp://x.net/es/a#b", "http://net/fr/", "http://adult-x.example.net/en/?q", "http://m.adult-x.example.net/", "http://xadult-x.example.net/", "http://a.casino-win.example.com", "no scheme", None, "http://", "http://com", "http://com/", "http://notcom/", "x://y://z.com/p", "http://u?a/b", "http://spam.net/es/x", "http://m.www.example.com/en/q"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)] + [(None, "http://spam.x", "h")], "page_id long, url string, host string").repartition(2)
    listed = spark.createDataFrame([(h,) for h in (*op9.LISTED_HOSTS, "spam-farm.example.com", None)], "key string")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(oracle(op9.SQL, pages=df.select("page_id", "url")), key=str)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    for most in (op9.MAX_SHARDS, 0):  # filters as literals, and asked by join
        assert rows(op9.filter_urls(df, listed, max_shards=most), cols) == want
    assert op9.filter_urls(df.limit(0), listed.limit(0)).count() == 0
    assert {x.verdict for x in op9.filter_urls(df, listed.limit(0), rules=[]).collect()} == {"allow"}


def test_cascade_is_exact_in_shards_and_by_join(spark, monkeypatch):
    monkeypatch.setattr(op9, "SHARD", 5)
    monkeypatch.setattr(op9, "BITS_PER_KEY", 4)
    keys = spark.range(6000).selectExpr("concat('h', id) as key", "id % 7 = 0 as listed")
    for most in (1000, 0):
        cascade = op9.Cascade(keys, most)
        assert len(cascade.levels) >= 3 and cascade.sent == (most > 0)
        asked = cascade.ask(keys.union(keys.limit(9)), "key")
        assert asked.count() == 6009 and asked.where("_listed <> listed").count() == 0


def test_cascade_grows_with_the_list(spark):
    """A list of 400,000 keys: no bound on the bits, so the levels shrink."""
    keys = spark.range(800_000).selectExpr("concat('host', id, '.example.org') as key", "id % 2 = 0 as listed")
    cascade = op9.Cascade(keys)
    assert cascade.ask(keys, "key").where("_listed <> listed").count() == 0
    assert len(cascade.levels) < 20 and cascade.levels[0].words * 64 >= 16 * 400_000


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_on_tables(spark, name):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, want.columns) == sorted(want.fetchall(), key=str)
