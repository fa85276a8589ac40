"""The pipeline against its operators' plain versions on a small corpus."""

import random
import re

import corpus_pipeline
from quietfield.llm import op6_quality_rules as op6
from test_jaccard import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(tmp_path, spark):
    r = random.Random(9)
    vocab = ["w%d" % i for i in range(400)]
    text = lambda n: "\n".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(n // 12))
    item = " ".join(r.choice(vocab) for _ in range(30))
    shared = text(36)
    docs = []
    for i in range(120):
        t = text(r.choice([60, 120, 240]))
        if i % 7 == 0 and docs:
            w = docs[r.randrange(len(docs))][1].split(" ")
            w[r.randrange(len(w))] = "edited"
            t = " ".join(w)
        if i % 11 == 0:
            t = t + "\n" + shared
        if i % 13 == 0:
            t = item + "\n" + t
        if i % 17 == 0:
            t = "too short"
        docs.append((i, t, "en", "s%d" % (i % 4), len(t)))
    docs += [(200, None, None, None, None), (201, "", "en", "s1", 0), (None, text(120), "en", "s1", 5)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, cols).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def brute_lines(docs):
    """Texts without lines of three-line windows that start earlier; in order of id, null last."""
    seen, out = set(), []
    for d in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        if d[1] is None:
            out.append(d)
            continue
        lines = d[1].split("\n")
        full = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(full) - 2):
            w = tuple(lines[i] for i in full[k : k + 3])
            if w in seen:
                gone |= set(full[k : k + 3])
            seen.add(w)
        t = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or len(gone) < len(full):
            out.append((d[0], t, d[2], d[3], len(t) if gone else d[4]))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, tmp_path):
    docs = make(tmp_path, spark)
    sf = str(tmp_path)
    own = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, own, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in op6.quality(own, labels).where("kept").collect()}
    want = [d for d in docs if d[0] in good]
    assert kept.columns == own.columns and rows(kept) == sorted(want, key=str)
    assert {d[0] for d in docs if d[1] and len(d[1].split()) >= 50} == good  # clean documents stay
    kept = corpus_pipeline.table(kept, "t")
    cut = corpus_pipeline.table(stage["line_dedup"](spark, kept, sf), "t")
    want = brute_lines(want)
    assert cut.columns == own.columns and rows(cut) == sorted(want, key=str)
    one = corpus_pipeline.table(stage["near_duplicates"](spark, cut, sf), "t")
    by = {r[0]: r for r in want if r[0] is not None}
    heads = {g[2] for g in brute([(k, v[1]) for k, v in by.items()])}
    assert one.columns == own.columns and {r for r in rows(one) if r[0] is not None} == {by[h] for h in heads}
    assert sum(r[0] is None for r in rows(one)) == 1
    clean = corpus_pipeline.table(stage["decontamination"](spark, one, sf), "t")
    assert clean.columns == own.columns
    before, after = {r.doc_id: r.text for r in one.collect()}, {r.doc_id: r.text for r in clean.collect()}
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    for k, t in before.items():
        share = 30 / len(t.split()) if item in t else 0
        assert (k not in after) == (share >= 0.05)
        assert k not in after or share or after[k] == t
    out = stage["source_mix"](spark, clean, sf)
    assert {r.doc_id for r in out.collect()} <= set(after) and all(r.taken > 0 for r in out.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(out)


def test_empty(spark, tmp_path):
    make(tmp_path, spark)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_near_duplicates_without_or_with_repeated_ids(spark, tmp_path):
    r = random.Random(4)
    text = lambda n: " ".join("u%d" % r.randrange(10**6) for _ in range(n))
    a, b, c, d, e = (text(60) for _ in range(5))
    keep = [(1, a), (2, b), (None, c), (None, d), (5, e), (5, text(40)), (None, None), (None, " ")]
    gone = [(None, a), (3, b), (None, a + " x"), (None, c)]
    docs = [(i, t, "en", "s1", 9) for i, t in keep + gone]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path))
    assert rows(got) == sorted([(i, t, "en", "s1", 9) for i, t in keep], key=str)


def test_clashing_columns(spark, tmp_path):
    """Columns with names of the operators' own, with dots and of map type go through every stage unharmed."""
    make(tmp_path, spark)
    sf = str(tmp_path)
    F = corpus_pipeline.F
    own = ["_kept", "_row", "_node", "_tie", "_c0", "cover", "sig", "doc", "node", "size", "a.b", "n_words", "cut_text"]
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    docs = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in own], F.create_map(F.lit("k"), F.col("doc_id")).alias("labels"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, docs = (corpus_pipeline.table(stage(spark, d, sf), "t") for d in (plain, docs))
        assert docs.columns == [*plain.columns, *own, "labels"], name
        assert rows(docs.select(*plain.columns)) == rows(plain), name
        for r in docs.collect():
            assert r["_row"] == (None if r.doc_id is None else f"_row{r.doc_id}") and r["a.b"] == (None if r.doc_id is None else f"a.b{r.doc_id}") and r.labels == {"k": r.doc_id}
    assert corpus_pipeline.source_mix(spark, docs, sf).count() == corpus_pipeline.source_mix(spark, plain, sf).count()


def test_against_sql(spark):
    """The whole pipeline over the smallest tables."""
    import os

    import duckdb
    import pytest

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(corpus_pipeline.ORACLE_SQL)
    got = corpus_pipeline.run(spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*want.columns)) == sorted(want.fetchall(), key=str) and got.count() > 0
