"""The pipeline's stages against brute force on a small corpus."""

import random

import corpus_pipeline

from . import brute


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = {"en": ["the", "then", "other", "earth", "thing", "ration"], "de": ["ich", "schein", "einig", "pfund", "zeit", "auch"]}
    text = lambda lang, n: " ".join("".join(rng.sample(words[lang], 2)) for _ in range(n))
    rows = [(i, text("en" if i % 3 else "de", rng.randint(30, 90)), "en" if i % 3 else "de", "s", 1) for i in range(300)]
    item = " ".join(rng.sample("abcdefghijklmnop", 12)) + " earthration thething"
    rows += [(1000, rows[3][1], "de", "s", 1), (1001, rows[4][1] + " tail", "en", None, 1), (1002, text("en", 40) + " " + item + " " + text("en", 40), "en", "s", 1), (1003, None, "en", "s", 1), (1004, "12 34", "en", "s", 1), (1005, "漢字" * 60, None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        ids[name] = {r["doc_id"] for r in docs.collect()}
        assert name == "packing" or docs.columns == columns
    every = {r[0] for r in rows}
    gone = every - ids["language_id"]
    assert {1003, 1004, 1005} <= gone and len(gone) <= 6
    assert ids["language_id"] - ids["exact_dedup"] == {3} & ids["language_id"]  # the larger id of equal texts stays
    left = [(r[0], r[1]) for r in rows if r[0] in ids["exact_dedup"]]
    assert ids["near_dedup"] == {i for i, (_, _, kept) in brute.near(left, 5, 80).items() if kept}
    assert ids["near_dedup"] - ids["decontamination"] == {1002} & ids["near_dedup"]
    assert ids["packing"] == ids["decontamination"]


def test_rows_that_share_an_id_go_by_their_own_text(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30))
    item, clean, other, copy, last = text(), text(), text(), text(), text()
    bad = [f"{text()} {item} {text()}" for _ in range(3)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = lambda *rows: spark.createDataFrame([(i, t, "en", 7, 8) for i, t in rows], "doc_id long, text string, lang string, id long, row long")
    rows = lambda df: sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=repr)
    docs = table((None, clean), (None, bad[0]), (None, bad[1]), (None, None), (5, other), (5, bad[2]), (6, last), (6, last), (7, bad[0]))
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and rows(got) == sorted([(None, clean), (None, None), (5, other), (6, last), (6, last)], key=repr)
    docs = table((3, copy), (5, copy.upper()), (5, other), (None, copy), (None, clean), (6, last), (6, last))
    got = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and rows(got) == sorted([(3, copy), (5, other), (None, copy), (None, clean), (6, last), (6, last)], key=repr)


def test_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, nulls in every column, very long texts, and columns with the operators' names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, score double, text_sha256 string, c0 int, `a.b` string"
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    long, item, more = text(60_000), text(30), (None, None, None, None, None, "t", 1, None)
    bench = spark.createDataFrame([(1, item), (None, text(9)), (2, None)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, long, "en", *more), (2, long + " end", "en", *more), (3, f"{long} {item}", "en", *more), (4, text(50), "en", *more), (4, None, None, *more), (None, text(50), None, *more), (None, None, "en", *more)]
    for given in ([], [*rows, *rows]):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        ids = sorted({r["doc_id"] for r in docs.collect()}, key=repr)
        assert ids == ([1, 4, None] if given else []), name
    none = spark.createDataFrame([], bench.schema)
    none.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, schema), f"{tmp_path}/none").count() == len(rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fixed"] and out.count() > 100
