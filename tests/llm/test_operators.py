"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linesift.llm import common, decontam, exact_dedup, html_extract, lang_id, line_dedup, near_dedup, packing, queries, secrets_scan, substring_dedup, textnum, url_filter

from ..oracle import same
from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, score double"
SF = "/root/testdata/sf0.001"


def docs(spark, *texts, ids=None):
    """Texts as documents, with columns whose names the operators use inside."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", None, None, "x", 1, 0.5) for i, t in zip(ids, texts)], DOCS)


def table(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_every_operator_takes_an_empty_table(spark):
    none = docs(spark, "x").limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.PositionalIndex(none, bench).report().count() == 0
    assert lang_id.identify(none, lang_id.fit(none), ["doc_id"]).count() == 0
    assert packing.pack(none, queries.tokenizer_path()).count() == 0
    for f in (secrets_scan.secret_report, near_dedup.near_dedup, substring_dedup.substring_dedup, exact_dedup.exact_dedup, line_dedup.line_dedup):
        assert f(none).count() == 0, f
    assert url_filter.url_verdicts(pages, url_filter.listed_urls(spark)).count() == 0
    assert html_extract.extract(pages).count() == 0


# --- 1 -----------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    item = [word() for _ in range(12)]
    long = " ".join(word() for _ in range(30_000))
    texts = [None, "", "?!", "x " + " ".join(item[:8]).upper() + " y", " ".join(item[:7]), " ".join(item) + ", " + " ".join(item), "Kurz wörter", long + " " + " ".join(item[4:]), "x " + " ".join(item[:8]).upper() + " y"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "kurz; Wörter"), (2, "kurz; Wörter"), (3, None), (None, "x"), (4, " ".join(item[2:11]))], "item_id long, text string")
    index = decontam.PositionalIndex(docs(spark, *texts, ids=[0, 1, 2, 3, 4, 5, None, 7, 3]), bench)
    got = table(index.report(), "doc_id", "n_words", "n_hit", "n_items", "contaminated")
    assert got == sorted([(0, 0, 0, 0, False), (1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 10, 8, 1, False), (3, 10, 8, 1, False), (4, 7, 0, 0, False), (5, 24, 24, 2, True), (None, 2, 2, 1, False), (7, 30_008, 8, 1, False)], key=repr)
    sha = {r["doc_id"]: r["items_sha256"] for r in index.report().collect()}
    assert sha[5] == brute.sha("1,4") and sha[0] == brute.sha("")


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    index = decontam.PositionalIndex(docs(spark, "delta x gamma alpha beta", "alpha q q q q q q q beta gamma delta"), bench, n=4, slack=4)
    assert table(index.near(6), "id") == [(0,)]
    assert index.phrases().count() == 0


# --- 2 -----------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(2)
    words = {"aa": ["ban", "nabo", "abba", "oban"], "bb": ["kri", "skir", "trisk", "irk"]}
    rows = []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(3, 40))), lang))
    rows += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "ban nabo " * 20_000, None), (None, "kri trisk irk", "aa"), (1003, "漢字" * 200, None)]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, lang string, score double")
    model = lang_id.fit(df)
    got = {r["doc_id"]: r for r in lang_id.identify(df, model, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.99 * len(held)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1001]["rejected"]
    assert (got[1002]["lang_pred"], got[1002]["rejected"], got[None]["lang_pred"], got[1003]["rejected"]) == ("aa", False, "bb", True)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[r[0]]["rejected"] for r in rows[:400]) <= 4
    assert {r[0]: r[1] for r in df.select("doc_id", lang_id.held_out(F.col("doc_id"))).collect()} == {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows}


def test_probabilities_sum_to_one():
    """After any context, the probabilities of all known characters and one unknown sum to one."""
    model = lang_id.Model.fit({"x": [" abra cadabra abba "] * 3, "y": [" bib bub "]})
    letters = sorted(set(" abra cadabra abba  bib bub ")) + ["~"]
    for context in (" ab", "abb", "zzz", "cab", " bu", "bra"):
        p = sum(np.exp(model.log_probs(lang_id.coded([context + c])[0])[-1].astype(float)) for c in letters)
        assert np.allclose(p, 1, atol=1e-5), (context, p)


def kneser_ney(train, size, context, c, d=lang_id.DISCOUNT):
    """P(c | context) by the definition, over n-gram counts in a dict; size: characters, with one unknown."""
    n = len(context) + 1

    def count(g):
        if len(g) == lang_id.ORDER:
            return sum(train[i : i + len(g)] == g for i in range(len(train)))
        left = {train[i : i + len(g) + 1] for i in range(len(train) - len(g)) if train[i + 1 : i + len(g) + 1] == g}
        return max(len(left), int(g in train))  # a start of the text has no character before it

    after = {x: count(context + x) for x in set(train) if context + x in train}
    lower = kneser_ney(train, size, context[1:], c) if n > 1 else 1 / size
    if not after:
        return lower
    total = sum(after.values())
    return max(after.get(c, 0) - d, 0) / total + d * len(after) / total * lower


def test_kneser_ney_by_the_definition():
    texts = {"x": " abra cadabra abba arab ", "y": " bib bub abab "}
    model = lang_id.Model.fit({k: [v] for k, v in texts.items()})
    size = len(set("".join(texts.values()))) + 1
    for text in (" abra ", " bubab ", " zab rab ", "b"):
        got = model.log_probs(lang_id.coded([text])[0])
        for k, train in enumerate(texts.values()):
            for i, c in enumerate(text):
                want = kneser_ney(train, size, text[max(0, i - lang_id.ORDER + 1) : i], c)
                assert abs(np.exp(float(got[i, k])) - want) < 1e-5, (text, i, k)


def test_samples_are_bounded_and_fit_every_language(spark):
    rows = [(i, "abba " * 40, "aa") for i in range(200)] + [(1000 + i, "kri " * (5 if i else 50_000), "bb") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    fit, calibrate = lang_id.Model.fit.__func__, lang_id.Model.calibrate

    class Spy(lang_id.Model):
        @classmethod
        def fit(cls, samples):
            seen["fit"] = {k: sum(map(len, v)) for k, v in samples.items()}
            return fit(lang_id.Model, samples)

    try:
        original, lang_id.Model.fit = lang_id.Model.fit, Spy.fit
        lang_id.Model.calibrate = lambda self, held: seen.update(held=sum(map(len, held))) or calibrate(self, held)
        model = lang_id.fit(df, sample_chars=2_000)
    finally:
        lang_id.Model.fit, lang_id.Model.calibrate = original, calibrate
    assert model.langs == ["aa", "bb"] and all(0 < n <= 2_000 for n in seen["fit"].values()) and seen["held"] <= 1_000


def test_kept_columns_may_have_any_names(spark):
    df = spark.createDataFrame([(i, "ban nabo abba", "aa", 0.5, "t", 7) for i in range(9)], "doc_id long, text string, lang string, score double, `a.b` string, c0 int")
    got = lang_id.identify(df, lang_id.fit(df), ["doc_id", "score", "a.b", "c0", "text"])
    assert got.columns == ["doc_id", "score_in", "a.b", "c0", "text", *lang_id.FOUND]
    assert {tuple(r)[1:5] for r in got.collect()} == {(0.5, "t", 7, "ban nabo abba")}


def test_models_reach_workers_without_the_package(spark, tmp_path):
    """The broadcast and the function that is shipped can be loaded where the package can't be imported."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    df = spark.createDataFrame([(i, "ban nabo abba", "aa") for i in range(9)], "doc_id long, text string, lang string")
    (tmp_path / "model").write_bytes(pickle.dumps(lang_id.fit(df).plain()))

    (tmp_path / "run").write_bytes(cloudpickle.dumps(lang_id.judge_rows))
    code = (
        "import pickle, types, pandas as pd\n"
        f"model = pickle.load(open({str(tmp_path / 'model')!r}, 'rb'))\n"
        f"run = pickle.load(open({str(tmp_path / 'run')!r}, 'rb'))(types.SimpleNamespace(value=model))\n"
        "out = next(run([pd.DataFrame({'c0': [1], 'text': ['nabo ban']})]))\n"
        "assert out['lang_pred'][0] == 'aa'\n"
        "import importlib.util; assert importlib.util.find_spec('linesift') is None\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, timeout=120)


# --- 3 -----------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(3)
    texts = [None, "", "<|endoftext|> Don't!", *(" ".join(rng.choices(["the", "Éclair", "x1y2", "naïve", "漢字", "tion,"], k=rng.choice([1, 5, 40, 300, 900]))) for _ in range(60)), "word " * 9000, "a b", "a b"]
    ids = [None, *range(1, len(texts) - 1), len(texts) - 2]
    path = queries.tokenizer_path()
    got = packing.pack(docs(spark, *texts, ids=ids), path).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want, total = [], 0
    for i, t in zip(ids, texts):
        x = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(x)
        want += [(i, p, at, len(x[at : at + 4096]), zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes())) for p, at in enumerate(range(0, len(x), 4096))]
    assert table(spark.createDataFrame(got), "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    alone = sum(r["length"] > 2048 for r in got)  # no two of these share a sequence
    # In this small instance every sequence but the last is full, or as full as its long pieces allow.
    assert len(bins) <= max(-(-total // 4096), alone) + 1
    whole = {r["sequence_id"] for r in got if r["fixed"]}
    assert not whole & {r["sequence_id"] for r in got if not r["fixed"]} and whole


@pytest.mark.parametrize("seed", range(30))
def test_plans_hold_every_piece_and_need_no_more_bins_than_best_fit(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 50, 100])
    counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
    patterns, fixed = packing.plan(counts, cap)
    used: dict = {}
    for bin_, n in patterns:
        assert sum(bin_) <= cap and n > 0
        for w in bin_:
            used[w] = used.get(w, 0) + n
    assert used == counts
    plain = packing.best_fit([((w,), n) for w, n in counts.items()], cap)
    bins, least = sum(n for _, n in patterns), -(-sum(w * n for w, n in counts.items()) // cap)
    assert least <= bins <= sum(n for _, n in plain) and 0 <= fixed <= bins


def fewest_bins(pieces, cap):
    """By trying every bin for every piece, longest first."""
    pieces = sorted(pieces, reverse=True)
    best = [len(pieces)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= pieces[i]:
                left = list(rooms)
                left.remove(r)
                go(i + 1, [*left, r - pieces[i]])
        go(i + 1, [*rooms, cap - pieces[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(120))
def test_dominance_never_costs_a_bin(seed):
    """Fixed sets belong to some best packing: fixed bins and the fewest for the rest are the fewest for all."""
    rng = random.Random(seed)
    cap = rng.choice([12, 20, 31])
    pieces = [rng.randint(rng.choice([1, cap // 5, cap // 4]), cap) for _ in range(rng.randint(1, 9))]
    fixed, rest = packing.reduce_dominated(packing.Counter(pieces), cap)
    assert sorted([w for p, n in fixed for w in p * n] + list(rest.elements())) == sorted(pieces)
    assert all(sum(p) <= cap for p, _ in fixed)
    assert sum(n for _, n in fixed) + fewest_bins(rest.elements(), cap) == fewest_bins(pieces, cap)


def test_dominance_fixes_sets_of_two_partners():
    fixed, rest = packing.reduce_dominated(packing.Counter({40: 7, 31: 7, 28: 7}), 100)
    assert [(sorted(p), n) for p, n in fixed] == [([28, 31, 40], 7)] and not rest


def test_grouped_best_fit_equals_one_by_one():
    for seed in range(40):
        rng = random.Random(seed)
        pieces = sorted((rng.randint(1, 30) for _ in range(60)), reverse=True)
        rooms: list[int] = []
        for w in pieces:
            fits = [r for r in rooms if r >= w]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - w)
            else:
                rooms.append(40 - w)
        grouped = packing.best_fit([((w,), pieces.count(w)) for w in set(pieces)], 40)
        assert sorted(40 - sum(b) for b, n in grouped for _ in range(n)) == sorted(rooms)


# --- 4 -----------------------------------------------------------------------------------


def spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate([("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def test_secrets(spark):
    h = "0123456789abcdef"
    texts = [None, "", f"é😀 token = '{h}{h}' TOKEN: short1 secret:password=abcdefghijklmnop", f"AKIA{'A' * 14} AKIA{'A' * 13} AKIAKIA{'B' * 20}", h * 3 + "\n" + h[:15] + " " + h, "x" * 100_000 + f" api_key={h}", f"é😀 token = '{h}{h}' TOKEN: short1 secret:password=abcdefghijklmnop", "password=" * 50 + h, "token:secret: abcdefghijklmnop"]
    ledger = secrets_scan.BlobLedger(spark)
    df = docs(spark, *texts)
    got = {r["doc_id"]: r for r in secrets_scan.secret_report(df, ledger=ledger).collect()}
    for i, t in enumerate(texts):
        assert got[i]["spans"] == ",".join(spans(t)), (i, got[i])
        assert got[i]["base_sha256"] == brute.sha(",".join(spans(t)))
    assert len(ledger.scanned()) == 7  # empty and null are one blob, and two texts are equal
    again = secrets_scan.BlobLedger(spark, ledger.path, buckets=3)  # keeps its own number of buckets
    more = secrets_scan.secret_report(df.unionByName(docs(spark, f"new {h}", ids=[99])), ledger=again).collect()
    assert {r["doc_id"]: r["spans"] for r in more} == {i: got[i]["spans"] for i in got} | {99: f"hex:4:{4 + len(h)}"}
    assert len(again.scanned()) == 8 and again.scanned("2") == []
    again.ingest(df, version="2").collect()
    assert len(again.scanned()) == 8 and len(again.scanned("2")) == 7


def test_more_kinds_come_after_base_kinds(spark):
    pem = "-----BEGIN RSA PRIVATE KEY-----"
    assert secrets_scan.secret_report(docs(spark, f"a {pem}")).first()["spans"] == f"pem:2:{2 + len(pem)}"


# --- 5 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", 0)
    urls = [None, "", "no scheme.net/x", "http://", "https://A.Example.NET/en/x", "http://a.net", "http://a.net/", "http://a.net?q=/", "http://example.com/de/", "http://badexample.com/de/", "http://x.y.org/fr/#a", "ftp://x.bad.example.com/1", "http://net/", "http://a.net/x\ny", "a://b://c.net/x", "http://a.net/", "http://site2999.test/y", "http://site3000.test/y", "http://h.test/" + "z" * 200_000]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    # A list of 3,000 further sites by rule, of which one is asked for.
    listed = spark.range(3000).select(F.lit("block").alias("verdict"), F.format_string("site%d.test", "id").alias("host"), F.lit("/").alias("path"))
    listed = listed.unionByName(spark.createDataFrame([("block", "bad.example.com", "/"), (None, "a.net", "/")], "verdict string, host string, path string"))
    urls_listed = url_filter.listed_urls(spark, listed=listed)
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_verdicts(pages, urls_listed).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("a.example.net", "/en/x", "example.net/en/", "allow"), 5: ("a.net", "", None, "allow"),
        6: ("a.net", "/", "net/", "block"), 7: ("a.net", "", None, "allow"), 8: ("example.com", "/de/", "example.com/de/", "block"), 9: ("badexample.com", "/de/", None, "allow"), 10: ("x.y.org", "/fr/", "org/fr/", "allow"),
        11: ("x.bad.example.com", "/1", None, "block"), 12: ("net", "/", "net/", "block"), 13: ("a.net", "/x\ny", "net/", "block"), 14: ("b:", "//c.net/x", None, "allow"), 15: ("a.net", "/", "net/", "block"),
        16: ("site2999.test", "/y", None, "block"), 17: ("site3000.test", "/y", None, "allow"), 18: ("h.test", "/" + "z" * 200_000, None, "allow"),
    }
    twice = url_filter.url_verdicts(pages.unionByName(pages), urls_listed)
    assert twice.count() == 2 * len(urls)


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    blocks = common.bloom_blocks(3000)
    assert blocks == 1 << 10 and common.bloom_blocks(0) == 16 and common.bloom_blocks(10**9) == common.MOST_BLOCKS
    bloom = common.blocked_bloom(keys, "k", blocks)
    hit = lambda n: spark.range(*n).filter(common.might_contain(bloom, F.col("id").cast("string"), blocks)).count()
    assert hit((0, 3000)) == 3000 and hit((10_000, 20_000)) < 400


# --- 6 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [2000, 7])
def test_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [word() for _ in range(120)]
    texts: list = [None, "", " \n", "one two", "ONE two", "é two", "É two", "a b c d e"]
    for n in (0, 1, 2, 4, 6, 9) * 6:
        copy = list(base)
        for _ in range(n):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(20_000))] * 2 + [" ".join(word() for _ in range(60)) for _ in range(20)]
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_dedup(docs(spark, *texts), k=4).collect()}
    assert got == brute.near(list(enumerate(texts)), 4)


def test_near_copies_with_odd_ids(spark):
    df = docs(spark, "a b c d e f g", "a b c d e f g", "a b c d e f g", "z", "z", ids=[5, 5, None, 7, 3])
    assert table(near_dedup.near_dedup(df), "doc_id", "component_id", "kept") == sorted([(5, 5, True), (5, 5, True), (None, None, True), (7, 3, False), (3, 3, True)], key=repr)


@pytest.mark.parametrize("block", [2000, 5])
def test_chains_and_groups_across_blocks(spark, block, monkeypatch):
    """A chain of near copies, and two groups that boilerplate brings into one family."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(61)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts, chain = [], [word() for _ in range(60)]
    for i in range(30):
        chain = [*chain[1:], word()] if i % 3 else [*chain[3:], word(), word(), word()]
        texts.append(" ".join(chain))
    common = [word() for _ in range(40)]
    for size in (9, 14):
        own = [word() for _ in range(22)]
        for _ in range(size):
            copy = [*common, *own]
            copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_dedup(docs(spark, *texts), k=4).collect()}
    assert got == brute.near(list(enumerate(texts)), 4)


def thue_morse(n):
    """Two strings of 2**n letters that sums of powers modulo 2**64 can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_near_copies_tell_apart_what_polynomials_do_not(spark):
    a, b = thue_morse(11)
    words = [" ".join(x) for x in thue_morse(11)]
    texts = [f"{a} one", f"{b} one", *words, f"{a} {a} {b} {b}", f"{b} {b} {a} {a}"]
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_dedup(docs(spark, *texts), k=4).collect()}
    assert got == brute.near(list(enumerate(texts)), 4)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 25, 50, 63])
def test_runs_of_words_have_their_own_hashes(n):
    rng = random.Random(n)
    texts = [" ".join(rng.choices(["a", "b"], k=400)).encode(), b"", b" x ", " ".join(rng.choices("abcdé", k=300)).encode()]
    lanes, first = textnum.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert first.tolist() == np.cumsum([0, *(len(t.split()) for t in texts)]).tolist()
    runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    for lane, own in enumerate(lanes):
        hashes = textnum.run_hashes(own, n, lane).tolist()
        assert len(hashes) == len(runs) and len(set(zip(hashes, runs))) == len(set(hashes)) == len(set(runs))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = (" ".join(f"w{i % 97}" for i in range(3000)) + "  ").encode()
    (whole, _), first = textnum.word_hashes([text, b"a b"])
    monkeypatch.setattr(textnum, "CHUNK", 100)
    (parts, _), again = textnum.word_hashes([text, b"a b"])
    assert whole.tolist() == parts.tolist() and first.tolist() == again.tolist()


def test_ids_of_other_types_are_refused(spark):
    df = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    for f in (near_dedup.near_dedup, substring_dedup.substring_dedup, line_dedup.line_dedup):
        with pytest.raises(TypeError, match="integer ids"):
            f(df)


# --- 7 -----------------------------------------------------------------------------------


def test_passages_tell_apart_what_polynomials_do_not(spark):
    a, b = thue_morse(11)
    rest = [f"w{i}" for i in range(49)]
    sentences = [" ".join(x) for x in thue_morse(7)]
    texts = [" ".join([a, *rest]), " ".join([b, *rest]), *sentences, f"x {sentences[0]} y"]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs(spark, *texts), window=50).collect()}
    assert got == removed(texts, 50) and got[1][1] == 0


def removed(texts, window):
    words = [(t or "").encode().split() for t in texts]
    first: dict = {}
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in enumerate(words):
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


@pytest.mark.parametrize("window", [50, 6, 1])
def test_repeated_passages(spark, window):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcé", k=3))
    passage, few = [word() for _ in range(80)], ["the", "of", "a"]
    texts: list = [None, "", "x", " ".join(passage[:50]), " ".join(passage[:49])]
    for _ in range(30):
        a, b = sorted(rng.sample(range(81), 2))
        texts.append("\t".join([word() for _ in range(rng.randint(0, 40))] + passage[a:b] + [word() for _ in range(rng.randint(0, 40))]))
    texts += [" ".join(rng.choices(few, k=300)) for _ in range(6)] + [texts[9], texts[9], " ".join(["the"] * 500), " ".join(["the"] * 120)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs(spark, *texts), window=window).collect()}
    assert got == removed(texts, window)


def test_passages_with_odd_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    got = table(substring_dedup.substring_dedup(docs(spark, t, t, t + " x", ids=[4, 4, None])), "doc_id", "n_removed")
    assert got == sorted([(4, 0), (4, 0), (None, 60)], key=repr)


# --- 8 -----------------------------------------------------------------------------------


def test_exact_copies(spark):
    df = docs(spark, "a", "a", None, "", "A", "b", "b", "b", ids=[1, 9, 3, 4, 5, None, None, 2])
    got = table(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(1, 9, 2, False), (9, 9, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (None, 2, 3, False), (None, 2, 3, False), (2, 2, 3, True)], key=repr)


def test_hot_copies(spark):
    df = docs(spark, *(["same"] * 400 + [f"t{i}" for i in range(300)]))
    got = exact_dedup.exact_dedup(df)
    assert got.filter("kept").count() == 301 and got.filter("group_size = 400 and keep_id = 399").count() == 400


@pytest.mark.parametrize("buckets", [8, None])
def test_index_is_kept_between_batches(spark, tmp_path, buckets):
    """An index is opened again with its own number of buckets, whatever the setting or the argument say."""
    path, texts = f"file://{tmp_path}/index", [f"text {i}" for i in range(40)]
    exact_dedup.DigestIndex(spark, path, buckets=8).ingest(docs(spark, *texts)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = exact_dedup.DigestIndex(spark, path, buckets and 5)
        frame = docs(spark, *texts[:39], "new", ids=range(100, 140)).withColumnRenamed("id", "digest").withColumnRenamed("row", "keep_id")
        got = table(again.ingest(frame), "doc_id", "keep_id", "kept")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted([(100 + i, i, False) for i in range(39)] + [(139, 139, True)], key=repr)
    with again.open() as index:
        assert index.rows().count() == 41 and index.buckets == 8
        plan = index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan  # the buckets spare the shuffle
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


# --- 9 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("question_bytes", [1 << 20, 64])
def test_lines(spark, question_bytes, monkeypatch):
    monkeypatch.setattr(line_dedup, "QUESTION_BYTES", question_bytes)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 5)
    monkeypatch.setattr(line_dedup, "CHUNK_LINES", 7)
    rng = random.Random(9)
    pool = [f"line number {i} of the pool" for i in range(12)] + ["short", "", "  ", "É long enough line"]
    texts: list = [None, "", "\n", "a\n"] + ["\n".join(rng.choice([str, str.upper, lambda s: f" \t{s}\r"])(rng.choice(pool)) for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["\n".join(pool * 400)]
    holders: dict = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    want = {}
    for i, t in enumerate(texts):
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        want[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.line_dedup(docs(spark, *texts)).collect()}
    assert got == want


def test_lines_with_odd_ids(spark):
    got = table(line_dedup.line_dedup(docs(spark, "the same line", "the same line", "the same line", "the same line", ids=[2, 2, None, None])), "doc_id", "n_dropped")
    assert got == sorted([(2, 0), (2, 0), (None, 1), (None, 1)], key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    keys = np.unique(keys)
    at = line_dedup.find(line_dedup.build_hash(keys), keys)
    assert sorted(at.tolist()) == list(range(len(keys)))


# --- 10 ----------------------------------------------------------------------------------


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain <b>text</b>", "plain text"), ("<article><h1>A &amp; B</h1><p>one<br>two  three<p>four</article><footer>f</footer>", "A & B\n\none two three\n\nfour"),
    ("<nav>n</nav><main>x<aside>y</aside><script>if (a<b) {}</script> z</main>", "x\n\nz"), ("<div class='ad'>buy</div><article>a<div id=comments><p>c</div><form>f</form></article>", "a"),
    ("<body><article><p>1 &lt; 2 &#233;<!-- <p>no --></p><p>é</article><p>outside", "1 < 2 é\n\né"), ("<article><p>never closed <b>bold<p>next", "never closed bold\n\nnext"), ("<header>h</header><article><header><h1>t</h1></header>b</article>", "t\n\nb"),
    ("<article><p class='ad'>buy<p>real text</article>", "real text"), ("<ul><li class=share>s<li>item one<li>item two</ul>", "item one\n\nitem two"),
    ("<table><tr><td class=ad>x<td>y<tr><th>z</table>", "y\n\nz"), ("<dl><dt class=promo>x<dd>y<dt>z</dl>", "y\n\nz"), ("<p title=it's>one</p><p>don't lose this</p>", "one\n\ndon't lose this"),
    ("<p title='a > b' hidden>x</p><p data-hidden=1>y", "y"), ("<article><div class='social-science'>a</div><section id='comments-on-kant'>b</section><div class='share-buttons'>c</div></article>", "a\n\nb"),
    ("<p><table><tr><td><p>in</table>after", "in\n\nafter"), ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", "a\n\nb\n\nc\n\nd"), ("<h1 class=banner>x<h2>y</h2>z", "y\n\nz"), ("a <b title=\"x>y</b> z", "a y z"), ("x<style>p</style ><script>a</script\n>y", "x\n\ny"),
    ("<article><p>a<div class=ad>b</div>c</article>", "a\n\nc"), ("<p/>x<div/>y", "x\n\ny"), ("x <span hidden/>y", "x y"),
])
def test_page(page, text):
    lines = html_extract.parse(page)
    own = [x for x, mark in lines if mark == html_extract.OWN]
    assert "\n\n".join(own or [x for x, mark in lines if mark == html_extract.PLAIN]) == text


@pytest.mark.parametrize("seed", range(40))
def test_no_word_of_an_article_is_lost(seed):
    """Pages of random elements, with end tags that are left out where HTML allows it; words outside chrome stay, in order."""
    rng = random.Random(seed)
    words, n = [], iter(range(10_000))

    def inline(keep):
        out = []
        for _ in range(rng.randint(1, 4)):
            w = f"w{next(n)}"
            out.append(rng.choice([w, f"<b>{w}</b>", f'<a href="x>{w}" title=it\'s>{w}</a>', f"<i class=social-science>{w}</i>", f"{w}<br>"]))
            if keep:
                words.append(w)
        return " ".join(out)

    def blocks(depth, keep):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["p", "div", "ul", "table", "chrome", "text", "dl", "h2"])
            if depth > 2 and kind in ("div", "ul", "table"):
                kind = "p"
            if kind == "p":
                out.append(f"<p{rng.choice(['', ' id=comments-on-kant', ' title=don' + chr(39) + 't'])}>{inline(keep)}{rng.choice(['</p>', ''])}")
            elif kind == "div":
                out.append(f"<div>{blocks(depth + 1, keep)}</div>")
            elif kind == "ul":
                out.append("<ul>" + "".join(f"<li>{blocks(depth + 1, keep)}{rng.choice(['</li>', ''])}" for _ in range(2)) + "</ul>")
            elif kind == "table":
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{blocks(depth + 1, keep)}{rng.choice(['</td>', ''])}" for _ in range(2)) for _ in range(2)) + "</table>")
            elif kind == "dl":
                out.append(f"<dl><dt>{inline(keep)}<dd>{inline(keep)}</dl>")
            elif kind == "h2":
                out.append(f"<h2>{inline(keep)}</h2>")
            elif kind == "chrome":
                tag, attribute = rng.choice([("p", " class=ad"), ("div", " class='share-buttons left'"), ("nav", ""), ("form", ""), ("aside", ""), ("div", " role=search")])
                out.append(f"<{tag}{attribute}>{inline(False)}</{tag}>")
            else:
                out.append(f"<div>{inline(keep)}</div>")
        return "".join(out)

    page = f"<html><body><nav>{inline(False)}</nav><article>{blocks(0, True)}</article><footer>{inline(False)}</footer>"
    got = " ".join(x for x, mark in html_extract.parse(page) if mark == html_extract.OWN).split()
    assert got == words


def differenced(rows):
    """What extract() returns, by looking at every page of the host."""
    out = {}
    parsed = {i: (url_parts_of(u), html_extract.parse(h or "")) for i, u, h in rows}
    for i, ((host, path), lines) in parsed.items():
        key = lambda j: (parsed[j][0][1], j)
        others = [j for j, ((h, _), x) in parsed.items() if h == host and host and [t for t, _ in x] != [t for t, _ in lines]]
        before, after = max((j for j in others if key(j) < key(i)), key=key, default=None), min((j for j in others if key(j) > key(i)), key=key, default=None)
        near = [j for j in (before, after) if j is not None]
        nearest = max(near, key=lambda j: html_extract.alike(parsed[j][0][1], path), default=None)
        shared = html_extract.common([t for t, _ in lines], [t for t, _ in parsed[nearest][1]]) if nearest is not None else set()
        own, plain = [t for t, m in lines if m == html_extract.OWN], [t for k, (t, m) in enumerate(lines) if m == html_extract.PLAIN and k not in shared]
        text = "\n\n".join(own or plain or [t for t, m in lines if m == html_extract.PLAIN])
        out[i] = (text, len(text), nearest, len(shared))
    return out


def url_parts_of(url):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", "")


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_pages_by_brute_force(spark, parts):
    rng = random.Random(10)
    rows = []
    for i in range(90):
        host = rng.choice(["a.net", "b.org", "A.net", ""])
        menu = [f"menu {k} of {host.lower()}" for k in range(rng.randint(2, 4))]
        body = [rng.choice([f"own text {rng.randint(0, 30)}", "a paragraph that several pages share"]) for _ in range(rng.randint(0, 3))]
        page = "".join(f"<div>{x}</div>" for x in menu) + rng.choice(["{}", "<article>{}</article>"]).format("".join(f"<p>{x}" for x in body)) + "<div>legal</div>"
        rows.append((i, f"http://{host}/{rng.choice('xyz')}/{rng.randint(0, 9)}" if host else rng.choice([None, "no url"]), page))
    rows += [(100 + i, "http://c.net/same", "<div>the same page</div>") for i in range(40)] + [(200, "http://c.net/z", "<div>the same page</div><p>and more</p>"), (201, "http://c.net/a", None)]
    df = spark.createDataFrame([(*r, 7, "p") for r in rows], "page_id long, url string, html string, text int, path string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["page_id"]: (r["text"], r["n_chars"], r["neighbour"], r["n_shared"]) for r in html_extract.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == differenced(rows)


def test_the_given_pages_by_brute_force(spark):
    """Each given page marks its article; the words between its tags are the text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = {r["page_id"]: (r["text"], r["n_chars"], r["neighbour"], r["n_shared"]) for r in html_extract.extract(pages).collect()}
    assert got == differenced(rows)
    for i, _, page in rows:
        inside = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        assert got[i][0].split() == re.sub(r"<[^>]*>", " ", inside).replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&").split()


def test_differencing_never_empties_a_page(spark):
    menu = "".join(f"<div>menu {i}</div>" for i in range(4))
    rows = [(i, f"http://h.net/a/{i}", f"{menu}<p>own text {i}</p><div>legal</div>") for i in range(5)] + [(7, "http://h.net/a/7", f"{menu}<div>legal</div>"), (8, "http://k.net/", "<p>x"), (9, "http://k.net/", "<p>x"), (9, "http://k.net/", "<p>x")]
    rows += [(13, "http://lone.org/", f"{menu}<p>{'long ' * 200_000}")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"own text {i}" for i in range(5)] and got[7].startswith("menu 0") and got[8] == got[9] == "x" and len(got[13]) > 10**6


@pytest.mark.parametrize("seed", range(20))
def test_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "xy")
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    got = html_extract.common(a, b)
    rest = iter(b)
    assert len(got) == best[-1][-1] and all(a[i] in rest for i in sorted(got))


def test_digest_helpers():
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
