"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, decontaminate, jaccard, language_id, lm_score, mixing, page_text, quality, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder".split()


def corpus(n=120, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        words = [r.choice(EN if lang == "en" else DE) for _ in range(r.randint(5, 120))]
        rows.append((i, " ".join(words), lang, f"s{i % 3 if i % 5 else 0}", 0))
    rows += [(1000, None, "en", "s1", None), (1001, "", None, None, 0), (1002, "?!  ..", "en", "s2", 5), (1003, rows[3][1], "en", "s1", 0), (1004, rows[3][1], "en", "s1", 0)]
    rows += [(1005, " ".join(rows[7][1].split() * 400), "en", "s0", 0), (None, "and the of", "en", "s0", 0), (5, rows[5][1], rows[5][2], "s2", 0)]
    return [(a, b, c, d, len(b) if b else e) for a, b, c, d, e in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 10 != 0), int(i % 7 == 0)) for i in range(0, 110)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def clash(df):
    """With columns that operators might use themselves."""
    return df.withColumn("score", F.lit("x")).withColumn("LANG_PRED", F.lit(1)).withColumn("n_words", F.lit("y")).withColumn("k0", F.lit(2)).withColumn("h", F.lit(3))


# --- hashing, components --------------------------------------------------------------------------


def test_hash_table():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 5000).astype(np.uint64))
    t = common.HashTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1)) == -1).sum() > 4900
    assert (common.HashTable(np.zeros(0, np.uint64)).find(keys) == -1).all()


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 quality -------------------------------------------------------------------------------------


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney by its definition: a function of (u, v, w)."""
    c3 = collections.Counter()
    for t in texts:
        s = ["<s>", "<s>", *t.split(), "</s>"]
        if len(s) > 3:
            c3.update(zip(s, s[1:], s[2:], strict=False))
    c2 = collections.Counter()
    for (u, v, w), c in c3.items():
        c2[v, w] += c if v == "<s>" else 1
    c1 = collections.Counter(w for _, w in c2)

    def discounts(c):
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return 0.5, 0.5, 0.5
        y = n[0] / (n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
        return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]

    d1, d2, d3 = map(discounts, (c1, c2, c3))
    cut = lambda d, c: d[min(c, 3) - 1]
    t1 = sum(c1.values())
    g1 = sum(cut(d1, c) for c in c1.values()) / t1
    t2, g2, t3, g3 = (collections.Counter() for _ in range(4))
    for (v, _), c in c2.items():
        t2[v] += c
        g2[v] += cut(d2, c)
    for (u, v, _), c in c3.items():
        t3[u, v] += c
        g3[u, v] += cut(d3, c)

    def p(u, v, w):
        x = (c1[w] - cut(d1, c1[w]) if c1[w] else 0) / t1 + g1 / (len(c1) + 1)
        if t2[v]:
            x = (c2[v, w] - cut(d2, c2[v, w]) if c2[v, w] else 0) / t2[v] + g2[v] / t2[v] * x
        if t3[u, v]:
            x = (c3[u, v, w] - cut(d3, c3[u, v, w]) if c3[u, v, w] else 0) / t3[u, v] + g3[u, v] / t3[u, v] * x
        return x

    return p


def test_quality_model_is_kneser_ney(spark):
    texts = [t for _, t, *_ in corpus(30, 9) if t and len(t) < 2000]
    p = brute_kneser_ney(texts)
    model = quality.Model(*quality.model_terms(spark.createDataFrame([(t,) for t in texts], "text string")))
    tests = [*texts[:5], "the of xyzzy and", "xyzzy", "die und the und"]
    got = quality.score(spark.createDataFrame(list(enumerate(tests)), "i int, text string"), model, ["i"]).collect()
    for r in got:
        s = ["<s>", "<s>", *tests[r["i"]].split(), "</s>"]
        logp = sum(math.log(p(*g)) for g in zip(s, s[1:], s[2:], strict=False))
        assert r["perplexity"] == pytest.approx(math.exp(-logp / (len(s) - 2)), rel=1e-4)


def test_quality(spark, docs, rows, labels, empty):
    got = quality.classify(clash(docs), labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["perplexity"] is None and not by[1000]["keep"] and not by[1001]["keep"]
    assert by[1003]["perplexity"] == by[1004]["perplexity"]
    assert sum(r["keep"] for r in got) > 0.8 * len(rows)
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(docs, labels.where("false")).collect()
    assert all(r["perplexity"] is None for r in none) and sum(r["keep"] for r in none) == sum(bool(t and t.split()) for _, t, *_ in rows)
    kept = quality.keep_good(clash(docs), labels)
    assert kept.columns == clash(docs).columns and kept.count() == sum(r["keep"] for r in got)


def test_quality_learns_from_a_window_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_CHARS", 300)
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(EN, k=2000)), "en", "s", 0) for i in range(80)] + [(100, " ".join(f"zz{i}" for i in range(500)), "en", "s", 0)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model, rate = quality.train(spark.createDataFrame(rows, DOCS), labels)
    assert model and rate == 0.5
    by = {x["doc_id"]: x for x in quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert sum(x["keep"] for x in by.values()) >= 78 and by[100]["perplexity"] > 2 * by[1]["perplexity"] and not by[100]["keep"]


def test_filter_has_all_that_was_added():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2)
    f = quality.Filter(len(h))
    f.add(h)
    assert f.has(h).all() and f.has(h + np.uint64(1)).mean() < 0.05


def test_searched_code_lengths_equal_the_tables(monkeypatch):
    texts = {"a": ["the cat sat on the mat".encode(), b"the hat"], "b": ["der hund läuft".encode()], "c": [b"x"]}
    dense = language_id.ContextTrees(texts)
    monkeypatch.setattr(language_id, "MAX_CELLS", 0)
    sparse = language_id.ContextTrees(texts)
    assert dense.dense and not sparse.dense and dense.order == sparse.order == language_id.MAX_ORDER
    some = [b"", b"the mat", "läuft zzz".encode(), b"\xff\x00q", b"the cat " * 50]
    assert np.allclose(dense.bits(some), sparse.bits(some), rtol=1e-5)


def test_languages_of_long_rows_are_learned(spark):
    rows = [(i, " ".join(random.Random(i).choices(EN, k=60)), "en", "s", 0) for i in range(40)]
    rows += [(100 + i, " ".join(random.Random(i).choices(DE, k=12_000)), "de", "s", 0) for i in range(4)]
    model = language_id.train(spark.createDataFrame(rows, DOCS))
    assert model.langs == ["de", "en"]
    assert language_id.train(spark.createDataFrame(rows, DOCS).where("false")).langs == []


# --- 2 archives --------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "u", None), (4, "u", ""), (5, "u\r\nInjected: 1", "é" * 600), (6, "u", "small"), (7, "u", "small"), (9, None, big), (None, "u", big), (8, "u", "é" * 600)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = sorted(warc.round_trip(df).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert len(got) == len(rows)
    want = {1: 9, 2: 9, None: 9, 5: 8}
    for r in got:
        html = next(h for p, _, h in rows if p == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert r["refers_to"] == want.get(r["page_id"]) and r["record_type"] == ("revisit" if r["page_id"] in want else "response")
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_format(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{'word ' * (i % 50)}{i}</html>") for i in range(60)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(df.repartition(1), path)
    data = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")).read_bytes()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert len(list(warc.read_archive(data))) == 60
    back = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path).collect()}
    warc.write_archives(df.repartition(1), path + "-small", archive_bytes=500)
    files = sorted(pathlib.Path(path + "-small").glob("part-*"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) < 500 + max(len(p or b"") for p in back.values()) + len(warc.dictionary_frame(b"x" * warc.DICTIONARY_BYTES)) + 2000
    assert {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path + "-small").collect()} == back
    ids = {r["fields"]["warc-record-id"]: r["fields"] for f in files for r in warc.read_archive(f.read_bytes())}
    assert all(f["warc-refers-to"] in ids for f in ids.values() if f["warc-type"] == "revisit")
    assert back == {r["page_id"]: r["html"].encode() for r in df.collect()}


def test_warc_rejects_damage():
    rec = warc.encode_record("response", "u", "1" * 8, b"hello", hashlib.sha1(b"hello").hexdigest(), None, {})
    assert warc.decode_record(rec)["payload"] == b"hello"
    for bad in (rec[:-1], rec + b"x", rec.replace(b"hello", b"jello"), rec.replace(b"Content-Length: 5\r", b"Content-Length: 6\r"), b"X" + rec, rec.replace(b"WARC-Date", b"WARC-Dat "), rec.replace(b"WARC-Record-ID: ", b"Other: ")):
        with pytest.raises(warc.WarcError):
            warc.decode_record(bad)
    import zstandard

    frame = zstandard.ZstdCompressor().compress(rec)
    assert len(list(warc.read_archive(frame + warc.SEPARATOR + frame))) == 2
    for bad in (frame[:-3], frame + b"\0\0", frame + warc.dictionary_frame(b""), b"abcdefghij"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))


# --- 3 joins ------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((str(i), len(s), str(least.get(root(k), i))) for k, (i, s) in enumerate(sets))


def near_rows(seed=2):
    """Groups of near copies around the threshold, with shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out = [(i, t, *rest) for i, t, *rest in corpus(40, 4)]
    n = 5000
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(4, 150))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 18))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.4:
                w += passage
            out.append((n, " ".join(w).upper() if r.random() < 0.2 else "  ".join(w), "en", "s0", 0))
            n += 1
    out += [(n, "one two", "en", "s", 0), (n + 1, "ONE\ttwo", "en", "s", 0), (n + 2, "two one", "en", "s", 0)]
    return out


def test_jaccard_against_brute_force(spark, empty):
    rows = near_rows()
    df = clash(spark.createDataFrame(rows, DOCS)).repartition(4)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.components(df).collect())
    assert got == brute_components(rows)
    assert jaccard.components(empty).count() == 0
    kept = jaccard.keep_one(df)
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert kept.columns == df.columns and sorted(ids) == sorted({int(c) for i, _, c in got if i == c and i != "None"})


def test_stage_links_five_words_at_80_percent(spark):
    words = [f"w{i}" for i in range(204)]
    texts = [" ".join(words), " ".join(words + [f"new{i}" for i in range(44)]), " ".join(words + [f"far{i}" for i in range(60)])]
    # of sets of 200, 244 and 260 shingles of five words: 200 / 244 = 0.82 is linked, 200 / 260 = 0.77 isn't
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    assert sorted(r["doc_id"] for r in stage(spark, df, "").collect()) == [0, 2]
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == [0, 1, 2]


def test_keep_one_keeps_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(3, a), (5, a + " more"), (5, b), (None, b + " more"), (None, c), (None, c), (7, None), (7, None), (None, " "), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("set_id", F.lit("own"))
    for parts in (1, 3, 7):
        got = jaccard.keep_one(df.repartition(parts))
        assert got.columns == df.columns and {r["set_id"] for r in got.collect()} == {"own"}
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(i), str(t)) for i, t in [(3, a), (5, b), (None, c), (7, None), (None, " "), (None, None)])


@pytest.mark.parametrize("block, shingles", [(3, 4_000_000), (1500, 100)])
def test_jaccard_blocks(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "MAX_NEEDED", 0)
    rows = near_rows(7)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.components(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_components(rows)


def test_links_derive_answers():
    r = np.random.default_rng(3)
    base = r.choice(10_000, 200, replace=False)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[r.choice(200, r.integers(0, 24), replace=False)] = r.integers(20_000, 20_050, 1)
        sets.append(np.unique(s).astype(np.uint64))
    found = jaccard.links_around(sets, np.ones(60, int), np.zeros(60, int))
    up = jaccard.Links(60)
    for a, b in found:
        up.add(a, b)
    want = jaccard.Links(60)
    for a in range(60):
        for b in range(a):
            c = len(np.intersect1d(sets[a], sets[b]))
            if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                want.add(a, b)
    assert [up.root(i) for i in range(60)] == [want.root(i) for i in range(60)]


# --- 4 search ------------------------------------------------------------------------------------------


def test_topk_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(r.normal(0, 0.2, 6), 1)]) for i in range(150)]
    rows += [(20, rows[20][1]), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [0.5] * 6), (220, [0.5, 0.5]), (240, [])]
    monkeypatch.setattr(topk, "RUN", 16)
    monkeypatch.setattr(topk.search, "__defaults__", (5, 3, 40))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_neighbours(df, 5).collect())
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        found = sorted({(-float(x @ y), j, k) for i, x in good if i == q for k, (j, y) in enumerate(good) if j != q and len(x) == len(y)})
        want.append((q, [(int(-s), j) for s, j, _ in found][:5]))
    by = collections.defaultdict(list)
    for q, _, v, s in got:
        by[q].append((s, v))
    assert {q: by.get(q, []) for q, _ in want} == dict(want) and set(by) <= {q for q, _ in want}  # repeated rows are one query
    assert topk.top_neighbours(df.where("false")).count() == 0


def test_topk_repeated_rows(spark):
    v = lambda *x: [y / 64 for y in x]
    rows = [(0, v(1, 0)), (0, v(1, 0)), (20, v(0, 3)), (20, v(2, 0)), (1, v(5, 5)), (1, v(5, 5)), (3, v(5, 5)), (2, v(9, 0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_neighbours(df, 3).collect())
    # one query for id 0, two for id 20; copies of a candidate are candidates each; ties go to the smaller id
    assert got == collections.Counter([(0, 1, 2, 9), (0, 2, 1, 5), (0, 3, 1, 5), (20, 1, 1, 15), (20, 2, 1, 15), (20, 3, 3, 15), (20, 1, 2, 18), (20, 2, 1, 10), (20, 3, 1, 10)])


def test_pivots_skip():
    r = np.random.default_rng(5)
    centres = r.normal(0, 40, (20, 8)).round()
    x = (np.repeat(centres, 400, 0) + r.normal(0, 1, (8000, 8))).round()
    t = topk.PivotTable(np.arange(8000), x)
    q = x[[5, 4000]]
    rows, ids, s, _, seen = t.top(np.array([-1, -1]), q, 10)
    for i in range(2):
        want = np.lexsort((np.arange(8000), -(x @ q[i])))[:10]
        assert ids[rows == i].tolist() == want.tolist() and s[rows == i].tolist() == (x @ q[i])[want].tolist()
    assert seen < 2 * 8000 / 4  # where vectors lie in groups, most are never evaluated
    b = t.bounds(q)
    for k, c in enumerate(t.cuts):
        assert (b[:, k] >= (q @ t.x[c : c + topk.RUN].T).max(1)).all()


# --- 5 toxicity ------------------------------------------------------------------------------------------


def test_toxicity(spark, empty):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic, poor = i % 4 == 0, i % 5 == 0
        w = [r.choice(EN) for _ in range(r.randint(10, 60))]
        w += ["vile", "scum"] if toxic else []
        w += ["zzz", "qqq"] if poor else []
        r.shuffle(w)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "Vile, scum!", "en", "s", 0), (None, "scum vile", "en", "s", 0)]
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = toxicity.classify(clash(d), lab).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    held = range(400, 600)
    assert sum(by[i]["toxic"] == (i % 4 == 0) for i in held) > 0.95 * 200
    assert not by[9000]["toxic"] and by[9000]["p_toxic"] == 0 and by[9001]["p_toxic"] == 0 and by[9002]["toxic"]
    assert toxicity.classify(empty, lab).count() == 0
    none = toxicity.classify(d.where("doc_id < 50"), lab.where("false")).collect()
    assert len(none) == 50 and all(x["p_toxic"] <= 0.5 for x in none) and len({x["toxic"] for x in none}) == 1  # nothing is told apart


def test_toxicity_of_long_and_repeated_rows(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(EN) for _ in range(30)] + (["vile", "scum"] if i % 4 == 0 else [])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    long_ = " ".join(r.choices(EN, k=200_000))
    rows += [(500, long_, "en", "s", 0), (500, long_, "en", "s", 0), (501, long_ + " vile scum vile scum", "en", "s", 0), (0, rows[0][1], "en", "s", 0), (0, rows[1][1], "en", "s", 0)]
    labels += [(500, 1, 0), (0, 1, 1), (0, 1, 0)]  # of several labels of one id the largest counts
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(d, lab).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x)
    assert by[500][0] == by[500][1] and not by[500][0]["toxic"] and by[501][0]["p_toxic"] > by[500][0]["p_toxic"]
    assert sorted(x["toxic"] for x in by[0]) == [False, True, True]  # two copies of one text, and another under the same id


def test_chain_uses_earlier_categories():
    r = np.random.default_rng(8)
    n = 2000
    hidden = r.random(n) < 0.5
    rows, words = [], []
    for i in range(n):
        own = [10 + int(hidden[i])] if i % 2 else [50 + int(r.integers(200))]
        rows += [i] * len(own)
        words += own
    y = np.stack([hidden, hidden], 1).astype(float)
    y[::2, 1] = np.nan
    chain = toxicity.fit_chain(np.array(rows), np.array(words), y, np.arange(n) % toxicity.FOLDS)
    assert len(chain) == 2 and chain[1].dense.shape == (1,) and chain[1].dense[0] > 0


# --- 6 decontamination ------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(rows, items, window=8):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    win = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            win[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(low(t))
        hit, own = set(), set()
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in win:
                    own |= win[g]
                    hit |= set(range(k, k + n))
        out.append((str(i), len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(own) >= 2))
    return sorted(out)


@pytest.mark.parametrize("block", [8 << 20, 64])
def test_leaks_against_brute_force(spark, empty, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (block, 8))
    r = random.Random(10)
    rows = corpus(60, 11)
    items = [(i, " ".join(r.choice(EN[:6]) for _ in range(r.randint(1, 12)))) for i in range(40)] + [(50, None), (51, ""), (52, "the"), (53, "Ünï kö the THE 42"), (None, "the of"), (54, "the of")]
    rows += [(2000, items[3][1] + "!! " + items[4][1].upper(), "en", "s", 0), (2001, "x ünï kö,the the\n42 y", "en", "s", 0)]
    b = spark.createDataFrame(items, "item_id long, text string")
    df = clash(spark.createDataFrame(rows, DOCS)).repartition(3)
    got = decontaminate.annotate(df, b, keep=["doc_id"]).collect()
    assert sorted((str(x["doc_id"]), *list(x)[1:]) for x in got) == brute_leaks(rows, items)
    assert decontaminate.annotate(empty, b).count() == 0
    assert all(x["n_items"] == 0 for x in decontaminate.annotate(df, b.where("false")).collect())
    left = decontaminate.remove_contaminated(df, b)
    assert left.columns == df.columns and left.count() == sum(not x["contaminated"] for x in got)


def test_longest_matches(spark):
    b = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    d = spark.createDataFrame([(7, "x a b c d e f g h i z")], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(d, b).collect())
    assert got == [(7, 1, "1", 0, 9), (7, 2, "1", 1, 8)]


# --- 7 language ----------------------------------------------------------------------------------------------


def test_language(spark, docs, rows, empty):
    got = language_id.identify(clash(docs)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == by[1002]["lang_pred"] == "und" and by[1000]["score"] == 0
    right = sum(by[i]["lang_pred"] == lang for i, _, lang, *_ in rows if i is not None and i < 120)
    assert right > 0.97 * 120
    for i, r in by.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    assert language_id.identify(empty).count() == 0
    assert all(r["lang_pred"] == "und" for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    kept = language_id.keep_identified(clash(docs))
    assert kept.columns == clash(docs).columns and kept.count() >= 120


def test_code_lengths_are_exact():
    texts = {"a": [b"abracadabra", b"abba"], "b": [b"banana band"]}
    m = language_id.ContextTrees(texts, 3)

    def brute(lang, t):
        """Method C without exclusion, over contexts with starts before each text."""
        counts = collections.defaultdict(collections.Counter)
        for s in texts[lang]:
            p = [None] * 3 + list(s)
            for i in range(3, len(p)):
                for k in range(4):
                    counts[tuple(p[i - k : i])][p[i]] += 1
        known = set().union(*(set(s) for ts in texts.values() for s in ts))
        bits, p = 0.0, [None] * 3 + [c if c in known else -1 for c in t]
        for i in range(3, len(p)):
            cost = 8.0
            for k in range(4):
                c = counts[tuple(p[i - k : i])]
                if c:
                    n, q = sum(c.values()), len(c)
                    cost = -math.log2(c[p[i]] / (n + q)) if c[p[i]] else -math.log2(q / (n + q)) + cost
            bits += cost
        return bits

    for t in (b"abra", b"bandana", b"xyz\xff", b"a"):
        assert m.bits([t])[0] == pytest.approx([brute("a", t), brute("b", t)], rel=1e-5)


# --- 8 mixing -------------------------------------------------------------------------------------------------


def test_exponent():
    t = [1000, 100, 10]
    e = mixing.solve_exponent(t, sum(t), 0.9, None)
    w = mixing.weights_at([x / sum(t) for x in t], e)
    assert mixing.entropy(w) == pytest.approx(0.9 * math.log(3), abs=1e-6)
    e = mixing.solve_exponent(t, sum(t), 0.99, 4.0)
    w = mixing.weights_at([x / sum(t) for x in t], e)
    assert max(x * sum(t) / y for x, y in zip(w, t, strict=True)) == pytest.approx(4.0, abs=1e-6)
    assert mixing.solve_exponent([5], 5) == 1.0 and mixing.solve_exponent([], 0) == 1.0


@pytest.mark.parametrize("block", [4096, 4])
def test_mixing(spark, docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    got = mixing.plan(clash(docs), budget=2.0).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    tokens = collections.Counter()
    for _, t, _, s, _ in rows:
        tokens[s] += words(t)
    total = sum(tokens.values())
    taken, longest = collections.Counter(), max(words(t) for _, t, *_ in rows)
    for s in tokens:
        own = sorted((r for r in got if r["source"] == s), key=lambda r: (r["place"], r["n_tokens"]))
        place = 0
        for r in own:
            assert r["place"] == place
            place += r["n_tokens"]
            taken[s] += r["copies"] * r["n_tokens"]
        if tokens[s]:
            quota = own[0]["weight"] * 2.0 * total
            assert quota - 1 <= taken[s] <= quota + longest + 1
    assert sum({r["source"]: r["weight"] for r in got}.values()) == pytest.approx(1.0)
    again = {(r["doc_id"], r["source"], r["n_tokens"]): r["copies"] for r in mixing.plan(docs.repartition(2), budget=2.0).collect()}
    assert again == {(r["doc_id"], r["source"], r["n_tokens"]): r["copies"] for r in got}
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns == [*docs.columns, "mix_pass", "mix_block", "mix_place"]


def test_mix_takes_rows_not_ids(spark):
    """Rows that share an id, in one source or two, are taken as often as the plan says of each."""
    rows = [(i % 40, " ".join(["w"] * (3 + i % 5)) + f" t{i}", "en", "big" if i < 150 else "small", i) for i in range(170)] + [(None, None, None, None, None), (3, "", "en", "big", 1), (3, "", "en", "big", 2)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit(7)).withColumn("place", F.lit("x"))
    got = mixing.mix(docs.repartition(3)).collect()
    planned = mixing.plan(docs).collect()
    want = collections.Counter()
    for r in planned:
        want[r["doc_id"], r["source"], r["n_tokens"]] += r["copies"]
    seen = collections.Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in got)
    assert seen == +want
    assert all(r["copies"] == 7 and r["place"] == "x" for r in got)
    passes = collections.defaultdict(set)
    for r in got:
        passes[r["n_chars"], r["text"]].add(r["mix_pass"])
    assert all(p == set(range(len(p))) for p in passes.values())


# --- 9 pages ----------------------------------------------------------------------------------------------------


def test_main_text():
    t = page_text.main_text
    assert t(None) == t("") == ""
    page = '<html><head><title>no</title></head><body><nav>Menu</nav><div class="sidebar">side</div><article><h1>A &amp; B</h1><p>one\n two<p>three <b>bold</b><br>x<div class="comments">c</div><script>var a="</p>";</script></article><footer>f</footer></body></html>'
    assert t(page) == "A & B\none two\nthree bold x"
    assert t("<p>a<ul><li>b<li>c</ul>d") == "a\nb\nc\nd"
    assert t("plain &lt;text&gt;") == "plain <text>"
    assert t("<div><form>q<input></form>k<!-- c --><style>s</style></div>") == "k"
    assert t("<main><table><tr><td>1<td>2<tr><td>3</table></main><aside>z</aside>") == "1\n2\n3"
    assert t("<b><i>x</b>y</i>") == "xy"
    assert t("<div>" * 5000 + "deep") == "deep"
    assert t("<article>" + "w " * 100_000 + "</article>") == ("w " * 100_000).strip()
    for junk in ("<", "<>", "</", "<p", "<!--", "<a href='x", "</p></div>", "&#x110000;&bogus;", "<script>"):
        t(junk)


def test_style_tree_removes_what_a_site_repeats(spark):
    pages = [(i, f"http://Site.org/{i}", f'<body><div class="top{i}">Welcome to the site</div><div class="x"><p>Story number {i} tells of {i * 7}.</p></div><div class="end">All rights reserved</div></body>') for i in range(12)]
    pages += [(100, "http://other.org/1", "<body><div>Only page</div></body>"), (101, None, "<p>No host</p>"), (102, "http://site.org/x", None), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    got = page_text.extract(df.repartition(4)).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "Story number 3 tells of 21." and by[3]["n_chars"] == len(by[3]["text"])
    assert by[100]["text"] == "Only page" and by[101]["text"] == "No host" and by[102]["text"] == ""
    assert page_text.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("groups", [[6], [5, 1], [75, *[1] * 25], [20] * 5, [20] * 8])
@pytest.mark.parametrize("wrap", ["article", "div"])
def test_copies_keep_their_text(spark, groups, wrap):
    page = lambda g: f'<html><body><{wrap} class="x"><p>Story number {g} tells of {g * 7}.</p></{wrap}><div class="end">All rights reserved</div></body></html>'
    pages = [(1000 * g + i, f"http://site.org/{g}/{i}", page(g)) for g, n in enumerate(groups) for i in range(n)]
    got = page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == len(pages)
    # in a div, what isn't named as an article's surroundings goes by counts, of six different pages at least
    end = "\nAll rights reserved" if wrap == "div" and len(groups) < page_text.MIN_PAGES else ""
    assert all(r["text"] == f"Story number {r['page_id'] // 1000} tells of {r['page_id'] // 1000 * 7}.{end}" for r in got)


def test_whole_elements_stay():
    root = page_text.parse('<html><body><div role="main"><p>a</p></div><main><article><p>b</p></article></main></body></html>')
    page_text.weigh(root, {x.place: (0.0, 0.0, 1) for kind, x in page_text.walk(root) if kind == "start" and x.tag != "p"})
    assert page_text.blocks_of(root) == ["a", "b"]


@pytest.mark.parametrize("page, text", [
    ('<div class="content has-sidebar"><p>Long story here</p></div>', "Long story here"),
    ("<body><form><h1>T</h1><p>Long story</p><input></form></body>", "T\nLong story"),
    ("<article><header><h1>Headline</h1></header><p>body</p></article>", "Headline\nbody"),
    ("<body><article><h3>Teaser</h3></article><div><h1>Story</h1><p>Long long story</p></div></body>", "Teaser\nStory\nLong long story"),
    ('<article><p>a</p><p class="notice-period">Three months</p><p class="notice">n</p></article>', "a\nThree months"),
    ('<p>a</p><a href="x>y</p><p>z', "a\ny\nz"),
    ('<article>x</article><div class="site-footer"><p>long long footer</p></div>', "x"),
    ('<div class="widget"><p>most of the page</p></div><div>x</div>', "x"),
])
def test_names_are_one_sign(page, text):
    assert page_text.main_text(page) == text


def test_composite_importance():
    # the menu's entries change little and its presentation doesn't; beside it a place that each page fills differently
    root = page_text.parse("<div><ul><li>a</li><li>b</li></ul><p>story</p></div>")
    place = {x.tag: x.place for kind, x in page_text.walk(root) if kind == "start"}
    page_text.weigh(root, {place["div"]: (0.9, 0.0, 1), place["ul"]: (0.1, 0.0, 1), place["li"]: (0.1, 1.0, 1), place["p"]: (1.0, 1.0, 1)})
    assert {x.tag for kind, x in page_text.walk(root) if kind == "start" and x.noise} == {"ul", "li"}
    # many presentations: the place's own importance counts for more than its children's
    root = page_text.parse("<div><b>a</b></div>")
    place = {x.tag: x.place for kind, x in page_text.walk(root) if kind == "start"}
    page_text.weigh(root, {place["div"]: (0.1, 0.9, 20), place["b"]: (0.1, 1.0, 1)})
    assert [x.noise for kind, x in page_text.walk(root) if kind == "start"] == [False, True]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_tree_alone_cleans_a_site_without_names(spark, broadcast):
    menu = "".join(f"<div><b>{w}</b></div>" for w in ("Home", "Shop", "Help"))
    pages = [(i, f"http://site.org/{i}", f"<html><body><div class='a'>{menu}</div><div class='b'><h1>Title {i}</h1><p>Story number {i} tells of {i * 7}.</p><p>More of {i}</p></div><div class='c'><p>Imprint</p><p>All rights reserved</p></div></body></html>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = page_text.extract(df, max_broadcast=broadcast).collect()
    assert len(got) == 40 and all(r["text"] == f"Title {r['page_id']}\nStory number {r['page_id']} tells of {r['page_id'] * 7}.\nMore of {r['page_id']}" for r in got)
    alone = page_text.main_text(pages[0][2]).split("\n")
    assert len(alone) == 8  # five of eight blocks go by the tree


def test_style_tree_has_every_level(spark):
    assert len(page_text.features(page_text.parse("<div>" * 200_000 + "deep"))) == 200_000
    one, two = (page_text.features(page_text.parse(f"<div><p>a</p><p>{x}</p><b>c</b></div>")) for x in "bx")
    assert [one[p] == two[p] for p in one] == [False, False, True]
    pages = [(i, f"http://site.org/{i}", "<div>" * 80 + f"<p>Story number {i}</p><b><u>All rights reserved</u></b>") for i in range(12)]
    got = page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Story number {r['page_id']}" for r in got)


# --- 10 scores -----------------------------------------------------------------------------------------------------


def brute_backoff(rows):
    c, own = collections.Counter(), []
    texts = [(i, (t or "").split()) for i, t, *_ in rows]
    for _, w in texts:
        o = collections.Counter()
        if w:
            s = ["<", "<", *w, ">"]
            o["<",] += 1
            o["<", "<"] += 1
            for i in range(2, len(s)):
                for n in (1, 2, 3):
                    o[tuple(s[i - n + 1 : i + 1])] += 1
        own.append(o)
        c.update(o)
    total = sum(len(w) for _, w in texts)
    out = []
    for (i, w), o in zip(texts, own, strict=True):
        if not w:
            out.append((str(i), 0, None))
            continue
        s, x = ["<", "<", *w, ">"], 0.0
        n = lambda g, o=o: c[g] - o[g]
        for k in range(2, len(s)):
            low = math.log(max(n((s[k],)), 1) / max(1, total - len(w)))
            for m in (2, 3):
                g = tuple(s[k - m + 1 : k + 1])
                low = math.log(n(g) / max(1, n(g[:-1]))) if n(g) > 0 else math.log(0.4) + low
            x += low
        out.append((str(i), len(w), round(x, 5)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [12 << 20, 600])
def test_scores_against_brute_force(spark, docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_score, "SHARD_BYTES", 5000)
    ours = rows
    df = clash(spark.createDataFrame(ours, DOCS)).repartition(3)  # read twice, and shuffled anew each time
    got = lm_score.score(df).collect()
    assert sorted(((str(r["doc_id"]), r["n_words"], None if r["score"] is None else round(r["score"], 5)) for r in got), key=str) == brute_backoff(ours)
    assert lm_score.score(empty).count() == 0


def test_packing():
    r = np.random.default_rng(1)
    h = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm_score.unpack_sorted(lm_score.pack_sorted(h)) == h).all()
    assert len(lm_score.unpack(lm_score.pack(np.zeros(0, np.uint64)))) == 0
    assert (lm_score.unpack(lm_score.pack(np.array([0, 300, 1], np.uint64))) == [0, 300, 1]).all()
