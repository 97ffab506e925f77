"""The pipeline's stages on tables with nulls, repeated rows, clashing columns and planted copies, against the operators' own results."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, jaccard, language_id, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there we can".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie".split()}
LEAK = "seven bright copper kettles stood upon the old kitchen shelf beside warm woollen mittens"


def made(n=240):
    r = random.Random(11)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append([i, " ".join(r.choice(WORDS[lang]) + str(r.randrange(40) or "") for _ in range(r.randint(40, 90))), lang, f"s{min(i % 7, 3)}", 0])
    near = lambda t: " ".join(w if k % 30 else "other" for k, w in enumerate(t.split()))
    rows += [[1000 + i, rows[3][1], "en", "s0", 0] for i in range(5)]  # exact copies
    rows += [[1100, rows[4][1] + " and more", "en", "s1", 0], [1101, near(rows[5][1]), "en", "s1", 0]]
    rows += [[1200, f"{rows[7][1]} {LEAK} {rows[8][1]}", "en", "s2", 0]]
    rows += [[1300, None, "en", "s1", None], [1301, "", None, None, 0], [1302, "?! 12 ..", "en", "s2", 8], [7, rows[9][1] + " x y z", "en", "s0", 0], [7, rows[7][1], "en", "s3", 0], [None, rows[10][1] + " nothing", "en", None, 0]]
    rows += [[1400, " ".join(rows[11][1].split() * 300), "en", "s0", 0]]
    return [(a, b, c, d, len(b) if b else e) for a, b, c, d, e in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(made(), DOCS).withColumn("score", F.lit("x")).withColumn("LANG_PRED", F.lit(1)).withColumn("keep", F.lit(2)).withColumn("copies", F.lit("c"))
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(240)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("a", LEAK), ("b", None), (None, "x")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def key(r):
    return (str(r["doc_id"]), str(r["text"]), str(r["source"]))


def ran(spark, sf_dir):
    """What each stage was given and what it gave."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_each_stage_does_what_its_operator_says(spark, sf_dir):
    stages = {n: (a, b) for n, a, b in ran(spark, sf_dir)}
    assert list(stages) == ["language_id", "quality", "ngram_jaccard", "decontamination", "mixing"]
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(b.columns == columns for n, (_, b) in stages.items() if n != "mixing")

    before, after = stages["language_id"]
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == {1300, 1301, 1302}
    said = collections.Counter(r["doc_id"] for r in language_id.identify(before).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5 and r["bits_per_byte"] <= language_id.REJECT_BITS)
    assert collections.Counter(r["doc_id"] for r in after.collect()) == said

    before, after = stages["quality"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    said = collections.Counter(r["doc_id"] for r in quality.classify(before, labels).collect() if r["keep"])
    assert collections.Counter(r["doc_id"] for r in after.collect()) == said and after.count() > 0.9 * before.count()

    before, after = stages["ngram_jaccard"]
    rows, kept = before.collect(), collections.Counter(key(r) for r in after.collect())
    shingles = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (r["text"].lower().split() for r in rows)]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(shingles[i] & shingles[j])
            if 100 * c >= 80 * (len(shingles[i]) + len(shingles[j]) - c):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    assert sum(kept.values()) == len(groups) < len(rows)
    for own in groups.values():
        assert sum(min(1, kept[k]) for k in {key(r) for r in own}) == 1

    before, after = stages["decontamination"]
    gone = collections.Counter(key(r) for r in before.collect()) - collections.Counter(key(r) for r in after.collect())
    assert [k[0] for k in gone] == ["1200"]
    assert {r["doc_id"] for r in decontaminate.annotate(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"]).where("n_items >= 1").collect()} == {1200}

    before, after = stages["mixing"]
    assert after.columns == [*columns, "mix_pass", "mix_block", "mix_place"]
    want = collections.Counter()
    for r in mixing.plan(before).collect():
        want[str(r["doc_id"]), str(r["source"])] += r["copies"]
    assert collections.Counter((str(r["doc_id"]), str(r["source"])) for r in after.collect()) == +want


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    last = ran(spark, sf_dir)[-1][2]
    assert got.columns == last.columns
    assert collections.Counter(key(r) for r in got.collect()) == collections.Counter(key(r) for r in last.collect())


def test_empty_tables(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go_at_eight_tenths(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join([*words, *(f"new{i}" for i in range(85))]), "en", "s", 0), (3, " ".join([*words, *(f"add{i}" for i in range(130))]), "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs, 5, 80).collect()) == [1, 3]
