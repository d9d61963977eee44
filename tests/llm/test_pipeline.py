"""The pipeline's stages against plain-Python versions of their decisions."""

import random

import corpus_pipeline as C
import __spark_entry__ as E

from . import test_decontamination, test_near_dedup
from .data import odd_rows, prose, row, table


def made(tmp_path, spark):
    rng = random.Random(11)
    rows = [row(i, prose(rng, rng.randint(5, 60), lang), lang, rng.choice(["s0", "s0", "s0", "s1", "s2", None]))
            for i in range(200) for lang in [rng.choice(["en", "fr", "de"])]]
    rows += [row(500 + i, rows[3][1], "en", "s1") for i in range(10)] + odd_rows()
    items = [(i, prose(rng, 14)) for i in range(5)]
    rows += [row(700 + i, prose(rng, 20) + " " + items[i % 5][1], "en", "s2") for i in range(12)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = made(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns

    one = C.language(spark, docs, str(tmp_path))
    assert one.columns == names
    ids = {r.doc_id for r in one.collect()}
    assert {900, 901, 902, 905}.isdisjoint(ids)
    clean = [r for r in rows if r[0] in ids]
    assert len(clean) >= len(rows) - 8

    two = C.near_dedup(spark, docs, str(tmp_path)).collect()
    want = {r[0] for r in test_near_dedup.brute(rows) if r[3]}
    assert sorted((r.doc_id for r in two), key=str) == sorted(want, key=str)

    three = C.decontamination(spark, docs, str(tmp_path))
    assert three.columns == names
    hit = {r[0] for r in test_decontamination.brute(rows, items) if r[5]}
    assert len(hit) >= 12
    left = [r.doc_id for r in three.collect()]
    assert sorted(left, key=str) == sorted((r[0] for r in rows if r[0] not in hit), key=str)

    four = C.mixing(spark, docs, str(tmp_path))
    assert four.columns == names and {r.doc_id for r in four.collect()} <= {r[0] for r in rows}


def test_run(spark, tmp_path):
    rows, _ = made(tmp_path, spark)
    out = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in rows} and len(out) > 50
    assert [n for n, _ in C.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "sharding"]


def test_mixing_repeats_documents(spark):
    rows = [row(i, "one two three four " * 5, "en", "big" if i < 90 else "small") for i in range(100)]
    out = C.mixing(spark, table(spark, rows), "").collect()
    per = {}
    for r in out:
        per[r.doc_id] = per.get(r.doc_id, 0) + 1
    # shares 5 : 2 of 2000 words, all rows are 20 words long
    assert max(per.values()) == 3 and sum(per[i] for i in range(90, 100)) in (28, 29)
    assert len(out) == 100


def test_registered():
    q = E.queries()
    assert {n.split("_")[0] for n in q if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in q and "pipeline" not in E.oracle_sql()


def test_rows_without_or_with_a_shared_id_are_judged_alone(spark, tmp_path):
    rng = random.Random(13)
    rows = [row(i, prose(rng, 60, lang), lang) for i in range(60) for lang in ["en", "fr"]][::2] + [
        row(1000 + i, prose(rng, 60, "fr"), "fr") for i in range(30)]
    passage, twin = prose(rng, 14), prose(rng, 70)
    extra = [row(None, "12 34 -- !!"), row(None, prose(rng, 70)), row(None, prose(rng, 70) + " " + passage),
             row(7, prose(rng, 70)), row(7, twin), row(2000, twin), row(8, prose(rng, 50) + " " + passage)]
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, rows + extra)
    texts = lambda df: sorted(r.text for r in df.collect())
    every = sorted(r[1] for r in rows + extra)

    def without(*gone):
        left = list(every)
        for g in gone:
            left.remove(g)
        return left

    assert texts(C.language(spark, docs, str(tmp_path))) == without("12 34 -- !!")
    assert texts(C.decontamination(spark, docs, str(tmp_path))) == without(extra[2][1], extra[6][1])
    assert texts(C.near_dedup(spark, docs, str(tmp_path))) == without(twin)
    assert set(texts(C.mixing(spark, docs, str(tmp_path)))) <= set(every)


def test_few_texts_of_a_language_are_kept(spark):
    rng = random.Random(14)
    for labelled in (2, 5):
        rows = [row(i, prose(rng, 60, "en"), "en") for i in range(60)]
        rows += [row(100 + i, prose(rng, 60, "fr"), "fr" if i < labelled else None) for i in range(40)]
        kept = {r.doc_id for r in C.language(spark, table(spark, rows), "").collect()}
        assert kept == {r[0] for r in rows}


def test_near_dedup_from_a_similarity_of_80_percent(spark):
    rng = random.Random(12)
    rows = [row(i, prose(rng, rng.randint(5, 60))) for i in range(30)]
    for i in range(10):
        base = prose(rng, 150)  # 14 of 146 shingles change: similarity 0.825
        words = base.split(" ")
        for place in (40, 80):
            words[place] = f"edit{i}"
        words[-4:] = [f"end{i}"] * 4
        rows += [row(100 + i, base), row(200 + i, " ".join(words))]
    want = {r[0] for r in test_near_dedup.brute(rows, 80) if r[3]}
    assert len(want) < len({r[0] for r in test_near_dedup.brute(rows) if r[3]})
    assert {r.doc_id for r in C.near_dedup(spark, table(spark, rows), "").collect()} == want
