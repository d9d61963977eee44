import random
import re

from bazaar.llm.decontamination import decontaminate, proximity_hits

from .data import odd_rows, prose, row, table

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, size=10):
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for item, text in items:
            b = words(text)
            k = min(size, len(b))
            for s in range(len(b) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if item is not None and w[p:p + k] == b[s:s + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        out.append((r[0], len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force_in_any_number_of_blocks(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([12, 14, 25]))) for i in range(12)]
    items += [(20, "Tiny-Item 42"), (21, "lonely"), (22, ""), (23, None), (0, prose(rng, 15)), (None, "the thing"),
              (100, items[3][1])]
    rows = []
    for i in range(50):
        text = prose(rng, rng.randint(1, 60))
        if i % 2:
            text += " " + (rng.choice(items)[1] or "").upper() + "? " + prose(rng, 5)
        if i % 5 == 0:
            text += " tiny, ITEM -- 42 lonely"
        rows.append(row(i, text))
    rows += [r if r[0] != 904 else row(904, items[4][1] * 3) for r in odd_rows()]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = table(spark, rows)
    for block_words in (1_000_000, 60):
        got = decontaminate(docs, bench, block_words=block_words).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    out = decontaminate(table(spark, odd_rows()), bench)
    assert {r.n_hit for r in out.collect()} == {0}
    some = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate(table(spark, []), some).count() == 0


def test_proximity(spark):
    docs = table(spark, [row(1, "red x x green x blue"), row(2, "red " + "x " * 30 + "green blue"), row(3, "blue green red")])
    items = spark.createDataFrame([("i", "Green red, blue")], "item_id string, text string")
    got = proximity_hits(docs, items, "doc_id", "text", "item_id", "text", within=6).collect()
    assert {r.id for r in got} == {1, 3}


def test_texts_that_share_an_id_hide_no_hit(spark):
    """Both texts have the item's rarest words in the same places, one of them has the passage."""
    words = [f"w{i}x" for i in range(10)]
    docs = [(7, " ".join(words)), (7, " ".join([*words[:4], "other", *words[5:]]))] * 3
    docs = spark.createDataFrame([*docs, (8, "w0x")], "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame([("a", " ".join(words)), ("b", "w0x")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert list(got[7]["items"]) == ["a", "b"] and got[7].n_hit == 10
    assert list(got[8]["items"]) == ["b"] and got[8].n_hit == 1
