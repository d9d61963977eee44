import random

from bazaar.llm.line_dedup import line_dedup

from .data import odd_rows, prose, row, table

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_chars=10, min_docs=2):
    held = {}
    split = lambda t: (t or "").split("\n")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for r in rows:
        for x in split(r[1]):
            if r[0] is not None and len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(r[0])
    out = []
    for r in rows:
        lines = split(r[1])
        left = [x for x in lines if not (r[0] is not None and len(held.get(key(x), ())) >= min_docs
                                         and min(held[key(x)]) != r[0])]
        out.append((r[0], len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [prose(rng, 6).replace("\n", " ") for _ in range(30)] + ["short", "ÉCOLE une ligne", "École une ligne"]
    rows = [row(i, "\n".join(rng.choice(["", "  ", "\t"]) + (x if rng.random() < .5 else x.upper()) for x in
                             rng.choices(pool, k=rng.randint(1, 8))) + "\n" * rng.randint(0, 2)) for i in range(60)]
    rows += [row(100 + i, "a line that everybody has\r") for i in range(40)] + odd_rows()
    for least in (2, 4):
        got = line_dedup(table(spark, rows), min_docs=least).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, min_docs=least)


def test_texts_of_one_id_lose_their_own_lines_only(spark):
    rows = [row(0, "a line of many\nzero zero zero"), row(1, "a line of many\nonly in this text"),
            row(1, "unique text of the same id"), row(1, "another unique text\na line of many")]
    got = line_dedup(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert {r.kept_text for r in got if r.doc_id == 1} == {"only in this text", "unique text of the same id",
                                                           "another unique text"}


def test_empty_table(spark):
    out = line_dedup(table(spark, []))
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"] and out.count() == 0


def test_no_python_in_the_plan(spark):
    plan = line_dedup(table(spark, odd_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
