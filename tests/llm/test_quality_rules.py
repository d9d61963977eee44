import random
import re
from collections import Counter

from bazaar.llm.quality_rules import quality_rules

from .data import odd_rows, prose, row, table

LOWER = {i: i + 32 for i in range(65, 91)}
SPLIT = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, min_docs=10, percent_docs=5.0):
    text = [r[1] or "" for r in rows]
    lines = [[(x, SPLIT.findall(x)) for x in t.split("\n")] for t in text]
    held, hosts = {}, {}
    for r, t, ls in zip(rows, text, lines):
        hosts.setdefault(r[3], set()).add(t)
        for _, w in ls:
            if w:
                held.setdefault((r[3], " ".join(w).translate(LOWER)), set()).add(t)
    out = []
    for r, t, ls in zip(rows, text, lines):
        words = SPLIT.findall(t)
        runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        seen = Counter(runs)
        repeat = len({j for i, x in enumerate(runs) if seen[x] > 1 for j in range(i, i + 5)})
        full = [x for x, w in ls if w]
        gone = [i for i, (_, w) in enumerate(ls) if w and (
            n := len(held[r[3], " ".join(w).translate(LOWER)])) >= min_docs and n * 100 > percent_docs * len(hosts[r[3]])]
        left = len(words) - sum(len(ls[i][1]) for i in gone)
        failed = len(words) < 10 or 100 * repeat > 20 * len(words)
        depleted = left < 10 or left * 100 < 50 * len(words)
        out.append((r[0], len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"),
                    len(full) - len(set(full)), repeat, failed, len(gone), left, gone, depleted,
                    not failed and not depleted, "\n".join(x for i, (x, _) in enumerate(ls) if i not in gone)))
    return sorted(out, key=str)


def check(spark, rows, **how):
    got = quality_rules(table(spark, rows), with_text=True, **how).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, **how)


def test_against_brute_force(spark):
    rng = random.Random(11)
    pool = [prose(rng, 6).replace("\n", " ") for _ in range(25)] + ["# % é <b> & |", "x", "ÉCOLE  une\tligne", "École UNE ligne"]
    rows = []
    for i in range(150):
        body = [prose(rng, 14).replace("\n", " ") for _ in range(rng.randint(0, 3))]
        body += [x if rng.random() < .7 else f"  {x.upper()}\r" for x in rng.choices(pool, k=rng.randint(0, 5))]
        rng.shuffle(body)
        rows.append(row(i, rng.choice(["", "\n", " \n"]) + "\n".join(body) + "\n" * rng.randint(0, 2), "en",
                        rng.choice(["s0", "s1", None])))
    rows += [row(200 + i, "the same text again\n" * 9 + "its end", "en", "s1") for i in range(40)] + odd_rows()
    check(spark, rows)
    check(spark, rows, min_docs=3, percent_docs=2.0)


def test_boilerplate_documents_are_depleted_and_copies_are_one(spark):
    rng = random.Random(12)
    footer = "subscribe to our letter and follow us on every network there is today"
    clean = [row(i, prose(rng, 60).replace("\n", " ") + "\n" + footer) for i in range(60)]
    thin = [row(100 + i, footer + f"\nitem {i}") for i in range(20)]
    copies = [row(200 + i, prose(random.Random(1), 60)) for i in range(50)]
    got = {r.doc_id: r for r in quality_rules(table(spark, clean + thin + copies)).collect()}
    assert all(got[i].kept and got[i].dropped_lines == [1] for i in range(60))
    assert all(got[100 + i].depleted and not got[100 + i].kept for i in range(20))
    assert all(got[200 + i].kept and not got[200 + i].dropped_lines for i in range(50))


def test_long_list_of_frequent_lines_is_joined(spark, monkeypatch):
    monkeypatch.setattr("bazaar.llm.quality_rules.BROADCAST_LINES", 0)
    rng = random.Random(13)
    pool = [prose(rng, 6).replace("\n", " ") for _ in range(5)]
    check(spark, [row(i, "\n".join(rng.choices(pool, k=3) + [prose(rng, 9)]), "en", rng.choice(["a", "b", None]))
                  for i in range(80)])


def test_empty_table(spark):
    out = quality_rules(table(spark, []))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "n_words", "word_chars"] and out.columns[-1] == "kept"
