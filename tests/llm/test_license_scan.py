import random

from bazaar.llm.license_scan import TEMPLATES, align, increasing, patience, scan_licenses

from .data import odd_rows, prose, row, table


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(50):
        v = rng.sample(range(30), rng.randint(0, 12))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] += max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        got = increasing(v)
        assert len(got) == max(best, default=0)
        assert all(v[a] < v[b] and a < b for a, b in zip(got, got[1:]))


def test_patience_matches_are_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(60):
        a, b = (rng.choices("abcdefghij", k=rng.randint(0, 20)) for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert patience(list("abcxyz"), list("abcxyz")) == [(i, i) for i in range(6)]


def test_align_needs_a_dense_match():
    t = list("abcdefghij")
    assert align(list("..abcdefghij.."), 0, 14, t, .8) == (2, 12, 10)
    assert align(list("abcd" + "." * 30 + "efghij"), 0, 40, t, .8) is None


def test_finds_notices_and_nothing_else(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for i, (name, t) in enumerate(sorted(TEMPLATES.items())):
        changed = t.text.split()
        if len(changed) > 25:
            changed[7] = "another"
            del changed[4]
        rows.append(row(i, prose(rng, 50) + "\n" + " ".join(changed).upper() + "\n" + prose(rng, 50)))
        want.add((i, name))
    rows += [row(100 + i, prose(rng, 200) + " the license under this work is") for i in range(20)] + odd_rows()
    rows.append(row(200, (TEMPLATES["MIT-notice"].text + " ") * 3))
    got = scan_licenses(table(spark, rows)).collect()
    assert {(r.doc_id, r.license) for r in got} == want | {(200, "MIT-notice")}
    assert sum(r.doc_id == 200 for r in got) == 3
    assert all(r.coverage >= .8 and r.matched >= .8 * (r.end - r.start) for r in got)


NEAR_MISSES = {
    "Released under the BSD License.": "BSD-notice", "Released under the ISC License.": "ISC-notice",
    "Licensed under CC BY 4.0": "CC-BY-4.0-notice", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0-notice",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-notice",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0-notice",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General "
    "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
    "any later version.": "LGPL-2.0-header",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version.": None,
    "Released under the Foo License.": None, "Licensed under the Apache License, Version 1.1": None,
}


def test_near_misses_are_not_another_license(spark):
    rows = [row(i, "some words before it " + t + " and some after") for i, t in enumerate(NEAR_MISSES)]
    got = {r.doc_id: r.license for r in scan_licenses(table(spark, rows)).collect()}
    assert got == {i: name for i, name in enumerate(NEAR_MISSES.values()) if name}


def test_an_aligner_at_all_places_finds_the_same(spark):
    rng = random.Random(9)
    listed = {"a": "one two three four five six", "b": "six five four three", "c": "red green blue red green grey seven"}
    words = sorted({w for t in listed.values() for w in t.split()}) + ["x", "y", "z"]
    rows = [row(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(150)]
    rows += [row(300 + i, " ".join(rng.choices(words, k=4)) + " " + rng.choice(list(listed.values()))) for i in range(40)]
    got = {r.doc_id for r in scan_licenses(table(spark, rows), listed).collect()}
    want = set()
    for r in rows:
        t = r[1].split()
        for text in listed.values():
            size = len(text.split())
            if any(align(t, max(0, p - 2), min(len(t), p + size + 2), text.split(), .8) for p in range(-size, len(t))
                   if p + size + 2 > 0):
                want.add(r[0])
    assert got <= want and {300 + i for i in range(40)} <= got
    assert len(got) >= .95 * len(want)  # an aligner may need just the right window around changed words


def test_empty_tables(spark):
    assert scan_licenses(table(spark, [])).count() == 0
    assert scan_licenses(table(spark, odd_rows()), {"none": "..."}).count() == 0
