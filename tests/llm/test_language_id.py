import random
import zlib

import numpy as np

from bazaar.llm.language_id import ORDER, Model, identify_language, letter_codes, text_grams

from .data import LANGS, odd_rows, prose, row, table


def grams(texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return text_grams(letter_codes(), np.frombuffer(b"".join(raw), np.uint8), offs)


def plain(text):
    """Letters in lower case, one blank (0) after every word."""
    x = [0] * 3
    for c in text:
        if c.isalpha():
            x.append(ord(c.lower()))
        elif x[-1]:
            x.append(0)
    if x[-1]:
        x.append(0)
    return [tuple(x[i - 3:i + 1]) for i in range(3, len(x))]


def test_grams_of_each_text():
    texts = ["Été, là!", "", "12 34", "ab  c", "🙂x", "..z"]
    key, at, some = grams(texts)
    for i, t in enumerate(texts):
        got = [tuple(int(k) >> s & 0xFFFF for s in (48, 32, 16, 0)) for k in key[at[i]:at[i + 1]]]
        assert got == plain(t)
    assert some.tolist() == [True, False, False, True, True, True]


def test_probabilities_sum_to_one_over_seen_letters():
    key, _, _ = grams([prose(random.Random(1), 300)])
    u, n = np.unique(key, return_counts=True)
    m = Model(u, n)
    letters = np.unique(u & np.uint64(0xFFFF))
    for ctx in np.unique(u >> np.uint64(16))[:50]:
        p = m.probability((ctx << np.uint64(16)) | letters)
        assert 0.9 < p.sum() <= 1.0 + 1e-9 and (p > 0).all()
    assert ORDER == 4


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(2)
    rows = [row(i, prose(rng, rng.randint(3, 60), lang), lang) for i in range(600)
            for lang in [rng.choice(list(LANGS))]]
    rows += [row(5000 + i, "qxzj wvkq zzxq jjqx " * 30, None) for i in range(3)] + odd_rows()
    got = identify_language(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    out = [by[i] for i in range(600) if by[i].held_out]
    right = sum(by[r.doc_id].lang_pred == rows[r.doc_id][2] for r in out)
    assert len(out) > 80 and right >= .97 * len(out)
    assert not any(by[i].rejected for i in range(600))
    assert all(by[5000 + i].rejected for i in range(3))
    for i in (900, 901, 902, 905):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0, True)


def test_labels_of_held_out_rows_are_not_learned(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0][:20]
    rng = random.Random(3)
    rows = [row(i, prose(rng, 30), "xx" if i in held else "en") for i in range(200)
            if i in held or zlib.crc32(str(i).encode()) % 5]
    assert {r.lang_pred for r in identify_language(table(spark, rows)).collect()} == {"en"}


def test_empty_and_unlabelled(spark):
    assert identify_language(table(spark, [])).count() == 0
    got = identify_language(table(spark, [row(1, "the water", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_large_models_keep_every_gram(spark):
    """About 560 texts of 2,000 letters out of 20,000 to learn from: 1.1 million different 4-grams of one language."""
    rng = np.random.default_rng(4)
    rows = [row(i, "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 20_000, 2000))), "zh") for i in range(700)]
    rows += [row(1000 + i, prose(random.Random(i), 40), "en") for i in range(50)]
    got = {r.doc_id: r for r in identify_language(table(spark, rows)).collect()}
    learned = [got[i] for i in range(700) if not got[i].held_out]
    assert all(r.lang_pred == "zh" and not r.rejected for r in learned) and len(learned) > 520
    assert all(got[1000 + i].lang_pred == "en" for i in range(50))


def test_models_as_tables_give_the_same(spark):
    rng = random.Random(5)
    rows = [row(i, prose(rng, rng.randint(3, 60), lang), lang) for i in range(300)
            for lang in [rng.choice(list(LANGS))]]
    rows += [row(5000, "qxzj wvkq zzxq jjqx " * 30, None), row(5001, "日本語 ☃ 漢字", None)] + odd_rows()
    one, two = ({(str(r.doc_id), r.lang_pred, r.held_out, r.rejected, round(r.score, 8),
                  None if r.entropy != r.entropy else round(r.entropy, 8)) for r in identify_language(
                      table(spark, rows), at_once=most).collect()} for most in (2_000_000, 0))
    assert one == two
