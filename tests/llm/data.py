"""Small tables for the operator tests: prose-like random words and odd rows."""

import random

LANGS = {"en": ["the", "thing", "water", "house", "with", "other", "three", "shore", "whose", "forth"],
         "fr": ["eau", "maison", "été", "où", "voilà", "bien", "autre", "forêt", "leçon", "trois"],
         "de": ["haus", "wasser", "über", "straße", "schön", "zwei", "nicht", "wald", "großen", "drei"]}
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size string, key int, "
          "component_id string, n_words string, kept int")


def prose(rng, n, lang="en"):
    words = LANGS[lang]
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 2))) + rng.choice(["", "", "", ".", "\n"])
                    for _ in range(n))


def row(doc_id, text, lang="en", source="s0"):
    """A document with columns whose names clash with the operators' own."""
    return (doc_id, text, lang, source, len(text or ""), "x", None, 7, "c", None, 1)


def odd_rows(first=900):
    """NULL, empty and blank texts, a long one, NULLs in other columns, repeated rows."""
    rng = random.Random(5)
    long_text = prose(rng, 20_000)
    rows = [row(first, None), row(first + 1, ""), row(first + 2, " \t\n\x0b "), row(first + 3, "one"),
            row(first + 4, long_text, None, None), row(first + 5, "12 34 -- !!", None, "s1"),
            row(first + 6, "é" * 300, "fr", None), row(None, "a text without any id " * 20, "en", "s1")]
    twice = row(first + 7, prose(rng, 80), "en", "s2")
    return [*rows, twice, twice]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
