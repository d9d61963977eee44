"""Operator 5: URL filter with host rules, word segmentation and naive Bayes.

1. Host and path are cut from the URL; the longest fitting rule decides.
2. Names (letter runs of host and path) are split into words by a unigram
   Viterbi search. Word counts come from the visible words of all pages and
   from the parts of hyphenated host labels; a name's substrings meet the
   counts in a join, so the vocabulary is never sent whole to a task.
3. Two views label pages for the block class that a multinomial naive Bayes
   learns from: a seed word among the host's words, or visible text rich in
   seed words. All others are the allow class. Counts of words by class are
   over all pages, so words that stand beside seeds, or on pages whose text
   is unwanted, speak against hosts that hold no seed at all.
4. A name's score is the sum of its words' log odds, a URL's the sum of its
   names' scores and the prior. URLs without a rule go by the sign.

Pages are first combined by (host, path with numbers as 0), so a hot host is
few rows. Long names are named by a hash where their pieces are dealt out, so
the work is linear in a URL's length. Tables that a join looks names up in are
checkpointed, so both sides are plain shuffles that adaptive execution splits
when a name is hot.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.line_dedup import lower_ascii
from bazaar.session import reliable_checkpoint

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))

# Seed words of unwanted hosts: the labels that the classifier starts from.
SEEDS = ("ad", "ads", "adult", "adserver", "bet", "bets", "betting", "casino", "cheap", "gambling", "jackpot",
         "lottery", "malware", "phishing", "pill", "pills", "poker", "porn", "replica", "sex", "spam", "track",
         "tracker", "tracking", "viagra", "warez", "xxx")
LONGEST = 24  # letters of a word in the unigram model (default of a parameter)
LEAST_TOTAL = 1_000_000  # words that the unigram model counts at least: few pages make no piece likely


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, NULL if none does;
    of equally long ones the first in the list."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def viterbi(name: str, counts: dict[str, int], total: float, longest: int = LONGEST) -> list[str]:
    """The likeliest split into words; an unknown piece of n letters counts as 10 / (total 10^n)."""
    best = [0.0] + [-math.inf] * len(name)
    cut = [0] * (len(name) + 1)
    for i in range(1, len(name) + 1):
        for j in range(max(0, i - longest), i):
            n = counts.get(name[j:i])
            p = math.log(n / total) if n else math.log(10.0 / total) - (i - j) * math.log(10.0)
            if best[j] + p > best[i]:
                best[i], cut[i] = best[j] + p, j
    out, i = [], len(name)
    while i:
        out.append(name[cut[i]:i])
        i = cut[i]
    return out[::-1]


def is_seeded(name: str, words: list[str], known, seeds) -> bool:
    """Whether a name says a seed: it is one, or is split into known words of
    three letters or more, one of them a seed (essex and bethany are not)."""
    return name in seeds or (any(w in seeds for w in words) and all(len(w) > 2 and w in known for w in words))


def _segment(total: float, longest: int, seeds: frozenset):
    def run(batches):
        for b in batches:
            names, words, seeded = b.column("name").to_pylist(), [], []
            for name, found in zip(names, b.column("found").to_pylist(), strict=True):
                counts = {f["word"]: f["n"] for f in found or ()}
                words.append(viterbi(name, counts, total, longest))
                seeded.append(is_seeded(name, words[-1], counts, seeds))
            yield pa.RecordBatch.from_arrays(
                [b.column("name"), pa.array(words, pa.list_(pa.string())), pa.array(seeded, pa.bool_())],
                ["name", "words", "seeded"])
    return run


def _pieces(longest: int, at_once: int = 4096):
    """(key, name) -> (key, word): pieces of 2 to ``longest`` letters, ``at_once`` places at a time."""
    def batch(keys, words):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], ["key", "word"])

    def run(batches):
        for b in batches:
            keys, words = [], []
            for key, name in zip(b.column("key").to_pylist(), b.column("name").to_pylist(), strict=True):
                for lo in range(0, len(name), at_once):
                    cut = {name[i:j] for i in range(lo, min(lo + at_once, len(name)))
                           for j in range(i + 2, min(i + longest, len(name)) + 1)}
                    keys += [key] * len(cut)
                    words += cut
                    if len(keys) >= 20_000:
                        yield batch(keys, words)
                        keys, words = [], []
            yield batch(keys, words)
    return run


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                rules=RULES, seeds=SEEDS, smooth: float = 100.0, longest: int = LONGEST,
                text_seeds: int = 4, text_share: float = 0.05) -> DataFrame:
    """-> (page_id, host, path, rule, verdict, score), one row per input row.

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z
    lower-cased; path: from there up to `?`, `#` or the end. A rule fits its
    host and all subdomains if the path starts with the rule's; the longest
    one wins. ``score`` is the log odds of block against allow. ``longest`` is
    the most letters of a word of the unigram model. A page's text speaks for
    the block class if it has ``text_seeds`` different seed words and these are
    ``text_share`` of its words.

    Defined cases: NULL URLs and URLs without `://` have empty host and path;
    they have no words and go by the prior alone, or are allowed when no page
    is of the block class. NULL html has no words. Rows that repeat an id are
    judged each. Names without known words are single words or letters as
    the model finds likeliest. URLs and pages of any length are read whole. Of
    equally likely splits the one with the longer last word is taken; a score
    of 0 allows. No rows give no rows. Other columns are not looked at.
    """
    url = F.col(url_col).cast("string")
    src = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                       F.col(html_col).cast("string").alias("html"))
    src = src.withColumn("shape", F.regexp_replace(lower_ascii(F.col("path")), "[0-9]+", "0"))
    shown = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), "(?s)<(script|style).*?</\\1>|<[^>]*>", " ")
    shown = F.split(lower_ascii(shown), "[^a-z]+")
    # n pages, t of them with a text of the block class
    rich = (F.size(F.array_distinct("said")) >= text_seeds) & (F.size("said") >= F.lit(text_share) * F.size("shown"))
    told = src.withColumn("shown", shown).withColumn("said", F.filter("shown", lambda w: w.isin(*seeds)))
    keys = reliable_checkpoint(told.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(rich, 1).otherwise(0)).alias("t")))
    letters = "[a-z]+|0"
    names = reliable_checkpoint(keys.select(
        "host", "shape", "n", "t",
        F.explode(F.concat(
            F.transform(F.regexp_extract_all("host", F.lit("[a-z]+"), 0), lambda x: F.struct(x.alias("name"), F.lit(True).alias("of_host"))),
            F.transform(F.regexp_extract_all("shape", F.lit(letters), 0), lambda x: F.struct(x.alias("name"), F.lit(False).alias("of_host")))))
        .alias("x")).select("host", "shape", "n", "t", "x.name", "x.of_host"))

    # unigram model over the visible words of all pages and the parts of hyphenated labels
    parts = F.explode(F.filter(F.split("host", r"\."), lambda x: x.contains("-"))).alias("label")
    parts = keys.select("host").distinct().select(parts).select(F.explode(F.split("label", "[^a-z]+")).alias("word"))
    words = src.select(F.explode(shown).alias("word")).unionByName(parts)
    words = words.where((F.length("word") > 1) & (F.length("word") <= longest)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))
    words = reliable_checkpoint(words)
    total = float(max(LEAST_TOTAL, words.agg(F.sum("n")).first()[0] or 0))
    some = names.select("name").where("name <> '0'").distinct().withColumn(
        "key", F.when(F.length("name") <= 40, F.col("name")).otherwise(F.concat(F.lit("#"), F.sha2("name", 256))))
    pieces = some.select("key", "name").mapInArrow(_pieces(longest), "key string, word string")
    found = pieces.join(words, "word").groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("found"))
    split = reliable_checkpoint(some.join(found, "key", "left").select("name", "found").mapInArrow(
        _segment(total, longest, frozenset(seeds)), "name string, words array<string>, seeded boolean")
        .unionByName(names.select("name").where("name = '0'").distinct().withColumns(
            {"words": F.array(F.lit("0")), "seeded": F.lit(False)})))

    # classes, word counts by class, log odds
    bad = (names.where("of_host").join(split.where("seeded").select("name"), "name")
           .select("host", "shape", F.lit(True).alias("bad")).distinct())
    bad = reliable_checkpoint(bad)
    blocked = F.when(F.col("bad"), F.col("n")).otherwise(F.col("t"))  # pages of the block class
    marked = reliable_checkpoint(names.join(bad, ["host", "shape"], "left").groupBy("name").agg(
        F.sum(blocked).alias("nb"), F.sum(F.col("n") - blocked).alias("na")))
    per = (marked.join(split, "name").select("nb", "na", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("nb").alias("nb"), F.sum("na").alias("na")))
    per = reliable_checkpoint(per)
    nb, na = per.agg(F.sum("nb"), F.sum("na")).first()
    pb = keys.join(bad, ["host", "shape"], "left").agg(F.sum(blocked), F.sum(F.col("n") - blocked)).first()
    prior = math.log(pb[0] + 1.0) - math.log(pb[1] + 1.0) if pb[0] else -1.0
    # ``smooth`` words of the overall distribution are added to both classes, so
    # a word that one class never has does not speak for the smaller class
    share = (F.col("nb") + F.col("na")) / F.lit(float(max(1, (nb or 0) + (na or 0))))
    odds = (F.log((F.col("nb") + smooth * share) / ((nb or 0) + smooth))
            - F.log((F.col("na") + smooth * share) / ((na or 0) + smooth)))
    scored = reliable_checkpoint(split.select("name", F.explode("words").alias("word")).join(
        per.select("word", odds.alias("odds")), "word").groupBy("name").agg(F.sum("odds").alias("odds")))
    judged = (names.join(scored, "name").groupBy("host", "shape").agg(F.sum("odds").alias("odds")))
    judged = reliable_checkpoint(keys.select("host", "shape").join(judged, ["host", "shape"], "left").select(
        "host", "shape", (F.coalesce("odds", F.lit(0.0)) + prior).alias("score")))

    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return (src.join(judged, ["host", "shape"]).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score"))
