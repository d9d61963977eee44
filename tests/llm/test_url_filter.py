import math
import random
import re
import time
from collections import Counter

import pytest

from bazaar.llm.url_filter import LEAST_TOTAL, LONGEST, RULES, SEEDS, filter_urls, viterbi

SCHEMA = "page_id bigint, url string, html string, host string, n int, score string"


def pages(spark, urls, html="<p>the water house cheap pills win casino</p><script>junk</script>"):
    return spark.createDataFrame([(i, u, html, "h", 1, "s") for i, u in enumerate(urls)], SCHEMA).repartition(3)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:end], rest[end:]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_viterbi_finds_the_likeliest_split():
    counts, total = {"cheap": 50, "pills": 20, "pill": 30, "she": 5, "a": 90, "s": 3}, 1000.0

    def cost(words):
        return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)
                   for w in words)

    def splits(s):
        yield [s]
        for i in range(1, len(s)):
            for rest in splits(s[i:]):
                yield [s[:i], *rest]
    for name in ("cheappills", "ashepill", "xqz", "apills"):
        assert cost(viterbi(name, counts, total)) == max(map(cost, splits(name)))
    assert viterbi("cheappills", counts, total) == ["cheap", "pills"]


def test_parts_rules_and_verdicts(spark):
    rng = random.Random(1)
    urls = [f"http://www.{rng.choice(['water', 'house', 'waterhouse'])}.example.net/en/{rng.randint(1, 999)}?x=//"
            for _ in range(150)]
    urls += [f"https://{h}.example.net/en/{i}#a" for i in range(4) for h in ("cheappills", "casino-win", "free-bets")]
    urls += ["http://A.example.ORG/es/1", "x://example.org/en/1", "x://example.org/en/2", "x://badexample.org",
             "x://a.com/de/", "x://a.com/fr/x?y", "x://a.com/De/", "ftp://com/de/1", "no scheme", "", None, "://", "x://é.com",
             "first://a.net/://b.org/es/", "x://h?q=/de/", "x://h#/de/"]
    got = {r.page_id: r for r in filter_urls(pages(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        r = got[i]
        assert (r.host, r.path) == parts(u)
        rule, verdict = ruled(r.host, r.path)
        assert r.rule == rule and (verdict is None or r.verdict == verdict)
        if rule is None:
            spam = any(w in r.host for w in ("pills", "casino", "bets"))
            assert r.verdict == ("block" if spam else "allow"), u


def test_empty_table_and_nulls(spark):
    assert filter_urls(pages(spark, [])).count() == 0
    got = filter_urls(pages(spark, [None, "x"], None)).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("", "", None, "allow")] * 2


SPAM = "<p>casino poker jackpot lottery and betting: slot machines, roulette, hub</p>"
PLAIN = "<h1>About us</h1><p>The town hall has news of the college and the county for all of you</p>"


def mixed(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", 1, "s") for i, (u, h) in enumerate(rows)], SCHEMA).repartition(3)


def brute_scores(rows, smooth=100.0):
    """The same classifier over plain lists, page by page."""
    names_of = [[(n, True) for n in re.findall("[a-z]+", parts(u)[0])]
                + [(n, False) for n in re.findall("[a-z]+|0", re.sub("[0-9]+", "0", parts(u)[1].lower()))]
                for u, _ in rows]
    shown = [re.split("[^a-z]+", re.sub(r"(?s)<(script|style).*?</\1>|<[^>]*>", " ", h or "").lower()) for _, h in rows]
    counts = Counter(w for words in shown for w in words)
    for host in {parts(u)[0] for u, _ in rows}:
        counts.update(w for label in host.split(".") if "-" in label for w in re.split("[^a-z]+", label))
    counts = {w: n for w, n in counts.items() if 1 < len(w) <= LONGEST}
    total = max(LEAST_TOTAL, sum(counts.values()))
    split = {n: ["0"] if n == "0" else viterbi(n, counts, total) for ns in names_of for n, _ in ns}
    seeded = {n for n, ws in split.items() if n in SEEDS or (
        set(ws) & set(SEEDS) and all(len(w) > 2 and w in counts for w in ws))}
    bad = []
    for names, words in zip(names_of, shown):
        said = [w for w in words if w in SEEDS]
        bad.append(any(of_host and n in seeded for n, of_host in names)
                   or (len(set(said)) >= 4 and len(said) >= .05 * len(words)))
    nb, na = Counter(), Counter()
    for names, b in zip(names_of, bad):
        for n, _ in names:
            (nb if b else na).update(split[n])
    b_all, a_all = sum(nb.values()), sum(na.values())

    def odds(w):
        share = (nb[w] + na[w]) / (b_all + a_all)
        return math.log((nb[w] + smooth * share) / (b_all + smooth)) - math.log((na[w] + smooth * share) / (a_all + smooth))
    prior = math.log(sum(bad) + 1) - math.log(len(bad) - sum(bad) + 1) if any(bad) else -1.0
    return [prior + sum(odds(w) for n, _ in names for w in split[n]) for names in names_of]


def two_views():
    rows = [(f"http://www.{h}.net/news/{i}", PLAIN) for i in range(12)
            for h in ("townhall", "county-news", "collegenews", "essex", "bethany", "alphabet", "sussex")]
    rows += [(f"http://{h}.net/play/{i}", SPAM) for i in range(6) for h in ("slotmachines", "roulettehub", "free-casino")]
    return rows + [("http://slotroulette.net/play/now", PLAIN), ("http://machines.net/play", None), (None, SPAM), ("x", None)]


def test_scores_equal_a_plain_naive_bayes(spark):
    rows = two_views()
    got = {r.page_id: r.score for r in filter_urls(mixed(spark, rows)).collect()}
    for i, want in enumerate(brute_scores(rows)):
        assert got[i] == pytest.approx(want, abs=1e-9), rows[i]


def test_hosts_without_a_seed_word(spark):
    """Page text labels what no seed names; letters inside a name are no seed."""
    rows = two_views()
    got = {r.page_id: r for r in filter_urls(mixed(spark, rows)).collect()}
    for i, (url, _) in enumerate(rows):
        host = parts(url)[0]
        spam = any(w in host for w in ("slot", "roulette", "casino", "machines"))
        assert got[i].verdict == ("block" if spam else "allow"), url


def test_very_long_names(spark):
    rng = random.Random(4)
    name = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    rows = [(f"http://long.net/{name}", PLAIN), (f"http://{name}.net/", None), ("http://townhall.net/", PLAIN)]
    start = time.time()
    got = {r.page_id: r for r in filter_urls(mixed(spark, rows)).collect()}
    assert time.time() - start < 90
    assert got[0].path == "/" + name and got[1].host == name + ".net" and {r.verdict for r in got.values()} == {"allow"}
