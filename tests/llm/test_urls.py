"""URL filters: hosts, paths and domain rules in plain Python, mined rules against counted supports, edge cases."""

import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from bazaarlens.llm import urls
from bazaarlens.llm.queries import labelled_urls, op5_url_filters
from conftest import DATA

ODD = [
    None, "", "no host", "http://", "HTTP://A.Example.NET/en/x?q=1#f", "x://example.net/en", "x://example.net/en/", "x://notexample.net/en/",
    "x://deep.sub.example.com/de/1", "x://example.com/DE/1", "a://b://c.net/p", "x://host?://y/de/", "x://ÉCOLE.org/fr/#/", "x://org/fr/",
    "x://net", "x://net/", "x://h\nost.net/a\nb?c", "x://a.org#/fr/", "x://Iİ.net/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[at:]
    end = min((tail.index(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), tail[:end]


def domain(host, path):
    """(rule, verdict) of the longest rule that fits, else (None, None)."""
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    best = (None, None)
    for rule, verdict in rules.items():
        own_host, own_path = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == own_host or host.endswith("." + own_host)) and path.startswith(own_path) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


def mined(baskets, min_support, min_confidence, min_lift):
    """Rules {(antecedent, verdict): (confidence, support)} by counting every set of tokens, pruned by the definition."""
    n, counts, with_label, labels = len(baskets), Counter(), Counter(), Counter(v for _, v in baskets)
    for tokens, verdict in baskets:
        for size in range(1, len(tokens) + 1):
            for some in itertools.combinations(sorted(tokens), size):
                counts[some] += 1
                with_label[some, verdict] += 1
    least = math.ceil(min_support * n)
    rules = {
        (some, v): (c / counts[some], c / n)
        for (some, v), c in with_label.items()
        if c >= least and c / counts[some] >= min_confidence and c / counts[some] / (labels[v] / n) >= min_lift
    }
    covered = {
        (some, v)
        for some, v in rules
        for token in some
        if rules.get((tuple(t for t in some if t != token), v), (0, 0))[0] >= rules[some, v][0]
    }
    return {k: r for k, r in rules.items() if k not in covered}


def best(tokens, rules):
    fitting = [(c, s, " ".join(some), v) for (some, v), (c, s) in rules.items() if set(some) <= set(tokens)]
    return max(fitting, default=(None, None, None, None))


def corpus(seed):
    rng = random.Random(seed)
    words = ["ads", "win", "news", "wiki"]
    rows = []
    for _ in range(300):
        word = rng.choice(words)
        url = f"{rng.choice(['http', 'https'])}://{rng.choice(['a', 'b'])}.{rng.choice(['de', 'fr'])}/{word}/{rng.randint(1, 99)}"
        rows.append((url, "block" if rng.random() < {"ads": 0.9, "win": 0.6}.get(word, 0.1) else "allow"))
    return rows


def test_rules_and_verdicts_by_brute_force(spark):
    rows = corpus(1)
    labelled = spark.createDataFrame(rows, "url string, label string").withColumn("token", F.lit("clash"))
    tokens = {r["url"]: r["tokens"] for r in labelled.select("url", urls.url_tokens(F.col("url")).alias("tokens")).distinct().collect()}
    expected = mined([(tokens[u], v) for u, v in rows], 0.02, 0.5, 1.1)
    rules = urls.mine_rules(labelled, 0.02, 0.5, 1.1)
    got = {(tuple(r["antecedent"]), r["verdict"]): (r["confidence"], r["support"]) for r in rules.collect()}
    assert set(got) == set(expected) and len(expected) > 5
    assert all(math.isclose(x, y) for k in got for x, y in zip(got[k], expected[k]))
    for r in urls.judge(labelled, rules).collect():
        confidence, _, text, verdict = best(tokens[r["url"]], got)
        assert (r["mined_verdict"], r["mined_rule"], r["mined_confidence"]) == (verdict or "allow", text, confidence)


def test_hosts_paths_and_domain_rules(spark):
    rows = list(enumerate(ODD)) + [(0, None), (4, ODD[4]), (None, "x://q.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("mined_rule", F.lit("clash")).withColumn("host", F.lit("h"))
    labelled = spark.createDataFrame(corpus(2), "url string, label string")
    got = urls.filter_urls(pages, labelled).collect()
    assert len(got) == len(rows)
    by_id = dict(rows[: len(ODD)]) | {None: "x://q.net/"}
    for r in got:
        host, path = parts(by_id[r["page_id"]])
        rule, verdict = domain(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_no_labels_no_pages(spark):
    pages = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string")
    none = spark.createDataFrame([], "url string, label string")
    got = urls.filter_urls(pages, none).collect()
    assert len(got) == len(ODD) and all(r["mined_rule"] is None and (r["rule"] or r["verdict"] == "allow") for r in got)
    assert urls.filter_urls(pages.limit(0), none).count() == 0


def test_query(spark):
    folder = f"{DATA}/sf0.01"
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    labelled = labelled_urls(spark, folder)
    rules = {
        (tuple(r["antecedent"]), r["verdict"]): (r["confidence"], r["support"]) for r in urls.mine_rules(labelled, 0.002, 0.5, 1.1).collect()
    }
    read = spark.read.parquet(f"{folder}/pages.parquet")
    tokens = {r["page_id"]: r["t"] for r in read.select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    rows = op5_url_filters(spark, folder).collect()
    assert {r["page_id"] for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        host, path = parts(pages[r["page_id"]])
        rule, verdict = domain(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or best(tokens[r["page_id"]], rules)[3] or "allow")
