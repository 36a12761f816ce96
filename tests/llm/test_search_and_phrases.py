"""Ranked search, collocations and the URL filter against plain versions, and on nulls, ties, empty tables and clashing names."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heaploom.llm import collocations, search, url_filter
from heaploom.llm.url_filter import Rule

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], DOCS).repartition(3)


# -- search -----------------------------------------------------------------------


def plain_search(docs, queries, k):
    terms = [(i, TERMS.findall(lower(t))) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in terms if t]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in queries:
        scores = []
        for at, (i, c, n) in enumerate(held):
            m = 50 + 50 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(TERMS.findall(lower(text))) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, at, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=300):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Éa", "ß", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(k, " ".join(draw.choices(words, weights, k=draw.choice([1, 5, 20, 200])))) for k in range(n)]
    rows += [(1000 + k, rows[k % 7][1]) for k in range(60)]  # repeated texts tie
    return [*rows, (5, rows[5][1]), (2000, None), (2001, ""), (2002, "... !"), (2003, "W1 w1,W1"), (2004, " ".join(draw.choices(words, weights, k=30_000)))]


@pytest.mark.parametrize(("k", "block"), [(3, 8192), (50, 16), (1000, 16)])
def test_search_equals_all_scores(spark, monkeypatch, k, block):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "LIST_SHARD", 40)
    docs = corpus(k)
    draw = random.Random(9)
    queries = [(q, " ".join(draw.choices([f"w{j}" for j in range(450)], k=draw.choice([1, 3, 30])))) for q in range(12)]
    queries += [(100, None), (101, ""), (102, "nothing-of-it ¿"), (103, "w1 W1 w2"), (103, "w1 W1 w2"), (None, "w3")]
    asked = spark.createDataFrame([(*q, "z", "z") for q in queries], "item_id long, text string, doc_id string, score string").repartition(2)
    found = search.ranked_search(frame(spark, [(i, t, "en") for i, t in docs]), asked, k=k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, [q for q in queries if q[1]], k)


def test_search_in_several_rounds_and_of_nothing(spark):
    docs = corpus(4, 60)
    queries = [(q, f"w{q} w{q + 3} w1") for q in range(20)]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    found = search.ranked_search(frame(spark, [(i, t, "en") for i, t in docs]), asked, k=5, query_terms=10)
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, queries, 5)
    assert search.ranked_search(frame(spark, []), asked).count() == 0
    assert search.ranked_search(frame(spark, [(1, "a b", "en")]), asked.limit(0)).count() == 0


def test_threshold_is_the_largest_that_holds():
    draw = random.Random(2)
    for _ in range(300):
        import numpy as np

        heads = np.array([draw.randint(0, 40) for _ in range(draw.randint(1, 8))])
        bound = draw.randint(0, int(heads.sum()))
        t = search.uniform_threshold(heads, bound)

        def most(x):
            return sum(min(h, x - 1) for h in heads.tolist() if x > 0)

        assert bound == 0 or most(t) < bound <= most(t + 1) or t > heads.max()


# -- collocations -----------------------------------------------------------------


def plain_collocations(rows, least, top, max_words=4):
    count, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    count[lang or "und", tuple(words[i : i + n])] += 1
    frequent = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in frequent.items():
        longer = [b for (g, q), b in frequent.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, total[lang], -s) for lang, of in out.items() for r, (s, a, p, left, right) in enumerate(sorted(of)[:top]))


def phrases(seed):
    draw = random.Random(seed)
    words = ["the", "of", "New", "york", "City", "hall", "Übung", "a", "b", "don't", "x-y"]
    fixed = ["New York City hall", "the the the", "a b. a b", "of\tthe", "Übung macht"]
    rows = []
    for k in range(250):
        parts = [draw.choice(fixed) if draw.random() < 0.4 else draw.choice(words) for _ in range(draw.choice([1, 4, 30]))]
        rows.append((draw.choice([" ", "  ", " ", ", ", "\n"]).join(parts), draw.choice(["en", "en", "de", None, "und"])))
    return [*rows, *rows[:5] * 8, (None, "en"), ("", "en"), ("...\n", "fr"), (" ".join(draw.choices(words, k=300_000)), "es")]


@pytest.mark.parametrize(("bits", "batch"), [(27, 400_000), (6, 50)])
def test_collocations_equal_plain_counts(spark, monkeypatch, bits, batch):
    # A filter of 64 bits lets nearly everything through, and small batches are combined by the shuffle: the result is the same.
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "BATCH_WORDS", batch)
    rows = phrases(bits)
    docs = frame(spark, [(k, *r) for k, r in enumerate(rows)]).withColumn("phrase", F.lit("z")).withColumn("n", F.lit("z"))
    found = collocations.collocations(docs, top=40)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, 30, 40)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, "a b", "en"), (2, None, None)])).count() == 0


# -- URL filter -------------------------------------------------------------------


def plain_rule(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^/?#]*([^?#]*)", rest, re.S).group(1)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.action


def test_urls_are_parsed_and_ruled(spark):
    urls = [
        None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://Example.com/", "https://www.example.com/en/1?x=/y#z", "https://example.com/en/", "https://example.com/EN/",
        "https://a.net/es/1", "https://a.net/esx", "https://net/fr/", "https://xnet/fr/", "https://m.x.org?a://b/c", "ftp://h#/x", "https://h.org/a\nb?c", "https://É.Org/É", "x://y://z.com/w",
    ]
    pages = spark.createDataFrame([(k, u, "z", "z") for k, u in enumerate([*urls, *urls])], "page_id long, url string, host string, key string").repartition(2)
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert len(found) == 2 * len(urls)
    for k, u in enumerate([*urls, *urls]):
        host, path, rule, action = plain_rule(u, url_filter.RULES)
        assert (found[k]["host"], found[k]["path"], found[k]["rule"], found[k]["verdict"]) == (host, path, rule, action or "allow")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_templates_generalise_merge_and_reject(spark):
    draw = random.Random(3)
    rows = []

    def add(host, path, bad):
        rows.append((len(rows), f"https://{host}{path}", bad))

    for k in range(300):
        known = k % 3 == 0
        # Slugs of very many kinds below /promo/ are unwanted where labelled; those below /news/ are wanted.
        add("shop.org", f"/promo/{''.join(draw.choices('ghjkmnpq', k=7))}", True if known else None)
        add("shop.org", f"/news/{''.join(draw.choices('ghjkmnpq', k=7))}", False if known else None)
        # Three sections of one shape, all sampled alike, are one branch; a fourth of another shape is not.
        add("blog.org", f"/{draw.choice(['red', 'green', 'blue'])}/{k}.html", (k % 30 != 0) if known else None)
        add("blog.org", f"/about/team/{k}", False if known else None)
        # Nothing is known of this host.
        add("quiet.org", f"/promo/{k}", None)
    rows += [(len(rows), "https://deep.org/" + "/".join("abcdefghijkl" * 200), None), (len(rows) + 1, "https://deep.org/" + "y" * 50_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, unwanted boolean").repartition(3)
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, [Rule("allow", "shop.org", "/promo/gh")], label_col="unwanted").collect()}
    verdicts = Counter()
    for k, url, _ in rows:
        verdicts[url.split("/")[2] + "/" + url.split("/")[3][:5], found[k]["verdict"] if found[k]["rule"] is None else "ruled"] += 1
    assert {v for (s, v) in verdicts if s == "shop.org/promo"} == {"block", "ruled"} and {v for (s, v) in verdicts if s == "shop.org/news"} == {"allow"}
    assert {s: v for (s, v) in verdicts if s.startswith("blog")} == {"blog.org/red": "block", "blog.org/green": "block", "blog.org/blue": "block", "blog.org/about": "allow"}
    assert {v for (s, v) in verdicts if s.startswith(("quiet", "deep"))} == {"allow"}
    templates = {r["template"] for r in found.values()}
    assert "/promo/{*}" in templates and "/news/{*}" in templates and "/about/team/{n}" in templates
    assert any(re.fullmatch(r"/\{blue~.*\}/\{n\}\.html", t) for t in templates) and not any(t.startswith(("/red", "/green", "/blue")) for t in templates)


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "https://a.org/b/1")], "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    plan = pages.select(host.alias("h"), path.alias("p")).withColumn("r", url_filter.matching_rule(F.col("h"), F.col("p"), url_filter.RULES)).withColumn("s", url_filter.segments(F.col("p")))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
