import fnmatch
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventdocs.llm import urls
from eventdocs.llm.queries import URL_RULES
from eventdocs.llm.urls import ALLOW, BLOCK, Rule


def plain(rule, host, path):
    if set(rule.host) & set("*?"):
        host_fits = fnmatch.fnmatchcase(host, rule.host)
    else:
        host_fits = host == rule.host or host.endswith("." + rule.host)
    return host_fits and fnmatch.fnmatchcase(path, rule.path if set(rule.path) & set("*?") else rule.path + "*")


parts = st.text("ab./", max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab.*?", min_size=1, max_size=7), st.text("ab/*?", max_size=6)), max_size=9),
       st.lists(st.tuples(st.text("ab.", max_size=9), parts), max_size=6))
def test_all_rules_at_once_equal_one_after_another(rules, found):
    rules = [Rule(BLOCK, *r) for r in rules]
    hits = urls.Automaton(rules).hits([h for h, _ in found], [p for _, p in found])
    assert hits.shape == (len(found), len(rules))
    assert hits.tolist() == [[plain(r, h, p) for r in rules] for h, p in found]


def test_rules_over_several_words():
    rng = random.Random(2)
    rules = [Rule(BLOCK, "".join(rng.choices("abc.", k=rng.randrange(1, 40))), "/" + "*" * (i % 2) + "x" * i) for i in range(30)]
    machine = urls.Automaton(rules)
    assert machine.start.shape[0] > 8
    hosts = [("sub." if i % 2 else "") + r.host for i, r in enumerate(rules)]
    paths = [r.path.replace("*", "yy") + "z" for r in rules]
    assert machine.hits(hosts, paths).tolist() == [[plain(r, h, p) for r in rules] for h, p in zip(hosts, paths)]


def judged(spark, values, rules=URL_RULES, **more):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "page_id bigint, url string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules, **more).collect()}


def test_the_longest_rule_wins(spark):
    got = judged(spark, [
        "http://WWW.Example.COM/en/1", "https://a.example.com/en/x?q=/es/", "http://example.com/EN/", "http://x.net/es/1#f",
        "http://x.net/de/", "http://net/fr/", "http://casino.org", "http://casino.com/", "http://notexample.com", None, "no scheme",
        "x://", "http://a.com#/en/", "http://example.com/en", "http://é.NET/es/ü?", "a://b://c/d",
    ])
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", ALLOW), 1: ("a.example.com", "/en/x", "example.com/en/", BLOCK),
        2: ("example.com", "/EN/", "com/", ALLOW), 3: ("x.net", "/es/1", "net/es/", BLOCK), 4: ("x.net", "/de/", None, ALLOW),
        5: ("net", "/fr/", "net/fr/", BLOCK), 6: ("casino.org", "", None, BLOCK), 7: ("casino.com", "/", "com/", ALLOW),
        8: ("notexample.com", "", None, ALLOW), 9: ("", "", None, ALLOW), 10: ("", "", None, ALLOW), 11: ("", "", None, ALLOW),
        12: ("a.com", "", None, ALLOW), 13: ("example.com", "/en", "com/", ALLOW), 14: ("é.net", "/es/ü", "net/es/", BLOCK),
        15: ("b:", "//c/d", None, ALLOW),
    }


def test_ties_long_urls_and_odd_tables(spark):
    tie = (Rule(ALLOW, "b.cc", "/x"), Rule(BLOCK, "cc", "/x/y"), Rule(BLOCK, "b.cc", "/x"))
    assert judged(spark, ["u://a.b.cc/x/yz", "u://b.cc/x"], tie) == {
        0: ("a.b.cc", "/x/yz", "b.cc/x", ALLOW), 1: ("b.cc", "/x", "b.cc/x", ALLOW)}
    long = "http://x.net/es/" + "a" * 20_000
    assert judged(spark, [long, ""])[0][2:] == ("net/es/", BLOCK)
    assert judged(spark, ["http://a.com/"], (), globs=()) == {0: ("a.com", "/", None, ALLOW)}
    df = spark.createDataFrame([(None, "http://a.net/es/"), (1, "u://q"), (1, "u://q")], "page_id bigint, url string")
    df = df.withColumns({"host": F.lit(1), "rule": F.lit("r"), "_url": F.lit("z")})
    assert sorted(str(r.page_id) for r in urls.judge_urls(df, URL_RULES).collect()) == ["1", "1", "None"]
    assert urls.judge_urls(df.limit(0), URL_RULES).collect() == []
