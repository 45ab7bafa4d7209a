import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerflow.llm import url_filter as U


def slow(url, rules=U.RULES):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for h, p, a in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = ["http://example.com/en/1", "https://WWW.Example.COM/en/", "https://www.example.com/en", "http://a.net/es/x?y", "http://net/fr/",
        "http://xnet/es/", "http://.net/es/", "http://a.com", "http://a.com/", "http://a.com?x=/", "http://a.com#/", "com/", "", None, "://", "x://y://z.com/",
        "ftp://m.example.com/en/#top", "http://a.com/\nb", "http://ÉX.com/é", "http://a.b.c.d.e.example.com/en/en/", "http://example.com./en/", "http://a.org/"]


def test_equals_plain_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:3])], "page_id int, url string, html string")
    got = U.judge(df, "url")
    assert sorted(got.columns) == sorted(df.columns + ["host", "path", "rule", "verdict"])
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == slow(r.url), r.url
    assert U.judge(df.limit(0), "url").collect() == []
    taken = df.select("url", F.lit("mine").alias("Host"), F.lit(7).alias("rule"), F.lit("b").alias("best"))
    got = U.judge(taken, "url")
    assert sorted(got.columns) == sorted(["url", "Host", "rule", "best", "host_", "path", "rule_", "verdict"])
    for r in got.collect():
        assert (r.host_, r.path, r.rule_, r.verdict) == slow(r.url) and (r.Host, r.rule, r.best) == ("mine", 7, "b")


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).cache()
    listed = universe.filter("pmod(hash(key), 10) = 0").unionByName(universe.limit(0))
    cascade = U.Cascade(listed, universe, 3)
    assert len(cascade.levels) > 1                    # level 1 alone lets wrong keys through
    got = {r.key for r in universe.filter(cascade.holds(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}
    empty = U.Cascade(listed.limit(0), universe, 4)
    assert universe.filter(empty.holds(F.col("key"))).count() == 0


def test_slices_and_passes_give_the_same(spark):
    rules = [(f"h{i}.org", f"/{'ab'[j]}", ("allow", "block")[(i + j) % 2]) for i in range(300) for j in range(2)]
    rules += [("org", "/", "block"), ("h7.org", "/aa", "allow")]
    urls = [f"http://x.h{i}.org/{p}" for i in range(0, 400, 3) for p in ("a", "aa1", "b", "c", "")]
    df = spark.createDataFrame([(u, "b") for u in urls], "url string, best string")
    assert U._slices(300, 1000, 512) > 4
    for max_bits, at_once in ((512, 3), (1 << 23, 16)):   # several passes of several slices; one of one
        got = U.judge(df, "url", rules, "none", max_bits, at_once)
        assert got.columns.count("best") == 1
        for r in got.collect():
            want = slow(r.url, rules)
            assert (r.host, r.path, r.rule, r.verdict) == (*want[:3], want[3] if want[2] else "none")


def test_a_million_listed_keys_are_exact(spark):
    n = 1_000_000
    assert U._slices(n, 2 * n, U.MAX_BITS) == 2
    universe = spark.range(n // 2, 2 * n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    wrong = 0
    for part in range(2):
        at = F.pmod(F.xxhash64("key", F.lit("slice")), F.lit(2)) == part
        keys = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).filter(at)
        cascade = U.Cascade(keys, universe.filter(at), part + 1)
        assert all(level.bits <= U.MAX_BITS for level in cascade.levels)
        wrong += universe.filter(at).filter(
            cascade.holds(F.col("key")) != (F.substring("key", 2, 9).cast("int") < n)).count()
    assert wrong == 0
