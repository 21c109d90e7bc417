from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from rideflow.llm import urls
from tests.llm.fixtures import FOLDER

ODD = [
    None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://a.org?x/es/",
    "http://EXAMPLE.org/es/1", "x://sub.example.org/en/1", "x://sub.example.org/en/1999#a",
    "x://badexample.org/es/", "x://example.org/es", "y://a.com/de/", "y://a.com/fr/?q", "y://com/fr/",
    "z://m.spam-farm.example.net/en/", "z://spam-farm.example.org/", "z://x.notspam-farm.net/",
    "z://host.net/a?b://c.org/es/", "a://b://example.org/es/", "q://.org/x", "q://..com/de/", "q://free-bets",
    "http://h.net/" + "p" * 100_000, "http://ünï.example.org/en/1",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for key, verdict in urls.RULES:
        name, start = key.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(key), key, verdict))
    if fits:
        return host, path, *max(fits)[1:]
    return host, path, None, "block" if set(host.split(".")) & set(urls.LISTED_NAMES) else "allow"


def pages(spark, values):
    return spark.createDataFrame(
        [(i, u, "h", "p") for i, u in enumerate(values)], "page_id long, url string, host string, key string"
    )


def check(df, rows):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}
    assert got == {i: expected(u) for i, u in rows}


def test_odd_rows(spark):
    df = pages(spark, ODD)
    check(urls.judge(df), list(enumerate(ODD)))
    assert urls.judge(df.unionByName(df)).count() == 2 * len(ODD)


def test_empty_table(spark):
    assert urls.judge(pages(spark, ["x://a.org/"]).limit(0)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet(f"{FOLDER}/pages.parquet")
    check(urls.judge(df), [(r.page_id, r.url) for r in df.collect()])


def test_beyond_the_bound_a_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_BITS", 0)
    check(urls.judge(pages(spark, ODD)), list(enumerate(ODD)))


def test_cascade_is_exact_over_its_universe(spark, tmp_path):
    """Thousands of keys, so that several filters are needed."""
    keys = spark.range(40_000).select(
        F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed")
    )
    keys.write.parquet(str(tmp_path / "keys"))
    universe = spark.read.parquet(str(tmp_path / "keys"))
    levels = urls.cascade(universe)
    assert len(levels) > 2
    judged = urls.with_filters(universe, levels).withColumn("got", urls.listed(F.col("key"), levels))
    assert judged.where("got <> listed").count() == 0
    assert judged.where("got").count() == 5715


def _sites(spark):
    """A page for each of 60,000 hosts, a third of them of one domain; 15,000 hosts are listed."""
    number = F.col("id")
    name = F.concat(F.lit("h"), number % 20_000)
    host = F.when(number % 3 == 0, F.concat(name, F.lit(".hot.net"))).otherwise(
        F.concat(F.lit("Www."), name, F.lit(".site"), number % 7, F.lit(".net"))
    )
    df = spark.range(60_000).select(
        number.alias("page_id"), F.concat(F.lit("http://"), host, F.lit("/p?q")).alias("url")
    )
    odd = [None, "", "a/b", "NOT.there", "H3.hot.net"]
    listed = [f"h{i}.{d}.net" for i in range(0, 20_000, 4) for d in ("hot", "site1", "SITE5")]
    return df, odd + listed + listed[:1000]


def _tabled(url, listed):
    host, path, rule, verdict = expected(url)
    labels = host.split(".")
    hit = any(".".join(labels[i:]) in listed for i in range(len(labels)))
    return host, path, rule, "block" if rule is None and hit else verdict


@pytest.mark.parametrize("joined", [False, True])
def test_a_long_list_of_hosts_needs_several_filters(spark, monkeypatch, joined):
    levels = []
    made = urls.cascade
    monkeypatch.setattr(urls, "cascade", lambda u: levels.append(made(u)) or levels[-1])
    if joined:
        monkeypatch.setattr(urls, "MOST_BITS", 0)
    df, listed = _sites(spark)
    hosts = spark.createDataFrame([(h, 1) for h in listed], "name string, key int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, hosts=hosts).collect()}
    lower = {h.lower() for h in listed if h}
    assert got == {r.page_id: _tabled(r.url, lower) for r in df.collect()}
    blocked = sum(v[3] == "block" for v in got.values())
    assert 5_000 < blocked < 30_000
    assert levels == [None] if joined else len(levels[0]) > 3


def test_a_table_without_hosts_lists_nothing(spark):
    none = spark.createDataFrame([], "host string")
    check(urls.judge(pages(spark, ODD), hosts=none), list(enumerate(ODD)))
