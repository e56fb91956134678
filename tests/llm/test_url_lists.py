import datetime as dt
import random

import duckdb

from gridloom.llm import url_lists as u


def active(host, at, entries):
    """The state of the most specific listed domain at a time, entry by entry."""
    if host is None:
        return None
    parts = host.split(".")
    names = [".".join(parts[i:]) for i in range(max(1, len(parts) - 1))]
    rank = {"block": 0, "allow": 1, "remove": 2}
    for name in names:
        mine = [(d, rank[a], a) for n, a, d in entries if n == name and d <= at]
        if mine and max(mine)[2] != "remove":
            return max(mine)[2]
    return None


def test_as_of_join(spark):
    rng = random.Random(1)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
    names = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.b.org", "single"]
    entries = [(rng.choice(names), rng.choice(["block", "allow", "remove"]), day()) for _ in range(60)]
    hosts = [*names, "other.net", "deep.y.x.a.com"]
    rows = [(i, f"https://{rng.choice(hosts)}:80/p?q#f", day()) for i in range(400)] + [(900, None, day()), (901, "nonsense", day()), (902, "http://a.com", None), (900, None, day())]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").selectExpr("*", "1 as list_salt", "'z' as kept", "'h' as Host")
    odd = [(None, "block", day()), ("a.com", None, day()), ("b.org", "block", None)]
    got = u.filter_urls(captures, spark.createDataFrame(entries + odd, "domain string, action string, listed_at timestamp")).collect()
    assert len(got) == len(rows)
    assert all(r._kept == "z" and r._Host == "h" and r.list_salt == 1 for r in got)
    for r in got:
        host = r.url.split("//")[1].split("/")[0].split(":")[0] if r.url and "//" in r.url else None
        want = active(host, r.fetched_at, entries) if r.fetched_at else None
        assert (r.host, r.action, r.kept) == (host, want, want != "block")


def test_deep_hosts(spark):
    rng = random.Random(2)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
    labels = [f"l{i}" for i in range(12)] + ["example", "com"]
    names = [".".join(labels[i:]) for i in range(13)]
    entries = [(names[i], a, dt.datetime(2024, 1, d)) for i, a, d in ((11, "block", 1), (0, "allow", 5), (1, "block", 9), (0, "remove", 20))]
    entries += [(n, rng.choice(["block", "allow", "remove"]), day()) for n in names[2:9] for _ in range(2)]
    captures = [(i, f"http://{rng.choice(names)}/", day()) for i in range(300)]
    frames = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, "domain string, action string, listed_at timestamp")
    got = u.filter_urls(*frames).collect()
    assert len(got) == 300
    for r in got:
        want = active(r.host, r.fetched_at, entries)
        assert (r.action, r.kept) == (want, want != "block")
        assert r.entry_domain is None or r.host.endswith(r.entry_domain)


def test_nothing_to_do(spark):
    captures = spark.createDataFrame([(1, "http://a.com/" + "x" * 1_000_000, None), (2, "http://a.com", dt.datetime(2024, 1, 1))], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("a.com", "block", dt.datetime(2023, 1, 1))], "domain string, action string, listed_at timestamp")
    assert u.filter_urls(captures.where("page_id = 7"), entries).collect() == []
    assert [r.kept for r in u.filter_urls(captures, entries.where("domain = 'b'")).collect()] == [True, True]
    assert sorted((r.page_id, r.host, r.kept) for r in u.filter_urls(captures, entries).collect()) == [(1, "a.com", True), (2, "a.com", False)]


def test_addresses_have_no_parents(spark):
    day = dt.datetime(2024, 1, 1)
    urls = ["http://[2001:DB8::1]:80/p", "http://10.20.30.40/", "http://x.30.40/", "http://[2001:db8::2]/"]
    captures = spark.createDataFrame([(i, x, day) for i, x in enumerate(urls)], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([(d, "block", day) for d in ("[2001:db8::1]", "30.40", "20.30.40")], "domain string, action string, listed_at timestamp")
    got = sorted((r.page_id, r.host, r.kept) for r in u.filter_urls(captures, entries).collect())
    assert got == [(0, "[2001:db8::1]", False), (1, "10.20.30.40", True), (2, "x.30.40", False), (3, "[2001:db8::2]", True)]


def test_hot_hosts(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, "http://hot.a.com/" if i % 3 == 0 else None if i % 3 == 1 else f"http://h{i}.a.com/", day) for i in range(3000)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp")
    hot = u.hot_hosts(captures.select(u.host_of("url").alias("host"))).collect()
    assert [tuple(r) for r in hot] == [("hot.a.com", 334)]
    entries = spark.createDataFrame([("hot.a.com", "block", day)], "domain string, action string, listed_at timestamp")
    got = u.filter_urls(captures, entries).collect()
    assert len(got) == 3000 and sum(not r.kept for r in got) == 1000


def test_hosts(spark):
    urls = ["http://A.b.COM/x", "https://u:p@h.org:81?q", "//c.de", "ftp://x.y.", "mailto:a@b", "", None, "http:///p"]
    got = [r.h for r in spark.createDataFrame([(x,) for x in urls], "url string").select(u.host_of("url").alias("h")).collect()]
    assert got == ["a.b.com", "h.org", "c.de", "x.y", None, None, None, None]


def test_query_is_its_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://s{rng.randrange(9)}.d{rng.randrange(6)}.example.{rng.choice(['com', 'org'])}/{i}", "") for i in range(300)] + [(7, None, ""), (None, "http://q.r.st/", "")]
    rows += [(400 + i, f"http://{'.'.join(f'l{rng.randrange(3)}' for _ in range(n))}.example.com/", "") for i, n in enumerate((5, 6, 7, 8, 9, 12, 12, 12))] + [(450, "http://[2001:db8::1]:80/", ""), (451, "http://10.2.3.4/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = u.op6(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({u.OP6_SQL})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
