"""URL filters by temporal list join, in DataFrame operations only.

A list has dated entries: from its date on, a domain and all hosts under it are
``block``ed, ``allow``ed, or back without an entry (``remove``). Entries become
validity intervals: for each host that occurs, the entries of the host and its
parent domains are laid on one time line, the state of the most specific domain
that has one holds, and each change opens an interval that the next one ends.
An as-of join then gives every capture the interval that holds its fetch time.

A host may have any share of the captures: a host with more than one part in
``shares`` of them is hot, its captures are salted by their id and its
intervals repeated once for each salt, so no task gets a hot host whole. There
are fewer than ``shares`` hot hosts, whatever the captures, so their list may
be broadcast. Hosts' time lines are made from distinct hosts, never from
captures.

Defined results: a null url or one without a host, and a null fetch time, have
no entry and are kept; a host is followed through all its labels, however many;
an address in digits or in brackets has no parent domains; of entries of one
domain and date, the last of block, allow, remove in this order holds; entries
with a null domain, date or action are no entries; repeated captures get equal
answers; an entry holds from the moment of its date on; no captures give no
rows, and without entries all are kept; a url of any length is read whole;
an input column named as a result is kept under a
name with a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import aside, fresh, load

SHARES = 1000
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)"
ADDRESS = r"^(?:\[.*|[0-9]+(?:\.[0-9]+){3})$"


def host_of(url: str | Column) -> Column:
    """The host of a URL in lower case, without a dot at its end; null where there is none."""
    found = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), r"\.+$", "")
    return F.when(found != "", found)


def domains(host: str) -> Column:
    """The host and all its parents of two labels or more, as (domain, level): level 0 is the shortest. An address stands alone."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    several = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.array_join(F.slice(labels, n - 1 - i, i + 2), ".").alias("domain"), i.alias("level")))
    return F.when((n > 1) & ~F.col(host).rlike(ADDRESS), several).otherwise(F.array(F.struct(F.col(host).alias("domain"), F.lit(0).alias("level"))))


def intervals(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """``host, action, domain, valid_from, valid_to`` (open end: null) of distinct ``hosts`` by dated ``entries`` (domain, action, listed_at)."""
    order = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 2)
    dated = entries.select(F.lower(F.trim("domain")).alias("domain"), F.col("listed_at").cast("timestamp").alias("at"), order.alias("rank"))
    dated = dated.where("domain is not null and at is not null and rank is not null").groupBy("domain", "at").agg(F.max("rank").alias("rank"))
    each = hosts.select("host", F.explode(domains("host")).alias("d")).select("host", "d.domain", "d.level")
    # at each change of a host there is a row for each of its listed domains, with the entry that this domain has by then
    events = each.join(dated, "domain").withColumn("levels", F.collect_set("level").over(Window.partitionBy("host")))
    changes = events.groupBy("host", "at").agg(F.first("levels").alias("levels"), F.map_from_entries(F.collect_list(F.struct("level", F.struct("rank", "domain")))).alias("new"))
    listed = changes.select("host", "at", "new", F.explode("levels").alias("level"))
    so_far = F.last(F.col("new")[F.col("level")], ignorenulls=True).over(Window.partitionBy("host", "level").orderBy("at"))
    deepest = F.max_by("s", F.when(F.col("s.rank") < 2, F.col("level")))
    state = listed.select("host", "at", "level", so_far.alias("s")).groupBy("host", "at").agg(deepest.alias("s"))
    w = Window.partitionBy("host").orderBy("at")
    lined = state.select("host", "at", "s", F.lead("at").over(w).alias("valid_to"))
    return lined.where("s is not null").select("host", F.when(F.col("s.rank") == 0, "block").otherwise("allow").alias("action"), F.col("s.domain").alias("domain"), F.col("at").alias("valid_from"), "valid_to")


def hot_hosts(captures: DataFrame, shares: int = SHARES) -> DataFrame:
    """``host, salts`` of hosts with more than one part in ``shares`` of all captures: fewer than ``shares`` rows."""
    counts = captures.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    part = F.col("n") * F.lit(shares) / F.col("total")
    every = captures.agg(F.count(F.lit(1)).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(every)).where(part > 1).select("host", F.ceil(part).cast("int").alias("salts"))


def filter_urls(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at", shares: int = SHARES) -> DataFrame:
    """Add ``host, action, entry_domain, entry_from, kept`` to every capture; only blocked ones aren't kept."""
    captures, now_named = aside(captures, "host", "action", "entry_domain", "entry_from", "kept")
    key, url, fetched = now_named(key), now_named(url), now_named(fetched)
    salt, salts, ihost, isalt, to = fresh(captures, "list_salt", "list_salts", "list_host", "list_to_salt", "list_entry_to")
    df = captures.withColumn("host", host_of(url))
    hot = hot_hosts(df.select("host"), shares)
    df = df.join(F.broadcast(hot.select(F.col("host").alias(ihost), F.col("salts").alias(salts))), F.col("host") == F.col(ihost), "left").drop(ihost)
    # captures without a host meet nothing and are dealt by the salt alone
    spread = F.coalesce(salts, F.when(F.col("host").isNull(), F.lit(shares)).otherwise(F.lit(1)))
    df = df.withColumn(salt, F.pmod(F.xxhash64(key, url), spread)).drop(salts)
    valid = intervals(df.where("host is not null").select("host").distinct(), entries)
    valid = valid.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    valid = valid.select(F.col("host").alias(ihost), F.col("salt").cast("bigint").alias(isalt), "action", F.col("domain").alias("entry_domain"), F.col("valid_from").alias("entry_from"), F.col("valid_to").alias(to))
    now = F.col(fetched).cast("timestamp")
    held = (now >= F.col("entry_from")) & (F.col(to).isNull() | (now < F.col(to)))
    out = df.join(valid, (F.col("host") == F.col(ihost)) & (F.col(salt) == F.col(isalt)) & held, "left").drop(ihost, isalt, salt, to)
    return out.withColumn("kept", F.coalesce(F.col("action") != "block", F.lit(True)))


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list for the hosts of ``pages``: the entries follow from checksums of the domains.

    Half of the domains are blocked from some day of early 2024; of these some
    are removed later, and some of their subdomains are allowed.
    """
    hosts = pages.select(host_of("url").alias("host")).where("host is not null").distinct()
    each = hosts.select(F.explode(domains("host")).alias("d")).select("d.domain", "d.level").distinct()
    # a domain of two labels only is a public name here, such as example.com
    h = F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("long")
    day = lambda n: F.timestamp_add("DAY", n.cast("int"), F.lit("2024-01-01").cast("timestamp"))
    listed = each.where("level > 0").withColumn("h", h)
    first = listed.where("h % 2 = 0").select("domain", F.when((F.col("level") > 1) & (F.col("h") % 4 == 0), "allow").otherwise("block").alias("action"), day(F.col("h") % 120).alias("listed_at"))
    second = listed.where("h % 6 = 0").select("domain", F.lit("remove").alias("action"), day(F.col("h") % 120 + 60 + F.col("h") % 50).alias("listed_at"))
    third = listed.where("h % 18 = 0").select("domain", F.lit("block").alias("action"), day(F.col("h") % 120 + 200).alias("listed_at"))
    return first.unionByName(second).unionByName(third)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched on days of 2024 that follow from their ids, by the sample list."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    day = F.coalesce(F.pmod(F.col("page_id") * 7, F.lit(366)), F.lit(0)).cast("int")
    captures = pages.withColumn("fetched_at", F.timestamp_add("DAY", day, F.lit("2024-01-01").cast("timestamp")))
    out = filter_urls(captures, sample_list(pages))
    return out.select("page_id", "url", "host", "action", "entry_domain", F.date_format("entry_from", "yyyy-MM-dd").alias("entry_from"), F.col("kept").cast("int").alias("kept"))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(coalesce(((page_id * 7) % 366 + 366) % 366, 0) AS INTEGER) AS fetched_at,
         nullif(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1), '\.+$', ''), '') AS host
  FROM pages),
h AS (SELECT DISTINCT host, CASE WHEN regexp_matches(host, '^(?:\[.*|[0-9]+(?:\.[0-9]+){3})$') THEN [host] ELSE string_split(host, '.') END AS l FROM p WHERE host IS NOT NULL),
d AS (
  SELECT host, array_to_string(l[len(l) - 1 - i : len(l)], '.') AS domain, i AS level
  FROM (SELECT host, l, unnest(range(0, len(l) - 1)) AS i FROM h WHERE len(l) > 1)
  UNION ALL SELECT host, host, 0 FROM h WHERE len(l) = 1),
n AS (SELECT DISTINCT domain, level, CAST('0x' || substr(md5(domain), 1, 6) AS BIGINT) AS h FROM d WHERE level > 0),
e AS (
  SELECT domain, CASE WHEN level > 1 AND h % 4 = 0 THEN 1 ELSE 0 END AS rank, h % 120 AS day FROM n WHERE h % 2 = 0
  UNION ALL SELECT domain, 2, h % 120 + 60 + h % 50 FROM n WHERE h % 6 = 0
  UNION ALL SELECT domain, 0, h % 120 + 200 FROM n WHERE h % 18 = 0),
f AS (SELECT domain, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(day AS INTEGER) AS listed_at, max(rank) AS rank FROM e GROUP BY ALL),
pd AS (SELECT DISTINCT p.page_id, p.url, p.host, p.fetched_at, d.domain, d.level FROM p JOIN d USING (host)),
a AS (SELECT pd.*, f.rank, f.listed_at FROM pd ASOF JOIN f ON pd.domain = f.domain AND pd.fetched_at >= f.listed_at),
b AS (
  SELECT page_id, url, host, arg_max(CASE rank WHEN 0 THEN 'block' ELSE 'allow' END, level) AS action, arg_max(domain, level) AS entry_domain
  FROM a WHERE rank < 2 GROUP BY ALL),
-- the interval that holds began with the last change of any of the host's entries
c AS (SELECT pd.page_id, pd.url, max(f.listed_at) AS entry_from FROM pd JOIN f ON pd.domain = f.domain AND f.listed_at <= pd.fetched_at GROUP BY ALL)
SELECT p.page_id, p.url, p.host, b.action, b.entry_domain, CASE WHEN b.action IS NOT NULL THEN strftime(c.entry_from, '%Y-%m-%d') END AS entry_from,
       CASE WHEN b.action = 'block' THEN 0 ELSE 1 END AS kept
FROM p LEFT JOIN b ON p.page_id = b.page_id AND p.url = b.url LEFT JOIN c ON p.page_id = c.page_id AND p.url = c.url
"""
