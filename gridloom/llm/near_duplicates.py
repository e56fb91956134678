"""MinHash near-duplicate detection: banded minima, signatures, full sets, connected components.

A text's words are what ASCII white space separates, A to Z lowered; its set
holds the runs of five words (a shorter text is one run). Texts of equal sets
are one node. Each node gets ``HASHES`` minima of strongly universal hashes
(``(a * x + b) >> 32`` in 64 bits), cut into bands whose number and height are
chosen for a target recall; nodes that share a band's hash are candidates.

Components need no link between two nodes that others already tie together, so
most candidates are settled in rounds that are linear in the buckets: in each
bucket one node, the hub, is held against all others. Pairs whose signatures (a
byte of each minimum) agree in fewer than ``AGREE`` places are no links (at the
threshold that happens once in millions); the rest are confirmed on full sets,
a hub's text travelling once for each ``BLOCK`` of its partners. The hub then
leaves its bucket, and a bucket whose nodes are all in one component is done.
What is left after ``ROUNDS`` rounds is compared exactly: its nodes are cut into
blocks, and blocks that share a bucket meet in a task, first as signatures
alone, then with the texts of the nodes that still have a partner outside their
component. No bucket is capped and no pair of a bucket is left out. Links
become components by alternating large-star and small-star rounds.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing, not even with each other; a null id has no component (null), is
kept, and its text links nothing; rows that repeat are copies; if an id has
several texts, each text is a row of its own with its own component, and a
component's id is the least id of its rows; an empty table gives no rows; a
text of any length is read whole. Sets are compared by 64-bit shingle hashes.
Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import components, discard, load, released, runs, small_batches, stored
from gridloom.llm.ngram_join import bands_for, blocks

N = 5
THRESHOLD = (85, 100)
RECALL = 0.99999
HASHES = 100
AGREE = 65
BLOCK = 256
ROUNDS = 2
KNOWN_WORDS = 100_000
CHUNK = 512


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


_WORDS = _Words()


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``n`` words."""
    words = (text or "").encode().lower().split()  # bytes: A to Z and ASCII white space alone
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(n, len(h))
    m = len(h) - size + 1
    out = h[:m] + np.uint64(size)
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


class Minima:
    """Minima of a set under many strongly universal hashes, as band hashes and as a signature."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a, self.b = (rng.integers(0, 2**64 - 1, (bands * rows, 1), np.uint64) for _ in range(2))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        x = grams >> np.uint64(32)
        low = np.full(self.bands * self.rows, 2**64 - 1, np.uint64)
        for at in range(0, len(x), CHUNK):
            v = self.a * x[None, at : at + CHUNK]
            v += self.b
            np.minimum(low, v.min(1), out=low)  # the least sum has the least upper half
        return low >> np.uint64(32)

    def banded(self, low: np.ndarray) -> np.ndarray:
        low = low.reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.rows):
            out = (out ^ low[:, i]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def signatures(rows: DataFrame, minima: Minima, n: int = N) -> DataFrame:
    """``doc_id, text_key, set_a, set_b, n_shingles, sig, bands`` of every row with an id, stored in the shared folder."""
    small_batches(rows.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b, size, sig, bands = [], [], [], [], []
            for text in pdf["text"]:
                grams = shingles(text, n)
                raw = grams.tobytes()
                a.append(xxhash.xxh3_64_intdigest(raw))
                b.append(xxhash.xxh3_64_intdigest(raw, 1))
                size.append(len(grams))
                low = minima(grams) if len(grams) else None
                sig.append(None if low is None else low.astype(np.uint8).tobytes())
                bands.append(None if low is None else minima.banded(low))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "set_a": np.array(a, np.uint64).view(np.int64), "set_b": np.array(b, np.uint64).view(np.int64), "n_shingles": size, "sig": sig, "bands": bands})
        released()

    return stored(rows.mapInPandas(sign, "doc_id long, text_key long, set_a long, set_b long, n_shingles long, sig binary, bands array<bigint>"), "signed")


def alike(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> bool:
    """Whether two sorted sets are alike to the threshold."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * threshold[1] < len(large) * threshold[0]:
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both * threshold[1] >= (len(a) + len(b) - both) * threshold[0]


def _places(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)


def agreeing(left: np.ndarray, right: np.ndarray, least: int = AGREE) -> np.ndarray:
    """Which rows of ``left`` agree with which of ``right`` in ``least`` places, as a matrix."""
    out = np.zeros((len(left), len(right)), bool)
    for i, row in enumerate(left):
        out[i] = np.count_nonzero(right == row, 1) >= least
    return out


def open_pairs(pdf: pd.DataFrame, lo: int, hi: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks that meet (or of one block) whose signatures agree and whose components differ."""
    sigs, comp, own = _places(pdf["sig"].tolist()), pdf["comp"].to_numpy(np.int64), pdf["blk"].to_numpy(np.int64)
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    ok = agreeing(sigs[left], sigs[right], least) & (comp[left][:, None] != comp[right][None, :])
    if lo == hi:
        ok &= left[:, None] < right[None, :]
    i, j = np.nonzero(ok)
    return left[i], right[j]


class Ties:
    """Union of numbers: which are tied together."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up.setdefault(x, x)
        while up != self.up[up]:
            self.up[x] = up = self.up[up]
        return up

    def tie(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


class Search:
    """The tables of one run: nodes, their texts and the buckets they share."""

    def __init__(self, rows: DataFrame, minima: Minima, n: int, threshold: tuple[int, int], agree: int, block: int):
        self.n, self.threshold, self.agree, self.block = n, threshold, agree, block
        self.rows = rows
        self.signed = signatures(rows, minima, n)
        best = F.min(F.struct("doc_id", "text_key", "n_shingles", "sig", "bands")).alias("best")
        nodes = self.signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(best)
        self.nodes = stored(nodes.select("set_a", "set_b", "best.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
        buckets = self.nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "hash"))
        full = self.nodes.select(F.posexplode("bands").alias("band", "hash")).groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # dealt by other columns, so that the join deals both sides anew and a very common hash can be split
        self.buckets = stored(buckets.join(full.repartition("n", "hash"), ["band", "hash"]).select("node", "n_shingles", "band", "hash", F.col("node").alias("comp")), "buckets")

    def texts(self, needed: DataFrame) -> DataFrame:
        """``node, text``: one text of each node in ``needed`` (node, distinct)."""
        of = self.nodes.select("node", "doc_id", "text_key").join(needed, "node", "left_semi")
        # a row may repeat very often: its copies fall together before they travel on
        return self.rows.join(of, ["doc_id", "text_key"]).groupBy("doc_id", "text_key", "node").agg(F.max("text").alias("text")).select("node", "text")

    def hub_links(self, turn: int) -> DataFrame:
        """Links (``u, v``) of each bucket's hub with the others in it; the hub then leaves the bucket."""
        spark, n, threshold, least = self.rows.sparkSession, self.n, self.threshold, self.agree
        # the first round takes the least node, the same one in most buckets of a group; later rounds others
        first = F.struct((F.lit(0) if turn == 0 else F.xxhash64(F.lit(turn), "node", "band")).alias("h"), "node")
        hubs = self.buckets.groupBy("band", "hash").agg(F.min(first).alias("hub"), F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other")
        hubs = hubs.select("band", "hash", F.col("hub.node").alias("hub")).repartition("hub", "hash")
        joined = stored(self.buckets.join(hubs, ["band", "hash"]).where("node <> hub"), "hubs")
        last, self.buckets = self.buckets, joined.drop("hub")
        discard(last)
        sig = self.nodes.select("node", "sig")

        @F.pandas_udf("boolean")
        def agree(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(np.count_nonzero(_places(a.tolist()) == _places(b.tolist()), 1) >= least) if len(a) else pd.Series([], dtype=bool)

        pairs = joined.select("node", "hub").distinct().join(sig, "node").join(sig.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub").where(agree("sig", "hub_sig"))
        pairs = stored(pairs.select("node", "hub"), "pairs")
        parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(self.block)).alias("parts"))
        dealt = pairs.join(parts.repartition("parts", "hub"), "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node")
        heads = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"))
        ends = stored(dealt.unionByName(heads), "ends")
        small_batches(spark)

        def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hub, own = None, None
            for pdf in batches:
                out = []
                for h, part, node, text in zip(pdf["hub"], pdf["part"], pdf["node"], pdf["text"], strict=True):
                    if hub != (h, part):
                        hub, own = (h, part), shingles(text, n)  # the hub's own row comes first
                    elif alike(own, shingles(text, n), threshold):
                        out.append((h, node))
                yield pd.DataFrame(out, columns=["v", "u"])[["u", "v"]].astype("int64")
            released()

        met = self.texts(ends.select("node").distinct()).join(ends, "node").select("hub", "part", "node", "text", (F.col("node") != F.col("hub")).alias("later"))
        met = met.repartition("hub", "part").sortWithinPartitions("hub", "part", "later", "node").select("hub", "part", "node", "text")
        links = stored(met.mapInPandas(confirm, "u long, v long"), "links")
        discard(ends)
        discard(pairs)
        return links

    def rest_links(self) -> DataFrame | None:
        """Links among what the hubs have left: all pairs of a bucket whose components differ, in blocks that meet."""
        spark, n, threshold, least = self.rows.sparkSession, self.n, self.threshold, self.agree
        left = self.buckets.groupBy("band", "hash").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other").select("band", "hash", "one").repartition("one", "hash")
        rest = stored(self.buckets.join(left, ["band", "hash"]).select(F.col("node").alias("rep"), F.col("n_shingles").alias("grams"), "band", "hash", "comp"), "rest")
        if rest.isEmpty():
            return None
        homes, meet = blocks(rest.drop("comp"), self.block)
        comps = rest.select(F.col("rep").alias("node"), "comp").distinct()
        of = homes.withColumnRenamed("rep", "node").join(comps, "node").join(self.nodes.select("node", "sig"), "node")
        ends = meet.select(F.col("lo").alias("blk"), "lo", "hi").unionByName(meet.where("lo <> hi").select(F.col("hi").alias("blk"), "lo", "hi"))

        def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for (lo, hi), pdf in runs(batches, ["lo", "hi"]):
                i, j = open_pairs(pdf, lo, hi, least)
                yield pdf.iloc[np.unique(np.concatenate([i, j]))][["lo", "hi", "blk", "node", "comp", "sig"]]

        met = of.join(ends, "blk").select("lo", "hi", "blk", "node", "comp", "sig").repartition("lo", "hi").sortWithinPartitions("lo", "hi", "node")
        some = stored(met.mapInPandas(partners, "lo long, hi long, blk long, node long, comp long, sig binary"), "partners")
        small_batches(spark)

        def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for (lo, hi), pdf in runs(batches, ["lo", "hi"]):
                sets, comp, node, ties, out = [shingles(t, n) for t in pdf["text"]], pdf["comp"].tolist(), pdf["node"].tolist(), Ties(), []
                i, j = open_pairs(pdf, lo, hi, least)
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if ties.root(comp[a]) != ties.root(comp[b]) and alike(sets[a], sets[b], threshold):
                        ties.tie(comp[a], comp[b])
                        out.append((node[a], node[b]))
                yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")
            released()

        met = self.texts(some.select("node").distinct()).join(some, "node").select("lo", "hi", "blk", "node", "comp", "sig", "text")
        return stored(met.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "node").mapInPandas(confirm, "u long, v long"), "rest-links")

    def relabel(self, classes: DataFrame) -> None:
        """Give the buckets' nodes their components so far."""
        to = classes.select("node", F.col("root").alias("now"))
        last, self.buckets = self.buckets, stored(self.buckets.join(to, "node", "left").select("node", "n_shingles", "band", "hash", F.coalesce("now", "node").alias("comp")), "buckets")
        discard(last)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, agree: int = AGREE, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    minima = Minima(*bands_for(threshold[0] / threshold[1], recall, hashes))
    source = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    search = Search(source.where("doc_id is not null"), minima, n, threshold, agree, block)
    links, found = None, None
    for turn in range(rounds):
        more = search.hub_links(turn)
        links = more if links is None else links.unionByName(more)
        found = components(links, "classes")
        search.relabel(found)
    if (more := search.rest_links()) is not None:
        links = more if links is None else links.unionByName(more)
        found = components(links, "classes")
    of = search.nodes.select("set_a", "set_b", "node", "doc_id")
    if found is not None:
        of = of.join(found, "node", "left").withColumn("node", F.coalesce("root", "node"))
    least = of.groupBy("node").agg(F.min("doc_id").alias("component_id"))
    answers = of.select("set_a", "set_b", "node").join(least.repartition("component_id", "node"), "node").select("set_a", "set_b", "component_id")
    some = search.signed.where("n_shingles > 0").select("doc_id", "n_shingles", "set_a", "set_b").join(answers.repartition("component_id", "set_a"), ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    none = search.signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.unionByName(none).withColumn("kept", F.col("doc_id") == F.col("component_id"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pd.array([None] * len(pdf), dtype="Int64"), "n_shingles": [len(shingles(t, n)) for t in pdf["text"]], "component_id": pd.array([None] * len(pdf), dtype="Int64"), "kept": True})

    small_batches(df.sparkSession)
    return out.unionByName(source.where("doc_id is null").select("text").mapInPandas(count, "doc_id long, n_shingles long, component_id long, kept boolean"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates of all documents."""
    return classes(load(spark, sf_dir, "documents").select("doc_id", "text"))


#: Pairs from an inverted index of the shingles of distinct sets; each node then takes the least id it reaches.
OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM s),
r AS MATERIALIZED (SELECT min(doc_id) AS r, k, any_value(n) AS n, any_value(s) AS s FROM t WHERE n > 0 GROUP BY k),
g AS MATERIALIZED (SELECT r, n, unnest(s) AS g FROM r),
l AS MATERIALIZED (SELECT a.r AS u, b.r AS v FROM g AS a JOIN g AS b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach(a, b) AS (SELECT DISTINCT u, u FROM e UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_shingles, coalesce(c.c, r.r, t.doc_id) AS component_id, t.doc_id = coalesce(c.c, r.r, t.doc_id) AS kept
FROM t LEFT JOIN r ON r.k = t.k AND t.n > 0 LEFT JOIN c ON c.a = r.r"""
