"""Spelling variants: words that differ by one letter, grouped under their most frequent form.

Words are counted where they stand (a task adds up its own texts' words before
they travel). Candidates come from deletions: a word with one code point taken
out is the word it grew from by an insertion, and two words of one length that
agree after a deletion at one place differ in that place alone. No string is
built for a deletion: prefix and suffix sums of a polynomial hash (two bases
modulo 2**31 - 1) give the hashes of all deletions of a batch of words at once,
as 64-bit keys. Keys are dealt by their upper bits (radix) and sorted; a run of
equal keys is a group. Only groups that can hold a pair get their words'
strings, and equal keys of different strings are parted again there.

Pairs are never written out: a group's words get the number of their near words
and the best of them from the group's two most frequent words. A replacement
group has one word a letter at most, a deletion group one word a place and
letter. Forms are followed to their roots by doubling the step each round; as
n grows fivefold with each step, few rounds reach the end.

Defined results: null and empty texts have no words; under a null id no run is
changed; rows that repeat count each; of near words with equal n the first in
code-point order is the form; an empty table gives no rows; a text and a run of
any length are read whole (a run of ``l`` letters has ``2 * l + 1`` keys that
don't carry it). Only the id and the text are read, so other columns can't
clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import discard, load, released, small_batches, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
CHANGED = 199
LETTERS = 6
LEAST = 5
TIMES = 5
HELD = 200_000
SLICE = 1 << 20
WORDS = 2000
P = np.uint64(2**31 - 1)
BASES = (1_103_515_245, 1_597_334_677)
OWN, LONGER, REPLACED = 0, 1, 2


def pieces(text: str) -> Iterator[str]:
    """The text in slices of about ``SLICE`` characters that cut no run."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text) and RUN.match(text, end - 1) and (m := RUN.match(text, end)):
            end = m.end()
        yield text[at:end]
        at = end


def counted_words(doc_id: int | None, text: str, into: Counter, changed: int = CHANGED, letters: int = LETTERS) -> None:
    """Add the text's words to ``into``."""
    start = None if doc_id is None else crc32(b"%d:" % doc_id)
    low = text.encode().lower().decode()  # as bytes: A to Z alone
    for piece in pieces(low):
        for run, n in Counter(RUN.findall(piece)).items():
            if len(run) < letters:
                continue
            if start is not None and (h := crc32(run.encode(), start)) % changed == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < letters:
                    continue
            into[run] += n


def _tallied(held: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": np.fromiter(held.values(), np.int64, len(held))})


def counts(df: DataFrame, key: str, text: str, changed: int = CHANGED, letters: int = LETTERS) -> DataFrame:
    """``word, n``: all words and how often they occur."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                counted_words(None if doc_id is None else int(doc_id), text, held, changed, letters)
                if len(held) > HELD:
                    yield _tallied(held)
                    held.clear()
        yield _tallied(held)
        released()

    # ids as text: a column with nulls would come as doubles
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(base: int, n: int) -> np.ndarray:
    """The base's powers 0 to n modulo ``P``."""
    out = np.ones(1, np.uint64)
    step = np.uint64(base % int(P))
    while len(out) <= n:
        out = np.concatenate([out, out * step % P])
        step = step * step % P
    return out[: n + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words and their deletions: ``key``, index of the word, kind, and place taken out (-1: none).

    With ``S[i]`` the sum of ``c[j] * base**j`` over ``j < i``, the hash without
    place ``i`` is ``S[i]`` plus what stands behind it, one power lower.
    """
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - first[word]
    whole, without = np.zeros(len(words), np.uint64), np.zeros(len(letters), np.uint64)
    for shift, base in zip((31, 0), BASES, strict=True):
        power = _powers(base, int(size.max(initial=0)))
        back = np.uint64(pow(base, -1, int(P)))
        each = letters * power[place] % P
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])  # below 2**31 times the letters of a batch
        total = (upto[first + size] - upto[first]) % P
        prefix = (upto[:-1] - upto[first][word]) % P
        suffix = (total[word] + P - (prefix + each) % P) % P
        whole |= total << np.uint64(shift)
        without |= (prefix + suffix * back) % P << np.uint64(shift)
    length = size.astype(np.uint64)
    own = _mixed(whole ^ _mixed(length))
    shorter = _mixed(without ^ _mixed(length[word] - np.uint64(1)))
    # of equal letters in a row, one deletion says all
    turn = np.ones(len(letters), bool)
    turn[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
    replaced = _mixed(shorter ^ _mixed(place.astype(np.uint64) + np.uint64(1 << 40)))
    key = np.concatenate([own, shorter[turn], replaced]).view(np.int64)
    at = np.concatenate([np.full(len(words), -1), place[turn], place])
    kind = np.repeat(np.array([OWN, LONGER, REPLACED]), [len(words), int(turn.sum()), len(letters)])
    return key, np.concatenate([np.arange(len(words)), word[turn], word]), kind, at


def keys(words: DataFrame) -> DataFrame:
    """``key, id, kind, place`` of every word's deletions, without the words themselves."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = pdf["word"].tolist(), pdf["id"].to_numpy(np.int64)
            lo = 0
            while lo < len(texts):  # a batch's keys are bounded by letters, too
                hi, held = lo, 0
                while hi < len(texts) and hi - lo < WORDS and (hi == lo or held + len(texts[hi]) < SLICE):
                    held += len(texts[hi])
                    hi += 1
                key, at, kind, place = deletion_keys(texts[lo:hi])
                for s in range(0, len(key), SLICE):
                    e = s + SLICE
                    yield pd.DataFrame({"key": key[s:e], "id": ids[lo:hi][at[s:e]], "kind": kind[s:e].astype(np.int32), "place": place[s:e].astype(np.int32)})
                lo = hi

    return words.select("id", "word").mapInPandas(make, "key long, id long, kind int, place int")


def by_radix(df: DataFrame, *after: str) -> DataFrame:
    """Rows dealt by the upper bits of their keys, sorted by key in each partition."""
    return df.withColumn("radix", F.shiftrightunsigned("key", 48)).repartition("radix").sortWithinPartitions("key", *after).drop("radix")


def shared(rows: DataFrame) -> DataFrame:
    """The rows of sorted ``keys`` whose group can hold a pair."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = int(np.searchsorted(pdf["key"].to_numpy(), pdf["key"].iloc[-1])) if len(pdf) else 0
            held, pdf = pdf.iloc[last:], pdf.iloc[:last]
            if len(pdf):
                yield _paired(pdf)
        if held is not None and len(held):
            yield _paired(held)

    return rows.mapInPandas(keep, "key long, id long, kind int, place int")


def _paired(pdf: pd.DataFrame) -> pd.DataFrame:
    key, kind = pdf["key"].to_numpy(), pdf["kind"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([starts, [len(key)]]))
    tally = np.stack([np.add.reduceat((kind == k).astype(np.int64), starts) for k in (OWN, LONGER, REPLACED)])
    able = ((tally[OWN] > 0) & (tally[LONGER] > 0)) | (tally[REPLACED] > 1)
    return pdf[np.repeat(able, size)]


def near_of(group: list[tuple[int, str, int, int, int]]) -> Iterator[tuple[int, int, int, str]]:
    """From rows (id, word, n, kind, place) of equal keys: ``id, near, best_n, best`` of each word that has near ones among them."""
    same: dict[tuple[bool, int, str], list[tuple[int, str, int, int]]] = {}
    for i, word, n, kind, place in group:
        rest = word if kind == OWN else word[:place] + word[place + 1 :]
        same.setdefault((kind == REPLACED, place if kind == REPLACED else 0, rest), []).append((i, word, n, kind))
    for (replaced, _, _), members in same.items():
        order = sorted(members, key=lambda m: (-m[2], m[1]))
        if replaced:
            if len(order) > 1:
                for i, m in enumerate(order):
                    best = order[0] if i else order[1]
                    yield m[0], len(order) - 1, best[2], best[1]
            continue
        own = next((m for m in order if m[3] == OWN), None)
        longer = [m for m in order if m[3] == LONGER]
        if own and longer:
            yield own[0], len(longer), longer[0][2], longer[0][1]
            for m in longer:
                yield m[0], 1, own[2], own[1]


def _best(rows: list[tuple[int, int, int, str]]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object if c == "best" else "int64") for i, c in enumerate(("id", "near", "best_n", "best"))})


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, near_n, near``: how many near words a word has, and the most frequent of them."""
    small_batches(words.sparkSession)
    groups = stored(shared(by_radix(keys(words), "id")), "groups")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, out = None, [], []
        for pdf in batches:
            for k, *row in zip(*(pdf[c].tolist() for c in ("key", "id", "word", "n", "kind", "place")), strict=True):
                if k != key:  # a group may span batches
                    out += near_of(group)
                    key, group = k, []
                group.append(tuple(row))
            yield _best(out)
            out = []
        yield _best(list(near_of(group)))
        released()

    full = by_radix(groups.join(words, "id").select("key", "id", "word", "n", "kind", "place"), "id")
    each = full.mapInPandas(find, "id long, near long, best_n long, best string")
    out = each.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    return out.select("id", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.best").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of each row (word, form): forms are followed to the last, by doubled steps."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # dealt by other columns, so that a root with very many words can be split
        ahead = stored(now.join(step.repartition("next", "root"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return now


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, letters: int = LETTERS, changed: int = CHANGED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that occurs ``least`` times."""
    words = stored(counts(df, key, text, changed, letters).where(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()), "words")
    found = words.join(near_words(words), "id", "left")
    close = F.col("near_n") >= F.lit(times) * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, F.col("near")).alias("form"), F.when(close, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of the words of all documents."""
    return variants(load(spark, sf_dir, "documents").select("doc_id", "text"))


#: CRC-32 as a fold over bytes with the usual table; deletions as strings.
OP13_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run HAVING length(run) >= 6),
b AS (SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) - 64 AS BIGINT)] END)) AS b FROM r),
h AS (SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_concat([4294967295], b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) END AS h FROM b, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS MATERIALIZED (SELECT a.word AS a, b.word AS b, b.n AS n FROM d AS a JOIN d AS b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT w.word, d.word, d.n FROM w JOIN d ON d.d = w.word UNION SELECT d.word, w.word, w.n FROM w JOIN d ON d.d = w.word),
f AS MATERIALIZED (SELECT w.word, w.n, count(p.b) AS n_near, CASE WHEN max(p.n) >= 5 * w.n THEN max(p.n) END AS form_n FROM w LEFT JOIN p ON p.a = w.word GROUP BY w.word, w.n),
g AS MATERIALIZED (SELECT f.word, f.n, f.n_near, f.form_n, min(p.b) AS form FROM f LEFT JOIN p ON p.a = f.word AND p.n = f.form_n GROUP BY f.word, f.n, f.n_near, f.form_n),
up(word, root) AS (SELECT word, word FROM g UNION ALL SELECT up.word, g.form FROM up JOIN g ON g.word = up.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, e.root, CAST(g.n AS BIGINT) AS n, CAST(g.n_near AS BIGINT) AS n_near, CAST(g.form_n AS BIGINT) AS form_n
FROM g JOIN (SELECT up.word, up.root FROM up JOIN g ON g.word = up.root WHERE g.form IS NULL) AS e ON e.word = g.word"""
