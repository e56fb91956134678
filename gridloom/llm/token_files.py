"""Token-id output: documents in ascending id order as directly addressable code files.

Documents are dealt into ranges of ids, as many as their bytes ask for; each
range is encoded in order by one task and cut into segments of about
``segment_tokens`` ids (whole documents). A segment is one row of the token
table in the shared folder: its file (see ``dac``), which has the codes, the
documents' ids and where each begins, and the segment's place in its range. The
table's Parquet is neither compressed nor dictionary-coded, so a file lies in
it byte by byte, and ``dac.token`` reads any id from storage by range.

Defined results: a null text counts as empty and has the end id alone; a null
id sorts first; rows that repeat an id are ordered by text; a text of any length
is encoded whole and stays in one segment; an empty table gives an empty token
table; only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import dac
from gridloom.llm.common import LOWEST, load, small_batches, stored, with_ranges
from gridloom.llm.tokens import encoder, vocabulary

VOCABULARY = "word_bpe_49k.json"
END = 1
SEGMENT_TOKENS = 1 << 20
BITS = 8
TABLE = "rng int, before long, n_tokens long, file binary"


def write(df: DataFrame, vocabulary_name: str = VOCABULARY, end: int = END, segment_tokens: int = SEGMENT_TOKENS, bits: int = BITS) -> DataFrame:
    """Encode ``df`` (doc_id, text) and return the token table as stored."""
    small_batches(df.sparkSession)
    rows = df.select(F.coalesce("doc_id", F.lit(LOWEST)).cast("long").alias("k"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges, n = with_ranges(rows, "k", "rng", "text")
    dealt = ranges.repartitionById(n, "rng").sortWithinPartitions("rng", "k", F.desc("no_id"), "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(vocabulary(vocabulary_name))
        rng, before, held, ids, nulls, size = None, 0, [], [], 0, 0

        def segment() -> pd.DataFrame:
            ends = np.cumsum([len(x) for x in held])
            return pd.DataFrame({"rng": [rng], "before": [before], "n_tokens": [size], "file": [dac.encode(np.concatenate(held), bits, ids, [0, *ends[:-1].tolist()], nulls)]})

        for pdf in batches:
            for where, k, no_id, got in zip(pdf["rng"].tolist(), pdf["k"].tolist(), pdf["no_id"].tolist(), ids_of(pdf["text"].tolist()), strict=True):
                if held and (where != rng or size >= segment_tokens):
                    yield segment()
                    before, held, ids, nulls, size = (before + size if where == rng else 0), [], [], 0, 0
                rng = where
                held.append(np.append(got, np.uint32(end)))
                ids.append(k)
                nulls += bool(no_id)
                size += len(held[-1])
        if held:
            yield segment()

    return stored(dealt.mapInPandas(encode, TABLE), "tokens", "none", dictionary=False)


def read(table: DataFrame) -> DataFrame:
    """Each document's place and checksum, read from the files."""
    sums = sorted((r[0], r[1]) for r in table.groupBy("rng").agg(F.sum("n_tokens")).collect())  # one row a range
    base = dict(zip([r for r, _ in sums], np.concatenate([[0], np.cumsum([n for _, n in sums])]).tolist(), strict=False))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rng, before, file in pdf[["rng", "before", "file"]].itertuples(index=False):
                reader = dac.Reader(file)
                bounds = [*reader.starts.tolist(), len(reader)]
                sums = []
                for lo, hi in zip(bounds, bounds[1:], strict=False):
                    crc = 0
                    for at in range(lo, hi, SEGMENT_TOKENS):
                        crc = zlib.crc32(reader.slice(at, min(hi, at + SEGMENT_TOKENS)).astype("<u4").tobytes(), crc)
                    sums.append(crc)
                yield pd.DataFrame({
                    "doc_id": pd.array([None] * reader.nulls + reader.docs[reader.nulls :].tolist(), dtype="Int64"),
                    "start": np.array(bounds[:-1], np.int64) + base[rng] + before,
                    "n_tokens": np.diff(bounds),
                    "ids_crc32": sums,
                })

    return table.select("rng", "before", "file").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written and read back."""
    return read(write(load(spark, sf_dir, "documents").select("doc_id", "text")))
