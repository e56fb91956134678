"""A query: a DataFrame plan, its SQL, and the columns that both return."""

from __future__ import annotations

import atexit
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import round_away
from gridloom.plans.decisions import Decisions
from gridloom.plans.marts_sql import rounded, with_layers

#: Of the last digit; see ``round_away``.
NUDGE = 1e-5
ITEM = re.compile(r"([~#@^]?)(\w+)(?::(\d+))?$")


#: Layers of each session and state of its input, for queries that are run by name.
_SHARED: dict[tuple[str, str, tuple], Decisions] = {}


def _stamp(spark: SparkSession, folder: str) -> tuple:
    """Name, time and size of the entries of a folder, from its listing alone: tables that were written anew differ."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((x.getPath().getName(), x.getModificationTime(), x.getLen()) for x in found))


def shared(spark: SparkSession, folder: str) -> Decisions:
    """The layers that all queries of this session over this folder share: what one has written, the next one reads.

    They are removed when Python ends, or by ``clear``.
    """
    if not _SHARED:
        atexit.register(clear)
    key = (spark.sparkContext.applicationId, folder, _stamp(spark, folder))
    if key not in _SHARED:
        _SHARED[key] = Decisions(spark, folder)
    return _SHARED[key]


def clear() -> None:
    """Remove all that queries run by name have stored; results that read it can't be read afterwards."""
    while _SHARED:
        m = _SHARED.popitem()[1]
        if m.spark.sparkContext._jsc is not None and not m.spark.sparkContext._jsc.sc().isStopped():
            m.release()


@dataclass(frozen=True)
class Query:
    """``columns``: names; ``~x:2`` is a double rounded to 2 digits (4 unless said), ``#x`` a long, ``@x`` a day and ``^x`` a time as text."""

    name: str
    columns: str
    plan: Callable[[Decisions], DataFrame]
    body: str
    layers: bool = True
    more: str = ""

    def items(self) -> list[tuple[str, str, int]]:
        return [(m[1], m[2], int(m[3] or 4)) for m in map(ITEM.match, self.columns.split())]

    def run(self, spark: SparkSession, sf_dir: str, layers: Decisions | None = None) -> DataFrame:
        """The query's result; queries that get the same ``layers`` share what these have kept, and so do those without."""
        df, out = self.plan(layers or shared(spark, sf_dir)), []
        for kind, name, digits in self.items():
            c = F.col(name)
            c = {"~": lambda c=c, d=digits: round_away(c.cast("double"), d, NUDGE), "#": lambda c=c: c.cast("long"), "@": lambda c=c: F.date_format(c, "yyyy-MM-dd"), "^": lambda c=c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}.get(kind, lambda c=c: c)()
            out.append(c.alias(name))
        return df.select(*out)

    def sql(self) -> str:
        out = []
        for kind, name, digits in self.items():
            x = {"~": lambda n=name, d=digits: rounded(f"CAST({n} AS DOUBLE)", d, NUDGE), "#": lambda n=name: f"CAST({n} AS BIGINT)", "@": lambda n=name: f"strftime({n}, '%Y-%m-%d')", "^": lambda n=name: f"strftime({n}, '%Y-%m-%d %H:%M:%S')"}.get(kind, lambda n=name: n)()
            out.append(f"{x} AS {name}")
        body = f"SELECT {', '.join(out)} FROM ({self.body}) AS q"
        return with_layers(body, self.more) if self.layers else (f"WITH {self.more}\n{body}" if self.more else body)
