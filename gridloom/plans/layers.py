"""SQL text over the layers: a statement names layers and frames as tables and gets a lazy frame back.

A text names what it reads in braces, ``{zone_month}``, as Spark's own
``sql(text, name=frame)`` does, and takes values as ``:name``. Only what a text
names is planned; no view is left in the session. ``run`` takes a sequence of
named texts, of which each may read those before it, and gives a dictionary of
lazy frames; ``publish`` makes the layers views of the session for other tools.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from gridloom.plans.decisions import Decisions
from gridloom.sources.grid_csv import FRAMES

#: Layers in the order in which they build on each other.
LAYERS = (
    "zone_hour", "node_load", "event_hours", "outage_overlaps", "flex_zone", "node_state", "zone_day", "zone_month", "zone_risk", "asset_exposure", "flex_gap", "candidates",
    "node_features", "zone_day_features", "zone_month_features", "candidate_features", "anomalies", "scores", "ranking", "scenarios", "scenario_summary",
)
NAME = re.compile(r"\{(\w+)\}")


def layer(m: Decisions, name: str) -> DataFrame:
    """A layer or a domain frame by its name."""
    if name in LAYERS:
        return getattr(m, name)
    if name in FRAMES:
        return m.frame(name)
    raise KeyError(f"no layer or frame is named {name}")


def sql(m: Decisions, text: str, more: dict[str, DataFrame] | None = None, **values) -> DataFrame:
    """The statement's result; ``more``: frames of the user's own by name."""
    more = more or {}
    named = {name: more[name] if name in more else layer(m, name) for name in dict.fromkeys(NAME.findall(text))}
    return m.spark.sql(text, args=values or None, **named)


def run(m: Decisions, texts: dict[str, str], **values) -> dict[str, DataFrame]:
    """The results of a sequence of named texts; each may read those before it. A text gets the values that it mentions."""
    done: dict[str, DataFrame] = {}
    for name, text in texts.items():
        own = {k: v for k, v in values.items() if re.search(rf":{k}\b", text)}
        done[name] = sql(m, text, done, **own)
    return done


def publish(m: Decisions, names: Iterable[str] = LAYERS, prefix: str = "") -> list[str]:
    """Make layers temporary views of the session; gives the views' names. Publishing again replaces them."""
    made = []
    for name in names:
        layer(m, name).createOrReplaceTempView(f"{prefix}{name}")
        made.append(f"{prefix}{name}")
    return made


def plain(text: str) -> str:
    """The text for a reader that has the layers as tables under their own names."""
    return NAME.sub(r"\1", text)
