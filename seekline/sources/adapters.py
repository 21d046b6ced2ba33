"""Outside services as functions, with stand-ins that need no network."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.plans.lineage import materialize

#: A language model: prompt -> (text or None, reason or None).
Model = Callable[[str], tuple[str | None, str | None]]


def no_model(prompt: str) -> tuple[None, str]:
    return None, "no_key"


def chain(*models: Model) -> Model:
    """The first text that is not empty wins; else the last reason. A model that fails counts as ``error``."""

    def ask(prompt: str):
        reason = "no_key"
        for m in models:
            try:
                text, why = m(prompt)
            except Exception:
                text, why = None, "error"
            if text and text.strip():
                return text, None
            reason = why or "error"
        return None, reason

    return ask


def route(models: dict[str, Model], forced: str | None = None) -> Model:
    """The provider that is forced by name, alone, or all in their order; a forced name that isn't there counts as ``no_key``."""
    if forced is None:
        return chain(*models.values())
    return chain(models[forced]) if forced in models else no_model


def within(seconds: float, work: Callable, otherwise):
    """``work()`` if it ends in time without failing, else ``otherwise``."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(work).result(timeout=seconds)
    except (Late, Exception):
        return otherwise
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def synonyms_of(reply: str | None) -> list[str]:
    """The strings of the JSON array in a model's reply; anything else gives none."""
    if not reply:
        return []
    a, b = reply.find("["), reply.rfind("]")
    try:
        got = json.loads(reply[a : b + 1]) if 0 <= a < b else []
    except ValueError:
        return []
    return [x for x in got if isinstance(x, str)] if isinstance(got, list) else []


class Geocoder:
    """Places by name: a cache with an expiry before a lookup function; a failure is not kept."""

    def __init__(self, lookup: Callable[[str], dict | None], hours: int = 24, clock: Callable[[], dt.datetime] = dt.datetime.now):
        self.lookup, self.life, self.clock, self.cache = lookup, dt.timedelta(hours=hours), clock, {}

    def find(self, query: str) -> dict:
        key = query.strip().lower()
        if not key:
            return {"found": False}
        kept = self.cache.get(key)
        if kept and kept[0] > self.clock():
            return kept[1]
        try:
            got = self.lookup(key)
        except Exception:
            return {"found": False}
        out = {"found": True} | got if got else {"found": False}
        self.cache[key] = (self.clock() + self.life, out)
        return out


def geocode(queries: DataFrame, cache: DataFrame, lookup: Callable[[str], dict | None], now: dt.datetime, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Places (query, found, lat, lon, display_name) for a table of queries, and the cache afterwards.

    ``cache`` has (query, found, lat, lon, display_name, expires_at).  Rows
    that have not expired answer; each other place is looked up once, and what
    the lookup says, also that there is none, is kept for ``hours``; a lookup
    that fails gives a place not found that isn't kept.
    """
    fields = "query string, found boolean, lat double, lon double, display_name string"
    until = now + dt.timedelta(hours=hours)

    def ask(batches):
        for batch in batches:
            rows = []
            for q in batch["query"]:
                try:
                    got = lookup(q)
                except Exception:
                    rows.append((q, False, None, None, None, None))
                    continue
                rows.append((q, True, got.get("lat"), got.get("lon"), got.get("display_name"), until) if got else (q, False, None, None, None, until))
            yield pd.DataFrame(rows, columns=["query", "found", "lat", "lon", "display_name", "expires_at"]).astype({"lat": "float64", "lon": "float64", "expires_at": "datetime64[us]"})

    asked = queries.select(F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct()
    fresh = cache.where(F.col("expires_at") > F.lit(now))
    looked_up = materialize(asked.join(fresh.select("query"), "query", "left_anti").mapInPandas(ask, f"{fields}, expires_at timestamp"), "places")
    columns = [f.split(" ")[0] for f in fields.split(", ")]
    answers = asked.join(fresh, "query").select(*columns).unionByName(looked_up.select(*columns))
    return answers, fresh.select(*columns, "expires_at").unionByName(looked_up.where("expires_at is not null"))


def sse_text(events: Iterator[tuple[str, dict]]) -> Iterator[str]:
    """Named events as server-sent blocks."""
    for name, data in events:
        yield f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False, default=str)}\n\n"


def parse_sse(text: str) -> list[tuple[str, object]]:
    """The events of a stream's text; a block without readable JSON has the data None."""
    out = []
    for block in text.replace("\r\n", "\n").split("\n\n"):
        name, data = "message", []
        for line in block.split("\n"):
            if line.startswith("event:"):
                name = line[6:].strip()
            elif line.startswith("data:"):
                data.append(line[5:].lstrip())
        if data:
            try:
                out.append((name, json.loads("\n".join(data))))
            except ValueError:
                out.append((name, None))
    return out
