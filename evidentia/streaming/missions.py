"""Leads of missions as a stream: documents arrive, each mission's registry is state, and changed registries go on.

Documents are examined without state, side by side, as in the batch form. The state of a mission is a map from a lead's
identity to the lead, MOST_ACTIVE of them at most; a lead that no document shows again for LEAD_MS falls out, and a mission
without documents for IDLE_MS is closed by a timer. A stream may begin with the registries of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.operators.leads import SEEN, SIGHTING, Lead, Registry, examined, lead_of, row_of

OUT = "mission_id string, brand string, reference string, rank int, low_confidence boolean, n_places int"
IDENTITY, VALUE = "brand_key string, reference_key string", f"target string, brand string, reference string, seen {SEEN}, low_confidence boolean, relevance int, strength int, offers array<string>"
FIELDS = ("target", "brand", "reference", "seen", "low_confidence", "relevance", "strength", "offers")
IDLE_MS, LEAD_MS = 24 * 3600 * 1000, 7 * 24 * 3600 * 1000


class Leads(StatefulProcessor):
    """A mission's registry: leads by identity."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.leads = handle, handle.getMapState("leads", IDENTITY, VALUE, LEAD_MS)

    def kept(self) -> tuple[str, list[Lead]]:
        rows = [dict(zip(("brand_key", "reference_key"), key)) | dict(zip(FIELDS, value)) for key, value in (self.leads.iterator() if self.leads.exists() else ())]
        for r in rows:
            r["seen"] = [dict(zip(("url", "field", "spelling", "rank"), s)) for s in r["seen"]]
        return (rows[0]["target"] if rows else ""), [lead_of(r) for r in rows]

    def put(self, mission: str, registry: Registry, before: list[Lead]) -> None:
        """Only leads that changed are written, so that others age."""
        old = {(x.brand_key, x.reference_key): x for x in before}
        for key in old.keys() - registry.leads.keys():
            self.leads.removeKey(key)
        for key, x in registry.leads.items():
            if old.get(key) != x:
                row = row_of(mission, registry.target, x) | {"seen": [tuple(s) for s in x.seen]}
                self.leads.updateValue(key, tuple(row[f] for f in FIELDS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        target, before = self.kept()
        found = pd.concat(list(rows)).sort_values(["ord", "seq"], kind="stable")
        registry = Registry(found.iloc[0]["target"] or target, before)
        for _, document in found.groupby("ord", sort=True):
            registry.absorb(lead_of(r) for r in document.to_dict("records"))
        self.put(key[0], registry, before)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + IDLE_MS)
        yield pd.DataFrame([(key[0], x.brand, x.reference, n, x.low_confidence, len(x.seen)) for n, x in enumerate(registry.ranked(), 1)], columns=["mission_id", "brand", "reference", "rank", "low_confidence", "n_places"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.leads.clear()
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        first = initialState.iloc[0]["target"] or ""
        self.put(key[0], Registry(first, [lead_of(r) for r in initialState.to_dict("records")]), [])

    def close(self) -> None:
        pass


def lead_stream(documents: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """A mission's active leads after each batch of its documents; needs the RocksDB state store.

    `documents` (streaming): mission_id, ord, url, title, snippets, content, rank, proposals, and the mission's product,
    origin_brand, target_brand and criteria on each row. `state`: registries to begin with, as absorb() gives them."""
    columns = ["mission_id", "ord", "url", "title", "snippets", "content", "rank", "proposals", "product", "origin_brand", "target_brand", "criteria"]
    seen = documents.select(*columns, F.lit(True).alias("fallback")).mapInArrow(examined, SIGHTING).filter("reason IS NULL")
    begin = None if state is None else state.drop("rank").groupBy("mission_id")
    return seen.groupBy("mission_id").transformWithStateInPandas(statefulProcessor=Leads(), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime", initialState=begin)


def gate_stream(verdicts: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counters of gate verdicts by mission and event-time window, with a watermark for late pages."""
    late = verdicts.withWatermark("fetched_at", delay)
    return late.groupBy(F.window("fetched_at", window), "mission_id").agg(F.count("*").alias("pages_fetched"), F.count_if("accepted").alias("pages_analyzed"))
