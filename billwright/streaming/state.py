"""Keyed state with event-time timers: sessions that expire eagerly, first discoveries in arrival order."""

import json
import math
from bisect import bisect_right
from itertools import islice

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

#: Files and blobs of an id's open sessions that stay with its spans; what is more goes to entries of their own. Entries read at once.
HELD, PIECE = 4_000, 50_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark):
    """Timers and map state need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class ExpiringSessions(StatefulProcessor):
    """Open sessions of one id; a session leaves with all its files and blobs once the watermark passes its last use plus the gap.

    State: one value with the spans of the open sessions in time order and, up to HELD in all, their distinct files and blobs, so an
    id costs one read and one write per micro-batch whatever its events. What is more goes to a map, one entry per session part
    and file or blob: a busy session grows on disk only, and no call reads all its entries into memory.
    Late events pass through as rows marked late. Input rows: session_id, us (event time in microseconds), kind, ref.
    """

    def __init__(self, gap_seconds, held=HELD):
        self.gap, self.most = gap_seconds * 1_000_000, held

    def init(self, handle):
        self.handle = handle
        self.spans = handle.getValueState("spans", "spans string")
        self.refs = handle.getMapState("refs", "part long, kind string, ref string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        state = self._state()
        spans = state["open"]
        firsts, held = [s["first"] for s in spans], sum(len(s["held"]) for s in spans)
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        for row in rows:
            if row.us <= behind:
                yield Row(session_id=key[0], first=row.us, last=row.us, events=1, kind=row.kind, ref=row.ref, late=True)
                continue
            span, more = self._span_of(spans, firsts, row.us), (row.kind, row.ref)
            if more not in span["held"]:
                span["held"].add(more)
                held += 1
                if held > self.most:
                    for other in spans:
                        self._spill(state, other)
                    held = 0
        self._keep(state)

    def _state(self):
        """Spans in time order, more than the gap apart: first, last, events, held (pairs of kind and ref), parts (numbers in the map)."""
        found = self.spans.get()
        state = json.loads(found[0]) if found else {"next": 0, "timer": None, "open": []}
        for span in state["open"]:
            span["held"] = set(map(tuple, span["held"]))
        return state

    def _span_of(self, spans, firsts, us):
        """The open session of an event; an event between two sessions joins them."""
        end = bisect_right(firsts, us + self.gap)
        start = end
        while start and spans[start - 1]["last"] + self.gap >= us:
            start -= 1
        near = spans[start:end] or [{"first": us, "last": us, "events": 0, "held": set(), "parts": []}]
        span = near[0]
        for other in near[1:]:
            span["last"] = max(span["last"], other["last"])
            span["events"] += other["events"]
            span["held"] |= other["held"]
            span["parts"] += other["parts"]
        span["first"], span["last"] = min(span["first"], us), max(span["last"], us)
        span["events"] += 1
        spans[start:end], firsts[start:end] = [span], [span["first"]]
        return span

    def _spill(self, state, span):
        """Moves the held files and blobs of a session to the map."""
        if span["held"] and not span["parts"]:
            span["parts"].append(state["next"])
            state["next"] += 1
        for entry in span["held"]:
            self.refs.updateValue((span["parts"][0], *entry), (True,))
        span["held"] = set()

    def _keep(self, state):
        due = min((self._expiry(s) for s in state["open"]), default=None)
        if due != state["timer"]:
            if state["timer"] is not None:
                self.handle.deleteTimer(state["timer"])
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.spans.clear()
            return
        kept = [{**s, "held": list(s["held"])} for s in state["open"]]
        self.spans.update((json.dumps({**state, "timer": due, "open": kept}),))

    def _expiry(self, span):
        return math.ceil((span["last"] + self.gap) / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self._state()
        now = timerValues.getCurrentWatermarkInMs()
        over = [s for s in state["open"] if self._expiry(s) <= now]
        part_of = {}
        for span in over:
            if span["parts"]:
                self._spill(state, span)
                part_of |= dict.fromkeys(span["parts"], span)
            for entry in span["held"]:
                yield self._row(key, span, *entry)
        for part, kind, ref in self._drained(part_of):
            span = part_of[part]
            # joined sessions may hold one file twice: the part that leaves last sends it
            if not any(self.refs.containsKey((other, kind, ref)) for other in span["parts"] if other != part):
                yield self._row(key, span, kind, ref)
        state["open"] = [s for s in state["open"] if self._expiry(s) > now]
        self._keep(state)

    def _row(self, key, span, kind, ref):
        return Row(session_id=key[0], first=span["first"], last=span["last"], events=span["events"], kind=kind, ref=ref, late=False)

    def _drained(self, parts):
        """The entries of these parts, each removed from the state before it is given, read in bounded pieces."""
        more = bool(parts)
        while more:
            piece = list(islice((entry for entry in self.refs.keys() if entry[0] in parts), PIECE))
            for entry in piece:
                self.refs.removeKey(entry)
                yield entry
            more = len(piece) == PIECE


class FirstDiscovery(StatefulProcessor):
    """The discovery with the least arrival number of one product, released when no earlier event can come any more.

    State: the least row as JSON and, once released, only the mark; a second timer clears the mark, by which time
    the catalog holds the product. Input rows: the key, us, seq, row (JSON).
    """

    def __init__(self, remember_seconds):
        self.remember = remember_seconds * 1000

    def init(self, handle):
        self.handle = handle
        self.least = handle.getValueState("least", "seq long, us long, row string")

    def handleInputRows(self, key, rows, timerValues):
        held = self.least.get() if self.least.exists() else None
        if held is not None and held[2] is None:
            return iter(())  # already released
        best, timed = held, held is not None
        for row in rows:
            if best is None or (row.seq, row.us, row.row) < tuple(best):
                best = (row.seq, row.us, row.row)
        if best is not None and best != held:
            self.least.update(tuple(best))
            if not timed:
                self.handle.registerTimer(math.ceil(best[1] / 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seq, us, row = self.least.get()
        if row is None:
            self.least.clear()
            return
        self.least.update((seq, us, None))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.remember)
        yield Row(row=row)
