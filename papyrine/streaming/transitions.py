"""Transitions and animations of elements as keyed state over a stream of ticks.

A row is (element, seq, at, kind, prop, value, duration, delay): at time ``at`` (time is
data, nothing reads a clock) the style of ``prop`` is ``set``, an animation that keeps its
end value starts (``animate``), or time merely passes (``tick``).  Rows of an element
count in the order of ``seq`` from 0, whatever the batch they come in; rows that come
early wait in a map of the state, and a row that comes again is ignored.  So the same
rows come out for any batching.

What time has reached between two rows is reported first, by time and then by the
order in which the transitions and animations began (a stable order), and only then what
the row itself does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..runtime import ship
from .events import use_rocksdb

OUTPUT = "element string, event_no long, at double, kind string, prop string, value double"
_row = Row(*(c.split()[0] for c in OUTPUT.split(", ")))
#: (at, kind, prop, value)
Report = tuple[float, str, str | None, float | None]


@dataclass
class Element:
    """State of one element.

    ``base`` holds the values set; ``moving`` the transition of each property (order,
    begin, delay, duration, from, to, started, reversing start, reversing factor);
    ``played`` the animations of each property (order, begin, delay, duration, to, finished).
    """

    base: dict[str, float] = field(default_factory=dict)
    moving: dict[str, list] = field(default_factory=dict)
    played: dict[str, list[list]] = field(default_factory=dict)
    count: int = 0
    now: float = float("-inf")

    def apply(self, at: float, kind: str, prop: str | None, value: float | None, duration: float, delay: float) -> list[Report]:
        at = max(at, self.now)
        out = self.advance(at)
        if kind == "set" and prop is not None and value is not None:
            out += self._set(at, prop, value, max(duration, 0.0), delay)
        elif kind == "animate" and prop is not None and value is not None:
            self.played.setdefault(prop, []).append([self._order(), at, delay, max(duration, 0.0), value, False])
            out.append((at, "play", prop, value))
            out += self.advance(at)
        elif kind == "tick":
            out += [(at, "sample", p, self.value(p, at)) for p in sorted(self.base.keys() | self.played.keys())]
        return out

    def _order(self) -> int:
        self.count += 1
        return self.count

    def value(self, prop: str, at: float) -> float | None:
        """Value at a time: the last animation that has begun, else the transition, else what was set."""
        under = self.base.get(prop)
        if prop in self.moving:
            _, begin, delay, duration, start, end, *_ = self.moving[prop]
            under = start + (end - start) * min(1.0, max(0.0, (at - begin - delay) / duration if duration else float(at >= begin + delay)))
        for _, begin, delay, duration, end, _ in self.played.get(prop, ()):
            if at >= begin + delay:
                share = min(1.0, (at - begin - delay) / duration) if duration else 1.0
                under = end * share + (under if under is not None else 0.0) * (1 - share)
        return under

    def advance(self, to: float) -> list[Report]:
        """Everything that happens up to ``to``, in a stable order."""
        due: list[tuple[float, int, str, str]] = []
        for prop, (order, begin, delay, duration, _, _, started, *_) in self.moving.items():
            if not started and begin + max(delay, 0.0) <= to:
                due.append((begin + max(delay, 0.0), order, "start", prop))
            if begin + delay + duration <= to:
                due.append((max(begin, begin + delay + duration), order, "end", prop))
        for prop, animations in self.played.items():
            due += [(max(begin, begin + delay + duration), order, "finish", prop) for order, begin, delay, duration, _, finished in animations if not finished and begin + delay + duration <= to]
        out: list[Report] = []
        for at, order, kind, prop in sorted(due, key=lambda d: (d[0], d[1], d[2] != "start")):
            if kind == "start":
                self.moving[prop][6] = True
                out.append((at, kind, prop, self.moving[prop][4]))
            elif kind == "end":
                end = self.moving.pop(prop)[5]
                out.append((at, kind, prop, end))
            else:
                out += self._finish(at, order, prop)
        self.now = max(self.now, to)
        return out

    def _finish(self, at: float, order: int, prop: str) -> list[Report]:
        """An animation ends; finished ones that a later finished one covers are removed."""
        own = next(a for a in self.played[prop] if a[0] == order)
        own[5] = True
        out: list[Report] = [(at, "finish", prop, own[4])]
        last = max(a[0] for a in self.played[prop] if a[5])
        gone = [a for a in self.played[prop] if a[5] and a[0] < last]
        self.played[prop] = [a for a in self.played[prop] if a not in gone]
        return out + [(at, "remove", prop, a[4]) for a in gone]

    def _set(self, at: float, prop: str, value: float, duration: float, delay: float) -> list[Report]:
        if prop not in self.base:  # the first value of a property moves from nowhere
            self.base[prop] = value
            return []
        running = self.moving.get(prop)
        if value == (running[5] if running else self.base[prop]):
            return []
        begin_value = self.base[prop]
        out: list[Report] = []
        reverse_from, factor = begin_value, 1.0
        if running:
            del self.moving[prop]
            _, begin, old_delay, old_duration, start, end, _, old_reverse, old_factor = running
            share = min(1.0, max(0.0, (at - begin - old_delay) / old_duration)) if old_duration else 1.0
            begin_value = start + (end - start) * share
            out.append((at, "cancel", prop, begin_value))
            reverse_from = begin_value
            if value == old_reverse:  # turned back half-way: the way back is as short
                factor = min(1.0, abs(share * old_factor + 1 - old_factor))
                duration, delay = duration * factor, delay * factor if delay < 0 else delay
                reverse_from = end
        self.base[prop] = value
        if duration + delay > 0 and value != begin_value:
            self.moving[prop] = [self._order(), at, delay, duration, begin_value, value, False, reverse_from, factor]
            out.append((at, "run", prop, begin_value))
            out += self.advance(at)
        return out

    def state(self) -> str:
        return json.dumps([self.base, self.moving, self.played, self.count, self.now])

    @classmethod
    def of(cls, state: str) -> Element:
        return cls(*json.loads(state)) if state else cls()


class _Machine(StatefulProcessor):
    """One key; waiting rows are kept as JSON by their seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "next long, sent long, element string")
        self.waiting = handle.getMapState("waiting", "seq long", "row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        following, sent, state = tuple(self.progress.get()) if self.progress.exists() else (0, 0, "")
        element, out = Element.of(state), []
        for row in rows:
            seq = int(row["seq"])
            own = [row["at"], row["kind"], row["prop"], row["value"], row["duration"], row["delay"]]
            if seq < following:
                continue
            if seq > following:
                if not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), (json.dumps(own),))
                continue
            while own is not None:
                for report in element.apply(*own):
                    out.append(_row(key[0], sent, *report))
                    sent += 1
                following += 1
                own = None
                if self.waiting.containsKey((following,)):
                    own = json.loads(self.waiting.getValue((following,))[0])
                    self.waiting.removeKey((following,))
        self.progress.update((following, sent, element.state()))
        yield from out

    def close(self) -> None:
        pass


def run_elements(ticks: DataFrame) -> DataFrame:
    """What happens to every element: element, event_no, at, kind, prop, value.

    ``kind`` is run, start, end, cancel (transitions), play, finish, remove (animations)
    or sample.  A null time, duration or delay is 0; rows without an element, a seq or a
    known kind only let their seq pass.
    """
    ship(ticks.sparkSession)
    use_rocksdb(ticks.sparkSession)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    thin = ticks.where("element is not null and seq >= 0").select(
        F.col("element").cast("string").alias("element"), F.col("seq").cast("long").alias("seq"), number("at"), F.coalesce("kind", F.lit("")).alias("kind"), "prop", F.col("value").cast("double").alias("value"), number("duration"), number("delay")
    )
    return thin.groupBy("element").transformWithState(_Machine(), OUTPUT, "Append", "None")
