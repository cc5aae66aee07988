"""The rule by which a key's failures disable it and time or success enables it again, one event at a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """A failure disables if it is the ``retry_count``-th within ``seconds``, or if the first one lies ``hard_timeout``
    seconds back; ``persist`` seconds later, or by a DONE before that, the key is enabled and its failures forgotten."""

    seconds: int = 3600
    retry_count: int = 3
    hard_timeout: int = 86400
    persist: int = 86400


@dataclass
class State:
    """A key's failures within the window, its first failure, and since when it is disabled, in microseconds."""

    failed: deque = field(default_factory=deque)
    first: int | None = None
    disabled: int | None = None

    def due(self, rule: Rule) -> int | None:
        """When a disabled key is enabled, if nothing happens before."""
        return None if self.disabled is None else self.disabled + rule.persist * 1_000_000

    def forget(self) -> None:
        self.failed.clear()
        self.first = self.disabled = None

    def step(self, rule: Rule, us: int, status: str) -> Iterator[tuple[int, str]]:
        """The changes (time, change) that an event brings; events come in order."""
        due = self.due(rule)
        if due is not None and (us >= due or status == "DONE"):
            yield min(us, due), "ENABLED"
            self.forget()
        if status == "FAILED" and self.disabled is None:
            self.first = us if self.first is None else self.first
            self.failed.append(us)
            while self.failed[0] < us - rule.seconds * 1_000_000:
                self.failed.popleft()
            if len(self.failed) >= rule.retry_count or us - self.first >= rule.hard_timeout * 1_000_000:
                self.disabled = us
                yield us, "DISABLED"

    def pass_time(self, rule: Rule, us: int) -> Iterator[tuple[int, str]]:
        """The change that time alone brings until ``us``, itself included."""
        due = self.due(rule)
        if due is not None and us >= due:
            self.forget()
            yield due, "ENABLED"


def changes(rule: Rule, rows: Iterable[tuple], now: int | None = None) -> Iterator[tuple]:
    """(key, event, us, change) of rows (key, event, status, us) sorted by key and time.

    With ``now`` keys that are still disabled when their rows end are enabled by time, of no event, if that is due.
    """
    at, state = None, State()

    def ended() -> Iterator[tuple]:
        if now is not None:
            yield from ((at, None, us, change) for us, change in state.pass_time(rule, now))

    for key, event, status, us in rows:
        if key != at:
            yield from ended()
            at = key
            state.forget()
        yield from ((key, event, when, change) for when, change in state.step(rule, us, status))
    yield from ended()
