"""Push sources as pull sources: a reader thread fills a bounded buffer that polls drain."""

from __future__ import annotations

import collections
import logging
import threading
import time
from collections.abc import Callable
from typing import Any

log = logging.getLogger(__name__)
WARN_EVERY = 10.0


class DeadReaderError(RuntimeError):
    """The reader ended without having delivered anything."""


class Session:
    """One life of a reader: a thread, and the queue that it alone fills.

    Whoever lets go of a session drops its queue with it, so what an abandoned thread still delivers
    reaches nobody. A full queue loses its oldest samples.
    """

    def __init__(self, read: Callable, size: int, lost: Callable[[int], None]):
        self.queue: collections.deque = collections.deque()
        self.size, self.lost, self.guard, self.stopping = size, lost, threading.Lock(), threading.Event()
        self.received = self.dropped = 0
        self.failure: BaseException | None = None
        self.thread = threading.Thread(target=self._live, args=(read,), daemon=True)
        self.thread.start()

    def _live(self, read: Callable) -> None:
        try:
            read(self.put, self.stopping.is_set)
        except BaseException as e:  # noqa: BLE001 -- told by the next poll
            self.failure = e.with_traceback(None)

    def put(self, sample: Any) -> None:
        with self.guard:
            self.received += 1
            self.queue.append(sample)
            over = len(self.queue) > self.size
            if over:
                self.queue.popleft()
                self.dropped += 1
        if over:
            self.lost(self.dropped)

    def take(self) -> list:
        with self.guard:
            out = list(self.queue)
            self.queue.clear()
        return out

    @property
    def over(self) -> bool:
        return not self.thread.is_alive()


class PushSource:
    """Base of sources that receive: subclasses write ``run_reader(emit, should_stop)``, which blocks.

    What a dead reader had delivered is still handed out; its error is raised by the next poll, and
    the one after begins a new session.
    """

    def __init__(self, name: str, size: int = 4096, join_timeout: float = 2.0, clock: Callable[[], float] = time.monotonic):
        if size < 1:
            raise ValueError("a buffer holds one sample at least")
        self.name, self.size, self.join_timeout, self.clock = name, size, join_timeout, clock
        self.session: Session | None = None
        self.left: list = []  # of sessions that are over
        self.before = collections.Counter()
        self.warned = float("-inf")

    def run_reader(self, emit: Callable[[Any], None], should_stop: Callable[[], bool]) -> None:
        raise NotImplementedError

    @property
    def thread(self) -> threading.Thread | None:
        return self.session and self.session.thread

    def _lost(self, dropped: int) -> None:
        if self.clock() - self.warned >= WARN_EVERY:
            self.warned = self.clock()
            log.warning("%s: buffer full, %d samples dropped so far", self.name, self.before["dropped"] + dropped)

    def _retire(self) -> Session | None:
        """Let go of the session; its samples and counts stay."""
        done, self.session = self.session, None
        if done:
            self.left = (self.left + done.take())[-self.size :]
            self.before.update(received=done.received, dropped=done.dropped)
        return done

    def poll(self) -> list:
        """Samples since the last poll, in order."""
        now = self.session
        if now and now.over:
            if now.failure is not None:
                failure, now.failure = now.failure, None
                raise failure
            fruitless = not self._retire().received
            self.before["restarts"] += 1
            self.session = Session(self.run_reader, self.size, self._lost)
            if fruitless:
                raise DeadReaderError(f"{self.name}: the last reader delivered nothing")
        elif not now:
            self.session = Session(self.run_reader, self.size, self._lost)
        out, self.left = self.left + self.session.take(), []
        return out

    def stats(self) -> dict[str, int]:
        now = self.session
        return {"received_total": self.before["received"] + (now.received if now else 0), "dropped_total": self.before["dropped"] + (now.dropped if now else 0), "reader_restarts": self.before["restarts"]}

    def close(self) -> None:
        """Stop the reader; one that does not end in time is abandoned with its queue."""
        if self.session:
            self.session.stopping.set()
            self.session.thread.join(self.join_timeout)
            self._retire()
