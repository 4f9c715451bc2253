"""Delayed tasks by name: queues that hand over what is due, handlers that may ask for another turn."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass
from threading import Event
from typing import Any

from ..errors import QueueError
from ..sources.storage import Storage
from ..warehouse import Warehouse

Handler = Callable[[Any], "Result | None"]


@dataclass(frozen=True)
class Result:
    requeue: bool = False
    delay: float = 0.0


@dataclass
class _Task:
    name: str
    payload: str
    due: float


@dataclass
class Tasker:
    """Driver-side queues. A task leaves its queue when its handler returns, so one that fails stays due.

    With ``store`` and ``path`` every change is written there, and a new Tasker goes on where the last one ended; one
    Tasker at a time may use a path.
    """

    clock: Callable[[], float] = time.time
    store: Storage | None = None
    path: str = ""
    retry_seconds: float = 1.0
    failures: list[tuple[str, Exception]] = field(default_factory=list)
    _handlers: dict[str, Handler] = field(default_factory=dict)
    _packets: dict[str, type] = field(default_factory=dict)
    _queues: dict[str, dict[str, _Task]] = field(default_factory=dict)
    _delayed: dict[str, bool] = field(default_factory=dict)
    _next: int = 0

    def __post_init__(self) -> None:
        if self.store is not None and self.store.exists(self.path):
            kept = json.loads(self.store.read_text(self.path))
            self._queues = {q: {i: _Task(*t) for i, t in tasks.items()} for q, tasks in kept.items()}
            self._delayed = dict.fromkeys(kept, True)

    def _save(self) -> None:
        if self.store is not None:
            kept = {q: {i: (t.name, t.payload, t.due) for i, t in tasks.items()} for q, tasks in self._queues.items()}
            self.store.write_text(self.path, json.dumps(kept, sort_keys=True))

    def register_task(self, name: str, handler: Handler, packet: type | None = None) -> None:
        """Name a handler. With ``packet``, a dataclass, it gets one of those, made anew from the JSON it was queued as."""
        self._handlers[name] = handler
        if packet is not None:
            self._packets[name] = packet

    def register_queue(self, name: str, delayed: bool = True) -> None:
        self._queues.setdefault(name, {})
        self._delayed[name] = delayed

    def add(self, queue: str, task: str, task_id: str, payload: Any, delay: float = 0.0, replace: bool = False) -> bool:
        """Queue a task; of the same task_id the first due time stays unless ``replace``. True if it was queued."""
        if queue not in self._queues:
            raise QueueError(f"unknown queue {queue!r}")
        if task not in self._handlers:
            raise QueueError(f"unknown task {task!r}")
        if delay and not self._delayed[queue]:
            raise QueueError(f"queue {queue!r} takes no delayed tasks")
        if task_id in self._queues[queue] and not replace:
            return False
        plain = asdict(payload) if is_dataclass(payload) else payload
        self._queues[queue][task_id] = _Task(task, json.dumps(plain, sort_keys=True), self.clock() + delay)
        self._save()
        return True

    def length(self, queue: str) -> int:
        return len(self._queues[queue])

    def _earliest(self) -> tuple[str, str] | None:
        """Queue and id of the earliest due task of the next queue that has one."""
        names = list(self._queues)
        for i in range(len(names)):
            queue = names[(self._next + i) % len(names)]
            due = min(((t.due, key) for key, t in self._queues[queue].items() if t.due <= self.clock()), default=None)
            if due is not None:
                self._next = (self._next + i + 1) % len(names)
                return queue, due[1]
        return None

    def _handle(self, queue: str, task_id: str) -> None:
        task = self._queues[queue][task_id]
        if task.name not in self._handlers:
            raise QueueError(f"unknown task {task.name!r}")
        plain = json.loads(task.payload)
        result = self._handlers[task.name](self._packets[task.name](**plain) if task.name in self._packets else plain)
        if result is not None and result.requeue:
            task.due = self.clock() + result.delay
        elif self._queues[queue].get(task_id) is task:
            del self._queues[queue][task_id]
        self._save()

    def run_next(self) -> bool:
        """Run the earliest due task of the next queue that has one; False if none is due."""
        found = self._earliest()
        if found is not None:
            self._handle(*found)
        return found is not None

    def run(self, seconds: float | None = None, idle: float = 0.05, stop: Event | None = None) -> int:
        """Run what becomes due for ``seconds`` or until ``stop`` is set, with pauses of ``idle`` seconds where nothing
        is; the number of tasks that went well. One that fails is noted in ``failures`` and due again in
        ``retry_seconds``; the others go on."""
        end, done = None if seconds is None else time.monotonic() + seconds, 0
        while not (stop is not None and stop.is_set()) and (end is None or time.monotonic() < end):
            found = self._earliest()
            if found is None:
                time.sleep(idle)
                continue
            try:
                self._handle(*found)
                done += 1
            except Exception as error:  # noqa: BLE001 - a task's failure is no other's
                self.failures = [*self.failures[-99:], (found[1], error)]
                self._queues[found[0]][found[1]].due = self.clock() + self.retry_seconds
                self._save()
        return done


@dataclass(frozen=True)
class MergePacket:
    """Asks for what is due of a source to be merged."""

    table: str
    source: str


def schedule_merges(warehouse: Warehouse, tasker: Tasker, queue: str = "merges") -> Callable[[str, str], bool]:
    """Let ``tasker`` merge staged rows. The function given back queues a source's merge, which is due after the table's
    delay; while one is queued another changes nothing, and one that leaves rows waiting comes again."""

    def merge(packet: MergePacket) -> Result | None:
        warehouse.merge_due(packet.table, packet.source)
        waits = warehouse.staged(packet.table, packet.source) is not None
        return Result(requeue=True, delay=warehouse.table(packet.table).options.delay_seconds) if waits else None

    tasker.register_queue(queue)
    tasker.register_task("merge", merge, MergePacket)

    def ask(table: str, source: str) -> bool:
        delay = warehouse.table(table).options.delay_seconds
        return tasker.add(queue, "merge", f"{table}-{source}", MergePacket(table, source), delay)

    return ask
