"""Export tasks that run beside their caller."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

EXPIRY_SECONDS = 3600


@dataclass
class Task:
    id: str
    status: str = "pending"
    error: str | None = None
    created: float = field(default_factory=time.time)
    path: str | None = None


class Exports:
    """pending, processing, completed or failed; expired an hour after completion."""

    def __init__(self, expiry: float = EXPIRY_SECONDS):
        self.tasks: dict[str, Task] = {}
        self.threads: dict[str, threading.Thread] = {}
        self.expiry = expiry

    def submit(self, work: Callable[[], None], path: str) -> str:
        task = Task(uuid.uuid4().hex, path=path)
        self.tasks[task.id] = task

        def run() -> None:
            task.status = "processing"
            try:
                work()
                task.status, task.created = "completed", time.time()
            except Exception as e:
                task.status, task.error = "failed", str(e)

        self.threads[task.id] = threading.Thread(target=run, daemon=True)
        self.threads[task.id].start()
        return task.id

    def status(self, task_id: str) -> Task:
        task = self.tasks[task_id]
        if task.status == "completed" and time.time() - task.created > self.expiry:
            task.status = "expired"
        return task

    def wait(self, task_id: str, seconds: float | None = None) -> Task:
        self.threads[task_id].join(seconds)
        return self.status(task_id)
