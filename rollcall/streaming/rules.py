"""The rules of the refresh queue for one task, for folds that hold tasks as state. ``state`` has the same rules for tables of tasks."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

#: What errors hold after which a task is always tried again; of each entry all parts.
RETRYABLE = (
    ("block not found",),
    ("historical state", "not available"),
    ("error sending request",),
    ("request timed out",),
    ("context canceled",),
    ("connection reset",),
    ("connection refused",),
    ("temporarily unavailable",),
    ("deadline has elapsed",),
    ("too many requests",),
    ("rate limit",),
)
#: Doublings of the pause at most, and characters of an error that are kept.
MOST_DOUBLINGS, ERROR_CHARS = 5, 2048

State = dict[str, Any]


def is_retryable(error: str | None) -> bool:
    text = (error or "").lower()
    return any(all(part in text for part in parts) for parts in RETRYABLE)


@dataclass(frozen=True)
class Rules:
    """Times are milliseconds. Each method changes a task in place."""

    debounce_ms: int = 60_000
    lease_ms: int = 300_000
    retry_ms: int = 30_000
    max_attempts: int = 3

    def pause(self, attempts: int) -> int:
        """How long a task waits after so many attempts."""
        return self.retry_ms << min(max(attempts - 1, 0), MOST_DOUBLINGS)

    def stale(self, task: State, now: int) -> bool:
        return task["status"] == "processing" and task["locked_at"] is not None and task["locked_at"] <= now - self.lease_ms

    def enqueued(self, task: State, now: int, block: int) -> None:
        """Work for the account: at once due again after the debounce, or noted for after the lock."""
        if task["status"] is None:
            task |= {"status": "pending", "attempts": 0, "next_run_at": now + self.debounce_ms, "first_block": block, "last_block": block}
            return
        if task["status"] == "completed" and block <= task["last_block"]:
            return
        if task["status"] == "processing":
            task |= {"again": True, "again_block": max(task["last_block"] if task["again_block"] is None else task["again_block"], block)}
        else:
            task |= {"status": "pending", "attempts": 0, "next_run_at": now + self.debounce_ms, "processed_at": None, "error": None, "again_block": None}
        task |= {"first_block": min(task["first_block"], block), "last_block": max(task["last_block"], block)}

    def swept(self, task: State, now: int) -> None:
        """What becomes of tasks that are out of attempts: those with a retryable error get their last one back after a pause, others are exhausted."""
        spent = task["attempts"] >= self.max_attempts and (task["status"] == "failed" or self.stale(task, now))
        if is_retryable(task["error"]):
            if task["status"] == "exhausted" or spent and task["status"] == "processing":
                task |= {"status": "failed", "attempts": max(self.max_attempts - 1, 0), "next_run_at": now + self.pause(self.max_attempts), "locked_at": None, "processed_at": None}
        elif spent:
            task |= {"status": "exhausted", "locked_at": None, "processed_at": now if task["processed_at"] is None else task["processed_at"]}

    def claimed(self, task: State, now: int) -> None:
        ready = task["status"] == "pending" or task["attempts"] < self.max_attempts and (task["status"] == "failed" or self.stale(task, now))
        if ready and task["next_run_at"] <= now:
            task |= {"status": "processing", "attempts": task["attempts"] + 1, "locked_at": now}

    def completed(self, task: State, now: int) -> None:
        if task["status"] != "processing":
            return
        if task["again"]:
            task |= {"status": "pending", "attempts": 0, "next_run_at": now + self.debounce_ms}
        else:
            task |= {"status": "completed", "processed_at": now}
        last = task["last_block"] if task["again_block"] is None else task["again_block"]
        task |= {"locked_at": None, "error": None, "last_block": last, "again": False, "again_block": None}

    def failed(self, task: State, now: int, error: str | None) -> None:
        if task["status"] != "processing":
            return
        attempts, again = task["attempts"], is_retryable(error)
        task |= {
            "status": "failed" if again or attempts < self.max_attempts else "exhausted", "attempts": max(self.max_attempts - 1, 0) if again and attempts >= self.max_attempts else attempts,
            "next_run_at": now + self.pause(attempts), "locked_at": None, "processed_at": None, "error": (error or "")[:ERROR_CHARS],
        }
