"""Carries out plans of moves on a local file system, with a write-ahead journal; undoes them from the journal.

Each move is planned in the journal before it is made and completed after it, so that a run that dies can be judged
move by move. Plans are what a person reviews and moves is one driver's work; nothing here runs in Spark.
"""

from __future__ import annotations

import os
import uuid

from veritree.sinks import files


class Run:
    """One run in a journal file: `with Run(...) as run: run.move(...)`; it commits at the end, or records why it did not."""

    def __init__(self, journal: str, tool: str, root: str, mode: str = "APPLY", target: str | None = None):
        self.journal, self.tool, self.root, self.mode, self.target = journal, tool, root, mode, target
        self.run_id, self.count, self.seq = uuid.uuid4().hex, 0, 0
        if os.path.exists(journal):
            with open(journal, "rb") as f:
                self.seq = sum(1 for _ in f)

    def _event(self, event: str, **fields) -> None:
        files.append(self.journal, {"schema_version": 1, "seq": self.seq, "run_id": self.run_id, "event": event, **fields})
        self.seq += 1

    def __enter__(self) -> Run:
        self._event("RUN_STARTED", tool=self.tool, mode=self.mode, target_run_id=self.target)
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is None:
            self._event("RUN_COMMITTED", action_count=self.count, target_run_id=self.target)
        else:
            self._event("RUN_INCOMPLETE", reason=str(kind.__name__))

    def move(self, source: str, target: str) -> None:
        """Moves one file inside the root, onto a name that must be free."""
        before, after = (self._inside(p) for p in (source, target))
        action = f"a{self.count}"
        self._event("ACTION_PLANNED", action_id=action, before=source, after=target)
        os.makedirs(os.path.dirname(after), exist_ok=True)
        os.link(before, after, follow_symlinks=False)  # fails if the name is taken, unlike a rename
        os.unlink(before)
        self._event("ACTION_COMPLETED", action_id=action)
        self.count += 1

    def _inside(self, path: str) -> str:
        if os.path.isabs(path) or os.path.normpath(path) != path or path.startswith(".."):
            raise ValueError(f"{path} is no relative path in normal form")
        full = os.path.join(self.root, path)
        if os.path.realpath(os.path.dirname(full)) != os.path.normpath(os.path.dirname(full)):
            raise ValueError(f"{path} leads through a link")
        return full


def apply(plan: list[tuple[str, str]], journal: str, tool: str, root: str) -> str:
    """Makes the moves (source, target) in order, and returns the run's id."""
    with Run(journal, tool, root) as run:
        for source, target in plan:
            run.move(source, target)
    return run.run_id


def undo(steps: list[tuple[str, str]], journal: str, tool: str, root: str, target: str) -> str:
    """Makes the steps of an undo plan (before, after) as a run that names the run it reverts."""
    with Run(journal, tool, root, "UNDO", target) as run:
        for source, back in steps:
            run.move(source, back)
    return run.run_id
