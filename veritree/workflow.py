"""Workflows of stages on the driver: one collection's stages in order, queues of collections, plans over a virtual namespace.

Stages are callables that return an exit status; what they do is their own (Spark jobs, reports, plans). State is a
small JSON record, replaced whole after every attempt, so a driver that dies repeats at most the attempt it was in.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritree.operators import transitions
from veritree.plans import digest
from veritree.sinks import files

#: Exit statuses: done, findings or unproven or stopped safely, usage or setup error.
DONE, STOPPED, REFUSED = 0, 1, 2


@dataclass(frozen=True)
class Stage:
    """A stage; `accepts` are the statuses it advances on, and `advances` tells whether it can at all (acknowledgements never do)."""

    name: str
    run: Callable[[], int]
    accepts: tuple[int, ...] = (DONE,)
    advances: bool = True


class Workflow:
    """The attempts of one collection, kept in a state file: {"schema_version", "next_stage", "attempts": [{"stage", "status"}]}."""

    def __init__(self, path: str, stages: list[Stage]):
        self.path, self.stages = path, stages

    def state(self) -> dict:
        if not os.path.exists(self.path):
            return {"schema_version": 1, "next_stage": 0, "attempts": []}
        with open(self.path, encoding="utf-8") as f:
            state = json.load(f)
        names = [s.name for s in self.stages]
        if set(state) != {"schema_version", "next_stage", "attempts"} or state["schema_version"] != 1 or not 0 <= state["next_stage"] <= len(names) or any(a["stage"] not in names for a in state["attempts"]):
            raise ValueError(f"{self.path} is no state of this workflow")
        return state

    def run_next(self) -> int:
        """Runs the next stage and records the attempt; advances by one stage on a status that it accepts."""
        state = self.state()
        if state["next_stage"] == len(self.stages):
            return DONE
        stage = self.stages[state["next_stage"]]
        status = stage.run()
        ahead = int(status in stage.accepts and stage.advances)
        files.replace(self.path, {"schema_version": 1, "next_stage": state["next_stage"] + ahead, "attempts": [*state["attempts"], {"stage": stage.name, "status": status}]})
        return DONE if ahead else status or STOPPED

    def run(self) -> int:
        """Runs stages until one does not advance; 0 if all are done."""
        while self.state()["next_stage"] < len(self.stages):
            if status := self.run_next():
                return status
        return DONE

    def status(self) -> str:
        """not-started, pending, stopped or complete."""
        state = self.state()
        if state["next_stage"] == len(self.stages):
            return "complete"
        if not state["attempts"]:
            return "not-started"
        return "stopped" if state["attempts"][-1]["status"] != DONE else "pending"


def run_queue(jobs: list[Workflow], retry: frozenset[int] = frozenset()) -> list[tuple[int, str]]:
    """Jobs in order: complete ones are skipped, stopped ones run only if named in `retry`, and the first that does not end stops the queue. (ordinal, status) of each job."""
    out, stopped = [], False
    for k, job in enumerate(jobs):
        if not stopped and job.status() != "complete" and (job.status() != "stopped" or k in retry):
            job.run()
        out.append((k, job.status()))
        stopped = stopped or job.status() != "complete"
    return out


def virtual_stages(namespace: DataFrame, plans: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> list[dict]:
    """The digest of a namespace (path, kind) before and after each planned stage; a stage gives moves (source, target), and collisions refuse it.

    Stages are lazy plans on top of each other; of each only its counts and digest, one row, reach the driver.
    """
    now = namespace.select("path", "kind")
    out = [{"stage": None, "moves": 0, "collisions": 0, "digest": _digest(now)}]
    for name, plan in plans:
        moves = plan(now).select("source", "target")
        now = transitions.moved(now, moves).select("path", "kind")
        out.append({"stage": name, "moves": moves.count(), "collisions": transitions.collisions(now).count(), "digest": _digest(now)})
        if out[-1]["collisions"]:
            break
    return out


def _digest(namespace: DataFrame) -> str:
    return digest.set_digest(namespace, F.concat_ws(":", "path", "kind")).first()["digest"]


def plan_bound(accepted: dict, observed: dict) -> list[str]:
    """Which parts of what is observed differ from the accepted plan: its baseline, configuration, stage count, or the namespace of the current stage."""
    out = [name for name in ("baseline", "configuration", "stages") if accepted[name] != observed[name]]
    stage = observed["stage"]
    if not 0 <= stage < len(accepted["namespaces"]) or accepted["namespaces"][stage] != observed["namespace"]:
        out.append("namespace")
    return out


def accept(path: str, policy: bytes, candidate: str, outside: tuple[str, ...] = ()) -> dict:
    """A receipt that binds a policy's bytes to the digest of the candidate they were made for; never replaced."""
    import hashlib

    receipt = {"schema_version": 1, "candidate": candidate, "policy_sha256": hashlib.sha256(policy).hexdigest()}
    files.create(path, receipt, outside)
    return receipt
