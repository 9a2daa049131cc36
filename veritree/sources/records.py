"""Small records a person or a command writes - configurations, manifests, policies, outcomes, journals - read strictly."""

from __future__ import annotations

import json
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a manifest or policy may have.
LIMIT = 1 << 20
EVENT = "schema_version int, seq long, run_id string, event string, tool string, mode string, target_run_id string, action_id string, action_count long, reason string"


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is repeated")
    return out


def _refuse(constant: str) -> None:
    raise ValueError(f"{constant} is no JSON number")


def record(path: str, keys: tuple[str, ...], version: int, limit: int = LIMIT) -> dict:
    """One JSON object with exactly these keys and schema_version, within the limit; repeated keys, NaN and infinities are refused."""
    if os.path.getsize(path) > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    with open(path, encoding="utf-8") as f:
        value = json.load(f, object_pairs_hook=_no_repeats, parse_constant=_refuse)
    if not isinstance(value, dict) or set(value) != {"schema_version", *keys}:
        raise ValueError(f"{path} must have exactly the keys {sorted({'schema_version', *keys})}")
    if type(value["schema_version"]) is not int or value["schema_version"] != version:
        raise ValueError(f"{path} is not of version {version}")
    return value


def manifest(path: str) -> list[dict]:
    """The jobs of a queue, in order: name, source and working folder of each; names and folders are not repeated."""
    jobs = record(path, ("jobs",), 1)["jobs"]
    fields = ("name", "source", "working")
    if not isinstance(jobs, list) or not jobs or any(not isinstance(j, dict) or set(j) != set(fields) or any(not isinstance(j[f], str) or not j[f] for f in fields) for j in jobs):
        raise ValueError(f"every job of {path} must have {', '.join(fields)}")
    for f in fields:
        if len({j[f] for j in jobs}) != len(jobs):
            raise ValueError(f"{path} repeats a {f}")
    for j in jobs:
        for f in ("source", "working"):
            if not os.path.isabs(j[f]) or os.path.normpath(j[f]) != j[f] or "\0" in j[f]:
                raise ValueError(f"{j[f]} is no absolute path in normal form")
    return [{"ordinal": k, **j} for k, j in enumerate(jobs)]


def policy(path: str, checkpoints: tuple[str, ...]) -> list[dict]:
    """The expectations of a policy, in the canonical order of its checkpoints, each once."""
    rows = record(path, ("expected",), 5)["expected"]
    order = {c: k for k, c in enumerate(checkpoints)}
    if not isinstance(rows, list) or any(not isinstance(r, dict) or set(r) != {"checkpoint", "status", "findings"} or r["checkpoint"] not in order for r in rows):
        raise ValueError(f"{path} has an expectation of another shape")
    places = [order[r["checkpoint"]] for r in rows]
    if places != sorted(set(places)):
        raise ValueError(f"{path} has checkpoints out of order")
    return rows


def outcome(path: str, command: str, statuses: tuple[int, ...] = (0, 1)) -> dict:
    """The recorded outcome of one command; another command's, or an unknown status, is refused."""
    value = record(path, ("command", "status", "data"), 1)
    if value["command"] != command or type(value["status"]) is not int or value["status"] not in statuses:
        raise ValueError(f"{path} is no outcome of {command}")
    return value


def config(packaged: str, custom: str | None = None, fixed: tuple[str, ...] = ()) -> dict:
    """Packaged settings with one custom layer over them: arrays are appended (each value once, case-blind), scalars replaced, sections named in `fixed` and unknown keys refused.

    Both are TOML texts with sections of scalars and arrays. `added` lists, for each section and array, what the custom layer brought.
    """
    out, added = tomllib.loads(packaged), {}
    for section, values in (tomllib.loads(custom) if custom else {}).items():
        if section in fixed or section not in out or not isinstance(values, dict):
            raise ValueError(f"section {section} cannot be set")
        for key, value in values.items():
            old = out[section].get(key)
            if old is None or type(old) is not type(value):
                raise ValueError(f"{section}.{key} cannot be set to {value!r}")
            if isinstance(old, list):
                seen = {str(x).casefold() for x in old}
                new = [x for k, x in enumerate(value) if str(x).casefold() not in seen | {str(y).casefold() for y in value[:k]}]
                added.setdefault(section, {})[key] = new
                out[section][key] = [*old, *new]
            else:
                out[section][key] = value
    return out | {"added": added}


def accepted_problems(accepted: dict[str, list[str]], supported: tuple[str, ...], protected: tuple[str, ...]) -> list[str]:
    """Why a table of accepted extensions (by format) is refused: formats not covered exactly, bad or repeated extensions, overlaps with protected ones."""
    out = [f"missing {f}" for f in supported if f not in accepted] + [f"unexpected {f}" for f in accepted if f not in supported]
    seen: dict[str, str] = {}
    for f, extensions in accepted.items():
        if not extensions:
            out.append(f"empty {f}")
        for e in extensions:
            if not extension_ok(e):
                out.append(f"bad extension {e!r}")
            elif e in seen:
                out.append(f"{e} is accepted for {seen[e]} and {f}")
            elif e in protected:
                out.append(f"{e} is protected")
            seen.setdefault(e, f)
    return out


def extension_ok(value: str) -> bool:
    """A lower-case extension with its dot: letters, digits, and single inner hyphens or underscores."""
    parts = value[1:].replace("_", "-").split("-")
    return value.startswith(".") and all(p.isascii() and p.isalnum() and p == p.lower() for p in parts)


def journal(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Journal files (JSON lines) as events with file, line (from 1) and problem: syntax, version or null. A file is read by one task, whose lines are numbered in it; rotate long journals."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "text"))
    parsed = lines.select("file", (F.col("at") + 1).alias("line"), "text", F.from_json("text", EVENT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    problem = F.when(F.col("e").isNull() | F.col("e._bad").isNotNull() | (F.trim("text") == ""), "syntax").when(~F.col("e.schema_version").eqNullSafe(F.lit(version)), "version")
    return parsed.select("file", "line", "e.*", problem.alias("problem")).drop("_bad")
