"""Small private records on the driver's file system: canonical JSON that is created once, replaced whole, or appended line by line.

These are side effects of a command, a few kilobytes each; tables go through `store`. Files are readable by their owner only.
"""

from __future__ import annotations

import os
import uuid

from veritree.functions.text import canonical_json


def create(path: str, value: object, outside: tuple[str, ...] = ()) -> None:
    """Writes a new file and never replaces one; a path inside one of the `outside` folders (collections) is refused."""
    real = os.path.realpath(os.path.dirname(os.path.abspath(path)))
    for root in outside:
        base = os.path.realpath(root)
        if real == base or real.startswith(base + os.sep):
            raise ValueError(f"{path} lies inside {root}")
    _write(path, canonical_json(value), os.O_EXCL)


def replace(path: str, value: object) -> None:
    """Replaces a file whole, or creates it: readers see the old or the new content, never a part."""
    part = f"{path}.{uuid.uuid4().hex}"
    try:
        _write(part, canonical_json(value), os.O_EXCL)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def append(path: str, event: dict) -> None:
    """Adds one line that is on disk when this returns."""
    _write(path, canonical_json(event), os.O_APPEND)


def _write(path: str, data: bytes, flags: int) -> None:
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | flags, 0o600)
    try:
        while data:
            data = data[os.write(fd, data) :]
        os.fsync(fd)
    finally:
        os.close(fd)
