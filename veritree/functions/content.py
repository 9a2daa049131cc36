"""What a file's first bytes and state say: content types, formats, EXIF dates, names of scopes and bindings."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veritree.functions.text import canonical_json

# Signatures of content types - offset and bytes, in hexadecimal - as their formats define them.
SIGNATURES: tuple[tuple[str, int, str], ...] = (
    ("image/jpeg", 0, "FFD8FF"),
    ("image/png", 0, "89504E470D0A1A0A"),
    ("image/gif", 0, "47494638"),
    ("image/tiff", 0, "49492A00"),
    ("image/tiff", 0, "4D4D002A"),
    ("image/webp", 8, "57454250"),
    ("image/heic", 4, "6674797068656963"),
    ("image/bmp", 0, "424D"),
    ("video/quicktime", 4, "6674797071742020"),
    ("video/mp4", 4, "66747970"),
    ("video/x-matroska", 0, "1A45DFA3"),
    ("video/x-msvideo", 8, "41564920"),
    ("video/mpeg", 0, "000001BA"),
    ("application/ogg", 0, "4F676753"),
    ("audio/mpeg", 0, "494433"),
    ("audio/x-wav", 8, "57415645"),
    ("application/pdf", 0, "25504446"),
    ("application/zip", 0, "504B0304"),
)
#: The format that a content type's decoder names.
FORMATS = {"image/jpeg": "JPEG", "image/png": "PNG", "image/gif": "GIF", "image/tiff": "TIFF", "image/webp": "WEBP", "image/heic": "HEIF", "image/bmp": "BMP"}


def content_type(head: Column) -> Column:
    """The content type that a file's first bytes tell (64 are enough); text/plain without a control byte among them, application/octet-stream otherwise, null without bytes."""
    low = F.hex(head)
    plain = ~low.rlike("^(?:..)*?(?:0[0-8BCEF]|1[0-9A-F]|7F)")
    out = F.when(plain, "text/plain").otherwise("application/octet-stream")
    for mime, at, signature in reversed(SIGNATURES):
        out = F.when(F.substring(low, 2 * at + 1, len(signature)) == signature, mime).otherwise(out)
    return F.when(F.octet_length(head) > 0, out)


def detected_type(head: Column, ext: Column, by_extension: dict[str, str]) -> Column:
    """mime and from_content: by content where it says more than bytes or text, else guessed from the extension, else what content says, else unknown."""
    found = content_type(head)
    guess = F.element_at(F.create_map(*[F.lit(x) for pair in by_extension.items() for x in pair]), ext)
    says = found.isNotNull() & ~found.isin("text/plain", "application/octet-stream")
    mime = F.when(says, found).otherwise(F.coalesce(guess, found, F.lit("unknown")))
    return F.struct(mime.alias("mime"), (says | (guess.isNull() & found.isNotNull())).alias("from_content"))


def picture_format(head: Column) -> Column:
    """The format of a picture by its signature; a full decode is a provider's."""
    out = F.lit(None).cast("string")
    for mime, name in FORMATS.items():
        out = F.when(content_type(head) == mime, name).otherwise(out)
    return out


def sure_family(family: Column, score: Column, videos: Column) -> Column:
    """The container family that a probe names, if it found a video stream and scores 50 to 100."""
    return F.when(score.between(50, 100) & (videos > 0), family)


def _exif_date(data: bytes | None) -> str | None:
    """DateTimeOriginal, else DateTime, of a JPEG's or TIFF's EXIF block, as in a file name; null without a date."""
    if not data:
        return None
    at = data.find(b"Exif\0\0")
    block = data[at + 6 :] if at >= 0 else data
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None:
        return None

    def entries(offset: int) -> dict[int, tuple[int, int, int]]:
        (n,) = struct.unpack_from(order + "H", block, offset)
        rows = (struct.unpack_from(order + "HHII", block, offset + 2 + 12 * k) for k in range(n))
        return {tag: (kind, count, value) for tag, kind, count, value in rows}

    def text(found: tuple[int, int, int] | None) -> str | None:
        if not found or found[0] != 2 or found[1] < 20:
            return None
        raw = block[found[2] : found[2] + 19].decode("ascii", "replace")
        stamp = pd.to_datetime(raw, format="%Y:%m:%d %H:%M:%S", errors="coerce")
        return None if pd.isna(stamp) else stamp.strftime("%Y-%m-%d_%H-%M-%S")

    try:
        (first,) = struct.unpack_from(order + "I", block, 4)
        main = entries(first)
        more = entries(main[34665][2]) if 34665 in main else {}
        return text(more.get(36867)) or text(main.get(36867)) or text(main.get(306))
    except struct.error:
        return None


def exif_timestamp(data: Column) -> Column:
    """The date a picture was taken, from its own bytes (Arrow batches; the first 64 KiB hold the block)."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(_exif_date)

    return run(F.substring(data, 1, 65536))


def state_name(*columns: str) -> Column:
    """A file's state as one string: numbers between colons."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def destination_binding(path: Column) -> Column:
    """SHA-256 of a destination path, which a record can bind without naming it."""
    return F.sha2(path.cast("binary"), 256)


def runtime_name(fields: dict[str, object]) -> str:
    """A runtime as canonical JSON: what a store keys evidence by; equal runtimes are equal strings."""
    return canonical_json(fields).decode().rstrip("\n")


def absolute_path_ok(path: Column) -> Column:
    """Absolute and in normal form: no empty, `.` or `..` part, no NUL."""
    return F.coalesce(F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\x00")) & ((path == "/") | ~F.exists(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), lambda p: p.isin("", ".", ".."))), F.lit(False))
