"""Names: timestamps, slugs, descriptors, digests."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date patterns of file names, in the order in which they are tried; the groups that hold the digits of the date,
# and the group of milliseconds (0 for none).
STAMPS: tuple[tuple[str, tuple[int, ...], int], ...] = (
    (r"(?i)(?:IMG|VID)_([0-9]{8})_([0-9]{6})(?:_([0-9]{3}))?(?:_[0-9]+)?", (1, 2), 3),
    (r"(?i)(?:photo|video)_([0-9]{4}-[0-9]{2}-[0-9]{2})_([0-9]{2}-[0-9]{2}-[0-9]{2})", (1, 2), 0),
    (r"([0-9]{4}-[0-9]{2}-[0-9]{2})[ _]([0-9]{2})[.:-]([0-9]{2})[.:-]([0-9]{2})(?:[_-]([0-9]{3}))?", (1, 2, 3, 4), 5),
    (r"([0-9]{4})_([0-9]{2})_([0-9]{2})_([0-9]{2})_([0-9]{2})_([0-9]{2})", (1, 2, 3, 4, 5, 6), 0),
    (r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![-0-9])", (1,), 0),
)
def timestamp_from_name(name: Column) -> Column:
    """`yyyy-MM-dd_HH-mm-ss`, with `-mmm` where given, or `yyyy-MM-dd`, from a file name. The first pattern that matches decides: if its date is invalid the result is null."""
    out = F.lit(None).cast("string")
    for pattern, groups, millis in reversed(STAMPS):
        digits = F.replace(F.concat(*[F.regexp_extract(name, pattern, g) for g in groups]), F.lit("-"), F.lit(""))
        whole = len(groups) > 1
        stamp = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss" if whole else "yyyyMMdd"))
        text = F.date_format(stamp, "yyyy-MM-dd_HH-mm-ss" if whole else "yyyy-MM-dd")
        if millis:
            ms = F.regexp_extract(name, pattern, millis)
            text = F.concat(text, F.when(ms != "", F.concat(F.lit("-"), ms)).otherwise(""))
        out = F.when(name.rlike(pattern), text).otherwise(out)
    return out


@functools.cache
def _plain_forms() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of a character in ASCII, from Unicode's own tables: characters that become one, and those that become several."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0x20000)):
        if found := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode():
            if len(found) == 1:
                one[c] = found
            else:
                several[c] = found
    return "".join(one), "".join(one.values()), several


def ascii_form(text: Column) -> Column:
    """The ASCII characters of a text's compatibility decomposition; texts that are ASCII already are not touched."""
    old, new, several = _plain_forms()
    spelled = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    single = F.regexp_replace(F.translate(text, old, new), r"[\x{10000}-\x{10FFFF}]", "")
    known = F.regexp_replace(single, f"[^\\x00-\\x7F{''.join(c for c in several if ord(c) < 0x10000)}]", "")
    full = F.array_join(F.transform(F.split(known, ""), lambda c: F.coalesce(F.element_at(spelled, c), c)), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.when(known.rlike(r"[^\x00-\x7F]"), full).otherwise(known)).otherwise(text)


def slug(name: str, default: str = "collection") -> str:
    """One name as a slug, on the driver."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_") or default


def slugs(name: Column, default: str = "collection") -> Column:
    """Lower-case ASCII letters and digits with single underscores between."""
    out = F.regexp_replace(F.regexp_replace(F.lower(ascii_form(name)), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.when(name.isNotNull(), F.coalesce(F.nullif(out, F.lit("")), F.lit(default)))


def normalised(text: Column) -> Column:
    """Case-blind text with single spaces: a weak digest's input."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")))


def decimal_microseconds(text: Column, default: int | None = None) -> Column:
    """Microseconds of decimal seconds, half up; `default` for what is no number."""
    return F.coalesce((text.try_cast("decimal(38,6)") * 1_000_000).cast("long"), F.lit(default).cast("long"))


def canonical_json(value: object) -> bytes:
    """Sorted keys, no spaces, ASCII, one line; NaN is refused."""
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False) + "\n").encode()


def container_family(value: Column) -> Column:
    """A comma list as sorted distinct lower-case names."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.trim(value)), ","))), ",")


def format_bytes(size: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB")) -> Column:
    """A size in the largest of the units (and bytes) of which it has at least one, to one place (half to even). Each unit is 1024 of the one before."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", F.bround(size / float(1024**k), 1)), F.lit(" " + unit))).otherwise(out)
    return out


def rotation(text: Column) -> Column:
    """Degrees of a rotation tag, half to even and modulo 360; null unless a right angle."""
    turned = F.pmod(F.bround(text.try_cast("double")).cast("long"), F.lit(360))
    return F.when(turned.isin(0, 90, 180, 270), turned)


def format_duration(seconds: Column) -> Column:
    """The two largest units of a whole number of seconds, as `1d 2h`."""
    s = seconds.cast("long")
    two = lambda a, u, b, v: F.concat(a.cast("string"), F.lit(u + " "), b.cast("string"), F.lit(v))
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 86400, two(d, "d", h, "h")).when(s >= 3600, two(h, "h", m, "m")).when(s >= 60, two(m, "m", s % 60, "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))


#: What a telling word is made of, and what only looks like one (a hexadecimal id).
TELLING, NOT_TELLING = "^[a-z]{2,}$", "^[a-f]{8,}$"


def descriptors(stem: Column, collection: str, noise: tuple[str, ...], most: int = 6) -> Column:
    """The first telling words of file names, joined by underscores; null if there are none.

    Dates are taken out first; words are runs of ASCII letters and digits. A word loses the collection's name in front of it, written as one, and then the longest part of that name
    which leaves three characters; parts alone, noise, and words that are no plain letters tell nothing.
    """
    parts = slug(collection).split("_")
    for pattern, _, _ in STAMPS:
        stem = F.regexp_replace(stem, pattern, " ")
    found = F.regexp_extract_all(F.lower(ascii_form(stem)), F.lit("([a-z0-9]+)"), F.lit(1))
    alternatives = "|".join(sorted(set(parts), key=lambda p: (-len(p), p)))
    bare = F.transform(found, lambda w: F.regexp_replace(F.regexp_replace(w, f"^{''.join(parts)}(?=.)", ""), f"^(?:{alternatives})(?=.{{3}})", ""))
    telling = F.filter(bare, lambda w: w.rlike(TELLING) & ~w.rlike(NOT_TELLING) & ~w.isin(*parts, *noise))
    return F.nullif(F.array_join(F.slice(telling, 1, most), "_"), F.lit(""))


@functools.cache
def _decompositions() -> tuple[str, tuple[str, ...], str, str]:
    """Characters with a canonical decomposition (those with more parts first), the parts at each place, and combining marks with their classes, as characters from U+E000 on. From Unicode's own data; Hangul syllables follow a rule and are left out."""
    full = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0x80, 0x110000)) if not 0xAC00 <= ord(c) <= 0xDFFF}
    several = sorted((c for c in full if full[c] != c), key=lambda c: -len(full[c]))
    parts = tuple("".join(full[c][k] for c in several if len(full[c]) > k) for k in range(max(map(len, full.values()))))
    marks = [c for c in map(chr, range(0x300, 0x110000)) if unicodedata.combining(c)]
    return "".join(several), parts, "".join(marks), "".join(chr(0xE000 + unicodedata.combining(c)) for c in marks)


def decomposed(column: Column) -> Column:
    """A text in canonical decomposition (NFD), in built-in functions: characters are taken apart, then marks behind each base put in the order of their classes. Texts of ASCII characters are left as they are."""
    several, parts, marks, classes = _decompositions()

    def taken_apart(c: Column) -> Column:
        # where a list of parts is shorter than that of characters, translate() leaves nothing
        made = F.concat(*[F.translate(c, several, p) for p in parts])
        s = F.ascii(c) - 0xAC00
        jamo = lambda code: F.decode(F.unhex(F.concat(F.lit("E1"), F.hex(F.lit(0x80).bitwiseOR(F.shiftright(code, 6).bitwiseAND(F.lit(0x3F)))), F.hex(F.lit(0x80).bitwiseOR(code.bitwiseAND(F.lit(0x3F)))))), "UTF-8")
        whole = lambda x: F.floor(x).cast("int")
        tail = F.when(s % 28 == 0, "").otherwise(jamo(s % 28 + 0x11A7))
        hangul = F.concat(jamo(whole(s / 588) + 0x1100), jamo(whole(s % 588 / 28) + 0x1161), tail)
        return F.when((s >= 0) & (s < 11172), hangul).when(F.translate(c, several, parts[0]) != c, made).otherwise(c)

    def in_order(text: Column) -> Column:
        def sort(chars: Column) -> Column:
            # bound variables, or they would be computed again for each character
            def keyed(cls: Column) -> Column:
                run = lambda i: F.size(F.filter(F.slice(cls, F.lit(1), i + 1), lambda x: x == 0))
                rows = F.transform(chars, lambda c, i: F.struct(run(i).alias("run"), F.element_at(cls, i + 1).alias("cls"), i.alias("i"), c.alias("c")))
                return F.array_join(F.transform(F.array_sort(rows), lambda x: x["c"]), "")

            cls = F.transform(chars, lambda c: F.when(F.translate(c, marks, classes) == c, 0).otherwise(F.ascii(F.translate(c, marks, classes)) - 0xE000))
            return F.element_at(F.transform(F.array(cls), keyed), 1)

        return F.element_at(F.transform(F.array(F.split(text, "")), sort), 1)

    ready = F.array_join(F.transform(F.split(column, ""), taken_apart), "")
    sorted_ = F.element_at(F.transform(F.array(ready), lambda t: F.when(F.translate(t, marks, "") != t, in_order(t)).otherwise(t)), 1)
    return F.when(column.rlike(r"[^\x00-\x7f]"), sorted_).otherwise(column)
