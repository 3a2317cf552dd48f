"""Names, keys, hashes and text captures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bound

#: Names of Android's battery codes. Fixed values.
BATTERY_STATUS = {1: "Unknown", 2: "Charging", 3: "Discharging", 4: "Not charging", 5: "Full"}
BATTERY_HEALTH = {1: "Unknown", 2: "Good", 3: "Overheat", 4: "Dead", 5: "Over voltage", 6: "Unspecified failure", 7: "Cold"}
#: Characters that file names cannot hold. Fixed value.
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'


def clean(x: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def first_text(*values: Column) -> Column:
    return F.coalesce(*(clean(v) for v in values))


def lookup(code: Column, names: dict[int, str]) -> Column:
    """The name of a code, the code's own text where it has none, null for null."""
    out = None
    for k, name in names.items():
        out = F.when(code == k, name) if out is None else out.when(code == k, name)
    return out.otherwise(code.cast("string"))


def battery_status(code: Column) -> Column:
    return lookup(code, BATTERY_STATUS)


def battery_health(code: Column) -> Column:
    return lookup(code, BATTERY_HEALTH)


def snake_key(x: Column) -> Column:
    """Lower case, everything but letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def key_values(text: Column) -> Column:
    """Lines ``key: value`` as a map with snake-case keys; of repeated keys the last counts."""
    entry = lambda x: F.struct(snake_key(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.contains(":"))
    pairs = F.reverse(F.filter(F.transform(lines, entry), lambda p: p.k != ""))  # the last first

    def first_of_each(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p.k)
        named = lambda keys: bound(F.array_distinct(keys), lambda once: F.map_from_arrays(once, F.transform(once, lambda k: F.get(pairs, (F.array_position(keys, k) - 1).cast("int")).v)))
        return bound(keys, named)

    return F.when(text.isNotNull(), bound(pairs, first_of_each))


def as_boolean(x: Column) -> Column:
    return F.when(F.lower(x) == "true", True).when(F.lower(x) == "false", False)


def plugged(fields: Column) -> Column:
    """Where power comes from, from a map of ``*_powered`` flags."""
    on = lambda k: F.lower(F.try_element_at(fields, F.lit(k))) == "true"
    return F.when(on("ac_powered"), "AC").when(on("usb_powered"), "USB").when(on("wireless_powered"), "wireless").when(on("dock_powered"), "dock").otherwise("none")


def device_table(text: Column) -> Column:
    """Rows of a device listing: serial, state and a map of qualifiers split at the first colon."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("List of devices") & ~x.startswith("* ") & ~x.startswith("adb server") & (F.size(F.split(x, r"\s+")) >= 2))

    def row(line: Column) -> Column:
        parts = F.split(line, r"\s+")
        marks = F.filter(F.slice(parts, 3, F.size(parts)), lambda p: p.contains(":"))
        entries = F.transform(marks, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.regexp_replace(p, "^[^:]*:", "").alias("v")))
        return F.struct(parts[0].alias("serial"), parts[1].alias("state"), F.map_from_entries(entries).alias("qualifiers"))

    return F.transform(kept, row)


def listeners(text: Column) -> Column:
    """(instance, address) of services that can be connected to, with a numeric port."""
    rows = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.split(F.trim(x), r"\s+"))
    kept = F.filter(rows, lambda p: (F.size(p) >= 3) & F.rlike(F.element_at(p, -2), F.lit(r"^_adb(-tls-connect)?\._tcp\.?$")) & F.rlike(F.element_at(p, -1), F.lit(r"^.+:[0-9]+$")))
    return F.transform(kept, lambda p: F.struct(p[0].alias("instance"), F.element_at(p, -1).alias("address")))


def name_set(text: Column) -> Column:
    """Distinct words of a listing."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def cell_name(raw: Column) -> Column:
    """A file-safe name of at most 60 characters; ``unknown`` where nothing is left."""
    x = F.regexp_replace(raw, ILLEGAL, "-")
    for pattern in (r"\s+", "_{2,}", "-{2,}"):
        x = F.regexp_replace(x, pattern, "-")
    x = F.regexp_replace(F.substring(x, 1, 60), r"^[-._ ]+|[-._ ]+$", "")
    return F.when(x == "", "unknown").otherwise(x)


def dataset_filename(institution: Column, cell: Column, day: Column, seq: Column) -> Column:
    """``Inst__Cell__YYYYMMDD_XXX.bdf.csv``; raises where a part is empty, holds ``__`` or the number is out of range."""
    ok = (institution != "") & (cell != "") & ~institution.contains("__") & ~cell.contains("__") & seq.between(0, 999)
    name = F.format_string("%s__%s__%s_%03d.bdf.csv", institution, cell, F.date_format(day, "yyyyMMdd"), seq.cast("int"))
    return F.when(F.coalesce(ok, F.lit(False)), name).otherwise(F.raise_error(F.lit("a dataset file name needs non-empty parts without '__' and a number from 0 to 999")))


def content_hash(content: Column) -> Column:
    """SHA-256 in hex; null for no bytes at all."""
    return F.when(F.octet_length(content) > 0, F.sha2(content, 256))


def file_kind(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".txt"), "txt").when(n.endswith(".dat"), "dat").otherwise("unknown")


def instant(text: Column) -> Column:
    """UTC instant of an ISO text (no zone means UTC), null before the year 2000."""
    t = F.try_to_timestamp(F.regexp_replace(F.trim(text), "[zZ]$", "+00:00"))
    return F.when(F.year(t) >= 2000, t)


def stream_key(aircraft: Column, battery: Column) -> Column:
    return F.concat(aircraft, F.lit(":"), battery)


def cell_column(index: int) -> str:
    return f"cell_{index}_voltage_volt"


def leading_cells(cells: Column) -> Column:
    """The values before the first null or 0."""
    stops = F.transform(cells, lambda x, i: F.when(x.isNull() | (x == 0), i))
    stop = F.array_min(F.filter(stops, lambda i: i.isNotNull()))
    return F.slice(cells, 1, F.coalesce(stop, F.size(cells)))


def position(latitude: Column, longitude: Column) -> Column:
    """struct(lat, lon) where both are on the globe, else null."""
    return F.when(latitude.between(-90, 90) & longitude.between(-180, 180), F.struct(latitude.alias("lat"), longitude.alias("lon")))


def ascii_code(numbers: Column) -> Column:
    """The letters and digits that bytes (as numbers) spell, at least two; other bytes than ASCII are left out, blanks and zeros at the ends too."""
    spelled = F.array_join(F.transform(F.filter(numbers, lambda x: x < 128), lambda x: F.chr(x)), "")
    return bound(F.regexp_replace(spelled, r"^[ \x00]+|[ \x00]+$", ""), lambda s: F.when(s.rlike("^[A-Za-z0-9]{2,}$"), s))


def chemistry(value: Column, kind: str = "number") -> Column:
    """The code of a pack's chemistry, in any of the shapes in which packs tell it.

    ``number``: four bytes in an integer, low byte first, or reversed where that spells something;
    ``bytes``: binary; ``numbers``: an array of byte values, null where one is null; ``text``: as it is.
    """
    low = lambda x: x.cast("long").bitwiseAND(F.lit(255))
    if kind == "text":
        return clean(value)
    if kind == "numbers":
        return F.when(~F.exists(value, lambda x: x.isNull()), ascii_code(F.transform(value, low)))
    if kind == "bytes":
        pairs = F.regexp_extract_all(F.hex(value), F.lit("(..)"), F.lit(1))
        return ascii_code(F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long")))
    if kind != "number":
        raise ValueError(f"no kind of chemistry {kind!r}")
    n = value.cast("long")
    bytes_ = F.array(*(low(F.shiftright(n, 8 * k)) for k in range(4)))
    return bound(bytes_, lambda b: F.coalesce(ascii_code(b), ascii_code(F.reverse(b))))
