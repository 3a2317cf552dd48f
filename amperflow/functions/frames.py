"""Binary frames of a four-bay charger: checks, decoding, encoding. Only reading is ever asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bound
from .text import lookup

HEADER, PROGRESS, SETTINGS, MACHINE = 0x0F, 0x55, 0x5F, 0x5A
READ_ONLY = frozenset({PROGRESS, SETTINGS, MACHINE})
BLE_LENGTH, USB_LENGTH = 20, 64
#: Names of codes on the wire. Fixed values.
BATTERY_TYPES = {0: "LiIon", 1: "LiFe", 2: "LiIo4.35", 3: "NiMH", 4: "NiCd", 5: "NiZn", 6: "Eneloop", 7: "RAM", 8: "BatLTO"}
LITHIUM, ZINC, NICKEL = (0, 1, 2, 8), (5, 7), (3, 4, 6)
LITHIUM_MODES = {0: "Charge", 1: "Refresh", 2: "Storage", 3: "Discharge", 4: "Cycle"}
ZINC_MODES = {0: "Charge", 1: "Refresh", 2: "Discharge", 3: "Cycle"}
NICKEL_MODES = {0: "Charge", 1: "Refresh", 2: "Break-in", 3: "Discharge", 4: "Cycle"}
STATUSES = {
    0: "Standby", 1: "Charging", 2: "Discharging", 3: "Pause", 4: "Completed", 128: "Input low voltage", 129: "Input high voltage", 130: "ADC MCP3424-1 error", 131: "ADC MCP3424-2 error",
    132: "Connection break", 133: "Check voltage", 134: "Capacity limit reached", 135: "Time limit reached", 136: "SysTemp too hot", 137: "Battery too hot", 138: "Short circuit", 139: "Wrong polarity", 140: "Bad battery (high IR)",
}
NO_RESISTANCE = (0, 1, 0xFFFF)


class ReadOnlyError(ValueError):
    """A frame was asked for that could change the device."""


def request(command: int, slot: int = 0, usb: bool = False) -> bytes:
    """A read request; refuses every opcode that is not on the list of reads."""
    if command not in READ_ONLY:
        raise ReadOnlyError(f"opcode 0x{command:02x} is not a read")
    if usb:
        body = bytes([HEADER, 0x04, command, 0x00, slot & 0xFF])
        frame = body + bytes([sum(body[2:]) & 0xFF, 0xFF, 0xFF])
        return frame + bytes(USB_LENGTH - len(frame))
    body = bytes([HEADER, command, slot & 0xFF]) + bytes(BLE_LENGTH - 4)
    return body + bytes([sum(body) & 0xFF])


def byte_values(data: Column) -> Column:
    """The bytes of a binary value as an array of numbers."""
    pair = lambda h: F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.length(data) > 0, bound(F.hex(data), pair)).otherwise(F.array().cast("array<int>"))


def number(b: Column, at: int, n: int = 1) -> Column:
    """Big-endian number of ``n`` bytes at a 0-based place of an array of bytes."""
    out = F.get(b, at)
    for k in range(1, n):
        out = out * 256 + F.get(b, at + k)
    return out


def unsigned(frame: Column, at: int, n: int = 1) -> Column:
    """Big-endian number of ``n`` bytes at a 0-based place."""
    return F.conv(F.hex(F.substring(frame, at + 1, n)), 16, 10).cast("int")


def low_byte(b: Column) -> Column:
    return F.aggregate(b, F.lit(0), lambda acc, x: acc + x).bitwiseAND(F.lit(255))


def checksum(data: Column) -> Column:
    """Low byte of the sum of all bytes."""
    return bound(byte_values(data), low_byte)


def _sound(b: Column) -> Column:
    return (F.size(b) >= 2) & (low_byte(F.slice(b, 1, F.size(b) - 1)) == F.element_at(b, -1))


def checksum_valid(frame: Column) -> Column:
    return F.when(F.length(frame) >= 2, bound(byte_values(frame), _sound)).otherwise(F.length(frame) >= 2)


def _reason(b: Column) -> Column:
    return F.when(F.size(b) < BLE_LENGTH, "length").when(F.get(b, 0) != HEADER, "header").when(F.get(b, 1) != PROGRESS, "opcode").when(~_sound(b), "checksum")


def reject_reason(frame: Column) -> Column:
    """Why a progress frame cannot be decoded; null where it can."""
    return decoded(frame)["reject_reason"]


def mode_name(battery_type: Column, mode: Column) -> Column:
    named = lambda names: F.coalesce(*(F.when(mode == k, v) for k, v in names.items()), F.concat(F.lit("Mode"), mode.cast("string")))
    return F.when(battery_type.isin(*LITHIUM), named(LITHIUM_MODES)).when(battery_type.isin(*ZINC), named(ZINC_MODES)).when(battery_type.isin(*NICKEL), named(NICKEL_MODES)).otherwise(F.concat(F.lit("Mode"), mode.cast("string")))


def led_colour(bits: Column, slot: Column) -> Column:
    bit = lambda k: F.floor(bits / F.pow(F.lit(2), k)).cast("int").bitwiseAND(F.lit(1)) == 1
    return F.when(bit(slot), "red").when(bit(slot + 4), "green").otherwise("none")


def _fields(b: Column) -> Column:
    slot, battery, mode, status, led = (number(b, k) for k in (2, 3, 4, 6, 18))
    millivolt, resistance = number(b, 9, 2), number(b, 16, 2)
    return F.struct(
        slot.alias("slot"), battery.alias("battery_type_code"), lookup(battery, BATTERY_TYPES).alias("battery_type"), mode.alias("mode_code"), mode_name(battery, mode).alias("mode"), number(b, 5).alias("program_count"),
        status.alias("status_code"), lookup(status, STATUSES).alias("status"), number(b, 7, 2).alias("elapsed_s"), millivolt.alias("voltage_mv"), number(b, 11, 2).alias("current_ma"), number(b, 13, 2).alias("capacity_mah"),
        number(b, 15).alias("temperature"), F.when(~resistance.isin(*NO_RESISTANCE), resistance).alias("resistance_mohm"), led.alias("led_bits"), led_colour(led, slot).alias("led"),
        (millivolt > 0).alias("occupied"), (status == 1).alias("is_charging"), (status == 2).alias("is_discharging"),
    )


def decoded(frame: Column) -> Column:
    """struct(reject_reason, reading) of a progress frame: one of them is null. The frame's bytes are read once."""
    both = lambda b: bound(_reason(b), lambda why: F.struct(why.alias("reject_reason"), F.when(why.isNull(), _fields(b)).alias("reading")))
    return bound(F.coalesce(byte_values(frame), F.array().cast("array<int>")), both)


def progress(frame: Column) -> Column:
    """The fields of a progress frame as a struct, null where the frame is rejected."""
    return decoded(frame)["reading"]


def encode_progress(r: Column, length: int = USB_LENGTH) -> Column:
    """The frame of a struct of progress fields: negative numbers as 0, 16 bits each, checksum last."""
    whole = lambda c, most: F.greatest(F.coalesce(c, F.lit(0)).cast("long"), F.lit(0).cast("long")).bitwiseAND(F.lit(most))
    hexed = lambda name, digits: F.lpad(F.hex(whole(r[name], 16**digits - 1)), digits, "0")
    layout = (("slot", 2), ("battery_type_code", 2), ("mode_code", 2), ("program_count", 2), ("status_code", 2), ("elapsed_s", 4), ("voltage_mv", 4), ("current_ma", 4), ("capacity_mah", 4), ("temperature", 2), ("resistance_mohm", 4), ("led_bits", 2))
    body = F.unhex(F.concat(F.lit(f"{HEADER:02X}{PROGRESS:02X}"), *(hexed(*x) for x in layout), F.lit("00" * (length - BLE_LENGTH))))
    return bound(body, lambda b: F.concat(b, F.unhex(F.lpad(F.hex(checksum(b).cast("long")), 2, "0"))))


def machine(frame: Column) -> Column:
    """struct(serial, raw_hex) of an identity frame of at least 31 bytes, else null."""
    fits = (F.length(frame) >= 31) & (unsigned(frame, 0) == HEADER)
    return F.when(fits, F.struct(F.hex(F.substring(frame, 17, 15)).alias("serial"), F.lower(F.hex(frame)).alias("raw_hex")))


def reassemble(stream: bytes, length: int = BLE_LENGTH) -> tuple[list[bytes], bytes]:
    """(valid frames, bytes left over) of a byte stream: it falls back to the next header after what is no frame."""
    frames, at = [], 0
    while True:
        at = stream.find(bytes([HEADER]), at)
        if at < 0:
            return frames, b""
        if len(stream) - at < length:
            return frames, stream[at:]
        frame = stream[at : at + length]
        if sum(frame[:-1]) & 0xFF == frame[-1]:
            frames.append(frame)
            at += length
        else:
            at += 1
