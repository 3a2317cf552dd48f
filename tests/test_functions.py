"""Scalar functions against literal values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from amperflow.functions import frames, redact, text, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def num(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize("f,x,want", [
    (units.volts, 3_910_000, 3.91), (units.volts, 3910, 3.91), (units.volts, 3.91, 3.91), (units.volts, -3910, -3.91), (units.amperes, -420_000, -0.42), (units.amperes, 420, 0.42), (units.amperes, 42, 42.0),
    (units.celsius, 312, 31.2), (units.celsius, 95, 95.0), (units.clamped_percent, 120, 100.0), (units.clamped_percent, -3, 0.0), (units.known_number, 2147483648, None), (units.known_number, -2147483648, None), (units.known_number, 5, 5.0),
])
def test_units(spark, f, x, want):
    assert one(spark, f(num(x))) == want and one(spark, f(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("s,want", [("3.5", 3.5), (" -1e3 ", -1000.0), (".5", 0.5), ("5.", 5.0), ("3d", None), ("3.2f", None), ("nan", None), ("Infinity", None), ("", None), ("1_000", None), ("1e999", None), (None, None)])
def test_strict_numbers(spark, s, want):
    assert one(spark, units.strict_double(F.lit(s).cast("string"))) == want


def test_soc_and_sign(spark):
    assert one(spark, units.state_of_charge(num(52913), num(62903))) == pytest.approx(100 * 52913 / 62903)
    assert one(spark, units.state_of_charge(num(1), num(0))) is None and one(spark, units.state_of_charge(num(9), num(8))) == 100
    assert one(spark, units.signed_by_status(num(-0.25), F.lit("Charging "))) == 0.25 and one(spark, units.signed_by_status(num(0.25), F.lit("discharging"))) == -0.25
    assert one(spark, units.signed_by_status(num(-0.25), F.lit("Full"))) == -0.25
    assert one(spark, units.level_percent(num(3), num(6))) == 50 and one(spark, units.level_percent(num(42), num(0))) == 42
    assert [one(spark, units.backoff(F.lit(k))) for k in (1, 2, 5, 6)] == [1, 2, 16, 30]
    assert one(spark, units.capacity_relative(F.lit(0x40000001))) is True and one(spark, units.capacity_relative(F.lit(1))) is None


@pytest.mark.parametrize("raw,want", [("pack/1", "pack-1"), ("a  b", "a-b"), ("a__b", "a-b"), ("", "unknown"), ("...", "unknown"), ("_x_", "x"), ('a<>:"|?*b', "a-b"), ("x" * 70, "x" * 60), ("a\tb\nc", "a-b-c"), ("é1", "é1")])
def test_cell_names(spark, raw, want):
    assert one(spark, text.cell_name(F.lit(raw))) == want


def test_names_and_files(spark):
    assert one(spark, text.dataset_filename(F.lit("LOCAL"), F.lit("c"), F.lit("2024-01-02").cast("date"), F.lit(7))) == "LOCAL__c__20240102_007.bdf.csv"
    for bad in (("", "c", 1), ("a__b", "c", 1), ("a", "c", 1000)):
        with pytest.raises(Exception, match="file name"):
            one(spark, text.dataset_filename(F.lit(bad[0]), F.lit(bad[1]), F.lit("2024-01-02").cast("date"), F.lit(bad[2])))
    assert one(spark, text.file_kind(F.lit("A.TXT"))) == "txt" and one(spark, text.file_kind(F.lit("a.csv"))) == "unknown"
    assert one(spark, text.chemistry(F.lit(1852787020))) == "LIon" and one(spark, text.chemistry(F.lit(1))) is None
    told = [(b"LiP\x00", "bytes", "LiP"), (b"\xffLI\x80ON ", "bytes", "LION"), (b"L", "bytes", None), (b"", "bytes", None), (b"Li-P", "bytes", None), (None, "bytes", None), ([76, 105, 80 + 256, 0], "numbers", "LiP"), ([], "numbers", None), ([76, None], "numbers", None), ("  NiMH ", "text", "NiMH"), (" ", "text", None), (0x4C69F050, "number", "PiL"), (0x50694C00, "number", "LiP"), (-1, "number", None)]
    types = {"bytes": "binary", "numbers": "array<int>", "text": "string", "number": "long"}
    for value, kind, want in told:
        found = spark.createDataFrame([(value,)], f"v {types[kind]}").select(text.chemistry(F.col("v"), kind)).first()[0]
        assert found == want, (value, kind, found)
    assert one(spark, text.content_hash(F.lit(""))) is None
    assert one(spark, text.instant(F.lit("1970-01-01T00:00:00Z"))) is None and str(one(spark, text.instant(F.lit("2024-05-01T10:00:00.5+02:00")).cast("string"))) == "2024-05-01 08:00:00.5"


def test_captures(spark):
    dump = "Battery Service:\n  AC powered: false\n  USB powered: true\n  status: 2\n  Max charging current: 500000\n  status: 3\n"
    m = one(spark, text.key_values(F.lit(dump)))
    assert m["status"] == "3" and m["max_charging_current"] == "500000" and one(spark, text.plugged(text.key_values(F.lit(dump)))) == "USB"
    rows = one(spark, text.device_table(F.lit("List of devices attached\n* daemon started\nA1 device product:x model:y:z\n\nB2 offline\n")))
    assert [(r.serial, r.state, r.qualifiers) for r in rows] == [("A1", "device", {"product": "x", "model": "y:z"}), ("B2", "offline", {})]
    found = one(spark, text.listeners(F.lit("adb-1 _adb-tls-connect._tcp 10.0.0.2:5555\nadb-2 _adb-tls-pairing._tcp 10.0.0.2:1\nadb-3 _adb._tcp nohost\n")))
    assert [(r.instance, r.address) for r in found] == [("adb-1", "10.0.0.2:5555")]
    assert sorted(one(spark, text.name_set(F.lit(" a b\n a")))) == ["a", "b"]
    assert one(spark, text.first_text(F.lit(" "), F.lit(None).cast("string"), F.lit(" x "))) == "x"
    assert one(spark, text.leading_cells(F.array(num(3.7), num(3.8), num(0), num(3.9)))) == [3.7, 3.8]


def test_frames(spark):
    fields = dict(slot=2, battery_type_code=0, mode_code=3, program_count=1, status_code=2, elapsed_s=3600, voltage_mv=3700, current_ma=1500, capacity_mah=1234, temperature=27, resistance_mohm=50, led_bits=4)
    row = F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))
    for length in (20, 64):
        frame = bytes(one(spark, frames.encode_progress(row, length)))
        assert len(frame) == length and sum(frame[:-1]) & 255 == frame[-1]
        r = one(spark, frames.progress(F.lit(frame)))
        assert all(r[k] == v for k, v in fields.items()) and (r.mode, r.battery_type, r.status, r.led) == ("Discharge", "LiIon", "Discharging", "red")
    short = bytes(one(spark, frames.encode_progress(row, 20)))
    why = [one(spark, frames.reject_reason(F.lit(f))) for f in (short, short[:19], b"\x0e" + short[1:], short[:1] + b"\x5a" + short[2:], short[:-1] + bytes([short[-1] ^ 1]))]
    assert why == [None, "length", "header", "opcode", "checksum"]
    for mohm in (0, 1, 0xFFFF):
        assert one(spark, frames.progress(frames.encode_progress(F.struct(*(F.lit(mohm if k == "resistance_mohm" else v).alias(k) for k, v in fields.items())), 20))).resistance_mohm is None
    assert one(spark, frames.mode_name(F.lit(3), F.lit(2))) == "Break-in" and one(spark, frames.mode_name(F.lit(42), F.lit(1))) == "Mode1"
    found, rest = frames.reassemble(b"\x00\x0f\x01" + short + short[:5])
    assert found == [short] and rest == short[:5]
    for command in (0x05, 0xFE, 0x11):
        with pytest.raises(frames.ReadOnlyError):
            frames.request(command)
    assert len(frames.request(0x55, 1)) == 20 and len(frames.request(0x5A, usb=True)) == 64


def test_redaction(spark):
    assert one(spark, redact.mask_userinfo(F.lit("see http://u:p@h/x and ftp://k@h"))) == "see http://***@h/x and ftp://***@h"
    assert one(spark, redact.passwords(F.lit("http://u:p1@h ftp://v:p2@h http://w@h"))) == ["p1", "p2"]
    assert one(spark, redact.redact_text(F.lit("abc abcd"), ["abc", "abcd"])) == "*** ***"
    for name, want in {"accessToken": True, "path": False, "PAT": True, "spinner": False, "db_password2": True, "asphalt": False, "author": False}.items():
        assert one(spark, redact.is_secret_name(F.lit(name))) is want and redact.secret_name(name) is want
    assert one(spark, redact.bare_address(F.lit("HTTP://u:p@Host.COM:80/a/b?q=1#f"))) == "http://host.com:80/a/b"
    assert redact.redact_metadata({"a": [{"token": "x"}, "http://u:p@h"], "n": 1}) == {"a": [{"token": "***"}, "http://***@h"], "n": 1}
    with pytest.raises(ValueError, match="line ends"):
        redact.header_value("token", "a\r\nb")
    row = spark.createDataFrame([(float("nan"), 1.5, None, b"\x00\x01")], "a double, b double, c string, d binary")
    assert row.select(redact.json_row(dict(row.dtypes))).first()[0] == '{"a":null,"b":1.5,"c":null,"d":"AAE="}'


def test_metadata_is_masked_as_a_walk_over_the_parsed_text_masks_it(spark):
    rng = random.Random(5)
    names = ["a", "token", "apiKey", "user", "spinner", 'x"y', "pass word", "auth", "päss"]
    texts = ["s3cr3t", "plain", "http://u:p@h/x", 'a"b', "back\\slash", "tab\t", 's3cr3t " x', "", "[{", "}]:,", "\U0001f600", " "]

    def value(depth):
        kind = rng.random() if depth else 1
        if kind < 0.3:
            return {rng.choice(names): value(depth - 1) for _ in range(rng.randrange(4))}
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind < 0.5 else rng.choice([None, True, 1, 2.5, *texts])

    rows = [(k, json.dumps(value(6), ensure_ascii=k % 2 == 0, indent=2 if k % 3 == 0 else None)) for k in range(400)]
    rows.append((400, json.dumps([{"password": "x", "n": k, "s": "s3cr3t"} for k in range(2000)])))  # many slices
    rows.append((401, "[" * 20_000 + "]" * 20_000))
    found = dict(spark.createDataFrame(rows, "k int, t string").select("k", redact.redact_json(F.col("t"), ["s3cr3t"])).collect())
    walk = redact.Scrubber(["s3cr3t"])
    assert all(json.loads(found[k]) == walk(json.loads(t)) for k, t in rows[:-1])
    assert found[401] == rows[-1][1]


def test_metadata_that_is_no_json_shows_no_secret_either(spark):
    told = {
        None: None, "": "", " ": " ", "user password: s3cr3t": "user password: ***", '{"password": "abc': '{"password": "***"', '{"password": "abc:': '{"password": "***"', '{"password": [1,{"x":"abc"': '{"password": "***"', '{"a":1,"a":"s3cr3t"}': '{"a":1,"a":"***"}',
        '{"token" : null , "b":2}': '{"token" : "***" , "b":2}', '{"pass\\u0077ord":1}': '{"pass\\u0077ord":"***"}', '{"a":"\\u00733cr3t"}': '{"a":"***"}', '{"pin":1,"pin":2}': '{"pin":"***","pin":"***"}', "x http://u:p@h": "x http://***@h", '"': '"',
    }
    found = spark.createDataFrame([(t,) for t in told], "t string").select("t", redact.redact_json(F.col("t"), ["s3cr3t"])).collect()
    assert dict(map(tuple, found)) == told
