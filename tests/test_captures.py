"""Captures and raw streams as rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from trailmark.sources import captures


def write(at, name, units, data, config="0142"):
    (at / f"{name}.h264").write_bytes(data)
    (at / f"{name}.units.jsonl").write_text("".join(json.dumps(u) + "\n\n" for u in units))
    (at / f"{name}.info.json").write_text(json.dumps({"codec": "h264", "width": 64, "height": 32, "decoder_config_hex": config}, indent=2))


def test_captures(spark, tmp_path):
    unit = lambda o, n, t: {"offset": o, "len": n, "received_us": t, "ts_90k": t // 10, "key": o == 2}
    write(tmp_path, "a", [unit(2, 3, 5_000), unit(5, 1, 7_500)], b"..abcd")
    write(tmp_path, "b", [unit(0, 0, 90)], b"")
    write(tmp_path, "none", [], b"xyz")
    rows = captures.capture_units(spark, f"file://{tmp_path}").orderBy("base", "place").collect()
    assert [(r["base"].rsplit("/", 1)[1], r["place"], r["received_us"], r["key"], bytes(r["bytes"]), r["width"], bytes(r["config"])) for r in rows] == [("a", 0, 5_000, True, b"abc", 64, b"\x01B"), ("a", 1, 7_500, False, b"d", 64, b"\x01B"), ("b", 0, 90, False, b"", 64, b"\x01B")]
    assert [r["received_us"] for r in captures.capture_units(spark, f"file://{tmp_path}", 1_000).orderBy("base", "place").collect()] == [1_000, 3_500, 1_000]
    write(tmp_path, "b", [unit(1, 1, 0)], b"x")
    with pytest.raises(Exception, match="unit outside of"):
        captures.capture_units(spark, f"file://{tmp_path}").collect()


def plain_places(data):
    starts, i = [], 0
    while i + 3 <= len(data):
        if data[i : i + 3] == b"\0\0\1":
            starts.append(i + 3)
            i += 3
        else:
            i += 1
    out = []
    for k, start in enumerate(starts):
        end = len(data)
        if k + 1 < len(starts):
            end = starts[k + 1] - 3
            while end > start and data[end - 1] == 0:
                end -= 1
        out.append((start, end - start, data[start] & 31 if end > start else -1))
    return out


def test_units_of_raw_streams(spark):
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice([0, 0, 0, 1, 1, 5, 0x67]) for _ in range(rng.randint(0, 60)))
        assert captures._places(data) == plain_places(data)
    code = b"\0\0\0\1"
    stream = b"junk" + code + b"\x67sps" + code + b"\x68pps" + b"\0\0\1" + b"\x65idr\0" + code + b"\x06sei" + code + b"\x41one" + b"\0\0\1" + b"\x41two\0"
    rows = captures.raw_units(spark.createDataFrame([("p", stream)], "path string, content binary"), 4, 100).orderBy("place").collect()
    assert [(r["received_us"], r["ts_90k"], r["key"], bytes(r["bytes"])) for r in rows] == [(100, 0, True, b"\x65idr"), (250_100, 22_500, False, b"\x41one"), (500_100, 45_000, False, b"\x41two\0")]
    with pytest.raises(Exception, match="no parameter sets in p"):
        captures.raw_units(spark.createDataFrame([("p", code + b"\x65x")], "path string, content binary")).collect()
    urls = spark.createDataFrame([("file:///a?fps=25",), ("file:///a",), ("file:///a?x=1&fps=0",)], "u string")
    assert [r[0] for r in urls.select(captures.rate_of(F.col("u"))).collect()] == [25, 10, 1]
