"""The generated-code parser against the CSV library, line by line."""

from __future__ import annotations

import random

import pytest

from gridpulse.schemas import RAW
from gridpulse.sources.raw import _OPTIONS, parse_fields

FIELDS = ["1", "12", "-3", "+4", "", "1.5", "-.5", "5.", ".", "1e3", "1E-2", "1e", "e5", "--1", "1-", "9223372036854775808", "2147483648", "007",
          "NULL", "null", "NaN", "nan", "Inf", "-Inf", "Infinity", "inf", " 1", "1 ", "1.5d", "1.5f", "0x10", '"7"', '"7', '7"', '""', "a", "é", "1,5", "1_0",
          "1383260400000", "1.7976931348623157e309", "4.9e-325", "\\", "\\N", "#", "'1'", " 1", "true", "1L", "½"]


def shown(df):
    return sorted(str(tuple(r)) for r in df.collect())


def by_library(spark, path):
    return spark.read.options(**_OPTIONS).schema(RAW).csv(f"{path}/*.txt")


def check(spark, tmp_path, lines, end="\n", last=True):
    (tmp_path / "a.txt").write_bytes(end.join(lines).encode() + (end.encode() if last else b""))
    assert shown(parse_fields(spark.read.text(f"{tmp_path}/*.txt"), "value")) == shown(by_library(spark, tmp_path))


@pytest.mark.parametrize("at", range(len(RAW.fields)))
def test_every_field_in_every_place(spark, tmp_path, at):
    lines = []
    for field in FIELDS:
        row = ["1", "1383260400000", "39", "0.1", "0.2", "0.3", "0.4", "0.5"]
        row[at] = field
        lines.append("\t".join(row))
    check(spark, tmp_path, lines)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_short_long_and_blank_lines(spark, tmp_path, end):
    full = "1\t1383260400000\t39\t0.1\t0.2\t0.3\t0.4\t0.5"
    lines = [full, "", " ", "\t", "\t\t\t\t\t\t\t", "\t \t", "\x01", "1", "1\t2", full + "\t", full + "\t9\t8", full + "\tx", "\t" + full, "#" + full, full]
    check(spark, tmp_path, lines, end)
    check(spark, tmp_path, lines, end, last=False)


def test_random_lines(spark, tmp_path):
    rng = random.Random(11)
    lines = ["\t".join(rng.choice(FIELDS) for _ in range(rng.choice([1, 3, 7, 8, 8, 8, 9, 12]))) for _ in range(4000)]
    lines += ["".join(rng.choice("0123456789+-.eE\t") for _ in range(rng.randrange(0, 60))) for _ in range(4000)]
    check(spark, tmp_path, lines)


def test_plain_lines_stay_in_generated_code(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\t1383260400000\t39\t0.1\t0.2\t0.3\t0.4\t0.5\n")
    plan = parse_fields(spark.read.text(str(tmp_path)), "value")._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" in plan and "Python" not in plan and "Exchange" not in plan
