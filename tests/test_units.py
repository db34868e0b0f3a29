import pytest

from recordloom.operators import units as U

TABLE = [
    ("GLU", "mg/dL", 1.0, 0.0, True), ("GLU", "mmol/L", 18.016, 0.0, False), ("GLU", "g/L", 100.0, 0.0, False), ("HT", "cm", 1.0, 0.0, True), ("HT", "m", 100.0, 0.0, False), ("HT", "in", 2.54, 0.0, False),
    ("PLT", "10^9/L", 1.0, 0.0, True), ("PLT", "/uL", 0.001, 0.0, False), ("PLT", "lakh/uL", 100.0, 0.0, False), ("TEMP", "degC", 1.0, 0.0, True), ("TEMP", "degF", 5 / 9, -160 / 9, False),
    ("HBA1C", "%", 1.0, 0.0, True), ("HBA1C", "mmol/mol", 0.0915, 2.15, False), ("POT", "mmol/L", 1.0, 0.0, True), ("POT", "mEq/L", 1.0, 0.0, False), ("CREA", "mg/dL", 1.0, 0.0, True), ("CREA", "umol/L", 0.0113, 0.0, False),
]
SCHEMA = "item_id bigint, testName string, resultValue string, units string, referenceRange string, field string, value string"


def unit_frame(spark):
    return spark.createDataFrame(TABLE, "test_code string, unit_code string, factor double, offset_add double, is_common boolean")


@pytest.mark.parametrize(
    "field, text, unit",
    [
        ("GLU", "mg per dL", "mg/dL"), ("GLU", "mg%", "mg/dL"), ("GLU", "MG / DL", "mg/dL"), ("GLU", "mM", "mmol/L"), ("GLU", "millimol/litre", "mmol/L"), ("GLU", "gm/L", "g/L"), ("HT", "m", "m"), ("HT", "mtr", "m"),
        ("HT", "inches", "in"), ("HT", "CMS", "cm"), ("PLT", "x 10⁹/L", "10^9/L"), ("PLT", "10*9/L", "10^9/L"), ("PLT", "lac/cmm", "lakh/uL"), ("PLT", "per cumm", "/uL"), ("PLT", "cells/µL", "/uL"), ("TEMP", "°F", "degF"),
        ("TEMP", "deg C", "degC"), ("HBA1C", "mmol/mol Hb", "mmol/mol"), ("HBA1C", "% NGSP", "%"), ("POT", "mEq per L", "mEq/L"), ("CREA", "micromol/L", "umol/L"), ("CREA", "μmol/l", "umol/L"), ("GLU", "see range", None),
        ("GLU", "kg", None), ("GLU", "", None), ("GLU", "x" * 5000, None), ("GLU", None, None),
    ],
)
def test_unit_strings(spark, field, text, unit):
    assert U.UnitTable.of(unit_frame(spark)).read(field, text) == unit


@pytest.mark.parametrize(
    "text, value, beside",
    [("8,5", 8.5, ""), ("117,175", 117175.0, ""), ("approx 101 mg/dL (H)", 101.0, "mg/dl"), ("4.2 mmol/L", 4.2, "mmol/l"), ("27710^9/L", 277.0, "10^9/l"), ("> 5.2 *", 5.2, ""), ("pending", None, ""), (None, None, ""), ("", None, "")],
)
def test_values(text, value, beside):
    assert U.split_value(text) == (value, beside)


def test_order_of_evidence_defaults_nulls_and_clashing_columns(spark):
    rows = [
        (1, "FBS", "5.5 mmol/L", "mg/dL", "70 - 99 mg/dL", "x", "y"),  # beside the value
        (2, "FBS", "5.5", "mmol/L", "70 - 99", "x", "y"),  # units column
        (3, "FBS", "90", None, "70 to 99 mg/dL", "x", "y"),  # range text
        (4, "FBS", "5.1", "-", "3.9 - 5.5", "x", "y"),  # size of the range
        (5, "FBS", "5.1", "", None, "x", "y"),  # common unit
        (6, "FBS", "pending", "mg/dL", None, "x", "y"),
        (7, None, "5", "mg/dL", None, "x", "y"),
        (8, "FBS", None, None, None, None, None),
        (9, "Temp", "98.6", "F", None, "x", "y"),
        (2, "FBS", "5.5", "mmol/L", "70 - 99", "x", "y"),
    ] + [(100 + i, "FBS", "5.0", "mmol/L", "3.9 - 5.5", "x", "y") for i in range(3)] + [(200 + i, "FBS", "80", "mg/dL", "70 - 99", "x", "y") for i in range(3)]
    got = {r.item_id: r for r in U.recorded_units(spark.createDataFrame(rows, SCHEMA), unit_frame(spark)).collect()}
    assert {k: got[k].unit_code for k in (1, 2, 3, 4, 5, 9)} == {1: "mmol/L", 2: "mmol/L", 3: "mg/dL", 4: "mmol/L", 5: "mg/dL", 9: "degF"}
    assert not {6, 7, 8} & set(got)
    assert abs(got[9].common_value - 37.0) < 1e-9 and abs(got[1].common_value - 5.5 * 18.016) < 1e-9


def test_empty_table(spark):
    assert U.recorded_units(spark.createDataFrame([], SCHEMA), unit_frame(spark)).count() == 0


def test_units_inside_text():
    from recordloom.operators.units import segment, split_value

    for text, value, unit in (
        ("5.4 mmol/L fasting", 5.4, "mmol/L"), ("7.8 mmol/L (repeat)", 7.8, "mmol/L"), ("112 mg/dL, sample haemolysed", 112.0, "mg/dL"), ("after 2 hours 7.8 mmol/L", 7.8, "mmol/L"), ("5.4 mmol/L " + "fasting " * 5000, 5.4, "mmol/L"),
    ):
        number, beside = split_value(text)
        assert number == value and segment(beside)[0][1] == segment(unit)[0][1], text
    assert segment("in range") == () and segment("see the note below") == ()
