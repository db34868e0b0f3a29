"""Two visits held against each other, and names of several words in notes that speak of stopping."""

from recordloom.plans import comparison, history

ENTRIES = "visit int, section string, key string, shown string, details string"


def test_states(spark):
    visits = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 8)], "visit int, before int")
    entries = spark.createDataFrame(
        [(1, "medication", "a", "A", "5"), (1, "medication", "b", "B", "1"), (1, "diagnosis", "x", "X", ""), (2, "medication", "a", "A", "10"), (2, "medication", "c", "C", ""), (2, "diagnosis", "x", "X", "")], ENTRIES
    )
    got = {(r.visit, r.section, r.key): r.state for r in comparison.compared(visits, entries).collect()}
    assert got == {
        (2, "medication", "a"): "changed", (2, "medication", "b"): "notListed", (2, "medication", "c"): "added", (2, "diagnosis", "x"): "continued",
        (3, "medication", "a"): "notListed", (3, "medication", "c"): "notListed", (3, "diagnosis", "x"): "notListed",
    }
    assert comparison.compared(visits, entries.limit(0)).collect() == [] and comparison.compared(visits.limit(0), entries).collect() == []


def test_mentions_of_names_of_several_words(spark, tmp_path):
    tables = {
        "clinical_extractions": ([(1, 7, "Stopped Folic-Acid  today."), (2, 7, "Continue iron."), (3, None, "Stop iron"), (4, 8, None)], "_id long, patient long, aiSummary string"),
        "medical_records": ([(2, "withdrew IRON"), (2, "withdrew IRON"), (2, None), (None, "stop iron")], "extraction long, verificationNotes string"),
        "medication_items": ([(1, "Folic acid"), (1, "Acid"), (2, "iron"), (2, "ironic"), (4, "iron"), (4, None), (1, "")], "extraction long, name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {tuple(r) for r in history._mentions(spark, str(tmp_path)).collect()}
    assert got == {(7, 1, "folicacid"), (7, 1, "acid"), (7, 2, "iron")}
