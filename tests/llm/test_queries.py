import os

import pytest

from recordloom.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": ["item_id", "field_name", "med_ref_id"], "p3_found": ["conversation", "defect"], "p4_found": ["table_name", "row_id", "field_name", "pii_type"], "p5_found": ["answer_id", "defect"], "p7_found": ["patient_a", "patient_b"],
    "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.count() >= 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.distinct().count() == df.count()
