import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare

SF = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parent.parent
SAMPLE = [
    "p5_found", "f1_composite_all", "f7_missing_semantics", "f8_index_expression", "a10_inventory", "a13_tail", "j7_range_neighbours", "j8_knn", "p18_config_id",
    "s_p1_formula", "s_f10_lattice_range", "s_f13_geometry_summary", "s_g1_collisions", "s_a8_composition_bins", "s_a17_local_chemistry", "s_a18_pair_contacts", "s_a5_by_element", "s_u1_u5_state", "s_x5_divergence",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_sql(spark, name):
    assert compare(spark, entry, SF, name) == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_a_library_of_the_subpackage():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), 'p1_found' in e.queries(), 'p7_found' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1:] == ["True", "False"]
