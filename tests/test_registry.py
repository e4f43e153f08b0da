import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from piiguard import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: A part of the queries, at least one of each kind; all of them have SQL or a test of their own.
CHECKED = """flagship l1_detect l2_detect l2_find_matches red_spans red_infos san_fold san_validate_text gate_decide l3_indicators l3_convert geo_nms pipe_detect strat_run vis_perceive san_deep
san_validate san_structured val_action val_resolve src_mock_actions rsn_decide st_stats st_percentile_nearest bm_format_bytes ev_metrics ev_category ex_category_strategy ds_validate src_dataset_scan
snk_summary_text el_tag_counts el_label_text san_deep_records rsn_schema rsn_action_schema geo_overlap geo_overlap_page val_budget el_visible_pages el_walk_lateral st_sorted
l2_ssn l2_pobox src_dataset_lookup snk_results san_context snk_evaluation_text snk_experiment_text snk_benchmark_text""".split()


def test_names_and_oracles():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLES[name]})").fetchall()
    norm = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert norm(map(tuple, got.select(*columns).collect())) == norm(want)


def test_every_survey_query_is_checked():
    """Only these have no SQL: they are held by tests on trees and fixtures."""
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"src_dom_walk", "el_selector", "el_to_metadata", "pipe_detect_pages", "pipe_group_pages", "san_context_pages", "san_structured_pages", "val_mock_actions", "geo_nms_page"}


def test_imports_without_the_corpus_operators():
    code = "import sys; sys.modules['piiguard.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__)), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) == len(registry.QUERIES)
