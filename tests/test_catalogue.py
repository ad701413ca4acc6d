"""Registered queries against their check SQL. One query per group by default; SKEINLOG_ALL=1 runs every one."""

import os

import duckdb
import pytest

from given import ROOT
from skeinlog.plans import load_catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CATALOGUE = load_catalogue()
SAMPLE = [
    "flt_03_file_filter", "flt_13_reading_categories", "txt_03_snippet", "txt_04_project_search", "txt_05_timeline_totals", "osl_05_timeline_page",
    "agg_01_session_counts_codex", "agg_12_file_suggestions", "osl_04_slow_commands", "prj_13_session_summary", "prj_39_display_states",
    "win_02_turn_epochs", "win_04_cache_observations", "win_10_narrative_items", "win_15_reminder_runs", "jon_03_calls_and_results",
    "jon_06_mirrored_messages", "jon_12_nearest_goal_call", "jon_14_range_owner", "jon_16_discontinuity_anchor", "jon_18_confirmed_forks",
    "agg_16_inherited_context", "agg_16_inherited_previews", "grf_11_fork_point_target", "grf_01_fork_chains", "grf_05_fork_point_ancestry", "set_02_duplicate_transcripts", "lif_07_task_states", "lif_08_approvals", "lif_10_retry_chains", "lif_12_goal_revisions", "grf_06_code_dispatches", "lif_06_goals_by_descent",
    "lif_03_terminal_continuations", "src_02_line_numbered_scan", "src_09_packed_members", "src_15_projection_sink", "prj_01_rollout_projection",
    "prj_02_block_projection", "prj_03_event_log_projection", "prj_28_patch_lines", "dq_02_reference_ownership", "udf_03_sql_functions",
]
CHECKED = [n for n, q in CATALOGUE.items() if q.sql is not None]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return con


def ordered_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED if os.environ.get("SKEINLOG_ALL") else SAMPLE)
def test_query_equals_check_sql(spark, duck, name):
    query = CATALOGUE[name]
    df = query.build(spark, ROOT)
    result = duck.execute(query.sql)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered_rows(df.columns, df.collect()) == ordered_rows(columns, result.fetchall())


@pytest.mark.parametrize("name", ["win_04_cache_observations", "win_10_tool_groups", "jon_05_web_search_pairs", "txt_04_project_search", "win_12_compaction_groups"])
def test_small_blocks_change_nothing(spark, duck, tiny_blocks, name):
    test_query_equals_check_sql(spark, duck, name)


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
