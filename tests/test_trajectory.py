from skeinlog.operators import trajectory


def test_long_tool_names_stay_apart(spark):
    names = ["mcp__server_of_the_project__read_file", "mcp__server_of_the_project__read_tree", "shell", "", "shell"]
    rows = [("s", f"e{i}", i, "tools:e0", name, "success", "normal") for i, name in enumerate(names)]
    grouped = spark.createDataFrame(rows, "session_id string, event_id string, line long, group_id string, tool_name string, status string, severity string")
    row = trajectory.tool_groups(grouped).first()
    assert (row.events, row.tool_names) == (5, "|".join(sorted(set(names) - {""})))
