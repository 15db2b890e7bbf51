"""Physical-plan properties that matter at scale (checked on executed AQE plans)."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _first_arg(text):
    depth = 0
    for i, ch in enumerate(text):
        if ch == "(":
            depth += 1
        elif ch == ")":
            if depth == 0:
                return text[:i]
            depth -= 1
        elif ch == "," and depth == 0:
            return text[:i]
    return text


def _unpartitioned_windows(plan):
    """Window specs whose first argument is an ordering or the frame: no partition key."""
    out = []
    for ln in plan.splitlines():
        for m in re.finditer(r"windowspecdefinition\(", ln):
            first = _first_arg(ln[m.end():]).strip()
            if first.startswith("specifiedwindowframe") or first.endswith(("ASC NULLS FIRST", "ASC NULLS LAST",
                                                                            "DESC NULLS FIRST", "DESC NULLS LAST")):
                out.append(ln.strip())
                break
    return out


@pytest.mark.parametrize("name", ["feature_matrix", "feature_matrix_nations", "top_venues", "assign_region",
                                  "align_features_labels", "undersample", "roc_auc", "area_incident_density"])
def test_no_cartesian_and_no_global_window(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert _unpartitioned_windows(plan) == []


def test_detector_finds_the_small_unpartitioned_id_windows(spark):
    # dense ids over the distinct interval / column lists are the only global windows
    w = _unpartitioned_windows(_plan(spark, "sparse_cells"))
    assert w and all("dense_rank" in ln for ln in w)


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = _plan(spark, "top_venues")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scans_are_pruned_and_filtered(spark):
    plan = _plan(spark, "first_visits")
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", plan)
    assert schemas and all("value" not in s for s in schemas)  # unused event columns never read
    assert "Not(EqualTo(event_type,error))" in plan and "PushedFilters: [IsNotNull(event_type)" in plan


@pytest.mark.parametrize("name", ["feature_matrix", "top_venues", "first_visits"])
def test_first_visits_need_no_sorting_aggregate(spark, name):
    assert "SortAggregate" not in _plan(spark, name)


def test_feature_matrix_scans_the_events_once(spark):
    from regionpulse.operators import features as feat
    from regionpulse.sources import testdata as td

    plan = feat.feature_matrix(td.event_checkins(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan  # everything comes from the written aggregate
