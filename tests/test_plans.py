"""Physical plans: no pair-wise joins, filters that reach the scan."""

import pytest

import __spark_entry__ as entry
from opsloom import model
from opsloom.operators import select as sel
from opsloom.operators import summary
from opsloom.session import fresh_dir

# Queries that run streams or train models show the plan of their written result only.
LAZY = sorted(n for n in entry.queries() if n[0] in "apwjuqdt" and not n.startswith("d2"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_sample_store(spark, sf_dir):
    from opsloom.plans.storage import rounds
    from opsloom.sources import samples
    path = fresh_dir(spark, "samples")
    samples.append_samples(rounds(spark, sf_dir), path)
    df = sel.by_prefix(sel.filter_samples(
        samples.read_samples(spark, path).filter("date = date'2024-01-05'"), collector="queue",
        start="2024-01-05 06:00:00", newest_first=False), "pur").select("value")
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in text and "(collector" in text.split("PartitionFilters")[1].splitlines()[0], text
    assert "GreaterThanOrEqual(ts" in text and "StringStartsWith(name,pur)" in text
    assert "ReadSchema: struct<name:string,value:double,ts:timestamp>" in text


def test_raw_rows_of_a_series_never_meet_in_one_task(spark, sf_dir):
    text = plan(summary.series_summary(model.samples(spark, sf_dir), ["name"]))
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    # The deepest shuffle carries the rows and is keyed by slice as well.
    assert "_slice" in shuffles[-1]


def test_top_n_is_cut_before_the_shuffle(spark, sf_dir):
    from opsloom.operators.ordered import keep_newest
    text = plan(keep_newest(model.samples(spark, sf_dir), ["name"], ["us", "sample_id"], 5,
                            "sample_id"))
    assert text.count("WindowGroupLimit") >= 2
