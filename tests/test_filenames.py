from provenant.plans import registry


def test_spans_of_a_file_name_are_read_by_one_worker_a_task(spark):
    plan = registry.queries()["b09_filename_phones"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
