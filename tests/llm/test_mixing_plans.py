"""The steps of mixing are planned apart: the driver plans each query anew after each of its stages."""

import re

from logweir.llm import mixing, stages


def test_no_query_of_mixing_holds_the_plans_of_all_its_steps(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c {i}", "en", f"s{i % 3}", 9) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    for out, most in ((mixing.mix(docs), 4), (stages.mixture(spark, docs, ""), 6)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\b(?:Broadcast)?Exchange\b", plan)) <= most
        assert out.count() > 0
