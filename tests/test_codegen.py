"""Size of the methods that Spark makes of a query over the driver tables."""

from roundtide.plans.star import COMPILED_SIZE, HUGE_METHOD, Star


def test_operators_are_not_fused_into_methods_that_are_never_compiled(spark, tmp_path):
    Star(spark, str(tmp_path))
    assert spark.conf.get(HUGE_METHOD) == COMPILED_SIZE
    spark.conf.set(HUGE_METHOD, "4000")
    Star(spark, str(tmp_path))
    assert spark.conf.get(HUGE_METHOD) == "4000"
    spark.conf.set(HUGE_METHOD, COMPILED_SIZE)
