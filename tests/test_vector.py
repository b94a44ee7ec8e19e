import math

from pyspark.sql import functions as F

from vellum.functions import vector as V
from vellum.functions.sql import register_sql_functions


def _one(spark, expr, a, b=None):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in (b or a)])], "a array<float>, b array<float>")
    return df.select(expr(F.col("a"), F.col("b")).alias("v")).first()["v"]


def test_norm_dot_cosine(spark):
    assert _one(spark, lambda a, b: V.vec_norm(a), [3, 4]) == 5.0
    assert _one(spark, V.vec_dot, [1, 2, 3], [4, 5, 6]) == 32.0
    # FX1 worked scores
    assert round(_one(spark, V.cosine_sim, [1, .1, .1], [1, 0, 0]), 6) == 0.990148
    assert round(_one(spark, V.cosine_sim, [1, .1, .1], [0, 1, 0]), 6) == 0.099015
    assert round(_one(spark, V.cosine_sim, [.1, 0, 1], [0, 0, 1]), 6) == 0.995037
    assert round(_one(spark, V.cosine_dist, [1, 0, 0], [.7, .7, 0]), 6) == round(1 - math.sqrt(.5), 6)


def test_zero_vector_is_guarded(spark):
    # ANSI mode: a division by zero would raise; the guard gives 0 / zeros
    assert _one(spark, V.cosine_sim, [0, 0, 0], [1, 2, 3]) == 0.0
    assert _one(spark, lambda a, b: V.vec_normalize(a), [0, 0]) == [0.0, 0.0]
    assert _one(spark, lambda a, b: V.inv_norm(a), [0, 0]) == 0.0


def test_unequal_lengths_give_null_not_a_number(spark):
    assert _one(spark, V.vec_dot, [1, 2, 3], [1, 2]) is None


def test_sql_functions(spark):
    register_sql_functions(spark)
    r = spark.sql("SELECT vec_norm(array(3F, 4F)) AS n, round(cosine_sim(array(1F, .1F, .1F), array(1F, 0F, 0F)), 6) AS c, "
                  "metadata_match(map('a', '1', 'b', '2'), map('a', '1')) AS m1, "
                  "metadata_match(map('a', '1'), map('c', '1')) AS m2, metadata_match(map('a', '1'), map()) AS m3").first()
    assert r["n"] == 5.0 and r["c"] == 0.990148 and r["m1"] and not r["m2"] and r["m3"]
