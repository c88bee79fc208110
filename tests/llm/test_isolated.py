"""Recall of queries outside a loose cluster that holds a third of the table."""

import numpy as np
from pyspark.sql import functions as F

from loomstat.llm import neighbours


def test_isolated_queries_beside_a_loose_cluster(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1000, 64))
    near = x[0] + rng.standard_normal((500, 64)) * 0.23  # cosines of about 0.95 among them
    u = np.concatenate((x, near))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    asked = [i for i in range(1, 1000) if i % 25 == 0]
    got = neighbours.nearest(df, F.col("vec_id").isin(asked)).toPandas()
    found = set(zip(got.query_id, got.id))
    want = {(i, int(j)) for i in asked for j in [j for j in np.argsort(-(u @ u[i])) if j != i][:5]}
    recall = len(found & want) / len(want)
    print("recall of isolated queries", recall)
    assert recall >= 0.9
