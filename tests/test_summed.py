"""Common terms are known before their postings are summed up by region, so that rare ones aren't shuffled."""

from pyspark.sql import functions as F

from tidepool.operators import index


def test_only_common_terms_are_summed(spark, monkeypatch):
    monkeypatch.setattr(index, "REGIONED", 5)
    rows = [(f"t{t}", r % 4, t * 100 + r, r % 3 + 1, 10 + r) for t in range(9) for r in range(t + 1)]
    postings = spark.createDataFrame(rows, "term string, region int, key long, tf long, length long")
    got = index.summed(postings)
    want = {}
    for term, region, _, tf, length in rows:
        if int(term[1:]) >= 4:
            n, most, shortest = want.get((term, region), (0, 0, 1 << 30))
            want[term, region] = (n + 1, max(most, tf), min(shortest, length))
    assert {(r.term, r.region): (r.n, r.most, r.shortest) for r in got.collect()} == want
    assert got.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # the join is below; before, it was above
    assert index.summed(postings.where(F.lit(False))).count() == 0
