"""The first pairs of the near-duplicates are written depth by depth: no plan of all depths is left to the driver."""

from quillstone.llm import minhash


def test_first_pairs_are_read_from_tables(spark):
    bands = lambda i: [100 * t + (i if t % 2 else 0) for t in range(minhash.BANDS)]  # noqa: E731  every second band is shared by all
    rows = [(i, bands(i), 0, 0, 8) for i in range(8)] + [(i, bands(i), 1, 7, 2) for i in (3, 5)]
    members = spark.createDataFrame(rows, "node long, bands array<long>, tab int, band long, n long")
    pairs = minhash._first_pairs(members, len(rows))
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.a, r.b) for r in pairs.collect()}
    assert (5, 3) in got and {x for p in got for x in p} == set(range(8)) and all(a > b for a, b in got)
