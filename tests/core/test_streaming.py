from jobloom.plans import streams


def test_claims(spark):
    rows = streams.stream_claims(spark, "/root/testdata/sf0.001").collect()
    last, want = {}, {}
    for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").select("user_id", "ts").collect():
        n, g = want.get(r.user_id, (0, 0))
        ok = r.user_id not in last or (r.ts - last[r.user_id]).total_seconds() >= 43_200
        if ok:
            last[r.user_id] = r.ts
        want[r.user_id] = (n + 1, g + ok)
    assert {r.user_id: (r.claims, r.granted) for r in rows} == want
