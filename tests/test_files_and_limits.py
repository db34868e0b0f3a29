import datetime as dt
import random
from collections import Counter

from recordloom.plans.scalars import file_signatures
from recordloom.streaming.runs import stream_rate_limit


def test_large_files_are_listed(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b/large.parquet").write_bytes(b"PAR1" + bytes(16 * 1024 * 1024))
    (tmp_path / "small.parquet").write_bytes(b"%PDF-1.7")
    got = {(r.file, r.length, r.kind) for r in file_signatures(spark, str(tmp_path)).collect()}
    assert got == {("large.parquet", 16 * 1024 * 1024 + 4, "parquet"), ("small.parquet", 8, "pdf")}


def test_rate_limit_of_a_hot_user(spark, tmp_path):
    rng, start = random.Random(3), dt.datetime(2026, 1, 1)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(2, 50), start + dt.timedelta(seconds=rng.randrange(3_000_000))) for _ in range(25_000)]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "events.parquet")
    n = Counter((u, int((t - start).total_seconds()) // 900) for u, t in rows)
    want = {}
    for (u, _), k in n.items():
        a, r = want.get(u, (0, 0))
        want[u] = (a + min(k, 3), r + max(k - 3, 0))
    assert {r.user_id: (r.accepted, r.rejected) for r in stream_rate_limit(spark, str(tmp_path)).collect()} == want
