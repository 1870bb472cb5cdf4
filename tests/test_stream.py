"""A stream of files counts every row once, also when a batch runs again."""

import os

from rowgauge.operators import flags
from rowgauge.streaming import files


def test_restarts_and_new_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(i, f"mail a{i}@b.de" if i % 3 else "  x") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, t string")
    df.repartition(4).write.parquet(source)
    stream = lambda: files.read_stream(spark, source, "parquet", df.schema, max_files=1)
    want = lambda d: sorted(map(tuple, flags.flag_counts(d, ["t"]).collect()))
    got = lambda: sorted(map(tuple, files.counted(spark, out).collect()))
    files.count_stream(stream(), ["t"], out, state).awaitTermination()
    assert got() == want(df)
    # The last batch was written, but its end was not recorded: it runs again.
    commits = os.path.join(state, "commits")
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    os.remove(os.path.join(commits, last))
    crc = os.path.join(commits, f".{last}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    files.count_stream(stream(), ["t"], out, state).awaitTermination()
    assert got() == want(df)
    df.limit(7).coalesce(1).write.mode("append").parquet(source)
    files.count_stream(stream(), ["t"], out, state).awaitTermination()
    assert got() == want(spark.read.parquet(source)) != want(df)
