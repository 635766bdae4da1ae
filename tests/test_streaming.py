"""The answer log across batches and restarts."""

from __future__ import annotations

from panelworks.streaming import feeds

SCHEMA = "task int, reviewer string, at int, answer string"


def test_a_batch_writes_only_the_keys_it_changes(spark, tmp_path):
    base, out = f"{tmp_path}/in", f"{tmp_path}/log"

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(base)
        feeds.logged(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(base), ["task", "reviewer"], "at", out)
        return spark.read.schema(SCHEMA + ", batch long").parquet(out)

    log = run([(1, "a", 1, "left"), (2, "a", 1, "left"), (1, "b", 5, None)])
    assert log.count() == 3
    log = run([(1, "a", 2, "right"), (1, "b", 4, "late")])  # a new run goes on from the state; the older answer changes nothing
    batches = [r[0] for r in log.select("batch").distinct().orderBy("batch").collect()]
    assert sorted((r["task"], r["reviewer"], r["at"], r["answer"]) for r in log.where(f"batch = {batches[-1]}").collect()) == [(1, "a", 2, "right"), (1, "b", 5, None)]
    log = run([(3, "a", 9, "centre")])
    assert log.where(f"batch > {batches[-1]}").count() == 1
    log = run([(2, "a", 1, "right")])  # of one time the greater answer
    got = {(r["task"], r["reviewer"]): (r["at"], r["answer"]) for r in feeds.current(log, ["task", "reviewer"]).collect()}
    assert got == {(1, "a"): (2, "right"), (1, "b"): (5, None), (2, "a"): (1, "right"), (3, "a"): (9, "centre")}
    feeds.logged(spark.readStream.schema(SCHEMA).parquet(base), ["task", "reviewer"], "at", out)  # nothing new
    assert feeds.current(spark.read.schema(SCHEMA + ", batch long").parquet(out), ["task", "reviewer"]).count() == 4
