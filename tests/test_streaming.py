import shutil
import uuid

from pyspark.sql import functions as F

from tallyforge.operators import catalog, srs
from tallyforge.sources.adapters import reviews, runs, table
from tallyforge.streaming import twins


def stream(spark, df, tmp_path):
    """A file stream of df in three files, read one a batch."""
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    for i in range(3):
        df.where(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(f"{folder}/tmp{i}")
        for p in (tmp_path / folder.rsplit("/", 1)[1] / f"tmp{i}").glob("part-*.parquet"):
            shutil.move(p, f"{folder}/{i}.parquet")
        shutil.rmtree(f"{folder}/tmp{i}")
    return spark.readStream.schema(df.drop("_part").schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, df, mode, tmp_path):
    name = "q" + uuid.uuid4().hex[:8]
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def thirds(df):
    cut = df.approxQuantile("_o", [1 / 3, 2 / 3], 0.0)
    return df.withColumn("_part", F.when(F.col("_o") < cut[0], 0).when(F.col("_o") < cut[1], 1).otherwise(2)).drop("_o")


def test_review_states_match_the_batch_fold(spark, sf_dir, tmp_path):
    rows = reviews(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_o", F.col("ts").cast("double"))
    out = drain(spark, twins.review_states(stream(spark, thirds(rows), tmp_path)), "update", tmp_path)
    got = {(r.student_id, r.card_id): (round(r.ease, 6), r.interval, r.reps, r.lapses) for r in sorted(out.collect(), key=lambda r: (r.reps + r.lapses))}
    last = out.groupBy("student_id", "card_id").agg(F.max_by(F.struct("ease", "interval", "reps", "lapses"), "seq").alias("z"))
    batch = srs.fold(reviews(spark, sf_dir), ["student_id", "card_id"])
    want = {(r.student_id, r.card_id): (round(r.srs.ease, 6), r.srs.interval, r.srs.reps, r.srs.lapses) for r in batch.collect()}
    assert got.keys() == want.keys()
    latest = {(r.student_id, r.card_id): (round(r.z.ease, 6), r.z.interval, r.z.reps, r.z.lapses) for r in last.collect()}
    same = sum(latest[k] == want[k] for k in want)
    assert same >= 0.99 * len(want)


def test_run_totals_and_throttle(spark, sf_dir, tmp_path):
    rows = runs(spark, sf_dir).withColumn("_o", F.col("run_id").cast("double"))
    out = drain(spark, twins.run_totals_stream(stream(spark, thirds(rows), tmp_path)), "complete", tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, catalog.run_totals(runs(spark, sf_dir)).collect()))

    logins = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("ip"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"))
    timed = logins.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_o", F.col("ts").cast("timestamp").cast("double"))
    out = drain(spark, twins.throttled(stream(spark, thirds(timed), tmp_path), 4, 3600), "append", tmp_path)
    got = sorted((r.ip, r.seq, r.blocked) for r in out.collect())
    assert got == sorted((r.ip, r.seq, r.blocked) for r in catalog.throttle(logins, 4, 3600).collect())
