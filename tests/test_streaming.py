import os
import tempfile

from paths import SF001
from panelcast.functions import Missing
from panelcast.operators import distribution
from panelcast.sources import table
from panelcast.streaming import running_distribution, running_histogram, write_snapshots


def latest(spark, path):
    newest = max((p for p in os.listdir(path) if p.startswith("version=")), key=lambda p: int(p.split("=")[1]))
    return spark.read.parquet(os.path.join(path, newest))


def test_stream_distribution_equals_batch(spark):
    events = table(spark, SF001, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF001)
    out = tempfile.mkdtemp(prefix="panelcast-stream-")
    q = write_snapshots(running_distribution(stream, "event_type", Missing(values=["error"])), os.path.join(out, "d"), os.path.join(out, "c"))
    q.awaitTermination(120)
    got = sorted(latest(spark, os.path.join(out, "d")).collect())
    want = sorted(distribution(events, "event_type", Missing(values=["error"])).collect())
    assert got == want


def test_stream_histogram(spark):
    events = table(spark, SF001, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF001)
    out = tempfile.mkdtemp(prefix="panelcast-stream-")
    q = write_snapshots(running_histogram(stream, "value", 0, 500, 10), os.path.join(out, "h"), os.path.join(out, "c"))
    q.awaitTermination(120)
    got = latest(spark, os.path.join(out, "h")).collect()
    assert sum(r.cnt for r in got) == events.filter("value >= 0 AND value <= 500").count()


def test_restart_from_checkpoint_does_not_double_count(spark):
    events = table(spark, SF001, "events")
    out = tempfile.mkdtemp(prefix="panelcast-stream-")
    ckpt = os.path.join(out, "ckpt")

    def run():
        stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF001)
        q = write_snapshots(running_distribution(stream, "event_type"), os.path.join(out, "d"), checkpoint=ckpt)
        q.awaitTermination(120)

    run()
    run()  # resumes from the committed offsets and state: nothing is re-counted
    got = sorted(latest(spark, os.path.join(out, "d")).collect())
    assert got == sorted(distribution(events, "event_type").collect())
