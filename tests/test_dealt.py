from pyspark.sql import functions as F

from lectern.plans import learning as batch
from lectern.plans import streams
from lectern.plans.retrieval import table
from lectern.streaming import events as S


def test_parts_of_several_files_are_a_batch_each(spark, sf_dir, monkeypatch):
    """Large parts are written by several tasks; streams give what they give with a file a part."""
    monkeypatch.setattr(S, "FILE_ROWS", 50)
    monkeypatch.setattr(S, "SURE_ROWS", 25)
    events = table(spark, sf_dir, "events")
    folder, each = S.dealt(events, F.pmod("event_id", F.lit(2)), 2)
    assert each > 1 and len(spark.read.parquet(folder).inputFiles()) == 2 * each + 1
    told = lambda rows: sorted((r["event_id"], r["book"]) for r in rows.collect())
    assert told(streams.progress_throttle_stream(spark, sf_dir)) == told(batch.progress_throttle(spark, sf_dir))
