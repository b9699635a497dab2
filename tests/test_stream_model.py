"""A stream scored by the panel model equals the batch, and takes a newer model from the next batch on."""

import pytest
from pyspark.sql import functions as F

from fuelgrid.operators import panel
from fuelgrid.storage import shared_dir
from fuelgrid.streaming import prices
from tests.test_models import _panel


def test_each_batch_is_scored_by_the_newest_model(spark, tmp_path):
    p = _panel(spark, 8).select("*")
    models = [panel.fit(p.filter("date < '2025-05-01'"), rounds=1, with_bias=False), panel.fit(p.withColumn("relative", F.col("relative") * 3), rounds=2, with_bias=False)]
    folder = shared_dir(spark)
    panel.save(models[0], folder, 1)
    for k, rows in enumerate((p.filter("date < '2025-03-01'"), p.filter("date >= '2025-03-01'"))):
        rows.coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
    stream = prices.read(spark, str(tmp_path), p.schema, files_a_batch=1)
    seen = []

    def each(batch):
        out = prices.by_model(batch, folder)
        if not batch.isEmpty():
            seen.append(batch.count())
        return out

    def then_newer(batch):
        out = each(batch)
        if len(seen) == 1:
            out.cache().count()
            panel.save(models[1], folder, 2)
        return out

    got = prices.run(stream, "append", then_newer)
    assert len(seen) == 2 and {r.model_version for r in got.select("model_version").distinct().collect()} == {1, 2}
    for version, model in enumerate(models, 1):
        mine = got.filter(F.col("model_version") == version)
        want = {(r.station_id, r.date): r for r in panel.predict(p, model).collect()}
        rows = mine.collect()
        assert rows and all(r.structural_premium == pytest.approx(want[r.station_id, r.date].structural_premium) for r in rows)
        assert all((r.coverage, r.premium_confidence) == (want[r.station_id, r.date].coverage, want[r.station_id, r.date].premium_confidence) for r in rows)
