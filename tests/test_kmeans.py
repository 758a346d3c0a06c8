"""k-means over the whole vocabulary."""

from __future__ import annotations

from loomlens.operators import phrases


def test_unrelated_grams_stay_apart(spark, monkeypatch):
    seen = []
    fit = phrases.KMeans.fit
    monkeypatch.setattr(phrases.KMeans, "fit", lambda self, rows: seen.append(rows.first()["features"].size) or fit(self, rows))
    rows = [(f"t{i}", f"g{j}", 1.0) for i in range(4) for j in range(1500 * (i // 2), 1500 * (i // 2) + 1500)]
    got = phrases.kmeans(spark.createDataFrame(rows, "turn string, gram string, w double"), "turn").collect()
    by = {r["turn"]: r["cluster"] for r in got}
    assert by["t0"] == by["t1"] != by["t2"] == by["t3"]
    assert seen == [3000] * 20
