"""The secret scan's network is fitted and calibrated on all labelled windows."""

import numpy as np
from pyspark.sql import functions as F

from skein.llm import secrets
from tests.llm.test_search_phrases_secrets import secret_texts


def test_every_window_trains_or_calibrates(spark, monkeypatch):
    """In shards of any size each distinct window is in an epoch or in the calibration, with its count; the order of rows changes nothing."""
    trained, calibrated, epoch, calibrate = [], [], secrets.averaged, secrets.Network.calibrate
    monkeypatch.setattr(secrets, "SHARD", 300)
    monkeypatch.setattr(secrets, "EPOCHS", 2)
    monkeypatch.setattr(secrets, "averaged", lambda rows, shards, *a: trained.append((rows.count(), shards)) or epoch(rows, shards, *a))
    monkeypatch.setattr(secrets.Network, "calibrate", lambda self, *a: calibrated.append((int(a[3].sum()), a[4])) or calibrate(self, *a))
    docs = spark.createDataFrame(list(enumerate(secret_texts(3, 900))), "doc_id long, text string")
    network = secrets.fitted(docs, "whole")
    again = secrets.fitted(docs.repartition(7).orderBy(F.desc("doc_id")), "whole")
    rows = secrets.labelled(docs)
    assert trained[0][0] + calibrated[0][0] == rows.count() and trained[0][1] > 2
    n = {r.found: r.n for r in rows.groupBy("found").agg(F.sum("n").alias("n")).collect()}
    assert calibrated[0][1] == (n[False] / sum(n.values()), n[True] / sum(n.values()))
    assert np.array_equal(network.flat(), again.flat()) and np.array_equal(network.least, again.least)


def test_thresholds_keep_the_findings_in_counts():
    """Of 1,000 findings at most 50 less what chance may take are below the threshold, by counts as by single ones."""
    network = secrets.Network()
    bins = np.arange(-200, 200)
    labels, counts = np.repeat([0, 1], 200), np.full(400, 5)
    network.calibrate(labels, np.zeros(400, int), bins, counts, (0.5, 0.5))
    chance = 1 / (1 + np.exp(-(network.slope * (bins + 0.5) / secrets.GRID + network.offset)))
    below = counts[(labels == 1) & (chance < network.least[0])].sum()
    assert 0 < below and below + 1.64 * below**0.5 <= 50 < below + 5 + 1.64 * (below + 5) ** 0.5
