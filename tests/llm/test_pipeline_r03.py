"""The check's finding of round 3 on pipeline: counters of shingles in rows that don't grow with a group, and tables that go when they have been read."""

import os

import numpy as np
import pytest

from skein import shared
from skein.llm import jaccard

from tests.llm.test_words import DOCS, brute_components


@pytest.mark.parametrize("copies", [0, 300, 1200])
def test_counters_come_in_as_many_rows_for_any_group(spark, copies):
    """Before: a row for each counter of a task that isn't 0, here tens of thousands."""
    rng = np.random.default_rng(copies)
    common = rng.integers(0, 1 << 63, 60, np.int64).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 60, np.int64).astype(np.uint64)])) for _ in range(copies)]
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "lo long, hashes binary").repartition(3)
    tallied = jaccard.tallies(held)
    assert tallied.count() <= 3 * jaccard.SLOTS // jaccard.BLOCK
    every = np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(jaccard.SLOTS - 1)
    assert (jaccard.counters(tallied) == np.bincount(every.astype(np.int64), minlength=jaccard.SLOTS)).all()


def test_only_what_the_result_reads_is_left(spark):
    """Before: some twenty tables stayed until the application's end, and counted as the next stage's disk."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 400, 120)]
    rows = []
    for i in range(80):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 6)):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85, 100, "left")
    folder = f"{shared.shared_dir(spark)}/skein-{spark.sparkContext.applicationId}".removeprefix("file://")
    assert sorted(x.split("-")[1] for x in os.listdir(folder) if x.startswith("left-")) == ["reps", "sets"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 4, 85, 100)
