"""Small languages, samples of copies, short benchmark items and parts of long ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import decontaminate, jaccard, langid, repeats, sharding, urls


def test_small_languages_have_models(spark):
    """Languages of one text, copied, and of three get a model of all their texts."""
    alphabet = [chr(0x0431 + i) for i in range(16)]
    text = {f"l{i:02d}": (x + chr(ord(x) + 1)) * 12 + " " + x * 20 for i, x in enumerate(alphabet)}
    rows = [(t, k) for k, t in text.items() for _ in range(20)] + [(f"abc{i} abab cbcb " * 4, "few") for i in "xyz"]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    languages, models, limits = langid.fit(labelled, 5)
    assert languages == ["few", *sorted(text)] and len(models) == len(limits) == 17
    got = langid.predict(labelled, languages, models, limits).select("lang", "lang_pred", "accepted").distinct().collect()
    assert all(r.lang == r.lang_pred for r in got) and {r.lang for r in got if r.accepted} >= set(text)
    assert limits[0] < float("inf")


@pytest.mark.parametrize("n", [7, 13, 4000])
def test_sample_is_of_distinct_texts(spark, n):
    """Copies neither fill the sample nor empty it: of n texts, one of them 5,000 times, min(2 * sample, n) are drawn once each."""
    rows = spark.range(n + 5000).select(F.concat(F.lit("text "), F.least("id", F.lit(n - 1)).cast("string")).alias("text"), F.lit("en").alias("lang"))
    drawn = langid.draw(rows, {"en": n}, 5).collect()
    assert len(drawn) == len({r.text for r in drawn}) == min(10, n)
    assert sum(r.fold == 0 for r in drawn) == min(10, n) // 2


def test_leaks_of_short_items_and_parts(spark):
    words = [f"{x}{y}word" for x in "abcdefgh" for y in "klmnopqr"]
    long, other = " ".join(words[:56]), " ".join(reversed(words))
    items = [(1, "What is the capital of France?"), (2, long), (3, "Why"), (4, "\u6771\u4eac\u306f")]
    texts = {
        1: ("So: what is  the Capital of France? Paris.", [1]), 2: ("Somewhat is the capital of France?", []), 3: ("and " + " ".join(words[3:53]) + " end", [2]),
        4: (other + " " + " ".join(words[:20]), []), 5: (long, [2]), 6: ("why not", [3]), 7: ("whyever, awhy", []), 8: ("\u306f\u6771\u4eac\u306f\u6771", [4]), 9: (None, []), 10: ("", []),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    for size in (1 << 24, 64):
        got = {r.doc_id: r.leaks for r in decontaminate.mark_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=size).collect()}
        assert {i: [x.item_id for x in found] for i, found in got.items()} == {i: want for i, (_, want) in texts.items()}
        assert (got[1][0].start, got[1][0].end, got[5][0].edits, got[5][0].end) == (4, 35, 0, len(long))


OWN = "skein_gone skein_gone_ skein_th skein_doc skein_at skein_spans skein_text skein_leaks skein_node skein_rule skein_slot skein_shard skein_salt skein_own_kept SKEIN_RULE_".split()


def test_columns_of_the_operators_own_names(spark, sf, tmp_path):
    """Columns that are called as operators call theirs stay as they are."""
    text = "one two three four five six seven eight " * 4
    rows = [(i, text + f"tail {i}" * (i > 1), i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x long")
    docs = docs.select("doc_id", "text", *[F.concat(F.lit(f"{n}-"), F.col("x").cast("string")).alias(n) for n in OWN], F.lit("mine").alias("kept"))
    same = lambda df: {(r.doc_id, *[r[n] for n in OWN]) for r in df.collect()} <= {(r.doc_id, *[r[n] for n in OWN]) for r in docs.collect()}
    kept = jaccard.keep_one_of_each_group(docs, label="names")
    assert kept.columns == docs.columns and kept.count() == 1 and same(kept)
    assert same(repeats.remove_repeats(docs, label="names")) and same(sharding.place(docs, {"a": 1, "b": 1}))
    clean = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "absent words of an item that nobody has said")], "item_id long, text string"))
    assert clean.columns == docs.columns and clean.count() == 3 and same(clean)
    pages = docs.withColumn("url", F.concat(F.lit("http://www.a.com/en/"), F.col("doc_id").cast("string"))).withColumn("html", F.when(F.col("doc_id") == 0, '<link rel="canonical" href="http://b.org/x">'))
    judged = urls.judge(pages, [("block", "org/x"), ("allow", "net/")])
    assert same(judged) and {r.doc_id: r.verdict for r in judged.collect()} == {0: "block", 1: "allow", 2: "allow"}
    sharding.write_shards(sharding.place(docs, {"a": 1, "b": 1}), str(tmp_path / "shards"))
    assert same(spark.read.parquet(str(tmp_path / "shards")))
    done = corpus_pipeline.repeated_passages(spark, docs, sf)
    assert done.columns == docs.columns and same(done) and {r.kept for r in done.collect()} == {"mine"}
