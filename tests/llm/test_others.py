"""Chat formatting, URL filters, sharding, vectors and the pipeline."""

import hashlib
import random
from collections import Counter
from urllib.parse import urljoin

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat, queries, sharding, urls, vectors

TURNS = "conv_id long, turn long, role string, text string"


def brute_chats(rows):
    convs = {}
    key = lambda x: (x is not None, x)
    for conv, turn, role, text in set(rows):
        if conv is not None:
            convs.setdefault(conv, []).append((key(turn), key(role), key(text)))
    said = {k: [(r, t) for _, r, t in sorted(v)] for k, v in convs.items()}
    out = {}
    for k, v in said.items():
        same = [j for j, w in said.items() if w == v]
        if k == min(same) and not any(len(w) > len(v) and w[: len(v)] == v for w in said.values()):
            out[k] = (len(v), len(same), "".join(f"<|im_start|>{r[1] or ''}\n{t[1] or ''}<|im_end|>\n" for r, t in v))
    return out


def test_chats(spark):
    u, a = "user", "assistant"
    rows = [(1, 0, u, "hi"), (1, 1, a, "yo"), (2, 0, u, "hi"), (3, 5, u, "hi"), (3, 6, a, "yo"), (3, 7, u, "ok"), (4, 0, u, "hi"), (4, 1, a, "yo"), (4, 2, u, "ok"),
            (5, 0, u, None), (6, 0, u, ""), (6, 1, a, "x"), (7, 0, None, "hi"), (7, 0, None, "hi"), (8, None, u, "hi"), (8, 1, a, "no"), (None, 0, u, "lost"), (9, 0, u, "tie"), (9, 0, u, "tia"), (10, 0, u, "tia"), (11, 0, u, "tie")]
    rows += [(30, None, u, "first"), (30, -300, u, "second"), (30, 0, u, "third"), (31, None, u, "first"), (31, -300, u, "second"), (32, -300, u, "second"), (32, None, u, "first"), (32, 5, u, "third"), (32, 6, u, "last")]
    rows += [(20, i, u, f"t{i}") for i in range(700)] + [(21, i, u, f"t{i}") for i in range(300)] + [(22, i, u, f"t{i}") for i in range(299)] + [(22, 299, u, "other")]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS).withColumn("n_turns", F.lit(0)))
    assert {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in got.collect()} == brute_chats(rows)
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_query_is_native(spark, sf):
    df = queries.op2_chat_formatting(spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in df.collect()} == brute_chats(rows)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# -- URLs -----------------------------------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://x.com/en/1": ("x.com", "/en/1", "com/en/", "block"), "http://x.com?/en/": ("x.com", "", None, "allow"), "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"), "http://org/es/": ("org", "/es/", "org/es/", "block"), "x://y://z.com/en/": ("y:", "//z.com/en/", None, "allow"), "http://É.com/en/": ("É.com", "/en/", "com/en/", "block"),
    }
    rules = [*queries.URL_RULES[:3], ("block", "example.net/de/8"), ("block", "org/es/")]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("html", F.lit(None).cast("string"))
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rules).collect()} == cases


def test_url_aliases(spark):
    pages = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://bad.com/en/1">'), (2, "http://b.org/y", "<meta http-equiv='refresh' content='0; url=http://a.org/x'>"),
        (3, "https://bad.com/en/1", None), (4, "http://c.org/z", '<link href="/root" rel="canonical">'), (5, "http://c.org/root", ""),
        (6, "http://d.org/1", '<link rel=canonical href="http://bad.com/en/2">'), (7, "http://example.com/en/7", '<link rel=canonical href="http://bad.com/en/2">'), (8, None, "<html>"), (1, "http://a.org/x", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = Counter((r.page_id, r.verdict) for r in urls.judge(df, queries.URL_RULES).collect())
    want = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}
    assert got == Counter({(i, v): 1 + (i == 1) for i, v in want.items()})
    more = spark.createDataFrame([("http://c.org/root", "http://bad.com/en/1")], "url string, target string")
    assert {r.page_id: r.verdict for r in urls.judge(df, queries.URL_RULES, more).collect()}[4] == "block"
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_links_resolve(spark):
    """Against the standard library's rules, for targets of each kind."""
    base = "https://A.org/x/y/z.html?q=1#f"
    targets = ["http://b.org/1", "//b.org/2", "/root", "leaf", "./leaf", "../up", "../../../top", "a/./b/../c", "?only=query", "d/..", ".", "/p?x=1&amp;y=2"]
    got = spark.createDataFrame([(t,) for t in targets], "t string").select("t", urls.resolved(F.col("t"), F.lit(base)).alias("u")).collect()
    for r in got:
        want = urljoin(base.replace("A.org", "a.org"), r.t.replace("&amp;", "&"))
        assert r.u == want, (r.t, r.u, want)


@pytest.mark.parametrize("seed", range(3))
def test_random_link_graphs(spark, seed):
    """Verdicts on random graphs of canonical and refresh links against union-find, with quoted, bare and relative targets."""
    rnd = random.Random(seed)
    hosts = ["a.org", "b.org", "x.com", "example.com", "y.example.com", "z.net", "example.net"]
    url = lambda: f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'es', 'fr'])}/{rnd.randrange(9)}"
    pages = [(i, url()) for i in range(60)]
    links, rows = [], []
    for i, u in pages:
        html = "<p>text</p>"
        if rnd.random() < 0.6:
            target = rnd.choice([url(), f"../{rnd.choice(['en', 'de'])}/{rnd.randrange(9)}", f"{rnd.randrange(9)}"])
            html += rnd.choice(['<link rel="canonical" href="{}">', "<link rel=canonical href={}>", "<link href='{}' rel='canonical'>", '<meta http-equiv="refresh" content="0; url={}">', "<meta content='1;URL={}' http-equiv=refresh>"]).format(target)
            links.append((u, urljoin(u, target)))
        rows.append((i, u, html))
    part = {x: x for pair in links for x in pair} | {u: u for _, u in pages}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        part[root(a)] = root(b)

    def ruled(u):
        host, path = u.split("://")[1].split("/", 1)
        fits = [(len(r), v) for v, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and f"/{path}".startswith(r[r.index("/") :])]
        return max(fits)[1] if fits else None

    def want(u):
        if ruled(u):
            return ruled(u)
        said = {ruled(x) for x in part if root(x) == root(u)}
        return "block" if "block" in said and "allow" not in said else "allow"

    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got == {i: want(u) for i, u in pages}


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op3_url_filters"])
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(map(str, got.select(*names).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.fetchall()))


# -- sharding -------------------------------------------------------------------------------------------------------------------------------


def test_lookup_table():
    names = {f"s{i}": 1 for i in range(20)}
    table = sharding.lookup_table(names, 1009)
    n = Counter(table)
    assert max(n.values()) - min(n.values()) <= 1 and set(n) == set(names)
    fewer = sharding.lookup_table({k: v for k, v in names.items() if k != "s7"}, 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != "s7") < 0.15 * 1009
    heavy = Counter(sharding.lookup_table({"a": 3, "b": 1, "c": 0}, 1009))
    assert abs(heavy["a"] - 3 * heavy["b"]) <= 3 and "c" not in heavy
    assert table == sharding.lookup_table(dict(reversed(names.items())), 1009)
    for bad in (({}, 1009), ({"a": 1}, 1000), ({"a": 0}, 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def claimed(shards, slots):
    """The table by its definition: each shard has a list of all slots, and takes turns at claiming the first that is free."""
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:16], 16)
    lists = {}
    for name in shards:
        offset, skip = number(f"offset:{name}") % slots, number(f"skip:{name}") % (slots - 1) + 1
        lists[name] = iter([(offset + skip * j) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for name in sorted(shards):
            for _ in range(shards[name]):
                if len(table) < slots:
                    slot = next(x for x in lists[name] if x not in table)
                    table[slot] = name
    return [table[i] for i in range(slots)]


def test_table_by_its_definition():
    for shards, slots in (({f"s{i}": 1 for i in range(20)}, 1009), ({"a": 3, "b": 1, "c": 0}, 101), ({"only": 1}, 7)):
        assert sharding.lookup_table(shards, slots) == claimed(shards, slots)


def test_sharding_query(spark, sf):
    table = claimed({k: v for k, v in list(queries.SHARDS.items())}, sharding.SLOTS)
    rows = queries.op9_sharding(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])


def test_clashing_slot(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "slot long, skein_shard string")
    placed = sharding.place(df, {"a": 1, "b": 1}, key="slot", slots=101, slot="at")
    assert placed.columns == ["slot", "skein_shard", "at", "shard"] and placed.where("shard IS NULL").count() == 0
    assert sharding.place(df, {"a": 1}, key="slot", slots=101).columns == ["skein_shard", "slot", "shard"]


def test_place_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "x"), (1, "y"), (1, "y"), (2, "z")], "doc_id long, shard string")
    placed = sharding.place(df, {"a": 1, "b": 1}, slots=101)
    assert placed.columns == ["doc_id", "slot", "shard"] and placed.count() == 4 and placed.where("shard IS NULL").count() == 0
    assert placed.where("doc_id = 1").select("shard").distinct().count() == 1
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert sharding.place(df.limit(0), {"a": 1}, slots=101).count() == 0


# -- vectors --------------------------------------------------------------------------------------------------------------------------------


def brute_vectors(rows, least=0.9):
    good = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    part, n = {i: i for i, _ in rows}, Counter()

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(good)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(good[i]) == len(good[j]) and good[i] @ good[j] >= least:
                n[i] += 1
                n[j] += 1
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: (n[i], root(i), root(i) == i) for i, _ in rows}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        base = rng.normal(size=16)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in base + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.5])]) for k in range(int(rng.integers(1, 6)))]
    same = rows[0][1]
    rows += [(500 + i, same) for i in range(40)] + [(600, None), (601, [0.0] * 16), (602, [None] + [1.0] * 15), (603, [float("nan")] * 16), (604, [float("inf")] * 16), (605, []), (606, [1.0, 0.0]), (607, [2.0, 0.0]), (608, [x * 1e150 for x in same])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vector_recall_and_rows(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op5_embedding_near_dedup(spark, sf).collect()}
    assert set(got) == set(want)
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_vectors_of_many_parts(spark, monkeypatch):
    """More shards than chunks of queries, each several."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", 12)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=8) * 0.1]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    want = brute_vectors(rows)
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.97 * sum(w[0] for w in want.values()) and all(got[i][0] <= want[i][0] for i in want)


def test_audit_leaves_out_the_query_itself():
    x = np.eye(6)[[0, 1, 2, 3, 0]].astype(float)
    graph = vectors.Graph(x)
    found = dict(graph.audited(x.astype(np.float32), 0.9, np.arange(5)))
    assert {k: v.tolist() for k, v in found.items()} == {0: [4], 4: [0]}


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32))
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 32)) * 0.1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = vectors.Graph(x).within(x, 0.9)
    truth = [np.flatnonzero(r >= 0.9) for r in x @ x.T]
    assert sum(len(np.intersect1d(f, t)) for f, t in zip(found, truth, strict=True)) >= 0.95 * sum(map(len, truth))


# -- pipeline -------------------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers as P

    from skein.llm import bpe, decontaminate, langid
    from tests.llm.test_words import brute_components, brute_repeats  # noqa: F401

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", F.lit("own").alias("score"), F.lit("own").alias("n_removed"))
    spark_docs = docs
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        after = stage(spark, spark_docs, sf)
        assert after.columns == docs.columns
        before_rows, rows = spark_docs.collect(), after.collect()
        before, kept = {r.doc_id: r.text for r in before_rows}, {r.doc_id: r.text for r in rows}
        if i == 0:
            accepted = {r.doc_id for r in langid.identify(spark_docs.drop("score")).where("accepted").collect()}
            assert set(kept) == accepted and len(kept) >= 0.97 * len(before)
        elif i == 1:
            assert set(kept) == {k for k, (_, c) in brute_components(list(before.items()), 5, 4, 5).items() if k == c}
        elif i == 2:
            want = brute_repeats(list(before.items()), 100)
            assert all(len(kept.get(k, "").encode()) <= w[0] - w[1] for k, w in want.items())
            assert all(kept[k] == before[k] for k, w in want.items() if w[1] == 0) and all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
        else:
            items = [decontaminate.fold(r.text.encode()).strip() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(p in decontaminate.fold(t.encode()) for t in kept.values() for p in items if len(p) >= decontaminate.LEAST_BYTES)
        spark_docs = spark.createDataFrame(rows, after.schema)
    last = pipeline.STAGES[-1][1](spark, spark_docs, sf)
    texts = {r.doc_id: r.text for r in spark_docs.collect()}
    back = bpe.decode(last, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == texts and all(r.n_tokens == len(r.token_ids) for r in back)


def test_pipeline_of_odd_rows(spark, sf):
    """Null and empty texts go at the first stage; repeated rows are one group's and go together or stay together; null ids stay where they are clean."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(12)
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "en", None, 1)], docs.schema)
    clean = docs.orderBy("doc_id").first()
    again = spark.createDataFrame([tuple(clean), (None, *tuple(clean)[1:])], docs.schema)
    rows = docs.unionByName(odd).unionByName(again)
    for _, stage in pipeline.STAGES[:-1]:
        made = stage(spark, rows, sf)
        assert made.columns == docs.columns
        rows = spark.createDataFrame(made.collect(), docs.schema)
    kept = Counter(r.doc_id for r in rows.collect())
    assert not {9000, 9001, 9002} & set(kept) and (clean.doc_id not in kept or kept[clean.doc_id] == 2)


def test_pipeline_of_nothing(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert docs.count() == 0
