"""Day files, sinks, stores, reports and streams on hand-made folders."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.functions import models
from corpusloom.operators import bm25, export, profile, ranking, store, tree
from corpusloom.plans import corpus, ingest, retrieval
from corpusloom.sources import concatenated, day_files, tables
from corpusloom.streaming import ingest as stream
from tests.conftest import record

EMB = models.HashEmbedder(16)


def put(folder, name, rows, sep="\n"):
    (folder / name).write_text(sep.join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")


def test_dirty_day_file(spark, tmp_path):
    rows = [record(1, "ok text"), "", "{broken", record(2, ""), record(3, "   "), {k: v for k, v in record(4, "no title").items() if k != "title"},
            {**record(5, "null title"), "title": None}, {**record(6, "zero"), "timestamp": 0}, {**record(7, " pad "), "exerciseId": "e7"}]
    put(tmp_path, "2025-02-03.jsonl", rows)
    recs = day_files.read_records(spark, str(tmp_path))
    docs = day_files.documents(recs).collect()
    assert sorted(r["text"] for r in docs) == ["no title", "null title", "ok text", "pad", "zero"]
    assert {r["source"] for r in docs} == {"2025-02-03.jsonl"}
    assert [r["line"] for r in day_files.malformed_lines(spark, str(tmp_path)).collect()] == ["{broken"]
    blocks = {r["id"]: r["block"] for r in day_files.day_blocks(recs).where("kind = 1").collect()}
    assert blocks["m4"].startswith("\n## untitled\n### 2025") and blocks["m5"].startswith("\n## untitled")
    assert blocks["m6"] == "\n## t6\nzero"


def test_day_selection(spark, tmp_path):
    for d in ("2025-01-01", "2025-01-03", "2025-01-02"):
        put(tmp_path, f"{d}.jsonl", [record(1, d)])
    assert day_files.read_day(spark, str(tmp_path)).first()["content"] == "2025-01-03"
    assert day_files.read_day(spark, str(tmp_path), "2025-01-02").first()["content"] == "2025-01-02"
    recs = day_files.read_records(spark, str(tmp_path))
    assert day_files.select_day(recs).first()["day"] == "2025-01-03"
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        day_files.read_day(spark, str(empty))


def test_concatenated_objects(spark, tmp_path):
    put(tmp_path, "a.jsonl", ["  " + json.dumps(record(1, "brace } { inside")) + json.dumps(record(2, "two")) + "\n\n" + json.dumps(record(3, "x"))])
    put(tmp_path, "b.jsonl", [json.dumps(record(4, "good")) + '{"id": "m5", bad'])
    recs = concatenated.read_records(spark, str(tmp_path)).orderBy("fname", "obj_no").collect()
    assert [r["id"] for r in recs] == ["m1", "m2", "m3", "m4"] and recs[0]["content"] == "brace } { inside"
    assert concatenated.quarantine(spark, str(tmp_path)).first()["rest"] == '{"id": "m5", bad'


AWKWARD = ['{"id": "a", "content": "}{ \\" [ \\\\"}', '{"id": "b", "x": [{"y": "]"}, {"z": {}}]}', '[{"id": "in a list"}]', "17", '"text { with brace"', "null", '{"id": "é{"}',
           "{}", '{"id": "c"}', " \n\t "]
BROKEN = ['{"id": "d"', "}", '{"id" "e"}', '"open', "]", "{bad}", '\\']


def test_concatenated_values_as_by_one_reader(spark, tmp_path):
    """Any mixture of values and broken parts, cut into many byte ranges, against the decoder on the whole text."""
    rng = random.Random(4)
    texts = {}
    for i in range(30):
        parts = rng.choices(AWKWARD, k=rng.randrange(0, 14))
        if i % 2:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(BROKEN))
        texts[f"f{i:02}.txt"] = rng.choice(["", " ", "\n"]).join(parts)
        (tmp_path / f"f{i:02}.txt").write_text(texts[f"f{i:02}.txt"], encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        values, rest = concatenated.split_pieces(concatenated.pieces(spark, str(tmp_path)))
        got = {name: [] for name in texts}
        for r in values.orderBy("path", "obj_no").collect():
            assert r["obj_no"] == len(got[r["fname"]])
            got[r["fname"]].append(r["value"])
        left = {name: "" for name in texts}
        for r in rest.orderBy("path", "part").collect():
            left[r["fname"]] += r["rest"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in texts.items():
        found, after = concatenated.split_objects(text)
        assert got[name] == found, name
        # The last piece of a file loses a brace that nothing follows.
        assert left[name].strip() in (after.strip(), after.strip().removesuffix("{").strip()), name


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    objects = [json.dumps(record(i, "pay } load { " * 20)) for i in range(3000)]
    put(tmp_path, "big.jsonl", ["".join(objects)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = concatenated.pieces(spark, str(tmp_path))
        assert read.select(F.spark_partition_id()).distinct().count() > 5
        got = concatenated.read_records(spark, str(tmp_path)).orderBy("obj_no").select("id", "obj_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["id"], r["obj_no"]) for r in got] == [(f"m{i}", i) for i in range(3000)]


def test_oversized_values_are_set_aside(spark, tmp_path):
    put(tmp_path, "a.jsonl", [json.dumps(record(1, "x")) + json.dumps(record(2, "{" * 500)) + json.dumps(record(3, "y"))])
    values, rest = concatenated.split_pieces(concatenated.pieces(spark, str(tmp_path)), max_chars=400)
    assert [json.loads(r["value"])["id"] for r in values.collect()] == ["m1"]
    parts = [r["rest"] for r in rest.orderBy("part").collect()]
    assert "".join(parts) == json.dumps(record(2, "{" * 500)) + json.dumps(record(3, "y"))


def test_ingest_is_idempotent(spark, day_clean, tmp_path):
    coll = store.Collection(spark, str(tmp_path / "store"))
    first = ingest.ingest_folder(spark, str(day_clean), coll, embedder=EMB)
    n = first.count()
    nodes = coll.read("nodes", schemas.NODE)
    assert n == 4 and nodes.count() == 4
    assert {r["header_path"] for r in nodes.collect()} == {"/2025-01-02/t1/", "/2025-01-02/t3/", "/2025-01-02/t4/", "/2025-01-02/t3/2025-06-15T15:06:43/"}
    assert ingest.unlisted_files(spark, str(day_clean), coll) == []
    assert ingest.ingest_folder(spark, str(day_clean), coll, embedder=EMB).count() == 0
    put(day_clean, "2025-01-03.jsonl", [record(9, "new\nday")])
    assert [p.rsplit("/", 1)[-1] for p in ingest.unlisted_files(spark, str(day_clean), coll)] == ["2025-01-03.jsonl"]
    taken = []
    def upsert(collection, nodes):
        taken.append(nodes.count())
        collection.insert_new("nodes", nodes, schemas.NODE)
    assert ingest.ingest_folder(spark, str(day_clean), coll, embedder=EMB, upsert=upsert).count() == 1 and taken == [1]
    assert coll.read("nodes", schemas.NODE).count() == 5 and coll.read("vectors", schemas.VECTOR).count() == 5
    assert {r["fname"]: r["n_nodes"] for r in coll.read("files", schemas.LEDGER).collect()} == {"2025-01-02.jsonl": 4, "2025-01-03.jsonl": 1}


def test_refused_texts_are_set_aside(spark, day_clean, tmp_path):
    put(day_clean, "2025-01-04.jsonl", [record(20, "long line " * 50 + "\nmore"), record(21, "short\nline")])
    coll = store.Collection(spark, str(tmp_path / "store"))
    limited = models.LimitedEmbedder(EMB, 60)
    for _ in range(2):
        ingest.ingest_folder(spark, str(day_clean), coll, embedder=limited)
        refused = coll.read("rejects", schemas.REJECT).collect()
        assert len(refused) == 1 and refused[0]["fname"] == "2025-01-04.jsonl" and "cannot exceed 60" in refused[0]["error"]
        ids = {r["id"] for r in coll.read("nodes", schemas.NODE).collect()}
        assert ids == {r["id"] for r in coll.read("vectors", schemas.VECTOR).collect()} and refused[0]["id"] not in ids and len(ids) == 5
        assert {r["fname"]: r["n_nodes"] for r in coll.read("files", schemas.LEDGER).collect()} == {"2025-01-02.jsonl": 4, "2025-01-04.jsonl": 1}


def test_restart_between_vectors_and_ledger(spark, day_clean, tmp_path, monkeypatch):
    coll = store.Collection(spark, str(tmp_path / "store"))
    append = store.Collection.append

    def run():
        stream.start_ingest(stream.record_stream(spark, str(day_clean)), coll, str(tmp_path / "cp"), EMB).awaitTermination()

    def breaks(self, table, rows):
        if table == "files":
            raise RuntimeError("lost")
        append(self, table, rows)
    monkeypatch.setattr(store.Collection, "append", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(store.Collection, "append", append)
    assert coll.read("vectors", schemas.VECTOR).count() == 4 and not coll.exists("files")
    run()
    for name, kind in (("vectors", schemas.VECTOR), ("nodes", schemas.NODE)):
        rows = coll.read(name, kind)
        assert rows.count() == rows.select("id").distinct().count() == 4
    assert [r["n_nodes"] for r in coll.read("files", schemas.LEDGER).collect()] == [4]


def test_stream_ingest_takes_each_file_once(spark, day_clean, tmp_path):
    coll = store.Collection(spark, str(tmp_path / "store"))
    def run():
        q = stream.start_ingest(stream.record_stream(spark, str(day_clean), max_files=1), coll, str(tmp_path / "cp"), EMB)
        q.awaitTermination()
    run()
    assert coll.read("nodes", schemas.NODE).count() == 4
    run()
    put(day_clean, "2025-01-05.jsonl", [record(11, "later\nnote")])
    run()
    assert coll.read("nodes", schemas.NODE).count() == 5
    assert coll.read("files", schemas.LEDGER).count() == 2


def test_stream_of_concatenated_objects(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    coll = store.Collection(spark, str(tmp_path / "store"))
    record_row = T.StructType([T.StructField("id", T.StringType()), T.StructField("content", T.StringType())])
    take = lambda rows, _: coll.insert_new("records", rows.select("id", "content"), record_row)
    for day, ids in (("a", (1, 1, 2)), ("b", (2, 3))):
        put(src, f"{day}.jsonl", ["".join(json.dumps(record(i, f"x{i}")) for i in ids)])
        for _ in range(2):  # the second run finds nothing new
            stream.start_concatenated(spark, str(src), str(tmp_path / "cp"), take).awaitTermination()
    assert sorted((r["id"], r["content"]) for r in coll.read("records", record_row).collect()) == [("m1", "x1"), ("m2", "x2"), ("m3", "x3")]


def test_distinct_stream(spark, tmp_path):
    put(tmp_path, "2025-01-01.jsonl", [record(1, "x"), record(1, "x"), record(2, "y")])
    df = stream.distinct_stream(stream.record_stream(spark, str(tmp_path)))
    df.writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start().awaitTermination()
    assert {r["id"] for r in spark.table("dedup").collect()} == {"m1", "m2"} and spark.table("dedup").count() == 2


def test_dedup_state_forgets(spark, tmp_path):
    """Keys older than the horizon leave the state, so it does not grow for ever."""
    src = tmp_path / "in"
    src.mkdir()
    times = lambda df: df.withColumn("at", F.timestamp_millis("timestamp"))
    for day, start in enumerate((0, 10**8, 2 * 10**8, 3 * 10**8)):
        put(src, f"2025-01-0{day + 1}.jsonl", [record(i + 100 * day, "x", ts=1_750_000_000_000 + start) for i in range(20)] + [record(100 * day, "again", ts=1_750_000_000_000 + start)])
    query = stream.distinct_stream(times(stream.record_stream(spark, str(src), max_files=1)), time_col="at", horizon="1 hour").writeStream.format(
        "memory").queryName("forgets").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("forgets").count() == 80
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 60


def test_collection_guards(spark, tmp_path):
    coll = store.Collection(spark, str(tmp_path), "c")
    with pytest.raises(RuntimeError):
        coll.require_rows("nodes", schemas.NODE)
    rows = spark.createDataFrame([("a", "f", "/", "", 1, "x"), ("a", "f", "/", "", 1, "x")], schemas.NODE)
    coll.insert_new("nodes", rows, schemas.NODE)
    coll.insert_new("nodes", rows, schemas.NODE)
    assert coll.require_rows("nodes", schemas.NODE).count() == 1
    bad = spark.createDataFrame([(None, "f", "/", "", 1, "x")], schemas.NODE)
    with pytest.raises(Exception, match="missing id"):
        coll.insert_new("nodes", bad, schemas.NODE)
    coll.upsert("nodes", rows.withColumn("text", F.lit("new")), schemas.NODE)
    assert coll.read("nodes", schemas.NODE).first()["text"] == "new"


def files_of(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_upsert_rewrites_only_its_buckets(spark, tmp_path):
    kept = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    coll = store.Collection(spark, str(tmp_path), "c", buckets=16, keep=2)
    frame = lambda rows: spark.createDataFrame(rows, kept)
    coll.insert_new("t", frame([(f"k{i}", i) for i in range(500)]), kept)
    coll.upsert("t", frame([("k1", -1)]), kept)  # deals the table out
    before, old = files_of(tmp_path), coll.read("t", kept)
    coll.upsert("t", frame([("k7", -7), ("k7", -7)]), kept)
    assert len(files_of(tmp_path) - before) == 1
    assert {r["id"]: r["n"] for r in coll.read("t", kept).collect()} == {f"k{i}": i if i not in (1, 7) else -i for i in range(500)}
    # A reader of the manifest before still has its files.
    assert {r["n"] for r in old.where("id = 'k7'").collect()} == {7}
    for i in range(4):
        coll.upsert("t", frame([("k7", i), (f"new{i}", i)]), kept)
    coll.insert_new("t", frame([("k7", 99), ("late", 1)]), kept)
    rows = {r["id"]: r["n"] for r in coll.read("t", kept).collect()}
    assert rows["k7"] == 3 and rows["late"] == 1 and len(rows) == 505 == coll.read("t", kept).count()
    # Only folders that the kept manifests name are left.
    named = {d for k in coll._manifests("t") for dirs in coll.manifest("t", k)["parts"].values() for d in dirs}
    assert len(coll._manifests("t")) == 2
    assert {f.split("/")[2] + "/" + f.split("/")[3] for f in files_of(tmp_path) if "/g-" in f} == named
    coll.replace("t", frame([("only", 1)]))
    assert [(r["id"], r["n"]) for r in coll.read("t", kept).collect()] == [("only", 1)]
    with pytest.raises(ValueError):
        coll.upsert("t", frame([("x", 1)]), kept, "n")
    coll.upsert("t", frame([]), kept)
    assert coll.read("t", kept).count() == 1


def test_depths_by_doubling(spark):
    rng = random.Random(1)
    n = 100_000
    chain = spark.range(1, n).selectExpr("id - 1 as parent", "id as child", "0 as ord")
    assert profile.depths(chain).agg(F.max("depth"), F.count("*"), F.sum(F.abs(F.col("depth") - F.col("node") - 1))).first()[:] == (n, n, 0)
    parent = {i: rng.randrange(max(0, i - 3), i) for i in range(1, 300) if i % 50}
    depth = {}
    for i in range(300):
        depth[i] = depth[parent[i]] + 1 if i in parent else 1
    edges = spark.createDataFrame([(p, c, 0) for c, p in parent.items()], "parent bigint, child bigint, ord int")
    got = {r["node"]: r["depth"] for r in profile.depths(edges).collect()}
    assert got == {i: d for i, d in depth.items() if i in parent or i in set(parent.values())}
    diamond = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (1, 3, 0), (2, 4, 0), (4, 3, 0)], "parent bigint, child bigint, ord int")
    assert {r["node"]: r["depth"] for r in profile.depths(diamond).collect()} == {0: 1, 1: 2, 2: 2, 4: 3, 3: 4}
    for loop in ([(1, 2, 0), (2, 3, 0), (3, 1, 0)], [(0, 1, 0), (1, 2, 0), (2, 1, 0)], [(5, 5, 0)]):
        with pytest.raises(ValueError):
            profile.depths(spark.createDataFrame(loop, "parent bigint, child bigint, ord int"))


def test_bm25(spark):
    docs = ["a b c", "a a a d", "b e", "", None, "a b b c d e f g"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    questions = spark.createDataFrame([(1, "A b zz"), (2, "e e"), (3, "zz")], "q_id int, question string")
    hits = questions.select("q_id").crossJoin(corpus).withColumn("score", F.lit(0.5)).withColumn("rank", F.lit(1))
    got = {(r["q_id"], r["id"]): r["bm25"] for r in bm25.scores(hits, questions, corpus).collect()}
    words = [(t or "").split() for t in docs]
    mean = sum(map(len, words)) / len(words)
    for q, text in ((1, ["a", "b", "zz"]), (2, ["e"]), (3, ["zz"])):
        for i, w in enumerate(words):
            want = 0
            for t in text:
                df = sum(t in x for x in words)
                tf = w.count(t)
                if df:
                    want += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            assert abs(got[q, i] - want) < 1e-9
    best = bm25.rerank(hits, questions, corpus, 1).where("q_id = 1").first()
    assert best["id"] == max(range(6), key=lambda i: got[1, i]) and best["rank"] == 1


def test_provider_errors(spark):
    df = spark.createDataFrame([(1, ([1.0], None)), (2, (None, "input Cannot exceed 5"))], "id int, result struct<vec:array<float>,error:string>")
    good, bad = store.vectors_or_rejects(df)
    assert [r["id"] for r in good.collect()] == [1] and [r["id"] for r in bad.collect()] == [2]
    df = spark.createDataFrame([(1, (None, "boom"))], "id int, result struct<vec:array<float>,error:string>")
    with pytest.raises(Exception, match="boom"):
        store.vectors_or_rejects(df)[0].collect()


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([(i, f"/h{i}/", f"body {i}", i % 3) for i in range(7)], "id int, header_path string, text string, cluster int")
    export.write_blocks(export.flat_blocks(nodes), str(tmp_path / "flat"), single=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "flat").glob("part-*")))
    assert text == "".join(f"### /h{i}/\nbody {i}\n\n" for i in range(7))
    export.write_blocks(export.flat_blocks(nodes, ascending=False), str(tmp_path / "parts"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert text == "".join(f"### /h{i}/\nbody {i}\n\n" for i in reversed(range(7)))
    titles = spark.createDataFrame([(0, "zero")], "cluster int, title string")
    export.write_blocks(export.cluster_blocks(nodes, titles=titles), str(tmp_path / "cl"), single=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "cl").glob("part-*")))
    assert text.startswith("# Cluster 0 (3) — zero\n\n### /h0/\nbody 0") and "# Cluster 1 (2)\n\n### /h1/" in text
    export.write_documents_json(nodes, str(tmp_path / "json"))
    line = json.loads(next((tmp_path / "json").glob("part-*")).read_text().splitlines()[0])
    assert list(line)[0] == "text"


def test_daily_report_and_empty_day(spark, day_clean, tmp_path):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "zzz unknown")], "q_id bigint, question string")
    corpus.daily_report(spark, str(day_clean), str(tmp_path / "out"), EMB, q, token_cap=1000, reranker=models.overlap_reranker)
    page = "".join(p.read_text() for p in (tmp_path / "out" / "report.md").glob("part-*"))
    assert page.startswith("---\nconfig:\n  theme: redux\n") and "# Daily FAQ — 2025-01-02" in page
    assert "## Q1. alpha beta" in page and "## Sources\n[^1]: " in page
    run = json.loads(next((tmp_path / "out" / "report.run.json").glob("part-*")).read_text())
    assert run["docs_loaded"] == 4 and run["nodes_embedded"] == 4
    md = next((tmp_path / "out" / "report.run.md").glob("part-*")).read_text()
    assert "- Docs loaded: **4**" in md
    (day_clean / "2025-02-01.jsonl").write_text("")
    corpus.daily_report(spark, str(day_clean), str(tmp_path / "out2"), EMB, q, day="2025-02-01")
    page = "".join(p.read_text() for p in (tmp_path / "out2" / "report.md").glob("part-*"))
    assert page.endswith("# Daily FAQ — 2025-02-01\n\n_No notes found._\n")


@pytest.fixture(scope="module")
def tiny_tree(spark):
    texts = {0: "red apple", 1: "green apple", 2: "blue sky", 3: "grey sky", 4: "apple colours", 5: "sky colours", 6: "all colours"}
    layers = {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    nodes = spark.createDataFrame([(i, layers[i], t) for i, t in texts.items()], "node_id bigint, layer int, text string")
    nodes = nodes.withColumn("embeddings", F.create_map(F.lit(EMB.name), EMB(F.col("text"))))
    edges = spark.createDataFrame([(4, 0), (4, 1), (5, 2), (5, 3), (5, 1), (6, 4), (6, 5)], "parent bigint, child bigint")
    return tree.Tree(nodes, edges, 2)


def test_tree_search(spark, tiny_tree, tmp_path):
    q = spark.createDataFrame([(1, "green apple"), (2, "blue sky")], "q_id bigint, question string")
    top = tree.search_collapsed(tiny_tree, q, EMB, top_k=1).collect()
    assert {(r["q_id"], r["node_id"]) for r in top} == {(1, 1), (2, 2)}
    down = tree.search_layers(tiny_tree, q, EMB, 2, 3, top_k=1)
    assert [(r["step"], r["node_id"]) for r in down.where("q_id = 1").orderBy("step").collect()] == [(0, 6), (1, 4), (2, 1)]
    far = tree.search_layers(tiny_tree, q, EMB, 1, 1, selection="threshold", threshold=-1.0)
    assert far.count() == 4
    out = tree.retrieve(tiny_tree, q, EMB, collapse_tree=False, top_k=1, return_layer_information=True).where("q_id = 1").first()
    assert out["context"] == "all colours\n\napple colours\n\ngreen apple\n\n"
    assert [tuple(x) for x in out["layer_information"]] == [(6, 2), (4, 1), (1, 0)]
    for bad in ({"start_layer": 9}, {"num_layers": 5}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            tree.retrieve(tiny_tree, q, EMB, **bad)
    assert {r["q_id"]: r["answer"] for r in tree.answer(tiny_tree, q, EMB).collect()} == {1: "green apple", 2: "blue sky"}
    tables.write_tree(tiny_tree.nodes, tiny_tree.edges, str(tmp_path))
    nodes, edges = tables.read_tree(spark, str(tmp_path))
    assert nodes.count() == 7 and edges.count() == 7
    with pytest.raises(TypeError):
        schemas.require(edges, schemas.TREE_NODE, "edges")
    d = {r["node"]: r["depth"] for r in profile.depths(tiny_tree.edges).collect()}
    assert d[6] == 1 and d[4] == 2 and d[1] == 3


def test_tree_build(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{i % 4}x{j % 9} thing{i}." for j in range(60))) for i in range(12)], "doc_id bigint, text string")
    leaves = tree.leaves(docs, EMB)
    built = tree.build(leaves, EMB, max_components=4, passes=5)
    n0, rest = built.leaves.count(), built.nodes.where("layer > 0").count()
    assert built.num_layers >= 1 and rest < n0
    layer = {r["node_id"]: r["layer"] for r in built.nodes.collect()}
    edges = built.edges.collect()
    assert all(layer[e["parent"]] == layer[e["child"]] + 1 for e in edges)
    assert {e["parent"] for e in edges} == {i for i, l in layer.items() if l > 0}
    below = {i for i, l in layer.items() if l < built.num_layers}
    assert below == {e["child"] for e in edges}


def test_retrieval_token_cap_and_flat_index(spark):
    docs = spark.createDataFrame([(i, f"note {i} about topic{i % 3} " * 10, "s", None, None) for i in range(9)],
                                 "id int, text string, source string, ts_ms bigint, exercise_id string")
    q = spark.createDataFrame([(1, "topic1 note")], "q_id bigint, question string")
    c = retrieval.index(docs, EMB)
    capped = retrieval.retrieve(q, c, EMB, token_cap=60, cutoff=None)
    assert capped.count() == 1
    assert retrieval.retrieve(q, c, models.HashEmbedder(8), cutoff=None).count() == 0
    none = retrieval.answer_context_only(q, retrieval.retrieve(q, c, EMB, cutoff=2.0)).first()
    assert none["answer"] == "_No passages found._" and none["citations"] == []
    flat = retrieval.flat_index(docs.select("id", "text"), "id", EMB).withColumnRenamed("id", "cid")
    assert flat.count() >= 9
    chain = ranking.postprocess(capped, [lambda d: d.where("rank = 1"), lambda d: d.select("id")])
    assert chain.columns == ["id"]
