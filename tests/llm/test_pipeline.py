"""The pipeline on a small table against its parts done by hand."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import mixing, stages
from tests.llm.test_text_operators import docs_of, near_copy, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "stru") for b in ("mi", "ne", "ta") for c in range(200)]
    texts = [" ".join(prose(rng, 150, vocabulary)) for _ in range(30)]
    passage = " ".join(prose(rng, 80, vocabulary))
    texts[4] += " " + passage
    texts[8] = passage + " " + texts[8]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(50, texts[0], "en", "s0"), (51, near_copy(rng, texts[1].split(), 2), "en", "s1"), (52, None, "en", "s0"), (53, "12345", "en", "s0"), (54, texts[0], None, None)]
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mixed", "packed"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = sorted(r["doc_id"] for r in docs.collect())
        assert left == ([*range(30), 50, 51, 54] if i == 0 else list(range(30)))
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(after[i] == texts[i] for i in range(30) if i != 8)
    assert passage not in after[8] and set(texts[8].split()) - set(passage.split()) <= set(after[8].split())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(range(30))
    ends = {}
    for r in packed:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in ends.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and max(a + n for a, n in parts) <= 2048


def test_sequences_follow_the_mixed_order(spark, tmp_path):
    """The order in which mixing stores the documents decides the numbers of the sequences."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "stru", "mi") for b in range(90)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(500)), "en", f"s{i % 5 // 2}") for i in range(40)]  # no two fit a sequence
    docs = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    mixed = stages.mixed(spark, docs, "")
    mixed.write.parquet(str(tmp_path / "mixed"))
    for name, order in (("mixed", None), ("up", F.asc("doc_id")), ("down", F.desc("doc_id"))):
        if order is not None:
            docs.repartitionByRange(3, order).sortWithinPartitions(order).write.parquet(str(tmp_path / name))
    slots = {r["doc_id"]: (r["slot"], r["source"], r["place"]) for r in mixing.schedule(docs).collect()}
    want = {"mixed": sorted(slots, key=slots.get), "up": list(range(40)), "down": list(range(39, -1, -1))}
    for name, ids in want.items():
        got = stages.packed(spark, spark.read.parquet(str(tmp_path / name)), "").collect()
        firsts = {}
        for r in got:
            firsts[r["sequence_id"]] = min(firsts.get(r["sequence_id"], 99), ids.index(r["doc_id"]))
        assert sorted(firsts) == list(range(len(firsts))) and len(firsts) >= 20
        assert [firsts[i] for i in sorted(firsts)] == sorted(firsts.values())
