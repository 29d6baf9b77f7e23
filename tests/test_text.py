"""Scalar functions against plain Python."""

import hashlib
import textwrap

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunking, ids, models
from corpusloom.functions import text as tx
from corpusloom.functions import vectors as vx
from corpusloom.operators import filters, polish, sectioning

TEXTS = ["", "  a  b \t c\n", " x y　", "one...two   three....", "line1\r\nline2\rline3\n", "\x1cweird\x1f words",
         "a" * 150, "word " * 60, "é😀 " * 50, "\n\n"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")


def values(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_strip_and_normalize(texts):
    t = F.col("text")
    assert values(texts, tx.strip(t)) == [s.strip() for s in TEXTS]
    assert values(texts, tx.normalize(t)) == [" ".join(s.split()) for s in TEXTS]
    assert values(texts, tx.word_count(t)) == [len(s.split()) for s in TEXTS]


def test_clean_basic(texts):
    def clean(s):
        s = s.strip().replace("...", "…")
        while "  " in s:
            s = s.replace("  ", " ")
        return s
    assert values(texts, tx.clean_basic(F.col("text"))) == [clean(s) for s in TEXTS]


def test_flatten_lines(texts):
    assert values(texts, tx.flatten_lines(F.col("text"))) == [" ".join(s.splitlines()) for s in TEXTS]


def test_shorten_matches_textwrap(texts):
    got = values(texts, tx.shorten(F.col("text"), 100, " …"))
    assert got == [textwrap.shorten(s, 100, placeholder=" …") for s in TEXTS]


def test_token_estimates(texts):
    assert values(texts, tx.tokens_ceil(F.col("text"))) == [0 if not s else max(1, (len(s) + 3) // 4) for s in TEXTS]
    assert values(texts, tx.tokens_floor(F.col("text"))) == [max(1, len(s) // 4) for s in TEXTS]


def test_labels_and_templates(spark):
    df = spark.createDataFrame([(1, None, 0, "src"), (2, "e1", 5, "src"), (3, "", 7, None), (4, None, None, None)],
                               "rank int, ex string, ts bigint, source string")
    label = tx.citation_label(F.col("rank"), F.col("ex"), F.col("ts"), F.col("source"))
    assert [r[0] for r in df.orderBy("rank").select(label).collect()] == ["src", "e1", "7", "node-4"]
    out = df.select(tx.section_block(F.lit("h"), F.lit("b"), "{header}: <{body}> {header}").alias("s")).first()["s"]
    assert out == "h: <b> h"


def test_uids(spark):
    df = spark.createDataFrame([("t", "/a/", "f", 5), ("t", None, None, None)], "text string, hp string, f string, ts bigint")
    cols = [F.col(c) for c in ("text", "hp", "f", "ts")]
    keys = ["t/a/f5", "t"]
    got = df.select(ids.stable_uid(*cols).alias("a"), ids.stable_uid_blake2s(*cols).alias("b")).collect()
    assert [r["a"] for r in got] == [hashlib.sha256(k.encode()).hexdigest()[:32] for k in keys]
    assert [r["b"] for r in got] == [hashlib.blake2s(k.encode(), digest_size=16).hexdigest() for k in keys]


def test_chunks_respect_limit_and_keep_words(spark):
    long = "w " * 600 + ", " + "v " * 300 + ". Short one! " + "abc " * 50 + "?\n" * 3
    df = spark.createDataFrame([(0, long), (1, "A. B. C."), (2, " . \n ")], "i int, text string")
    rows = chunking.explode_chunks(df, chunking.split_text(F.col("text"), 100), "i").orderBy("i", "chunk_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r["i"], []).append(r["text"])
    assert by[1] == ["A  B  C"] and 2 not in by
    words = " ".join(by[0]).split()
    assert words == [w for w in long.replace(",", " ").replace(".", " ").replace("!", " ").replace("?", " ").split()]
    # A clause over the limit has no delimiter left to split at and stays whole.
    assert [len(c) for c in by[0]][0] > 400


def test_overlapping_chunks_repeat_text(spark):
    text = " ".join(f"Sentence number {i} has a few words." for i in range(200))
    df = spark.createDataFrame([(0, text)], "i int, text string")
    chunks = df.select(chunking.overlapping_chunks(F.col("text"), 100, 20).alias("c")).first()["c"]
    assert len(chunks) > 5
    for a, b in zip(chunks, chunks[1:]):
        first = b.split(". ")[0]
        assert first in a
        assert (len(b) + 3) // 4 <= 101 + len(b) // 20
    assert all(f"number {i} " in " ".join(chunks) for i in range(200))


def test_split_with_unit_overlap(spark):
    df = spark.createDataFrame([(0, "aaaa aaaa. bbbb bbbb. cccc cccc. dddd dddd")], "i int, text string")
    got = df.select(chunking.split_text(F.col("text"), 6, overlap=1).alias("c")).first()["c"]
    assert got == ["aaaa aaaa  bbbb bbbb", " bbbb bbbb  cccc cccc", " cccc cccc  dddd dddd"]


MD = ("intro text\n# One\nbody 1\n## Two\n```\n# not a heading\n```\nbody 2\n### Three\nx\n## Four\ny\n# Five\nz\n#hash\n"
      "#### Deep\nq")


@pytest.mark.parametrize("large", [False, True])
def test_sections(spark, large):
    df = spark.createDataFrame([("d", MD)], "doc string, text string")
    rows = sectioning.sections(sectioning.lines_of(df, "doc"), ["doc"], large_groups=large).orderBy("section_no").collect()
    assert [(r["header_path"], r["text"].split("\n")[0]) for r in rows] == [
        ("/", "intro text"), ("/", "# One"), ("/One/", "## Two"), ("/One/Two/", "### Three"), ("/One/", "## Four"),
        ("/", "# Five"), ("/Five/", "#### Deep")]
    assert "# not a heading" in rows[2]["text"] and rows[5]["text"] == "# Five\nz\n#hash"


def test_section_length_guard(spark):
    df = spark.createDataFrame([("d", "# a\nshort\n# b\n" + "long " * 100)], "doc string, text string")
    rows = sectioning.sections(sectioning.lines_of(df, "doc"), ["doc"], large_groups=True, max_chars=50).collect()
    assert [r["header"] for r in rows] == ["a"]


def test_line_changes(spark):
    df = spark.createDataFrame([(1, "  a\nb  c\nsame"), (2, "same")], "id int, text string")
    rows = {(r["line_no"], r["old_line"], r["new_line"]) for r in polish.line_changes(df).collect()}
    assert rows == {(0, "  a", "a"), (1, "b  c", "b c")}


def test_vectors_and_metrics(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(*[vx.distance(F.col("a"), F.col("b"), m).alias(m) for m in vx.METRICS]).first()
    assert got["L1"] == 3 and got["Linf"] == 2 and abs(got["L2"] - 5 ** 0.5) < 1e-12
    assert abs(got["cosine"] - (1 - 1 / 5 ** 0.5)) < 1e-12
    with pytest.raises(ValueError):
        vx.distance(F.col("a"), F.col("b"), "other")
    assert df.select(vx.to_float_vector(F.col("a"), 3).alias("v")).first()["v"] is None


def test_memberships(spark):
    df = spark.createDataFrame([([0.05, 0.5, 0.45],), ([0.1, 0.9],)], "p array<double>")
    assert [r[0] for r in df.select(filters.memberships(F.col("p"))).collect()] == [[1, 2], [1]]


def test_plugins(spark):
    assert models.get_embedder("hash-32").dim == 32
    with pytest.raises(ValueError):
        models.get_embedder("unknown")
    df = spark.createDataFrame([("Cats sleep. Dogs bark loudly. Cats purr.", "do dogs bark")], "c string, q string")
    row = df.select(models.extractive_answer(F.col("c"), F.col("q")).alias("a"),
                    models.extractive_summary(F.col("c"), 8).alias("s"),
                    models.overlap_reranker(F.col("q"), F.col("c")).alias("r")).first()
    assert row["a"] == "Dogs bark loudly" and row["s"].endswith(".") and abs(row["r"] - 2 / 3) < 0.34
