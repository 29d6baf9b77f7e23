"""Top-k search, WARC archives, packing and mixing against brute force, SQL and round trips."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import mixing, packing, queries, vafile, warc
from tests import oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, band string, row int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", 1) for i, t, lang, src in rows], DOCS)


def brute_top(rows, k, every):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v] + [0] * (8 - len(v))
        best[i] = min(best.get(i, w), w)
    out = []
    for q in sorted(best):
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(best[q], best[i])), i) for i in best if i != q)[:k]
            out += [(q, r, i, -v) for r, (v, i) in enumerate(s, 1)]
    return out


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 60)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 4)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, list(rows[7][1])) for i in range(300, 330)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, []), (410, [0.5]),
             (5, list(rows[5][1])), (6, [9.0] * 8), (420, [1e5] * 8), (421, [-1e5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = sorted(map(tuple, vafile.top_products(df, every=10).collect()))
    assert got == brute_top(rows, 5, 10)
    assert vafile.top_products(df.limit(0)).count() == 0
    assert vafile.top_products(df.filter("vec_id = 0")).count() == 0


@pytest.mark.parametrize("name", ["op1_vector_approximation", "op6_warc_revisits", "op10_pfair_mixing"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert oracle.spark_rows(queries.QUERIES[name](spark, sf)) == oracle.sql_rows(oracle.connect(sf), queries.SQL[name])


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né\n\n"
    rows = [(5, "http://a", tricky), (3, "http://b\r\nX: y", tricky), (9, None, tricky), (1, "u", None), (2, "u", ""), (4, "u", "own"), (4, "u", "own"),
            (None, "u", "own"), (7, "u", "z" * 5000), (6, "u", "z" * 5000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, refers_to string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect()), key=repr)
    size = len(tricky.encode())
    assert got == sorted([(3, size, "response", None), (5, size, "revisit", 3), (9, size, "revisit", 3), (1, 0, "response", None), (2, 0, "revisit", 1),
                          (4, 3, "response", None), (4, 3, "response", None), (None, 3, "response", None), (6, 5000, "response", None),
                          (7, 5000, "revisit", 6)], key=repr)
    least = {r["page_id"]: r["record_type"] for r in warc.archived(pages, least_bytes=4).collect()}
    assert least[2] == "response" and least[7] == "revisit"
    assert warc.archived(pages.limit(0)).count() == 0


def test_tokens_are_the_tokenizers(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, own = packing._encoder(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    pieces = ["a", " ", "  ", "\n", "\t", " ", "　", "é", "it's", "12", "!!", "<|endoftext|>", "word", "Straße", "漢字", "\r\n", "\x1f", "x y"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice(["", "", " "]) for _ in range(rng.randrange(9)))
        assert np.frombuffer(encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gam", "x"]) for _ in range(rng.choice([1, 30, 300, 900, 2500, 5000]))), "en", "s") for i in range(150)]
    rows += [(200, None, None, None), (201, "", "en", "s"), (None, "a b", "en", "s"), (3, rows[3][1], "en", "s")]
    got = packing.packed_sequences(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True).toPandas()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _, _ in rows}
    assert len(got.drop_duplicates(["sequence_id", "offset"])) == len(got)
    for seq, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 2048
    total = 0
    for doc, g in got.groupby("doc_id", dropna=False):
        g, full = g.sort_values(["piece"]), ids[None if np.isnan(doc) else int(doc)]
        for r in g.itertuples():
            part = np.array(full[r.start:r.start + r.length], "<u4").tobytes()
            assert part == r.ids and zlib.crc32(part) == r.ids_crc32 and (r.length == 2048 or r.piece == 0)
        total += g.length.sum()
    assert total == sum(len(ids[r[0]]) for r in rows)
    rooms = []  # best-fit decreasing over the same pieces
    for n in sorted(got.length, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        i = min(fits, key=rooms.__getitem__) if fits else rooms.append(2048) or len(rooms) - 1
        rooms[i] -= n
    assert got.sequence_id.nunique() <= 1.01 * len(rooms) + 1
    assert packing.packed_sequences(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_best_fit_places_every_piece():
    rng = random.Random(5)
    for _ in range(50):
        small = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 513), 20)}
        rooms = {n: rng.randrange(1, 10) for n in rng.sample(range(1, 2048), 10)}
        moves, opened = packing.best_fit(small, rooms)
        left = {(r, i): r for r, n in rooms.items() for i in range(n)} | {(packing.FRESH, i): 2048 for i in range(opened)}
        placed = dict.fromkeys(small, 0)
        for size, first, n, kind, lo in moves:
            assert first == placed[size]
            placed[size] += n
            for i in range(lo, lo + n):
                left[kind, i] -= size
                assert left[kind, i] >= 0
        assert placed == small


def test_mixing_deviates_by_less_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 50)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 5)
    rng = random.Random(4)
    rows = [(i, "t" * rng.randrange(0, 120), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    rows += [(None, None, "en", "b"), (5, "ttt", "en", "a"), (5, "ttt", "en", "a")]
    parts = spark.createDataFrame([("a", 5), ("b", 3), ("", 2)], "source string, parts long")
    got = mixing.schedule(docs_of(spark, rows), parts).collect()
    assert len(got) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    slots = {r["slot"]: r["source"] for r in got}
    blocks = {(r["source"], r["block"]): r["slot"] for r in got}
    assert len(slots) == len(blocks)
    one = {r["source"]: r for r in mixing.period_slots(parts).collect()}
    assert sorted(s for r in one.values() for s in r["slots"]) == list(range(10))
    for r in one.values():
        for t in range(1, 11):
            assert abs(sum(s < t for s in r["slots"]) - t * r["parts"] / 10) < 1
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append((r["place"], rows))
    assert all(min(p for p, _ in x) == 0 for x in by.values())
    assert mixing.schedule(docs_of(spark, [])).count() == 0
    assert mixing.in_schedule_order(docs_of(spark, rows)).count() == len(rows)


def test_schedule_of_default_weights_equals_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 700)
    sf = "/root/testdata/sf0.001"
    sql = mixing.SQL.replace("65536", "700")
    assert oracle.spark_rows(mixing.schedule(spark.read.parquet(f"{sf}/documents.parquet"))) == oracle.sql_rows(oracle.connect(sf), sql)


def test_queries_for_all_blocks_do_not_go_through_the_driver(spark, monkeypatch):
    """The queries, repeated for every block, meet the blocks as groups, not by a join that Spark may broadcast."""
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 60)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    plan = vafile.top_products(df, every=10)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan
