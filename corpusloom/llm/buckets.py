"""Links inside banding buckets, verified on whole texts.

Every member of a bucket is compared with its smallest; where that leaves a
bucket in several components, members of all but the largest component meet
the whole bucket in blocks of bounded size, skipping pairs that are connected
already.  So a bucket of copies costs a comparison a member, and no link of a
bucket between different components goes unseen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens as tk
from corpusloom.llm.common import components, cut

BLOCK = 512  # members of a bucket that one task compares with as many
Profile = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]  # hashes, rows and weights of texts


def log_counts(n: int) -> Profile:
    """Shingles of ``n`` words, weighted with 1 + ln count."""
    def run(col: pa.Array):
        h, row, count = tk.weighted(*tk.shingles(tk.words(col), n))
        return h, row, 1 + np.log(count)
    return run


def plain_sets(n: int) -> Profile:
    """Sets of shingles of ``n`` words: the probability Jaccard is the Jaccard similarity."""
    def run(col: pa.Array):
        h, row, _ = tk.weighted(*tk.shingles(tk.words(col), n))
        return h, row, np.ones(len(h))
    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets ``(sorted hashes, weights)``.

    sum over the common items of 1 / sum_j max(a_j / a_i, b_j / b_i): with the
    ratio r_j = b_j / a_j sorted, the inner sums are a suffix of b and a prefix
    of a, so all of them cost one sort.
    """
    (ha, wa), (hb, wb) = a, b
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    low = np.cumsum(x) + only_a                    # items whose ratio is at most this one's count by a
    high = np.cumsum(y[::-1])[::-1] - y + only_b   # the rest by b
    return float((1 / (low / x + high / y)).sum())


def _verify(profile: Profile, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a in range(0, len(batch), 200):
                left, right = profile(batch.column("text_a").slice(a, 200)), profile(batch.column("text_b").slice(a, 200))
                n = min(200, len(batch) - a)
                cl, cr = np.searchsorted(left[1], np.arange(n + 1)), np.searchsorted(right[1], np.arange(n + 1))
                for i in range(n):
                    p, q = slice(cl[i], cl[i + 1]), slice(cr[i], cr[i + 1])
                    keep.append(similarity((left[0][p], left[2][p]), (right[0][q], right[2][q])) >= least - 1e-12)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])
    return run


def _blocks(profile: Profile, least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """All links between two blocks of one bucket; a pair already in one component is skipped."""
        def load(t, side):
            h, row, w = profile(t.column(f"text_{side}"))
            cuts = np.searchsorted(row, np.arange(t.num_rows + 1))
            return t.column(f"id_{side}").to_pylist(), t.column(f"root_{side}").to_pylist(), [(h[i:j], w[i:j]) for i, j in zip(cuts, cuts[1:])]

        ids_a, roots_a, sets_a = load(left, "a")
        ids_b, roots_b, sets_b = load(right, "b")
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        out = []
        for i, a in enumerate(ids_a):
            for j, b in enumerate(ids_b):
                if a == b or find(roots_a[i]) == find(roots_b[j]):
                    continue
                if similarity(sets_a[i], sets_b[j]) >= least - 1e-12:
                    out.append((a, b))
                    parent[find(roots_a[i])] = find(roots_b[j])
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
    return run


def bucket_links(members: DataFrame, texts: DataFrame, profile: Profile, least: float) -> DataFrame:
    """``node, root`` for all ``members(band, id, lead, size)`` that have a link; ``texts(id, text)``.

    A link has a similarity of ``least`` or more.  A bucket of two is settled by its one comparison.
    """
    pairs = members.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(_with_texts(pairs, texts).mapInArrow(_verify(profile, least), "a long, b long"))
    roots = components(links)
    rooted = members.filter("size > 2").join(roots, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    left = cut(rooted.join(split, "band", "left_semi"))
    if left.isEmpty():
        return roots
    return components(links.union(_within_buckets(left, texts, profile, least)))


def members_of(banded: DataFrame) -> DataFrame:
    """Rows ``band, id, lead, size`` of the buckets with two members or more, from distinct ``id, band``."""
    full = banded.groupBy("band").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return cut(banded.join(full, "band"))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")


def _within_buckets(left: DataFrame, texts: DataFrame, profile: Profile, least: float) -> DataFrame:
    """Links inside buckets of several components.

    Members of other components than the bucket's largest are few; each meets
    all members, in blocks of bounded size on both sides.
    """
    sizes = left.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"))
    left = left.join(main, "band")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    number = F.pmod(F.xxhash64("id"), blocks("total"))
    # A pair of outsiders is met once, from its larger side; with the main component an outsider always meets it.
    outside = left.filter("root <> main").select("band", "id", "root", number.alias("x"), F.explode(F.sequence(F.lit(0), blocks("total") - 1)).alias("y"))
    inside = left.select("band", "id", "root", number.alias("y"))
    sides = outside.select("band", "x", "y").distinct()
    inside = inside.join(sides, ["band", "y"])
    a = outside.join(texts, "id").select("band", "x", "y", F.col("id").alias("id_a"), F.col("root").alias("root_a"), F.col("text").alias("text_a"))
    b = inside.join(texts, "id").select(F.col("band").alias("band_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"), F.col("id").alias("id_b"), F.col("root").alias("root_b"), F.col("text").alias("text_b"))
    return cut(a.groupBy("band", "x", "y").cogroup(b.groupBy("band_b", "x_b", "y_b")).applyInArrow(_blocks(profile, least), "a long, b long"))
