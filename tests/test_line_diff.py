"""Line differences against the texts themselves and a longest common subsequence."""

import random

import numpy as np

from corpusloom.operators import line_diff


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def changed(rng, lines):
    out = []
    for x in lines:
        kind = rng.random()
        if kind < 0.1:
            continue
        out.append(x + "!" if kind < 0.2 else x)
        if kind > 0.9:
            out.append(rng.choice(["new", "newer", ""]))
    if rng.random() < 0.3 and len(out) > 3:
        out.append(out.pop(1))
    return out


def test_rising_run():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 40):
        v = rng.permutation(n)
        run = line_diff.rising_run(v)
        assert (np.diff(v[run]) > 0).all() and len(run) == common(v.tolist(), sorted(v.tolist()))


def test_edits_turn_old_into_new(spark):
    rng = random.Random(9)
    pairs = []
    for k in range(40):
        n, repeats = rng.randrange(1, 25), k % 2
        old = [f"line {rng.randrange(6) if repeats else i}" for i in range(n)]
        pairs.append(("\n".join(old), "\n".join(changed(rng, old))))
    pairs += [("a\nb", "a\nb"), ("", "x"), ("x", ""), (None, "a\nb"), ("a", None), (None, None), ("a\na\na", "a\na"), ("x\ny", "x\ny\n")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, old string, new string")
    edits = {i: [] for i in range(len(pairs))}
    for r in line_diff.line_edits(df).collect():
        edits[r["id"]].append(r)
    for i, (old, new) in enumerate(pairs):
        a, b = ([] if t is None else t.split("\n") for t in (old, new))
        gone = {r["old_no"]: r["old_line"] for r in edits[i] if r["old_no"] is not None}
        come = {r["new_no"]: r["new_line"] for r in edits[i] if r["new_no"] is not None}
        assert all(a[k] == v for k, v in gone.items()) and all(b[k] == v for k, v in come.items())
        kept_a, kept_b = ([x for k, x in enumerate(t) if k not in c] for t, c in ((a, gone), (b, come)))
        assert kept_a == kept_b
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(kept_a) == common(a, b)


def test_an_inserted_line_is_one_edit(spark):
    lines = [f"line {i}" for i in range(500)]
    pairs = [(1, "\n".join(lines), "\n".join(["first", *lines])), (1, "\n".join(lines), "\n".join([*lines[:250], *lines[251:]])),
             (2, "\n".join(["same"] * 40), "\n".join(["same"] * 41))]
    got = line_diff.line_edits(spark.createDataFrame(pairs, "id int, old string, new string")).collect()
    assert sorted((r["id"], r["old_no"], r["new_line"]) for r in got if r["new_line"]) == [(1, None, "first"), (2, None, "same")]
    assert [(r["old_no"], r["old_line"]) for r in got if r["new_no"] is None] == [(250, "line 250")]


def test_rows_and_line_rows_agree(spark):
    """Texts compared inside their rows and as line rows have the same edits, row by row."""
    rng = random.Random(4)
    pairs = [(None, "a\n\nb"), ("a", None), ("", "x\n"), ("a\na\nb", "a\nb\nb"), ("x\ny\nx", "x\nx\ny\nx\nz")]
    for k in range(30):
        old = [f"line {rng.randrange(4) if k % 3 else i}" for i in range(rng.randrange(1, 30))]
        pairs.append(("\n".join(old), "\n".join(changed(rng, old))))
    df = spark.createDataFrame([(i if i % 5 else None, *p) for i, p in enumerate(pairs)], "id int, old string, new string")
    order = lambda rows: sorted(rows, key=repr)
    inside = line_diff.line_edits(df)
    assert "Exchange" not in inside._jdf.queryExecution().toString()  # no line is shuffled or written
    apart = line_diff.line_edits(df, long=-1)
    assert inside.schema.names == apart.schema.names and order(inside.collect()) == order(apart.collect())
    mixed = line_diff.line_edits(df, long=120)
    assert order(mixed.collect()) == order(apart.collect())
