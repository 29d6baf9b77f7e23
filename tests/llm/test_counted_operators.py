"""Resampling, exact duplicates and phrases against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import collocations, crc, radix, resampling, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, n long, row int, digit string, phrase string, _no int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "x", 1, 1, "d", "p", 0) for i, t, lang in rows], DOCS)


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def prose(rng, n, size=60):
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5))) for _ in range(size)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


AWKWARD = [None, "", " \t\n", "...", "A a É é A", "x" * 5000, "one.two,three;ONE", "日本 語 日本", "a\x00b c\x0bd"]


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 70_000])
def test_crc_of_any_substring(size):
    rng = random.Random(size)
    data = rng.randbytes(size)
    ends = [sorted(rng.randrange(size + 1) for _ in range(2)) for _ in range(100)]
    start, end = np.array(ends).T
    got = crc.RunningCrc(np.frombuffer(data, np.uint8)).between(start, end)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in ends]


@pytest.mark.parametrize("cut_at", [1, 3, 17, 1 << 20])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_runs_of_words_in_slices(monkeypatch, cut_at, n):
    monkeypatch.setattr(runs, "SLICE", cut_at)
    texts = [*AWKWARD, "end of it. Then, more", *AWKWARD]
    got = collections.Counter()
    for part in runs.slices(pa.chunked_array([texts]), collocations.WORD, collocations.PIECE_ENDS, back=n - 1):
        at = part.first_words(n)
        found = collocations.spans(part.data, part.start[at], part.end[at + n - 1]).to_pylist()
        got.update(zip(part.row[at].tolist(), found))
    want = collections.Counter()
    for row, text in enumerate(texts):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update((row, " ".join(words[i:i + n])) for i in range(len(words) - n + 1))
    assert got == want


# Resampling ---------------------------------------------------------------

def resampled_by_hand(docs, target, max_words, buckets, least, share):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall(low(text))
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        f, n = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    drawn = len(able) * share[0] // share[1]
    ranked = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return sorted([*ranked, *[(*r[:4], None) for r in rows if r[4] < least]], key=repr)


@pytest.mark.parametrize("max_words", [1, 3])
def test_resampling(spark, max_words):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randrange(5, 60))) for i in range(60)]
    docs += [(100 + i, t) for i, t in enumerate(AWKWARD)] + [(None, docs[7][1]), (7, docs[7][1]), (7, docs[7][1]), (200, "word " * 30_000)]
    target = [prose(rng, 40) for _ in range(5)] + [None, ""]
    frame = docs_of(spark, [(i, t, "en") for i, t in docs]).repartition(5)
    got = resampling.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), max_words=max_words, buckets=50, share=(1, 3))
    rows = sorted([tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()], key=repr)
    assert rows == resampled_by_hand(docs, target, max_words, 50, 20, (1, 3))


def test_resampling_of_nothing(spark):
    none = docs_of(spark, [])
    assert resampling.resampled(none, none.select("text")).collect() == []
    only = resampling.resampled(docs_of(spark, [(1, "a b", None)]), none.select("text")).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in only] == [(1, 2, None)]


# Exact duplicates ---------------------------------------------------------

def test_exact_duplicates(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 40)) for _ in range(25)]
    # Texts that part only after many bytes, at block borders and inside characters.
    base += ["y" * n for n in (63, 64, 65, 511, 512, 513, 575, 576, 577, 5000)]
    base += ["p" * 3000 + end for end in ("", "a", "b", "é", "è")] + ["z" * 2_000_000 + end for end in "ab"] + ["é" * 32, "é" * 31 + "è"]
    texts = base + [t.upper() if t.isascii() else t for t in rng.choices(base, k=80)] + AWKWARD + AWKWARD + [base[3]] * 150
    rng.shuffle(texts)
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, ""), (None, base[0]), (None, "only null"), (4, texts[4]), (4, texts[4])]
    got = radix.exact_duplicates(docs_of(spark, [(i, t, "en") for i, t in docs]).repartition(6)).collect()
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[low(t)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        want.update((i, keep, len(ids), digest) for i in ids)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_duplicates_of_nothing(spark):
    assert radix.exact_duplicates(docs_of(spark, [])).collect() == []


# Phrases ------------------------------------------------------------------

def phrases_by_hand(docs, least, most, best, covered):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i:i + n])) for n in range(1, most + 1) for i in range(len(w) - n + 1))
    phrases = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in phrases.items():
        if any(q_lang == lang and len(q) > len(p) and covered[1] * f >= covered[0] * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (q_lang, q), f in phrases.items()):
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((" ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        rows += [(lang, i + 1, *r) for i, r in enumerate(found[:best])]
    return sorted(rows)


@pytest.mark.parametrize("least, most, best, bits", [(10, 3, 2000, 1 << 20), (4, 4, 7, 1 << 20), (2, 2, 2000, 64)])
def test_phrases(spark, monkeypatch, least, most, best, bits):
    monkeypatch.setattr(collocations, "HELD", 50)
    rng = random.Random(least)
    docs = [(prose(rng, rng.randrange(1, 80), 25).replace("e ", rng.choice([". ", "\t ", "  "])), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    docs += [(t, "en") for t in AWKWARD] * 6 + [("new york city hall", "en")] * 20 + [("same words " * 4000, "fr")]
    frame = docs_of(spark, [(i, t, lang) for i, (t, lang) in enumerate(docs)]).repartition(5)
    got = collocations.collocations(frame, least_count=least, max_words=most, per_language=best, bits=bits)
    rows = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect())
    assert rows == phrases_by_hand(docs, least, most, best, (50, 100))


def test_phrases_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).collect() == []
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, "a b", None)])).collect() == []


@pytest.mark.parametrize("capacity", [1, 8, 64, 1000])
def test_summary_keeps_every_frequent_key(capacity):
    rng = np.random.default_rng(capacity)
    keys = np.concatenate([rng.integers(0, 2000, 4000), rng.integers(0, 40, 1500), np.zeros(900, np.int64)])
    rng.shuffle(keys)
    true = collections.Counter(keys.tolist())
    halves = []
    for half in np.array_split(keys, 2):
        summary = collocations.MisraGries(10, capacity)
        for batch in np.array_split(half, 60):
            summary.add(*np.unique(batch, return_counts=True))
        summary.frequent()
        assert summary.lost < 10
        halves.append(summary)
    first = collections.Counter(np.array_split(keys, 2)[0].tolist())
    assert {k for k, n in first.items() if n >= 10} <= set(halves[0].frequent().tolist())
    for k, c in zip(halves[0].keys.tolist(), halves[0].counts.tolist()):
        assert first[k] - halves[0].lost <= c <= first[k]
    if halves[0].lost + halves[1].lost < 10:
        halves[0].merge(halves[1])
        assert {k for k, n in true.items() if n >= 10} <= set(halves[0].frequent().tolist())
    else:
        with pytest.raises(ValueError):
            halves[0].merge(halves[1])


def test_slices_of_a_long_text_are_small():
    """The arrays of a slice take many times its bytes, and several workers share an executor."""
    text = "abcdefg " * 700_000
    parts = list(runs.slices(pa.array([text]), collocations.WORD, collocations.PIECE_ENDS, 2))
    assert max(len(p.data) for p in parts) < 1.5 * (1 << 20) and collocations.HELD <= 1 << 19
    assert sum(len(p.start) - p.carried for p in parts) == 700_000
