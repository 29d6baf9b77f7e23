"""Duplicates, repeats, language models and classifiers against brute force and planted cases."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import buckets, katz, langid, paragraphs, perplexity, probminhash, quality, stages
from corpusloom.llm import tokens as tk
from corpusloom.llm.common import components, remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, band string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", 1) for i, t, lang, src in rows], DOCS)


def prose(rng, n, vocabulary=None):
    words = vocabulary or ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    return [rng.choice(words) for _ in range(n)]


def folded(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def shingle_weights(text):
    w = folded(text)
    c = collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {k: 1 + math.log(n) for k, n in c.items()}


def probability_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in set(a) & set(b))


def classes(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_words_in_slices(monkeypatch):
    monkeypatch.setattr(tk, "SLICE", 7)
    texts = ["", None, "a bb  ccc\n\té É x", "longerthanaslice " * 3, " ", "end"]
    w = tk.words(pa.array(texts))
    assert [list(w.data[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])) for a, b in zip(w.bounds, w.bounds[1:])] == [
        [x.encode() for x in WORD.findall(t or "")] for t in texts]
    assert len(set(w.hash)) == len({x for t in texts for x in folded(t)})


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 330)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes([e for e in edges if e[0] != e[1]], {x for e in edges for x in e})
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {i: want[i] for i in linked}


def test_exact_probability_jaccard_and_registers():
    rng = random.Random(2)
    for _ in range(20):
        a = {rng.randrange(60): rng.choice([1, 1, 1.7, 3]) for _ in range(40)}
        b = {rng.randrange(60): rng.choice([1, 1, 2.1]) for _ in range(30)}
        pack = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
        assert buckets.similarity(pack(a), pack(b)) == pytest.approx(probability_jaccard(a, b))
    m = 4096
    h = tk.mix(np.array([*a, *b], np.uint64))
    sig = probminhash.signatures(h, np.array([0] * len(a) + [1] * len(b)), np.array([*a.values(), *b.values()]), 2, m)
    assert (sig[0] == sig[1]).mean() == pytest.approx(probability_jaccard(a, b), abs=0.04)


def near_copy(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = "new%d" % rng.randrange(10 ** 6)
    return " ".join(out)


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for _ in range(12):
        base = prose(rng, 150)
        for edits in (0, 0, 1, 2, 2, 3, 30, 150):
            rows.append((i, near_copy(rng, base, edits), "en", "s"))
            i += 1
    chain = prose(rng, 200)
    for _ in range(30):  # each is close to the next only
        rows.append((i, " ".join(chain), "en", "s"))
        at = rng.randrange(200)
        chain[at] = "step%d" % i
        i += 1
    rows += [(i, None, "en", "s"), (i + 1, "", "en", "s"), (i + 2, "", "en", "s"), (i + 3, "Two words", "en", "s"), (i + 4, "two words", None, None),
             (None, rows[0][1], "en", "s"), (2, rows[2][1], "en", "s"), (i + 5, "x " * 3000, "en", "s"), (i + 6, "x " * 2999, "en", "s")]
    df = docs_of(spark, rows)
    got = collections.defaultdict(set)
    for r in probminhash.near_duplicates(df).collect():
        got[r["doc_id"]].add(r["class_id"])
    sets = {d: shingle_weights(t) for d, t, _, _ in rows if d is not None}
    ids = [d for d in sets if sets[d]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if probability_jaccard(sets[a], sets[b]) >= 0.8 - 1e-9]
    want = classes(links, sets)
    assert {d: next(iter(c)) for d, c in got.items() if d is not None} == want and all(len(c) == 1 for c in got.values())
    kept = sorted(r["doc_id"] for r in stages.one_of_each(df).filter("doc_id is not null").collect())
    assert kept == sorted(d for d in want if want[d] == d)
    assert probminhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_bucket_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BLOCK", 4)
    rng = random.Random(9)
    texts = []
    for _ in range(3):
        base = prose(rng, 120)
        texts += [near_copy(rng, base, 1) for _ in range(6)]
    members = spark.createDataFrame([(1, i, 0, len(texts)) for i in range(len(texts))], "band long, id long, lead long, size long")
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["node"]: r["root"] for r in buckets.bucket_links(members, table, buckets.plain_sets(5), 0.8).collect()}
    assert got == {i: i // 6 * 6 for i in range(len(texts))}


def test_repeated_paragraphs(spark):
    rng = random.Random(4)
    passage, line, once = prose(rng, 70), prose(rng, 30), prose(rng, 60)
    own = [prose(rng, 200, ["w%d" % rng.randrange(10 ** 6) for _ in range(200)]) for _ in range(20)]
    text = [" ".join(w) for w in own]
    for k in (3, 6, 9):
        text[k] = " ".join([*own[k][:50 + k], *passage, *own[k][50 + k:]])
    text[4] += "\n" + " ".join(line) + "\nend"
    text[5] = " ".join([*line[:29], "other"]) + "\n" + text[5]
    text[7] = " ".join(once) + "\n" + " ".join(once) + "\n" + text[7]  # inside one document only
    rows = [(i, t, "en", "s") for i, t in enumerate(text)] + [(30, None, "en", "s"), (31, "", "en", "s"), (None, text[3], "en", "s"), (3, text[3], "en", "s")]
    df = docs_of(spark, rows)
    found = paragraphs.repeated_paragraphs(df).collect()
    assert {r["doc_id"] for r in found if r["removed"]} == {5, 6, 9} and {r["doc_id"] for r in found} == {3, 4, 5, 6, 9}
    assert all(r["keeper_id"] == (3 if r["doc_id"] in (3, 6, 9) else 4) for r in found)
    after = {r["doc_id"]: r for r in paragraphs.without_repeats(df).filter("doc_id is not null").collect()}
    assert set(after) == {r[0] for r in rows if r[0] is not None}
    for i, t in enumerate(text):
        if i not in (5, 6, 9):
            assert after[i]["text"] == t
    joined = " ".join(passage)
    assert sum(joined in (r["text"] or "") for r in after.values()) == 1
    assert all(set(own[i]) <= set(after[i]["text"].split()) and after[i]["n_chars"] == len(after[i]["text"]) for i in range(20))
    assert paragraphs.repeated_paragraphs(docs_of(spark, [])).count() == 0
    assert paragraphs.without_repeats(docs_of(spark, [])).count() == 0


def test_whole_passages_and_wrapped_paragraphs(spark):
    """Every planted passage of 51 to 200 words is covered from its first to its last word, and nothing around it."""
    rng = random.Random(12)
    own = lambda n: ["u%d" % rng.randrange(10 ** 9) for _ in range(n)]
    rows, spans = [], {}
    for k in range(120):
        n = rng.choice([51, 51, 52, 60, 100, 200])
        passage = [own(2 + k % 4), own(1)][k % 9 == 0] * n if k % 3 == 0 else own(n)
        passage = passage[:n]
        for copy in range(2):
            before, after = own(rng.randrange(40)), own(rng.randrange(40))
            rows.append((2 * k + copy, " ".join([*before, *passage, *after]), "en", "s"))
            spans[2 * k + copy] = (len(" ".join([*before, ""])), len(" ".join(passage)))
    text = own(60)
    wrapped = "\n".join(" ".join(text[i:i + 10]) for i in range(0, 60, 10))
    edited = " ".join(["other" if i == 30 else x for i, x in enumerate(text)])
    rows += [(900, edited + "\n" + " ".join(own(80)), "en", "s"), (901, " ".join(own(80)) + "\n\n" + wrapped + "\n\n" + " ".join(own(80)), "en", "s")]
    found = paragraphs.repeated_paragraphs(docs_of(spark, rows)).collect()
    seen = collections.defaultdict(set)
    for r in found:
        if r["kind"] == "passage" or r["doc_id"] >= 900:
            seen[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        assert r["removed"] == (r["doc_id"] % 2 == 1)
    for i, (start, length) in spans.items():
        assert seen[i] == set(range(start, start + length))
    at = rows[-1][1].index(wrapped)
    assert seen[901] == set(range(at, at + len(wrapped))) and {r["kind"] for r in found if r["doc_id"] == 901} == {"block", "passage"}


def brute_katz(train, texts):
    """Plain dictionaries; start context, one end token a text."""
    uni, bi = collections.Counter(), collections.defaultdict(collections.Counter)
    for t in train:
        w = [*folded(t), None]
        uni.update(w)
        for a, b in zip([0, *w], w):
            bi[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    count = lambda cs: [sum(c == r for c in cs) for r in range(1, katz.K + 2)]
    d1, d2 = katz.discounts(count(uni.values())), katz.discounts(count([c for x in bi.values() for c in x.values()]))
    kept = lambda c, d: c * (d[c] if c <= katz.K else 1)
    seen = sum(kept(c, d1) for c in uni.values()) / n
    scale1 = 1 if seen < 1 else n / (n + 1)
    unknown = 1 - seen * scale1
    p1 = lambda w: kept(uni[w], d1) / n * scale1 if w in uni else unknown

    def p(w, a):
        if a not in bi:
            return p1(w)
        total, own = sum(bi[a].values()), sum(kept(c, d2) for c in bi[a].values())
        scale = 1 if total - own > 1e-9 * total else total / (total + 1)
        if w in bi[a]:
            return kept(bi[a][w], d2) * scale / total
        return (1 - own * scale / total) / max(1 - sum(p1(x) for x in bi[a]), unknown) * p1(w)

    for a in [*list(bi)[:30], "nowhere"]:
        assert sum(p(w, a) for w in uni) + p("never seen", a) == pytest.approx(1)
    out = []
    for t in texts:
        w = [*folded(t), None]
        out.append((len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(x, a)) for a, x in zip([0, *w], w))))
    return out


def test_katz(spark, monkeypatch):
    rng = random.Random(5)
    common = ["the", "of", "A", "and"] + ["v%d" % i for i in range(60)]
    rows = [(i, " ".join(rng.choice(common[: rng.choice([4, 64])]) for _ in range(rng.randrange(0, 120))), "en", "s") for i in range(80)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (None, "the of", "en", "s"), (3, rows[3][1], "en", "s"), (102, "only here ÉÉ", "en", "s")]
    df = docs_of(spark, rows)
    out = remainder(F.col("doc_id"), 7) == 2
    held = {r["doc_id"] for r in df.filter(out).collect()}
    want = brute_katz([t for i, t, _, _ in rows if i not in held], [t for _, t, _, _ in rows])

    def check():
        got = collections.defaultdict(list)
        for r in katz.katz_scores(df, out).collect():
            assert r["held_out"] == (r["doc_id"] in held)
            got[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
        for (i, *_), w in zip(rows, want):
            assert any(g == pytest.approx(w) for g in got[i])
        assert sum(map(len, got.values())) == len(rows)

    check()
    real = katz.parts_for
    monkeypatch.setattr(katz, "parts_for", lambda s, n, per: real(s, n, 300))
    monkeypatch.setattr(katz, "LEAST_SPREAD", 1)  # frequent contexts spread over groups
    check()
    assert katz.katz_scores(docs_of(spark, []), out).count() == 0
    assert katz.katz_scores(df, F.lit(True)).count() == len(rows)


def test_perplexity(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = [(i, ". ".join(" ".join(prose(rng, 12, vocabulary)) for _ in range(6)), "en", "s") for i in range(120)]
    rows += [(200, "ZQ|*#XX%% &&<>" * 30 + " kjq" * 25, "en", "s"), (201, "few words", "en", "s"), (202, None, None, None), (203, "", "en", "s"),
             (204, "a b c d e f g h i j k\n" * 9, "en", "s"), (None, rows[0][1], "xx", "s"), (5, rows[5][1], "en", "s"), (205, "\n \n x\n\nx\n", None, "s")]
    got = perplexity.perplexity_rules(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t, _, _ in rows:
        w, t = WORD.findall(t or ""), t or ""
        eight = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        mark, seen, lines = [0] * len(w), set(), 0
        for k in range(len(w) - 7):
            if eight[tuple(w[k:k + 8])] > 1:
                mark[k:k + 8] = [1] * 8
        for x in t.split("\n"):
            if WORD.search(x):
                lines += x in seen
                seen.add(x)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, sum(mark))
        assert all((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want for r in by[i])
        assert all(r["base_failed"] == (len(w) < 20 or 100 * sum(mark) > 30 * len(w)) for r in by[i])
    assert all(by[i][0]["kept"] for i in range(120)) and not any(by[i][0]["kept"] for i in (200, 201, 202, 203, 204))
    key = np.unique(perplexity.packed(*tk.buffers(pa.array([t for _, t, _, _ in rows[:50]]))))
    levels = perplexity.kneser_ney(key, np.ones(len(key), np.int64) + key % 4)
    for ctx in [*(key[:5] >> 5), 12345]:
        assert np.exp(perplexity.log_probability(levels, (ctx << 5) + np.arange(32))).sum() == pytest.approx(1)
    assert perplexity.perplexity_rules(docs_of(spark, [])).count() == 0


def test_perplexity_bands_reject_partly_spoilt_texts(spark):
    """Texts with a few spoilt words leave the bands; bands of eight deviations kept them."""
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    texts = [prose(rng, 120, vocabulary) for _ in range(300)]
    for w in texts[:20]:
        for k in rng.sample(range(120), 12):
            w[k] = "".join(rng.choice("bcdfghjklmpqvwxyz") for _ in range(5))
    df = docs_of(spark, [(i, " ".join(w), "en", "s") for i, w in enumerate(texts)])
    kept = {r["doc_id"] for r in perplexity.perplexity_rules(df).filter("kept").collect()}
    assert len(kept & set(range(20))) <= 5 and len(kept) >= 0.98 * 280
    wide = {r["doc_id"] for r in perplexity.perplexity_rules(df, spread=8.0, least=0.15).filter("kept").collect()}
    assert len(wide & set(range(20))) > 10


def test_short_texts_do_not_reach_into_the_next():
    alone = perplexity.packed(*tk.buffers(pa.array(["xyz"])))
    for before in (["a"], ["ab", ""], ["", "abcdef"]):
        assert perplexity.packed(*tk.buffers(pa.array([*before, "xyz"])))[-3:].tolist() == alone.tolist()


def test_quality(spark):
    rng = random.Random(7)
    good = [" ".join(prose(rng, rng.randrange(40, 300))).capitalize() + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, rng.randrange(40, 300))) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*good, *bad])]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(1, None, 1), (2, 7, 0), (None, 1, 0)], "doc_id long, quality int, held_out int")
    rows += [(400, None, "en", "s"), (401, "", "en", "s"), (None, "words " * 9, "en", "s"), (3, rows[3][1], "en", "s"), (402, "z " * 50_000, "en", "s")]
    got = quality.quality_scores(docs_of(spark, rows), labels, remainder(F.col("doc_id"), 4) == 2).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 40 and sum(r["predicted"] == int(r["doc_id"] < 150) for r in held if r["doc_id"] < 300) >= 0.97 * len(held)
    none = quality.quality_scores(docs_of(spark, rows[:5]), labels.limit(0), F.lit(False)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(docs_of(spark, []), labels, F.lit(False)).count() == 0


def test_languages(spark):
    rng = random.Random(8)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "sch"], "cc": ["é", "que", "ment"]}
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(sounds))
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randrange(5, 60))), lang, "s"))
    rows += [(300, None, "aa", "s"), (301, "", "aa", "s"), (302, "12 !?", "bb", "s"), (303, "kaka", None, "s"), (None, "kalomi", "aa", "s"), (5, rows[5][1], rows[5][2], "s")]
    df = docs_of(spark, rows)
    got = langid.predict_languages(df, remainder(F.col("doc_id"), 4) != 2).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang, _ in rows[:240])
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (300, 301, 302)) and by[303]["lang_pred"] == "aa"
    assert {r["lang_pred"] for r in langid.predict_languages(df.limit(9), F.lit(False)).collect()} == {"und"}
    assert langid.predict_languages(docs_of(spark, []), F.lit(True)).count() == 0
    assert {r["doc_id"] for r in stages.identified(df).collect()} == {r[0] for r in rows} - {300, 301, 302}


def test_every_language_is_learned(spark):
    """More than 64 languages, the rare ones with few texts: each is recognised."""
    rng = random.Random(13)
    sounds = ["".join(chr(0x3041 + rng.randrange(20)) if k % 2 else rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for k in range(480)]
    rows = []
    for k in range(80):
        own = sounds[6 * k:6 * k + 6]
        for _ in range(12 if k < 64 else 8):
            rows.append((len(rows), " ".join("".join(rng.choice(own) for _ in range(2)) for _ in range(40)), "l%02d" % k, "s"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(docs_of(spark, rows), F.lit(True)).collect()}
    assert len({got[i] for i, *_ in rows}) == 80
    assert sum(got[i] == lang for i, _, lang, _ in rows) >= 0.99 * len(rows)
    kept = {r["doc_id"]: r["lang"] for r in stages.identified(docs_of(spark, rows)).collect()}
    assert {kept.get(i) for i, _, lang, _ in rows if lang == "l79"} == {"l79"}


def test_passages_are_not_matched_with_their_places(spark):
    """Passages carry their class through the text: no join whose rows are the passages of all documents."""
    passage = " ".join(f"w{i}" for i in range(70))
    docs = docs_of(spark, [(i, f"{passage} own{i} tail{i}", "en", "s") for i in range(6)])
    found = paragraphs.repeated_paragraphs(docs)
    assert " windows" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines(True) if "Join" in x)
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "pos#" in x]
    got = {(r["doc_id"], r["start"], r["length"], r["n_words"], r["class_size"], r["keeper_id"]) for r in found.where("kind = 'passage'").collect()}
    assert got == {(i, 0, len(passage), 70, 6, 0) for i in range(6)}


def test_removals_are_not_cut_at_the_edits_of_other_copies(spark):
    """Near copies, each with edits of its own: the removed characters are those of the passages, in a number of rows that does not grow with the copies."""
    rng = random.Random(21)
    base = ["w%d" % i for i in range(600)]
    rows = []
    for i in range(24):
        words = list(base)
        for at in range(10 + i * 2, 600, 150):
            words[at] = "e%d_%d" % (i, at)
        # Lines of 8 words, each a paragraph too short to be compared: passages only.
        rows.append((i, "\n\n".join(" ".join(words[a:a + 8]) for a in range(0, 600, 8)), "en", "s"))
    rng.shuffle(rows)
    docs = docs_of(spark, rows)
    chars = lambda found: {(r["doc_id"], x) for r in found for x in range(r["start"], r["start"] + r["length"])}
    whole = paragraphs.repeated_paragraphs(docs).where("removed").collect()
    spans = paragraphs.removed_spans(docs).collect()
    assert chars(spans) == chars(whole)
    assert len(spans) <= 8 * len(rows) < len(whole) / 4
