"""Near duplicates, repeated lines, classifiers, images and neighbours against brute force and held-out cases."""

import collections
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowdex.llm import ann, common, jaccard, licences, line_dedup, media, toxicity

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("bdfglmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 5))) for _ in range(900)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(text, changes, rng=RNG):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def copies_fixture():
    base, hot = [prose(RNG.randint(60, 200)) for _ in range(40)], prose(150)
    passage = prose(60)
    texts = []
    for b in base:
        texts += [b, b] + [near(b, RNG.randint(1, 6)) for _ in range(RNG.randint(0, 4))]
    texts += [near(hot, RNG.randint(0, 4)) for _ in range(400)] + [prose(100) + " " + passage + " " + prose(100) for _ in range(150)]
    return texts + ["", None, "  ", "one two", "one two", "one  two", "x" * 10_000]


def test_jaccard_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    texts = copies_fixture()
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a row without an id and nine words in it")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, links int")
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sets = {(t or ""): frozenset(jaccard.shingles(t).tolist()) for _, t in rows}
    names = list(sets)
    links, parent = collections.Counter(), {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            u = len(sets[a] | sets[b])
            if (not u) or len(sets[a] & sets[b]) >= 0.8 * u - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        c = find(t or "")
        least[c] = min(least.get(c, 10**9), -1 if i is None else i)
    for r in got:
        c = least[find(r["text"] or "")]
        assert (r["class_id"], r["links"]) == (None if c == -1 else c, links[r["text"] or ""])
    kept = jaccard.keep_one(docs).collect()
    assert len(kept) == len(least)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_keeps_each_class_without_ids_or_with_a_shared_id(spark):
    rng = random.Random(12)
    a, b, c, d, e = (prose(80, rng) for _ in range(5))
    rows = [(None, a), (4, a), (None, b), (5, b), (6, b), (None, c), (None, c), (7, d), (7, e), (8, e)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(None, a), (None, b), (None, c), (7, d), (7, e)])
    by = collections.defaultdict(set)
    for r in jaccard.near_duplicates(docs).collect():
        by[r["class_id"], r["class_text"]].add(r["text"])
    assert sorted(map(list, by.values())) == sorted([a] for a in (a, b, c, d, e))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(5000, i) for i in range(1000, 1300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(220)] + [(7, 7)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r["v"]: r["label"] for r in jaccard.components(spark, spark.createDataFrame(edges, "v long, w long")).collect()}
    assert got == {v: find(v) for v in got} and set(root) - set(got) <= {v for v in root if all(v not in e or e[0] == e[1] for e in edges)}
    assert jaccard.components(spark, spark.createDataFrame([], "v long, w long")).count() == 0


def test_similar_in_blocks():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 60, 3000).astype(np.uint64))
    sets = [np.unique(np.where(rng.random(len(base)) < 0.9, base, rng.integers(0, 1 << 60, len(base)).astype(np.uint64))) for _ in range(20)] + [base[:5]]
    want = {(i, j) for i in range(21) for j in range(i + 1, 21) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    a, b = jaccard.similar_in(sets, 0.8, np.triu(np.ones((21, 21), bool), 1))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    side = (np.arange(21) >= 9).astype(int)
    links, root = jaccard.join_within(5, np.ones(21, int), sets, [[5]] * 21, side, 0.8)
    assert links.sum() == 2 * len([1 for i, j in want if i < 9 <= j])
    # pairs that share a lesser leaf are compared there
    links, _ = jaccard.join_within(5, np.ones(21, int), sets, [[3, 5] if i < 10 else [5] for i in range(21)], np.zeros(21, int), 0.8)
    assert links.sum() == 2 * len([1 for i, j in want if not (i < 10 and j < 10)])


def test_word_hashes_follow_split():
    texts = [near(prose(50), 3) + t for t in (" a\u3000b\x1cc", "\n\n", "", " \U0001f600x x\U0001f600 ab ba", "\ud800 \ud800")] + ["", " ", "x"]
    seen = {}
    for t in texts:
        got = jaccard._word_hashes(t).tolist()
        assert len(got) == len(t.split())
        assert all(seen.setdefault(w, h) == h for w, h in zip(t.split(), got, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_groups_cut_by_batches():
    """Groups that begin in one batch and end in another give what they give in one piece, and small groups share a call."""
    rng = np.random.default_rng(6)
    rows = []
    for leaf in range(30):
        base = np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64))
        for k in range(rng.integers(1, 9)):
            one = np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 1 << 60, len(base)).astype(np.uint64), base))
            rows += [{"leaf": leaf, "p": 0, "q": 0, "side": 0, "s1": 10 * leaf + k, "s2": 7, "texts": 1 + k, "leaves": [leaf], "grams": one.tobytes()}] * (1 + (k == 3))
    schema = pa.schema([(c, pa.int64()) for c in ("leaf", "p", "q", "side", "s1", "s2", "texts")] + [("leaves", pa.list_(pa.int64())), ("grams", pa.binary())])
    whole = pa.RecordBatch.from_pylist(rows, schema=schema)
    want = {}
    for leaf in range(30):
        own = {r["s1"]: r for r in rows if r["leaf"] == leaf}
        sets = [np.frombuffer(r["grams"], np.uint64) for r in own.values()]
        links, root = jaccard.join_within(leaf, np.array([r["texts"] for r in own.values()]), sets, [[leaf]] * len(sets), np.zeros(len(sets), int), 0.8)
        want |= {s: (links[i], list(own)[root[i]]) for i, s in enumerate(own) if len(own) > 1}
    for size in (1, 5, 17, len(rows)):
        out = list(jaccard._joined([whole.slice(at, size) for at in range(0, len(rows), size)], 0.8))
        assert {r["s1"]: (r["links"], r["r1"]) for b in out for r in b.to_pylist()} == want and sum(b.num_rows for b in out) == len(want)
    assert len(out) == 2 and any(x for x, _ in want.values())
    assert list(jaccard._joined([], 0.8)) == []


def test_runs_reach_recall():
    assert jaccard.runs_for() < jaccard.COORDINATES
    assert jaccard.runs_for(0.9) < jaccard.runs_for(0.999)


def test_line_dedup(spark):
    rng = random.Random(3)
    passages = [[prose(60, rng)], [prose(10, rng) for _ in range(6)], [prose(30, rng), prose(25, rng)], [prose(5, rng) for _ in range(14)]]
    short = prose(12, rng)
    rows = []
    for i in range(80):
        blocks = [[prose(rng.choice([3, 8, 20, 40]), rng)] for _ in range(rng.randint(0, 6))]
        blocks += [rng.choice(passages) for _ in range(rng.randint(0, 2))] + [[rng.choice(["", short])]] * (rng.random() < 0.3)
        rng.shuffle(blocks)
        rows.append((i, "\n".join(x for b in blocks for x in b)))
    rows += [(None, rows[5][1]), (7, rows[7][1]), (100, None), (101, ""), (102, "\n".join(["a b"] * 100)), (103, prose(40_000, rng))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed_lines string")
    out = line_dedup.drop_repeated_lines(docs).collect()
    assert len(out) == len(rows)
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    kept = "\n\0\n".join(r["text"] or "" for r in out)
    for p in passages:
        assert kept.count("\n".join(p)) == 1
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert by[100][0]["text"] is None and by[101][0]["text"] == "" and by[102][0]["text"] == "a b" and by[103][0]["text"] == rows[-1][1]
    # what goes has GRAM_WORDS words and stands earlier; what is short or alone stays
    before = collections.Counter()
    lines_of = lambda t: [x for x in (t or "").split("\n") if x.strip()]
    original = {(r[0], r[1]): r[1] for r in rows}
    every = set()
    for r in sorted(out, key=order):
        full = next(t for (i, t) in original if i == r["doc_id"])
        raw = (full or "").split("\n")
        for run in r["removed_lines"]:
            words = sum(len(x.split()) for x in raw[run["s"] : run["e"] + 1])
            assert words >= line_dedup.GRAM_WORDS
            assert all(x in every or raw.index(x) < run["s"] for x in raw[run["s"] : run["e"] + 1] if x.strip())
        every |= set(lines_of(full))
    assert kept.count(short) > 5  # too short to be a run by itself
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_lines_that_an_earlier_text_holds_in_part(spark):
    rng = random.Random(13)
    new = lambda *n: [prose(k, rng) for k in n]
    one, two, three = new(30, 25), new(*[10] * 6), new(70, 80)
    texts = [one[:1] + new(40), new(8) + one + new(9), new(7) + one + new(40), new(12) + one]
    texts += [new(40) + two[:5] + new(9), two + new(30), new(35) + two, new(5) + three[:1], new(5) + three + new(6), new(4) + [three[0], "", three[1]] + new(4)]
    docs = spark.createDataFrame(list(enumerate("\n".join(t) for t in texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    # by brute force: a line goes if it is in a run of GRAM_WORDS words or more that stands earlier
    for i, t in enumerate(texts):
        gone = set()
        for s in range(len(t)):
            for e in range(s, len(t)):
                run = [x for x in t[s : e + 1] if x]
                lines = [[x for x in texts[j] if x] for j in range(i)]
                if sum(len(x.split()) for x in run) >= line_dedup.GRAM_WORDS and any(h[k : k + len(run)] == run for h in lines for k in range(len(h))):
                    gone |= set(range(s, e + 1))
        assert got[i]["text"].split("\n") == ([x for k, x in enumerate(t) if k not in gone] or [""]), i
    every = "\n".join(r["text"] for r in got.values())
    for x in one + two + three:
        assert every.count(x) == 1


def test_lines_of_long_texts_and_clashing_columns(spark):
    rng = random.Random(17)
    run = [prose(20, rng) for _ in range(3)]
    rows = [
        (1, "\n".join(["same line"] * 100_000), "a", 1, 1, 1),
        (2, "\n".join(prose(12, rng) for _ in range(5_000)), "b", 2, 2, 2),
        (3, "\n".join(x for _ in range(1_000) for x in [prose(8, rng), *run]), "c", 3, 3, 3),
        (4, "\n".join(run), "d", 4, 4, 4),
        (4, "\n".join(run), "e", 5, 5, 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, _k long, _th long, _inst long")
    got = sorted(line_dedup.drop_repeated_lines(docs).collect(), key=lambda r: r["_k"])
    assert [list(r.asDict())[:6] for r in got][0] == ["doc_id", "text", "a.b", "_k", "_th", "_inst"]
    assert [(r["doc_id"], r["a.b"], r["_k"], r["_th"], r["_inst"]) for r in got] == [(r[0], *r[2:]) for r in rows]
    # whole stretches before: 15 lines make 30 words
    assert got[0]["text"].count("same line") < 20 and got[1]["text"] == rows[1][1]
    assert all(got[2]["text"].count(x) == 1 for x in run) and len(got[2]["removed_lines"]) == 999
    assert got[3]["text"] == got[4]["text"] == ""
    assert [r["removed_lines"] for r in line_dedup.drop_repeated_lines(docs).filter("doc_id = 3").collect()] == [got[2]["removed_lines"]]


def toxic_texts(n, rng, held=False):
    stems = ["grobnik", "snarvel", "plozzer", "quimfart"]
    rows = []
    for i in range(n):
        s = [prose(rng.randint(4, 12), rng) for _ in range(rng.randint(2, 6))]
        toxic = int(rng.random() < 0.4)
        if toxic:
            w = rng.choice(stems)
            if held and rng.random() < 0.5:
                k = rng.randrange(2, len(w) - 1)
                w = rng.choice([w[:k] + "." + w[k:], w[:k] + rng.choice("xyz") + w[k:], " ".join(w)])
            s.insert(rng.randint(0, len(s)), "you are a " + w + " " + rng.choice(WORDS))
        rows.append((". ".join(s), toxic))
    return rows


def test_toxicity_held_out():
    rng = random.Random(5)
    model = toxicity.fit(toxic_texts(500, rng))
    test = toxic_texts(300, rng, held=True)
    p = toxicity.score_texts(model, [t for t, _ in test])
    y = np.array([t for _, t in test])
    assert (p[y == 0] < toxicity.THRESHOLD).mean() > 0.99
    assert (p[y == 1] >= toxicity.THRESHOLD).mean() > 0.85
    order = p.argsort()
    ranks = np.empty(len(p))
    ranks[order] = np.arange(len(p))
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.95


def test_kernel_is_the_sum_over_shared_subsequences():
    def slow(a, b):
        import itertools

        f = [collections.Counter() for _ in range(2)]
        for x, c in zip((a, b), f, strict=True):
            for t in itertools.combinations(range(len(x)), toxicity.ORDER):
                c["".join(x[i] for i in t)] += toxicity.DECAY ** (t[-1] - t[0] + 1)
        dot = lambda u, v: sum(u[k] * v[k] for k in u)
        return dot(*f) / np.sqrt(dot(f[0], f[0]) * dot(f[1], f[1]))

    words = ["banana", "bandana", "bxaxnana", "grob", "банан", "бандана", "баран"]
    f = toxicity.features(words, toxicity.columns(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(float(f[i] @ f[j]) - slow(a, b)) < 1e-5


def test_scores_are_those_of_the_kernel_machine():
    import itertools

    model = toxicity.fit(toxic_texts(200, random.Random(11)))
    vector = model.vector

    def slow(word):
        c = collections.Counter()
        for t in itertools.combinations(range(len(word)), toxicity.ORDER):
            c["".join(word[i] for i in t)] += toxicity.DECAY ** (t[-1] - t[0] + 1)
        point = lambda x: ord(x) - 97 if "a" <= x <= "z" else toxicity.LATIN + ord(x) % (toxicity.SIDE - toxicity.LATIN)
        at = lambda s: (point(s[0]) * toxicity.SIDE + point(s[1])) * toxicity.SIDE + point(s[2])
        return sum(w * float(vector[at(s)]) for s, w in c.items()) / np.sqrt(sum(w * w for w in c.values())) + model.bias

    texts = [t for t, _ in toxic_texts(30, random.Random(12))] + ["a bb c", "", "только чистый текст", "aaaa bbbb", "你好世界", "ok " * 50 + "x" * 500]
    for text, p in zip(texts, toxicity.score_texts(model, texts), strict=True):
        found = [slow(u) for w in toxicity.tokens(text) for u in toxicity.units(w) if len(u) >= toxicity.ORDER]
        margin = max(found, default=toxicity.NOTHING)
        assert abs(p - 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))) < 1e-4, text
    assert len({round(float(p), 9) for p in toxicity.score_texts(model, [prose(3) for _ in range(50)])}) > 25  # clean texts are ranked too


def test_toxicity_rows(spark):
    rng = random.Random(6)
    texts = toxic_texts(300, rng)
    rows = [(i, t) for i, (t, _) in enumerate(texts)] + [(1000, None), (1001, ""), (None, "x"), (1002, "é " * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, None, y) for i, (_, y) in enumerate(texts)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_rows(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    truth = {i: y for i, (_, y) in enumerate(texts)}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9
    none = toxicity.toxicity_rows(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1
    assert toxicity.toxicity_rows(docs.limit(0), labels).count() == 0


def test_licences(spark):
    model = licences.train()
    for family, notices in licences.TEMPLATES.items():
        for notice in notices:
            found = licences.scan(model, f"{prose(30)}\n{notice}\n{prose(10)}")
            assert family in {f[0] for f in found if f[2]}, (family, notice, found)
    for s in licences.PROSE:
        assert not [f for f in licences.scan(model, s) if f[2]], s
    rows = [(1, "Some text.\nLicensed under the Apache License, Version 2.0."), (2, None), (3, ""), (4, prose(50_000)), (1, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licences int")
    got = {(r["doc_id"], (r["text"] or "")[:4]): r["licences"] for r in licences.scan_licences(docs, model).collect()}
    assert [x["family"] for x in got[(1, "Some")]] == ["apache-2.0"] and got[(1, "Some")][0]["line"] == 1
    assert got[(2, "")] == [] and got[(3, "")] == [] and len(got) == 5
    assert licences.licence_rows(docs.limit(0)).count() == 0


#: Notices and prose that the fit never sees.
HELD_NOTICES = [
    ("apache-2.0", "This project is distributed under the Apache License, Version 2.0; see http://www.apache.org/licenses/LICENSE-2.0 for its terms."),
    ("apache-2.0", "You may not use these files except in compliance with the Apache License, Version 2.0."),
    ("mit", "This library is released under the terms of the MIT License."),
    ("mit", "to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistributions in binary form must retain the above copyright notice, this list of conditions and the following disclaimer in the documentation."),
    ("bsd", "Use of this source code is governed by a BSD-style license which can be found in the root folder."),
    ("gpl", "The tool is free software under the GNU General Public License, version 3 or any later version."),
    ("gpl", "You can redistribute this script and modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "The shared library is licensed under the GNU Lesser General Public License, version 2.1 or later."),
    ("agpl", "The server is licensed under the GNU Affero General Public License, version 3 only."),
    ("mpl-2.0", "These files are subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "The text is available under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Its contents are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Photographs are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "The data are dedicated to the public domain under CC0 1.0."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted, provided that the above copyright notice appears in all copies."),
    ("epl", "The plug-in is made available under the terms of the Eclipse Public License 2.0."),
    ("unlicense", "The scripts are free and unencumbered software released into the public domain."),
    ("gfdl", "The manual may be copied under the terms of the GNU Free Documentation License, Version 1.3."),
    ("proprietary", "All rights reserved. No part of this book may be reproduced without the written permission of the author."),
]
HELD_PROSE = [
    "The council granted a fishing license to every resident of the island.",
    "Students need permission from the teacher to leave the room without notice.",
    "The general in command published his memoirs as a public figure.",
    "The second version of the report was free of errors and came with a list of sources.",
    "Copies of the painting were distributed without restriction among the merchants.",
    "A warranty of two years covers the engine and any particular parts.",
    "The foundation was established to restore the common library of the town.",
    "The original source of the river was found under the rocks.",
    "Conditions on the road were subject to change without warning.",
    "He reserved all rights to comment on the published terms.",
]


def test_licences_of_held_out_notices():
    model = licences.train()
    sure = [{f[0] for f in licences.scan(model, t) if f[2]} for _, t in HELD_NOTICES]
    right = sum(name in found for (name, _), found in zip(HELD_NOTICES, sure, strict=True))
    wrong = sum(len(found - {name}) for (name, _), found in zip(HELD_NOTICES, sure, strict=True))
    wrong += sum(bool([f for f in licences.scan(model, t) if f[2]]) for t in HELD_PROSE)
    print("licences held out:", right, "of", len(HELD_NOTICES), "wrong", wrong, [(n, f) for (n, _), f in zip(HELD_NOTICES, sure, strict=True) if n not in f])
    assert right >= 0.8 * len(HELD_NOTICES) and right >= 0.9 * (right + wrong)


def test_wrapped_notice_is_one_paragraph():
    notice = licences.TEMPLATES["mit"][1].split()
    wrapped = "Some prose stands here.\n\n" + "\n".join(" ".join(notice[i : i + 7]) for i in range(0, len(notice), 7)) + ".\nMore prose follows.\nReleased under the MIT License.\nLicensed under CC BY 4.0."
    got = licences.scan(licences.train(), wrapped)
    assert [(f[0], f[2]) for f in got] == [("mit", True), ("mit", True), ("cc-by", True)]
    assert got[0][3] == 2 and got[0][5] - got[0][4] >= len(notice) - 8


def test_jaccard_near_copies_have_no_rows_for_children(spark, monkeypatch):
    """Buckets of near copies are leaves at once; before, each set had two rows more for each run, whatever became of them."""
    made, children = [], jaccard._children
    monkeypatch.setattr(jaccard, "_children", lambda *a: made.append(children(*a)) or made[-1])
    rng = random.Random(8)
    base = prose(150, rng)
    texts = sorted({near(base, 1, rng) for _ in range(150)})
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert made and sum(c.count() for c in made) == 0
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    links = [sum(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets) - 1 for a in sets]
    assert [r["links"] for r in sorted(got, key=lambda r: r["doc_id"])] == links and sum(links) > 150 * 100


def test_media_copies(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.125, size=64)], 0) for i in range(60)]
    vectors += [(100, vectors[3][1], 0), (101, None, 0), (102, [1.0] * 64, 0), (None, vectors[4][1], 0), (103, [float("nan")] * 64, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    images = media.images_of(df, every=5)
    # two rows more of one id, one of them of other bytes, and a row without an id
    more = images.filter("image_id = 8").withColumn("pixels", F.lit(b"broken")).unionByName(images.filter("image_id = 8")).unionByName(images.filter("image_id = 10").withColumn("image_id", F.lit(None).cast("long")))
    for table in (images, images.unionByName(more)):
        out = {r["image_id"]: r for r in media.find_copies(table.withColumns({"links": F.lit("x"), "key": F.lit(1)})).collect()}
        assert len(out) == images.count()
        for i in range(60):
            if i % 5 == 0 and i:
                assert out[-(2 * i + 1)]["class_id"] == out[2 * i]["class_id"] == -(2 * i + 1) and out[2 * i]["images"] == 2
            elif i != 3 and (table is images or i != 4):
                assert out[2 * i]["images"] == (2 if i == 0 else 1) and out[2 * i]["class_id"] == (-1 if i == 0 else 2 * i)
        assert out[200]["class_id"] == out[6]["class_id"] == -201 and out[6]["images"] == 3 and out[202]["images"] == out[204]["images"] == 1
    assert media.find_copies(images.limit(0)).count() == 0


def media_fixture():
    """200 images and copies of them under other ids, and a group of 40 near copies of one."""
    rng = np.random.default_rng(14)
    images = {1000 + i: media.render(rng.normal(0, 0.125, size=64)) for i in range(160)}
    of = {}
    for k, edit in enumerate([{"crop": 0.75, "at": (0.1, 0.8)}, {"crop": 0.65}, {"turn": 0.4}, {"turn": 2.0}, {"scale": 0.75}, {"scale": 1.3}, {"gain": 0.5, "lift": 60}, {"crop": 0.8, "turn": 0.3, "gain": 0.8}]):
        for i in range(5):
            of[9000 - 37 * (5 * k + i)] = (1000 + 7 * k + i, edit)
    for i, (source, edit) in of.items():
        images[i] = media.warped(images[source], **edit)
    one = media.render(rng.normal(0, 0.125, size=64))
    for i in range(40):
        images[200 + 211 * i] = media.warped(one, crop=0.8 + 0.005 * i, at=(i % 7 / 6, i % 5 / 4))
    return images, of


def test_media_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 8)
    images, of = media_fixture()
    rows = [(i, x.shape[1], x.shape[0], x.tobytes()) for i, x in images.items()]
    out = {r["image_id"]: r for r in media.find_copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()}
    made = {i: media.describe(x) for i, x in images.items()}
    names, root = sorted(images), {i: i for i in images}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(names):
        for b in names[:k]:
            if media.agreeing(*made[a], *made[b], enough=media.AGREE) >= media.AGREE:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    want = {i: find(i) for i in names}
    # nothing that the comparison of all pairs doesn't join is joined
    assert all(want[r["class_id"]] == want[i] for i, r in out.items())
    # copies that all pairs find are found; the group of 40 is one class
    assert sum(out[i]["class_id"] == out[s]["class_id"] for i, (s, _) in of.items()) >= 0.95 * len(of)
    assert len({out[200 + 211 * i]["class_id"] for i in range(40)}) == 1
    assert sum(r["class_id"] == want[i] for i, r in out.items()) >= 0.97 * len(out)


def test_media_copies_do_not_depend_on_other_images(spark):
    """Which copies are found is the same in a small table and in one with many other images; sizes between two scales are the hardest to meet."""
    rng = np.random.default_rng(21)
    images = {i: media.render(rng.normal(0, 0.125, size=64)) for i in range(180)}
    some = {i: images[i] for i in range(20)} | {1000 + i: media.warped(images[i], scale=0.77) for i in range(20)}

    def classes(of):
        rows = [(i, x.shape[1], x.shape[0], x.tobytes()) for i, x in of.items()]
        found = media.find_copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()
        return {r["image_id"]: (r["class_id"], r["images"]) for r in found if r["image_id"] in some}

    assert classes(some) == classes(images | some)


def test_media_pairs_across_labels(spark):
    """Of all buckets' pairs with different labels none is missing, whatever the size of the blocks."""
    rng = np.random.default_rng(3)
    rows = [(int(k), int(i), int(p)) for k in range(12) for i, p in zip(rng.choice(60, 2 + 3 * k, replace=False), rng.integers(0, 50, 60), strict=False)]
    label = {i: i % 4 * (i > 20) for i in range(60)}
    met = spark.createDataFrame(rows, "key long, image long, point int")
    labels = spark.createDataFrame([(i, x) for i, x in label.items()], "image long, label long")
    want = {(*x, *y) for k in range(12) for a in rows if a[0] == k for b in rows if b[0] == k for x, y in [(a[1:], b[1:])] if x[0] < y[0] and label[x[0]] != label[y[0]]}
    for size in (2, 256):
        media.BLOCK, before = size, media.BLOCK
        try:
            got = media._across(met, labels).collect()
        finally:
            media.BLOCK = before
        assert {(r["a"], r["pa"], r["b"], r["pb"]) for r in got} == want


def test_written_tables_leave_no_shuffle_files(spark):
    """Tables between the steps hold their rows; the shuffle files of their making are gone when they are written."""
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toString().count("ShuffleDataBlockId")
    before = blocks()
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = common.written(frame, "test")
    for _ in range(50):  # files go in the background
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and table.count() == 7
    assert spark.conf.get(common._CLEAN, None) is None
    common.dropped(table)
    with pytest.raises(Exception, match="(?i)file|path"):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_media_unlike_images_rarely_meet(spark):
    """Among 400 unlike images a few pairs at most share a key by chance (some hundreds did when one point made a key); their copies all do."""
    rng = np.random.default_rng(31)
    images = {i: media.render(rng.normal(0, 0.125, size=64)) for i in range(400)}
    images |= {1000 + i: media.warped(images[i], crop=0.8, turn=0.3 + 0.1 * i, gain=0.8) for i in range(10)} | {1010 + i: media.warped(images[10 + i], scale=0.85) for i in range(10)}
    rows = [(i, x.shape[1], x.shape[0], x.tobytes()) for i, x in images.items()]
    described = media.describe_images(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary"))
    met = media._met(media._keys(described))
    pairs = media._across(met, spark.createDataFrame([], "image long, label long")).collect()
    true = {(i, 1000 + i) for i in range(20)}
    assert true <= {(r["a"], r["b"]) for r in pairs}
    assert sum((r["a"], r["b"]) not in true for r in pairs) <= 20


def test_media_keys_met_and_pairs_verified_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    keys = [(int(k), int(i), int(p)) for k, i, p in zip(rng.integers(0, 400, 600), rng.integers(0, 90, 600), rng.integers(0, 9, 600), strict=True)]
    met = media._met(spark.createDataFrame(keys, "key long, image long, point int"))
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    of = {}
    for k, i, p in keys:
        of.setdefault(k, []).append((i, p))
    want = sorted((k, *x, *min(xs)) for k, xs in of.items() if len({i for i, _ in xs}) > 1 for x in xs)
    assert sorted(tuple(r) for r in met.select("key", "image", "point", "head.image", "head.point").collect()) == want
    # one image that meets many others, in chunks and rounds
    monkeypatch.setattr(media, "CHUNK", 5)
    images, _ = media_fixture()
    names = sorted(images)[:60]
    rows = [(i, images[i].shape[1], images[i].shape[0], images[i].tobytes()) for i in names]
    described = media.describe_images(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary"))
    pairs = [(names[0], i) for i in names[1:]] + [(names[3], i) for i in names[4:30]]
    made = {i: media.describe(images[i]) for i in names}
    got = media._verified(spark.createDataFrame(pairs, "a long, b long"), described, media.AGREE).collect()
    want = sorted((a, b) for a, b in pairs if media.agreeing(*made[a], *made[b], enough=media.AGREE) >= media.AGREE)
    assert sorted(tuple(r) for r in got) == want and want


def test_neighbours_recall(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(8, 24))
    v = (centres[rng.integers(8, size=1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    v[200:700] = v[200]  # one very common vector
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    rows += [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0] * 3), (None, rows[0][1]), (50, rows[50][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    index_rows = ann.usable(df, "vec_id", "embedding")
    queries = index_rows.filter("id % 50 = 0").dropDuplicates(["id"])
    got = ann.search(queries, ann.build_index(index_rows, 400)).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
    wide = v.astype(np.float64)
    norm = np.sqrt((wide**2).sum(axis=1))
    hits = total = 0
    for q in range(0, 1500, 50):
        s = wide @ wide[q] / (norm * norm[q])
        want = [i for i in sorted(range(1500), key=lambda i: (-round(s[i], 12), i)) if i != q][:5]
        assert [r["rank"] for r in by[q]] == [1, 2, 3, 4, 5]
        for r in by[q]:
            assert abs(r["score"] - s[r["vec_id"]]) < 1e-12
        hits += len(set(want) & {r["vec_id"] for r in by[q]})
        total += 5
    assert hits / total >= 0.95
    assert set(by) == set(range(0, 1500, 50))  # alone in its length, 5150 has no candidates
    assert ann.neighbours(df.limit(0)).count() == 0


def test_neighbours_in_double_precision_with_ties(spark):
    base = [0.3, -0.7, 0.2, 0.11]
    rows = [(i, [x * 2.0 ** (i - 6) for x in base]) for i in range(13)]
    rows += [(100, [1e300, 1e300, 0.0, 0.0]), (101, [1e-300, 1e-300, 0.0, 0.0]), (102, [1.0, 1.0 + 1e-12, 0.0, 0.0]), (103, [1.0, 1.0, 1e-9, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(ann.neighbours(df, every=50).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and all(abs(s - 1) < 1e-15 for _, s in got[0])
    assert [i for i, _ in got[100]][:3] == [101, 102, 103] and len(got[100]) == 5


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(15)
    v = [[float(x) for x in rng.normal(size=8)] for _ in range(12)]
    rows = [(1, v[0])] * 40 + [(i, v[0]) for i in (0, 2, 3, 4)] + [(5, x) for x in v[1:9]] * 30 + [(6, v[9]), (7, v[10])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r["vec_id"]) for r in ann.neighbours(df, every=100, k=7).collect())
    assert [i for _, i in got[:4]] == [1, 2, 3, 4]
    assert sorted(i for _, i in got) == [1, 2, 3, 4, 5, 6, 7]


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = corpus_pipeline.common.written(docs, "t")
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    assert corpus_pipeline.run(spark, sf).count() == corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_pipeline_stages_keep_all_columns_and_hard_rows(spark, tmp_path):
    """Each stage on null ids and texts, repeated rows and ids, and columns named like the operators' own."""
    import corpus_pipeline

    names = ["links", "class_id", "size", "removed_lines", "_k", "_row", "_rest", "score", "predicted", "a.b"]
    rng = random.Random(23)
    texts = [prose(60, rng) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[5]), (7, None), (8, ""), (6, texts[5])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", None if i == 8 else "s", 1, *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(5, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept[name] = out.collect()
        assert all(r[n][: len(n)] == n for r in kept[name] for n in names), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert len(kept["toxicity"]) == len(kept["line_dedup"]) == len(rows)
    assert collections.Counter(r["text"] for r in kept["line_dedup"]) == collections.Counter([*texts, None, "", ""])
    # six texts and one of the empty ones
    assert len(kept["jaccard"]) == 7 and {r["text"] for r in kept["jaccard"]} - {None, ""} == set(texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(rows)
