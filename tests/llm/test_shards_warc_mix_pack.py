"""Archives, shards, mixes and packs against brute force, with hard rows in every table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdex.llm import common, mixing, packing, sharding, warc

LONG = "word " * 30_000


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 200 + "</p>"
    rows = [(5, "http://a/1", big), (2, "http://a/2 x", big), (9, None, None), (4, "u", ""), (3, "u", "small"), (1, "u", "small"), (2, "http://a/2 x", big), (None, "u", "n" * 150), (7, "u", LONG)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    root = common.new_dir(spark, "t")
    manifest = warc.write_warc(pages, root, shard_bytes=1000, roll_bytes=200).collect()
    assert sum(m["records"] for m in manifest) == len(rows) and len(manifest) > 3
    got = warc.read_warc(spark, root).collect()
    assert len(got) == len(rows)
    assert sum(r["record_type"] == "response" for r in got) == len(rows) - 2
    for r in got:
        want = {(i, (h or "").encode()) for i, _, h in rows}
        if r["record_type"] == "response":
            assert (r["page_id"], bytes(r["payload"])) in want and r["refers_to"] is None
            assert r["payload_digest"] == hashlib.sha256(bytes(r["payload"])).hexdigest()
        else:
            assert r["refers_to"] == 2 and r["payload_bytes"] == len(big.encode())
    # the same names and bytes again
    again = warc.write_warc(pages.repartition(3), common.new_dir(spark, "t"), shard_bytes=1000, roll_bytes=200).collect()
    assert {(m["name"], m["sha256"]) for m in again} == {(m["name"], m["sha256"]) for m in manifest}


def test_warc_rows_without_an_id_spread(spark):
    rows = [(None, "u", f"{i % 150:0120d}") for i in range(300)] + [(i, "u", f"{i:0120d}") for i in range(20)]
    root = common.new_dir(spark, "t")
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), root, shard_bytes=8000).collect()
    assert len({m["shard"] for m in manifest}) > 10
    got = warc.read_warc(spark, root).collect()
    assert len(got) == 320
    by = collections.defaultdict(list)
    for r in got:
        by[r["payload_digest"]].append(r)
    for same in by.values():  # a null id is the least, so one of those rows is the response
        assert [r["page_id"] for r in same if r["record_type"] == "response"] == [None]
        assert all(r["refers_to"] is None for r in same)


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_rows(spark, pages).count() == 0


def test_cut_archive_is_an_error():
    import io

    raw = warc.gzip_member(warc.format_record(1, "u", b"x" * 1000, None, False))
    with pytest.raises(ValueError):
        list(warc.parse_members(io.BytesIO(raw[:-9])))
    tampered = warc.format_record(1, "u", b"x" * 1000, None, False).replace(b"xx", b"xy", 1)
    with pytest.raises(ValueError):
        warc.parse_record(tampered)


def test_shards_near_equal(spark):
    rows = [(i, f"text {i % 37} " * (i % 11)) for i in range(2000)] + [(i, "hot " * 50) for i in range(2000, 3000)] + [(None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    out = sharding.shard_by_bytes(docs, 8, range_bytes=20_000).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        by[r["shard"]].append(r)
    mean = sum(r["size"] for r in out) / 8
    for s in range(8):
        assert sorted(r["slot"] for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r["size"] for r in by[s]) - mean) < 0.02 * mean + 250
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_histogram_splitters_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(h), int(l), int(w)) for h, l, w in zip(rng.integers(-5, 5, 3000), rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(1, 50, 3000), strict=True)]
    df = spark.createDataFrame(rows, "h long, l long, w long")
    cuts, total, _ = common.histogram_splitters(df, "h", "l", "w", 7, 0.001)
    keys = sorted((common.to_key(h, l), w) for h, l, w in rows)
    for i, c in enumerate(cuts, 1):
        assert abs(sum(w for k, w in keys if k < c) - total * i / 7) <= 50
    assert common.histogram_splitters(df.limit(0), "h", "l", "w", 7)[0] == []


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    goal, out, rest = share * sum(sizes.values()), {}, set(names)
    while rest:
        left, total = goal - sum(out.values()), sum(weight[n] for n in rest)
        over = [n for n in rest if left * weight[n] / total > cap * sizes[n] + 1e-9]
        if not over:
            out |= {n: left * weight[n] / total for n in rest}
            break
        out |= {n: cap * sizes[n] for n in over}
        rest -= set(over)
    return out


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 80)), ["a", "b", "é", "z", None][int(min(4, rng.exponential(1.2)))]) for i in range(4000)]
    rows += [(1, None, "a"), (5, "same words", "b"), (5, "same words", "b")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, target double")
    out = mixing.mix(docs, group_rows=300).collect()
    assert len(out) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
    want = targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
    for n, t in want.items():
        assert abs(taken[n] - t) <= 0.01 * t + 5, (n, taken[n], t)
    again = mixing.mix(docs.repartition(3), group_rows=300).collect()
    key = lambda r: (r["doc_id"], r["text"] or "", r["copies"])
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.take(docs).count() == sum(r["copies"] for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    s, p = rng.integers(1, 900, 500).astype(float), np.full(500, 0.37)
    q = mixing.flight(p, s)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs((q * s).sum() - (p * s).sum()) < 1e-6 * s.sum() and abs(q.sum() - p.sum()) < 1e-6


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", None, "Hello  world", " lead\n\n x's ", "naïve 漢字 — ok", LONG, "a" * 5000, "tail "] + [f"document {i} " * (i % 70) for i in range(300)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(3, texts[3]), (None, "no id")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, length int")
    pieces = packing.tokenize_pieces(docs, with_ids=True)
    out = packing.pack(pieces, group_rows=64).collect()
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    seqs, docs_ = collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert list(r["ids"]) == ids and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs_[r["doc_id"]].add((r["start"], r["length"]))
    for i, ps in docs_.items():
        assert sum(n for _, n in ps) == len(want[i])
    for ps in seqs.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_fill_windows_exact():
    rng = np.random.default_rng(4)
    counts = collections.Counter(int(x) for x in rng.integers(1, 60, 200))
    windows = packing.fill_windows(dict(counts), 64)
    used = collections.Counter()
    for w in windows:
        assert sum(n * c for n, c in w.items()) <= 64
        used.update(w)
    assert used == counts
    first = windows[0]
    seed = max(counts)
    left = counts - collections.Counter({seed: 1})
    best = {0}
    for n, c in left.items():
        best = {b + n * k for b in best for k in range(c + 1) if b + n * k <= 64 - seed}
    assert sum(n * c for n, c in first.items()) == seed + max(best)


def test_words_equal_whole_texts():
    import random

    e = packing.WordEncoder(packing.default_tokenizer())
    rng = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "Bc", "'s", "é", "9", ".", "　", "\x1c", "\x00", "😀", "word", "-- ", "漢", "’"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for x, b in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)
    slow = packing.WordEncoder(packing.default_tokenizer())
    slow.ranks = None
    assert slow.encode(texts) == e.encode(texts)


def test_long_runs_of_one_kind_of_character():
    enc = packing.encoder(packing.default_tokenizer())
    for text in (" " * 1_000_000 + "x", "\t" * 1_000_000, "\n" * 1_000_000 + "x", "a" * 1_000_000, ("x" + " " * 1500) * 400):
        assert len(enc.encode([text])[0]) > 0
    for text in (" " * 3000 + "x y", "\t" * 3000 + "x\n\n  y", "\n" * 3000, "a" * 3000, ("x" + " " * 1500) * 4, " \t\n" * 1200 + "é   z"):
        assert enc.encode([text])[0] == enc._encode([text])[0]


def test_packing_keeps_columns_whatever_their_names(spark):
    big = (1 << 60) + 1
    rows = [(i if i % 3 else None, "word " * (i % 40), 7, 8, "g", "t", big if i % 2 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, offset int, _g string, _text string, note long")
    pieces = packing.tokenize_pieces(docs, capacity=32)
    out = packing.pack(pieces, capacity=32, group_rows=50).collect()
    assert len(out) == pieces.count() and {r["_g"] for r in out} == {"g"} and {r["_text"] for r in out} == {"t"} and {r["note"] for r in out} == {big, None}
    held = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 32
    with pytest.raises(ValueError):
        packing.pack(pieces.withColumnRenamed("note", "extra"), order="offset")
