"""Manifests, pieces and phrases against brute force and the library, with hard rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowdex.llm import manifest, phrases, sentencepieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    """Root, and each node's siblings level by level with its place among them."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, joined = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k, group in enumerate(groups[a : a + 16]):
                for i in group:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            up.append(digest(run))
            joined.append(list(itertools.chain(*groups[a : a + 16])))
        nodes, groups = up, joined
    return nodes[0], paths


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built.append(tree([leaf(r) for r in by[s]]))
    root, above = tree([b[0] for b in built])
    out = []
    for s, (sub, paths), up in zip(order, built, above, strict=True):
        for r, path in zip(by[s], paths, strict=True):
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for k, others in path + up:
                node = digest([*others[:k], node, *others[k:]])
            out.append((r[0], leaf(r), sub, root, digest(x for _, others in path + up for x in others), node, node == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_equals_brute_force(spark, levels, monkeypatch):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["Abc É", "x", "", None, "ÀB:9", "Long " * 3000]), rng.choice(["en", None]), rng.choice(["hot", "hot", "a", "b", None, "é", "", "Z"]), rng.choice([0, None, 5])) for i in range(300)]
    rows += [rows[3], rows[3], (None, "T", "en", "hot", 1), (None, "T", "en", "hot", 1), (7, "other", "en", "hot", 2), (9000, "lone", "de", "single", 4)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("leaf", "path", "root", "_g", "_i", "_node", "_at", "tampered")})
    own = manifest.manifest
    monkeypatch.setattr(manifest, "manifest", lambda *a, **k: own(*a, **k, levels=levels))
    got = [tuple(r) for r in manifest.manifest_rows(docs.repartition(5)).collect()]
    want = brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_none(spark):
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    (row,) = manifest.manifest_rows(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == digest([])
    assert manifest.manifest_rows(one.limit(0)).collect() == []


def test_manifest_path_leads_to_the_root_only_from_its_own_leaf(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(40)], DOCS)
    rows = manifest.manifest(docs, levels=1).withColumns({"right": manifest.folded(F.col("leaf"), F.col("path")), "wrong": manifest.folded(F.sha2("leaf", 256), F.col("path"))})
    for r in rows.collect():
        assert r["right"] == r["root"] != r["wrong"] and len(r["path"]) == 2


ALPHABET = ["a", "b", "th", "e", "er", "ing", " ", "  ", "   ", "▁", "\n", "\t", "é", "漢", "字", "𝔘", "\x00", "<s>", "<0x41>", "ñ", "0", "1", "aa", "....", "==", "//", "    ", "the", "http://"]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())


def test_pieces_equal_the_library():
    rng, lib, own = random.Random(5), library(), sentencepieces.coder(sentencepieces.default_model())
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(5000)]
    texts += [" " * n for n in range(100)] + ["a" * n for n in range(100)] + ["=" * n + " " * (n % 7) for n in range(100)]
    texts += ["x " * 50_000, " " * 20_000, "".join(rng.choices("etaoinsr", k=20_000)), "漢字" * 20_000]
    want = lib.encode(texts)
    assert own.encode(pa.array(texts)).to_pylist() == want
    assert own.decode_all(pa.array(want, pa.list_(pa.int32()))).to_pylist() == lib.decode(want)


def test_any_ids_decode_as_the_library_does():
    rng, lib, own = random.Random(6), library(), sentencepieces.coder(sentencepieces.default_model())
    lists = [[rng.randrange(0, 400) if rng.random() < 0.8 else rng.randrange(32_000) for _ in range(rng.randint(0, 12))] for _ in range(6000)]
    want = [lib.decode(x) for x in lists]
    assert [own.decode(x) for x in lists] == want
    for at in range(0, len(lists), 3):
        assert own.decode_all(pa.array(lists[at : at + 3], pa.list_(pa.int32()))).to_pylist() == want[at : at + 3]


def test_pieces_of_hard_rows(spark):
    texts = [None, "", " ", "plain words", "plain words", "long " * 40_000, "é\n\nx", "▁▁ a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(1), "_g": F.lit(2)})
    lib = library()
    coded = sentencepieces.encode_pieces(docs)
    assert {"_g", "decoded", "ids"} < set(coded.columns)
    back = {r["doc_id"]: r for r in sentencepieces.decode_pieces(coded).collect()}
    for i, t in enumerate(texts):
        assert back[i]["ids"] == lib.encode(t or "") and back[i]["decoded"] == lib.decode(lib.encode(t or ""))
    rows = {r["doc_id"]: r for r in sentencepieces.piece_rows(docs).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), digest([",".join(map(str, ids))]), digest([lib.decode(ids)]))
    assert sentencepieces.piece_rows(docs.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in sentencepieces.decode_pieces(nulls).collect()] == [None, ""]


def brute_phrases(rows, least, top, cover=80):
    """rows: text, lang."""
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        good = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in good.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= cover * a and inside(q) for q, b in good.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    words = ["a", "B", "cat", "Éa", "the", "the", "of", "x\x00", "...", "the,", "\tof", "é"]
    rows = [(rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(300)]
    rows += [(None, "en"), ("", None), (" \t ", "fr"), ("one two three four five " * 20, "en"), ("one two three four five " * 20, "en"), ("w " * 20_000, "de"), ("rare pair", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("clash") for c in ("word", "c", "gid", "left", "seq", "block")})
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 700)  # many blocks of each language
    for least, top in ((5, 2000), (5, 7)):
        got = [tuple(r) for r in phrases.mine_phrases(docs.repartition(3), least=least, top=top).collect()]
        assert sorted(got) == brute_phrases(rows, least, top)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine_phrases(docs).collect() == []


def test_scores_past_64_bits(spark):
    big = 9_000_000_000_000
    row = spark.range(1).select(phrases._score(F.lit(big), F.lit(big + 1), F.lit(big + 2)).alias("s")).first()
    assert row["s"] == 2_000_000 * big // (2 * big + 3)
