"""The text operators against plain versions of themselves, on small hostile tables."""

import gc
import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import ann, bpe, common, language, licenses, minhash, packing, pii, quality, queries, sharding, suffix_tree
from lattica.llm.common import KeyFilter, id_bucket, pieces

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, score double, digest string, id long, row int, kept int, uid int, bands int, bin int"


def prose(rng, n, words=None):
    words = words or ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "omi", "pi", "rho"]
    return " ".join(rng.choice(words) for _ in range(n))


def hostile():
    rng = random.Random(4)
    base = prose(rng, 300)
    near = base.split()
    near[100] = "changed"
    long = prose(rng, 30_000, [f"w{i}" for i in range(4000)])
    texts = [None, "", " \n\t ", "a", "one two", base, base, " ".join(near), long, "x" * 70_000, "é漢😀 12", "a@b.co\n" * 3, "4111 1111 1111 1111", base.upper(), "Released under the MIT Licence."]
    rows = [(i, t, ["en", None, "xx"][i % 3], None if i % 2 else "s", None) for i, t in enumerate(texts)]
    rows += [rows[5]] * 3 + [(None, base, None, None, None), (None, None, None, None, None), (5, "another text with the same id", "en", None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["x", 1, 0.5, "d", 9, 1, 1, 1, 1, 1]) for r in hostile()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def model_of():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary()), special_tokens={})


# sharding


def test_shards(docs, empty):
    got = sharding.shard_by_bytes(docs, 4).collect()
    rows = hostile()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    total, at = sum(r["size"] for r in got), 0
    for r in sorted(got, key=lambda r: r["position"]):
        assert r["shard"] == min(3, (2 * at + r["size"]) * 4 // (2 * total))
        at += r["size"]
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert sharding.shard_by_bytes(empty, 4).collect() == []


def test_shards_of_one_hot_id(spark):
    got = sharding.shard_by_bytes(spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("abc").alias("text")), 8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [375] * 8


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def plain_spans(t):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_the_plain_matches():
    rng = random.Random(1)
    bits = ["a@b.co", "@", "x.y", "1.2.3.4", ".", "255.255.255.255", "0256.1.1.1", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1 (555) 555-0100", "+", "9", "é", "(", ")", "_", "%", "a@b", "a@b.c_d@e.f", "\n"]
    for _ in range(6000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("7" * 200_000 + "a" * 200_000 + "@") == []


def test_field_adds_what_repeats_and_keeps_clean_texts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        phone = f"+1 (555) 555-{rng.randrange(1000, 9999)}"
        rows.append((i, f"{prose(rng, 20)} {phone} {prose(rng, 20)}" if i % 2 else prose(rng, 40)))
    rows.append((1000, f"{prose(rng, 5)} call +15555550100 today {prose(rng, 9)} or 15555550100 again"))
    rows.append((1001, "chapter 3 has 12 pages and 4.5 stars"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in pii.with_spans(df, pii.learn(df), "f").collect()}
    text = dict(rows)
    assert all(not got[i] for i in range(0, 400, 2)) and not got[1001]
    assert all([(s["start"], s["end"]) for s in got[i] if s["base"]] == [(a, b) for a, b, _ in plain_spans(text[i])] for i in got)
    added = [text[1000][s["start"] : s["end"]] for s in got[1000] if not s["base"]]
    assert added == ["15555550100"]


def test_every_repeat_of_a_caught_number_is_labelled(spark):
    rng = random.Random(12)
    rows = [(i, f"{prose(rng, 20)} +1 (555) 555-{rng.randrange(1000, 9999)} {prose(rng, 20)}" if i % 2 else prose(rng, 40)) for i in range(400)]
    rows.append((1000, "call +15555550100 " + " ".join(f"{prose(rng, 9)} or 15555550100 again" for _ in range(50))))
    rows.append((1001, " ".join(f"{prose(rng, 9)} or 15555550100 again" for _ in range(25)) + " call +15555550100 " + " ".join(f"{prose(rng, 9)} or 15555550100 again" for _ in range(25))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.with_spans(df, pii.learn(df), "f").where("doc_id >= 1000").collect():
        assert [r["text"][s["start"] : s["end"]] for s in r["f"] if not s["base"]] == ["15555550100"] * 50


def test_repeats_hear_the_caught_word_however_many_there_are():
    lean = pii.Weights({}, np.array([[1.0, 0, 0, 0, 0]]), np.zeros((pii.LABELS, pii.LABELS)), pii.TIE * (2 * np.eye(pii.LABELS) - 1))  # every word to clean
    for n in (1, 50, 500):
        for text in ("+15555550100 x" + " 15555550100 x" * n, "15555550100 x " * n + "+15555550100"):
            found = pii.find([text], lean, {})[0]
            assert [text[a:b] for a, b, kind, base in found if kind == 3 and not base] == ["15555550100"] * n
            dropped = []
            assert len(pii.graph(text, pii.base_spans(text, dropped), dropped).skip) <= 3 * (n + 1)


def enumerated(unary, edges, potential):
    n = len(unary)
    out = np.zeros_like(unary)
    for y in itertools.product(range(pii.LABELS), repeat=n):
        p = math.exp(sum(unary[k, y[k]] for k in range(n)) + sum(t[y[a], y[b]] for (a, b), t in zip(edges, potential)))
        out[np.arange(n), y] += p
    return out / out.sum(axis=1, keepdims=True)


def test_beliefs_against_enumeration():
    rng = np.random.default_rng(6)
    tie = 1.5 * (2 * np.eye(pii.LABELS) - 1)
    for edges in ([(0, 1), (1, 2), (2, 3), (1, 4)], [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)]):  # trees: exact
        unary, potential = rng.normal(size=(6, pii.LABELS)), rng.normal(size=(len(edges), pii.LABELS, pii.LABELS))
        got = pii.marginals(unary[: max(max(e) for e in edges) + 1], np.array(edges), potential)
        assert np.allclose(got, enumerated(unary[: len(got)], edges, potential), atol=2e-3)
    for edges in ([(0, 1), (1, 2), (2, 3), (0, 2)], [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)]):  # loops: near, and the same best label
        unary = rng.normal(size=(4, pii.LABELS)) * 2
        potential = np.array([tie if k >= 3 else rng.normal(size=(pii.LABELS, pii.LABELS)) for k in range(len(edges))])
        got, want = pii.marginals(unary, np.array(edges), potential), enumerated(unary, edges, potential)
        assert np.abs(got - want).max() < 0.1 and (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_beliefs_of_a_text_are_those_of_its_whole_field():
    """Caught words are folded into their neighbours; the whole field with them clamped says the same."""
    rng = np.random.default_rng(3)
    text = "x +1 (555) 555-0100 12 a 15555550100 b 77.1 +1 x 15555550100"
    dropped = []
    g = pii.graph(text, pii.base_spans(text, dropped), dropped)
    w = pii.Weights({}, rng.normal(size=(1, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), 1.2 * (2 * np.eye(pii.LABELS) - 1))
    unary = np.array([np.where(np.arange(pii.LABELS) == x, 0, -1e9) if x else w.node(p) for x, p in zip(g.labels, g.patterns)])
    want = pii.marginals(unary, np.array(g.chain + g.skip), np.array([w.chain] * len(g.chain) + [w.skip] * len(g.skip)))
    assert 0 in g.labels and 4 in g.labels and g.skip
    assert np.allclose(pii.beliefs([g], w, {}), want, atol=2e-3)


def test_weights_are_fitted_together():
    """Of two examples that differ in neighbour or tie alone, the chain and the skip edges take the weight."""
    node = "a0000-0--|-|-"
    chain = pii.fit_weights({("4", f"{node}|4|-|"): 50, ("0", f"{node}|0|-|"): 50})
    assert chain.chain[4, 4] > chain.chain[0, 4] + 1 and chain.chain[0, 0] > chain.chain[4, 0] + 1
    with_ties = pii.fit_weights({("4", f"{node}|-|-|4"): 500, ("0", f"{node}|-|-|0"): 500})
    against = pii.fit_weights({("4", f"{node}|-|-|0"): 500, ("0", f"{node}|-|-|4"): 500})
    assert against.skip[0, 0] < pii.TIE < with_ties.skip[0, 0] + 1e-9


def test_field_finds_hidden_and_swallowed_spans(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for r in pii.recovery(d, 0.2).collect():
        assert r["hidden"] >= 20 and r["found"] >= 0.95 * r["hidden"], r
        assert r["added"] <= 1.15 * r["hidden"], r
    found = pii.with_spans(d, pii.learn(d), "f").select("text", F.explode("f").alias("s")).where("not s.base").collect()
    added = [(r["s"]["kind"], r["text"][r["s"]["start"] : r["s"]["end"]]) for r in found]
    assert len(added) >= 5
    assert all(luhn(x) and 14 <= len(x) <= 19 if kind == "card" else re.fullmatch(r"\+1 \(\d{3}\) 555-\d{4}", x) for kind, x in added), added


def test_many_spans_in_one_text_take_seconds():
    w = pii.fit_weights({("1", "a1000-0--|-|-|-|-|"): 10, ("0", "a0000-0--|-|-|-|-|"): 10})
    began = time.time()
    assert len(pii.find([" ".join(f"user{i}@mail.example.com" for i in range(100_000))], w, {})[0]) == 100_000
    assert len(pii.find(["x" * 2_000_000 + " a@b.co " + "9" * 300_000], w, {})[0]) == 1
    assert time.time() - began < 20


def test_pii_edges(docs, empty, spark):
    w = pii.learn(docs)
    got = pii.with_spans(docs, w, "found").select("doc_id", "text", "found").collect()
    assert len(got) == len(hostile())
    for r in got:
        assert [(s["start"], s["end"], pii.KINDS.index(s["kind"])) for s in r["found"] if s["base"]] == plain_spans(r["text"] or "")
    masked = docs.where("doc_id = 11").select(pii.masked(F.col("text"), w)).first()[0]
    assert masked == "[EMAIL]\n" * 3
    assert pii.with_spans(empty, pii.learn(empty), "found").collect() == []


# byte-level BPE


def test_encoding_is_the_library_s_and_round_trips():
    rng, c, enc = random.Random(5), bpe.codec(vocabulary()), model_of()
    alphabet = "  \n\t '''stmdrevlabcEY1２é漢!?#́ \x85\x1c😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(4000)]
    texts += ["a" * 3000, "ab" * 700 + " " * 500 + "x", "'" * 300, "é" * 400, "<|endoftext|>", "'re 've 'll 'l 'r", prose(rng, 5000), ""]
    got = c.encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), repr(t)
        assert c.decode(ids, c.offsets(ids)) == t.encode()
    with pytest.raises(ValueError):
        c.decode(got[-2], c.offsets(got[-2])[:-4])


def test_scan_is_associative_composition():
    rng = np.random.default_rng(0)
    f = rng.integers(0, bpe.STATES, (37, bpe.STATES)).astype(np.uint8)
    want = f[0]
    for k, row in enumerate(bpe.scan(f)):
        want = want if k == 0 else f[k][want]
        assert (row == want).all()


def test_bpe_edges(docs, empty):
    enc = model_of()
    rows = bpe.decode_documents(bpe.encode_documents(docs, vocabulary()), vocabulary()).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == Counter((r[0], np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes()) for r in hostile())
    assert Counter(bytes(r["decoded"]) for r in rows) == Counter((r[1] or "").encode() for r in hostile())
    both = bpe.encode_documents(docs, vocabulary(), and_decode=True).collect()
    assert Counter(bytes(r["decoded"]) for r in both) == Counter((r[1] or "").encode() for r in hostile())
    assert bpe.encode_documents(empty, vocabulary(), and_decode=True).collect() == []


# licences


def test_licenses(docs, empty, spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;")), (2, "text\nReleased under the MIT License!\nmore"), (3, mit + " more"), (4, "All rights reserved.\n\n© 2001 x")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["license"], got[1]["notices"]) == ("MIT", "")
    assert (got[2]["license"], got[2]["notices"], got[2]["n_notices"]) == (None, "MIT", 1)
    assert got[3]["license"] is None and got[4]["license"] is None
    out = licenses.scan_licenses(docs).collect()
    assert len(out) == len(hostile()) and [r["license"] for r in out if r["doc_id"] == 14] == ["MIT"]
    assert licenses.scan_licenses(empty).collect() == []
    assert licenses.scan_licenses(docs, known=[("X", "one two")]).where("license = 'X'").count() == 1
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, known=[("X", "a")] * 3, most_known=2)


def test_whole_licenses_and_commented_copyright_lines(spark):
    folder = licenses.Path(licenses.__file__).parent / "license_texts"
    texts = [(f.stem, f.read_text()) for f in sorted(folder.glob("*.txt"))]
    assert {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= {n for n, _ in texts}
    for head in ("# Copyright (c) 2020 X", " * Copyright 2021 X", "// Copyright The X Authors", "Copyright The X Authors"):
        mark = head.split("C")[0]
        texts += [("MIT", "\n".join([head, *(mark + line for line in licenses.KNOWN[0][1].split("\n"))]))]
    texts += [("GPL-3.0", dict(texts)["GPL-3.0"].split("END OF TERMS")[0]), (None, dict(texts)["GPL-3.0"] + "\nand more words")]
    rows = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan_licenses(rows).collect()} == {k: n for k, (n, _) in enumerate(texts)}


# language


def test_language_edges(docs, empty):
    model = language.learn(docs)
    got = language.with_language(docs, model, "found").select("doc_id", "text", "found.*").collect()
    assert len(got) == len(hostile())
    for r in got:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    assert language.with_language(empty, language.learn(empty), "found").collect() == []
    none = language.with_language(docs, language.learn(empty), "found").select("found.lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_language_held_out(spark):
    rows = queries.op5_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_bundles_are_the_plain_sums():
    texts = ["abc ab", "ça", "", "12 b"]
    got = language.bundles(language.trigrams(texts), np.arange(4), 4)
    for k, t in enumerate(texts):
        want = np.zeros(language.DIMENSIONS)
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = [0, *map(ord, w), 0]
            for x in zip(padded, padded[1:], padded[2:]):
                v = language.letter_vectors(np.array(x)).astype(float)
                want += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        assert np.allclose(got[k], want)


def test_pieces_of_a_long_text_bundle_to_the_same_sum(monkeypatch):
    rng = random.Random(31)
    texts = ["".join(rng.choice("abcé İß漢 .-") for _ in range(n)) for n in (0, 1, 50, 3000, 7001)] + ["x" * 5000]
    want, n = language.text_bundles(texts, np.arange(6), 6)
    for chars, cells in ((64, 1 << 22), (1000, 512), (1, 1)):
        monkeypatch.setattr(language, "BATCH_CHARS", chars)
        monkeypatch.setattr(language, "CELLS", cells)
        monkeypatch.setattr(language, "TEXT_COST", 1)
        got, m = language.text_bundles(texts, np.arange(6), 6)
        assert (got == want).all() and (m == n).all()


def test_prediction_against_plain_cosines():
    rng = random.Random(32)
    texts = [prose(rng, 30, w) for w in (["the", "and", "this"], ["der", "und", "das"], ["le", "et", "ça"]) for _ in range(6)]
    plain = np.zeros((18, language.DIMENSIONS))
    for k, t in enumerate(texts):
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = [0, *map(ord, w), 0]
            for x in zip(padded, padded[1:], padded[2:]):
                v = language.letter_vectors(np.array(x)).astype(float)
                plain[k] += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    rows = np.array([plain[:6].sum(axis=0), plain[6:12].sum(axis=0), plain[12:].sum(axis=0)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows -= rows.mean(axis=0)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    near = plain @ rows.T / np.linalg.norm(plain, axis=1, keepdims=True)
    sums, _ = language.text_bundles(texts, np.repeat(np.arange(3), 6), 3)
    names, scores = language.predict(texts, language.Profiles(["a", "b", "c"], language.centred(sums)))
    assert names == ["abc"[k] for k in near.argmax(axis=1)] and np.allclose(scores, near.max(axis=1), atol=1e-5)
    tied = language.Profiles(["a", "b"], np.array([rows[0], rows[0]]))
    assert language.predict(texts[:1], tied)[0] == ["a"]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    df = spark.createDataFrame([("abc", str(k)) for k in range(5)], "text string, lang string")
    with pytest.raises(Exception, match="more than 3 languages"):
        language.learn(df.repartition(5))
    assert len(language.learn(df.where("lang < '3'")).langs) == 3


def peak_mb(code):
    """Greatest memory of a fresh process that runs ``code``, less what it has after its imports."""
    said = subprocess.run(
        [sys.executable, "-c", "import resource, random\nfrom lattica.llm import language, quality, minhash, pii, suffix_tree, words\nimport zstandard\nrandom.seed(1)\n" + code + "\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"],
        capture_output=True, text=True, timeout=600, cwd=str(Path(__file__).resolve().parents[2]),
    )
    return int(said.stdout.split()[-1])


LONG = "t = ' '.join(''.join(random.choices('abcdefgh', k=random.randrange(2, 9))) for _ in range(1 << 16)) + ' '\nt = (t * (64 * 2**20 // len(t) + 1))[: 64 * 2**20]\n"


@pytest.mark.parametrize("code", ["quality.measure([t], zstandard.ZstdCompressor(level=3))", "language.text_bundles([t], __import__('numpy').zeros(1, int), 1)", "words.hashed([t.encode()])", "suffix_tree.tree_scores(suffix_tree.grow(__import__('pandas').DataFrame({'d': [0], 'code': [97], 'n': [1]}), 1), [t.encode()])", "pii.find([t + ' a@b.co'], pii.fit_weights({}), {})"])
def test_a_text_of_64_mb_is_held_in_bounded_memory(code):
    assert peak_mb(LONG + code) < 1600


def test_many_short_texts_are_held_in_bounded_memory():
    assert peak_mb("x = [''.join(chr(random.randrange(0x4E00, 0x9FFF)) for _ in range(40)) for _ in range(10_000)]\nlanguage.predict(x, language.Profiles(['a'], __import__('numpy').ones((1, 1024))))") < 700


def test_words_in_pieces_are_words(monkeypatch):
    from lattica.llm import words

    rng = random.Random(33)
    texts = ["".join(rng.choice("ab  \n\t") for _ in range(rng.randrange(0, 40))).encode() for _ in range(300)] + [b"x" * 500, b"", b" "]
    whole_words, grams = words.hashed(texts), words.windows(words.hashed(texts), 3)
    plain_words = [w for t in texts for w in t.split()]
    assert [whole_words.data[a:b] for a, b in zip(whole_words.start, whole_words.end)] == plain_words
    assert len(set(whole_words.hashes.tolist())) == len(set(plain_words)) and len({(w, h) for w, h in zip(plain_words, whole_words.hashes.tolist())}) == len(set(plain_words))
    counts = [max(0, len(t.split()) - 2) for t in texts]
    assert np.diff(grams[1]).tolist() == counts and len(grams[0]) == sum(counts)
    triples = [tuple(t.split()[k : k + 3]) for t in texts for k in range(max(0, len(t.split()) - 2))]
    assert len({(x, h) for x, h in zip(triples, grams[0].tolist())}) == len(set(triples)) == len(set(grams[0].tolist()))
    for piece in (1, 7, 64):
        monkeypatch.setattr(words, "PIECE", piece)
        again = words.hashed(texts)
        assert (again.hashes == whole_words.hashes).all() and (again.start == whole_words.start).all() and (again.first == whole_words.first).all()
        assert (words.windows(again, 3)[0] == grams[0]).all()


# neighbours


def brute(rows, top):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float((w * v).sum()), i) for i, w in ok if i != q))[:top]
    return out


def test_neighbours_of_few_rows_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(60, 90)]
    rows += [(100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 0.0, 0.0]), (180, [float("nan")] * 4), (200, [float("inf"), 0.0, 0.0, 0.0]), (220, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, rank string")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    want = brute(rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_neighbour_recall(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in e], float)
    ids = np.array([r["vec_id"] for r in e])
    found = defaultdict(set)
    for r in queries.op6_ann(spark, sf).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        hits.append(len(found[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]])))
    assert np.mean(hits) / 20 >= 0.9


def recall_and_seen(df, x, ids):
    found, seen = defaultdict(set), {}
    for r in df.collect():
        found[r["query_id"]].add(r["vec_id"])
        seen[r["query_id"]] = r["seen"] / len(ids)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -1e9
        hits.append(len(found[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]])))
    return np.mean(hits) / 20, np.mean(list(seen.values()))


def test_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    recall, seen = recall_and_seen(ann.search(df, F.col("vec_id") % 20 == 0, with_visits=True), x, np.arange(6000))
    assert recall >= 0.9 and seen <= 0.15, (recall, seen)


def test_parts_grow_with_the_rows():
    assert [ann.parts_for(n) for n in (0, 1, 40, 2000, 51_282, 300_000, 10**9)] == [1, 1, 1, 32, 256, 512, 512]


def test_blocks_and_early_leaving_change_nothing(spark, monkeypatch):
    rng = random.Random(51)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ann.search(df, F.col("vec_id") % 5 == 0, parts=1).collect()))
    for name, value in (("CANDIDATE_BLOCK", 16), ("QUERY_BLOCK", 7), ("CELLS", 50), ("HELD", 40)):
        monkeypatch.setattr(ann, name, value)
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") % 5 == 0, parts=1).collect())) == want and len(want) > 1400


# quality


def plain_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(triples)
    covered = {i + k for i, x in enumerate(triples) if count[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_quality(docs, empty, spark):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in quality.with_quality(docs, "found").select("text", "found.*").collect():
        assert tuple(r[n] for n in names) == plain_quality(r["text"])
        assert not (r["base_failed"] and r["kept"])
    for r in spark.read.parquet(f"{SF}/documents.parquet").transform(lambda d: quality.with_quality(d, "found")).select("text", "found.*").collect():
        assert tuple(r[n] for n in names) == plain_quality(r["text"])
    assert quality.with_quality(empty, "found").collect() == []


def test_compression_bands():
    z, rng = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(6)
    syllables = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    clean = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(2000)).encode()
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000)).encode()
    assert quality.judge(clean, z)[3] and quality.judge(clean[:600], z)[3]
    assert not quality.judge(noise, z)[3] and not quality.judge(b"spam and eggs " * 500, z)[3]
    assert not quality.judge(clean[:3000] + noise, z)[3]


def test_junk_beside_prose_is_judged():
    z, rng = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(7)
    syllables = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    clean = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(9000)).encode()
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000)).encode()
    for text in (clean[:20_480] + noise, clean[:24_576] + b"The same sentence is said again. " * 500, clean[:4096] + noise[:4095], clean[:4096] + noise[:2000], noise[:4096] + clean[:20_480]):
        assert not quality.judge(text, z)[3]
    for n in (*range(4090, 4210, 7), 8191, 8192, 8193, 8291, 8292, 12_000, 40_000):
        assert quality.judge(clean[:n], z)[1:] == (0, n // 4096 + (n >= 4096 and n % 4096 >= quality.LEAST_TAIL), True), n


# packing


def packed_ok(rows, texts, capacity=packing.CAPACITY):
    enc = model_of()
    want = Counter()
    for i, t in texts:
        ids = np.array(enc.encode_ordinary(t or "") + [0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        want += Counter((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs, empty, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path, public_tokenizers.PATTERN).collect()
    packed_ok(rows, [(r[0], r[1]) for r in hostile()])
    assert packing.pack(empty, path, public_tokenizers.PATTERN).collect() == []
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op8_packing(spark, SF).collect()
    n = packed_ok(rows, [(r["doc_id"], r["text"]) for r in d.collect()])
    assert n <= math.ceil(1.02 * sum(r["length"] for r in rows) / packing.CAPACITY)


def test_ids_are_the_tokenizers_library_s():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encode = packing.encoder(path, public_tokenizers.PATTERN, added=True)
    rng = random.Random(21)
    bits = [" ", "  ", "\n", "\t", "it's", "'ll", "é", "漢", "😀", "12", "#!", "the", "<|endoftext|>", "<|", "|>", "\x85", "\u2028", "\xa0", "\x1c"]
    fuzz = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 20))) for _ in range(1500)]
    for x in ["it's  two  spaces\n\n\nand <|endoftext|> é漢", " a\t b", "x ", "\n", *[r[1] for r in hostile() if r[1]], *fuzz]:
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_added_tokens_get_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|endoftext|>" * 2, "x  <|endoftext|>  y\n\n", "<|endoftext|", "é <|endoftext|>'s", "plain  text"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()
    want = [np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4") for x in texts]
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows} == {k: (len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(want)}


def whole(p, sizes, capacity=2048):
    assert len(p.where) == len(sizes) and sorted(set(p.where.tolist())) == list(range(len(p.fill)))
    assert np.bincount(p.where, weights=sizes).tolist() == p.fill.tolist() and p.fill.max() <= capacity


def test_crossover_keeps_every_item_and_injects_whole_bins():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1500, 300)
    for _ in range(30):
        a, b = (packing.packed(rng.permutation(300), sizes, 2048) for _ in range(2))
        child = packing.crossover(a, b, sizes, 2048, rng)
        whole(child, sizes)
        bins = lambda p: {frozenset(np.flatnonzero(p.where == k).tolist()) for k in range(len(p.fill))}  # noqa: B023, E731
        assert len(bins(child) & bins(b)) >= int(packing.INJECTED[0] * len(b.fill)) // 2
    one = packing.packed(np.array([0]), np.array([5]), 2048)
    whole(packing.crossover(one, one, np.array([5]), 2048, rng), np.array([5]))


def test_evolution_gains_on_its_first_packings_and_on_falling_sizes():
    rng = np.random.default_rng(2)
    for low, high, n in ((500, 900, 1500), (300, 700, 1500)):
        sizes = rng.integers(low, high, n)
        best, bins, crossed = packing.evolve(sizes, [], 2048, 3)
        whole(best, sizes)
        assert bins == sorted(bins, reverse=True) and len(best.fill) == bins[-1] < bins[0] and crossed == packing.CHILDREN * (len(bins) - 1)
        assert len(best.fill) < len(packing.packed(np.argsort(-sizes), sizes, 2048).fill)
    start = [packing.packed(rng.permutation(n), sizes, 2048) for _ in range(2)]
    assert len(packing.evolve(sizes, start, 2048, 3)[0].fill) <= min(len(p.fill) for p in start)


def test_packings_of_the_tables_come_through_crossover(spark):
    rows = queries.op8_packing(spark, "/root/testdata/sf0.01").where("first_bins is not null").groupBy("first_bins", "group_bins", "crossovers").agg(F.sum("length").alias("n")).collect()
    assert all(r["crossovers"] > 0 and r["group_bins"] < r["first_bins"] for r in rows)
    assert all(r["group_bins"] <= math.ceil(1.003 * r["n"] / packing.CAPACITY) for r in rows)


def test_packing_writes_few_files_whatever_the_shuffle_partitions(spark, monkeypatch, tmp_path):
    tables, write = [], packing.checkpointed
    monkeypatch.setattr(packing, "checkpointed", lambda df: tables.append(write(df)) or tables[-1])
    docs = spark.createDataFrame([(i, prose(random.Random(i), 20 + 37 * i % 400)) for i in range(5000)], "doc_id long, text string").coalesce(1)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert len(rows.inputFiles()) == 1 and len(tables) > 2 and all(len(t.inputFiles()) == 1 for t in tables)
    packed_ok(rows.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


# n-gram join


def plain_classes(rows, similarity=0.8):
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    grams = {}
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams[t] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    names = list(texts)
    links = defaultdict(set)
    for a in range(len(names)):
        for b in range(a):
            x, y = grams[names[a]], grams[names[b]]
            if x and y and len(x & y) >= similarity * len(x | y):
                links[names[a]].add(names[b])
                links[names[b]].add(names[a])
    out = Counter()
    for t, ids in texts.items():
        seen, todo = {t}, [t]
        while todo:
            for u in links[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        members = [i for u in seen for i in texts[u] if i is not None]
        n = sum(len(texts[u]) for u in links[t]) + len(ids) - 1
        out += Counter({(i, min(members, default=None), n): ids.count(i) for i in set(ids)})
    return out


def near_family(rng, n, words=120):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        yield " ".join(w)


def test_join_against_brute_force(docs, empty, spark, monkeypatch):
    got = minhash.jaccard_join(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == plain_classes([(r[0], r[1]) for r in hostile()])
    assert minhash.jaccard_join(empty).collect() == []
    rng = random.Random(8)
    rows = list(enumerate([*near_family(rng, 120), *near_family(rng, 5), *[prose(rng, 60) for _ in range(40)], *["one two three"] * 3, "one two three", "one two"]))
    want = plain_classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, size in ((1024, 1 << 30), (32, 1 << 30), (1024, 1 << 15)):  # one block, then pairs of blocks by texts and by bytes
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
        monkeypatch.setattr(minhash, "CROWD", 1 if block == 32 else 10_000)
        got = minhash.jaccard_join(df).collect()
        assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    kept = minhash.without_near_copies(df.unionByName(df)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c, _ in want})


def drifting(rng, n, words=120):
    """Texts of which each is near the one before and the one after, and no other."""
    w = [f"d{rng.randrange(10**6)}" for _ in range(words)]
    for k in range(n):
        yield " ".join(w)
        for j in (0, 1):
            w[(20 * k + 10 * j) % words] = f"e{rng.randrange(10**6)}"


def test_classes_without_counts_lose_no_link(docs, empty, spark, monkeypatch):
    rng = random.Random(51)
    chain = list(drifting(rng, 40))
    around = chain[0].split()  # a core of many near copies, from which a chain leads away
    core = [" ".join([*around[:k], f"c{k}", *around[k + 1 :]]) for k in range(120)]
    texts = [*chain, *core, *core[:9], *drifting(rng, 30), *near_family(rng, 30), *[prose(rng, 60) for _ in range(20)], "one two", "one two", "", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = {i: c for i, c, _ in plain_classes(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    paired = []
    decide = minhash.decided
    monkeypatch.setattr(minhash, "decided", lambda *args, **named: paired.append(args[1]) or decide(*args, **named))
    for block, size in ((1024, 1 << 30), (8, 1 << 30), (1024, 1 << 13)):  # whole families, then blocks by texts and by bytes
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
        paired.clear()
        classes = minhash.near_classes(df).collect()
        assert len(paired) == (1 if block == 1024 and size == 1 << 30 else 2)  # what is left is compared with all where there are blocks
        roots = {}
        for r in classes:
            roots[r["root"]] = min(r["first_id"], roots.get(r["root"], r["first_id"]))
        assert {r["first_id"]: roots[r["root"]] for r in classes} == {r["first_id"]: want[r["first_id"]] for r in classes}
        alone = Counter(want.values())
        assert {r["first_id"] for r in classes if r["alone"]} == {i for i, c in want.items() if alone[c] == 1}
        assert sorted(r["doc_id"] for r in minhash.without_near_copies(df).collect()) == sorted(set(want.values()))
    assert minhash.near_classes(empty).collect() == []
    assert minhash.near_classes(docs).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_pairs_at_exactly_the_threshold_are_linked(spark):
    for c in range(4, 4001, 4):  # c of c + c / 4 distinct shingles are 0.8; one more shingle is less
        a = np.arange(c, dtype=np.uint64)
        whole = np.arange(c + c // 4, dtype=np.uint64)
        assert minhash.link_matrix([a, whole], 0.8).tolist() == [[False, True], [True, False]], c
        assert not minhash.link_matrix([a, np.append(whole, np.uint64(10**6))], 0.8).any(), c
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[:220]), " ".join(words[:274]), " ".join(words[300:320]), " ".join(words[300:324]), " ".join(words[300:325])]
    got = minhash.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == plain_classes(list(enumerate(texts)))


def test_unlike_texts_with_null_or_repeated_ids_are_all_kept(spark):
    rng = random.Random(10)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(12)]
    near = f"{texts[0]} more"
    rows = [(None, t) for t in texts[:6]] + [(5, t) for t in texts[6:]] + [(None, near), (3, texts[1]), (5, texts[6]), (None, None)]
    kept = minhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], r["text"]) for r in kept)
    assert got == Counter([(3, texts[1]), (None, None), *[(None, t) for t in texts[2:6]], *[(5, t) for t in texts[6:]], *[x for x in got if x in {(None, texts[0]), (None, near)}][:1]])


def test_filters_let_all_their_keys_through(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    for bits in (1 << 10, 1 << 20):  # a filter that is too small lets more through, never less
        f = KeyFilter(keys, bits)
        both = spark.range(4000).select("id", F.xxhash64("id").alias("key"), F.array(F.xxhash64("id"), F.xxhash64(F.col("id") + 1000)).alias("list"))
        got = {r["id"]: (r["may"], len(r["some"])) for r in both.select("id", f.may_hold(F.col("key")).alias("may"), f.only_held(F.col("list")).alias("some")).collect()}
        assert all(got[k][0] and got[k][1] >= 1 for k in range(1000))
        if bits == 1 << 20:
            assert sum(may for may, _ in got.values()) < 1200 and sum(n for _, n in got.values()) < 1500
    assert not any(r[0] for r in spark.range(50).select(KeyFilter(keys.limit(0)).may_hold(F.col("id"))).collect())


def test_survivors_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "y", 1), (1, "a b c d e f", "x", 2), (2, "a b c d e f", "w", 3), (None, "q w e r t y", None, 4), (4, None, "v", 5), (5, "", "u", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __digest string, may int").withColumnsRenamed({"may": "row"})
    kept = minhash.without_near_copies(df)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(1, "a b c d e f", "x", 2), (None, "q w e r t y", None, 4), (4, None, "v", 5)])
    assert minhash.without_near_copies(df.limit(0)).collect() == []


def test_a_family_of_long_texts_is_cut_by_bytes(spark):
    rng = random.Random(41)
    base = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    texts = [" ".join([*base, f"end{k}"]) for k in range(24)]  # 0.2 MB each
    got = minhash.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 23)}


def test_bands_reach_the_recall():
    b = minhash.bands_for(0.8, 0.9995, 6)
    assert 1 - (1 - 0.8**6) ** b >= 0.9995 > 1 - (1 - 0.8**6) ** (b - 1)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + d, i) for i in range(60) for d in (0, 1)] + [(200, 900), (201, 900)], "node long, hub long")
    got = {r["node"]: r["root"] for r in minhash.components(edges).collect()}
    assert got == dict.fromkeys(range(61), 0) | {200: 200, 201: 200}


# suffix tree


def test_suffix_tree(docs, empty, spark):
    held = id_bucket("doc_id", 7) == 2
    model = suffix_tree.learn(docs.where(~held))
    got = suffix_tree.score(docs.withColumn("held_out", held), model, extra=("held_out",)).collect()
    rows = hostile()
    words = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    count = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            count.update(words(t) + [None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t, *_ in rows:
        tokens = words(t) + [None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        want[(i, len(tokens), sum(count[w] > 0 for w in tokens), round(base, 3))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 3)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    assert suffix_tree.score(empty, model).collect() == []
    unlearned = suffix_tree.score(docs, suffix_tree.learn(empty)).where("doc_id = 3").first()
    assert (unlearned["base_score"], unlearned["n_known"]) == (0.0, 0)
    assert unlearned["score"] == pytest.approx(3 * math.log10(1 / 256), abs=1e-4)


def plain_tree(train, least, core):
    """Next-byte probabilities by context, and the retained contexts, from the texts themselves: those of ``core`` occurrences as a tree, others of full depth on top of it."""
    body = lambda t: b"".join(w + b" " for w in t.encode().lower().split()) + b"\n"
    depth, counts, total = suffix_tree.DEPTH, defaultdict(Counter), 0
    for t in train:
        x = b"\n" * depth + body(t or "")
        for i in range(depth, len(x)):
            total += 1
            for d in range(depth + 1):
                counts[x[i - d : i]][x[i]] += 1
    of = {c: sum(n.values()) for c, n in counts.items()}
    chance, kept = {b"": {s: (counts[b""][s] + 1) / (of[b""] + 256) for s in range(256)}}, {b""}

    def add(c, prior):
        n, kinds = of[c], len(counts[c])
        chance[c] = {s: (counts[c][s] + kinds * prior[s]) / (n + kinds) for s in range(256)}
        return sum(k * math.log(k / n / prior[s]) for s, k in counts[c].items()) > 0.5 * kinds * math.log(total)

    for c in sorted((c for c in of if c and of[c] >= core), key=len):
        if add(c, chance[c[1:]]):
            kept |= {c[k:] for k in range(len(c))}
    inner = set(kept)
    longest = lambda c, some: next(c[k:] for k in range(len(c) + 1) if c[k:] in some)
    for c in of:
        if len(c) == depth and least <= of[c] < core and add(c, chance[longest(c, inner)]):
            kept.add(c)

    def score(t):
        x = b"\n" * depth + body(t or "")
        return sum(math.log10(chance[longest(x[i - depth : i], kept)][x[i]]) for i in range(depth, len(x)))

    def prefix(x):
        y = b"\n" * depth + x
        return sum(math.log10(chance[longest(y[i - depth : i], kept)][y[i]]) for i in range(depth, len(y)))

    score.prefix = prefix
    return score, inner, kept


@pytest.mark.parametrize(("least", "most", "part", "travelling"), [(2, 1 << 16, 1 << 20, 1 << 20), (2, 40, 1 << 20, 0), (2, 40, 1 << 20, 40), (5, 150, 64, 1 << 20)])
def test_scores_against_a_plain_tree(spark, monkeypatch, least, most, part, travelling):
    """The core alone; a core with many contexts beyond it that are joined, travel in part, or travel all; texts in parts."""
    monkeypatch.setattr(suffix_tree, "TRAVELLING", travelling)
    rng = random.Random(71)
    texts = [prose(rng, rng.randrange(0, 60), ["abab", "bca", "é", "a", "cabb", "zz"]) for _ in range(120)] + [None, "", "abab" * 50, "new wörds only"]
    monkeypatch.setattr(suffix_tree, "LEAST", least)
    monkeypatch.setattr(suffix_tree, "CORE", most)
    monkeypatch.setattr(suffix_tree, "BATCH_BYTES", part)
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 7 != 2], "doc_id long, text string")
    model = suffix_tree.learn(train)
    everything = [t for i, t in enumerate(texts) if i % 7 != 2]
    core = next(c for k in range(20) if (c := least << k) and len([1 for x in plain_contexts(everything).values() if x >= c]) <= most)
    score, inner, kept = plain_tree(everything, least, core)
    assert len(kept) > len(inner) if most < 1000 else kept == inner
    near = 0 if model.near is None else len(model.near.context)
    assert model.beyond.count() + near == len(kept) - len(inner) and len(inner) > 5
    assert most > 1000 or (near > 0) == (travelling > 0) and (model.beyond_filter is None) == (travelling > 1000)
    got = suffix_tree.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        assert r["score"] == pytest.approx(score(texts[r["doc_id"]]), rel=1e-5, abs=1e-4), texts[r["doc_id"]]


@pytest.mark.parametrize(("least", "most", "part", "travelling"), [(2, 1 << 16, 1 << 20, 1 << 20), (2, 40, 1 << 20, 0), (2, 40, 1 << 20, 40), (5, 150, 64, 1 << 20), (2, 0, 1 << 20, 40)])
def test_whole_tree_does_not_depend_on_what_the_core_holds(spark, monkeypatch, least, most, part, travelling):
    """Contexts of every depth, retained as by one plain tree, whatever the core has room for and whatever travels."""
    rng = random.Random(71)
    texts = [prose(rng, rng.randrange(0, 60), ["abab", "bca", "é", "a", "cabb", "zz"]) for _ in range(120)] + [None, "", "abab" * 50, "new wörds only"]
    for name, value in (("TRAVELLING", travelling), ("LEAST", least), ("CORE", most), ("BATCH_BYTES", part), ("FAMILY_ROWS", 7)):
        monkeypatch.setattr(suffix_tree, name, value)
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 7 != 2], "doc_id long, text string")
    model = suffix_tree.learn(train, whole=True)
    score, _, kept = plain_tree([t for i, t in enumerate(texts) if i % 7 != 2], least, least)
    near = set() if model.near is None else set(model.near.context.tolist())
    beyond = {r["key"] for r in model.beyond.collect()}
    assert not near & beyond and (travelling > 0 or not near)
    outside = {(k & ((1 << 40) - 1)).to_bytes(k >> 40, "big") for k in near | beyond}
    assert outside <= kept and len(outside) + model.tree.contexts == len(kept)
    assert most > 1000 and not outside or len({len(c) for c in outside}) > 2
    got = suffix_tree.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        assert r["score"] == pytest.approx(score(texts[r["doc_id"]]), rel=1e-5, abs=1e-4), texts[r["doc_id"]]


def test_whole_tree_has_words_as_contexts_whatever_travels(spark, monkeypatch):
    """The words that are contexts follow from their occurrences, not from how many words or followers travel."""
    rng = random.Random(72)
    once = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(3, 6))) for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*once, *once[:15], "aaa bbb aaa bbb aaa ccc", None])), "doc_id long, text string")
    found = []
    for frequent, core, travelling in ((1 << 19, 1 << 16, 1 << 21), (0, 40, 0), (50, 40, 100)):
        for name, value in (("FREQUENT", frequent), ("CORE", core), ("TRAVELLING", travelling)):
            monkeypatch.setattr(suffix_tree, name, value)
        model = suffix_tree.learn(df, whole=True)
        assert (model.beyond_filter is None) == (core > 1000)
        assert [tuple(r)[1:] for r in suffix_tree.score(df.where("text is null"), model).collect()] == [pytest.approx(tuple(r)[1:]) for r in suffix_tree.score(df, model).where("doc_id = 76").collect()]
        found.append(({tuple(r) for r in model.pairs.collect()}, {r["doc_id"]: tuple(r)[1:] for r in suffix_tree.score(df, model).collect()}))
    assert len(found[0][0]) > 50 and found[0][0] == found[1][0] == found[2][0]
    for k, row in found[0][1].items():
        assert row == pytest.approx(found[1][1][k], rel=1e-6) and row == pytest.approx(found[2][1][k], rel=1e-6)


def test_op10_does_not_depend_on_what_the_core_holds(spark, monkeypatch):
    want = {r["doc_id"]: r for r in queries.op10_suffix_tree(spark, SF).collect()}
    monkeypatch.setattr(suffix_tree, "CORE", 300)
    monkeypatch.setattr(suffix_tree, "FREQUENT", 50)
    for r in queries.op10_suffix_tree(spark, SF).collect():
        assert tuple(r) == pytest.approx(tuple(want[r["doc_id"]]), rel=1e-5)


def plain_contexts(train):
    out = Counter()
    for t in train:
        x = b"\n" * suffix_tree.DEPTH + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n"
        out.update(x[i - d : i] for i in range(suffix_tree.DEPTH, len(x)) for d in range(1, suffix_tree.DEPTH + 1))
    return out


def test_whole_words_as_contexts_against_a_plain_version(spark, monkeypatch):
    """With no word frequent, every retained word is a context of the next word whole; documents that occur twice are told apart."""
    rng = random.Random(72)
    once = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(3, 6))) for _ in range(30)) for _ in range(60)]
    texts = [*once, *once[:15], "aaa bbb aaa bbb aaa ccc", None]
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = suffix_tree.learn(df)
    score, _, _ = plain_tree(texts, suffix_tree.LEAST, suffix_tree.LEAST)
    lp = lambda before, after: score_of(score, before, after)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    pairs, total = Counter(), sum(len(b" ".join(tokens(t)[:-1])) + (2 if tokens(t)[:-1] else 1) for t in texts)
    prior = {}
    for t in texts:
        x = tokens(t)
        for i in range(len(x) - 1):
            pairs[x[i], x[i + 1]] += 1
            prior[x[i], x[i + 1]] = max(prior.get((x[i], x[i + 1]), -999), lp(x[: i + 1], x[i + 1]))
    kept = {}
    for w in {a for a, _ in pairs}:
        mine = {b: c for (a, b), c in pairs.items() if a == w}
        n = sum(mine.values())
        if n >= 2 and sum(c * (math.log(c / n) - math.log(10) * prior[w, b]) for b, c in mine.items()) > 0.5 * len(mine) * math.log(total):
            kept[w] = (n, len(mine))
    assert 50 < len(kept) and model.pairs.count() == sum(k for _, k in kept.values())
    got = {r["doc_id"]: r for r in suffix_tree.score(df, model).collect()}
    for i, t in enumerate(texts):
        want, x = score(t), tokens(t)
        for k, w in enumerate(x[:-1]):
            if w in kept:
                n, kinds = kept[w]
                p = 10.0 ** lp(x[: k + 1], x[k + 1])
                want += math.log10((pairs[w, x[k + 1]] + kinds * p) / (n + kinds) / p)
        assert got[i]["score"] == pytest.approx(want, rel=1e-4, abs=1e-3), i
    twice, single = ([got[i]["score"] / got[i]["n_tokens"] for i in some] for some in (range(15), range(15, 60)))
    assert min(twice) > max(single)


def test_what_follows_some_words_is_scored_alike():
    rng = random.Random(73)
    texts = [prose(rng, n).encode() for n in (0, 1, 2, 40, 500)] + [b"", b" a  b "]
    counted = [(d, c) for t in texts for x in [b"\n" * 5 + suffix_tree.spaced(t)] for i in range(5, len(x)) for d in range(6) for c in [int.from_bytes(x[i - d : i + 1], "big")]]
    levels = Counter(counted)
    import pandas as pd

    tree = suffix_tree.grow(pd.DataFrame([(d, c, n) for (d, c), n in levels.items()], columns=["d", "code", "n"]), len(counted) // 6)
    w, by_word = suffix_tree.hashed(texts), []
    suffix_tree.tree_scores(tree, texts, None, None, by_word)
    want = suffix_tree.followed(w, *by_word)
    some = np.array(sorted(rng.sample(range(len(want)), 200)))
    assert np.allclose(suffix_tree.followed_by(tree, None, texts, w, some), want[some], atol=1e-4)
    assert np.allclose(suffix_tree.followed_by(tree, None, texts, w, np.arange(len(want))), want, atol=1e-4)


def score_of(score, before, after):
    """log10 probability of the next word, or of the end, after some words, from a plain score of whole texts."""
    text = lambda words: b" ".join(words).decode()
    if after is None:
        return score(text(before)) - score.prefix(b" ".join(before) + b" ")
    return score.prefix(b" ".join([*before, after]) + b" ") - score.prefix(b" ".join(before) + b" ")


def test_tree_is_a_distribution_and_grows_with_the_corpus(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tree = suffix_tree.learn(d).tree
    width = tree.logp.shape[1]
    unseen = 256 - (width - 1)
    mass = (10.0 ** tree.logp[:, :-1]).sum(axis=1) + unseen * 10.0 ** tree.logp[:, -1]
    assert np.allclose(mass, 1, atol=1e-3) and tree.contexts > 100
    more = suffix_tree.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert more.tree.contexts > 1.5 * tree.contexts


def test_contexts_that_the_core_has_no_room_for_are_in_the_table(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CORE", 300)
    monkeypatch.setattr(suffix_tree, "TRAVELLING", 0)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = suffix_tree.learn(d)
    assert model.beyond.count() > 300
    rich = suffix_tree.score(d, model).agg(F.sum("score")).first()[0]
    poor = sum(suffix_tree.tree_scores(model.tree, [(r["text"] or "").lower().encode() for r in d.collect()])[0])
    assert rich > poor


def test_rare_words_are_joined(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    all_frequent = {r["doc_id"]: r for r in suffix_tree.score(d, suffix_tree.learn(d)).collect()}
    monkeypatch.setattr(suffix_tree, "FREQUENT", 50)
    for r in suffix_tree.score(d, suffix_tree.learn(d)).collect():
        o = all_frequent[r["doc_id"]]
        assert r["base_score"] == pytest.approx(o["base_score"], abs=1e-6) and r["n_known"] == o["n_known"] == r["n_tokens"]


# pipeline and helpers


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == columns, name
        assert 0 < kept.count() <= before
        before = kept.count()
    assert all(not plain_spans(r["text"]) for r in kept.collect())
    texts = {r["doc_id"] for r in kept.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == texts
    packed_ok(rows, [(r["doc_id"], r["text"]) for r in kept.collect()])


def test_pipeline_rejects_and_keeps(spark):
    rng = random.Random(9)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [r["text"] for r in d.where("length(text) between 900 and 4000").limit(200).collect()]
    clean = [t for t in clean if quality.measure([t], zstandard.ZstdCompressor(level=3))[0]["kept"]][:3]
    rows = [(90_000 + i, t, "en", "s", len(t)) for i, t in enumerate([*clean, "12 34 | 56 " * 40, "again " * 300])]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = d.unionByName(extra)
    lang = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, both, SF).collect()}
    good = {r["doc_id"] for r in corpus_pipeline.check_quality(spark, both, SF).collect()}
    assert {90_000, 90_001, 90_002} <= lang & good and 90_003 not in lang and 90_004 not in good
    assert rng


def test_unknown_languages_are_rejected(spark):
    others = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "minden emberi lény szabadon születik és egyenlő méltósága és joga van az emberek ésszel és lelkiismerettel bírván",
        "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
    ]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_000 + i, f"{t} " * 20, None, "s", 20 * len(t)) for i, t in enumerate(others)], "doc_id long, text string, lang string, source string, n_chars long")
    both = d.unionByName(extra)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, both, SF).collect()}
    assert not kept & {90_000, 90_001, 90_002}
    assert {r["doc_id"] for r in d.where("n_chars > 300").collect()} <= kept


def plain_pipeline(rows, spark):
    """The pipeline on (doc_id, text, lang), each text by itself: (doc_id, text) of what is packed."""
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string, lang string")
    profiles = language.learn(frame([r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 4 != 2]))
    squeeze = zstandard.ZstdCompressor(level=3)
    kept = []
    for r in rows:
        (lang,), (score,) = language.predict([r[1] or ""], profiles)
        if lang != "und" and score >= corpus_pipeline.LEAST_NEAR * min(1, len(r[1]) / corpus_pipeline.SHORT) ** 0.5 and quality.measure([r[1]], squeeze)[0]["kept"]:
            kept.append(r)
    least = {t: min((i is None, i) for i, u, _ in kept if u == t) for t in {r[1] for r in kept}}
    grams = {t: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t)] for k in range(len(w) - 4)} for t in least}
    todo, first = set(least), []
    while todo:
        group, edge = set(), {todo.pop()}
        while edge:
            group |= edge
            edge = {u for t in edge for u in todo - group if len(grams[t] & grams[u]) * 5 >= 4 * len(grams[t] | grams[u])}
            todo -= edge
        first.append(min(group, key=lambda t: (least[t], hashlib.md5(t.encode()).digest())))
    w = pii.learn(frame([(None, t, None) for t in first]))
    return [(least[t][1], pii.cover(t, pii.find([t], w, {})[0])) for t in first]


@pytest.fixture(scope="module")
def mixed(spark):
    """The small table, and beside it nulls, repeats, a long text and columns of clashing names."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(61)
    clean = [r["text"] for r in d.where("length(text) between 900 and 4000").orderBy("doc_id").limit(6).collect()]
    shuffled = " ".join(rng.sample(clean[4].split(), len(clean[4].split())))
    rows = [(None, clean[0], "en"), (None, None, None), (5, clean[1], "en"), (5, clean[1], "en"), (5, clean[2], "de"), (90_001, clean[3] + " more words here", "en"), (90_002, "", "en"), (90_003, " \n ", None), (90_004, f"{shuffled} +1 (555) 555-0100 4111111111111111 ", "xx")]
    rows += [(90_005, " ".join(rng.choice(clean[k % 6].split()) for k in range(60_000)), "en")]
    extra = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], d.schema)
    return d.unionByName(extra).withColumns({"found": F.lit(1), "__digest": F.lit("x"), "row": F.lit(2), "may": F.lit(3), "Found_": F.lit("y")})


def test_pipeline_against_the_plain_version(mixed, spark):
    want = plain_pipeline([(r["doc_id"], r["text"], r["lang"]) for r in mixed.collect()], spark)
    docs = mixed
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.cache()
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(want)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.select("n_chars", "text").collect())
    packed_ok(corpus_pipeline.pack_sequences(spark, docs, SF).collect(), want)


def test_pipeline_of_nothing(mixed, spark):
    for some in (mixed.limit(0), mixed.where("text is null")):
        docs = some
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_tables_of_a_block_are_removed(spark):
    path = None
    with common.short_lived(spark):
        df = common.checkpointed(spark.range(5))
        path = df.inputFiles()[0].removeprefix("file://")
        assert Path(path).exists() and df.count() == 5
    assert not Path(path).exists()


def test_pieces():
    assert list(pieces([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(pieces([], 6)) == []


def test_digests_are_of_real_outputs(spark):
    enc = model_of()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_bpe(spark, SF).limit(20).collect():
        ids = np.array(enc.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_masked_texts_leave_a_batch_slice_by_slice(monkeypatch):
    made = []
    monkeypatch.setattr(pii.F, "arrow_udf", lambda kind: lambda f: made.append(f) or f)
    pii.masked(None, pii.fit_weights({}))
    texts = [f"{'word ' * 400} a{k}@b.co" for k in range(2000)] + [None, ""]
    gc.collect()
    before = pa.total_allocated_bytes()

    def batches():
        yield pa.array(texts, pa.string())
        yield pa.array([], pa.string())

    done, most = [], 0
    for some in made[0](batches()):
        most = max(most, some.nbytes)
        done += some.to_pylist()
    del some
    assert done == [t and f"{'word ' * 400} [EMAIL]" for t in texts]
    assert most < 2 * common.SLICE_BYTES  # of some 4 MB
    assert pa.total_allocated_bytes() == before
