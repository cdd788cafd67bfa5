"""Whole results of the registered queries, held against plain Python on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op2(spark, texts):
    from tessera.llm.sharding import op2_histogram_sort

    found = op2_histogram_sort(spark, SF).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in found) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for i, t in texts.items())
    shards = defaultdict(list)
    for r in found:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(16))
    mean, largest = sum(r["size"] for r in found) / 16, max(r["size"] for r in found)
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        assert abs(sum(r["size"] for r in s) - mean) <= 0.002 * mean * 2 + largest
    # in key order: a text's rows are neighbours in (shard, slot)
    places = defaultdict(list)
    for at, r in enumerate(sorted(found, key=lambda r: (r.shard, r.slot))):
        places[texts[r.doc_id]].append((at, r.doc_id))
    for p in places.values():
        assert p[-1][0] - p[0][0] == len(p) - 1 and [i for _, i in p] == sorted(i for _, i in p)


def test_op4(spark, texts):
    from tessera.llm import pii

    for r in pii.op4_semi_markov_pii(spark, SF).collect():
        t = texts[r.doc_id]
        spans = [("email", m.start(), m.end()) for m in pii.EMAIL.finditer(t)]
        spans += [("ip", m.start(), m.end()) for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        spans += [("card", m.start(), m.end()) for m in pii.CARD.finditer(t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        spans += [("phone", m.start(), m.end()) for m in pii.PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in spans) for kind in pii.KINDS)
        base = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(base) <= set(every) and len(every) == len(base) + r.n_added
        keys = [(pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in every]
        assert keys == sorted(keys) and all(0 <= int(x.split(":")[1]) < int(x.split(":")[2]) <= len(t) for x in every)


def test_op7(spark, texts):
    from tokenizers import Tokenizer

    from tessera.llm.packing import op7_packing, tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    found = defaultdict(list)
    sequences = defaultdict(list)
    for r in op7_packing(spark, SF).collect():
        found[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(found[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    filled = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        filled += at
    assert sorted(sequences) == list(range(len(sequences)))
    assert filled / (2048 * len(sequences)) > 0.99


@pytest.mark.parametrize("special", ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", " <|endoftext", "  x y  \n\n z"])
def test_special_strings_as_the_library_reads_them(special):
    from tokenizers import Tokenizer

    from tessera.llm.packing import Encoder, tokenizer_path

    assert Encoder(tokenizer_path())(special).tolist() == Tokenizer.from_file(tokenizer_path()).encode(special, add_special_tokens=False).ids


def test_op9(spark, texts):
    """Without Spark's hash in Python, sketches are checked by what they must do, and by the hashes Spark gives single shingles."""
    from pyspark.sql import functions as F

    from tessera.llm.fingerprints import op9_scaled_sketch

    order = sorted(texts)
    edited = {}
    for k, i in enumerate(order):
        n, after = len(texts[i]), texts[order[(k + 1) % len(order)]]
        edited[i] = texts[i][: n - n // 2] + after[: n // 2]
    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    grams = lambda t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()
    some = order[:150] + sorted(order, key=lambda i: len(texts[i]))[:60]
    every = sorted({g for i in some for t in (texts[i], edited[i], texts[order[(order.index(i) + 1) % len(order)]]) for g in grams(t)})
    frame = spark.createDataFrame([(k, list(g)) for k, g in enumerate(every)], "k long, g array<string>")
    h = F.xxhash64(*[F.coalesce(F.xxhash64(F.get("g", F.lit(j))).cast("long") if j == 0 else F.when(F.size("g") > j, F.xxhash64(F.get("g", F.lit(j)))), F.lit(0).cast("long")) for j in range(5)])
    value = {every[r.k]: r.h for r in frame.select("k", h.alias("h")).collect()}
    low = -(2**63) + 2**62

    def sketch(t):
        hashes = {value[g] for g in grams(t)}
        kept = frozenset(x for x in hashes if x < low)
        return kept, min(hashes) if hashes and not kept else None

    text = lambda s: "~" + f"{s[1] & (2**64 - 1):016x}" if s[1] is not None else "".join(f"{x & (2**64 - 1):016x}" for x in sorted(s[0]))
    alike = lambda a, b: len(a[0] & b[0]) / len(a[0] | b[0]) if a[0] | b[0] else float(a[1] == b[1])
    found = {r.doc_id: r for r in op9_scaled_sketch(spark, SF).collect()}
    assert found.keys() == texts.keys()
    for i, r in found.items():
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest())
    for i in some:
        r, own, other, after = found[i], sketch(texts[i]), sketch(edited[i]), sketch(texts[order[(order.index(i) + 1) % len(order)]])
        assert (r.fingerprint, r.edited_fingerprint) == (text(own), text(other))
        assert r.near_edited == pytest.approx(alike(own, other)) and r.near_next == pytest.approx(alike(own, after))
    exact = [(r.near_edited, len(grams(texts[i]) & grams(edited[i])) / max(1, len(grams(texts[i]) | grams(edited[i])))) for i, r in found.items() if len(texts[i]) > 4000]
    assert np.mean([abs(a - b) for a, b in exact]) < 0.05
    by_text = defaultdict(set)
    for i, r in found.items():
        by_text[texts[i]].add(r.fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_quality_cut_is_a_quantile(spark):
    from tessera.llm import quality

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    for q in (0.2, 0.5):
        model = quality.fit_bradley_terry(x, y, quantile=q)
        assert model.quantile == pytest.approx(q) and (model.raw(x) < model.threshold).mean() == pytest.approx(q, abs=0.01)
    model = quality.fit_bradley_terry(x, y)
    cuts = np.sort(model.raw(x))
    right = lambda c: ((model.raw(x) >= c) == (y == 1)).sum()
    assert right(model.threshold) == max(right(c) for c in [*cuts, np.inf])
    # the weights are a maximum of the ridge-regularised pair likelihood: no small step raises it
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    pick = np.random.default_rng(quality.SEED)
    d = z[pick.choice(np.flatnonzero(y == 1), quality.PAIRS)] - z[pick.choice(np.flatnonzero(y == 0), quality.PAIRS)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.5e-3 * (w @ w)
    assert all(loss(model.weights + s * e) >= loss(model.weights) for e in np.eye(len(model.weights))[:8] for s in (0.02, -0.02))
