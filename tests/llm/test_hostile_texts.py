"""Texts made to stall or blow up a scanner, and columns whose names are the operators' own."""

import random
import re
import time
from itertools import pairwise

import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fields(spark):
    from tessera.llm import pii

    return pii.train(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1.22." * 200_000, "a" * 1_000_000 + "@", "@" * 300_000, "+1 (" * 40_000, "12 345678 " * 10_000, "x" * 500_000 + "7" * 500_000])
def test_personal_data_in_linear_time(text, fields):
    from tessera.llm import pii

    began = time.time()
    pii.find_spans(text, fields)
    assert time.time() - began < 5


def test_base_spans_are_the_patterns_own(spark):
    from tessera.llm import pii

    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["1", "22", "255", "256", ".", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "4111111111111111"]) for _ in range(60)) for _ in range(3000)]
    for t in texts:
        want = [(0, m.start(), m.end()) for m in pii.EMAIL.finditer(t)]
        want += [(1, m.start(), m.end()) for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(2, m.start(), m.end()) for m in pii.CARD.finditer(t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [(3, m.start(), m.end()) for m in pii.PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(t) == want


def test_segmentation_is_the_best_of_all(fields):
    from tessera.llm import pii

    rng = random.Random(8)
    for _ in range(60):
        zone = "".join(rng.choice(["12", "3456", "4111111111111111", " ", "-", ".", "@", "ab", "+1"]) for _ in range(9))
        tokens, segments, x = pii._candidates(zone)
        value = {s: v for s, v in zip(segments, (x @ fields.weights.T).max(axis=1), strict=True)}
        outside = [fields.outside[fields._class(zone, t)] for t in tokens]

        def best(i):
            if i == len(tokens):
                return 0.0
            return max([outside[i] + best(i + 1), *(v + best(j) for (a, j), v in value.items() if a == i)])

        found = fields.best(zone, slab=2)
        at = {t[0]: k for k, t in enumerate(tokens)} | {len(zone): len(tokens)}
        inside = [(at[a], at[b]) for _, a, b in found]
        assert all(b <= c for (_, b), (c, _) in pairwise(inside))
        free = [k for k in range(len(tokens)) if not any(a <= k < b for a, b in inside)]
        assert sum(value[s] for s in inside) + sum(outside[k] for k in free) == pytest.approx(best(0))


@pytest.mark.parametrize(
    "page",
    [
        "<p>kept</p>" + '<a "' * 100_000, "<p>kept</p>" + "<a '\"" * 100_000 + ">", "<b>" * 50_000 + "<p>x</p>" * 20_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "kept",
        "<p " + "a" * 1_000_000 + ">kept</p>", "<div>x" * 30_000, "<a" * 200_000 + "<p>kept", "<!--" * 100_000, "<h1>" * 50_000 + "kept", "<li>" * 50_000, "<p>" + "\t\n " * 300_000 + "kept",
    ],
    ids=range(11),
)
def test_pages_in_linear_time(page):
    from tessera.llm import html_text as h

    model = h.Boosted([h.np.zeros(0)] * h.N_FEATURES, [], 1.0)
    began = time.time()
    text = h.main_texts([page], model)[0]
    assert time.time() - began < 5
    assert ("kept" in text) == ("kept" in page)


def test_markup_is_read_as_a_regex_reads_it():
    from tessera.llm import html_text as h

    whole = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/><]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    rng = random.Random(5)
    for _ in range(4000):
        page = "".join(rng.choice(["<", ">", '"', "'", "a", "p ", "/", "<!--", "-->", "<b", " x=", "<p>", "=", "\n", "!"]) for _ in range(rng.randint(1, 25)))
        want = [(m.start(), m.end(), m[1] == "/", (m[2] or "").lower()) for m in whole.finditer(page)]
        markup, at, found = h._Markup(page), 0, []
        while m := markup.after(at):
            found.append(m[:4])
            at = m[1]
        assert found == want, page


NAMES = "score predicted held_out shard slot law size class_id set_id kept n_links rep digest bands spans n_email fingerprint start length offset sequence_id label __id __text __sha __slot __score a b u v".split()


def _clash(spark):
    body = " ".join(f"w{i}" for i in range(80))
    texts = [None, "", body, body, body + " tail", "mail a.b@c.org now", None, body]
    ids = [1, 2, 3, 4, 5, 6, None, 3]
    rows = [(i, t, "en", "s", 1, *(f"{n}{k}" for n in NAMES)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows[-1] = (*rows[-1][:5], *rows[2][5:])  # one row repeated whole
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_of_any_name(spark, stage):
    import corpus_pipeline

    docs, (name, run) = _clash(spark), corpus_pipeline.STAGES[stage]
    out = run(spark, docs, "/root/testdata/sf0.001")
    given = {tuple(r) for r in docs.collect()}
    assert run(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    if name == "packing":
        assert out.count() == 8
        return
    assert out.columns == docs.columns
    rows = [tuple(r) for r in out.collect()]
    if name == "personal data":
        given = {r[:1] + r[2:4] + r[5:] for r in given}
        rows = [r[:1] + r[2:4] + r[5:] for r in rows]
    assert set(rows) <= given
    if name == "n-gram jaccard join":
        assert sorted((r[0] is None, r[0] or 0) for r in rows) == [(False, 3), (False, 6), (True, 0)]  # null and empty texts are alike


def test_one_row_of_each_class(spark):
    from tessera.llm.near_join import near_join, one_of_each

    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, "hello"), (1, "hello"), (7, text("a")), (7, text("a") + " x"), (8, text("a") + " y"), (7, text("b")), (9, text("b") + " z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in one_of_each(frame).collect()]
    assert len(kept) == 3 and {t[0] for t in (r[1] for r in kept)} == {"h", "a", "b"} and all(r in rows for r in kept)
    assert near_join(frame).filter("kept").count() == 4
