"""Identifiers that are null, or stand on different texts, do not mix up the n-gram join's sets."""


def test_sets_with_one_identifier_stay_apart(spark):
    from tessera.llm.near_join import near_join

    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (1, text("a") + " more"), (2, text("b") + " more")]
    rows += [(7, text("c")), (7, text("d")), (8, text("c") + " more"), (9, text("e"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in near_join(frame).select("doc_id", "class_id", "set_id", "n_copies", "n_links").collect()), key=str)
    want = [(None, None, None, 1, 1), (None, None, None, 1, 1), (1, None, 1, 1, 1), (2, None, 2, 1, 1)]
    want += [(7, 7, 7, 1, 0), (7, 7, 7, 1, 1), (8, 7, 8, 1, 1), (9, 9, 9, 1, 0)]
    assert found == sorted(want, key=str)
