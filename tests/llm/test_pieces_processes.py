"""The digest of short texts runs in one Python process a task."""


def test_short_texts_are_encoded_and_decoded_in_one_pass(spark, monkeypatch):
    from tessera.llm import pieces

    seen = {}

    def kept(df, name):
        seen[name] = df
        return df

    monkeypatch.setattr(pieces, "materialize", kept)
    docs = spark.createDataFrame([(1, "so  it ▁ was\n"), (2, ""), (3, None), (None, "é" * 40), (5, "a long one " * 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encoding_digest(docs, chunk=100).collect()}
    short = seen["digests"]._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert short.count("MapInArrow") == 1
    import zlib

    for k, text in ((1, "so  it ▁ was\n"), (2, ""), (3, ""), (None, "é" * 40), (5, "a long one " * 30)):
        assert (got[k].decoded_chars, got[k].decoded_crc32) == (len(text), zlib.crc32(text.encode()))
    assert (got[2].n_tokens, got[5].chunks) == (0, 4)
