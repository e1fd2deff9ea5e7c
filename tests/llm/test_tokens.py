from jobloom.llm.tokens import default_path, default_pattern, encoder, with_tokens


def test_counts(spark):
    texts = ["Olá, mundo", "", None, "<|endoftext|> x", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.n_tokens for r in with_tokens(df, "text").collect()}
    e = encoder(default_path(), default_pattern())
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)} and got[0] > 0
    assert e.decode(e.encode_ordinary(texts[0])) == texts[0]
