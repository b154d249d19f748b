"""A caller's own columns come back as they were, whatever their names."""

import corpus_pipeline
from verdikt.llm import language, mixing, rows, surrogates, urls

NAMES = ["_found", "_again", "_mark", "_key", "_id", "_size", "_copy", "_copies", "_x_own", "__x_key", "key", "form", "found", "judged", "a.b"]


def with_names(spark, data, schema):
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *(f"{k}-{n}" for n in NAMES)) for k, r in enumerate(data)], f"{schema}, {extra}")


def own(df):
    """The callers' columns of each row, and the row's text."""
    at = [df.columns.index(n) for n in NAMES]
    return sorted(tuple(r[i] for i in at) for r in df.collect())


def test_prefix_is_free(spark):
    df = spark.createDataFrame([(1, 2)], "_X_a int, __x_b int")
    assert not any(c.lower().startswith(rows.free(df)) for c in df.columns)


def test_surrogates(spark):
    df = with_names(spark, [(1, "mail a@b.de now"), (2, None), (3, "")], "doc_id long, text string")
    out = surrogates.replaced(df, "k")
    assert out.columns == [*df.columns, "n_entities"] and own(out) == own(df)
    assert not any("a@b.de" in str(v) for r in out.collect() for v in r)


def test_stages(spark, sf_dir):
    texts = [(k, f"the plain words of text number {k} are here to stay", "en", "s", 40) for k in range(6)]
    df = with_names(spark, texts, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, sf_dir).columns == df.columns
    model = language.train(df)
    assert own(language.identify(df, model)) == own(df)
    assert own(rows.without(df, df.limit(0).select("key"), "doc_id", "text")) == own(df)
    twice = df.unionAll(df)
    keys = df.select(rows.row_key("doc_id", "text").alias("key"))
    assert own(rows.once(twice, keys, "doc_id", "text")) == own(df)
    out = mixing.mixed(df)
    assert out.columns == df.columns and set(own(out)) <= set(own(df))


def test_urls(spark):
    df = with_names(spark, [(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/", "block")], "host string, path string, action string")
    for limit in (10, 0):
        assert own(urls.judged(df, rules, trie_rules=limit)) == own(df)
