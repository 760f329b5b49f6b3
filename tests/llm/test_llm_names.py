"""Columns of the caller keep their values, whatever their names."""

from cohortia.llm import language_id, line_dedup, mixing, ngram_join

NAMES = ["_text", "_n_lines", "_doc", "_th", "_at", "_key", "_copy", "_copies", "doc", "th", "removed", "copies", "key", "Copy_", "equal_at"]


def frame(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "der die das und ist nicht ein\nder die das und ist nicht ein", None, ""]
    rows = [(k, t, *(f"{name}{k}" for name in NAMES)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_other_columns_stay_as_they_are(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(0, "a"), (2, "b"), (1, "a")], "doc_id long, domain string")
    known = language_id.learn(spark.createDataFrame([(1, "one two three", "en"), (2, "der die das", "de")], "doc_id long, text string, lang string"))
    for found in (line_dedup.dedup_lines(docs), ngram_join.one_of_each(docs), mixing.mixed(docs, labels, {"a": 0.5, "b": 0.5}, least=1.0),
                  language_id.keep_known(docs, known)):
        rows = found.collect()
        assert rows and set(docs.columns) <= set(found.columns)
        for r in rows:
            assert [r[name] for name in NAMES] == [f"{name}{r.doc_id}" for name in NAMES]
