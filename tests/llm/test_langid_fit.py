"""The language fit over all of its texts and languages."""

from gridloom.llm import langid


def test_frequencies_are_of_all_texts_and_every_language_is_learned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, chr(97 + i // 60) * 3 + f" {chr(97 + i // 60)}x" * 5, f"l{i // 60:02}") for i in range(720)], "doc_id long, text string, lang string")
    n, seen = langid.frequencies(docs.selectExpr("text as t"))
    assert n == 720 and seen.max() == 720
    monkeypatch.setattr(langid, "MAX_ROWS", 120)
    model = langid.fit(docs)
    assert model.langs == [f"l{i:02}" for i in range(12)]
