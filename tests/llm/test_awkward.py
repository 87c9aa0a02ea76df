"""Rows that the other tests of these operators leave out: empty tables, repeated ids, very long texts, ties."""

from pyspark.sql import functions as F

from beliefline.llm import chat, langid, mixing, warc


def test_warc_without_pages(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write(warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.read(spark, path).count() == 0


def test_warc_of_repeated_ids(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (2, "v", "same"), (1, "u", "other"), (3, None, None), (4, "x", "")]
    path = f"file://{tmp_path}/repeated"
    warc.write(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))), path)
    got = sorted((r["record_id"] or "", r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in warc.read(spark, path).collect())
    want = [("1", "response", "", 5), ("1", "revisit", "2", 4), ("1", "revisit", "2", 4), ("2", "response", "", 4), ("2", "response", "", 4), ("3", "revisit", "4", 0), ("4", "response", "", 0)]
    assert got == sorted(want)


def test_a_very_long_text_in_a_mix(spark):
    rows = [(1, "word " * 600_000, "a"), (2, "word " * 10, "a"), (3, "word " * 50, "b")]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["size"] == 600_000 and all(r["taken"] == r["size"] * r["times"] and r["times"] <= 3 for r in got.values())


def test_a_very_long_turn(spark):
    said = "### User: \\ </turn> " * 100_000
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "assistant", "short")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == len(said) and got[2]["loss_chars"] == 5


def test_languages_that_tie(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("abc abc", "zz"), ("abc abc", "aa"), ("xyz", "mm"), ("xyz", None)])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame([(1, "abc"), (2, "xyz")], "doc_id long, text string"), model).collect()}
    assert got[1][0] == "aa" and abs(got[1][1] - 0.5) < 0.01, "the first by name of equally likely ones"
    assert got[2][0] == "mm"
