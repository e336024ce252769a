import zlib

import pytest

from varispan.llm import langid


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: (r.lang, len((r.text or "").split())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op7_langid(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    test = [(r.lang_pred == truth[r.doc_id][0]) for r in rows if r.held_out and truth[r.doc_id][0] is not None]
    assert sum(test) / len(test) > 0.95


def test_held_out_rows_teach_nothing(spark):
    """A language that only held-out rows have is never predicted."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows = [(i, "the cat sat on the mat and saw the dog " * 3, "en") for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:30] + [(held, "der hund und die katze sind im haus " * 3, "de")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[held].lang_pred == "en" and got[held].held_out


@pytest.mark.parametrize("text", [None, "", " \n", "123 !?", "____"])
def test_no_letters(spark, text):
    rows = [(i, "some words of text here " * 4, "en") for i in range(12)] + [(99, text, "en")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[99].lang_pred, got[99].score, got[99].rejected) == ("und", 0.0, True)


def test_odd_rows(odd, nothing):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {"en", "und"}
    assert langid.identify(nothing).count() == 0


def test_narrow_margins_are_rejected(spark):
    raw = {"a": b"alpha beta gamma delta " * 20, "b": b"alpha beta gamma delta " * 20}
    r = langid.predict(spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string"), raw).first()
    assert r.rejected and r.lang_pred == "a"


def test_signs_are_not_letters(spark):
    raw = {"de": b"der die das und nicht ist", "en": b"the and of that is not"}
    rows = [(1, "² ½ ①"), (2, "12 _ ²!"), (3, "²a"), (4, "ª"), (5, "中")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), raw).collect()}
    assert got[1] == got[2] == ("und", 0.0)
    assert all(got[i][0] in raw for i in (3, 4, 5))
    assert [langid.has_letter(t) for t in ("", "²³¹¼½¾", "x²", "é", "ª")] == [False, False, True, True, True]
