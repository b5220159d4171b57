from zlib import crc32

from flightline.llm.language_id import fold, identify
from flightline.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) / len(held) > 0.97


def test_small_cases(spark):
    rows = [(0, "the cat and the dog", "en", 1), (1, "der hund und die katze", "de", 2), (2, None, "en", 3), (3, "", None, 4), (4, "123 !!", "xx", 5), (5, "und der hund", None, 6),
            (None, "the dog", None, 7), (5, "und der hund", None, 6), (6, "x", None, 1), (7, "the dog " * 90000, "en", 1), (8, "中文字", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in identify(frame, fold("doc_id", 1) == 0).collect()), key=repr)
    pred = {i: p for i, p, _ in got}
    assert len(got) == len(rows)
    assert pred[0] == pred[7] == pred[None] == "en" and pred[1] == pred[5] == "de"
    assert pred[2] == pred[3] == pred[4] == "und" and pred[8] in ("en", "de")
    assert identify(frame.limit(0), fold("doc_id", 1) == 0).collect() == []
    nothing = identify(frame, fold("doc_id", 1) == 9).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and {r["score"] for r in nothing} == {0.0}
