"""Each stage of the pipeline on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import corpus_pipeline as pipeline
import pytest

SMALL = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)
WORDS = "the quick river runs over old stones while people of the town walk along its banks and talk about the weather of the day".split()
SCHEMA = "doc_id long, text string, lang string, n_chars long, row int, __row0 string, component_id long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", len(t or ""), 7, "x", 5, 0.5) for i, t in rows], SCHEMA)


def texts(n=30):
    return [" ".join(WORDS[(i * 7 + j * (1 + i % 5)) % len(WORDS)] + str(i % 4) for j in range(40)) for i in range(n)]


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_odd_rows(spark, name):
    rows = [*enumerate(texts()), (None, texts()[0]), (None, "a row of its own without an id and with words enough"), (3, None), (3, ""), (4, "x"), (5, "word " * 100_000), (6, "\u4e2d\u6587 \U0001d4b3")] * 2
    docs = frame(spark, rows)
    out = STAGES[name](spark, docs, SMALL)
    assert name == "bpe" or out.columns == docs.columns
    got = out.collect()
    assert len(got) <= len(rows) and (name in ("quality", "near_duplicates") or len(got) == len(rows))
    assert STAGES[name](spark, docs.limit(0), SMALL).count() == 0


def test_one_row_of_equal_ones_and_of_copies_stays(spark):
    t = texts(6)
    rows = [(7, t[0]), (7, t[0]), (3, t[0]), (None, t[0]), (None, t[1]), (None, t[1]), (9, t[2]), (9, t[3]), (1, None), (1, None), (2, ""), (11, t[4] + " and one more"), (10, t[4]), (8, t[5])]
    got = sorted(((r["doc_id"], r["text"]) for r in STAGES["near_duplicates"](spark, frame(spark, rows), SMALL).collect()), key=str)
    assert got == sorted([(3, t[0]), (None, t[1]), (9, t[2]), (9, t[3]), (1, None), (1, None), (2, ""), (10, t[4]), (8, t[5])], key=str)


def test_contaminated_rows_go_whatever_their_id(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r["text"] and len(r["text"].split()) > 8)
    rows = [(1, f"some words {item} more words"), (None, f"some words {item} more words"), (2, "clean words alone"), (2, f"again {item}"), (None, "clean without id"), (3, None)]
    got = [(r["doc_id"], r["text"]) for r in STAGES["decontaminate"](spark, frame(spark, rows), SMALL).collect()]
    assert sorted(got, key=str) == sorted([(2, "clean words alone"), (None, "clean without id"), (3, None)], key=str)


def test_secrets_of_rows_without_id_go(spark):
    rows = [(None, "a token=abcdefgh12 b"), (None, "nothing here"), (1, None), (1, "AKIA" + "Z" * 12)]
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in STAGES["secrets"](spark, frame(spark, rows), SMALL).collect()}
    assert got == {(None, "a [assign] b", 12), (None, "nothing here", 12), (1, None, None), (1, "[access]", 8)}
