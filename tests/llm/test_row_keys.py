"""Line dedup tells rows apart by their whole text, whatever their doc_id and however their short hashes collide."""

import pytest
from pyspark.sql import functions as F

from routeloom.llm import linededup

PASSAGE = "\n".join(" ".join(f"p{k}x{i}" for i in range(20)) for k in range(3))


def own(k):
    return "\n".join(" ".join(f"own{k}y{j}z{i}" for i in range(9)) for j in range(6))


@pytest.mark.parametrize("doc_id", [None, 7, -1, linededup.LAST])
@pytest.mark.parametrize("ties", [1 << 31, 1])
def test_no_row_loses_another_s_lines(spark, monkeypatch, doc_id, ties):
    """With ties = 1 all texts of a doc_id collide in the order of passages."""
    monkeypatch.setattr(linededup, "TIES", ties)
    monkeypatch.setattr(linededup, "UNKNOWN", 1 if ties == 1 else 1 << 62)
    rows = [(1, PASSAGE)] + [(doc_id, own(k)) for k in range(40)] + [(doc_id, f"{PASSAGE}\nlast {k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in linededup.dedup_lines(docs).collect())
    rest = [f"last {k}" for k in range(3)]
    if doc_id == -1 and ties == 1:  # passages of one place: all copies of the first doc_id stay
        want = [("1", "")] + [("-1", f"{PASSAGE}\n{t}") for t in rest]
    elif doc_id == -1:
        assert sum(t.startswith(PASSAGE) for i, t in got if i == "-1") == 1
        want = [("1", ""), *((i, t) for i, t in got if "last" in t)]
    else:
        want = [("1", PASSAGE)] + [(str(doc_id), t) for t in rest]
    assert got == sorted(want + [(str(doc_id), own(k)) for k in range(40)])


def test_texts_that_collide_in_few_bits(spark):
    """A null doc_id, and texts whose 20-bit hashes are equal: each loses its own repeated lines only."""
    texts = spark.range(6000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    hashed = texts.select("t", F.pmod(F.xxhash64(F.concat(F.lit(PASSAGE + "\n"), "t")), F.lit(1 << 20)).alias("h"))
    other = texts.select(F.concat(F.lit(own(1) + "\n"), "t").alias("o")).withColumn("h", F.pmod(F.xxhash64("o"), F.lit(1 << 20)))
    pair = hashed.join(other, "h").first()
    docs = spark.createDataFrame([(1, PASSAGE), (None, f"{PASSAGE}\n{pair['t']}"), (None, pair["o"])], "doc_id long, text string")
    assert sorted(r["text"] for r in linededup.dedup_lines(docs).collect()) == sorted([PASSAGE, pair["t"], pair["o"]])


def test_unknown_and_largest_doc_id_are_two_rows(spark):
    docs = spark.createDataFrame([(None, PASSAGE), (linededup.LAST, PASSAGE)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == {linededup.LAST: PASSAGE, None: ""}
