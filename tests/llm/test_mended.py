"""Cases that went wrong once: clashing columns of a fit, texts of one doc_id with equal checksums, many rows without doc_id."""

import zlib

from pyspark.sql import functions as F

from millrace.llm import passages, quality, queries, token_files
from millrace.llm.common import table

SF = "/root/testdata/sf0.001"


def test_a_column_named_label_does_not_clash(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    clash = docs.withColumns({"label": F.lit("x"), "difference": F.lit(1), "n_bytes": F.lit("y")})
    plain, named = quality.fit(docs, labels), quality.fit(clash, labels)
    assert plain == named
    assert quality.kept(clash, named).columns == clash.columns


def test_repeated_ids_of_labelled_rows_do_not_multiply(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    again = docs
    for _ in range(4):
        again = again.unionByName(docs)
    assert quality.fit(again, labels) == quality.fit(docs, labels)


def with_equal_checksums():
    """Two texts of 21 words with one crc32: four bytes put behind a text give it any checksum, and one is searched for where they are letters."""
    a = " ".join(f"a{i}" for i in range(21))
    want = zlib.crc32(a.encode())
    head = " ".join(f"b{i}" for i in range(20)) + " "
    start = zlib.crc32(head.encode())
    table_ = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table_[i] = c
    seen = {t >> 24: i for i, t in enumerate(table_)}
    for n in range(1 << 16):
        tail = f"{n:04x}z"
        state, goal, picks = zlib.crc32(tail.encode(), start) ^ 0xFFFFFFFF, want ^ 0xFFFFFFFF, []
        for _ in range(4):
            i = seen[goal >> 24]
            picks.append(i)
            goal = ((goal ^ table_[i]) << 8) & 0xFFFFFFFF
        out = []
        for i in reversed(picks):
            byte = (state ^ i) & 0xFF
            out.append(byte)
            state = (state >> 8) ^ table_[(state ^ byte) & 0xFF]
        if all(0x21 <= b < 0x7F for b in out):
            b = head + tail + bytes(out).decode()
            assert zlib.crc32(b.encode()) == want
            return a, b
    raise AssertionError


def test_equal_checksums_take_nothing_away(spark):
    a, b = with_equal_checksums()
    got = sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in passages.dedup(spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")).collect())
    assert got == sorted([(1, 0, a), (2, 21, ""), (2, 0, b)])


def test_rows_without_doc_id_are_dealt_out(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = token_files.write_tokens(df, queries.TOKENIZER, queries.END_ID, partitions=8)
    sizes = [r["n"] for r in token_files.read_tokens(spark, path).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    index = token_files.token_index(spark, path).orderBy("start").collect()
    assert [r["start"] for r in index] == [sum(x["n_tokens"] for x in index[:i]) for i in range(len(index))]
