"""Exact search against brute force; archives as an exact round trip."""

import base64
import hashlib
import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from broadsheet.llm import topk, warc


def plain_top(rows, queries, k):
    out = []
    for q, x in queries:
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(x) == len(y))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_with_ties_odd_vectors_and_a_merge_tree(spark):
    dice = random.Random(2)
    rows = [(i, [dice.uniform(-1, 1) for _ in range(5)]) for i in range(150)]
    rows += [(i, [0.5] * 5) for i in range(150, 300)]  # ties
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (None, [0.1] * 5), (904, [0.5, 0.5]), (905, [0.25, 1.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    vectors = table.select(F.col("vec_id").alias("_id"), topk.quantize(F.col("embedding")).alias("_x"))
    found = topk.top_k(vectors, vectors.filter("_id % 20 = 0 OR _id = 905"), k=20, block=16, query_block=4)
    whole = [(i, [int(np.floor(64 * c)) for c in x]) for i, x in [*rows, *odd[-2:]]]
    expect = plain_top(whole, [(i, x) for i, x in whole if i % 20 == 0 or i == 905], 20)
    assert sorted(map(tuple, found.collect())) == expect
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_query_rows_that_repeat_an_id_get_a_list_each(spark):
    dice = random.Random(7)
    rows = [(i, [dice.uniform(-1, 1) for _ in range(4)]) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = table.select(F.col("vec_id").alias("_id"), topk.quantize(F.col("embedding")).alias("_x"))
    asked = [(5, rows[5][1]), (5, rows[6][1]), (5, rows[5][1])]
    queries = spark.createDataFrame(asked, table.schema).select(F.col("vec_id").alias("_id"), topk.quantize(F.col("embedding")).alias("_x"))
    whole = [(i, [int(np.floor(64 * c)) for c in x]) for i, x in rows]
    expect = plain_top(whole, [(i, [int(np.floor(64 * c)) for c in x]) for i, x in asked], 5)
    for block, query_block in ((8, 2), (4096, 1), (4096, 4096)):
        assert sorted(map(tuple, topk.top_k(vectors, queries, k=5, block=block, query_block=query_block).collect())) == expect


def test_scores_beyond_floating_point_are_exact():
    q, rows = np.array([[2**31 + 1, 1]]), np.array([[2**31 + 1, 0], [2**31 + 1, 1], [2**31, 5]])
    ((_, ids, scores),) = topk.tile_best(q, np.array([9]), rows, np.array([0, 1, 2]), 2)
    assert ids.tolist() == [1, 0] and scores.tolist() == [(2**31 + 1) ** 2 + 1, (2**31 + 1) ** 2]


def pages(spark, n=120):
    rows = [(i, f"http://h.example/{i}?é", f"<p>page {i}</p>" * (i % 40) if i % 3 else "<p>same</p>") for i in range(n)]
    rows += [(n, None, None), (n + 1, "u", ""), (None, "u", "<p>same</p>"), (None, "back\\slash\nline", "<p>no id</p>"), (5, "u", "x" * 400_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), rows


def test_archives_hold_a_bounded_number_of_records(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RECORDS", 30)
    table, rows = pages(spark)
    warc.write_archives(table.coalesce(1), str(tmp_path / "a"))
    files = list((tmp_path / "a").glob("part-*"))
    assert len(files) >= 5 and all(f.read_bytes()[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") for f in files)
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == len(rows)


def test_archives_hold_bounded_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RECORDS", 50)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3_000)
    table, rows = pages(spark)
    warc.write_archives(table.coalesce(1), str(tmp_path / "a"))
    files = list((tmp_path / "a").glob("part-*"))
    assert len(files) > len(rows) / 50 + 2 and all(f.read_bytes()[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") for f in files)
    found = {(r.page_id, r.url, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert found == {(i, u, len((h or "").encode())) for i, u, h in rows}


def test_archives_round_trip(spark):
    table, rows = pages(spark)
    found = warc.archive_round_trip(table).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))

    def expected(i, url, html):
        data = (html or "").encode()
        revisit = i != first.get(html or "", i)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        return (i, url, "revisit" if revisit else "response", None if revisit else data, len(data), digest, first[html or ""] if revisit else None)

    key = repr
    got = [(r.page_id, r.url, r.record_type, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest, r.refers_to) for r in found]
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)


def test_small_payloads_are_all_responses(spark):
    found = warc.archive_round_trip(pages(spark)[0], min_bytes=12).filter("payload_bytes = 11")
    assert {r.record_type for r in found.collect()} == {"response"}


def test_archives_are_frames_after_a_dictionary(spark, tmp_path):
    warc.write_archives(pages(spark)[0], f"file://{tmp_path}/archives")
    for file in (tmp_path / "archives").glob("part-*"):
        data = file.read_bytes()
        if not data:
            continue
        assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + int.from_bytes(data[4:8], "little")])
        frames = [f for d, f in warc._frames(data) if f is not None]
        assert frames and all(zstandard.ZstdDecompressor(dict_data=dictionary).decompress(f).startswith(b"WARC/1.1\r\n") for f in frames)


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
