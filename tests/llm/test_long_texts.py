"""Texts of some megabytes, beside short ones, in every operator on texts."""

import hashlib
import random
import zlib

import pytest

from lensaudit.llm import common, decontaminate, jaccard_join, line_dedup, lm_scoring, sharding, warc


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(12)
    return "\n".join(" ".join(f"w{rng.randrange(10**6)}x" for _ in range(25)) for _ in range(12_000))


def test_warc(spark, long_text):
    pages = spark.createDataFrame([(1, "http://a/", long_text), (2, "http://b/", long_text), (3, None, "short")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_pages(spark, warc.write_pages(pages, common.work_dir(spark, "w"))).collect()}
    digest = hashlib.sha256(long_text.encode()).hexdigest()
    assert {k: (r.payload_digest == digest, r.record_type, r.refers_to) for k, r in got.items()} == {1: (True, "response", None), 2: (True, "revisit", 1), 3: (False, "response", None)}
    empty = warc.write_pages(pages.where("false"), common.work_dir(spark, "w"))
    assert warc.read_pages(spark, empty).collect() == []


def test_scoring(spark, long_text):
    rows = [(k, long_text if k == 3 else f"some words {k}") for k in range(8)]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].n_tokens == 12_000 * 25 + 1 and all(r.score < 0 for r in got.values())
    assert {r.train_tokens for r in got.values()} == {sum(len(t.split()) + 1 for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2)}


def test_line_dedup(spark, long_text):
    lines = long_text.split("\n")
    rows = [(1, long_text), (2, "own line of this document\n" + "\n".join(lines[5000:])), (3, "short")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].removed_lines, got[2].removed_lines, got[2].text.strip(), got[3].text) == (0, 7000, "own line of this document", "short")


def test_jaccard(spark, long_text):
    near = long_text.replace(long_text.split()[7], "changed", 1)
    got = {r.doc_id: r for r in jaccard_join.link_components(spark.createDataFrame([(5, long_text), (9, near), (7, "short text")], "doc_id long, text string")).collect()}
    words = long_text.split()
    assert got[5].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert {k: r.component_id for k, r in got.items()} == {5: 5, 9: 5, 7: 7}


def test_decontamination(spark, long_text):
    words = long_text.split()
    item = " ".join(words[200_000:200_020])
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame([(1, long_text), (2, item)], "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string")).collect()}
    assert {k: (r.n_words, r.n_hit, r.contaminated) for k, r in got.items()} == {1: (len(words), 20, False), 2: (20, 20, True)}


def test_sharding(spark, long_text):
    rows = [(1, long_text), *((k, f"text {k}") for k in range(2, 300)), (300, long_text)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, law string, shard int")  # names of its own columns
    got = sharding.assign_shards(df, 4).collect()
    size = {r.doc_id: (r["size"], r.text_crc32) for r in got}
    assert len(got) == 300 and size == {k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in rows}
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    own = {r.doc_id: r.shard for r in got}
    assert own[1] == own[300] and [r.doc_id for r in got if r.shard == own[1]].__len__() == 2  # over the even share: alone
