import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lensaudit.llm import common, token_files

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library_on_odd_texts(tok):
    rng, parts = random.Random(3), [*"abAB1 9'  \n\t.,!é中😀 　\x1c\x0b\0stl|<>", "'s", " \n", "<|endoftext|>", "\r\n"]
    enc = token_files.Encoder(PATH, cache_units=300)
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(6)] + [None, "", " ", " a", "a ", "a" * 5000]
        flat, n = enc.batch(pa.array(texts), 0)
        want = [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
        assert n.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_added_tokens_are_read_as_the_library_reads_them(tok):
    assert 50256 in tok.encode("<|endoftext|> x", add_special_tokens=False).ids
    texts = ["<|endoftext|> x", "a <|endoftext|>", "a<|endoftext|><|endoftext|> b", "< |endoftext|>", "<|endoftext| >", "plain"]
    flat, n = token_files.Encoder(PATH).batch(pa.array(texts), 0)
    want = [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert n.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_files_read_back(spark, tok):
    rows = [(7, "The the cat, sat.\nOn it", "x"), (2, None, "y"), (5, "", None), (None, "null id", None), (11, "word " * 3000, None), (3, "ü ß 中", None), (3, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    uri = common.work_dir(spark, "tok")
    token_files.write_tokens(df, uri, PATH)
    got = sorted(map(tuple, token_files.read_tokens(spark, uri).collect()), key=lambda r: r[1])
    at, want = 0, []
    for k, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_empty_table(spark):
    uri = common.work_dir(spark, "tok")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), uri, PATH)
    assert token_files.read_tokens(spark, uri).collect() == []
