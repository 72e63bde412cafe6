import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
queries = pytest.importorskip("lensaudit.llm.queries")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(20)) + "." for _ in range(n))
    bench = [(i, " ".join(word() for _ in range(30))) for i in range(4)]
    docs = {i: prose(rng.randrange(4, 10)) for i in range(100)}
    docs |= {100 + i: "!! ".join(word().upper() for _ in range(100)) + "!!" for i in range(60)}  # junk
    passage = prose(3)
    docs |= {200: prose(3) + "\n" + passage, 201: prose(4) + "\n" + passage, 202: docs[5]}  # a shared passage; a whole copy
    base = prose(10).replace("\n", " ")  # one line: no repeated line, but a near copy
    docs |= {210: base, 211: base.replace(base.split()[7], "changed", 1)}
    docs |= {220: bench[0][1] + " and more of it " + prose(1), 221: prose(40) + "\n" + bench[1][1]}
    docs |= {230: None, 231: ""}
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(k, int(not 100 <= k < 160), 0) for k in docs if k < 160]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs


def test_stages_decide_in_turn(spark, folder):
    path, docs = folder
    rows = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, path)
        rows.write.parquet(f"{path}/out-{name}")
        rows = spark.read.parquet(f"{path}/out-{name}")
        seen[name] = rows.collect()
        if name != "packing":
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r.doc_id for r in v} for k, v in seen.items() if k != "packing"}
    junk = set(range(100, 160))
    assert not ids["quality"] & junk and set(range(100)) <= ids["quality"]
    text = {r.doc_id: r for r in seen["line_dedup"]}
    assert 202 not in text and text[200].text == docs[200]  # a whole copy goes, the first passage stays
    assert docs[201].startswith(text[201].text) and text[201].n_chars == len(text[201].text) < len(docs[201])
    assert 210 in ids["jaccard_join"] and 211 not in ids["jaccard_join"] and set(range(100)) <= ids["jaccard_join"]
    assert 220 not in ids["decontaminate"] and 221 in ids["decontaminate"] and set(range(100)) <= ids["decontaminate"]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path(corpus_pipeline.TOKENIZER))
    pieces = {}
    for r in seen["packing"]:
        for k, start, n, at in zip(r.doc_ids, r.starts, r.lengths, r.offsets):
            pieces.setdefault(k, []).append((start, np.frombuffer(r.ids, "<u2").tolist()[at : at + n]))
    got = {k: sum((x for _, x in sorted(v)), []) for k, v in pieces.items()}
    assert got == {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in seen["decontaminate"]}


def test_run_gives_the_last_stage(spark, folder):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).columns == ["bin", "capacity", "used", "ids", "doc_ids", "starts", "lengths", "offsets"]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "jaccard_join", "decontaminate", "packing"]


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_benchmark_passages_of_documents_that_stay_are_cut(spark, folder):
    path, docs = folder
    rows = spark.read.parquet(f"{path}/documents.parquet").where("doc_id IN (0, 221)")
    got = {r.doc_id: r for r in corpus_pipeline.decontaminate_stage(spark, rows, path).collect()}
    item = spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 1").collect()[0].text
    assert item in docs[221] and got[221].text == docs[221].replace(item, "") and got[221].n_chars == len(got[221].text)
    assert got[0].text == docs[0] and got[0].n_chars == len(docs[0])


def test_nulls_repeats_long_texts_and_clashing_names(spark, folder):
    """Columns of the operators' own names pass through all stages but the last."""
    path, docs = folder
    names = ("did", "th", "runs", "score", "held_out", "removed_lines", "u", "comp", "ids", "bin", "row")
    rows = [(k, docs[k], "en", "s", len(docs[k]), *range(len(names))) for k in (0, 1, 2, 2)]
    rows += [(None, docs[3], None, None, None, *[None] * len(names)), (None, None, "en", "s", 0, *range(len(names))), (None, None, "en", "s", 0, *range(len(names))), (7, "", "en", "s", 0, *range(len(names)))]
    long_text = " ".join(f"w{i}x" for i in range(60_000))
    rows += [(8, long_text, "en", "s", len(long_text), *range(len(names)))]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} int" for n in names))
    out = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, path)
        assert out.columns == df.columns, name
        out = spark.createDataFrame(out.collect(), df.schema)
        if name == "quality":
            assert {r.doc_id for r in out.collect()} >= {0, 1, 2}
            out = df  # the model knows no such texts: the next stages see all rows
    got = out.collect()
    ids = [r.doc_id for r in got]
    assert ids.count(2) == 1 and {0, 1, 2, 7, 8} <= set(ids) and sum(r.text is None for r in got) == 2
    assert next(r for r in got if r.doc_id == 8).text == long_text and all(r.ids == 8 for r in got if r.doc_id == 0)
    packed = corpus_pipeline.STAGES[-1][1](spark, out, path).collect()
    assert sorted({k for r in packed for k in r.doc_ids}, key=str) == sorted(set(ids), key=str)
