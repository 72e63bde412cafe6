"""Ranking chunks for questions: by words or by vectors, and whether the span was found."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.pandas.types import to_arrow_schema

from .. import fixed
from ..functions import text as T
from ..sources import shared

#: Vectors of a page in one block of a comparison, and the questions of it that are scored at once.
BLOCK_VECTORS, BLOCK_ROWS = 4096, 256
#: Bands of chunk sizes grow by this, and are so many (sizes up to 10^11); words that give the first scores.
GROWTH, BANDS, RAREST = 1.25, 113, 3


def _top(scored: DataFrame, by: list[str], k: int) -> DataFrame:
    """Best first; ties by chunk index. Plans as a group limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_idx"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def sought(asked: DataFrame, c: DataFrame, page: list[str]) -> DataFrame:
    """Words of chunks (page columns, chunk_idx, _t) that are a ``term`` asked for on their page: page columns, chunk_idx, nt (words of the chunk), term."""
    words = asked.groupBy(*page).agg(F.collect_set("term").alias("_s"))
    return c.join(words, page).select(*page, "chunk_idx", F.size("_t").alias("nt"), F.explode(F.array_intersect("_t", "_s")).alias("term"))


def lexical_top_k(questions: DataFrame, chunks: DataFrame, page: list[str], k: int = fixed.TOP_K) -> DataFrame:
    """For each question the k chunks of its own page of the highest word overlap,
    |q & t| / sqrt(|q| |t|); chunks without a common word rank last, with 0.

    ``questions``: page columns, q_id, question; ``chunks``: page columns, chunk_idx,
    heading_path, text. By an inverted index of each page, of the words that its questions have:
    a chunk meets those as one set, and only words in common become rows; only pairs that share a
    word are made. To those come the first k chunks of the page, with 0, which is where a question
    with fewer scored chunks takes the rest from.
    """
    q = questions.select(*page, "q_id", T.tokens(F.col("question")).alias("_q"))
    c = chunks.select(*page, "chunk_idx", T.tokens(F.concat_ws(" ", "heading_path", "text")).alias("_t"))
    asked = q.select(*page, "q_id", F.size("_q").alias("nq"), F.explode("_q").alias("term"))
    hits = sought(asked, c, page).join(asked, [*page, "term"]).groupBy(*page, "q_id", "chunk_idx").agg(F.count(F.lit(1)).alias("n"), F.first("nq").alias("nq"), F.first("nt").alias("nt"))
    scored = hits.select(*page, "q_id", "chunk_idx", (F.col("n") / F.sqrt(F.col("nq") * F.col("nt"))).alias("score"))
    order = F.row_number().over(Window.partitionBy(*page).orderBy("chunk_idx"))
    lead = chunks.select(*page, "chunk_idx").withColumn("_i", order).where(F.col("_i") <= k).drop("_i")
    fill = questions.select(*page, "q_id").join(lead, page).withColumn("score", F.lit(0.0))
    best = scored.unionByName(fill).groupBy(*page, "q_id", "chunk_idx").agg(F.max("score").alias("score"))
    return _top(best, [*page, "q_id"], k)


def _band(words):
    """Sizes of chunks in steps of a quarter: a band holds sizes from GROWTH^band to below the next."""
    return F.floor(F.log(words.cast("double")) / math.log(GROWTH) + 1e-9).cast("int")


def _scored(pairs: DataFrame, q: DataFrame, c: DataFrame, key: list[str]) -> DataFrame:
    """Exact scores of pairs (q_id, key, chunk_idx) that share a word. ``nt``: size of a chunk of which ``_t``
    has only the words that are asked for. Pairs meet the chunks before the questions, which are few."""
    rows = pairs.join(_sized(c).hint("merge"), [*key, "chunk_idx"]).join(q.select("q_id", "_q"), "q_id")
    return rows.withColumn("score", F.size(F.array_intersect("_t", "_q")) / F.sqrt(F.size("_q") * F.col("nt"))).drop("_q", "_t", "nt")


def _sized(c: DataFrame) -> DataFrame:
    return c if "nt" in c.columns else c.withColumn("nt", F.size("_t"))


def candidates(q: DataFrame, c: DataFrame, key: list[str], k: int) -> DataFrame:
    """Pairs (q_id, key, chunk_idx) of ``q`` (q_id, _q: words) and ``c`` (key, chunk_idx, _t: words) that hold the
    first k of each question.

    Chunks by their rarest common words give k scores, so a bound that the first k reach. To reach it a
    chunk of some size must share so many words, hence one of the question's rarest but as many less
    one: only these are looked up, band of sizes by band, and bands whose chunks are too short or too long
    to reach it not at all. So a frequent word is looked up only where one word in common may be enough.
    Words of chunks are sorted and merged: their files are small, but they are not once they are rows.
    """
    held = _sized(c).where(F.size("_t") > 0).select(*key, "chunk_idx", _band(F.col("nt")).alias("band"), F.explode("_t").alias("term"))
    asked = q.select("q_id", F.size("_q").alias("nq"), F.explode("_q").alias("term"))
    often = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(often, "term")  # words that no chunk has are in no pair
    mine = Window.partitionBy("q_id")
    known = known.withColumns({"place": F.row_number().over(mine.orderBy("df", "term")), "known": F.count(F.lit(1)).over(mine)})
    chunk = [*key, "chunk_idx"]
    first = known.where(F.col("place") <= RAREST).select("q_id", "term").join(held.select(*chunk, "term").hint("merge"), "term").select("q_id", *chunk).distinct()
    order = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score")))
    bound = _scored(first, q, c, key).withColumn("_i", order).where(F.col("_i") == k).select("q_id", F.col("score").alias("bound"))
    rows = known.join(bound, "q_id", "left").withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS))))
    least, most = F.ceil(F.pow(F.lit(GROWTH), F.col("band")) - 1e-6), F.ceil(F.pow(F.lit(GROWTH), F.col("band") + 1) - 1e-6) - 1
    shared = F.greatest(F.lit(1), F.ceil(F.coalesce("bound", F.lit(0.0)) * F.sqrt(F.col("nq") * least) - 1e-6))
    # the words in common of a chunk of this band are at most those the question has, and its own
    rows = rows.where((shared <= F.col("known")) & (shared <= most) & (F.col("place") <= F.col("known") - shared + 1))
    return rows.select("q_id", "band", "term").join(held.hint("merge"), ["band", "term"]).select("q_id", *chunk).distinct()


def _numbered(questions: DataFrame, chunks: DataFrame, key: list[str], work: str) -> tuple[DataFrame, DataFrame]:
    """Questions (q_id, _q) and chunks (chunk_idx, at: key and chunk_idx, nt: number of words, _t), written under
    ``work``: words are numbers, of chunks only those that some question has, and chunks have numbers of their own."""
    spark = questions.sparkSession

    def put(name: str, made: DataFrame) -> DataFrame:
        made.write.parquet(f"{work}/{name}")
        return spark.read.schema(made.schema).parquet(f"{work}/{name}")

    q = questions.select("q_id", T.tokens(F.col("question")).alias("_q"))
    terms = put("terms", q.select(F.explode("_q").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()))
    c = chunks.select(F.struct(*key, "chunk_idx").alias("at"), T.tokens(F.concat_ws(" ", "heading_path", "text")).alias("_t"))
    c = c.withColumn("chunk_idx", F.monotonically_increasing_id()).select("chunk_idx", "at", F.size("_t").alias("nt"), F.explode("_t").alias("word"))
    c = c.join(terms, "word").groupBy("chunk_idx").agg(F.first("at").alias("at"), F.first("nt").alias("nt"), F.collect_list("term").alias("_t"))
    q = q.select("q_id", F.explode_outer("_q").alias("word")).join(terms, "word", "left").groupBy("q_id").agg(F.collect_list("term").alias("_q"))
    return put("questions", q), put("chunks", c)


def lexical_top_k_corpus(questions: DataFrame, chunks: DataFrame, key: list[str], k: int = fixed.TOP_K) -> DataFrame:
    """The same over all chunks of a corpus, exact, by the pairs that ``candidates`` finds. Chunks without
    a common word are left out. Texts are read once; their words are written as numbers, and read from there."""
    q, c = _numbered(questions, chunks, key, shared.work_dir(questions.sparkSession, "lexical"))
    found = _scored(candidates(q, c, [], k), q, c, []).select("q_id", "at.*", "score")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), *key, "chunk_idx"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine(a, b):
    """0 for empty or zero vectors; components beyond the shorter vector are left out of the product."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def _dealt(vectors: DataFrame, page: list[str], key: str) -> DataFrame:
    """``vectors`` with the block of each row and the number of blocks of its page."""
    sizes = vectors.groupBy(*page).agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("blocks"))
    return vectors.join(sizes, page).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))


def vector_top_k(questions: DataFrame, chunks: DataFrame, page: list[str], k: int = fixed.TOP_K) -> DataFrame:
    """For each question the k chunks of its page of the highest cosine.

    ``questions``: page columns, q_id, vector; ``chunks``: page columns, chunk_idx, vector.
    Vectors of a page are dealt into blocks; each pair of blocks is one matrix product in one
    task, which returns k chunks for a question. Scores count to 12 digits; empty, zero and
    null vectors score 0, null components count as 0, and of vectors of different length the
    components beyond the shorter are left out of the product.
    """
    q = _dealt(questions.select(*page, "q_id", F.col("vector").cast("array<double>").alias("vector")), page, "q_id").withColumnsRenamed({"block": "qb", "blocks": "qbs"})
    c = _dealt(chunks.select(*page, "chunk_idx", F.col("vector").cast("array<double>").alias("vector")), page, "chunk_idx").withColumnsRenamed({"block": "cb", "blocks": "cbs"})
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(c.select(*page, "cbs").distinct(), page).withColumn("cb", others("cbs")).select(*page, "qb", "cb", "q_id", "vector")
    c = c.join(q.groupBy(*page).agg((F.max("qb") + 1).alias("qbs")), page).withColumn("qb", others("qbs")).select(*page, "qb", "cb", "chunk_idx", "vector")
    # both sides may come from one table: columns of their own
    q, c = (x.select(*(F.col(n).alias(n) for n in x.columns)) for x in (q, c))
    kinds = {f.name: f.dataType for f in (*q.schema, *c.schema)}
    names = [*page, "q_id", "chunk_idx"]
    out = types.StructType([types.StructField(n, kinds[n]) for n in names] + [types.StructField("score", types.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        right = right.take(pc.sort_indices(right, [("chunk_idx", "ascending")]))
        at, scores = nearest(left["vector"], right["vector"], k)
        row = np.repeat(np.arange(left.num_rows), len(at) // left.num_rows)
        columns = [left[n].take(pa.array(row)) for n in (*page, "q_id")] + [right["chunk_idx"].take(pa.array(at)), pa.array(scores)]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

    cell = [*page, "qb", "cb"]
    return _top(q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInArrow(run, out), [*page, "q_id"], k)


def nearest(asked: pa.ChunkedArray, held: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best of ``held`` for each of ``asked`` one after another, ties by place.
    Scores of BLOCK_ROWS questions are held at once."""
    b, at, scores = unit_rows(held), [], []
    for i in range(0, len(asked), BLOCK_ROWS):
        a = unit_rows(asked.slice(i, BLOCK_ROWS))
        width = min(a.shape[1], b.shape[1])
        score = np.round(a[:, :width] @ b[:, :width].T, 12) + 0.0
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        at.append(best.ravel())
        scores.append(np.take_along_axis(score, best, axis=1).ravel())
    return np.concatenate(at), np.concatenate(scores)


def unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows over their norms, zeros after their end; zero rows stay zero."""
    rows = [np.nan_to_num(np.array([0.0 if x is None else x for x in v.as_py() or ()], float)) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def span_hits(questions: DataFrame, found: DataFrame, chunks: DataFrame, page: list[str]) -> DataFrame:
    """has_span and span_hit of each question over its retrieved chunks."""
    got = found.select(*page, "q_id", "chunk_idx").join(chunks.select(*page, "chunk_idx", "text"), [*page, "chunk_idx"])
    span = F.coalesce("source_span", F.lit(""))
    rows = questions.select(*page, "q_id", "source_span").join(got, [*page, "q_id"], "left")
    return rows.groupBy(*page, "q_id").agg(F.bool_or(span != "").alias("has_span"), F.coalesce(F.bool_or(T.span_in(span, F.col("text"))), F.lit(False)).alias("span_hit"))


def similarity_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Jaccard similarity of all pairs of ``left`` (a, text) and ``right`` (b, text) that share a
    word, by an inverted index; other pairs are 0."""
    x = left.select("a", T.tokens(F.col("text")).alias("_t")).select("a", F.size("_t").alias("na"), F.explode("_t").alias("term"))
    y = right.select("b", T.tokens(F.col("text")).alias("_t")).select("b", F.size("_t").alias("nb"), F.explode("_t").alias("term"))
    both = x.join(y, "term").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return both.select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("similarity"))
