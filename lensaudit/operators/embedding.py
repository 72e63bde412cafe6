"""Vectors of texts, made once: an embedding model behind a store by text, and retrieval by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..sources.store import Store
from . import judging, retrieval

KEPT = "vector array<float>, error string"
#: Texts given to a client at once, and tasks that call side by side.
BATCH, PARTS = 64, 16

#: Some texts to as many vectors.
Client = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Embedder:
    """An embedding model with its store. A failed batch is tried again by the next run."""

    name: str
    client: Client
    store_at: str
    base_url: str | None = None
    tries: int = fixed.MODEL_TRIES
    backoff: float = fixed.MODEL_BACKOFF

    def store(self) -> Store:
        return Store(self.store_at, KEPT)

    def key(self, text: Column) -> Column:
        return T.cache_key(F.lit("embed"), F.lit(self.name), F.lit(self.base_url), text)

    def vectors(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """``texts`` with vector and error of the column ``text``; equal texts are embedded once. ``texts`` is
        read twice. Null texts are empty ones."""
        kept, call = self.store(), judging.retrying(self.client, self.tries, self.backoff)
        keyed = texts.withColumn("_said", F.coalesce(F.col(text), F.lit(""))).withColumn("key", self.key(F.col("_said")))
        todo = kept.missing(keyed.groupBy("key").agg(F.first("_said").alias("said")), F.col("error").isNull())

        def make(rows: Iterator[dict]) -> Iterator[dict]:
            held: list[dict] = []

            def said(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
                """One text that cannot be embedded does not cost the others of its batch their vectors."""
                try:
                    got = call(texts)
                    if len(got) != len(texts):
                        raise RuntimeError(f"provider error: {len(got)} vectors for {len(texts)} texts")
                    return [([float(x) for x in v], None) for v in got]
                except Exception as e:  # noqa: BLE001 - whatever the client raises is a row
                    error = str(e) if isinstance(e, RuntimeError) else f"{type(e).__name__}: {e}"
                    if len(texts) == 1 or error.startswith("authentication"):
                        return [(None, error)] * len(texts)
                    return [x for t in texts for x in said([t])]

            def flush():
                yield from ({"key": r["key"], "vector": v, "error": e} for r, (v, e) in zip(held, said([r["said"] for r in held])))

            for r in rows:
                held.append(r)
                if len(held) == BATCH:
                    yield from flush()
                    held.clear()
            if held:
                yield from flush()

        kept.fill(todo.repartition(PARTS, "key"), make, BATCH)
        return keyed.join(kept.newest(texts.sparkSession).select("key", "vector", "error"), "key", "left").drop("key", "_said")


def finder(model: Embedder, page: list[str], k: int = fixed.TOP_K) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Retrieval by ``model``: for each question of a page its k best chunks, with ``by``: the model's name, or
    ``lexical`` for pages of which a chunk or question has no vector, where words decide."""

    def find(questions: DataFrame, chunks: DataFrame) -> DataFrame:
        asked = model.vectors(questions.select(*page, "q_id", "question"), "question")
        told = model.vectors(chunks.select(*page, "chunk_idx", F.concat_ws("\n", F.nullif(F.col("heading_path"), F.lit("")), "text").alias("text")))
        lost = asked.where("vector IS NULL").select(*page).unionByName(told.where("vector IS NULL").select(*page)).distinct()
        near = retrieval.vector_top_k(asked.join(lost, page, "left_anti"), told.join(lost, page, "left_anti"), page, k)
        words = retrieval.lexical_top_k(questions.join(lost, page, "left_semi"), chunks.join(lost, page, "left_semi"), page, k)
        cols = [*page, "q_id", "chunk_idx", "rank", "score"]
        return near.select(*cols, F.lit(model.name).alias("by")).unionByName(words.select(*cols, F.lit("lexical").alias("by")))

    return find
