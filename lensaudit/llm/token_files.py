"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Each partition of a doc_id range writes ``part-N.tok`` (ids, uint16 or uint32),
``part-N.off`` (int64 offsets of its documents, one more than documents),
``part-N.doc`` (int64 doc_ids) and ``part-N.nul`` (uint8, 1 where the doc_id is null).
``bases.i64`` holds the prefix sums of the partitions' token counts, so a global
position is base + offset, and a reader maps any part without the others.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common

#: A single space before more white space or the end of the text; or NUL. (Characters that
#: only some libraries take for white space are in it: such texts are encoded whole.)
_WHOLE = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| \z|\x00"
#: Distinct units kept by an encoder before it starts anew: about 150 bytes each.
CACHE_UNITS = 1_200_000
BATCH_BYTES = 8_000_000


class Encoder:
    """Whole texts to ids with the tokenizers library, each distinct unit encoded once.

    Byte-level BPE with the usual pre-tokenizing pattern never joins across a single
    space that stands between other characters: the space starts a pre-token. So a text
    is cut at such spaces, and units are encoded by the library and kept. New units are
    joined again for the call; the ids that begin with a space mark where each starts.
    Texts with longer runs of white space after a space are encoded whole, and so are texts
    that hold the spelling of an added (special) token, which the library reads as that token.
    """

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._most = cache_units
        added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        # a spelling with a space in it could arise between units: then every text is encoded whole
        self._whole = "" if any(" " in t for t in added) else "|".join([_WHOLE, *map(re.escape, added)])
        vocab = self._tok.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocab) <= 1 << 16 else "<u4")
        self._opens = np.zeros(max(vocab.values()) + 1, bool)
        self._opens[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True  # a space, in byte-level spelling
        self._clear()

    def hold(self, cache_units: int) -> None:
        """Keep at most about so many units from now on."""
        self._most = cache_units

    def _clear(self):
        self._ids: defaultdict[str, int] = defaultdict()
        self._ids.default_factory = self._ids.__len__
        self._flat, self._lens = np.empty(0, self.dtype), np.empty(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode units in their order; those that open a text (NUL first) have no space before them."""
        flat, lens = [], []
        for first, group in groupby(new, key=lambda x: x[:1] == "\0"):
            if first:
                got = self._encode([x[1:] for x in group])
                flat += got
                lens.append(np.fromiter(map(len, got), np.int64, len(got)))
                continue
            group = list(group)
            for i in range(0, len(group), 5_000):
                got = self._encode([" " + " ".join(group[i : i + 5_000])])[0]
                at = np.flatnonzero(self._opens[got])
                flat.append(got)
                lens.append(np.diff(np.append(at, len(got))))
        self._flat, self._lens = np.concatenate([self._flat, *flat]), np.concatenate([self._lens, *lens])
        if len(self._lens) != len(self._ids):
            raise ValueError("a unit is not encoded on its own: not a byte-level tokenizer of this pattern")

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``, and the number of ids of each."""
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        if len(self._ids) > self._most:
            self._clear()
        ids, known = self._ids, len(self._ids)
        texts = texts.cast(pa.large_string()).fill_null("")
        entire = pc.match_substring_regex(texts, self._whole)
        whole = {i: texts[i].as_py() for i in np.flatnonzero(entire.to_numpy(zero_copy_only=False)).tolist()}
        cut = pc.split_pattern(pc.if_else(entire, "", texts), " ")
        opens, units = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        at = np.fromiter(map(ids.__getitem__, units.dictionary.to_pylist()), np.int64, len(units.dictionary))[units.indices.to_numpy()]
        first = cut.values.take(pa.array(opens[:-1])).to_pylist()
        at[opens[:-1]] = np.fromiter((ids["\0" + x] for x in first), np.int64, len(first))
        if len(ids) > known:
            self._learn(list(islice(ids, known, None)))
        whole = dict(zip(whole, self._encode(list(whole.values())))) if whole else {}
        starts = np.cumsum(self._lens) - self._lens
        n = self._lens[at]
        pos = np.cumsum(n) - n
        flat = self._flat[np.arange(int(n.sum())) + np.repeat(starts[at] - pos, n)]
        upto = np.concatenate([[0], np.cumsum(n)])[opens[1:]]
        out, per_doc, a, close = [], [], 0, np.array([end], self.dtype)
        for i, z in enumerate(upto.tolist()):
            mine = whole[i] if i in whole else flat[a:z]
            out += [mine, close]
            per_doc.append(len(mine) + 1)
            a = z
        return np.concatenate(out), np.array(per_doc, np.int64)


#: Encoders of this process by file. Workers import this module, so later tasks find the units of earlier ones.
_KEPT: dict[str, Encoder] = {}


def kept_encoder(path: str, cache_units: int = CACHE_UNITS) -> Encoder:
    """The encoder of this worker process for ``path``; it holds ``cache_units`` units from now on."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path, cache_units)
    _KEPT[path].hold(cache_units)
    return _KEPT[path]


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into files under ``uri``.

    Texts are encoded as the library does by itself with ``add_special_tokens=False``. Null
    and empty texts have only the end id; texts of any length are encoded whole. Null doc_ids
    sort first; rows with one doc_id are ordered by text, and repeated rows are written each.
    An empty table makes no documents. Other columns are ignored. A retried task writes the
    same files again under the same names.
    """
    spark = docs.sparkSession
    parts = common.shuffle_partitions(spark)

    def write(batches):
        pid = TaskContext.get().partitionId()
        encoder, lens, keys = kept_encoder(tokenizer), [np.zeros(1, np.int64)], []

        def ids():
            for b in common.batched(batches, "text", BATCH_BYTES):
                got, n = encoder.batch(b.column("text"), end_id)
                lens.append(n)
                keys.extend(b.column("doc_id").to_pylist())
                yield got.tobytes()

        name = f"{uri}/part-{pid:06d}"
        common.put_file(f"{name}.tok", ids())
        offsets = np.cumsum(np.concatenate(lens))
        common.put_file(f"{name}.off", [offsets.astype("<i8").tobytes()])
        common.put_file(f"{name}.doc", [np.array([k or 0 for k in keys], "<i8").tobytes()])
        common.put_file(f"{name}.nul", [np.array([k is None for k in keys], "u1").tobytes()])
        yield pa.RecordBatch.from_pydict({"part": [pid], "tokens": [int(offsets[-1])], "width": [encoder.dtype.itemsize]})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    done = {r["part"]: r for r in rows.mapInArrow(write, "part long, tokens long, width long").collect()}  # a row for each part
    n = max(done, default=-1) + 1
    base = np.concatenate([[0], np.cumsum([done[i]["tokens"] if i in done else 0 for i in range(n)], dtype=np.int64)])
    common.put_file(f"{uri}/bases.i64", [base.astype("<i8").tobytes()])
    width = max((r["width"] for r in done.values()), default=2)
    common.put_file(f"{uri}/meta.json", [json.dumps({"parts": n, "present": sorted(done), "dtype": f"<u{width}"}).encode()])


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and the CRC-32 of its ids as little-endian uint32."""
    fs, path = common.open_uri(f"{uri}/meta.json")
    with fs.open_input_file(path) as f:
        meta = json.loads(f.read())
    present, dtype = set(meta["present"]), meta["dtype"]

    def read(batches):
        base = common.read_array(f"{uri}/bases.i64", "<i8")
        for b in batches:
            for part in b.column("id").to_pylist():
                if part not in present:
                    continue
                name = f"{uri}/part-{part:06d}"
                ids, off = common.read_array(f"{name}.tok", dtype), common.read_array(f"{name}.off", "<i8")
                keys, nul = common.read_array(f"{name}.doc", "<i8"), common.read_array(f"{name}.nul", "u1")
                if int(off[-1]) != len(ids) or len(off) != len(keys) + 1 or int(base[part + 1] - base[part]) != len(ids):
                    raise ValueError(f"{name}: lengths do not agree")
                for i in range(0, len(keys), 10_000):
                    lo, hi = off[i : i + 10_000], off[i + 1 : i + 10_001]
                    k = hi.shape[0]
                    crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(lo[:k].tolist(), hi.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(keys[i : i + k]), mask=np.array(nul[i : i + k], bool)), pa.array(base[part] + lo[:k]), pa.array(hi - lo[:k]), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, meta["parts"])
    return spark.range(0, n, 1, n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
