"""Whole-corpus encoding with a public byte-level BPE vocabulary by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged over, so the text may be cut
there for certain. The fragments between certain cuts are encoded independently, and the ids are concatenated. A cut is taken only where the pre-tokeniser's pattern can't see across it either:

* the character before it is no white space (a run of white space is split by what follows it), and
* neither side is an apostrophe (contractions are matched from the apostrophe on), and
* it lies between two characters, not inside one.

Elsewhere the pattern matches runs of one class (letters, digits, others), with at most one space before them: a run
cut in two gives two pieces of the same class, whose merges are those of the whole because none crosses the cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


TOKENIZER_DIR = "/opt/tokenizers"
#: fixed value: the pre-tokeniser pattern of the byte_bpe vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: least bytes of a fragment: shorter texts are one fragment, longer ones are cut so that none grows without bound
FRAGMENT = 1024
#: white space in ASCII, and the last bytes of all white space beyond it
WHITE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
WHITE_LAST = [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]


def read_ranks(name: str, tokenizer_dir: str = TOKENIZER_DIR) -> bytes:
    """The vocabulary file's bytes (below 1 MB, a fixed size)."""
    with open(f"{tokenizer_dir}/{name}.tiktoken", "rb") as f:
        return f.read()


class ForcedBoundaryEncoder:
    def __init__(self, ranks_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        joined = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8)
            joined[b[:-1], b[1:]] = True
        cut = ~joined
        cut[WHITE, :] = False
        cut[ord("'"), :] = cut[:, ord("'")] = False
        cut[:, 0x80:0xC0] = False
        cut[WHITE_LAST, :] = False
        self.cut = cut.ravel()

    def fragments(self, data: np.ndarray, starts: np.ndarray) -> list[int]:
        """Bounds of the fragments: the starts of the texts, and in each the first certain cut after FRAGMENT bytes."""
        pairs = data[:-1].astype(np.int32) * 256 + data[1:] if len(data) > 1 else np.zeros(0, np.int32)
        cuts = np.flatnonzero(self.cut[pairs]) + 1
        bounds = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            bounds.append(a)
            while b - a > 2 * FRAGMENT:
                k = np.searchsorted(cuts, a + FRAGMENT)
                if k == len(cuts) or cuts[k] >= b:
                    break
                a = int(cuts[k])
                bounds.append(a)
        return [*bounds, int(starts[-1])]

    def encode_array(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of the texts in them; null and empty texts get none."""
        texts = pa.array(texts.fill_null(""), type=pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        if hi == lo:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        raw = texts.buffers()[2][lo:hi].to_pybytes()
        starts = offsets - lo
        bounds = self.fragments(np.frombuffer(raw, dtype=np.uint8), starts)
        parts = [self.whole.encode_ordinary(raw[a:b].decode("utf-8")) for a, b in zip(bounds[:-1], bounds[1:])]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return np.fromiter(chain.from_iterable(parts), np.int32, int(ends[-1])), ends[np.searchsorted(bounds, starts)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()))[0].tolist()


@lru_cache(maxsize=4)
def _encoder(ranks_file: bytes) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(ranks_file)


def encode_corpus(
    df: DataFrame, row_id: str, text: str, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, counts_only: bool = False
) -> DataFrame:
    """row_id and ids (or n_tokens), without special tokens. Empty and null texts give the empty list (0)."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer, tokenizer_dir))
    id_field = df.schema[row_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            step = 2000
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids, offsets = encoder.encode_array(part.column(1))
                if counts_only:
                    out = pa.array(np.diff(offsets), pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[row_id, "n_tokens" if counts_only else "ids"])

    out_field = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    return df.select(row_id, text).mapInArrow(run, T.StructType([id_field, out_field]))
