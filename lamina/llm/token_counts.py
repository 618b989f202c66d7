"""Token counts without materialising tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.shared import as_frame, prepare, slices, texts_of, tidied
from lamina.llm.text import VOCAB, encoding, safe_pieces


def token_counts(docs: DataFrame, *, vocab: str = VOCAB, batch_bytes: int = 1 << 20, piece_chars: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row, by batch encoding inside an Arrow function.

    Each incoming batch is re-cut to calls of about ``batch_bytes`` of text; a text longer than
    ``piece_chars`` is cut where no token can span, so one document never becomes one long call,
    and only lengths leave the function.  Null text gives null, empty text 0; repeated rows and
    repeated or null ids each give a row; other columns are ignored; no rows give no rows.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocab).encode_ordinary_batch
        for b in batches:
            col, counts = texts_of(b), []
            for lo, hi in slices(col, batch_bytes):
                pieces, owner = [], []
                for k, t in enumerate(col.slice(lo, hi - lo).to_pylist()):
                    parts = [t] if len(t) <= piece_chars else safe_pieces(t, piece_chars)
                    pieces += parts
                    owner += [k] * len(parts)
                got = [0] * (hi - lo)
                for k, ids in zip(owner, encode(pieces, num_threads=1)):
                    got[k] += len(ids)
                counts += got
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64(), mask=null)], ["doc_id", "n_tokens"])

    return as_frame(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id bigint, n_tokens bigint")
