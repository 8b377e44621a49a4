"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A match never runs from a letter or number into a space or line feed, so such places are safe to cut.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")
PIECE_CHARS = 1 << 16
#: Longer pieces are split by the pattern before the library sees them.
LONG_CHARS = 4 * PIECE_CHARS


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text at safe boundaries, the first at or after each size characters.

    The cuts leave every match of the pre-splitting pattern whole: a match holds white space
    only as its first character or throughout, so none spans a letter followed by a space. A stretch
    without such a place stays one piece.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, enc) -> np.ndarray:
    """Token ids of the whole text as little-endian unsigned 32-bit integers; null is empty.

    A piece beyond LONG_CHARS, which holds no safe boundary for long, is split by the same pattern
    here, and each match goes to the library's merge alone: its own pattern engine would run out
    of stack on it.
    """
    parts = []
    for piece in pieces(text or ""):
        if len(piece) <= LONG_CHARS:
            parts.append(np.array(enc.encode_ordinary(piece), "<u4"))
        else:
            parts += [np.array(enc._encode_single_piece(m[0]), "<u4") for m in splitter(enc._pat_str).finditer(piece)]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def decode(ids: np.ndarray, enc) -> bytes:
    """The raw bytes of the ids, which need not be valid UTF-8 when cut."""
    return enc.decode_bytes(ids.tolist())


def _encode_batches(batches, ranks_path: str, pattern: str, digests: bool, text_at: int):
    enc = encoding(ranks_path, pattern)
    for batch in batches:
        step = 256
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            ids = [encode(t, enc) for t in part.column(text_at).to_pylist()]
            extra = {"n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            if digests:
                extra["ids_sha256"] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
                extra["decoded_sha256"] = pa.array([hashlib.sha256(decode(x, enc)).hexdigest() for x in ids], pa.string())
            else:
                extra["token_ids"] = pa.array([x.tobytes() for x in ids], pa.binary())
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *extra.values()], [*batch.schema.names[:-1], *extra])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Encode each row's whole text; columns keep plus n_tokens and token_ids (packed '<u4').

    digests: instead of the ids, the SHA-256 of the packed ids and of the decoded bytes.
    Null text encodes as empty: no tokens. Repeated rows and extra columns pass through; a
    kept column named as a result column is refused. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    result = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "token_ids"]
    if clash := set(keep) & set(result):
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{c} {'long' if c == 'n_tokens' else 'string' if digests else 'binary'}" for c in result])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    at = len(keep)
    return rows.mapInArrow(lambda batches: _encode_batches(batches, ranks_path, pattern, digests, at), schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The inverse: token_ids (packed '<u4', null is empty) to a binary column bytes."""

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            at = batch.schema.names.index("token_ids")
            raw = pa.array([decode(np.frombuffer(x or b"", "<u4"), enc) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), raw], [*(n for n in batch.schema.names if n != "token_ids"), "bytes"])

    schema = ", ".join(f"`{c}` {k}" for c, k in encoded.dtypes if c != "token_ids")
    return encoded.mapInArrow(run, f"{schema}, bytes binary" if schema else "bytes binary")


def doc_hash(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))
