"""Byte-pair encoding by the tokenizers library over fragments between certain cuts.

A pair of bytes that stands inside no token of the vocabulary is never spanned by a token, so a
text may be cut between them and its fragments encoded apart. Fragments repeat, as words do: each
distinct one of a chunk is encoded once, and documents gather their ids from those.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks, spare

#: Fragments that a worker remembers, and the longest of them in characters.
REMEMBERED = 1 << 18
SHORT = 64
#: The pre-splitting pattern's contractions, inside which no cut may fall.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: ASCII white space, and the last two UTF-8 bytes of every other white space character.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20)
WIDE_SPACES = ((0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), (0xA0, 0x8E), (0x81, 0x9F), (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), *((0x80, k) for k in range(0x80, 0x8C)))


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def inside_pairs(vocabulary: list[bytes]) -> np.ndarray:
    """Whether byte a stands before byte b in some entry, at [a, b]."""
    found = np.zeros((256, 256), bool)
    for token in vocabulary:
        found[list(token[:-1]), list(token[1:])] = True
    return found


class Coder:
    """A tokenizer file with its certain cuts.

    Only byte-level BPE without normaliser, prefix space, dropout, byte fallback or greedy added
    tokens is taken, since cuts are proved for that; others are refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], told.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if not (plain and level) or told.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError(f"{path}: cuts are certain for plain byte-level BPE only")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        vocabulary = [bytes(alphabet[c] for c in token) for token in model["vocab"] if all(c in alphabet for c in token)]
        inside = inside_pairs(vocabulary + [t["content"].encode() for t in told["added_tokens"]] + [c.encode() for c in CONTRACTIONS])
        # The pattern looks past white space, so no cut stands after any; a quote that begins a text could begin a contraction.
        inside[list(SPACES), :] = True
        inside[:, ord("'")] = True
        # A cut is between characters, so not before a continuation byte.
        inside[:, 0x80:0xC0] = True
        self.certain = ~inside.ravel()
        self.wide = np.zeros(1 << 16, bool)
        self.wide[[a << 8 | b for a, b in WIDE_SPACES]] = True
        # The bytes of each id, for decoding.
        held = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in model["vocab"].items()} | {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        each = [held.get(i, b"") for i in range(max(held) + 1)]
        self.bytes, self.ends = np.frombuffer(b"".join(each), np.uint8), np.cumsum([0, *map(len, each)])
        # Remembered fragments by number; their ids stand in flat, from begin on.
        self.known: dict[str, int] = {}
        self.flat, self.begin = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether UTF-8 bytes may be cut before each of them."""
        pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
        at = np.zeros(len(data), bool)
        at[1:] = self.certain[pairs]
        at[2:] &= ~self.wide[pairs[:-1]]
        return at

    def encoded(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each distinct fragment's number, and the ids and begins of all numbers; those not remembered go to the library together."""
        new = [f for f in fragments if f not in self.known]
        new.sort(key=len)  # short ones are worth remembering
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        fresh = dict(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], "<u4")])
        begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
        codes = np.array([fresh[f] if f in fresh else self.known[f] for f in fragments])
        self.known.update((f, fresh[f]) for f in new[: REMEMBERED - len(self.known)] if len(f) <= SHORT)
        n = len(self.known)
        self.flat, self.begin = flat[: begin[n]], begin[: n + 1]
        return codes, flat, begin

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's documents, one after another, and where each document's begin (and the end)."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        cut = np.append(self.cuts(data), True)
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        fragments = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        codes, flat, begin = self.encoded(fragments.dictionary.to_pylist())
        code = codes[fragments.indices.to_numpy()]
        return gathered(flat, begin, code), np.concatenate([[0], np.cumsum(np.diff(begin)[code])])[np.searchsorted(bounds, offsets)]

    def encode(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_chunk(data, np.array([0, len(data)]))[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids as the library's decode() gives it with special tokens: unknown ids are left out, bytes that are no UTF-8 become U+FFFD."""
        return gathered(self.bytes, self.ends, ids[ids < len(self.ends) - 1]).tobytes().decode(errors="replace")


def gathered(flat: np.ndarray, begin: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches flat[begin[k] : begin[k + 1]] for each k of which, one after another."""
    size = begin[which + 1] - begin[which]
    ends = np.cumsum(size)
    return flat[np.repeat(begin[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def coder(path: str) -> Coder:
    """The file's coder, one a worker process: functions come there pickled by value, so a module of their own holds what outlives a task."""
    held = sys.modules.setdefault("signalframe_coders", types.ModuleType("signalframe_coders")).__dict__
    if path not in held:
        held[path] = Coder(path)
    return held[path]


def _encode_batches(batches, path: str, digests: bool):
    own, names = coder(path), None
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(batch.num_columns - 1)):
            ids, at = own.encode_chunk(data, offsets)
            each = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            extra = {"n_tokens": pa.array(np.diff(at), pa.int64())}
            if digests:
                names = names or [str(i) for i in range(len(own.ends) - 1)]
                extra["ids_sha256"] = pa.array([sha(",".join([names[i] for i in x.tolist()])) for x in each], pa.string())
                extra["decoded_sha256"] = pa.array([sha(own.decode(x)) for x in each], pa.string())
            else:
                extra["token_ids"] = pa.array([x.tobytes() for x in each], pa.binary())
            kept = batch.slice(first, last - first).columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, *extra.values()], [*batch.schema.names[:-1], *extra])


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Each row's whole text in ids of the tokenizer file: columns keep plus n_tokens and token_ids (packed '<u4').

    digests: instead of the ids, the SHA-256 of the decimal ids joined by commas and of the decoded
    text. Null and empty texts have no tokens; the strings of added tokens in a text become those
    tokens, as in the library. Repeated rows and extra columns pass through, a kept column named as
    a result column is refused, and an empty table has an empty result. Chunks of about 1 MB of
    texts are worked on at a time; a text without a certain cut is one fragment.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    result = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "token_ids"]
    if clash := set(keep) & set(result):
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{c} {'long' if c == 'n_tokens' else 'string' if digests else 'binary'}" for c in result])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(spare("__text", keep)))
    return rows.mapInArrow(lambda batches: _encode_batches(batches, path, digests), schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """The inverse: packed ids (null: none) become a string column; a column of that name is refused."""
    if text in encoded.columns:
        raise ValueError(f"column {text} is there already")

    def run(batches):
        own = coder(path)
        for batch in batches:
            at = batch.schema.names.index(ids)
            texts = pa.array([own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), texts], [*(n for n in batch.schema.names if n != ids), text])

    schema = ", ".join([f"`{c}` {k}" for c, k in encoded.dtypes if c != ids] + [f"`{text}` string"])
    return encoded.mapInArrow(run, schema)
