"""Byte-level BPE over Arrow text batches, from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from .common import by_segment, ragged

VOCABULARY = os.environ.get("SKEIN_BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: This vocabulary leaves one id free behind its ranks, which marks the end of a document.
END_OF_DOCUMENT = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[int, "Bpe"] = {}


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """Reads the vocabulary on the driver and broadcasts it; its size is that of the file and doesn't depend on the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(data: bytes) -> "Bpe":
    """One encoder per vocabulary and worker process."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Bpe(data)
    return _ENCODERS[key]


def wide_space(data: np.ndarray) -> bool:
    """Whether the bytes may hold white space beyond ASCII, after which a text mustn't be cut."""
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(lead):
        return False
    a = data[lead]
    b = data[np.minimum(lead + 1, len(data) - 1)]
    return bool(((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)).any())


class Bpe:
    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)

    def _chunks(self, text: pa.Array):
        """All ids of the distinct chunks, each chunk's first id and number of ids, the chunks' codes, offsets by text.

        A pretoken never holds a space or line feed that follows another kind of character, and what precedes such a place
        doesn't change what follows. So texts are cut there, and each distinct piece is encoded once.
        """
        flat = pc.fill_null(text, "").cast(pa.large_binary())
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        base = ends[0]
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[base : ends[-1]]
        ends = ends - base
        solid = (data > 32) & (data < 127)
        plain = not wide_space(data)
        if plain:
            solid |= data >= 128
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = solid[:-1] & ((data[1:] == 32) | (data[1:] == 10))
        cut[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary
        at = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
        raw = distinct.buffers()[2].to_pybytes() if len(distinct) else b""
        view = np.frombuffer(raw, np.uint8)[: at[-1]]
        first, last = view[at[:-1]], view[at[1:] - 1]
        joins = ((first == 32) | (first == 10)) & ((last > 32) & (last < 127) | plain & (last >= 128))
        ids = self.encode(b"".join(distinct.filter(pa.array(joins)).to_pylist()).decode())
        where, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        reach = np.cumsum(self.width[ids])
        own = np.cumsum(np.diff(at)[joins])
        stop = np.searchsorted(reach, own, "right")
        where[joins], size[joins] = np.concatenate(([0], stop[:-1]))[: len(stop)], np.diff(np.concatenate(([0], stop)))
        rest, total = [ids], len(ids)
        for k in np.flatnonzero(~joins).tolist():
            x = self.encode(raw[at[k] : at[k + 1]].decode())
            where[k], size[k] = total, len(x)
            rest.append(x)
            total += len(x)
        code = pieces.indices.to_numpy(zero_copy_only=False)
        return np.concatenate(rest), where, size, code, np.searchsorted(starts, ends)

    def counts(self, text: pa.Array) -> np.ndarray:
        """The number of ids by text. A null text has none."""
        _, _, size, code, offsets = self._chunks(text)
        return by_segment(size[code], offsets)

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and the number of them by text. A null text has none."""
        ids, where, size, code, offsets = self._chunks(text)
        return ids[ragged(where[code], size[code])], by_segment(size[code], offsets)
