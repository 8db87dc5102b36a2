"""Fixed-width bit packing of ids, and a file format with random access.

File: magic, packed blocks, footer. Ids are stored least significant bit first in
``bits`` bits each, ``bits`` being the fewest that hold every id of the vocabulary.
Every block but the last holds ``block_ids`` ids and starts on a byte, so the byte
offset of any id follows from the block offsets. The footer has the block offsets,
the documents' keys and ends, and a JSON trailer.
"""

from __future__ import annotations

import json
import struct

import numpy as np

MAGIC = b"LTOKPK01"
BLOCK_IDS = 1 << 16


def width(vocab_size: int) -> int:
    """Fewest bits that hold 0 .. vocab_size - 1."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int, first: int = 0) -> np.ndarray:
    """Ids ``first .. first + n`` of a block, without a Python loop over ids."""
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    raw = np.frombuffer(data, dtype=np.uint8)
    if bits % 8 == 0:
        k = bits // 8
        out = np.zeros((n, 4), dtype=np.uint8)
        out[:, :k] = raw[first * k : (first + n) * k].reshape(n, k)
        return out.view("<u4").ravel()
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Streams documents into one file; holds one block and the document table."""

    def __init__(self, sink, vocab_size: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.vocab, self.block_ids = sink, width(vocab_size), vocab_size, block_ids
        self.at, self.held, self.n_held, self.n_ids = len(MAGIC), [], 0, 0
        self.offsets: list[int] = []
        self.keys: list[int] = []
        self.null: list[bool] = []
        self.ends: list[int] = []
        sink.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.keys.append(0 if key is None else int(key))
        self.null.append(key is None)
        self.ends.append(self.n_ids)
        if self.n_held >= self.block_ids:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for k in range(0, stop, self.block_ids):
            block = pack(ids[k : min(stop, k + self.block_ids)], self.bits)
            self.offsets.append(self.at)
            self.sink.write(block)
            self.at += len(block)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> dict:
        self._flush(last=True)
        parts = [np.array(self.offsets + [self.at], "<u8"), np.array(self.keys, "<i8"), np.array(self.null, np.uint8), np.array(self.ends, "<u8")]
        body = b"".join(x.tobytes() for x in parts)
        trailer = json.dumps({"bits": self.bits, "vocab": self.vocab, "block_ids": self.block_ids, "n_ids": self.n_ids, "n_docs": len(self.keys), "n_blocks": len(self.offsets), "footer_at": self.at}).encode()
        self.sink.write(body + trailer + struct.pack("<Q", len(trailer)) + MAGIC)
        return {"n_ids": self.n_ids, "n_docs": len(self.keys)}


class Reader:
    """Random access to documents and id ranges of one file; reads the blocks it needs."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a packed token file, or it was cut short")
        n = struct.unpack("<Q", tail[:8])[0]
        self.meta = json.loads(source.read_at(n, size - 16 - n))
        m, at = self.meta, self.meta["footer_at"]
        body, pos = source.read_at(size - 16 - n - at, at), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal pos
            out = np.frombuffer(body, kind, count, pos)
            pos += out.nbytes
            return out

        self.offsets, self.keys = take("<u8", m["n_blocks"] + 1), take("<i8", m["n_docs"])
        self.null, self.ends = take("u1", m["n_docs"]), take("<u8", m["n_docs"])
        self._held: tuple[int, np.ndarray] | None = None

    def _block(self, k: int) -> np.ndarray:
        if self._held is None or self._held[0] != k:
            m = self.meta
            lo, hi = int(self.offsets[k]), int(self.offsets[k + 1])
            n = min(m["block_ids"], m["n_ids"] - k * m["block_ids"])
            self._held = (k, unpack(self.source.read_at(hi - lo, lo), n, m["bits"]))
        return self._held[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop of the file."""
        size, parts = self.meta["block_ids"], []
        while start < stop:
            k = start // size
            end = min(stop, (k + 1) * size)
            parts.append(self._block(k)[start - k * size : end - k * size])
            start = end
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))
