"""Segments of token ids as bytes: a static range asymmetric numeral system (rANS).

A segment holds whole documents: a header, the documents' identifiers and lengths, one
frequency table that all its blocks share, a directory of the blocks, and the blocks. A
block holds up to `BLOCK` ids dealt to `LANES` interleaved coders (id i of a block belongs
to lane i mod LANES); it depends on nothing but the table, so blocks decode in parallel and
here are worked side by side in one numpy array. The states of all lanes are kept at every
`CHECKPOINT`-th step, so decoding can also start inside a block. Directory entries carry a
CRC-32 of their block; a segment ends with the CRC-32 of everything before the blocks.

All integers are little-endian. Coder states are 64 bits and renormalise by 32-bit words.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"TLRANS01"
LANES = 256
BLOCK = 1 << 17
CHECKPOINT = 256
SCALE = 18
_HEADER = struct.Struct("<8sIQIIIIIB")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, at least 1 for each symbol that occurs."""
    whole = 1 << SCALE
    used = counts > 0
    if used.sum() > whole:
        raise ValueError(f"more than {whole} different ids in a segment")
    scaled = np.where(used, np.maximum(1, counts * whole // max(int(counts.sum()), 1)), 0).astype(np.int64)
    while (excess := int(scaled.sum()) - whole) > 0:
        room = np.maximum(scaled - 1, 0)
        scaled -= np.minimum(room, -(-room * excess // max(int(room.sum()), 1)))
    if used.any():
        scaled[scaled.argmax()] += whole - scaled.sum()
    return scaled


def _pack_table(freq: np.ndarray) -> bytes:
    """Which symbols occur as a bit map, then a byte each; 255 refers to a list of larger ones."""
    present = freq[freq > 0]
    small = np.minimum(present - 1, 255).astype(np.uint8)
    large = present[small == 255].astype("<u4")
    bits = np.packbits(freq > 0)
    return struct.pack("<III", len(freq), len(small), len(large)) + bits.tobytes() + small.tobytes() + large.tobytes()


def _unpack_table(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    symbols, n_small, n_large = struct.unpack_from("<III", data, at)
    at += 12
    n_bits = (symbols + 7) // 8
    used = np.unpackbits(np.frombuffer(data, np.uint8, n_bits, at))[:symbols].astype(bool)
    at += n_bits
    present = np.frombuffer(data, np.uint8, n_small, at).astype(np.int64) + 1
    at += n_small
    present[present == 256] = np.frombuffer(data, "<u4", n_large, at)
    freq = np.zeros(symbols, dtype=np.int64)
    freq[used] = present
    return freq, at + 4 * n_large


def encode(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment of the documents `doc_ids`, whose ids follow each other in `ids`."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    counts = np.bincount(ids, minlength=1) if n else np.zeros(1, np.int64)
    freq = frequencies(counts)
    starts = np.concatenate([[0], np.cumsum(freq)[:-1]])
    # A short segment needs no more steps than its ids fill.
    steps = -(-min(n, BLOCK) // LANES)
    padded = np.full(n_blocks * steps * LANES, int(freq.argmax()), dtype=np.int64)
    padded[:n] = ids
    grid = padded.reshape(n_blocks, steps, LANES)

    freq64, start64 = freq.astype(np.uint64), starts.astype(np.uint64)
    state = np.full((n_blocks, LANES), _LOW, dtype=np.uint64)
    words = np.zeros((steps, n_blocks, LANES), dtype="<u4")
    emitted = np.zeros((steps, n_blocks, LANES), dtype=bool)
    saved = np.zeros((-(-steps // CHECKPOINT), n_blocks, LANES), dtype="<u8")
    for t in range(steps - 1, -1, -1):
        f = freq64[grid[:, t]]
        full = state >= f << np.uint64(63 - SCALE)
        words[t] = state & np.uint64(0xFFFFFFFF)
        emitted[t] = full
        state = np.where(full, state >> _WORD, state)
        quotient = state // f
        state = (quotient << np.uint64(SCALE)) + (state - quotient * f) + start64[grid[:, t]]
        if t % CHECKPOINT == 0:
            saved[t // CHECKPOINT] = state

    blocks, directory = [], b""
    for b in range(n_blocks):
        before = np.concatenate([[0], emitted[:, b].sum(axis=1).cumsum()])[:steps:CHECKPOINT].astype("<u4")
        stream = words[:, b][emitted[:, b]]
        block = before.tobytes() + np.ascontiguousarray(saved[:, b]).tobytes() + stream.tobytes()
        directory += struct.pack("<II", len(block), zlib.crc32(block))
        blocks.append(block)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    head = (
        _HEADER.pack(MAGIC, len(doc_ids), n, n_blocks, steps, LANES, BLOCK, CHECKPOINT, SCALE)
        + known.tobytes() + np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes()
        + np.array(lengths, dtype="<u8").tobytes() + _pack_table(freq) + directory
    )
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


@dataclass
class Segment:
    """A parsed segment; ids are decoded when asked for."""

    doc_ids: list[int | None]
    lengths: np.ndarray
    n_ids: int
    freq: np.ndarray
    steps: int
    spans: list[tuple[int, int, int]]  # start, length and CRC-32 of each block
    data: memoryview

    @classmethod
    def parse(cls, payload: bytes) -> Segment:
        data = memoryview(payload)
        magic, n_docs, n, n_blocks, steps, lanes, block, checkpoint, scale = _HEADER.unpack_from(data, 0)
        if (magic, lanes, block, checkpoint, scale) != (MAGIC, LANES, BLOCK, CHECKPOINT, SCALE):
            raise ValueError("not a segment of this format")
        at = _HEADER.size
        known = np.frombuffer(data, np.uint8, n_docs, at)
        at += n_docs
        doc_ids = [int(x) if k else None for k, x in zip(known, np.frombuffer(data, "<i8", n_docs, at))]
        at += 8 * n_docs
        lengths = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        freq, at = _unpack_table(data, at + 8 * n_docs)
        entries = [struct.unpack_from("<II", data, at + 8 * b) for b in range(n_blocks)]
        at += 8 * n_blocks
        if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
            raise ValueError("damaged header")
        at, spans = at + 4, []
        for size, crc in entries:
            spans.append((at, size, crc))
            at += size
        return cls(doc_ids, lengths, n, freq, steps, spans, data)

    def _tables(self):
        freq = self.freq.astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        symbol = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq)
        return freq, start, symbol

    def ids(self, blocks: list[int] | None = None, checkpoint: int = 0) -> np.ndarray:
        """The ids of the given blocks (all by default), from the given checkpoint of each on."""
        chosen = list(range(len(self.spans))) if blocks is None else blocks
        if not chosen:
            return np.zeros(0, dtype=np.int64)
        n_saved = -(-self.steps // CHECKPOINT)
        first = checkpoint * CHECKPOINT
        state = np.zeros((len(chosen), LANES), dtype=np.uint64)
        streams, at = [], np.zeros((len(chosen), 1), dtype=np.int64)
        offset = 0
        for i, b in enumerate(chosen):
            start, size, crc = self.spans[b]
            block = self.data[start:start + size]
            if zlib.crc32(block) != crc:
                raise ValueError(f"block {b} is damaged")
            before = np.frombuffer(block, "<u4", n_saved)
            state[i] = np.frombuffer(block, "<u8", LANES, 4 * n_saved + 8 * LANES * checkpoint)
            stream = np.frombuffer(block, "<u4", offset=4 * n_saved + 8 * LANES * n_saved)
            at[i] = offset + int(before[checkpoint])
            offset += len(stream)
            streams.append(stream)
        words = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
        freq, start, symbol = self._tables()
        out = np.zeros((len(chosen), self.steps - first, LANES), dtype=np.int32)
        mask = np.uint64((1 << SCALE) - 1)
        for t in range(self.steps - first):
            slot = state & mask
            found = symbol[slot]
            out[:, t] = found
            state = freq[found] * (state >> np.uint64(SCALE)) + slot - start[found]
            short = state < _LOW
            taken = np.cumsum(short, axis=1)
            fresh = words[np.minimum(at + taken - 1, len(words) - 1)]
            state = np.where(short, (state << _WORD) | fresh, state)
            at += taken[:, -1:]
        pieces = []
        for i, b in enumerate(chosen):
            size = min(BLOCK, self.n_ids - b * BLOCK)
            pieces.append(out[i].ravel()[: max(size - first * LANES, 0)])
        return np.concatenate(pieces)
