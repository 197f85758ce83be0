"""Adaptive context-mixing range coder for token ids, many blocks side by side.

A file of ids is cut into blocks of ``BLOCK`` ids. Every block starts from reset models and a reset coder and has its
own checksum, so each can be read alone with the file's header. Blocks are coded in step: one array operation does
the same step of all blocks.

An id's probability mixes three predictions. Order 2 and order 1 each remember, for a hash of the last two ids or the
last id, which id came next and how often in a row that was right (0 to 15); order 0 is the frequency of the id in
the file, held in the header. Per block, order and confidence, the coder learns how often that prediction is right, and
gives it that share: share2 to order 2's id, share1 of the rest to order 1's id, what is left to order 0.
The mixture is one cumulative table, monotone with two jumps, so each id costs one step of a carry-less range coder
with 64-bit state and 16-bit output words.

File layout, little-endian: ``MAGIC``, u32 ids, u32 block size, u32 distinct ids, u32 crc32 of the two tables; u32 distinct
ids ascending; u32 their frequencies (sum 2**18); u32 words of each block; u32 crc32 of each block's ids; then the
blocks' u16 words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"TIDC0001"
BLOCK = 2048
BASE_BITS, MIX_BITS = 18, 28  # totals of order 0 and of the mixture
SLOTS = 1024  # remembered contexts of a block and order
RATE = 4  # learning speed of the shares
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_U = np.uint64


_MASK = SLOTS - 1
# What a guess's entry gains, at its confidence and 16 times whether it was right: a wrong guess halves it, a right one adds 1 up to 15.
_STEP = np.array([(c >> 1) - c for c in range(16)] + [int(c < 15) for c in range(16)], np.int32)


class _Models:
    """What both orders remember, for all lanes: a slot holds an id and, in the low four bits, its confidence.

    Arrays hold order 1's lanes, then order 2's, so that one operation does both.
    """

    def __init__(self, lanes: int) -> None:
        self.slot, self.share = np.zeros(2 * lanes * SLOTS, np.int32), np.full(2 * lanes * 16, 1024, np.int32)
        self.row, self.share_row = np.arange(2 * lanes) * SLOTS, np.arange(2 * lanes) * 16
        self.hash, self.context, self.lanes = np.zeros(lanes, np.int64), np.zeros(2 * lanes, np.int64), lanes

    def look(self) -> None:
        """Guessed ids and their weights, and order 0's factor; a lane's add up to 2**28."""
        n = self.lanes
        self.at = self.context & _MASK
        self.at += self.row
        self.entry = self.slot.take(self.at)
        self.guess, self.conf = self.entry >> 4, self.entry & 15
        self.share_at = self.share_row + self.conf
        self.now = self.share.take(self.share_at)
        self.weight = np.empty(2 * n, np.int32)
        one, two = self.weight[:n], self.weight[n:]
        rest = np.int32(1 << MIX_BITS) - (self.now[n:] << (MIX_BITS - 12))
        np.multiply(rest >> 12, self.now[:n], out=one)
        rest -= one
        self.base = rest >> BASE_BITS
        np.subtract(np.int32(1 << MIX_BITS), one, out=two)
        two -= self.base << BASE_BITS

    def interval(self, ids: np.ndarray, cum: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids in the mixture; they are what is learned next."""
        n = self.lanes
        self.ids = np.concatenate((ids, ids))
        past = self.guess - self.ids
        self.right = (past == 0).astype(np.int32)
        start, size = cum.take(ids), freq.take(ids)
        start *= self.base
        size *= self.base
        past >>= 31
        past &= self.weight  # of guesses below the id
        start += past[:n]
        start += past[n:]
        same = self.right * self.weight
        size += same[:n]
        size += same[n:]
        return start, size

    def guesses(self, cum: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the guessed ids in the mixture."""
        n = self.lanes
        base = np.concatenate((self.base, self.base))
        start, size = cum.take(self.guess), freq.take(self.guess)
        start *= base
        size *= base
        size += self.weight
        other = np.concatenate((self.weight[n:], self.weight[:n]))
        past = np.concatenate((self.guess[n:], self.guess[:n]))
        past -= self.guess
        size += other * (past == 0)
        past >>= 31
        past &= other
        start += past
        return start, size

    def learn(self) -> None:
        target = self.right * np.int32(3900)
        target += np.int32(16)
        target -= self.now
        target >>= RATE
        target += self.now
        self.share[self.share_at] = target
        # a wrong guess without confidence gives way; else confidence grows by one or halves
        step = self.right << 4
        step |= self.conf
        entry = _STEP.take(step)
        entry += self.entry
        np.copyto(entry, self.ids << 4, where=step == 0)
        self.slot[self.at] = entry
        n = self.lanes
        before = self.hash * 5
        before >>= 2
        self.hash = self.ids[:n] * np.int64(40503)
        self.hash >>= 5
        self.context[:n] = self.hash
        np.bitwise_xor(self.hash, before, out=self.context[n:])

    def keep(self, lanes: int) -> None:
        """Only the first lanes go on."""
        for what in ("row", "share_row", "context"):
            held = getattr(self, what)
            setattr(self, what, np.concatenate((held[:lanes], held[self.lanes : self.lanes + lanes])))
        self.hash, self.lanes = self.hash[:lanes], lanes


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and frequencies of at least 1 that add up to 2**18."""
    count = np.bincount(ids)
    known = np.flatnonzero(count)
    count = count[known]
    total = 1 << BASE_BITS
    if len(known) > total // 2:
        raise ValueError("more distinct ids than the order-0 table can hold")
    freq = 1 + (count * (total - len(known))) // max(1, count.sum())
    freq[np.argmax(freq)] += total - freq.sum()
    return known, freq


def encode(ids: np.ndarray) -> bytes:
    """The file of ``ids``, which are places in a vocabulary and so small numbers."""
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    known, freq = _frequencies(ids) if len(ids) else (np.empty(0, np.int64), np.empty(0, np.int64))
    cum = np.concatenate(([0], np.cumsum(freq)))
    place = np.zeros(int(known[-1]) + 1 if len(known) else 0, np.int32)
    place[known] = np.arange(len(known))
    symbol = place[ids]
    blocks = -(-len(ids) // BLOCK)
    words, lengths = _encode_blocks(symbol, freq, cum, blocks) if blocks else (np.empty(0, "<u2"), np.empty(0, np.int64))
    tables = known.astype("<u4").tobytes() + freq.astype("<u4").tobytes()
    checks = [zlib.crc32(ids[a : a + BLOCK].astype("<u4")) for a in range(0, len(ids), BLOCK)]
    head = struct.pack("<IIII", len(ids), BLOCK, len(known), zlib.crc32(tables))
    return MAGIC + head + tables + lengths.astype("<u4").tobytes() + np.array(checks, "<u4").tobytes() + words.tobytes()


def _encode_blocks(symbol: np.ndarray, freq: np.ndarray, cum: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    padded = np.zeros(BLOCK * blocks, np.int32)
    padded[: len(symbol)] = symbol
    grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    cum, freq = cum.astype(np.int32), freq.astype(np.int32)
    short = len(symbol) - (blocks - 1) * BLOCK  # steps of the last block
    models = _Models(blocks)
    low, range_ = np.zeros(blocks, _U), np.full(blocks, (1 << 64) - 1, _U)
    out, used = np.zeros((blocks, 2 * BLOCK + 8), "<u2"), np.zeros(blocks, np.int64)
    flat, row = out.reshape(-1), np.arange(blocks, dtype=np.int64) * out.shape[1]

    def emit(low: np.ndarray, range_: np.ndarray) -> None:
        far = (low ^ (low + range_)) >= _TOP
        at = np.flatnonzero(~far | (range_ < _BOT))
        if not len(at):
            return
        lo, ra, far, end = low[at], range_[at], far[at], row[at]
        place, lanes = end + used[at], at
        while True:  # only lanes that gave a word can have another
            if far.any():
                ra = np.where(far, (~lo + _U(1)) & (_BOT - _U(1)), ra)
            flat[place] = lo >> _U(48)
            place, lo, ra = place + 1, lo << _U(16), ra << _U(16)
            far = (lo ^ (lo + ra)) >= _TOP
            more = ~far | (ra < _BOT)
            low[lanes], range_[lanes], used[lanes] = lo, ra, place - end
            if not more.any():
                return
            lanes, lo, ra, far, place, end = lanes[more], lo[more], ra[more], far[more], place[more], end[more]

    n = blocks
    for step in range(BLOCK):
        if step == short:  # the last block is done
            if n == 1:
                break
            n -= 1
            models.keep(n)
        ids, lo, ra = grid[step, :n], low[:n], range_[:n]
        models.look()
        start, size = models.interval(ids, cum, freq)
        ra >>= _U(MIX_BITS)
        lo += ra * start.astype(_U)
        ra *= size.astype(_U)
        emit(lo, ra)
        models.learn()
    for k in range(4):
        flat[row + used] = (low >> _U(48 - 16 * k)).astype(np.uint16)
        used += 1
    return np.concatenate([out[i, : used[i]] for i in range(blocks)]), used


def decode(data: bytes) -> np.ndarray:
    """The ids of a file; raises if a checksum is wrong."""
    return np.concatenate([x for _, x in decode_blocks(data)] or [np.empty(0, np.int64)])


def decode_blocks(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(block, ids) of a file, checked one by one."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    total, block, distinct, check = struct.unpack_from("<IIII", data, 8)
    at, blocks = 24 + 8 * distinct, -(-total // block)
    if zlib.crc32(data[24:at]) != check:
        raise ValueError("the header's checksum is wrong")
    if not total:
        return
    known, freq = np.frombuffer(data, "<u4", distinct, 24).astype(np.int64), np.frombuffer(data, "<u4", distinct, 24 + 4 * distinct).astype(np.int64)
    lengths, checks = np.frombuffer(data, "<u4", blocks, at).astype(np.int64), np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    words = np.frombuffer(data, "<u2", int(lengths.sum()), at + 8 * blocks)
    grid = _decode_blocks(words, lengths, freq, total, block, blocks)
    for k in range(blocks):
        ids = known[grid[: min(block, total - k * block), k]]
        if zlib.crc32(ids.astype("<u4")) != checks[k]:
            raise ValueError(f"the checksum of block {k} is wrong")
        yield k, ids


def _decode_blocks(words: np.ndarray, lengths: np.ndarray, freq: np.ndarray, total: int, block: int, blocks: int) -> np.ndarray:
    cum, freq = np.concatenate(([0], np.cumsum(freq))).astype(np.int32), freq.astype(np.int32)
    of = np.repeat(np.arange(len(freq), dtype=np.int32), freq)  # the symbol at each point of the order-0 table
    grid = np.zeros((block, blocks), np.int32)
    short = total - (blocks - 1) * block
    models = _Models(blocks)
    words = np.concatenate((words, np.zeros(8, "<u2"))).astype(_U)
    place = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    low, range_, code = np.zeros(blocks, _U), np.full(blocks, (1 << 64) - 1, _U), np.zeros(blocks, _U)
    for _ in range(4):
        code = (code << _U(16)) | words[place]
        place += 1
    n, most, last_point = blocks, (1 << MIX_BITS) - 1, len(of) - 1
    for step in range(block):
        if step == short:
            if n == 1:
                break
            n -= 1
            models.keep(n)
        lo, ra, co = low[:n], range_[:n], code[:n]
        models.look()
        ra >>= _U(MIX_BITS)
        value = np.minimum((co - lo) // ra, _U(most)).astype(np.int32)
        start, size = models.guesses(cum, freq)
        past = np.concatenate((value, value))
        past -= start
        on = past >= 0
        on &= past < size
        ids = np.where(on[:n], models.guess[:n], models.guess[n:])
        # elsewhere the point lies past the whole weight of an order's id or before it
        rest = np.flatnonzero(~(on[:n] | on[n:]))
        two = rest + n
        plain = value[rest] - models.weight[rest] * (past[rest] > 0) - models.weight[two] * (past[two] > 0)
        ids[rest] = of.take(np.minimum(plain // models.base[rest], last_point))
        grid[step, :n] = ids
        start, size = models.interval(ids, cum, freq)
        lo += ra * start.astype(_U)
        ra *= size.astype(_U)
        far = (lo ^ (lo + ra)) >= _TOP
        at = np.flatnonzero(~far | (ra < _BOT))
        far = far[at]
        while len(at):  # only lanes that took a word can need another
            part, left, point = lo[at], ra[at], place[at]
            if far.any():
                left = np.where(far, (~part + _U(1)) & (_BOT - _U(1)), left)
            co[at] = (co[at] << _U(16)) | words[point]
            place[at] = point + 1
            part, left = part << _U(16), left << _U(16)
            lo[at], ra[at] = part, left
            far = (part ^ (part + left)) >= _TOP
            more = ~far | (left < _BOT)
            at, far = at[more], far[more]
        models.learn()
    return grid
