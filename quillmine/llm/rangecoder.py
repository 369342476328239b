"""Adaptive context-mixing range coder for token ids, on many blocks at once.

A segment's head has what its ids have in common: how often each id comes in each of up to TOPICS kinds of text (order 0), and
the likeliest id after an id (order 1) and after two (order 2), each with how sure it is. Each block of up to BLOCK ids starts
from this head, whatever other blocks hold, and adapts to its own ids: chances of being right per order and sureness, weights of
the three orders, and the kind of text at hand. Whether the predicted id is right has the mixed chance of the three orders;
other ids share the rest by order 0. That makes one step of the range coder an id. A block carries a CRC-32 of its ids.

All arithmetic is on integers, so any machine decodes what another wrote. numpy works on one id of every block at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
#: Blocks coded at once.
LANES = 4096
MAGIC = b"QMC2"
TOPICS = 8
#: Order 0 has its frequencies in 2**FREQ_BITS, the mixed chance in 2**CHANCE_BITS; both together fill 32 bits.
FREQ_BITS, CHANCE_BITS = 20, 12
#: Entries of the table of two ids: upper 16 bits the id, then 4 of sureness, then 12 that tell contexts of one place apart.
SLOTS_BITS = 17
#: Contexts that save fewer bits than their entries take are left out.
WORTH_1, WORTH_2 = 24.0, 40.0
U64, I32 = np.uint64, np.int32
K1, K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Code goes out in words of 32 bits, when they are settled or the range would get too narrow for the next step.
TOP = BOT = U64(1 << 32)

#: stretch(p) = ln(p / (1 - p)) and its inverse, in whole numbers: p in 1/4096, the result in 1/256.
_P = (np.arange(4096) + 0.5) / 4096
STRETCH = np.round(np.log(_P / (1 - _P)) * 256).astype(I32)
SQUASH = np.clip(np.round(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 65536 - 32).astype(I32)
#: 256 times the natural logarithm of 1 + i/256. Like the two tables above, whole numbers far from a tie in rounding.
LOGS = np.round(np.log(1 + np.arange(256) / 256) * 256).astype(np.int64)
#: Chances in 65536 that the sureness 1 to 15 stands for when a block begins.
SURE = np.clip((np.arange(16) / 16 * 65536), 2048, 63488).astype(I32)


def _log(x: np.ndarray) -> np.ndarray:
    """About 256 times the natural logarithm of whole numbers from 1, without floating-point logarithms."""
    mantissa, exponent = np.frexp(x.astype(np.float64))
    return (exponent.astype(np.int64) - 1) * 45426 // 256 + LOGS[(mantissa * 512 - 256).astype(np.int64)]


def _context(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    h = older.astype(np.uint32) * K1 + newer.astype(np.uint32) * K2
    return h ^ (h >> np.uint32(15))


def _followers(key: np.ndarray, follower: np.ndarray, worth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, likeliest follower, sureness 1 to 15, bits saved) of the contexts that are worth an entry."""
    both = key.astype(U64)
    both <<= U64(16)
    both |= follower
    both.sort()
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    times = np.diff(np.append(first, len(both)))
    each = both[first]
    of = each >> U64(16)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    if not len(starts):
        return of, of, times, times
    most, total = np.maximum.reduceat(times, starts), np.add.reduceat(times, starts)
    best = np.flatnonzero(times == np.repeat(most, np.diff(np.append(starts, len(of)))))
    group = np.searchsorted(starts, best, "right") - 1
    best = best[np.append(True, group[1:] != group[:-1])[: len(group)]]
    sure = np.clip(most * 16 // total, 1, 15)
    saved = np.where(sure > 1, most * 6.0, 0.0)
    keep = saved >= worth
    return of[starts][keep], (each[best] & U64(0xFFFF))[keep], sure[keep], saved[keep]


def _scaled(counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Whole frequencies that sum to 2**FREQ_BITS, one at least for each id in use."""
    room = (1 << FREQ_BITS) - int(used.sum())
    total = max(int(counts.sum()), 1)
    freq = np.where(used, counts.astype(np.int64) * room // total + 1, 0)
    freq[int(np.argmax(freq))] += (1 << FREQ_BITS) - int(freq.sum())
    return freq


def _topics(blocks: np.ndarray, lens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of each id in each of TOPICS kinds of text: stretches of 128 ids are dealt to the kind that fits them best, a few rounds."""
    width = 128
    flat = blocks[:, : blocks.shape[1] // width * width].reshape(-1, width)
    ends = (np.arange(blocks.shape[1] // width) + 1) * width
    flat = flat[(ends[None, :] <= lens[:, None]).ravel()]
    sample = flat[:: max(1, len(flat) // 4096)]
    if len(sample) < 64:
        return counts[None, :].astype(np.int64)
    size = len(counts)
    # Stretches are first told apart by which of the frequent ids they hold.
    frequent = np.argsort(-counts, kind="stable")[:256]
    place = np.full(size, -1)
    place[frequent] = np.arange(len(frequent))
    at = place[sample]
    row = np.repeat(np.arange(len(sample)), width)[at.ravel() >= 0]
    hold = np.bincount(row * 256 + at.ravel()[at.ravel() >= 0], minlength=len(sample) * 256).reshape(len(sample), 256).astype(np.float64)
    hold = np.sqrt(hold)
    centre = [hold[0]]
    for _ in range(TOPICS - 1):
        far = np.min([((hold - c) ** 2).sum(axis=1) for c in centre], axis=0)
        centre.append(hold[int(np.argmax(far))])
    of = np.argmin([((hold - c) ** 2).sum(axis=1) for c in centre], axis=0)
    part = slice(None, None, 4)  # all but the last round go by every fourth stretch
    for last in (False, False, False, False, True):
        seen, told = sample[part], of[part]
        logs = []
        for k in range(TOPICS):
            own = np.bincount(seen[told == k].ravel(), minlength=size) + 0.02 * counts * (np.sum(told == k) + 1) * width / max(int(counts.sum()), 1) + 1e-9
            logs.append(np.log(own / own.sum()))
        if last:
            part = slice(None)
        of[part] = np.argmax([x[sample[part]].sum(axis=1) for x in logs], axis=0)
    out = np.array([np.bincount(sample[of == k].ravel(), minlength=size) for k in range(TOPICS) if (of == k).any()], dtype=np.int64)
    scale = max(1.0, counts.sum() / max(1, sample.size))
    return (out * 64 * scale).astype(np.int64) + counts[None, :].astype(np.int64) * 2


class Head:
    """Tables that all blocks of a segment start from."""

    def __init__(self, freqs: np.ndarray, order1: np.ndarray, order2: np.ndarray):
        self.freq, self.order1, self.order2 = freqs, order1, order2
        topics, size = freqs.shape
        self.size = size
        self.start = np.zeros((topics, size), dtype=np.int64)
        self.start[:, 1:] = np.cumsum(freqs, axis=1)[:, :-1]
        self.flat_freq, self.flat_start = freqs.ravel().astype(U64), self.start.ravel().astype(U64)
        chance = np.clip(freqs >> (FREQ_BITS - 12), 0, 4095)
        self.stretch = STRETCH[chance].ravel().astype(np.int16)
        # How much likelier an id is in each kind of text than in the mean of all, in 1/256 of the logarithm.
        if topics > 1:
            logs = _log(np.maximum(freqs, 1))
            told = np.clip(logs - logs.sum(axis=0) // topics, -640, 640).astype(np.int16)
            told[:, ~freqs.any(axis=0)] = 0
            self.told = np.ascontiguousarray(told)

    @staticmethod
    def of(blocks: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> "Head":
        size = int(ids.max()) + 1 if len(ids) else 1
        counts = np.bincount(ids, minlength=size)
        used = counts > 0
        if not used.any():
            used[0] = True
        freqs = np.array([_scaled(c, used) for c in _topics(blocks, lens, counts)])
        order1, order2 = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << SLOTS_BITS, dtype=np.uint32)
        if len(ids) > 2:
            of, best, sure, _ = _followers(ids[:-1], ids[1:], WORTH_1)
            order1[of.astype(np.int64)] = best.astype(np.uint32) << np.uint32(16) | sure.astype(np.uint32) << np.uint32(12)
            h = _context(ids[:-2], ids[1:-1])
            of, best, sure, saved = _followers(h, ids[2:], WORTH_2)
            entry = best.astype(np.uint32) << np.uint32(16) | sure.astype(np.uint32) << np.uint32(12) | (of.astype(np.uint32) & np.uint32(0xFFF))
            order = np.argsort(saved, kind="stable")  # the last written stays: the one that saves most
            order2[(of[order] >> U64(32 - SLOTS_BITS)).astype(np.int64)] = entry[order]
        return Head(freqs, order1, order2)

    def pack(self) -> bytes:
        parts = [struct.pack("<II", *self.freq.shape)]
        for table in (self.freq.astype("<u4"), self.order1[: self.size], self.order2):
            flat = np.ascontiguousarray(table).ravel().astype("<u4")
            at = np.flatnonzero(flat)
            gaps = np.diff(at, prepend=-1).astype("<u4")
            # Bytes of one weight stand together, which compresses better.
            planes = b"".join(x.view(np.uint8).reshape(-1, 4)[:, k].tobytes() for x in (gaps, flat[at]) for k in range(4))
            pressed = zlib.compress(planes, 5)
            parts.append(struct.pack("<II", len(at), len(pressed)) + pressed)
        return b"".join(parts)

    @staticmethod
    def unpack(data: bytes) -> "Head":
        topics, size = struct.unpack_from("<II", data)
        if not 0 < topics <= TOPICS or not 0 < size <= 1 << 16:
            raise ValueError("a segment's head is damaged")
        at, tables = 8, []
        for length in (topics * size, 1 << 16, 1 << SLOTS_BITS):
            n, pressed = struct.unpack_from("<II", data, at)
            planes = np.frombuffer(zlib.decompress(data[at + 8 : at + 8 + pressed]), dtype=np.uint8).reshape(2, 4, n)
            gaps, values = (np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes)
            table = np.zeros(length, dtype=np.uint32)
            table[np.cumsum(gaps.astype(np.int64)) - 1] = values
            tables.append(table)
            at += 8 + pressed
        return Head(tables[0].reshape(topics, size).astype(np.int64), *tables[1:])


class Model:
    """What adapts in each block, a column per block. Each of the 64 chances of a block has its standing in 65536."""

    def __init__(self, head: Head, lanes: int):
        self.head = head
        begin = np.concatenate((SURE, SURE // 4, SURE, SURE)).astype(I32)
        self.chance = np.tile(begin, lanes)
        self.base = np.arange(lanes, dtype=np.int64) * 64
        self.weight = np.empty((3, lanes), dtype=I32)
        self.weight[0], self.weight[1:] = 1 << 13, 1 << 15
        self.topic = np.zeros(lanes, dtype=np.int64)
        self.for_topic = np.zeros((len(head.freq), lanes), dtype=np.int16)
        self.steps = 0
        self.x = np.empty((3, lanes), dtype=I32)
        self.slot = np.empty((2, lanes), dtype=np.int64)

    def look(self, entry1: np.ndarray, entry2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(candidate, whether there is one, places of its chances by order 1 and 2), for entries of one step or of several."""
        sure2, sure1 = entry2 >> np.uint32(12) & np.uint32(15), entry1 >> np.uint32(12) & np.uint32(15)
        c1 = entry1 >> np.uint32(16)
        cand = np.where(sure2, entry2 >> np.uint32(16), c1)
        other = (c1 != cand).astype(np.uint32) << np.uint32(4)
        return cand.astype(np.int64), (sure2 | sure1) != 0, self.base + (sure1 + other), self.base + (sure2 + other + np.uint32(32))

    def predict(self, cand: np.ndarray, asked: np.ndarray, slot1: np.ndarray, slot2: np.ndarray) -> np.ndarray:
        """The chance in 4096 that the candidate of each block is right, 0 where it has none."""
        self.cand, self.asked = cand, asked
        self.slot[0], self.slot[1] = slot1, slot2
        self.had = self.chance.take(self.slot)
        self.x[0] = self.head.stretch.take(self.topic + cand)
        STRETCH.take(self.had >> 4, out=self.x[1:], mode="clip")
        dot = (self.weight * self.x).sum(axis=0, dtype=I32) >> 16
        np.minimum(np.maximum(dot, -2047, out=dot), 2047, out=dot)
        self.p = SQUASH.take(dot + 2047)
        return (self.p >> 4) * asked

    def learn(self, hit: np.ndarray, ids: np.ndarray) -> None:
        goal = hit.astype(I32) << 16
        err = (goal - self.p) * self.asked
        self.weight += (self.x * err + (1 << 13)) >> 14
        np.minimum(np.maximum(self.weight, -(1 << 18), out=self.weight), 1 << 18, out=self.weight)
        # Steps of a 32nd keep a chance between 31 and 65536 - 31.
        self.chance[self.slot] = self.had + (((goal - self.had) * self.asked) >> 5)
        self.steps += 1
        if self.steps % 2 == 0 and len(self.for_topic) > 1:
            # Every other id tells the kind of text.
            self.for_topic += self.head.told.take(ids, axis=1)
            if self.steps % 4 == 0:
                self.for_topic -= self.for_topic >> 3
                np.multiply(self.for_topic.argmax(axis=0), self.head.size, out=self.topic)


def _low_bits(low: np.ndarray) -> np.ndarray:
    return np.negative(low) & (BOT - U64(1))


class Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, dtype=U64)
        self.rng = np.full(lanes, 2**64 - 1, dtype=U64)
        self.out = np.zeros((lanes, steps // 3 + 8), dtype=np.uint32)
        self.at = np.zeros(lanes, dtype=np.int64)

    def put(self, start: np.ndarray, freq: np.ndarray) -> None:
        r = self.rng >> U64(32)
        self.low += start * r
        np.multiply(r, freq, out=self.rng)
        idx = np.flatnonzero(((self.low ^ (self.low + self.rng)) < TOP) | (self.rng < BOT))
        while len(idx):
            low, rng = self.low[idx], self.rng[idx]
            rng = np.where((low ^ (low + rng)) < TOP, rng, _low_bits(low))
            at = self.at[idx]
            if int(at.max()) + 4 > self.out.shape[1]:
                self.out = np.concatenate((self.out, np.zeros_like(self.out)), axis=1)
            self.out[idx, at] = low >> U64(32)
            self.at[idx] = at + 1
            low, rng = low << U64(32), rng << U64(32)
            self.low[idx], self.rng[idx] = low, rng
            idx = idx[((low ^ (low + rng)) < TOP) | (rng < BOT)]

    def done(self) -> list[bytes]:
        for shift in (32, 0):
            self.out[np.arange(len(self.at)), self.at] = (self.low >> U64(shift)) & U64(0xFFFFFFFF)
            self.at += 1
        return [self.out[i, : self.at[i]].astype("<u4").tobytes() for i in range(len(self.at))]


class Decoder:
    def __init__(self, data: list[bytes]):
        n = max(map(len, data), default=0) // 4 + 4
        self.words = np.zeros((len(data), n), dtype=np.uint32)
        for i, d in enumerate(data):
            self.words[i, : len(d) // 4] = np.frombuffer(d, dtype="<u4", count=len(d) // 4)
        self.low = np.zeros(len(data), dtype=U64)
        self.rng = np.full(len(data), 2**64 - 1, dtype=U64)
        self.code = self.words[:, 0].astype(U64) << U64(32) | self.words[:, 1]
        self.row = np.arange(len(data)) * n
        self.at = self.row + 2
        self.last = self.row + n - 1
        self.flat = self.words.ravel()

    def ask(self) -> np.ndarray:
        self.r = self.rng >> U64(32)
        return np.minimum((self.code - self.low) // self.r, U64(2**32 - 1))

    def took(self, start: np.ndarray, freq: np.ndarray) -> None:
        self.low += start * self.r
        np.multiply(self.r, freq, out=self.rng)
        idx = np.flatnonzero(((self.low ^ (self.low + self.rng)) < TOP) | (self.rng < BOT))
        while len(idx):
            low, rng = self.low[idx], self.rng[idx]
            rng = np.where((low ^ (low + rng)) < TOP, rng, _low_bits(low))
            at = self.at[idx]
            self.code[idx] = self.code[idx] << U64(32) | self.flat[at]
            self.at[idx] = np.minimum(at + 1, self.last[idx])
            low, rng = low << U64(32), rng << U64(32)
            self.low[idx], self.rng[idx] = low, rng
            idx = idx[((low ^ (low + rng)) < TOP) | (rng < BOT)]


def _entry2(order2: np.ndarray, older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    h = _context(older, newer)
    e = order2.take((h >> np.uint32(32 - SLOTS_BITS)).astype(np.int64))
    return e * (((e ^ h) & np.uint32(0xFFF)) == 0)


def _encode_lanes(ids: np.ndarray, lens: np.ndarray, head: Head) -> list[bytes]:
    """ids: a row per block, lens: ids in each; blocks by falling length."""
    lanes, steps = ids.shape
    by_step = np.zeros((steps + 2, lanes), dtype=np.uint16)  # two ids 0 stand before each block
    by_step[2:] = ids.T
    m, coder = Model(head, lanes), Encoder(lanes, steps)
    live = np.searchsorted(-lens, -np.arange(steps), "left")  # blocks longer than t ids stand first
    for t in range(steps):
        if t % 16 == 0:
            slab = by_step[t : t + 18].astype(np.int64)
            older, newer = slab[:-2], slab[1:-1]
            looked = m.look(head.order1.take(newer), _entry2(head.order2, older, newer))
        now = slab[t % 16 + 2]
        p = m.predict(*(x[t % 16] for x in looked)).astype(U64)
        hit = (m.cand == now) & m.asked
        rest = U64(4096) - p
        p <<= U64(FREQ_BITS)
        at = m.topic + now
        start = np.where(hit, U64(0), p + rest * head.flat_start.take(at))
        freq = np.where(hit, p, rest * head.flat_freq.take(at))
        if live[t] < lanes:  # ended blocks take the whole range
            start[live[t] :], freq[live[t] :] = 0, 1 << 32
        coder.put(start, freq)
        m.learn(hit, now)
    return coder.done()


def _decode_lanes(data: list[bytes], lens: np.ndarray, head: Head) -> np.ndarray:
    lanes, steps = len(data), int(lens.max())
    m, coder = Model(head, lanes), Decoder(data)
    # The id at each place of order 0's range, a row per kind of text.
    at_place = np.concatenate([np.repeat(np.arange(head.size, dtype=np.uint16), f) for f in head.freq])
    live = np.searchsorted(-lens, -np.arange(steps), "left")
    out = np.zeros((steps, lanes), dtype=np.uint16)
    older = newer = np.zeros(lanes, dtype=np.int64)
    for t in range(steps):
        entry1 = head.order1.take(newer)
        entry2 = _entry2(head.order2, older, newer)
        p = m.predict(*m.look(entry1, entry2)).astype(U64)
        v = coder.ask()
        rest = U64(4096) - p
        p <<= U64(FREQ_BITS)
        hit = v < p
        place = (np.where(hit, U64(0), v - p) // rest).astype(np.int64)
        row = (m.topic // head.size) << FREQ_BITS if len(head.freq) > 1 else 0
        now = np.where(hit, m.cand, at_place.take(place + row, mode="clip"))
        if live[t] < lanes:
            now[live[t] :] = 0
        at = m.topic + now
        start = np.where(hit, U64(0), p + rest * head.flat_start.take(at, mode="clip"))
        freq = np.where(hit, p, rest * head.flat_freq.take(at, mode="clip"))
        if live[t] < lanes:
            start[live[t] :], freq[live[t] :] = 0, 1 << 32
            hit = (m.cand == now) & m.asked
        coder.took(start, freq)
        out[t] = now
        m.learn(hit, now)
        older, newer = newer, now
    return np.ascontiguousarray(out.T)


def encode_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: head, then the blocks' lengths, checksums (of ids and of code) and code. ids: below 65536."""
    ids = np.ascontiguousarray(ids, dtype=np.uint16)
    n = len(ids)
    n_blocks = -(-n // block)
    lens = np.full(n_blocks, block)
    if n_blocks:
        lens[-1] = n - block * (n_blocks - 1)
    padded = np.zeros(n_blocks * block, dtype=np.uint16)
    padded[:n] = ids
    padded = padded.reshape(n_blocks, block)
    head = Head.of(padded, lens, ids)
    table = head.pack()
    code: list[bytes] = []
    for i in range(0, n_blocks, LANES):
        code += _encode_lanes(padded[i : i + LANES, : lens[i]], lens[i : i + LANES], head)
    crc = [zlib.crc32(ids[i * block : i * block + lens[i]].astype("<u2").data) for i in range(n_blocks)]
    start = MAGIC + struct.pack("<QIII", n, block, n_blocks, len(table)) + table
    index = np.array([lens, [len(c) for c in code], crc, [zlib.crc32(c) for c in code]], dtype="<u4").tobytes() if n_blocks else b""
    return start + struct.pack("<I", zlib.crc32(start + index)) + index + b"".join(code)


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if anything in it is damaged."""
    data = bytes(data)
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, block, n_blocks, size = struct.unpack_from("<QIII", data, 4)
    at = 24 + size
    index = data[at + 4 : at + 4 + 16 * n_blocks]
    if len(index) < 16 * n_blocks or zlib.crc32(data[:at] + index) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("a segment's head is damaged")
    head = Head.unpack(data[24:at])
    lens, sizes, crc, code_crc = np.frombuffer(index, dtype="<u4").reshape(4, n_blocks).astype(np.int64)
    ends = at + 4 + len(index) + np.cumsum(sizes)
    if n_blocks and ends[-1] != len(data):
        raise ValueError("a segment is cut off")
    out = np.zeros(n, dtype=np.uint16)
    for i in range(0, n_blocks, LANES):
        k = slice(i, min(i + LANES, n_blocks))
        code = [data[e - s : e] for s, e in zip(sizes[k], ends[k], strict=True)]
        for j, c in enumerate(code):
            if zlib.crc32(c) != code_crc[i + j]:
                raise ValueError(f"block {i + j} is damaged")
        got = _decode_lanes(code, lens[k], head)
        for j in range(got.shape[0]):
            ids = got[j, : lens[i + j]]
            if zlib.crc32(np.ascontiguousarray(ids, dtype="<u2").data) != crc[i + j]:
                raise ValueError(f"block {i + j} is damaged")
            out[(i + j) * block : (i + j) * block + len(ids)] = ids
    return out
