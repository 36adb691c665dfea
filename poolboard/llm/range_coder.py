"""Adaptive context-mixing range coder for blocks of token ids below 65,536.

Blocks are independent: each starts with an empty model and its own coder. All blocks of a segment are coded in
lockstep, one id of every block at a time, so a step is a handful of array operations over the blocks.

The model holds, per block, what followed the last two ids (order 2), what followed the last id (order 1) and the ids
seen lately (order 0, a slot by hash). Four events describe an id: the order-2 guess, the order-1 guess, a seen id
(its slot follows, 8 bits) or a new one (it follows, 16 bits). How far the orders are trusted is learned: the events'
cumulative frequencies belong to the pair of confidences of both guesses and adapt after each id. The events are
arithmetic-coded; slots and new ids, evenly spread as far as the model knows, are stored as they are.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMRC1\0"
#: Ids of a block; the last block of a segment is filled up with zeros.
BLOCK = 2048
#: Slots of the order-1 and order-2 tables; a power of two.
SLOTS = 512
#: Frequencies add up to 4096 and move by a 32nd of the way to their target; 32 is the least an event has in a target.
SCALE_BITS, RATE = 12, 5
#: Three cumulative frequencies share a long, 16 bits each.
FIELDS = 1 | 1 << 16 | 1 << 32
TOP = (1 << SCALE_BITS) << 48
#: The coder's range has up to 48 bits and gives 16 of them away below 2**32. It looks every second id: an id takes 12 at
#: most, so at least 20 are left for the second.
RANGE_BITS, DIGIT, CHECK = 48, 16, 2
LEAST, REST = 1 << RANGE_BITS - DIGIT, (1 << RANGE_BITS - DIGIT) - 1


def packed(one: int, two: int, three: int) -> int:
    return one | two << 16 | three << 32


#: A 32nd of the target of each cumulative frequency after each event: high above the event, low up to it.
STEP = np.array([packed(*[(128 - (4 - k) if k > event else k) for k in (1, 2, 3)]) for event in range(4)])


def hash2(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (before * 40503 + last * 30011) >> 5 & SLOTS - 1


def hash1(last: np.ndarray) -> np.ndarray:
    return (last * 40503) >> 3 & SLOTS - 1


def hash0(ids: np.ndarray) -> np.ndarray:
    return (ids * 40503) >> 7 & 0xFF


class Model:
    """Predictions and event frequencies of ``lanes`` blocks at once.

    A slot of ``two`` and ``one`` holds an id times four, plus how sure the guess is (0 to 3).
    """

    def __init__(self, lanes: int) -> None:
        self.at = np.arange(lanes)
        self.at16, self.at256, self.at_slots = self.at * 16, self.at * 256, self.at * SLOTS
        self.two = np.zeros(lanes * SLOTS, dtype=np.int32)
        self.one = np.zeros(lanes * SLOTS, dtype=np.int32)
        self.seen = np.zeros(lanes * 256, dtype=np.int32)
        # cumulative frequencies before event 1, 2 and 3, by the two confidences
        self.cumulative = np.full(lanes * 16, packed(1024, 2048, 3072))

    def predict(self, place2: np.ndarray, place1: np.ndarray) -> None:
        """Guesses and frequencies at the given slots."""
        self.place2, self.place1 = place2, place1
        self.slot2, self.slot1 = self.two.take(place2), self.one.take(place1)
        self.guess2, self.guess1 = self.slot2 >> 2, self.slot1 >> 2
        self.sure2, self.sure1 = self.slot2 & 3, self.slot1 & 3
        self.row = self.at16 + (self.sure2 << 2) + self.sure1
        self.borders = self.cumulative.take(self.row)

    def interval(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of an event's part of the scale."""
        shift = event << 4
        start = (self.borders << 16) >> shift & 0xFFFF
        return start, ((self.borders | TOP) >> shift & 0xFFFF) - start

    def event_at(self, value: np.ndarray) -> np.ndarray:
        """The event whose part holds a place on the scale: how many borders lie at or below it."""
        above = (((value * FIELDS) | FIELDS << 15) - self.borders) >> 15 & FIELDS
        return (above * FIELDS) >> 32 & 3

    def update(self, ids: np.ndarray, event: np.ndarray, hit1: np.ndarray, seen_at: np.ndarray) -> None:
        # a field moves by its target's 32nd less its own 32nd; borders stay apart by one at least
        self.cumulative[self.row] = self.borders + STEP.take(event) - (self.borders >> RATE & FIELDS * 0x7F)
        four = ids << 2
        self.two[self.place2] = np.where(event == 0, self.slot2 + (self.sure2 < 3), four)
        self.one[self.place1] = np.where(hit1, self.slot1 + (self.sure1 < 3), four)
        self.seen[seen_at] = ids


def encode_segment(ids: np.ndarray) -> bytes:
    """Segment bytes: magic, number of ids and blocks, crc32 of the rest: a table (crc32 of the ids, sizes), the blocks."""
    count = len(ids)
    lanes = -(-count // BLOCK)
    padded = np.zeros(lanes * BLOCK, dtype=np.int64)
    padded[:count] = ids
    steps = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    model = Model(lanes)
    # the two ids before each one are known, and with them all slots
    last, before = np.zeros_like(steps), np.zeros_like(steps)
    last[1:], before[2:] = steps[:-1], steps[:-2]
    places2, places1, places0 = hash2(before, last), hash1(last), hash0(steps)
    slots = places0.astype(np.uint8)
    for places, at in ((places2, model.at_slots), (places1, model.at_slots), (places0, model.at256)):
        places += at
    low, width = np.zeros(lanes, dtype=np.int64), np.full(lanes, (1 << RANGE_BITS) - 1, dtype=np.int64)
    digits = np.zeros((lanes, BLOCK + 4), dtype=np.int64)
    filled = np.zeros(lanes, dtype=np.int64)
    events = np.empty((BLOCK, lanes), dtype=np.uint8)
    for t in range(BLOCK):
        now, seen_at = steps[t], places0[t]
        model.predict(places2[t], places1[t])
        hit1 = now == model.guess1
        event = (now != model.guess2) * np.where(hit1, 1, 3 - (now == model.seen.take(seen_at)))
        start, size = model.interval(event)
        unit = width >> SCALE_BITS
        low += unit * start
        width = unit * size
        if t % CHECK == CHECK - 1:
            short = (width < LEAST).nonzero()[0]
            while len(short):
                digits[short, filled[short]] = low[short] >> RANGE_BITS - DIGIT
                filled[short] += 1
                low[short] = (low[short] & REST) << DIGIT
                width[short] <<= DIGIT
                short = short[width[short] < LEAST]
        events[t] = event
        model.update(now, event, hit1, seen_at)
    for _ in range(RANGE_BITS // DIGIT):
        digits[model.at, filled] = low >> RANGE_BITS - DIGIT
        filled += 1
        low = (low & REST) << DIGIT
    # carries run from the last digit to the first, for all blocks together
    for n in range(digits.shape[1] - 1, 0, -1):
        digits[:, n - 1] += digits[:, n] >> DIGIT
    words = (digits & 0xFFFF).astype("<u2")
    table, body = [], []
    for lane in range(lanes):
        own = padded[lane * BLOCK:(lane + 1) * BLOCK]
        event = events[:, lane]
        parts = (words[lane, :filled[lane]].tobytes(), slots[event == 2, lane].tobytes(),
                 own[event == 3].astype("<u2").tobytes())
        table.append(struct.pack("<IHHH", zlib.crc32(own.astype("<u4").tobytes()), filled[lane],
                                 len(parts[1]), len(parts[2]) // 2))
        body += parts
    rest = b"".join([*table, *body])
    return MAGIC + struct.pack("<QII", count, lanes, zlib.crc32(rest)) + rest


def decode_segment(raw: bytes) -> np.ndarray:
    """The ids of a segment as unsigned 32-bit; raises on a wrong magic or a checksum that doesn't hold."""
    if raw[:len(MAGIC)] != MAGIC:
        raise ValueError("not a segment of coded ids")
    count, lanes, check = struct.unpack_from("<QII", raw, len(MAGIC))
    at = len(MAGIC) + 16
    if zlib.crc32(raw[at:]) != check:
        raise ValueError("the segment's checksum doesn't hold")
    table = list(struct.iter_unpack("<IHHH", raw[at:at + 10 * lanes]))
    at += 10 * lanes
    most = [max(row[k] for row in table) if table else 0 for k in (1, 2, 3)]
    digits = np.zeros((lanes, max(3, most[0]) + 3), dtype=np.int64)
    slots, fresh = np.zeros((lanes, most[1] + 1), dtype=np.int64), np.zeros((lanes, most[2] + 1), dtype=np.int64)
    for lane, (_, a, b, c) in enumerate(table):
        digits[lane, :a] = np.frombuffer(raw, "<u2", a, at)
        slots[lane, :b] = np.frombuffer(raw, "u1", b, at + 2 * a)
        fresh[lane, :c] = np.frombuffer(raw, "<u2", c, at + 2 * a + b)
        at += 2 * a + b + 2 * c
    model = Model(lanes)
    code = digits[:, 0] << 2 * DIGIT | digits[:, 1] << DIGIT | digits[:, 2]
    width = np.full(lanes, (1 << RANGE_BITS) - 1, dtype=np.int64)
    read, slot_at, fresh_at = np.full(lanes, 3), np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    out = np.empty((BLOCK, lanes), dtype=np.int64)
    last = before = np.zeros(lanes, dtype=np.int64)
    for t in range(BLOCK):
        model.predict(hash2(before, last) + model.at_slots, hash1(last) + model.at_slots)
        unit = width >> SCALE_BITS
        event = model.event_at(np.minimum(code // unit, (1 << SCALE_BITS) - 1))
        start, size = model.interval(event)
        code -= unit * start
        width = unit * size
        now = np.where(event == 0, model.guess2, model.guess1)
        held = (event == 2).nonzero()[0]
        place = slot_at[held]
        now[held] = model.seen[slots[held, place] + model.at256[held]]
        slot_at[held] = place + 1
        new = (event == 3).nonzero()[0]
        place = fresh_at[new]
        now[new] = fresh[new, place]
        fresh_at[new] = place + 1
        if t % CHECK == CHECK - 1:
            short = (width < LEAST).nonzero()[0]
            while len(short):
                at_digit = read[short]
                code[short] = code[short] << DIGIT | digits[short, at_digit]
                read[short] = at_digit + 1
                width[short] <<= DIGIT
                short = short[width[short] < LEAST]
        out[t] = now
        model.update(now, event, now == model.guess1, hash0(now) + model.at256)
        before, last = last, now
    ids = np.ascontiguousarray(out.T).astype("<u4")
    for lane, row in enumerate(table):
        if zlib.crc32(ids[lane].tobytes()) != row[0]:
            raise ValueError(f"block {lane}: checksum doesn't hold")
    return ids.reshape(-1)[:count]
