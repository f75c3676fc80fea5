"""Records of containers as walks over bytes that need not be at hand whole.

A walk starts at a known place and gives the records that begin before ``stop``, in blocks; its
return value is where the next record begins and whether that place is still to be searched.
``guess`` gives places in a slice that look like the start of a record.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: What a walk returns: the next record's place, and whether it is only searched from there.
End = tuple[int, bool]


class Bytes:
    """Bytes of a file from ``base``; ``more(at, size)`` reads what is not at hand."""

    def __init__(self, data: bytes, base: int = 0, length: int | None = None, more: Callable | None = None):
        self.data, self.base, self.more = data, base, more
        self.length = base + len(data) if length is None else length

    def get(self, at: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``at``, fewer at the end of the file."""
        size = max(0, min(size, self.length - at))
        begin = at - self.base
        if 0 <= begin and begin + size <= len(self.data):
            return self.data[begin : begin + size]
        return self.more(at, size) if size else b""

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.get(at, size), "big")


@dataclass(frozen=True)
class Format:
    suffix: str
    schema: str
    walk: Callable[[Bytes, int, bool, int], Generator[list, None, End]]
    guess: Callable[[Bytes, int, int], list[int]]
    table: Callable[[str, Iterator, int, pa.Schema], Iterator[pa.RecordBatch]]


def _table(path: str, walk: Iterator[list[dict]], first: int, arrow: pa.Schema, size: int = 4096):
    """Blocks of rows as record batches; ``pos`` counts on from ``first``."""
    held: list[dict] = []
    for block in walk:
        for row in block:
            held.append({"pos": first, **row})
            first += 1
        if len(held) >= size:
            yield _batch(path, held, arrow)
            held = []
    if held:
        yield _batch(path, held, arrow)


def _batch(path: str, rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([path] * len(rows), pa.string())]
    columns += [pa.array([r.get(f.name) for r in rows], f.type) for f in list(arrow)[1:]]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


# FLV --------------------------------------------------------------------------------------
FLV_SCHEMA = (
    "pos bigint, offset bigint, type int, size int, ts bigint, stream_id int, data binary, "
    "error string"
)
TAG, WORD = 11, 4
#: Audio, video and script tags.
TAG_TYPES = (8, 9, 18)


def walk_flv(source: Bytes, at: int, searching: bool, stop: int):
    """Header, then previous-size words and tags of 11 header bytes and a body."""
    over = (source.length, False)
    if at == 0 and source.length:
        if source.length < 9 or source.get(0, 3) != b"FLV":
            yield [{"pos": None, "error": "no FLV header"}]
            return over
        at = source.number(5, 4) + WORD
    while at < min(stop, source.length):
        head = source.get(at, TAG)
        if len(head) < TAG:
            yield [{"offset": at, "error": "tag header cut"}]
            return over
        size = int.from_bytes(head[1:4], "big")
        if at + TAG + size > source.length:
            yield [{"offset": at, "error": "tag body cut"}]
            return over
        yield [{
            "offset": at, "type": head[0] & 0x1F, "size": size,
            # The eighth byte extends the 24-bit time upwards.
            "ts": int.from_bytes(head[4:7], "big") | head[7] << 24,
            "stream_id": int.from_bytes(head[8:11], "big"), "data": source.get(at + TAG, size),
        }]
        at += TAG + size + WORD
    return at, False


def guess_flv(source: Bytes, offset: int, stop: int) -> list[int]:
    """The first place with a tag whose size stands again behind it, as does the next tag's."""
    if offset == 0:
        return [0]
    raw = np.frombuffer(source.get(offset, stop - offset + TAG), np.uint8)
    n = max(0, min(stop - offset, len(raw) - TAG))
    likely = np.isin(raw[:n] & 0x1F, TAG_TYPES)
    for k in (8, 9, 10):
        likely &= raw[k : n + k] == 0

    def fits(at: int, tags: int) -> bool:
        if not tags or at == source.length:
            return True
        size = source.number(at + 1, 3)
        behind = at + TAG + size
        if behind + WORD > source.length or source.number(behind, WORD) != size + TAG:
            return False
        return fits(behind + WORD, tags - 1)

    for at in np.flatnonzero(likely):
        if fits(offset + int(at), 2):
            return [offset + int(at)]
    return []


# transport stream ---------------------------------------------------------------------------
TS_SCHEMA = (
    "pos bigint, pid int, error_flag int, unit_start int, priority int, scrambling int, "
    "adaptation int, cc int, error string"
)
PACKET, SYNC = 188, 0x47
#: Packets looked at in one step, and sync bytes in a row that make a likely start.
STEP, LIKELY = 1 << 16, 5


class _Packets:
    """The first four bytes of packets in a row, with what is wrong with them."""

    def __init__(self, heads: np.ndarray, error: str = ""):
        self.heads, self.error = heads, error

    def __len__(self):
        return len(self.heads)


def _is_sync(source: Bytes, at: int) -> bool:
    """A sync byte, or the end of the file."""
    return at >= source.length or source.get(at, 1)[0] == SYNC


def _resync(source: Bytes, low: int, high: int) -> int | None:
    """The first place from ``low`` before ``high`` where three packets in a row have sync bytes."""
    raw = np.frombuffer(source.get(low, high - low), np.uint8)
    for at in np.flatnonzero(raw == SYNC):
        place = low + int(at)
        if _is_sync(source, place + PACKET) and _is_sync(source, place + 2 * PACKET):
            return place
    return None


def walk_ts(source: Bytes, at: int, searching: bool, stop: int):
    """188-byte packets. A lost byte costs the packet it was in; a false sync byte is marked.

    A packet without its sync byte is one all the same if the next stands in its place; otherwise
    the next is searched. One with it, and without the next in its place, is cut short if another
    begins inside it. Damage less than three packets apart can cost the packets between.
    """
    stop = min(stop, source.length)
    while at < stop:
        if searching:
            place = _resync(source, at, stop)
            if place is None:
                return stop, stop < source.length
            at, searching = place, False
            continue
        if at + PACKET > source.length:
            yield _Packets(np.zeros((1, 4), np.int32), "packet cut")
            return source.length, False
        n = min(STEP, -(-(stop - at) // PACKET), (source.length - at) // PACKET)
        raw = np.frombuffer(source.get(at, n * PACKET + 1), np.uint8)
        heads = raw[: n * PACKET].reshape(n, PACKET)[:, :4].astype(np.int32)
        good = np.append(heads[:, 0] == SYNC, raw[n * PACKET] == SYNC if len(raw) > n * PACKET else True)
        plain = good[:-1] & good[1:]
        run = n if plain.all() else int(np.argmin(plain))
        if run:
            yield _Packets(heads[:run])
            at += run * PACKET
        if run == n:
            continue
        head, follows = heads[run : run + 1], good[run + 1]
        if not good[run]:
            yield _Packets(head, "no sync byte")
            at, searching = (at + PACKET, False) if follows else (at + 1, True)
            continue
        inside = _resync(source, at + 1, min(at + PACKET, source.length))
        yield _Packets(head, "" if inside is None else "bytes lost")
        at = at + PACKET if inside is None else inside
    return at, searching


def guess_ts(source: Bytes, offset: int, stop: int) -> list[int]:
    """Places in the first packet's length where sync bytes stand at every packet after."""
    if offset == 0:
        return [0]
    span = min(PACKET, stop - offset)
    raw = np.frombuffer(source.get(offset, span + (LIKELY - 1) * PACKET), np.uint8)
    likely = np.ones(span, bool)
    for k in range(LIKELY):
        seen = raw[k * PACKET : k * PACKET + span] == SYNC
        likely[: len(seen)] &= seen
    return [offset + int(at) for at in np.flatnonzero(likely)[:2]]


def batch_ts(parts: list[tuple[str, int, _Packets]], arrow: pa.Schema) -> pa.RecordBatch:
    """Header fields of packets (path, first pos, packets), read as columns of a byte matrix."""
    heads = np.concatenate([packets.heads for _, _, packets in parts])
    sizes = [len(packets) for _, _, packets in parts]
    errors = np.repeat(np.array([packets.error for _, _, packets in parts], object), sizes)
    paths = np.repeat(np.array([path for path, _, _ in parts], object), sizes)
    pos = np.concatenate([first + np.arange(len(packets)) for _, first, packets in parts])
    cut = errors == "packet cut"
    _, b1, b2, b3 = heads.T
    fields = (
        (b1 & 31) << 8 | b2, b1 >> 7, b1 >> 6 & 1, b1 >> 5 & 1, b3 >> 6, b3 >> 4 & 3, b3 & 15,
    )
    columns = [pa.array(paths, pa.string()), pa.array(pos, pa.int64())]
    columns += [pa.array(v, pa.int32(), mask=cut) for v in fields]
    columns.append(pa.array(errors, pa.string(), mask=errors == ""))
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def table_ts(path: str, walk: Iterator[_Packets], first: int, arrow: pa.Schema, size: int = 1 << 15):
    held, count = [], 0
    for packets in walk:
        held.append((path, first, packets))
        first, count = first + len(packets), count + len(packets)
        if count >= size:
            yield batch_ts(held, arrow)
            held, count = [], 0
    if held:
        yield batch_ts(held, arrow)


# web-socket frames ---------------------------------------------------------------------------
WS_SCHEMA = "pos bigint, offset bigint, final boolean, opcode int, size bigint, text string, error string"
#: Continuation, text, binary, close, ping and pong.
OPCODES = (0, 1, 2, 8, 9, 10)


def _ws_head(source: Bytes, at: int) -> tuple[int, int, int] | None:
    """(place of the mask, 1 if there is one, size of the body) of a frame; null if it is cut."""
    head = source.get(at, 10)
    if len(head) < 2:
        return None
    size, wide = head[1] & 127, 2
    if size >= 126:
        extra = 2 if size == 126 else 8
        size, wide = int.from_bytes(head[2 : 2 + extra], "big"), 2 + extra
    return at + wide, head[1] >> 7, size


def walk_ws(source: Bytes, at: int, searching: bool, stop: int):
    """Masked client frames one after another; lengths of 7, 16 or 64 bits."""
    over = (source.length, False)
    while at < min(stop, source.length):
        head = _ws_head(source, at)
        if head is None:
            yield [{"offset": at, "error": "frame header cut"}]
            return over
        mask, masked, size = head
        begin = mask + 4 * masked
        if begin + size > source.length:
            yield [{"offset": at, "size": size, "error": "frame cut"}]
            return over
        body = np.frombuffer(source.get(begin, size), np.uint8)
        if masked:
            body = body ^ np.resize(np.frombuffer(source.get(mask, 4), np.uint8), size)
        first = source.get(at, 1)[0]
        yield [{
            "offset": at, "final": bool(first >> 7), "opcode": first & 15, "size": size,
            "text": body.tobytes().decode("utf-8", "replace"),
        }]
        at = begin + size
    return at, False


def guess_ws(source: Bytes, offset: int, stop: int) -> list[int]:
    """The first place from which several frames in a row look right, or all up to the end."""
    if offset == 0:
        return [0]
    raw = np.frombuffer(source.get(offset, stop - offset), np.uint8)

    def fits(at: int, frames: int) -> bool:
        while frames and at < source.length:
            first, head = source.get(at, 1)[0], _ws_head(source, at)
            if first & 0x70 or first & 15 not in OPCODES or head is None:
                return False
            mask, masked, size = head
            if (size < 126) != (mask - at == 2) or (mask - at == 10 and size < 1 << 16):
                return False
            at, frames = mask + 4 * masked + size, frames - 1
        return at <= source.length

    for at in np.flatnonzero((raw & 0x70 == 0) & np.isin(raw & 15, OPCODES)):
        if fits(offset + int(at), LIKELY):
            return [offset + int(at)]
    return []


FORMATS = {
    "flv": Format(".flv", FLV_SCHEMA, walk_flv, guess_flv, _table),
    "ts": Format(".ts", TS_SCHEMA, walk_ts, guess_ts, table_ts),
    "ws": Format("", WS_SCHEMA, walk_ws, guess_ws, _table),
}
