"""Media columns: progressive JPEG in numpy.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays, inverse-transforms the
blocks, upsamples chroma and gives full-resolution RGB tensors. It works on all restart intervals of a batch of images side
by side: every step decodes one symbol of each interval. The encoder writes 4:2:0 images of given quantised coefficients in
eleven scans with restart intervals, so any bytes can be stored without loss: a byte b is the coefficient b - 128.
Transforms and colours are in whole numbers, so equal images give equal tensors wherever they are computed.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import spans, text_buffer, tidy

#: Blocks (MCUs in interleaved scans) a restart interval of the encoder.
INTERVAL = 4
#: Blocks that one vectorised step works on at most.
CHUNK_BLOCKS = 1 << 14
END_OF_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def zigzag() -> np.ndarray:
    """Raster place (row * 8 + column) of each zigzag place."""
    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    return np.array(order)


ZIGZAG = zigzag()
FIXED = 14  # fraction bits of the transform


def transform() -> np.ndarray:
    """(64 coefficients in zigzag order, 64 samples in raster order), rounded to FIXED fraction bits; products stay exact in doubles."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.round(both[ZIGZAG] * (1 << FIXED))


TRANSFORM = transform()


@dataclass(frozen=True)
class Huffman:
    """Code lengths and symbols as in a table segment."""

    bits: tuple[int, ...]  # number of codes of length 1 to 16
    symbols: tuple[int, ...]

    @functools.lru_cache(64)  # noqa: B019
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, length) by symbol; length 0 for symbols without a code."""
        code, k, out, lengths = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
        for n, many in enumerate(self.bits, 1):
            for _ in range(many):
                out[self.symbols[k]], lengths[self.symbols[k]] = code, n
                code += 1
                k += 1
            code <<= 1
        return out, lengths

    @functools.lru_cache(64)  # noqa: B019
    def lookup(self) -> np.ndarray:
        """length << 8 | symbol by the next 16 bits; 0 where no code fits."""
        out = np.zeros(1 << 16, np.int32)
        at, k = 0, 0
        for n, many in enumerate(self.bits, 1):
            for _ in range(many):
                out[at : at + (1 << 16 - n)] = n << 8 | self.symbols[k]
                at += 1 << 16 - n
                k += 1
        return out


@functools.lru_cache(256)
def _read_table(body: bytes) -> Huffman:
    return Huffman(tuple(body[:16]), tuple(body[16:]))


def _table(by_length: dict[int, list[int]]) -> Huffman:
    return Huffman(tuple(len(by_length.get(n, [])) for n in range(1, 17)), tuple(s for n in sorted(by_length) for s in by_length[n]))


#: The encoder's own codes: sizes of DC differences; first AC passes, where runs of 0 and sizes to 7 are short; refinements.
DC_CODES = _table({4: list(range(12))})
AC_CODES = _table({3: list(range(1, 8)), 11: [r << 4 | s for r in range(16) for s in range(11) if not (r == 0 and 1 <= s <= 7)]})
REFINE_CODES = _table({1: [0], 6: [*(r << 4 | 1 for r in range(16)), 0xF0, *(r << 4 for r in range(1, 15))]})
#: (components, first, last, high, low) of each scan; 0 is luma.
SCANS = [((0, 1, 2), 0, 0, 0, 1), *(((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 63, 1, 0) for c in range(3))]


# ---------------------------------------------------------------- encoding


def _pack(values: np.ndarray, lengths: np.ndarray, segment: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, byte offsets of the segments): codes put together bit by bit, each segment filled with ones to a whole byte."""
    total = np.bincount(segment, weights=lengths, minlength=n_segments).astype(np.int64)
    n_bytes = (total + 7) >> 3
    offsets = np.concatenate([[0], np.cumsum(n_bytes)])
    before = np.cumsum(lengths) - lengths
    first = np.concatenate([[0], np.cumsum(total)])
    at = offsets[segment] * 8 + before - first[segment]
    word, shift = at >> 5, (64 - (at & 31) - lengths).astype(np.uint64)
    wide = values.astype(np.uint64) << shift
    n_words = int((offsets[-1] + 3) >> 2) + 2
    acc = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=n_words) + np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_words)
    out = acc.astype(np.uint32).astype(">u4").view(np.uint8)[: offsets[-1]].copy()
    pad = (n_bytes * 8 - total).astype(np.int64)
    some = n_bytes > 0
    out[offsets[1:][some] - 1] |= ((1 << pad[some]) - 1).astype(np.uint8)
    return out, offsets


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitudes."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _marks(value: np.ndarray, new: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, is 16 zeros, is event) by place: events are new values, and each 16th zero in a row before a later new value."""
    n, width = new.shape
    count = np.cumsum(zero, 1, dtype=np.int16)
    at_new = np.where(new, count, 0)
    since = np.maximum.accumulate(at_new, 1)
    since = np.concatenate([np.zeros((n, 1), np.int16), since[:, :-1]], 1)
    run = count - since
    last_new = np.where(new.any(1), width - 1 - new[:, ::-1].argmax(1), -1)
    sixteen = zero & (run > 0) & (run % 16 == 0) & (np.arange(width)[None, :] < last_new[:, None])
    return np.where(new, run % 16, 15), sixteen, new | sixteen


def _encode_ac_first(c: np.ndarray, low: int, segment: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = AC_CODES.codes()
    v = np.sign(c) * (np.abs(c) >> low)
    n, width = v.shape
    new = v != 0
    if new.all():
        block, place = np.repeat(np.arange(n), width), None
        value, run = v.reshape(-1).astype(np.int64), 0
        last = np.zeros(n, bool)
    else:
        run, sixteen, event = _marks(v, new, ~new)
        block, place = np.nonzero(event)
        value, run = v[event].astype(np.int64), run[event].astype(np.int64)
        last = ~new[:, -1]
    s = _size(value)
    symbol = (run << 4 | s) if not isinstance(run, int) else s
    extra = np.where(value < 0, value + (1 << s) - 1, value)
    words, bits = codes[symbol] << s | extra, lengths[symbol] + s
    if last.any():
        # the end-of-block code follows the block's events
        ends = np.searchsorted(block, np.flatnonzero(last), "right")
        words, bits, block = np.insert(words, ends, codes[0]), np.insert(bits, ends, lengths[0]), np.insert(block, ends, np.flatnonzero(last))
    return _pack(words, bits, segment[block], n_segments)


def _encode_refine(c: np.ndarray, low: int, segment: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = REFINE_CODES.codes()
    m = np.abs(c) >> low
    old, new = m > 1, m == 1
    n, width = m.shape
    run, sixteen, event = _marks(m, new, m == 0)
    bits_of = np.where(new, lengths[(run << 4) | 1] + 1, np.where(sixteen, lengths[0xF0], 0)) if event.any() else np.zeros((1, 1), np.int64)
    has_end = ~event[:, -1]
    end_bits = np.where(has_end, lengths[0], 0)
    n_old = old.sum(1)
    block_bits = n_old + end_bits + (bits_of.sum(1) if event.any() else 0)
    total = np.bincount(segment, weights=block_bits, minlength=n_segments).astype(np.int64)
    n_bytes = (total + 7) >> 3
    offsets = np.concatenate([[0], np.cumsum(n_bytes)])
    before = np.cumsum(block_bits) - block_bits
    first = np.concatenate([[0], np.cumsum(total)])
    start = offsets[segment] * 8 + before - first[segment]
    out = np.ones(offsets[-1] * 8, np.uint8)
    rank = np.cumsum(old, 1, dtype=np.int64) - old
    eventful = event.any(1)
    plain = np.flatnonzero(~eventful)
    if len(plain):
        # only corrections behind one end-of-block code
        out[start[plain]] = codes[0]
        at = (start[plain] + lengths[0])[:, None] + rank[plain]
        out[at[old[plain]]] = (m[plain][old[plain]] & 1).astype(np.uint8)
    rows = np.flatnonzero(eventful)
    if len(rows):
        e, nb, o = event[rows], bits_of[rows], old[rows]
        earlier = np.cumsum(nb, 1) - nb
        # bits of the event that ends the group of each place; the end code's behind the last event
        following = np.where(e, np.arange(width)[None, :], width)
        following = np.minimum.accumulate(following[:, ::-1], 1)[:, ::-1]
        padded = np.concatenate([nb, end_bits[rows][:, None]], 1)
        ending = np.take_along_axis(padded, following, 1)
        at = start[rows][:, None] + earlier + ending + rank[rows]
        out[at[o]] = (m[rows][o] & 1).astype(np.uint8)
        # an event's code stands before the corrections of its group
        group_old = np.where(e, rank[rows], 0)
        before_group = np.concatenate([np.zeros((len(rows), 1), np.int64), np.maximum.accumulate(group_old, 1)[:, :-1]], 1)
        r, p = np.nonzero(e)
        where = start[rows][r] + earlier[r, p] + before_group[r, p]
        is_new = new[rows][r, p]
        symbol = np.where(is_new, run[rows][r, p] << 4 | 1, 0xF0)
        word = codes[symbol] << is_new | (is_new & (c[rows][r, p] > 0))
        many = lengths[symbol] + is_new
        for k in range(int(many.max())):
            ok = k < many
            out[where[ok] + k] = word[ok] >> (many[ok] - 1 - k) & 1
        ended = has_end[rows]
        tail = (start[rows] + nb.sum(1) + group_old.max(1))[ended]
        out[tail] = codes[0]
    return np.packbits(out), offsets


def _encode_dc_first(dc: np.ndarray, low: int, segment: np.ndarray, n_segments: int, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = DC_CODES.codes()
    v = dc.astype(np.int64) >> low
    diff = v.copy()
    for c in range(3):
        own = np.flatnonzero(kind == c)
        same = segment[own][1:] == segment[own][:-1]
        diff[own[1:][same]] -= v[own[:-1][same]]
    s = _size(diff)
    extra = np.where(diff < 0, diff + (1 << s) - 1, diff)
    return _pack(codes[s] << s | extra, lengths[s] + s, segment, n_segments)


def _framed(data: np.ndarray, offsets: np.ndarray, scan_of: np.ndarray, n_scans: int) -> list[bytes]:
    """Entropy-coded data of each scan: bytes stuffed, restart markers between its segments."""
    full = np.flatnonzero(data == 0xFF) + 1
    inner = np.flatnonzero(scan_of[1:] == scan_of[:-1])
    first = np.searchsorted(scan_of, np.arange(n_scans))
    nth = inner - first[scan_of[inner]]
    cut = offsets[inner + 1]
    at = np.concatenate([full, np.repeat(cut, 2)])
    put = np.concatenate([np.zeros(len(full), np.uint8), np.stack([np.full(len(inner), 0xFF), 0xD0 + nth % 8], 1).reshape(-1).astype(np.uint8)])
    # at one place a stuffed zero comes before a marker
    order = np.argsort(at, kind="stable")
    at, put = at[order], put[order]
    out = np.insert(data, at, put).tobytes()
    ends = offsets[np.concatenate([first[1:], [len(scan_of)]])]
    ends = ends + np.searchsorted(at, ends, "left")
    # zeros stuffed right at a scan's end belong to it
    ends = ends + (np.isin(offsets[np.concatenate([first[1:], [len(scan_of)]])], full)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    return [out[a:b] for a, b in zip(begins, ends, strict=True)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables(kind: int, slot: int, t: Huffman) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, *t.bits, *t.symbols]))


def grid(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of MCUs (six blocks each) that hold so many blocks."""
    many = max(1, -(-n_blocks // 6))
    columns = int(np.ceil(np.sqrt(many)))
    return columns, -(-many // columns)


@functools.lru_cache(4096)
def coding_plan(columns: int, rows: int, first: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray | None]:
    """(blocks in coding order, their restart interval, number of intervals, component of each) of a scan.

    first: -1 for all components interleaved, else the component.
    """
    m = columns * rows
    if first < 0:
        order, per, kinds = mcu_order(columns, rows), 6 * INTERVAL, np.tile([0, 0, 0, 0, 1, 2], m)
    else:
        order, per, kinds = (np.arange(4 * m) if first == 0 else np.arange(m) + (3 + first) * m), INTERVAL, None
    return order, np.arange(len(order)) // per, -(-len(order) // per), kinds


def mcu_order(columns: int, rows: int) -> np.ndarray:
    """Blocks of an image (luma in raster order, then both chroma planes) in the order of interleaved MCUs."""
    m = columns * rows
    y, x = np.divmod(np.arange(m), columns)
    luma = [(2 * y + v) * 2 * columns + 2 * x + h for v in (0, 1) for h in (0, 1)]
    return np.stack([*luma, 4 * m + np.arange(m), 5 * m + np.arange(m)], 1).reshape(-1)


def encode_images(coefficients: np.ndarray, grids: list[tuple[int, int]], lengths: list[int]) -> list[bytes]:
    """Progressive JPEGs of blocks of quantised coefficients (all images' blocks in a row, zigzag order, int16).

    lengths are kept in a comment: how many bytes of payload the coefficients hold.
    """
    many = [6 * a * b for a, b in grids]
    starts = np.concatenate([[0], np.cumsum(many)])
    scans: list[list[bytes]] = [[] for _ in grids]
    for comps, ss, se, high, low in SCANS:
        rows, kinds, segments, owner, n = [], [], [], [], 0
        for i, (a, b) in enumerate(grids):
            order, interval, k, kind = coding_plan(a, b, -1 if ss == 0 else comps[0])
            rows.append(order + starts[i])
            segments.append(interval + n)
            owner.append(np.full(k, i))
            kinds.append(kind)
            n += k
        rows, segments, owner = np.concatenate(rows), np.concatenate(segments), np.concatenate(owner)
        kinds = np.concatenate(kinds) if ss == 0 else None
        data, offsets, last = [], [np.zeros(1, np.int64)], 0
        # segments are independent, so they are coded in bounded portions
        cuts = np.searchsorted(segments, np.arange(0, n + CHUNK_BLOCKS // INTERVAL, CHUNK_BLOCKS // INTERVAL))
        for k in range(len(cuts) - 1):
            i, j = cuts[k], cuts[k + 1]
            if i == j:
                continue
            s = segments[i:j] - segments[i]
            if ss == 0:
                dc = coefficients[rows[i:j], 0]
                d, o = _encode_dc_first(dc, low, s, int(s[-1]) + 1, kinds[i:j]) if not high else _pack((dc.astype(np.int64) >> low) & 1, np.ones(j - i, np.int64), s, int(s[-1]) + 1)
            else:
                c = coefficients[rows[i:j], ss : se + 1]
                d, o = (_encode_ac_first if not high else _encode_refine)(c, low, s, int(s[-1]) + 1)
            data.append(d)
            offsets.append(o[1:] + last)
            last += int(o[-1])
        for i, part in enumerate(_framed(np.concatenate(data), np.concatenate(offsets), owner, len(grids))):
            scans[i].append(part)
    quant = _segment(0xDB, b"\0" + b"\1" * 64)
    codes = _tables(0, 0, DC_CODES) + _tables(1, 0, AC_CODES) + _tables(1, 1, REFINE_CODES)
    heads = [_segment(0xDA, bytes([len(cs), *(x for c in cs for x in (c + 1, 1 if hi and a else 0)), a, b, hi << 4 | lo])) for cs, a, b, hi, lo in SCANS]
    out = []
    for (a, b), length, parts in zip(grids, lengths, scans, strict=True):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * b, 16 * a, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        top = b"\xff\xd8" + _segment(0xFE, b"payload=%d" % length) + quant + frame + codes + _segment(0xDD, struct.pack(">H", INTERVAL))
        out.append(b"".join([top, *(x for pair in zip(heads, parts, strict=True) for x in pair), b"\xff\xd9"]))
    return out


# ---------------------------------------------------------------- decoding


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in a row that scans of this component alone have
    high: int = 0
    stride: int = 0  # blocks in a row as stored: whole MCUs
    rows: int = 0
    base: int = 0  # its first block among all images' blocks


@dataclass
class Scan:
    comps: list[Component]
    dc: list[Huffman]
    ac: list[Huffman]
    ss: int
    se: int
    ah: int
    al: int
    interval: int
    data: memoryview
    level: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    mcus: tuple[int, int] = (0, 0)
    blocks: int = 0


def parse(data: bytes) -> Image:
    """Headers and scans of a progressive JPEG; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at, tables, interval = Image(), 2, {}, 0
    reach: dict[int, list[int]] = {}
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC2:
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not image.height or not image.width or n not in (1, 3):
                raise ValueError("this frame is not supported")
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
            image.mcus = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
            for c in image.components:
                c.wide, c.high = -(-(-(-image.width * c.h // hm)) // 8), -(-(-(-image.height * c.v // vm)) // 8)
                c.stride, c.rows, c.base = image.mcus[0] * c.h, image.mcus[1] * c.v, image.blocks
                image.blocks += c.stride * c.rows
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive JPEG")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                end = k + 17 + sum(body[k + 1 : k + 17])
                tables[body[k] >> 4, body[k] & 15] = _read_table(body[k + 1 : end])
                k = end
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quants[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + bool(wide))
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            n = body[0]
            by_id = {c.ident: c for c in image.components}
            comps = [by_id[body[1 + 2 * i]] for i in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            m = END_OF_SCAN.search(data, at)
            if m is None:
                raise ValueError("a scan has no end")
            get = lambda kind, i: tables.get((kind, body[2 + 2 * i] >> 4 if not kind else body[2 + 2 * i] & 15))
            scan = Scan(comps, [get(0, i) for i in range(n)], [get(1, i) for i in range(n)], ss, se, a >> 4, a & 15, interval, memoryview(data)[at : m.start()])
            # scans that share coefficients keep their order, others can be taken together
            touched = [reach.setdefault(c.ident, [0] * 64) for c in comps]
            scan.level = 1 + max(max(t[ss : se + 1]) for t in touched)
            for t in touched:
                t[ss : se + 1] = [scan.level] * (se + 1 - ss)
            image.scans.append(scan)
            at = m.start()
    if not image.components:
        raise ValueError("a frame is missing")
    return image


class _Stream:
    """Unstuffed bits of the restart intervals of many scans, and the blocks that each interval codes."""

    def __init__(self, scans: list[tuple[Scan, np.ndarray, np.ndarray]]):
        """scans: (scan, its blocks in coding order, which of its components each is)."""
        raw = np.frombuffer(b"".join([*(s.data for s, _, _ in scans), b"\xff\0" * 8]), np.uint8)
        sizes = np.array([len(s.data) for s, _, _ in scans])
        ends = np.cumsum(sizes)
        full = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[full + 1]
        marks = full[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(raw), bool)
        keep[full[after == 0] + 1] = False
        keep[marks] = False
        keep[marks + 1] = False
        place = np.concatenate([[0], np.cumsum(keep)])
        self.bytes = raw[keep]
        begins = np.sort(np.concatenate([ends - sizes, marks + 2]))
        self.start = place[begins] * 8
        per_scan = np.searchsorted(begins, ends) - np.searchsorted(begins, ends - sizes)
        length, first, last = [], [], 0
        for (s, blocks, _), many in zip(scans, per_scan, strict=True):
            in_mcu = sum(c.h * c.v for c in s.comps) if len(s.comps) > 1 else 1
            step = s.interval * in_mcu or len(blocks)
            wanted = -(-len(blocks) // step) if len(blocks) else 1
            if many != wanted:
                raise ValueError("restart markers don't fit the frame")
            edge = np.minimum(np.arange(wanted + 1) * step, len(blocks))
            first.append(edge[:-1] + last)
            length.append(np.diff(edge))
            last += len(blocks)
        self.first, self.length = np.concatenate(first), np.concatenate(length)
        self.rows = np.concatenate([b for _, b, _ in scans])
        self.kind = np.concatenate([k for _, _, k in scans])
        # tables that differ between scans are told apart by number
        names: dict[int, tuple[int, Huffman | None]] = {}
        number = lambda t: names.setdefault(id(t), (len(names), t))[0]
        table = []
        for (s, blocks, kinds), many in zip(scans, per_scan, strict=True):
            own = np.array([number(t) for t in (s.dc if s.ss == 0 else s.ac)])
            table.append(own[kinds] if len(own) > 1 else np.full(len(blocks), own[0]))
        self.table = np.concatenate(table)
        self.lookup = np.concatenate([t.lookup() if t is not None else np.zeros(1 << 16, np.int32) for _, t in names.values()])
        self.one_table = len(names) == 1

    def window(self) -> np.ndarray:
        """The 8 bytes from each byte on, as an unaligned view."""
        padded = np.concatenate([self.bytes, np.zeros(16, np.uint8)])
        return np.ndarray((len(self.bytes) + 8,), ">u8", padded.tobytes(), strides=(1,))


def _symbols(stream: _Stream, w: np.ndarray, pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, code length, the bits from pos on at the top of 64-bit words; at least 57 of them count)."""
    ahead = w[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
    peek = (ahead >> np.uint64(48)).astype(np.int64)
    got = stream.lookup[peek if stream.one_table else peek + (table << 16)].astype(np.int64)
    if not got.all():
        raise ValueError("a code is not in its table")
    return got & 255, got >> 8, ahead


def _extended(ahead: np.ndarray, skip: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The signed value of the s bits behind the first skip bits."""
    v = ((ahead << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - s).astype(np.uint64)).astype(np.int64)
    return np.where(v < (1 << s >> 1), v - (1 << s) + 1, v)


def _dc_first(stream: _Stream, c: np.ndarray, al: int) -> None:
    w = stream.window()
    live = np.arange(len(stream.start))
    pos = stream.start.copy()
    before = np.zeros((len(pos), 4), np.int64)
    for t in range(int(stream.length.max(initial=0))):
        live = live[stream.length[live] > t]
        at = stream.first[live] + t
        kind = stream.kind[at]
        s, n, ahead = _symbols(stream, w, pos[live], stream.table[at])
        before[live, kind] += _extended(ahead, n, s)
        c[stream.rows[at], 0] = before[live, kind] << al
        pos[live] += n + s


def _dc_refine(stream: _Stream, c: np.ndarray, al: int) -> None:
    bits = np.unpackbits(stream.bytes)
    segment = np.repeat(np.arange(len(stream.start)), stream.length)
    at = stream.start[segment] + np.arange(len(segment)) - stream.first[segment]
    c[stream.rows, 0] |= bits[at].astype(c.dtype) << al


def _ac_first(stream: _Stream, c: np.ndarray, ss: int, se: int, al: int) -> None:
    w = stream.window()
    flat = c.reshape(-1)
    at, last = stream.first.copy(), stream.first + stream.length
    pos = stream.start.copy()
    live = np.flatnonzero(at < last)
    at, last, pos = at[live], last[live], pos[live]
    k = np.full(len(at), ss)
    base, table = stream.rows[at] * 64, stream.table[at]
    while len(at):
        sym, n, ahead = _symbols(stream, w, pos, table)
        s, r = sym & 15, sym >> 4
        k += r
        v = _extended(ahead, n, s)
        pos += n + s
        if s.all():
            if k.max() > se:
                raise ValueError("a run leaves its band")
            flat[base + k] = v << al
            k += 1
            done = k > se
            skip = None
        else:
            some = s > 0
            if (k[some] > se).any():
                raise ValueError("a run leaves its band")
            flat[(base + k)[some]] = v[some] << al
            k += 1
            # a run of blocks without more values: 2 ** r and r more bits, this block counted
            end = (s == 0) & (r < 15)
            extra = ((ahead << n.astype(np.uint64)) >> np.uint64(1) >> (63 - r).astype(np.uint64)).astype(np.int64)
            skip = np.where(end, (1 << r) + extra, 1)
            pos += np.where(end, r, 0)
            done = end | (k > se)
        if done.any():
            at = at + (done if skip is None else np.where(done, skip, 0))
            k[done] = ss
            if (over := at >= last).any():
                on = ~over
                at, last, pos, k, base, table = at[on], last[on], pos[on], k[on], base[on], table[on]
                done = done[on]
            moved = np.flatnonzero(done)
            base[moved] = stream.rows[at[moved]] * 64
            if not stream.one_table:
                table[moved] = stream.table[at[moved]]


def _ac_refine(stream: _Stream, c: np.ndarray, ss: int, se: int, al: int) -> None:
    w, bits = stream.window(), np.unpackbits(np.concatenate([stream.bytes, np.zeros(16, np.uint8)]))
    pos, skip = stream.start.copy(), np.zeros(len(stream.start), np.int64)
    width = se - ss + 1
    places = np.arange(width)[None, :]
    unit = np.int64(1 << al)

    def corrected(x: np.ndarray, old: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Number of corrections of each row; adds their bits to the marked values."""
        rank = np.cumsum(old, 1, dtype=np.int32)
        got = bits[(start[:, None] - 1 + rank)] & old
        np.add(x, np.where(x > 0, unit, -unit).astype(x.dtype), out=x, where=got.astype(bool))
        return rank[:, -1].astype(np.int64)

    for t in range(int(stream.length.max(initial=0))):
        seg = np.flatnonzero(stream.length > t)
        at = stream.first[seg] + t
        rows = stream.rows[at]
        x = c[rows, ss : se + 1]
        old = x != 0
        k = np.zeros(len(seg), np.int64)
        todo = np.flatnonzero(skip[seg] == 0)
        while len(todo):
            g = seg[todo]
            sym, n, ahead = _symbols(stream, w, pos[g], stream.table[at[todo]])
            s, r = sym & 15, sym >> 4
            pos[g] += n
            end = (s == 0) & (r < 15)
            if end.any():
                e = g[end]
                extra = ((ahead[end] << n[end].astype(np.uint64)) >> np.uint64(1) >> (63 - r[end]).astype(np.uint64)).astype(np.int64)
                skip[e] = (1 << r[end]) + extra
                pos[e] += r[end]
            go = ~end
            if not go.any():
                break
            todo, g, s, r = todo[go], g[go], s[go], r[go]
            sign = bits[pos[g]].astype(np.int64)
            pos[g] += s
            sub, o = x[todo], old[todo]
            ahead_ = places >= k[todo][:, None]
            zeros = np.cumsum(~o & ahead_, 1)
            target = (zeros == r[:, None] + 1) & ~o & ahead_
            if not target.any(1).all():
                raise ValueError("a run leaves its band")
            stop = target.argmax(1)
            pos[g] += corrected(sub, o & ahead_ & (places < stop[:, None]), pos[g])
            hit = np.flatnonzero(s)
            sub[hit, stop[hit]] = np.where(sign[hit] == 1, unit, -unit)
            x[todo] = sub
            k[todo] = stop + 1
            todo = todo[k[todo] < width]
        tail = np.flatnonzero((skip[seg] > 0) & (k < width)) if width else np.zeros(0, np.int64)
        if len(tail) == len(seg):
            pos[seg] += corrected(x, old & (places >= k[:, None]) if k.any() else old, pos[seg])
        elif len(tail):
            sub = x[tail]
            pos[seg[tail]] += corrected(sub, old[tail] & (places >= k[tail][:, None]), pos[seg[tail]])
            x[tail] = sub
        skip[seg] = np.maximum(skip[seg] - 1, 0)
        c[rows, ss : se + 1] = x


def _coding_order(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of a scan in the order in which they are coded, and which of its components each belongs to."""
    if len(scan.comps) == 1:
        comp = scan.comps[0]
        y, x = np.divmod(np.arange(comp.wide * comp.high), comp.wide)
        return comp.base + y * comp.stride + x, np.zeros(len(y), np.int64)
    columns, rows = image.mcus
    y, x = np.divmod(np.arange(columns * rows), columns)
    parts = [(comp.base + (y * comp.v + v) * comp.stride + x * comp.h + h, i) for i, comp in enumerate(scan.comps) for v in range(comp.v) for h in range(comp.h)]
    return np.stack([p for p, _ in parts], 1).reshape(-1), np.tile([i for _, i in parts], len(y))


def decode_coefficients(files: list[bytes]) -> tuple[np.ndarray, list[Image], list[int]]:
    """(all images' quantised coefficients by block, parsed images, first block of each)."""
    images = [parse(f) for f in files]
    starts = [0, *np.cumsum([i.blocks for i in images]).tolist()]
    c = np.zeros((starts[-1], 64), np.int16)
    groups: dict[tuple, list] = {}
    orders: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for image, start in zip(images, starts[:-1], strict=True):
        for scan in image.scans:
            shape = (image.mcus, image.width, image.height, tuple((p.base, p.h, p.v) for p in scan.comps))
            if shape not in orders:
                orders[shape] = _coding_order(image, scan)
            blocks, kinds = orders[shape]
            groups.setdefault((scan.level, scan.ss, scan.se, scan.ah, scan.al), []).append((scan, blocks + start, kinds))
    for (_, ss, se, ah, al), scans in sorted(groups.items(), key=lambda g: g[0]):
        stream = _Stream(scans)
        if ss == 0:
            (_dc_refine if ah else _dc_first)(stream, c, al)
        else:
            (_ac_refine if ah else _ac_first)(stream, c, ss, se, al)
    return c, images, starts


def tensors(c: np.ndarray, images: list[Image], starts: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, (height, width, 3) uint8 RGB) of each image; images of one sampling are transformed together."""
    alike: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        alike.setdefault(tuple((p.h, p.v) for p in image.components), []).append(k)
    for sampling, members in alike.items():
        hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
        many = [images[k].mcus[0] * images[k].mcus[1] for k in members]
        planes = []
        for p, (h, v) in enumerate(sampling):
            rows = np.concatenate([_mcu_blocks(*images[k].mcus, h, v) + (starts[k] + images[k].components[p].base) for k in members])
            values = c[rows].astype(np.float64)
            if any((images[k].quants[images[k].components[p].quant] != 1).any() for k in members):
                values *= np.repeat([images[k].quants[images[k].components[p].quant] for k in members], [n * h * v for n in many], 0)
            values = values @ TRANSFORM
            values *= 1 / (1 << FIXED)
            np.rint(values, out=values)
            samples = np.clip(values, -128, 127, out=values).astype(np.int16)
            plane = samples.reshape(-1, v, h, 8, 8).swapaxes(2, 3).reshape(-1, v * 8, h * 8)
            planes.append(plane if (h, v) == (hm, vm) else plane.repeat(vm // v, 1).repeat(hm // h, 2))
        rgb = np.empty((*planes[0].shape, 3), np.uint8)
        y = planes[0] + np.int16(128)
        if len(planes) == 1:
            rgb[:] = y[..., None]
        else:
            # the inverse colour transform in 1 / 8192; products stay below 2 ** 31
            wide, cb, cr = y.astype(np.int32) * 8192 + 4096, planes[1].astype(np.int32), planes[2].astype(np.int32)
            for k, value in enumerate((wide + 11485 * cr, wide - 2819 * cb - 5850 * cr, wide + 14516 * cb)):
                rgb[..., k] = np.clip(value >> 13, 0, 255)
        at = 0
        for k, n in zip(members, many, strict=True):
            (columns, rows), image = images[k].mcus, images[k]
            t = rgb[at : at + n].reshape(rows, columns, vm * 8, hm * 8, 3).swapaxes(1, 2).reshape(rows * vm * 8, columns * hm * 8, 3)
            yield k, np.ascontiguousarray(t[: image.height, : image.width])
            at += n


@functools.lru_cache(4096)
def _mcu_blocks(columns: int, rows: int, h: int, v: int) -> np.ndarray:
    """A component's blocks (raster order in whole MCUs) MCU by MCU."""
    return np.arange(columns * rows * h * v).reshape(rows, v, columns, h).swapaxes(1, 2).reshape(-1)


def payloads(c: np.ndarray, images: list[Image], starts: list[int]) -> list[bytes]:
    """The bytes that the images' coefficients hold, by the lengths in their comments."""
    stored = (c + 128).astype(np.uint8)
    return [stored[s:e].tobytes()[: int(i.comment.removeprefix(b"payload="))] for i, s, e in zip(images, starts, starts[1:], strict=False)]


# ---------------------------------------------------------------- columns


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each row's text (null: empty) in UTF-8, filled with zeros to a positive multiple of 64, as a JPEG.

    One row per input row; a null id stays null; other columns are ignored, whatever their names.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in spans(offsets, 128 * CHUNK_BLOCKS):
                n = np.diff(offsets[a : b + 1])
                padded = np.maximum(64, -(-n // 64) * 64)
                grids = [grid(int(p) // 64) for p in padded]
                room = np.array([6 * x * y for x, y in grids])
                c = np.zeros((int(room.sum()), 64), np.int16)
                flat = c.reshape(-1)
                at = 0
                for k in range(b - a):
                    text = data[offsets[a + k] : offsets[a + k + 1]]
                    flat[at : at + len(text)] = text
                    flat[at : at + padded[k]] -= 128
                    at += int(room[k]) * 64
                files = encode_images(c, grids, padded.tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Spans of files of bounded bytes."""
    _, offsets = text_buffer(column)
    for a, b in spans(offsets, 144 * CHUNK_BLOCKS):
        yield a, [x.as_py() or b"" for x in column.slice(a, b - a)]


def tensor_column(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media's columns with height, width, tensor (RGB bytes, row by row) and error added; columns of these names are replaced.

    Null and empty media, and files that aren't whole progressive JPEGs, give null sizes and tensor and an error.
    """
    media = media.drop("height", "width", "tensor", "error")
    at = media.columns.index(media_col)

    def one(data: bytes) -> tuple:
        try:
            c, images, starts = decode_coefficients([data])
            ((_, t),) = tensors(c, images, starts)
            return (*t.shape[:2], t.tobytes(), None)
        except (ValueError, IndexError, KeyError, struct.error) as e:
            return None, None, None, str(e) or type(e).__name__

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, files in _batches(batch.column(at)):
                try:
                    c, images, starts = decode_coefficients(files)
                    rows = [(*t.shape[:2], t.tobytes(), None) for _, t in sorted(tensors(c, images, starts), key=lambda x: x[0])]
                except (ValueError, IndexError, KeyError, struct.error):
                    rows = [one(f) for f in files]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(files)).columns, *(pa.array([r[k] for r in rows], kinds[k]) for k in range(4))], names=[*batch.schema.names, "height", "width", "tensor", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(run, f"{schema}, height int, width int, tensor binary, error string")


def features(t: np.ndarray) -> str:
    """Size, sums by channel, samples with bit 4, samples unlike those above, and a checksum of a tensor: whole numbers only."""
    flat = t.reshape(-1, 3)
    means = np.add.reduce(flat, 0, dtype=np.int64)
    values, edges = np.add.reduce(flat.reshape(-1) >> 4 & 1, dtype=np.int64), np.count_nonzero(t[1:] != t[:-1])
    return f"{t.shape[0]}x{t.shape[1]};" + ",".join(str(int(x)) for x in (*means, values, edges)) + f";{zlib.crc32(flat.tobytes()):08x}"


def media_digest(media: DataFrame) -> DataFrame:
    """Digests of stored media (doc_id, n_bytes, media): what the payload read back is, and features of the decoded tensor.

    payload_bytes, payload_sha256 and tail_crc32 (of the last 64 bytes) come from the decoded coefficients, media_bytes and
    media_sha256 from the stored file, feature from the RGB tensor. An empty table gives an empty one.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, files in _batches(batch.column(2)):
                c, images, starts = decode_coefficients(files)
                held = payloads(c, images, starts)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                columns = [
                    pa.array([len(p) for p in held], pa.int64()),
                    pa.array([sha(p) for p in held]),
                    pa.array([zlib.crc32(p[-64:]) for p in held], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([sha(f) for f in files]),
                    pa.array([features(t) for _, t in sorted(tensors(c, images, starts), key=lambda x: x[0])]),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(files)).columns[:2], *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
