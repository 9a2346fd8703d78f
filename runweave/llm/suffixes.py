"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if it is covered by a string of LENGTH bytes that also starts earlier. What can repeat at all is found first:
every window of LENGTH bytes has a least hash among its substrings of K bytes, its seed, and equal windows have equal
seeds. Runs of windows with one seed are the pieces of the texts. Pieces that are equal as a whole are put together by
their hashes before anything is shuffled, the later ones go; a piece of which no other has the seed repeats nothing.

The pieces that share a seed and differ (both ends of a repeated passage, and near copies around each edit) go on to the
transforms. Each task sorts the suffixes of its own pieces and sends them as Burrows-Wheeler transforms, a shard for each
bucket of seeds. A bucket's shards are merged as they are: their rows start in the order of the shards, and each round
refines the interleave, so that rows which agreed in their first d symbols come to be in the order of their first 2d, by
walking over the present order and dealing each row's predecessor to its block. No suffix is compared or sorted again.
After the rounds for d = LENGTH, blocks are the intervals of common prefixes of LENGTH or more: the repeated strings.

A seed that more than HOT different pieces share (a line that very many texts have, within different ones) is not left to
one task: the windows of its pieces are dealt by their own hashes of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, no_clash

#: Bytes of a repeated string; most windows of a piece; different pieces of one seed from which its windows are dealt.
LENGTH, RUN, HOT = 100, 128, 4096
#: Bytes of text worked on at once, and between two rounds of what a task sends; bytes of pieces sorted, and merged, at once.
BLOCK, SENT, SORTED, MERGED = 1 << 20, 16 << 20, 2 << 20, 2 << 20
#: Bytes of text, and of pieces to be merged, a task of an exchange gets about; least number of buckets of either.
TASK_BYTES, MERGE_BYTES, BUCKETS = 32 << 20, 4 << 20, 1024
#: A null id comes first, as the least number.
NO_ID = -(1 << 63)
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xCA5A826395121157)
#: What a piece, a mark and a place are made of.
PIECE = [("m", "<u4"), ("s", "<u8"), ("id", "<i8"), ("th", "<i8"), ("at", "<u4"), ("n", "<u2"), ("many", "u1")]
WINDOW = [("g", "<u8"), ("h", "<u8"), ("id", "<i8"), ("th", "<i8"), ("at", "<u4")]
STRING = [("id", "<i8"), ("th", "<i8"), ("at", "<u4"), ("n", "<u4")]
#: Kinds of what goes to a bucket: pieces, bytes that go for sure, a transform, windows of hot seeds.
PIECES, SURE, TRANSFORM, DEALT = 0, 1, 2, 3
#: Kinds of marks: bytes that go, pieces for the transforms, pieces whose windows are dealt.
GOES, MERGE, DEAL = 0, 1, 2
MARKS = "id long, th long, at long, n long, kind int, bucket long"
SHARDS = "bucket long, kind int, data binary"


@cache
def _powers(odd: int) -> tuple[np.ndarray, np.ndarray]:
    """odd^i and odd^-i modulo 2^64 for all positions of a block."""
    n = BLOCK + LENGTH * 64
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (odd, pow(odd, -1, 1 << 64)))


@cache
def _byte_values(seed: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([seed, i]), digest_size=8).digest() for i in range(256)), np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD[1])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(32))


def _spans(values: np.ndarray, odd: int, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """Polynomial hashes of values[start:end], whatever their place."""
    up, down = _powers(odd)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return (sums[ends] - sums[starts]) * down[: len(sums)][starts]


def window_hashes(data: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k bytes of data."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    return _mixed(_spans(_byte_values(seed)[data], _ODD[0], slice(0, len(data) - k + 1), slice(k, len(data) + 1)))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    return values if span == width else np.minimum(values[: span - width], values[width - span :])


def pieces(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, seed, hash, many) of every run of windows of one seed; bounds: where the texts in data begin
    and, last, end. many: the seed is in the piece more than once, so the piece may repeat itself."""
    k = seed_bytes(length)
    width = length - k + 1
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    hashes = window_hashes(data, k)
    least = _least(hashes, width)
    stops = np.maximum(bounds[1:] - length + 1, bounds[:-1])
    edges = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, bounds[:-1], stops]))
    edges = edges[edges < len(least)]
    text = np.searchsorted(bounds, edges, side="right") - 1
    ends = np.append(edges[1:], len(least))
    real = edges < stops[text]
    text, first, last = text[real], edges[real], ends[real]
    many = -(-(last - first) // RUN)
    text, first, last = np.repeat(text, many), np.repeat(first, many), np.repeat(last, many)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    first = first + nth * RUN
    last = np.minimum(first + RUN, last)
    seed = least[first]
    side = np.arange(width)
    left = (hashes[first[:, None] + side] == seed[:, None]).argmax(1) + first
    right = last - 1 + width - 1 - (hashes[(last + width - 2)[:, None] - side] == seed[:, None]).argmax(1)
    end = last + length - 1
    whole = _mixed(_spans(hashes, _ODD[1], first, end - k + 1) + (end - first).astype(np.uint64))
    return text, first, end, seed, whole, left != right


def seed_bytes(length: int) -> int:
    return max(1, min(24, length // 4))


def _packed(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)


def _unpacked(datas: list[bytes], kind: list) -> np.ndarray:
    dtype = np.dtype(kind)
    rows = np.zeros(sum(len(d) for d in datas) // dtype.itemsize, dtype)
    begun = 0
    for data in datas:
        n, offset = len(data) // dtype.itemsize, 0
        for name in dtype.names:
            rows[name][begun : begun + n] = np.frombuffer(data, dtype[name], n, offset)
            offset += n * dtype[name].itemsize
        begun += n
    return rows


def _settled(rows: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, later) of rows by keys and place: the first of equal keys, and those that start after it."""
    order = np.lexsort((rows["at"], rows["th"], rows["id"], *reversed(keys)))
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    later = ~new
    same = np.ones(len(order), bool)
    for name in ("id", "th", "at"):
        same &= rows[name][lead] == rows[name][order]
    return order, new, later & ~same


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the column `text` of a batch; no text is null."""
    column = batch.column("text")
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] and bounds[-1] else np.zeros(0, np.uint8)
    return data, bounds


def _blocks(bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, first byte, last byte + 1) of blocks; long texts are cut so that no window is lost."""
    i, n = 0, len(bounds) - 1
    while i < n:
        if bounds[i + 1] - bounds[i] > BLOCK:
            for begin in range(int(bounds[i]), int(bounds[i + 1]) - length + 1, BLOCK):
                yield i, i + 1, begin, min(begin + BLOCK + length - 1, int(bounds[i + 1]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, side="right")) - 1)
        yield i, j, int(bounds[i]), int(bounds[j])
        i = j


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def _by_bucket(rows: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    return [(int(bucket[a]), kind, _packed(rows[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _seeded(batches: Iterable[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The pieces of all texts, by buckets of their seeds; of equal pieces of one task's stretch all but the first
    are bytes that go."""
    held: list[np.ndarray] = []
    seeds: list[np.ndarray] = []
    size = 0

    def send() -> pa.RecordBatch:
        rows, seed = np.concatenate(held), np.concatenate(seeds)
        order, new, later = _settled(rows, seed, rows["s"])
        first, sure = order[new], _strings(rows[order[later]])
        out = _by_bucket(rows[first], ((seed[first] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), PIECES)
        return _sent(out + _by_bucket(sure, _mixed(sure["th"].astype(np.uint64)).astype(np.int64) % buckets, SURE))

    for batch in batches:
        data, bounds = _texts(batch)
        ids, hashes = batch.column("id").to_numpy(), batch.column("th").to_numpy()
        for i, j, begin, end in _blocks(bounds, length):
            inner = np.array([0, end - begin]) if j == i + 1 else bounds[i : j + 1] - begin
            text, first, last, seed, whole, many = pieces(data[begin:end], inner, length)
            rows = np.zeros(len(text), PIECE)
            rows["m"], rows["s"], rows["id"], rows["th"] = (seed & np.uint64(0xFFFFFFFF)), whole, ids[i:j][text], hashes[i:j][text]
            rows["at"], rows["n"], rows["many"] = first + begin - bounds[i:j][text], last - first, many
            held.append(rows)
            seeds.append(seed)
            size += end - begin
            if size >= SENT:
                yield send()
                held, seeds, size = [], [], 0
    if held:
        yield send()


def _strings(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), STRING)
    for name, _ in STRING:
        out[name] = rows[name]
    return out


def _marked(rows: np.ndarray, kind: np.ndarray | None = None, bucket: np.ndarray | None = None) -> pa.RecordBatch:
    zero = np.zeros(len(rows), np.int64)
    values = [rows["id"], rows["th"], rows["at"].astype(np.int64), rows["n"].astype(np.int64), (zero if kind is None else kind).astype(np.int32), zero if bucket is None else bucket]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["id", "th", "at", "n", "kind", "bucket"])


def _sifted(batches: Iterable[pa.RecordBatch], hot: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Marks of the pieces of some buckets: copies go, pieces that share their seed with others are to be merged."""
    datas, numbers = [], []
    for batch in batches:
        for bucket, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
            if kind == SURE:
                yield _marked(_unpacked([data], STRING))
            else:
                datas.append(data)
                numbers.append(bucket)
    if not datas:
        return
    width = np.dtype(PIECE).itemsize
    rows = _unpacked(datas, PIECE)
    bucket = np.repeat(np.array(numbers, np.uint64), [len(d) // width for d in datas])
    datas.clear()
    seed = (bucket << np.uint64(32)) | rows["m"]
    order, new, later = _settled(rows, seed, rows["s"])
    lead = order[new]
    lead_seed = seed[lead]
    starts = np.flatnonzero(np.concatenate([[True], lead_seed[1:] != lead_seed[:-1]]))
    counts = np.diff(np.append(starts, len(lead)))
    of_seed = np.repeat(counts, counts)
    wanted = (of_seed > 1) | (rows["many"][lead] > 0)
    kind = np.where(of_seed > hot, DEAL, MERGE)[wanted]
    to = (_mixed(lead_seed[wanted]) % np.uint64(buckets)).astype(np.int64)
    yield _marked(_strings(rows[order[later]]))
    yield _marked(_strings(rows[lead[wanted]]), kind, to)


def _dealt(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys below 2^32, by digits of 16 bits."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def _numbered(new: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, alone) of each member of blocks that begin where new is: the slot of its block's first, and whether it
    is the only one."""
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    return np.repeat(slots[starts], sizes), np.repeat(sizes == 1, sizes)


class Interleave:
    """Suffixes of strings in the order of their first symbols, in blocks of equal ones, which rounds refine.

    Places number the symbols of all strings, each with its end. order: places by slot; block: for each place the first
    slot of its block; open: whether the place shares its block.
    """

    def __init__(self, lengths: np.ndarray, order: np.ndarray, new: np.ndarray) -> None:
        base = np.cumsum(lengths + 1) - lengths - 1
        self.offset = (np.arange(len(order)) - np.repeat(base, lengths + 1)).astype(np.int32)
        self.left = (np.repeat(lengths, lengths + 1) - self.offset).astype(np.int32)
        self.order = order.astype(np.int32)
        self.block, self.open = np.empty(len(order), np.int32), np.empty(len(order), bool)
        number, alone = _numbered(new, np.arange(len(order), dtype=np.int32))
        self.block[self.order], self.open[self.order] = number, ~alone

    def refine(self, step: int) -> None:
        """From the order of the first d symbols to that of the first d + step, for step <= d.

        The present order is walked over, and each place `step` symbols before is dealt to its block; places without
        `step` more symbols come first. What follows a place is known by its block, so no symbols are compared.
        """
        order, block, left = self.order, self.block, self.left
        slots = np.flatnonzero(self.open[order]).astype(np.int32)
        if not len(slots):
            return
        walked = order[self.offset[order] >= step] - np.int32(step)
        ended = np.flatnonzero((left < step) & self.open).astype(np.int32)
        dealt = np.concatenate([ended, walked[self.open[walked]]])
        dealt = dealt[_dealt(block[dealt])]
        own = block[dealt]
        ahead = np.where(left[dealt] >= step, block[np.minimum(dealt + step, len(block) - 1)], -1)
        new = np.ones(len(dealt), bool)
        new[1:] = (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])
        order[slots] = dealt
        number, alone = _numbered(new, slots)
        block[dealt], self.open[dealt] = number, ~alone


def transforms(strings: list[np.ndarray], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bounds): the Burrows-Wheeler transform of each bucket's strings, one after another, which are in the order
    of their buckets. Symbols are bytes plus 1; 0 ends a string. Ends of earlier strings come before those of later ones.
    """
    lengths = np.array([len(s) for s in strings])
    last = np.cumsum(lengths + 1) - 1
    text = np.zeros(int(last[-1]) + 1, np.uint16)
    inside = np.ones(len(text), bool)
    inside[last] = False
    text[inside] = np.concatenate(strings).astype(np.uint16) + 1
    bucket = np.repeat(np.cumsum(np.concatenate([[0], np.diff(buckets) != 0])), lengths + 1)
    end = np.repeat(last, lengths + 1)
    # The bucket's number and the first five symbols, as far as the string goes.
    depth, here = 5, np.arange(len(text))
    key, padded = bucket.astype(np.uint64), np.concatenate([text, np.zeros(depth, np.uint16)])
    for i in range(depth):
        key = (key << np.uint64(9)) | np.where(here + i <= end, padded[i : i + len(text)], np.uint16(0))
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    sorted_key = key[order]
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rows = Interleave(lengths, order, new)
    while depth <= lengths.max():
        rows.refine(depth)
        depth *= 2
    before = np.where(rows.offset[rows.order] > 0, text[rows.order - 1], 0)
    return before.astype(np.uint16), np.concatenate([[0], np.flatnonzero(np.diff(bucket[rows.order])) + 1, [len(order)]])


def merged(shards: list[tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset), block of the merged transform of shards (rows of symbols, lengths of the strings): the suffixes
    that have `length` bytes or more, with equal blocks where the first `length` bytes are equal."""
    n = sum(len(rows) for rows, _ in shards)
    to, firsts = np.empty(n, np.int32), np.empty(n, np.uint16)
    ends, begun = [], 0
    for rows, lengths in shards:
        order = np.argsort(rows, kind="stable")
        to[begun + order] = np.arange(begun, begun + len(rows), dtype=np.int32)
        firsts[begun : begun + len(rows)] = rows[order]
        ends.append(np.arange(begun, begun + len(lengths), dtype=np.int32))
        begun += len(rows)
    lengths = np.concatenate([size for _, size in shards]).astype(np.int64)
    base = np.cumsum(lengths + 1) - lengths - 1
    # Walk from the end of every string to its beginning, the long ones first: which place a row's suffix has.
    place = np.empty(n, np.int32)
    by_length = np.argsort(-lengths, kind="stable")
    row, at = np.concatenate(ends)[by_length], (base + lengths)[by_length].astype(np.int32)
    still = np.searchsorted(lengths[by_length] * -1, -np.arange(int(lengths.max()) + 2), side="right")
    place[row] = at
    for back in range(1, int(lengths.max()) + 1):
        row, at = to[row[: still[back]]], at[: still[back]] - 1
        place[row] = at
    order = np.argsort(firsts, kind="stable")
    new = np.ones(n, bool)
    new[1:] = firsts[order][1:] != firsts[order][:-1]
    rows = Interleave(lengths, place[order], new)
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        rows.refine(step)
        depth += step
    kept = np.flatnonzero(rows.left >= length)
    string = np.repeat(np.arange(len(lengths)), lengths + 1)[kept]
    return np.stack([string, rows.offset[kept]]), rows.block[kept]


def _shard_data(symbols: np.ndarray, strings: np.ndarray) -> bytes:
    starts = np.flatnonzero(symbols == 0).astype("<u4")
    head = np.array([len(strings), len(starts)], "<u4")
    return head.tobytes() + starts.tobytes() + _packed(strings) + (symbols - (symbols > 0)).astype(np.uint8).tobytes()


def _shard_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, ends = np.frombuffer(data, "<u4", 2)
    starts = np.frombuffer(data, "<u4", ends, 8)
    at = 8 + 4 * int(ends)
    width = np.dtype(STRING).itemsize * int(n)
    symbols = np.frombuffer(data, np.uint8, offset=at + width).astype(np.uint16) + 1
    symbols[starts] = 0
    return symbols, _unpacked([data[at : at + width]], STRING)


def _sharded(batches: Iterable[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The marked pieces of texts as transforms by bucket; windows of pieces with hot seeds by their hashes."""
    for batch in batches:
        data, bounds = _texts(batch)
        marks = batch.column("marks")
        flat, of = marks.flatten(), np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy())
        rows = np.zeros(len(of), STRING)
        rows["id"], rows["th"] = batch.column("id").to_numpy()[of], batch.column("th").to_numpy()[of]
        rows["at"], rows["n"] = flat.field("at").to_numpy(), flat.field("n").to_numpy()
        begin, deal = bounds[of] + rows["at"], flat.field("kind").to_numpy() == DEAL
        bucket = flat.field("bucket").to_numpy()
        n = rows["n"].astype(np.int64)
        weight = np.cumsum(np.where(deal, (n - length + 1) * np.dtype(WINDOW).itemsize, n))
        for part in np.split(np.arange(len(of)), np.searchsorted(weight, np.arange(SORTED, int(weight[-1]) + 1, SORTED))):
            out: list[tuple[int, int, bytes]] = []
            merge = part[~deal[part]]
            merge = merge[np.argsort(bucket[merge], kind="stable")]
            if len(merge):
                strings = [data[a : a + n] for a, n in zip(begin[merge], rows["n"][merge], strict=True)]
                numbers = bucket[merge]
                symbols, ends = transforms(strings, numbers)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(merge)]])
                for i in range(len(ends) - 1):
                    shard = _shard_data(symbols[ends[i] : ends[i + 1]], rows[merge[edges[i] : edges[i + 1]]])
                    out.append((int(numbers[edges[i]]), TRANSFORM, shard))
            if len(dealt := part[deal[part]]):
                windows = np.concatenate([_windows(data[a : a + row["n"]], row, length) for a, row in zip(begin[dealt], rows[dealt], strict=True)])
                order, new, later = _settled(windows, windows["g"], windows["h"])
                first, sure = windows[order[new]], _joined(windows[order[later]], length)
                out += _by_bucket(first, (first["g"] % np.uint64(buckets)).astype(np.int64), DEALT)
                out += _by_bucket(sure, _mixed(sure["th"].astype(np.uint64)).astype(np.int64) % buckets, SURE)
            yield _sent(out)


def _windows(string: np.ndarray, row: np.void, length: int) -> np.ndarray:
    """All windows of a piece, by two hashes."""
    out = np.zeros(len(string) - length + 1, WINDOW)
    out["g"], out["h"] = window_hashes(string, length, 1), window_hashes(string, length, 2)
    out["id"], out["th"], out["at"] = row["id"], row["th"], row["at"] + np.arange(len(out))
    return out


def _joined(rows: np.ndarray, length: int) -> np.ndarray:
    """Windows (id, th, at) that follow one another as strings."""
    order = np.lexsort((rows["at"], rows["th"], rows["id"]))
    ids, hashes, at = rows["id"][order], rows["th"][order], rows["at"][order].astype(np.int64)
    new = np.ones(len(order), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (at[1:] - at[:-1] > 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(order)) - 1
    out = np.zeros(len(starts), STRING)
    if len(starts):
        out["id"], out["th"], out["at"], out["n"] = ids[starts], hashes[starts], at[starts], at[ends] - at[starts] + length
    return out


def _repeats(shards: list[tuple[np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """The strings (id, th, at, n) that go by the merged transform of the shards."""
    places, block = merged([(symbols, strings["n"]) for symbols, strings in shards], length)
    strings = np.concatenate([s for _, s in shards])[places[0]]
    rows = np.zeros(len(block), WINDOW)
    rows["id"], rows["th"], rows["at"] = strings["id"], strings["th"], strings["at"] + places[1]
    order, _, later = _settled(rows, block)
    return _joined(rows[order[later]], length)


def _unrepeated(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Marks of the bytes that go, from what came to some buckets, which are in order."""
    shards: list[tuple[np.ndarray, np.ndarray]] = []
    windows: list[bytes] = []
    size, last = 0, None

    for batch in batches:
        for bucket, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
            if size >= MERGED and bucket != last:
                yield _marked(_repeats(shards, length))
                shards, size = [], 0
            last = bucket
            if kind == TRANSFORM:
                shards.append(_shard_of(data))
                size += len(data)
            elif kind == SURE:
                yield _marked(_unpacked([data], STRING))
            else:
                windows.append(data)
    if shards:
        yield _marked(_repeats(shards, length))
    if windows:
        rows = _unpacked(windows, WINDOW)
        order, _, later = _settled(rows, rows["g"], rows["h"])
        yield _marked(_joined(rows[order[later]], length))


def _finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of every text: maximal runs of the marked bytes are taken out."""
    for batch in batches:
        data, bounds = _texts(batch)
        marks = batch.column("marks")
        flat, counts = marks.flatten(), marks.value_lengths().fill_null(0).to_numpy()
        at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
        stops = np.cumsum(counts)
        size = np.diff(bounds)
        removed, spans, digests = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), []
        for i in range(len(size)):
            text = data[bounds[i] : bounds[i + 1]]
            if counts[i]:
                a = slice(stops[i] - counts[i], stops[i])
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, at[a], 1)
                np.add.at(edge, at[a] + n[a], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed[i] = gone.sum()
                spans[i] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
                text = text[~gone]
            digests.append(hashlib.sha256(text).hexdigest())
        columns = [batch.column("given"), pa.array(size), pa.array(removed), pa.array(spans), pa.array(digests)]
        yield pa.RecordBatch.from_arrays(columns, ["given", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """given (the id), id (null: NO_ID), th (a hash of the text, for rows of one id), text as bytes (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = F.col(id_col).cast("long")
    return docs.select(given.alias("given"), F.coalesce(given, F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def repeated_strings(keyed: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """id, th, at, n of strings that cover exactly the bytes to go (they may overlap); keyed: id, th, text."""
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(8, -(-size // TASK_BYTES))
    buckets = max(BUCKETS, 8 * tasks)
    texts = keyed.select("id", "th", "text")
    dealt = texts.mapInArrow(partial(_seeded, length=length, buckets=buckets), SHARDS).repartition(tasks, "bucket")
    marks = cut(dealt.mapInArrow(partial(_sifted, hot=hot, buckets=1 << 30), MARKS))
    weight = F.when(F.col("kind") == MERGE, F.col("n")).when(F.col("kind") == DEAL, (F.col("n") - length + 1) * 36).otherwise(0)
    size = marks.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    sure = marks.where(f"kind = {GOES}").select("id", "th", "at", "n")
    tasks = max(8, -(-size // MERGE_BYTES))
    buckets = max(BUCKETS, 8 * tasks)
    mark = F.struct("at", "n", "kind", (F.col("bucket") % buckets).alias("bucket"))
    wanted = marks.where(f"kind <> {GOES}").groupBy("id", "th").agg(F.collect_list(mark).alias("marks"))
    # Repeated rows of one id and text are one text.
    shards = texts.join(wanted, ["id", "th"]).mapInArrow(partial(_sharded, length=length, buckets=buckets), SHARDS)
    shards = shards.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    found = shards.mapInArrow(partial(_unrepeated, length=length), MARKS).select("id", "th", "at", "n")
    return sure.unionByName(found)


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 of every row: its text without the repeated strings.

    A null text is empty and a null id the least; rows of one id are in the order of a hash of their texts, and rows of
    one id and text are one text, which takes nothing from itself. Empty tables give no rows; other columns do not
    matter; an id column that is named as an output is an error (ValueError).
    """
    no_clash([id_col], "n_bytes", "n_removed", "n_spans", "kept_sha256")
    keyed = _keyed(docs, id_col, text_col)
    gone = repeated_strings(keyed, length, hot).groupBy("id", "th").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    out = keyed.join(gone, ["id", "th"], "left").select("given", "text", "marks")
    schema = "given long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return out.mapInArrow(_finished, schema).withColumnRenamed("given", id_col)
