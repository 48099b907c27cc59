"""Labels as pictures: modules to PNG, PNG to gray pixels, pixels to the text of a Code 128 symbol."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenestra.functions.code128 import FNC1, PATTERNS, START_C, STOP

ROWS, CONTRAST, QUIET = 48, 48, 10
#: A drawn label: pixels a module, its height in pixels, and its resolution.
MODULE_PX, HEIGHT, DPI = 3, 40, 300
MEAN_ERROR, LARGEST_ERROR = 0.25, 0.7
_TABLE, _STOP = np.array([[int(w) for w in p] for p in PATTERNS[:106]], float), np.array([int(w) for w in PATTERNS[106]], float)
#: The value of a data symbol by its six widths as octal digits, -1 for none; widths this near to whole modules name a symbol that no other is as near to.
_BY_WIDTHS, _NEAR = np.full(8**6, -1), 0.4
_BY_WIDTHS[[int(p, 8) for p in PATTERNS[:103]]] = range(103)
_OCTAL = 8 ** np.arange(5, -1, -1)
PAIRS = [f"{i:02d}" for i in range(100)]
#: So many rows of pixels are read at once.
AT_ONCE = 500
#: So many symbols are read after a start.
LONGEST = 80
READING = T.StructType([T.StructField("text", T.StringType()), T.StructField("gs1", T.BooleanType()), T.StructField("module_px", T.DoubleType()), T.StructField("rows", T.IntegerType()), T.StructField("problem", T.StringType())])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def gray_png(pixels: np.ndarray, dpi: int | None = None) -> bytes:
    """An 8-bit gray PNG, with its resolution after the header if `dpi` is given. Rows are stored as differences to the one above, so a label's rows after the first are runs of 0, which are told without a search."""
    h, w = pixels.shape
    px, raw = pixels.astype(np.uint8), np.empty((h, w + 1), np.uint8)
    raw[0, 0], raw[1:, 0], raw[0, 1:] = 0, 2, px[0]
    np.subtract(px[1:], px[:-1], out=raw[1:, 1:])
    packer = zlib.compressobj(6, zlib.DEFLATED, 15, 8, zlib.Z_RLE)
    return _before(w, h, dpi) + _chunk(b"IDAT", packer.compress(raw.tobytes()) + packer.flush()) + _chunk(b"IEND", b"")


@lru_cache(64)
def _same_rows(width: int, more: int) -> tuple[bytes, bytes, int]:
    """Rows that don't differ from the one above: as stored, packed as the last blocks of a stream, and their checksum."""
    rows = (b"\x02" + bytes(width)) * more
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return rows, packer.compress(rows) + packer.flush(), zlib.adler32(rows)


def repeated_png(row: bytes, height: int, dpi: int) -> bytes:
    """gray_png() of a picture whose rows are all the same: only the first is packed, the blocks of the others are the same for every picture of that size."""
    first, (rows, rest, tail) = b"\0" + row, _same_rows(len(row), height - 1)
    packer = zlib.compressobj(1, zlib.DEFLATED, -9, 4, zlib.Z_RLE)
    head, sums = packer.compress(first) + packer.flush(zlib.Z_FULL_FLUSH), _both_sums(zlib.adler32(first), tail, len(rows))
    return _before(len(row), height, dpi) + _chunk(b"IDAT", b"\x78\x01" + head + rest + sums) + _chunk(b"IEND", b"")


@lru_cache(64)
def _before(width: int, height: int, dpi: int | None) -> bytes:
    """What stands in a file before its pixels."""
    size = _chunk(b"pHYs", struct.pack(">IIB", *[round(dpi / 0.0254)] * 2, 1)) if dpi else b""
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + size


def _packed(data: bytes) -> tuple[int, int, int, bytes]:
    """Width, height, channels and the packed rows of an 8-bit PNG without interlace."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    if head is None:
        raise ValueError("no header")
    w, h, depth, color, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or channels is None or interlace:
        raise ValueError("unsupported kind of PNG")
    return w, h, channels, body


def _only_row(w: int, h: int, body: bytes) -> bytes | None:
    """The row of a gray picture whose rows are all the same, None for others. Blocks that repeated_png() ends with, behind a whole block, are known without being unpacked; the checksum covers both."""
    if w < 2 or not h:
        return None
    rows, rest, tail = _same_rows(w, h - 1)
    if body[:2] == b"\x78\x01" and body.endswith(rest, 0, -4) and body.endswith(b"\x00\x00\xff\xff", 0, -4 - len(rest)):
        first = zlib.decompressobj(-15).decompress(body[2 : -4 - len(rest)])
        if len(first) == w + 1 and not first[0] and body[-4:] == _both_sums(zlib.adler32(first), tail, len(rows)):
            return first[1:]
    raw = zlib.decompress(body)
    return raw[1 : w + 1] if raw[:1] == b"\0" and len(raw) == h * (w + 1) and raw.endswith(rows) else None


def _both_sums(start: int, tail: int, n: int) -> bytes:
    """The checksum of two parts, from those of each and the length of the second."""
    low = ((start & 0xFFFF) + (tail & 0xFFFF) - 1) % 65521
    high = ((start >> 16) + (tail >> 16) + n * ((start & 0xFFFF) - 1)) % 65521
    return struct.pack(">HH", high, low)


def png_gray(data: bytes) -> np.ndarray:
    """Gray pixels of an 8-bit PNG without interlace: gray, RGB, each with or without alpha (laid on white)."""
    w, h, channels, body = _packed(data)
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    if not raw[:1, 0].any() and (raw[1:, 0] == 2).all():
        # a drawn label's rows are all the first one
        out = np.cumsum(raw[:, 1:], axis=0, dtype=np.uint8) if raw[1:, 1:].any() else np.tile(raw[:1, 1:], (h, 1))
    else:
        out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.int64)
        for y in range(h):
            out[y] = above = _unfilter(raw[y, 0], raw[y, 1:].astype(np.int64), above, channels)
    if channels == 1:
        return out
    px = out.reshape(h, w, channels).astype(np.int64)
    if channels in (2, 4):
        alpha = px[..., -1:]
        px = (px[..., :-1] * alpha + 255 * (255 - alpha)) // 255
    gray = px[..., 0] if channels == 2 else (299 * px[..., 0] + 587 * px[..., 1] + 114 * px[..., 2]) // 1000
    return gray.astype(np.uint8)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return (row + above) % 256
    out = row.copy()
    for x in range(len(row)):
        a, b, c = (out[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
        if kind == 1:
            out[x] += a
        elif kind == 3:
            out[x] += (a + b) // 2
        else:
            p = a + b - c
            out[x] += min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[x] %= 256
    return out


def raster(modules: str, module_px: int = MODULE_PX, height: int = HEIGHT) -> np.ndarray:
    return np.tile(_lines([modules], module_px), (height, 1))


def _lines(modules: list[str], module_px: int) -> np.ndarray:
    """A line of pixels for each symbol, all of one length, with quiet zones."""
    bars = np.frombuffer("".join(modules).encode(), np.uint8).reshape(len(modules), -1) == ord("1")
    return np.repeat(np.where(np.pad(bars, ((0, 0), (QUIET, QUIET))), 0, 255).astype(np.uint8), module_px, axis=1)


def run_widths(row: np.ndarray) -> tuple[np.ndarray, bool] | None:
    """Widths of the light and dark runs of a row, edges placed between pixels, and whether the first is dark; None without contrast."""
    ranked, n = np.sort(row), len(row)
    low, high = int(ranked[n // 10]), int(ranked[n * 9 // 10])
    if high - low < CONTRAST:
        return None
    level = (low + high) / 2
    dark, v = row < level, row.astype(float)
    at = np.flatnonzero(dark[1:] != dark[:-1])
    edges = at + 0.5 + (v[at] - level) / (v[at] - v[at + 1])
    return np.diff(np.concatenate([[0.0], edges, [n]])), bool(dark[0])


def _match(widths: np.ndarray, rows: slice) -> tuple[int, float] | None:
    unit = widths.sum() / 11
    if unit < 0.6:
        return None
    off = np.abs(widths / unit - _TABLE[rows])
    mean = off.mean(axis=1)
    best = int(mean.argmin())
    return (best + (rows.start or 0), unit) if mean[best] <= MEAN_ERROR and off[best].max() <= LARGEST_ERROR else None


def read_symbols(widths: np.ndarray, first_dark: bool) -> tuple[list[int], float] | None:
    """Symbol values with check and stop, and the module's width, of the first symbol that a row of runs holds."""
    for i in range(0 if first_dark else 1, len(widths) - 12, 2):
        start = _match(widths[i : i + 6], slice(103, 106))
        if not start or (i and widths[i - 1] < 3 * start[1]):
            continue
        found, units = [start[0]], [start[1]]
        for value, unit, ends in _following(widths[i + 6 :]):
            if ends is not None and abs(ends - units[-1]) < 0.25 * units[-1]:
                return [*found, STOP], float(np.mean(units))
            if value is None:
                break
            found.append(value)
            units.append(unit)
    return None


def _following(widths: np.ndarray) -> list[tuple[int | None, float, float | None]]:
    """What each six runs after a start are, all of them matched at once: the symbol's value (None for none) and module, and the module of a stop that begins there."""
    n = min(len(widths) // 6, LONGEST)
    six = widths[: 6 * n].reshape(n, 6)
    units = six.sum(axis=1) / 11
    fair = units >= 0.6
    off = np.abs((six.T / np.where(fair, units, 1.0))[:, :, None] - _TABLE[:103].T[:, None, :])
    mean = off.sum(axis=0) / 6
    best = mean.argmin(axis=1)
    at = np.arange(n)
    known = fair & (mean[at, best] <= MEAN_ERROR) & (off[:, at, best].max(axis=0) <= LARGEST_ERROR)
    whole = at[6 * at + 7 <= len(widths)]
    tails = widths[6 * whole[:, None] + np.arange(7)]
    stops = tails.sum(axis=1) / 13
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = np.abs(tails / stops[:, None] - _STOP).max(axis=1) <= LARGEST_ERROR
    told = [u if e else None for u, e in zip(stops.tolist(), ends.tolist())] + [None] * (n - len(whole))
    return [(b if k else None, u, e) for b, k, u, e in zip(best.tolist(), known.tolist(), units.tolist(), told)]


def interpret(symbols: list[int]) -> tuple[str, bool] | None:
    """The text of symbol values, and whether FNC1 leads it; None for a wrong check or a function that isn't read."""
    *data, check, _ = symbols
    if len(symbols) < 4 or (data[0] + sum(i * s for i, s in enumerate(data[1:], 1))) % 103 != check:
        return None
    if data[0] == START_C and all(s < 100 or s == FNC1 for s in data[1:]):
        return "".join([PAIRS[s] for s in data[1:] if s != FNC1]), data[1] == FNC1
    mode, shift, text = "ABC"[data[0] - 103], "", []
    for s in data[1:]:
        now, shift = shift or mode, ""
        if s == FNC1:
            continue
        if now == "C":
            if s < 100:
                text.append(f"{s:02d}")
            else:
                mode = {100: "B", 101: "A"}[s]
        elif s < 96:
            text.append(chr(s + 32) if now == "B" or s < 64 else chr(s - 64))
        elif s == 98:
            shift = "A" if now == "B" else "B"
        elif s == 99:
            mode = "C"
        elif s in (100, 101):
            mode = {100: "B", 101: "A"}[s] if now != {100: "B", 101: "A"}[s] else mode
        else:
            return None
    return "".join(text), data[1] == FNC1


def _read_row(row: np.ndarray) -> tuple[tuple[str, bool], float] | None:
    runs = run_widths(row)
    read = runs and read_symbols(*runs)
    text = read and interpret(read[0])
    return (text, read[1]) if text else None


def decode(pixels: np.ndarray) -> tuple[str, bool, float, int] | None:
    """Text, GS1 mark, mean module and rows in favour, by vote of evenly spaced rows, each read forwards, then backwards."""
    votes: dict[tuple[str, bool], list[float]] = {}
    seen: dict[bytes, tuple[tuple[str, bool], float] | None] = {}  # drawn labels repeat their rows
    for y in sorted({int((k + 0.5) * len(pixels) / ROWS) for k in range(ROWS)}):
        row = pixels[y]
        if (key := row.tobytes()) not in seen:
            seen[key] = _read_row(row) or _read_row(row[::-1])
        if seen[key]:
            votes.setdefault(seen[key][0], []).append(seen[key][1])
    if not votes:
        return None
    text, units = max(votes.items(), key=lambda v: len(v[1]))  # the first seen, of equals
    return *text, float(np.mean(units)), len(units)


def _read_lines(lines: np.ndarray) -> list[tuple[tuple[str, bool], float] | None]:
    """_read_row() of many rows of one length at once, where a symbol begins with the row's first bar and its widths are near to whole modules; None for others, which need a closer look."""
    n, ranked = lines.shape[1], np.sort(lines, axis=1)
    low, high = ranked[:, n // 10].astype(int), ranked[:, n * 9 // 10].astype(int)
    level = (low + high) / 2
    dark = lines < level[:, None]
    turns = dark[:, 1:] != dark[:, :-1]
    count, found = turns.sum(axis=1), [None] * len(lines)
    for c, first in {(int(c), bool(d)) for c, d in zip(count, dark[:, 0])}:
        of = np.flatnonzero((count == c) & (dark[:, 0] == first) & (high - low >= CONTRAST))
        begin = 0 if first else 1
        if not len(of) or c + 1 - begin < 13:
            continue
        row, at = np.nonzero(turns[of])
        v, w, lev = lines[of][row, at].astype(float), lines[of][row, at + 1].astype(float), level[of][row]
        edges = (at + 0.5 + (v - lev) / (v - w)).reshape(len(of), c)
        widths = np.diff(np.concatenate([np.zeros((len(of), 1)), edges, np.full((len(of), 1), float(n))], axis=1), axis=1)
        for i, got in zip(of.tolist(), _symbols_of(widths, begin)):
            text = got and interpret(got[0])
            found[i] = (text, got[1]) if text else None
    return found


def _symbols_of(widths: np.ndarray, begin: int) -> list[tuple[list[int], float] | None]:
    """read_symbols() of rows with equally many runs, the first start at run `begin`; None where that isn't plain."""
    k = min((widths.shape[1] - begin) // 6, LONGEST + 1)
    six = widths[:, begin : begin + 6 * k].reshape(len(widths), k, 6)
    units = six.sum(axis=2) / 11
    fair = units >= 0.6
    near = six / np.where(fair, units, 1.0)[:, :, None]
    whole = np.rint(near)
    off = np.abs(near - whole)
    sure = fair & (off.max(axis=2) <= _NEAR) & (off.mean(axis=2) <= MEAN_ERROR)
    code = np.where(sure, (np.clip(whole, 0, 7) @ _OCTAL).astype(int), 0)
    values = np.where(sure & (whole.max(axis=2) < 8), _BY_WIDTHS[code], -1)
    starts = np.select([(whole[:, 0] == p).all(axis=1) & sure[:, 0] for p in _TABLE[103:106]], [103, 104, 105], -1)
    if begin:
        starts = np.where(widths[:, begin - 1] >= 3 * units[:, 0], starts, -1)
    m = min(k - 1, (widths.shape[1] - begin - 7) // 6)  # places behind the start where a stop can be
    tails = widths[:, begin + 6 + 6 * np.arange(m)[:, None] + np.arange(7)]
    stops = tails.sum(axis=2) / 13
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = (np.abs(tails / stops[:, :, None] - _STOP).max(axis=2) <= LARGEST_ERROR) & (np.abs(stops - units[:, :m]) < 0.25 * units[:, :m])
    stop = np.where(ends.any(axis=1), ends.argmax(axis=1), -1)
    known = np.cumprod(values[:, 1:] >= 0, axis=1).sum(axis=1)  # symbols in a row behind the start
    good = (starts >= 0) & (stop >= 0) & (known >= stop)
    mean = {int(j): units[:, : int(j) + 1].mean(axis=1) for j in set(stop[good].tolist())}
    told = values.tolist()
    return [([s, *told[i][1 : j + 1], STOP], float(mean[j][i])) if g else None for i, (s, j, g) in enumerate(zip(starts.tolist(), stop.tolist(), good.tolist()))]


def read_pictures(content: list[bytes | None]) -> list[tuple]:
    """text, gs1, module_px, rows and problem of each PNG. Pictures whose rows are all the same, as drawn labels' are, are read by their first row, many at once; others, and what isn't plain, one by one by decode()."""
    out: list[tuple | None] = [None] * len(content)
    lines: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
    for i, data in enumerate(content):
        if data is None:
            out[i] = (None, None, None, None, "no_image")
            continue
        try:
            w, h, channels, body = _packed(data)
            row = _only_row(w, h, body) if channels == 1 else None
            if row is not None:
                lines[w].append((i, h, row))
            else:
                out[i] = _one_by_one(data)
        except (ValueError, zlib.error, struct.error) as e:
            out[i] = (None, None, None, None, str(e))
    for w, every in lines.items():
        for part in (every[k : k + AT_ONCE] for k in range(0, len(every), AT_ONCE)):
            rows = np.frombuffer(b"".join(row for _, _, row in part), np.uint8).reshape(len(part), w)
            for (i, h, _), got in zip(part, _read_lines(rows)):
                out[i] = (*got[0], got[1], min(h, ROWS), None) if got else _one_by_one(content[i])
    return out


def _one_by_one(data: bytes) -> tuple:
    got = decode(png_gray(data))
    return (*got, None) if got else (None, None, None, None, "no_barcode")


@F.pandas_udf(T.BinaryType())
def label_png(modules: pd.Series) -> pd.Series:
    """PNGs of symbols given as strings of 0 and 1; null for null."""
    out, by_length = [None] * len(modules), defaultdict(list)
    each = modules.tolist()
    for i, m in enumerate(each):
        if m is not None:
            by_length[len(m)].append(i)
    for of in by_length.values():
        for i, line in zip(of, _lines([each[i] for i in of], MODULE_PX)):
            out[i] = repeated_png(line.tobytes(), HEIGHT, DPI)
    return pd.Series(out, dtype=object)


@F.pandas_udf(READING)
def _read(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(read_pictures(content.tolist()), columns=["text", "gs1", "module_px", "rows", "problem"])


def read_label(content: Column) -> Column:
    """The reading of a PNG: text, gs1, module_px, rows, problem; a bad picture has a problem, the job goes on."""
    return _read(content)
