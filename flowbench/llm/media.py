"""Media columns of baseline JPEG.

``store`` keeps bytes losslessly as the samples of gray baseline JPEG images: each byte is the DC coefficient of one
8x8 block (quantiser 8, so the block's luminance is the byte itself), 24 blocks a row, with a restart marker after
every row. ``read`` parses any baseline JPEG stream: markers, quantisation and Huffman tables, restart intervals; it
Huffman-decodes the scans and reconstructs the luminance thumbnail from the DC coefficients alone, one sample a
block. Restart intervals of all images of a batch are decoded in step, as lanes of numpy arrays.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import per_text, slices

#: Samples that a payload is padded to a multiple of; blocks a row; rows of blocks an image holds at most.
UNIT, ACROSS, MOST_ROWS = 576, 24, 8184
#: Code counts by length (1 to 16 bits) of the standard table for luminance DC; its symbols are 0 to 11.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
#: The AC table has one symbol, end of block, of one bit.
AC_COUNTS = bytes([1] + [0] * 15)


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: 256 * length + symbol of the code they begin with; 0 where none does."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in codes(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = 256 * length + symbol
    return table


def difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block whose DC differs by -255 to 255 from the one before: code, amplitude, end of block."""
    by = {s: (c, n) for s, c, n in codes(DC_COUNTS, bytes(range(12)))}
    bits, lengths = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = by[size]
        bits[d + 255] = ((code << size) | (d if d > 0 else d + (1 << size) - 1)) << 1
        lengths[d + 255] = n + size + 1
    return bits, lengths


BITS, LENGTHS = difference_codes()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    """All markers up to the scan of an image of so many rows of blocks."""
    return b"".join([
        b"\xff\xd8",
        segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        segment(0xDB, bytes([0] + [8] * 64)),
        segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ACROSS * 8, 1, 1, 0x11, 0)),
        segment(0xC4, bytes([0x00]) + DC_COUNTS + bytes(range(12))),
        segment(0xC4, bytes([0x10]) + AC_COUNTS + bytes([0])),
        segment(0xDD, struct.pack(">H", ACROSS)),
        segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def pad(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def scans(samples: np.ndarray, rows: list[int]) -> list[bytes]:
    """Entropy-coded data of images with so many rows, whose samples stand one after another; with the end marker."""
    lanes = samples.reshape(-1, ACROSS).astype(np.int32) - 128
    index = np.diff(lanes, axis=1, prepend=0) + 255
    bits, lengths = BITS[index], LENGTHS[index]
    spare = -lengths.sum(axis=1) % 8
    bits = np.concatenate([bits, ((1 << spare) - 1).astype(np.uint32)[:, None]], axis=1).ravel()
    lengths = np.concatenate([lengths, spare[:, None]], axis=1)
    each = lengths.ravel()
    wide = np.unpackbits((bits << (16 - each).astype(np.uint32)).astype(">u2").view(np.uint8)).reshape(-1, 16)
    packed = np.packbits(wide[np.arange(16) < each[:, None]])
    ends = np.cumsum(lengths.sum(axis=1) // 8)
    lane = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    stuffed = np.cumsum(packed == 0xFF)
    place = np.arange(len(packed)) + stuffed - (packed == 0xFF) + 2 * lane
    out = np.zeros(len(packed) + int(stuffed[-1]) + 2 * len(ends), np.uint8)
    out[place] = packed
    marks = ends + stuffed[ends - 1] + 2 * np.arange(len(ends))
    number = np.concatenate([np.arange(n) % 8 + 0xD0 for n in rows])
    last = np.cumsum(rows) - 1
    number[last] = 0xD9
    out[marks], out[marks + 1] = 0xFF, number
    cuts = marks[last] + 2
    return [out[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def write(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of UNIT) as one JPEG image, or several in a row where it is too high for one."""
    out: list[list[bytes]] = [[] for _ in payloads]
    rows, owners, parts, waiting = [], [], [], 0

    def flush() -> None:
        for owner, n, scan in zip(owners, rows, scans(np.frombuffer(b"".join(parts), np.uint8), rows), strict=True):
            out[owner].append(header(n) + scan)
        rows.clear(), owners.clear(), parts.clear()

    for k, payload in enumerate(payloads):
        for start in range(0, len(payload), MOST_ROWS * ACROSS):
            part = payload[start : start + MOST_ROWS * ACROSS]
            rows.append(len(part) // ACROSS), owners.append(k), parts.append(part)
            waiting += len(part)
            if waiting >= 1 << 20:
                flush()
                waiting = 0
    if parts:
        flush()
    return [b"".join(x) for x in out]


@dataclass
class Image:
    """What the markers of one image say, and where the scan of its first component lies."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quantisers: dict[int, int] = field(default_factory=dict)  # of DC
    order: list[tuple[int, int, bytes, bytes]] = field(default_factory=list)  # of the scan: component, blocks, DC and AC table
    interval: int = 0
    across: int = 0  # minimum coded units
    down: int = 0
    scan: bytes = b""
    splits: list[int] = field(default_factory=list)

    def grid(self) -> tuple[int, int]:
        """Rows and columns of luminance blocks that the picture covers."""
        high, wide = max(c[2] for c in self.components), max(c[1] for c in self.components)
        _, h, v, _ = self.components[0]
        return -(-(-(-self.height * v // high)) // 8), -(-(-(-self.width * h // wide)) // 8)


def parse(raw: bytes) -> list[Image]:
    """The images of a stream. Raises ValueError for what isn't baseline JPEG."""
    images, at, image, tables = [], 0, None, {}
    while at + 1 < len(raw):
        if raw[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = raw[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == 0xD8:
            image, tables = Image(), {}
            continue
        if marker == 0xD9:
            if image is None or not image.order:
                raise ValueError("an image without a scan of its first component")
            images.append(image)
            image = None
            continue
        if image is None or at + 2 > len(raw):
            raise ValueError("a segment outside an image")
        size = struct.unpack_from(">H", raw, at)[0]
        body = raw[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            image.interval = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDA:
            found = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            start, splits, pieces, begin = at, [], [], at
            while True:  # to the next marker that is neither a stuffed byte nor a restart
                at = raw.find(b"\xff", at)
                if at < 0 or at + 1 >= len(raw):
                    raise ValueError("a scan without an end")
                if raw[at + 1] == 0:
                    at += 2
                elif 0xD0 <= raw[at + 1] <= 0xD7:
                    pieces.append(raw[begin:at].replace(b"\xff\0", b"\xff"))
                    at += 2
                    begin = at
                else:
                    break
            pieces.append(raw[begin:at].replace(b"\xff\0", b"\xff"))
            first = image.components[0][0]
            if first in [c for c, _ in found]:
                by = {c[0]: c for c in image.components}
                high, wide = max(c[2] for c in image.components), max(c[1] for c in image.components)
                if len(found) == 1:
                    image.down, image.across = image.grid()
                    blocks = {first: 1}
                else:
                    image.down, image.across = -(-image.height // (8 * high)), -(-image.width // (8 * wide))
                    blocks = {c: by[c][1] * by[c][2] for c, _ in found}
                image.order = [(c, blocks[c], b"".join(tables[t >> 4]), b"".join(tables[0x10 | t & 15])) for c, t in found]
                image.scan, image.splits = b"".join(pieces), np.cumsum([0] + [len(p) for p in pieces[:-1]]).tolist()
    if image is not None:
        raise ValueError("an image without an end")
    return images


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Luminance DC coefficients of images that share tables and order: an array (units, blocks a unit) each."""
    order, first = images[0].order, images[0].components[0][0]
    tables = {t: lookup(t[:16], t[16:]) for _, _, dc, ac in order for t in (dc, ac)}
    raw = np.frombuffer(b"".join(i.scan for i in images) + bytes(8), np.uint8).astype(np.uint64)
    window = sum(raw[k : len(raw) - 4 + k] << np.uint64(32 - 8 * k) for k in range(5)).astype(np.int64)
    offsets = np.cumsum([0] + [len(i.scan) for i in images[:-1]])
    starts = np.concatenate([np.asarray(i.splits) + o for i, o in zip(images, offsets, strict=True)])
    counts = np.concatenate([
        np.minimum(i.interval or i.across * i.down, i.across * i.down - (i.interval or 0) * np.arange(len(i.splits))) for i in images
    ])
    if (counts <= 0).any() or any((len(i.splits) - 1) * (i.interval or 1 << 60) >= i.across * i.down for i in images if len(i.splits) > 1):
        raise ValueError("more restart intervals than the picture has")
    lanes, most = len(starts), int(counts.max())
    luma = next(n for c, n, _, _ in order if c == first)
    out = np.zeros((lanes, most, luma), np.int32)
    place, before = starts.astype(np.int64) * 8, {c: np.zeros(lanes, np.int64) for c, *_ in order}
    limit = (len(raw) - 5) * 8
    even = bool((counts == most).all())
    active = np.arange(lanes)

    def take(at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shift, bits = at & 7, window[at >> 3]
        entry = table[(bits >> (24 - shift)) & 0xFFFF]
        return bits, shift + (entry >> 8), entry & 255

    for unit in range(most):
        if not even:
            active = np.flatnonzero(counts > unit)
        for c, n, dc, ac in order:
            for k in range(n):
                at = place[active]
                bits, used, size = take(at, tables[dc])
                if (used == (at & 7)).any() or (size > 11).any():
                    raise ValueError("bits that are no code")
                value = (bits >> (40 - used - size)) & ((1 << size) - 1)
                value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
                before[c][active] += value
                if c == first:
                    out[active, unit, k] = before[c][active]
                at = at - (at & 7) + used + size
                index, todo, spot = np.ones(len(active), np.int64), np.arange(len(active)), at
                while len(todo):
                    if (spot > limit).any():
                        raise ValueError("the scan ends early")
                    _, used, symbol = take(spot, tables[ac])
                    if (used == (spot & 7)).any():
                        raise ValueError("bits that are no code")
                    run, size = symbol >> 4, symbol & 15
                    spot = spot - (spot & 7) + used + size
                    at[todo] = spot
                    step = np.where((size == 0) & (run < 15), 64, run + 1)
                    index[todo] += step
                    on = index[todo] < 64
                    todo, spot = todo[on], spot[on]
                place[active] = at
    ends = np.cumsum([len(i.splits) for i in images])
    result = []
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        own = out[a:b]
        result.append(own.reshape(-1, luma) if even else np.concatenate([own[j, : counts[a + j]] for j in range(b - a)]))
    return result


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """Luminance of each 8x8 block, as bytes."""
    groups = defaultdict(list)
    for k, i in enumerate(images):
        groups[tuple(i.order), i.components[0][0], i.interval or (k,)].append(k)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(images)
    for members in groups.values():
        for k, dc in zip(members, coefficients([images[m] for m in members]), strict=True):
            i = images[k]
            _, h, v, q = i.components[0]
            rows, cols = i.grid()
            if len(i.order) > 1:
                dc = dc.reshape(i.down, i.across, v, h).transpose(0, 2, 1, 3).reshape(i.down * v, i.across * h)
            plane = dc.reshape(-1, i.across * (h if len(i.order) > 1 else 1))[:rows, :cols]
            out[k] = np.clip((plane * i.quantisers[q] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def means(picture: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means of a grid of areas of the picture, which has at least as many samples each way."""
    r, c = np.arange(rows) * picture.shape[0] // rows, np.arange(cols) * picture.shape[1] // cols
    total = np.add.reduceat(np.add.reduceat(picture.astype(np.int64), r, axis=0), c, axis=1)
    return total / np.outer(np.diff(r, append=picture.shape[0]), np.diff(c, append=picture.shape[1]))


def hashes(picture: np.ndarray) -> str:
    """Average hash and difference hash, 64 bits each, in hex; small pictures are repeated to 9 samples each way."""
    if min(picture.shape) < 9:
        picture = np.kron(picture, np.ones((9, 9), np.uint8)) if picture.size else np.zeros((9, 9), np.uint8)
    a, d = means(picture, 8, 8), means(picture, 8, 9)
    bits = np.concatenate([(a > a.mean()).ravel(), (d[:, 1:] > d[:, :-1]).ravel()])
    raw = np.packbits(bits).tobytes().hex()
    return f"{raw[:16]}:{raw[16:]}"


def read(media: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """Width, height and thumbnail of each stream; images in a row stand below one another."""
    parsed = [parse(m) for m in media]
    flat = iter(thumbnails([i for images in parsed for i in images]))
    out = []
    for images in parsed:
        planes = [next(flat) for _ in images]
        same = len({p.shape[1] for p in planes}) == 1
        picture = np.concatenate(planes) if same else (planes[0] if planes else np.zeros((0, 0), np.uint8))
        out.append((max((i.width for i in images), default=0), sum(i.height for i in images), picture))
    return out


def store(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with each whole text (null: empty), padded, as JPEG in ``out`` (binary)."""
    docs = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(texts: list[str]) -> dict[str, pa.Array]:
        return {out: pa.array(write([pad(t.encode()) for t in texts]), pa.binary())}

    return docs.mapInArrow(per_text(text, run), f"{fields}, `{out}` binary")


def features(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows with ``width``, ``height``, ``thumbnail`` (binary, by rows) and ``hash`` of a JPEG column (null: nulls).

    A stream that isn't baseline JPEG gets nulls too. Columns of these names are replaced.
    """
    rows = rows.drop("width", "height", "thumbnail", "hash")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def safe(items: list[bytes]) -> list[tuple[int, int, np.ndarray] | None]:
        try:
            return read(items)
        except (ValueError, IndexError, KeyError, struct.error):
            return [None] if len(items) == 1 else [x for i in items for x in safe([i])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, media):
                items = part.column(media).to_pylist()
                found = iter(safe([x for x in items if x is not None]))
                got = [next(found) if x is not None else None for x in items]
                made = [
                    pa.array([g and g[0] for g in got], pa.int32()), pa.array([g and g[1] for g in got], pa.int32()),
                    pa.array([g and g[2].tobytes() for g in got], pa.binary()), pa.array([g and hashes(g[2]) for g in got], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "width", "height", "thumbnail", "hash"])

    return rows.mapInArrow(run, f"{fields}, width int, height int, thumbnail binary, hash string")


def digests(docs: DataFrame) -> DataFrame:
    """Per document what its stored form and the samples read back from it come to."""
    stored = store(docs.select("doc_id", "text")).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    return features(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -32, 32)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "hash").alias("feature"),
    )
