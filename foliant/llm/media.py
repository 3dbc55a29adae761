"""Media columns: AVI files of motion JPEG, and the shots in them as timed clip rows.

A payload is stored without loss as 8-bit samples: sample s becomes an 8 x 8 block of the grey value s in a baseline
JPEG frame. With a quantiser step of 8 a flat block's DC coefficient is s - 128 and it has no AC coefficients, so any
JPEG decoder gives the value back exactly. Frames are COLUMNS blocks wide and at most ROWS high, the last is padded;
the payload's length stands in the stream's 'strd' chunk.

Reading parses the RIFF tree, finds the frames by 'idx1' (or by walking 'movi' where a file has none) and decodes
them. Frames that hold flat blocks alone are decoded side by side: step k decodes block k of every frame of a batch
with numpy. Any other baseline grey frame goes through a plain decoder with AC coefficients and inverse DCT. Shots
are cut where the difference of two frames' grey histograms exceeds the mean plus CUT deviations of the differences
in the WINDOW frames before it, and FLOOR at least.

Defined results: null text counts as empty (a payload of 64 zero bytes); a null or unreadable medium has no frames
and no clips, and so has one with a damaged frame; equal payloads give equal files; rows are independent; other columns
are not read. Frames are coded and decoded AT_ONCE samples at a time, so work space beyond a text and its file is bounded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

PAD, COLUMNS, ROWS, FPS = 64, 32, 32, 25
CUT, FLOOR, WINDOW, BINS = 3.0, 0.25, 8, 16
#: Bytes of text worked at once; the arrays for coding take some 150 bytes for each.
AT_ONCE = 1 << 19

# Fixed values of the JPEG standard: luminance DC code lengths (count of codes of 1 to 16 bits) and the zigzag order.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = bytes(range(12))
AC_LENGTHS = (1,) + (0,) * 15
AC_SYMBOLS = b"\0"
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def huffman(lengths, symbols) -> dict[tuple[int, int], int]:
    """(bits, code) -> symbol of a canonical table."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[bits, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


_DC = {symbol: (bits, code) for (bits, code), symbol in huffman(DC_LENGTHS, DC_SYMBOLS).items()}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + bytes([8]) * 64)
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, COLUMNS * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + bytes(DC_LENGTHS) + DC_SYMBOLS + b"\x10" + bytes(AC_LENGTHS) + AC_SYMBOLS)
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def _code_tables():
    """Bits and value for each difference -255..255 of two samples: DC code, extra bits, and the block's end."""
    bits, value = np.zeros(511, dtype=np.int64), np.zeros(511, dtype=np.uint64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        length, code = _DC[n]
        bits[d + 255], value[d + 255] = length + n + 1, ((code << n) | (d if d >= 0 else d + (1 << n) - 1)) << 1
    return bits, value


_BITS, _VALUE = _code_tables()


def encode_scans(samples: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Entropy-coded segments of frames that lie one after another in samples; sizes: their samples."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    diff = np.diff(samples.astype(np.int64), prepend=128)
    diff[starts[:-1]] = samples[starts[:-1]].astype(np.int64) - 128
    bits, value = _BITS[diff + 255], _VALUE[diff + 255]
    ends = np.cumsum(bits)
    total = ends[starts[1:] - 1]
    before = np.concatenate([[0], total[:-1]])
    filled = (total - before + 31) // 32 * 32  # every frame begins a 32-bit word
    origin = np.concatenate([[0], np.cumsum(filled)])
    at = ends - bits + np.repeat(origin[:-1] - before, sizes)
    shifted = value << (64 - (at & 31) - bits).astype(np.uint64)
    words = int(origin[-1] // 32)
    packed = np.bincount(at >> 5, (shifted >> np.uint64(32)).astype(np.float64), words + 1)
    packed += np.bincount((at >> 5) + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 2)[: words + 1]
    used = total - before
    for i in np.flatnonzero(used % 32):  # ones up to the end of the byte
        last = origin[i] + used[i]
        packed[last >> 5] += float((1 << (32 - int(last & 31))) - 1)
    raw = packed.astype(np.uint64).astype(">u4").tobytes()
    return [raw[o >> 3 : (o >> 3) + (u + 7 >> 3)].replace(b"\xff", b"\xff\0") for o, u in zip(origin.tolist(), used.tolist())]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(frames: list[bytes], rows: int, payload: int) -> bytes:
    width, height, most = COLUMNS * 8, rows * 8, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", payload))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def pad(data: bytes) -> bytes:
    return data + b"\0" * (PAD - len(data) % PAD if len(data) % PAD or not data else 0)


def _groups(sizes: list[int], most: int):
    """(first, end) of neighbours with up to `most` in all, one at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def write_avis(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length is a positive multiple of PAD; frames are coded AT_ONCE samples at a time."""
    shapes, frames = [], []
    for p in payloads:
        rows = min(ROWS, len(p) // COLUMNS)
        size = rows * COLUMNS
        own = [p[i : i + size] for i in range(0, len(p), size)]
        own[-1] += b"\0" * (size - len(own[-1]))
        shapes.append((rows, len(own)))
        frames += own
    scans: list[bytes] = []
    for a, z in _groups([len(f) for f in frames], AT_ONCE):
        scans += encode_scans(np.frombuffer(b"".join(frames[a:z]), dtype=np.uint8), np.array([len(f) for f in frames[a:z]]))
    each = iter(scans)
    return [_avi([_frame_head(rows) + next(each) + b"\xff\xd9" for _ in range(n)], rows, len(p)) for p, (rows, n) in zip(payloads, shapes)]


def parse_riff(data: bytes) -> tuple[int, list[bytes], int | None]:
    """(microseconds a frame, the frames, payload's length if it is there)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return 0, [], None
    pause, index, movi, payload, found = 0, None, None, None, []

    parts = [(12, len(data))]  # stretches that are still to be read, the next one last
    while parts:
        at, end = parts.pop()
        if at + 8 > end:
            continue
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body, stop = at + 8, min(end, at + 8 + size)
        parts.append((body + size + (size & 1), end))
        kind = data[body : body + 4] if name == b"LIST" else b""
        if kind == b"movi":
            movi = body
        if name == b"LIST":
            parts.append((body + 4, stop))
        elif name == b"avih" and stop - body >= 4:
            pause = struct.unpack_from("<I", data, body)[0]
        elif name == b"strd" and stop - body == 8:
            payload = struct.unpack_from("<Q", data, body)[0]
        elif name == b"idx1":
            index = (body, stop)
        elif name[2:] in (b"dc", b"db"):
            found.append(data[body:stop])
    if index and movi is not None:
        table = np.frombuffer(data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16], dtype="<u4").reshape(-1, 4)
        base = movi if len(table) and table[0, 2] < movi else 0  # offsets count from 'movi', in some files from the file's start
        found = [data[base + o + 8 : base + o + 8 + n] for k, _, o, n in table.tolist() if struct.pack("<I", k)[2:] in (b"dc", b"db")]
    return pause, found, payload


class Frame:
    """A baseline grey JPEG's tables and scan."""

    def __init__(self, data: bytes):
        at, self.quant, self.tables, self.restart = 2, {}, {}, 0
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 65 + 64 * wide
                    self.quant[body[0] & 15] = np.frombuffer(body[1:n], dtype=">u2" if wide else "u1").astype(np.int64)
                    body = body[n:]
            elif marker == 0xC0:
                _, self.height, self.width, parts, _, _, self.q = struct.unpack(">BHHBBBB", body[:9])
                if parts != 1:
                    raise ValueError("one grey component is expected")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (tuple(body[1:17]), body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("baseline frames only")
            at += 2 + size
            if marker == 0xDA:
                self.dc, self.ac = self.tables[body[2] >> 4], self.tables[0x10 | body[2] & 15]
                break
        end = data.rfind(b"\xff\xd9")
        self.scan = data[at : end if end >= at else len(data)]
        self.rows, self.columns = -(-self.height // 8), -(-self.width // 8)

    @property
    def flat(self) -> bool:
        return self.ac[1] == AC_SYMBOLS and not self.restart and self.dc == (DC_LENGTHS, DC_SYMBOLS) and self.quant[self.q][0] == 8

    def blocks(self) -> np.ndarray:
        """Grey pixels by block (rows x columns x 8 x 8), by the plain decoder."""
        dc, ac, quant = huffman(*self.dc), huffman(*self.ac), self.quant[self.q]
        basis = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
        out, done, each = np.zeros((self.rows * self.columns, 8, 8), dtype=np.uint8), 0, self.restart or self.rows * self.columns
        parts, start = [], 0
        for k in range(len(self.scan) - 1):
            if self.scan[k] == 0xFF and 0xD0 <= self.scan[k + 1] <= 0xD7:
                parts.append(self.scan[start:k])
                start = k + 2
        for part in [*parts, self.scan[start:]]:
            raw = part.replace(b"\xff\0", b"\xff")
            word, left, before = int.from_bytes(raw, "big"), len(raw) * 8, 0

            def take(n):
                nonlocal left
                left -= n
                return word >> left & (1 << n) - 1

            def symbol(table):
                code = 0
                for n in range(1, 17):
                    code = code << 1 | take(1)
                    if (n, code) in table:
                        return table[n, code]
                raise ValueError("no such code")

            def signed(n):
                v = take(n) if n else 0
                return v if not n or v >> n - 1 else v - (1 << n) + 1

            for _ in range(min(each, len(out) - done)):
                zz = np.zeros(64)
                before += signed(symbol(dc))
                zz[0], k = before, 1
                while k < 64 and (s := symbol(ac)):
                    k += s >> 4
                    if s & 15:
                        zz[k] = signed(s & 15)
                    k += 1
                freq = np.zeros(64)
                freq[ZIGZAG] = zz * quant
                out[done] = np.clip(np.rint(basis @ freq.reshape(8, 8) @ basis.T + 128), 0, 255)
                done += 1
        return out.reshape(self.rows, self.columns, 8, 8)


def _dc_lookup():
    """By the next 9 bits: the difference's bits, and the code's."""
    size, length = np.zeros(512, dtype=np.int64), np.zeros(512, dtype=np.int64)
    for (bits, code), symbol in huffman(DC_LENGTHS, DC_SYMBOLS).items():
        span = 1 << 9 - bits
        size[code * span : (code + 1) * span], length[code * span : (code + 1) * span] = symbol, bits
    return size, length


_SIZE, _LENGTH = _dc_lookup()


def decode_frames(frames: list[Frame]) -> list[np.ndarray | None]:
    """Each frame's samples (rows x columns): its blocks' grey values; None where a scan is damaged."""
    out: list = [None] * len(frames)
    # a block takes two bits at least
    sound = [f.rows * f.columns <= 4 * len(f.scan) for f in frames]
    for i, f in enumerate(frames):
        if sound[i] and not f.flat:
            try:
                out[i] = np.rint(f.blocks().mean(axis=(2, 3))).astype(np.uint8)
            except (ValueError, KeyError, IndexError):
                pass
    fast = [i for i, f in enumerate(frames) if sound[i] and f.flat and f.rows * f.columns]
    for a, z in _groups([frames[i].rows * frames[i].columns for i in fast], AT_ONCE):
        own = sorted(fast[a:z], key=lambda i: -frames[i].rows * frames[i].columns)
        for i, samples in zip(own, _decode_flat([frames[i] for i in own])):
            out[i] = samples
    return out


def _decode_flat(frames: list[Frame]) -> list[np.ndarray | None]:
    """Frames of flat blocks, the largest first, side by side: step k decodes block k of each."""
    n = np.array([f.rows * f.columns for f in frames])
    scans = [f.scan.replace(b"\xff\0", b"\xff") for f in frames]
    raw = np.frombuffer(b"".join(scans) + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    word = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at = np.concatenate([[0], np.cumsum([len(s) for s in scans])[:-1]]) * 8
    end = at + np.array([len(s) * 8 for s in scans])
    grey, value, good = np.zeros((len(frames), n[0]), dtype=np.uint8), np.full(len(frames), 128, dtype=np.int64), np.ones(len(frames), dtype=bool)
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")
    for k in range(n[0]):
        m = active[k]
        p = np.minimum(at[:m], end[:m])
        bits = (word[p >> 3].astype(np.int64) << (p & 7)) & 0xFFFFFFFF
        peek = bits >> 23
        size, length = _SIZE[peek], _LENGTH[peek]
        extra = (bits << length & 0xFFFFFFFF) >> (32 - size)
        value[:m] += np.where(extra >> np.maximum(size - 1, 0) > 0, extra, extra - (1 << size) + 1) * (size > 0)
        used = length + size
        good[:m] &= (bits >> (31 - used) & 1 == 0) & (length > 0) & (p + used < end[:m]) & (value[:m] >= 0) & (value[:m] <= 255)
        at[:m] = p + used + 1
        grey[:m, k] = value[:m] & 255
    return [grey[row, : n[row]].reshape(f.rows, f.columns) if good[row] else None for row, f in enumerate(frames)]


def read_avis(media: list[bytes | None]) -> list[tuple[int, list[np.ndarray], int | None]]:
    """(microseconds a frame, frames, payload's length) of each file; a frame that can't be read makes its file unreadable."""
    heads, frames, owner = [], [], []
    for k, m in enumerate(media):
        try:
            pause, raw, payload = parse_riff(m or b"")
            own = [Frame(f) for f in raw]
        except (ValueError, KeyError, IndexError, struct.error, AttributeError):
            pause, own, payload = 0, [], None
        heads.append((pause, [], payload))
        frames += own
        owner += [k] * len(own)
    damaged = set()
    for k, f in zip(owner, decode_frames(frames)):
        if f is None:
            damaged.add(k)
        else:
            heads[k][1].append(f)
    return [(0, [], None) if k in damaged else h for k, h in enumerate(heads)]


def payload_of(frames: list[np.ndarray], length: int | None) -> bytes:
    return b"".join(f.tobytes() for f in frames)[:length]


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot."""
    if not frames:
        return []
    hist = np.array([np.bincount(f.ravel() * BINS // 256 if f.dtype != np.uint8 else f.ravel() >> 4, minlength=BINS) / f.size for f in frames])
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts, since = [0], 0
    for i, d in enumerate(diff):
        past = diff[max(since, i - WINDOW) : i]
        if d > max(FLOOR, past.mean() + CUT * past.std() if len(past) else FLOOR):
            cuts.append(i + 1)
            since = i + 1
    return list(zip(cuts, [*cuts[1:], len(frames)]))


def feature(frames: list[np.ndarray]) -> str:
    """Frames, their size, mean grey in thousandths, and the shots' bounds."""
    if not frames:
        return "0"
    total, size = sum(int(f.sum()) for f in frames), sum(f.size for f in frames)
    return f"{len(frames)}x{frames[0].shape[1]}x{frames[0].shape[0]};{1000 * total // size};" + ",".join(f"{a}-{b}" for a, b in shots(frames))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, media binary): each text's bytes, padded, as an AVI file."""

    def run(batches):
        for ids, texts in text_batches(batches, AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(write_avis([pad((t or "").encode()) for t in texts]), pa.binary())], ["id", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, media binary").withColumnRenamed("id", id_col)


def timed(pause: int, frames: list[np.ndarray]) -> list[tuple]:
    """(clip, first_frame, n_frames, start_ms, end_ms, mean_grey) of each shot."""
    return [(i, a, z - a, a * pause / 1000, z * pause / 1000, float(sum(int(f.sum()) for f in frames[a:z]) / sum(f.size for f in frames[a:z]))) for i, (a, z) in enumerate(shots(frames))]


CLIP_NAMES, CLIP_KINDS = ["clip", "first_frame", "n_frames", "start_ms", "end_ms", "mean_grey"], (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
CLIP_TYPE = "clip:int,first_frame:int,n_frames:int,start_ms:double,end_ms:double,mean_grey:double"
CLIP = "clip int, first_frame int, n_frames int, start_ms double, end_ms double, mean_grey double"


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot: id_col, clip, first_frame, n_frames, start_ms, end_ms, mean_grey."""

    def run(batches):
        for b in batches:
            rows = [(key, *clip) for key, m in zip(*(b.column(i).to_pylist() for i in range(2))) for pause, frames, _ in read_avis([m]) for clip in timed(pause, frames)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), *CLIP_KINDS))], names=["id", *CLIP_NAMES])

    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(run, f"id long, {CLIP}").withColumnRenamed("id", id_col)


def stored(docs: DataFrame) -> DataFrame:
    """What comes back of each text that is written as a medium and read again, with its timed clip rows; the columns of query op2."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    clip = pa.list_(pa.struct(list(zip(CLIP_NAMES, CLIP_KINDS))))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip)

    def run(batches):
        for ids, texts in text_batches(batches, AT_ONCE):
            data = [(t or "").encode() for t in texts]
            media = write_avis([pad(d) for d in data])
            rows = []
            for key, d, m, (pause, frames, length) in zip(ids, data, media, read_avis(media)):
                back = payload_of(frames, length)
                rows.append((key, len(d), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(frames), [dict(zip(CLIP_NAMES, c)) for c in timed(pause, frames)]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<{CLIP_TYPE}>>")
