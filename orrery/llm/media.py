"""Media columns: progressive JPEG whose coefficients carry bytes without loss, and its decoder.

A payload's 64 bytes are the coefficients of one 8 x 8 block (in zigzag order, each byte BIAS higher), for luminance and
chrominance at half resolution. Scans by spectral selection (DC, 1-7, 8-63) come with the lowest bit left out, then scans
by successive approximation bring it. The decoder accumulates all scans of any such file into coefficient arrays,
inverse-transforms them in numpy, upsamples chroma and gives full-resolution RGB tensors. With BIAS every coefficient has
the same size and each of our tables one code, so that scans of many files are coded and decoded at once; scans
of other files are decoded bit by bit.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

BIAS, SIZE = 512, 9
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def zigzag() -> np.ndarray:
    """For each place of the zigzag order its place in the block, row by row."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def inverse() -> np.ndarray:
    """64 x 64: from coefficients in zigzag order to samples, in units of 2^-14. Whole numbers, so products in floating point are exact."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.where(u == 0, np.sqrt(0.5), 1) * np.cos((2 * x + 1) * u * np.pi / 16) / 2
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()] * (1 << 14))


INVERSE = inverse()


# ---- writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, ident: int, length: int, symbol: int) -> bytes:
    """A table of one code: zeros, of the given length."""
    return segment(0xC4, bytes([kind << 4 | ident, *(int(i + 1 == length) for i in range(16)), symbol]))


def scan_header(component: int, tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([1, component, tables, first, last, high << 4 | low]))


TABLES = segment(0xDB, bytes([0] + [1] * 64)) + huffman(0, 0, 7, SIZE) + huffman(1, 0, 7, SIZE) + huffman(1, 1, 1, SIZE) + huffman(1, 2, 1, 0)
COMPONENTS = ((1, 4), (2, 1), (3, 1))  # with their blocks in each unit of 16 x 16 pixels
EVERY, NEVER = segment(0xDD, b"\0\1"), segment(0xDD, b"\0\0")
HEADS = {c: (scan_header(c, 0x00, 0, 0, 0, 1), scan_header(c, 0x00, 1, 7, 0, 1), scan_header(c, 0x01, 8, 63, 0, 1), scan_header(c, 0, 0, 0, 1, 0), scan_header(c, 0x02, 1, 63, 1, 0)) for c, _ in COMPONENTS}


def shape(blocks: int) -> tuple[int, int]:
    """Rows and columns of 16 x 16 units that hold so many blocks."""
    units = max(1, -(-blocks // 6))
    columns = int(np.ceil(np.sqrt(units)))
    return -(-units // columns), columns


def write(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload; lengths are multiples of 64."""
    shapes = [shape(len(p) // 64) for p in payloads]
    sizes = [6 * r * c for r, c in shapes]
    values = np.frombuffer(b"".join(p + bytes(64 * n - len(p)) for p, n in zip(payloads, sizes)), np.uint8).reshape(-1, 64)
    n = len(values)
    bits = np.unpackbits(values[:, :, None], axis=2)
    pairs = np.ones((n, 8, 2), np.uint8)
    pairs[:, :, 1] = values[:, :8] >> 1
    wide = np.zeros((n, 56, 10), np.uint8)
    wide[:, :, 1] = 1
    wide[:, :, 3:] = bits[:, 8:, :7]
    low = bits[:, :, 7].copy()
    dc_low = low[:, 0].copy()
    low[:, 0] = 0
    wide, low = np.packbits(wide.reshape(n, 560), axis=1), np.packbits(low, axis=1)
    dc = np.full((n, 4), 0xFF, np.uint8)
    dc[:, :2] = pairs[:, 0]
    narrow = pairs[:, 1:].reshape(n, 14)
    out, at = [], 0
    for payload, (rows, columns) in zip(payloads, shapes):
        frame = segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        parts = [b"\xff\xd8", segment(0xFE, struct.pack(">Q", len(payload))), TABLES, frame]
        spans = []
        for component, k in COMPONENTS:
            spans.append((component, at, at := at + k * rows * columns))
        parts.append(EVERY)
        for component, a, b in spans:
            dc[a:b, 3] = 0xD0 + np.arange(b - a) % 8
            parts += [HEADS[component][0], dc[a:b].tobytes()[:-2]]
        parts.append(NEVER)
        for which, body in ((1, narrow), (2, wide)):
            for component, a, b in spans:
                parts += [HEADS[component][which], body[a:b].tobytes()]
        for component, a, b in spans:
            ones = np.append(dc_low[a:b], np.ones(-(b - a) % 8, np.uint8))
            parts += [HEADS[component][3], np.packbits(ones).tobytes().replace(b"\xff", b"\xff\0")]
        for component, a, b in spans:
            parts += [HEADS[component][4], low[a:b].tobytes().replace(b"\xff", b"\xff\0")]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# ---- reading


class Frame:
    """What a file's headers say, and its scans."""

    def __init__(self, data: bytes) -> None:
        self.scans, self.quant, self.comment = [], {}, b""
        tables, every, at = {}, 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xD9:
                break
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    self.quant[body[0] & 15], body = np.array(list(body[1:65])), body[65:]
            elif marker == 0xC4:
                while body:
                    k = sum(body[1:17])
                    tables[body[0]], body = (body[1:17], body[17 : 17 + k]), body[17 + k :]
            elif marker == 0xDD:
                every = int.from_bytes(body, "big")
            elif marker == 0xC2:
                self.height, self.width, k = struct.unpack(">HHB", body[1:6])
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
                self.across, self.down = max(c[1] for c in self.components), max(c[2] for c in self.components)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only progressive Huffman-coded files are decoded")
            elif marker == 0xDA:
                k = body[0]
                chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(k)]
                first, last, bits = body[1 + 2 * k : 4 + 2 * k]
                end = MARKER.search(data, at).start()
                self.scans.append((chosen, first, last, bits >> 4, bits & 15, dict(tables), every, data[at:end]))
                at = end

    def grid(self, component: tuple) -> tuple[int, int, int, int]:
        """Rows and columns of a component's blocks: those stored (whole units), and those that scans of it alone have."""
        units = lambda size, most: -(-size // (8 * most))
        _, h, v, _ = component
        return units(self.height, self.down) * v, units(self.width, self.across) * h, -(-(-(-self.height * v // self.down)) // 8), -(-(-(-self.width * h // self.across)) // 8)


def single(table) -> tuple[int, int] | None:
    """Length and symbol of the only code of a table."""
    return None if table is None or len(table[1]) != 1 else (next(i + 1 for i, n in enumerate(table[0]) if n), table[1][0])


def coefficients(frames: list[Frame]) -> tuple[np.ndarray, list[list[int]]]:
    """Blocks x 64 coefficients in zigzag order of all frames, and where each component of each frame starts."""
    starts, total = [], 0
    for f in frames:
        own = []
        for c in f.components:
            own.append(total)
            rows, columns, _, _ = f.grid(c)
            total += rows * columns
        starts.append(own)
    out = np.zeros((total, 64), np.int16)
    depth = max((len(f.scans) for f in frames), default=0)
    for turn in range(depth):  # scans of a file build on each other, those of different files don't
        alike = defaultdict(list)
        for f, own in zip(frames, starts):
            if turn >= len(f.scans):
                continue
            scan = f.scans[turn]
            chosen, first, last, high, low, tables, every, data = scan
            code = single(tables.get((0x10 | chosen[0][1] & 15) if first else chosen[0][1] >> 4))
            index = next(i for i, c in enumerate(f.components) if c[0] == chosen[0][0])
            rows, columns, r, c = f.grid(f.components[index])
            n = rows * columns
            plain = RESTART.sub(b"", data).replace(b"\xff\0", b"\xff") if every else data.replace(b"\xff\0", b"\xff")
            width = last - first + 1
            if len(chosen) == 1 and (rows, columns) == (r, c) and (
                (not high and code and 0 < code[1] < 16 and (sum(code) * width) % 8 == 0 and len(plain) * 8 == sum(code) * width * n and (first or every == 1))
                or (high and first and not every and code == (1, 0) and len(plain) * 8 == n * 64 and width == 63)
                or (high and not first and not every)
            ):
                alike[(first, last, high, low, code)].append((own[index], n, plain))
            else:
                decode(f, own, scan, out)
        for (first, last, high, low, code), found in alike.items():
            if high and not first:
                for at, n, plain in found:
                    out[at : at + n, 0] |= np.unpackbits(np.frombuffer(plain, np.uint8))[:n].astype(np.int16) << low
                continue
            which = np.concatenate([np.arange(at, at + n) for at, n, _ in found])
            bits = np.frombuffer(b"".join(p for _, _, p in found), np.uint8).reshape(len(which), -1)
            if high:
                step = np.unpackbits(bits, axis=1)[:, 1:].astype(np.int16) << low
                old = out[which, 1:]
                out[which, 1:] = old + np.sign(old) * step  # all are non-zero, or checked below
                if (old == 0).any():
                    raise ValueError("a scan that refines has bits for coefficients that are zero")
                continue
            length, size = code
            if length + size == 16:
                word = bits.reshape(len(which), -1, 2)
                word = word[:, :, 0].astype(np.int32) << 8 | word[:, :, 1]
                if (word >> size).any():
                    raise ValueError("a code that no table has")
                word &= (1 << size) - 1
            else:
                flat = np.unpackbits(bits, axis=1).reshape(len(which), last - first + 1, length + size)
                if flat[:, :, :length].any():
                    raise ValueError("a code that no table has")
                top = flat[:, :, length : length + size]
                word = np.zeros(top.shape[:2], np.int32)
                for j in range(size):
                    word = word << 1 | top[:, :, j]
            value = np.where(word < 1 << (size - 1), word - (1 << size) + 1, word)
            out[which, first : last + 1] = value << low
    return out, starts


def decode(f: Frame, starts: list[int], scan: tuple, out: np.ndarray) -> None:
    """One scan, code by code, into out."""
    chosen, first, last, high, low, tables, every, data = scan
    parts = [p.replace(b"\xff\0", b"\xff") for p in (RESTART.split(data) if every else [data])]
    codes = {}
    for ident, (counts, symbols) in tables.items():
        code, k = 0, 0
        codes[ident] = own = {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                own[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
    units = []  # of each unit its blocks: (component, row in out, its DC and AC table)
    by = {c[0]: i for i, c in enumerate(f.components)}
    if len(chosen) == 1:
        i = by[chosen[0][0]]
        rows, columns, r, c = f.grid(f.components[i])
        units = [[(i, starts[i] + y * columns + x, chosen[0][1])] for y in range(r) for x in range(c)]
    else:
        rows, columns = -(-f.height // (8 * f.down)), -(-f.width // (8 * f.across))
        for y in range(rows):
            for x in range(columns):
                unit = []
                for ident, t in chosen:
                    i = by[ident]
                    _, h, v, _ = f.components[i]
                    unit += [(i, starts[i] + (y * v + b) * columns * h + x * h + a, t) for b in range(v) for a in range(h)]
                units.append(unit)
    every = every or len(units)
    for p, at in enumerate(range(0, len(units), every)):
        bits = np.unpackbits(np.frombuffer(parts[p], np.uint8)).tolist() + [1] * 64
        place = 0
        run, before = 0, defaultdict(int)

        def take(n):
            nonlocal place
            value = 0
            for b in bits[place : place + n]:
                value = value << 1 | b
            place += n
            return value

        def symbol(table):
            code, length = 0, 0
            while (length, code) not in table:
                code, length = code << 1 | take(1), length + 1
                if length > 16:
                    raise ValueError("a code that no table has")
            return table[length, code]

        def extended(n):
            value = take(n)
            return value - (1 << n) + 1 if n and value < 1 << (n - 1) else value

        for unit in units[at : at + every]:
            for i, row, t in unit:
                block = out[row]
                if not first:
                    if high:
                        block[0] |= take(1) << low
                    else:
                        before[i] += extended(symbol(codes[t >> 4]))
                        block[0] = before[i] << low
                    continue
                own, k = codes[0x10 | t & 15], first

                def refine(k, zeros):
                    """Passes so many zero coefficients, correcting the others; where the next zero is."""
                    while k <= last:
                        if block[k]:
                            if take(1):
                                block[k] += (1 << low) if block[k] > 0 else -(1 << low)
                        elif zeros == 0:
                            return k
                        else:
                            zeros -= 1
                        k += 1
                    return k

                while k <= last and not run:
                    r, s = divmod(symbol(own), 16)
                    if s == 0 and r < 15:
                        run = (1 << r) + take(r)
                        break
                    if high:
                        value = (1 if take(1) else -1) << low if s else 0
                        k = refine(k, r)
                        if s and k <= last:
                            block[k] = value
                    else:
                        k += r
                        if s:
                            block[k] = extended(s) << low
                    k += 1
                if run:
                    if high:
                        refine(k, 64)
                    run -= 1


def tensors(frames: list[Frame], values: np.ndarray, starts: list[list[int]]) -> list[np.ndarray]:
    """Height x width x 3 bytes of each frame. Whole numbers throughout: the same file gives the same tensor in any batch."""
    scaled = values.astype(np.float64)
    for f, own in zip(frames, starts):
        for c, s in zip(f.components, own):
            if (f.quant[c[3]] != 1).any():
                rows, columns, _, _ = f.grid(c)
                scaled[s : s + rows * columns] *= f.quant[c[3]]
    samples = (scaled @ INVERSE + (1 << 13)).astype(np.int64) >> 14
    out = []
    for f, own in zip(frames, starts):
        planes = []
        for c, s in zip(f.components, own):
            rows, columns, _, _ = f.grid(c)
            plane = samples[s : s + rows * columns].reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
            plane = np.clip(plane + 128, 0, 255)
            planes.append(plane.repeat(f.down // c[2], 0).repeat(f.across // c[1], 1)[: f.height, : f.width])
        if len(planes) == 1:
            planes *= 3
            out.append(np.stack(planes, 2).astype(np.uint8))
            continue
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        half = 1 << 15
        red = y + (91881 * r + half >> 16)
        green = y + (-22554 * b - 46802 * r + half >> 16)
        blue = y + (116130 * b + half >> 16)
        out.append(np.clip(np.stack([red, green, blue], 2), 0, 255).astype(np.uint8))
    return out


def payload(frame: Frame, values: np.ndarray, start: int) -> bytes:
    """What write() stored in the coefficients."""
    (n,) = struct.unpack(">Q", frame.comment)
    return (values[start : start + n // 64] - BIAS).astype(np.uint8).tobytes()


def feature(tensor: np.ndarray) -> str:
    """Size, sums of each channel, and the sum of squares."""
    sums = tensor.sum((0, 1), dtype=np.int64).tolist()
    flat = tensor.ravel().astype(np.int64)
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{','.join(map(str, sums))}:{int(flat @ flat)}"


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(64 - len(text) if len(text) < 64 else -len(text) % 64)


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, keep: list[str], text: str = "text", media: bool = False, tensor: bool = False) -> DataFrame:
    """The columns keep, what FIELDS says, and with media the stored file, with tensor its full-resolution RGB bytes, height and width.

    The text's bytes, with zeros up to a positive multiple of 64, are written as a progressive JPEG file and read back from it; all
    but n_bytes comes from what was read. Null and empty texts are 64 zeros; equal texts have equal values, repeated rows stay. A
    kept column with a result's name gets `_source` appended.
    """

    def make():
        def work(texts):
            files = write([padded(t) for t in texts])
            frames = [Frame(f) for f in files]
            values, starts = coefficients(frames)
            back = [payload(f, values, s[0]) for f, s in zip(frames, starts)]
            images = tensors(frames, values, starts)
            return (
                [len(t or b"") for t in texts], [len(p) for p in back], [hashlib.sha256(p).hexdigest() for p in back], [zlib.crc32(p[-64:]) for p in back],
                [len(f) for f in files], [hashlib.sha256(f).hexdigest() for f in files], [feature(x) for x in images],
                *([files] if media else []), *([[x.tobytes() for x in images], [x.shape[0] for x in images], [x.shape[1] for x in images]] if tensor else []),
            )

        return work

    return map_texts(docs, keep, text, FIELDS + ", media binary" * media + ", tensor binary, height int, width int" * tensor, make, 1 << 19)


def decode_images(rows: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The columns keep, and tensor (RGB bytes, row by row), height, width of each progressive JPEG file. They are null for null, and for
    what isn't one or is cut off: problem then says why."""

    def make():
        def work(files):
            out, problems = [], []
            for f in files:
                found = problem = None
                try:
                    if f is not None:
                        frame = Frame(f)
                        values, starts = coefficients([frame])
                        found = tensors([frame], values, starts)[0]
                except (TypeError, ValueError, IndexError, KeyError, AttributeError, StopIteration, struct.error) as e:
                    problem = f"{type(e).__name__}: {e}"
                out.append(found)
                problems.append(problem)
            return *([None if x is None else y(x) for x in out] for y in (lambda x: x.tobytes(), lambda x: x.shape[0], lambda x: x.shape[1])), problems

        return work

    return map_texts(rows, keep, media, "tensor binary, height int, width int, problem string", make)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stored files their size and digest, of the tensors their size beside the features."""
    stored = store(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], media=True, tensor=True)
    media = [F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.length("tensor").cast("long").alias("tensor_bytes")]
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *media)
