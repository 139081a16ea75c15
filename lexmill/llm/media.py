"""Media columns: AVI files of motion JPEG, and shots in them."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import jpeg
from lexmill.llm.textkit import blocks

#: Rows of samples in a frame at most, frames in a second.
FRAME_ROWS, RATE = 64, 25


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def avi(frames: list[bytes], width: int, height: int, payload: int, rate: int = RATE) -> bytes:
    """An AVI file of motion-JPEG frames with its index; a comment has the payload's length."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiIHHHH", 0, 0, 0, 0, 1, rate, 0, len(frames), most, -1, 0, 0, 0, width, height)
    shape = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", shape)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", f"payload={payload}".encode() + b"\x00"))
    index, offset, parts = [], 4, []
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, offset, len(f)))
        parts.append(chunk(b"00dc", f))
        offset += len(parts[-1])
    body = b"AVI " + head + info + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def parse_avi(data: bytes) -> tuple[dict, list[bytes]]:
    """``(facts, frames)``: frames by the index where there is one (offsets from the movie list or from the file), else in the order of the list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    facts, frames, index, movie = {"rate": RATE, "payload": None}, [], [], 0

    def walk(at: int, end: int) -> None:
        nonlocal movie
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movie = body
                walk(body + 4, body + size)
            elif name == b"avih":
                micro, *_, width, height = struct.unpack("<10I", data[body : body + 40])
                facts.update(rate=1_000_000 / micro if micro else RATE, width=width, height=height)
            elif name == b"ICMT" and data[body : body + 8] == b"payload=":
                facts["payload"] = int(data[body + 8 : body + size].rstrip(b"\x00"))
            elif name == b"idx1":
                index.extend(struct.unpack("<4sIII", data[k : k + 16]) for k in range(body, body + size, 16))
            elif name[2:] in (b"dc", b"db"):
                frames.append(data[body : body + size])
            at = body + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0]))
    if index:
        base = movie if any(data[movie + o : movie + o + 4] == n for n, _, o, _ in index[:1]) else 0
        frames = [data[base + o + 8 : base + o + 8 + size] for n, _, o, size in index if n[2:] in (b"dc", b"db")]
    return facts, frames


def shots(histograms: np.ndarray, window: int = 12, sigma: float = 4.0, least: float = 0.35) -> list[tuple[int, int, float]]:
    """``(first frame, frame after the last, difference at its start)``.

    A frame begins a shot if half the sum of absolute histogram differences to the last frame is ``least`` at least and
    more than ``sigma`` deviations above the mean of the last ``window`` differences of the same shot.
    """
    if not len(histograms):
        return []
    share = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    step = np.abs(np.diff(share, axis=0)).sum(1) / 2
    cuts, start, at = [], 0, 0.0
    for i, d in enumerate(step, 1):
        seen = step[max(start, i - 1 - window) : i - 1]
        if d >= least and (not len(seen) or d > seen.mean() + sigma * seen.std()):
            cuts.append((start, i, at))
            start, at = i, float(d)
    return [*cuts, (start, len(histograms), at)]


def payloads(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts filled up with zeros to positive multiples of 64 bytes, on end, and their limits."""
    n = np.diff(at)
    full = np.maximum(64, -(-n // 64) * 64)
    limit = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(limit[-1], np.uint8)
    out[np.repeat(limit[:-1] - at[:-1], n) + np.arange(at[-1])] = data
    return out, limit


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each whole text's bytes as samples of the frames of an AVI file. Null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches, limit=1 << 20):
            flat, limit = payloads(data, at)
            n_rows = np.diff(limit) // 64
            counts = -(-n_rows // FRAME_ROWS)  # frames of each text
            height = np.minimum(n_rows, FRAME_ROWS)
            filled = counts * height  # rows, with those that fill the last frame
            to = np.concatenate([[0], np.cumsum(filled)])
            samples = np.zeros((int(to[-1]), 64), np.uint8)
            samples[np.repeat(to[:-1] - limit[:-1] // 64, n_rows) + np.arange(limit[-1] // 64)] = flat.reshape(-1, 64)
            frames = jpeg.encode_rows(samples, np.repeat(height, counts))
            first = np.concatenate([[0], np.cumsum(counts)])
            media = [avi(frames[first[i] : first[i + 1]], 8 * 64, int(height[i]) * 8, int(limit[i + 1] - limit[i])) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


CLIP = "array<struct<clip:int,start_s:double,end_s:double,first_frame:int,frames:int,cut:double>>"
MEDIA = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips {CLIP}, payload binary"


def read_media(media: DataFrame, id_col: str = "doc_id", with_payload: bool = False) -> DataFrame:
    """Reads ``(id, n_bytes, media)`` back: payload facts and timed clips.

    Frames are decoded from the stored bytes: those of flat blocks all at once, others block by block. Clips are the shots
    of the frames' luminance histograms. Null media, and what is no AVI file, is an error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [x.as_py() for x in batch.column(2)]
            at = 0
            while at < len(media):
                end, size = at, 0
                while end < len(media) and (end == at or size + len(media[end]) < 1 << 20):
                    size += len(media[end])
                    end += 1
                yield from read(batch.slice(at, end - at), media[at:end])
                at = end

    def read(batch: pa.RecordBatch, media: list[bytes]) -> Iterator[pa.RecordBatch]:
        files = [parse_avi(m) for m in media]
        images = [jpeg.Frame(f) for _, frames in files for f in frames]
        flat = [i for i, f in enumerate(images) if f.flat]
        kinds: dict[tuple, list[int]] = {}
        for i in flat:
            f = images[i]
            kinds.setdefault((f.width, f.tables[f.scan[f.parts[0][0]][0]], int(f.quant[f.parts[0][3]][0])), []).append(i)
        samples: list[np.ndarray | None] = [None] * len(images)
        for which in kinds.values():
            for i, s in zip(which, jpeg.decode_flat([images[i] for i in which]), strict=True):
                samples[i] = s
        for i, s in enumerate(samples):
            if s is None:
                samples[i] = jpeg.decode(images[i])
        out, k = [], 0
        for m, (facts, frames) in zip(media, files, strict=True):
            own = samples[k : k + len(frames)]
            k += len(frames)
            payload = b"".join(s.tobytes() for s in own)[: facts["payload"]]
            histogram = np.array([np.bincount(s.ravel() >> 2, minlength=64) for s in own]) if own else np.zeros((0, 64))
            clips = [{"clip": i, "start_s": a / facts["rate"], "end_s": b / facts["rate"], "first_frame": a, "frames": b - a, "cut": round(d, 6)} for i, (a, b, d) in enumerate(shots(histogram))]
            feature = f"{len(own)} frames;" + ",".join(f"{c['start_s']:.2f}-{c['end_s']:.2f}:{c['cut']:.4f}" for c in clips)
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, clips, payload if with_payload else None))
        clip = pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("cut", pa.float64())])
        kinds_ = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip), pa.binary())
        names = [x.split()[0] for x in MEDIA.replace(CLIP, "x").split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds_))], names=["id", "n_bytes", *names])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(work, f"id {kind}, n_bytes long, {MEDIA}").withColumnRenamed("id", id_col)


def clip_rows(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per shot: ``(id, clip, start_s, end_s, first_frame, frames, cut)``."""
    return read.select(id_col, F.explode("clips").alias("c")).select(id_col, "c.*")
