"""Media columns: audio features.

A clip is polyphase-resampled, cut into overlapped frames, turned into log-mel bands and segmented by an
energy threshold with hysteresis. Bands are kept in fixed-shape Arrow tensors, one per tile of frames, each
with its time span. A clip is worked through in steps of STEP frames, so that beside its bytes only its bands
and energies are held; bands are stored in steps of 1 / GRAIN.

Defined results: a null or empty clip has no frame, no tensor and no segment; repeated rows get equal values;
columns other than the id and the clip are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from tapeloom.llm.textbuf import buffers, flat

BLOCK = 576
STORED_RATE, RATE = 24_000, 16_000
FRAME, HOP, FFT, MELS, TILE = 400, 160, 512, 40, 32
RISE_DB, FALL_DB = 1.0, -1.0
STEP, GRAIN = 8192, 64

FEATURE_SCHEMA = "id long, n_samples long, rate int, n_frames int, tensors binary, segments array<struct<start_s:double,end_s:double>>"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, n_segments int"


def wav_bytes(samples: bytes, rate: int = STORED_RATE) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    pad = len(samples) & 1
    fmt = b"fmt " + (16).to_bytes(4, "little") + b"\x01\x00\x01\x00" + rate.to_bytes(4, "little") * 2 + b"\x01\x00\x08\x00"
    body = b"WAVE" + fmt + b"data" + len(samples).to_bytes(4, "little") + samples + b"\x00" * pad
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """The samples of an unsigned 8-bit mono WAVE file, and their rate."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            if media[at + 8 : at + 12] != b"\x01\x00\x01\x00" or media[at + 22 : at + 24] != b"\x08\x00":
                raise ValueError("not 8-bit mono PCM")
            rate = int.from_bytes(media[at + 12 : at + 16], "little")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def polyphase_taps(up: int, down: int, lobes: int = 6) -> np.ndarray:
    """A Kaiser-windowed low-pass for resampling by up/down, as one row of taps per phase."""
    half = lobes * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) / max(up, down) * np.kaiser(len(t), 8.0) * up
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    return np.ascontiguousarray(h.reshape(-1, up).T.astype(np.float32))


def resample(x: np.ndarray, up: int, down: int, taps: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
    """y[n] = sum over j of taps[phase, j] * x[base - j], with phase and base from n * down + delay, for n from first to end.

    x is silent outside; first is a multiple of up.
    """
    n_out = -(-len(x) * up // down)
    end = n_out if end is None else min(end, n_out)
    if up == down or not len(x):
        return x[first:end]
    width = taps.shape[1]
    delay = (width * up - 1) // 2
    shift = first * down // up  # a whole number, as first is a multiple of up
    low, high = shift - width, ((end - 1) * down + delay) // up + 2
    padded = np.concatenate([np.zeros(max(0, -low), np.float32), x[max(0, low) : max(0, high)], np.zeros(max(0, high - max(len(x), 0)) + down, np.float32)])
    frames = sliding_window_view(padded, width)
    out = np.empty(max(0, end - first), np.float32)
    for r in range(min(up, len(out))):
        count = len(range(r, len(out), up))
        base, phase = divmod(r * down + delay, up)
        out[r::up] = frames[base + 1 :: down][:count] @ taps[phase, ::-1]
    return out


def mel_matrix(rate: int, bands: int = MELS, fft: int = FFT) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


class Frontend:
    """Tables of one pair of rates."""

    def __init__(self, stored_rate: int, rate: int):
        g = math.gcd(stored_rate, rate)
        self.rate, self.up, self.down = rate, rate // g, stored_rate // g
        self.taps, self.mel = polyphase_taps(self.up, self.down), mel_matrix(rate)
        self.window = np.hanning(FRAME).astype(np.float32)

    def bands(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-mel bands (frames x MELS) and the energy of each frame in decibels; the last frame is zero-padded."""
        size = -(-len(samples) * self.up // self.down)
        n = 1 + max(0, -(-(size - FRAME) // HOP)) if size else 0
        bands, energy = np.zeros((n, MELS), np.float32), np.zeros(n, np.float32)
        for lo in range(0, n, STEP):
            hi = min(n, lo + STEP)
            first = lo * HOP // self.up * self.up
            x = self.resampled(samples, first, (hi - 1) * HOP + FRAME)[lo * HOP - first :]
            x = np.concatenate([x, np.zeros(max(0, (hi - lo - 1) * HOP + FRAME - len(x)), np.float32)])
            frames = sliding_window_view(x, FRAME)[::HOP][: hi - lo]
            power = np.abs(np.fft.rfft(frames * self.window, FFT)) ** 2
            energy[lo:hi] = 10 * np.log10((frames * frames).mean(1) + 1e-10)
            bands[lo:hi] = np.round(np.log(power.astype(np.float32) @ self.mel + 1e-6) * GRAIN) / GRAIN
        return bands, energy

    def resampled(self, samples: np.ndarray, first: int, end: int) -> np.ndarray:
        """The clip at the new rate, from place first to end; only the samples around them are made floats."""
        edge = self.taps.shape[1] + self.down
        low = max(0, (first * self.down // self.up - edge) // self.down * self.down)
        part = samples[low : end * self.down // self.up + edge]
        skip = low // self.down * self.up
        size = -(-len(samples) * self.up // self.down)
        return resample((part.astype(np.float32) - 128) / 128, self.up, self.down, self.taps, first - skip, min(end, size) - skip)

    def segments(self, energy: np.ndarray) -> list[tuple[float, float]]:
        """Spans in seconds that begin RISE_DB above the mean energy and last until FALL_DB below it."""
        if not len(energy):
            return []
        level = energy - energy.mean()
        mark = np.where(level > RISE_DB, 1, np.where(level < FALL_DB, -1, 0))
        last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
        on = np.concatenate([[False], (last >= 0) & (mark[last] == 1), [False]])
        edge = np.flatnonzero(on[1:] != on[:-1])
        return [(a * HOP / self.rate, ((b - 1) * HOP + FRAME) / self.rate) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]

    def tensors(self, bands: np.ndarray) -> pa.RecordBatch:
        """Tiles of TILE frames as a fixed-shape tensor column with time spans; `frames` counts a tile's real ones."""
        n = -(-len(bands) // TILE)
        tiles = np.zeros((n, TILE, MELS), np.float32)
        tiles.reshape(n * TILE, MELS)[: len(bands)] = bands
        first = np.arange(n) * TILE
        frames = np.minimum(TILE, len(bands) - first)
        kind = pa.fixed_shape_tensor(pa.float32(), (TILE, MELS), dim_names=("frame", "mel"))
        column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(tiles.reshape(-1)), TILE * MELS))
        return pa.record_batch({"start_s": pa.array(first * HOP / self.rate), "end_s": pa.array(((first + frames - 1) * HOP + FRAME) / self.rate), "frames": pa.array(frames, pa.int32()), "log_mel": column})


def ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def _features(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fronts: dict[int, Frontend] = {}
        for batch in batches:
            media = flat(batch.column(1))
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for key, clip in zip(batch.column(0)[lo : lo + 256].to_pylist(), media[lo : lo + 256], strict=True):
                    samples, stored = wav_samples(clip.as_py()) if len(clip.as_buffer()) else (b"", rate)
                    front = fronts.setdefault(stored, Frontend(stored, rate))
                    bands, energy = front.bands(np.frombuffer(samples, np.uint8))
                    rows.append((key, len(samples), stored, len(bands), ipc(front.tensors(bands)), [{"start_s": a, "end_s": b} for a, b in front.segments(energy)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), strict=True)], names=["id", "n_samples", "rate", "n_frames", "tensors", "segments"])

    return run


def audio_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", rate: int = RATE) -> DataFrame:
    """Per WAVE clip: sample count, stored rate, frames, an Arrow IPC stream of log-mel tensors with spans, energy segments."""
    return df.select(df[id_col].cast("long").alias("id"), df[media_col].alias("media")).mapInArrow(_features(rate), FEATURE_SCHEMA)


def payload(text: bytes) -> bytes:
    """The bytes, and bytes 255 up to a positive multiple of BLOCK."""
    return text + b"\xff" * (BLOCK if not text else -len(text) % BLOCK)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    front = Frontend(STORED_RATE, RATE)
    for batch in batches:
        data, offs = buffers(flat(batch.column(1)))
        rows = []
        for key, a, b in zip(batch.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            media = wav_bytes(payload(data[a:b].tobytes()))
            back, _ = wav_samples(media)
            bands, energy = front.bands(np.frombuffer(back, np.uint8))
            tensor, spans = front.tensors(bands), front.segments(energy)
            mean, spread = bands.mean(0, dtype=np.float64), bands.std(0, dtype=np.float64).mean()
            # the stored tensor, as the bytes that a reader would get
            stored = hashlib.sha256(ipc(tensor)).hexdigest()[:16]
            said = f"frames={len(bands)};tiles={tensor.num_rows};tensor={stored};mel={','.join(f'{x:.1f}' for x in mean)};std={spread:.1f};spans={','.join(f'{x:.2f}-{y:.2f}' for x, y in spans)}"
            rows.append((key, b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), said, len(bands), len(spans)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGEST_SCHEMA.split(", ")])


def text_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text's bytes as an 8-bit WAVE clip, read the clip back and describe it.

    A null text is empty; its payload is one block of bytes 255.
    """
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(_digest, DIGEST_SCHEMA)
