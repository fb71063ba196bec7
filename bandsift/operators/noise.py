"""Noise floors: per frame, smoothed per session, and per bin."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.functions.arrays import frame_floor_of
from bandsift.operators.ordered import Fold, affine_scan, attach, columns_of, fold_sorted


def frame_floor(frames: DataFrame) -> DataFrame:
    """Add `frame_floor_db`; no shuffle."""
    return frames.withColumn("frame_floor_db", frame_floor_of(F.col("power_db")))


def check_alpha(alpha: float) -> float:
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    return float(alpha)


def ema_floor(
    frames: DataFrame, alpha: float = P.FLOOR_ALPHA, width: int = P.CHUNK_FRAMES
) -> DataFrame:
    """Smoothed floor per (session, frame): the first frame seeds it and every frame's
    floor already includes that frame.

    The smoothing is an affine recurrence, so it runs as a scan over chunks of frames.
    Only (session, frame, floor) travels; join it back where the spectrum is needed.
    """
    alpha = check_alpha(alpha)
    floors = frames.select(
        "session_id", "frame_seq", frame_floor_of(F.col("power_db")).alias("x")
    ).select(
        "session_id",
        "frame_seq",
        F.lit(1.0 - alpha).alias("a"),
        (F.col("x") * alpha).alias("b"),
        "x",
    )
    seed = floors.groupBy("session_id").agg(F.min_by("x", "frame_seq").alias("seed"))
    states = affine_scan(floors.drop("x"), ["session_id"], "frame_seq", "a", "b", seed, width)
    return states.select(
        "session_id",
        "frame_seq",
        (F.col("a") * F.col("state_before") + F.col("b")).alias("floor_db"),
    )


def with_floor(
    frames: DataFrame, alpha: float = P.FLOOR_ALPHA, width: int = P.CHUNK_FRAMES
) -> DataFrame:
    """Frames with their smoothed `floor_db`."""
    floors = ema_floor(frames, alpha, width)
    return attach(frames, floors, ["session_id", "frame_seq"], how="inner")


def bin_blocks(frames: DataFrame, block_bins: int = 32, carried: Sequence[str] = ()) -> DataFrame:
    """Cut each spectrum into blocks of neighbouring bins; bins never interact."""
    last = F.floor((F.size("power_db") - 1) / F.lit(block_bins)).cast("int")
    return frames.withColumn(
        "bin_block", F.explode(F.sequence(F.lit(0), last))
    ).select(
        "session_id",
        "bin_block",
        (F.col("bin_block") * block_bins).alias("first_bin"),
        "segment_start",
        "frame_id",
        "frame_start",
        "f0_hz",
        "bin_hz",
        "seed_frames",
        F.slice("power_db", F.col("bin_block") * block_bins + 1, block_bins).alias("power_db"),
        *carried,
    )


def next_bin_noise(
    noise: np.ndarray, power: np.ndarray, threshold_db: float, alpha: float
) -> np.ndarray:
    step = np.clip(power - noise, P.NOISE_STEP_DOWN_DB, P.NOISE_STEP_UP_DB)
    return np.where(power < noise + threshold_db, noise + alpha * step, noise)


class BinNoiseFold(Fold):
    """Floor of one block of bins. The first block's frames are held until all are there.

    Frames of another tuning (place, width or number of bins) begin a new floor.
    """

    threshold_db = P.EVIDENCE_THRESHOLD_DB
    alpha = P.NOISE_ALPHA

    def __init__(self, key: tuple):
        super().__init__(key)
        self.noise: np.ndarray | None = None
        self.held: list[tuple] = []
        self.index = 0
        self.tuning: tuple | None = None

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        own = [rows.column("f0_hz"), rows.column("bin_hz"), pc.list_value_length(rows.column("power_db"))]
        tuned = np.stack([np.asarray(c, dtype=np.float64) for c in own], axis=1)
        edges = np.flatnonzero((tuned[1:] != tuned[:-1]).any(axis=1)) + 1
        out: list[tuple] = []
        for low, high in zip([0, *edges], [*edges, len(tuned)], strict=True):
            if self.tuning is not None and tuple(tuned[low]) != self.tuning:
                out += self.finish()
                self.noise, self.held, self.index = None, [], 0
            self.tuning = tuple(tuned[low])
            out += self.take(rows.slice(low, high - low))
        return out

    def take(self, rows: pa.RecordBatch) -> list[tuple]:
        bins = rows.column("power_db")
        power = bins.flatten().to_numpy().reshape(len(bins), -1)
        frames = list(zip(columns_of(rows, _FRAME_COLUMNS), power, strict=True))
        if self.noise is None:
            self.held += frames
            if len(self.held) < rows.column("seed_frames")[0].as_py():
                return []
            frames, self.held = self.held, []
            self.seed(frames[: rows.column("seed_frames")[0].as_py()])
        return self.advance(frames)

    def finish(self) -> list[tuple]:
        if not self.held:
            return []
        self.seed(self.held)
        return self.advance(self.held)

    def seed(self, frames: list[tuple]) -> None:
        first = np.stack([power for _, power in frames])
        self.noise = np.percentile(first, P.NOISE_SEED_PERCENTILE, axis=0)

    def advance(self, frames: list[tuple]) -> list[tuple]:
        out = []
        for meta, power in frames:
            out.append((*self.key, *meta, self.index, power, self.noise))
            self.noise = next_bin_noise(self.noise, power, self.threshold_db, self.alpha)
            self.index += 1
        return out


BIN_NOISE_SCHEMA = (
    "session_id BIGINT, bin_block INT, first_bin INT, segment_start BIGINT, frame_id BIGINT, "
    "frame_start BIGINT, f0_hz DOUBLE, bin_hz DOUBLE, frame_index BIGINT, "
    "power_db ARRAY<DOUBLE>, noise_db ARRAY<DOUBLE>"
)
_FRAME_COLUMNS = ["first_bin", "segment_start", "frame_id", "frame_start", "f0_hz", "bin_hz"]


def bin_noise_floor(
    frames: DataFrame,
    threshold_db: float = P.EVIDENCE_THRESHOLD_DB,
    alpha: float = P.NOISE_ALPHA,
    block_bins: int = 32,
) -> DataFrame:
    """Per-bin adaptive floor as it stood before each frame.

    Seeded from the 20th percentile of the first block's frames (`seed_frames` of them);
    quiet bins move by alpha times a clipped step, occupied bins stay.
    """

    def start(key: tuple) -> BinNoiseFold:
        fold = BinNoiseFold(key)
        fold.threshold_db, fold.alpha = threshold_db, alpha
        return fold

    return fold_sorted(
        bin_blocks(frames, block_bins),
        ["session_id", "bin_block"],
        ["frame_start"],
        start,
        BIN_NOISE_SCHEMA,
    )
