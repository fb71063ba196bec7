"""Sample formats: interleaved floats as bytes and back."""

from __future__ import annotations

import numpy as np


#: What each byte of a cu8 sample stands for.
CU8 = ((np.arange(256) - 127.5) / 127.5).astype(np.float32)


def sample_bytes(datatype: str) -> int:
    """Bytes of one complex sample."""
    return 2 if datatype == "cu8" else 8


def decode(raw: bytes, datatype: str) -> np.ndarray:
    """Interleaved float samples of a cf32_le or cu8 byte string."""
    if datatype == "cu8":
        return CU8[np.frombuffer(raw, np.uint8)]
    if datatype == "cf32_le":
        return np.frombuffer(raw, "<f4").astype(np.float32)
    raise ValueError(f"cannot read samples of type {datatype!r}")


def encode(samples: np.ndarray, datatype: str) -> bytes:
    """Bytes of interleaved float samples."""
    if datatype == "cu8":
        return np.clip(np.round(samples * 127.5 + 127.5), 0, 255).astype(np.uint8).tobytes()
    if datatype == "cf32_le":
        return samples.astype("<f4").tobytes()
    raise ValueError(f"cannot write samples of type {datatype!r}")
