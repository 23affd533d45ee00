"""Column functions on sample arrays and PCM bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def rms(samples: Column) -> Column:
    """Root of the mean square, 0 for no samples; summed in double."""
    total = F.aggregate(samples, F.lit(0.0), lambda z, x: z + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def pcm_rms(pcm: pd.Series) -> pd.Series:
    """The same of little-endian 16-bit PCM; a last odd byte is ignored."""
    return pcm.map(lambda b: float(np.sqrt(np.mean(np.square(np.frombuffer(b, "<i2", len(b) // 2).astype(float))))) if b is not None and len(b) > 1 else 0.0)


def pcm_seconds(n_bytes: Column, rate: Column | int, channels: Column | int) -> Column:
    return n_bytes / ((F.lit(rate) if isinstance(rate, int) else rate) * channels * 2)


def trimmed(samples: Column, rate: int, skip: float = 3.0, seconds: float = 15.0) -> Column:
    """The samples of so many seconds after the skipped ones."""
    return F.slice(samples, int(skip * rate) + 1, int(seconds * rate))


def _little(n: Column, size: int) -> Column:
    """A number as so many bytes, the lowest first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(size))))


def wav_header(n: Column, rate: Column | int, channels: Column | int) -> Column:
    """The 44 bytes before n bytes of 16-bit PCM."""
    rate, channels = (F.lit(x) if isinstance(x, int) else x for x in (rate, channels))
    form = (F.lit(b"WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(channels, 2), _little(rate, 4), _little(rate * channels * 2, 4), _little(channels * 2, 2), _little(F.lit(16), 2))
    return F.concat(F.lit(b"RIFF"), _little(36 + n + n % 2, 4), *form, F.lit(b"data"), _little(n, 4))


def wav(payload: Column, rate: Column | int, channels: Column | int) -> Column:
    """A WAV file of 16-bit PCM: the header, the bytes, and a zero byte after an odd number of them. Up to 4 GB."""
    data = F.coalesce(payload, F.lit(b""))
    n = F.octet_length(data)
    return F.concat(wav_header(n, rate, channels), data, F.when(n % 2 == 1, F.lit(b"\x00")).otherwise(F.lit(b"")))


def wav_payload(content: Column) -> Column:
    """The sound of a file that `wav` has made."""
    said = F.hex(F.substring(content, 41, 4))
    n = F.conv(F.concat(*(F.substring(said, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("int")
    return F.substring(content, F.lit(45), n)
