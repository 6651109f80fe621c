"""Chunk layout arithmetic as column expressions: segment counts, frame lengths, milliseconds, presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The model family's numbers that existing payloads depend on.
SAMPLE_RATE = 48_000
LEGACY_LAYOUTS = (63_998, 86_400)  # tried in this order for payloads without a stored layout, at 48 kHz
CARDINALITY = 1_024
LOGIT_STEP = 1 / 64
ENTROPY_LOGIT_STEP = 2.0999999046325684  # 2.1 held in single precision


def whole_div(a: Column, b) -> Column:
    """Integer division of longs, in ``bigint`` throughout."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("long"), b.cast("long"))


def ceil_div(a: Column, b) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return whole_div(a + b - 1, b)


def segment_count(total: Column, stride) -> Column:
    """How many segments begin below ``total``; a stride below one counts as one."""
    stride = F.greatest(stride if isinstance(stride, Column) else F.lit(stride), F.lit(1))
    return F.when(total > 0, ceil_div(total, stride)).otherwise(F.lit(0).cast("long"))


def segment_starts(total: Column, stride) -> Column:
    """array<bigint> of 0, stride, 2 * stride ... below ``total``; empty for an empty signal."""
    stride = F.greatest(stride if isinstance(stride, Column) else F.lit(stride), F.lit(1)).cast("long")
    return F.when(total > 0, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1, stride)).otherwise(F.array().cast("array<bigint>"))


def frame_length(samples: Column, segment_samples, frames) -> Column:
    """ceil(samples * frames / segment_samples) in whole numbers."""
    return ceil_div(samples * F.lit(frames), segment_samples)


def model_frame_length(stored: Column, samples: Column, segment_samples, frames) -> Column:
    """The stored length if it is positive, else :func:`frame_length`."""
    return F.coalesce(F.when(stored > 0, stored).cast("long"), frame_length(samples, segment_samples, frames))


def samples_of_ms(ms: Column, rate=SAMPLE_RATE) -> Column:
    """Milliseconds to samples, rounded; null for values that aren't positive, finite and at least one sample."""
    raw = ms.cast("double") * F.lit(rate) / F.lit(1000.0)
    return F.when((ms > 0) & (raw < F.lit(9.0e18)) & ~F.isnan(ms.cast("double")) & (raw >= 1), F.round(raw).cast("long"))


def packet_size_of_ms(ms: Column, rate=SAMPLE_RATE, most: int = 4_095) -> Column:
    """Samples of a packet of so many whole milliseconds, at least one; null beyond ``most``, which a packet's header can't hold."""
    n = F.greatest(whole_div(ms.cast("long") * F.lit(rate), 1000), F.lit(1).cast("long"))
    return F.when(n <= most, n)


def resolve_layout(stored_samples: Column, stored_stride: Column, samples, stride) -> Column:
    """struct(samples, stride, valid): stored values before the model's; zero isn't valid."""
    a, b = F.coalesce(stored_samples, F.lit(samples)).cast("long"), F.coalesce(stored_stride, F.greatest(F.lit(stride), F.lit(1))).cast("long")
    return F.struct(a.alias("samples"), b.alias("stride"), ((a != 0) & (b != 0)).alias("valid"))


def layout_for_count(total: Column, chunks: Column, samples: int, stride: int, rate: int = SAMPLE_RATE) -> Column:
    """struct(samples, stride) of the first candidate that gives ``chunks`` chunks, null if none does."""
    candidates = [(samples, max(1, stride)), *[(n, n) for n in LEGACY_LAYOUTS if rate == SAMPLE_RATE]]
    out = F.lit(None).cast("struct<samples:bigint,stride:bigint>")
    for a, b in reversed(candidates):
        out = F.when(segment_count(total, b) == chunks, F.struct(F.lit(a).cast("long").alias("samples"), F.lit(b).cast("long").alias("stride"))).otherwise(out)
    return out


def bandwidth_preset(kbps: Column) -> Column:
    """6 or 12 (null: 6); null for a bandwidth that has no preset."""
    return F.when(kbps.isNull() | (F.abs(kbps - 6.0) <= 0.001), 6).when(F.abs(kbps - 12.0) <= 0.001, 12)


def chunk_preset(ms: Column) -> Column:
    """1333 or 1800 (null: 1333); null for a duration that has no preset."""
    return F.when(ms.isNull() | (F.abs(ms - 1333.0) <= 5.0) | (F.abs(ms - 1333.3) <= 5.0), 1333).when(F.abs(ms - 1800.0) <= 5.0, 1800)


def bits_per_codebook(bits: Column, codebook: Column, model: Column) -> Column:
    return F.coalesce(bits.cast("long"), F.floor(F.log2(F.coalesce(codebook, model, F.lit(CARDINALITY)).cast("double")) + 1e-9))


def model_cardinality(codebook: Column, model: Column) -> Column:
    return F.coalesce(model, codebook, F.lit(CARDINALITY)).cast("long")


def entropy_logit_step(step: Column, entropy_step: Column) -> Column:
    return F.greatest(F.coalesce(step, F.lit(LOGIT_STEP)), F.coalesce(entropy_step, F.lit(ENTROPY_LOGIT_STEP)))
