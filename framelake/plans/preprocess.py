"""From raw interleaved frames to the corrected signal, with its checks, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import channels as ch
from framelake.operators import checks, frames as fr
from framelake.sources import writers


@dataclass
class Preprocessed:
    """The tables of a run; all of them are lazy."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def write(self, path: str) -> None:
        writers.bundle(path, self.tables)


def preprocess(frames: DataFrame, times: DataFrame | None = None, *, edge: int = 0, bins: int = 2, window: int | None = None, use_means: bool = False, flip: bool = False, skip_start: int | None = None, skip_end: int | None = None, integers: bool = True, qa: bool = True, means_only: bool = False) -> Preprocessed:
    """frames as in ``framelake.layout``; times: session_id, frame_idx, ts_raw, micros.

    The window is, for each recording by itself, 30 s of frames or a quarter of the recording unless it is given. Binned frames are read by several tables: persist ``frames`` or write them
    between if they are costly to make.
    """
    kept = fr.spatial_bin(fr.crop(fr.skip(frames, skip_start, skip_end), edge), bins) if bins > 1 else fr.crop(fr.skip(frames, skip_start, skip_end), edge)
    stats = fr.statistics(kept)
    separated = ch.separate(stats, use_means, flip)
    two = ch.of_channels(kept, separated)
    out = Preprocessed({"frame_stats": stats, "channels": separated, "channel_means": ch.channel_series(two)})
    if means_only:
        return out
    if window is None:
        window = ch.session_windows(kept.select("session_id"))
    dff = ch.rolling_dff(ch.channel_traces(two), window, integers)
    change = ch.corrected(dff)
    series = ch.corrected_series(change)
    out.tables |= {
        "projections": fr.projections(two, "channel"),
        "channel_dff": dff.groupBy("session_id", "channel", "k").agg(F.avg("dff").alias("mean")),
        "change": change,
        "change_means": series,
        "change_max": change.groupBy("session_id", "y", "x").agg(F.max("value").alias("maxip")),
    }
    if times is not None:
        out.tables["change_times"] = ch.corrected_times(separated, times)
    if qa:
        noise = checks.noise_map(change.withColumn("frame_idx", F.col("k")))
        out.tables |= {
            "noise_levels": noise,
            "check_noise": checks.noise_check(noise),
            "check_snr": checks.snr(change, noise),
            "check_bleaching": checks.bleaching(series),
            "check_separation": checks.histogram_separation(stats, "mean" if use_means else "std"),
        }
        if times is not None:
            gaps = checks.intervals(times)
            out.tables |= {"check_consistency": checks.timestamp_consistency(gaps), "check_jumps": checks.timestamp_jumps(gaps)}
    return out
