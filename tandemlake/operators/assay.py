"""The run of assays: channels to markers, ladders to sizes, peaks called, checked and binned. Steps over tables of all
assays at once; each gives new tables.

channels: assay_id, channel_id, dye, data; signals: assay_id, channel_id, levels (map from times to the trace's values).
assays: assay_id, panel, exclude (array of lower-case marker codes or null).
panels: panel, ladder, marker, dye (`tabular.panel_markers`). ladders: ladder, dye, sizes. markers: marker_id, code,
repeats, min_size, max_size, bins. peaks: peak_id, assay_id, channel_id, marker, rtime, height, ..., peak_type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalar import ladder_reports, ladder_score
from ..model import LADDER_DYE, LADDERS
from ..shipping import ship
from ..storage import cut
from .ladder import LadderParams, fit_ladder, fit_score
from .peaks import bin_alleles, overlaps, size_peaks, stutter
from .signal import PEAK, ScanParams, peak_rows

UNDEFINED = "undefined"
#: Ladder scores from which an assay's other channels are scanned, its peaks called, and checked for stutter and overlap.
SCAN_SCORE, CALL_SCORE, CHECK_SCORE = 0.9, 0.5, 0.9
LADDER = "channel_id bigint, z array<double>, rss double, dpscore double, used int, n_sizes int, first_rtime int, last_rtime int, height double, failure string, peaks array<struct<rtime:int,height:double,size:double,peak_type:string>>"
#: A row an assay: its ladders, the peaks of its other channels, and of channels with peaks the levels at the times of all of them.
SCANNED = f"assay_id bigint, ladders array<struct<{LADDER}>>, peaks array<struct<{PEAK}, marker string>>, signals array<struct<channel_id bigint, levels map<int,double>>>"


@dataclass(frozen=True)
class RunParams:
    scan: ScanParams = ScanParams(min_height=1.0)
    ladder_scan: ScanParams = field(default_factory=lambda: replace(ScanParams(), min_height=1.0, min_snr=0.25, max_peaks=0))
    ladder: LadderParams = LadderParams()
    min_size: float = 70
    max_size: float = 600
    stutter: float = 1.25


def ladder_table(spark: SparkSession) -> DataFrame:
    """ladder, dye, sizes of the known ladders."""
    rows = [F.struct(F.lit(k).alias("ladder"), F.lit(LADDER_DYE).alias("dye"), F.array(*[F.lit(float(x)) for x in v]).alias("sizes")) for k, v in LADDERS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def assign_channels(channels: DataFrame, assays: DataFrame, panels: DataFrame, ladders: DataFrame) -> DataFrame:
    """The channels with marker and status, and with sizes where they are their panel's ladder.

    channel-ladder: the ladder's dye. channel-clean: the panel has a marker of the dye. channel-unassigned, with the
    marker `undefined`: it has none, or the assay excludes it. Dyes match in any case; assays of unknown panels have only
    unassigned channels.
    """
    dyes = panels.select("panel", F.upper("dye").alias("_dye"), F.col("marker").alias("_marker"))
    ladder_of = panels.select("panel", "ladder").distinct().join(ladders.select("ladder", F.upper("dye").alias("_ladder_dye"), F.col("sizes").alias("_sizes")), "ladder").drop("ladder")
    rows = channels.drop("marker", "status", "sizes").join(assays.select("assay_id", "panel", "exclude"), "assay_id", "left").withColumn("_dye", F.upper("dye"))
    rows = rows.join(F.broadcast(ladder_of), "panel", "left").join(F.broadcast(dyes), ["panel", "_dye"], "left")  # a row a marker of a panel
    is_ladder = F.coalesce(F.col("_dye") == F.col("_ladder_dye"), F.lit(False))
    excluded = F.coalesce(F.array_contains("exclude", F.lower("_marker")), F.lit(False))
    marker = F.when(~is_ladder & ~excluded, F.col("_marker"))
    status = F.when(is_ladder, "channel-ladder").when(marker.isNotNull(), "channel-clean").otherwise("channel-unassigned")
    found = rows.withColumn("marker", F.coalesce(marker, F.lit(UNDEFINED))).withColumn("status", status).withColumn("sizes", F.when(is_ladder, F.col("_sizes")))
    return found.drop("panel", "exclude", "_dye", "_marker", "_ladder_dye", "_sizes")


def ladder_row(channel: int, y: np.ndarray, sizes: list[float], params: RunParams) -> tuple:
    """The ladder of a trace in the columns of LADDER."""
    rows = [r for r in peak_rows(channel, y, params.ladder_scan) if r[9] == "peak-scanned"] if len(y) else []
    times, heights = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    fit = fit_ladder(list(sizes), times, heights, params.ladder)
    size = {j: s for s, j in fit.pairs}
    peaks = [
        {"rtime": int(times[j]), "height": float(heights[j]), "size": size.get(j, -1.0), "peak_type": "peak-ladder" if j in size else "peak-unassigned"}
        for j in range(len(rows))
    ]
    used = sorted(int(times[j]) for j in size)
    return (channel, fit.z or None, fit.rss, fit.dpscore, len(used), len(sizes), used[0] if used else None, used[-1] if used else None, fit.height, fit.report or None, peaks)


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(", ")]


def _scored(found: DataFrame) -> DataFrame:
    """assay_id and the columns of LADDER with score and report."""
    failed = F.col("z").isNull()
    report = F.when(failed, F.col("failure")).otherwise(F.concat_ws("|", ladder_reports(F.col("rss"), F.col("used"), F.col("n_sizes")), F.format_string("Height = %d", F.col("height").cast("int"))))
    score = F.when(failed, 0.0).otherwise(ladder_score(F.col("rss"), F.col("used"), F.col("n_sizes")))
    return found.select("assay_id", "channel_id", "z", "rss", "dpscore", score.alias("score"), report.alias("report"), "used", "n_sizes", "first_rtime", "last_rtime", "peaks")


def scan_ladders(channels: DataFrame, params: RunParams = RunParams()) -> DataFrame:
    """assay_id, channel_id, z, rss, dpscore, score, report, used, first_rtime, last_rtime, peaks of each ladder channel.

    z is null and score 0 where the ladder is not found; rss and dpscore are -1 then.
    """
    ship(channels.sparkSession)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(assay, *ladder_row(channel, np.asarray([] if y is None else y, float), sizes, params)) for assay, channel, y, sizes in zip(f["assay_id"], f["channel_id"], f["data"], f["sizes"])]
            yield pd.DataFrame(out, columns=["assay_id", *_names(LADDER)]).astype({"first_rtime": "Int32", "last_rtime": "Int32"})

    ladders = channels.filter("status = 'channel-ladder'")
    return _scored(ladders.select("assay_id", "channel_id", "data", "sizes").mapInPandas(scan, f"assay_id bigint, {LADDER}"))


def scan_channels(channels: DataFrame, ladders: DataFrame, params: RunParams = RunParams(), least: float = SCAN_SCORE) -> DataFrame:
    """Peaks of all channels but the ladders', of assays whose ladder scores `least` at least."""
    ship(channels.sparkSession)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for k, y in zip(f["channel_id"], f["data"]) if y is not None and len(y) for r in peak_rows(k, np.asarray(y, float), params.scan)]
            yield pd.DataFrame(rows, columns=_names(PEAK))

    wanted = channels.filter("status <> 'channel-ladder'").join(ladders.filter(F.col("score") >= least).select("assay_id"), "assay_id", "left_semi")
    found = wanted.select("channel_id", "data").mapInPandas(scan, PEAK)
    of = wanted.select("channel_id", "assay_id", "marker")
    return found.join(of, "channel_id").withColumn("peak_id", F.xxhash64("channel_id", "rtime"))


def scan_assays(channels: DataFrame, params: RunParams = RunParams(), least: float = SCAN_SCORE) -> DataFrame:
    """SCANNED: what `scan_ladders` and `scan_channels` find, and the levels that `check_peaks` asks for.

    The channels of an assay meet in one task, so traces are read once and only what is found leaves it. Where channels
    are placed by assay already (`repartition(n, "assay_id")`, such as of the rows or files that traces are made from)
    no trace is shuffled or written.
    """
    ship(channels.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(SCANNED))
    at = _names(LADDER).index

    def one(rows: pa.Table) -> tuple:
        """The row of an assay."""
        columns = rows.select(["channel_id", "status", "marker", "sizes"]).to_pylist()
        traces = rows["data"].combine_chunks()
        ladders: dict[int, tuple] = {}
        peaks: list[tuple] = []
        found: dict[int, list[tuple]] = {}
        mine: dict[int, pa.Array] = {}

        def numbers(i: int) -> np.ndarray:
            return np.asarray(traces[i].values.to_numpy(zero_copy_only=False), float) if traces[i].is_valid else np.empty(0)

        for i, c in enumerate(columns):
            if c["status"] == "channel-ladder" and c["channel_id"] not in ladders:
                ladders[c["channel_id"]] = ladder_row(c["channel_id"], numbers(i), c["sizes"], params)
        if any(r[at("z")] is not None and fit_score(r[at("rss")], r[at("used")], r[at("n_sizes")]) >= least for r in ladders.values()):
            for i, c in enumerate(columns):
                k = c["channel_id"]
                if c["status"] != "channel-ladder":
                    if k not in found:
                        y = numbers(i)
                        found[k], mine[k] = (peak_rows(k, y, params.scan) if len(y) else []), traces[i].values
                    peaks += [(*r, c["marker"]) for r in found[k]]
        times = sorted({r[1] for got in found.values() for r in got})
        signals = []
        for k, got in found.items():
            if got:
                own = [t for t in times if t < len(mine[k])]
                levels = mine[k].take(pa.array(own, pa.int64())).to_pylist()
                signals.append({"channel_id": k, "levels": [(t, v) for t, v in zip(own, levels) if v is not None]})
        return [dict(zip(_names(LADDER), r)) for r in ladders.values()], [dict(zip([*_names(PEAK), "marker"], r)) for r in peaks], signals

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []  # of an assay that goes on in the next batch
        for batch in batches:
            table = pa.concat_tables([*rest, pa.Table.from_batches([batch])])
            begin, ids, out = 0, table["assay_id"].to_pylist(), []
            while begin < len(ids) and (end := begin + table["channels"][begin].as_py()) <= len(ids):
                if ids[begin:end] != ids[begin : begin + 1] * (end - begin):
                    raise ValueError(f"the channels of assay {ids[begin]} are not together")
                out.append((ids[begin], *one(table.slice(begin, end - begin))))
                begin = end
            rest = [table.slice(begin)] if begin < len(ids) else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    # A window needs the rows of an assay in one task and side by side, and shuffles only those that aren't.
    known = channels.filter("assay_id IS NOT NULL").withColumn("channels", F.count("*").over(Window.partitionBy("assay_id")))
    return known.select("assay_id", "channels", "channel_id", "status", "marker", "sizes", "data").mapInArrow(scan, SCANNED)


def scanned_ladders(scanned: DataFrame) -> DataFrame:
    """The ladders of `scan_assays`, as `scan_ladders` gives them."""
    return _scored(scanned.select("assay_id", F.inline("ladders")))


def scanned_peaks(scanned: DataFrame) -> DataFrame:
    """The peaks of `scan_assays`, as `scan_channels` gives them."""
    return scanned.select("assay_id", F.inline("peaks")).select(*_names(PEAK), "assay_id", "marker", F.xxhash64("channel_id", "rtime").alias("peak_id"))


def call_peaks(peaks: DataFrame, ladders: DataFrame, params: RunParams = RunParams(), least: float = CALL_SCORE) -> DataFrame:
    """Sizes, values and types of the peaks of assays whose ladder scores `least` at least; other peaks stay as they are.

    Inside the ladder and within the sizes a peak is called, or stutter beside a higher called one; else unassigned.
    """
    good = ladders.filter((F.col("score") >= least) & F.col("z").isNotNull()).select("assay_id", "z", "first_rtime", "last_rtime")
    bare = peaks.drop("size", "value")
    sized = size_peaks(bare, good, params.min_size, params.max_size)
    called = stutter(sized.filter("peak_type = 'peak-called'"), params.stutter)
    rest = sized.filter("peak_type <> 'peak-called'")
    left = bare.join(good, "assay_id", "left_anti").withColumns({"size": F.lit(None).cast("double"), "value": F.lit(None).cast("int")})
    return called.unionByName(rest).unionByName(left)


def check_peaks(peaks: DataFrame, channels: DataFrame, ladders: DataFrame, params: RunParams = RunParams(), least: float = CHECK_SCORE) -> DataFrame:
    """Stutter and overlap of called and binned peaks, of assays whose ladder scores `least` at least. channels: traces or signals."""
    sound = F.col("peak_type").isin("peak-called", "peak-bin")
    seen = peaks.filter(sound).join(ladders.filter(F.col("score") >= least).select("assay_id"), "assay_id", "left_semi")
    marked = stutter(seen, params.stutter).filter("peak_type = 'peak-stutter'").select("peak_id", F.lit("peak-stutter").alias("_new"))
    hidden = overlaps(seen, channels).select("peak_id", F.lit("peak-overlap").alias("_new"))
    # A stutter peak is no longer a called one, so it isn't checked for overlap.
    new = hidden.join(marked, "peak_id", "left_anti").unionByName(marked)
    return peaks.join(new, "peak_id", "left").withColumn("peak_type", F.coalesce("_new", "peak_type")).drop("_new")


def bin_peaks(peaks: DataFrame, markers: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Sized peaks of the markers (of `codes`, if given) take the nearest bin; overlapping ones too. Others stay."""
    named = markers if codes is None else markers.filter(F.col("code").isin(*codes))
    mine = peaks.join(F.broadcast(named.select("marker_id", F.col("code").alias("marker"))), "marker")  # a row a marker
    sized = F.col("size") > 0
    ready = mine.withColumn("peak_type", F.when(sized & (F.col("peak_type") != "peak-overlap"), "peak-called").otherwise(F.col("peak_type")))
    binned = bin_alleles(ready, named.drop("code"))
    others = peaks.join(F.broadcast(named.select(F.col("code").alias("marker"))), "marker", "left_anti")
    return binned.unionByName(others, allowMissingColumns=True)


def process(
    channels: DataFrame, assays: DataFrame, panels: DataFrame, ladders: DataFrame, markers: DataFrame, params: RunParams = RunParams(),
    keep: Callable[[DataFrame], DataFrame] = cut,
) -> dict[str, DataFrame]:
    """channels, ladders and peaks of a whole run: assigned, scanned, called, checked and binned.

    `keep` writes what the scan finds and the called peaks, which the later steps read several times; traces are read
    once and never written (see `scan_assays`).
    """
    assigned = assign_channels(channels, assays, panels, ladders)
    scanned = keep(scan_assays(assigned, params))
    fits = scanned_ladders(scanned)
    peaks = keep(call_peaks(scanned_peaks(scanned), fits, params))
    signals = scanned.select("assay_id", F.inline("signals"))
    return {"channels": assigned, "ladders": fits, "peaks": bin_peaks(check_peaks(peaks, signals, fits, params), markers)}


def refit(ladder_peaks: DataFrame, ladders: DataFrame) -> DataFrame:
    """z, rss, score and report anew from the peaks that are marked as the ladder's (assay_id, rtime, size, peak_type)."""
    ship(ladder_peaks.sparkSession)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        from .ladder import cubic

        z, rss = cubic(f["size"].to_numpy(float), f["rtime"].to_numpy(float))
        return pd.DataFrame([(f["assay_id"].iloc[0], z.tolist(), rss, len(f))], columns=["assay_id", "z", "rss", "used"])

    marked = ladder_peaks.filter("peak_type = 'peak-ladder'").select("assay_id", "rtime", "size")
    fit = marked.groupBy("assay_id").applyInPandas(one, "assay_id bigint, z array<double>, rss double, used int").join(ladders.select("assay_id", "n_sizes"), "assay_id")
    return fit.select("assay_id", "z", "rss", ladder_score(F.col("rss"), F.col("used"), F.col("n_sizes")).alias("score"), ladder_reports(F.col("rss"), F.col("used"), F.col("n_sizes")).alias("report"))


def set_types(peaks: DataFrame, markers: list[str], values: list[int], to: str, only: str | None = None) -> DataFrame:
    """Peaks of the markers with one of the values get the type `to`; only those of the type `only`, if given."""
    chosen: Column = F.col("marker").isin(*markers) & F.col("value").isin(*values)
    if only:
        chosen = chosen & (F.col("peak_type") == only)
    return peaks.withColumn("peak_type", F.when(chosen, to).otherwise(F.col("peak_type")))


def reset(peaks: DataFrame, assays: DataFrame) -> DataFrame:
    """The peaks without those of the assays."""
    return peaks.join(assays.select("assay_id"), "assay_id", "left_anti")


def accept(peaks: DataFrame, value: str = "value") -> DataFrame:
    """Peaks given from outside: uncalled where their value is positive, noise where it is not."""
    return peaks.withColumn("peak_type", F.when(F.col(value) > 0, "peak-uncalled").otherwise("peak-noise"))


def qc_listing(assays: DataFrame, ladders: DataFrame) -> DataFrame:
    """sample, fsa_file, rss, score and report of each assay; of those without a ladder the last three are null."""
    return assays.join(ladders.select("assay_id", "rss", "score", "report"), "assay_id", "left").select("sample", "fsa_file", "rss", "score", "report")


def repeated_files(lines: DataFrame, file: str = "fsa_file") -> DataFrame:
    """Trace files on more than one line of an assay list: an error of the list."""
    return lines.groupBy(file).agg(F.count("*").alias("n")).filter("n > 1")


def by_keys(assays: DataFrame, **keys) -> DataFrame:
    """Assays by batch, sample, panel and file, those of the keys that are given; a list is any of its values."""
    unknown = set(keys) - {"batch", "sample", "panel", "fsa_file"}
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    for k, v in keys.items():
        if v is not None:
            assays = assays.filter(F.col(k).isin(*(v if isinstance(v, (list, tuple)) else [v])))
    return assays


def series_bins(value: Column | int, interval: int = 3, low: int = 200, high: int = 400) -> Column:
    """Bins (pos, tag) an interval apart in the phase of a value: the first beyond `low`'s step, the last below `high`."""
    first = F.lit((low // interval + 1) * interval) + (value if isinstance(value, Column) else F.lit(value)).cast("int") % interval
    steps = F.when(first < high, F.sequence(first, F.greatest(first, F.lit(high - 1)), F.lit(interval))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda b: F.struct(b.cast("double").alias("pos"), b.alias("tag")))
