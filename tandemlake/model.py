"""Table shapes, constants and analysis parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

ALLELE = "marker_id bigint, sample_id bigint, value double, size double, height double, assay_id bigint, peak_type string"
SAMPLE = (
    "sample_id bigint, code string, batch string, country string, level1 string, level2 string, level3 string, level4 string, "
    "collection_date date, passive_detection boolean, recurrent boolean"
)
CHANNEL = "channel_id bigint, assay_id bigint, dye string, marker_id bigint, raw array<int>, data array<double>"
MARKER = "marker_id bigint, code string, repeats int, min_size double, max_size double, bins array<struct<pos:double,tag:int>>"
SAMPLE_DOC = (
    "code string, collection_date string, location array<string>, comments string, "
    "assays map<string, struct<panel:string,nest:string,size_standard:string,"
    "markers:map<string, struct<dye:string,alleles:array<struct<value:int,size:double,height:int,area:int>>>>>>"
)

# Fixed values that results depend on.
PEAK_TYPES = (
    "peak-bin", "peak-called", "peak-scanned", "peak-ambiguous", "peak-stutter", "peak-overlap", "peak-noise",
    "peak-ladder", "peak-unassigned", "peak-broad", "peak-bigdelta", "peak-uncalled", "peak-artifact",
)
CHANNEL_STATUS = ("channel-clean", "channel-dirty", "channel-ladder", "channel-unavailable", "channel-unassigned")
ASSAY_STATUS = ("assay-uploaded", "assay-analyzed", "assay-reviewed", "assay-unavailable")
SIZING_METHODS = (
    "allele-autoladder", "allele-semiladder", "allele-external", "allele-leastsquare", "allele-localsouthern", "allele-cubicspline", "allele-unknown",
)
BINNING_METHODS = ("binning-auto", "binning-semi", "binning-external", "binning-unavailable")
LADDERS = {
    "LIZ600": (20, 40, 60, 80, 100, 114, 120, 140, 160, 180, 200, 214, 220, 240, 250, 260, 280, 300, 314, 320, 340, 360,
               380, 400, 414, 420, 440, 460, 480, 500, 514, 520, 540, 560, 580, 600),
    "LIZ500": (35, 50, 75, 100, 139, 150, 160, 200, 250, 300, 340, 350, 400, 450, 490, 500),
}
LADDER_DYE = "LIZ"
COLOURS = ("red", "green", "blue", "orange", "purple", "black", "magenta", "wheat", "cyan", "brown", "slateblue", "lightgreen")
DYES = {"B": "6-FAM", "G": "VIC", "Y": "NED", "O": "LIZ", "R": "PET"}


#: Columns and the values that they may have.
DOMAINS = {"peak_type": PEAK_TYPES, "channel_status": CHANNEL_STATUS, "assay_status": ASSAY_STATUS, "sizing_method": SIZING_METHODS, "binning_method": BINNING_METHODS}


@dataclass(frozen=True)
class AnalysisParams:
    """Thresholds and differentiation of an analysis.

    spatial: -1 none, 0 country, 1..4 that level. temporal: 0 none, 1 year, 3 quarter. sample_option: A all,
    S strict, U unique.
    """

    abs_threshold: float = 100
    rel_threshold: float = 0.33
    rel_cutoff: float = 0.0
    sample_qual_threshold: float = 0.50
    marker_qual_threshold: float = 0.10
    sample_option: str = "A"
    spatial: int = -1
    temporal: int = 0
    detection: bool = False
    peak_types: tuple[str, ...] = ("peak-bin",)
    marker_ids: tuple[int, ...] = ()

    def __post_init__(self):
        if self.sample_option not in ("A", "S", "U") or self.spatial not in range(-1, 5) or self.temporal not in (0, 1, 3):
            raise ValueError(f"unknown option in {self}")

    @classmethod
    def from_control(cls, d: dict) -> AnalysisParams:
        """Parameters of a control document: its parts `parameter` (thresholds) and `differentiation`, both optional."""
        where = dict(d.get("differentiation") or {})
        return cls.from_dict({**(d.get("parameter") or {}), **where})

    @classmethod
    def from_dict(cls, d: dict) -> AnalysisParams:
        """Known keys override the defaults, in the types of the defaults."""
        known = {f.name: f.default for f in fields(cls)}
        unknown = set(d) - set(known)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(known[k], tuple) else type(known[k])(v) for k, v in d.items()})


#: Differentiation by tool.
PRESETS = {
    "allele": AnalysisParams(), "genotype": AnalysisParams(), "he": AnalysisParams(), "nj": AnalysisParams(), "pca": AnalysisParams(),
    "moi": AnalysisParams(spatial=0), "haplotype": replace(AnalysisParams(), spatial=4), "structure": replace(AnalysisParams(), spatial=4),
}
