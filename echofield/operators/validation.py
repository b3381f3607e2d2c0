"""Rules for the metadata of complex images.

A row is an image's metadata, flat, with nulls for what is absent. A rule is a condition
that holds where the metadata are wrong; unknown is not wrong. Conditions are portable
SQL, so they are one projection here and can run elsewhere too.

Names: row_ and col_ for the two axes (sgn, ss, bw, width, dk1, dk2, kctr, window and
broadening), tx_ and rcv_ for waveforms, derived_ for values made anew from others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metadata import Rule, findings

#: Rule, level, condition, message.
RULES: list[tuple[str, str, str, str]] = [
    ("spotlight_coa", "Error", "mode = 'SPOTLIGHT' and not coa_scalar", "a spotlight's time of centre of aperture must be one number"),
    ("moving_coa", "Warning", "mode <> 'SPOTLIGHT' and coa_scalar", "only a spotlight has one time of centre of aperture"),
    ("sgn", "Error", "row_sgn <> col_sgn", "the axes differ in the sign of the transform"),
]
for _axis in ("row", "col"):
    RULES += [
        (f"{_axis}_dk_order", "Error", f"{_axis}_dk2 <= {_axis}_dk1", "the band's upper bound is not above the lower one"),
        (f"{_axis}_dk2", "Error", f"{_axis}_dk2 > 1 / (2 * {_axis}_ss) * (1 + 1e-15)", "the band goes beyond the sampling"),
        (f"{_axis}_dk1", "Error", f"{_axis}_dk1 < -1 / (2 * {_axis}_ss) * (1 + 1e-15)", "the band goes beyond the sampling"),
        (f"{_axis}_bw", "Error", f"{_axis}_bw > ({_axis}_dk2 - {_axis}_dk1) * (1 + 1e-15)", "the bandwidth is larger than the band"),
        (f"{_axis}_dk1_derived", "Error", f"abs({_axis}_dk1 - derived_{_axis}_dk1) > 0.01 * abs(derived_{_axis}_dk1)", "the band's lower bound is not the vertices' one"),
        (f"{_axis}_dk2_derived", "Error", f"abs({_axis}_dk2 - derived_{_axis}_dk2) > 0.01 * abs(derived_{_axis}_dk2)", "the band's upper bound is not the vertices' one"),
        (f"{_axis}_weights", "Warning", f"{_axis}_window <> 'UNIFORM' and {_axis}_weight_count is null", "weighting without a weight function"),
        (f"{_axis}_window", "Style", f"{_axis}_window not in ('UNIFORM', 'HAMMING', 'HANNING', 'KAISER', 'TAYLOR', 'RAISED_COSINE', 'UNKNOWN')", "the weighting's name is not known"),
        (f"{_axis}_width", "Error", f"abs({_axis}_width - {_axis}_broadening / {_axis}_bw) > 1e-3 * {_axis}_width", "width, bandwidth and weighting don't fit"),
        (f"{_axis}_long_weights", "Style", f"{_axis}_weight_count > 1024", "the weight function is longer than necessary"),
    ]
RULES += [
    ("arp_terms", "Error", "arp_terms < 2", "the position polynomial has no velocity"),
    ("scp_time", "Error", "abs(scp_time - coa_constant) > 1e-12", "the scene centre's time is not the polynomial's"),
    ("arp_position", "Error", "arp_miss > 0.01", "the position is not the polynomial's"),
    ("side", "Error", "side <> derived_side", "the side of track is not the geometry's"),
    ("graze", "Error", "abs(graze - derived_graze) > 0.01", "the grazing angle is not the geometry's"),
    ("slant_range", "Error", "abs(slant_range - derived_slant_range) > 0.01", "the slant range is not the geometry's"),
    ("tx_bandwidth", "Error", "abs(tx_bandwidth - tx_length * tx_rate) > 1e-3 * tx_bandwidth", "bandwidth is not length times rate"),
    ("chirp", "Error", "demodulation = 'CHIRP' and rcv_rate <> 0", "a chirp is received without a rate"),
    ("stretch", "Warning", "demodulation = 'STRETCH' and rcv_rate <> tx_rate", "a stretched pulse is received at another rate"),
    ("tx_positive", "Error", "tx_min <= 0 and reference_index is null", "a frequency is not positive"),
    ("window_length", "Error", "tx_length > rcv_window", "the pulse is longer than the receive window"),
    ("if_bandwidth", "Error", "rcv_if_bandwidth > adc_rate", "the bandwidth is larger than the sampling rate"),
    ("rcv_start", "Error", "rcv_start >= tx_max or rcv_start <= tx_min - rcv_if_bandwidth", "reception starts outside the transmitted band"),
    ("tx_order", "Error", "tx_min >= tx_max", "the lowest frequency is not below the highest"),
    ("processed_order", "Error", "proc_min >= proc_max", "the lowest frequency is not below the highest"),
    ("sequence", "Error", "tx_polarisation = 'SEQUENCE' and tx_steps is null", "a sequence without transmit steps"),
    ("scp_miss", "Error", "scp_miss > 0.01", "the scene centre's two forms differ"),
    ("valid_data", "Error", "(valid_pixels is null) <> (valid_geo is null)", "valid data in one of two places only"),
    ("rgazcomp_plane", "Error", "algorithm = 'RGAZCOMP' and plane <> 'SLANT'", "range-azimuth compression needs the slant plane"),
    ("rgazcomp_grid", "Error", "algorithm = 'RGAZCOMP' and grid <> 'RGAZIM'", "range-azimuth compression needs a range-azimuth grid"),
    ("rgazcomp_scale", "Error", "algorithm = 'RGAZCOMP' and abs(azimuth_scale - derived_azimuth_scale) > 1e-6", "the azimuth scale is not the geometry's"),
    ("pfa_grid", "Error", "algorithm = 'PFA' and grid <> 'RGAZIM'", "the polar format needs a range-azimuth grid"),
    ("pfa_block", "Error", "algorithm = 'PFA' and polar_reference is null", "the polar format's parameters are missing"),
    ("pfa_reference", "Warning", "algorithm = 'PFA' and abs(polar_reference - scp_time) > 1e-6", "the polar reference is not the scene centre's time"),
    ("pfa_col_low", "Error", "algorithm = 'PFA' and kaz1 - col_kctr < -1 / (2 * col_ss) * (1 + 1e-15)", "the aperture goes beyond the sampling"),
    ("pfa_col_high", "Error", "algorithm = 'PFA' and kaz2 - col_kctr > 1 / (2 * col_ss) * (1 + 1e-15)", "the aperture goes beyond the sampling"),
    ("pfa_col_bw", "Error", "algorithm = 'PFA' and col_bw > (kaz2 - kaz1) * (1 + 1e-15)", "the bandwidth is larger than the aperture"),
    ("pfa_col_centre", "Warning", "algorithm = 'PFA' and col_kctr <> 0 and abs(col_kctr - (kaz1 + kaz2) / 2) > 1e-5", "the centre is not the aperture's"),
    ("rma_kind", "Error", "algorithm = 'RMA' and rma_kind is null", "the range migration parameters are missing"),
    ("rma_rmat_grid", "Error", "rma_kind = 'RMAT' and grid <> 'XCTYAT'", "the grid doesn't fit the algorithm"),
    ("rma_rmcr_grid", "Error", "rma_kind = 'RMCR' and grid <> 'XRGYCR'", "the grid doesn't fit the algorithm"),
    ("rma_rmcr_centre", "Error", "rma_kind = 'RMCR' and col_kctr <> 0", "the centre must be zero"),
    ("inca_grid", "Error", "rma_kind = 'INCA' and grid <> 'RGZERO'", "the grid doesn't fit the algorithm"),
    ("inca_centre", "Error", "rma_kind = 'INCA' and col_kctr <> 0", "the centre must be zero"),
    ("inca_spotlight", "Error", "rma_kind = 'INCA' and mode = 'SPOTLIGHT' and has_doppler", "a spotlight has no Doppler centroid"),
    ("inca_doppler", "Error", "rma_kind = 'INCA' and mode <> 'SPOTLIGHT' and not has_doppler", "the Doppler centroid is missing"),
    ("other_algorithm", "Warning", "algorithm = 'OTHER'", "the algorithm is not known"),
    ("processed_times", "Error", "proc_start >= proc_end", "processing ends before it starts"),
    ("processed_polarisation", "Error", "proc_polarisation <> all_polarisations and not contains(all_polarisations, proc_polarisation)", "the processed polarisation was not collected"),
    ("scp_middle", "Warning", "scp_time < duration / 4 or scp_time > duration * 3 / 4", "the scene centre's time is not in the middle of the collection"),
    ("relative_noise", "Error", "noise_kind = 'RELATIVE' and noise_constant <> 0", "relative noise has a constant"),
    ("noise_absolute", "Optional", "noise_kind is null or noise_kind <> 'ABSOLUTE'", "absolute noise is missing"),
    ("reference_frequency", "Optional", "reference_index is not null", "a reference frequency is in use"),
    ("valid_missing", "Optional", "valid_pixels is null", "valid data are missing"),
]


def rules(df: DataFrame) -> list[Rule]:
    """The rules that the columns of df allow."""
    out = []
    columns = set(df.columns)
    for name, level, condition, message in RULES:
        words = set(re.findall(r"\b[a-z_][a-z0-9_]*", re.sub(r"'[^']*'", "", condition)))
        if words - SYNTAX <= columns:
            out.append(Rule(name, level, F.expr(condition), message))
    return out


#: What conditions hold besides names of columns.
SYNTAX = {"and", "or", "not", "in", "is", "null", "abs", "contains"}


def validate(df: DataFrame, key: str) -> DataFrame:
    """(key, rule, level, message): what is wrong with each image's metadata."""
    return findings(df, key, rules(df))
