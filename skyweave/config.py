"""Parameters of the linking workflow, with the defaults of the published survey set-up, and input errors."""

from __future__ import annotations

from dataclasses import dataclass


class SkyweaveError(ValueError):
    """Base of the errors that are raised while a plan is built."""


class BadParameter(SkyweaveError):
    pass


class BadInput(SkyweaveError):
    pass


@dataclass(frozen=True)
class TrackletConfig:
    max_v: float = 2.0  # degrees a day
    min_v: float = 0.0
    min_dt: float = 0.01  # days
    max_dt: float = 0.0625

    def __post_init__(self) -> None:
        if self.max_v <= 0 or self.min_v < 0 or self.min_v > self.max_v:
            raise BadParameter("0 <= min_v <= max_v and max_v > 0 are needed")
        if self.max_dt <= 0 or self.min_dt > self.max_dt:
            raise BadParameter("min_dt <= max_dt and max_dt > 0 are needed")


@dataclass(frozen=True)
class CollapseConfig:
    ra_tol: float = 0.002
    dec_tol: float = 0.002
    angle_tol: float = 5.0
    v_tol: float = 0.05
    method: str = "greedy"  # greedy, minimum_rms or best_fit
    max_rms: float | None = None
    use_atan2: bool = False  # the angle by asin loses the sign of the RA motion; atan2 keeps it

    def __post_init__(self) -> None:
        if self.method not in ("greedy", "minimum_rms", "best_fit"):
            raise BadParameter(f"unknown method {self.method}")
        if min(self.ra_tol, self.dec_tol, self.angle_tol, self.v_tol) < 0 or max(self.ra_tol, self.dec_tol, self.angle_tol) > 180:
            raise BadParameter("tolerances are from 0 to 180 degrees")


@dataclass(frozen=True)
class LinkConfig:
    max_ra_accel: float = 0.02  # degrees a day squared
    max_dec_accel: float = 0.02
    location_error: float = 0.0002
    min_endpoint_separation: float = 1.0  # days
    min_support_separation: float = 0.5
    min_nights: int = 3
    min_detections: int = 6
    addition_threshold: float = 0.028648
    min_prob: float = 0.98
    astrom_err: float = 0.2 / 3600
    sky_centre_ra: float = 340.0
    sky_centre_dec: float = -15.0
    max_window: float = 15.0  # longest time from the first to the last tracklet, in days
    latest_first_endpoint: float | None = None
    earliest_last_endpoint: float | None = None
    use_topo: bool = False
    max_ratio: float = 100.0  # a fit lowers its order beyond this ratio of uncertainty to residual; infinity: it never does
    symmetric_accel: bool = False  # False: only accelerations above the limit are refused, as published
    cell_rows: int = 1000  # cells of the linking grid with more tracklets of a night are split
    obs_lat: float = -30.169
    obs_long: float = -70.804

    def __post_init__(self) -> None:
        if self.cell_rows < 1 or min(self.max_ra_accel, self.max_dec_accel) <= 0 or self.location_error <= 0 or self.astrom_err <= 0:
            raise BadParameter("accelerations, errors and cell_rows must be positive")


#: Presets of the nightly workflow (fixed values of the survey's stage policies).
INTRA_NIGHT = TrackletConfig(max_v=2.0, max_dt=0.05)
COLLAPSE_PRESET = CollapseConfig()
INTER_NIGHT = LinkConfig(min_nights=3, max_window=30.0)
