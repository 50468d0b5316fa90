"""Algorithms, features and their defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from . import kernels as K


class SegmentationError(Exception):
    """Base of the library's errors."""


class NoAlgorithmError(SegmentationError):
    """No algorithm of that name."""


class IncapableAlgorithmError(SegmentationError):
    """The algorithm finds no boundaries, or no labels, or no hierarchy."""


class ParameterCollisionError(SegmentationError):
    """A boundary and a label algorithm share a parameter name."""


class NoHierarchyError(SegmentationError):
    """The algorithm has one level only."""


class NoReferencesError(SegmentationError):
    """A track has no reference annotation."""


class NoEstimationsError(SegmentationError):
    """A track has no matching estimation."""


class FeatureTypeNotFound(SegmentationError):
    """The feature, or its synchronisation, is absent."""


class FeatureParamsError(SegmentationError):
    """Feature parameters contradict each other or the stored ones."""


class FeaturesNotFound(SegmentationError):
    """A feature file is of another duration, rate, hop or audio file."""


class NoFeaturesFileError(SegmentationError):
    """A feature file is absent."""


class WrongFeaturesFormatError(SegmentationError):
    """A stored feature lacks a part."""


class NoAudioFileError(SegmentationError):
    """An audio file is absent."""


@dataclass(frozen=True)
class Algorithm:
    name: str
    run: Callable
    boundaries: bool
    labels: bool
    hierarchical: bool = False
    #: Defaults of the parameters.
    defaults: dict = field(default_factory=dict)


ALGORITHMS: dict[str, Algorithm] = {}
FEATURES: dict[str, Callable] = {}


def algorithm(name: str, *, boundaries: bool, labels: bool, hierarchical: bool = False, **defaults):
    """Registers f(x, bounds, config, seed); also for algorithms of one's own."""

    def add(f):
        ALGORITHMS[name] = Algorithm(name, f, boundaries, labels, hierarchical, defaults)
        return f

    return add


def feature(name: str):
    """Registers f(waveform, rate) -> frames x dimensions."""

    def add(f):
        FEATURES[name] = f
        return f

    return add


algorithm("foote", boundaries=True, labels=False, M_gaussian=66, m_median=12, L_peaks=64, bound_norm_feats="min_max")(K.foote)
algorithm("sf", boundaries=True, labels=False, M_gaussian=27, m_embedded=3, k_nearest=0.04, Mp_adaptive=28, offset_thres=0.05, bound_norm_feats="inf")(K.sf)
algorithm("cbm", boundaries=True, labels=False, ssm="rbf", penalty_weight=1, penalty_func="modulo8", bands_number=7, max_size=32)(K.cbm)
algorithm("cnmf", boundaries=True, labels=True, h=20, R=16, rank=3, R_labels=16, rank_labels=4, niters=500, norm_feats="inf")(K.cnmf)
algorithm("olda", boundaries=True, labels=False, hierarchical=True, transform=None)(K.olda)
algorithm("scluster", boundaries=True, labels=True, hierarchical=True, num_layers=10, scluster_k=4, evec_smooth=9, rec_smooth=9, rec_width=9, scluster_restarts=50)(K.scluster)
algorithm("vmo", boundaries=True, labels=True, hierarchical=True, connectivity="lrs", median_filter_width=9, hier_num_layers=10, vmo_k=10, vmo_restarts=50, vmo_thresholds=100)(K.vmo)
algorithm("fmc2d", boundaries=False, labels=True, xmeans=False, k=4, offset=4, label_norm_feats="inf", label_norm_floor=0.1, label_norm_min_db=-80, fmc2d_restarts=100)(K.fmc2d)


def algorithms(kind: str) -> list[str]:
    """Names of the algorithms of a kind, `boundaries`, `labels` or `hierarchical`."""
    return sorted(a.name for a in ALGORITHMS.values() if getattr(a, kind))


def lookup(name: str, kind: str) -> Algorithm:
    if name not in ALGORITHMS:
        raise NoAlgorithmError(f"no algorithm {name}; there are {sorted(ALGORITHMS)}")
    if not getattr(ALGORITHMS[name], kind):
        raise (NoHierarchyError if kind == "hierarchical" else IncapableAlgorithmError)(f"{name} has no {kind}")
    return ALGORITHMS[name]


def configuration(boundaries: str, labels: str | None, **own) -> dict:
    """Defaults of both algorithms and one's own values over them."""
    out = dict(ALGORITHMS[boundaries].defaults) if boundaries in ALGORITHMS else {}
    if labels and labels != boundaries:
        both = set(out) & set(ALGORITHMS[labels].defaults)
        if both:
            raise ParameterCollisionError(f"{boundaries} and {labels} share {sorted(both)}")
        out |= ALGORITHMS[labels].defaults
    return out | own
