"""Settings: typed defaults, overridden by `segmentry.<key>` in the Spark configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    #: The defaults.
    default_bound_id: str = "sf"
    default_label_id: str | None = None
    sample_rate: int = 22050
    n_fft: int = 4096
    hop_size: int = 1024
    minimum_frames: int = 10
    results_ext: str = ".csv"
    audio_dir: str = "audio"
    estimations_dir: str = "estimations"
    features_dir: str = "features"
    references_dir: str = "references"
    audio_exts: str = "wav,mp3,aif"

    @staticmethod
    def parse(flags: str) -> dict[str, str]:
        """Values of `name=value,name=value`, quotes allowed, the last of equal names."""
        import shlex

        words = shlex.shlex(flags, posix=True)
        words.whitespace, words.whitespace_split = ",", True
        return {k.strip(): v for k, eq, v in (w.partition("=") for w in words) if eq}

    @classmethod
    def of(cls, spark: SparkSession, **own) -> Settings:
        """Own values over the session's over the defaults; values of the wrong kind are errors."""
        found = {}
        for f in fields(cls):
            value = own.get(f.name, spark.conf.get(f"segmentry.{f.name}", None))
            if value is None:
                continue
            kind = int if "int" in str(f.type) else str
            try:
                found[f.name] = kind(value)
            except ValueError as e:
                raise ValueError(f"{f.name}: {value!r} is not {kind.__name__}") from e
        if unknown := set(own) - {f.name for f in fields(cls)}:
            raise KeyError(f"no setting {sorted(unknown)}")
        return cls(**found)
