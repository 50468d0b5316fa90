"""Command line: segment a Parquet table of packed tracks, or evaluate segments against references.

python -m segmentry segment IN OUT --boundaries sf --labels fmc2d --param k_nearest=0.1
python -m segmentry evaluate SEGMENTS REFERENCES OUT [--again]
python -m segmentry sweep IN REFERENCES OUT --boundaries sf --param k_nearest=[0.04,0.1]
python -m segmentry mirex IN OUT --boundaries sf --labels fmc2d
python -m segmentry features AUDIO_FOLDER OUT --feature pcp
"""

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation as E
from .plans import api
from .plans import registry as G
from .sources import annotations as ann


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="segmentry")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("segment", "mirex", "sweep"):
        s = commands.add_parser(name)
        s.add_argument("source")
        if name == "sweep":
            s.add_argument("references")
        s.add_argument("target")
        s.add_argument("--boundaries", default="sf", choices=[*G.algorithms("boundaries"), *["gt"] * (name == "segment")])
        s.add_argument("--param", action="append", default=[], help="name=value, value in JSON" + ", a list of values to try" * (name == "sweep"))
        if name != "sweep":
            s.add_argument("--labels", choices=G.algorithms("labels"))
        if name == "segment":
            s.add_argument("--hier", action="store_true")
    e = commands.add_parser("evaluate")
    e.add_argument("segments")
    e.add_argument("references")
    e.add_argument("target")
    e.add_argument("--again", action="store_true", help="evaluate although there are results")
    f = commands.add_parser("features")
    f.add_argument("audio")
    f.add_argument("target")
    f.add_argument("--feature", action="append")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    params = {k: json.loads(v) for k, _, v in (p.partition("=") for p in getattr(a, "param", []))}
    if a.command == "segment":
        api.segment(spark.read.parquet(a.source), a.boundaries, a.labels, a.hier, **params).write.mode("overwrite").parquet(a.target)
    elif a.command == "mirex":
        found = api.segment(spark.read.parquet(a.source), a.boundaries, a.labels, **params).where("level = 0")
        ann.mirex_lines(found.withColumn("label", ann.label_letter(F.col("label")))).write.mode("overwrite").partitionBy("track_id").text(a.target)
    elif a.command == "sweep":
        found = api.sweep(spark.read.parquet(a.source), spark.read.parquet(a.references), a.boundaries, params)
        found.write.mode("overwrite").csv(a.target, header=True)
    elif a.command == "evaluate":
        if a.again or ann.cached_results(spark, a.target) is None:
            ann.save_results(api.evaluate(api.as_sides(spark.read.parquet(a.segments)), spark.read.parquet(a.references)), a.target)
        E.summary(ann.cached_results(spark, a.target)).show(vertical=True)
    else:
        from .sources import features

        features.write_features(features.extract(features.audio_files(spark, a.audio), tuple(a.feature) if a.feature else None), a.target)


if __name__ == "__main__":
    main()
