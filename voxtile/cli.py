"""Commands over manifests: ``python -m voxtile.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from voxtile.operators import batching, joins
from voxtile.plans.sets import CutSet, RecordingSet, SupervisionSet
from voxtile.sources import archives, manifests

_PREDICATE = re.compile(r"^\s*([\w.]+)\s*(==|=|!=|>=|<=|>|<)\s*([-+\d.eE]+)\s*$")


def predicate(text: str) -> Column:
    """``field op number``; equality allows for the noise of floats."""
    m = _PREDICATE.match(text)
    if not m:
        raise ValueError(f"not a predicate: {text}")
    c, v = F.col(m[1]).cast("double"), float(m[3])
    close = F.abs(c - v) <= 1e-9 * F.greatest(F.abs(c), F.lit(abs(v)))
    return {"=": close, "==": close, "!=": ~close, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[m[2]]


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="voxtile")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, (kind, default) in options.items():
            c.add_argument("--" + k.replace("_", "-"), type=kind, default=default)

    command("copy", "input", "output")
    command("filter", "predicate", "input", "output")
    command("combine", "output", inputs=(str, ""))
    command("subset", "input", "output", first=(int, None), last=(int, None))
    command("split", "n", "input", "output")
    command("describe", "input")
    command("validate", "input")
    command("windows", "input", "output", duration=(float, 5.0), hop=(float, None))
    command("trim-to-supervisions", "input", "output", min_duration=(float, None))
    command("trim-to-groups", "input", "output", max_pause=(float, 0.0))
    command("truncate", "input", "output", max_duration=(float, 10.0), offset_type=(str, "start"))
    command("pad", "input", "output", duration=(float, 10.0))
    command("decompose", "input", "output")
    command("bucket-bins", "input", buckets=(int, 10))
    command("fix", "recordings", "supervisions", "output")
    command("kaldi-import", "folder", "output", sampling_rate=(int, 16000))
    command("kaldi-export", "recordings", "supervisions", "output")
    command("index", "input")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("voxtile").getOrCreate()
    cuts = lambda: CutSet.from_file(spark, a.input)
    if a.command == "copy":
        cuts().to_file(a.output)
    elif a.command == "filter":
        cuts().filter(predicate(a.predicate)).to_file(a.output)
    elif a.command == "combine":
        CutSet.from_files(spark, a.inputs.split(",")).to_file(a.output)
    elif a.command == "subset":
        cuts().subset(a.first, a.last).to_file(a.output)
    elif a.command == "split":
        for i, part in enumerate(cuts().split(int(a.n))):
            part.to_file(f"{a.output}/{i}")
    elif a.command == "describe":
        cuts().describe().show(truncate=False)
        cuts().describe_speech().show(truncate=False)
    elif a.command == "validate":
        cuts().validate().groupBy("rule").count().show(truncate=False)
    elif a.command == "windows":
        cuts().cut_into_windows(a.duration, a.hop).to_file(a.output)
    elif a.command == "trim-to-supervisions":
        cuts().trim_to_supervisions(min_duration=a.min_duration).to_file(a.output)
    elif a.command == "trim-to-groups":
        cuts().trim_to_supervision_groups(a.max_pause).to_file(a.output)
    elif a.command == "truncate":
        cuts().truncate(a.max_duration, a.offset_type).to_file(a.output)
    elif a.command == "pad":
        cuts().pad(a.duration).to_file(a.output)
    elif a.command == "decompose":
        for name, s in zip(("recordings", "supervisions", "features"), cuts().decompose()):
            s.to_file(f"{a.output}/{name}")
    elif a.command == "bucket-bins":
        print(batching.duration_bins(cuts().df, a.buckets))
    elif a.command == "fix":
        rec, sup = joins.fix_manifests(RecordingSet.from_file(spark, a.recordings).df, SupervisionSet.from_file(spark, a.supervisions).df)
        manifests.write_manifest(rec, f"{a.output}/recordings")
        manifests.write_manifest(sup, f"{a.output}/supervisions")
    elif a.command == "kaldi-import":
        rec, sup, _ = manifests.read_kaldi_dir(spark, a.folder, a.sampling_rate)
        manifests.write_manifest(rec, f"{a.output}/recordings")
        manifests.write_manifest(sup, f"{a.output}/supervisions")
    elif a.command == "kaldi-export":
        manifests.write_kaldi_dir(RecordingSet.from_file(spark, a.recordings).df, SupervisionSet.from_file(spark, a.supervisions).df, a.output)
    elif a.command == "index":
        archives.write_line_index(spark, [a.input]).show(truncate=False)


if __name__ == "__main__":
    main()
