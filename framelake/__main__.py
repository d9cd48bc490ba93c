"""``python -m framelake``: the workflows from the command line."""

from __future__ import annotations

import argparse
import os

from framelake.plans import commands
from framelake.sources.readers import DEFAULT_METADATA


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framelake", description="Analysis of widefield imaging recordings.")
    sub = top.add_subparsers(dest="command", required=True)

    def add(to, name, *arguments, out=True):
        p = to.add_parser(name)
        for a in arguments:
            flags, more = a if isinstance(a, tuple) else (a, {})
            p.add_argument(*flags.split(), **more)
        if out:
            p.add_argument("-o", "--out-dir", default=".")
        return p

    number, switch = {"type": int}, {"action": "store_true"}
    add(sub, "sample", "path", ("--index", number | {"default": 0}), ("--crop", number | {"default": 0}), ("--vmin", {"type": float, "default": 0}), ("--vmax", {"type": float, "default": 255}), ("--key", {"default": "frames"}))
    add(sub, "preprocess", "path", ("--crop", number | {"default": 0}), ("--bins", number | {"default": 2}), ("--channel-means-only", switch), ("--use-means", switch), ("--flip-channels", switch), ("--skip-start", number), ("--skip-end", number), ("--no-qa", switch))
    register = sub.add_parser("register").add_subparsers(dest="step", required=True)
    add(register, "landmarks", "path", ("-r --recording-points", {}), ("-t --template-points", {}), ("--crop-x", number | {"default": 0}), ("--crop-y", number | {"default": 0}))
    process = sub.add_parser("process").add_subparsers(dest="step", required=True)
    add(process, "smooth", "path", ("-s --sigma", {"type": float, "default": 2.0}))
    add(process, "zscore", "path", out=False)
    add(process, "regions", "path", ("--raster", {"required": True}), ("--dictionary", {"required": True}), ("--width", number | {"default": 142}), ("--exclude", {"nargs": "*", "default": []}), ("--ignore-default-exclude", switch))
    add(process, "regression", "path", "regressors", ("-a --alpha", {"type": float, "default": 1.0}))
    add(sub, "convert", "source", ("-t --ts-path", {}), ("-d --ts-delimiter", {"default": ",", "choices": [",", "tab", " "]}), ("-c --ts-column", number | {"default": 0}), ("--ts-has-header", switch), ("-m --meta", {}), *((f"--{k.replace('_', '-')}", {}) for k in DEFAULT_METADATA))
    export = sub.add_parser("export").add_subparsers(dest="step", required=True)
    add(export, "deltaf", "path")
    add(export, "timestamps", "path")
    add(sub, "inspect", "path", ("--level", {"default": "meta-only", "choices": ["meta-only", "acquisition", "deltaf", "registered"]}), out=False)
    add(sub, "report", "path")
    return top


def run(spark, a: argparse.Namespace) -> str:
    """What the command made, or says."""
    step = f"{a.command} {getattr(a, 'step', '')}".strip()
    if getattr(a, "out_dir", None) and "://" not in a.out_dir:
        os.makedirs(a.out_dir, exist_ok=True)
    if step == "sample":
        return commands.sample(spark, a.path, a.out_dir, a.index, a.crop, a.vmin, a.vmax, a.key)
    if step == "preprocess":
        return commands.run_preprocess(spark, a.path, a.out_dir, edge=a.crop, bins=a.bins, means_only=a.channel_means_only, use_means=a.use_means, flip=a.flip_channels, skip_start=a.skip_start, skip_end=a.skip_end, qa=not a.no_qa)
    if step == "register landmarks":
        return commands.register_landmarks(spark, a.path, a.out_dir, a.recording_points, a.template_points, a.crop_x, a.crop_y)
    if step == "process smooth":
        return commands.smooth(spark, a.path, a.out_dir, a.sigma)
    if step == "process zscore":
        return commands.zscore(spark, a.path)
    if step == "process regions":
        return commands.region_table(spark, a.path, a.out_dir, a.raster, a.dictionary, a.width, tuple(a.exclude), a.ignore_default_exclude)
    if step == "process regression":
        return commands.regress(spark, a.path, a.regressors, a.out_dir, a.alpha)
    if step == "convert":
        out = f"{a.out_dir}/{commands.session_of(a.source).rsplit('.', 1)[0]}"
        given = {k: getattr(a, k) for k in DEFAULT_METADATA if getattr(a, k) is not None}
        return commands.convert(spark, a.source, out, a.ts_path, a.meta, a.ts_column, {"tab": "\t"}.get(a.ts_delimiter, a.ts_delimiter), a.ts_has_header, **given)
    if step == "export deltaf":
        return commands.export_changes(spark, a.path, a.out_dir)
    if step == "export timestamps":
        return commands.export_timestamps(spark, a.path, a.out_dir)
    if step == "inspect":
        return commands.inspect(spark, a.path, a.level)
    return commands.write_report(spark, a.path, a.out_dir)


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    asked = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("framelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(run(spark, asked))


if __name__ == "__main__":
    main()
