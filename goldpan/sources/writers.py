"""Writers of frozen files: sorted JSON lines and CSV, each with its hash, and a manifest.

A frozen file is one file in one order, byte for byte the same whenever it is written. Lines are
made on the executors; the driver writes them as they come in order, a partition at a time, to the
store that the path names, from where the readers read them back.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.model import ROW
from goldpan.operators.splits import check_invariants, stats_dict
from goldpan.sources import store


def canonical(df: DataFrame) -> DataFrame:
    """(key, line): each row as JSON with sorted keys, all but ASCII escaped."""
    names = sorted(ROW.names)

    def run(frames):
        for f in frames:
            records = f[names].to_dict("records")
            yield pd.DataFrame({"key": f["example_id"], "line": [json.dumps(r, sort_keys=True) for r in records]})

    return df.mapInPandas(run, "key string, line string")


def write_lines(df: DataFrame, path, header: str | None = None) -> str:
    """Write (key, line) by key, then line; the file's hash."""

    def parts():
        held, size = [header] if header else [], 0
        for r in df.orderBy("key", "line").select("line").toLocalIterator(prefetchPartitions=True):
            held.append(r["line"])
            size += len(r["line"])
            if size >= store.CHUNK:
                yield "".join(x + "\n" for x in held).encode()
                held, size = [], 0
        yield "".join(x + "\n" for x in held).encode()

    return store.write(path, parts())


def write_rows(df: DataFrame, path) -> str:
    return write_lines(canonical(df), path)


#: The files of a frozen split, the columns of its assignments and what its manifest says of publishing.
SPLITS = ("train", "dev", "test")
ASSIGNED = ("example_id", "split", "agreement_tier", "dup_group")
REDISTRIBUTION = {"text_published": False, "labels_published": False, "note": "Only ids and split assignments may be published: the text's licence is non-commercial."}


def freeze(rows: DataFrame, out_dir) -> dict:
    """Check, then write train, dev, test, the assignments (no text, no labels) and the manifest."""
    check_invariants(rows)
    assigned = rows.select(F.col("example_id").alias("key"), F.concat_ws(",", *ASSIGNED).alias("line"))
    files = [(name, f"{name}.jsonl", canonical(rows.where(F.col("split") == name)), None) for name in SPLITS]
    files.append(("split_assignments", "split_assignments.csv", assigned, ",".join(ASSIGNED)))
    hashes = {name: write_lines(lines, f"{out_dir}/{file}", header) for name, file, lines, header in files}
    manifest = {"stats": stats_dict(rows), "hashes": hashes, "redistribution": REDISTRIBUTION}
    store.write_json(manifest, f"{out_dir}/manifest.json")
    return manifest
