"""Series of pictures: frames and the two components of optical flow, paired by their names alone.

Listing reads no contents and is done by tasks, folder by folder, and joins move paths. The task that needs a picture opens it, so no picture crosses a shuffle.
Files lie in match/{half}_HQ/{series}/{number}.{png|jpg}; frames count from 1, flow pictures from 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.operators.ranking import flow_index, repaired_flow_index
from pitchgrid.sources.shared import checkpointed, in_small_batches, spread

SERIES = ("frames", "u", "v")
HALF = ["match", "half"]
#: Folders that a task lists, and names that it hands on at a time.
FOLDERS_PER_TASK, LISTED_AT_ONCE = 64, 10_000
#: Folders that a writing task remembers to have made.
FOLDERS_KNOWN = 10_000
#: Files that a task opens or makes; by their paths' few bytes alone, far more would come into one task.
FILES_PER_TASK = 1000


def _entries(deep: bool):
    """mapInArrow function: folders' paths -> (path, folder) of what they hold, at every depth if deep; hidden names are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = _located(path)
                found = files.get_file_info(fs.FileSelector(name, recursive=deep))
                for at in range(0, len(found), LISTED_AT_ONCE):
                    rows = [(i.path[len(name) :].lstrip("/"), i.type == fs.FileType.Directory) for i in found[at : at + LISTED_AT_ONCE]]
                    rows = [(f"{path}/{n}", folder) for n, folder in rows if not any(part[0] in "._" for part in n.split("/"))]
                    yield pa.RecordBatch.from_pydict({"path": [p for p, _ in rows], "folder": [f for _, f in rows]}, pa.schema([("path", pa.string()), ("folder", pa.bool_())]))

    return run


def list_files(spark: SparkSession, root: str, levels: int = 3) -> DataFrame:
    """(path) of every file below root, listed by tasks and written once; names alone are read, and none of them reaches the driver.

    The folders of each of the first levels are dealt to tasks anew, so that a few large ones don't meet; those below come with their parent.
    """
    folders, found = spark.createDataFrame([(root.rstrip("/"),)], "path string"), []
    for level in range(levels + 1):
        entries = checkpointed(spread(folders, FOLDERS_PER_TASK).mapInArrow(_entries(level == levels), "path string, folder boolean"))
        found.append(entries.where("not folder").select("path"))
        folders = entries.where("folder").select("path")
        if folders.isEmpty():
            break
    # of levels that hold folders alone nothing is left to read
    found = [f for f in found if not f.isEmpty()] or found[:1]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def list_pictures(spark: SparkSession, root: str) -> DataFrame:
    """(match, half, series, number, path) of every picture below root; only names are read. number counts from 0 in each series."""
    part = lambda k: F.regexp_extract("path", r"([^/]+)/(\d)_HQ/(frames|u|v)/(\d+)\.\w+$", k)
    rows = list_files(spark, root).select(part(1).alias("match"), part(2).alias("half"), part(3).alias("series"), part(4).alias("number"), "path").where("match <> ''")
    number = F.col("number").cast("int") - F.when(F.col("series") == "frames", 1).otherwise(0)
    return rows.select("match", F.col("half").cast("int").alias("half"), "series", number.alias("number"), "path")


def frame_pictures(listing: DataFrame) -> DataFrame:
    """(match, half, frame_idx, rgb): the path of each frame's picture."""
    return listing.where("series = 'frames'").select(*HALF, F.col("number").alias("frame_idx"), F.col("path").alias("rgb"))


def flow_pictures(listing: DataFrame) -> DataFrame:
    """(match, half, flow_idx, u, v): the paths of both components; a picture without its partner is left out."""
    one = lambda s: F.max(F.when(F.col("series") == s, F.col("path"))).alias(s)
    pairs = listing.where("series in ('u', 'v')").groupBy(*HALF, F.col("number").alias("flow_idx")).agg(one("u"), one("v"))
    return pairs.where("u is not null and v is not null")


def frame_counts(listing: DataFrame) -> DataFrame:
    """(match, half, n_frames) by the pictures that are there."""
    return listing.where("series = 'frames'").groupBy(*HALF).agg(F.count("*").alias("n_frames"))


def with_flow(frames: DataFrame, listing: DataFrame, counts: DataFrame, sizes: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """frames(match, half, frame_idx, ...) with the paths rgb, u, v of their picture and their flow.

    counts(match_path, half, n_flow) has the number of flow pictures of each half, sizes(match, half, n_frames) the number
    of its frames: flow pictures are spread evenly over frames. Halves of repaired(match, half, frame_idx, all_frame_idx,
    n_all) take the flow of the repaired frame instead. Frames without a count or a picture are left out.
    """
    looked_up = frames.join(counts.withColumnRenamed("match_path", "match"), HALF).join(sizes, HALF)
    index = flow_index(F.col("frame_idx"), F.col("n_flow"), F.col("n_frames"))
    if repaired is not None:
        looked_up = looked_up.join(repaired, [*HALF, "frame_idx"], "left")
        index = F.coalesce(repaired_flow_index(F.col("all_frame_idx"), F.col("n_flow"), F.col("n_all")), index)
    named = looked_up.withColumn("flow_idx", index.cast("int")).drop("n_flow", "n_frames", "all_frame_idx", "n_all")
    return named.join(flow_pictures(listing), [*HALF, "flow_idx"]).join(frame_pictures(listing), [*HALF, "frame_idx"])


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&,"))


def opened(path: str) -> bytes:
    """The bytes of a file that Spark has listed, read by the task itself."""
    files, name = _located(path)
    with files.open_input_stream(name) as f:
        return f.read()


def file_contents(listing: DataFrame) -> DataFrame:
    """listing(path, ...) with data, the bytes of each file, opened by the task that holds its row."""

    @F.arrow_udf("binary")
    def read(path: pa.Array) -> pa.Array:
        return pa.array([opened(p) for p in path.to_pylist()], pa.binary())

    return in_small_batches(spread(listing, FILES_PER_TASK)).withColumn("data", read("path"))


def write_files(rows: DataFrame, root: str) -> int:
    """Writes rows(name, data) below root, one file each, and returns how many; names may hold folders.

    Few rows come to Python at a time, so memory holds a few files, however many and large they are in all. Each file is written under the attempt's own name and then moved to its place, so a repeated task does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        n, made = 0, set()
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("name", "data")}
                files, path = _located(f"{root}/{r['name']}")
                folder = path.rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    if len(made) >= FOLDERS_KNOWN:
                        made.clear()
                    made.add(folder)
                draft = f"{folder}/_{uuid4().hex}"
                with files.open_output_stream(draft) as f:
                    f.write(r["data"])
                files.move(draft, path)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    named = in_small_batches(rows.select("name", F.col("data").cast("binary").alias("data")))
    return named.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_pictures(rows: DataFrame, root: str) -> int:
    """Writes rows(match, half, series, number, data) below root as the series they belong to and returns how many."""
    number = F.when(F.col("series") == "frames", F.format_string("%05d", F.col("number") + 1)).otherwise(F.format_string("%06d", F.col("number")))
    return write_files(rows.select(F.concat("match", F.lit("/"), "half", F.lit("_HQ/"), "series", F.lit("/"), number, F.lit(".png")).alias("name"), "data"), root)
