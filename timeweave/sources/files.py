"""File sources and sinks: reports, recogniser and tracker output, score lists, metadata, logs and run folders."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from fnmatch import fnmatchcase

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.functions.text import lang_code
from timeweave.operators.lineage import staged

SEGMENT = "segment_id long, speaker string, start_ms long, end_ms long, text string, translated string, emotion string, emotion_score double, tts_mos double"
REPORT = (
    "run_id string, chunks array<struct<chunk_id:long, segments:array<struct<segment_id:long, speaker:string, start_ms:long, end_ms:long, text:string, translated:string, emotion:string, "
    "emotion_score:double, tts_mos:double>>, profiles:map<string, array<struct<emotion:string, segment_id:long>>>>>"
)


MEGABYTE = 1 << 20
FILES_A_TASK = 2000  # files that a task lists, reads or writes


def _globs(pattern: str) -> list[str]:
    """A pattern's alternatives in braces, one by one."""
    found = re.search(r"\{([^{}]*)\}", pattern)
    return [pattern] if found is None else [g for a in found[1].split(",") for g in _globs(pattern[: found.start()] + a + pattern[found.end() :])]


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files under a folder whose names match. Tasks list the folders, level by level, so no list of
    files comes to the driver. Hidden files and folders are passed over, as Spark's own sources do."""
    globs = _globs(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        from timeweave.sources.tail import opened

        for pdf in batches:
            for folder in pdf["path"]:
                store, place = opened(folder)
                stem = folder.rstrip("/")[: len(folder.rstrip("/")) - len(place.rstrip("/"))]
                out = []
                for f in store.get_file_info(fs.FileSelector(place)):
                    hidden = f.base_name[0] == "." or (f.base_name[0] == "_" and "=" not in f.base_name)
                    if not hidden and (f.type == fs.FileType.Directory or any(fnmatchcase(f.base_name, g) for g in globs)):
                        out.append((stem + f.path, f.base_name, f.size if f.type == fs.FileType.File else None))
                yield pd.DataFrame(out, columns=["path", "name", "length"]).astype({"length": "Int64"})

    folders, levels = spark.createDataFrame([(root,)], "path string"), []
    while True:
        levels.append(staged(folders.mapInPandas(run, "path string, name string, length long"), "listed"))
        folders = levels[-1].where("length IS NULL").select("path")
        n = folders.count()
        if not n:
            break
        folders = folders.repartition(math.ceil(n / 4))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.where("length IS NOT NULL")


def spread(files: DataFrame, by: str) -> DataFrame:
    """Rows that stand for files, dealt by one of their columns to as many tasks as there are files for: their bytes tell Spark
    nothing of the work. A row always lands in the same task."""
    return files.repartition(max(1, math.ceil(files.select(by).count() / FILES_A_TASK)), by)


def read_files(files: DataFrame, last_bytes: int | None = None) -> DataFrame:
    """(name, value): texts of files (path, name, length), whole or their last bytes; tasks open them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from timeweave.sources.tail import opened

        for pdf in batches:
            names, values, held = [], [], 0
            for path, name, length in zip(pdf["path"], pdf["name"], pdf["length"].tolist()):
                store, place = opened(path)
                with store.open_input_file(place) as f:
                    at = 0 if last_bytes is None else max(0, length - last_bytes)
                    values.append(f.read_at(length - at, at).decode("utf-8", "replace"))
                names.append(name)
                held += length - at
                if held > 4 * MEGABYTE:
                    yield pd.DataFrame({"name": names, "value": values})
                    names, values, held = [], [], 0
            if names:
                yield pd.DataFrame({"name": names, "value": values})

    return spread(files, "path").mapInPandas(run, "name string, value string")


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def write_reports(segments: DataFrame, profiles: DataFrame, path: str) -> None:
    """One JSON document a run: chunks with ordered segments and the speakers' references."""
    rows = F.array_sort(F.collect_list(F.struct(*_columns(SEGMENT))))
    by_chunk = segments.groupBy("run_id", "chunk_id").agg(rows.alias("segments"))
    refs = profiles.groupBy("run_id", "chunk_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("emotion", "segment_id"))).alias("r")).groupBy("run_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "r"))).alias("profiles"))
    chunks = by_chunk.join(refs, ["run_id", "chunk_id"], "left").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "segments", F.to_json("profiles").alias("p")))).alias("c"))
    full = F.transform("c", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["segments"].alias("segments"), F.from_json(c["p"], "map<string, array<struct<emotion:string, segment_id:long>>>").alias("profiles")))
    chunks.select("run_id", full.alias("chunks")).write.json(path)


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, profiles) of nested reports, one row each."""
    chunks = spark.read.schema(REPORT).json(path).select("run_id", F.explode("chunks").alias("c"))
    segments = chunks.select("run_id", "c.chunk_id", F.explode("c.segments").alias("s")).select("run_id", "chunk_id", "s.*")
    refs = chunks.select("run_id", "c.chunk_id", F.explode("c.profiles").alias("speaker", "r")).select("run_id", "chunk_id", "speaker", F.explode("r").alias("r")).select("run_id", "chunk_id", "speaker", "r.*")
    return segments, refs


ASR = "chunk_id long, result array<struct<text:string, language:string, words:array<struct<word:string, start:double, end:double, start_time:double, end_time:double, timestamp:array<double>>>>>"


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    """Words of the first entry of each result; times come as start/end, start_time/end_time or a pair."""
    first = spark.read.schema(ASR).json(path).select("chunk_id", F.get("result", F.lit(0)).alias("r"))
    w = first.select("chunk_id", lang_code(F.col("r.language")).alias("lang"), F.posexplode("r.words").alias("word_idx", "w"))
    ms = lambda a, b, i: F.round(F.coalesce(F.col(f"w.{a}"), F.col(f"w.{b}"), F.get("w.timestamp", F.lit(i))) * 1000).cast("long")
    return w.select("chunk_id", "lang", F.col("word_idx").cast("long").alias("word_idx"), "w.word", ms("start", "start_time", 0).alias("start_ms"), ms("end", "end_time", 1).alias("end_ms"))


def read_turns(spark: SparkSession, path: str, min_ms: int = 300) -> DataFrame:
    """Speaker turns with numeric labels named SPEAKER_nn; turns under min_ms are dropped."""
    raw = spark.read.schema("chunk_id long, turns array<struct<start:double, end:double, label:long>>").json(path)
    t = raw.select("chunk_id", F.posexplode("turns").alias("turn_idx", "t"))
    out = t.select("chunk_id", F.col("turn_idx").cast("long").alias("turn_idx"), F.format_string("SPEAKER_%02d", "t.label").alias("speaker"), F.round(F.col("t.start") * 1000).cast("long").alias("start_ms"), F.round(F.col("t.end") * 1000).cast("long").alias("end_ms"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


TRACKS = "chunk_id long, n_frames long, tracks array<struct<frames:array<long>, bboxes:array<array<double>>, scores:array<double>>>"


def read_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(face_frames, clips): a track's lists are cut to the shortest; a missing frame count is the last frame + 1."""
    raw = spark.read.schema(TRACKS).json(path)
    t = raw.select("chunk_id", "n_frames", F.posexplode("tracks").alias("track", "t"))
    n = F.least(F.size("t.frames"), F.size("t.bboxes"), F.size("t.scores"))
    rows = t.withColumn("n", n).where("n > 0").select("chunk_id", F.col("track").cast("long").alias("track"), F.explode(F.arrays_zip(*[F.slice(f"t.{c}", F.lit(1), F.col("n")).alias(c) for c in ("frames", "bboxes", "scores")])).alias("z"))
    frames = rows.select("chunk_id", "track", F.col("z.frames").alias("frame"), *[F.get("z.bboxes", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.col("z.scores").alias("score"))
    last = frames.groupBy("chunk_id").agg((F.max("frame") + 1).alias("last"))
    return frames, raw.select("chunk_id", "n_frames").join(last, "chunk_id", "left").select("chunk_id", F.coalesce("n_frames", "last").alias("n_frames"))


def write_index(chunks: DataFrame, path: str, fps: int = 25, threshold: float = 0.0) -> None:
    """An index document for each video: its chunks by name with their frame counts."""
    entries = F.array_sort(F.collect_list(F.struct("stem", "n_frames")))
    documents = chunks.groupBy("video").agg(entries.alias("chunks"))
    documents.select("video", F.lit(1).alias("version"), F.lit(fps).alias("fps"), F.lit(threshold).alias("score_threshold"), "chunks").write.json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(video, stem, ord, n_frames); entries without a frame count are dropped, order within a video is by name."""
    raw = spark.read.schema("video long, chunks array<struct<stem:string, n_frames:long>>").json(path)
    kept = F.array_sort(F.filter("chunks", lambda c: c["n_frames"].isNotNull()))
    return raw.select("video", F.posexplode(kept).alias("ord", "c")).select("video", "c.stem", F.col("ord").cast("long").alias("ord"), "c.n_frames")


def read_score_list(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """(file, mos) of header-less comma lists; short and unreadable rows are skipped; only files that exist, if given."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).select(F.trim(F.get(parts, F.lit(0))).alias("file"), F.get(parts, F.lit(1)).try_cast("double").alias("mos")).where("mos is not null")
    return rows if existing is None else rows.join(existing.select("file"), "file", "left_semi")


def read_clip_metadata(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(file, angle, noise, video) of JSON objects or one-element lists, keys in either case; broken files are skipped. A file
    that names no video stands for one of its own name."""
    raw = read_files(listed(spark, root, pattern))
    # Parsed once: filters would carry the parser with them, but not past a generator. A broken file has no value. Spark's own
    # field names do not tell case apart, paths into a value do.
    parsed = raw.select(F.col("name").alias("file"), F.explode(F.array_compact(F.array(F.try_parse_json("value")))).alias("v"))
    pick = lambda where, *names: F.coalesce(*[F.try_variant_get("v", f"{top}.{where}.{n}", "string") for top in ("$", "$[0]") for n in names])
    out = parsed.select("file", pick("Video_env", "Angle", "angle").alias("angle"), pick("Audio_env", "Noise", "noise").alias("noise"), pick("Video_info", "video_Name", "video_name").alias("video"))
    return out.where("angle is not null or noise is not null or video is not null").withColumn("video", F.coalesce("video", F.concat(F.regexp_replace("file", r"\.\w+$", ""), F.lit(".mp4"))))


def filter_clips(meta: DataFrame, angle: str | None = None, noise: str | None = None) -> DataFrame:
    for name, value in (("angle", angle), ("noise", noise)):
        if value is not None:
            meta = meta.where(F.col(name) == value)
    return meta


def media_inventory(spark: SparkSession, root: str, pattern: str = "*", min_bytes: int = 0) -> DataFrame:
    """(path, name, length) of files; contents are not read."""
    return spread(listed(spark, root, pattern).where(F.col("length") >= min_bytes), "path")


def with_media(meta: DataFrame, media: DataFrame) -> DataFrame:
    """Metadata (video) with path and length of the media file (path, name, length) of that base name, the first path where
    several have it; metadata whose file is nowhere is left out."""
    first = media.groupBy(F.col("name").alias("video")).agg(F.min_by(F.struct("path", "length"), "path").alias("m"))
    return meta.join(first.select("video", "m.path", "m.length"), "video")


def pending(pairs: DataFrame, made: DataFrame, least_bytes: int = 1024) -> DataFrame:
    """Pairs (path of a media file) without a made file (name, length) of the same stem that has more than `least_bytes`."""
    stem = lambda name: F.regexp_replace(name, r"\.\w+$", "")
    done = made.where(F.col("length") > least_bytes).select(stem(F.col("name")).alias("stem")).distinct()
    return pairs.withColumn("stem", stem(F.element_at(F.split("path", "/"), -1))).join(done, "stem", "left_anti").drop("stem")


def content_hash(files: DataFrame) -> DataFrame:
    """(path, fingerprint): first 16 hex digits of md5(first megabyte, last megabyte, size) of files (path, length).

    Tasks open the files and read the two ends only, whatever their size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from timeweave.sources.tail import opened

        for pdf in batches:
            out = []
            for path, length in zip(pdf["path"], pdf["length"].tolist()):
                store, name = opened(path)
                with store.open_input_file(name) as f:
                    digest = hashlib.md5(f.read_at(min(MEGABYTE, length), 0))
                    digest.update(f.read_at(min(MEGABYTE, length), max(0, length - MEGABYTE)))
                digest.update(str(length).encode())
                out.append(digest.hexdigest()[:16])
            yield pd.DataFrame({"path": pdf["path"], "fingerprint": out})

    return files.select("path", "length").mapInPandas(run, "path string, fingerprint string")


def new_run_id(name: str, now: datetime | None = None) -> str:
    short = re.sub("[^a-zA-Z0-9가-힣]", "", name)[:10] or "run"
    return f"{(now or datetime.now()):%Y%m%d_%H%M%S}_{short}_{uuid.uuid4().hex[:6]}"


def write_run(df: DataFrame, run_id: str, path: str) -> None:
    """Write one run's partition; the same id replaces it and leaves other runs alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_train_log(spark: SparkSession, path: str, tail_chars: int = 200_000) -> DataFrame:
    """(log, seq, line) of the last characters of each file; lines end at a carriage return or newline."""
    # A character has four bytes at most.
    raw = read_files(listed(spark, path), 4 * tail_chars).select(F.regexp_replace("name", r"\.\w+$", "").alias("log"), F.expr(f"right(value, {tail_chars})").alias("tail"))
    return raw.select("log", F.posexplode(F.split("tail", "[\r\n]")).alias("seq", "line")).where("line <> ''")


def write_manifest(df: DataFrame, path: str, column: str = "path") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_texts(texts: DataFrame, folder: str, ending: str = ".log", folders: bool = False) -> None:
    """One file a row (name, content): written whole by its task, so a task that runs again writes the same file. With
    `folders` each task writes to a numbered folder of its own, so none holds very many files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from timeweave.sources.tail import opened

        store, root = opened(folder)
        if folders:
            root = f"{root}/{TaskContext.get().partitionId():06d}"
        store.create_dir(root)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                with store.open_output_stream(f"{root}/{name}{ending}") as f:
                    f.write(content.encode())
            yield pdf[["name"]]

    spread(texts.select("name", "content"), "name").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def write_validation(words: DataFrame, ratios: DataFrame, path: str, first: int = 200) -> None:
    """One document a chunk: its figures and first words."""
    head = F.slice(F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms"))), 1, first)
    words.groupBy("chunk_id").agg(F.max("end_ms").alias("duration_ms"), head.alias("words")).join(ratios, "chunk_id", "left").write.json(path)


def score_with(df: DataFrame, column: str, scorer, load) -> Column:
    """Batch scoring hook: load() runs once a worker, scorer(model, list) a batch; a batch that fails is tried row by
    row, and a row that fails scores 0."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            items = b.tolist()
            try:
                yield pd.Series([float(x) for x in scorer(model, items)])
            except Exception:
                out = []
                for i in items:
                    try:
                        out.append(float(scorer(model, [i])[0]))
                    except Exception:
                        out.append(0.0)
                yield pd.Series(out)

    return run(F.col(column))
