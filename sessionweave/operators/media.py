"""Reconciliation of segment manifests with raw media files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import numeric_id
from .validate import require_empty, require_unique

WARNING_SECONDS = 1.0
DIAGNOSTIC_COLUMNS = ("segment_id", "reason", "manifest_count", "raw_count", "label_idx", "local_video_id", "duration_difference_sec")


def build_manifest(segments: DataFrame) -> DataFrame:
    """Identity columns, with audio_path and video_path not yet known, by segment and time."""
    return segments.select(F.col("segment_id").cast("string"), F.col("label_idx").cast("int"), F.col("start").cast("double"), F.col("end").cast("double"), F.lit(None).cast("string").alias("audio_path"), F.lit(None).cast("string").alias("video_path")).orderBy("segment_id", "start", "end", "label_idx")


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """Counts of missing keys, doubled keys, and intervals that aren't finite or don't end after they start; one row."""
    from ..functions.missing import is_finite

    bad = ~is_finite(F.col("start")) | ~is_finite(F.col("end")) | F.coalesce(F.col("end") <= F.col("start"), F.lit(False))
    return manifest.agg(
        F.count_if(F.col("segment_id").isNull() | F.col("label_idx").isNull()).alias("missing_keys"),
        (F.count("*") - F.count_distinct(F.struct("segment_id", "label_idx"))).alias("doubled_keys"),
        F.count_if(bad).alias("bad_intervals"),
    )


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("segment_id").agg(F.count("*").alias(name))


def exception_errors(manifest: DataFrame, raw: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(segment_id, label_idx, local_video_id, errors) of exceptions that don't fit: doubled rows or files, rows or files that don't exist,
    and sources whose counts agree, so that nothing is to be excepted. Each error is a name; exceptions without any are left out."""
    named = exceptions.select("segment_id", "label_idx", "local_video_id", F.lit(True).alias("_named"))
    keyed = lambda *keys: reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))

    def met(own: DataFrame, others: DataFrame, twice: str, there: str, *keys: str) -> DataFrame:
        same = Window.partitionBy(*keys)
        marks = {twice: F.count_if(F.col("_named")).over(same) > 1, there: keyed(*keys) & (F.count_if(F.col("_named").isNull()).over(same) > 0)}
        return own.unionByName(others.select(*keys), allowMissingColumns=True).withColumns(marks).where("_named")

    marked = met(named, manifest, "_rows", "_row", "segment_id", "label_idx")
    marked = met(marked, raw, "_files", "_file", "segment_id", "local_video_id")
    even = _counts(manifest, "a").join(_counts(raw, "b"), "segment_id").where("a = b").select("segment_id", F.lit(True).alias("_even"))
    found = marked.join(even, "segment_id", "left")
    rules = {"doubled row": F.col("_rows"), "doubled file": F.col("_files"), "no such row": ~F.col("_row"), "no such file": ~F.col("_file"), "counts agree": F.col("_even").isNotNull()}
    errors = F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items())))
    return found.select("segment_id", "label_idx", "local_video_id", errors.alias("errors")).where(F.size("errors") > 0)


def _checked(manifest: DataFrame, raw: DataFrame, exceptions: DataFrame | None) -> None:
    """Raises if file ids aren't numbers or are twice in a source ("1" and "01" are one), manifest keys double, or exceptions don't name rows and
    files that exist, of sources whose counts differ."""
    numbers = raw.select("segment_id", numeric_id(F.col("local_video_id")).alias("number"))
    require_empty(numbers.where("number is null"), "file ids that aren't numbers")
    require_unique(numbers, ["segment_id", "number"])
    require_unique(manifest, ["segment_id", "label_idx"])
    if exceptions is None:
        return
    named = exceptions.select("segment_id", "label_idx", "local_video_id")
    require_unique(named, ["segment_id", "label_idx"])
    require_unique(named, ["segment_id", "local_video_id"])
    require_empty(named.join(manifest, ["segment_id", "label_idx"], "left_anti"), "exceptions without a manifest row")
    require_empty(named.join(raw, ["segment_id", "local_video_id"], "left_anti"), "exceptions without a file")
    even = _counts(manifest, "a").join(_counts(raw, "b"), "segment_id").where("a = b")
    require_empty(named.join(even, "segment_id", "left_semi"), "exceptions of sources whose counts agree")


def _suspect(manifest: DataFrame, raw: DataFrame, exceptions: DataFrame | None) -> bool:
    """Whether `_checked` may find anything, in one pass: rows and exceptions are counted by source and row, files and exceptions by source and
    number, and both then by source. Keys with a NULL in them are suspect where joins wouldn't meet them, and so are exceptions beside a file
    id that isn't written like its number."""
    number = F.col("local_video_id").cast("string").try_cast("long")
    row = F.struct(F.lit("row").alias("kind"), F.col("label_idx").try_cast("long").alias("key"), F.lit(True).alias("plain"))
    file = F.struct(F.lit("file").alias("kind"), number.alias("key"), F.coalesce(number.cast("string") == F.col("local_video_id").cast("string"), F.lit(False)).alias("plain"))
    side = lambda df, n, key: df.select("segment_id", F.lit(n).alias("side"), key.alias("k"))
    every = side(manifest, 0, row).unionByName(side(raw, 0, file))
    if exceptions is not None:
        every = every.unionByName(side(exceptions, 1, row)).unionByName(side(exceptions, 1, file))
    counts = [F.count_if(F.col("side") == 0).alias("there"), F.count_if(F.col("side") == 1).alias("named"), F.bool_and("plain").alias("plain")]
    met = every.select("segment_id", "side", "k.*").groupBy("segment_id", "kind", "key").agg(*counts)
    missing = F.col("segment_id").isNull() | F.col("key").isNull() | (F.col("there") == 0) | ~F.col("plain")
    wrong = (F.col("there") > 1) | (F.col("named") > 1) | ((F.col("kind") == "file") & F.col("key").isNull()) | ((F.col("named") > 0) & missing)
    total = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    sources = met.groupBy("segment_id").agg(F.bool_or(wrong).alias("wrong"), ((total("row", "named") > 0) & (total("row", "there") == total("file", "there"))).alias("even"))
    return bool(sources.agg(F.bool_or(F.col("wrong") | F.col("even"))).first()[0])


def map_media(manifest: DataFrame, raw: DataFrame, exceptions: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Every manifest row and every file that no row has, in one table: segment_id, label_idx, start, end, chronological_rank,
    local_video_id, video_path, duration_sec, has_video, has_audio, manifest_count, raw_count.

    Where a source has as many files as rows, the i-th row by time takes the i-th file by number; elsewhere only exceptions pair
    them. Rows, files and exceptions are put together and dealt by source once; counts, places and partners are windows within a
    source. Of a row without a file the file's columns are NULL, of a file without a row the row's. With `check`, what doesn't fit raises.
    """
    if check and _suspect(manifest, raw, exceptions):
        _checked(manifest, raw, exceptions)
    media = [c for c in ("video_path", "duration_sec", "has_video", "has_audio") if c in raw.columns]
    rows = manifest.select("segment_id", F.lit(0).alias("side"), "label_idx", "start", "end")
    files = raw.select("segment_id", F.lit(1).alias("side"), "local_video_id", numeric_id(F.col("local_video_id")).alias("number"), *media)
    both = rows.unionByName(files, allowMissingColumns=True)
    if exceptions is not None:
        both = both.unionByName(exceptions.select("segment_id", F.lit(2).alias("side"), "label_idx", "local_video_id"), allowMissingColumns=True)
    source = lambda *more: Window.partitionBy("segment_id", *more)
    row, file = F.col("side") == 0, F.col("side") == 1
    placed = both.withColumn("_place", F.row_number().over(source().orderBy("side", "start", "end", "label_idx", "number", "local_video_id")) - 1)
    counted = placed.withColumns({"manifest_count": F.count_if(row).over(source()), "raw_count": F.count_if(file).over(source())})
    ranked = counted.withColumn("rank", F.when(row, F.col("_place")).otherwise((F.col("_place") - F.col("manifest_count")).cast("int")))
    partner = F.when(F.col("manifest_count") == F.col("raw_count"), F.col("rank"))
    if exceptions is not None:
        ranked = ranked.withColumn("_file", F.max(F.when(F.col("side") == 2, F.col("label_idx"))).over(source("local_video_id"))).where("side < 2")
        partner = partner.when(row, F.col("label_idx")).when(file, F.col("_file"))
    paired = ranked.withColumn("_pair", partner)
    whole = F.struct("local_video_id", *media)
    met = paired.withColumns({"_has": F.max(F.when(file & F.col("_pair").isNotNull(), whole)).over(source("_pair")), "_taken": F.max(F.when(row & F.col("_pair").isNotNull(), True)).over(source("_pair"))})
    kept = met.where(row | F.col("_pair").isNull() | F.col("_taken").isNull())
    own = lambda c: F.when(row, F.when(F.col("_pair").isNotNull(), F.col(f"_has.{c}"))).otherwise(F.col(c)).alias(c)
    rank = F.when(row & F.col("_pair").isNotNull() & F.col("_has").isNotNull(), F.col("rank")).alias("chronological_rank")
    return kept.select("segment_id", "label_idx", "start", "end", rank, own("local_video_id"), *(own(c) for c in media), "manifest_count", "raw_count", row.alias("in_manifest"))


def pair_media(manifest: DataFrame, raw: DataFrame, exceptions: DataFrame | None = None, check: bool = True) -> DataFrame:
    """(segment_id, label_idx, local_video_id, chronological_rank) of the manifest rows that `map_media` finds a file for."""
    found = map_media(manifest, raw, exceptions, check).where("in_manifest and local_video_id is not null")
    return found.select("segment_id", "label_idx", "local_video_id", "chronological_rank")


def _judged(mapped: DataFrame, warning: float) -> DataFrame:
    """Manifest rows of map_media with the check of their duration."""
    found = F.col("local_video_id").isNotNull()
    length = F.col("end") - F.col("start")
    gap = F.abs(F.col("duration_sec") - length)
    return mapped.where("in_manifest").select(
        "segment_id", "label_idx", "start", "end", "chronological_rank", "local_video_id", "video_path", F.col("duration_sec").alias("media_duration_sec"),
        length.alias("manifest_duration_sec"), gap.alias("duration_difference_sec"),
        F.coalesce("has_video", F.lit(False)).alias("has_video"), F.coalesce("has_audio", F.lit(False)).alias("has_audio"),
        found.alias("media_available"), F.when(found, "MAPPED").otherwise("MEDIA_UNAVAILABLE").alias("mapping_status"),
        F.when(gap <= warning, "CLOSE").when(gap > warning, "WARNING").otherwise("NOT_AVAILABLE").alias("duration_validation"),
        "manifest_count", "raw_count",
    )


def mapped_manifest(mapped: DataFrame, warning: float = WARNING_SECONDS) -> DataFrame:
    """Every manifest row of `map_media` with its file, or marked MEDIA_UNAVAILABLE, and the check of its duration."""
    return _judged(mapped, warning).drop("manifest_count", "raw_count")


def mapped_diagnostics(mapped: DataFrame, warning: float = WARNING_SECONDS) -> DataFrame:
    """What didn't fit in `map_media`: durations, rows without files and files without rows, with both counts of the source."""
    gap = F.when(F.col("in_manifest"), F.abs(F.col("duration_sec") - (F.col("end") - F.col("start"))))
    without = F.when(F.col("raw_count") == 0, "MISSING_RAW_SOURCE").otherwise("MEDIA_UNAVAILABLE")
    row = F.when(F.col("local_video_id").isNull(), without).when(gap > warning, "DURATION_WARNING")
    file = F.when(F.col("manifest_count") == 0, "RAW_ONLY_SOURCE").otherwise("EXTRA_RAW_MEDIA")
    reasons = mapped.withColumns({"duration_difference_sec": gap, "reason": F.when(F.col("in_manifest"), row).otherwise(file)})
    return reasons.where("reason is not null").select(*DIAGNOSTIC_COLUMNS)


def media_manifest(manifest: DataFrame, raw: DataFrame, pairs: DataFrame, warning: float = WARNING_SECONDS) -> DataFrame:
    """Every manifest row with its file, or marked MEDIA_UNAVAILABLE, and the check of its duration."""
    media = raw.select("segment_id", "local_video_id", "video_path", F.col("duration_sec").alias("media_duration_sec"), "has_video", "has_audio")
    full = manifest.select("segment_id", "label_idx", "start", "end").join(pairs, ["segment_id", "label_idx"], "left").join(media, ["segment_id", "local_video_id"], "left")
    found = F.col("local_video_id").isNotNull()
    length = F.col("end") - F.col("start")
    gap = F.abs(F.col("media_duration_sec") - length)
    return full.select(
        "segment_id", "label_idx", "start", "end", "chronological_rank", "local_video_id", "video_path", "media_duration_sec",
        length.alias("manifest_duration_sec"), gap.alias("duration_difference_sec"),
        F.coalesce("has_video", F.lit(False)).alias("has_video"), F.coalesce("has_audio", F.lit(False)).alias("has_audio"),
        found.alias("media_available"), F.when(found, "MAPPED").otherwise("MEDIA_UNAVAILABLE").alias("mapping_status"),
        F.when(gap <= warning, "CLOSE").when(gap > warning, "WARNING").otherwise("NOT_AVAILABLE").alias("duration_validation"),
    )


def media_diagnostics(manifest: DataFrame, raw: DataFrame, pairs: DataFrame, warning: float = WARNING_SECONDS) -> DataFrame:
    """What didn't fit: durations, rows without files and files without rows, with both counts of the source."""
    counts = _counts(manifest, "manifest_count").join(_counts(raw, "raw_count"), "segment_id", "full").na.fill(0, ["manifest_count", "raw_count"])
    mapped = media_manifest(manifest, raw, pairs, warning)
    rows = mapped.where("not media_available or duration_validation = 'WARNING'").join(counts, "segment_id")
    reason = F.when(F.col("media_available"), "DURATION_WARNING").when(F.col("raw_count") == 0, "MISSING_RAW_SOURCE").otherwise("MEDIA_UNAVAILABLE")
    extra = raw.select("segment_id", "local_video_id").join(pairs, ["segment_id", "local_video_id"], "left_anti").join(counts, "segment_id")
    extra = extra.withColumn("reason", F.when(F.col("manifest_count") == 0, "RAW_ONLY_SOURCE").otherwise("EXTRA_RAW_MEDIA"))
    nothing = {"label_idx": F.lit(None).cast("int"), "duration_difference_sec": F.lit(None).cast("double")}
    return rows.withColumn("reason", reason).select(*DIAGNOSTIC_COLUMNS).unionByName(extra.withColumns(nothing).select(*DIAGNOSTIC_COLUMNS))


def mapping_errors(mapped: DataFrame) -> DataFrame:
    """Counts of broken invariants of media_manifest's result; one row, all zero for a sound mapping."""
    taken = F.col("local_video_id").isNotNull()
    return mapped.agg(
        (F.count("*") - F.count_distinct(F.struct("segment_id", "label_idx"))).alias("doubled_rows"),
        (F.count_if(taken) - F.count_distinct(F.when(taken, F.struct("segment_id", "local_video_id")))).alias("doubled_files"),
        F.count_if(F.col("media_available") != taken).alias("wrong_availability"),
        F.count_if((F.col("mapping_status") == "MAPPED") != taken).alias("wrong_status"),
        F.count_if(F.col("media_available") & F.col("video_path").isNull()).alias("missing_paths"),
    )


def listed_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """`file` of everything below a folder of any store that Spark reads; names only, listed by Spark, in parallel where
    folders are many. Spark leaves out files without content."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return listing.select(plain_path(F.col("path")).alias("file"))


def plain_path(path: Column) -> Column:
    """A path without its store's name, so that file:/a and /a are one."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def missing_files(mapped: DataFrame, files: DataFrame) -> DataFrame:
    """Mapped rows of media_manifest's result whose video_path isn't among `files`: one join with the listing, no look at each file."""
    taken = mapped.where("local_video_id is not null and video_path is not null")
    return taken.join(files.select(F.col("file").alias("_file")).distinct(), plain_path(F.col("video_path")) == F.col("_file"), "left_anti")


def check_mapping(mapped: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """mapped, if no invariant of it is broken and, given a listing, all its files exist; else an error that names what is wrong."""
    broken = {k: n for k, n in mapping_errors(mapped).first().asDict().items() if n}
    if broken:
        raise ValueError(f"mapping: {broken}")
    if files is not None:
        require_empty(missing_files(mapped, files), "mapped files that don't exist")
    return mapped


def attach_media(manifest: DataFrame, mapping: DataFrame, check: bool = True) -> DataFrame:
    """Left join of one mapping row at most per manifest row; the mapping's columns that clash get the suffix _mapped."""
    keys = ["segment_id", "label_idx"]
    if check:
        require_unique(manifest, keys)
        require_unique(mapping, keys)
    clashing = [c for c in mapping.columns if c in manifest.columns and c not in keys]
    return manifest.join(mapping.withColumnsRenamed({c: f"{c}_mapped" for c in clashing}), keys, "left")
