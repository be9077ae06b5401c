"""Expressions on stored-file paths and archive file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout of crawl output paths (.../output/<job>/<launch>/<folder>/<file>) and of archive file names.
OUTPUT_FOLDERS = ("warcs", "viral", "logs")
# The end of an output path; a line end may follow the launch's 14 digits.
OUTPUT_PATH = rf"(?:^|/)output/[^/]*/[0-9]{{14}}(?:\r\n|[\n\r\u0085\u2028\u2029])?/(?:{'|'.join(OUTPUT_FOLDERS)})/[^/]+\z"
DOMAIN_JOB = r"^dc[0-9]{4}"
ARCHIVE_NAME = r"^(.+?)-([0-9]{17})-([0-9]+)-([0-9]+)~([^~]+)~([0-9]+)\.warc\.gz$"
CHECKPOINT_START = "crawl.log.cp"
CHECKPOINT_LOG = r"crawl\.log\.cp([0-9]+)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _part(text: Column | str, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit(""))


def _segment(path: Column, from_end: int) -> Column:
    return F.substring_index(F.substring_index(path, "/", -from_end), "/", 1)


def path_parts(path: Column | str) -> Column:
    """Struct (job, launch_id, folder, kind, stream, basis, file_name) of a storage path.

    All but the file name, kind and stream are null where the path is not a crawl output path. Our rules: kind is
    ``warcs``, ``viral``, ``crawl-logs``, ``logs`` or ``other``; stream follows the job name (``frequent*``,
    ``dc<year>`` = domain, ``webrecorder*``); basis is the text after the job's dash, and domain crawls
    run under legal deposit.
    """
    path = _col(path)
    name, folder_, launch, job = (_segment(path, i) for i in (1, 2, 3, 4))
    # one pattern: a computed path is put in anew, and evaluated, for each place that names it
    is_output = path.contains("/output/") & path.rlike(OUTPUT_PATH)
    is_domain = job.rlike(DOMAIN_JOB)
    kind = (
        F.when(~is_output, F.lit("other"))
        .when(folder_ == "viral", F.lit("viral"))
        .when(folder_ == "warcs", F.when(name.endswith(".warc.gz"), F.lit("warcs")).otherwise(F.lit("other")))
        .when(name.startswith("crawl.log"), F.lit("crawl-logs"))
        .otherwise(F.lit("logs"))
    )
    stream_ = (
        F.when(~is_output, F.lit("other"))
        .when(job.startswith("frequent"), F.lit("frequent"))
        .when(is_domain, F.lit("domain"))
        .when(job.startswith("webrecorder"), F.lit("webrecorder"))
        .otherwise(F.lit("other"))
    )
    basis = F.when(is_domain, F.lit("npld")).otherwise(F.nullif(F.regexp_extract(job, r"-([a-z]+)$", 1), F.lit("")))
    return F.struct(
        F.when(is_output, job).alias("job"),
        F.when(is_output, launch).alias("launch_id"),
        F.when(is_output, folder_).alias("folder"),
        kind.alias("kind"),
        stream_.alias("stream"),
        F.when(is_output, basis).alias("basis"),
        name.alias("file_name"),
    )


def job_name(path: Column | str) -> Column:
    return path_parts(path)["job"]


def launch_id(path: Column | str) -> Column:
    return path_parts(path)["launch_id"]


def folder(path: Column | str) -> Column:
    return path_parts(path)["folder"]


def file_kind(path: Column | str) -> Column:
    return path_parts(path)["kind"]


def stream(path: Column | str) -> Column:
    return path_parts(path)["stream"]


def legal_basis(path: Column | str) -> Column:
    return path_parts(path)["basis"]


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def archive_prefix(name: Column | str) -> Column:
    return _part(name, ARCHIVE_NAME, 1)


def archive_ts17(name: Column | str) -> Column:
    return _part(name, ARCHIVE_NAME, 2)


def archive_serial(name: Column | str) -> Column:
    return _part(name, ARCHIVE_NAME, 3).cast("bigint")


def archive_pid(name: Column | str) -> Column:
    return _part(name, ARCHIVE_NAME, 4).cast("bigint")


def archive_host(name: Column | str) -> Column:
    return _part(name, ARCHIVE_NAME, 5)


def archive_port(name: Column | str) -> Column:
    return _part(name, ARCHIVE_NAME, 6).cast("int")


def checkpoint_number(path: Column | str) -> Column:
    return _part(path, CHECKPOINT_LOG, 1).cast("bigint")
