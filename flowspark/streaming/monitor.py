"""Directory watch: finished exports are scored once, bad ones are set aside."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from flowspark.plans.scoring import Scorer, score_rows
from flowspark.session import collect_bounded
from flowspark.sources.files import (
    base_name, csv_headers, exists, free_name, inspect_headers, list_files, make_folder, rename, write_text,
)
from flowspark.sources.flowcsv import number_rows, read_flows

FILES_PER_BATCH = 1000
PATH_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass
class Stager:
    """Moves exports that stopped changing into the watched folder.

    Producers that write in place need it: the stream takes a file the moment it
    sees it, so only files with the same size and time in ``checks`` consecutive
    listings are renamed into its folder.  Producers that rename finished files
    into the watched folder themselves do not need it.
    """

    spark: SparkSession
    incoming: str
    watched: str
    checks: int = 2
    seen: dict[str, tuple[int, int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.checks < 2:
            raise ValueError("A file must be seen twice or more before it counts as written.")
        make_folder(self.spark, self.incoming)
        make_folder(self.spark, self.watched)

    def scan_once(self) -> list[str]:
        """List once; returns the files that were moved."""
        listed = {path: (size, time) for path, size, time in list_files(self.spark, self.incoming, ".csv")}
        self.seen = {path: state for path, state in self.seen.items() if path in listed}
        moved = []
        for path, state in sorted(listed.items()):
            times = self.seen[path][2] + 1 if path in self.seen and self.seen[path][:2] == state else 1
            self.seen[path] = (*state, times)
            if times >= self.checks:
                target = free_name(self.spark, self.watched, base_name(path))
                try:
                    rename(self.spark, path, target)
                except Exception:
                    # The producer may have removed it in between; look again next time.
                    if exists(self.spark, path):
                        raise
                    self.seen.pop(path, None)
                    continue
                self.seen.pop(path, None)
                moved.append(target)
        return moved


@dataclass
class FlowMonitor:
    """Streaming scorer of a watched folder.

    The file source's log decides which files are new.  A micro-batch validates the
    headers, sets incompatible files aside with an error note, scores the others in
    one job, publishes its result folder, and archives the sources the result names.
    A file that cannot be read is set aside and the others proceed.  A repeated batch
    finds its published result and only finishes the moves.  Results are kept by the
    run (one for each checkpoint) and the number of the batch.
    """

    spark: SparkSession
    watched: str
    alerts: str
    processed: str
    failed: str
    features: Sequence[str]
    scorer: Scorer
    threshold: float
    version: str
    files_per_batch: int = FILES_PER_BATCH

    def __post_init__(self) -> None:
        for folder in (self.watched, self.alerts, self.processed, self.failed):
            make_folder(self.spark, folder)

    def set_aside(self, path: str, error: str) -> None:
        """Quarantine a source file together with the reason."""
        if not exists(self.spark, path):
            return
        target = free_name(self.spark, self.failed, base_name(path))
        rename(self.spark, path, target)
        write_text(self.spark, f"{target}.error.json", json.dumps({"source_file": target, "error": error}, indent=2))

    def archive(self, paths: Sequence[str]) -> None:
        for path in paths:
            if not exists(self.spark, path):
                continue
            try:
                rename(self.spark, path, free_name(self.spark, self.processed, base_name(path)))
            except Exception as error:
                # The scores exist already, so the file must not be scored again.
                self.set_aside(path, f"scored_archive_failed: {error}")

    def result_path(self, number: int, run: str) -> str:
        return f"{self.alerts.rstrip('/')}/run={run}/batch={number}"

    def readable(self, paths: Sequence[str]) -> list[str]:
        """The files that can be read to their end, one by one; the others are set aside."""
        good = []
        for path in paths:
            try:
                flows = read_flows(self.spark, [path], self.features)
                flows.write.format("noop").mode("overwrite").save()
            except Exception as error:
                self.set_aside(path, f"cannot be read: {error}")
            else:
                good.append(path)
        return good

    def compatible(self, paths: Sequence[str]) -> list[str]:
        """The files with all features under names of their own; the others are set aside."""
        report = inspect_headers(csv_headers(self.spark, paths), self.features)
        good = []
        for row in collect_bounded(report, "Files of a batch"):
            if row["missing_feature_count"]:
                self.set_aside(row["file"], f"missing features: {row['missing_required_features']}")
            elif row["duplicate_normalized_columns"]:
                self.set_aside(row["file"], f"duplicate columns: {row['duplicate_normalized_columns']}")
            else:
                good.append(row["file"])
        return good

    def publish(self, paths: Sequence[str], output: str) -> list[str]:
        """Score the compatible files, unless their result is there; returns these files."""
        good = self.compatible(paths) if paths else []
        if good and not exists(self.spark, f"{output}/_SUCCESS"):
            flows = number_rows(read_flows(self.spark, good, self.features))
            results = score_rows(
                flows, self.features, self.scorer, self.threshold, self.version, ["source_file", "source_row"]
            )
            results.write.mode("overwrite").parquet(output)
        return good

    def process(self, batch: DataFrame, number: int, run: str = "direct") -> None:
        """One micro-batch; ``batch`` is a bounded list of file paths."""
        paths = [r["path"] for r in collect_bounded(batch.select("path"), "Files of a batch")]
        output = self.result_path(number, run)
        present = [p for p in paths if exists(self.spark, p)]
        if not present:
            return
        try:
            good = self.publish(present, output)
        except Exception:
            # Only now each file is tried alone; if none is to blame, the fault is not theirs.
            rest = [p for p in present if exists(self.spark, p)]
            good = self.readable(rest)
            if len(good) == len(rest):
                raise
            good = self.publish(good, output)
        if not good:
            return
        published = self.spark.read.parquet(output).select("source_file").distinct()
        scored = {posixpath.basename(r[0]) for r in collect_bounded(published, "Scored files")}
        for path in good:
            if base_name(path) not in scored:
                self.set_aside(path, "Input CSV contained no flow records")
        self.archive([p for p in good if base_name(p) in scored])

    def source(self) -> DataFrame:
        """Stream of new file paths; contents are not read here."""
        return (
            self.spark.readStream.format("binaryFile")
            .schema(PATH_SCHEMA)
            .option("pathGlobFilter", "*.csv")
            .option("maxFilesPerTrigger", self.files_per_batch)
            .load(self.watched)
            .select("path")
        )

    def run_of(self, checkpoint: str) -> str:
        """Name of the run, noted in its checkpoint: batch numbers start anew with each checkpoint."""
        note = f"{checkpoint.rstrip('/')}/flow-monitor-run"
        if not exists(self.spark, note):
            make_folder(self.spark, checkpoint)
            write_text(self.spark, note, f"r{uuid.uuid4().hex}")
        return self.spark.read.text(note).first()[0]

    def start(self, checkpoint: str, **trigger):
        """Start the watch; ``availableNow=True`` processes what is there and ends."""
        run = self.run_of(checkpoint)
        return (
            self.source()
            .writeStream.foreachBatch(lambda batch, number: self.process(batch, number, run))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"}))
            .start()
        )

    def scores(self) -> DataFrame:
        """Everything scored so far, one row per input row."""
        return self.spark.read.parquet(self.alerts)
