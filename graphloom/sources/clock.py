"""A stream source whose offset is a position in an append-only log, with admission by elements.

The source doesn't move data: a batch is a range (after, upto], so many positions wide at most.  Whoever handles the batch
reads these positions from the log with a pushed filter, so files whose statistics lie outside aren't opened.  As the offset is
in the stream's checkpoint, a restart goes on after the last batch, and a repeated batch has the same range.

Where the log is ahead, a trigger may take several batches (at_once).  It's given as runs: a row (batch, after, upto] stands for
the batches of so many positions one after the other, numbered from batch on.  The numbers and runs are in the offset, too.

The end of the log comes from the footers of its Parquet files, of new ones only; positions must be whole numbers and unique
(a batch then has as many elements as positions at most).  Ranges without any element are skipped where footers show it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


#: Runs of a trigger at most: a new one begins behind a gap between files.
RUNS = 16


class LogClock(DataSource):
    """Options: path (a Parquet file or folder), column, max_elements, at_once (1 unless given), start (the position after which to begin, -1 unless given)."""

    @classmethod
    def name(cls) -> str:
        return "log_clock"

    def schema(self) -> str:
        return "batch long, after long, upto long"

    def simpleStreamReader(self, schema: StructType) -> LogClockReader:
        return LogClockReader(self.options)


class LogClockReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.column = options["path"], options["column"]
        self.most = int(options.get("max_elements", "10000"))
        self.at_once = int(options.get("at_once", "1"))
        self.start = int(options.get("start", "-1"))
        self.known: dict[str, tuple[int, int] | None] = {}

    def initialOffset(self) -> dict:
        return {"position": self.start, "batches": 0}

    def _ranges(self) -> list[tuple[int, int]]:
        """(least, most) position of every file."""
        fs, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path.removeprefix("file:"))
        for fragment in ds.dataset(path, filesystem=fs, format="parquet").get_fragments():
            if fragment.path not in self.known:
                groups = [g.statistics.get(self.column) for g in fragment.row_groups]
                ends = [(g["min"], g["max"]) for g in groups if g]
                self.known[fragment.path] = (min(a for a, _ in ends), max(b for _, b in ends)) if ends else None
        return sorted(r for r in self.known.values() if r)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        ranges = sorted((b, a) for a, b in self._ranges())
        ends = [b for b, _ in ranges]
        first = [*accumulate((a for _, a in reversed(ranges)), min)][::-1]  # the least position of a file and those that end later
        after, count, runs = start["position"], start["batches"], []
        for _ in range(self.at_once):
            i = bisect_right(ends, after)
            if i == len(ends):
                break
            begin = max(after, first[i] - 1)
            if not runs or begin > after:
                if len(runs) == RUNS:
                    break
                runs.append([count, begin, begin])
            after = runs[-1][2] = min(begin + self.most, ends[-1])
            count += 1
        if not runs:
            return iter([]), start
        return iter([tuple(r) for r in runs]), {"position": after, "batches": count, "runs": runs}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([tuple(r) for r in end["runs"]])

    def commit(self, end: dict) -> None:
        pass
