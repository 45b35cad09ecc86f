"""A prompt on a store: fill, get, scan, put, delete, flush, compact, full_compaction, dump, quit."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .model import Bound
from .plans import compaction
from .sources.store import Store, fill

STRATEGIES = {"none": compaction.NoCompaction, "simple": compaction.SimpleLeveled, "leveled": compaction.Leveled, "tiered": compaction.Tiered}


class Prompt:
    """One command a line; ``run`` yields the lines to print."""

    def __init__(self, store: Store):
        self.store, self.epoch = store, 0

    def run(self, line: str) -> Iterable[str]:
        name, *args = line.split()
        if name == "fill" and len(args) == 2:
            n = fill(self.store, int(args[0]), int(args[1]), self.epoch)
            yield f"{n} values filled with epoch {self.epoch}"
            self.epoch += 1
        elif name == "put" and len(args) == 2:
            self.store.put(args[0].encode(), args[1].encode())
        elif name == "delete" and len(args) == 1:
            self.store.delete(args[0].encode())
        elif name == "get" and len(args) == 1:
            value = self.store.get(args[0].encode())
            yield f"{args[0]} not exist" if value is None else f"{args[0]}={value.decode(errors='replace')}"
        elif name == "scan" and len(args) in (0, 2):
            bounds = [Bound.incl(a.encode()) for a in args] or [Bound.unbounded()] * 2
            count = 0
            for row in self.store.scan(*bounds).toLocalIterator():
                count += 1
                yield f"{bytes(row['key']).decode(errors='replace')}={bytes(row['value']).decode(errors='replace')}"
            yield f"{count} keys scanned"
        elif name == "flush":
            self.store.flush()
        elif name == "compact":
            yield "compacted" if self.store.compact_once() else "nothing to compact"
        elif name == "full_compaction":
            self.store.compact_full()
        elif name == "dump":
            for row in self.store.levels().orderBy("level").collect():
                yield f"L{row['level']}: {row['files']} files, {row['bytes']} bytes"
        else:
            yield f"invalid command: {line}"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="keystrata")
    parser.add_argument("--path", default="keystrata.db")
    parser.add_argument("--compaction", choices=STRATEGIES, default="leveled")
    parser.add_argument("--no-log", action="store_true", help="keep commits in memory until a flush")
    parser.add_argument("--serializable", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("keystrata").getOrCreate()
    store = Store(spark, args.path, STRATEGIES[args.compaction](), not args.no_log, args.serializable)
    prompt = Prompt(store)
    for line in sys.stdin:
        if line.strip() in ("quit", "close"):
            break
        if line.strip():
            for out in prompt.run(line.strip()):
                print(out)
    store.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
