"""A prompt for one statement a line: python -m lamina.cli FOLDER [--strict]."""

from __future__ import annotations

import cmd
import sys
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from lamina.session import Engine


class Prompt(cmd.Cmd):
    prompt = "> "

    def __init__(self, engine: Engine, out: Callable[[str], None] = print):
        super().__init__()
        self.engine, self.out = engine, out

    def default(self, line: str) -> bool:
        """Plan, rows and statistics of a query, or what an INSERT did; errors are printed. End of input or exit leaves."""
        if line in ("EOF", "exit", "quit"):
            return True
        try:
            done = self.engine.execute(line)
            if isinstance(done, DataFrame):
                self.out(self.engine.explain(line, "simple"))
                rows, statistics = self.engine.measure(line)
                self.out(rows.to_pandas().to_string(index=False) if rows.num_rows else "(0 rows)")
                self.out(f"({statistics})")
            else:
                self.out(f"OK ({done.rows} rows inserted, {done.folder})" if done else "OK (0 rows inserted)")
        except (ValueError, PySparkException) as e:
            self.out(f"error: {e}")
        return False

    def emptyline(self) -> bool:
        return False


if __name__ == "__main__":
    Prompt(Engine(SparkSession.builder.getOrCreate(), sys.argv[1], "--strict" in sys.argv)).cmdloop()
