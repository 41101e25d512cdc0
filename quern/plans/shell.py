"""A line shell: ``python -m quern.plans.shell ROOT``.

Statements, or \\timing, \\trace, \\opt off|heuristic|cost, \\open ROOT, \\close, \\save, \\help, \\q.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession

from .session import Session

HELP = "\\timing  \\trace  \\opt off|heuristic|cost  \\open ROOT  \\close  \\save  \\help  \\q"


def optimized(df: DataFrame) -> str:
    """The plan as the optimizer left it, and what it expects of each step."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost")).rstrip()


class Shell:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.timing, self.trace = spark, False, False
        self.session: Session | None = Session(spark, root)

    def line(self, text: str) -> str | None:
        """What a line prints; None to leave."""
        word, _, rest = text.strip().partition(" ")
        match word:
            case "":
                return ""
            case "\\q" | "exit" | "quit":
                return None
            case "\\help":
                return HELP
            case "\\timing":
                self.timing = not self.timing
                return f"timing {'on' if self.timing else 'off'}"
            case "\\trace":
                self.trace = not self.trace
                return f"optimizer trace {'on' if self.trace else 'off'}"
            case "\\open":
                self._close()
                self.session = Session(self.spark, rest)
                return f"opened {rest}"
            case "\\close":
                self._close()
                return "closed"
        if not self.session:
            return 'err IO "no store is open"'
        match word:
            case "\\opt":
                self.session.set_mode(rest or "cost")
                return f"optimizer {self.session.mode}"
            case "\\save":
                return "every write is saved"
        begun = time.perf_counter()
        result = self.session.execute(text)
        out = result.text()
        if self.trace and result.df is not None:
            out += "\n" + optimized(result.df)
        return f"{out}\n{(time.perf_counter() - begun) * 1000:.1f} ms" if self.timing else out

    def _close(self) -> None:
        if self.session:
            self.session.close()
        self.session = None


def main() -> None:
    shell = Shell(SparkSession.builder.appName("quern").getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else "quern-store")
    for text in sys.stdin:
        out = shell.line(text)
        if out is None:
            break
        print(out, flush=True)


if __name__ == "__main__":
    main()
