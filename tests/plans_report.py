"""Write PLANS.md: the physical operator tree of every registered batch
query (sf0.01 paths), as ``explain("formatted")`` prints its first part.

    python tests/plans_report.py
"""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text.split("\n\n\n")[0].strip()


def main() -> None:
    from conftest import core_queries
    from quizlens.session import local_session
    spark = local_session()
    sf = "/root/testdata/sf0.01"
    out = ["# Physical plans", "",
           "Operator trees of the registered batch queries at sf0.01 (`tests/plans_report.py`).",
           "Streaming queries (st1-st4) run when built and are not listed.", "",
           "At this size Catalyst broadcasts some per-key results (for example the per-user",
           "branches of r2) because its size estimate is under `autoBroadcastJoinThreshold`;",
           "on large inputs these are sort-merge joins whose per-key sides are already",
           "hash-partitioned by that key (only the other side is shuffled). Explicit broadcasts",
           "(question bank, hot keys, lemma changes, range starts) go through a check of",
           "their bytes (`quizlens.session.small_side`).", ""]
    for name, fn in core_queries().items():
        if name.startswith("st"):
            continue
        out += [f"## {name}", "", "```", tree(fn(spark, sf)), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
