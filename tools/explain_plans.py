"""Print the formatted physical plan of selected registered queries after
execution (AQE final plans), for plan review.

Usage: python tools/explain_plans.py [sf_dir] name ...
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from copyledger.registry import REGISTRY  # noqa: E402
from copyledger.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(app_name="copyledger-explain")
    for name in sys.argv[2:]:
        df = REGISTRY[name](spark, sf_dir)
        df.collect()   # same QueryExecution: explain shows the final AQE plan
        print(f"===== {name} =====")
        df.explain("formatted")


if __name__ == "__main__":
    main()
