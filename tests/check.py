"""Run registered queries against their SQL: python tests/check.py FOLDER [NAME ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import connect, differences  # noqa: E402
from tidewatch.plans import load_catalogue  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, entry in load_catalogue().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = entry.build(spark, folder)
            if entry.oracle:
                problems = differences(df, con, entry.oracle)
            else:
                n = df.count()
                problems = [] if n else ["no rows"]
        except Exception as error:  # report and go on
            problems = [repr(error)[:1500]]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':4} {name:28} {time.time() - start:6.2f}s (sql {getattr(differences, 'sql_seconds', 0):.2f}) "
              f"{'' if entry.oracle else '(rows only)'} {' / '.join(problems)}", flush=True)
    print("failed:", failed)
