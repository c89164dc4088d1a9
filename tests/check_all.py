"""python tests/check_all.py SF_DIR [name...]: compare queries with their checks, with times."""

import sys
import time
import traceback

sys.path[:0] = [__file__.rsplit("/tests/", 1)[0], __file__.rsplit("/", 1)[0]]

from compare import compare, connect  # noqa: E402
from conftest import make_session  # noqa: E402

import __spark_entry__ as e  # noqa: E402

if __name__ == "__main__":
    sf, only = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf)
    bad = 0
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in e.oracle_sql():
                problem = compare(df, con, e.oracle_sql()[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:
            problem = (str(error).strip() or repr(error))[-1500:] if only else str(error).strip()[:600]
            if only:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("bad:", bad)
