"""Run every registered query (or the named ones) and print row counts and timings."""
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
from learnlog.session import get_spark  # noqa: E402
from learnlog.plans.queries import QUERIES  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(QUERIES)
spark = get_spark()
for n in names:
    t = time.time()
    try:
        df = QUERIES[n](spark, sf)
        c = df.count()
        print(f"OK   {n:28s} rows={c:8d} {time.time()-t:6.2f}s cols={df.columns}", flush=True)
    except Exception as e:  # noqa: BLE001
        print(f"FAIL {n:28s} {type(e).__name__}: {str(e)[:400]}", flush=True)
        traceback.print_exc(limit=3, file=sys.stdout)
