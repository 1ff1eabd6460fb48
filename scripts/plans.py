"""List plan features of every registered query: nested-loop joins, single-task exchanges, Python stages.

usage: plans.py SF_DIR [name-prefix ...]
"""
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from gradeloom.plans import catalog
from gradeloom.session import local_session

spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
spark.conf.set("spark.sql.adaptive.enabled", "false")
for name, fn in catalog.QUERIES.items():
    if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
        continue
    plan = fn(spark, sys.argv[1])._jdf.queryExecution().executedPlan().toString()
    count = lambda p: len(re.findall(p, plan))
    print(f"{name}: scans={count('FileScan')} exchanges={count(r'[^d]Exchange ')} single={count('Exchange SinglePartition')} "
          f"nested={count('BroadcastNestedLoopJoin|CartesianProduct')} bcast={count('BroadcastExchange')} python={count('EvalPython|MapInPandas|FlatMapGroups')} "
          f"limit={count('WindowGroupLimit')}", flush=True)
    if len(sys.argv) > 3 and sys.argv[-1] == "-v":
        print(plan)
