"""Every operator and the pipeline with the package on the driver's path only."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as driver
from granary.session import build_session
spark = build_session("foreign", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
spark.sparkContext.setLogLevel("OFF")

def seen(batches):
    import importlib.util
    for batch in batches:
        yield batch.slice(0, 0)
        if importlib.util.find_spec("granary") is not None:
            raise RuntimeError("the workers can import the package, so this test shows nothing")

spark.range(1).mapInArrow(seen, "id long").collect()
for name, query in driver.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, {folder!r}).write.format("noop").mode("overwrite").save()
        print("done", name, flush=True)
"""


def test_all_operators_run_without_the_package_on_executors(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT, folder=sf_dir))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    names = [x.split()[1] for x in done.stdout.splitlines() if x.startswith("done")]
    assert done.returncode == 0, (names, done.stderr[-3000:])
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names
