"""Functions that run on executors must not need the package there."""

import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as registered
from voxloom.session import build_session
spark = build_session(master="local[2]", **{{"spark.ui.enabled": "false"}})
frame = registered.queries()["model_unavailable_fallback"](spark, "/root/testdata/sf0.001")
print("rows", frame.count(), frame.filter("error IS NULL").count())
"""


def test_models_run_where_the_package_is_not_installed(tmp_path, pytestconfig):
    script = tmp_path / "script.py"
    script.write_text(SCRIPT.format(repo=str(pytestconfig.rootpath)))
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "rows 200" in done.stdout, done.stderr[-2000:]
