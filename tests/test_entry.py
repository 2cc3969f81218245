import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert sorted(df.columns) == ["from_module", "n", "to_module"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_training_data_operators(tmp_path):
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'module_edges' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    """A machine-local folder is made only where everything runs on one machine."""
    from types import SimpleNamespace

    from weftgraph import runtime

    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)

    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(session(master))
    assert runtime.shared_dir(session("local[4]")).startswith("file://")


def test_scratch_is_cleared(spark, tmp_path):
    """By an application of its own, as the other tests' tables lie in this one's folder."""
    script = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pathlib import Path
from pyspark.sql import SparkSession
from weftgraph import runtime
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {tmp_path.as_uri()!r}).getOrCreate())
assert runtime.staged(spark.range(3), "x").count() == 3
made = list(Path({str(tmp_path)!r}).rglob("*.parquet"))
runtime.clear_scratch(spark)
print("CLEARED" if made and not list(Path({str(tmp_path)!r}).rglob("*.parquet")) else "LEFT")
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert "CLEARED" in done.stdout, done.stderr[-2000:]
