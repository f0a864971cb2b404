import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
JOB = """
import sys
sys.path.insert(0, {repo!r})
from newsmill.session import build
spark = build("bare", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false"}})


def lacks(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.record_batch([pa.array([importlib.util.find_spec("newsmill") is None])], ["lacks"])


assert spark.range(1).mapInArrow(lacks, "lacks boolean").first()[0]
import __spark_entry__ as entry
import corpus_pipeline
queries = entry.queries()
for name in ({names}):
    assert queries[name](spark, {sf!r}).count() > 0, name
docs = spark.read.parquet({sf!r} + "/documents.parquet")
for name in ("quality", "decontamination"):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, {sf!r}).count() > 0, name
print("all ran")
"""


def test_workers_need_not_have_the_package(tmp_path):
    names = ("op4_quality_rules", "op7_token_counts", "op8_token_files", "op9_decontaminate",
             "op10_license_scans", "op11_filter_audit")
    job = JOB.format(repo=REPO, sf=SF_DIR, names=", ".join(map(repr, names)) + ",")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "all ran" in done.stdout, done.stderr[-3000:]
