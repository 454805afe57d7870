"""Session helpers: the configured checkpoint folder is the one used, and
lineage can be cut there; the job runner writes a query's result."""

import os
import tempfile

from conftest import SF_SMALL
from quadflow.session import cut_lineage, ensure_checkpoint_dir


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    used = ensure_checkpoint_dir(spark)
    if configured:
        assert os.path.basename(configured.rstrip("/")) in used
    df = cut_lineage(spark.range(10).selectExpr("id * 2 AS x"))
    assert df.count() == 10 and "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_job_runner_writes_a_query(spark):
    from quadflow.__main__ import main
    out = os.path.join(tempfile.mkdtemp(prefix="quadflow-out-"), "hot")
    main(["hot_activity_top10", SF_SMALL, out])
    assert spark.read.parquet(out).count() == 10


def test_python_kernels_need_no_package_on_workers():
    """The sequential-fold kernels are shipped by value: a job started from
    another folder (workers cannot import the package) still runs them."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from quadflow.session import get_session\n"
            "from quadflow.plans.catalog import queries\n"
            "s = get_session('local[2]', shuffle_partitions=2)\n"
            "print(queries()['stock_reserve'](s, %r).count(), queries()['trade_log'](s, %r).count())\n"
            % (repo, SF_SMALL, SF_SMALL))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    counts = [int(x) for x in out.stdout.split()[-2:]]
    assert counts[0] > 0 and counts[1] > 0


def test_partitions_follow_the_source(spark):
    """A larger source gets more shuffle partitions, never fewer than the
    session has; sizes that the session names are kept."""
    from quadflow import session
    key, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, named = spark.conf.get(key), spark.conf.get(size, None)
    try:
        spark.conf.set(key, "8")
        spark.conf.set(size, "3m")
        session.fit_partitions(spark, 5 * session.SOURCE_BYTES)
        assert spark.conf.get(key) == "8" and spark.conf.get(size) == "3m"
        session.fit_partitions(spark, 100 * session.SOURCE_BYTES)
        assert spark.conf.get(key) == "100"
        spark.conf.unset(size)
        session.fit_partitions(spark, 0)
        assert spark.conf.get(key) == "100" and spark.conf.get(size) == session.SIZED[size]
    finally:
        spark.conf.set(key, before)
        if named is not None:
            spark.conf.set(size, named)
