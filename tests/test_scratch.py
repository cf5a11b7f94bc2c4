import glob
import os
import threading
from types import SimpleNamespace

import pytest

from threadloom.plans import scratch


def there(df):
    return all(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles())


def test_a_scope_frees_all_but_what_it_keeps(spark):
    before = scratch.cut(spark.range(3), "before")
    with scratch.scope() as kept:
        inner, left = scratch.cut(spark.range(5), "inner"), scratch.cut(spark.range(7), "left")
        kept.append(left)
        files = inner.inputFiles()
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert there(before) and there(left) and left.count() == 7
    scratch.drop(left)
    with pytest.raises(Exception, match="not exist|NOT_EXIST"):
        left.count()


def test_a_scope_frees_after_an_error(spark):
    n = len(scratch._made)
    with pytest.raises(ValueError), scratch.scope():
        scratch.cut(spark.range(2))
        raise ValueError
    assert len(scratch._made) == n


def test_batches_are_small_only_while_a_table_is_written(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = lambda df: df.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    rows = spark.range(0, 5000, 1, 1)
    assert max(r.n for r in scratch.cut(sizes(rows)).collect()) == scratch.BATCH_ROWS
    assert max(r.n for r in sizes(rows).collect()) == 5000 and key not in dict(spark.conf.getAll)
    spark.conf.set(key, "3000")
    try:
        scratch.cut(rows)
        assert spark.conf.get(key) == "3000"
    finally:
        spark.conf.unset(key)


def test_a_scope_leaves_alone_what_other_threads_write(spark):
    """Another thread's tables, a stream's too, outlive a scope that is left meanwhile."""
    inside, left, found = threading.Event(), threading.Event(), {}

    def other():
        inside.wait()
        with scratch.scope():
            table = scratch.cut(spark.range(4), "other")
            found["files"] = table.inputFiles()
            left.set()
            done.wait()
            found["count"] = table.count()

    done = threading.Event()
    thread = threading.Thread(target=other)
    thread.start()
    with scratch.scope():
        scratch.cut(spark.range(2))
        inside.set()
        left.wait()
    done.set()
    thread.join()
    assert found["count"] == 4 and not any(os.path.exists(f.removeprefix("file://")) for f in found["files"])


def test_what_an_inner_scope_keeps_an_outer_one_frees(spark):
    with scratch.scope():
        with scratch.scope() as kept:
            table = scratch.cut(spark.range(3))
            kept.append(table)
        files = table.inputFiles()
        assert table.count() == 3
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_the_last_of_several_writers_restores_the_session(spark):
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"}
    both, threads = threading.Barrier(3), []

    def write():
        with scratch.writing(spark):
            both.wait()

    for _ in range(2):
        threads.append(threading.Thread(target=write))
        threads[-1].start()
    with scratch.writing(spark):
        assert keys <= set(dict(spark.conf.getAll)) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(scratch.BATCH_ROWS)
        both.wait()
    for t in threads:
        t.join()
    assert not keys & set(dict(spark.conf.getAll)) and not scratch._writers


def test_shuffles_of_a_written_table_are_removed(spark):
    folder = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{folder}/**/shuffle_*", recursive=True))
    before = files()
    table = scratch.cut(spark.range(1000).groupBy("id").count())
    assert not files() - before and len(table.collect()) == 1000


def test_no_local_folder_on_a_cluster():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(session)
