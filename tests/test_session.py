from types import SimpleNamespace

import pytest

from corpusmill.session import keep, release, release_all, shared_folder


def test_steps_are_deleted(spark):
    kept = keep(spark.range(5).toDF("n"), "five")
    path = kept._kept_at
    assert kept.count() == 5
    release(kept)
    release(kept)  # twice is once
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    other = keep(spark.range(3).toDF("n"), "three")
    release_all(spark)
    with pytest.raises(Exception):
        spark.read.parquet(other._kept_at).count()


def test_no_folder_of_one_machine_on_a_cluster():
    session = lambda master, found: SimpleNamespace(conf={"spark.checkpoint.dir": found} if found else {}, sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("spark://host:7077", "s3a://bucket/steps/")) == "s3a://bucket/steps"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master, None))
