"""Tables in the shared folder: who owns them, and where they may be."""

import os
from types import SimpleNamespace

import pytest

from loopweave import storage


def there(df):
    return os.path.exists(df.written_path.removeprefix("file:").replace("//", "/"))


def test_scratch_keeps_what_it_is_told(spark):
    with storage.scratch():
        with storage.scratch():
            a, b = storage.written(spark.range(3), "a"), storage.keep(storage.written(spark.range(4), "b"))
        assert not there(a) and there(b) and b.count() == 4
    assert not there(b)
    with pytest.raises(ValueError), storage.scratch():
        c = storage.written(spark.range(3), "c")
        raise ValueError
    assert not there(c)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
