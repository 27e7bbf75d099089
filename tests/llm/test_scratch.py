from types import SimpleNamespace

import pytest

from quern.llm import scratch


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, applicationId="app-1"), conf=SimpleNamespace(get=lambda key, default=None: default))


def test_only_local_mode_has_a_folder_of_its_own():
    assert scratch.shared_root(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch.shared_root(session("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_root(session(master))
