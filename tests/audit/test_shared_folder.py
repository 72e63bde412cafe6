from types import SimpleNamespace

import pytest

from lensaudit.plans import queries


def _session(master):
    conf = SimpleNamespace(get=lambda *a: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_stream_on_a_cluster_needs_the_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        queries.block_stream(_session(master), "unread")
