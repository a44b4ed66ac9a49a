from types import SimpleNamespace

import pytest

from pitwise.session import CHECKPOINT_CONF, scratch_root


def _session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == CHECKPOINT_CONF else default)
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_must_name_the_shared_folder():
    with pytest.raises(RuntimeError, match="shared folder"):
        scratch_root(_session("spark://host:7077"))
    assert scratch_root(_session("spark://host:7077", "hdfs:///scratch")) == "hdfs:///scratch"


def test_one_machine_makes_its_own_folder_once():
    session = _session("local[2]")
    assert scratch_root(session) == scratch_root(session)
