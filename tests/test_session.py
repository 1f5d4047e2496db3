"""The shared folder."""

import types

import pytest

from passagework import session


def test_a_cluster_needs_a_shared_folder():
    def fake(master, path=None):
        conf = types.SimpleNamespace(get=lambda key, default: path)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))

    with pytest.raises(ValueError):
        session.shared_dir(fake("yarn"))
    with pytest.raises(ValueError):
        session.shared_dir(fake("local-cluster[3,2,1024]"))
    assert session.shared_dir(fake("yarn", "hdfs:///x/")) == "hdfs:///x"
    assert session.shared_dir(fake("local[4]"))
