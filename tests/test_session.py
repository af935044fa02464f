"""Settings by the size of the input, and the command line that applies them."""

import pytest

from quayline import __main__ as command
from quayline.session import MB, cluster_conf

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("gigabytes, shuffle", [(0, 200), (1, 200), (100, 400), (100_000, 400_000)])
def test_shuffles_follow_the_input(gigabytes, shuffle):
    conf = cluster_conf(gigabytes * 1024 * MB)
    assert conf["spark.sql.shuffle.partitions"] == str(shuffle)
    assert "RocksDB" in conf["spark.sql.streaming.stateStore.providerClass"]


def test_command_line_sizes_the_session(spark):
    keys = list(cluster_conf(0))
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        size = command.input_bytes(spark, DATA, "parquet")
        assert 400_000 < size < 10 * MB and command.input_bytes(spark, DATA, "csv") == 0
        command.sized_for(spark, DATA, "parquet")
        assert {k: spark.conf.get(k) for k in keys} == cluster_conf(size)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
