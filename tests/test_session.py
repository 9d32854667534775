from types import SimpleNamespace

from palisade import session


def fake(master, **conf):
    get = lambda key, default=None: conf.get(key.replace(".", "_"), default)
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert session.shared_folder(fake("yarn", spark_checkpoint_dir="hdfs://x/c/")) == "hdfs://x/c"
    assert session.shared_folder(fake("yarn")) is None
    assert session.shared_folder(fake("local[2]")) == session.shared_folder(fake("local[2]"))


def test_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
