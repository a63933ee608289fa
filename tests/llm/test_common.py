import random
from pathlib import Path
from types import SimpleNamespace

import pytest

from tests.llm.brute import groups
from thalweg.llm import common


def session(master, **conf):
    get = lambda key, default=None: conf.get(key.replace(".", "_"), default)
    sc = SimpleNamespace(master=master, applicationId="app", getConf=lambda: SimpleNamespace(get=get))
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=get))


def test_folder_is_the_cluster_s():
    assert common.shared_dir(session("spark://h:7077", spark_checkpoint_dir="hdfs://x/c/")) == "hdfs://x/c"
    assert common.shared_dir(session("local[4]")).endswith("thalweg-app") and common.shared_dir(session("local"))
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(session(master))


def test_written_tables_go(spark):
    df = common.cut(spark.range(5), "t")
    where = Path(df.written_to.removeprefix("file:"))
    assert df.count() == 5 and where.is_dir()
    common.drop(df)
    assert not where.exists() and where.parent.is_dir()


@pytest.mark.parametrize("broadcast", [common.BROADCAST, 0])
def test_components(spark, monkeypatch, broadcast):
    """Stars, chains, cliques and loops, with lookups by broadcast and by salted join."""
    monkeypatch.setattr(common, "BROADCAST", broadcast)
    rng = random.Random(2)
    edges = [(1000, k) for k in range(300, 500)] + [(k, k + 1) for k in range(60)] + [(a, b) for a in range(200, 208) for b in range(200, 208)]
    edges += [(rng.randint(600, 900), rng.randint(600, 900)) for _ in range(120)]
    rng.shuffle(edges)
    got = {r.node: r.component_id for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = [(a, b) for a, b in edges if a != b]
    assert got == groups({x for e in linked for x in e}, linked)
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
