"""What is sent to tasks loads in a process that has no copy of the package."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle, serializers

from candlewake.llm.queries import R

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_secret_scan", "op7_near_dedup", "op11_lexical_search", "op13_exact_dedup"])
def test_shipped_functions_load_without_the_package(spark, monkeypatch, tmp_path, name):
    sent = []
    dumps = serializers.CloudPickleSerializer.dumps
    monkeypatch.setattr(serializers.CloudPickleSerializer, "dumps", lambda self, obj: sent.append(dumps(self, obj)) or sent[-1])
    R.queries[name](spark, SF).count()
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(sent))
    load = "import pickle; print(sum(bool(pickle.loads(x)) for x in pickle.load(open('sent', 'rb'))))"
    got = subprocess.run([sys.executable, "-I", "-c", load], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) == len(sent) > 0
