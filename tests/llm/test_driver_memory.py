"""What the driver's Python keeps of the secrets' model."""

import re
from pathlib import Path

import pytest

from tidemill.llm import secrets

ROLLUP = Path("/proc/self/smaps_rollup")


def held() -> float:
    return int(re.search(r"\n(?:Pss_Anon|Pss):\s+(\d+)", ROLLUP.read_text())[1]) / 1024


@pytest.mark.skipif(not ROLLUP.exists(), reason="memory can't be read here")
def test_the_driver_gives_back_what_the_models_counts_took(spark):
    docs = spark.createDataFrame([(i, "some ordinary words of a text") for i in range(5)], "doc_id long, text string")
    secrets._labelled.cache_clear()
    secrets._labelled_counts.cache_clear()
    before = held()
    model = secrets.MarkovRatio.of(docs)
    assert held() - before < 60
    assert model.table.nbytes < 10 << 20
