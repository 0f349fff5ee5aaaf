"""What the pipeline's stages return."""

import zlib

import numpy as np

from corpus_pipeline import packing
from tests.llm.helpers import AWKWARD, clashing, documents, prose


def test_packing_stage_returns_the_ids(spark):
    rows = packing(spark, clashing(documents(spark, [*AWKWARD, (20, prose(1, 3000))])), "").collect()
    assert rows
    for r in rows:
        assert len(r["ids"]) == r["length"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
