"""What a task holds while it packs pieces, without Spark."""

import tracemalloc

import numpy as np
import pandas as pd

from tidemark.llm import run_index


def test_packing_holds_texts_not_their_pieces():
    """Pieces are three to four times the text; a task holds less than that, and sends what it packed in parts."""
    draw = np.random.default_rng(2)
    texts = [draw.integers(97, 123, 100_000, dtype=np.uint8).tobytes().decode() for _ in range(160)]
    batch = pd.DataFrame({"doc_id": range(len(texts)), "tag": 0, "text": texts})
    tracemalloc.start()
    sent = [d["pieces"].map(len).sum() for d in run_index._packer(64)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1] - sum(sent)
    tracemalloc.stop()
    assert len(sent) > 4 and max(sent) < 2 * run_index.SENT_AT_ONCE
    assert peak < 4 * 16_000_000
