"""What a batch of texts takes while its lattices are filtered."""

import random
import tracemalloc

import numpy as np

from cohortloom.llm import lattice


def test_a_batch_holds_narrow_edges():
    draw = random.Random(5)
    m = lattice.model()
    texts = [" ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 12))) for _ in range(400)) for _ in range(30)]
    chars = sum(map(len, texts))
    tracemalloc.start()
    ids = lattice.encode_batch(texts, np.arange(30).astype(np.uint64), m)
    most = tracemalloc.get_traced_memory()[1] / chars
    tracemalloc.stop()
    assert [lattice.decode_ids(x.tolist(), m) for x in ids] == texts
    assert most < 220
