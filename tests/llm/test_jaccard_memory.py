import tracemalloc

import pyarrow as pa

from factorloom.llm import jaccardjoin as JJ


def test_hashing_a_batch_holds_little():
    texts = [" ".join(f"word{(k * 7919 + n) % 5003}" for n in range(500)) for k in range(1000)]
    column = pa.array(texts)
    tracemalloc.start()
    sizes = [len(s) for s in JJ.sets_of(column, 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [496] * 1000
    assert peak < 100e6
