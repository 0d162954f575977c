"""Links at the threshold whose signatures agree in few coordinates."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ragloom.llm.near_dup import _signatures, least_match, near_dup, shingle_sets


@pytest.mark.parametrize("percent, changed", [(80, 11), (50, 33)])
def test_pairs_with_few_equal_coordinates_are_linked(spark, percent, changed):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(base)]
    for i in range(6000):
        copy = list(base)
        for at in rng.sample(range(100), changed):
            copy[at] = f"x{i}y{at}"
        texts.append(" ".join(copy))
    signatures = _signatures(*shingle_sets(pa.array(texts), 1))
    agree = (signatures[1:] == signatures[0]).sum(1)
    at = int(np.argmin(agree))
    assert least_match(percent) <= agree[at] < 41
    got = near_dup(spark.createDataFrame([(1, texts[0]), (2, texts[1 + at])], "doc_id long, text string"), shingle_words=1, percent=percent).collect()
    assert {r.component_id for r in got} == {1}


def test_no_silent_loss_at_low_thresholds():
    assert least_match(80) == 34 and least_match(100) == 64
    with pytest.raises(ValueError):
        least_match(10)


def test_only_texts_asked_for_are_joined(spark, monkeypatch):
    from ragloom.llm import near_dup as module

    left, real = [], module.asked

    def watched(rows, *args):
        left.append(real(rows, *args).count())
        return real(rows, *args)

    monkeypatch.setattr(module, "asked", watched)
    same = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"{' '.join(f'd{i}x{j}' for j in range(40))}") for i in range(300)] + [(None, same), (500, f"{same} more")]
    got = near_dup(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=2).collect()
    assert sum(r.component_id == 500 for r in got) == 2 and len(got) == len(docs)
    assert left and max(left) < 10
