import random

import pytest

from quillspark.llm.decontaminate import contamination


@pytest.mark.parametrize("n", [100, 250])
def test_long_items_with_a_fifth_of_their_words_gone_are_found(spark, n):
    r = random.Random(n)
    vocabulary = [f"v{i}" for i in range(3000)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    items = [words(n) for _ in range(60)]
    docs = []
    for i, item in enumerate(items):
        gone = set(r.sample(range(n), n // 5 + (i % 3 == 2)))  # every third is one edit over the limit
        docs.append((i, " ".join([*words(30), *(w for j, w in enumerate(item) if j not in gone), *words(30)])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {x.doc_id: x for x in contamination(d, b).collect()}
    for i in range(len(items)):
        if i % 3 < 2:
            assert (got[i].contaminated, got[i].best_item) == (True, i) and got[i].best_edits <= n // 5
        else:
            # a kept word of the context may stand for one that is gone
            assert not got[i].contaminated or got[i].best_edits <= n // 5
