"""The exchange of op9_quality draws on all unlabelled documents and hands over the surest that weren't given yet."""

from __future__ import annotations

import random

import numpy as np

from marginalia.llm import quality


def test_pool(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        good = i % 3 > 0
        words = [rng.choice("the of and under house river stone cloud".split()) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "en", f"s{int(good)}", 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample=100)
    assert model.text is not None and max(model.handed) > 100  # more than the labelled rows' bound

    views = {i: (quality.text_view(t), quality.page_view(t, lang, source, n)) for i, t, lang, source, n in rows if i >= 120}
    pool = spark.createDataFrame([(i, bytearray(np.concatenate(v).tobytes())) for i, v in views.items()], "doc_id long, x binary").repartition(4)
    surest, models, given = quality.surest_of(pool, 7), {"text": model.text, "page": model.page}, {"text": {}, "page": {}}
    for _ in range(3):
        got = surest(models, given)
        for to, by, k in (("text", "page", 1), ("page", "text", 0)):
            logit = {i: float(models[by].logit(v[k][None])[0]) for i, v in views.items() if i not in given[to]}
            for label in (0.0, 1.0):
                sure = sorted((abs(x) for x in logit.values() if abs(x) > quality.SURE and (x > 0) == bool(label)), reverse=True)[:7]
                found = [r[0] for r in got[to] if r[1] == label]
                assert len(found) == len(set(found)) == len(sure) and np.allclose([abs(logit[i]) for i in found], sure)
            given[to] |= {r[0]: r[1] for r in got[to]}
    assert max(map(len, given.values())) > 14
