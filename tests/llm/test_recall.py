"""Recall of near-duplicate groups over the documents, against all pairs of the query set."""

import os
from collections import Counter

import numpy as np
import pytest

from murmura.llm import simhash

SF = os.environ.get("RECALL_SF_DIR", "/root/testdata/sf0.01")


def near_pairs(ids, sets, least, step):
    """(a, b, likeness) of every document b with each a whose id is divisible by ``step``, by an index of all shingles."""
    index = {}
    for k, s in enumerate(sets):
        for h in s.tolist():
            index.setdefault(h, []).append(k)
    for a, s in enumerate(sets):
        if ids[a] % step:
            continue
        shared = Counter(b for h in s.tolist() for b in index[h] if b != a)
        for b, n in shared.items():
            likeness = n / (len(s) + len(sets[b]) - n)
            if likeness >= least:
                yield a, b, likeness


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_recall_at_the_threshold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    frame = docs.toPandas().fillna({"text": ""})
    group = dict(simhash.similar_texts(docs).toPandas().drop_duplicates("doc_id").itertuples(index=False))
    ids, sets = frame.doc_id.tolist(), [simhash.shingle_hashes(t, 5) for t in frame.text]
    step = 1 if len(ids) <= 2000 else 20
    found, missed, below = 0, [], np.zeros(5, int)
    for a, b, likeness in near_pairs(ids, sets, 0.5, step):
        if likeness < 0.8 - 1e-9:
            below[int((likeness - 0.5) / 0.06)] += 1
        elif group[ids[a]] == group[ids[b]]:
            found += 1
        else:
            missed.append((ids[a], ids[b], likeness))
    print(f"{SF}: {found} of {found + len(missed)} pairs at 0.8 or more joined; pairs from 0.5 to 0.8 by steps of 0.06: {below.tolist()}")
    assert found > 20 and found >= 0.97 * (found + len(missed)), missed
