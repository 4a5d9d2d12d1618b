"""Signatures of near dedup meet by slot: all rows of those that several documents have, whatever the batches, and no more is held than a slot."""

import random
from collections import defaultdict

import pyarrow as pa

from leafwork.llm import simhash


def brute(rows):
    of = defaultdict(list)
    for doc, n, sigs in rows:
        for s in sigs:
            of[s].append((s, doc, n))
    return sorted(x for group in of.values() if len(group) > 1 for x in group)


def made(seed, docs=300):
    r = random.Random(seed)
    # one signature that all have, negative ones, documents without any, and one with many
    rows = [(i, i % 7, [] if i % 50 == 3 else [-5, *r.sample(range(-600, 600), r.randrange(1, 6)), 10_000 + i]) for i in range(docs)]
    return [*rows, (docs, 3, list(range(20_000, 20_700)))]


def test_signatures_of_several_documents_come_with_all_their_documents(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, "doc_id long, n long, signatures array<long>")
    found = simhash.shared_signatures(df)
    assert sorted(tuple(x) for x in found.collect()) == brute(rows)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Aggregate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 2
    assert simhash.shared_signatures(df.filter("doc_id < 0")).collect() == []


def test_a_slot_is_folded_as_it_passes():
    rows = made(2)
    batch = pa.RecordBatch.from_pydict({"doc_id": [x[0] for x in rows], "n": [x[1] for x in rows], "signatures": pa.array([x[2] for x in rows], pa.list_(pa.int64()))})
    dealt = pa.Table.from_batches(simhash._Dealt(3)(batch.slice(a, 40) for a in range(0, len(rows), 40))).sort_by("slot")
    for size in (1, 2, 1000):
        for most in (1, 50, 10**6):
            batches = dealt.to_batches(max_chunksize=size)
            got = [tuple(x.values()) for b in simhash._Shared(most)(iter([b.slice(0, 0) for b in batches[:1]] + batches)) for x in b.to_pylist()]
            assert sorted(got) == brute(rows)


def test_rows_of_a_signature_that_many_documents_have_are_not_held():
    read = []

    def batches():
        for k in range(50):
            read.append(k)
            yield pa.RecordBatch.from_pydict({"slot": [0], "sig": [[9] * 100], "doc_id": [list(range(100 * k, 100 * k + 100))], "n": [[5] * 100]})

    task = simhash._Shared(100)
    first = next(task(batches()))
    assert first.num_rows == 100 and read == [0]
    assert sum(b.num_rows for b in task(batches())) == 5000
