"""Cleaning with quarantine against plain Python."""

import hashlib
import random

from quillspark.operators.cleaning import clean_rows


def expected(rows):
    parents = {f: f for *_, f in rows}

    def find(x):
        while parents[x] != x:
            x = parents[x]
        return x

    groups = {}
    for row in sorted(rows, key=lambda r: r[0]):
        groups.setdefault(row[1], []).append(row)
    for group in groups.values():
        for row in group:
            a, b = sorted((find(group[0][3]), find(row[3])))
            parents[b] = a
    name = lambda f: "family-" + hashlib.sha256(find(f).encode()).hexdigest()[:24]
    kept, held, counts = set(), set(), dict.fromkeys(["duplicate_rows_removed", "conflicting_prompts", "conflicting_rows_quarantined", "unique_rows"], 0)
    for group in groups.values():
        if len({r[2] for r in group}) > 1:
            counts["conflicting_prompts"] += 1
            counts["conflicting_rows_quarantined"] += len(group)
            held |= {(*r, name(r[3])) for r in group}
            continue
        counts["unique_rows"] += 1
        counts["duplicate_rows_removed"] += len(group) - 1
        kept.add((*group[0], name(group[0][3])))
    return kept, held, {"input_rows": len(rows), **counts}


def test_cleaning_is_that_of_plain_python(spark):
    r = random.Random(4)
    rows = [(i, f"k{r.randrange(120)}", r.choice(["one", "one", "one", "two"]) if r.random() < 0.1 else "one", f"f{r.randrange(80)}") for i in range(300)]
    rows += [(400 + i, "hot", "same", f"h{i % 3}") for i in range(900)]
    rows += [(2000, None, "one", "f1"), (2001, None, None, "n1"), (2002, "", "one", "n2"), (2003, "lone", None, "n3"), (2004, "lone", None, "n4")]
    out = clean_rows(spark.createDataFrame(rows, "id long, key string, label string, family string").repartition(5), key="key", label="label", family="family", order="id")
    kept, held, counts = expected(rows)
    assert {tuple(x) for x in out.kept.collect()} == kept
    assert {tuple(x) for x in out.quarantined.collect()} == held
    assert out.counters == counts
    empty = clean_rows(spark.createDataFrame([], "id long, key string, label string, family string"), key="key", label="label", family="family", order="id")
    assert empty.kept.count() == empty.quarantined.count() == 0 and empty.counters["input_rows"] == 0
