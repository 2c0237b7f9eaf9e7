import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geomill.llm import exact_dedup
from geomill.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(documents, odd_rows, monkeypatch, small):
    if not small:  # the joins that replace the broadcasts
        monkeypatch.setattr(exact_dedup, "FILTER_WORDS", 1)
        monkeypatch.setattr(exact_dedup, "BROADCAST_IDS", 0)
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    rows = [*odd_rows, *[(100 + i, f"a  copy\n{i % 4}") for i in range(50)], *[(200 + i, f"alone {i}") for i in range(200)]]
    want = brute(rows)
    got = exact_duplicates(documents(rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(((i, *want[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows), key=repr)
    # one row of each text is kept, with the smallest id
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len({h for _, h in kept}) == len(kept) == len(want)
    stays = drop_exact_duplicates(documents(rows))
    assert stays.columns == documents(rows).columns
    assert sorted(((r.doc_id, normal(r.text)) for r in stays.collect()), key=repr) == sorted(((k, t) for t, (k, _) in want.items()), key=repr)


def test_empty(documents):
    assert exact_duplicates(documents([])).count() == 0
    assert drop_exact_duplicates(documents([])).count() == 0


def test_plan_is_native(documents, odd_rows):
    plan = exact_duplicates(documents(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_one_id_with_other_texts(documents):
    """Rows with one id are told apart by their texts; of wholly equal ones one stays."""
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (0, "a"), (None, "c"), (None, "d"), (None, "d"), (3, None), (3, "")]
    got = drop_exact_duplicates(documents(rows)).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(0, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "")], key=repr)


def exchanged(df):
    """What the plan's exchanges take in."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange\n(Input \[\d+\]: .*)", plan)


def test_no_text_is_exchanged(documents, odd_rows, monkeypatch):
    """Whatever the size of the filter, digests and ids move, and the documents are read once in the last step."""
    monkeypatch.setattr(exact_dedup, "FILTER_WORDS", 1)
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    seen = []
    written = exact_dedup.scratch.materialize
    monkeypatch.setattr(exact_dedup.scratch, "materialize", lambda df, name: seen.append(exchanged(df)) or written(df, name))
    rows = [(i, t) for i, t in dict((i, t) for i, t in odd_rows).items()]
    docs = exact_dedup.scratch.materialize(documents(rows), "documents")
    seen.clear()
    last = drop_exact_duplicates(docs)
    seen.append(exchanged(last))
    assert len(seen) > 3 and sum(map(len, seen)) > 3
    assert not any("text#" in x for plan in seen for x in plan)
    assert len(re.findall(r"FileScan parquet .*text#", last._jdf.queryExecution().sparkPlan().toString())) == 1

